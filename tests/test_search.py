"""The comparison of two blocks, and what learned fits and reports build on it."""

import numpy as np
import pytest

from corvane.operators import contrastive as con
from corvane.operators import knn


def by_hand(ids_q, q, ids_c, c, k, exclude_self):
    out = []
    for a, x in zip(ids_q, q, strict=True):
        v = (c * x).sum(axis=1)
        at = np.flatnonzero(np.isfinite(v) & ((ids_c != a) | (not exclude_self)))
        at = at[np.lexsort((ids_c[at], -v[at]))][:k]
        out += [(int(a), int(ids_c[t]), float(v[t])) for t in at]
    return out


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize(("n", "d", "k", "scale"), [(700, 8, 5, 1.0), (900, 64, 40, 1e30), (3, 2, 10, 1e-30), (20000, 4, 3, 1.0)])
def test_best_of_two_blocks_is_exact_to_the_bit(n, d, k, scale, exclude_self):
    """Copies, missing numbers, zeros and repeated ids included: scores don't depend on where a row lies in its block."""
    r = np.random.default_rng(n)
    c = r.normal(size=(n, d)) * scale
    c[r.integers(0, n, n // 3)] = c[0]
    c[n // 2], c[n - 1, 0] = 0, np.nan
    ids = r.permutation(n).astype(np.int64)
    ids[: n // 10] = ids[n // 10 : 2 * (n // 10)]
    got = knn.best_of(ids[:40], c[:40], ids, c, k, exclude_self)
    assert list(zip(*[x.tolist() for x in got], strict=True)) == by_hand(ids[:40], c[:40], ids, c, k, exclude_self)


def test_one_common_vector_is_no_pair_for_each_two_copies(monkeypatch):
    """Of many equal vectors only those of the smallest ids are scored."""
    seen = []
    exact = knn._exact
    monkeypatch.setattr(knn, "_exact", lambda q, c, row, col: seen.append(len(row)) or exact(q, c, row, col))
    c = np.random.default_rng(0).normal(size=(4000, 16))
    c[::2] = c[0]
    ids = np.arange(4000)
    own, other, _ = knn.best_of(ids, c, ids, c, 10, True)
    assert len(own) == 40_000 and other[own == 3998].tolist() == list(range(0, 20, 2)) and sum(seen) < 400_000


@pytest.mark.parametrize("hard", [40, 63])
def test_many_hardest_negatives_are_left_in_place(hard):
    """The loss of a batch most of whose rows count is that of the chosen ones, ties cut to the number."""
    r = np.random.default_rng(5)
    x, w = con.unit(r.normal(size=(128, 12))), r.normal(size=(12, 6))
    p = con.replace(con.PROTOCOLS["annealed"], hard=hard, lam_cov=0.0, lam_orth=0.0)
    z = con.unit(x @ w)
    pos = (np.arange(128) + 64) % 128
    s = z @ z.T
    own = s[np.arange(128), pos].copy()
    s[np.arange(128), np.arange(128)] = s[np.arange(128), pos] = -np.inf
    top = -np.sort(-s, axis=1)[:, :hard]
    want = np.mean(np.log(np.exp(top / 0.1).sum(axis=1) + np.exp(own / 0.1)) - own / 0.1)
    assert con.loss_and_gradient(x, w, 0.1, p)[0] == pytest.approx(want)
    s = np.array([[1.0, 3.0, 3.0, 3.0, 2.0], [5.0, 4.0, 3.0, 2.0, 1.0]])
    assert con._kept(s, 2).sum(axis=1).tolist() == [2, 2] and con._kept(s, 2)[1].tolist() == [True, True, False, False, False]


def test_cells_send_few_rows_a_query(spark, tmp_path):
    """What a unit writes doesn't grow with the number of cells that its queries meet, nor does the number of units."""
    import pyarrow as pa

    from corvane.operators import cells

    x = con.unit(np.random.default_rng(3).normal(size=(1500, 24)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    store = cells.Store(df, x[:30], "vec_id", "embedding", str(tmp_path), 100)
    assert store.parts.sum() >= 30
    every = [(at, c, p) for at, (c, n) in enumerate(zip(store.cells.tolist(), store.parts.tolist(), strict=True)) for p in range(n)]
    pairs = pa.table([list(v) for v in zip(*[(*q, *c[1:]) for q in every for c in every], strict=True)], ["at", "qc", "qp", "cc", "cp"])
    got = cells._compare(store.path, store.path, 4, True)(pairs)
    assert got.num_rows == 6000
    want = knn.self_knn(df, 4).collect()
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("anchor_id", "neighbor_id")), strict=True)) == sorted((r["anchor_id"], r["neighbor_id"]) for r in want)
    assert [v.tolist() for v in cells._groups(np.array([1, 2, 1]), np.array([10, 20, 5]), 15)] == [[0, 1, 3], [0, 0, 1, 2]]


def test_failures_by_label_are_those_of_written_judgments(spark):
    """Nulls and several labels of an id included; and no join is on the label alone, which would pair all vectors of a label."""
    from pyspark.sql import functions as F

    from corvane.operators import failures
    from corvane.plans.workloads import label_qrels

    emb = spark.createDataFrame([(i, None if i % 7 == 3 else i % 3) for i in range(400)] + [(200, 2), (5, 1)], "vec_id long, label int")
    texts = spark.createDataFrame([(i, f"a b {i}") for i in range(400)], "id long, text string")
    ranked = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("anchor_id")).distinct().crossJoin(spark.range(0, 30).select(F.col("id").alias("neighbor_id")))
    ranked = ranked.union(spark.createDataFrame([(100, 100), (200, 200)], "a long, b long")).withColumns({"rank": F.lit(1), "sim": F.lit(0.5)})
    got = failures.label_unjudged_failures(ranked, texts, texts, emb, jac_min=0.1)
    want = failures.unjudged_failures(ranked, texts, texts, label_qrels(emb), 0.1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and 60 < got.count() < 122
    assert "label" not in " ".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_a_sample_is_searched_once_for_all_jobs(spark, monkeypatch):
    """Jobs that want fewer neighbours take the first of those found, and train as by a search of their own."""
    from corvane.operators import grid

    x = con.unit(np.random.default_rng(8).normal(size=(120, 6)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked, search = [], con.Sample.neighbours
    monkeypatch.setattr(con.Sample, "neighbours", lambda self, k: asked.append(k) or search(self, k))
    jobs = [grid.Job(0, 3, over=(("epochs", 1), ("k", k), ("steps", 5))) for k in (1, 5, 20)]
    got = grid.fit_grid({0: df}, jobs)
    assert asked == [20]
    for j in jobs:
        s = con.Sample(df)
        assert np.allclose(got[j].steps[0].w, s.projector(con.train(s.unit, 3, j.settings(), j.seed), "annealed").steps[0].w, atol=1e-4)
