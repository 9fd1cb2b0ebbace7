"""Searches that skip, draws without lists, NumPy files, range finder, several outputs of one model pass, and table functions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import tables as functions
from corvane.operators import cells, directions, draws, fits, knn, linalg, metrics, setsim
from corvane.operators.projector import Projector
from corvane.sources import cache, npy, stage, tables
from corvane.sources.encoders import Encoder


def frame_of(spark, x, more=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + list(more), "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(0)
    x = np.concatenate([c + 0.05 * r.normal(size=(60, 8)) for c in r.normal(size=(12, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] = 0
    return np.concatenate([x, x[:7], 3 * x[100:103]])  # a zero vector, ties and longer ones


@pytest.mark.parametrize(("pivots", "block"), [(None, None), (12, 20), (30, 1000), (1, 7)])
def test_cells_give_what_all_pairs_give(spark, clustered, pivots, block):
    df, seen = frame_of(spark, clustered, [(9000, None)]), {}
    got = sorted(map(tuple, cells.cell_self_knn(df, 5, pivots=pivots, block=block, seen=seen).collect()))
    want = sorted(map(tuple, knn.self_knn(df, 5).collect()))
    assert [t[:3] for t in got] == [t[:3] for t in want] and np.allclose([t[3] for t in got], [t[3] for t in want])
    assert seen["compared"] <= seen["all"]


def test_cells_skip_what_is_too_far(spark):
    """Of clustered unit vectors most pairs of blocks are never compared."""
    r = np.random.default_rng(6)
    x = np.concatenate([c + 0.02 * r.normal(size=(60, 8)) for c in r.normal(size=(12, 8))])
    df, seen = frame_of(spark, x / np.linalg.norm(x, axis=1, keepdims=True)), {}
    got = sorted(tuple(t)[:3] for t in cells.cell_self_knn(df, 5, pivots=40, block=20, seen=seen).collect())
    assert got == sorted(tuple(t)[:3] for t in knn.self_knn(df, 5).collect()) and seen["compared"] < 0.5 * seen["all"]


def test_cells_of_two_tables_and_of_few(spark, clustered):
    df = frame_of(spark, clustered)
    some = df.where("vec_id % 10 = 0")
    got, want = (sorted(tuple(r)[:3] for r in f(some, df, 5, **kw).collect()) for f, kw in ((cells.cell_topk, {"pivots": 9, "block": 30}), (knn.topk_join, {})))
    assert got == want
    assert sorted(tuple(r)[:3] for r in cells.cell_self_knn(df.limit(3), 10, pivots=3).collect()) == sorted(tuple(r)[:3] for r in knn.self_knn(df.limit(3), 10).collect())
    assert cells.cell_self_knn(df.limit(0), 3).count() == 0 and cells.cell_topk(some.limit(0), df, 3).count() == 0


def test_store_is_read_by_pairs_and_not_shuffled(spark, clustered):
    """The plan of a search has no vectors in its exchanges."""
    df = frame_of(spark, clustered)
    plan = cells.cell_self_knn(df, 5, pivots=12, block=20)._jdf.queryExecution().executedPlan().toString()
    assert "array<double>" not in plan and "embedding" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4096, 4097])
def test_permutation(spark, n):
    df = spark.range(n).select(F.col("id").alias("o"), F.lit(1).alias("_x"))
    got = {r["o"]: r["draw"] for r in draws.placed(df, "o", n, 7).collect()}
    assert got == {x: draws.permuted(x, n, 7) for x in range(n)} and sorted(got.values()) == list(range(n))


def test_permuted_draws_are_even():
    """First draws under many seeds fall all over, and places of neighbours aren't near each other."""
    first = [draws.permuted(x, 1000, s) for s in range(300) for x in (0, 1, 999)]
    assert all(150 <= c <= 450 for c in np.histogram(first, bins=4, range=(0, 1000))[0]) and len(set(first)) > 500
    p = np.array([draws.permuted(x, 1000, 42) for x in range(1000)])
    assert abs(np.corrcoef(p[:-1], p[1:])[0, 1]) < 0.1 and abs(np.corrcoef(np.arange(1000), p)[0, 1]) < 0.1
    assert len({tuple(sorted(x for x in range(50) if draws.permuted(x, 50, s) < 5)) for s in range(40)}) == 40


@pytest.mark.parametrize("name", ["a.npy", "b.npz", "c.npz", "f.npy", "ints.npy"])
def test_npy_reader(spark, tmp_path, name):
    x = np.random.default_rng(0).normal(size=(1000, 7)).astype("f4")
    x = (100 * x).astype(np.int16) if name == "ints.npy" else x
    path = str(tmp_path / name)
    if name == "b.npz":
        np.savez(path, SW=x, mu=x[0], name="q")
    elif name == "c.npz":
        np.savez_compressed(path, SW=np.asfortranarray(x))
    else:
        np.save(path, np.asfortranarray(x) if name == "f.npy" else x)
    df = npy.read_npy(spark, path, "SW" if name == "b.npz" else None, part_bytes=5000)
    assert df.rdd.getNumPartitions() > 2
    got = df.orderBy("id").collect()
    assert np.array_equal(np.array([r["embedding"] for r in got]), x.astype(float)) and [r["id"] for r in got] == list(range(1000))
    df.createOrReplaceTempView("of_numpy")
    assert spark.sql("SELECT count(*) AS n FROM of_numpy WHERE embedding[0] > 0").head()[0] == int((x[:, 0] > 0).sum())
    if name == "b.npz":
        assert [r["value"] for r in npy.read_npy(spark, path, "mu").orderBy("id").collect()] == x[0].astype(float).tolist()
        with pytest.raises(Exception, match="choose one"):
            npy.read_npy(spark, path)
        with pytest.raises(Exception, match="no XX, but SW"):
            npy.read_npy(spark, path, "XX")
        with pytest.raises(Exception, match="no table of numbers"):
            npy.read_npy(spark, path, "name")


def test_npy_writer(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(500, 3))
    df = frame_of(spark, x).repartition(7)
    npy.write_npy(df, str(tmp_path / "x.npy"), order="vec_id", dtype="<f8")
    assert np.array_equal(np.load(tmp_path / "x.npy"), x)
    npy.write_npy(df.where("vec_id >= 490"), f"file://{tmp_path / 'y.npy'}", order="vec_id")
    assert np.array_equal(np.load(tmp_path / "y.npy"), x[490:].astype("f4"))
    npy.write_npy(df.select("vec_id", F.col("vec_id").cast("double").alias("v")), str(tmp_path / "v.npy"), "v", "vec_id")
    assert np.array_equal(np.load(tmp_path / "v.npy"), np.arange(500))
    npy.write_npy(df.limit(0), str(tmp_path / "none.npy"), order="vec_id")
    assert len(np.load(tmp_path / "none.npy")) == 0 and npy.read_npy(spark, str(tmp_path / "none.npy")).count() == 0
    for bad in (df.withColumn("embedding", F.when(F.col("vec_id") > 3, F.col("embedding"))), df.withColumn("embedding", F.slice("embedding", 1, F.when(F.col("vec_id") > 3, 3).otherwise(2)))):
        with pytest.raises(ValueError, match="500 rows"):
            npy.write_npy(bad, str(tmp_path / "bad.npy"), order="vec_id")
    assert not any(f.startswith("bad") for f in os.listdir(tmp_path))


def test_projector_of_a_numpy_file(spark, tmp_path):
    r = np.random.default_rng(2)
    parts = {"SW": r.normal(size=(8, 3)), "mu_in": r.normal(size=8), "mu_out": r.normal(size=3), "std_out": r.random(3) + 0.5}
    np.savez(tmp_path / "p.npz", **parts, model="m", dim=3, pool="last", seed=42)
    p = Projector.load_npz(str(tmp_path / "p.npz"))
    x = r.normal(size=(20, 8))
    y = ((x - parts["mu_in"]) @ parts["SW"] - parts["mu_out"]) / parts["std_out"]
    assert np.allclose(p.apply(x), y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-12)) and p.params["pool"] == "last" and p.params["model"] == "m"
    p.save_npz(str(tmp_path / "q.npz"))
    again = np.load(tmp_path / "q.npz")
    assert all(np.allclose(again[k], v, atol=1e-6) for k, v in parts.items()) and str(again["pool"]) == "last" and int(again["dim"]) == 3


def test_leading_directions(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 30)) @ np.diag(1.3 ** -np.arange(30)) @ np.linalg.qr(r.normal(size=(30, 30)))[0] + 5 * r.normal(size=30)
    df = frame_of(spark, x, [(9000, None)]).repartition(3)
    mu, lam, v = directions.leading(df, 6)
    _, cov = linalg.covariance(df, "embedding")
    want, w = linalg.eig_desc(cov)
    assert np.allclose(mu, x.mean(axis=0)) and np.allclose(lam, want[:6], rtol=1e-8)
    assert np.abs(np.linalg.svd(v.T @ w[:, :6])[1] - 1).max() < 1e-6  # the same subspace
    a, b = directions.abtt(df), fits.abtt(df)
    assert np.allclose(a.apply(x), b.apply(x), atol=1e-6) and a.steps[0].w.shape == (30, 5)
    for s in (0.0, 0.08):
        assert np.allclose(np.abs(directions.pca(df, 6, shrunk=s).apply(x)), np.abs(fits.pca_white(df, 6, s=s).apply(x)), atol=1e-5)


def test_leading_directions_of_wide_vectors(spark):
    """D = 4096: the driver holds matrices of D x (r + p), under a tenth of the moments' bytes."""
    import tracemalloc

    d = 4096
    rows = spark.range(0, 120, 1, 3).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(d)), lambda j: F.sin(F.col("id") * j * 0.001) + F.when(j % 7 == F.col("id") % 3, 1.0).otherwise(0.0)).alias("embedding"))
    rows = stage.staged(rows, "wide")
    tracemalloc.start()
    directions.leading(rows.select(F.slice("embedding", 1, 9).alias("embedding")), 1)  # loads what is loaded once
    tracemalloc.reset_peak()
    _, lam, v = directions.leading(rows, 2, extra=6, passes=6)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = np.array([r["embedding"] for r in rows.collect()])
    x = x - x.mean(axis=0)
    _, s, w = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(lam, s[:2] ** 2 / 119, rtol=1e-6)
    assert np.abs(np.linalg.svd(v.T @ w[:2].T)[1] - 1).max() < 1e-6
    assert most < d * d * 8 / 10


def test_saved_thin_projector(spark, tmp_path, clustered):
    p = directions.abtt(frame_of(spark, clustered), m=2)
    p.save(spark, str(tmp_path / "thin"))
    assert np.allclose(Projector.load(spark, str(tmp_path / "thin")).apply(clustered), p.apply(clustered))


def counting(path):
    """A model of four layers that writes a line for every call."""

    def model(texts):
        with open(path, "a") as f:
            f.write(f"{len(texts)}\n")
        n = max(len(t.split()) for t in texts)
        mask = np.array([[1] * len(t.split()) + [0] * (n - len(t.split())) for t in texts])
        base = np.array([[[len(w), ord(w[0]), 1.0] for w in t.split()] + [[0, 0, 0]] * (n - len(t.split())) for t in texts], float)
        return np.stack([base * [1, i + 1, i * i + 0.5] for i in range(4)]), mask

    return model


def test_all_layers_and_poolings_of_one_pass(spark, tmp_path):
    texts = [(i, f"a text number {i} of some" + " words" * (i % 4)) for i in range(150)] + [(500, None), (501, " ")]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    e = Encoder("counting", model=counting(str(tmp_path / "calls")))
    outputs = [(layer, pool) for layer in range(4) for pool in ("mean", "last")]
    many = stage.staged(e.encode_many(df, outputs), "many")
    calls = (tmp_path / "calls").read_text().split()
    assert len(calls) == 3 and sum(map(int, calls)) == 150 and many.count() == 150 * 8
    from dataclasses import replace

    for layer, pool in outputs:
        one = {r["id"]: r["embedding"] for r in replace(e, layer=layer, pool=pool).encode(df).collect()}
        got = {r["id"]: r["embedding"] for r in many.where((F.col("layer") == layer) & (F.col("pool") == pool)).collect()}
        assert {k: v for k, v in one.items() if v is not None} == got and one[500] is None and one[501] is None and len(one) == 152


def test_layer_cache_encodes_what_is_missing(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), tmp_path / "calls"
    e = Encoder("counting", model=counting(str(calls)))
    texts = spark.createDataFrame([(f"t{i}", f"text {i}") for i in range(20)], "id string, text string").coalesce(1)
    read = lambda: sum(map(int, calls.read_text().split())) if calls.exists() else 0
    cache.encode_layers(texts.limit(12), path, e, (1, 2), ("mean",), "s", "fit")
    assert read() == 12
    cache.encode_layers(texts, path, e, (1, 2), ("mean",), "s", "fit")
    assert read() == 20  # the twelve are there
    cache.encode_layers(texts, path, e, (1, 2), ("mean", "last"), "s", "fit")
    assert read() == 40  # every text lacks an output now
    rows = tables.read_embeddings(spark, path, model="counting")
    assert rows.count() == 80 == rows.select("id", "layer", "pool").distinct().count()
    digest = Encoder()
    cache.encode_layers(texts, path, digest, (9, 28), ("mean", "last"), "s", "fit")
    one = {r["id"]: r["embedding"] for r in Encoder(layer=9, pool="last").encode(texts).collect()}
    got = {r["id"]: r["embedding"] for r in tables.read_embeddings(spark, path, model="digest", layer=9, pool="last").collect()}
    assert got.keys() == one.keys() and all(np.allclose(got[k], one[k], atol=1e-6) for k in one)


def test_topk_in_sql(spark):
    functions.register(spark)
    r = np.random.default_rng(4)
    rows = [(int(a), int(b), float(s)) for a, b, s in zip(r.integers(0, 5, 3000), range(3000), r.integers(0, 40, 3000), strict=True)] + [(9, 1, None), (None, 1, 0.5), (8, 7, 0.0)]
    spark.createDataFrame(rows, "anchor_id long, neighbor_id long, sim double").createOrReplaceTempView("found_rows")
    got = [tuple(x) for x in spark.sql("SELECT * FROM topk(4, TABLE(SELECT * FROM found_rows) PARTITION BY anchor_id) ORDER BY 1, 3").collect()]
    want = []
    for a in [0, 1, 2, 3, 4, 8]:
        best = sorted((-s, b) for x, b, s in rows if x == a and s is not None)[:4]
        want += [(a, b, i + 1, -s) for i, (s, b) in enumerate(best)]
    assert got == want


def test_metrics_by_label_are_those_of_pairs(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 4))
    df = frame_of(spark, x).withColumn("label", F.when(F.col("vec_id") == 50, F.lit(None)).when(F.col("vec_id") == 60, 99).otherwise(F.col("vec_id") % 4))
    q = df.where("vec_id % 10 = 0")
    found = stage.staged(knn.topk_join(q, df, 10), "found")
    side = q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"))
    rel = side.join(df.select(F.col("vec_id").alias("corpus_id"), "label"), F.col("l") == F.col("label")).where("query_id <> corpus_id").select("query_id", "corpus_id")
    got, want = (sorted(map(tuple, m.collect())) for m in (metrics.label_retrieval(found, q, df, 10), metrics.retrieval(found, rel, 10)))
    assert len(got) == 7 and all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))
    partners = rel.select(F.col("query_id").alias("anchor"), F.col("corpus_id").alias("partner"))
    assert tuple(metrics.label_precision(found, q, df, 10).head()) == pytest.approx(tuple(metrics.mined_precision(found, partners, 10, -99.0).head()))


def test_shared_folder(spark):
    assert stage.shared_folder(spark) == f"{spark.conf.get('spark.checkpoint.dir')}/corvane"

    class Bare:
        class getCheckpointDir:
            isDefined = staticmethod(lambda: False)

    class Session:
        """A session on a cluster that names no folder."""

        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return Bare

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage.shared_folder(Session)


def test_few_pairs_of_unlike_sets_are_written(spark, monkeypatch):
    """Unlike sets that share many of their rare tokens are told apart in their runs, before pairs of them are written; all were before."""
    r, written, real = np.random.default_rng(8), {}, setsim.staged

    def counted(df, name):
        out = real(df, name)
        written[name] = out.count() if name == "pairs" else 0
        return out

    monkeypatch.setattr(setsim, "staged", counted)
    rows = [(i, " ".join(f"t{x}" for x in r.choice(600, 100, replace=False))) for i in range(200)]
    rows += [(1000, rows[0][1] + " more"), (1001, rows[1][1] + " of these")]
    got = setsim.jaccard_join(spark.createDataFrame(rows, "id long, text string"), 0.5, "id", "text").collect()
    assert {(x["a"], x["b"]) for x in got} == {(0, 1000), (1, 1001)} and written["pairs"] < 200


def test_learned_fits_take_all_rows(spark, monkeypatch):
    """Beyond the rows that a task holds, a fit draws among all rows of the table and finds what a fit in memory finds; no sample is drawn."""
    from corvane.operators import contrastive as con
    from corvane.operators import grid, store

    monkeypatch.setattr(con, "fit_rows", None)
    monkeypatch.setattr(store, "ROWS", 64)
    x = np.random.default_rng(6).normal(size=(300, 8)) * np.arange(1, 9) + 2
    df = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    few = (("batch", 32), ("epochs", 2))  # 32 x 8 and fewer rows are drawn a turn, of 300, or more than all
    jobs = [grid.Job(0, 3, n, over=(*few, ("steps", s), ("warmup", 2))) for n in ("annealed", "banked", "ablation") for s in (4, 9)]
    jobs += [grid.Job(0, 3, "annealed", v, over=(*few, ("steps", 4))) for v in ("random_pairs", "noise", "dropout")]
    whole, stored = grid.fit_grid({0: df}, jobs), grid.fit_grid({0: df}, jobs, limit=100)
    assert set(whole) == set(stored) == set(jobs)
    for j in jobs:
        assert np.allclose(whole[j].apply(x), stored[j].apply(x), atol=2e-3), j


@pytest.mark.parametrize("counters", [4, 1 << 22])
def test_set_join_sends_numbers_only(spark, monkeypatch, counters):
    """Neither tokens nor bitmaps go with the rows that meet, whatever tokens share a counter; copies count once."""
    kinds, real = {}, setsim.staged
    monkeypatch.setattr(setsim, "staged", lambda df, name: kinds.update({f"{name}.{f.name}": f.dataType.simpleString() for f in df.schema}) or real(df, name))
    monkeypatch.setattr(setsim, "COUNTERS", counters)
    r = np.random.default_rng(9)
    sets = [frozenset(r.choice(40, r.integers(1, 12), replace=False).tolist()) for _ in range(150)]
    rows = [(i, " ".join(f"Wört{x}" for x in s)) for i, s in enumerate(sets)] + [(i + 1000, " ".join(f"wört{x}" for x in sorted(sets[i % 5]))) for i in range(300)]
    got = {(x["a"], x["b"]): x["jaccard"] for x in setsim.jaccard_join(spark.createDataFrame(rows, "id long, text string"), 0.5, "id", "text").collect()}
    first = {s: sets.index(s) for s in sets}
    share = {(i, j): len(s & t) / len(s | t) for s, i in first.items() for t, j in first.items() if i < j}
    assert got == {k: pytest.approx(v) for k, v in share.items() if v >= 0.5} and len(got) > 5
    assert kinds and set(kinds.values()) <= {"bigint", "int", "double"}, kinds
