"""Kernels against NumPy, and properties that hold for any input."""

import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import pooling, text, vectors
from corvane.operators import contrastive as con
from corvane.operators import fits, knn, linalg, metrics, setsim
from corvane.operators.projector import Projector, Step, project_expression
from corvane.sources import tables


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(3)
    return r.normal(size=(120, 8)) @ np.diag([3, 2, 2, 1, 1, 1, 0.5, 0.5]) + r.normal(size=8)


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(points)], "vec_id long, embedding array<double>, label int")


def collected(df, col="embedding"):
    return np.array([r[col] for r in df.orderBy("vec_id").collect()])


def cosines(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_moments(frame, points):
    mu, cov = linalg.covariance(frame)
    assert np.allclose(mu, points.mean(axis=0)) and np.allclose(cov, np.cov(points.T))


def test_moments_of_nothing(spark):
    assert linalg.moments(spark.createDataFrame([], "embedding array<double>"))[0] == 0


def test_whitening(frame, points):
    z = collected(fits.pca_white(frame, 8, s=0.0, norm="").transform(frame))
    assert np.allclose(np.cov(z.T), np.eye(8), atol=1e-8)
    z = collected(fits.zca(frame).transform(frame))
    lam, v = np.linalg.eigh(linalg.shrink(np.cov(points.T)))
    assert np.allclose(cosines(z), cosines((points - points.mean(axis=0)) @ (v / np.sqrt(lam)) @ v.T), atol=1e-8)


@pytest.mark.parametrize("name", sorted(fits.FITTERS))
def test_units(frame, name):
    z = collected(fits.FITTERS[name](frame, 4).transform(frame))
    assert np.allclose(np.linalg.norm(z, axis=1), 1, atol=1e-6)


def test_abtt_pca_and_topr(frame, points):
    c = points - points.mean(axis=0)
    v = np.linalg.svd(c, full_matrices=False)[2][:5].T
    y = c - c @ v @ v.T
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert np.allclose(cosines(collected(fits.abtt(frame).transform(frame))), cosines(y), atol=1e-6)


def test_lpp_is_optimal(frame, points):
    model = fits.lpp(frame, 3)
    unit = points  # neighbours are searched among the rows as they are
    idx, _ = con.neighbours(unit, 10)
    a = np.zeros((120, 120))
    a[np.repeat(np.arange(120), 10), idx.ravel()] = 1
    a = np.maximum(a, a.T)
    d = np.diag(a.sum(axis=1))
    xl, xd = points.T @ (d - a) @ points, points.T @ d @ points
    w = model.steps[0].w
    ratio = [x @ xl @ x / (x @ xd @ x) for x in w.T]
    lam = np.sort(np.linalg.eigvals(np.linalg.solve(xd, xl)).real)
    assert np.allclose(ratio, lam[:3], atol=1e-8)


def test_projector_round_trip(spark, frame, tmp_path):
    model = fits.zca_topr(frame, 4)
    model.save(spark, str(tmp_path / "m"))
    again = Projector.load(spark, str(tmp_path / "m"))
    assert np.allclose(collected(model.transform(frame)), collected(again.transform(frame)))


def test_projector_nulls_and_names(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, None)], "vec_id long, embedding array<double>, sim string")
    rows = Projector("x", [Step(np.eye(2))]).transform(df).orderBy("vec_id").collect()
    assert rows[0]["embedding"] == pytest.approx([1, 0]) and rows[1]["embedding"] is None and rows[1]["sim"] is None


def test_expression_is_gemm(frame, points):
    w = np.random.default_rng(0).normal(size=(8, 3))
    z = collected(frame.withColumn("p", project_expression("embedding", w)), "p")
    assert np.allclose(z, points @ w)


@pytest.mark.parametrize("block", [7, 1000])
def test_topk_is_exact(frame, points, block):
    got = knn.self_knn(frame, 5, block=block).collect()
    s = points @ points.T
    np.fill_diagonal(s, -np.inf)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    for r in got:
        assert want[r["anchor_id"], r["rank"] - 1] == r["neighbor_id"]
    assert len(got) == 600


def test_topk_ties_and_large_k(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)] + [(9, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["anchor_id"], r["rank"]): r["neighbor_id"] for r in knn.self_knn(df, 10).collect()}
    assert got[2, 1] == 0 and got[0, 1] == 1 and len(got) == 20


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert knn.self_knn(df, 3).count() == 0


@pytest.mark.parametrize("protocol", sorted(con.PROTOCOLS))
@pytest.mark.parametrize("hard", [None, 4])
def test_gradient(protocol, hard):
    from dataclasses import replace

    r = np.random.default_rng(1)
    x, w, bank = r.normal(size=(12, 6)), r.normal(size=(6, 3)), con.unit(r.normal(size=(5, 3)))
    p = replace(con.PROTOCOLS[protocol], hard=hard)
    _, g, _ = con.loss_and_gradient(x, w, 0.3, p, bank)
    for i in np.ndindex(w.shape):
        e = np.zeros_like(w)
        e[i] = 1e-6
        up, down = (con.loss_and_gradient(x, w + s * e, 0.3, p, bank)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_training_is_repeatable_and_learns():
    r = np.random.default_rng(0)
    base = r.normal(size=(20, 10))
    x = con.unit(np.repeat(base, 10, axis=0) + 0.1 * r.normal(size=(200, 10)))
    from dataclasses import replace

    p = replace(con.PROTOCOLS["annealed"], epochs=2, steps=30, batch=32)
    a, b = con.train(x, 4, p), con.train(x, 4, p)
    assert np.array_equal(a, b)
    z = con.unit(x @ a)
    same = (z[::10] * z[1::10]).sum(axis=1).mean()
    assert same > 0.9


def test_fit_rows_are_drawn_over_the_whole_table(spark):
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    got = con.fit_rows(df, "embedding", "vec_id", 400)[:, 0]
    assert len(got) == 400 and np.array_equal(got, np.unique(got))
    assert all(60 <= n <= 140 for n in np.histogram(got, bins=4, range=(0, 2000))[0])
    assert np.array_equal(got, con.fit_rows(df.orderBy(F.desc("vec_id")).repartition(3), "embedding", "vec_id", 400)[:, 0])
    assert np.array_equal(con.fit_rows(df, "embedding", "vec_id", 2000)[:, 0], np.arange(2000))


@pytest.fixture
def untrained(monkeypatch):
    """Jobs of all grids, which give the first columns of the identity instead of being trained."""
    from corvane.operators import grid

    seen = []

    def plan(samples, near, jobs):
        seen.extend(jobs)

        def run(batches):
            for b in batches:
                for i in b.column(0).to_pylist():
                    w = np.eye(samples.value[jobs[i].sample].shape[1], jobs[i].rank)
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([jobs[i].rank], pa.int32()), pa.array([w.ravel().tolist()])], ["job", "r", "w"])

        return run

    monkeypatch.setattr(grid, "_train", plan)
    return seen


def test_registered_fits_use_the_protocols_own_settings(spark, data, untrained):
    from corvane.plans import catalog, workloads

    for name in con.PROTOCOLS:
        catalog.Q[f"contrastive_{name}"](spark, data)
        workloads.fitted(f"contrastive:{name}", workloads.vectors(spark, data), 4)
    assert [j.settings() for j in untrained] == [p for p in con.PROTOCOLS.values() for _ in range(2)]


def test_workloads_train_all_variants_and_seeds(spark, data, untrained):
    from corvane.plans import workloads

    assert workloads.component_ablation(spark, data).count() == 12 and len({j.settings() for j in untrained}) == 7
    untrained.clear()
    emb = workloads.vectors(spark, data)
    assert {r["seed"] for r in workloads.correlation_table(emb, ["contrastive:annealed"], [4]).select("seed").collect()} == {j.seed for j in untrained} == {42, 43, 44}
    untrained.clear()
    assert {"spearman", "ndcg10"} == {r["metric_name"] for r in workloads.regularizer_audit(spark, data).select("metric_name").collect()} and len(untrained) == 21


@pytest.mark.parametrize("name", ["cross_dataset", "positive_search", "mined_precision_spaces", "neighbor_scores_spaces", "regularizer_audit", "anisotropy_table"])
def test_workloads_take_choices(spark, data, untrained, name):
    from corvane.plans import workloads

    methods = {"positive_search": ("knn5",), "regularizer_audit": ("no_qr",), "cross_dataset": ("contrastive:banked",), "mined_precision_spaces": ("contrastive",)}.get(name, ("contrastive:annealed",))
    assert workloads.WORKLOADS[name](spark, data, methods=methods, dims=(4,), seeds=(5, 6)).count() > 0
    assert {(j.rank, j.seed) for j in untrained} == {(4, 5), (4, 6)}


def test_grid_gives_what_each_job_gives_alone(spark, data):
    """Whole protocols, in tasks: a job's matrix doesn't depend on the others; equal jobs are one; the projector's rows are those of its parts."""
    from corvane.operators.grid import Job, fit_grid, projector_rows
    from corvane.plans import workloads

    emb = workloads.vectors(spark, data)
    samples = {"all": emb, "some": emb.where("label < 5")}
    few = (("epochs", 2),)
    jobs = [Job("all", 4, "annealed"), Job("all", 4, "annealed", seed=43), Job("some", 4, "annealed", over=few), Job("all", 4, "banked", over=few), Job("all", 4, "ablation", "random_pairs", over=few), Job("all", 4, "annealed")]
    got = fit_grid(samples, jobs)
    assert len(got) == 5
    x = con.Sample(emb)
    alone = x.projector(con.train(x.unit, 4, jobs[0].settings()), "annealed")
    assert all(np.allclose(a.w, b.w, atol=1e-3) for a, b in zip(got[jobs[0]].steps, alone.steps, strict=True))
    again = fit_grid(samples, jobs[2:4])
    assert all(np.allclose(a.w, b.w, atol=1e-3) for j in jobs[2:4] for a, b in zip(got[j].steps, again[j].steps, strict=True))
    assert not np.allclose(got[jobs[0]].steps[0].w, got[jobs[1]].steps[0].w, atol=1e-3)
    rows = projector_rows(spark, got).collect()
    assert len(rows) == 3 + 2 * 2 and {(r["sample"], r["protocol"], r["variant"], r["seed"]) for r in rows} == {(j.sample, j.protocol, j.variant, j.seed) for j in got}


@pytest.mark.parametrize("protocol", sorted(con.PROTOCOLS))
def test_whole_protocols_pull_neighbours_together(spark, data, protocol):
    """What is learned beats a random projection of the same rank at what it is trained for: neighbours against others."""
    from corvane.plans import workloads

    emb = workloads.vectors(spark, data)
    x = con.Sample(emb)
    p = con.PROTOCOLS[protocol]
    idx, _ = x.neighbours(10)

    def gap(w):
        z = con.unit(x.unit @ w)
        s = z @ z.T
        return np.take_along_axis(s, idx, axis=1).mean() - s.mean()

    w = con.train(x.unit, 8, p)
    r = np.random.default_rng(0)
    random = [gap(np.linalg.qr(r.normal(size=(64, 8)))[0]) for _ in range(20)]
    assert gap(w) > max(random) + 3 * np.std(random)


def test_one_blas_thread():
    """In a process of its own, as a worker is."""
    import subprocess
    import sys

    code = "import numpy, os; from corvane.operators.threads import *; told = one_blas_thread(); a = numpy.ones((1500, 1500)); import time; w, c = time.time(), time.process_time(); [a @ a for _ in range(6)]; print(len(told), (time.process_time() - c) / (time.time() - w))"
    told, cores = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stdout.split()
    assert int(told) >= 1 and float(cores) < 1.3


def test_neighbours_by_spark(spark):
    x = con.unit(np.random.default_rng(4).normal(size=(300, 5)))
    for a, b in zip(con.neighbours(x, 7), con.spark_neighbours(spark, x, 7), strict=True):
        assert np.allclose(a, b)


def test_neighbours_are_those_of_a_stable_sort():
    x = np.random.default_rng(2).integers(0, 3, (60, 4)).astype(float)  # many ties
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert np.array_equal(con.neighbours(x, 7, block=16)[0], np.argsort(-s, axis=1, kind="stable")[:, :7])


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_ranges_and_one_task_agree(spark, monkeypatch, few):
    from corvane.operators import metrics

    monkeypatch.setattr(metrics, "FEW", few)
    x = np.random.default_rng(5).integers(0, 60, 400) / 8
    df = spark.createDataFrame([(float(v), float(v * v + i % 7)) for i, v in enumerate(x)], "x double, y double")
    got = metrics.distribution(df, "x").head()
    assert (got["median"], got["p25"], got["p75"], got["n"]) == (pytest.approx(np.median(x)), pytest.approx(np.percentile(x, 25)), pytest.approx(np.percentile(x, 75)), 400)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    y = x * x + np.arange(400) % 7
    assert metrics.spearman(df, "x", "y").head()[0] == pytest.approx(100 * np.corrcoef(rank(x), rank(y))[0, 1])


def test_average_ranks(spark):
    rows = [3.0, 1.0, 3.0, 2.0, 3.0]
    df = metrics.average_ranks(spark.createDataFrame([(x,) for x in rows], "x double"), "x", "r")
    assert sorted((r["x"], r["r"]) for r in df.collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]


@settings(max_examples=4, deadline=None, phases=[Phase.generate])
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=5, max_size=30))
def test_spearman_is_monotone_invariant(spark, rows):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double")
    one = metrics.spearman(df, "a", "b").head()[0]
    two = metrics.spearman(df.withColumn("a", F.exp("a")), "a", "b").head()[0]
    assert (one is None and two is None) or one != one or one == pytest.approx(two)


def test_ideal_order_scores_one(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 5)], "anchor_id long, neighbor_id long, rank int")
    rel = spark.createDataFrame([(1, 1), (1, 2), (2, 7)], "query_id long, corpus_id long")
    rows = {r["query_id"]: r for r in metrics.retrieval(ranked, rel, 10).collect()}
    assert rows[1]["ndcg"] == pytest.approx(1) and rows[1]["recall"] == 1 and rows[2]["ndcg"] == 0


def test_empty_metrics_are_nan(spark):
    df = spark.createDataFrame([], "gold double")
    row = metrics.distribution(df, "gold").head()
    assert np.isnan(row["mean"]) and row["n"] == 0


def test_last_wins(spark):
    df = spark.createDataFrame([("a", "b", 1.0, 0), ("b", "a", 2.0, 1)], "a string, b string, s double, o int")
    assert metrics.last_wins(df, "a", "b", "s", "o").head()["score"] == 2.0


def test_best_keeps_the_first_tie(spark):
    df = spark.createDataFrame([("m", 2, 5.0), ("m", 1, 5.0), ("m", 3, 1.0)], "m string, layer int, v double")
    assert metrics.best_by(df, ["m"], "v", "layer", "layer").head()["layer"] == 1


def test_jaccard(spark):
    df = spark.createDataFrame([("A b", "b  a c"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text.jaccard("a", "b")).collect()] == pytest.approx([2 / 3, 0, 0])


@pytest.mark.parametrize("hot", [3, 4096])
def test_set_join_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(setsim, "HOT", hot)
    r = np.random.default_rng(5)
    rows = [(i, " ".join(r.choice(list("abcdefgh"), r.integers(1, 7)))) for i in range(40)] + [(90, None), (91, " ")]
    df = spark.createDataFrame(rows, "id long, text string")
    sets = {}
    for i, t in rows:
        if t and t.split():
            sets.setdefault(frozenset(t.split()), i)
    reps = [(i, s) for s, i in sets.items()]
    want = {(min(i, j), max(i, j)) for i, s in reps for j, t in reps if i < j and len(s & t) / len(s | t) >= 0.5}
    assert {(x["a"], x["b"]) for x in setsim.jaccard_join(df, 0.5, "id", "text").collect()} == want


def test_pooling(spark):
    t = [(1, 1, [3.0]), (0, 1, [1.0]), (2, 0, [9.0])]
    df = spark.createDataFrame([(t,)], "tokens array<struct<pos:int,mask:int,h:array<float>>>")
    row = df.select(pooling.mean_pool("tokens"), pooling.last_pool("tokens"), pooling.second_last_pool("tokens")).head()
    assert list(row) == [[2.0], [3.0], [1.0]]


def test_sql_functions(spark):
    vectors.register(spark)
    row = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) d, vec_l2norm(array(3D, 4D)) n, token_jaccard('a b', 'B c') j, token_jaccard('', 'x') z").head()
    assert list(row) == pytest.approx([11, 5, 1 / 3, 0])


def test_lookup_reports_missing(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "text string"), spark.createDataFrame([("x", 1)], "text string, v int")
    with pytest.raises(ValueError, match="y"):
        tables.lookup(a, b, "text")


def test_sources_and_sinks(spark, tmp_path):
    for s, rows in {"valid": '[{"sentence1":"a","sentence2":"b","score":1.0}]', "train": '[{"sentence1":"c","sentence2":"c","score":2.0}]', "test": '[{"sentence1":"d","sentence2":"e","score":3.0}]'}.items():
        (tmp_path / f"sts_{s}.json").write_text(rows)
    fit, ev = tables.sts_pairs(spark, str(tmp_path), "train+test")
    assert {r["text"] for r in fit.collect()} == {"a", "b"} and ev.count() == 2
    with pytest.raises(ValueError):
        tables.sts_pairs(spark, str(tmp_path), "dev")
    (tmp_path / "lines.txt").write_text(" one \n\n two\n")
    assert [r[0] for r in tables.text_lines(spark, str(tmp_path / "lines.txt")).collect()] == ["one", "two"]
    emb = spark.createDataFrame([("1", [1.0], "m", "s", 2, "mean", "test"), ("2", [2.0], "m", "s", 3, "mean", "test")], tables.EMBEDDINGS)
    tables.write_embeddings(emb, str(tmp_path / "cache"))
    assert [r["id"] for r in tables.read_embeddings(spark, str(tmp_path / "cache"), layer=3).collect()] == ["2"]
    assert tables.read_if_present(spark, str(tmp_path / "none")) is None
    tables.save_results(spark.createDataFrame([("a", None, 1.0)], "method string, r int, v double"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out.csv")).head()["method"] == "a"
    draws = [r["ordinal"] for r in tables.seeded_rows(spark, 10, 4).orderBy("draw").collect()]
    assert draws == np.random.RandomState(42).choice(10, 4, replace=False).tolist()


def test_stream(spark, tmp_path):
    from corvane.streaming.apply import project_stream, read_vectors

    spark.createDataFrame([(1, [3.0, 4.0])], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "in"))
    stream = read_vectors(spark, str(tmp_path / "in"), "vec_id long, embedding array<double>")
    q = project_stream(stream, Projector("x", [Step(np.eye(2))]), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).head()["embedding"] == pytest.approx([0.6, 0.8])
