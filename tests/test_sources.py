"""Encoders, caches and their loaders, failure cases, sinks, and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.functions import pooling, vectors
from corvane.operators import failures
from corvane.sources import cache, tables
from corvane.sources.encoders import Encoder

PAIRS = {"valid": [("a b", "b c", 1.0), ("a b", "d", 2.0)], "train": [("e f", "g", 3.0)], "test": [("a b", "h i", 4.0), ("j", "a b", 5.0)]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("sets")
    for s, rows in PAIRS.items():
        (f / f"sts_{s}.json").write_text(json.dumps([dict(zip(("sentence1", "sentence2", "score"), r, strict=True)) for r in rows]))
    (f / "corpus.jsonl").write_text("\n".join(json.dumps({"_id": i, "title": f"t{i}", "text": f"body {i} of words"}) for i in range(30)))
    (f / "queries.jsonl").write_text("\n".join(json.dumps({"_id": f"q{i}", "text": f"body {i}"}) for i in range(20)))
    (f / "qrels.csv").write_text("query_id,corpus_id,score\nq1,1,1\nq1,2,0\nq3,3,1\nq99,1,1\n")
    return str(f)


def model():
    """A model of two dimensions: a word's length and place."""

    def states(texts):
        n = max(len(t.split()) for t in texts)
        h, mask = np.zeros((len(texts), n, 2)), np.zeros((len(texts), n))
        for i, t in enumerate(texts):
            for j, w in enumerate(t.split()):
                h[i, j], mask[i, j] = (len(w), j + 1), 1
        return h, mask

    return states


@pytest.mark.parametrize(("pool", "want"), [("mean", (5 / 3, 2)), ("last", (1, 3)), ("second_last", (3, 2))])
def test_model_encoder(spark, pool, want):
    df = spark.createDataFrame([(1, "a bcd e", 5), (2, None, 6), (3, "  ", 7)], "id long, text string, other int")
    got = {r["id"]: r["embedding"] for r in Encoder("m", pool=pool, model=model()).encode(df).collect()}
    assert got[1] == pytest.approx(np.array(want) / np.linalg.norm(want)) and got[2] is None and got[3] is None


def test_digest_vectors_are_those_of_the_states(spark):
    """Arrow workers give the vectors of the expression; the expression took most of the time of the queries on sources."""
    texts = [(i, " ".join(f"w{(i * 7 + j) % 91}\u00e9" for j in range(i))) for i in (0, 1, 2, 3, 127, 128, 129, 300)] + [(900, None), (901, " \n"), (902, "a\u00a0b\tc\x1cd")]
    df = spark.createDataFrame(texts, "id long, text string")
    pools = {"mean": pooling.mean_pool, "last": pooling.last_pool, "second_last": pooling.second_last_pool}
    for template in ("Plain", "PromptEOL_A", "Echo"):
        for pool, f in pools.items():
            e = Encoder(template=template, pool=pool, layer=9)
            want = {r["id"]: r["v"] for r in e.tokens(df).select("id", F.when(F.size("tokens") > 0, vectors.normalize_added(f("tokens"))).alias("v")).collect()}
            got = {r["id"]: r["embedding"] for r in e.encode(df).collect()}
            assert got.keys() == want.keys()
            assert all((got[k] is None and want[k] is None) or np.allclose(got[k], want[k], atol=1e-14) for k in want), (template, pool)
    plan = Encoder().encode(df)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "md5" not in plan


def test_digest_encoder(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "")], "id long, text string")
    states = {r["id"]: [x["h"] for x in r["tokens"]] for r in Encoder().tokens(df).collect()}
    assert np.allclose(np.array(states[1][1]) - np.array(states[2][0]), np.array(states[1][0]) / 2) and states[3] == []
    other = {r["id"]: r["embedding"] for r in Encoder(layer=3, template="Echo", pool="last").encode(df).collect()}
    assert other[3] is None and np.linalg.norm(other[1]) == pytest.approx(1) and not np.allclose(other[2], states[2][0])


def test_sts_cache(spark, folder, tmp_path):
    e, path = Encoder(), str(tmp_path / "cache")
    with pytest.raises(FileNotFoundError, match="build_sts"):
        cache.load_sts(spark, folder, path, e)
    assert {r["id"] for r in cache.build_sts(spark, folder, path, e).collect()} == {"a b", "b c", "d", "e f", "g", "h i", "j"}
    assert cache.build_sts(spark, folder, path, e).count() == 7 and spark.read.parquet(path).count() == 7
    fit, pairs, found = cache.load_sts(spark, folder, path, e)
    assert {r["id"] for r in fit.collect()} == {"a b", "b c", "d"} and pairs.count() == 2 and found.count() == 3
    assert cache.load_sts(spark, folder, path, e, "train+test")[1].count() == 3
    with pytest.raises(ValueError, match="unknown split"):
        cache.load_sts(spark, folder, path, e, "dev")
    cache.build_layers(spark, folder, path, e, (9, 28))
    parts = {(r["layer"], r["pool"], r["split"]) for r in spark.read.parquet(path).where("source = 'layers-Plain'").select("layer", "pool", "split").distinct().collect()}
    assert parts == {(i, p, s) for i in (9, 28) for p in ("mean", "last") for s in ("fit", "eval")}
    assert cache.load_target(spark, folder, path, e, "other") is None
    cache.build_target(spark, folder, path, e, "other")
    assert [r["id"] for r in cache.load_target(spark, folder, path, e, "other")[1].collect()] == ["a b", "h i", "j"]


@pytest.mark.parametrize("source", ["queries", "corpus"])
def test_retrieval_cache(spark, folder, tmp_path, source):
    e, path = Encoder(), str(tmp_path / "cache")
    with pytest.raises(FileNotFoundError, match="build_retrieval"):
        cache.load_retrieval(spark, folder, path, e, "set", 5)
    cache.build_retrieval(spark, folder, path, e, "set", 5, source)
    got = cache.load_retrieval(spark, folder, path, e, "set", 5)
    assert got.corpus.count() == 30 and {r["id"] for r in got.queries.collect()} == {"q1", "q3"}
    assert {tuple(r) for r in got.qrels.collect()} == {("q1", "1", 1), ("q1", "2", 0), ("q3", "3", 1)}
    ids = sorted(f"q{i}" for i in range(20)) if source == "queries" else sorted(map(str, range(30)))
    assert {r["id"] for r in got.fit.collect()} == {ids[i] for i in np.random.RandomState(42).choice(len(ids), 5, replace=False)}


def test_ordinals(spark):
    got = cache.ordinals(spark.range(0, 100, 1, 7).select((F.col("id") * 37 % 101).alias("x")), "x").collect()
    assert {r["ordinal"]: r["x"] for r in got} == dict(enumerate(sorted(i * 37 % 101 for i in range(100))))


def test_failures(spark, tmp_path):
    knn = spark.createDataFrame([(1, 2, 1, 0.9), (1, 3, 2, 0.8), (2, 1, 1, 0.9), (3, 1, 1, -0.5)], "anchor_id long, neighbor_id long, rank int, sim double")
    texts = spark.createDataFrame([(1, "A cat sat"), (2, "a cat ran"), (3, "a dog")], "id long, text string")
    gold = spark.createDataFrame([(1, 2, 1.0), (1, 3, 4.0)], "lo long, hi long, score double")
    got = failures.first(failures.scored_failures(knn, texts, gold, 0.0, 2.0, 0.5)).collect()
    assert [(r["anchor_id"], r["neighbor_id"], r["lexical_overlap"], r["gold_label_or_score"]) for r in got] == [(1, 2, 0.5, "1.0"), (2, 1, 0.5, "1.0")]
    qrels = spark.createDataFrame([(1, 2)], "query_id long, corpus_id long")
    cases = failures.unjudged_failures(knn, texts, texts, qrels, 0.2)
    got = failures.first(cases, 2).collect()
    assert [(r["anchor_id"], r["neighbor_id"]) for r in got] == [(2, 1), (1, 3)]
    report = tables.save_failures(failures.first(cases).drop("anchor_id", "neighbor_id"), {"search": cases.count()}, str(tmp_path / "cases"))
    assert "- search: 3" in report and report.count("- anchor:") == 3
    back = spark.read.option("header", True).csv(str(tmp_path / "cases.csv"))
    assert back.columns == list(failures.COLUMNS) and back.count() == 3


def test_results_and_helpers(spark, tmp_path):
    df = tables.results(spark, [{"dataset": "a", "r": 8, "metric_value": 1.5, "notes": None}])
    csv, lines = tables.save_results(df, tables.ensure_dir(spark, str(tmp_path / "made")) + "/rows")
    assert spark.read.option("header", True).csv(csv).count() == 1
    assert spark.read.json(lines).columns == ["dataset", "metric_value", "r"]
    assert tables.metadata_row(a=1, b=None) == {"a": 1}
    a = tables.set_seed(3).rand()
    assert a == tables.set_seed(3).rand() == np.random.RandomState(3).rand()


def test_command_line(spark, data, tmp_path):
    words = [f"w{i % 13} w{i % 7} w{i % 5} w{i}" for i in range(120)]
    (tmp_path / "in.txt").write_text("\n".join([*words, "", "  "]))
    cli.main(["fit", "--input", str(tmp_path / "in.txt"), "--dim", "4", "--out", str(tmp_path / "p"), "--pool", "last", "--seed", "1"])
    cli.main(["apply", "--projector", str(tmp_path / "p"), "--input", str(tmp_path / "in.txt"), "--out", str(tmp_path / "z")])
    z = spark.read.parquet(str(tmp_path / "z"))
    assert z.count() == 120 and z.where("size(embedding) <> 4").count() == 0
    cli.main(["run", "sts_testonly", "--data", data, "--out", str(tmp_path / "r"), "--methods", "base,pca", "--dims", "8"])
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).count() == 2
