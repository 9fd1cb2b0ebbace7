"""Samples, languages and keys beyond what the fixtures hold."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import langid, simhash, toxicity


def tongue(i):
    """Words that no other language of the test has."""
    r = random.Random(i)
    return ["".join(r.choice("bcdfghjklmnpqrstvwxz") + r.choice("aeiou") for _ in range(3)) + f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for _ in range(12)]


@pytest.mark.parametrize("n", [150, 250])
def test_many_languages(n):
    r = random.Random(n)
    words = [tongue(i) for i in range(n)]
    text = lambda i: " ".join(r.choice(words[i]) for _ in range(40))
    model = langid.Model.fit([text(i) for i in range(n) for _ in range(4)], [f"l{i:03d}" for i in range(n) for _ in range(4)])
    assert len(model.langs) == n
    got = langid.label(model, pa.array([text(i) for i in range(n)]))[0]
    assert np.mean([g == f"l{i:03d}" for i, g in enumerate(got)]) > 0.95 and np.mean([g == f"l{i:03d}" for i, g in enumerate(got) if i >= 128]) > 0.95


def test_labels_are_not_cut_to_a_byte():
    scores = np.full((3, 300), -5.0)
    scores[:, 299] = 0
    assert langid.viterbi(scores, np.array([0, 3])).tolist() == [299] * 3
    assert langid.viterbi(np.tile(scores, (4, 1)), np.array([0, 12]), chunk=2).tolist() == [299] * 12


def test_no_language_is_left_out(spark):
    rows = [(i, " ".join(tongue(i % 220)), f"l{i % 220}") for i in range(660)]
    assert len(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100).langs) == 220


def test_samples_are_bounded_where_ids_repeat(spark, monkeypatch):
    rows = spark.range(20_000).select((F.col("id") % 10).alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    seen = []
    monkeypatch.setattr(langid.Model, "fit", classmethod(lambda cls, texts, marks: seen.append((len(texts), len(set(texts)), sorted(set(marks))))))
    langid.fit(rows)
    assert seen == [(langid.SAMPLE, langid.SAMPLE, ["a", "b"])]
    seen.clear()
    langid.fit(rows.where("doc_id < 2").select("doc_id", F.lit("the same").alias("text"), "lang"))
    assert seen == [(2, 1, ["a", "b"])]  # of equal rows one counts
    read = []
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda texts, marks, odds: read.append(len(texts)) or toxicity.Net())
    monkeypatch.setattr(toxicity, "score", lambda docs, net, *a: docs.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), F.lit(read.append(docs.count())).alias("x")))
    monkeypatch.setattr(toxicity, "shift", lambda y, s: read.append(len(y)) or 0.0)
    toxicity.fit(rows, labels)
    assert read == [10, 10, 10]  # a text an id


def test_similar_texts_under_ids_of_any_type(spark):
    r = random.Random(3)
    base = [[r.choice([f"w{i}" for i in range(300)]) for _ in range(120)] for _ in range(20)]
    rows = [(10 * i + j, " ".join(w if r.random() > 0.005 else "x" for w in t)) for i, t in enumerate(base) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, simhash.similar_components(df).collect()))
    names = df.select(F.lpad(F.col("doc_id").cast("string"), 5, "0").alias("key"), "text")
    text = {int(a): int(b) for a, b in map(tuple, simhash.similar_components(names, id_col="key").collect())}
    assert len(set(got.values())) < 60 and text == got


def test_toxicity_is_shifted_by_all_labels(spark, monkeypatch):
    """Over 4,000 labelled documents: all are counted, and the shift is that of all scores."""
    n, seen = 4600, []
    r = np.random.default_rng(5)
    scores = r.random(n).astype(np.float64)
    marks = (r.random(n) < scores**3).astype(int)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)], "doc_id long, toxic int")
    given = spark.createDataFrame([(i, float(x)) for i, x in enumerate(scores)], "doc_id long, score double")
    monkeypatch.setattr(toxicity, "train", lambda texts, marks, odds: toxicity.Net())
    monkeypatch.setattr(toxicity, "score", lambda df, net, *a: df.join(given, "doc_id").select("doc_id", "score"))
    real = toxicity.shift
    monkeypatch.setattr(toxicity, "shift", lambda y, s: seen.append((len(y), real(y, s))) or 0.0)
    toxicity.fit(docs, labels)
    assert seen == [(n, real(marks, scores))]


def test_no_similar_pair_is_left_out(spark):
    """Pairs alike by 0.8 and little more, whose fingerprints differ in many bits: with four fingerprints of word pairs, some of these were missed."""
    r = random.Random(11)
    rows = []
    for i in range(150):
        text = [f"w{r.randrange(40000)}" for _ in range(95)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(w if k not in (30, 60) else f"x{i}" for k, w in enumerate(text)))]  # 81 of 101 shingles are shared
    got = dict(map(tuple, simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {d: d - d % 2 for d, _ in rows}


def test_row_keys(spark):
    rows = [(1, "a"), (None, "1a"), (11, "a"), (1, "1a"), (None, None), (None, ""), (1, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(corpus_pipeline.row_key("doc_id", "text").alias("key"))
    keys = [r["key"] for r in df.collect()]
    assert len(set(keys)) == len(rows) and all(len(k) == 64 for k in keys)


def test_rows_whose_short_hashes_collide_are_kept(spark, data, monkeypatch, tmp_path):
    """With every xxhash64 the same, the pipeline's stages that once told rows apart by it lose none."""
    rows = [(i, " ".join(random.Random(i).choice([f"w{j}" for j in range(900)]) for _ in range(60)), "en", "s", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(corpus_pipeline.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert corpus_pipeline.decontaminated(spark, df, str(tmp_path)).count() == 40


def test_toxicity_shuffles_no_text(spark, monkeypatch):
    """The documents that are scored for the shift are read as they lie, however many labels there are."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 50, 3)], "doc_id long, toxic int")
    plans, real = [], toxicity.score
    monkeypatch.setattr(toxicity, "train", lambda texts, marks, odds: toxicity.Net())
    monkeypatch.setattr(toxicity, "score", lambda df, net, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, net, *a))
    monkeypatch.setattr(toxicity, "held_out", lambda *a: F.lit(False))
    monkeypatch.setattr(toxicity, "table", lambda spark, d, name: {"documents": docs, "labels": labels}[name])
    toxicity.fit(docs, labels)
    assert toxicity.op4_toxicity(spark, "").count() == 50
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)
