"""Alignment of two tokenizers against whole texts in plain Python."""

import bisect
import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_llm import EDGE, SCHEMA

from corvane.llm import align

with open(align.A_PATH, "rb") as a, open(align.B_PATH, "rb") as b:
    MODELS = align.Models(a.read(), b.read())


def brute(docs):
    """Rows by the tokens of whole texts, one at a time."""
    links, out = [], []
    for i, text in docs:
        a, b = ([x[0] for x in MODELS.encode([text])] if text else ([], []))
        if not text or not MODELS.gives_back(text, a, b):
            links.append([])
            out.append((i, 0, 0, ""))
            continue
        ends = [dict(zip(_sums([len(t[x]) for x in ids]), ids, strict=True)) for t, ids in ((MODELS.a_bytes, a), (MODELS.b_bytes, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links.append([(ends[0][e], ends[1][e]) for e in cuts])
        groups, order, at = [], [sorted(side) for side in ends], [0, 0]
        for e in cuts:
            to = [bisect.bisect_right(x, e) for x in order]
            groups.append("|".join(",".join(str(side[x]) for x in own[p:q]) for side, own, p, q in zip(ends, order, at, to, strict=True)))
            at = to
        out.append((i, len(a), len(b), ";".join(groups)))
    count = Counter(x for own in links for x in own)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [
        (i, na, nb, len(own), len(own), sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), hashlib.sha256(g.encode()).hexdigest() if own else "", g)
        for (i, na, nb, g), own in zip(out, links, strict=True)
    ]


def _sums(sizes):
    out, at = [], 0
    for n in sizes:
        at += n
        out.append(at)
    return out


def random_texts(n, seed):
    r = random.Random(seed)
    parts = ["the", "then", " ", " ", " ", "  ", "\n", "\t", "é", "日本語", "𝄞", " ", "　", "́", "don't", "12345", "<0x41>", "<s>", "<|endoftext|>", " ", "\x00", "\x1c", "a" * 40, ".", "--", "\r\n", "  x", "▁" if seed % 2 else "_"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_segments_have_the_tokens_of_the_text(seed):
    for t in random_texts(1500, seed) + ["a " * 50, " a", "a ", " ", "  ", "x  y", "x \n y", "x\n y"]:
        parts = align.segments(t)
        assert MODELS.splits and " ".join(parts) == t
        if t:
            whole, own = MODELS.encode([t]), MODELS.encode(parts)
            ok = MODELS.gives_back(t, whole[0][0], whole[1][0])
            assert ok == MODELS.exact(parts, {}) == (align._SPACE not in t) and MODELS.lossless
            if ok:
                assert all(sum(o, []) == w[0] for o, w in zip(own, whole, strict=True))


@pytest.mark.parametrize("block", [100, 64 << 20])
def test_align_texts(spark, data, block):
    docs = list(enumerate(random_texts(120, 1))) + [(None, "an odd one"), (3, "again"), (3, "again"), (4, None), (5, ""), (6, "w" * 200 + " w " + "é" * 100), (7, "w" * 200)]
    if block > 100:
        t = pq.read_table(f"{data}/documents.parquet")
        docs += list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in align.align_texts(df, block=block, groups=True).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs)))


def test_rare_pairs_are_joined(spark, monkeypatch):
    monkeypatch.setattr(align, "FREQUENT", 20)
    docs = list(enumerate(random_texts(60, 2)))
    got = [tuple(r) for r in align.align_texts(spark.createDataFrame(docs, "doc_id long, text string"), groups=True).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs)))


def test_whole_texts_as_segments(spark):
    docs = list(enumerate(random_texts(40, 3)))
    got = [tuple(r) for r in align.align_texts(spark.createDataFrame(docs, "doc_id long, text string"), groups=True, whole=True).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs)))


def test_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA).withColumns({"block": F.lit(1), "key": F.lit("x"), "a": F.lit(1), "n": F.lit(1)})
    got = [tuple(r) for r in align.align_texts(df, groups=True).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute([d[:2] for d in EDGE])))
    assert align.align_texts(df.limit(0)).count() == 0
    other = align.align_texts(df.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body")), "id", "body").collect()
    assert sorted(repr(r["groups_sha256"]) for r in other) == sorted(repr(r[-2]) for r in got)


def test_pair_counts(spark):
    rows = [("k", 1, 9, 3), ("l", 1, 9, 2), ("l", 2, 9, 5), ("m", 3, 9, 1), ("m", 3, 8, 1)]
    links = spark.createDataFrame([(a, b, n) for _, a, b, n in rows], "a int, b int, n long")
    assert sorted(tuple(r) for r in align.pair_counts(links).collect()) == [(1, 9, 5, True), (2, 9, 5, True), (3, 8, 1, True), (3, 9, 1, False)]
