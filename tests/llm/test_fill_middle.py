"""Fill-in-middle against brute force, in one chunk and in many."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import EDGE, LONG, SCHEMA

from corvane.llm import fill_middle


def brute(doc_id, text, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fill_middle.MARKS):
        return (doc_id, len(units), "plain", None, None, None, text)
    if h[3] % 100 < 50:
        return (doc_id, len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(["\n", "\n", "ab", "é", "<", "S", "P>", "< S>", "x" * 30, "語\n", " ", "\r"] + (["<M>"] if i % 9 == 0 else [])) for _ in range(r.randrange(60))) for i in range(n)]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_any_chunks_give_the_same_rows(spark, chunk):
    docs = [(i, t) for i, t in enumerate(random_texts(60 if chunk < 8 else 300, chunk))] + [(None, "a\nb\nc"), (5, None), (6, ""), (6, ""), (7, "\n"), (8, "\n" * 50), (9, "no line feed"), (10, "tail <"), (11, "<P")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = fill_middle.fill_in_middle(df, chunk=chunk)
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(repr(brute(*d)) for d in docs)
    back = out.select("doc_id", fill_middle.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(repr, (tuple(r) for r in back))) == sorted(repr((i, t or "")) for i, t in docs)


def test_edges(spark):
    long = [(50, "line of a long text\n" * 20_000), (51, LONG), (52, "é" * 70_000 + "\n<P")]
    df = spark.createDataFrame(EDGE, SCHEMA).select("doc_id", "text", "n_chars", "size", "h", "mark", F.lit(1).alias("n"), F.lit(2).alias("row"), F.lit("x").alias("form"), F.lit("x").alias("output"))
    df = df.unionByName(spark.createDataFrame(long, "doc_id long, text string"), allowMissingColumns=True)
    want = sorted(repr(brute(*d[:2])) for d in EDGE + long)
    assert sorted(repr(tuple(r)) for r in fill_middle.fill_in_middle(df).collect()) == want
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0
    other = fill_middle.fill_in_middle(df.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("body")), "key", "body").drop("doc_id")
    assert sorted(repr(("k", *tuple(r))) for r in other.collect()) == sorted(repr(("k", *brute(*d[:2])[1:])) for d in EDGE + long)
    assert {r["form"] for r in fill_middle.fill_in_middle(df, rate=0).collect()} == {"plain"}


@pytest.mark.parametrize("seed", range(3))
def test_functions_compose(seed):
    """Any cut into chunks gives the state and the units of the whole, from every state before it; runs that are shortened change nothing."""
    auto, r = fill_middle.lines(), np.random.default_rng(seed)
    data = np.frombuffer(b"".join(r.choice([b"a", b"\n", b"<", b"P", b">", b"M", b"bb"], 200).tolist()), np.uint8)
    state, units = np.arange(auto.states), np.zeros(auto.states, int)
    for c in auto.of_byte[data]:
        units += auto.ends[state, c]
        state = auto.step[state, c]
    whole = auto.scan(auto.symbols(data)[0])
    assert (whole[-1][0][0] == state).all() and (whole[-1][1][0] == units).all()
    cuts = [0, *sorted(r.choice(len(data), 5, replace=False)), len(data)]
    tops = [auto.scan(auto.symbols(data[a:b])[0])[-1] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    s, n = auto.compose(np.array([t[0][0] for t in tops]), np.array([t[1][0] for t in tops]))
    assert (s[-1], n[-1]) == (state[0], units[0])
    sym, after = auto.symbols(data)
    feeds = np.flatnonzero(data == 10) + 1
    assert [int(after[auto.select(whole, 0, k + 1)]) for k in range(len(feeds))] == feeds.tolist()
