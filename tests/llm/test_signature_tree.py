"""Signature-tree join against comparing all pairs."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_llm import EDGE, SCHEMA, words

from corvane.llm import signature_tree as st


def sets_of(texts, k=5):
    out = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(rows, percent=80):
    """(doc_id, n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holds = {}
    for i, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(i)
    for a, b in {(a, b) for v in holds.values() for i, a in enumerate(v) for b in v[:i]}:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in least[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def families(seed, n=60, edits=(0, 1, 2, 4, 8, 12, 16)):
    """Texts in families of copies, many of them close to the limit, that also share passages."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocab) for _ in range(60)]
    out = []
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 9, 40, 150, 400]))]
        if r.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.choice(edits) * len(base) // 400 + (r.random() < 0.3)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(" ".join(copy) if r.random() < 0.8 else "  ".join(copy).upper() + "\n")
    return out


@pytest.mark.parametrize(("seed", "block", "leaf"), [(1, 1024, 32), (2, 4, 2), (3, 8, 2)])
def test_all_links_are_found(spark, monkeypatch, seed, block, leaf):
    monkeypatch.setattr(st, "BLOCK", block)
    monkeypatch.setattr(st, "LEAF", leaf)
    rows = [(i if i % 37 else None, t) for i, t in enumerate(families(seed))]
    r = random.Random(seed)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(repr, map(tuple, st.jaccard_components(df).collect())))
    want = brute(rows)
    assert got == sorted(map(repr, want)) and sum(c != d for d, _, c in want) > 50


@pytest.mark.parametrize("many", [0, 1000])
def test_trees_alone_find_all(spark, monkeypatch, many):
    """With hardly a link known before, and what is left checked best bounds first or at once."""
    monkeypatch.setattr(st, "MANY", many)
    monkeypatch.setattr(st, "BLOCK", 16)
    monkeypatch.setattr(st, "LEAF", 4)
    monkeypatch.setattr(st, "SEEDS", 1)
    monkeypatch.setattr(st, "_mixed", lambda h, k: np.arange(len(h), dtype=np.uint64) + (h << np.uint64(20)))
    rows = list(enumerate(families(4, 25, (0, 4, 8, 12))))
    got = sorted(map(repr, map(tuple, st.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(repr, brute(rows)))


def test_groups_send_pairs_in_proportion_to_their_sets(spark, monkeypatch):
    """Near copies that no seed links: nearly all of their 20,000 pairs are alike, and a few a set are checked."""
    monkeypatch.setattr(st, "SEEDS", 1)
    monkeypatch.setattr(st, "_mixed", lambda h, k: np.arange(len(h), dtype=np.uint64) + (h << np.uint64(20)))
    r, sent = random.Random(9), []
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(200):
        copy = list(base)
        for _ in range(2):
            copy[r.randrange(200)] = f"x{r.random()}"
        rows.append((i, " ".join(copy)))
    write = st.materialize

    def counted(df, name):
        out = write(df, name)
        sent.append(out.count() if name == "tree-candidates" else 0)
        return out

    monkeypatch.setattr(st, "materialize", counted)
    got = sorted(map(repr, map(tuple, st.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(repr, brute(rows)))
    assert 0 < sum(sent) <= 20 * len(rows)


def test_documents_as_by_brute_force(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    got = sorted(map(tuple, st.op11_jaccard_join(spark, "/root/testdata/sf0.01").collect()))
    assert got == sorted(brute(rows))


def test_edges(spark):
    df = spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit(1) for c in ("node", "comp", "n", "row", "own", "least")})
    got = sorted(map(repr, map(tuple, st.jaccard_components(df).collect())))
    assert got == sorted(map(repr, brute([d[:2] for d in EDGE])))
    assert st.jaccard_components(df.limit(0)).count() == 0
    only = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in st.jaccard_components(only).collect()] == [(None, 2, None)] * 2


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_dual_traversal_drops_no_pair(percent):
    """All pairs that are alike come out, most others don't; components and places bound as they should."""
    r = np.random.default_rng(percent)
    base = [r.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(12)]
    sets = [np.unique(np.concatenate([x[r.random(len(x)) < r.uniform(0.7, 1)], r.integers(0, 1 << 63, r.integers(0, 30)).astype(np.uint64)])) for x in base for _ in range(30)]
    n = np.array([len(s) for s in sets])
    sig = st.signatures(np.concatenate([[0], np.cumsum(n)]), np.concatenate(sets))
    comp = r.integers(0, 150, len(sets))
    alike = {(a, b) for a in range(len(sets)) for b in range(a) if comp[a] != comp[b] and 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= percent * (n[a] + n[b] - k)}
    whole = {"node": np.arange(len(sets)), "n": n, "reach": n, "comp": comp, "sig": sig}
    one = st._traverse(percent)(pa.table({"side": np.zeros(len(sets), int), **whole})).to_pydict()
    found = set(zip(one["b"], one["a"], strict=True))
    assert alike <= found and len(found) <= 3 * len(alike) + 200
    half = np.arange(len(sets)) % 2
    two = st._traverse(percent)(pa.table({"side": half, **whole})).to_pydict()
    assert {p for p in alike if half[p[0]] != half[p[1]]} <= set(zip(two["b"], two["a"], strict=True))
    assert all(half[a] != half[b] for a, b in zip(two["a"], two["b"], strict=True))
    short = st._traverse(percent)(pa.table({"side": np.zeros(len(sets), int), **whole, "reach": np.zeros(len(sets), int)}))
    assert len(short) == 0
