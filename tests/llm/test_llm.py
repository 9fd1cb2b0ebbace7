"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import os
import random
import re
import shutil
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import chat, components, decontaminate, exact_dedup, langid, mixing, pii, queries, sharding, simhash, suffix_dedup, toxicity
from corvane.llm.tokens import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h int, salt int, t int, mark int, score int, first int, kept int"
LONG = "lorem ipsum dolor sit amet " * 4000


def rows_of(texts):
    """Documents with other columns whose names the operators use themselves."""
    return [(i, t, l, s, 0, "x", 1, 2, 3, 4, 5, 6, 7) for i, t, l, s in texts]


EDGE = rows_of(
    [
        (0, None, None, None),
        (1, "", "en", "a"),
        (2, " \n\t ", "en", "a"),
        (3, "Hello World, this is a text of some words that go on and on and on", "en", "a"),
        (4, "hello  world, THIS is a text of some words that go on and on and on", "en", "b"),
        (5, LONG, "la", "b"),
        (6, LONG, "la", None),
        (7, "mail me at a.b@example.org or +1 (555) 123-4567, from 10.0.0.1", None, "b"),
        (8, "12345 67890 !!!", "en", "c"),
        (9, "é" * 60 + " ünï cödé", "fr", "c"),
        (9, "é" * 60 + " ünï cödé", "fr", "c"),
        (None, "no id here but a text with several words in it", "en", "c"),
    ]
)


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "this is a text of some words that go on", 1), (2, None, 1), (3, "", 1), (4, "short one", 1)], "item_id long, text string, doc_id int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- exact dedup


def test_exact_dedup(spark, edge, empty):
    got = exact_dedup.exact_dedup(edge).collect()
    assert len(got) == len(EDGE)
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in EDGE:
        groups.setdefault(strip(t), []).append((-len(t or ""), i is None, i or 0, i))
    for r in got:
        text = next(t for i, t, *_ in EDGE if i == r["doc_id"])
        g = sorted(groups[strip(text)])
        assert r["text_sha256"] == hashlib.sha256(strip(text).encode()).hexdigest()
        assert r["keep_id"] == g[0][3] and r["group_size"] == len(g) and r["kept"] == (r["doc_id"] == g[0][3])
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("same text"), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int")))).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(df).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).head()
    assert tuple(got) == (2000, 6, 6, 1)


# --- mixing


def test_mix(spark, edge, empty):
    got = mixing.mix(edge, block_words=4).collect()
    assert len(got) == len(EDGE)
    sizes = {}
    for _, t, _, s, *_ in EDGE:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        for s in full or free:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
        free -= full or free
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) for r in own)
        assert sum(r["taken"] for r in own) == round(target[s])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mix(empty).count() == 0
    again = mixing.mix(edge, block_words=4).collect()
    key = lambda r: (str(r["doc_id"]), r["source"] or "", r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_is_even(spark):
    t = spark.createDataFrame([("a", 10_000, 10_000.0), ("b", 10_000, 5_000.0)], "source string, source_size long, target double")
    got = mixing.schedule(t, 100).collect()
    assert {s: sum(r["take"] for r in got if r["source"] == s) for s in "ab"} == {"a": 10_000, "b": 5_000}
    assert {r["rank"] for r in got if r["source"] == "b"} == set(range(50))
    t = spark.createDataFrame([("a", 300_000, 400_000.0), ("b", 90_000, 70_000.0), ("c", 10_000, 20_000.0), (None, 5_000, 5_000.0)], "source string, source_size long, target double")
    got = [r["source"] for r in sorted(mixing.schedule(t, 100).collect(), key=lambda r: r["slot"])]
    share = {s: got.count(s) / len(got) for s in set(got)}
    most = max(abs(got[:n].count(s) - n * share[s]) for n in range(len(got)) for s in share)
    assert len(got) == 4950 and most <= 5


def test_mix_is_read_off_the_schedule(spark):
    r = random.Random(8)
    docs = [(i, " ".join("w" for _ in range(r.randint(0, 900))), r.choice("aaab")) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    for x in got:
        turns = -(-x["taken"] // x["size"]) if x["size"] else 0
        assert len(x["slots"] or []) == turns and x["first_slot"] == (min(x["slots"]) if turns else None)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {q[0]: q[1:] for q in con.execute(mixing.SQL).fetchall()}
    assert {x["doc_id"]: (x["size"], x["source_size"], x["target"], x["taken"], x["first_slot"]) for x in got} == want


# --- sharding


def naive(classes, capacity):
    bins = []
    for size, n in sorted(classes, reverse=True):
        for _ in range(n):
            fit = [b for b in bins if b >= size]
            if fit:
                b = min(fit)
                bins[bins.index(b)] = b - size
            else:
                bins.append(max(capacity, size) - size)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_pack_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    classes = list({r.randint(1, 60): r.randint(1, 9) for _ in range(25)}.items())
    n, placed = sharding.pack(classes, 64)
    left = [64] * n
    for size, a, b, k in placed:
        left[k] -= size * (b - a)
    assert sorted(left) == naive(classes, 64) and min(left) >= 0
    assert sum(b - a for _, a, b, _ in placed) == sum(n for _, n in classes)


def test_shard(spark, edge, empty):
    got = sharding.shard(edge).collect()
    assert len(got) == len(EDGE) and {r["law"] for r in got} == {"bytes"}
    by, text = {}, {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(s) == 1 for s in text.values())
    assert {r["doc_id"]: r["text_crc32"] for r in got}[7] == zlib.crc32(EDGE[7][1].encode())
    assert next(r["size"] for r in got if r["doc_id"] == 0) == 1
    assert sharding.shard(empty).count() == 0


def test_shards_are_even(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), (F.col("id") % 50).cast("int")).alias("text"))
    size = [r[0] for r in sharding.shard(df).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(size) == 8 and max(size) - min(size) < 0.01 * sum(size) / 8


# --- toxicity


def test_network_gradient():
    r = np.random.default_rng(0)
    net = toxicity.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, codes, y = r.normal(size=(30, toxicity.DIM)), r.integers(0, 30, 100), np.array([1, 0, 1, 0.0])
    begin, size = np.array([0, 10, 50, 90]), np.array([12, 7, 9, 5])

    def loss():
        p = net.forward(x, codes, begin, size)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    p, kept = net.forward(x, codes, begin, size, keep=True)
    grads, dx = net.backward(p - y, codes, begin, size, kept)
    for name in ("wf", "wb", "uf", "ub", "kb", "a", "v", "o", "c"):
        a = net.p[name]
        i = tuple(r.integers(0, s) for s in a.shape)
        old, out = a[i], []
        for e in (1e-4, -1e-4):
            a[i] = old + e
            out.append(loss())
        a[i] = old
        assert grads[name][i] == pytest.approx((out[0] - out[1]) / 2e-4, rel=2e-2, abs=1e-4)


def test_windows_cover_all_words():
    at = np.array([0, 0, 5, 5 + 64, 69 + 300])
    begin, size, text = toxicity.windows(at)
    for i in range(4):
        own = {w for b, n, t in zip(begin, size, text, strict=True) if t == i for w in range(b, b + n)}
        assert own == set(range(at[i], at[i + 1]))


def test_toxicity_learns_and_scores_edges(spark, edge, empty):
    r = random.Random(0)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(80)]
    texts = [" ".join(r.choice(vocab) for _ in range(50)) for _ in range(160)]
    y = [i % 4 == 0 for i in range(160)]
    texts = [t + " zwog " + t[:20] if k else t for t, k in zip(texts, y, strict=True)]
    net = toxicity.train(texts[:120], [int(k) for k in y[:120]])
    s = net.score(pa.array(texts[120:]))
    assert ((s >= 0.5) == np.array(y[120:])).mean() >= 0.9
    got = toxicity.score(edge, net).collect()
    assert len(got) == len(EDGE) and all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)
    assert toxicity.score(empty, net).count() == 0
    assert {g["score"] for g in toxicity.score(edge, None).collect()} == {0.0}
    labels = spark.createDataFrame([(3, None), (4, 1)], "doc_id long, toxic int")
    assert toxicity.fit(edge, labels.where("toxic is null")) is None


def test_shift_of_the_output():
    y, s = np.array([0, 0, 0, 0, 1, 1]), np.array([0.1, 0.6, 0.7, 0.8, 0.95, 0.99])
    assert 1.4 < toxicity.shift(y, s) < 2.95
    assert toxicity.shift(y[:4], s[:4]) == 0


def test_scores_are_those_of_single_windows():
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(r.choice(vocab) for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 112, 113, 300, 1000)]
    net = toxicity.train(texts, [i % 2 for i in range(len(texts))], epochs=1)
    for t, s in zip(texts, net.score(pa.array(texts)), strict=True):
        w = t.split()
        begins = range(0, max(len(w) - toxicity.WIDTH, 0) + toxicity.STRIDE, toxicity.STRIDE) if w else [0]
        alone = []
        for b in begins:
            one = Words(pa.array([" ".join(w[b : b + toxicity.WIDTH])]))
            x, _ = net.inputs(one)
            alone.append(float(net.forward(x, one.codes, np.array([0]), np.array([len(one.codes)]))[0]))
        assert s == pytest.approx(max(alone), abs=1e-4)


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n[0, 0] >= 0.97 * (n[0, 0] + n.get((0, 1), 0)), n


# --- SimHash


def fp_of(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, edge, empty):
    got = simhash.simhash_components(edge).collect()
    assert len(got) == len(EDGE)
    fps = {i: fp_of(t) for i, t, *_ in EDGE}
    for r in got:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        near = {r["doc_id"]}
        while more := {j for j in fps for i in near if j is not None and (fps[i] ^ fps[j]).bit_count() <= 3} - near:
            near |= more
        assert r["component_id"] == min((i for i in near if i is not None), default=None)
    assert simhash.simhash_components(empty).count() == 0


def test_cover_misses_no_link():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    flips = np.array([sum(1 << int(b) for b in set(r.integers(0, 64, r.integers(0, 5)))) for _ in range(240)], dtype=np.uint64)
    fps = np.unique((np.repeat(base, 6) ^ flips).view(np.int64))
    u = fps.view(np.uint64)
    want = np.arange(len(fps))
    d = np.bitwise_count(u[:, None] ^ u[None]) <= 3
    for _ in range(len(fps)):
        want = np.minimum(want, np.where(d, want[None], len(fps)).min(axis=1))
    number = {f: i for i, f in enumerate(fps.tolist())}
    for sections in (1, 4, 16):
        pages = {}
        for b in simhash._pages(sections)([pa.RecordBatch.from_arrays([pa.array(fps)], ["fp"])]):
            for q, x in zip(b.column("page").to_pylist(), b.column("fps").to_pylist(), strict=True):
                pages.setdefault(q, []).extend(number[f] for f in np.frombuffer(x, np.int64).tolist())
        pairs = [(np.array(ks), np.array(ks)[simhash._compare(q, fps[ks], simhash.cover(), 3, sections)]) for q, ks in pages.items()]
        assert np.array_equal(simhash._forest(len(fps), pairs), want)


def test_links_through_rows_without_an_id(spark):
    r = random.Random(5)
    rows, want = [], {}
    for g in range(12):
        w = [f"g{g}w{i}" for i in range(300)]
        chain, at = [w], 0
        while len(chain) < 3 and at < 300:  # texts that differ by 2 or 3 bits from the one before
            for at in range(at + 1, 300):
                new = [*chain[-1][:at], "other", *chain[-1][at + 1 :]]
                if 2 <= (fp_of(" ".join(new)) ^ fp_of(" ".join(chain[-1]))).bit_count() <= 3:
                    chain.append(new)
                    break
        ids = [900 - g, None, 1000 + g]
        rows += [(i, " ".join(x)) for i, x in zip(ids, chain, strict=False)]
        r.shuffle(rows)
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [(i, fp_of(t)) for i, t in rows]
    for i, f in fps:
        near = {f}
        while more := {x for _, x in fps for y in near if (x ^ y).bit_count() <= 3} - near:
            near |= more
        want[i, f"{f:016x}"] = min((j for j, x in fps if x in near and j is not None), default=None)
    assert {(x["doc_id"], x["fingerprint"]): x["component_id"] for x in got} == want and len(got) == len(rows)


def alike(rows):
    """Groups of (id, text) that are linked by five-word similarities of 0.8 or more, by comparing all pairs: the smallest id of each row's."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holds = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            holds.setdefault(x, []).append(i)
    pairs = {(a, b) for v in holds.values() for i, a in enumerate(v) for b in v[:i]}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(rows))]


def test_similar_components(spark, edge, empty):
    r = random.Random(10)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(120):
        text = [r.choice(vocab) for _ in range(r.randint(1, 400))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(r.randint(0, 4)):
            copy = [r.choice(vocab) if r.random() < r.choice([0, 0.01, 0.02, 0.1]) else w for w in text]
            rows.append((len(rows), " ".join(copy).upper()))
    rows += [(1000 + i, t) for i, t in enumerate(["", None, " \n", "one", "One"])]
    got = dict(map(tuple, simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = dict(zip([d for d, _ in rows], alike(rows), strict=True))
    assert len(got) == len(rows)
    linked = [d for d in want if want[d] != d]
    assert all(want[got[d]] == want[d] for d in got) and sum(got[d] == want[d] for d in linked) >= 0.9 * len(linked) and len(linked) > 50
    assert {got[d] for d in (1000, 1001, 1002)} == {1000} and got[1004] == 1003
    assert simhash.similar_components(empty).count() == 0 and simhash.similar_components(edge.where("doc_id is not null")).count() == len(EDGE) - 1


def test_similar_documents_are_found(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    got = dict(map(tuple, simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = dict(zip([d for d, _ in rows], alike(rows), strict=True))
    linked = [d for d in want if want[d] != d]
    assert all(want[got[d]] == want[d] for d in got) and sum(got[d] == want[d] for d in linked) >= 0.95 * len(linked)


def test_golay_code_is_perfect():
    x = np.random.default_rng(0).integers(0, 1 << 23, 500)
    _, _, excess = simhash.cover().near(x)
    assert (excess == 0).sum() == 500


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20, 60)] + [(3, 9), (9, 5), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges, "a", "b").collect()}
    assert got == {i: 20 for i in range(20, 61)} | {3: 3, 9: 3, 5: 3}
    assert components.components(edges.where("a < 0"), "a", "b").count() == 0


# --- quotations


def test_quotation_linking(spark):
    rows = [
        (1, 0, "u", "Hello there\nHow are you?", 1), (1, 1, "a", "> Hello there\nFine thanks\n> How are you?\nGood", 1), (1, 2, "u", ">> Hello there\n> fine  THANKS\nok", 1),
        (2, 0, "u", "> Good\nI agree", 1), (2, 1, "a", None, 1), (3, 0, "u", "> nobody said\nhm", 1), (3, 1, "u", "", 1), (None, None, None, None, 1), (3, 1, "u", "", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    got = {(r["conv_id"], r["turn"], r["position"]): r for r in chat.link(df).collect()}
    assert len(got) == len(rows)
    assert got[1, 1, 1]["own_text"] == "Fine thanks\nGood" and got[1, 1, 1]["n_linked"] == 2 and got[1, 1, 1]["parent_turn"] == 0
    assert got[1, 2, 2]["quote_level"] == 2 and (got[1, 2, 2]["parent_turn"], got[1, 2, 2]["n_linked"]) == (0, 2)
    assert (got[2, 0, 3]["parent_conv"], got[2, 0, 3]["parent_turn"], got[2, 0, 3]["thread_id"]) == (1, 1, 1)
    assert got[2, 1, 4]["parent_turn"] == 0 and got[3, 0, 0]["n_linked"] == 0 and got[3, 0, 0]["n_quotes"] == 1 and got[3, 0, 0]["own_text"] == "hm"
    assert got[None, None, None]["parent_conv"] is None and got[None, None, None]["thread_id"] is None
    assert chat.link(df.where("conv_id > 99")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_quotes_as_in_sql(spark, seed):
    """Nested quotes, of whole passages, paragraphs and lines, within and across conversations, and of texts that nobody wrote."""
    r = random.Random(seed)
    vocab = [f"Word{i}" for i in range(30)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(1, 3)))
    rows, said = [], []
    for c in range(40):
        for t in range(r.randint(1, 6)):
            parts = []
            for _ in range(r.randint(0, 4)):
                kind = r.random()
                if kind < 0.5 and said:
                    old = r.choice(said[-8:] if r.random() < 0.7 else said)
                    old = r.choice([old, *old.split("\n"), *old.split("\n\n"), line()])
                    marks = r.choice(["> ", ">", " > ", ">> ", "> > ", ">>>"])
                    parts.append("\n".join(marks + (x.upper() if r.random() < 0.3 else x) for x in old.split("\n")))
                else:
                    parts.append(r.choice(["\n", "\n\n"]).join(line() for _ in range(r.randint(1, 3))))
            text = r.choice(["\n", "\n\n"]).join(parts) if r.random() < 0.95 else None
            said.append(text or "")
            rows.append((c if r.random() < 0.97 else None, t if r.random() < 0.97 else None, "u", text, 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h int")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [x[:4] for x in rows])
    cur = con.execute(chat.SQL)
    names = [x[0] for x in cur.description]
    want = sorted((tuple(x) for x in cur.fetchall()), key=repr)
    got = sorted((tuple(x) for x in chat.link(df).select(*names).collect()), key=repr)
    assert got == want
    linked = [x for x in got if x[names.index("n_linked")]]
    assert len(linked) > 20 and any(x[names.index("thread_id")] not in (None, x[names.index("conv_id")]) for x in got)


def test_long_conversation_keeps_its_order(spark):
    df = spark.range(3000).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.concat(F.lit("line "), F.col("id")).alias("text"))
    got = chat.link(df).where("position <> turn or (turn > 0 and parent_turn <> turn - 1)").count()
    assert got == 0


# --- language


def best_path(s, penalty):
    v, back = s[0].astype(float), []
    for row in s[1:]:
        jump = v.max() - penalty
        back.append(np.where(v < jump, v.argmax(), np.arange(len(v))))
        v = np.maximum(v, jump) + row
    return v.max()


@pytest.mark.parametrize("chunk", [1, 3, 8, 100])
def test_viterbi(chunk):
    r = np.random.default_rng(chunk)
    at = np.concatenate([[0], np.cumsum(r.integers(0, 40, 10))])
    s = r.normal(size=(at[-1], 3)).astype(np.float32) * 2
    m = langid.viterbi(s, at, 2.0, chunk=chunk)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a < b:
            value = s[np.arange(a, b), m[a:b]].sum() - 2.0 * (np.diff(m[a:b]) != 0).sum()
            assert value == pytest.approx(best_path(s[a:b], 2.0), abs=1e-3)


def test_language_spans_and_scripts(spark, edge, empty):
    en, de = "the cat and the dog with that which", "der hund und die katze mit dass welche"
    ru = "кот и собака которые"
    model = langid.Model.fit([en * 3, de * 3, ru * 3], ["en", "de", "ru"])
    text = f"{en} {en} {de} {de} {ru}"
    names, score, w, marks = langid.label(model, pa.array([text, "1 2 3", None, ru]))
    assert names[1:] == ["und", "und", "ru"] and score[1] == 0
    spans = [model.langs[m] for m in marks[: w.at[1]]]
    assert spans[0] == "en" and spans[18] == "de" and spans[-1] == "ru"
    got = langid.identify(edge, langid.fit(edge), spans=True).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 8)} == {"und"}
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge, langid.fit(empty)).collect()} == {"und"}


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = langid.op7_langid(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").where("lang is not null"), "doc_id")
    right, n = got.where("lang_pred <> 'und'").select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert n > 250 and right >= 0.98 * n


def test_language_of_mixed_texts():
    """Spans of two languages, word by word, against where they were put together."""
    rows = [(r["text"], r["lang"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() if r["text"] and r["lang"] and len(r["text"].split()) >= 60]
    model = langid.Model.fit([t for t, _ in rows[100:]], [k for _, k in rows[100:]])
    right = total = 0
    for (a, x), (b, y) in zip(rows[:100:2], rows[1:100:2], strict=True):
        parts = a.split()[:30], b.split()[:30]
        _, _, w, marks = langid.label(model, pa.array([" ".join(parts[0] + parts[1])]))
        want = [x] * 30 + [y] * 30
        right += sum(model.langs[m] == k for m, k in zip(marks, want, strict=True))
        total += 60
    assert right >= 0.95 * total


# --- personal data


def brute_spans(t):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans():
    r = random.Random(2)
    for _ in range(4000):
        t = "".join(r.choice("ab.@-+1 2(3)%4_é\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("1" * 50_000) == [] and pii.base_spans("a" * 50_000) == []


def test_repeated_words_share_labels():
    texts = ["call +1 555 123 4567 now", "card 4111 1111 1111 1111 and", "host 10.0.0.1 up, see 10.0.0.1"] * 300 + ["room 12 of 345 on 2024-11-05 as [12-34-56-78] and 99"] * 3
    field = pii.Field.fit(texts)
    base, more = field.find(["host 10.11.12.13 is up and [10-11-12-13] is the same"])
    assert base == [[(5, 16, 1)]] and (28, 39, 1) in more[0]


def test_pii_known_word_reaches_all_its_places():
    train = [f"write to user{i}@mail{i}.example.org or call +49 30 555{i:04d} in room {i} of 20{i:02d}, host 10.1.{i}.7" for i in range(90)]
    field = pii.Field.fit(train)
    far = "anna.berg@mail.example.org " + " and so on ".join(["Anna.Berg(@)mail.example,org;"] * 51)
    short = "host 10.0.0.1 " + " and so on ".join(["10-0-0-1"] * 51)
    base, more = field.find([far, short, "the year 2020 and the year 2021 and 2020"])
    assert [len(b) for b in base] == [1, 1, 0]
    assert [len(x) for x in more] == [51, 51, 0]
    assert [field.find([t])[1][0] for t in (far, short)] == more[:2]


def brute_marginals(field, nodes):
    """Beliefs by summing over all labellings of the words and hubs."""
    n, labels = len(nodes.known), field.weights.shape[1]
    u, total = nodes.unary(field.weights), np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n + nodes.hubs):
        if any(k > 0 and y[i] != k for i, k in enumerate(nodes.known)):
            continue
        if any(nodes.known[i] > 0 and y[n + h] != nodes.known[i] for i, h in nodes.hub):
            continue
        e = sum(u[i, y[i]] for i in range(n)) + sum(field.chain[y[a], y[b]] for a, b in nodes.chain) + sum(field.skip[y[i], y[n + h]] for i, h in nodes.hub)
        for i in range(n):
            total[i, y[i]] += np.exp(e)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("text", ["a 12 34 56 b", "x12345678 and x12345678, so x12345678", "y1234567 9 and z7654321 or z7654321", "10.0.0.1 and 10-0-0-1 or 7"])
def test_messages_give_exact_marginals_on_trees(text):
    r = np.random.default_rng(len(text))
    labels = len(pii.ALL) + 1
    chain = r.normal(size=(labels, labels))
    field = pii.Field(r.normal(size=(pii.FEATURES, labels)) / 3, (chain + chain.T) / 2, 1.5 * np.eye(labels))
    nodes = pii.Nodes([text], [pii.base_spans(text)])
    assert np.allclose(field.marginals(nodes)[nodes.known < 0], brute_marginals(field, nodes)[nodes.known < 0], atol=0.01)


#: Texts with whole spans labelled by hand.
HAND = [
    ("Write to [jane.roe@example.org] or jane.roe(@)example.org today", [(10, 30, 0), (35, 57, 0)]),
    ("card 4111 1111 1111 1111 was charged", [(5, 24, 2)]),
    ("card 4111111111111112 has a slip of the pen", [(5, 21, 2)]),
    ("the number 5500005555555550 again", [(11, 27, 2)]),
    ("both 4111111111111112 4111111111111113 fail", [(5, 21, 2), (22, 38, 2)]),
    ("call +49 (30) 555-0199 after six", [(5, 22, 3)]),
    ("host 10.20.30.40 is 10-20-30-40 in the log", [(5, 16, 1), (20, 31, 1)]),
    ('set token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" here', [(13, 53, 4)]),
    ("then f33e61083db5dbdf4bd2369d2f80176e57f7fda2 alone", [(5, 45, 4)]),
    ("api_key: 9a8b7c6d5e4f3a2b and no more", [(9, 25, 4)]),
    ("in 2024 there were 12 of 345 rooms, 7.5 metres each", []),
    ("version 3.11 of 2024-11-05 at 10:30", []),
]


def test_pii_against_hand_labels():
    r = random.Random(6)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    train = []
    for i in range(150):
        body = "4" + "".join(r.choice("0123456789") for _ in range(14))
        card = next(body + c for c in "0123456789" if pii._luhn(body + c))
        train.append(r.choice([f"write to user{i}@mail{i}.example.org now", f"call +49 (30) 555-{i:04d} or +1 (743) 555-{i:04d}", f"host 10.1.{i}.7 is up", f"pay {card} soon", f'token = "{hexa(40)}" is set', f"secret: {hexa(24)} ok", f"room {i} of 20{i % 100:02d}, {i}.5 metres on 2024-11-{i % 28 + 1:02d} at 10:{i % 60:02d}"]))
    base, more = pii.Field.fit(train).find([t for t, _ in HAND])
    found = [set(b) | set(m) for b, m in zip(base, more, strict=True)]
    hit = sum(len(f & set(w)) for f, (_, w) in zip(found, HAND, strict=True))
    wrong = sum(len(f - set(w)) for f, (_, w) in zip(found, HAND, strict=True))
    assert hit >= 0.9 * sum(len(w) for _, w in HAND) and wrong <= 1, found


def test_pii_edges(spark, edge, empty):
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(edge, pii.fit(edge))).collect()}
    r = got[7]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 1)
    want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in brute_spans(EDGE[7][1]))
    assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(r["spans"].split(","))
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.digest(pii.find_pii(empty, pii.fit(empty))).count() == 0


# --- decontamination


def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_contamination(spark, edge, empty, bench):
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_hit"]) for r in decontaminate.contamination(edge, bench).collect()}
    assert got == {(3, 1): (6, 6), (4, 1): (6, 6)}
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(edge, bench.where("item_id < 0")).count() == 0


def test_contamination_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 40)))) for i in range(30)]
    docs = []
    for i in range(80):
        text = [r.choice(vocab) for _ in range(r.randint(0, 200))]
        if i % 2:
            own = r.choice(items)[1].split()
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] = "changed"
            cut = r.randint(0, len(text))
            text = text[:cut] + own + text[cut:]
        docs.append((i, " ".join(text)))
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i) for d, t in docs for i, u in items if (s := shingles(u)) and len(s & shingles(t)) >= 0.8 * len(s) - 1e-9}
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want and want


# --- suffixes


def brute_cut(docs):
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        x = (t or "").encode()
        cover = np.zeros(len(x), bool)
        for s in range(len(x) - 49):
            w = x[s : s + 50]
            if w in seen and seen[w] != i:
                cover[s : s + 50] = True
            seen.setdefault(w, i)
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[i] = (len(x), int(cover.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~cover].tobytes()).hexdigest())
    return out


def test_deep_shallow_sort():
    r = np.random.default_rng(0)
    base = [bytes(r.integers(97, 99, 60).astype(np.uint8)) for _ in range(6)]
    for _ in range(10):
        data = b"".join(base[r.integers(0, 6)][: r.integers(20, 60)] if r.random() < 0.8 else bytes(r.integers(97, 255, 30).astype(np.uint8)) for _ in range(60))
        order, group = suffix_dedup.deep_shallow(np.frombuffer(data, np.uint8), np.arange(len(data) - 49))
        strings = [data[i : i + 50] for i in order]
        assert strings == sorted(strings) and len(set(group)) == len(set(strings))


def test_suffix_dedup(spark, edge, empty):
    got = suffix_dedup.suffix_dedup(edge).collect()
    want = brute_cut([(i, t) for i, t, *_ in EDGE])
    assert len(got) == len(EDGE)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]]
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    passages = ["".join(r.choice("abcdé \n") for _ in range(r.randint(30, 120))) for _ in range(12)]
    docs = [(i, "".join(r.choice(passages) if r.random() < 0.6 else "".join(r.choice("abcd") for _ in range(r.randint(1, 60))) for _ in range(r.randint(0, 6)))) for i in range(300)]
    docs += [(1000 + i, passages[0] * 3) for i in range(150)]  # a group of copies
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_cut(docs)
    assert all(tuple(x)[1:] == want[x["doc_id"]] for x in got) and len(got) == len(docs)


def test_pieces_overlap():
    text = bytes(range(65, 91)) * 40
    got = {x[i : i + 50] for group in suffix_dedup.pieces([text], 200) for _, _, x in group for i in range(len(x) - 49)}
    assert got == {text[i : i + 50] for i in range(len(text) - 49)}


# --- words


def test_words_of_sliced_batches():
    texts = ["Éa b", None, "", "  x\n\ty ", "Zé\xa0q \x85r"] * 7
    whole = pa.array(texts)
    for a, b in ((0, 35), (3, 9), (8, 8)):
        w = Words(whole.slice(a, b - a))
        names = w.words.to_pylist()
        got = [[names[c] for c in w.codes[x:y]] for x, y in zip(w.at[:-1], w.at[1:], strict=True)]
        assert got == [[x.decode() for x in (t or "").encode().lower().split()] for t in texts[a:b]]


# --- pipeline


def test_pipeline_on_edges(spark, edge, empty, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, docs in (("edge", edge.select(*corpus_pipeline.COLUMNS)), ("empty", empty.select(*corpus_pipeline.COLUMNS))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs.withColumns({c: F.lit(1) for c in ("key", "slot", "size", "taken", "first", "component_id", "t")}), str(tmp_path))
            if k < 4:
                assert out.columns == list(corpus_pipeline.COLUMNS)
            out.write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            if name == "edge" and k == 0:
                assert not {0, 1, 2, 8} & set(ids) and {3, 4, 5, 6, 7, 9, None} <= set(ids)
            if name == "edge" and k == 1:
                assert sorted(i for i in ids if i is not None) == [3, 5, 7, 9]
            if name == "edge" and k == 2:
                assert sorted(i for i in ids if i is not None) == [5, 7, 9]
        assert (docs.count() == 0) == (name == "empty")


def test_pipeline_stages_with_missing_and_repeated_ids(spark, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = "this is a text of some words that go on"
    rows = [(None, leak), (None, "seven words without any id at all"), (1, leak), (1, "another text that has one id with it")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    clean = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert {(r["doc_id"], r["text"]) for r in clean.collect()} == {rows[1], rows[3]}
    assert None in {r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()}
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).where("doc_id = 1").collect()} == {rows[2], rows[3]}


def test_pipeline_against_brute_force(spark, data, tmp_path):
    """All stages after the first, chained, on whole fixtures with rows of null, repeated and shared ids."""
    shutil.copy(f"{data}/benchmark.parquet", tmp_path / "benchmark.parquet")
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    r = random.Random(9)
    docs += [(None, *d[1:]) for d in r.sample(docs, 10)] + [(d[0], f"{d[1]} and more words of another kind {i}", *d[2:]) for i, d in enumerate(r.sample(docs, 10))] + r.sample(docs, 5)
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))

    got = [tuple(x) for x in corpus_pipeline.language(spark, rows, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(d) for d in docs if re.search(r"[^\W\d_]", d[1] or ""))
    docs = got

    least, home = {}, dict(zip([d[1] for d in docs], alike([(i, d[1]) for i, d in enumerate(docs)]), strict=True))
    for d in docs:
        least[home[d[1]]] = min(least.get(home[d[1]], (True, 0)), (d[0] is None, d[0] or 0))
    rows = spark.createDataFrame(docs, rows.schema)
    got = [tuple(x) for x in corpus_pipeline.near_duplicates(spark, rows, str(tmp_path)).collect()]
    assert sorted(home[d[1]] for d in got) == sorted(least) and all((d[0] is None, d[0] or 0) == least[home[d[1]]] for d in got) and set(got) <= set(docs)
    docs = got

    rows = spark.createDataFrame(docs, rows.schema)
    got = [tuple(x) for x in corpus_pipeline.decontaminated(spark, rows, str(tmp_path)).collect()]
    dirty = [d for d in docs if any(s and len(s & shingles(d[1])) >= 0.8 * len(s) - 1e-9 for s in items)]
    assert sorted(map(repr, got)) == sorted(repr(d) for d in docs if d not in dirty) and dirty
    docs = got

    rows = spark.createDataFrame(docs, rows.schema)
    corpus_pipeline.mixed(spark, rows, str(tmp_path)).write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("*.parquet"))
    got = [tuple(x.values()) for f in files for x in pq.read_table(f).to_pylist()]
    size = {d[:2]: len(words(d[1])) for d in docs}
    slots = mixing.mix(rows.withColumn("body", F.col("text")), keep=("body",)).collect()
    assert sorted(repr(x[:2]) for x in got) == sorted(repr((x["doc_id"], x["body"])) for x in slots for _ in x["slots"] or [])
    first = {(x["doc_id"], x["body"]): x["first_slot"] for x in slots if x["slots"]}
    seen, at = set(), []
    for x in got:
        if x[:2] not in seen:
            seen.add(x[:2])
            at.append(first[x[:2]])
    assert at == sorted(at) and all(got.count(x) == -(-next(y["taken"] for y in slots if (y["doc_id"], y["body"]) == x[:2]) // size[x[:2]]) for x in set(got))

    out = corpus_pipeline.sharded(spark, spark.createDataFrame(got, rows.schema), str(tmp_path)).collect()
    assert len(out) == len(got) and sorted(x["size"] for x in out) == sorted(len(x[1].encode()) + 1 for x in got)
    by = {}
    for x in out:
        by.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_pipeline_deletes_what_it_no_longer_needs(spark, data):
    folder = os.path.join(spark.conf.get("spark.checkpoint.dir"), "corvane")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and [x.split("-")[1] for x in set(os.listdir(folder)) - before] == ["sharded"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_as_in_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(x) for x in cur.fetchall()), key=repr)
    df = queries.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(names) and sorted((tuple(x) for x in df.select(*names).collect()), key=repr) == want


def test_registered_queries(spark, data):
    import __spark_entry__ as e

    names = {n.split("_")[0] for n in e.queries()}
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= names
