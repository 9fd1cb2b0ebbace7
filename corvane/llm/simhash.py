"""SimHash near-duplicates by anchor-point covering.

The anchors are pairs of codewords of the binary Golay code of length 23, one for bits 0-22 and one
for bits 23-45. The code is perfect: every 23-bit word lies within 3 bits of just one codeword, so
every fingerprint has one home anchor. If two fingerprints differ in at most ``THRESHOLD`` bits, the
home of either is, over both halves together, at most ``THRESHOLD`` bits beyond radius 3 of the
other; each fingerprint is therefore replicated to all anchors within covering radius plus
threshold (about 300 of 2^24), and at each anchor the fingerprints at home there are compared with
all that came. No link is missed. The anchor's first codeword is the page that replicas are shuffled
to; the second is expanded where the page is compared, so about 71 copies of 8 bytes are moved.

Copies are collapsed to distinct fingerprints before replication. An anchor emits a spanning forest
of its links, never all pairs. Components follow in ``components``, over fingerprints; each is named
by the smallest id of its documents. As distinct fingerprints grow, a page is cut into sections by
the second codeword, so that it never holds much more than ``PAGE`` fingerprints; then at most
about 300 copies are moved.

``similar_components`` finds texts whose shingles of five words are alike by 0.8 or more. At that similarity fingerprints
differ in some ten bits, beyond any cover of use, so the links are found by the trees of ``signature_tree``, all of them.

Defined results: a null or wordless text has fingerprint zero and links like any other; a row of null
id links like any other and has the smallest id that it reaches (null if it reaches none); repeated
rows keep a row each; an empty table gives none.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import signature_tree
from .common import WORD, discard, lookup, materialize, table
from .components import components
from .tokens import slices

THRESHOLD = 3
SHINGLE = 3
SEED = 42
RADIUS = 3
N = 23
#: Generator polynomial of the Golay code; a fixed value.
GOLAY = 0b101011100011


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles: a bit is set where over half of the shingles' hashes have it."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([fingerprint(x, words) if x else 0 for x in part.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Cover:
    """The Golay code: codewords by distance from any 23-bit word."""

    def __init__(self, radius: int = RADIUS + THRESHOLD):
        check = N - (GOLAY.bit_length() - 1)
        self.low = N - check
        syn = np.zeros(N, np.int64)
        for i in range(N):
            r = 1 << i
            for j in range(N - 1, self.low - 1, -1):
                if r >> j & 1:
                    r ^= GOLAY << (j - self.low)
            syn[i] = r
        words = [np.zeros(1, np.int64)]
        last = np.full(1, -1)
        for _ in range(radius):  # all error patterns of the next weight
            more = [(words[-1][last < i] | (1 << i), i) for i in range(N)]
            words.append(np.concatenate([x for x, _ in more]))
            last = np.concatenate([np.full(len(x), i) for x, i in more])
        err = np.concatenate(words)
        weight = np.concatenate([np.full(len(x), w) for w, x in enumerate(words)])
        s = np.zeros(len(err), np.int64)
        for i in range(N):
            s ^= np.where(err >> i & 1, syn[i], 0)
        order = np.lexsort((weight, s))
        self.err, self.excess = err[order], np.maximum(weight[order] - RADIUS, 0)
        self.begin = np.searchsorted(s[order], np.arange((1 << self.low) + 1))
        self.syn = syn

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), np.int64)
        for i in range(N):
            s ^= np.where(x >> i & 1, self.syn[i], 0)
        return s

    def near(self, x: np.ndarray):
        """All codewords within the radius: (index into x, codeword number, bits beyond the covering radius)."""
        s = self.syndrome(x)
        n = self.begin[s + 1] - self.begin[s]
        i = np.repeat(np.arange(len(x)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.begin[s][i]
        return i, (x[i] ^ self.err[j]) >> self.low, self.excess[j]


@functools.lru_cache(1)
def cover() -> Cover:
    return Cover()


def halves(fp: np.ndarray):
    u = fp.view(np.uint64)
    return (u & np.uint64((1 << N) - 1)).astype(np.int64), ((u >> np.uint64(N)) & np.uint64((1 << N) - 1)).astype(np.int64)


#: Distinct fingerprints that a section of a page aims at.
PAGE = 1 << 18


def _pages(sections: int):
    """Sends each fingerprint to its pages, or to the sections of a page where it has a codeword."""

    def keys(fp):
        x, y = halves(fp)
        i, page, e1 = cover().near(x)
        if sections == 1:
            return i, page
        j, code, e2 = cover().near(y)
        at = np.searchsorted(j, np.arange(len(fp) + 1))
        order = np.lexsort((e2, j))  # each fingerprint's codewords by rising excess
        code, e2 = code[order], e2[order]
        fit = np.stack([np.add.reduceat(e2 <= THRESHOLD - e, at[:-1]) for e in range(THRESHOLD + 1)])
        n = fit[e1, i]
        who = np.repeat(np.arange(len(i)), n)
        k = at[:-1][i][who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(np.stack([i[who], page[who] * sections + code[k] % sections]), axis=1)
        return both[0], both[1]

    def run(batches):
        step = 20_000 if sections == 1 else 2_000
        for batch in batches:
            every = batch.column(0).to_numpy()
            for k in range(0, len(every), step):
                fp = every[k : k + step]
                i, page = keys(fp)
                order = np.argsort(page, kind="stable")
                page, packed = page[order], fp[i[order]]
                cut = np.flatnonzero(np.diff(page, prepend=-1))
                ends = np.append(cut[1:], len(page))
                yield pa.RecordBatch.from_arrays([pa.array(page[cut], pa.int64()), pa.array([packed[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], ["page", "fps"])

    return run


def _forest(n: int, pairs) -> np.ndarray:
    """Least member of each of n items' component, over batches of index pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            live = ra != rb
            if not live.any():
                break
            a, b, ra, rb = a[live], b[live], ra[live], rb[live]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


#: Codewords of the second half that a page is expanded to at once, and index pairs that are compared at once.
PART = 512
CHUNK = 1 << 22


def _compare(page: int, fps: np.ndarray, cover: Cover, threshold: int, sections: int = 1) -> np.ndarray:
    """Component root (index) of each distinct fingerprint in a section of a page."""
    page, section = divmod(page, sections)
    x, y = halves(fps)
    i, a, e1 = cover.near(x)
    here = a == page
    e1 = e1[here][np.argsort(i[here])]
    u = fps.view(np.uint64)

    def pairs():
        for k in range(0, len(fps), 200_000):
            j, b, e2 = cover.near(y[k : k + 200_000])
            m = (b % sections == section) & (e1[j + k] + e2 <= threshold)
            parts.append((j[m] + k, b[m], e2[m]))
        every = 1 << (N - cover.low)
        step = every if len(fps) <= 20_000 else PART
        for lo in range(0, every, step):
            got = [(j[m], b[m], e2[m]) for j, b, e2 in parts for m in [(b >= lo) & (b < lo + step)]]
            j, b, e2 = (np.concatenate([g[q] for g in got]) for q in range(3))
            order = np.argsort(b, kind="stable")
            j, b, home = j[order], b[order], ((e1[j] == 0) & (e2 == 0))[order]
            begin, end = np.searchsorted(b, b[home]), np.searchsorted(b, b[home], side="right")
            homes, n = j[home], end - begin
            k = 0
            while k < len(homes):
                m = max(1, int(np.searchsorted(np.cumsum(n[k:]), CHUNK, side="right")))
                left = np.repeat(homes[k : k + m], n[k : k + m])
                at = np.arange(len(left)) - np.repeat(np.cumsum(n[k : k + m]) - n[k : k + m], n[k : k + m]) + np.repeat(begin[k : k + m], n[k : k + m])
                right = j[at]
                ok = np.bitwise_count(u[left] ^ u[right]) <= threshold
                yield left[ok], right[ok]
                k += m

    parts: list = []
    return _forest(len(fps), pairs())


def links(distinct: DataFrame, threshold: int = THRESHOLD, sections: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span every component."""
    if sections is None:  # a page holds 1 in 58 fingerprints
        sections = 1
        while sections < 256 and distinct.count() // 58 > PAGE * sections:
            sections *= 2

    def compare(key, t):
        fps = np.frombuffer(b"".join(t.column("fps").to_pylist()), dtype=np.int64)
        root = _compare(key[0].as_py(), fps, cover(), threshold, sections)
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": fps[linked], "b": fps[root[linked]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return distinct.select("fp").mapInArrow(_pages(sections), "page long, fps binary").groupBy("page").applyInArrow(compare, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col="doc_id", text_col="text", words: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    firsts = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-firsts")
    comps = components(links(firsts, threshold), "a", "b")
    # a component is known by one of its fingerprints, and named by the smallest id of all; a fingerprint of null ids alone has none to give
    named = firsts.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = materialize(named.select("fp", "component").join(names, "component").select("fp", "component_id"), "simhash-components")
    discard(firsts)
    return lookup(fps, whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_components(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, component_id, the smallest id of the texts that it is linked to by similarities of shingles of at least that (in whole per cent), itself included.

    Ids are of any type that is ordered. The links are those of ``signature_tree``, which leaves none out; null and wordless texts are linked with each other.
    """
    percent = round(100 * similarity)
    if abs(percent - 100 * similarity) > 1e-9:
        raise ValueError("similarities are whole per cents")
    found = signature_tree.jaccard_components(docs, id_col, text_col, words, percent)
    empty = docs.where(~F.coalesce(F.col(text_col).cast("string").rlike(WORD), F.lit(False))).agg(F.min(id_col).alias("least"))
    return found.crossJoin(F.broadcast(empty)).select("doc_id", F.when(F.col("n_shingles") == 0, F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def op5_simhash(spark, sf_dir) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
