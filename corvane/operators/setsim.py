"""Exact token-set similarity join by prefix filtering and bitmaps.

Texts with one token set form a class; classes are compared, and membership links texts to them. A class is written once, to
a block of the shared folder: its tokens, its bitmaps and its head. All steps read what they need there by the place of
the class, so neither tokens nor bitmaps are sent along with the rows that meet; those are numbers.
Tokens are ordered by rising frequency, by counters that several tokens may share (any order serves, if it is one for all sets); two sets of similarity t must share a token among the first
``size - ceil(t * size) + 1`` of each, so only rare tokens are joined on, never the common ones. The sets that have a
token there lie side by side in one run, in order of size; pairs of a run go on if their sizes allow t, and if what
follows the token on both sides leaves room for enough common ones (at the first token that a pair shares, that bounds
all they share). Runs are compared in slices; a token that more than ``HOT`` sets have is dealt out by blocks of its sets,
each pair of blocks to a task of its own. Then a bitmap of ``BITS`` bits a set bounds what a pair can share, before any
token is looked at: every bit that one has and the other lacks stands for a token that isn't shared. What is left is
compared as text.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_set
from ..sources.stage import shared_folder, staged
from . import store

BITS = 2048
#: Bits of the sketch that goes with a set into the runs, so that most pairs are dropped before they are written.
SKETCH = 1024
HOT = 4096
#: Counters of tokens, classes of a block on average, and places that are kept for a block.
COUNTERS = 1 << 22
BLOCK = 2048
PLACES = 1 << 24
#: Rows of runs that are looked at at once.
TOGETHER = 1 << 17
#: Pairs that are compared as text at once.
TEXTS = 1024
#: Pairs that are looked at at once, and pairs whose sketches are.
PAIRS = 1 << 20
SLICE = 1 << 16


def need(m, n, t: float):
    """The least number of common tokens of sets of m and n tokens of similarity t."""
    return np.ceil((m + n) * (t / (1 + t)) - 1e-9)


def _within(begin: np.ndarray, n: np.ndarray, t: float):
    """Pairs (i, j), i < j, of rows in runs that begin at begin, in order of n in each, whose sizes allow t; in pieces."""
    end = np.append(begin[1:], len(n))
    own = np.repeat(np.arange(len(begin)), end - begin)
    # a run's sizes rise, so a row's partners are those after it up to a size
    key = own * (int(n.max()) + 2) + np.minimum(np.floor(n / t + 1e-9), int(n.max()) + 1)
    last = np.searchsorted(own * (int(n.max()) + 2) + n, key, side="right")
    count = np.maximum(last - np.arange(len(n)) - 1, 0)
    yield from _spread(np.arange(len(n)), np.arange(len(n)) + 1, count)


def _spread(i: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Each i with the count rows from first on, in pieces of about PAIRS."""
    total = np.cumsum(count)
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
        c = count[a:b]
        at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(i[a:b], c), np.repeat(first[a:b], c) + at
        a = b


def _room(x: np.ndarray, y: np.ndarray, m, n):
    """The most common tokens that sets of m and n tokens with bitmaps x and y can have: a bit that one alone has stands for a token that isn't shared."""
    return np.minimum(m - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


class Classes:
    """Where the blocks of classes lie. A class is known by its place, PLACES times its block and a number in it."""

    def __init__(self, path: str):
        self.path = path
        self.heads = store.Store(f"{path}/heads", 4, "i8", PLACES)  # id, tokens, begin and end of the text
        self.maps = {bits: store.Store(f"{path}/{bits}", bits // 64, "u8", PLACES) for bits in (SKETCH, BITS)}

    def save(self, block: int, ids: np.ndarray, sets: list[str]) -> None:
        codes, size = _codes(sets)
        raw = [x.encode() for x in sets]
        end = np.cumsum([len(x) for x in raw])
        store.put(f"{self.path}/text", block, b"".join(raw))
        store.put(self.heads.path, block, np.stack([ids, size, end - [len(x) for x in raw], end], axis=1).astype("i8").tobytes())
        row = np.repeat(np.arange(len(sets)), size)
        for width, kept in self.maps.items():
            bits = np.zeros((len(sets), width), np.uint8)
            bits[row, codes & (width - 1)] = 1
            store.put(kept.path, block, np.packbits(bits, axis=1).tobytes())

    def block(self, block: int) -> list[str]:
        """The sets of a block, tokens joined by spaces."""
        where, root = store._place(self.path)
        with where.open_input_file(f"{root}/heads/{block}") as f:
            heads = np.frombuffer(f.read(), "i8").reshape(-1, 4)
        with where.open_input_file(f"{root}/text/{block}") as f:
            raw = f.read()
        return [raw[a:z].decode() for a, z in heads[:, 2:].tolist()]

    def texts(self, at: np.ndarray, heads: np.ndarray):
        """Token sets of the classes at rising places."""
        where, root = store._place(self.path)
        block = at // PLACES
        begin = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        for a, z in zip(begin, [*begin[1:], len(at)], strict=True):
            with where.open_input_file(f"{root}/text/{block[a]}") as f:
                for first, last in heads[a:z, 2:].tolist():
                    yield frozenset(f.read_at(last - first, first).split(b" "))

    def alike(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
        """Which pairs of classes at a and b, of n and m tokens, may reach t by their bitmaps."""
        left = np.arange(len(a))
        for kept in self.maps.values():
            for k in range(0, len(left), SLICE):
                now = left[k : k + SLICE]
                own, back = np.unique(np.concatenate([a[now], b[now]]), return_inverse=True)
                x = kept.read(own)
                ok = _room(x[back[: len(now)]], x[back[len(now) :]], n[now], m[now]) >= need(n[now], m[now], t)
                left[k : k + SLICE] = np.where(ok, now, -1)
            left = left[left >= 0]
        return left


def _codes(sets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit code of each token, tokens of each set)."""
    words = [x.split(" ") for x in sets]
    size = np.array([len(x) for x in words], np.int64)
    known: dict[str, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for x in words for w in x), np.int64, int(size.sum()))
    digest = b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in known)
    return np.frombuffer(digest, "<i8")[flat], size


def _combined(batches):
    """Of the texts of one token set in a batch, the smallest id; and the block's key."""
    for b in batches:
        first: dict[str, int] = {}
        for i, x in zip(b.column("id").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            if (had := first.get(x)) is None or i < had:
                first[x] = i
        yield pa.RecordBatch.from_arrays([pa.array(list(first.values()), pa.int64()), pa.array(list(first), pa.string())], ["id", "tokens"])


def _saved(kept: Classes):
    def run(table: pa.Table) -> pa.Table:
        first: dict[str, int] = {}
        for i, x in zip(table.column("id").to_pylist(), table.column("tokens").to_pylist(), strict=True):
            if (had := first.get(x)) is None or i < had:
                first[x] = i
        block = table.column("block")[0].as_py()
        kept.save(block, np.array(list(first.values()), np.int64), list(first))
        return pa.table({"block": pa.array([block], pa.int64())})

    return run


def _counted(kept: Classes, slots: int):
    """(slot, n): tokens of the blocks by counter."""

    def run(batches):
        total = np.zeros(slots, np.int64)
        for b in batches:
            for block in b.column(0).to_pylist():
                total += np.bincount(_codes(kept.block(block))[0] & (slots - 1), minlength=slots)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)], pa.int32()), pa.array(total[at[i : i + (1 << 16)]])], ["slot", "n"])

    return run


def _prefixes(kept: Classes, counters, t: float, hot: int):
    """(w, id, n, at, parts): the tokens of each set that others of similarity t must meet; parts is above 1 for a token that is dealt out."""

    def run(batches):
        for b in batches:
            for block in b.column(0).to_pylist():
                codes, size = _codes(kept.block(block))
                row = np.repeat(np.arange(len(size)), size)
                f = counters.value[codes & (len(counters.value) - 1)].astype(np.int64)
                by = np.lexsort((codes, f, row))
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                n = size[row]
                f = f[by]
                ok = np.flatnonzero((at <= n - np.ceil(n * t - 1e-9)) & (f > 1))
                for i in range(0, len(ok), 1 << 16):
                    o = ok[i : i + (1 << 16)]
                    cols = [pa.array(codes[by[o]]), pa.array(block * PLACES + row[o]), pa.array(n[o], pa.int32()), pa.array(at[o], pa.int32()), pa.array(-(-f[o] // hot), pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, ["w", "id", "n", "at", "parts"])

    return run


def _runs(kept: Classes, t: float):
    """Rows (w, id, n, at) in order of w, n: pairs (a, b) of each token's sets; a run is never in two pieces."""

    def compare(w, ids, n, at):
        left = n - at
        begin = np.flatnonzero(np.diff(w, prepend=w[0] - 1))
        for i, j in _within(begin, n, t):
            ok = np.flatnonzero(np.minimum(left[i], left[j]) >= need(n[i], n[j], t))
            i, j = i[ok], j[ok]
            ok = kept.alike(ids[i], ids[j], n[i], n[j], t)
            if len(ok):
                yield _batch(ids[i[ok]], ids[j[ok]])

    def run(batches):
        held, wait = [np.zeros(0, np.int64)] * 4, []
        for b in batches:
            wait.append([b.column(c).to_numpy().astype(np.int64) for c in ("w", "id", "n", "at")])
            if sum(len(x[0]) for x in wait) < TOGETHER:  # so that bitmaps are read for many at once
                continue
            cols, wait = [np.concatenate(x) for x in zip(held, *wait, strict=True)], []
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield from compare(*(c[:cut] for c in cols))
            held = [c[cut:] for c in cols]
        held = [np.concatenate(x) for x in zip(held, *wait, strict=True)]
        if len(held[0]):
            yield from compare(*held)

    return run


def _blocks(kept: Classes, t: float):
    """Two blocks of a frequent token's sets (or one, with itself): their pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, na, pa_ = (left.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "at"))
        b, nb, pb = (right.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "at"))
        order = np.argsort(nb, kind="stable")
        b, nb, pb = b[order], nb[order], pb[order]
        first, last = np.searchsorted(nb, np.ceil(na * t - 1e-9)), np.searchsorted(nb, np.floor(na / t + 1e-9), side="right")
        found = []
        for i, j in _spread(np.arange(len(a)), first, np.maximum(last - first, 0)):
            ok = (np.minimum(na[i] - pa_[i], nb[j] - pb[j]) >= need(na[i], nb[j], t)) & (a[i] != b[j])
            i, j = i[ok], j[ok]
            ok = kept.alike(a[i], b[j], na[i], nb[j], t)
            found.append(_batch(a[i[ok]], b[j[ok]]))
        return pa.Table.from_batches(found, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _compared(kept: Classes, t: float):
    """Of pairs of places those that reach t, as (a, b, jaccard) of ids."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                a, b = (batch.column(c).to_numpy()[i : i + TEXTS] for c in ("a", "b"))
                own, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                heads = kept.heads.read(own)
                sets = list(kept.texts(own, heads))
                x, y = back[: len(a)], back[len(a) :]
                common = np.array([len(sets[p] & sets[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
                j = common / (heads[x, 1] + heads[y, 1] - common)
                ok = (j >= t - 1e-12) & (heads[x, 0] != heads[y, 0])
                one, two = heads[x[ok], 0], heads[y[ok], 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(j[ok])], ["a", "b", "jaccard"])

    return run


def _token_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens) of the texts that have a token."""
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:  # a few files, as splitting into words is what takes long
        texts = texts.repartition(cores)
    return texts.select("id", F.sort_array(token_set("text")).alias("tokens")).where(F.size("tokens") > 0)


def classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class_id, id, tokens): class_id is the smallest id with the same token set; texts without a token are left out."""
    sets = staged(_token_sets(df, id_col, text_col).withColumn("h", F.sha2(F.array_join("tokens", " "), 256)), "token-sets")
    reps = sets.groupBy("h").agg(F.min("id").alias("class_id"))
    return sets.join(reps, "h").select("class_id", "id", "tokens")


def jaccard_join(df: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b, jaccard): pairs of class representatives, a < b, that reach the threshold."""
    spark = df.sparkSession
    kept = Classes(f"{shared_folder(spark)}/classes-{uuid.uuid4().hex}")
    blocks = max(1, -(-df.count() // BLOCK))
    sets = _token_sets(df, id_col, text_col).where("id is not null").select(F.col("id").cast("long").alias("id"), F.array_join("tokens", " ").alias("tokens"))
    sets = sets.mapInArrow(_combined, "id long, tokens string").withColumn("block", F.pmod(F.xxhash64("tokens"), F.lit(blocks)).cast("long"))
    own = sets.groupBy("block").applyInArrow(_saved(kept), "block long").toArrow().column("block")  # a number a block
    tasks = max(1, min(len(own), 4 * spark.sparkContext.defaultParallelism))
    every = spark.createDataFrame(pa.table({"block": own})).repartition(tasks)
    slots = every.mapInArrow(_counted(kept, COUNTERS), "slot int, n long").groupBy("slot").agg(F.least(F.sum("n"), F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()  # the counters
    total = np.zeros(COUNTERS, np.int32)
    total[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    prefix = every.mapInArrow(_prefixes(kept, spark.sparkContext.broadcast(total), threshold, HOT), "w long, id long, n int, at int, parts int")
    runs = prefix.where("parts = 1").drop("parts").repartition("w").sortWithinPartitions("w", "n")
    near = runs.mapInArrow(_runs(kept, threshold), "a long, b long")
    # blocks of a frequent token's sets by a digest of the id, so that each has sets of all sizes
    many = prefix.where("parts > 1").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    far = F.sequence(F.lit(0), F.col("parts") - 1)
    left = many.withColumn("other", F.explode(F.filter(far, lambda x: x >= F.col("own")))).select("w", F.col("own").alias("p"), F.col("other").alias("q"), "id", "n", "at")
    right = many.withColumn("other", F.explode(F.filter(far, lambda x: x <= F.col("own")))).select(F.col("w").alias("w2"), F.col("other").alias("p2"), F.col("own").alias("q2"), *(F.col(c).alias(c) for c in ("id", "n", "at")))
    met = left.groupBy("w", "p", "q").cogroup(right.groupBy("w2", "p2", "q2")).applyInArrow(_blocks(kept, threshold), "a long, b long")
    near = staged(near.unionByName(met).distinct().sortWithinPartitions("a", "b"), "pairs")
    return near.mapInArrow(_compared(kept, threshold), "a long, b long, jaccard double").dropDuplicates(["a", "b"])
