"""Jaccard join of documents' word shingles by signature trees.

A set's signature is a bitmap with a bit for each of its shingles' hashes, of the least power of two of bits that is
four times the set's size or more. A tree's node holds the OR of its sets' bitmaps, the range of their sizes, and
what bounds an overlap: how many more shingles than bits a set below it has at most. Two sets of sizes m and n are
alike by p per cent if they share p (m + n) / (100 + p) shingles. If the bitmaps of two nodes share c bits, no set
below one shares more than c plus its surplus of shingles over bits with one below the other. A dual traversal goes
down pairs of nodes from the roots and drops a pair when the largest overlap possible is below the least that is
needed, when the sizes are too far apart, or when all sets below are known to be linked.

One tree of everything would have a full bitmap near its root, and compare all nodes of a level. So there is a tree
for each shingle, of the sets that have it among their rarest: sets that are alike share one of each other's first
n - ceil(p n / 100) + 1 shingles in any order that is the same for all. The order is by how many shingles of the corpus
fall into a shingle's slot of a table of 2^``SLOTS`` counters (in powers of two), so trees of common shingles are few.
A shingle of more than ``BLOCK`` sets has a tree for each block of them, and each pair of trees that sizes and
components allow is a task of its own.

Before that, sets that share a least hash (of ``SEEDS`` hash functions) are compared with the first of them, which
links most copies; what is known to be linked isn't compared again, so a group of copies isn't compared pair by pair.
What the trees leave is checked on the sets themselves. Trees that leave more than ``DENSE`` pairs a set, as those of a
group of near copies do whose first member is like few of the others, send only pairs that span them. These are
checked, and what they don't link is traversed again; after ``TURNS`` such turns all pairs that are left are sent. No link
is lost; of linked sets, only as many pairs are checked as it takes to link them, best bounds first when there are many.

Shingles are known by 64-bit hashes and equal sets by 128-bit digests of these. Defined results: a text of fewer
words than a shingle is one shingle; a null or wordless one has none and is linked with nothing; rows of one id are
documents of their own; a row of null id links like any other and has the smallest id it reaches, or null; an empty
table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialize, table, tidy
from .components import components
from .shingles import shingle_hashes
from .tokens import Words, slices

SHINGLE = 5
PERCENT = 80
SLOTS = 20
SEEDS = 6
#: Sets of a shingle that are one tree; sets that are compared without one.
BLOCK = 1024
LEAF = 32
#: Children of a node, and the bits of the widest bitmap.
FAN = 8
WIDEST = 1 << 17
#: Words of bitmaps that are compared at once.
CHUNK = 1 << 21
#: Sets that are compared with one set in one task.
STAR = 1000
#: More pairs a set than this are checked best bounds first.
MANY = 1
#: More pairs a set than this are not sent by a task at once, and how often it sends a part of them.
DENSE = 2
TURNS = 2


def need(m, n, percent: int = PERCENT):
    """The least overlap of sets of sizes m and n that are alike."""
    return -(-percent * (m + n) // (100 + percent))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOTS)).astype(np.int64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function of shingles."""
    x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _sets(part: pa.RecordBatch, words: int):
    """(set's bounds, hashes): the distinct shingles of each text of a slice, in order of hash."""
    _, _, text, h = shingle_hashes(Words(part.column("text")), words)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    text, h = text[new], h[new]
    return np.searchsorted(text, np.arange(part.num_rows + 1)), h


def slot_ranks(docs: DataFrame, words: int = SHINGLE) -> np.ndarray:
    """For each slot the power of two of the shingles that fall into it, over all documents. A task counts all its documents into one table; tables are added up in two steps, so none gathers many."""
    width = 1 << 14

    def count(batches):
        n = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                n += np.bincount(_slot(shingle_hashes(Words(part.column("text")), words)[3]), minlength=1 << SLOTS)
        deal = TaskContext.get().partitionId() % 64
        rows = [pa.compress(n[a : a + width], codec="zstd", asbytes=True) for a in range(0, len(n), width)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), deal, np.int32)), pa.array(rows, pa.binary())], ["part", "deal", "n"])

    def add(t: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(pa.decompress(x, 8 * width, codec="zstd", asbytes=True), np.int64) for x in t.column("n").to_pylist())
        return pa.table({"part": t.column("part")[:1], "deal": t.column("deal")[:1], "n": pa.array([pa.compress(n, codec="zstd", asbytes=True)], pa.binary())})

    schema = "part int, deal int, n binary"
    tasks = max(64, docs.sparkSession.sparkContext.defaultParallelism)
    once = docs.select("text").coalesce(tasks).mapInArrow(count, schema).groupBy("part", "deal").applyInArrow(add, schema)
    out = np.zeros(1 << SLOTS, np.int64)
    for r in once.withColumn("deal", F.lit(0)).groupBy("part").applyInArrow(add, schema).collect():  # a table of fixed size
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(pa.decompress(bytes(r["n"]), 8 * width, codec="zstd", asbytes=True), np.int64)
    return np.searchsorted(1 << np.arange(63), out, side="right").astype(np.int8)  # bit lengths


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the signatures of sets of these sizes."""
    return np.minimum(np.maximum(1 << np.ceil(np.log2(np.maximum(4 * n, 64))).astype(np.int64), 64), WIDEST)


def signatures(at: np.ndarray, h: np.ndarray) -> list[bytes]:
    """Bitmaps of sets given by their bounds and hashes. A bit's number is the hash's low bits, so a bitmap folded in half is the narrower one."""
    n = np.diff(at)
    w = widths(n)
    off = np.concatenate([[0], np.cumsum(w)])
    bits = np.zeros(off[-1], np.uint8)
    own = np.repeat(np.arange(len(n)), n)
    bits[off[own] + (h & (w[own] - 1).astype(np.uint64)).astype(np.int64)] = 1
    packed = np.packbits(bits, bitorder="little")
    return [packed[a:b].tobytes() for a, b in zip((off[:-1] // 8).tolist(), (off[1:] // 8).tolist(), strict=True)]


def _describe(ranks, words: int, percent: int, kind):
    """(row, doc_id, t, n, keys, prefix, sig) of each document: digest of its set, size, least hashes, rarest shingles, signature."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                at, h = _sets(part, words)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys = np.zeros((SEEDS, len(n)), np.uint64)
                for k in range(SEEDS):
                    if len(full):
                        keys[k, full] = np.minimum.reduceat(_mixed(h, k), at[full])
                own = np.repeat(np.arange(len(n)), n)
                order = np.argsort(own * 128 + ranks.value[_slot(h)], kind="stable")
                first = n - -(-percent * n // 100) + (n > 0)
                rarest = h[order][np.arange(len(h)) - at[:-1][own] < first[own]]
                raw = h.view(np.uint8)
                t = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lists = lambda flat, size: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat.view(np.int64)))
                cols = [pa.array(row + np.arange(len(n))), part.column("doc_id"), pa.array(t, pa.binary()), pa.array(n, pa.int64()), lists(np.ascontiguousarray(keys.T).ravel(), np.full(len(n), SEEDS)), lists(rarest, first), pa.array(signatures(at, h), pa.binary())]
                row += len(n)
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "t", "n", "keys", "prefix", "sig"])

    return run, f"row long, doc_id {kind}, t binary, n long, keys array<long>, prefix array<long>, sig binary"


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes (node, t, own) that are alike, by their sets, written. Nodes that many are compared with are dealt out."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                at, h = _sets(part, words)
                raw = h.view(np.uint8)
                t = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], ["t", "s"])

    stars = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts")), "tree-stars")
    dealt = lookup(pairs.select("a", "b"), stars, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    used = nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node").select("node", "t", "own")
    ids = used.select("own").distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["own"]), "left_semi").select("text")
    sets = texts.mapInArrow(run, "t binary, s array<long>").dropDuplicates(["t"]).join(used.select("node", "t"), "t").select("node", "s")
    sets = materialize(sets, "tree-sets")
    left = dealt.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    right = sets.join(stars.withColumnRenamed("b", "node"), "node").select(F.col("node").alias("b"), F.col("s").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sized = left.join(right, ["b", "part"]).select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    out = materialize(sized.where(F.col("both") * 100 >= percent * (F.col("sum") - F.col("both"))).select("a", "b"), "tree-links")
    discard(stars, sets)
    return out


def _live(percent: int):
    """Rows (token, node, n, pos, comp) in order of token: the groups of a token that may hold a link between components, as (token, part, single, nodes, reach, low, high, first, last, digest)."""
    names = ["token", "part", "single", "nodes", "reach", "low", "high", "first", "last", "digest"]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def group(token, part, single, node, n, reach, comp):
        return (token, part, single, node.tolist(), reach.tolist(), int(n.min()), int(n.max()), int(comp.min()), int(comp.max()), xxhash.xxh3_128_digest(np.sort(node)))

    def small(tokens, begin, size, node, n, reach, comp):
        """Groups of at most LEAF sets, all groups of a size at once: their sets that may be alike to another."""
        for k in np.unique(size):
            i = begin[size == k][:, None] + np.arange(k)
            ok = np.minimum(reach[i][:, :, None], reach[i][:, None]) >= need(n[i][:, :, None], n[i][:, None], percent)
            ok &= comp[i][:, :, None] != comp[i][:, None]
            some = ok.any(axis=2)
            for r in np.flatnonzero(some.any(axis=1)):
                j = i[r][some[r]]
                yield group(int(tokens[j[0]]), 0, True, node[j], n[j], reach[j], comp[j])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        held, parts = None, 0  # the last token's sets so far, and how many of its blocks have gone out

        def close(cols, done):
            """The groups of whole runs of tokens; done: the blocks of the first run that have gone out."""
            token, node, n, reach, comp = cols
            begin = np.flatnonzero(np.diff(token, prepend=token[0] - 1)) if len(token) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(token)))
            if done and len(begin):
                j = slice(0, size[0])
                yield group(int(token[0]), done, False, node[j], n[j], reach[j], comp[j])
                begin, size = begin[1:], size[1:]
            if not len(begin):
                return
            mixed = (size > 1) & (np.minimum.reduceat(comp, begin) != np.maximum.reduceat(comp, begin)) if len(begin) else np.zeros(0, bool)
            few = mixed & (size <= LEAF)
            yield from small(token, begin[few], size[few], node, n, reach, comp)
            for a, k in zip(begin[mixed & (size > LEAF)].tolist(), size[mixed & (size > LEAF)].tolist(), strict=True):
                j = slice(a, a + k)
                yield group(int(token[a]), 0, True, node[j], n[j], reach[j], comp[j])

        for batch in batches:
            new = [batch.column(c).to_numpy().astype(np.int64) for c in ("token", "node", "n", "pos", "comp")]
            new[3] = new[2] - new[3]
            cols = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            rows = []
            if last:
                rows += close([c[:last] for c in cols], parts)
                parts = 0
            held = [c[last:] for c in cols]
            while len(held[0]) > BLOCK:
                rows.append(group(int(held[0][0]), parts, False, *(held[c][:BLOCK] for c in (1, 2, 3, 4))))
                held, parts = [c[BLOCK:] for c in held], parts + 1
            if rows:
                yield batch_of(rows)
        rows = list(close(held, parts)) if held is not None else []
        if rows:
            yield batch_of(rows)

    return run


_LIVE = "token long, part int, single boolean, nodes array<long>, reach array<long>, low long, high long, first long, last long, digest binary"


class Tree:
    """Levels of nodes over sets of one width, in the order given; the last has at most FAN nodes."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, reach: np.ndarray, comp: np.ndarray):
        surplus = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, surplus, reach, comp, comp)]
        while len(self.levels[-1][0]) > FAN:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            how = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip(how, self.levels[-1], strict=True)))

    def level(self, i: int):
        return self.levels[min(i, len(self.levels) - 1)]


def pairs_of(left: Tree, right: Tree, percent: int = PERCENT):
    """(i, j, bound): the pairs of sets below two trees that may be alike and aren't of one component, by dual traversal; of one tree with itself, i < j."""
    same = left is right

    def allowed(level, i, j):
        a, b = left.level(level), right.level(level)
        out = np.zeros(len(i), bool)
        bound = np.zeros(len(i), np.int64)
        low = need(a[1][i], b[1][j], percent)
        ok = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
        ok &= np.minimum(a[4][i], b[4][j]) >= low
        ok &= (a[5][i] != b[6][j]) | (a[6][i] != b[5][j])
        if same:
            ok &= (i < j) if level == 0 else (i <= j)
        step = max(1, CHUNK // a[0].shape[1])
        live = np.flatnonzero(ok)
        for k in range(0, len(live), step):
            q = live[k : k + step]
            shared = np.bitwise_count(a[0][i[q]] & b[0][j[q]]).sum(axis=1, dtype=np.int64)
            most = shared + np.minimum(a[3][i[q]], b[3][j[q]])
            bound[q], out[q] = most, most >= low[q]
        return out, bound

    def children(tree, level, i):
        """Bounds of the children of nodes i of a level, one level down."""
        if level >= len(tree.levels):
            return i, i + 1
        return i * FAN, np.minimum(i * FAN + FAN, len(tree.levels[level - 1][0]))

    top = max(len(left.levels), len(right.levels)) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left.level(top)[0])), np.arange(len(right.level(top)[0])), indexing="ij"))
    todo = [(top, i, j)]
    found = []
    while todo:  # depth first, in pieces, so that few pairs wait
        level, i, j = todo.pop()
        ok, bound = allowed(level, i, j)
        i, j = i[ok], j[ok]
        if level == 0:
            found.append((i, j, bound[ok]))
            continue
        for k in range(0, len(i), 4096):
            (a, b), (c, d) = children(left, level, i[k : k + 4096]), children(right, level, j[k : k + 4096])
            n = (b - a) * (d - c)
            own = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            todo.append((level - 1, a[own] + at // (d - c)[own], c[own] + at % (d - c)[own]))
    return tuple(np.concatenate([f[q] for f in found]) if found else np.zeros(0, np.int64) for q in range(3))


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of components to check first, two a component at most: its heaviest one, and the heaviest with the component of most pairs among those that it is paired with."""
    own, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    other = np.roll(code, len(a))
    pair = np.tile(np.arange(len(a)), 2)
    pairs = np.bincount(code, minlength=len(own))
    keep = np.zeros(len(a), bool)
    for keys in ((-weight[pair], code), (-weight[pair], other, -pairs[other], code)):
        order = np.lexsort(keys)
        keep[pair[order[np.searchsorted(code[order], np.arange(len(own)))]]] = True
    return keep


def _traverse(percent: int, turn: int | None = None):
    """The pairs (a, b, bound) of a task's sets (task, side, node, n, reach, comp, sig) that its trees leave: of one side among themselves, or of both across. With a turn, tasks of many pairs give those that span them, by their bounds at first and drawn anew later, and their name."""

    def run(t: pa.Table) -> pa.Table:
        side, node, n, reach, comp = (t.column(c).to_numpy().astype(np.int64) for c in ("side", "node", "n", "reach", "comp"))
        sig = t.column("sig").to_pylist()
        size = np.array([len(x) for x in sig])
        trees = {}
        for s in np.unique(side):
            for w in np.unique(size[side == s]):
                i = np.flatnonzero((side == s) & (size == w))
                i = i[np.lexsort((node[i], n[i], comp[i]))]
                trees[int(s), int(w)] = i, np.frombuffer(b"".join(sig[x] for x in i), "<u8").reshape(len(i), -1)
        two = len(np.unique(side)) > 1
        out = []
        for (s, w), (i, x) in trees.items():
            for (r, v), (j, y) in trees.items():
                if (s, r) != (0, 1) and two or not two and w > v or max(v, w) > 2 * min(v, w):
                    continue
                words = min(v, w) // 8
                left = Tree(_fold(x, words), n[i], reach[i], comp[i])
                right = left if (s, w) == (r, v) else Tree(_fold(y, words), n[j], reach[j], comp[j])
                a, b, bound = pairs_of(left, right, percent)
                out.append((i[a], j[b], bound))
        a, b, bound = (np.concatenate([o[q] for o in out]) if out else np.zeros(0, np.int64) for q in range(3))
        more = turn is not None and len(a) > DENSE * len(node)
        if more:
            weight = _mixed((node[a] * len(node) + node[b]).astype(np.uint64), turn) >> np.uint64(1) if turn else bound
            keep = spanning(comp[a], comp[b], weight.astype(np.int64))
            a, b, bound = a[keep], b[keep], bound[keep]
        a, b = node[a], node[b]
        task = pa.array([t.column("task")[0].as_py() if more else None] * len(a), pa.string())
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "bound": bound, "task": task})

    return run


def groups(nodes: DataFrame, comps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The groups of nodes (node, n, prefix) of each shingle that may hold a link between components (node, comp), written."""
    known = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = known.select("node", "n", "comp", F.posexplode("prefix").alias("pos", "token"))
    runs = rows.repartition("token").sortWithinPartitions("token", "comp", "n", "node").select("token", "node", "n", "pos", "comp")
    return materialize(runs.mapInArrow(_live(percent), _LIVE), "tree-live")


def candidates(nodes: DataFrame, comps: DataFrame, live: DataFrame, percent: int = PERCENT, turn: int | None = None, tasks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, bound) of nodes (node, n, sig) in different components (node, comp) that may be alike, and the tasks that have more of them, both written. Groups are those of ``groups``; tasks: those that still matter."""
    known = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    member = lambda side, nodes, reach: F.transform(F.arrays_zip(nodes.alias("node"), reach.alias("reach")), lambda x: F.struct(F.lit(side).alias("side"), x["node"].alias("node"), x["reach"].alias("reach")))
    # a tree that several shingles have is traversed once, without the place of the shingle in each set's order
    single = live.where("single").dropDuplicates(["digest"]).select(F.hex("digest").alias("task"), F.transform("nodes", lambda x: F.struct(F.lit(0).alias("side"), x.alias("node"), F.lit(None).cast("long").alias("reach"))).alias("all"))
    parts = live.where("not single").drop("single", "digest")
    other = parts.select("token", *(F.col(c).alias(f"{c}_2") for c in parts.columns if c != "token"))
    near = (F.col("high") * 100 >= percent * F.col("low_2")) & (F.col("high_2") * 100 >= percent * F.col("low"))
    mixed = (F.least("first", "first_2") != F.greatest("last", "last_2")) & near
    both = parts.join(other, "token").where((F.col("part") <= F.col("part_2")) & mixed)
    whole = F.when(F.col("part") == F.col("part_2"), member(0, F.col("nodes"), F.col("reach"))).otherwise(F.concat(member(0, F.col("nodes"), F.col("reach")), member(1, F.col("nodes_2"), F.col("reach_2"))))
    crossed = both.select(F.concat_ws(":", "token", "part", "part_2").alias("task"), whole.alias("all"))
    due = single.unionByName(crossed)
    due = due if tasks is None else due.join(tasks, "task", "left_semi")
    sets = due.select("task", F.explode("all").alias("x")).select("task", "x.side", "x.node", "x.reach")
    sets = sets.join(known.select("node", "n", "comp", "sig"), "node").withColumn("reach", F.coalesce("reach", "n"))
    found = materialize(sets.groupBy("task").applyInArrow(_traverse(percent, turn), "a long, b long, bound long, task string"), "tree-found")
    out = materialize(found.groupBy("a", "b").agg(F.max("bound").alias("bound")), "tree-candidates")
    more = materialize(found.where("task is not null").select("task").distinct(), "tree-more")
    discard(found)
    return out, more


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text", words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest id that links reach, itself included)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with tidy(spark):
        ranks = spark.sparkContext.broadcast(slot_ranks(base, words))  # 2^SLOTS bytes
        rows = materialize(base.mapInArrow(*_describe(ranks, words, percent, docs.schema[id_col].dataType.simpleString())), "tree-rows")
        firsts = rows.where("n > 0").groupBy("t").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"))
        nodes = materialize(rows.join(firsts.select("row", "least"), "row").select(F.col("row").alias("node"), "t", "n", "least", F.col("doc_id").alias("own"), "keys", "prefix", "sig"), "tree-nodes")

        seeds = nodes.select("node", F.posexplode("keys").alias("k", "key"))
        heads = seeds.groupBy("k", "key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        pairs = materialize(seeds.join(heads, ["k", "key"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "tree-seeds")
        links = _verified(base, nodes, pairs, words, percent)
        named = lambda edges: components(edges, "a", "b").withColumnRenamed("component", "comp")
        comps = materialize(named(links), "tree-comps")

        live, tasks, checked = groups(nodes, comps, percent), None, None
        comp = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
        for turn in range(TURNS + 1):
            left, tasks = candidates(nodes, comps, live, percent, turn if turn < TURNS else None, tasks)
            if checked is not None:
                left = materialize(left.join(checked, ["a", "b"], "left_anti"), "tree-new")
            checked = left.select("a", "b") if checked is None else checked.unionByName(left.select("a", "b"))
            if left.count() > MANY * nodes.count():  # many: first the best of each set with each component, then what that hasn't linked
                full = left.join(comp("a"), "a", "left").join(comp("b"), "b", "left").withColumns({f"comp_{c}": F.coalesce(f"comp_{c}", c) for c in "ab"})
                best = lambda x, y: full.groupBy(x, f"comp_{y}").agg(F.max_by(F.struct("a", "b"), "bound").alias("p")).select("p.*")  # noqa: B023, E731
                chosen = materialize(best("a", "b").union(best("b", "a")).distinct(), "tree-best")
                links = links.unionByName(_verified(base, nodes, chosen, words, percent))
                comps = materialize(named(links), "tree-comps")
                full = left.join(chosen, ["a", "b"], "left_anti").join(comp("a"), "a", "left").join(comp("b"), "b", "left")
                left = materialize(full.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b"), "tree-rest")
            links = links.unionByName(_verified(base, nodes, left, words, percent))
            if tasks.isEmpty():
                break
            comps = materialize(named(links), "tree-comps")
        discard(live)
        comps = named(links)
        own = nodes.select("node", "t", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        names = own.groupBy("comp").agg(F.min("least").alias("component_id"))
        whole = materialize(own.join(names, "comp").select("t", "component_id"), "tree-components")
        discard(nodes, pairs)
        out = lookup(rows.where("n > 0").select("doc_id", "t", "n"), whole, "t").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_jaccard_join(spark, sf_dir) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
