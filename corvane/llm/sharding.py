"""Sharding by best-fit-decreasing bin packing.

Equal texts form indivisible groups. Groups enter by falling size, each into the bin with the
tightest remaining capacity that still holds it; the bins are kept in a balanced search tree. Equal
sizes are placed in bulk (the tightest bin stays the tightest until it is full), so packing costs
one tree operation per size class and bin, not one per group. Sizes count exactly to ``1 << BITS``
and are rounded up to BITS significant bits above that, so the driver sees at most
``2 ** (BITS - 1) * (64 - BITS) + 2 ** BITS`` classes, whatever the number of rows.

``pack`` minimises the number of bins of a fixed capacity. ``shard`` has a fixed number of shards
instead and seeks the least capacity at which best fit needs no more bins; a group larger than an
even part of what is left gets a shard of its own first.

Defined results: a null text has no bytes (size 1) and groups with empty texts; null ids and
repeated rows are documents like any other, ordered null first and by text; an empty table gives
none. The law is ``bytes``: shard sizes are as near to equal as indivisible groups allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, materialize, table, text_bytes

SHARDS = 8
BITS = 12
SUBS = 1024


class _Node:
    __slots__ = ("bins", "key", "left", "level", "right")

    def __init__(self, key, bins):
        self.key, self.bins, self.left, self.right, self.level = key, bins, None, None, 1


class BinTree:
    """AA tree from remaining capacity to the bins that have it."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t.left and t.left.level == t.level:
            u = t.left
            t.left, u.right = u.right, t
            return u
        return t

    @staticmethod
    def _split(t):
        if t and t.right and t.right.right and t.right.right.level == t.level:
            u = t.right
            t.right, u.left = u.left, t
            u.level += 1
            return u
        return t

    def add(self, key, bins):
        def put(t):
            if t is None:
                return _Node(key, list(bins))
            if key == t.key:
                t.bins.extend(bins)
                return t
            if key < t.key:
                t.left = put(t.left)
            else:
                t.right = put(t.right)
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key):
        def cut(t, key):
            if t is None:
                return None
            if key < t.key:
                t.left = cut(t.left, key)
            elif key > t.key:
                t.right = cut(t.right, key)
            elif t.left is None or t.right is None:
                return t.left or t.right
            else:
                near = t.right
                while near.left:
                    near = near.left
                t.key, t.bins = near.key, near.bins
                t.right = cut(t.right, near.key)
            low = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if low < t.level:
                t.level = low
                if t.right and low < t.right.level:
                    t.right.level = low
            t = self._skew(t)
            t.right = self._skew(t.right)
            if t.right:
                t.right.right = self._skew(t.right.right)
            t = self._split(t)
            t.right = self._split(t.right)
            return t

        self.root = cut(self.root, key)

    def tightest(self, need):
        """The node of the least key that is at least need."""
        t, best = self.root, None
        while t:
            if t.key >= need:
                t, best = t.left, t
            else:
                t = t.right
        return best


def pack(classes, capacity):
    """classes: (size, count) pairs; returns (number of bins, placements (size, first rank, end rank, bin)).

    Sizes above the capacity get a bin each of their own.
    """
    tree, bins, out = BinTree(), 0, []
    for size, count in sorted(classes, reverse=True):
        rank = 0
        while rank < count:
            node = tree.tightest(size)
            if node is None:
                tree.add(max(capacity, size), [bins])
                bins += 1
                continue
            left, b = node.key, node.bins.pop()
            if not node.bins:
                tree.remove(left)
            n = min(count - rank, left // size)
            out.append((size, rank, rank + n, b))
            tree.add(left - n * size, [b])
            rank += n
    return bins, out


def level(classes, shards):
    """Placements (size, first rank, end rank, shard) of all classes in a fixed number of shards."""
    rest, out, free = {s: n for s, n in classes if n}, [], shards
    total = sum(s * n for s, n in rest.items())
    at = dict.fromkeys(rest, 0)
    while free > 1 and rest and max(rest) * free >= total:
        s = max(rest)
        free -= 1
        out.append((s, at[s], at[s] + 1, free))
        at[s] += 1
        total -= s
        rest[s] -= 1
        if not rest[s]:
            del rest[s]
    items = list(rest.items())
    if items:
        low = max(-(-total // free), max(rest))
        high = low + max(rest)
        placed = None
        while low <= high:
            mid = (low + high) // 2
            n, found = pack(items, mid)
            if n <= free:
                placed, high = found, mid - 1
            else:
                low = mid + 1
        if placed is None:
            while (found := pack(items, high := high + max(rest) + 1))[0] > free:
                pass
            placed = found[1]
        out += [(s, a + at[s], b + at[s], k) for s, a, b, k in placed]
    return out


def _class(size):
    """size rounded up to BITS significant bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))) + 1 - BITS)).cast("long")
    return (F.ceil(size / step) * step).cast("long")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size_bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialize(docs.select(F.col(id_col).alias("doc_id"), (text_bytes(F.col(text_col)) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("sha")), "shard-rows")
    groups = base.groupBy("sha").agg(F.sum("size").alias("group_bytes")).withColumn("c", _class(F.col("group_bytes"))).withColumn("sub", F.pmod(F.xxhash64("sha"), F.lit(256)))
    groups = materialize(groups, "shard-groups")
    per = groups.groupBy("c", "sub").agg(F.count(F.lit(1)).alias("n"))
    hist = [(r["c"], r["n"]) for r in per.groupBy("c").agg(F.sum("n").alias("n")).collect()]  # bounded by BITS
    placed = spark.createDataFrame([(int(s), int(a), int(b), int(k)) for s, a, b, k in level(hist, shards)], "c long, a long, b long, shard int")
    placed = placed.groupBy("c").agg(F.collect_list(F.struct("a", "b", "shard")).alias("at"))  # at most one entry a shard, and one for each group alone
    base_rank = per.select("c", "sub", (F.sum("n").over(Window.partitionBy("c").orderBy("sub")) - F.col("n")).alias("base"))
    ranked = groups.withColumn("r", F.row_number().over(Window.partitionBy("c", "sub").orderBy("sha")) - 1).join(base_rank, ["c", "sub"])
    hit = F.filter("at", lambda x: (x["a"] <= F.col("rank")) & (F.col("rank") < x["b"]))[0]["shard"]
    homes = materialize(ranked.withColumn("rank", F.col("r") + F.col("base")).join(placed, "c").select("sha", hit.alias("shard"), "group_bytes"), "shard-groups-placed")
    out = materialize(lookup(base, homes, "sha").withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(SUBS))), "shard-homes")
    # slots: rank inside (shard, sub) on top of the rows of the subs before
    before = out.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("base"))
    slot = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "sha")) - 1
    return out.withColumn("r", slot).join(before, ["shard", "sub"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("r") + F.col("base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_bytes"
    )


def op2_sharding(spark, sf_dir) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
