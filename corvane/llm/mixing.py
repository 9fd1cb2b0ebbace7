"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents are shuffled by a digest of their id and laid end to end as a stream of
words, which is cut into blocks of equal length. A golden-ratio sequence is mapped through the
cumulative weights of the sources; the slots that fall to a source are ranked, and slot k takes
block k of the (wrapping) stream. So at any point of the schedule every source has had its share,
to within a few blocks. A source's last slot takes only as many words as its target leaves open.
What a document gives, and where in the mix it stands, is read off the slots that take its blocks.

Prefix sums over a source are taken in two levels, inside digest buckets and over the buckets'
totals, so a source with a third of all rows is spread over all tasks.

Defined results: a null text has size 0; a null source is a source of its own, ordered last;
documents of size 0 take 0 words; repeated rows count as documents of their own (ties in the
shuffled order fall in any order, with equal totals); an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 256
CELLS = 4096
BUCKET_HEX = 3
#: Fractional part of the golden ratio, and of its multiple by 2^20; fixed values.
GOLDEN = 0.6180339887498949
GOLDEN_20 = 0.8114887066185474


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target): target = min(most * size, level * weight), with the one level that makes the sum share * total.

    The level is found by taking sources in the order in which they reach their limit.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("i", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    src = src.withColumn("w", pick).withColumn("top", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy((F.col("top") / F.col("w")).asc(), F.col("i").asc())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    lvl = src.select(
        "source", "source_size", "w", "top",
        F.coalesce(F.sum("top").over(before), F.lit(0.0)).alias("capped"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("rest_w"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest_w"))
    # a source is at its limit while the level that the rest would share lies above it
    lvl = lvl.withColumn("at_limit", F.col("level") * F.col("w") >= F.col("top"))
    free = F.max(F.when(~F.col("at_limit"), F.col("level"))).over(everything)
    return lvl.select("source", "source_size", "w", F.when(F.col("at_limit"), F.col("top")).otherwise(free * F.col("w")).alias("target"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per slot: (slot, source, rank, block, turn, take), ranked per source along the golden-ratio sequence; turn counts the passes over the stream."""
    spark = targets.sparkSession
    b = F.lit(block_words)
    src = targets.where("source_size > 0 and target > 0").select("source", "source_size", F.round("target").cast("long").alias("quota"))
    src = src.withColumn("blocks", F.ceil(F.col("source_size") / b).cast("long"))
    src = src.withColumn("slots", (F.floor(F.col("quota") / F.col("source_size")) * F.col("blocks") + F.ceil((F.col("quota") % F.col("source_size")) / b)).cast("long"))
    by = Window.orderBy(F.col("source").asc_nulls_last())
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.sum("slots").over(everything)
    src = materialize(src.where("slots > 0").select("*", ((F.sum("slots").over(by) - F.col("slots")) / n).alias("lo"), (F.sum("slots").over(by) / n).alias("hi")), "mix-sources")
    total = src.agg(F.sum("slots")).head()[0] or 0
    # points meet the sources' intervals by an equality join on cells of [0, 1)
    cells = src.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    i = F.col("id")
    turn = (F.floor(i / F.lit(1 << 20)) * F.lit(GOLDEN_20) + (i % (1 << 20)) * F.lit(GOLDEN)) % 1.0
    points = spark.range(total).select(i.alias("slot"), turn.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    cells = bounded(materialize(cells, "mix-cells"))
    hit = points.join(cells, "cell").where("u >= lo and u < hi").select("source", "slot")
    ranked = _rank(hit)
    # the sequence is a few slots off the exact share: a source's slots over it are left out, those missing stand at the end, in order of rank
    counts = hit.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("got"))
    late = src.join(counts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "slots", F.coalesce("got", F.lit(0)).alias("got"))
    late = late.where("got < slots").select("source", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
    every = ranked.select("slot", "source", "rank").unionByName(late.select((F.lit(total) + F.col("rank")).alias("slot"), "source", "rank"))
    s = bounded(src.select(F.col("source").alias("s"), "source_size", "quota", "blocks", "slots"))
    out = every.join(s, F.col("source").eqNullSafe(F.col("s"))).where("rank < slots")
    out = out.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("turn", F.floor(F.col("rank") / F.col("blocks")))
    start = F.col("turn") * F.col("source_size") + F.col("block") * b
    take = F.least(b, F.col("source_size") - F.col("block") * b, F.col("quota") - start)
    return out.select("slot", "source", "rank", "block", "turn", take.cast("long").alias("take"))


def _rank(hit: DataFrame, span: int = 1 << 14) -> DataFrame:
    """Rank of each slot among those of its source, in spans of the schedule so that no source fills a task."""
    hit = hit.withColumn("span", F.floor(F.col("slot") / span))
    per = hit.groupBy("source", "span").agg(F.count(F.lit(1)).alias("n"))
    per = per.select(F.col("source").alias("s"), F.col("span").alias("p"), (F.sum("n").over(Window.partitionBy("source").orderBy("span")) - F.col("n")).alias("base"))
    inner = hit.withColumn("r", F.row_number().over(Window.partitionBy("source", "span").orderBy("slot")) - 1)
    return inner.join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p"))).select("source", "slot", (F.col("r") + F.col("base")).alias("rank"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken, first_slot (null if not taken), slots (the first of each copy), source and the columns in keep."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *keep)
    base = base.withColumn("mark", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    base = materialize(base.withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")
    targets = materialize(source_targets(base, weights, share, most), "mix-targets")
    # two-level prefix sum of sizes along the shuffled order
    base = base.withColumn("bucket", F.substring("mark", 1, BUCKET_HEX))
    per = base.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    per = per.select(F.col("source").alias("s"), F.col("bucket").alias("p"), (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base_words"))
    inner = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    laid = base.withColumn("at", inner).join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("p")))
    laid = laid.where("size > 0").select("uid", "source", (F.col("at") + F.col("base_words")).alias("begin"), (F.col("at") + F.col("base_words") + F.col("size")).alias("end"))
    b = F.lit(block_words)
    pieces = laid.select("uid", "source", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("end") - 1) / b))).alias("block"))
    pieces = pieces.select("uid", "source", "block", F.greatest(F.col("begin") - F.col("block") * b, F.lit(0)).alias("x"), F.least(F.col("end") - F.col("block") * b, b).alias("y"))
    slots = schedule(targets, block_words).select(F.col("source").alias("s"), F.col("block").alias("k"), "take", "turn", "slot")
    words = F.greatest(F.least("y", "take") - F.col("x"), F.lit(0))
    met = pieces.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k"))).select("uid", "turn", "slot", words.alias("words")).where("words > 0")
    copies = [F.min(F.when(F.col("turn") == i, F.col("slot"))) for i in range(math.ceil(most))]
    taken = met.groupBy("uid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.filter(F.array(*copies), lambda x: x.isNotNull()).alias("slots"))
    t = bounded(targets.select(F.col("source").alias("s"), "source_size", "target"))
    return base.join(taken, "uid", "left").join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "slots", "source", *keep
    )


def op1_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "slots")


#: The schedule again, slot by slot.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS mark
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1 AS i
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w, CAST(2 AS DOUBLE) * source_size AS top FROM s
), l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(top) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY top / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, i, CASE WHEN level * w >= top THEN top ELSE w * max(CASE WHEN level * w < top THEN level END) OVER () END AS target FROM l
), q AS (
  SELECT source, source_size, i, CAST(round(target) AS BIGINT) AS quota, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks FROM t WHERE source_size > 0 AND round(target) > 0
), n AS (
  SELECT *, (quota // source_size) * blocks + (quota % source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS slots FROM q
), v AS (
  SELECT *, CAST(sum(slots) OVER (ORDER BY i) - slots AS BIGINT) / CAST(sum(slots) OVER () AS BIGINT) AS lo, CAST(sum(slots) OVER (ORDER BY i) AS BIGINT) / CAST(sum(slots) OVER () AS BIGINT) AS hi, CAST(sum(slots) OVER () AS BIGINT) AS total FROM n
), g AS (
  SELECT slot, ((slot // 1048576) * CAST({GOLDEN_20!r} AS DOUBLE) + (slot % 1048576) * CAST({GOLDEN!r} AS DOUBLE)) % CAST(1 AS DOUBLE) AS u FROM range(0, (SELECT max(total) FROM v)) r(slot)
), h AS (
  SELECT i, slot, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS rank FROM g JOIN v ON u >= lo AND u < hi
), z AS (
  SELECT i, slot, rank FROM h
  UNION ALL SELECT v.i, total + r, r FROM v, LATERAL (SELECT unnest(range((SELECT count(*) FROM h WHERE h.i = v.i), slots)) AS r)
), k AS (
  SELECT v.source, v.i, slot, rank % blocks AS block, least({BLOCK_WORDS}, source_size - (rank % blocks) * {BLOCK_WORDS}, quota - (rank // blocks) * source_size - (rank % blocks) * {BLOCK_WORDS}) AS take
  FROM z JOIN v USING (i) WHERE rank < slots
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.i, CAST(sum(d.size) OVER (PARTITION BY t.i ORDER BY d.mark, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), m AS (
  SELECT doc_id, slot, least(a + size, block * {BLOCK_WORDS} + take) - greatest(a, block * {BLOCK_WORDS}) AS words
  FROM p JOIN k ON p.i = k.i AND block * {BLOCK_WORDS} < a + size AND block * {BLOCK_WORDS} + take > a
), x AS (SELECT doc_id, sum(words) AS taken, min(slot) AS first_slot FROM m GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_slot FROM p LEFT JOIN x USING (doc_id)
"""
