"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document that holds at least ``THRESHOLD`` of its distinct word shingles. Items
are partitioned by size class, the power of two at or above their number of shingles. A class sets how many of an item's shingles
make its sketch, as many as a document that holds enough of the largest item of the class may miss and ``MEET`` more, and so how many
sketch members such a document must hold at least: a search by members loses no match, however long the document
is, and a chance meeting of one member is no candidate. A sketch has the shingles of least hash among those that
fewest items share, so openings that many items have in common are not searched for. Only candidates are
verified, by exact containment of shingle texts.

Documents are scanned once. Two bitmaps of fixed size (``BITS`` bits each, whatever the number of
items) tell which of a document's shingles may belong to a sketch or an item; only documents with
a sketch member go on, with their shingles that may be an item's.

Defined results: a text of fewer than ``SHINGLE`` words is one shingle; a null or wordless item or
document matches nothing; rows of one id and text count once, of one id and several texts each by
itself (the best is returned); null ids are kept apart from others; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .shingles import shingle_hashes
from .tokens import Words, slices

SHINGLE = 5
THRESHOLD = 0.8
#: Members of a sketch that a document with enough of the item is sure to hold, where the item has as many shingles to spare.
MEET = 3
BITS = 24


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def items_of(bench: DataFrame, id_col="item_id", text_col="text", threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """(item_id, shingles, hashes, need, keep, meet): distinct shingles, how many must be met, how many make the sketch, and how many of these must be met."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                first, end, text, h = shingle_hashes(w, n)
                spelled = w.words.to_pylist()
                rows = []
                cut = np.searchsorted(text, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    own = {}
                    for j in range(cut[i], cut[i + 1]):
                        own.setdefault(" ".join(spelled[c] for c in w.codes[first[j] : end[j]]), h[j])
                    size = len(own)
                    need = int(np.ceil(threshold * size - 1e-9))
                    top = 1 << max(size - 1, 0).bit_length()
                    keep = min(size, top - int(np.ceil(threshold * top - 1e-9)) + MEET)
                    rows.append((list(own), np.array(list(own.values()), np.uint64).view(np.int64).tolist(), need, keep, max(1, keep - (size - need))))
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("item_id"), *cols], ["item_id", "shingles", "hashes", "need", "keep", "meet"])

    kind = bench.schema[id_col].dataType.simpleString()
    schema = f"item_id {kind}, shingles array<string>, hashes array<long>, need int, keep int, meet int"
    return bench.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).where(F.size("shingles") > 0)


def sketches(items: DataFrame) -> DataFrame:
    """(item, h, meet): the members of each item's sketch."""
    every = items.select("item", "keep", "meet", F.explode("hashes").alias("h"))
    shared = every.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.floor(F.log2("n")).alias("n"), F.shiftrightunsigned("h", 1).alias("r"), F.col("h").alias("h"))
    own = every.join(shared, "h").groupBy("item", "keep", "meet").agg(F.array_sort(F.collect_list(order)).alias("all"))
    return own.select("item", "meet", F.explode(F.slice("all", F.lit(1), F.col("keep"))["h"]).alias("h"))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the slots of a column h of hashes; parts are joined where they are made, so the driver gets a few of fixed size."""

    def run(batches):
        bits = np.zeros(1 << BITS, bool)
        for b in batches:
            bits[_slot(b.column(0).to_numpy().view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in hashes.coalesce(32).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def contamination(docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, n_shingles, n_hit, containment."""
    spark = docs.sparkSession
    items = materialize(items_of(bench, item_col, item_text, threshold, n).withColumn("item", F.monotonically_increasing_id()), "bench-items")
    members = materialize(sketches(items), "bench-sketches")
    sketch, every = _bitmap(members.select("h")), _bitmap(items.select(F.explode("hashes").alias("h")))
    maps = spark.sparkContext.broadcast((sketch, every))  # two bitmaps of 2**BITS bits

    def has(bits, h):
        s = _slot(h)
        return (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 > 0

    def run(batches):
        sketch, every = maps.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                first, end, text, h = shingle_hashes(w, n)
                met = has(sketch, h)
                go = np.zeros(part.num_rows, bool)
                go[text[met]] = True
                j = np.flatnonzero(go[text] & has(every, h))
                if not len(j):
                    continue
                cut = np.searchsorted(text[j], np.flatnonzero(go))
                cut = np.append(cut, len(j))
                rows = np.flatnonzero(go)
                spell, hits = [], []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    own = {}
                    for x in j[a:b]:
                        own.setdefault(int(h[x]), x)
                    codes = [w.codes[first[x] : end[x]] for x in own.values()]
                    names = {c: w.words[int(c)].as_py() for c in {int(c) for q in codes for c in q}}
                    spell.append([" ".join(names[int(c)] for c in q) for q in codes])
                    hits.append(np.unique(h[j[a:b]][met[j[a:b]]]).view(np.int64).tolist())
                ids = part.column("doc_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(spell, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "found", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    near = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, found array<string>, hits array<long>")
    near = materialize(near.withColumn("mark", F.xxhash64("found")), "bench-near")
    pairs = near.select("doc_id", "mark", F.explode("hits").alias("h")).join(members, "h").groupBy("doc_id", "mark", "item", "meet").agg(F.countDistinct("h").alias("hits")).where("hits >= meet")
    pairs = pairs.select("doc_id", "mark", "item").join(items.select("item", "item_id", "shingles", "need"), "item")
    side = near.dropDuplicates(["doc_id", "mark"]).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "found")
    met = pairs.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    met = met.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"), F.size(F.array_intersect("shingles", "found")).cast("long").alias("n_hit"), "need").where("n_hit >= need")
    best = met.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_hit").alias("n_hit"))
    return best.withColumn("containment", F.col("n_hit") / F.col("n_shingles"))


def op9_decontamination(spark, sf_dir) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT DISTINCT side, id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
  FROM (SELECT side, id, words, unnest(range(1, CASE WHEN len(words) >= 5 THEN len(words) - 3 WHEN len(words) > 0 THEN 2 ELSE 1 END)) AS i FROM w)
), n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE side = 'b' GROUP BY id),
hit AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_hit
  FROM s d JOIN s b ON d.side = 'd' AND b.side = 'b' AND d.shingle = b.shingle GROUP BY 1, 2
)
SELECT doc_id, item_id, n_shingles, n_hit, CAST(n_hit AS DOUBLE) / n_shingles AS containment
FROM hit JOIN n USING (item_id) WHERE n_hit >= ceil(CAST(0.8 AS DOUBLE) * n_shingles - 1e-9)
"""
