"""Table functions for SQL text."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

TOPK = "anchor_id bigint, neighbor_id bigint, rank int, sim double"


class TopK:
    """The k best neighbours of each anchor by falling sim, then id. At most two batches of k and more rows are held: what can't be among the best goes at once."""

    def __init__(self):
        self.held, self.k = None, 0

    def _best(self) -> pa.Table:
        order = [("anchor_id", "ascending"), ("sim", "descending"), ("neighbor_id", "ascending")]
        t = self.held.take(pc.sort_indices(self.held, sort_keys=order))
        anchor = t.column("anchor_id").to_numpy()
        first = anchor.searchsorted(anchor)
        place = pa.array(range(len(t)), pa.int64())
        rank = pc.add(pc.subtract(place, pa.array(first)), 1)
        return t.append_column("rank", rank.cast(pa.int32())).filter(pc.less_equal(rank, self.k))

    def eval(self, k: pa.Array, rows: pa.RecordBatch):
        self.k = k[0].as_py()
        new = pa.table({c: rows.column(c).cast(t) for c, t in (("anchor_id", pa.int64()), ("neighbor_id", pa.int64()), ("sim", pa.float64()))})
        new = new.filter(pc.and_(pc.is_valid(new.column("sim")), pc.is_valid(new.column("anchor_id"))))
        self.held = new if self.held is None else pa.concat_tables([self.held, new])
        self.held = self._best().drop_columns("rank")
        return iter(())

    def terminate(self):
        if self.held is not None:
            yield self._best().select(["anchor_id", "neighbor_id", "rank", "sim"])


def register(spark: SparkSession) -> None:
    """topk(k, TABLE(rows) PARTITION BY anchor_id): rows have anchor_id, neighbor_id and sim."""
    spark.udtf.register("topk", arrow_udtf(TopK, returnType=TOPK))
