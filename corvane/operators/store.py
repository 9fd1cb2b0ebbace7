"""Records of one size by ordinal, in files of the shared folder: Spark writes them block by block, and a task reads the records it asks for.

A file holds ``ROWS`` records, so neither a writer nor a reader holds more than one block beside what was asked for. Files
are read by pyarrow, which knows local, HDFS and S3 folders; a file is moved into its place when it is whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import shared_folder

#: Records of a file, and records that are read along rather than skipped between two that are wanted.
ROWS = 1 << 14
GAP = 64


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def put(folder: str, block: int, data: bytes) -> None:
    """Writes a file, or the same again."""
    where, root = _place(folder)
    where.create_dir(root, recursive=True)
    own = f"{root}/_{block}-{uuid.uuid4().hex}"
    with where.open_output_stream(own) as f:
        f.write(data)
    where.move(own, f"{root}/{block}")


@dataclass(frozen=True)
class Store:
    path: str
    width: int
    kind: str
    block: int

    def read(self, at: np.ndarray) -> np.ndarray:
        """The records at ordinals at, in any order."""
        where, root = _place(self.path)
        own, back = np.unique(at, return_inverse=True)
        out, size = np.empty((len(own), self.width), self.kind), self.width * np.dtype(self.kind).itemsize
        block = own // self.block
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(own)], strict=True):
            want = own[a:z] - block[a] * self.block
            cut = np.flatnonzero(np.diff(want) > GAP) + 1
            with where.open_input_file(f"{root}/{block[a]}") as f:
                for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(want)], strict=True):
                    low, n = int(want[s]), int(want[e - 1] - want[s]) + 1
                    raw = np.frombuffer(f.read_at(n * size, low * size), self.kind).reshape(n, self.width)
                    out[a + s : a + e] = raw[want[s:e] - low]
        return out[back]


def write(df: DataFrame, ordinal: str, name: str, width: int, kind: str, fill) -> Store:
    """A store of df's rows: fill(records, places, table) sets the records of a block at the places of the table's rows."""
    each = ROWS
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def save(table: pa.Table) -> pa.Table:
        at = table.column("_o").to_numpy()
        block = int(at[0]) // each
        records = np.zeros((int(at.max()) - block * each + 1, width), kind)
        fill(records, at - block * each, table)
        put(path, block, records.tobytes())
        return pa.table({"n": pa.array([len(at)])})

    rows = df.withColumn("_o", F.col(ordinal).cast("long")).withColumn("_b", F.floor(F.col("_o") / each))
    rows.groupBy("_b").applyInArrow(save, "n long").agg(F.sum("n")).collect()  # one row
    return Store(path, width, kind, each)
