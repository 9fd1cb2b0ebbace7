"""NumPy files as tables: a reader whose partitions are ranges of rows of one .npy or .npz file, and a sink that writes one.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").option("member", "SW").load("projector.npz")

A matrix gives (id, embedding), a vector (id, value); ids are the rows' numbers. Members of an .npz file that are stored
as they are (``np.savez``) are read in ranges like an .npy file; compressed ones are unpacked by each partition up to its
rows. Files are opened by path where tasks run, so they lie in a folder that the driver and all executors see.

Rows are written to their place in a file made beforehand, so a task that is run again writes the same bytes; the file
gets its name when all have ended.
"""

from __future__ import annotations

import os
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .cache import ordinals

#: Bytes of a partition, and of a batch within it.
PART_BYTES = 64 << 20
BATCH_BYTES = 4 << 20


def _plain(path: str) -> str:
    return path.removeprefix("file://")


@dataclass(frozen=True)
class Layout:
    path: str
    #: offset of the data in the file; None where the member is compressed
    offset: int | None
    member: str | None
    shape: tuple
    dtype: np.dtype
    fortran: bool

    @property
    def kind(self) -> str:
        return "double" if self.dtype.kind == "f" else "long"

    def rows(self, start: int, stop: int) -> np.ndarray:
        if self.offset is None:
            with zipfile.ZipFile(self.path) as z, z.open(self.member) as f:
                return np.lib.format.read_array(f, allow_pickle=False)[start:stop]
        if not self.shape[0]:
            return np.zeros(self.shape, self.dtype)
        return np.memmap(self.path, self.dtype, "r", self.offset, self.shape, "F" if self.fortran else "C")[start:stop]


def _header(f):
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(f)


def layout(path: str, member: str | None = None) -> Layout:
    """Where and how an array lies in its file. Arrays of other than one or two dimensions, or of no numbers, are errors."""
    path, offset, name = _plain(path), None, None
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            names = [n.removesuffix(".npy") for n in z.namelist()]
            if member is None and len(names) > 1:
                raise ValueError(f"{path} has {', '.join(names)}; choose one by the option member")
            if (member or names[0]) not in names:
                raise ValueError(f"{path} has no {member}, but {', '.join(names)}")
            name = f"{member or names[0]}.npy"
            info = z.getinfo(name)
            with z.open(info) as f:
                shape, fortran, dtype = _header(f)
                before = f.tell()
            if info.compress_type == zipfile.ZIP_STORED:
                with open(path, "rb") as f:
                    f.seek(info.header_offset + 26)  # lengths of the name and of the extra field in the member's own header
                    own = f.read(4)
                offset = info.header_offset + 30 + int.from_bytes(own[:2], "little") + int.from_bytes(own[2:], "little") + before
    else:
        with open(path, "rb") as f:
            shape, fortran, dtype = _header(f)
            offset = f.tell()
    if len(shape) not in (1, 2) or dtype.kind not in "fiub":
        raise ValueError(f"{path} holds an array of shape {shape} and type {dtype}, which is no table of numbers")
    return Layout(path, offset, name, shape, dtype, fortran)


@dataclass
class Rows(InputPartition):
    start: int
    stop: int


class NpyReader(DataSourceReader):
    def __init__(self, at: Layout, part_bytes: int):
        self.at, self.part_bytes = at, part_bytes
        self.width = max(1, at.dtype.itemsize * int(np.prod(at.shape[1:])))

    def partitions(self):
        step = max(1, self.part_bytes // self.width)
        return [Rows(a, min(a + step, self.at.shape[0])) for a in range(0, self.at.shape[0], step)] or [Rows(0, 0)]

    def read(self, partition):
        step = max(1, BATCH_BYTES // self.width)
        x = self.at.rows(partition.start, partition.stop)
        for a in range(0, len(x), step):
            part = np.ascontiguousarray(x[a : a + step], np.float64 if self.at.kind == "double" else np.int64)
            ids = pa.array(np.arange(partition.start + a, partition.start + a + len(part)))
            if part.ndim == 1:
                yield pa.RecordBatch.from_arrays([ids, pa.array(part)], ["id", "value"])
            else:
                off = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(off, pa.array(part.ravel()))], ["id", "embedding"])


class NpyWriter(DataSourceWriter):
    """Puts rows (ordinal, vector) in their places of a file of the shape given by options."""

    def __init__(self, path: str, shape: tuple, dtype: str):
        self.path, self.shape, self.dtype = path, shape, dtype
        self.draft = f"{path}.part"
        x = np.lib.format.open_memmap(self.draft, "w+", np.dtype(dtype), shape)
        self.offset = x.offset
        del x

    def write(self, iterator):
        width = np.dtype(self.dtype).itemsize * int(np.prod(self.shape[1:]))
        with open(self.draft, "r+b") as f:
            for ordinal, vector in iterator:
                f.seek(self.offset + ordinal * width)
                f.write(np.asarray(vector, self.dtype).tobytes())
        return WriterCommitMessage()

    def commit(self, messages):
        os.replace(self.draft, self.path)

    def abort(self, messages):
        if os.path.exists(self.draft):
            os.remove(self.draft)


class NpySource(DataSource):
    """Options: member (of an .npz file), part_bytes; for writing rows, dim (absent: a vector) and dtype."""

    @classmethod
    def name(cls):
        return "npy"

    def _layout(self) -> Layout:
        return layout(self.options["path"], self.options.get("member"))

    def schema(self):
        at = self._layout()
        return f"id long, embedding array<{at.kind}>" if len(at.shape) == 2 else f"id long, value {at.kind}"

    def reader(self, schema):
        return NpyReader(self._layout(), int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema, overwrite):
        shape = (int(self.options["rows"]), *([int(self.options["dim"])] if "dim" in self.options else []))
        return NpyWriter(_plain(self.options["path"]), shape, self.options.get("dtype", "<f4"))


def read_npy(spark: SparkSession, path: str, member: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy").options(**options)
    return (reader.option("member", member) if member else reader).load(path)


def write_npy(df: DataFrame, path: str, vec: str = "embedding", order: str = "id", dtype: str = "<f4") -> None:
    """The vectors (or numbers) of df as one array, in the order of a column; a null, or vectors of different lengths, are errors."""
    spark = df.sparkSession
    spark.dataSource.register(NpySource)
    placed = ordinals(df.select(order, vec), order).select("ordinal", F.col(vec).alias("x"))
    vector = dict(df.dtypes)[vec].startswith("array")
    size = F.size("x") if vector else F.lit(1)
    n, least, most, full = placed.agg(F.count(F.lit(1)), F.min(size), F.max(size), F.count("x")).head()
    if full < n or least != most:
        raise ValueError(f"{n} rows, of which {full} have a value, of {least} to {most} numbers")
    options = {"rows": n, "dtype": dtype} | ({"dim": most or 0} if vector else {})
    placed.write.format("npy").mode("append").options(**options).save(path)
