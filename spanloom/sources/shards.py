"""Sharded frame arrays (.npz) as a Spark data source: one partition a shard, headers and frames read by seeking.

    register(spark)
    spark.read.format("npz_headers").load(folder)
    spark.read.format("npz_frames").option("index", ...).load().where("array = 'tx1' and frame >= 100 and frame < 200")

Conditions on `array` and `frame` are pushed into the source: shards outside the range give no partition, and of the others only
the wanted frames are read, as arrays that aren't compressed allow it. Paths may be of any store that Arrow's file systems reach.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

HEADERS = "path string, array string, n_frames long, bins int, channels int"
FRAMES = "array string, frame long, bin int, channel int, re double, im double"
PREFIX = "tx"
#: Frames decoded at once.
STEP = 256


class Header(NamedTuple):
    name: str
    shape: tuple[int, ...]
    dtype: np.dtype
    offset: int         # of the first frame in the member


def header_of(member: BinaryIO) -> tuple[tuple[int, ...], np.dtype, int]:
    version = np.lib.format.read_magic(member)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(member)
    if fortran:
        raise ValueError("frames of an array in column order don't lie together")
    return shape, dtype, member.tell()


def headers(file: BinaryIO) -> list[Header]:
    """Headers of the arrays of a shard, by the archive's directory: no frame is read."""
    with zipfile.ZipFile(file) as z:
        out = []
        for name in sorted(n for n in z.namelist() if n.startswith(PREFIX) and n.endswith(".npy")):
            with z.open(name) as member:
                out.append(Header(name.removesuffix(".npy"), *header_of(member)))
    return out


def read_frames(file: BinaryIO, array: str, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first frame, frames) of the frames [low, high) of an array, `STEP` at a time, from where they lie."""
    with zipfile.ZipFile(file) as z, z.open(f"{array}.npy") as member:
        shape, dtype, offset = header_of(member)
        width = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
        high = min(high, shape[0])
        member.seek(offset + low * width)
        for at in range(low, high, STEP):
            n = min(STEP, high - at)
            yield at, np.frombuffer(member.read(n * width), dtype).reshape(n, *shape[1:])


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The shards of a folder, or the one that is named, in order."""
    system, inner = store(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner))
    head = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npz"))


class Shard(InputPartition):
    def __init__(self, path: str, first: dict[str, int] | None = None, low: int = 0, high: int = 0) -> None:
        super().__init__(path)
        self.path, self.first, self.low, self.high = path, first or {}, low, high


class HeaderReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Shard(p) for p in listed(self.path)]

    def read(self, partition: Shard | None) -> Iterator[tuple]:
        if partition is None:       # as Spark asks where there is no partition
            return
        system, inner = store(partition.path)
        with system.open_input_file(inner) as file:
            for h in headers(file):
                shape = (*h.shape, 1, 1)
                yield partition.path, h.name, int(shape[0]), int(shape[1]), int(shape[2])


class NpzHeaders(DataSource):
    """(path, array, n_frames, bins, channels) of the arrays of the shards of a folder."""

    @classmethod
    def name(cls) -> str:
        return "npz_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options["path"])


class FrameReader(DataSourceReader):
    """Frames of the shards that option `index` lists: JSON of [path, array, first_frame, n_frames]."""

    def __init__(self, index: str) -> None:
        self.index = [tuple(x) for x in json.loads(index)]
        self.array: str | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = tuple(f.attribute) if hasattr(f, "attribute") else ()
            if column == ("array",) and isinstance(f, EqualTo):
                self.array = f.value if self.array in (None, f.value) else ""
            elif column == ("frame",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif column == ("frame",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif column == ("frame",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        shards: dict[str, dict[str, int]] = {}
        for path, array, first, n in self.index:
            if self.array in (None, array) and first < self.high and first + n > self.low:
                shards.setdefault(path, {})[array] = first
        return [Shard(p, arrays, self.low, self.high) for p, arrays in sorted(shards.items())]

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, inner = store(partition.path)
        for array, first in sorted(partition.first.items()):
            with system.open_input_file(inner) as file:
                for at, cube in read_frames(file, array, max(0, partition.low - first), max(0, partition.high - first)):
                    cube = cube.reshape(*cube.shape[:3], *(1,) * max(0, 3 - cube.ndim))
                    frame, b, c = np.indices(cube.shape)
                    values = cube.ravel().astype(np.complex128)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([array] * len(values), pa.string()), pa.array(frame.ravel() + (first + at), pa.int64()), pa.array(b.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()),
                        pa.array(values.real), pa.array(values.imag)], ["array", "frame", "bin", "channel", "re", "im"])


class NpzFrames(DataSource):
    """(array, frame, bin, channel, re, im) of the shards that option `index` lists; frames are counted over all shards of a folder."""

    @classmethod
    def name(cls) -> str:
        return "npz_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options["index"])


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let Spark push conditions into them; again is no harm."""
    spark.dataSource.register(NpzHeaders)
    spark.dataSource.register(NpzFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def shard_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, array, n_frames, first_frame) of .npz shards in order of their paths; a task reads one shard's directory and headers. Keep the table for later reads."""
    register(spark)
    order = Window.partitionBy("array", F.regexp_extract("path", "^(.*)/", 1)).orderBy("path")
    found = spark.read.format("npz_headers").load(path).select("path", "array", "n_frames")
    return found.withColumn("first_frame", F.sum("n_frames").over(order) - F.col("n_frames"))


def frames(spark: SparkSession, path: str, array: str, first: int, last: int, index: DataFrame | None = None) -> DataFrame:
    """(frame, bin, channel, re, im) of the frames [first, last) of an array: only these are read, of the shards that hold some.

    `index` is a table of `shard_index`, made here if none is given. The names of the shards in the range go to the driver, as the list of partitions.
    """
    register(spark)
    index = shard_index(spark, path) if index is None else index
    chosen = index.where((F.col("array") == array) & (F.col("first_frame") < last) & (F.col("first_frame") + F.col("n_frames") > first)).select("path", "array", "first_frame", "n_frames").collect()
    source = spark.read.format("npz_frames").option("index", json.dumps([list(r) for r in chosen])).load()
    return source.where((F.col("array") == array) & (F.col("frame") >= first) & (F.col("frame") < last)).drop("array")


def frame_chunks(spark: SparkSession, path: str, array: str, first: int, last: int, size: int, index: DataFrame | None = None) -> DataFrame:
    """`frames` with chunk: which run of `size` frames from `first` on a frame belongs to."""
    return frames(spark, path, array, first, last, index).withColumn("chunk", F.floor((F.col("frame") - first) / size))
