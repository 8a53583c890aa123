"""Binary coordinate files, and single files of matrices, read and written by many tasks.

A binary file has, after a head, an array of indices for each mode and then one of values. It is read
in ranges of entries, each from as many places of the file; and written as pieces that tasks encode and
one task appends to each other. Files are opened with pyarrow's file systems: by local path or by URI.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tensorloom.functions.storage import stored
from tensorloom.operators.dense import Matrix
from tensorloom.tensor import SparseTensor, coords

#: First fields of the layout with a head: a magic number, and the bytes of an index and of a value.
HEAD = struct.Struct("<iQQ")
MAGIC = 0x5350
#: Bytes of the start of a file that surely hold its order; dimensions are read after that.
FIRST = 64
#: Entries in one task.
ENTRIES = 1 << 20
#: Bytes of one file of a tensor that is written as a folder of files: what one task appends.
FILE_BYTES = 256 << 20
#: Entries in one batch of a task, and in one piece of a file that is written.
BATCH = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass(frozen=True)
class Layout:
    """What a file's first bytes say. Order, dimensions and count are as wide as an index."""

    dims: tuple[int, ...]
    count: int
    index: str
    value: str
    start: int

    @classmethod
    def of(cls, path: str, header: bool) -> Layout:
        system, at = opened(path)
        with system.open_input_file(at) as f:
            index = value = 8
            skip = 0
            first = f.read_at(min(FIRST, f.size()), 0)
            if header:
                _, index, value = HEAD.unpack_from(first)
                skip = HEAD.size
                if index not in (4, 8) or value not in (4, 8):
                    raise ValueError(f"{path}: indices of {index} and values of {value} bytes")
            kind = f"<u{index}"
            order = int(np.frombuffer(first, kind, 1, skip)[0])
            if not 1 <= order <= 1 << 10:
                raise ValueError(f"{path}: order {order}")
            numbers = np.frombuffer(f.read_at(index * (order + 1), skip + index), kind)
            out = cls(tuple(map(int, numbers[:order])), int(numbers[order]), kind, f"<f{value}", skip + index * (order + 2))
            if (size := f.size()) < out.end:
                raise ValueError(f"{path}: {size} bytes of {out.end}")
        return out

    def place(self, mode: int, entry: int) -> int:
        """Where an entry's index of a mode lies; its value, with the mode behind the last."""
        return self.start + mode * self.count * int(self.index[2]) + entry * int((self.value if mode == len(self.dims) else self.index)[2])

    @property
    def end(self) -> int:
        return self.place(len(self.dims), self.count)


@dataclass
class Entries(InputPartition):
    """A range of the entries of a file."""

    path: str
    first: int
    last: int


class CoordinateReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.header = options["path"], options.get("header", "true") == "true"
        self.entries = int(options.get("entries", ENTRIES))

    def files(self) -> list[str]:
        system, at = opened(self.path)
        if system.get_file_info(at).type != fs.FileType.Directory:
            return [self.path]
        found = system.get_file_info(fs.FileSelector(at))
        return [f"{self.path.rstrip('/')}/{i.base_name}" for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and i.base_name[:1] not in "_."]

    def layout(self) -> Layout:
        return Layout.of(self.files()[0], self.header)

    def partitions(self) -> list[Entries]:
        out = []
        for path in self.files():
            n = Layout.of(path, self.header).count
            out += [Entries(path, k, min(n, k + self.entries)) for k in range(0, n, self.entries)]
        return out or [Entries("", 0, 0)]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        layout = Layout.of(partition.path, self.header)
        order = len(layout.dims)
        system, at = opened(partition.path)
        with system.open_input_file(at) as f:
            for k in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - k)
                cols = []
                for m in range(order + 1):
                    kind = np.dtype(layout.value if m == order else layout.index)
                    cols.append(np.frombuffer(f.read_at(n * kind.itemsize, layout.place(m, k)), kind))
                    if m < order and n and cols[m].max() >= layout.dims[m]:
                        raise ValueError(f"{partition.path}: an index of mode {m} is not below {layout.dims[m]}")
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols[:-1]), pa.array(cols[-1].astype(np.float64))], [*coords(order), "v"])


class CoordinateFiles(DataSource):
    """``spark.read.format("tensor_bin")``: options path (a file, or a folder of files alike), header and entries (in one task)."""

    @classmethod
    def name(cls) -> str:
        return "tensor_bin"

    def schema(self) -> StructType:
        order = len(CoordinateReader(self.options).layout().dims)
        return StructType([*(StructField(c, LongType()) for c in coords(order)), StructField("v", DoubleType())])

    def reader(self, schema: StructType) -> CoordinateReader:
        return CoordinateReader(self.options)


def read_bin(spark: SparkSession, path: str, header: bool = True, entries: int = ENTRIES) -> SparseTensor:
    """Binary files: (head,) order, dimensions, count, an index array for each mode, values.

    A file of any size is read by many tasks, ``entries`` in each, which hold one batch at a time. A
    file that is too short, or an index that is not below its dimension, raises. The dimensions of
    several files are the largest.
    """
    spark.dataSource.register(CoordinateFiles)
    options = {"path": path, "header": str(header).lower(), "entries": str(entries)}
    layouts = [Layout.of(f, header) for f in CoordinateReader(options).files()]
    if len({len(x.dims) for x in layouts}) != 1:
        raise ValueError(f"{path} holds files of different orders")
    dims = tuple(map(max, zip(*(x.dims for x in layouts), strict=True)))
    return SparseTensor(spark.read.format("tensor_bin").options(**options).load(), len(dims), dims)


def join_pieces(pieces: DataFrame, head: bytes, path: str) -> int:
    """Write head and then the bytes of pieces(section, seq, bytes), in this order, as one file; its size.

    One task takes sorted pieces and appends each as it comes; see ``join_files``.
    """
    return join_files(pieces.withColumn("file", F.lit(0)), [(path, head)])


def join_files(pieces: DataFrame, files: list[tuple[str, bytes]]) -> int:
    """Write files (path, head), each its head and then the bytes of its pieces(file, section, seq, bytes) in order; the size of all.

    One task for each file takes its sorted pieces and appends each as it comes; it writes under another
    name first, so that a task that is lost leaves nothing under a path. The folder must be one that
    all executors share.
    """

    def append(batches):
        now, out, draft, at, size = None, None, "", "", 0

        def ended():
            nonlocal size
            size += out.tell()
            out.close()
            system.move(draft, at)

        for batch in batches:
            for file, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file != now:
                    if out:
                        ended()
                    now = file
                    system, at = opened(files[file][0])
                    draft = f"{at}.{uuid.uuid4().hex}"
                    system.create_dir(os.path.dirname(at), recursive=True)
                    out = system.open_output_stream(draft)
                out.write(cell.as_buffer())
        if out:
            ended()
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], ["size"])

    columns = ["file", "section", "seq", "bytes"]
    heads = pieces.sparkSession.createDataFrame([(k, -1, 0, head) for k, (_, head) in enumerate(files)], "file int, section int, seq long, bytes binary")
    ordered = pieces.select(*columns).unionByName(heads).repartitionById(len(files), "file").sortWithinPartitions("file", "section", "seq").select("file", "bytes")
    return sum(r["size"] for r in ordered.mapInArrow(append, "size long").collect())


def _encoded(rows: DataFrame, encoders: list[Callable[[pa.Array], bytes]], batch: int = BATCH) -> DataFrame:
    """(section, seq, bytes): each column of rows encoded in pieces, numbered in the order of tasks."""

    def encode(batches):
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                made = [f(part.column(m)) for m, f in enumerate(encoders)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array([seq] * len(made), pa.int64()), pa.array(made, pa.binary())], ["section", "seq", "bytes"])
                seq += 1

    return rows.mapInArrow(encode, "section int, seq long, bytes binary")


def write_bin(x: SparseTensor, path: str, header: bool = True, index_bytes: int = 8, value_bytes: int = 8, file_bytes: int | None = None) -> None:
    """One binary file of the whole tensor, or a folder of several of at most ``file_bytes`` each, for tools that read such files.

    Tasks encode their entries in pieces, one for each mode and for values; a task for each file
    appends its pieces mode by mode, in the order of tasks. Each file has the head, the dimensions of the
    tensor and its own count, as ``read_bin`` takes them.
    """
    if not header and (index_bytes, value_bytes) != (8, 8):
        raise ValueError("without a head indices and values have 8 bytes")
    if max(x.dims, default=0) > 1 << (8 * index_bytes - (index_bytes == 8)):
        raise ValueError(f"indices below {max(x.dims)} don't fit in {index_bytes} bytes")
    raw = lambda kind: lambda column: column.to_numpy(zero_copy_only=False).astype(kind).tobytes()
    # Written once: pieces are counted and joined from the same rows.
    pieces = stored(_encoded(x.df.select(*x.coords, "v"), [raw(f"<u{index_bytes}")] * x.order + [raw(f"<f{value_bytes}")]))
    sizes = pieces.where(F.col("section") == x.order).select("seq", (F.octet_length("bytes") / value_bytes).cast("long").alias("n")).orderBy("seq").collect()  # two numbers for each piece
    counts, first = [0], []
    for seq, n in sizes:
        if file_bytes and counts[-1] and (counts[-1] + n) * (x.order * index_bytes + value_bytes) > file_bytes:
            counts.append(0)
            first.append(seq)
        counts[-1] += n
    head = HEAD.pack(MAGIC, index_bytes, value_bytes) if header else b""
    heads = [head + np.array([x.order, *x.dims, n], f"<u{index_bytes}").tobytes() for n in counts]
    paths = [path] if len(counts) == 1 else [f"{path}/{k:06d}.bin" for k in range(len(counts))]
    file = sum(((F.col("seq") >= s).cast("int") for s in first), F.lit(0))
    join_files(pieces.withColumn("file", file), list(zip(paths, heads, strict=True)))


def _decimals(column: pa.Array) -> bytes:
    return "".join(f"{v:.20f}\n" for v in column.to_pylist()).encode()


def _whole(rows: DataFrame, length: int, cells: list[str]) -> DataFrame:
    """Rows 0 to length - 1 in order, of zeros where one is missing."""
    every = rows.sparkSession.range(length).withColumnRenamed("id", "row")
    return every.join(rows, "row", "left").repartitionByRange("row").sortWithinPartitions("row").select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in cells))


def write_matrix(a: Matrix, path: str) -> None:
    """Text: "matrix", 2, rows and rank, then the cells column by column. Tasks format ranges of rows, in a piece for each column."""
    join_pieces(_encoded(_whole(a.df, a.rows, a.cols), [_decimals] * a.rank), f"matrix\n2\n{a.rows} {a.rank}\n".encode(), path)


def write_vector(df: DataFrame, length: int, path: str) -> None:
    """Text: "vector", 1, the length, then the cells of df(row, v)."""
    join_pieces(_encoded(_whole(df, length, ["v"]), [_decimals]), f"vector\n1\n{length}\n".encode(), path)


def write_kruskal(weights, factors: list[Matrix], prefix: str) -> None:
    """A matrix file for each factor and a vector file of the weights."""
    for n, a in enumerate(factors):
        write_matrix(a, f"{prefix}.{n}.out")
    spark = factors[0].df.sparkSession
    write_vector(spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "row long, v double"), len(weights), f"{prefix}.lambda.out")
