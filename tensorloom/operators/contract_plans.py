"""Further plans of a contraction, for skewed keys, one-sided sizes, dense results and bounded memory.

All give what ``contract`` gives. ``contract_by_plan`` chooses one by counts of keys alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions import bits
from tensorloom.functions.running import running_total
from tensorloom.functions.storage import exists, shared_dir, stored, written
from tensorloom.operators.contract import _sides, contract
from tensorloom.operators.dense import BROADCAST_BYTES
from tensorloom.tensor import SparseTensor


class _Sides:
    """Both operands by role: z0 .. free, k0 .. contracted, a and b the values."""

    def __init__(self, x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], strict: bool | None = None):
        if not x_modes:
            raise ValueError("without a contract mode there is no key to deal by")
        self.left, self.right, fx, fy = _sides(x, y, x_modes, y_modes, strict)
        self.keys = [f"k{k}" for k in range(len(x_modes))]
        self.fx = [f"z{k}" for k in range(len(fx))]
        self.fy = [f"z{len(fx) + k}" for k in range(len(fy))]
        self.dims = (*(x.known_dims[m] for m in fx), *(y.known_dims[m] for m in fy)) if x.known_dims and y.known_dims else None

    @property
    def out(self) -> list[str]:
        return self.fx + self.fy

    def summed(self, products: DataFrame) -> SparseTensor:
        return self.tensor(products.groupBy(*self.out).agg(F.sum("p").alias("v")))

    def tensor(self, df: DataFrame) -> SparseTensor:
        if not self.out:
            df = df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
        return SparseTensor(df.select(*(F.col(z).alias(f"i{k}") for k, z in enumerate(self.out)), "v"), len(self.out), self.dims)


def _product():
    return (F.col("a") * F.col("b")).alias("p")


# Skew: keys with too many products are dealt to a grid.
def _grids(sides: _Sides, limit: int) -> DataFrame:
    """(keys, n, m, wide, high): keys of over ``limit`` products, and chunk sizes whose product is within it.

    Both chunks are near the root of the limit; a side that is shorter stays whole and leaves more to the other.
    """
    n = sides.left.groupBy(*sides.keys).agg(F.count("*").alias("n"))
    m = sides.right.groupBy(*sides.keys).agg(F.count("*").alias("m"))
    side = max(1, int(limit**0.5))
    wide = F.when(F.col("n") <= side, F.col("n")).when(F.col("m") <= side, F.floor(F.lit(limit) / F.col("m"))).otherwise(side)
    high = F.when(F.col("n") <= side, F.floor(F.lit(limit) / F.col("n"))).when(F.col("m") <= side, F.col("m")).otherwise(side)
    counts = n.join(m, sides.keys).where(F.col("n") * F.col("m") > limit)
    chunk = lambda c, total: F.least(F.greatest(c.cast("long"), F.lit(1)), F.col(total)).cast("long")
    return counts.select(*sides.keys, "n", "m", chunk(wide, "n").alias("wide"), chunk(high, "m").alias("high"))


def _small(df: DataFrame, rows: int, columns: int) -> DataFrame:
    return F.broadcast(df) if 16 * rows * columns <= BROADCAST_BYTES else df


def _chunked(rows: DataFrame, grids: DataFrame, keys: list[str], own: str, other: str, total: str, mine: str, theirs: str) -> DataFrame:
    """Rows of heavy keys with their chunk, once for each chunk of the other side.

    A row's place among those of its key is its place in its task plus the rows of earlier tasks,
    so no task numbers a whole key.
    """
    held = stored(rows.join(grids, keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftrightunsigned("_at", 33)))
    counts = held.groupBy(*keys, "_task").agg(F.count("*").alias("_n"))
    base = counts.select(*keys, "_task", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_task")) - F.col("_n")).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*keys, "_task").orderBy("_at")) - 1
    placed = held.withColumn("_place", place).join(base, [*keys, "_task"])
    chunk = F.floor((F.col("_base") + F.col("_place")) / F.col(own)).alias(mine)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(total) / F.col(other)) - 1)).alias(theirs)
    return placed.select(*(c for c in rows.columns), chunk, copies)


#: Products of heavy keys that one task makes, cell after cell.
TASK_PRODUCTS = 1 << 27


def contract_grid(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], limit: int = 1 << 24, drop_zeros: bool = False) -> SparseTensor:
    """Contraction under skew: no cell of the join makes more than ``limit`` products of one key.

    Products are counted for each contract key from the key counts of both sides. Keys within the
    limit join as they are. A key over it is a grid of cells, a chunk of x by a chunk of y, of at
    most ``limit`` products each; its rows are copied once for each chunk of the other side. Heavy
    keys are at most all products over the limit, and go to the others by broadcast if few.
    """
    s = _Sides(x, y, x_modes, y_modes)
    grids = stored(_grids(s, limit))
    keys, products = grids.agg(F.count("*"), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()
    few = _small(grids, keys, len(grids.columns))
    # Tasks are sized by products, which Spark can't know from bytes; each has many cells, so that their number stays small.
    least = int(x.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = [side.join(few.select(*s.keys), s.keys, "left_anti").repartition(least, *s.keys) for side in (s.left, s.right)]
    cell, tasks = [*s.keys, "gx", "gy"], max(least, products // max(limit, TASK_PRODUCTS))
    heavy = [side.repartition(tasks, *cell) for side in _cells(s, few)]
    joined = heavy[0].join(heavy[1], cell)
    z = s.summed(light[0].join(light[1], s.keys).select(*s.out, _product()).unionByName(joined.select(*s.out, _product())))
    return z.drop_zeros() if drop_zeros else z


def _cells(s: _Sides, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _chunked(s.left, grids, s.keys, "wide", "high", "m", "gx", "gy"), _chunked(s.right, grids, s.keys, "high", "wide", "n", "gy", "gx")


def grid_cells(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], limit: int) -> DataFrame:
    """(keys, n, m, cells, most): how the heavy keys of ``contract_grid`` are dealt, and the products of the largest cell, as counted from the dealt rows."""
    s = _Sides(x, y, x_modes, y_modes)
    grids = stored(_grids(s, limit))
    left, right = _cells(s, _small(grids, grids.count(), len(grids.columns)))
    a = left.groupBy(*s.keys, "gx", "gy").agg(F.count("*").alias("a"))
    b = right.groupBy(*s.keys, "gx", "gy").agg(F.count("*").alias("b"))
    cells = a.join(b, [*s.keys, "gx", "gy"]).groupBy(*s.keys).agg(F.count("*").alias("cells"), F.max(F.col("a") * F.col("b")).alias("most"))
    return grids.select(*s.keys, "n", "m").join(cells, s.keys)


# One-sided sizes: x is dealt by its free key and never again.
def contract_aligned(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], broadcast_bytes: int = BROADCAST_BYTES, buckets: int | None = None, drop_zeros: bool = False) -> SparseTensor:
    """Contraction without a merge of partial sums: each free key of x lies whole in one task, and so does each result.

    x is dealt once, by ranges of its free key. y goes to every task if its rows, which are counted,
    take no more than ``broadcast_bytes``. Otherwise x is dealt to buckets of its free key, y's
    rows are copied to the buckets that hold their contract key, and both meet within the bucket:
    join and sum need no exchange beyond the two that deal x and y.
    """
    s = _Sides(x, y, x_modes, y_modes)
    if not s.fx:
        raise ValueError("x has no free mode to be dealt by")
    if 8 * s.right.count() * len(s.right.columns) <= broadcast_bytes:
        joined = s.left.repartitionByRange(*s.fx).join(F.broadcast(s.right), s.keys)
        z = s.summed(joined.select(*s.out, _product()))
    else:
        spark = x.df.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        left = s.left.withColumn("bucket", F.pmod(F.xxhash64(*s.fx), F.lit(n)))
        right = s.right.join(left.select("bucket", *s.keys).distinct(), s.keys)
        met = _met_in_buckets(left, right, s, n)
        z = s.tensor(spark.read.schema(met.schema).parquet(written(met)))
    return z.drop_zeros() if drop_zeros else z


def _products_in_buckets(left: DataFrame, right: DataFrame, s: _Sides, n: int, pre_sum: bool = False) -> DataFrame:
    """The products of rows that meet in their bucket: planned in a session that takes rows dealt by bucket as dealt by every key that bucket belongs to."""
    other = left.sparkSession.newSession()
    other.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    other.conf.set("spark.sql.shuffle.partitions", str(n))
    sides = []
    for df, value in ((left, "a"), (right, "b")):
        df = other.read.schema(df.schema).parquet(written(df)).repartition(n, "bucket")
        sides.append(df.groupBy(*(c for c in df.columns if c != value)).agg(F.sum(value).alias(value)) if pre_sum else df)
    return sides[0].join(sides[1], ["bucket", *s.keys]).select("bucket", *s.out, _product())


def _met_in_buckets(left: DataFrame, right: DataFrame, s: _Sides, n: int) -> DataFrame:
    """The sums by free keys of rows that meet in their bucket."""
    return _products_in_buckets(left, right, s, n).groupBy("bucket", *s.out).agg(F.sum("p").alias("v")).drop("bucket")


# More products than cells: keys that lie together are contracted together.
#: Rows of both sides in one bucket of neighbouring keys.
BUCKET_ROWS = 1 << 21
#: Cells of keys that buckets are put together from, counted and broadcast.
KEY_CELLS = 1 << 14


def contract_neighbours(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], pre_sum: bool = False, bucket_rows: int = 0, drop_zeros: bool = False) -> SparseTensor:
    """Contraction that deals both sides by ranges of their first contract key, and adds up each range's products before they move.

    Where neighbouring keys meet the same free keys, a cell of the result leaves a task about once, not once
    for each product: dealt by a hash, every task has a few products of every cell, and the more
    tasks there are the less it can add up. Ranges have about equal rows, ``bucket_rows`` if given; with
    keys in no order this moves what ``contract`` moves.
    """
    s = _Sides(x, y, x_modes, y_modes)
    spark, key = x.df.sparkSession, s.keys[0]
    ends = [side.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).first() for side in (s.left, s.right)]
    if not all(e["n"] for e in ends):
        return contract(x, y, x_modes, y_modes, drop_zeros=drop_zeros)
    low, high, rows = min(e["low"] for e in ends), max(e["high"] for e in ends), sum(e["n"] for e in ends)
    n = max(1, rows // bucket_rows) if bucket_rows else max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    cell = F.shiftright(F.col(key) - F.lit(low), max(0, (high - low).bit_length() - (KEY_CELLS.bit_length() - 1))).alias("cell")
    counts = s.left.select(cell).unionByName(s.right.select(cell)).groupBy("cell").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("cell")) - F.col("rows")  # over KEY_CELLS cells at most
    buckets = stored(counts.select("cell", F.floor(before * n / rows).alias("number")))
    # A number for each bucket that Spark's hash deals to a task of its own.
    labels = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("number")).agg(F.min("id").alias("bucket"))
    buckets = F.broadcast(stored(buckets.join(labels, "number", "left").select("cell", F.coalesce("bucket", F.col("number")).alias("bucket"))))
    left, right = (side.withColumn("cell", cell).join(buckets, "cell").drop("cell") for side in (s.left, s.right))
    met = _products_in_buckets(left, right, s, n, pre_sum).groupBy(*s.out).agg(F.sum("p").alias("v"))
    z = s.tensor(spark.read.schema(met.schema).parquet(written(met)))
    return z.drop_zeros() if drop_zeros else z


# More products than can move: the result is cut to squares, and each square reads the entries that it needs.
#: Products that may move, or so many for an entry; beyond, entries are read several times instead.
MOVED_PRODUCTS, MOVED_EACH = 1 << 24, 4
#: Products of a square on average.
SQUARE_PRODUCTS = 1 << 23
#: Entries of one side in a square, some 16 bytes each.
RANGE_ENTRIES = 1 << 23
#: Entries of one row, all within one part of the contract keys.
PIECE_ENTRIES = 1 << 18
#: Products that a task makes before it adds them up.
PRODUCTS_HELD = 1 << 21
#: Entries whose keys are counted for an estimate of the products.
COUNTED_ENTRIES = 1 << 22


def _estimated_products(s: _Sides, rows: int) -> int:
    """The products of all keys, from the keys of some COUNTED_ENTRIES of ``rows`` entries; only sizes of tasks follow from it."""
    share = max(1, rows // COUNTED_ENTRIES)
    sides = (side.where(F.pmod(F.xxhash64(*s.keys), F.lit(share)) == 0) for side in (s.left, s.right))
    n, m = (side.groupBy(*s.keys).agg(F.count("*").alias(c)) for side, c in zip(sides, "nm", strict=True))
    return share * (n.join(m, s.keys).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)


class _Squares:
    """Operands whose contract keys, and whose cells of the result, are each packed to one long.

    Columns are packed from their least value on, and a free coordinate of null has the number behind the largest.
    """

    def __init__(self, s: _Sides):
        self.s = s
        stat = lambda c: F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c)
        left, right = (
            side.dropna(subset=s.keys).agg(F.count("*").alias("n"), F.count(value).alias("some"), *(stat(c) for c in (*s.keys, *free))).first()
            for side, free, value in ((s.left, s.fx, "a"), (s.right, s.fy, "b"))
        )
        self.entries, self.nulls = (left["n"], right["n"]), (left["n"] - left["some"]) + (right["n"] - right["some"])
        if not all(self.entries):
            return
        ends = {z: tuple(v or 0 for v in side[z]) for side, free in ((left, s.fx), (right, s.fy)) for z in free}
        ends |= {k: (min(left[k]["low"], right[k]["low"]), max(left[k]["high"], right[k]["high"])) for k in s.keys}
        self.low = {c: low for c, (low, _) in ends.items()}
        self.none = {c: high - low + 1 for c, (low, high) in ends.items()}
        self.widths = {c: bits.width(n + (c not in s.keys)) for c, n in self.none.items()}

    def width(self, cols: Sequence[str]) -> int:
        return sum(self.widths[c] for c in cols)

    @property
    def fit(self) -> bool:
        """Whether both take 62 bits at most; values of null have no place in arrays."""
        return all(self.entries) and not self.nulls and self.width(self.s.keys) <= 62 and self.width(self.s.out) <= 62

    def packed(self, side: DataFrame, free: list[str], value: str) -> DataFrame:
        """(key, cell, value), the cell by the side's free coordinates alone."""
        numbers = side.dropna(subset=self.s.keys).select(*(F.coalesce(F.col(c) - F.lit(self.low[c]), F.lit(self.none[c])).alias(c) for c in (*self.s.keys, *free)), F.col(value).alias("value"))
        linear = lambda cols: bits.linearize(cols, [self.widths[c] for c in cols])
        return numbers.select(linear(self.s.keys).alias("key"), linear(free).alias("cell"), "value")

    def unpacked(self, cells: DataFrame) -> DataFrame:
        """(cell, v) with the coordinates that the cell stands for."""
        numbers = bits.delinearize("cell", [self.widths[z] for z in self.s.out])
        return cells.select(*(F.when(n != F.lit(self.none[z]), n + F.lit(self.low[z])).alias(z) for z, n in zip(self.s.out, numbers, strict=True)), "v")


class _Sums:
    """The cells of a square with their sums, in order of cells."""

    def __init__(self):
        self.cells, self.values = np.empty(0, np.int64), np.empty(0)
        self.waiting, self.n = [], 0

    def add(self, cells: np.ndarray, values: np.ndarray) -> None:
        self.waiting.append((cells, values))
        self.n += len(cells)
        if self.n >= PRODUCTS_HELD:
            self.add_up()

    def add_up(self) -> None:
        if not self.n:
            return
        cells, values = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.n = [], 0
        order = np.argsort(cells)
        cells, values = cells[order], values[order]
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        cells, values = cells[starts], np.add.reduceat(values, starts)
        at = np.searchsorted(self.cells, cells)
        known = np.zeros(len(cells), bool)
        inside = np.flatnonzero(at < len(self.cells))
        known[inside] = self.cells[at[inside]] == cells[inside]
        self.values[at[known]] += values[known]
        if not known.all():
            self.cells, self.values = np.insert(self.cells, at[~known], cells[~known]), np.insert(self.values, at[~known], values[~known])


#: Entries by ranges of cells: arrays of one part of the keys, in order of keys, which count from the part's first.
PIECES = "range int, part long, keys binary, cells binary, values binary"


def _narrow(width: int) -> type:
    return np.int32 if width < 32 else np.int64


def _pieces(packed: DataFrame, ranges: int, part_bits: int, cell_bits: int) -> str:
    """Path of PIECES, with a file for each range."""
    types = _narrow(part_bits), _narrow(cell_bits), np.float64
    rows = packed.repartitionByRange(ranges, "cell").sortWithinPartitions("key", "cell").withColumn("range", F.spark_partition_id())

    def pack(batches):
        held, n, of = [], 0, 0

        def rows_of(last: bool):
            nonlocal held, n
            key, cell, value = (np.concatenate(c) for c in zip(*held, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
            key, cell, value = key[starts], cell[starts], np.add.reduceat(value, starts)
            part = key >> part_bits
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(key)]
            held, n = [], 0
            if not last and cuts[-1] - cuts[-2] < PIECE_ENTRIES:  # the open part waits for more
                at = cuts.pop(-2)
                held, n, cuts[-1] = [(key[at:], cell[at:], value[at:])], len(key) - at, at
            whole = [(a, min(a + PIECE_ENTRIES, b)) for start, b in zip(cuts, cuts[1:], strict=False) for a in range(start, b, PIECE_ENTRIES)]
            for a, b in whole:
                arrays = [pa.array([c.astype(t).tobytes()], pa.binary()) for c, t in zip((key[a:b] - (part[a] << part_bits), cell[a:b], value[a:b]), types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([int(part[a])], pa.int64()), *arrays], ["range", "part", "keys", "cells", "values"])

        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(3)[0].as_py()
            held.append(tuple(batch.column(c).to_numpy() for c in range(3)))
            n += batch.num_rows
            if n >= 2 * PIECE_ENTRIES:
                yield from rows_of(False)
        if held:
            yield from rows_of(True)

    return written(rows.mapInArrow(pack, PIECES), maxRecordsPerFile=0)


def contract_squares(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], square_products: int = SQUARE_PRODUCTS, drop_zeros: bool = False) -> SparseTensor:
    """Contraction that moves no product: each side is dealt once, by ranges of its free keys, and a task makes the cells of one range of x by one of y.

    What is shuffled and written is the entries, once; what grows with the products is how often they are
    read: by the root of the number of squares. A range lies in one file, as arrays of one part of
    the contract keys each, so that a task holds two arrays, the other range of y and the cells of its
    square. Sums need no merge. Where coordinates don't pack or a value is null, ``contract_neighbours`` does the job.
    """
    s = _Sides(x, y, x_modes, y_modes)
    spark, q = x.df.sparkSession, _Squares(s)
    if not q.fit:
        return contract_neighbours(x, y, x_modes, y_modes, drop_zeros=drop_zeros)
    ranges = max(1, round((_estimated_products(s, max(q.entries)) / square_products) ** 0.5), -(-max(q.entries) // RANGE_ENTRIES))
    parts = max(1, max(q.entries) // (ranges * PIECE_ENTRIES))
    part_bits = max(0, q.width(s.keys) - parts.bit_length() + 1)
    # Files are read as this session says, whichever one runs the query: a task for each pair of files, none of which is cut.
    other = spark.newSession()
    for name, value in (("files.maxPartitionBytes", 1 << 40), ("files.openCostInBytes", 1 << 40), ("parquet.columnarReaderBatchSize", 4)):
        other.conf.set(f"spark.sql.{name}", str(value))
    sides = []
    for name, side, free, value in (("a", s.left, s.fx, "a"), ("b", s.right, s.fy, "b")):
        pieces = other.read.schema(PIECES).parquet(_pieces(q.packed(side, free, value), ranges, part_bits, q.width(free)))
        sides.append(pieces.select(*(F.col(c).alias(f"{name}_{c}") for c in pieces.columns)))
    # Parts meet while files are walked through, not by a shuffle of their arrays.
    met = sides[0].hint("shuffle_replicate_nl").join(sides[1], F.col("a_part") - F.col("b_part") == 0)
    rows = met.select("a_range", "a_keys", "a_cells", "a_values", "b_range", "b_keys", "b_cells", "b_values")
    types = [t for free in (s.fx, s.fy) for t in (_narrow(part_bits), _narrow(q.width(free)), np.float64)]
    shift = q.width(s.fy)

    def multiply(batches):
        held: dict[int, _Sums] = {}  # by ranges of y
        now = None

        def passed_on():
            for j in list(held):
                one = held.pop(j)
                one.add_up()
                for at in range(0, len(one.cells), PIECE_ENTRIES):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + PIECE_ENTRIES]) for c in (one.cells, one.values)], ["cell", "v"])

        for batch in batches:
            for row in range(batch.num_rows):
                i, j = batch.column(0)[row].as_py(), batch.column(4)[row].as_py()
                if i != now:
                    yield from passed_on()
                    now = i
                key, cell, value, keys, cells, values = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in zip((1, 2, 3, 5, 6, 7), types, strict=True))
                first = np.searchsorted(keys, key, "left")
                n = np.searchsorted(keys, key, "right") - first
                some = np.flatnonzero(n)
                first, n, cell, value = first[some], n[some], cell[some].astype(np.int64) << shift, value[some]
                ends, at = np.cumsum(n), 0
                while at < len(n):
                    # Some PRODUCTS_HELD at once, and those of one entry at least.
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS_HELD, "right")))
                    m = n[at:to]
                    theirs = np.arange(m.sum()) + np.repeat(first[at:to] - (np.cumsum(m) - m), m)
                    held.setdefault(j, _Sums()).add(np.repeat(cell[at:to], m) | cells[theirs], np.repeat(value[at:to], m) * values[theirs])
                    at = to
        yield from passed_on()

    products = spark.createDataFrame([], "cell long, v double").unionByName(rows.mapInArrow(multiply, "cell long, v double"))  # in the caller's session
    z = s.tensor(q.unpacked(products))
    return z.drop_zeros() if drop_zeros else z


def contract_by_products(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], pre_sum: bool = False, drop_zeros: bool = False) -> SparseTensor:
    """``contract_neighbours`` as long as products are few enough to move, ``contract_squares`` beyond."""
    s = _Sides(x, y, x_modes, y_modes)
    rows = max(s.left.count(), s.right.count())
    if _estimated_products(s, rows) > max(MOVED_PRODUCTS, MOVED_EACH * rows):
        return contract_squares(x, y, x_modes, y_modes, drop_zeros=drop_zeros)
    return contract_neighbours(x, y, x_modes, y_modes, pre_sum, drop_zeros=drop_zeros)


# Dense results: tiles are multiplied as arrays.
#: Indices of a tile's side are 2^8; a full tile takes 512 kB.
TILE_BITS = 8
#: Result tiles that a task adds up before it passes them on.
TILES_HELD = 64
#: Entries of both sides for each task that multiplies.
TILE_ENTRIES = 1 << 19


def _packed(df: DataFrame, rows: list[str], columns: list[str], dims: dict[str, int], value: str, names: tuple[str, str], tile_bits: int) -> DataFrame:
    """(tile row, tile column, cells, values): entries with one row for each tile that has any."""
    mask = F.lit((1 << tile_bits) - 1)
    key = lambda cols: bits.linearize(cols, [bits.width(dims[c]) for c in cols]) if cols else F.lit(0).cast("long")
    flat = df.groupBy(key(rows).alias("_r"), key(columns).alias("_c")).agg(F.sum(value).alias("_v"))
    cell = F.shiftleft(F.col("_r").bitwiseAND(mask), tile_bits).bitwiseOR(F.col("_c").bitwiseAND(mask)).cast("int")
    tiles = flat.groupBy(F.shiftrightunsigned("_r", tile_bits).alias(names[0]), F.shiftrightunsigned("_c", tile_bits).alias(names[1]))
    tiles = tiles.agg(F.collect_list(F.struct(cell.alias("cell"), F.col("_v").alias("v"))).alias("all"))  # at most the cells of a tile
    return tiles.select(*names, F.col("all.cell").alias("cells"), F.col("all.v").alias("values"))


def contract_tiles(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], tile_bits: int = TILE_BITS, drop_zeros: bool = False) -> SparseTensor:
    """Contraction for dense results: no row for a product, but one for a pair of tiles.

    Free and contract coordinates are packed to one number each, and cut to tiles of 2^tile_bits by
    2^tile_bits. The result is dealt in squares of tiles that a task can hold, each cut to shares of the contract
    tiles. Tiles of x and y go to the cells of this where they meet, in order of contract tiles, and are multiplied
    as arrays of the rows and columns that they have; so a task passes each cell of its result on once.
    """
    s = _Sides(x, y, x_modes, y_modes)
    fx, fy = ([m for m in range(t.order) if m not in modes] for t, modes in ((x, x_modes), (y, y_modes)))
    dims = dict(zip(s.out, [*(x.dims[m] for m in fx), *(y.dims[m] for m in fy)], strict=True))
    dims |= {k: max(x.dims[a], y.dims[b]) for k, a, b in zip(s.keys, x_modes, y_modes, strict=True)}
    spark = x.df.sparkSession
    width = lambda cols: sum(bits.width(dims[c]) for c in cols)
    # A cell is a square of result tiles that a task can hold, and a share of the contract tiles.
    wide, high = (max(0, width(cols) - tile_bits) for cols in (s.fx, s.fy))
    tj_bits = min(3, high)
    ti_bits = min(6 - tj_bits, wide)
    tj_bits = min(6 - ti_bits, high)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, 2 * spark.sparkContext.defaultParallelism, (x.df.count() + y.df.count()) // TILE_ENTRIES)
    shares = max(1, -(-tasks // (1 << min(20, wide - ti_bits + high - tj_bits))))
    share = F.pmod("tk", F.lit(shares)).alias("share")
    a = stored(_packed(s.left, s.fx, s.keys, dims, "a", ("ti", "tk"), tile_bits).select("*", F.shiftright("ti", ti_bits).alias("gi"), share))
    b = stored(_packed(s.right, s.keys, s.fy, dims, "b", ("tk", "tj"), tile_bits).select("*", F.shiftright("tj", tj_bits).alias("gj"), share))
    # A tile goes to the cells where tiles of the other side wait for it.
    to_a = a.join(b.select("tk", "gj").distinct(), "tk").select("gi", "gj", "share", "tk", F.lit(1).alias("side"), F.col("ti").alias("t"), "cells", "values")
    to_b = b.join(a.select("tk", "gi").distinct(), "tk").select("gi", "gj", "share", "tk", F.lit(0).alias("side"), F.col("tj").alias("t"), "cells", "values")
    dealt = to_a.unionByName(to_b).repartition(tasks, "gi", "gj", "share").sortWithinPartitions("gi", "gj", "share", "tk", "side")
    pairs = dealt.select("tk", "side", "t", "cells", "values")
    side = 1 << tile_bits

    def multiply(batches):
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        now, others = None, []  # the tiles of y at the contract tile at hand

        def passed_on():
            for (i, j), (total, used) in held.items():
                r, c = np.nonzero(used)
                yield pa.RecordBatch.from_arrays([pa.array((i << tile_bits) + r), pa.array((j << tile_bits) + c), pa.array(total[r, c])], ["row", "col", "v"])
            held.clear()

        for batch in batches:
            tk, of, t = (batch.column(k).to_numpy() for k in range(3))
            for n in range(batch.num_rows):
                cells, values = (batch.column(k)[n].values.to_numpy() for k in (3, 4))
                # Only the rows and columns of a tile that have an entry.
                rows, r = np.unique(cells >> tile_bits, return_inverse=True)
                cols, c = np.unique(cells & (side - 1), return_inverse=True)
                p, pu = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)), np.float32)
                p[r, c], pu[r, c] = values, 1
                if of[n] == 0:
                    if tk[n] != now:
                        now, others = tk[n], []
                    place = np.full(side, -1)
                    place[rows] = np.arange(len(rows))
                    others.append((int(t[n]), place, cols, p, pu))
                    continue
                if tk[n] != now:
                    continue
                for tj, place, wide_cols, q, qu in others:
                    met = place[cols]
                    some = np.flatnonzero(met >= 0)
                    if not len(some):
                        continue
                    at = int(t[n]), tj
                    if at not in held:
                        if len(held) >= TILES_HELD:
                            yield from passed_on()
                        held[at] = np.zeros((side, side)), np.zeros((side, side), np.float32)
                    total, used = held[at]
                    where = np.ix_(rows, wide_cols)
                    total[where] += p[:, some] @ q[met[some]]
                    used[where] += pu[:, some] @ qu[met[some]]
        yield from passed_on()

    cells = pairs.mapInArrow(multiply, "row long, col long, v double").groupBy("row", "col").agg(F.sum("v").alias("v"))
    unpack = lambda key, cols: [c.alias(z) for z, c in zip(cols, bits.delinearize(key, [bits.width(dims[z]) for z in cols]), strict=True)]
    z = s.tensor(cells.select(*unpack("row", s.fx), *unpack("col", s.fy), "v"))
    return z.drop_zeros() if drop_zeros else z


# Bounded memory: rounds of x's free keys.
def round_products(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], limit: int) -> DataFrame:
    """(free coordinates of x as z0 .., products, round): free keys in order, cut by the prefix sum of their products.

    Cuts are half the limit apart, so a round makes no more than ``limit`` products unless one free key makes
    over half of that by itself. Free keys without a product have no round.
    """
    s = _Sides(x, y, x_modes, y_modes)
    if not s.fx:
        raise ValueError("x has no free mode to cut by")
    m = s.right.groupBy(*s.keys).agg(F.count("*").alias("m"))
    weights = s.left.join(m, s.keys).groupBy(*s.fx).agg(F.sum("m").alias("products"))
    before = running_total(weights, s.fx, "products", "before")
    return before.select(*s.fx, "products", F.floor(F.col("before") / max(1, limit // 2)).alias("round"))


def contract_rounds(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], limit: int, folder: str | None = None) -> SparseTensor:
    """Contraction in rounds of at most some ``limit`` products (see ``round_products``), each written when it is done.

    x is written once, by round; a round reads its part of it and the y it needs. No free key of x
    is in two rounds, so results need no merge. With a ``folder`` of one's own a run that was
    stopped goes on where it was: cuts and finished rounds that lie there are taken as they are, so
    it must be for the same operands and limit.
    """
    s = _Sides(x, y, x_modes, y_modes)
    spark = x.df.sparkSession
    folder = (folder or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/rounds-{uuid.uuid4().hex}").rstrip("/")
    dealt, counted = f"{folder}/dealt", f"{folder}/rounds"
    if not exists(spark, f"{counted}/_SUCCESS"):
        cuts = stored(round_products(x, y, x_modes, y_modes, limit))
        s.left.join(cuts.select(*s.fx, "round"), s.fx).repartitionByRange("round", *s.fx).write.mode("overwrite").partitionBy("round").parquet(dealt)
        cuts.groupBy("round").agg(F.sum("products").alias("products")).write.mode("overwrite").parquet(counted)
    rounds = sorted(r["round"] for r in spark.read.parquet(counted).select("round").collect())  # a number for each round
    done = []
    for r in rounds:
        path = f"{folder}/result/round={r}"
        if not exists(spark, f"{path}/_SUCCESS"):
            part = spark.read.schema(s.left.schema).parquet(f"{dealt}/round={r}")
            s.summed(part.join(s.right, s.keys).select(*s.out, _product())).df.write.mode("overwrite").parquet(path)
        done.append(path)
    order = len(s.out)
    schema = ", ".join([*(f"i{k} long" for k in range(order)), "v double"])
    df = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    return SparseTensor(df.select(*(f"i{k}" for k in range(order)), "v"), order, s.dims)


def choose_plan(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], limit: int = 1 << 24, dense: float = 1.0) -> str:
    """"tiles", "grid", "aligned" or "join", from key counts: never from entries.

    Tiles if a cell of the result gets ``dense`` products or more on average and coordinates can be
    packed; a grid if one key makes more than ``limit`` products; aligned if y is small enough to
    go everywhere, or if its copies, one for each entry of x with their key at most, are no more than
    the entries of x: then dealing x and the copies moves less than merging partial sums, at any size.
    """
    s = _Sides(x, y, x_modes, y_modes)
    n = s.left.groupBy(*s.keys).agg(F.count("*").alias("n"))
    m = s.right.groupBy(*s.keys).agg(F.count("*").alias("m"))
    each = n.join(m, s.keys, "full").agg(F.sum(F.col("n") * F.col("m")), F.max(F.col("n") * F.col("m")), F.sum("m"), F.sum("n")).first()
    products, largest, rows, entries = (v or 0 for v in each)
    free = [x.dims[i] for i in range(x.order) if i not in x_modes], [y.dims[i] for i in range(y.order) if i not in y_modes]
    keys = [max(x.dims[a], y.dims[b]) for a, b in zip(x_modes, y_modes, strict=True)]
    packs = all(sum(map(bits.width, dims)) <= 63 for dims in (*free, keys))
    cells = reduce(lambda p, d: p * d, [*free[0], *free[1]], 1)
    if packs and cells and products / cells >= dense:
        return "tiles"
    if largest > limit:
        return "grid"
    if s.fx and (8 * rows * len(s.right.columns) <= BROADCAST_BYTES or products <= entries):
        return "aligned"
    return "join"


def contract_by_plan(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], plan: str | None = None, drop_zeros: bool = False) -> SparseTensor:
    """``contract`` by the plan named, or by ``choose_plan``."""
    plans = {"tiles": contract_tiles, "grid": contract_grid, "aligned": contract_aligned, "join": contract}
    return plans[plan or choose_plan(x, y, x_modes, y_modes)](x, y, x_modes, y_modes, drop_zeros=drop_zeros)
