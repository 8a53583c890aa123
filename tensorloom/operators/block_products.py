"""MTTKRP that works on a format: blocks, parts and streams of packed entries, never a row for an entry.

Entries travel packed, as arrays of coordinates or keys in one row for a block. Factors come as slices of
consecutive rows. What is joined and shuffled are blocks and slices; products are made on arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import bits
from tensorloom.functions.running import running_total
from tensorloom.functions.storage import stored
from tensorloom.operators.dense import BROADCAST_BYTES, Matrix
from tensorloom.tensor import SparseTensor


def _checked(dims: Sequence[int], factors: Sequence[Matrix], mode: int) -> int:
    """The rank, if there is a factor of it for every mode and each but that of ``mode`` has a row for each index."""
    rank = factors[0].rank
    if len(factors) != len(dims) or any(f.rank != rank for f in factors):
        raise ValueError("one factor of equal rank for each mode")
    if not 0 <= mode < len(dims):
        raise ValueError(f"mode {mode} of a tensor of order {len(dims)}")
    for m, f in enumerate(factors):
        if m != mode and f.rows and f.rows < dims[m]:
            raise ValueError(f"factor {m} has {f.rows} rows for a dimension of {dims[m]}")
    return rank


def factor_slices(f: Matrix, slice_bits: int, name: str) -> DataFrame:
    """(name, name_at, name_cells): 2^slice_bits consecutive rows of a factor in one row, with their places and cells."""
    at = F.col("row").bitwiseAND(F.lit((1 << slice_bits) - 1)).cast("int")
    rows = f.df.groupBy(F.shiftright("row", slice_bits).alias(name)).agg(F.collect_list(F.struct(at.alias("at"), F.array(*f.cols).alias("cells"))).alias("all"))
    return rows.select(name, F.col("all.at").alias(f"{name}_at"), F.flatten("all.cells").alias(f"{name}_cells"))


def _slice_join(blocks: DataFrame, f: Matrix, slice_bits: int, name: str, broadcast_bytes: int) -> DataFrame:
    slices = factor_slices(f, slice_bits, name)
    # A block whose slice is missing stays, so that its task can say so.
    return blocks.join(F.broadcast(slices) if 8 * f.rows * (f.rank + 1) <= broadcast_bytes else slices, name, "left")


#: Which rows of a stream are blocks; the others, 0 .., are slices and come before them.
BLOCKS = 1 << 10


def _streamed(blocks: DataFrame, slices: list[tuple[str, Matrix, int]], columns: list[str], broadcast_bytes: int) -> DataFrame:
    """(deal, which, at, cells, columns): blocks behind the slices that they need, each slice once for all blocks of a deal.

    Blocks that need the same slices are a deal, and lie next to each other in one task; so what
    moves is each block once and a slice once for each deal, not once for each block.
    """
    names = [name for name, _, _ in slices]
    # Few deals are cut by block, so that all tasks have some.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(1, -(-4 * tasks // max(1, blocks.select(*names).distinct().count())))
    dealt = blocks.withColumn("piece", F.pmod(F.xxhash64(columns[0]), F.lit(pieces)))
    key = F.struct(*names, "piece").alias("deal")
    groups = dealt.select(*names, "piece").distinct()
    empty = [F.lit(None).cast(dict(blocks.dtypes)[c]).alias(c) for c in columns]
    rows = dealt.select(key, F.lit(BLOCKS).alias("which"), F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<double>").alias("cells"), *columns)
    for k, (name, f, slice_bits) in enumerate(slices):
        found = _slice_join(groups, f, slice_bits, name, broadcast_bytes)
        rows = rows.unionByName(found.select(key, F.lit(k).alias("which"), F.col(f"{name}_at").alias("at"), F.col(f"{name}_cells").alias("cells"), *empty))
    return rows.repartition(tasks, "deal").sortWithinPartitions("deal", "which").select("which", "at", "cells", *columns)


def _stretches(batches: Iterable[pa.RecordBatch], slices: int) -> Iterator[tuple[list, pa.RecordBatch]]:
    """(slices, rows of blocks that need them) of a stream; slices are held until the next ones of their kind."""
    held: list = [None] * slices
    for batch in batches:
        which = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(which) != 0) + 1
        for low, high in zip([0, *cuts], [*cuts, len(which)], strict=True):
            if low == high:
                continue
            if which[low] == BLOCKS:
                yield held, batch.slice(low, high - low)
            else:
                for n in range(low, high):
                    held[which[n]] = _value(batch.column(1), n), _value(batch.column(2), n)


def _flat(column) -> np.ndarray:
    """The cells of all lists of a column."""
    return column.flatten().to_numpy(zero_copy_only=False)


def _lengths(column) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False)


def _rows_of(at, cells, slice_bits: int, rank: int, needed: np.ndarray) -> np.ndarray:
    """The factor's rows at the places needed, from a slice."""
    if at is None:
        raise ValueError("a factor has no row for an index of the tensor")
    place = np.full(1 << slice_bits, -1)
    place[at] = np.arange(len(at))
    found = place[needed]
    if len(found) and found.min() < 0:
        raise ValueError("a factor has no row for an index of the tensor")
    return cells.reshape(-1, rank)[found]


def _summed(index: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products by index: a private buffer over the interval of indices, or sorted if that is mostly empty."""
    if not len(index):
        return index, products
    low, width = index.min(), int(index.max() - index.min()) + 1
    if width <= 8 * len(index) + 1024:
        local = index - low
        used = np.flatnonzero(np.bincount(local, minlength=width))
        sums = np.stack([np.bincount(local, products[:, r], minlength=width)[used] for r in range(products.shape[1])], 1)
        return used + low, sums
    order = np.argsort(index, kind="stable")
    rows, first = np.unique(index[order], return_index=True)
    return rows, np.add.reduceat(products[order], first, axis=0)


def _value(column, n: int):
    """Cell n of an Arrow list column as an array, or None."""
    cell = column[n]
    return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else None


def _out(rows: np.ndarray, sums: np.ndarray, *more) -> pa.RecordBatch:
    cols = [pa.array(rows.astype(np.int64)), *(pa.array(np.ascontiguousarray(sums[:, r])) for r in range(sums.shape[1])), *more]
    return pa.RecordBatch.from_arrays(cols, ["row", *(f"c{r}" for r in range(sums.shape[1])), *(f"m{k}" for k in range(len(more)))])


def _merged(parts: DataFrame, rows: int, rank: int) -> Matrix:
    return Matrix(parts.groupBy("row").agg(*(F.sum(f"c{r}").alias(f"c{r}") for r in range(rank))), rows, rank)


# HiCOO
def hicoo_packed(x: SparseTensor, block_bits: int) -> DataFrame:
    """(b0 .., e0 .., values): a row for each block, with arrays of in-block coordinates and values. Repeated coordinates are added up, so a block has its cells at most."""
    names = [f"b{m}" for m in range(x.order)]
    mask = F.lit((1 << block_bits) - 1)
    rows = x.coalesce().df.select(*(F.shiftright(c, block_bits).alias(b) for c, b in zip(x.coords, names, strict=True)), F.struct(*(F.col(c).bitwiseAND(mask).cast("int").alias(f"e{m}") for m, c in enumerate(x.coords)), "v").alias("entry"))
    packed = rows.groupBy(*names).agg(F.collect_list("entry").alias("all"))
    return packed.select(*names, *(F.col(f"all.e{m}").alias(f"e{m}") for m in range(x.order)), F.col("all.v").alias("values"))


def mttkrp_hicoo(blocks: DataFrame, dims: Sequence[int], block_bits: int, factors: Sequence[Matrix], mode: int, broadcast_bytes: int = BROADCAST_BYTES) -> Matrix:
    """MTTKRP on ``hicoo_packed`` blocks: each meets one slice of every other factor, by block number.

    Rows that move are blocks and slices; products are made on the arrays of all blocks of a batch that
    need the same slices, and added up there. A missing factor row raises.
    """
    rank, order = _checked(dims, factors, mode), len(dims)
    others = [m for m in range(order) if m != mode]
    df = _streamed(stored(blocks), [(f"b{m}", factors[m], block_bits) for m in others], [f"b{mode}", "values", *(f"e{m}" for m in [mode, *others])], broadcast_bytes)

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, rows in _stretches(batches, len(others)):
            products = np.repeat(_flat(rows.column(4))[:, None], rank, 1)
            for k in range(len(others)):
                products = products * _rows_of(*held[k], block_bits, rank, _flat(rows.column(6 + k)))
            base = np.repeat(rows.column(3).to_numpy(), _lengths(rows.column(4)))
            yield _out(*_summed(_flat(rows.column(5)) + (base << block_bits), products))

    return _merged(df.mapInArrow(multiply, _schema(rank)), dims[mode], rank)


def _schema(rank: int, more: str = "") -> str:
    return "row long, " + ", ".join(f"c{r} double" for r in range(rank)) + more


# ALTO
#: A part is packed in one row, so it has so many entries at most (16 MB).
PART = 1 << 20


@dataclass(frozen=True)
class AltoParts:
    """A tensor in order of its interleaved keys, cut to parts of equal numbers of entries; a row of ``df`` is a part."""

    df: DataFrame
    dims: tuple[int, ...]
    conflicts: DataFrame
    """(mode, i): the indices that more than one part has."""

    @property
    def places(self) -> list[tuple[int, int]]:
        return bits.alto_places([bits.width(d) for d in self.dims])


def _decoded(keys: np.ndarray, places: Sequence[tuple[int, int]], order: int) -> list[np.ndarray]:
    """Coordinates from interleaved keys: bits that stay together move together."""
    out = [np.zeros(len(keys), np.int64) for _ in range(order)]
    k = 0
    while k < len(places):
        m, b = places[k]
        run = 1
        while k + run < len(places) and places[k + run] == (m, b + run):
            run += 1
        out[m] |= ((keys >> k) & ((1 << run) - 1)) << b
        k += run
    return out


def alto_packed(x: SparseTensor, parts: int) -> AltoParts:
    """Entries (repeated ones added up) by interleaved key in ``parts`` packed parts, more if they would be too large."""
    dims = tuple(x.dims)
    keyed = stored(x.coalesce().df.select(bits.alto(x.coords, [bits.width(d) for d in dims]).alias("key"), *x.coords, "v", F.lit(1).cast("long").alias("one")))
    each = max(1, min(PART, -(-keyed.count() // parts)))
    dealt = stored(running_total(keyed, "key", "one", "before").withColumn("part", F.floor(F.col("before") / each)))
    packed = dealt.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("key", "v"))).alias("all"), *(f(c).alias(f"{n}{m}") for m, c in enumerate(x.coords) for f, n in ((F.min, "low"), (F.max, "high"))))
    rows = dealt.select("part", F.posexplode(F.array(*x.coords)).alias("mode", "i"))
    shared = rows.groupBy("mode", "i").agg((F.min("part") < F.max("part")).alias("shared")).where("shared").select("mode", "i")
    bounds = [f"{n}{m}" for m in range(x.order) for n in ("low", "high")]
    return AltoParts(stored(packed.select("part", *bounds, F.col("all.key").alias("keys"), F.col("all.v").alias("values"))), dims, stored(shared))


def mttkrp_alto(x: AltoParts, factors: Sequence[Matrix], mode: int, broadcast_bytes: int = BROADCAST_BYTES) -> Matrix:
    """MTTKRP over parts: each adds up in a buffer of its own over its interval of the mode.

    Rows that only one part has are final and pass on. Only those of several parts
    (``AltoParts.conflicts``) are shuffled and merged. Factors go to every task as arrays and must
    fit ``broadcast_bytes`` together, as must the list of shared rows; ``mttkrp_blco`` is for larger ones.
    """
    rank, order, places = _checked(x.dims, factors, mode), len(x.dims), x.places
    if sum(8 * f.rows * rank for m, f in enumerate(factors) if m != mode) > broadcast_bytes:
        raise ValueError("the factors are too large to go to every task")
    spark = x.df.sparkSession
    own = x.conflicts.where(F.col("mode") == mode).select("i")
    if 8 * own.count() > broadcast_bytes:
        raise ValueError("too many rows are shared by parts to go to every task")
    shared = spark.sparkContext.broadcast(np.sort(np.array([r.i for r in own.collect()], np.int64)))
    arrays = {}
    for m, f in enumerate(factors):
        if m != mode:
            arrays[m] = np.full((max(f.rows, x.dims[m]), rank), np.nan)
            table = f.df.select("row", *f.cols).toArrow()
            arrays[m][table.column(0).to_numpy()] = np.stack([table.column(1 + r).to_numpy() for r in range(rank)], 1)
    sent = spark.sparkContext.broadcast(arrays)

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                at = _decoded(_value(batch.column(0), n), places, order)
                products = np.repeat(_value(batch.column(1), n)[:, None], rank, 1)
                for m, a in sent.value.items():
                    products = products * a[at[m]]
                if np.isnan(products).any() and any(np.isnan(a[at[m]]).any() for m, a in sent.value.items()):
                    raise ValueError("a factor has no row for an index of the tensor")
                rows, sums = _summed(at[mode], products)
                yield _out(rows, sums, pa.array(np.isin(rows, shared.value)))

    # Written once: final rows and rows to be merged are read from there.
    made = stored(x.df.select("keys", "values").mapInArrow(multiply, _schema(rank, ", m0 boolean")))
    cells = [f"c{r}" for r in range(rank)]
    merged = made.where("m0").groupBy("row").agg(*(F.sum(c).alias(c) for c in cells))
    return Matrix(made.where("NOT m0").select("row", *cells).unionByName(merged), x.dims[mode], rank)


# BLCO
@dataclass(frozen=True)
class BlcoBatches:
    """Packed batches (block, keys, values) of at most ``largest`` entries; the block holds the high bits of the key."""

    df: DataFrame
    dims: tuple[int, ...]
    low_bits: int
    largest: int

    @property
    def places(self) -> list[tuple[int, int]]:
        return bits.alto_places([bits.width(d) for d in self.dims])

    def free_bits(self) -> list[int]:
        """For each mode, the bits of its index that the low part of the key has: a block spans that many bits of it."""
        out = [0] * len(self.dims)
        for m, _ in self.places[: self.low_bits]:
            out[m] += 1
        return out

    def batch_bytes(self, rank: int) -> int:
        """What a batch and its factor slices take in a task at most."""
        return 8 * (self.largest * (2 + rank) + sum((1 << b) * (rank + 1) for b in self.free_bits()))


def blco_packed(x: SparseTensor, low_bits: int, largest: int) -> BlcoBatches:
    from tensorloom.operators.layout import blco_blocks

    rows = blco_blocks(x, low_bits, largest)
    packed = rows.groupBy("block", "part").agg(F.collect_list(F.struct("key", "v")).alias("all"))
    return BlcoBatches(stored(packed.select("block", F.col("all.key").alias("keys"), F.col("all.v").alias("values"))), tuple(x.dims), low_bits, largest)


def mttkrp_blco(x: BlcoBatches, factors: Sequence[Matrix], mode: int, broadcast_bytes: int = BROADCAST_BYTES) -> Matrix:
    """MTTKRP as a stream of bounded batches: keys are decoded in the task by shifts, and factors come as the slices that the block spans.

    A task holds one Arrow batch of these and their slices, however large the tensor and the factors
    are (``BlcoBatches.batch_bytes`` for each); slices are dealt once for all batches that need the same.
    """
    rank, order, places, free = _checked(x.dims, factors, mode), len(x.dims), x.places, x.free_bits()
    # The high bits of each index, which all entries of a block share.
    high = [[(k - x.low_bits, b) for k, (m, b) in enumerate(places) if k >= x.low_bits and m == own] for own in range(order)]

    def base(m: int):
        out = F.lit(0).cast("long")
        for k, b in high[m]:
            out = out.bitwiseOR(F.shiftleft(F.shiftright("block", k).bitwiseAND(F.lit(1)), b))
        return out

    others = [m for m in range(order) if m != mode]
    rows = x.df.select(base(mode).alias("base"), "keys", "values", "block", *(F.shiftright(base(m), free[m]).alias(f"s{m}") for m in others))
    df = _streamed(rows, [(f"s{m}", factors[m], free[m]) for m in others], ["base", "block", "keys", "values"], broadcast_bytes)
    low = places[: x.low_bits]

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, rows in _stretches(batches, len(others)):
            at = _decoded(_flat(rows.column(5)), low, order)
            products = np.repeat(_flat(rows.column(6))[:, None], rank, 1)
            for k, m in enumerate(others):
                products = products * _rows_of(*held[k], free[m], rank, at[m])
            yield _out(*_summed(at[mode] + np.repeat(rows.column(3).to_numpy(), _lengths(rows.column(5))), products))

    return _merged(df.mapInArrow(multiply, _schema(rank)), x.dims[mode], rank)
