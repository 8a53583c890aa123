"""Reshaping, ordering, blocking and renumbering of tensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import bits
from tensorloom.functions.running import numbered, running_total, runs
from tensorloom.functions.storage import stored
from tensorloom.operators.dense import BROADCAST_BYTES, Matrix, matched
from tensorloom.tensor import SparseTensor


def permute(x: SparseTensor, modes: Sequence[int]) -> SparseTensor:
    """Mode k of the result is mode modes[k] of x: a projection only."""
    if sorted(modes) != list(range(x.order)):
        raise ValueError(f"{modes} is no order of the modes")
    dims = tuple(x.known_dims[m] for m in modes) if x.known_dims else None
    return SparseTensor(x.df.select(*(F.col(f"i{m}").alias(f"i{k}") for k, m in enumerate(modes)), "v"), x.order, dims)


def best_order(dims: Sequence[int], mode: int) -> list[int]:
    """The mode, then the others by growing dimension."""
    return [mode, *sorted((m for m in range(len(dims)) if m != mode), key=lambda m: (dims[m], m))]


def worst_order(dims: Sequence[int], mode: int) -> list[int]:
    """The others by falling dimension, then the mode."""
    return [*sorted((m for m in range(len(dims)) if m != mode), key=lambda m: (-dims[m], m)), mode]


def sort(x: SparseTensor, modes: Sequence[int] | None = None) -> SparseTensor:
    """Order by the given modes, then by the others: all of them, contract modes first, or any order."""
    first = list(modes or [])
    return x.like(x.df.orderBy(*(f"i{m}" for m in first), *(f"i{m}" for m in range(x.order) if m not in first)))


def sort_at(x: SparseTensor, mode: int) -> SparseTensor:
    """Order by all modes except one, which comes last."""
    x.check_modes(mode)
    return sort(x, [m for m in range(x.order) if m != mode])


def sort_blocks(x: SparseTensor, block_bits: int, z_order: bool = False, without: int | None = None) -> SparseTensor:
    """Order by blocks of 2^block_bits indices, in rows or in Z-order, and by coordinates within.

    ``without`` names a mode that makes no blocks; it is ordered by last.
    """
    modes = [m for m in range(x.order) if m != without]
    blocks = x.df.select("*", *(F.shiftright(f"i{m}", block_bits).alias(f"b{m}") for m in modes))
    names = [f"b{m}" for m in modes]
    keys = [bits.morton(names, [max(0, bits.width(x.dims[m]) - block_bits) for m in modes])] if z_order else names
    return x.like(blocks.orderBy(*keys, *(f"i{m}" for m in modes), *([f"i{without}"] if without is not None else [])))


def sort_mixed(x: SparseTensor, kernel_bits: int, block_bits: int) -> SparseTensor:
    """Order by rows of kernels of 2^kernel_bits indices, by blocks in Z-order within them, and by coordinates."""
    modes = range(x.order)
    blocks = x.df.select("*", *(F.shiftright(f"i{m}", kernel_bits).alias(f"k{m}") for m in modes), *(F.shiftright(f"i{m}", block_bits).alias(f"b{m}") for m in modes))
    z = bits.morton([f"b{m}" for m in modes], [max(0, bits.width(d) - block_bits) for d in x.dims])
    return x.like(blocks.orderBy(*(f"k{m}" for m in modes), z, *x.coords))


def sort_slices(x: SparseTensor, mode: int, block_bits: int) -> SparseTensor:
    """Order by the slices of a mode, by rows of blocks of the other modes within them, and by coordinates."""
    x.check_modes(mode)
    others = [m for m in range(x.order) if m != mode]
    return x.like(x.df.orderBy(f"i{mode}", *(F.shiftright(f"i{m}", block_bits) for m in others), *(f"i{m}" for m in others)))


def shuffle_elements(x: SparseTensor, seed: int) -> SparseTensor:
    """Entries in an order that looks random and that the seed fixes."""
    return x.like(x.df.orderBy(F.xxhash64(F.lit(seed), *x.coords, "v"), *x.coords, "v"))


def row_numbers(x: SparseTensor) -> DataFrame:
    """(n, coordinates, v): entries with their number in the order that x has."""
    return numbered(x.df, "n").select("n", *x.coords, "v")


def matricize(x: SparseTensor, mode: int, transpose: bool = False) -> DataFrame:
    """(row, col, v): the unfolding along a mode; columns run over the next modes in turn, the last fastest."""
    x.check_modes(mode)
    others = [(mode + k) % x.order for k in range(1, x.order)]
    col, stride = F.lit(0).cast("long"), 1
    for m in reversed(others):
        col, stride = col + F.col(f"i{m}") * stride, stride * x.dims[m]
    row = F.col(f"i{mode}")
    return x.df.select((col if transpose else row).alias("row"), (row if transpose else col).alias("col"), "v")


#: A fiber of up to so many cells is summed cell by cell in one pass.
SHORT_FIBER = 64


def to_semisparse(x: SparseTensor, mode: int) -> DataFrame:
    """(other coordinates, fiber): each fiber along a mode as a dense array; values of one cell add up."""
    x.check_modes(mode)
    others = [c for m, c in enumerate(x.coords) if m != mode]
    dim = x.dims[mode]
    x = x.dealt([m for m in range(x.order) if m != mode])
    if dim <= SHORT_FIBER:
        cells = x.df.groupBy(*others).agg(*(F.sum(F.when(F.col(f"i{mode}") == k, F.col("v"))).alias(f"c{k}") for k in range(dim)))
        return cells.select(*others, F.array(*(F.coalesce(f"c{k}", F.lit(0.0)) for k in range(dim))).alias("fiber"))
    cells = x.coalesce().df.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct(F.col(f"i{mode}").alias("k"), "v"))).alias("cells"))
    # Gaps of zeros before each cell and after the last, so that a fiber costs its length once.
    gap = "array_repeat(0.0D, CAST(b - a - 1 AS INT))"
    places = "concat(array(-1L), transform(cells, c -> c.k))"
    gaps = f"zip_with({places}, concat(transform(cells, c -> c.k), array({dim}L)), (a, b) -> {gap})"
    values = "concat(transform(cells, c -> array(c.v)), array(CAST(array() AS array<double>)))"
    return cells.select(*others, F.expr(f"flatten(zip_with({gaps}, {values}, (g, v) -> concat(g, v)))").alias("fiber"))


def set_dense_mode(semi: DataFrame, mode: int, dense: int) -> DataFrame:
    """A semi-sparse tensor whose fibers run along ``mode``, with fibers along another mode instead."""
    return to_semisparse(from_semisparse(semi, mode, 0.0), dense)


def append_entries(semi: DataFrame, entries: SparseTensor, mode: int, dims: Sequence[int]) -> DataFrame:
    """A semi-sparse tensor of the given dimensions with further entries: new fibers, or added to the cells of those there."""
    old = from_semisparse(semi, mode, 0.0)
    # A task holds fibers: no more than the old ones and the new entries.
    held = None if entries.source is None else semi.select(F.lit(1)).union(entries.source.select(F.lit(1)))
    return to_semisparse(SparseTensor(old.df.unionByName(entries.df), old.order, tuple(dims), source=held), mode)


def sort_fibers(semi: DataFrame) -> DataFrame:
    """Fibers in order of their coordinates."""
    return semi.orderBy(*(c for c in semi.columns if c != "fiber"))


def compare_fibers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(other coordinates, in_a, in_b, equal) for every fiber of either tensor."""
    others = [c for c in a.columns if c != "fiber"]
    both = a.withColumnRenamed("fiber", "x").join(b.withColumnRenamed("fiber", "y"), others, "full")
    return both.select(*others, F.col("x").isNotNull().alias("in_a"), F.col("y").isNotNull().alias("in_b"), F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("equal"))


def from_semisparse(semi: DataFrame, mode: int, epsilon: float = 1e-6) -> SparseTensor:
    """Entries of at least epsilon in size (other than zero, without one), infinities and NaN of a semi-sparse tensor."""
    others = [c for c in semi.columns if c != "fiber"]
    large = (F.abs("v") >= epsilon) if epsilon else (F.col("v") != 0)
    rows = semi.select(*others, F.posexplode("fiber").alias("k", "v")).where(large | F.isnan("v"))
    return SparseTensor(rows.select(*(F.col(f"i{m}") if m != mode else F.col("k").cast("long").alias(f"i{m}") for m in range(len(others) + 1)), "v"), len(others) + 1)


def semisparse_rows(semi: DataFrame, x: SparseTensor, mode: int) -> DataFrame:
    """(row, col, v) of a semi-sparse tensor as a matrix: rows number the other coordinates."""
    row, stride = F.lit(0).cast("long"), 1
    for m in reversed([m for m in range(x.order) if m != mode]):
        row, stride = row + F.col(f"i{m}") * stride, stride * x.dims[m]
    return semi.select(row.alias("row"), F.posexplode("fiber").alias("col", "v")).where("v <> 0").withColumn("col", F.col("col").cast("long"))


def semisparse_norm(semi: DataFrame) -> DataFrame:
    """One row ``norm``: the root of the sum of squares over all fibers."""
    return semi.agg(F.sqrt(F.coalesce(F.sum(F.aggregate("fiber", F.lit(0.0), lambda a, v: a + v * v)), F.lit(0.0))).alias("norm"))


def fiber_offsets(x: SparseTensor, mode: int) -> DataFrame:
    """(i, start): where the entries of each index of a mode begin in the order of that mode."""
    counts = x.df.groupBy(F.col(f"i{mode}").alias("i")).agg(F.count("*").alias("n"))
    return running_total(counts, "i", "n", "start").select("i", "start")


def fiber_set(x: SparseTensor, mode: int) -> DataFrame:
    """(other coordinates, n, start): the fibers along a mode, their entries, and where each begins in the order of the other modes."""
    x.check_modes(mode)
    others = [c for m, c in enumerate(x.coords) if m != mode]
    return running_total(x.df.groupBy(*others).agg(F.count("*").alias("n")), others, "n", "start").select(*others, "n", "start")


def to_dense(x: SparseTensor) -> DataFrame:
    """(row, cells): a tensor of two modes as rows of dense arrays."""
    return to_semisparse(x, 1).select(F.col("i0").alias("row"), F.col("fiber").alias("cells"))


def linearized(x: SparseTensor, order: Sequence[int] | None = None) -> DataFrame:
    """(key, v): coordinates packed in a long, the first of ``order`` highest."""
    order = list(order or range(x.order))
    return x.df.select(bits.linearize([f"i{m}" for m in order], [bits.width(x.dims[m]) for m in order]).alias("key"), "v")


def delinearized(packed: DataFrame, dims: Sequence[int], order: Sequence[int] | None = None) -> SparseTensor:
    order = list(order or range(len(dims)))
    parts = dict(zip(order, bits.delinearize("key", [bits.width(dims[m]) for m in order]), strict=True))
    return SparseTensor(packed.select(*(parts[m].alias(f"i{m}") for m in range(len(dims))), "v"), len(dims), tuple(dims))


def flip_key(packed: DataFrame, high_bits: int, low_bits: int) -> DataFrame:
    """Swap the high and low fields of a packed key."""
    low = F.col("key").bitwiseAND(F.lit((1 << low_bits) - 1))
    return packed.select(F.shiftleft(low, high_bits).bitwiseOR(F.shiftrightunsigned("key", low_bits)).alias("key"), "v")


def to_hicoo(x: SparseTensor, block_bits: int, kernel_bits: int | None = None) -> DataFrame:
    """Block (b0 ..) and in-block (e0 ..) coordinates, kernel (k0 ..) coordinates if asked, and v."""
    cols = [F.shiftright(c, block_bits).alias(f"b{m}") for m, c in enumerate(x.coords)]
    cols += [F.col(c).bitwiseAND(F.lit((1 << block_bits) - 1)).alias(f"e{m}") for m, c in enumerate(x.coords)]
    cols += [F.shiftright(c, kernel_bits).alias(f"k{m}") for m, c in enumerate(x.coords)] if kernel_bits is not None else []
    return x.df.select(*cols, "v")


def hicoo_blocks(hicoo: DataFrame, order: int, of: str = "b") -> DataFrame:
    """(b0 .., n): entries of each block (or kernel, with of="k")."""
    return hicoo.groupBy(*(f"{of}{m}" for m in range(order))).agg(F.count("*").alias("n"))


def hicoo_pointers(hicoo: DataFrame, order: int, of: str = "b") -> DataFrame:
    """(b0 .., n, start): where the entries of each block (or kernel, with of="k") begin in the order of blocks."""
    names = [f"{of}{m}" for m in range(order)]
    return running_total(hicoo_blocks(hicoo, order, of), names, "n", "start").select(*names, "n", "start")


def from_hicoo(hicoo: DataFrame, order: int, block_bits: int) -> SparseTensor:
    return SparseTensor(hicoo.select(*(F.shiftleft(f"b{m}", block_bits).bitwiseOR(F.col(f"e{m}")).alias(f"i{m}") for m in range(order)), "v"), order)


def alto_keys(x: SparseTensor) -> DataFrame:
    """(key, v) with interleaved coordinates: near keys are near in every mode."""
    return x.df.select(bits.alto(x.coords, [bits.width(d) for d in x.dims]).alias("key"), "v")


def _alto_runs(x: SparseTensor, parts: int) -> DataFrame:
    """(part, coordinates, n): the entries of each coordinate by their part of the key order; a part has an equal number of entries."""
    total = x.nnz()
    each = max(1, -(-total // parts))
    keyed = x.df.select(bits.alto(x.coords, [bits.width(d) for d in x.dims]).alias("key"), *x.coords)
    counts = keyed.groupBy("key", *x.coords).agg(F.count("*").alias("n"))
    before = running_total(counts, "key", "n", "before").withColumn("after", F.col("before") + F.col("n"))
    touched = F.sequence(F.floor(F.col("before") / each), F.floor((F.col("after") - 1) / each))
    cut = before.select("*", F.explode(touched).alias("part"))
    own = F.least("after", (F.col("part") + 1) * each) - F.greatest("before", F.col("part") * each)
    return cut.select("part", *x.coords, own.alias("n"))


def alto_partitions(x: SparseTensor, parts: int) -> DataFrame:
    """(part, n, low0, high0, ..): entries in order of interleaved keys, cut to parts of equal numbers, with the index interval of each mode."""
    return _alto_runs(x, parts).groupBy("part").agg(F.sum("n").alias("n"), *(f(c).alias(f"{n}{m}") for m, c in enumerate(x.coords) for f, n in ((F.min, "low"), (F.max, "high"))))


def alto_conflicts(x: SparseTensor, parts: int) -> DataFrame:
    """(mode, i, parts): the indices of each mode that more than one part of alto_partitions has, and how many do."""
    rows = _alto_runs(x, parts).select("part", F.posexplode(F.array(*x.coords)).alias("mode", "i"))
    shared = rows.groupBy("mode", "i").agg(F.count_distinct("part").alias("parts")).where("parts > 1")
    return shared.select(F.col("mode").cast("long").alias("mode"), "i", "parts")


#: A block of up to so many entries is numbered in one task.
LARGE_BLOCK = 1 << 20
#: The keys of a larger one are numbered in so many ranges of their highest bits, each by itself.
RANGE_BITS = 10


def blco_blocks(x: SparseTensor, low_bits: int, largest: int) -> DataFrame:
    """(block, part, key, v): the high bits of the interleaved key name a block, which is cut into parts of ``largest`` at most."""
    keys = alto_keys(x).select(F.shiftrightunsigned("key", low_bits).alias("block"), F.col("key").bitwiseAND(F.lit((1 << low_bits) - 1)).alias("key"), "v")
    part = lambda at: F.floor(at / largest).cast("long").alias("part")
    number = lambda *names: F.row_number().over(Window.partitionBy(*names).orderBy("key", "v")) - 1
    large = stored(keys.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_BLOCK).select("block"))
    if not (found := large.count()):
        return keys.select("block", part(number("block")), "key", "v")
    few = F.broadcast(large) if 16 * found <= BROADCAST_BYTES else large
    small = keys.join(few, "block", "left_anti").select("block", part(number("block")), "key", "v")
    keys = keys.join(few, "block").withColumn("range", F.shiftrightunsigned("key", max(0, low_bits - RANGE_BITS)))
    counts = keys.groupBy("block", "range").agg(F.count("*").alias("n"))
    bases = counts.select("block", "range", (F.sum("n").over(Window.partitionBy("block").orderBy("range")) - F.col("n")).alias("base"))
    within = keys.withColumn("within", number("block", "range")).join(bases, ["block", "range"])
    return small.unionByName(within.select("block", part(F.col("base") + F.col("within")), "key", "v"))


def dist_rows(x: SparseTensor, parts: int) -> DataFrame:
    """(i, part): indices of mode 0 in runs; each is closed when it has the average number of entries, and the last takes what is left."""
    counts = x.df.groupBy(F.col("i0").alias("i")).agg(F.count("*").alias("n")).withColumn("group", F.lit(0).cast("long"))
    return runs(counts, "i", x.nnz() // parts, True).select("i", F.least("run", F.lit(parts - 1).cast("long")).alias("part"))


def split(x: SparseTensor, limits: Sequence[int]) -> tuple[SparseTensor, DataFrame]:
    """(x with a column ``part``, bounds): cut into sub-tensors, mode after mode, of at most limits[m] entries each.

    The indices of a mode are taken in order as long as a part has no more than the limit; a part
    exceeds it only if one index alone does. Each part is cut again along the next mode; a limit
    of 0 leaves a mode whole. bounds has (part, n, low0, high0, ..): the interval of each mode
    that was current when that mode was cut.
    """
    df, bounds = x.df.withColumn("part", F.lit(0).cast("long")), None
    for m, limit in enumerate(limits):
        i = f"i{m}"
        counts = df.groupBy(F.col("part").alias("group"), F.col(i).alias("i")).agg(F.count("*").alias("n"))
        if limit:
            found = runs(counts, "i", limit, False)
        else:
            found = counts.withColumn("run", F.col("group"))
        found = stored(found)
        if limit:
            df = df.join(found.select(F.col("group").alias("part"), F.col("i").alias(i), "run"), ["part", i]).select(*x.coords, "v", F.col("run").alias("part"))
            df = stored(df) if m + 1 < len(limits) else df  # the last cut is read lazily, if at all
        own = found.groupBy("group", F.col("run").alias("part")).agg(F.sum("n").alias("n"), F.min("i").alias(f"low{m}"), (F.max("i") + 1).alias(f"high{m}"))
        if bounds is None:
            bounds = own.drop("group")
        else:
            bounds = own.join(bounds.drop("n").withColumnRenamed("part", "group"), "group").drop("group")
    modes = range(len(limits))
    return SparseTensor(df, x.order, x.known_dims), bounds.select("part", "n", *(f"{n}{m}" for m in modes for n in ("low", "high")))


def split_by_nnz(x: SparseTensor, limit: int) -> DataFrame:
    """(part, n, low0, high0): the bounds of ``split`` along mode 0 alone."""
    return split(x, [limit])[1]


def hicoo_chunks(hicoo: DataFrame, order: int, size: int) -> DataFrame:
    """(k0 .., b0 .., n, chunk): blocks of each kernel in order, in chunks closed at ``size`` entries."""
    kernels, blocks = [f"k{m}" for m in range(order)], [f"b{m}" for m in range(order)]
    counts = hicoo.groupBy(*kernels, *blocks).agg(F.count("*").alias("n"))
    counts = counts.select("n", F.struct(*kernels).alias("group"), F.struct(*blocks).alias("block"))
    return runs(counts, "block", size, True).select("group.*", "block.*", "n", F.col("run").alias("chunk"))


def renumber(x: SparseTensor, mode: int, mapping: DataFrame) -> SparseTensor:
    """Indices of a mode replaced by mapping(old, new); an index that the map lacks fails the job."""
    x.check_modes(mode)
    joined = matched(x.df, mapping.select(F.col("old").alias(f"i{mode}"), "new"), f"i{mode}", ["new"], "the map")
    return SparseTensor(joined.select(*(F.col("new").alias(c) if m == mode else c for m, c in enumerate(x.coords)), "v"), x.order, x.known_dims)


def inverse_map(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("new").alias("old"), F.col("old").alias("new"))


def random_map(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(old, new): a permutation of 0 .. n-1 fixed by the seed."""
    if n >= 1 << 31:
        raise ValueError("an index map has one row for each index; this dimension is too large")
    hashed = spark.range(n).select(F.col("id").alias("old"), F.xxhash64(F.lit(seed), "id").alias("h"), F.lit(1).alias("one"))
    return running_total(hashed, "h", "one", "new").select("old", F.col("new").cast("long"))


def inverse_rows(a: Matrix, mapping: DataFrame) -> Matrix:
    """A matrix whose rows a map (old, new) moved, with its rows where they were."""
    back = inverse_map(mapping).select(F.col("old").alias("row"), F.col("new").alias("back"))
    return Matrix(a.df.join(back, "row").select(F.col("back").alias("row"), *a.cols), a.rows, a.rank)


def inverse_factors(factors: Sequence[Matrix], mappings: Sequence[DataFrame]) -> list[Matrix]:
    """``inverse_rows`` of each factor of a Kruskal tensor by the map of its mode."""
    return [inverse_rows(a, m) for a, m in zip(factors, mappings, strict=True)]
