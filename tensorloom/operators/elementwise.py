"""Element-wise arithmetic, scalars and reductions. Repeated coordinates are added up first."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.tensor import SparseTensor, same_shape


def _sum(x: SparseTensor, y: SparseTensor, sign: int) -> SparseTensor:
    same_shape(x, y)
    other = y.df.withColumn("v", F.col("v") * sign)
    return x.like(x.df.unionByName(other)).coalesce().drop_zeros()


def add(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Union of coordinates; sums of zero go."""
    return _sum(x, y, 1)


def sub(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    return _sum(x, y, -1)


def _paired(x: SparseTensor, y: SparseTensor) -> DataFrame:
    same_shape(x, y)
    return x.coalesce().df.withColumnRenamed("v", "a").join(y.coalesce().df.withColumnRenamed("v", "b"), x.coords)


def mul(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Hadamard product over common coordinates; zeros go."""
    return x.like(_paired(x, y).withColumn("v", F.col("a") * F.col("b")), True).drop_zeros()


def mul_same_pattern(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Hadamard product of tensors that must have the same coordinates; the job fails where they differ."""
    same_shape(x, y)
    both = x.coalesce().df.withColumnRenamed("v", "a").join(y.coalesce().df.withColumnRenamed("v", "b"), x.coords, "full")
    alone = F.raise_error(F.lit("the patterns differ")).cast("double")
    v = F.when(F.col("a").isNull() | F.col("b").isNull(), alone).otherwise(F.col("a") * F.col("b"))
    return x.like(both.withColumn("v", v), True).drop_zeros()


def div(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Quotient over common coordinates; zeros stay. Division by zero gives infinity or NaN as floats do."""
    a, b = F.col("a"), F.col("b")
    by_zero = F.when(a == 0, F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return x.like(_paired(x, y).withColumn("v", F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))))


def scale(x: SparseTensor, factor: float) -> SparseTensor:
    """Times a scalar; zero gives an empty tensor."""
    return x.where("false") if factor == 0 else x.like(x.df.withColumn("v", F.col("v") * float(factor)), x.unique)


def divide_by(x: SparseTensor, divisor: float) -> SparseTensor:
    if divisor == 0:
        raise ZeroDivisionError("tensor divided by zero")
    return x.like(x.df.withColumn("v", F.col("v") / float(divisor)), x.unique)


def norm(x: SparseTensor) -> DataFrame:
    """One row: norm2, the sum of squares of stored values, and norm, its root."""
    return x.df.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("norm2")).select("norm2", F.sqrt("norm2").alias("norm"))


def largest(x: SparseTensor) -> DataFrame:
    return x.df.agg(F.max("v").alias("v"))


def status(x: SparseTensor) -> DataFrame:
    """One row: nnz, dims, density, average slice length by mode and bytes of indices."""
    row = x.df.agg(F.count("*").alias("nnz"), *(F.coalesce(F.max(c) + 1, F.lit(0)).alias(c) for c in x.coords))
    dims = [F.lit(d) for d in x.known_dims] if x.known_dims else [F.col(c) for c in x.coords]
    cells = F.lit(1.0)
    for d in dims:
        cells = cells * d
    return row.select(
        "nnz",
        F.array(*(d.cast("long") for d in dims)).alias("dims"),
        F.when(cells > 0, F.col("nnz") / cells).otherwise(0.0).alias("density"),
        F.array(*(F.when(d > 0, F.col("nnz") / d).otherwise(0.0) for d in dims)).alias("slice_length"),
        (F.col("nnz") * (8 * x.order)).alias("index_bytes"),
    )


def bounds(x: SparseTensor) -> DataFrame:
    """A row for each mode: mode, low and high, the indices from low up to high; 0 and 0 if empty."""
    one = x.df.agg(*(F.coalesce(f(c) + k, F.lit(0)).alias(f"{n}{m}") for m, c in enumerate(x.coords) for f, k, n in ((F.min, 0, "low"), (F.max, 1, "high"))))
    rows = F.array(*(F.struct(F.lit(m).cast("long").alias("mode"), F.col(f"low{m}").alias("low"), F.col(f"high{m}").alias("high")) for m in range(x.order)))
    return one.select(F.inline(rows))


def slice_sizes(x: SparseTensor, mode: int) -> DataFrame:
    """(i, n): entries for each index along a mode, with 0 for empty slices."""
    x.check_modes(mode)
    counts = x.df.groupBy(F.col(f"i{mode}").alias("i")).agg(F.count("*").alias("n"))
    return x.df.sparkSession.range(x.dims[mode]).select(F.col("id").alias("i")).join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))


def subtensor(x: SparseTensor, low: list[int], high: list[int]) -> SparseTensor:
    """Entries with low <= index < high in each mode; the shape stays. The range reaches the scan."""
    df = x.df
    for c, a, b in zip(x.coords, low, high, strict=True):
        df = df.where((F.col(c) >= a) & (F.col(c) < b))
    return x.like(df)
