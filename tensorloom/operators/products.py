"""Products of tensors with vectors, matrices and each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.dense import Matrix, matched
from tensorloom.tensor import SparseTensor


def _fits(x: SparseTensor, mode: int, u: Matrix, what: str = "the matrix") -> None:
    """Raise if a matrix is known to have other rows than a mode has indices; what isn't known is checked in the join."""
    if x.known_dims and u.rows and u.rows != x.known_dims[mode]:
        raise ValueError(f"{what} has {u.rows} rows for a dimension of {x.known_dims[mode]}")


def ttv(x: SparseTensor, mode: int, vector: DataFrame) -> SparseTensor:
    """Sum over a mode of x times vector(i, w); that mode becomes a single index 0. An index without an element fails the job."""
    x.check_modes(mode)
    joined = matched(x.df, vector.select(F.col("i").alias(f"i{mode}"), "w"), f"i{mode}", ["w"], "the vector")
    others = [c for m, c in enumerate(x.coords) if m != mode]
    out = joined.groupBy(*others).agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumn(f"i{mode}", F.lit(0).cast("long"))
    dims = tuple(1 if m == mode else d for m, d in enumerate(x.known_dims)) if x.known_dims else None
    return SparseTensor(out.select(*x.coords, "v"), x.order, dims)


def ttm(x: SparseTensor, mode: int, u: Matrix) -> DataFrame:
    """(other coordinates, fiber): x times u along a mode; each fiber is an array of u's rank. An index without a row fails the job."""
    x.check_modes(mode)
    _fits(x, mode, u)
    joined = u.beside(x.dealt([m for m in range(x.order) if m != mode]).df, f"i{mode}", "c")
    others = [c for m, c in enumerate(x.coords) if m != mode]
    summed = joined.groupBy(*others).agg(*(F.sum(F.col("v") * F.col(c)).alias(c) for c in u.cols))
    return summed.select(*others, F.array(*u.cols).alias("fiber"))


def fiber_ttm(semi: DataFrame, u: Matrix) -> DataFrame:
    """A semi-sparse (coordinates, fiber) times u along the dense mode. A cell without a row of u fails the job."""
    others = [c for c in semi.columns if c != "fiber"]
    rows = semi.select(*others, F.posexplode("fiber").alias("row", "v"))
    joined = u.beside(rows.withColumn("row", F.col("row").cast("long")), "row", "c")
    summed = joined.groupBy(*others).agg(*(F.sum(F.col("v") * F.col(c)).alias(c) for c in u.cols))
    return summed.select(*others, F.array(*u.cols).alias("fiber"))


def mttkrp(x: SparseTensor, factors: list[Matrix], mode: int) -> Matrix:
    """Row i of mode: the sum of x times the rows of all other factors at its coordinates.

    Factors of a checked size are broadcast, larger ones join by a shuffle. Rows without an entry
    are absent. A factor that has other rows than its mode has indices raises, one that lacks the
    row of an entry fails the job.
    """
    x.check_modes(mode)
    rank = factors[0].rank
    if any(f.rank != rank for f in factors) or len(factors) != x.order:
        raise ValueError("one factor of equal rank for each mode")
    df, product = x.df, [F.col("v")] * rank
    for m, f in enumerate(factors):
        if m != mode:
            _fits(x, m, f, f"factor {m}")
            df = f.beside(df, f"i{m}", f"f{m}_")
            product = [p * F.col(f"f{m}_{r}") for r, p in enumerate(product)]
    out = df.groupBy(F.col(f"i{mode}").alias("row")).agg(*(F.sum(p).alias(f"c{r}") for r, p in enumerate(product)))
    return Matrix(out, factors[mode].rows, rank)


def kronecker(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Every pair of entries, at x's index times y's dimension plus y's index in each mode; that many rows are its result."""
    if x.order != y.order:
        raise ValueError(f"orders differ: {x.order} and {y.order}")
    other = y.df.select(*(F.col(c).alias(f"j{m}") for m, c in enumerate(y.coords)), F.col("v").alias("w"))
    joined = x.df.crossJoin(other)
    cols = [(F.col(f"i{m}") * y.dims[m] + F.col(f"j{m}")).alias(f"i{m}") for m in range(x.order)]
    return SparseTensor(joined.select(*cols, (F.col("v") * F.col("w")).alias("v")), x.order, tuple(a * b for a, b in zip(x.dims, y.dims, strict=True)))


def khatri_rao(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """Kronecker in all modes but the last, which is joined."""
    if x.order != y.order or x.dims[-1] != y.dims[-1]:
        raise ValueError("equal orders and last dimensions are needed")
    last = x.order - 1
    other = y.df.select(*(F.col(f"i{m}").alias(f"j{m}") for m in range(last)), F.col(f"i{last}"), F.col("v").alias("w"))
    joined = x.df.join(other, f"i{last}")
    cols = [(F.col(f"i{m}") * y.dims[m] + F.col(f"j{m}")).alias(f"i{m}") for m in range(last)]
    dims = (*(a * b for a, b in zip(x.dims[:-1], y.dims[:-1], strict=True)), x.dims[-1])
    return SparseTensor(joined.select(*cols, f"i{last}", (F.col("v") * F.col("w")).alias("v")), x.order, dims)


