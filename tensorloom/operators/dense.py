"""Dense matrices as wide rows (row, c0 .. ), their norms and grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A matrix of up to so many bytes may be broadcast; rows and rank are known, so the size is too.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    rows: int
    rank: int

    @property
    def cols(self) -> list[str]:
        return [f"c{r}" for r in range(self.rank)]

    @property
    def is_small(self) -> bool:
        """Whether the rows are few enough to be broadcast."""
        return 8 * self.rows * (self.rank + 1) <= BROADCAST_BYTES

    def beside(self, df: DataFrame, index: str, prefix: str) -> DataFrame:
        """df with the cells of the row that ``index`` names, as prefix0 ..; an index without a row fails the job."""
        named = self.df.select(F.col("row").alias(index), *(F.col(c).alias(f"{prefix}{r}") for r, c in enumerate(self.cols)))
        return matched(df, named, index, [f"{prefix}{r}" for r in range(self.rank)], "the matrix", self.is_small)

    def map(self, f) -> Matrix:
        return Matrix(self.df.select("row", *(f(r, F.col(c)).alias(c) for r, c in enumerate(self.cols))), self.rows, self.rank)


def matched(df: DataFrame, other: DataFrame, on: str, columns: list[str], what: str, small: bool = False) -> DataFrame:
    """df with the columns of the row of other with the same ``on``; a row without one fails the job, which an inner join would hide."""
    marked = other.select(on, *columns, F.lit(True).alias("_there"))
    joined = df.join(F.broadcast(marked) if small else marked, on, "left")
    missing = F.raise_error(F.concat(F.lit(f"{what} has no row for index "), F.col(on).cast("string")))
    return joined.select(*df.columns, *(F.when(F.col("_there").isNull(), missing).otherwise(F.col(c)).alias(c) for c in columns))


def matrix(spark: SparkSession, rows: int, rank: int, cell) -> Matrix:
    """cell(row column, column number) for each cell."""
    return Matrix(spark.range(rows).select(F.col("id").alias("row"), *(cell(F.col("id"), r).cast("double").alias(f"c{r}") for r in range(rank))), rows, rank)


def counting(spark: SparkSession, rows: int, rank: int) -> Matrix:
    """row + column + 1, the fixed start that needs no random numbers."""
    return matrix(spark, rows, rank, lambda i, r: i + r + 1)


def constant(spark: SparkSession, rows: int, rank: int, value: float) -> Matrix:
    return matrix(spark, rows, rank, lambda i, r: F.lit(value))


def identity(spark: SparkSession, n: int) -> Matrix:
    return matrix(spark, n, n, lambda i, r: (i == r).cast("int"))


def uniform(spark: SparkSession, rows: int, rank: int, seed: int) -> Matrix:
    """Numbers in [0, 1) that depend on seed and place only, however the rows are dealt."""
    return matrix(spark, rows, rank, lambda i, r: F.pmod(F.xxhash64(F.lit(seed), i, F.lit(r)), F.lit(1 << 52)) / float(1 << 52))


def hadamard(a: Matrix, b: Matrix) -> Matrix:
    if a.rank != b.rank or (a.rows and b.rows and a.rows != b.rows):
        raise ValueError(f"shapes differ: {a.rows} x {a.rank} and {b.rows} x {b.rank}")
    other = b.df.select(F.col("row"), *(F.col(c).alias(f"_{c}") for c in b.cols))
    return Matrix(a.df.join(other, "row").select("row", *((F.col(c) * F.col(f"_{c}")).alias(c) for c in a.cols)), a.rows, a.rank)


def hadamard_others(mode: int, matrices: list[Matrix]) -> Matrix:
    """The product, cell by cell, of all matrices but that of ``mode``; ones if there is no other."""
    first = matrices[mode]
    if any((m.rows, m.rank) != (first.rows, first.rank) for m in matrices):
        raise ValueError("matrices of one shape are needed")
    others = [m for k, m in enumerate(matrices) if k != mode]
    if not others:
        return first.map(lambda r, c: F.lit(1.0))
    out = others[0]
    for m in others[1:]:
        out = hadamard(out, m)
    return out


def gram_product(mode: int, grams: list[DataFrame]) -> DataFrame:
    """(r, s, v) for r <= s: the product of all grams (r, s, v) but that of ``mode``, of which the upper triangle is kept."""
    others = [g for k, g in enumerate(grams) if k != mode]
    if not others:
        raise ValueError("there is no other gram")
    every = others[0]
    for g in others[1:]:
        every = every.unionByName(g)
    # A triangle has rank * (rank + 1) / 2 cells, one of each gram in a group.
    return every.groupBy("r", "s").agg(F.aggregate(F.collect_list("v"), F.lit(1.0), lambda p, v: p * v).alias("v"))


def append(a: Matrix, b: Matrix) -> Matrix:
    """The rows of b below those of a."""
    if a.rank != b.rank:
        raise ValueError(f"ranks differ: {a.rank} and {b.rank}")
    return Matrix(a.df.unionByName(b.df.withColumn("row", F.col("row") + a.rows)), a.rows + b.rows, a.rank)


def gram(a: Matrix) -> DataFrame:
    """(r, s, v) of the cells r <= s of the product of a's transpose with a, from one pass."""
    pairs = [(r, s) for r in range(a.rank) for s in range(r, a.rank)]
    one = a.df.agg(*(F.sum(F.col(f"c{r}") * F.col(f"c{s}")).alias(f"g{r}_{s}") for r, s in pairs))
    cell = lambda r, s: F.struct(F.lit(r).cast("long").alias("r"), F.lit(s).cast("long").alias("s"), F.coalesce(F.col(f"g{r}_{s}"), F.lit(0.0)).alias("v"))
    return one.select(F.inline(F.array(*(cell(r, s) for r, s in pairs))))


def gram_array(a: Matrix) -> np.ndarray:
    """The rank x rank product on the driver."""
    out = np.zeros((a.rank, a.rank))
    for r, s, v in gram(a).collect():
        out[r, s] = out[s, r] = v
    return out


def column_norms(a: Matrix, kind: str = "2") -> DataFrame:
    """(r, v): the 2-norm of each column, or with kind "max" its largest value, 1 at least, or its 1-norm."""
    measure = {"2": lambda c: F.sqrt(F.sum(c * c)), "max": lambda c: F.greatest(F.max(c), F.lit(1.0)), "1": lambda c: F.sum(F.abs(c))}[kind]
    one = a.df.agg(*(measure(F.col(c)).alias(c) for c in a.cols))
    return one.select(F.inline(F.array(*(F.struct(F.lit(r).cast("long").alias("r"), F.col(c).alias("v")) for r, c in enumerate(a.cols)))))


def normalized(a: Matrix, kind: str = "2") -> tuple[Matrix, np.ndarray]:
    """(a with each column divided by its norm, the norms); a column of zeros stays."""
    norms = np.zeros(a.rank)
    for r, v in column_norms(a, kind).collect():
        norms[r] = v or 0.0
    return a.map(lambda r, c: c / float(norms[r]) if norms[r] else c), norms


def times(a: Matrix, square: np.ndarray) -> Matrix:
    """a times a small square array from the driver, row by row."""
    return a.map(lambda r, _: sum((F.col(f"c{s}") * float(square[s, r]) for s in range(a.rank)), F.lit(0.0)))


def solve_gram(v: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite array by Cholesky, else its pseudo-inverse."""
    try:
        low = np.linalg.cholesky(v)
        inverse = np.linalg.inv(low)
        return inverse.T @ inverse
    except np.linalg.LinAlgError:
        return np.linalg.pinv(v)
