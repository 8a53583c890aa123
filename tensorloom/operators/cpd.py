"""CP decomposition by alternating least squares, Kruskal tensors and random tensors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.storage import stored
from tensorloom.operators import dense
from tensorloom.operators.dense import Matrix
from tensorloom.operators.elementwise import norm
from tensorloom.operators.products import mttkrp
from tensorloom.tensor import SparseTensor


@dataclass(frozen=True)
class Kruskal:
    """Weights on the driver and a factor for each mode in Spark."""

    weights: np.ndarray
    factors: list[Matrix]
    fit: float | None = None


def _stored(a: Matrix) -> Matrix:
    """A factor written to the shared folder, so that sweeps don't pile up lineage."""
    return Matrix(stored(a.df), a.rows, a.rank)


def kruskal_norm2(weights: np.ndarray, grams: list[np.ndarray]) -> float:
    return float(weights @ np.prod(grams, axis=0) @ weights)


def kruskal_inner(x: SparseTensor, k: Kruskal) -> float:
    """The sum over the entries of x times the model's value there."""
    last = x.order - 1
    return _inner(mttkrp(x, k.factors, last), k, last)


def _inner(m: Matrix, k: Kruskal, mode: int) -> float:
    """The same from the MTTKRP of a mode with the factors of all others."""
    own = k.factors[mode]
    other = own.df.select("row", *(F.col(c).alias(f"_{c}") for c in own.cols))
    one = m.df.join(other, "row").agg(*(F.sum(F.col(c) * F.col(f"_{c}")).alias(c) for c in m.cols)).first()
    return float(sum(w * (s or 0.0) for w, s in zip(k.weights, one, strict=True)))


def kruskal_fit(x: SparseTensor, k: Kruskal) -> float:
    """1 - ||x - model|| / ||x||."""
    x2 = norm(x.coalesce()).first()["norm2"]
    rest = x2 + kruskal_norm2(k.weights, [dense.gram_array(f) for f in k.factors]) - 2 * kruskal_inner(x, k)
    return 1 - np.sqrt(max(0.0, rest)) / np.sqrt(x2) if x2 else 0.0


def cp_als(x: SparseTensor, rank: int, sweeps: int = 10, tolerance: float = 1e-5, seed: int = 0, start: list[Matrix] | None = None, by_length: bool = False, two_norm: bool = False) -> Kruskal:
    """Fit a Kruskal tensor of the given rank.

    Each sweep updates each mode by an MTTKRP and a solve with the product of the other grams
    (rank x rank, on the driver), then normalizes columns: by 2-norm in the first sweep and
    max-norm later, or always by 2-norm. ``by_length`` takes the longest modes first. It stops
    when the fit changes by less than the tolerance; the fit comes from the last MTTKRP of a sweep,
    for which every other factor is that of the model. x is added up and written once. Indices
    without an entry get rows of zeros.
    """
    spark = x.df.sparkSession
    x = x.like(stored(x.coalesce().df), True)
    factors = list(start) if start else [dense.uniform(spark, d, rank, seed + m) for m, d in enumerate(x.dims)]
    grams = [dense.gram_array(f) for f in factors]
    order = sorted(range(x.order), key=lambda m: -x.dims[m]) if by_length else list(range(x.order))
    x2, fit, weights = norm(x).first()["norm2"], None, np.ones(rank)
    for sweep in range(sweeps):
        for mode in order:
            v = np.prod([grams[m] for m in range(x.order) if m != mode], axis=0)
            raw = mttkrp(x, factors, mode)
            if mode == order[-1]:
                raw = _stored(raw)  # the fit needs it as well
            solved = dense.times(raw, dense.solve_gram(v))
            full = spark.range(x.dims[mode]).select(F.col("id").alias("row")).join(solved.df, "row", "left")
            full = _stored(Matrix(full.na.fill(0.0), x.dims[mode], rank))
            factors[mode], weights = dense.normalized(full, "2" if sweep == 0 or two_norm else "max")
            grams[mode] = dense.gram_array(factors[mode])
        model = Kruskal(weights, list(factors))
        rest = x2 + kruskal_norm2(weights, grams) - 2 * _inner(raw, model, order[-1])
        before, fit = fit, 1 - np.sqrt(max(0.0, rest)) / np.sqrt(x2) if x2 else 0.0
        if np.isnan(fit) or (before is not None and abs(fit - before) < tolerance):
            break
    final = [dense.normalized(f, "2") for f in factors]
    for _, n in final:
        weights = weights * n
    return Kruskal(weights, [f for f, _ in final], fit)


def random_kruskal(spark: SparkSession, dims: list[int], rank: int, seed: int) -> Kruskal:
    return Kruskal(np.ones(rank), [dense.uniform(spark, d, rank, seed + m) for m, d in enumerate(dims)])


def normalize_1(k: Kruskal) -> Kruskal:
    """Columns divided by their 1-norms, which go into the weights."""
    pairs = [dense.normalized(f, "1") for f in k.factors]
    return Kruskal(k.weights * np.prod([n for _, n in pairs], axis=0), [f for f, _ in pairs], k.fit)


def redistribute(k: Kruskal, mode: int) -> Kruskal:
    """The weights multiplied into the factor of a mode."""
    factors = list(k.factors)
    factors[mode] = factors[mode].map(lambda r, c: c * float(k.weights[r]))
    return Kruskal(np.ones(len(k.weights)), factors, k.fit)


def kruskal_values(x: SparseTensor, k: Kruskal) -> DataFrame:
    """The model's value at each coordinate of x."""
    df, parts = x.df, [F.lit(float(w)) for w in k.weights]
    for m, f in enumerate(k.factors):
        df = f.beside(df, f"i{m}", f"f{m}_")
        parts = [p * F.col(f"f{m}_{r}") for r, p in enumerate(parts)]
    return df.select(*x.coords, sum(parts[1:], parts[0]).alias("v"))


def poisson_tensor(spark: SparkSession, dims: list[int], rank: int, draws: int, seed: int) -> SparseTensor:
    """Counts of draws from a random Kruskal model: a component by weight, then an index of each mode by its column.

    A fifth of each column's cells are large. Cumulative columns are arrays on the driver (their
    size is the sum of dims times rank, which is checked); draws are made and counted in Spark.
    """
    if sum(dims) * rank > 1 << 24:
        raise ValueError("the model is too large to send to every task")
    rng = np.random.default_rng(seed)
    weight = rng.random(rank)
    columns = [np.where(rng.random((rank, d)) < 0.2, 1 + rng.random((rank, d)) * (10 * rank - 1), 0.1) for d in dims]
    uniform = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 52)) / float(1 << 52)
    draws_df = spark.range(draws).select(*(uniform(k).alias(f"u{k}") for k in range(len(dims) + 1)))
    picks = [np.cumsum(weight) / weight.sum(), *(np.cumsum(c, 1) / c.sum(1, keepdims=True) for c in columns)]

    def choose(batches):
        import pyarrow as pa

        for batch in batches:
            u = [batch.column(k).to_numpy() for k in range(len(dims) + 1)]
            component = np.minimum(np.searchsorted(picks[0], u[0], side="right"), rank - 1)
            out = []
            for m, d in enumerate(dims):
                index = np.zeros(len(component), np.int64)
                for r in range(rank):
                    own = component == r
                    index[own] = np.minimum(np.searchsorted(picks[m + 1][r], u[m + 1][own], side="right"), d - 1)
                out.append(pa.array(index))
            yield pa.RecordBatch.from_arrays(out, [f"i{m}" for m in range(len(dims))])

    chosen = draws_df.mapInArrow(choose, ", ".join(f"i{m} long" for m in range(len(dims))))
    counted = chosen.groupBy(*(f"i{m}" for m in range(len(dims)))).agg(F.count("*").cast("double").alias("v"))
    return SparseTensor(counted, len(dims), tuple(dims))
