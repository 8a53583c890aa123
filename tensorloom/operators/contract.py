"""Sparse tensor contraction: a join on the contract modes, then a sum over the free modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.storage import dealt
from tensorloom.tensor import SparseTensor, coords


def _sides(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int], strict: bool | None):
    if len(x_modes) != len(y_modes):
        raise ValueError("each contract mode of one side pairs with one of the other")
    x.check_modes(*x_modes)
    y.check_modes(*y_modes)
    if strict is None:
        strict = bool(x.known_dims and y.known_dims)
    if strict and any(x.dims[a] != y.dims[b] for a, b in zip(x_modes, y_modes, strict=True)):
        raise ValueError("contract dimensions differ")
    fx = [m for m in range(x.order) if m not in x_modes]
    fy = [m for m in range(y.order) if m not in y_modes]
    left = x.df.select(*(F.col(f"i{m}").alias(f"z{k}") for k, m in enumerate(fx)), *(F.col(f"i{m}").alias(f"k{k}") for k, m in enumerate(x_modes)), F.col("v").alias("a"))
    right = y.df.select(*(F.col(f"i{m}").alias(f"z{len(fx) + k}") for k, m in enumerate(fy)), *(F.col(f"i{m}").alias(f"k{k}") for k, m in enumerate(y_modes)), F.col("v").alias("b"))
    return left, right, fx, fy


def contract(
    x: SparseTensor,
    y: SparseTensor,
    x_modes: Sequence[int],
    y_modes: Sequence[int],
    drop_zeros: bool = False,
    pre_sum: bool = False,
    strict: bool | None = None,
) -> SparseTensor:
    """Z[free of x, free of y] = sum over the contract modes of x * y; the k-th modes pair.

    Keys are compared column by column, so widths never matter. ``pre_sum`` adds up repeated
    coordinates of both sides before the join, which pays where they abound. Sums of zero stay
    unless ``drop_zeros``. Contract modes must have equal dimensions: ``strict`` always checks that,
    by a pass over the data where they aren't known; by default it is checked where they are known
    for both sides. With every mode contracted the result is one value, with none it is
    the outer product.
    """
    if pre_sum:
        x, y = x.coalesce(), y.coalesce()
    left, right, fx, fy = _sides(x, y, x_modes, y_modes, strict)
    keys = [f"k{k}" for k in range(len(x_modes))]
    joined = left.join(right, keys) if keys else left.crossJoin(right)  # no key: the outer product is asked for
    out = [f"z{k}" for k in range(len(fx) + len(fy))]
    summed = joined.groupBy(*out).agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    if not out:
        summed = summed.select(F.coalesce("v", F.lit(0.0)).alias("v"))
    if drop_zeros:
        summed = summed.where("v <> 0")
    dims = (*(x.known_dims[m] for m in fx), *(y.known_dims[m] for m in fy)) if x.known_dims and y.known_dims else None
    return SparseTensor(summed.select(*(F.col(z).alias(f"i{k}") for k, z in enumerate(out)), "v"), len(out), dims)


def estimate_products(x: SparseTensor, y: SparseTensor, x_modes: Sequence[int], y_modes: Sequence[int]) -> DataFrame:
    """One row ``products``: how many products the contraction would sum, from the counts of keys alone."""
    keys = [f"k{k}" for k in range(len(x_modes))]
    left, right, _, _ = _sides(x, y, x_modes, y_modes, False)
    rows = max(x.most_rows, y.most_rows)  # one number for both, so that counts of a key meet where they are made
    left, right = dealt(left, keys, rows), dealt(right, keys, rows)
    n, m = left.groupBy(*keys).agg(F.count("*").alias("n")), right.groupBy(*keys).agg(F.count("*").alias("m"))
    joined = n.join(m, keys) if keys else n.crossJoin(m)
    return joined.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).cast("long").alias("products"))


def chain(x: SparseTensor, y: SparseTensor, w: SparseTensor, xy: tuple, zw: tuple, **options) -> SparseTensor:
    """contract(contract(x, y), w) as one lazy plan; xy and zw are (left modes, right modes)."""
    return contract(contract(x, y, *xy, **options), w, *zw, **options)


def inner(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    """The sum of products over all coordinates."""
    modes = list(range(x.order))
    return contract(x, y, modes, modes)


def outer(x: SparseTensor, y: SparseTensor) -> SparseTensor:
    return contract(x, y, [], [])


def sort_result(z: SparseTensor) -> SparseTensor:
    return z.like(z.df.orderBy(*coords(z.order)))
