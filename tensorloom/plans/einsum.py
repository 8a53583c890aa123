"""Einstein notation over any number of tensors, contracted pair by pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tensorloom.plans.order import cheapest_order
from tensorloom.tensor import SparseTensor


def _named(letters: str, t: SparseTensor):
    """Rows of a tensor by letter; a letter that repeats keeps its diagonal."""
    if len(letters) != t.order:
        raise ValueError(f"'{letters}' for a tensor of order {t.order}")
    df = t.df
    for m, c in enumerate(letters):
        if letters.index(c) < m:
            df = df.where(F.col(f"i{m}") == F.col(f"i{letters.index(c)}"))
    return df.select(*(F.col(f"i{letters.index(c)}").alias(c) for c in dict.fromkeys(letters)), "v")


def contraction_order(inputs: list[str], dims: dict[str, int], output: str) -> list[tuple[int, int]]:
    """Greedy order: the pair with the smallest dense result first, of pairs that share a letter if any do."""
    left, steps = {k: set(x) for k, x in enumerate(inputs)}, []
    while len(left) > 1:

        def cost(pair):
            a, b = pair
            others = set(output).union(*(x for k, x in left.items() if k not in pair))
            return (not left[a] & left[b], reduce(lambda p, c: p * dims.get(c, 1), (left[a] | left[b]) & others, 1), pair)

        a, b = min(((a, b) for a in left for b in left if a < b), key=cost)
        others = set(output).union(*(x for k, x in left.items() if k not in (a, b)))
        left[a] = (left[a] | left.pop(b)) & others
        steps.append((a, b))
    return steps


def einsum(expression: str, *tensors: SparseTensor, dims: dict[str, int] | None = None, by_cost: bool = False) -> SparseTensor:
    """For instance einsum("ij,jk->ik", x, y). Letters absent from the output are summed.

    Each pair is a join on its common letters and a sum over what is needed later. Given ``dims``
    by letter, the order of pairs is chosen by the size of their results; with ``by_cost`` by the
    products that they make, estimated from counts and sampled joins (``plans.order``); otherwise
    left to right.
    """
    sides, _, output = expression.replace(" ", "").partition("->")
    names = sides.split(",")
    if len(names) != len(tensors):
        raise ValueError(f"{len(names)} operands are named and {len(tensors)} given")
    if len(set(output)) != len(output) or set(output) - set(sides):
        raise ValueError(f"output letters '{output}'")
    frames = {k: _named(x, t) for k, (x, t) in enumerate(zip(names, tensors, strict=True))}
    letters = {k: list(dict.fromkeys(x)) for k, x in enumerate(names)}
    if by_cost:
        steps = cheapest_order([letters[k] for k in range(len(names))], [frames[k] for k in range(len(names))], output).steps()
    else:
        steps = contraction_order(names, dims, output) if dims else [(0, k) for k in range(1, len(names))]
    for a, b in steps:
        common = [c for c in letters[a] if c in letters[b]]
        x, y = frames[a].withColumnRenamed("v", "_a"), frames.pop(b).withColumnRenamed("v", "_b")
        joined = x.join(y, common) if common else x.crossJoin(y)
        later = set(output).union(*(letters[k] for k in frames if k != a))
        letters[a] = [c for c in dict.fromkeys(letters[a] + letters.pop(b)) if c in later]
        frames[a] = joined.groupBy(*letters[a]).agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))
    out = frames[next(iter(frames))].groupBy(*output).agg(F.sum("v").alias("v"))
    return SparseTensor(out.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(output)), "v"), len(output))
