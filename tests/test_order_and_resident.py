import re

import numpy as np
import pytest

from tensorloom.operators.resident import contract_resident, keep
from tensorloom.plans.einsum import _named, einsum
from tensorloom.plans.order import Planner, Statistics
from tensorloom.tensor import SparseTensor


def matrix(spark, seed, n, rows, cols):
    rng = np.random.default_rng(seed)
    i, j, v = rng.integers(0, rows, n), rng.integers(0, cols, n), rng.integers(1, 5, n).astype(float)
    a = np.zeros((rows, cols))
    np.add.at(a, (i, j), v)
    return SparseTensor(spark.createDataFrame([(int(x), int(y), float(w)) for x, y, w in zip(i, j, v)], "i0 long, i1 long, v double").repartition(3), 2, (rows, cols)), a


def counted(names, tensors, output, steps):
    """The products that a sequence of steps really makes."""
    held = {k: (list(n), t.coalesce().df) for k, (n, t) in enumerate(zip(names, tensors))}
    held = {k: (n, df.toDF(*n, "v")) for k, (n, df) in held.items()}
    total = 0
    for a, b in steps:
        (x, p), (y, q) = held.pop(a), held.pop(b)
        common = [c for c in x if c in y]
        joined = p.withColumnRenamed("v", "_a").join(q.withColumnRenamed("v", "_b"), common) if common else p.withColumnRenamed("v", "_a").crossJoin(q.withColumnRenamed("v", "_b"))
        total += joined.count()
        later = set(output).union(*(n for n, _ in held.values()))
        letters = [c for c in dict.fromkeys(x + y) if c in later]
        held[a] = letters, joined.groupBy(*letters).agg({"_a": "count"}).toDF(*letters, "v")
    return total


def test_the_dynamic_program_takes_the_cheaper_order(spark):
    # The last operand is a few rows: from the right everything stays small.
    names, output = ["ab", "bc", "cd", "de"], "ae"
    made = [matrix(spark, 1, 900, 30, 25), matrix(spark, 2, 900, 25, 400), matrix(spark, 3, 900, 400, 60), matrix(spark, 4, 6, 60, 4)]
    tensors = [t for t, _ in made]
    frames = [_named(n, t.coalesce()) for n, t in zip(names, tensors)]
    planner = Planner(Statistics.of(names, frames), output)
    best, left = planner.best(), [(0, 1), (0, 2), (0, 3)]
    assert best.steps() == [(2, 3), (1, 2), (0, 1)]
    made_by = {tuple(map(tuple, s)): counted(names, tensors, output, s) for s in (best.steps(), left, [(1, 2), (0, 1), (0, 3)])}
    assert min(made_by, key=made_by.get) == tuple(best.steps())
    assert made_by[tuple(best.steps())] * 5 < made_by[tuple(left)]
    # Estimates are within a small factor of the counts.
    for steps, n in made_by.items():
        assert n / 3 < planner.in_order(steps).cost < 3 * n
    got = einsum("ab,bc,cd,de->ae", *tensors, by_cost=True)
    a = np.zeros((30, 4))
    for i, j, v in got.df.collect():
        a[i, j] = v
    assert np.allclose(a, np.linalg.multi_dot([m for _, m in made]))


def test_sampled_joins_estimate_the_whole(spark):
    x, _ = matrix(spark, 5, 6000, 3000, 50)
    y, _ = matrix(spark, 6, 6000, 3000, 50)
    frames = [_named("ab", x), _named("ac", y)]
    whole = Statistics.of(["ab", "ac"], frames).share[0, 1]
    assert whole == frames[0].join(frames[1].withColumnRenamed("v", "w"), "a").count() / 6000**2
    assert whole / 1.5 < Statistics.of(["ab", "ac"], frames, sample=600).share[0, 1] < 1.5 * whole


def test_crosses_and_many_operands(spark):
    s = Statistics(["a", "b", "c", "ab"], [10, 20, 5, 50], [{"a": 10}, {"b": 20}, {"c": 5}, {"a": 10, "b": 20}], {(0, 3): 0.1, (3, 0): 0.1, (1, 3): 0.05, (3, 1): 0.05})
    best = Planner(s, "").best()
    assert best.members == frozenset(range(4)) and len(best.steps()) == 3
    chain = [f"{chr(97 + k)}{chr(98 + k)}" for k in range(12)]
    share = {(i, j): 0.01 for i in range(12) for j in range(12) if abs(i - j) == 1}
    s = Statistics(chain, [100.0] * 12, [{c: 100.0 for c in n} for n in chain], share)
    assert len(Planner(s, "am").best().steps()) == 11  # greedy
    x, a = matrix(spark, 8, 30, 5, 6)
    assert einsum("ab,cd->", x, x, by_cost=True).df.first().v == a.sum() ** 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan_of(df)))


def test_a_resident_side_does_not_move(spark):
    x, a = matrix(spark, 1, 500, 40, 7)
    y, b = matrix(spark, 2, 500, 40, 9)
    kx, ky = keep(x, (0,), 5), keep(y, (0,), 5)
    both = contract_resident(kx, ky)
    assert exchanges(both.df) == 1  # of the sum by free key
    assert exchanges(contract_resident(kx, y, y_modes=(0,)).df) == 2  # and that of y
    want = np.einsum("ka,kb->ab", a, b)
    for z in (both, contract_resident(kx, y, y_modes=(0,)), contract_resident(x, ky, (0,))):
        out = np.zeros((7, 9))
        for i, j, v in z.df.collect():
            out[i, j] = v
        assert np.allclose(out, want) and z.known_dims == (7, 9)
    # Any operator reads the table.
    assert kx.tensor.coalesce().df.count() == x.coalesce().df.count()
    with pytest.raises(ValueError, match="kept by modes"):
        contract_resident(kx, ky, (1,), (0,))
    with pytest.raises(ValueError):
        contract_resident(x, y, (0,), (0,))
    kx.drop()


def test_pre_summed_and_scalar(spark):
    x, a = matrix(spark, 3, 400, 6, 5)
    k = keep(x, (0, 1), 3, pre_sum=True)
    assert k.tensor.nnz() == x.coalesce().nnz()
    assert contract_resident(k, k).df.first().v == (a * a).sum()
