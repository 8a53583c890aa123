"""Shapes that don't fit raise: at once where they are known, else in the job; nothing is lost silently."""

import numpy as np
import pytest

from tensorloom.operators import cpd, dense, layout, products
from tensorloom.tensor import SparseTensor


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(0, 0, 1.0), (9, 0, 5.0)], "i0 long, i1 long, v double")


def test_known_shapes(spark, entries):
    x = SparseTensor(entries, 2, (10, 1))
    short, one = dense.counting(spark, 3, 2), dense.counting(spark, 1, 2)
    with pytest.raises(ValueError, match="factor 0 has 3 rows for a dimension of 10"):
        products.mttkrp(x, [short, one], 1)
    with pytest.raises(ValueError, match="3 rows for a dimension of 10"):
        products.ttm(x, 0, short)
    with pytest.raises(ValueError):
        dense.hadamard(short, one)
    with pytest.raises(ValueError):
        dense.hadamard(dense.counting(spark, 3, 4), short)
    with pytest.raises(ValueError):
        dense.append(short, dense.counting(spark, 3, 4))
    with pytest.raises(ValueError):
        dense.hadamard_others(0, [short, one])


def test_unknown_shapes_fail_the_job(spark, entries):
    x = SparseTensor(entries, 2)
    short, one = dense.counting(spark, 3, 2), dense.counting(spark, 1, 2)
    vector = spark.range(3).selectExpr("id i", "1.0D w")
    jobs = [
        products.mttkrp(x, [short, one], 1).df,
        products.ttm(x, 0, short),
        products.ttv(x, 0, vector).df,
        products.fiber_ttm(layout.to_semisparse(SparseTensor(entries, 2, (10, 1)), 0), short),
        layout.renumber(x, 0, spark.range(3).selectExpr("id old", "id new")).df,
        cpd.kruskal_values(x, cpd.Kruskal(np.ones(2), [short, one])),
    ]
    for job in jobs:
        with pytest.raises(Exception, match="has no row for index [39]"):
            job.collect()


def test_fitting_shapes_keep_every_entry(spark, entries):
    x = SparseTensor(entries, 2, (10, 1))
    ten, one = dense.counting(spark, 10, 2), dense.counting(spark, 1, 2)
    assert {r.row: (r.c0, r.c1) for r in products.mttkrp(x, [ten, one], 0).df.collect()} == {0: (1.0, 2.0), 9: (5.0, 10.0)}
    assert products.ttv(x, 0, spark.range(10).selectExpr("id i", "2.0D w")).df.first().v == 12.0
    # An element that is null is no missing row.
    assert products.ttv(x, 1, spark.createDataFrame([(0, None)], "i long, w double")).df.where("v IS NULL").count() == 2


def test_products_of_all_but_one(spark):
    a, b, c = (dense.counting(spark, 4, 2).map(lambda r, x, k=k: x + k) for k in range(3))
    rows = {r.row: (r.c0, r.c1) for r in dense.hadamard_others(1, [a, b, c]).df.collect()}
    assert rows == {i: ((i + 1) * (i + 3), (i + 2) * (i + 4)) for i in range(4)}
    assert {(r.c0, r.c1) for r in dense.hadamard_others(0, [a]).df.collect()} == {(1.0, 1.0)}
    grams = [dense.gram(m) for m in (a, b, c)]
    arrays = [dense.gram_array(m) for m in (a, b, c)]
    got = {(r.r, r.s): r.v for r in dense.gram_product(1, grams).collect()}
    assert got == {(r, s): arrays[0][r, s] * arrays[2][r, s] for r in range(2) for s in range(r, 2)}


def test_als_makes_one_mttkrp_for_each_mode(spark, monkeypatch):
    made = []
    monkeypatch.setattr(cpd, "mttkrp", lambda x, f, m: made.append(m) or products.mttkrp(x, f, m))
    x = SparseTensor(spark.createDataFrame([(i, j, float(i + j + 1)) for i in range(4) for j in range(3)], "i0 long, i1 long, v double"), 2, (4, 3))
    k = cpd.cp_als(x, 2, sweeps=2, tolerance=0.0)
    assert made == [0, 1, 0, 1]
    assert abs(cpd.kruskal_fit(x, k) - k.fit) < 1e-9
