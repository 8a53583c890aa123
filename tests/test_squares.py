"""Contraction by squares of the result: its results, and that what it moves follows the entries, not their products."""

import pytest
from pyspark.sql import functions as F

from tensorloom import workload
from tensorloom.operators import contract_plans as plans
from tensorloom.operators.contract import contract
from tensorloom.tensor import SparseTensor


def rows_of(z):
    return sorted(((*r[:-1], round(r[-1], 6)) for r in map(tuple, z.df.collect())), key=str)


def operands(spark):
    x = spark.range(3000).select((F.col("id") * 37 % 101 - 3).alias("i0"), (F.col("id") % 11).alias("i1"), (F.col("id") % 7).cast("double").alias("v"))
    x = x.unionByName(spark.createDataFrame([(5, None, 1.5), (None, 2, 9.0)], "i0 long, i1 long, v double"))
    y = spark.range(2000).select((F.col("id") % 5 - (1 << 20)).alias("i0"), (F.col("id") * 53 % 150).alias("i1"), F.lit(2.0).alias("v"))
    y = y.unionByName(spark.createDataFrame([(1, None, 1.0), (None, 5, -4.0), (7, 6, 3.0), (7, 6, -3.0)], "i0 long, i1 long, v double"))
    return SparseTensor(x, 2), SparseTensor(y, 2)


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 21), (64, 100), (1, 1)])
def test_equals_contract(spark, monkeypatch, sizes):
    monkeypatch.setattr(plans, "PIECE_ENTRIES", sizes[0])
    monkeypatch.setattr(plans, "PRODUCTS_HELD", sizes[1])
    monkeypatch.setattr(plans, "contract_neighbours", lambda *a, **b: pytest.fail("products were moved"))
    x, y = operands(spark)
    for square in (1 << 30, 20000):
        assert rows_of(plans.contract_squares(x, y, (0,), (1,), square)) == rows_of(contract(x, y, (0,), (1,)))
    if sizes[0] == 64:
        assert rows_of(plans.contract_squares(x, x, (0, 1), (0, 1), 500)) == rows_of(contract(x, x, (0, 1), (0, 1)))
        assert rows_of(plans.contract_squares(x, y, (0,), (1,), 20000, drop_zeros=True)) == rows_of(contract(x, y, (0,), (1,), drop_zeros=True))
        cube = SparseTensor(x.df.select("i0", "i1", (F.col("i0") % 4).alias("i2"), "v"), 3)
        assert rows_of(plans.contract_squares(cube, y, (1,), (1,), 20000)) == rows_of(contract(cube, y, (1,), (1,)))


def test_what_does_not_pack_goes_by_neighbours(spark):
    x, y = operands(spark)
    wide = SparseTensor(x.df.withColumn("i1", F.col("i1") * (1 << 58)), 2)
    unknown = SparseTensor(x.df.withColumn("v", F.when(F.col("i1") > 3, F.col("v"))), 2)
    for z in (wide, unknown):
        want = contract(z, y, (0,), (1,)).df.select("i0", "i1", F.coalesce("v", F.lit(-1.0)).alias("v"))
        got = plans.contract_squares(z, y, (0,), (1,), 20000).df.select("i0", "i1", F.coalesce("v", F.lit(-1.0)).alias("v"))
        assert rows_of(SparseTensor(got, 2)) == rows_of(SparseTensor(want, 2))
    assert plans.contract_squares(x.where("false"), y, (0,), (1,)).df.count() == 0


def test_one_mode_contraction_moves_entries(spark, monkeypatch, tmp_path):
    """Keys in no order, 40 entries each: 20 million products and nearly as many cells, none of which is shuffled or written."""
    n, paths = 500_000, []
    line = spark.range(n).select(F.pmod(F.hash("id"), F.lit(n // 40)).cast("long").alias("l_partkey"), F.pmod(F.xxhash64("id"), F.lit(n // 50)).cast("long").alias("l_suppkey"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    real = plans.written
    monkeypatch.setattr(plans, "written", lambda *a, **b: (paths.append(real(*a, **b)), paths[-1])[1])
    z = workload.queries()["sptc_1mode"](spark, str(tmp_path))
    assert sum(spark.read.parquet(p).count() for p in paths) <= n
    assert "Exchange" not in z._jdf.queryExecution().executedPlan().toString()
    assert z.count() > 15_000_000
