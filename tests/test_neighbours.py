"""Contraction by ranges of keys: its results, and the partial sums that it moves."""

import pytest
from pyspark.sql import functions as F

from tensorloom import workload
from tensorloom.operators.contract import contract
from tensorloom.operators.contract_plans import contract_neighbours
from tensorloom.tensor import SparseTensor


def rows_of(z):
    return sorted((*r[:-1], round(r[-1], 6)) for r in map(tuple, z.df.collect()))


@pytest.mark.parametrize("pre_sum", [False, True])
def test_equals_contract(spark, pre_sum):
    x = SparseTensor(spark.range(3000).select((F.col("id") * 37 % 101 - 3).alias("i0"), (F.col("id") % 11).alias("i1"), (F.col("id") % 7).cast("double").alias("v")), 2)
    y = SparseTensor(spark.range(2000).select((F.col("id") % 5).alias("i0"), (F.col("id") * 53 % 150).alias("i1"), F.lit(2.0).alias("v")), 2)
    y = SparseTensor(y.df.unionByName(spark.createDataFrame([(1, None, 1.0)], "i0 long, i1 long, v double")), 2)
    want = rows_of(contract(x, y, (0,), (1,)))
    for bucket_rows in (0, 300):
        assert rows_of(contract_neighbours(x, y, (0,), (1,), pre_sum, bucket_rows)) == want
    both = rows_of(contract(x, x, (0, 1), (0, 1)))
    assert rows_of(contract_neighbours(x, x, (0, 1), (0, 1), pre_sum)) == both
    assert contract_neighbours(x.where("false"), y, (0,), (1,)).df.count() == 0


def test_one_mode_contraction_is_dealt_by_ranges(spark, monkeypatch):
    """Keys are met in buckets of neighbours, which a join by the key's hash does not make."""
    dealt = []
    import tensorloom.operators.contract_plans as plans

    real = plans._products_in_buckets
    monkeypatch.setattr(plans, "_products_in_buckets", lambda left, *rest, **more: (dealt.append(left.groupBy("bucket").agg(F.min("k0").alias("low"), F.max("k0").alias("high")).collect()), real(left, *rest, **more))[1])
    workload.queries()["sptc_1mode"](spark, "/root/testdata/sf0.001").count()
    ranges = sorted((r["low"], r["high"]) for r in dealt[0])
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
