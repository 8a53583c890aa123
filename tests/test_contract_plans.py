import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import contract_plans as plans
from tensorloom.operators.contract import contract
from tensorloom.tensor import SparseTensor

SCHEMA = "i0 long, i1 long, i2 long, v double"


def tensor(spark, rng, n, dims, skew=0.0, dims_known=True):
    """n entries; the share ``skew`` of them has index 0 in mode 0."""
    rows = np.stack([rng.integers(0, d, n) for d in dims], 1)
    rows[rng.random(n) < skew, 0] = 0
    v = rng.integers(-4, 5, n).astype(float)
    a = np.zeros(dims)
    np.add.at(a, tuple(rows.T), v)
    return SparseTensor(spark.createDataFrame([(*map(int, r), float(x)) for r, x in zip(rows, v)], SCHEMA).repartition(5), 3, tuple(dims) if dims_known else None), a


def dense(z, dims):
    out = np.zeros(dims)
    rows = z.df.collect()
    assert len({tuple(r)[:-1] for r in rows}) == len(rows)
    for *i, v in rows:
        out[tuple(i)] += v
    return out


PLANS = {
    "grid": lambda *a: plans.contract_grid(*a, limit=500),
    "grid_of_ones": lambda *a: plans.contract_grid(*a, limit=1),
    "aligned": plans.contract_aligned,
    "aligned_copies": lambda *a: plans.contract_aligned(*a, broadcast_bytes=0, buckets=5),
    "tiles": lambda *a: plans.contract_tiles(*a, tile_bits=2),
    "tiles_large": plans.contract_tiles,
    "rounds": lambda *a: plans.contract_rounds(*a, limit=900),
}


@pytest.mark.parametrize("name", PLANS)
def test_plans_equal_numpy(spark, name):
    rng = np.random.default_rng(7)
    # Half of all entries of both sides share one contract key.
    x, a = tensor(spark, rng, 200, (6, 9, 7), 0.5)
    y, b = tensor(spark, rng, 150, (6, 8, 9), 0.5)
    got = PLANS[name](x, y, (0, 1), (0, 2))
    assert np.allclose(dense(got, (7, 8)), np.einsum("kmc,kdm->cd", a, b))
    assert got.known_dims == (7, 8)
    x, a = tensor(spark, rng, 150, (3, 5, 4), 0.6, False)
    y, b = tensor(spark, rng, 90, (3, 4, 6), 0.6, False)
    assert np.allclose(dense(PLANS[name](x, y, (0,), (0,)), (5, 4, 4, 6)), np.einsum("kab,kcd->abcd", a, b))


@pytest.mark.parametrize("name", PLANS)
def test_plans_with_nothing_to_join(spark, name):
    rng = np.random.default_rng(8)
    x, _ = tensor(spark, rng, 20, (4, 5, 6))
    y = x.where("false")
    assert PLANS[name](x, y, (0,), (0,)).df.count() == 0
    far = x.like(x.df.withColumn("i0", F.col("i0") + 100))
    assert PLANS[name](SparseTensor(x.df, 3), SparseTensor(far.df, 3), (0,), (0,)).df.count() == 0


def test_sums_of_zero_stay_unless_asked(spark):
    x = SparseTensor(spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, -1.0)], SCHEMA), 3)
    y = SparseTensor(spark.createDataFrame([(0, 0, 0, 2.0), (0, 1, 0, 2.0)], SCHEMA), 3)
    want = [tuple(r) for r in contract(x, y, (0, 1), (0, 1)).df.collect()]
    assert want == [(0, 0, 0.0)]
    for plan in ("tiles", "grid", "aligned"):
        assert [tuple(r) for r in plans.contract_by_plan(x, y, (0, 1), (0, 1), plan).df.collect()] == want
        assert plans.contract_by_plan(x, y, (0, 1), (0, 1), plan, drop_zeros=True).df.count() == 0


def test_no_cell_of_the_grid_makes_more_than_the_limit(spark):
    rng = np.random.default_rng(9)
    x, _ = tensor(spark, rng, 3000, (40, 5, 4), 0.5)
    y, _ = tensor(spark, rng, 700, (40, 5, 4), 0.5)
    for limit in (1, 7, 1000, 50_000):
        cells = plans.grid_cells(x, y, (0,), (0,), limit).collect()
        assert cells and max(r.most for r in cells) <= limit
        if limit > 1:
            # Not many more cells than the products need.
            assert all(r.cells <= 4 * r.n * r.m / limit + 4 for r in cells if limit > 100)
    # One side far below the root of the limit stays whole.
    one = SparseTensor(spark.createDataFrame([(0, 0, 0, 1.0)], SCHEMA), 3)
    row = plans.grid_cells(x, one, (0,), (0,), 100).first()
    assert row.most == 100 and row.cells == -(-row.n // 100)


def test_heavy_keys_are_dealt_without_numbering_a_key_in_one_task(spark):
    x = SparseTensor(spark.range(20_000, numPartitions=16).selectExpr("0L i0", "id i1", "0L i2", "1.0D v"), 3)
    left, _ = plans._cells(plans._Sides(x, x, (0,), (0,)), plans._grids(plans._Sides(x, x, (0,), (0,)), 1 << 20))
    sizes = [r["count"] for r in left.where("gy = 0").groupBy("gx").count().collect()]
    assert sorted(sizes)[1:] == [1024] * 19 and sum(sizes) == 20_000


def test_tasks_of_the_grid_are_few(spark):
    """20,000 products a key in cells of 100: cells grow with products, tasks don't."""
    x = SparseTensor(spark.range(20_000, numPartitions=4).selectExpr("id % 3 i0", "id i1", "0L i2", "1.0D v"), 3)
    y = SparseTensor(spark.range(1500, numPartitions=4).selectExpr("id % 3 i0", "id i1", "0L i2", "1.0D v"), 3)
    plan = plan_of(plans.contract_grid(x, y, (0,), (0,), 100).df)
    assert {int(n) for n in re.findall(r"hashpartitioning\(k0#\w+, gx#\w+, gy#\w+, (\d+)\)", plan)} == {4}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_aligned_plans_have_no_exchange_after_the_join(spark):
    rng = np.random.default_rng(10)
    x, _ = tensor(spark, rng, 100, (6, 5, 4))
    y, _ = tensor(spark, rng, 100, (6, 5, 4))
    plan = plan_of(plans.contract_aligned(x, y, (0,), (0,)).df)
    assert len(re.findall(r"Exchange (hash|range)partitioning", plan)) == 1
    # Copies: between the join and the result there is no exchange, and both sides come by bucket.
    s = plans._Sides(x, y, (0,), (0,))
    left = s.left.withColumn("bucket", F.col("z0") % 5)
    right = s.right.withColumn("bucket", F.col("z2") % 5)
    met = plans._met_in_buckets(left, right, s, 5)
    met.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(met)
    above, below = plan.split("Join", 1)
    assert "Aggregate" in above and "Exchange" not in above
    assert len(re.findall(r"Exchange hashpartitioning\(bucket#\w+, 5\)", below)) == 2


def test_tiles_make_a_row_for_pairs_of_tiles_only(spark):
    x = SparseTensor(spark.range(30_000).selectExpr("id % 100 i0", "id % 211 i1", "0L i2", "1.0D v"), 3, (100, 211, 1))
    z = plans.contract_tiles(x, x, (0, 2), (0, 2))
    assert "MapInArrow" in plan_of(z.df) and z.df.count() == 211 * 211
    assert plans.choose_plan(x, x, (0, 2), (0, 2)) == "tiles"


def test_tiles_pass_each_cell_of_a_task_on_once(spark, monkeypatch):
    """Thin tiles over many contract tiles: what is summed at the end has a row for each cell and task, not for each product."""
    seen = []
    tensor = plans._Sides.tensor
    monkeypatch.setattr(plans._Sides, "tensor", lambda self, df: seen.append(df) or tensor(self, df))
    x = SparseTensor(spark.range(20_000).selectExpr("id i0", "id % 150 i1", "1.0D v"), 2, (20_000, 150))
    y = SparseTensor(spark.range(20_000).selectExpr("id i0", "id % 3 i1", "2.0D v"), 2, (20_000, 3))
    z = plans.contract_tiles(x, y, (0,), (0,), tile_bits=1)
    assert sorted(map(tuple, z.df.collect())) == sorted((i, i % 3, 2.0 * len(range(i, 20_000, 150))) for i in range(150))
    made = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in made and "Join" in made.split("MapInArrow", 1)[1] and "Join" not in made.split("MapInArrow", 1)[0]
    assert "tk" in made and "Union" in made  # tiles of both sides come as one stream, none repeated for a pair


def test_choice_of_plan(spark):
    rng = np.random.default_rng(11)
    x, _ = tensor(spark, rng, 400, (50, 500, 400), 0.5)
    assert plans.choose_plan(x, x, (0,), (0,), limit=1000) == "grid"
    assert plans.choose_plan(x, x, (0,), (0,)) == "aligned"
    assert plans.choose_plan(x, x, (0, 1, 2), (0, 1, 2)) == "tiles"  # one cell gets all products
    huge = SparseTensor(x.df, 3, (1 << 40, 1 << 40, 1 << 40))
    assert plans.choose_plan(huge, huge, (0,), (0,)) == "aligned"


def test_choice_of_plan_does_not_turn_with_the_size_of_the_tables(spark, monkeypatch):
    """Every entry of x meets one of y: x is dealt once, whether or not y fits a broadcast."""
    x = SparseTensor(spark.range(4000).selectExpr("id div 4 i0", "id % 997 i1", "1.0D v"), 2, (1000, 1000))
    y = SparseTensor(spark.range(1000).selectExpr("id i0", "id % 991 i1", "1.0D v"), 2, (1000, 1000))
    monkeypatch.setattr(plans, "BROADCAST_BYTES", 100)
    assert plans.choose_plan(x, y, (0,), (0,)) == "aligned"
    many = SparseTensor(y.df.unionByName(y.df).unionByName(y.df), 2, (1000, 1000))
    assert plans.choose_plan(x, many, (0,), (0,)) == "join"


def test_rounds_keep_their_bound_and_go_on_where_they_were(spark, tmp_path):
    rng = np.random.default_rng(12)
    x, a = tensor(spark, rng, 600, (9, 40, 6))
    y, b = tensor(spark, rng, 300, (9, 5, 6))
    found = plans.round_products(x, y, (0,), (0,), 3000).collect()
    by = {}
    for r in found:
        by.setdefault(r["round"], []).append(r.products)
    assert len(by) >= 8
    assert all(sum(p) <= 3000 or max(p) > 1500 for p in by.values())
    assert sorted((r.z0, r.z1) for r in found) == [(r.z0, r.z1) for r in sorted(found, key=lambda r: (r["round"], r.z0, r.z1))]
    folder = f"file://{tmp_path}/rounds"
    z = plans.contract_rounds(x, y, (0,), (0,), 3000, folder)
    want = dense(z, (40, 6, 5, 6))
    assert np.allclose(want, np.einsum("kab,kcd->abcd", a, b))
    # A round that was not finished is made again, and no other is.
    results = sorted((tmp_path / "rounds" / "result").iterdir())
    assert len(results) == len(by)
    times = {p: (p / "_SUCCESS").stat().st_mtime_ns for p in results}
    (results[3] / "_SUCCESS").unlink()
    again = plans.contract_rounds(x, y, (0,), (0,), 3000, folder)
    assert (dense(again, (40, 6, 5, 6)) == want).all()
    assert [p for p in results if (p / "_SUCCESS").stat().st_mtime_ns != times[p]] == [results[3]]


def test_errors(spark):
    x = SparseTensor(spark.createDataFrame([(0, 0, 0, 1.0)], SCHEMA), 3, (2, 3, 4))
    for plan in (plans.contract_grid, plans.contract_tiles, plans.contract_aligned):
        with pytest.raises(ValueError):
            plan(x, x, (0,), (1,))
        with pytest.raises(ValueError):
            plan(x, x, (), ())
    with pytest.raises(ValueError):
        plans.contract_aligned(x, x, (0, 1, 2), (0, 1, 2))
