import numpy as np
import pytest

from tensorloom.operators import block_products as blocks
from tensorloom.operators import dense
from tensorloom.operators.layout import alto_conflicts
from tensorloom.tensor import SparseTensor


def tensor(spark, seed, n, dims):
    rng = np.random.default_rng(seed)
    i = np.stack([rng.integers(0, d, n) for d in dims], 1)
    i[: n // 3] = i[0]  # a third of all entries at one place
    i[-1] = [d - 1 for d in dims]
    v = rng.integers(-5, 6, n).astype(float)
    a = np.zeros(dims)
    np.add.at(a, tuple(i.T), v)
    schema = ", ".join(f"i{m} long" for m in range(len(dims))) + ", v double"
    return SparseTensor(spark.createDataFrame([(*map(int, r), float(w)) for r, w in zip(i, v)], schema).repartition(4), len(dims), tuple(dims)), a


def factors(spark, dims, rank, seed=3):
    rng = np.random.default_rng(seed)
    arrays = [rng.normal(size=(d, rank)) for d in dims]
    schema = "row long, " + ", ".join(f"c{r} double" for r in range(rank))
    return [dense.Matrix(spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(a)], schema), len(a), rank) for a in arrays], arrays


def want(a, arrays, mode):
    letters = "abcd"[: a.ndim]
    others = [m for m in range(a.ndim) if m != mode]
    return np.einsum(f"{letters}," + ",".join(f"{letters[m]}r" for m in others) + f"->{letters[mode]}r", a, *(arrays[m] for m in others))


def same(got, expected):
    rows = got.df.collect()
    assert len({r.row for r in rows}) == len(rows)
    out = np.zeros_like(expected)
    for r in rows:
        out[r.row] = r[1:]
    assert np.allclose(out, expected)
    return rows


RUNS = {
    "hicoo": lambda x, f, m: blocks.mttkrp_hicoo(blocks.hicoo_packed(x, 2), x.dims, 2, f, m),
    "hicoo_shuffled": lambda x, f, m: blocks.mttkrp_hicoo(blocks.hicoo_packed(x, 3), x.dims, 3, f, m, broadcast_bytes=0),
    "alto": lambda x, f, m: blocks.mttkrp_alto(blocks.alto_packed(x, 5), f, m),
    "blco": lambda x, f, m: blocks.mttkrp_blco(blocks.blco_packed(x, 5, 7), f, m),
    "blco_shuffled": lambda x, f, m: blocks.mttkrp_blco(blocks.blco_packed(x, 4, 50), f, m, broadcast_bytes=0),
}


@pytest.mark.parametrize("name", RUNS)
def test_mttkrp_equals_numpy(spark, name):
    for dims, modes in (((13, 6, 21), (0, 1, 2)), ((5, 1, 9, 4), (1, 2))):
        x, a = tensor(spark, 1, 150, dims)
        f, arrays = factors(spark, dims, 3)
        for mode in modes:
            same(RUNS[name](x, f, mode), want(a, arrays, mode))


@pytest.mark.parametrize("name", RUNS)
def test_empty_and_errors(spark, name):
    x, _ = tensor(spark, 2, 30, (4, 5, 6))
    f, _ = factors(spark, (4, 5, 6), 2)
    assert RUNS[name](x.where("false"), f, 0).df.count() == 0
    with pytest.raises(ValueError):
        RUNS[name](x, f[:2], 0)
    with pytest.raises(ValueError, match="factor 1 has 3 rows"):
        RUNS[name](x, [f[0], dense.Matrix(f[1].df, 3, 2), f[2]], 0)
    holes = [f[0], dense.Matrix(f[1].df.where("row <> 4"), 5, 2), f[2]]
    with pytest.raises(Exception, match="no row for an index"):
        RUNS[name](x, holes, 0).df.count()


def test_joins_of_blocks_have_a_row_for_each_block(spark):
    x, _ = tensor(spark, 3, 4000, (64, 64, 64))
    packed = blocks.hicoo_packed(x, 4)
    n = packed.count()
    assert n <= 64 and x.nnz() == 4000
    assert sum(len(r["values"]) for r in packed.collect()) == x.coalesce().nnz()
    f, _ = factors(spark, (64, 64, 64), 2)
    joined = blocks._slice_join(packed, f[1], 4, "b1", 1 << 20)
    assert joined.count() == n


def test_alto_parts_have_equal_numbers_and_merge_shared_rows_only(spark):
    x, a = tensor(spark, 4, 3000, (300, 40, 30))
    x = x.coalesce()
    packed = blocks.alto_packed(x, 8)
    rows = packed.df.collect()
    sizes = sorted(len(r["values"]) for r in rows)
    assert len(rows) == 8 and sizes[1] == sizes[-1] and sizes[-1] - sizes[0] <= 8
    shared = {(r.mode, r.i) for r in alto_conflicts(x, 8).collect()}
    assert {(r.mode, r.i) for r in packed.conflicts.collect()} == shared
    f, arrays = factors(spark, (300, 40, 30), 2)
    out = blocks.mttkrp_alto(packed, f, 0)
    got = same(out, want(a, arrays, 0))
    # The rows that go to the exchange are those that the parts share.
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    before = [r for r in got if (0, r.row) in shared]
    assert 0 < len(before) < len(got)


def test_large_parts_are_cut(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 10)
    x, _ = tensor(spark, 5, 200, (30, 20, 10))
    assert max(len(r["values"]) for r in blocks.alto_packed(x, 2).df.collect()) <= 10


def test_blco_batches_keep_their_bound(spark):
    dims = (1000, 50, 700)
    x, a = tensor(spark, 6, 2000, dims)
    packed = blocks.blco_packed(x, 12, 100)
    rows = packed.df.collect()
    assert max(len(r["values"]) for r in rows) == 100 and sum(len(r["values"]) for r in rows) == 2000
    assert packed.free_bits() == [4, 4, 4]
    rank = 3
    f, arrays = factors(spark, dims, rank)
    # Slices of factors over the broadcast limit: no more rows than a block spans, and the stated bytes in all.
    slices = [blocks.factor_slices(f[m], packed.free_bits()[m], "s").collect() for m in range(3)]
    largest = [max(8 * (len(r.s_at) + len(r.s_cells)) for r in s) for s in slices]
    assert 8 * 100 * (2 + rank) + sum(largest) <= packed.batch_bytes(rank)
    same(blocks.mttkrp_blco(packed, f, 2, broadcast_bytes=0), want(a, arrays, 2))
    with pytest.raises(ValueError, match="too large"):
        blocks.mttkrp_alto(blocks.alto_packed(x, 2), f, 0, broadcast_bytes=100)


def test_slices_are_sent_once_for_all_blocks_that_need_them(spark):
    """300 blocks need one slice: before, each carried a copy of it."""
    x = SparseTensor(spark.range(600).selectExpr("id * 4 i0", "id % 4 i1", "1.0D v"), 2, (2400, 4))
    packed = blocks.hicoo_packed(x, 3)
    assert packed.count() == 300
    f, _ = factors(spark, x.dims, 2)
    sent = blocks._streamed(packed, [("b1", f[1], 3)], ["b0", "values", "e0", "e1"], 0).collect()
    assert sum(r.which == blocks.BLOCKS for r in sent) == 300
    assert 1 <= sum(r.which == 0 for r in sent) <= 16  # a deal for each of a few tasks


def test_decoding_undoes_interleaving(spark):
    dims = (1 << 20, 3, 1, 500)
    rng = np.random.default_rng(7)
    rows = [tuple(int(rng.integers(0, d)) for d in dims) + (1.0,) for _ in range(200)]
    x = SparseTensor(spark.createDataFrame(rows, "i0 long, i1 long, i2 long, i3 long, v double"), 4, dims)
    from tensorloom.functions import bits

    widths = [bits.width(d) for d in dims]
    out = x.df.withColumn("key", bits.alto(x.coords, widths)).collect()
    at = blocks._decoded(np.array([r.key for r in out]), bits.alto_places(widths), 4)
    assert [tuple(map(int, t)) for t in zip(*at)] == [(r.i0, r.i1, r.i2, r.i3) for r in out]


def test_sums_over_sparse_and_dense_intervals():
    rng = np.random.default_rng(8)
    for index in (rng.integers(0, 50, 300), rng.integers(0, 1 << 50, 300), np.zeros(0, np.int64)):
        index = np.concatenate([index, index[:40]])
        p = rng.normal(size=(len(index), 2))
        rows, sums = blocks._summed(index, p)
        assert list(rows) == sorted(set(index.tolist()))
        assert all(np.allclose(s, p[index == r].sum(0)) for r, s in zip(rows, sums))
