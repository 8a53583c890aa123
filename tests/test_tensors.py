import numpy as np
import pytest

from tensorloom.functions import running
from tensorloom.functions.running import runs
from tensorloom.operators import contract as ct
from tensorloom.operators import cpd, dense, elementwise, layout, products
from tensorloom.plans.einsum import einsum
from tensorloom.sources import files
from tensorloom.tensor import SparseTensor


def tensor(spark, rows, order, dims=None):
    schema = ", ".join(f"i{m} long" for m in range(order)) + ("," if order else "") + " v double"
    return SparseTensor(spark.createDataFrame([(*map(int, r[:-1]), float(r[-1])) for r in rows], schema), order, dims)


def random_tensor(spark, dims, nnz, seed):
    rng = np.random.default_rng(seed)
    rows = np.stack([rng.integers(0, d, nnz) for d in dims] + [rng.integers(-3, 4, nnz)], 1)
    array = np.zeros(dims)
    np.add.at(array, tuple(rows[:, :-1].T), rows[:, -1])
    return tensor(spark, rows.tolist(), len(dims), tuple(dims)), array


def densified(x, dims):
    out = np.zeros(dims)
    for r in x.df.collect():
        out[tuple(r[:-1])] += r[-1]
    return out


def test_contract_against_einsum(spark):
    x, a = random_tensor(spark, (5, 4, 6), 60, 1)
    y, b = random_tensor(spark, (6, 5, 3), 50, 2)
    for z in (ct.contract(x, y, (0, 2), (1, 0)), ct.contract(x, y, (0, 2), (1, 0), pre_sum=True, strict=True), einsum("abc,cad->bd", x, y)):
        assert np.array_equal(densified(z, (4, 3)), np.einsum("abc,cad->bd", a, b))
    assert np.array_equal(densified(ct.chain(x, y, y, ((2,), (0,)), ((2, 3), (1, 2))), (5, 4, 6)), np.einsum("abc,cde,fde->abf", a, b, b))
    w, c = random_tensor(spark, (3, 4), 9, 3)
    z = einsum("abc,cad,de->be", x, y, w, dims=dict(zip("abcde", (5, 4, 6, 3, 4))))
    assert np.array_equal(densified(z, (4, 4)), np.einsum("abc,cad,de->be", a, b, c))
    assert ct.inner(x, x).df.first()["v"] == (a * a).sum()
    assert ct.estimate_products(x, x, (0, 1, 2), (0, 1, 2)).first()[0] == x.df.join(x.df.withColumnRenamed("v", "w"), x.coords).count()
    assert np.array_equal(densified(ct.outer(w, w), (3, 4, 3, 4)), np.einsum("ab,cd->abcd", c, c))


def test_contract_edges(spark):
    x, y = tensor(spark, [(0, 0, 1), (0, 1, 1)], 2), tensor(spark, [(0, 0, 1), (1, 0, -1)], 2)
    assert [tuple(r) for r in ct.contract(x, y, (1,), (0,)).df.collect()] == [(0, 0, 0.0)]
    assert ct.contract(x, y, (1,), (0,), drop_zeros=True).nnz() == 0
    assert ct.contract(x, tensor(spark, [(7, 7, 1)], 2), (1,), (0,)).nnz() == 0
    empty = tensor(spark, [], 2)
    assert ct.contract(empty, y, (1,), (0,)).nnz() == 0 and ct.inner(empty, empty).df.first()["v"] == 0
    assert empty.dims == (0, 0) and elementwise.status(empty).first()["density"] == 0
    # Keys match by value, whatever the widths of the dimensions.
    p, q = tensor(spark, [(1, 3, 1)], 2, (4, 4)), tensor(spark, [(1, 3, 5), (3, 1, 7)], 2, (4, 16))
    with pytest.raises(ValueError):
        ct.contract(p, q, (0, 1), (0, 1))
    assert ct.contract(p, q, (0, 1), (0, 1), strict=False).df.first()["v"] == 5
    with pytest.raises(ValueError):
        ct.contract(p, q, (0, 0), (0, 1))
    # Coordinates of more than 63 bits in all.
    far = tensor(spark, [(2**40, 2**41, 3)], 2)
    assert ct.inner(far, far).df.first()["v"] == 9
    with pytest.raises(ValueError):
        layout.linearized(far)


def test_elementwise_laws(spark):
    x, a = random_tensor(spark, (6, 7), 30, 4)
    y, b = random_tensor(spark, (6, 7), 30, 5)
    for f, want in ((elementwise.add, a + b), (elementwise.sub, a - b), (elementwise.mul, a * b)):
        z = f(x, y)
        assert np.array_equal(densified(z, (6, 7)), want) and z.df.where("v = 0").count() == 0
    q = {tuple(r[:2]): r[2] for r in elementwise.div(tensor(spark, [(0, 0, 1), (0, 1, -1), (0, 2, 0), (1, 1, 6)], 2), tensor(spark, [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 1, 3)], 2)).df.collect()}
    assert q[0, 0] == np.inf and q[0, 1] == -np.inf and np.isnan(q[0, 2]) and q[1, 1] == 2
    assert elementwise.scale(x, 0).nnz() == 0
    with pytest.raises(ZeroDivisionError):
        elementwise.divide_by(x, 0)
    with pytest.raises(Exception, match="patterns differ"):
        elementwise.mul_same_pattern(x, tensor(spark, [(5, 6, 1)], 2, (6, 7))).df.collect()
    assert np.array_equal(densified(elementwise.mul_same_pattern(x, x), (6, 7)), a * a)
    with pytest.raises(ValueError):
        elementwise.add(x, tensor(spark, [], 2, (6, 8)))


def test_products_and_layouts(spark):
    x, a = random_tensor(spark, (4, 5, 3), 40, 6)
    factors = [dense.uniform(spark, d, 2, 9 + m) for m, d in enumerate(x.dims)]
    u = [np.array([r[1:] for r in sorted(f.df.collect())]) for f in factors]
    for mode, e in enumerate(("abc,br,cr->ar", "abc,ar,cr->br", "abc,ar,br->cr")):
        got = np.zeros((x.dims[mode], 2))
        for r in products.mttkrp(x, factors, mode).df.collect():
            got[r[0]] = r[1:]
        assert np.allclose(got, np.einsum(e, a, *(w for m, w in enumerate(u) if m != mode)))
    y, b = random_tensor(spark, (2, 3, 3), 9, 7)
    assert np.array_equal(densified(products.kronecker(x, y), (8, 15, 9)), np.kron(a, b))
    assert np.array_equal(densified(products.khatri_rao(x, y), (8, 15, 3)), np.stack([np.kron(a[..., k], b[..., k]) for k in range(3)], -1))
    got = np.zeros((5, 12))
    for r in layout.matricize(x, 1).collect():
        got[r.row, r.col] += r.v
    assert np.array_equal(got, np.transpose(a, (1, 2, 0)).reshape(5, 12))
    assert np.array_equal(densified(layout.from_semisparse(layout.to_semisparse(x, 1), 1), (4, 5, 3)), a)
    assert np.array_equal(densified(layout.delinearized(layout.linearized(x, (1, 2, 0)), x.dims, (1, 2, 0)), (4, 5, 3)), a)
    perm = sorted(r.new for r in layout.random_map(spark, 500, 3).collect())
    assert perm == list(range(500))
    one = tensor(spark, [(0, 2, 1)], 2, (1, 4))
    assert [tuple(r) for r in layout.linearized(one).collect()] == [(2, 1.0)]


def greedy(counts, weight, fill):
    """Runs of keys by the rule, one after another: {key: run}."""
    out, run, held = {}, -1, None
    for key, n in sorted(counts.items()):
        if held is None or (held >= weight if fill else held + n > weight):
            run, held = run + 1, 0
        out[key], held = run, held + n
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_against_the_greedy_rule(spark, seed, monkeypatch):
    monkeypatch.setattr(running, "BLOCK_KEYS", (40, 1 << 20, 15)[seed - 1])  # blocks that runs and groups span
    rng = np.random.default_rng(seed)
    groups = [{int(k): int(n) for k, n in zip(rng.choice(900, size, replace=False), rng.integers(1, (40, 4, 3000)[seed - 1], size))} for size in (1, 30, 250)]
    rows = [(g, k, n) for g, counts in enumerate(groups) for k, n in counts.items()]
    df = spark.createDataFrame(rows, "group long, key long, n long")
    for weight in ((1, 10**6), (7,), (100,))[seed - 1]:
        for fill in (False, True):
            want, base = {}, 0
            for g, counts in enumerate(groups):
                own = greedy(counts, weight, fill)
                want |= {(g, k): base + r for k, r in own.items()}
                base += max(own.values()) + 1
            assert {(r.group, r.key): r.run for r in runs(df, "key", weight, fill).collect()} == want
    assert runs(df.limit(0), "key", 5, True).count() == 0


def test_split_bounds_hold_their_parts(spark):
    x, a = random_tensor(spark, (40, 9, 7), 500, 11)
    parts, bounds = layout.split(x, [60, 0, 25])
    limits = {r.part: r for r in bounds.collect()}
    held = {}
    for r in parts.df.collect():
        b = limits[r.part]
        assert b.low0 <= r.i0 < b.high0 and b.low1 <= r.i1 < b.high1 and b.low2 <= r.i2 < b.high2
        held.setdefault(r.part, []).append(r)
    assert {p: len(rows) for p, rows in held.items()} == {p: b.n for p, b in limits.items()} and sum(b.n for b in limits.values()) == 500
    assert all(b.n <= 25 or b.high2 - b.low2 == 1 for b in limits.values())
    assert np.array_equal(densified(SparseTensor(parts.df.select("i0", "i1", "i2", "v"), 3), (40, 9, 7)), a)


def test_alto_partitions_have_equal_numbers(spark):
    x, _ = random_tensor(spark, (8, 4, 16), 100, 12)
    whole = layout.alto_partitions(x, 8).collect()
    assert sorted((r.part, r.n) for r in whole) == [(p, 13) for p in range(7)] + [(7, 9)]
    shared = {(r.mode, r.i): r.parts for r in layout.alto_conflicts(x, 8).collect()}
    for (mode, i), n in shared.items():
        assert 1 < n <= sum(r[f"low{mode}"] <= i <= r[f"high{mode}"] for r in whole)


def test_orders_and_numbers(spark):
    x, _ = random_tensor(spark, (9, 9, 9), 200, 13)
    x = x.coalesce()
    rows = [tuple(r) for r in x.df.collect()]
    z = lambda *c: sum(((v >> 1) >> k & 1) << (len(c) * k + n) for k in range(3) for n, v in enumerate(c))
    orders = {
        "sort": (layout.sort(x, [2]), lambda r: (r[2], r[0], r[1])),
        "at": (layout.sort_at(x, 0), lambda r: (r[1], r[2], r[0])),
        "z": (layout.sort_blocks(x, 1, z_order=True), lambda r: (z(*r[:3]), r[:3])),
        "z without": (layout.sort_blocks(x, 1, z_order=True, without=0), lambda r: (z(*r[1:3]), r[1], r[2], r[0])),
        "rows": (layout.sort_blocks(x, 2), lambda r: ([c >> 2 for c in r[:3]], r[:3])),
        "mixed": (layout.sort_mixed(x, 2, 1), lambda r: ([c >> 2 for c in r[:3]], z(*r[:3]), r[:3])),
        "slices": (layout.sort_slices(x, 1, 2), lambda r: (r[1], r[0] >> 2, r[2] >> 2, r[0], r[2])),
    }
    for name, (got, key) in orders.items():
        numbers = sorted(tuple(r) for r in layout.row_numbers(got).collect())
        assert [r[0] for r in numbers] == list(range(len(rows))), name
        assert [r[1:] for r in numbers] == sorted(rows, key=key), name
    assert sorted(tuple(r) for r in layout.shuffle_elements(x, 3).df.collect()) == sorted(rows)
    assert [r.row for r in dense.identity(spark, 3).df.collect() if r[r.row + 1] == 1] == [0, 1, 2]


def test_only_large_blocks_are_numbered_in_ranges(spark, monkeypatch):
    x, _ = random_tensor(spark, (64, 8, 4), 900, 21)
    want = sorted(map(tuple, layout.blco_blocks(x, 6, 7).collect()))
    plan = layout.blco_blocks(x, 6, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    for large in (0, 60):
        monkeypatch.setattr(layout, "LARGE_BLOCK", large)
        assert sorted(map(tuple, layout.blco_blocks(x, 6, 7).collect())) == want


def test_runs_hold_blocks_of_bounded_memory(spark, monkeypatch):
    """A task holds a block as arrays and copies of them: its keys are few, however many there are."""
    seen = []
    keep = running.stored
    monkeypatch.setattr(running, "stored", lambda df: seen.append(out := keep(df)) or out)
    counts = spark.range(400_000).selectExpr("0L `group`", "id i", "1L n")
    assert runs(counts, "i", 1000, True).agg({"run": "max"}).first()[0] == 399
    sizes = [r["count"] for r in seen[0].groupBy("_block").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * (1 << 17)


def test_shuffled_elements_are_whole_and_mixed(spark):
    """The query returns every entry; in the order of the operator i0 rises at about half of all steps."""
    from tensorloom import workload

    t = workload.Tensors(spark, "/root/testdata/sf0.001")
    got = workload.queries()["shuffle_elements"](spark, t.sf)
    assert got.columns == ["i0", "i1", "i2", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, t.c3().df.collect()))
    rows = sorted(layout.row_numbers(layout.shuffle_elements(t.c3(), 5)).collect())
    assert [r.n for r in rows] == list(range(len(rows)))
    steps = np.diff([r.i0 for r in rows])
    assert 0.45 < (steps > 0).sum() / (steps != 0).sum() < 0.55


def test_cp_als_recovers_a_low_rank_tensor(spark):
    rng = np.random.default_rng(8)
    u = [rng.random((d, 2)) for d in (5, 4, 3)]
    full = np.einsum("ar,br,cr->abc", *u)
    x = tensor(spark, [(*i, v) for i, v in np.ndenumerate(full) for i in [tuple(i)]], 3, (5, 4, 3))
    k = cpd.cp_als(x, 2, sweeps=12, seed=1)
    other = cpd.cp_als(x, 2, sweeps=12, seed=1, by_length=True, two_norm=True)
    assert 0.95 < other.fit <= 1 and abs(cpd.kruskal_fit(x, other) - other.fit) < 1e-6
    assert 0.95 < k.fit <= 1 and abs(cpd.kruskal_fit(x, k) - k.fit) < 1e-6
    one = cpd.normalize_1(k)
    assert np.allclose(sorted(densified(SparseTensor(cpd.kruskal_values(x, one), 3), (5, 4, 3)).ravel()), sorted(densified(SparseTensor(cpd.kruskal_values(x, cpd.redistribute(k, 1)), 3), (5, 4, 3)).ravel()))


def test_poisson_tensor(spark):
    x = cpd.poisson_tensor(spark, [9, 8, 7], 3, 5000, 1)
    rows = x.df.collect()
    assert sum(r.v for r in rows) == 5000 and all(r.i0 < 9 and r.i1 < 8 and r.i2 < 7 for r in rows)
    assert sorted(rows) == sorted(cpd.poisson_tensor(spark, [9, 8, 7], 3, 5000, 1).df.repartition(7).collect())


def test_formats(spark, tmp_path):
    (tmp_path / "t.tns").write_text("1 2 3 1.5\n2\t2 1 -4e-1\n\n# c\n3 1 1 2")
    want = [(0, 1, 2, 1.5), (1, 1, 0, -0.4), (2, 0, 0, 2.0)]
    x = files.read_tensor(spark, str(tmp_path / "t.tns"))
    assert sorted(tuple(r) for r in x.df.collect()) == want and x.dims == (3, 2, 3)
    for n, options in enumerate(({}, {"header": False}, {"index_bytes": 4, "value_bytes": 4})):
        files.write_bin(x, str(tmp_path / f"{n}.bin"), **options)
        back = files.read_bin(spark, str(tmp_path / f"{n}.bin"), options.get("header", True))
        assert np.allclose(sorted(tuple(r) for r in back.df.collect()), want) and back.dims == (3, 2, 3)
    (tmp_path / "indices.txt").write_text("# modes\n1 2.0 3\n\n2e0 2 1\n3\t1  1\n")
    (tmp_path / "values.txt").write_text("1.5 -0.4\n2\n")
    assert sorted(tuple(r) for r in files.read_tensor(spark, str(tmp_path), quantum=True).df.collect()) == want
    wide, _ = random_tensor(spark, (50, 60), 700, 14)
    files.write_quantum(wide, str(tmp_path / "q"))
    assert sorted(tuple(r) for r in files.read_tensor(spark, str(tmp_path / "q"), quantum=True).df.collect()) == sorted(tuple(r) for r in wide.df.collect())
    (tmp_path / "bad.tns").write_text("0 1 1 2\n")
    with pytest.raises(Exception, match="malformed"):
        files.read_tns(spark, str(tmp_path / "bad.tns")).df.collect()
    files.write_dump(x, str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump/head")).first()[0] == "3"
    (tmp_path / "map.txt").write_text("\n".join("3 1 2 2 1 1 2 3".split()))
    first, second, third = files.read_index_map(spark, str(tmp_path / "map.txt"), [3, 2, 3])
    assert {tuple(r) for r in first.collect()} == {(0, 2), (1, 0), (2, 1)} and third.count() == 3
    files.write_kruskal([1.0], [dense.counting(spark, 2, 1)], str(tmp_path / "k"))
    assert (tmp_path / "k.0.out").read_text().startswith("matrix\n2\n2 1\n1.0000") and (tmp_path / "k.lambda.out").exists()
    cells = {(r.row, r.col): r.v for r in files.read_cells(spark, str(tmp_path / "k.0.out")).collect()}
    assert cells == {(0, 0): 1.0, (1, 0): 2.0}
    files.write_vector(spark.createDataFrame([(1, 0.5), (3, -2.0)], "row long, v double"), 5, str(tmp_path / "v.out"))
    assert [r.v for r in files.read_cells(spark, str(tmp_path / "v.out")).orderBy("row").collect()] == [0, 0.5, 0, -2.0, 0]
    files.write_index_map([first, second], str(tmp_path / "maps"))
    again = files.read_index_map(spark, str(tmp_path / "maps"), [3, 2])
    assert {tuple(r) for r in again[0].collect()} == {(0, 2), (1, 0), (2, 1)} and {tuple(r) for r in again[1].collect()} == {tuple(r) for r in second.collect()}
