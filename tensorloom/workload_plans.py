"""Queries of the further plans: their results, and the bounds that they keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tensorloom.operators import block_products as blocks
from tensorloom.operators import contract as ct
from tensorloom.operators import contract_plans as plans
from tensorloom.operators import dense, resident
from tensorloom.plans.einsum import einsum
from tensorloom.sources import files
from tensorloom.sources.binary import FILE_BYTES
from tensorloom.tensor import SparseTensor
from tensorloom.workload import Tensors, query

# Contraction of skewed keys: a tenth of the suppliers count as one.
_HEAVY = "(SELECT greatest(l_suppkey, 10) k, CAST(l_linenumber AS BIGINT) line, CAST(month(l_shipdate) AS BIGINT) m, l_quantity v FROM lineitem)"


def _skewed(t: Tensors, free) -> SparseTensor:
    return t.lineitem(F.greatest("l_suppkey", F.lit(10)), free)


_LIMIT = 1 << 18


def _heavy(t: Tensors) -> tuple[SparseTensor, SparseTensor]:
    return _skewed(t, "l_linenumber"), _skewed(t, F.month("l_shipdate"))


query("sptc_heavy_grid", f"SELECT line i0, m i1, SUM(a.v * b.v) v FROM (SELECT k, line, SUM(v) v FROM {_HEAVY} GROUP BY ALL) a JOIN (SELECT k, m, SUM(v) v FROM {_HEAVY} GROUP BY ALL) b USING (k) GROUP BY ALL")(
    lambda t: plans.contract_grid(*(x.coalesce() for x in _heavy(t)), (0,), (0,), _LIMIT)
)
# The bound that the grid keeps: both chunks are near the root of the limit, so no cell makes more products.
query("heavy_grid_cells", f"""SELECT k k0, n, n m, CAST(ceil(n / {int(_LIMIT**0.5)}.0) AS BIGINT) * CAST(ceil(n / {int(_LIMIT**0.5)}.0) AS BIGINT) cells, least(n, {int(_LIMIT**0.5)}) * least(n, {int(_LIMIT**0.5)}) most
FROM (SELECT k, COUNT(*) n FROM {_HEAVY} GROUP BY k) WHERE n * n > {_LIMIT}""")(lambda t: plans.grid_cells(*_heavy(t), (0,), (0,), _LIMIT))

_SUPPLIER_CUSTOMER = "SELECT a.i1 i0, b.i1 i1, SUM(a.v * b.v) v FROM os a JOIN oc b USING (i0) GROUP BY ALL"
query("sptc_aligned", _SUPPLIER_CUSTOMER)(lambda t: plans.contract_aligned(t.os(), t.oc(), (0,), (0,)))
query("sptc_aligned_copies", _SUPPLIER_CUSTOMER)(lambda t: plans.contract_aligned(t.os(), t.oc(), (0,), (0,), broadcast_bytes=0))

_MONTHS = "(SELECT CAST(l_partkey AS BIGINT) i0, CAST(month(l_shipdate) AS BIGINT) i1, l_quantity v FROM lineitem)"


def _dense(t: Tensors) -> tuple[SparseTensor, SparseTensor]:
    """Supplier by month over common parts: nearly every cell of the result has products."""
    return t.lineitem("l_partkey", "l_suppkey"), t.lineitem("l_partkey", F.month("l_shipdate"))


query("sptc_tiles", f"SELECT a.i1 i0, b.i1 i1, SUM(a.v * b.v) v FROM (SELECT i0, i1, SUM(v) v FROM l3 GROUP BY ALL) a JOIN {_MONTHS} b USING (i0) GROUP BY ALL")(lambda t: plans.contract_tiles(*_dense(t), (0,), (0,)))
query("choose_contraction", f"""SELECT 'dense' AS name, CASE WHEN (SELECT SUM(n * m) FROM (SELECT i0, COUNT(*) n FROM l3 GROUP BY i0) JOIN (SELECT i0, COUNT(*) m FROM {_MONTHS} GROUP BY i0) USING (i0))
    >= (SELECT MAX(i1) + 1 FROM l3) * 13 THEN 'tiles' ELSE 'other' END plan UNION ALL SELECT 'sparse', 'aligned'""")(
    lambda t: t.spark.createDataFrame([("dense", plans.choose_plan(*_dense(t), (0,), (0,))), ("sparse", plans.choose_plan(t.os(), t.oc(), (0,), (0,)))], "name string, plan string")
)


def _rounds(t: Tensors) -> tuple:
    """Operands and a limit that takes some 20 rounds at any scale."""
    x, y = t.os(), t.oc()
    return x, y, (0,), (0,), max(2, ct.estimate_products(x, y, (0,), (0,)).first()["products"] // 10)


query("sptc_rounds", _SUPPLIER_CUSTOMER)(lambda t: plans.contract_rounds(*_rounds(t)))
query("contraction_rounds", """SELECT i1 z0, products, CAST(floor(before / greatest(1, greatest(2, total // 10) // 2)) AS BIGINT) AS "round"
FROM (SELECT i1, products, CAST(SUM(products) OVER (ORDER BY i1) - products AS BIGINT) before, CAST(SUM(products) OVER () AS BIGINT) total FROM (SELECT os.i1, COUNT(*) products FROM os JOIN oc USING (i0) GROUP BY os.i1))""")(
    lambda t: plans.round_products(*_rounds(t))
)


# MTTKRP on formats: the SQL of the entry-wise plan.
def _mttkrp_sql(mode: int, rank: int = 8) -> str:
    a, b = (m for m in range(3) if m != mode)
    return f'SELECT i{mode} "row", ' + ", ".join(f"SUM(v * (i{a} + {r + 1}) * (i{b} + {r + 1})) c{r}" for r in range(rank)) + f" FROM l3 GROUP BY i{mode}"


query("mttkrp_hicoo_blocks", _mttkrp_sql(0))(lambda t: blocks.mttkrp_hicoo(blocks.hicoo_packed(x := t.l3(), 8), x.dims, 8, t.factors(x, 8), 0).df)
query("mttkrp_alto_parts", _mttkrp_sql(0))(lambda t: blocks.mttkrp_alto(blocks.alto_packed(x := t.l3(), 16), t.factors(x, 8), 0).df)
query("mttkrp_blco_stream", _mttkrp_sql(1))(lambda t: blocks.mttkrp_blco(blocks.blco_packed(x := t.l3(), 18, 4096), t.factors(x, 8), 1, broadcast_bytes=0).df)


# Binary files, written and read by many tasks; large tensors as folders of files.
@query("io_bin", "SELECT * FROM l3")
def _bin(t: Tensors) -> SparseTensor:
    files.write_bin(t.l3(), path := f"{t.folder()}/t.bin", file_bytes=FILE_BYTES)
    return files.read_bin(t.spark, path, entries=10_000)


@query("io_bin_plain", "SELECT * FROM os")
def _bin_plain(t: Tensors) -> SparseTensor:
    files.write_bin(t.os(), path := f"{t.folder()}/t.bin", header=False, file_bytes=FILE_BYTES)
    return files.read_tensor(t.spark, path, header=False)


@query("io_bin_narrow", "SELECT * FROM os")
def _bin_narrow(t: Tensors) -> SparseTensor:
    files.write_bin(t.os(), path := f"{t.folder()}/t.bin", index_bytes=4, value_bytes=4, file_bytes=FILE_BYTES)
    return files.read_bin(t.spark, path)


_PARTS = "(SELECT i0, SUM(CASE WHEN i2 = 1 THEN v ELSE 0 END) c0, SUM(CASE WHEN i2 = 2 THEN v ELSE 0 END) c1 FROM l3 GROUP BY i0)"
_ROWS = "(SELECT unnest(range(0, (SELECT MAX(i0) + 1 FROM l3)))::BIGINT i)"
_CELLS = f'SELECT i "row", c::BIGINT col, COALESCE(CASE c WHEN 0 THEN c0 ELSE c1 END, 0) v FROM {_ROWS} LEFT JOIN {_PARTS} ON i0 = i, (SELECT unnest([0, 1]) c)'


def _two_columns(t: Tensors) -> dense.Matrix:
    x = t.l3()
    df = x.df.groupBy(F.col("i0").alias("row")).agg(*(F.sum(F.when(F.col("i2") == r + 1, F.col("v")).otherwise(0.0)).alias(f"c{r}") for r in range(2)))
    return dense.Matrix(df, x.dims[0], 2)


@query("io_matrix", _CELLS)
def _matrix_file(t: Tensors):
    files.write_matrix(_two_columns(t), path := f"{t.folder()}/m.out")
    return files.read_cells(t.spark, path)


@query("io_vector", f'SELECT i "row", COALESCE(c0, 0) v FROM {_ROWS} LEFT JOIN {_PARTS} ON i0 = i')
def _vector_file(t: Tensors):
    a = _two_columns(t)
    files.write_vector(a.df.select("row", F.col("c0").alias("v")), a.rows, path := f"{t.folder()}/v.out")
    return files.read_cells(t.spark, path)


@query("io_kruskal", f"""SELECT 'factor' AS name, * FROM ({_CELLS}) UNION ALL SELECT 'weight', r, 0, [SUM(c0), SUM(c1)][r + 1] FROM {_PARTS}, (SELECT unnest([0, 1])::BIGINT r) GROUP BY r""")
def _kruskal_files(t: Tensors):
    a = _two_columns(t)
    weights = a.df.agg(F.sum("c0"), F.sum("c1")).first()
    files.write_kruskal(list(weights), [a], prefix := f"{t.folder()}/k")
    of = lambda name, df: df.select(F.lit(name).alias("name"), "row", F.col("col") if "col" in df.columns else F.lit(0).cast("long").alias("col"), "v")
    return of("factor", files.read_cells(t.spark, f"{prefix}.0.out")).unionByName(of("weight", files.read_cells(t.spark, f"{prefix}.lambda.out")))


# Order of a chain by its products, and tensors that stay where they lie.
_CHAIN = "SELECT a.i1 i0, d.i1, SUM(a.v * b.v * c.v * d.v) v FROM oc a JOIN os b USING (i0) JOIN sn c ON b.i1 = c.i0 JOIN nr d ON c.i1 = d.i0 GROUP BY ALL"
query("einsum_by_cost", _CHAIN)(lambda t: einsum("oc,os,sn,nr->cr", t.oc(), t.os(), t.sn(), t.nr(), by_cost=True))
query("sptc_resident", "SELECT a.i1 i0, b.i1 i1, SUM(a.v * b.v) v FROM oc a JOIN os b USING (i0) GROUP BY ALL")(lambda t: resident.contract_resident(resident.keep(t.oc(), (0,)), resident.keep(t.os(), (0,))))
query("sptc_resident_chain", "SELECT a.i1 i0, c.i1, SUM(a.v * b.v * c.v) v FROM oc a JOIN os b USING (i0) JOIN sn c ON b.i1 = c.i0 GROUP BY ALL")(
    lambda t: resident.contract_resident(resident.contract_resident(t.oc(), resident.keep(t.os(), (0,)), (0,)), resident.keep(t.sn(), (0,)), (1,))
)
