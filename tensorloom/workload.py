"""The registered tensor queries over the given tables, each with the SQL that it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions import bits
from tensorloom.functions.running import numbered
from tensorloom.functions.storage import shared_dir
from tensorloom.operators import contract as ct
from tensorloom.operators import cpd, dense, elementwise, layout, products
from tensorloom.operators.contract_plans import contract_by_products
from tensorloom.plans.einsum import einsum
from tensorloom.sources import files
from tensorloom.tensor import SparseTensor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Shapes wide enough for any scale of the tables: 63 bits packed, and 63 bits in Z-order.
WIDE = (1 << 34, 1 << 26, 8)
CUBE = (1 << 21, 1 << 21, 1 << 21)

TENSORS = """WITH
l3 AS (SELECT CAST(l_partkey AS BIGINT) i0, CAST(l_suppkey AS BIGINT) i1, CAST(l_linenumber AS BIGINT) i2, l_quantity v FROM lineitem),
c3 AS (SELECT i0, i1, i2, SUM(v) v FROM l3 GROUP BY ALL),
a3 AS (SELECT * FROM c3 WHERE i2 <= 4),
b3 AS (SELECT i0, i1, i2, v - 25 v FROM c3 WHERE i2 >= 3),
oc AS (SELECT o_orderkey i0, o_custkey i1, 1.0::DOUBLE v FROM orders),
os AS (SELECT l_orderkey i0, l_suppkey i1, l_quantity v FROM lineitem),
sn AS (SELECT s_suppkey i0, CAST(s_nationkey AS BIGINT) i1, 1.0::DOUBLE v FROM supplier),
nr AS (SELECT CAST(n_nationkey AS BIGINT) i0, CAST(n_regionkey AS BIGINT) i1, n_nationkey + 1.0::DOUBLE v FROM nation),
rr AS (SELECT CAST(r_regionkey AS BIGINT) i0, CAST(r_regionkey AS BIGINT) % 3 i1, r_regionkey + 2.0::DOUBLE v FROM region)
"""


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Tensors:
    """The tensors that queries use, by the names of TENSORS."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def lineitem(self, *modes: str, dims=None) -> SparseTensor:
        return SparseTensor.from_table(read(self.spark, self.sf, "lineitem"), modes, "l_quantity", dims)

    def l3(self, dims=None) -> SparseTensor:
        return self.lineitem("l_partkey", "l_suppkey", "l_linenumber", dims=dims)

    def c3(self, dims=None) -> SparseTensor:
        return self.l3(dims).coalesce()

    def a3(self) -> SparseTensor:
        return self.c3().where("i2 <= 4")

    def b3(self) -> SparseTensor:
        x = self.c3().where("i2 >= 3")
        return x.like(x.df.withColumn("v", F.col("v") - 25), True)

    def oc(self) -> SparseTensor:
        return SparseTensor.from_table(read(self.spark, self.sf, "orders"), ["o_orderkey", "o_custkey"], F.lit(1.0))

    def os(self) -> SparseTensor:
        return self.lineitem("l_orderkey", "l_suppkey")

    def sn(self) -> SparseTensor:
        return SparseTensor.from_table(read(self.spark, self.sf, "supplier"), ["s_suppkey", "s_nationkey"], F.lit(1.0))

    def nr(self) -> SparseTensor:
        return SparseTensor.from_table(read(self.spark, self.sf, "nation"), ["n_nationkey", "n_regionkey"], F.col("n_nationkey") + 1.0)

    def rr(self) -> SparseTensor:
        return SparseTensor.from_table(read(self.spark, self.sf, "region"), ["r_regionkey", F.col("r_regionkey") % 3], F.col("r_regionkey") + 2.0)

    def factors(self, x: SparseTensor, rank: int) -> list[dense.Matrix]:
        return [dense.counting(self.spark, d, rank) for d in x.dims]

    def folder(self) -> str:
        return f"{shared_dir(self.spark)}/files-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    """Register a query: it gets the tensors and returns a tensor or a DataFrame."""

    def register(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = f(Tensors(spark, sf))
            return out.df if isinstance(out, SparseTensor) else out

        QUERIES[name] = run
        if sql:
            SQL[name] = TENSORS + sql
        return f

    return register


# Contraction
query("sptc_2mode", "SELECT a.i2 i0, b.i2 i1, SUM(a.v * b.v) v FROM l3 a JOIN l3 b USING (i0, i1) GROUP BY ALL")(lambda t: ct.contract(t.l3(), t.l3(), (0, 1), (0, 1)))
query("sptc_2mode_pre_sum", "SELECT a.i2 i0, b.i2 i1, SUM(a.v * b.v) v FROM l3 a JOIN l3 b USING (i0, i1) GROUP BY ALL")(lambda t: ct.contract(t.l3(), t.l3(), (0, 1), (0, 1), pre_sum=True))
query("sptc_1mode", "SELECT a.i1 i0, b.i1 i1, SUM(a.v * b.v) v FROM l3 a JOIN l3 b USING (i0) GROUP BY ALL")(
    lambda t: contract_by_products(*(t.lineitem("l_partkey", "l_suppkey"),) * 2, (0,), (0,), pre_sum=True)
)
query("sptc_asym", "SELECT a.i1 i0, b.i1 i1, SUM(a.v * b.v) v FROM oc a JOIN os b USING (i0) GROUP BY ALL")(lambda t: ct.contract(t.oc(), t.os(), (0,), (0,)))
query("sptc_crossed_modes", "SELECT a.i2 i0, b.i2 i1, SUM(a.v * b.v) v FROM l3 a JOIN l3 b ON a.i0 = b.i1 AND a.i1 = b.i0 GROUP BY ALL")(lambda t: ct.contract(t.l3(), t.l3(), (0, 1), (1, 0)))
query("sptc_drop_zeros", "SELECT a.i0, a.i2 i1, b.i2, SUM(a.v * b.v) v FROM a3 a JOIN b3 b USING (i0, i1) GROUP BY ALL HAVING SUM(a.v * b.v) <> 0")(
    lambda t: einsum("abc,abd->acd", t.a3(), t.b3()).drop_zeros()
)
query("sptc_chain", "SELECT a.i1 i0, c.i1, SUM(a.v * b.v * c.v) v FROM oc a JOIN os b USING (i0) JOIN sn c ON b.i1 = c.i0 GROUP BY ALL")(
    lambda t: ct.chain(t.oc(), t.os(), t.sn(), ((0,), (0,)), ((1,), (0,)))
)
query("einsum_chain", "SELECT a.i1 i0, c.i1, SUM(a.v * b.v * c.v) v FROM oc a JOIN os b USING (i0) JOIN sn c ON b.i1 = c.i0 GROUP BY ALL")(lambda t: einsum("oc,os,sn->cn", t.oc(), t.os(), t.sn()))
query("einsum_diagonal", "SELECT i0, SUM(v) v FROM l3 WHERE i0 = i1 GROUP BY i0")(lambda t: einsum("ii->i", t.lineitem("l_partkey", "l_suppkey")))
query("inner_product", "SELECT SUM(a.v * b.v) v FROM l3 a JOIN l3 b USING (i0, i1, i2)")(lambda t: ct.inner(t.l3(), t.l3()))
query("outer_small", "SELECT a.i0, a.i1, b.i0 i2, b.i1 i3, a.v * b.v v FROM oc a, rr b")(lambda t: ct.outer(t.oc(), t.rr()))
query("sptc_sorted", "SELECT row_number() OVER (ORDER BY i0, i1) - 1 n, i0, i1, v FROM (SELECT a.i1 i0, b.i1 i1, SUM(a.v * b.v) v FROM oc a JOIN os b USING (i0) GROUP BY ALL)")(
    lambda t: layout.row_numbers(ct.sort_result(ct.contract(t.oc(), t.os(), (0,), (0,))))
)
query("sptc_drop_zeros_flag", "SELECT a.i1 i0, b.i1, SUM(a.v * b.v) v FROM a3 a JOIN b3 b USING (i0, i2) GROUP BY ALL HAVING SUM(a.v * b.v) <> 0")(lambda t: ct.contract(t.a3(), t.b3(), (0, 2), (0, 2), drop_zeros=True))
query("estimate_products", "SELECT COUNT(*) products FROM l3 a JOIN l3 b USING (i0, i1)")(lambda t: ct.estimate_products(t.l3(), t.l3(), (0, 1), (0, 1)))

# Element-wise, scalars and reductions
query("coalesce", "SELECT * FROM c3")(lambda t: t.c3())
query("collect_zeros", "SELECT * FROM b3 WHERE v <> 0")(lambda t: t.b3().drop_zeros())
query("add", "SELECT i0, i1, i2, SUM(v) v FROM (SELECT * FROM a3 UNION ALL SELECT * FROM b3) GROUP BY ALL HAVING SUM(v) <> 0")(lambda t: elementwise.add(t.a3(), t.b3()))
query("sub", "SELECT i0, i1, i2, SUM(v) v FROM (SELECT * FROM a3 UNION ALL SELECT i0, i1, i2, -v FROM b3) GROUP BY ALL HAVING SUM(v) <> 0")(lambda t: elementwise.sub(t.a3(), t.b3()))
query("mul", "SELECT i0, i1, i2, a.v * b.v v FROM a3 a JOIN b3 b USING (i0, i1, i2) WHERE a.v * b.v <> 0")(lambda t: elementwise.mul(t.a3(), t.b3()))
query("mul_same_pattern", "SELECT i0, i1, i2, v * v v FROM c3")(lambda t: elementwise.mul_same_pattern(t.c3(), t.c3()))
query("div", "SELECT i0, i1, i2, a.v / b.v v FROM b3 a JOIN a3 b USING (i0, i1, i2)")(lambda t: elementwise.div(t.b3(), t.a3()))
query("scale", "SELECT i0, i1, i2, v * 3 v FROM l3")(lambda t: elementwise.scale(t.l3(), 3))
query("scale_zero", "SELECT * FROM l3 WHERE false")(lambda t: elementwise.scale(t.l3(), 0))
query("divide_by", "SELECT i0, i1, i2, v / 4 v FROM l3")(lambda t: elementwise.divide_by(t.l3(), 4))
query("norm", "SELECT SUM(v * v) norm2, sqrt(SUM(v * v)) norm FROM l3")(lambda t: elementwise.norm(t.l3()))
query("largest", "SELECT MAX(v) v FROM l3")(lambda t: elementwise.largest(t.l3()))
query("density", "SELECT COUNT(*) nnz, COUNT(*) / ((MAX(i0) + 1.0::DOUBLE) * (MAX(i1) + 1) * (MAX(i2) + 1)) density, COUNT(*) * 24 index_bytes FROM l3")(
    lambda t: elementwise.status(t.l3()).select("nnz", "density", "index_bytes")
)
query("status", "SELECT m AS mode, [d0, d1, d2][m + 1] dim, nnz / [d0, d1, d2][m + 1] slice_length FROM (SELECT COUNT(*) nnz, MAX(i0) + 1 d0, MAX(i1) + 1 d1, MAX(i2) + 1 d2 FROM l3), (SELECT unnest(range(0, 3)) m)")(
    lambda t: elementwise.status(t.l3()).select(F.posexplode(F.arrays_zip("dims", "slice_length"))).select(F.col("pos").cast("long").alias("mode"), F.col("col.dims").alias("dim"), "col.slice_length")
)
query("bounds", "SELECT 0::BIGINT mode, MIN(i0) low, MAX(i0) + 1 high FROM l3 UNION ALL SELECT 1, MIN(i1), MAX(i1) + 1 FROM l3 UNION ALL SELECT 2, MIN(i2), MAX(i2) + 1 FROM l3")(lambda t: elementwise.bounds(t.l3()))
query("slice_sizes", "SELECT r.i, COUNT(l.i0) n FROM (SELECT unnest(range(0, (SELECT MAX(i0) + 1 FROM l3))) i) r LEFT JOIN l3 l ON l.i0 = r.i GROUP BY r.i")(lambda t: elementwise.slice_sizes(t.l3(), 0))
query("subtensor", "SELECT * FROM l3 WHERE i0 >= 10 AND i0 < 500 AND i1 >= 5 AND i1 < 60 AND i2 >= 2 AND i2 < 5")(lambda t: elementwise.subtensor(t.l3(), [10, 5, 2], [500, 60, 5]))

# Products
query("ttv", "SELECT i0, i1, 0::BIGINT i2, SUM(v * (i2 + 1)) v FROM l3 GROUP BY i0, i1")(lambda t: products.ttv(x := t.l3(), 2, t.spark.range(x.dims[2]).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("w"))))
TTM = "SELECT i0, i1, r, SUM(v * (i2 + r + 1)) v FROM l3, (SELECT unnest(range(0, 4)) r) GROUP BY i0, i1, r"
query("ttm", TTM)(lambda t: products.ttm(x := t.l3(), 2, dense.counting(t.spark, x.dims[2], 4)).select("i0", "i1", F.posexplode("fiber").alias("r", "v")).withColumn("r", F.col("r").cast("long")))
query("semisparse_ttm", f"SELECT i0, i1, s r, SUM(m.v * (m.r + s + 1)) v FROM ({TTM}) m, (SELECT unnest(range(0, 3)) s) GROUP BY i0, i1, s")(
    lambda t: products.fiber_ttm(products.ttm(x := t.l3(), 2, dense.counting(t.spark, x.dims[2], 4)), dense.counting(t.spark, 4, 3))
    .select("i0", "i1", F.posexplode("fiber").alias("r", "v"))
    .withColumn("r", F.col("r").cast("long"))
)
for _m, _others in enumerate(((1, 2), (0, 2), (0, 1))):
    _cells = ", ".join(f"SUM(v * (i{_others[0]} + {r + 1}) * (i{_others[1]} + {r + 1})) c{r}" for r in range(8))
    query(f"mttkrp_mode{_m}", f'SELECT i{_m} "row", {_cells} FROM l3 GROUP BY i{_m}')(lambda t, m=_m: products.mttkrp(x := t.l3(), t.factors(x, 8), m).df)
query("kron_small", "SELECT a.i0 * 5 + b.i0 i0, a.i1 * 3 + b.i1 i1, a.v * b.v v FROM oc a, rr b")(lambda t: products.kronecker(t.oc(), t.rr()))
query("khatri_rao", "SELECT a.i0 * (SELECT MAX(i0) + 1 FROM oc) + b.i0 i0, i1, a.v * b.v v FROM (SELECT i1 i0, i0 i1, v FROM rr) a JOIN (SELECT i0, i1 % 5 i1, v FROM oc) b USING (i1)")(
    lambda t: products.khatri_rao(layout.permute(t.rr(), (1, 0)), SparseTensor((o := t.oc()).df.withColumn("i1", F.col("i1") % 5), 2, (o.dims[0], 5)))
)

# Layout
_DIM = {m: f"(SELECT MAX(i{m}) + 1 FROM l3)" for m in range(3)}
for _m, (_a, _b) in enumerate(((1, 2), (2, 0), (0, 1))):
    query(f"matricize_m{_m}", f'SELECT i{_m} "row", i{_a} * {_DIM[_b]} + i{_b} col, v FROM l3')(lambda t, m=_m: layout.matricize(t.l3(), m))
query("matricize_transposed", f'SELECT i2 * {_DIM[0]} + i0 "row", i1 col, v FROM l3')(lambda t: layout.matricize(t.l3(), 1, transpose=True))
query("permute", "SELECT i2 i0, i0 i1, i1 i2, v FROM l3")(lambda t: layout.permute(t.l3(), (2, 0, 1)))
query("permute_best_order", "SELECT i1 i0, i2 i1, i0 i2, v FROM l3")(lambda t: layout.permute(x := t.l3(), layout.best_order(x.dims, 1)))
query("permute_worst_order", "SELECT i0, i2 i1, i1 i2, v FROM l3")(lambda t: layout.permute(x := t.l3(), layout.worst_order(x.dims, 1)))


def _sorted(name: str, keys: str, f) -> None:
    query(name, f"SELECT row_number() OVER (ORDER BY {keys}) - 1 n, * FROM c3")(lambda t: layout.row_numbers(f(t.c3())))


_blocks = lambda b, modes=(0, 1, 2): ", ".join(f"i{m} >> {b}" for m in modes)
_z = lambda b, modes=(0, 1, 2): " | ".join(f"(((i{m} >> {k + b}) & 1)::BIGINT << {len(modes) * k + n})" for k in range(20) for n, m in enumerate(modes))
_sorted("sort_lexicographic", "i0, i1, i2", layout.sort)
_sorted("sort_modes", "i1, i0, i2", lambda x: layout.sort(x, [1]))
_sorted("sort_custom", "i2, i0, i1", lambda x: layout.sort(x, [2, 0, 1]))
_sorted("sort_at_mode", "i0, i2, i1", lambda x: layout.sort_at(x, 1))
_sorted("sort_z_order_blocks", f"{_z(3)}, i0, i1, i2", lambda x: layout.sort_blocks(x, 3, z_order=True))
_sorted("sort_z_order_without", f"{_z(3, (0, 2))}, i0, i2, i1", lambda x: layout.sort_blocks(x, 3, z_order=True, without=1))
_sorted("sort_row_blocks", f"{_blocks(4)}, i0, i1, i2", lambda x: layout.sort_blocks(x, 4))
_sorted("sort_row_blocks_without", f"{_blocks(4, (1, 2))}, i1, i2, i0", lambda x: layout.sort_blocks(x, 4, without=0))
_sorted("sort_mixed", f"{_blocks(6)}, {_z(3)}, i0, i1, i2", lambda x: layout.sort_mixed(x, 6, 3))
_sorted("sort_slices", f"i2, {_blocks(4, (0, 1))}, i0, i1", lambda x: layout.sort_slices(x, 2, 4))
query("shuffle_elements", "SELECT * FROM c3")(lambda t: layout.shuffle_elements(t.c3(), 5))
query("renumber", "SELECT (SELECT MAX(i0) FROM l3) - i0 i0, i1, i2, v FROM l3")(
    lambda t: layout.renumber(x := t.l3(), 0, layout.inverse_map(t.spark.range(x.dims[0]).select((x.dims[0] - 1 - F.col("id")).alias("new"), F.col("id").alias("old"))))
)
query("random_renumber_roundtrip", "SELECT * FROM l3")(lambda t: layout.renumber(layout.renumber(x := t.l3(), 1, m := layout.random_map(t.spark, x.dims[1], 7)), 1, layout.inverse_map(m)))
query("linearize", "SELECT (i0 << 29) | (i1 << 3) | i2 AS key, v FROM l3")(lambda t: layout.linearized(t.l3(WIDE)))
query("linearize_flip", "SELECT (((i1 << 3) | i2) << 34) | i0 AS key, v FROM l3")(lambda t: layout.flip_key(layout.linearized(t.l3(WIDE)), 34, 29))
query("delinearize", "SELECT * FROM l3")(lambda t: layout.delinearized(layout.linearized(t.l3(WIDE), (2, 0, 1)), WIDE, (2, 0, 1)))
_bits = lambda places: " | ".join(f"(((i{m} >> {b}) & 1) << {k})" for k, (m, b) in enumerate(places))
_alto = [(m, b) for b in range(34) for m, w in ((2, 3), (1, 26), (0, 34)) if b < w]
query("alto_key", f"SELECT {_bits(_alto)} AS key, v FROM l3")(lambda t: layout.alto_keys(t.l3(WIDE)))
query("morton_key", f"SELECT {_bits([(m, b) for b in range(21) for m in range(3)])} AS key, v FROM l3")(lambda t: (x := t.l3(CUBE)).df.select(bits.morton(x.coords, [21] * 3).alias("key"), "v"))
_alto_parts = f"(SELECT *, (row_number() OVER (ORDER BY {_bits(_alto)}) - 1) // CAST(ceil((SELECT COUNT(*) FROM l3) / 16.0) AS BIGINT) part FROM l3)"
query("alto_partitions", f"SELECT part, COUNT(*) n, MIN(i0) low0, MAX(i0) high0, MIN(i1) low1, MAX(i1) high1, MIN(i2) low2, MAX(i2) high2 FROM {_alto_parts} GROUP BY part")(lambda t: layout.alto_partitions(t.l3(WIDE), 16))
query("alto_conflicts", " UNION ALL ".join(f"SELECT {m}::BIGINT mode, i{m} i, COUNT(DISTINCT part) parts FROM {_alto_parts} GROUP BY i{m} HAVING COUNT(DISTINCT part) > 1" for m in range(3)))(lambda t: layout.alto_conflicts(t.l3(WIDE), 16))
query("hicoo_blocks", "SELECT i0 >> 5 b0, i1 >> 5 b1, i2 >> 5 b2, COUNT(*) n FROM l3 GROUP BY ALL")(lambda t: layout.hicoo_blocks(layout.to_hicoo(t.l3(), 5), 3))
query("hicoo_kernel_pointers", "SELECT k0, k1, k2, n, CAST(SUM(n) OVER (ORDER BY k0, k1, k2) - n AS BIGINT) AS \"start\" FROM (SELECT i0 >> 7 k0, i1 >> 7 k1, i2 >> 7 k2, COUNT(*) n FROM l3 GROUP BY ALL)")(
    lambda t: layout.hicoo_pointers(layout.to_hicoo(t.l3(), 5, 7), 3, "k")
)
query("hicoo_kernels", "SELECT i0 >> 7 k0, i1 >> 7 k1, i2 >> 7 k2, COUNT(*) n FROM l3 GROUP BY ALL")(lambda t: layout.hicoo_blocks(layout.to_hicoo(t.l3(), 5, 7), 3, "k"))
query("hicoo_roundtrip", "SELECT * FROM l3")(lambda t: layout.from_hicoo(layout.to_hicoo(t.l3(), 5), 3, 5))
query("mttkrp_hicoo", SQL["mttkrp_mode0"].removeprefix(TENSORS))(lambda t: products.mttkrp(layout.from_hicoo(layout.to_hicoo(x := t.l3(), 4), 3, 4), t.factors(x, 8), 0).df)
query(
    "blco_blocks",
    f"SELECT block, CAST(floor((row_number() OVER (PARTITION BY block ORDER BY low, v) - 1) / 64.0) AS BIGINT) part, low AS key, v FROM (SELECT key >> 20 block, key & 1048575 low, v FROM (SELECT {_bits(_alto)} AS key, v FROM l3))",
)(lambda t: layout.blco_blocks(t.l3(WIDE), 20, 64))
query("semisparse", "SELECT i0, i1, r, COALESCE(c.v, 0) v FROM (SELECT DISTINCT i0, i1 FROM l3) f CROSS JOIN (SELECT unnest(range(0, (SELECT MAX(i2) + 1 FROM l3))) r) k LEFT JOIN c3 c ON c.i0 = f.i0 AND c.i1 = f.i1 AND c.i2 = k.r".replace("SELECT i0, i1, r", "SELECT f.i0, f.i1, k.r"))(
    lambda t: layout.to_semisparse(t.l3(), 2).select("i0", "i1", F.posexplode("fiber").alias("r", "v")).withColumn("r", F.col("r").cast("long"))
)
query("semisparse_roundtrip", "SELECT * FROM c3")(lambda t: layout.from_semisparse(layout.to_semisparse(t.l3(), 2), 2))
query("semisparse_csr", f'SELECT i0 * {_DIM[1]} + i1 "row", i2 col, v FROM c3')(lambda t: layout.semisparse_rows(layout.to_semisparse(x := t.l3(), 2), x, 2))
query("semisparse_norm", "SELECT sqrt(SUM(v * v)) norm FROM c3")(lambda t: layout.semisparse_norm(layout.to_semisparse(t.l3(), 2)))
query("dense_rows", 'SELECT f.i0 "row", r, COALESCE(v, 0) v FROM (SELECT DISTINCT i0 FROM sn) f CROSS JOIN (SELECT unnest(range(0, (SELECT MAX(i1) + 1 FROM sn))) r) k LEFT JOIN sn ON sn.i0 = f.i0 AND sn.i1 = r')(
    lambda t: layout.to_dense(t.sn()).select("row", F.posexplode("cells").alias("r", "v")).withColumn("r", F.col("r").cast("long"))
)
_before = "(SELECT i0 i, n, CAST(SUM(n) OVER (ORDER BY i0) - n AS BIGINT) before FROM (SELECT i0, COUNT(*) n FROM l3 GROUP BY i0))"
query("fiber_set", 'SELECT i0, i2, n, CAST(SUM(n) OVER (ORDER BY i0, i2) - n AS BIGINT) AS "start" FROM (SELECT i0, i2, COUNT(*) n FROM l3 GROUP BY ALL)')(lambda t: layout.fiber_set(t.l3(), 1))
query("fiber_offsets", f'SELECT i, before "start" FROM {_before}')(lambda t: layout.fiber_offsets(t.l3(), 0))
_RECURSIVE = TENSORS.replace("WITH", "WITH RECURSIVE", 1)
# Greedy runs: each cut leads to the next.
query("dist_rows")(lambda t: layout.dist_rows(t.l3(), 8))
SQL["dist_rows"] = _RECURSIVE + f""", p AS {_before}, cuts AS (
    SELECT 0::BIGINT c UNION ALL SELECT MIN(before) FROM cuts JOIN p ON before >= c + (SELECT COUNT(*) FROM l3) // 8 GROUP BY c)
SELECT i, LEAST((SELECT COUNT(*) FROM cuts WHERE c <= before) - 1, 7) part FROM p"""
_split0 = f""", p AS {_before}, cuts AS (
    SELECT 0::BIGINT c UNION ALL
    SELECT COALESCE(MAX(before) FILTER (before <= c + 1000), MIN(before)) FROM cuts JOIN p ON before > c WHERE c + 1000 < (SELECT COUNT(*) FROM l3) GROUP BY c),
s0 AS (SELECT i, n, (SELECT COUNT(*) FROM cuts WHERE c <= before) - 1 part FROM p)"""
query("split_by_nnz")(lambda t: layout.split_by_nnz(t.l3(), 1000))
SQL["split_by_nnz"] = _RECURSIVE + _split0 + " SELECT part, CAST(SUM(n) AS BIGINT) n, MIN(i) low0, MAX(i) + 1 high0 FROM s0 GROUP BY part"
_split1 = """, b0 AS (SELECT part, MIN(i) low0, MAX(i) + 1 high0 FROM s0 GROUP BY part),
p1 AS (SELECT part, i1 i, n, CAST(SUM(n) OVER (PARTITION BY part ORDER BY i1) - n AS BIGINT) before, CAST(SUM(n) OVER (PARTITION BY part) AS BIGINT) total
    FROM (SELECT part, i1, COUNT(*) n FROM l3 JOIN s0 ON i0 = i GROUP BY ALL)),
cuts1 AS (SELECT part g, 0::BIGINT c FROM b0 UNION ALL
    SELECT g, COALESCE(MAX(before) FILTER (before <= c + 300), MIN(before)) FROM cuts1 JOIN p1 ON part = g AND before > c WHERE c + 300 < total GROUP BY g, c),
s1 AS (SELECT part g, i, n, (SELECT COUNT(*) FROM cuts1 WHERE g = part AND c <= before) + (SELECT COUNT(*) FROM cuts1 WHERE g < part) - 1 part FROM p1)
SELECT s1.part, CAST(SUM(n) AS BIGINT) n, MIN(low0) low0, MIN(high0) high0, MIN(i) low1, MAX(i) + 1 high1 FROM s1 JOIN b0 ON b0.part = g GROUP BY s1.part"""
query("split_two_modes")(lambda t: layout.split(t.l3(), [1000, 300])[1])
SQL["split_two_modes"] = _RECURSIVE + _split0 + _split1
query("split_rows")(lambda t: layout.split(t.l3(), [1000])[0].df)
SQL["split_rows"] = _RECURSIVE + _split0 + " SELECT i0, i1, i2, v, part FROM l3 JOIN s0 ON i0 = i"
query("hicoo_chunks")(lambda t: layout.hicoo_chunks(layout.to_hicoo(t.l3(), 4, 9), 3, 64))
SQL["hicoo_chunks"] = _RECURSIVE + """, h AS (SELECT i0 >> 9 k0, i1 >> 9 k1, i2 >> 9 k2, i0 >> 4 b0, i1 >> 4 b1, i2 >> 4 b2, COUNT(*) n FROM l3 GROUP BY ALL),
p AS (SELECT *, CAST(SUM(n) OVER w - n AS BIGINT) before FROM h WINDOW w AS (PARTITION BY k0, k1, k2 ORDER BY b0, b1, b2)),
cuts AS (SELECT DISTINCT k0, k1, k2, 0::BIGINT c FROM h UNION ALL
    SELECT k0, k1, k2, MIN(before) FROM cuts JOIN p USING (k0, k1, k2) WHERE before >= c + 64 GROUP BY k0, k1, k2, c)
SELECT p.k0, p.k1, p.k2, b0, b1, b2, n, (SELECT COUNT(*) FROM cuts q WHERE (q.k0, q.k1, q.k2) < (p.k0, p.k1, p.k2) OR ((q.k0, q.k1, q.k2) = (p.k0, p.k1, p.k2) AND c <= before)) - 1 chunk FROM p"""
query("semisparse_dense_mode", """SELECT f.i0, f.i1, k.r, COALESCE(c.v, 0) v FROM (SELECT DISTINCT i0, i1 FROM m3 WHERE v <> 0) f CROSS JOIN (SELECT unnest(range(0, (SELECT MAX(i2) + 1 FROM m3))) r) k LEFT JOIN m3 c ON c.i0 = f.i0 AND c.i1 = f.i1 AND c.i2 = k.r""")(
    lambda t: layout.set_dense_mode(layout.to_semisparse(t.lineitem("l_partkey", "l_linenumber", F.month("l_shipdate")), 1), 1, 2).select("i0", "i1", F.posexplode("fiber").alias("r", "v")).withColumn("r", F.col("r").cast("long"))
)
SQL["semisparse_dense_mode"] = TENSORS + ", m3 AS (SELECT CAST(l_partkey AS BIGINT) i0, CAST(l_linenumber AS BIGINT) i1, CAST(month(l_shipdate) AS BIGINT) i2, SUM(l_quantity) v FROM lineitem GROUP BY ALL)" + SQL["semisparse_dense_mode"].removeprefix(TENSORS)
query("semisparse_append", "SELECT i0, i1, i2, SUM(v) v FROM (SELECT * FROM a3 UNION ALL SELECT * FROM b3) GROUP BY ALL HAVING SUM(v) <> 0")(
    lambda t: layout.from_semisparse(layout.append_entries(layout.to_semisparse(t.a3(), 2), t.b3(), 2, t.c3().dims), 2, 0.0)
)
query("semisparse_compare", "SELECT i0, i1, a.f IS NOT NULL in_a, b.f IS NOT NULL in_b, COALESCE(a.f = b.f, false) equal FROM (SELECT i0, i1, list((i2, v) ORDER BY i2) f FROM c3 GROUP BY ALL) a FULL JOIN (SELECT i0, i1, list((i2, v) ORDER BY i2) f FROM c3 WHERE i2 <= 4 GROUP BY ALL) b USING (i0, i1)")(
    lambda t: layout.compare_fibers(layout.to_semisparse(x := t.c3(), 2), layout.to_semisparse(replace(x.where("i2 <= 4"), known_dims=x.dims), 2))
)
query("semisparse_sort", "SELECT row_number() OVER (ORDER BY i0, i1) - 1 n, i0, i1 FROM (SELECT DISTINCT i0, i1 FROM l3)")(lambda t: numbered(layout.sort_fibers(layout.to_semisparse(t.l3(), 2)).select("i0", "i1"), "n"))

# Dense algebra and decomposition
_parts = "(SELECT i0, SUM(CASE WHEN i2 = 1 THEN v ELSE 0 END) c0, SUM(CASE WHEN i2 = 2 THEN v ELSE 0 END) c1, SUM(CASE WHEN i2 = 3 THEN v ELSE 0 END) c2 FROM l3 GROUP BY i0)"


def _matrix(t: Tensors) -> dense.Matrix:
    df = t.l3().df.groupBy(F.col("i0").alias("row")).agg(*(F.sum(F.when(F.col("i2") == r + 1, F.col("v")).otherwise(0.0)).alias(f"c{r}") for r in range(3)))
    return dense.Matrix(df, 0, 3)


def _columns(t: Tensors, mode: int) -> dense.Matrix:
    """The sums of lines 1 and 2 by an index of a mode."""
    x = t.l3()
    df = x.df.groupBy(F.col(f"i{mode}").alias("row")).agg(*(F.sum(F.when(F.col("i2") == r + 1, F.col("v")).otherwise(0.0)).alias(f"c{r}") for r in range(2)))
    return dense.Matrix(df, x.dims[mode], 2)


query("gram", " UNION ALL ".join(f"SELECT {r}::BIGINT r, {s}::BIGINT s, SUM(c{r} * c{s}) v FROM {_parts}" for r in range(3) for s in range(r, 3)))(lambda t: dense.gram(_matrix(t)))
query("column_norm_2", " UNION ALL ".join(f"SELECT {r}::BIGINT r, sqrt(SUM(c{r} * c{r})) v FROM {_parts}" for r in range(3)))(lambda t: dense.column_norms(_matrix(t)))
query("column_norm_max", " UNION ALL ".join(f"SELECT {r}::BIGINT r, greatest(MAX(c{r}), 1.0) v FROM {_parts}" for r in range(3)))(lambda t: dense.column_norms(_matrix(t), "max"))
query("matrix_hadamard", f'SELECT i0 "row", c0 * c0 c0, c1 * c1 c1, c2 * c2 c2 FROM {_parts}')(lambda t: dense.hadamard(m := _matrix(t), m).df)


_RANGE = "(SELECT unnest(range(0, (SELECT MAX({0}) + 1 FROM {1})))::BIGINT i)"
query("matrix_append", f"""SELECT i0 "row", c0, c1 FROM {_parts} UNION ALL
SELECT i1 + (SELECT MAX(i0) + 1 FROM l3), SUM(CASE WHEN i2 = 1 THEN v ELSE 0 END), SUM(CASE WHEN i2 = 2 THEN v ELSE 0 END) FROM l3 GROUP BY i1""")(lambda t: dense.append(_columns(t, 0), _columns(t, 1)).df)
query("hadamard_others", f'SELECT i0 "row", c0 * c0 c0, c1 * c1 c1, c2 * c2 c2 FROM {_parts}')(lambda t: dense.hadamard_others(1, [m := _matrix(t), dense.Matrix(m.df.limit(0), m.rows, m.rank), m]).df)
_gram = lambda shift: " UNION ALL ".join(f"SELECT {r}::BIGINT r, {s}::BIGINT s, SUM((c{r} + {shift}) * (c{s} + {shift})) v FROM {_parts}" for r in range(3) for s in range(r, 3))
query("gram_product", f"SELECT r, s, a.v * b.v v FROM ({_gram(0)}) a JOIN ({_gram(1)}) b USING (r, s)")(
    lambda t: dense.gram_product(1, [dense.gram(m := _matrix(t)), dense.gram(m.map(lambda r, c: c * 7)), dense.gram(m.map(lambda r, c: c + 1))])
)
query("normal_solve", f"""SELECT i0 "row", (c0 * g11 - c1 * g01) / (g00 * g11 - g01 * g01) c0, (c1 * g00 - c0 * g01) / (g00 * g11 - g01 * g01) c1
FROM {_parts}, (SELECT SUM(c0 * c0) g00, SUM(c0 * c1) g01, SUM(c1 * c1) g11 FROM {_parts})""")(
    lambda t: dense.times(m := dense.Matrix((w := _matrix(t)).df.select("row", "c0", "c1"), w.rows, 2), dense.solve_gram(dense.gram_array(m))).df
)
query("inverse_rows", f'SELECT (SELECT MAX(i0) FROM l3) - i0 "row", c0, c1, c2 FROM {_parts}')(
    lambda t: layout.inverse_factors([_matrix(t)], [t.spark.range(n := t.l3().dims[0]).select(F.col("id").alias("old"), (n - 1 - F.col("id")).alias("new"))])[0].df
)



def _terms(t: Tensors) -> SparseTensor:
    """Supplier, line and month of shipping: a small tensor to decompose."""
    return t.lineitem("l_suppkey", "l_linenumber", F.month("l_shipdate")).coalesce()


_X = ", x AS (SELECT CAST(l_suppkey AS BIGINT) i0, CAST(l_linenumber AS BIGINT) i1, CAST(month(l_shipdate) AS BIGINT) i2, SUM(l_quantity) v FROM lineitem GROUP BY ALL)"
_model = lambda cells: " + ".join(f"(i0 + {r + 1}.0) * (i1 + {r + 1}) * (i2 + {r + 1}) * {w}" for r, w in enumerate(cells))


def _weighted(t: Tensors, x: SparseTensor) -> cpd.Kruskal:
    return cpd.Kruskal(np.array([2.0, 0.5]), t.factors(x, 2))


@query("kruskal_values")
def _kruskal_values(t: Tensors) -> DataFrame:
    x = _terms(t)
    return cpd.kruskal_values(x, cpd.redistribute(cpd.normalize_1(_weighted(t, x)), 1))


SQL["kruskal_values"] = TENSORS + _X + f" SELECT i0, i1, i2, {_model((2.0, 0.5))} v FROM x"


@query("kruskal_fit")
def _kruskal_fit(t: Tensors) -> DataFrame:
    x = _terms(t)
    # The model is scaled to the size of x: a fit far from 0 and 1.
    k = cpd.Kruskal(np.array([0.05, 0.01]), t.factors(x, 2))
    norm2 = cpd.kruskal_norm2(k.weights, [dense.gram_array(f) for f in k.factors])
    return t.spark.createDataFrame([(round(float(cpd.kruskal_fit(x, k)), 6), round(norm2, 1))], "fit double, norm2 double")


_full = f"(SELECT {_model((0.05, 0.01))} m FROM (SELECT i i0 FROM {_RANGE.format('i0', 'x')}), (SELECT i i1 FROM {_RANGE.format('i1', 'x')}), (SELECT i i2 FROM {_RANGE.format('i2', 'x')}))"
SQL["kruskal_fit"] = TENSORS + _X + f""" SELECT round(1 - sqrt(x2 + m2 - 2 * xm) / sqrt(x2), 6) fit, round(m2, 1) norm2
FROM (SELECT SUM(v * v) x2, SUM(v * ({_model((0.05, 0.01))})) xm FROM x), (SELECT SUM(m * m) m2 FROM {_full})"""


@query("cp_als_sweep")
def _cp_als_sweep(t: Tensors) -> DataFrame:
    """One sweep from the counting matrices: the values of the model at the entries."""
    x = _terms(t)
    k = cpd.cp_als(x, 2, sweeps=1, start=t.factors(x, 2))
    return cpd.kruskal_values(x, k).withColumn("v", F.round("v", 3))


def _als_sql(sweeps: int, order=(0, 1, 2), two_norm: bool = True) -> str:
    """Sweeps of modes in turn: MTTKRP, the 2 x 2 normal equations, columns divided by their norms; at the end by their 2-norms."""
    sql = TENSORS + _X + "".join(f", f{m} AS (SELECT i, i + 1.0::DOUBLE c0, i + 2.0::DOUBLE c1 FROM {_RANGE.format(f'i{m}', 'x')})" for m in range(3))
    now = ["f0", "f1", "f2"]
    for sweep in range(sweeps):
        for m in order:
            a, b = (k for k in range(3) if k != m)
            k = f"{sweep}{m}"
            grams = ", ".join(f"(SELECT SUM(c0 * c0) p00, SUM(c0 * c1) p01, SUM(c1 * c1) p11 FROM {now[k]}) g{k}" for k in (a, b))
            cells = ", ".join(f"SUM(v * {now[a]}.c{r} * {now[b]}.c{r}) m{r}" for r in range(2))
            norm = "sqrt(SUM(c{0} * c{0}))" if two_norm or sweep == 0 else "greatest(MAX(c{0}), 1.0)"
            sql += f", m{k} AS MATERIALIZED (SELECT x.i{m} i, {cells} FROM x JOIN {now[a]} ON {now[a]}.i = x.i{a} JOIN {now[b]} ON {now[b]}.i = x.i{b} GROUP BY x.i{m})"
            sql += f", v{k} AS MATERIALIZED (SELECT g{a}.p00 * g{b}.p00 v00, g{a}.p01 * g{b}.p01 v01, g{a}.p11 * g{b}.p11 v11 FROM {grams})"
            sql += f", s{k} AS MATERIALIZED (SELECT i, (m0 * v11 - m1 * v01) / (v00 * v11 - v01 * v01) c0, (m1 * v00 - m0 * v01) / (v00 * v11 - v01 * v01) c1 FROM m{k}, v{k})"
            # Rows of indices without an entry are zeros, which the largest value sees.
            sql += f", w{k} AS MATERIALIZED (SELECT {norm.format(0)} w0, {norm.format(1)} w1 FROM s{k}), n{k} AS MATERIALIZED (SELECT i, c0 / w0 c0, c1 / w1 c1 FROM s{k}, w{k})"
            now[m], last = f"n{k}", f"w{k}"
    value = " + ".join(f"w{r} * " + " * ".join(f"{now[m]}.c{r}" for m in range(3)) for r in range(2))
    return sql + f" SELECT x.i0, x.i1, x.i2, round({value}, 3) v FROM x " + " ".join(f"JOIN {now[m]} ON {now[m]}.i = i{m}" for m in range(3)) + f", {last}"


SQL["cp_als_sweep"] = _als_sql(1)


def _als(t: Tensors, sweeps: int, **flags) -> DataFrame:
    """Sweeps from the counting matrices: the values of the model at the entries. Final weights and columns give the same values."""
    x = _terms(t)
    k = cpd.cp_als(x, 2, sweeps=sweeps, tolerance=0.0, start=t.factors(x, 2), **flags)
    return cpd.kruskal_values(x, k).withColumn("v", F.round("v", 3))


query("cp_als")(lambda t: _als(t, 2))
SQL["cp_als"] = _als_sql(2, two_norm=False)
query("cp_als_two_norm")(lambda t: _als(t, 2, two_norm=True))
SQL["cp_als_two_norm"] = _als_sql(2)
query("cp_als_by_length")(lambda t: _als(t, 2, two_norm=True, by_length=True))
SQL["cp_als_by_length"] = _als_sql(2, order=(0, 2, 1))  # suppliers, months, lines


# Files
@query("io_tns_roundtrip", "SELECT * FROM l3")
def _tns(t: Tensors) -> SparseTensor:
    files.write_tns(t.l3(), path := t.folder())
    return files.read_tns(t.spark, path, 3)


@query("io_tns_default_roundtrip", "SELECT * FROM os")
def _loadstore(t: Tensors) -> SparseTensor:
    files.write_tns(t.os(), path := t.folder(), base=0, separator="\t")
    return files.read_tensor(t.spark, path, base=0)


@query("io_dump_lines", r"SELECT concat_ws(chr(9), i0 + 1, i1 + 1, i2 + 1, CAST(v AS VARCHAR)) line FROM l3 UNION ALL SELECT '3' UNION ALL SELECT concat_ws(' ', MAX(i0) + 1, MAX(i1) + 1, MAX(i2) + 1) FROM l3")
def _dump(t: Tensors) -> DataFrame:
    files.write_dump(t.l3(), path := t.folder())
    return t.spark.read.text([f"{path}/head", f"{path}/body"]).withColumnRenamed("value", "line")


@query("io_tns_lines", "SELECT concat_ws(' ', i0 + 1, i1 + 1, CAST(v AS VARCHAR)) line FROM os")
def _tns_lines(t: Tensors) -> DataFrame:
    files.write_tns(t.os(), path := t.folder())
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query("io_quantum", "SELECT i0, i1, v FROM os")
def _quantum(t: Tensors) -> SparseTensor:
    files.write_quantum(t.os(), path := t.folder())
    return files.read_tensor(t.spark, path, quantum=True)


@query("io_index_map", "SELECT (SELECT MAX(i0) FROM l3) - i0 i0, (SELECT MAX(i1) FROM l3) - i1 i1, i2, v FROM l3")
def _index_map(t: Tensors) -> SparseTensor:
    x = t.l3()
    back = lambda m: t.spark.range(x.dims[m]).select(F.col("id").alias("old"), (x.dims[m] - 1 - F.col("id")).alias("new"))
    files.write_index_map([back(0), back(1)], path := t.folder())
    for m, each in enumerate(files.read_index_map(t.spark, path, list(x.dims[:2]))):
        x = layout.renumber(x, m, each)
    return x


@query("io_hicoo", "SELECT i0 >> 5 b0, i1 >> 5 b1, i2 >> 5 b2, i0 & 31 e0, i1 & 31 e1, i2 & 31 e2, v FROM l3")
def _hicoo_files(t: Tensors) -> DataFrame:
    files.write_hicoo(layout.to_hicoo(x := t.l3(), 5), 3, list(x.dims), path := t.folder())
    return files.read_hicoo(t.spark, path, 3)


def _register() -> None:
    """Import the modules that register further queries here."""
    from tensorloom import workload_plans  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _register()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(SQL)
