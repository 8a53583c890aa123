"""Readers and writers of coordinate formats."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions.running import numbered
from tensorloom.functions.storage import stored
from tensorloom.sources.binary import read_bin, write_bin, write_kruskal, write_matrix, write_vector  # noqa: F401
from tensorloom.tensor import SparseTensor


def _data_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\t", " ")).alias("line")).where("line <> '' AND NOT startswith(line, '#')")


def read_tns(spark: SparkSession, path: str, order: int | None = None, base: int = 1) -> SparseTensor:
    """Lines of ``order`` coordinates from ``base`` and a value, split by blanks or tabs.

    Blank lines and lines from # on are skipped. A line with another number of fields, or an index
    below base, fails the job. Without ``order`` one line is read to count the fields.
    """
    lines = _data_lines(spark, path)
    if order is None:
        first = lines.first()
        if first is None:
            raise ValueError(f"{path} holds no entry; give its order")
        order = len(first["line"].split()) - 1
    fields = F.split("line", " +")
    wrong = F.raise_error(F.concat(F.lit("malformed entry: "), F.col("line")))
    good = F.when(F.size(fields) == order + 1, fields).otherwise(wrong)
    index = lambda m: F.when(F.col("f")[m].cast("double").cast("long") >= base, F.col("f")[m].cast("double").cast("long") - base).otherwise(wrong)
    rows = lines.select("line", good.alias("f"))
    return SparseTensor(rows.select(*(index(m).alias(f"i{m}") for m in range(order)), F.col("f")[order].cast("double").alias("v")), order)


def write_tns(x: SparseTensor, path: str, base: int = 1, separator: str = " ") -> None:
    line = F.concat_ws(separator, *(F.col(c) + base for c in x.coords), "v")
    x.df.select(line.alias("value")).write.text(path)


def write_dump(x: SparseTensor, path: str, base: int = 1) -> None:
    """As .tns with tabs, after a line with the order and one with the dimensions."""
    head = x.df.sparkSession.createDataFrame([(f"{x.order}\n" + " ".join(map(str, x.dims)),)], "value string")
    body = x.df.select(F.concat_ws("\t", *(F.col(c) + base for c in x.coords), "v").alias("value"))
    head.coalesce(1).write.text(f"{path}/head")
    body.write.text(f"{path}/body")


def write_hicoo(hicoo: DataFrame, order: int, dims: list[int], path: str) -> None:
    """A head with the order and dimensions, and a line for each entry: block, place in it and value, block by block."""
    blocks, places = [f"b{m}" for m in range(order)], [f"e{m}" for m in range(order)]
    head = hicoo.sparkSession.createDataFrame([(f"{order}\n" + " ".join(map(str, dims)),)], "value string")
    head.coalesce(1).write.text(f"{path}/head")
    hicoo.orderBy(*blocks, *places).select(F.concat_ws("\t", *blocks, *places, "v").alias("value")).write.text(f"{path}/entries")


def read_hicoo(spark: SparkSession, path: str, order: int) -> DataFrame:
    """The entries that write_hicoo wrote: b0 .., e0 .., v."""
    fields = F.split("value", "\t")
    names = [f"{n}{m}" for n in "be" for m in range(order)]
    return spark.read.text(f"{path}/entries").select(*(fields[k].cast("long").alias(n) for k, n in enumerate(names)), fields[2 * order].cast("double").alias("v"))


#: Most lines that a file of coordinates may have: one for each mode, and notes.
MOST_LINES = 10_000


def _numbered_text(spark: SparkSession, path: str, items, line_end: str = "\n") -> DataFrame:
    """(x, n): the items of each line (an array column over ``value``), numbered from 0 in order of files and places.

    Spark splits files at ``line_end``. What one split holds is numbered by itself, and then by
    how many items the splits before it have.
    """
    lines = spark.read.text(path, lineSep=line_end).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    rows = stored(lines.select("_file", "_start", F.explode(items).alias("x")).withColumn("_at", F.monotonically_increasing_id()))
    splits = rows.groupBy("_file", "_start").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    bases = splits.select("_file", "_start", "_low", (F.sum("_n").over(Window.orderBy("_file", "_start")) - F.col("_n")).alias("_base"))  # a row for each split
    return rows.join(F.broadcast(bases), ["_file", "_start"]).select("x", (F.col("_base") + F.col("_at") - F.col("_low")).alias("n"))


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """(x, n): what blanks separate, numbered in order; the end of a line is a token of its own.

    Spark splits the file at blanks, so that one long line is read by many tasks.
    """
    return _numbered_text(spark, path, F.regexp_extract_all("value", F.lit(r"\n|[^\s]+"), F.lit(0)), " ")


def read_quantum(spark: SparkSession, indices: str, values: str) -> SparseTensor:
    """One line of coordinates (from 1, perhaps written as floats) for each mode, and a file of values.

    Empty lines and lines that start with # are skipped.
    """
    tokens = stored(_tokens(spark, indices))
    ends = [r["n"] for r in tokens.where("x = '\n'").orderBy("n").limit(MOST_LINES + 1).collect()]
    if len(ends) > MOST_LINES:
        raise ValueError(f"{indices} has over {MOST_LINES} lines; it should have one for each mode")
    starts = [0, *(e + 1 for e in ends)]
    heads = {r["n"]: r["x"] for r in tokens.where(F.col("n").isin(starts)).collect()}
    lines = [(a, b) for a, b in zip(starts, [*ends, 1 << 62], strict=True) if a in heads and heads[a] != "\n" and not heads[a].startswith("#")]
    mode = F.coalesce(*(F.when((F.col("n") >= a) & (F.col("n") < b), F.struct(F.lit(m).alias("mode"), (F.col("n") - a).alias("at"))) for m, (a, b) in enumerate(lines)))
    cells = tokens.select(mode.alias("p"), "x").where("p IS NOT NULL AND x <> '\n'").select("p.*", (F.col("x").cast("double").cast("long") - 1).alias("i"))
    wide = cells.groupBy("at").agg(*(F.max(F.when(F.col("mode") == m, F.col("i"))).alias(f"i{m}") for m in range(len(lines))))
    numbers = _numbered_text(spark, values, F.regexp_extract_all("value", F.lit(r"[^\s]+"), F.lit(0)), " ")
    rows = numbers.select(F.col("n").alias("at"), F.col("x").cast("double").alias("v"))
    return SparseTensor(wide.join(rows, "at").select(*(f"i{m}" for m in range(len(lines))), "v"), len(lines))


def write_quantum(x: SparseTensor, path: str) -> None:
    """indices.txt with a line of coordinates (from 1) for each mode, and values.txt, as folders of part files in order."""
    rows = stored(numbered(x.df, "n"))
    cells = rows.select("n", F.posexplode(F.array(*x.coords)).alias("mode", "i")).select("mode", "n", (F.col("i") + 1).cast("string").alias("value"))
    ends = rows.sparkSession.range(x.order).select(F.col("id").cast("int").alias("mode"), F.lit(1 << 62).alias("n"), F.lit("\n").alias("value"))
    cells.unionByName(ends).orderBy("mode", "n").select("value").write.text(f"{path}/indices.txt", lineSep=" ")
    rows.orderBy("n").select(F.col("v").cast("string").alias("value")).write.text(f"{path}/values.txt", lineSep=" ")


def read_tensor(spark: SparkSession, path: str, quantum: bool = False, **options) -> SparseTensor:
    """By kind and suffix: a quantum folder (indices.txt, values.txt), .bin as binary, all else as text."""
    if quantum:
        return read_quantum(spark, f"{path}/indices.txt", f"{path}/values.txt")
    return read_bin(spark, path, **options) if PurePosixPath(path).suffix == ".bin" else read_tns(spark, path, **options)


def read_index_map(spark: SparkSession, path: str, dims: list[int]) -> list[DataFrame]:
    """Maps (old, new) of each mode from a file of one new index (from 1) a line, mode after mode."""
    lines = stored(_numbered_text(spark, path, F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0))))
    if lines.count() != sum(dims):
        raise ValueError("the file needs a line for each index of each mode")
    out, start = [], 0
    for d in dims:
        own = lines.where((F.col("n") >= start) & (F.col("n") < start + d))
        out.append(own.select((F.col("n") - start).cast("long").alias("old"), (F.col("x").cast("long") - 1).alias("new")))
        start += d
    return out


def write_index_map(maps: list[DataFrame], path: str) -> None:
    """Maps (old, new) as lines of new indices (from 1), mode after mode, in part files in order."""
    rows = None
    for m, each in enumerate(maps):
        own = each.select(F.lit(m).alias("mode"), "old", (F.col("new") + 1).cast("string").alias("value"))
        rows = own if rows is None else rows.unionByName(own)
    rows.orderBy("mode", "old").select("value").write.text(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, v) of a matrix or (row, v) of a vector file that write_matrix or write_vector wrote."""
    lines = stored(_numbered_text(spark, path, F.array("value")).withColumnRenamed("x", "value"))
    kind, _, shape = (r["value"] for r in lines.where("n < 3").orderBy("n").collect())
    rows = int(shape.split()[0])
    cells = lines.where("n >= 3").select((F.col("n") - 3).alias("n"), F.col("value").cast("double").alias("v"))
    if kind == "vector":
        return cells.select(F.col("n").alias("row"), "v")
    return cells.select((F.col("n") % rows).alias("row"), F.floor(F.col("n") / rows).alias("col"), "v")
