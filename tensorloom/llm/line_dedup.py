"""Line deduplication: exact repeats, and near ones by a segment-partition edit join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import bit_filter, boxed, stored, table

#: Characters whose counts, modulo 32, in the first COUNTED_CHARS of two lines bound their edit distance from below.
COUNTED = "eantiorshd"
COUNTED_CHARS = 384


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, doc, body, text): whole rows, and their id and a hash of their text, which tell them apart."""
    return boxed(docs, doc=F.col(id_col).cast("long"), body=F.xxhash64(F.col(text_col)), text=F.col(text_col))


def _lines(keyed: DataFrame, least_chars: int, short: bool) -> DataFrame:
    """(doc, body, pos, line, h1, h2) for lines of least_chars or more, and for all that aren't blank if short; two hashes tell lines apart."""
    split = keyed.select("doc", "body", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    taken = F.char_length("line") >= least_chars
    return split.where(taken | F.col("line").rlike(r"\S") if short else taken).select(
        "doc", "body", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


#: A segment that so many lines share is cut a second time; one in HOT_SAMPLE lines is looked at to find it.
HOT_LINES, HOT_SAMPLE = 1024, 64
#: Segments that are cut a second time at most, those with the most lines; and the characters of a second cut.
HOT_KEYS, HOT_CHARS = 1 << 16, 6


def _hot(index: DataFrame, parts: int) -> DataFrame:
    """(key, size, cuts) of segments that many lines share: where such lines differ most, by a sample.

    cuts are the starts of ``parts`` disjoint pieces of ``size`` characters, those with the most
    different contents in the sample. The choice decides what the join costs, never what it finds.
    """
    sampled = stored(index.where(F.pmod("h1", F.lit(HOT_SAMPLE)) == 0).select("key", "line", "n"))
    many = sampled.groupBy("key").agg(F.count("*").alias("m"), F.any_value("n").alias("n")).where(F.col("m") >= HOT_LINES // HOT_SAMPLE).where(F.col("n") >= parts)
    many = stored(many.orderBy(F.col("m").desc(), "key").limit(HOT_KEYS).select("key", F.least(F.lit(HOT_CHARS), F.expr(f"n DIV {parts}")).cast("int").alias("size")))
    places = F.expr("sequence(0, n - size, CAST(greatest(1, (n - size) DIV 64) AS INT))")
    seen = sampled.join(F.broadcast(many), "key").select("key", "n", "size", "line", F.explode(places).alias("at"))
    kinds = seen.groupBy("key", "n", "size", "at").agg(F.approx_count_distinct(F.expr("substring(line, at + 1, size)")).alias("kinds"))
    ranked = kinds.groupBy("key", "n", "size").agg(F.array_sort(F.collect_list(F.struct((-F.col("kinds")).alias("rank"), "at"))).alias("all"))
    apart = f"aggregate(all.at, CAST(array() AS array<int>), (got, x) -> CASE WHEN size(got) < {parts} AND forall(got, g -> abs(g - x) >= size) THEN concat(got, array(x)) ELSE got END)"
    chosen = ranked.selectExpr("key", "n", "size", f"{apart} AS cuts")
    even = f"transform(sequence(0, {parts - 1}), j -> CAST(j * (n DIV {parts}) AS INT))"  # where the best ones leave no room
    return stored(chosen.selectExpr("key", "size", f"CASE WHEN size(cuts) = {parts} THEN cuts ELSE {even} END AS cuts"))


def _candidates(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b), the first hashes of distinct lines (h1, line) that may be within ``edits`` edits of each other.

    Each line is cut into edits + 1 segments, one of which any line within the bound holds
    unchanged, at a place that the two lengths confine. Segments are indexed by length and number,
    and each line probes the index for its own length and those up to ``edits`` shorter.
    Candidates whose character counts at the head of the lines differ by more than two for each
    edit (which changes a character there, or shifts one in and one out) are left out as the index
    is probed.

    Lines of one template share segments without being near. Where many lines share one, the
    indexed line is cut a second time, into edits + 1 pieces where lines of that segment differ
    most: the same argument holds for any disjoint pieces, so a line within the bound has one of
    them too, at most ``edits`` places away. Only lines that share both make a row.
    """
    parts = edits + 1
    # Each of these takes one byte, and bytes need no counting.
    count = "shiftleft(CAST((octet_length(head) - octet_length(replace(head, '{c}', ''))) & 31 AS BIGINT), {at})"
    counts = " | ".join(count.format(c=c, at=5 * k) for k, c in enumerate(COUNTED))
    # Written, so that lines are split and counted once for both sides of the join.
    sized = lines.select("h1", "line", F.char_length("line").alias("n"), F.substring("line", 1, COUNTED_CHARS).alias("head"))
    sized = stored(sized.select("h1", "line", "n", F.expr(counts).alias("counts")))
    # Segment i of an even partition; the last ones take what is over.
    whole, over = f"(length DIV {parts})", f"(length % {parts})"
    start = f"(i * {whole} + greatest(0, i - ({parts} - {over})))"
    size = f"({whole} + CASE WHEN i >= {parts} - {over} THEN 1 ELSE 0 END)"

    def keys(choices: list[tuple[int, int, int]]) -> DataFrame:
        rows = ", ".join(f"struct({shorter} AS shorter, {i} AS i, {off} AS off)" for shorter, i, off in choices)
        each = sized.select("*", F.explode(F.expr(f"array({rows})")).alias("p")).selectExpr("h1", "line", "n", "counts", "n - p.shorter AS length", "p.i AS i", "p.off AS off", "p.shorter = 0 AS same")
        each = each.selectExpr("*", f"{start} + off AS start", f"{size} AS size").where("start >= 0 AND start + size <= n AND length > 0")
        return each.selectExpr("h1", "line", "n", "counts | CASE WHEN same THEN 0L ELSE 1L << 60 END AS counts", "xxhash64(length, i, substring(line, start + 1, size)) AS key")

    index = keys([(0, i, 0) for i in range(parts)])
    shifts = [(d, i, off) for d in range(edits + 1) for i in range(parts) for off in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]
    hot = _hot(index, parts)
    if hot.isEmpty():
        hot = None

    def cut_again(rows: DataFrame, places: str) -> DataFrame:
        """Rows with the key itself or, if it is hot, one for each piece of the second cut at one of the places."""
        if hot is None:
            return rows.select("h1", "counts", "key")
        at = f"flatten(transform(sequence(0, {parts - 1}), j -> transform({places}, o -> struct(j AS j, cuts[j] + o AS at))))"
        pieces = f"transform(filter({at}, p -> p.at >= 0 AND p.at + size <= n), p -> xxhash64(key, p.j, substring(line, p.at + 1, size)))"
        met = rows.join(F.broadcast(hot), "key", "left")
        return met.select("h1", "counts", F.explode(F.expr(f"CASE WHEN cuts IS NULL THEN array(key) ELSE {pieces} END")).alias("key"))

    left = cut_again(keys(shifts), f"sequence({-edits}, {edits})").selectExpr("h1 AS a", "counts AS ca", "key")
    right = cut_again(index, "array(0)").selectExpr("h1 AS b", "counts AS cb", "key AS key2")
    # Per character the distance around the circle of 32, which is no more than the true one.
    apart = " + ".join(f"16 - abs(16 - abs((shiftright(ca, {5 * k}) & 31) - (shiftright(cb, {5 * k}) & 31)))" for k in range(len(COUNTED)))
    pairs = left.join(right, (F.col("key") == F.col("key2")) & F.expr("a < b OR (ca >= 1L << 60 AND a > b)") & F.expr(f"{apart} <= {2 * edits}"))
    return pairs.select("a", "b").distinct()


def _near(lines: DataFrame, distinct: DataFrame, edits: int) -> DataFrame:
    """(h1, h2) of distinct lines that have one within ``edits`` edits which first stands earlier."""
    total = distinct.count()
    repeated = distinct.where("n > 1")
    maybe = bit_filter(repeated, "h1", total)
    # Lines that surely stand once need no shuffle; of the others one copy is taken.
    once = maybe(lines.select("h1", "h2", "line"), invert=True)
    copies = maybe(lines.select("h1", "h2", "line")).groupBy("h1", "h2").agg(F.any_value("line").alias("line"))
    pairs = stored(_candidates(once.unionByName(copies).select("h1", "line"), edits))
    named = pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct()
    wanted = bit_filter(named, "h1", total)
    texts = wanted(lines.select("h1", "h2", "line")).groupBy("h1", "h2").agg(F.any_value("line").alias("line"))
    texts = stored(texts.join(wanted(distinct.select("h1", "h2", "first")), ["h1", "h2"]))
    one = texts.select(F.col("h1").alias("a"), F.col("h2").alias("ha"), F.col("line").alias("line_a"), F.col("first").alias("first_a"))
    two = texts.select(F.col("h1").alias("b"), F.col("h2").alias("hb"), F.col("line").alias("line_b"), F.col("first").alias("first_b"))
    links = pairs.join(one, "a").join(two, "b").where(F.levenshtein("line_a", "line_b", edits) >= 0)
    later = F.col("first_a") > F.col("first_b")
    return links.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("h1"), F.when(later, F.col("ha")).otherwise(F.col("hb")).alias("h2")).distinct()


def _deduped(docs: DataFrame, edits: int, least_chars: int, id_col: str, text_col: str, short: bool) -> DataFrame:
    """(_row, lines, gone) of docs; gone has the places of lines to drop, in order, or is null."""
    keyed = _keys(docs, id_col, text_col)
    lines = _lines(keyed.select("doc", "body", "text"), least_chars, short)
    place = F.struct("doc", "body", "pos")
    distinct = stored(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    near = _near(lines.where(F.char_length("line") >= least_chars) if short else lines, distinct, edits).withColumn("near", F.lit(True))
    exact = distinct.where("n > 1").select("h1", "h2", "first")
    marked = stored(exact.join(near, ["h1", "h2"], "full"))
    narrow = bit_filter(marked, "h1", distinct.count())
    gone = narrow(lines.select("doc", "body", "pos", "h1", "h2")).join(marked, ["h1", "h2"]).where(F.col("near") | (place > F.col("first")))
    lists = gone.select("doc", "body", "pos").distinct().groupBy("doc", "body").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    on = F.col("doc").eqNullSafe(F.col("doc2")) & F.col("body").eqNullSafe(F.col("body2"))
    lists = stored(lists.select(F.col("doc").alias("doc2"), F.col("body").alias("body2"), "gone"))
    return keyed.drop("text").join(lists, on, "left").select("_row", F.split(F.col("_row")[text_col], "\n").alias("lines"), "gone")


#: The lines that stay: what lies between the places of dropped ones.
KEPT = """
CASE WHEN gone IS NULL THEN lines ELSE flatten(zip_with(
    concat(array(-1), gone), concat(gone, array(size(lines))), (a, b) -> slice(lines, a + 2, b - a - 1))) END"""


def line_dedup(docs: DataFrame, edits: int = 2, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """Drop lines that stand earlier already, exactly or within ``edits`` edits.

    Lines are what newlines separate. A line shorter than ``least_chars`` always stays, or, with
    ``short``, stays unless it is an exact repeat; a short blank one stays in any case. Of equal
    lines only the first stays (in order of id, hash of the text and place; a missing id comes
    first), and it goes too if a line within the bound first stands still earlier. Distinct lines
    are compared once, however often they occur. Rows equal in id and text are one place, so both
    keep their first lines. A null text stays null, a text whose lines all go becomes empty; no
    row goes. Very long lines are compared whole. An empty table gives an empty result. All
    columns are kept, whatever their names.

    Verification uses Spark's banded edit distance; its bit-parallel form has no native function.
    """
    out = _deduped(docs, edits, least_chars, id_col, text_col, short)
    text = F.when(F.col("gone").isNull(), F.col("_row")[text_col]).otherwise(F.array_join(F.expr(KEPT), "\n"))
    return out.select(F.col("_row").withField(f"`{text_col}`", text).alias("_row")).select("_row.*")


def line_report(docs: DataFrame, edits: int = 2, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the text that line_dedup leaves; null counts as empty)."""
    out = _deduped(docs.select(id_col, text_col), edits, least_chars, id_col, text_col, short)
    return out.select(
        F.col("_row")[id_col].alias("doc_id"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(F.array_join(F.expr(KEPT), "\n"), F.lit("")), 256).alias("kept_sha256"),
    ).withColumns({c: F.greatest(c, F.lit(0).cast("long")) for c in ("n_lines", "n_removed")})


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), short=True)
