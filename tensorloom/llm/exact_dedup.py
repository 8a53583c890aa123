"""Exact deduplication: a two-pass Bloom filter, so that only possibly repeated rows shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import ascii_lower, stored, table


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 128,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Mark all but one row of each group of equal texts (A-Z lower-cased; null counts as empty).

    The Bloom filter is an array of 64-bit words. In pass 1 each row sets one bit of one word, by
    a hash of its digest; words are built by partial aggregates, with the number of rows that set
    them. A word with fewer bits than rows has a bit that two rows set. In pass 2 each row looks
    its word up: a row of a word without such a bit is unique and passes straight through; only
    the others shuffle, and are grouped by digest. With ``bits_per_row`` bits of filter for each
    row, few unique rows share a word with repeated ones. The words that pass 2 needs are
    broadcast up to ``broadcast_bytes``; beyond, digests and not texts are joined to them by a
    shuffle.

    The largest id stays (null ids rank lowest); of rows equal in id as well, exactly one stays.
    Texts of any length are hashed whole. An empty table gives an empty result; further columns
    are not read.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")))
    words = 1 << max(6, (rows.count() * bits_per_row // 64).bit_length())
    h = F.xxhash64("digest")
    rows = rows.withColumn("word", F.pmod(h, F.lit(words)))
    bit = F.shiftrightunsigned(h, 58).cast("int").alias("bit")
    bloom = rows.select("word", bit).groupBy("word").agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    repeated = stored(bloom.where("bit_count(bits) < n").select("word", F.lit(True).alias("maybe")))
    if repeated.count() * 16 <= broadcast_bytes:
        repeated = F.broadcast(repeated)
    looked = rows.join(repeated, "word", "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
    single = looked.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    maybe = looked.where("maybe").select("doc_id", "row", "digest")
    # Written, so that the join below deals both sides itself and Spark can split a hot group.
    groups = stored(maybe.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")))
    grouped = maybe.join(groups, "digest").select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("top.row")).alias("kept"),
        "digest",
    )
    return single.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""
