"""Sharding: a minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import offsets_of, stored, table

LOWEST_ID = -(1 << 63)


@dataclass
class Span:
    """Groups whose first id lies in [low, high]; one group can't be cut."""

    low: int
    high: int
    size: int
    groups: int


class Prefix:
    """Prefix sums of group sizes in id order, refined where a cut needs it.

    The driver holds at most ``fan`` more spans for each refinement; the groups stay distributed.
    """

    def __init__(self, groups: DataFrame, fan: int):
        self.groups, self.fan = groups, fan
        low, high, size, n, most = groups.agg(F.min("first_id"), F.max("first_id"), F.sum("size"), F.count("*"), F.max("size")).first()
        self.spans = [Span(low, high, size, n)] if n else []
        self.total, self.most = size or 0, most or 0
        self._sum()

    def _sum(self) -> None:
        self.ends = offsets_of([s.size for s in self.spans]).tolist()

    def fill(self, capacity: int, shards: int, divisible: bool) -> tuple[bool, list[int], set[int]]:
        """Fill shards greedily: (all fits, the spans that start shards, spans a cut falls inside).

        A span of several groups counts as one that can be cut anywhere (divisible) or nowhere,
        which bounds the true answer from both sides.
        """
        at, starts, inside = 0, [], set()
        for _ in range(shards):
            starts.append(bisect_right(self.ends, at) - 1)
            end = at + capacity
            if end >= self.total:
                return True, starts, inside
            j = bisect_right(self.ends, end) - 1
            if self.spans[j].groups > 1 and self.ends[j] < end:
                inside.add(j)
                at = end if divisible else self.ends[j]
            else:
                at = self.ends[j]
        return False, starts, inside

    def refine(self, which: set[int]) -> None:
        parts = max(2, self.fan // max(1, len(which)))
        cases = []
        for k in sorted(which):
            s = self.spans[k]
            width = max(1, -(-(s.high - s.low + 1) // parts))
            cases.append((k, s, width))
        inside = " OR ".join(f"first_id BETWEEN {s.low} AND {s.high}" for _, s, _ in cases)
        span = "CASE " + " ".join(f"WHEN first_id BETWEEN {s.low} AND {s.high} THEN {k}" for k, s, _ in cases) + " END"
        part = "CASE " + " ".join(
            f"WHEN first_id BETWEEN {s.low} AND {s.high} THEN (CAST(first_id AS DECIMAL(20,0)) - CAST({s.low} AS DECIMAL(20,0))) DIV {width}" for _, s, width in cases
        ) + " END"
        found = (
            self.groups.where(inside)
            .groupBy(F.expr(span).alias("span"), F.expr(part).alias("part"))
            .agg(F.min("first_id").alias("low"), F.max("first_id").alias("high"), F.sum("size").alias("size"), F.count("*").alias("n"))
            .collect()
        )
        finer: dict[int, list[Span]] = {}
        for r in sorted(found, key=lambda r: r["low"]):
            finer.setdefault(r["span"], []).append(Span(r["low"], r["high"], r["size"], r["n"]))
        self.spans = [x for k, s in enumerate(self.spans) for x in finer.get(k, [s])]
        self._sum()


def minimax_cuts(groups: DataFrame, shards: int, fan: int = 4096) -> tuple[int, list[int]]:
    """(smallest feasible capacity, first id of each shard that is filled) for (first_id, size) rows."""
    prefix = Prefix(groups, fan)
    if not prefix.total:
        return 0, []
    low = max(prefix.most, -(-prefix.total // shards))
    high = max(low, -(-prefix.total // shards) + prefix.most)
    while low < high:
        mid = (low + high) // 2
        fits, _, inside = prefix.fill(mid, shards, divisible=False)
        if fits:
            high = mid
            continue
        could, _, also = prefix.fill(mid, shards, divisible=True)
        if not could:
            low = mid + 1
        else:
            prefix.refine(inside | also)
    while True:
        _, starts, inside = prefix.fill(low, shards, divisible=False)
        if not inside:
            return low, [prefix.spans[j].low for j in starts]
        prefix.refine(inside)


def shard(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    fan: int = 4096,
    rows_per_slot_block: int = 512,
) -> DataFrame:
    """Put documents into contiguous shards of nearly equal bytes; equal texts stay together.

    Groups of equal texts are ordered by their smallest id. A binary search finds the smallest
    capacity with which greedy filling needs no more than ``shards`` shards, and the cuts of that
    filling are taken. Group sizes stay in Spark: the driver asks for sums over id ranges only
    where a cut may fall, at most ``fan`` at a time.

    A row's size is its UTF-8 bytes plus 1; a null text counts as empty. Rows without an id order
    first. Groups with the same smallest id (repeated ids) are cut as one, so ties need no order.
    ``slot`` numbers the rows of a shard from 0 without gaps. Texts of any length are hashed whole.
    Repeated rows each have a place; further columns are not read. An empty table gives an empty
    result.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    first = F.coalesce(F.min("doc_id").cast("long"), F.lit(LOWEST_ID))
    texts = stored(rows.groupBy("digest").agg(first.alias("first_id"), F.sum("size").alias("size")))
    groups = stored(texts.groupBy("first_id").agg(F.sum("size").alias("size")).repartitionByRange("first_id").sortWithinPartitions("first_id"))
    _, starts = minimax_cuts(groups, shards, fan)

    number = sum(((F.col("first_id") >= F.lit(x)).cast("int") for x in starts[1:]), F.lit(0))
    blocks = max(1, min(1 << 16, rows.count() // (shards * rows_per_slot_block)))
    placed = stored(
        rows.join(texts.select("digest", "first_id"), "digest").select(
            "doc_id", "row", "size", "text_crc32", number.alias("shard"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
        )
    )
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    bases = counts.select("shard", "block", before.alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row"))
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(bases), ["shard", "block"])  # at most 65536 blocks a shard
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("within") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)
