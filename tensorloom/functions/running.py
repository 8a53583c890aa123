"""Running totals, row numbers and runs of bounded weight that no single task has to make."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tensorloom.functions.storage import stored


def _with_bases(rows: DataFrame, amount, out: str, within) -> DataFrame:
    """Adds ``out``: ``within`` plus the amounts of all blocks before a row's own (column _block, one for each task)."""
    totals = rows.groupBy("_block").agg(amount.alias("_t"))
    bases = totals.select("_block", (F.sum("_t").over(Window.orderBy("_block")) - F.col("_t")).alias("_base"))  # a row for each task
    return rows.withColumn("_within", within).join(F.broadcast(bases), "_block").withColumn(out, F.col("_base") + F.col("_within")).drop("_block", "_base", "_within")


def running_total(df: DataFrame, key: str | list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of value over rows of smaller key (keys are unique).

    Rows are dealt by ranges of keys and written once; each range is summed by itself.
    """
    keys = [key] if isinstance(key, str) else key
    rows = stored(df.repartitionByRange(*keys).withColumn("_block", F.spark_partition_id()))
    within = F.sum(value).over(Window.partitionBy("_block").orderBy(*keys)) - F.col(value)
    return _with_bases(rows, F.sum(value), out, within)


def numbered(df: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the number of each row from 0, in the order that df has."""
    rows = stored(df.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_block": F.shiftrightunsigned("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    return _with_bases(rows, F.count("*"), out, F.col("_place")).drop("_place")


#: Keys of one block, which a task holds as arrays: some 30 MB of Arrow with its copies.
BLOCK_KEYS = 1 << 17


def _next_starts(before: np.ndarray, fresh: np.ndarray, weight: int, fill: bool) -> np.ndarray:
    """For a run that starts at each key of a block, the key at which the next one starts (their number: behind the block).

    before[j] is the weight of the keys before j; fresh are the keys that start a group.
    """
    m = len(before) - 1
    at = np.arange(m)
    if fill:
        found = np.searchsorted(before, before[:-1] + weight, "left")
    else:
        found = np.searchsorted(before, before[:-1] + weight, "right") - 1
    groups = np.append(fresh, m)
    return np.minimum(np.maximum(np.minimum(found, m), at + 1), groups[np.searchsorted(groups, at, "right")])


def _first_start(before: np.ndarray, entered: int, weight: int, fill: bool) -> int:
    """The first key that starts a run, if the open one has ``entered`` so far; as many as before has places if none there does."""
    if entered == 0:
        return 0
    if fill:
        return int(np.searchsorted(before, weight - entered, "left"))
    return max(0, int(np.searchsorted(before, weight - entered, "right")) - 1)


def runs(counts: DataFrame, key: str, weight: int, fill: bool) -> DataFrame:
    """Adds ``run``: consecutive keys of a group in runs, closed one by one from the first key on.

    counts has (group, key, n), a row for each key of a group and n of 1 at least. With ``fill`` a run
    closes at the first key that brings it to ``weight`` entries; else it takes keys as long as it
    has no more than ``weight``, and one key at least. Runs are numbered from 0 over all groups
    in order.

    Keys are dealt to blocks by ranges and each block is looked at by itself. All that it can get
    from the block before is the weight of the run that is open, and that matters up to the first
    run that starts here: so a block says, for each key where that may be, how many runs follow and
    what is open at its end. One task reads these few numbers block by block, and with what is
    open at its start each block numbers its keys.
    """
    weight = max(1, weight)
    names = ["group", key, "n"]
    blocks = max(1, -(-counts.count() // BLOCK_KEYS))
    dealt = counts.select(*names).repartitionByRange(blocks, "group", key).sortWithinPartitions("group", key)
    rows = stored(dealt.withColumns({"_at": F.monotonically_increasing_id(), "_block": F.spark_partition_id(), "_g": F.xxhash64("group"), "_h": F.hash("group")}))

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order, before, fresh, groups) of a block."""
        order = np.argsort(table.column("_at").to_numpy(), kind="stable")
        n, g, h = (table.column(c).to_numpy()[order] for c in ("n", "_g", "_h"))
        fresh = np.flatnonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1])) + 1
        return order, np.concatenate([[0], np.cumsum(n)]).astype(np.int64), fresh, np.stack([g, h.astype(np.int64)], 1)

    def look(table: pa.Table) -> pa.Table:
        _, before, fresh, groups = arrays(table)
        m = len(before) - 1
        step = np.append(_next_starts(before, fresh, weight, fill), m)
        # A run that is open with one entry goes furthest into the block, but not beyond its group.
        most = min(m, _first_start(before, 1, weight, fill), int(fresh[0]) if len(fresh) else m)
        starts = np.arange(most + 1)
        count, last, now = np.zeros(most + 1, np.int64), np.full(most + 1, -1), starts.copy()
        while (going := now < m).any():
            count[going] += 1
            last[going] = now[going]
            now = step[now]
        left = np.where(last >= 0, before[m] - before[last], 0)
        one = {
            "_block": [table.column("_block")[0].as_py()], "ends": [groups[[0, -1]].ravel().tolist()], "keys": [m], "fresh": [int(fresh[0]) if len(fresh) else m], "total": [int(before[m])],
            "before": [before[: most + 2].tolist()], "count": [count.tolist()], "left": [left.tolist()],
        }
        return pa.table(one, schema=pa.schema([("_block", pa.int32()), ("ends", pa.list_(pa.int64())), ("keys", pa.int64()), ("fresh", pa.int64()), ("total", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("before", "count", "left"))]))

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, entered, base = None, 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                block, ends, keys, fresh, total = (batch.column(c)[k].as_py() for c in range(5))
                before, count, left = (batch.column(c)[k].values.to_numpy() for c in range(5, 8))
                entered = entered if group == ends[:2] else 0
                first = min(_first_start(before, entered, weight, fill), fresh)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([base], pa.int64())], ["_block", "first", "base"])
                if first < keys:
                    base, entered = base + int(count[first]), int(left[first])
                else:
                    entered += total
                group = ends[2:]

    kind = "_block int, ends array<long>, keys long, fresh long, total long, before array<long>, count array<long>, left array<long>"
    looked = rows.select("n", "_at", "_block", "_g", "_h").groupBy("_block").applyInArrow(look, kind)
    entries = stored(looked.repartition(1).sortWithinPartitions("_block").mapInArrow(chain, "_block int, first long, base long"))

    def number(table: pa.Table) -> pa.Table:
        order, before, fresh, _ = arrays(table)
        m = len(before) - 1
        step, at, starts = _next_starts(before, fresh, weight, fill), table.column("first")[0].as_py(), []
        while at < m:
            starts.append(at)
            at = int(step[at])
        run = table.column("base")[0].as_py() - 1 + np.searchsorted(starts, np.arange(m), "right")
        return table.select(names).take(pa.array(order)).append_column("run", pa.array(run.astype(np.int64)))

    out = StructType([*(counts.schema[c] for c in names), StructField("run", LongType())])
    return rows.join(F.broadcast(entries), "_block").groupBy("_block").applyInArrow(number, out)
