"""Hard negatives by exact inner products: clusters of anchors share lists sorted by angular bounds."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import stored, table

#: Components are whole numbers up to this, so that an inner product of 2^13 of them is exact in a double.
LARGEST = 1 << 20
#: Anchors of one round hold so many components at most (as doubles in each Python worker: 32 MB).
ROUND = 1 << 22
#: Components of candidates looked at together.
BATCH = 1 << 21
#: Anchors in a cluster on average, and clusters at most.
MEMBERS, CLUSTERS = 64, 1024
#: Rows of a shared list that members look at in one step.
STEP = 1024
#: One in so many rows is walked first, for thresholds.
SEEDS = 64


class Best:
    """The k best (score, then smaller id) of each slot; an equal pair counts once. Below ``floor`` nothing is taken."""

    def __init__(self, slots: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = np.full((slots, k), -np.inf)
        self.id = np.zeros((slots, k), np.int64)
        self.bar = np.full(slots, -np.inf) if floor is None else floor.astype(np.float64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        old = np.nonzero(self.score[touched] > -np.inf)
        held = touched[old[0]], self.score[touched][old], self.id[touched][old]
        slot, score, ids = (np.concatenate(x) for x in zip(held, (slot, score, ids), strict=True))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        slot, score, ids = slot[new], score[new], ids[new]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        self.score[touched] = -np.inf
        self.score[slot[keep], rank[keep]], self.id[slot[keep], rank[keep]] = score[keep], ids[keep]
        self.bar[touched] = np.maximum(self.bar[touched], self.score[touched, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, rank = np.nonzero(self.score > -np.inf)
        return slot, self.score[slot, rank].astype(np.int64), self.id[slot, rank]


class Anchors:
    """Anchors of one round in clusters of close directions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        unit = vectors / np.maximum(self.norms, 1e-300)[:, None]
        n = len(ids)
        count = min(CLUSTERS, max(1, -(-n // MEMBERS)))
        centers = unit[np.random.default_rng(1).permutation(n)[:count]]
        for _ in range(6):  # spherical k-means
            near = np.concatenate([np.argmax(unit[i : i + 4096] @ centers.T, 1) for i in range(0, n, 4096)])
            sums = np.zeros_like(centers)
            np.add.at(sums, near, unit)
            length = np.sqrt((sums * sums).sum(1))
            centers = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centers)
        self.clusters = []
        for c, center in enumerate(centers):
            members = np.flatnonzero(near == c)
            if len(members):
                # A zero vector has no direction; its scores are zero, as is its bound.
                angle = np.arccos(np.clip(unit[members] @ center, -1, 1))[self.norms[members] > 0].max(initial=0.0)
                self.clusters.append((center, angle, members))

    def lists(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each cluster: members, the rows of vectors by falling bound, and the bounds.

        A member of norm u scores at most u times the bound with that row or any later one: its
        angle to the row is no less than the row's angle to the center less the widest of the cluster.
        """
        width = self.vectors.shape[1]
        norms = np.sqrt((vectors * vectors).sum(1))
        for center, angle, members in self.clusters:
            cos = np.clip(vectors[:, :width] @ center / np.maximum(norms, 1e-300), -1, 1)
            bound = norms * (np.cos(np.maximum(0.0, np.arccos(cos) - angle)) + 1e-9)
            order = np.argsort(-bound, kind="stable")
            yield members, order, bound[order]

    def walk(self, best: Best, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, bar, hits) -> None:
        """Every member walks its cluster's list until the bound is below its bar: nothing behind can count.

        ``bar(members)`` is what a score must reach now; ``hits(members, scores, rows)`` gives
        (slot, score, row) of those that count.
        """
        width = self.vectors.shape[1]
        vectors_here = vectors[:, :width]
        for members, order, bounds in self.lists(vectors):
            left = members
            for at in range(0, len(order), STEP):
                left = left[bar(left) <= self.norms[left] * bounds[at]]
                if not len(left):
                    break  # certified
                rows = order[at : at + STEP]
                slot, score, row = hits(left, self.vectors[left] @ vectors_here[rows].T, rows)
                best.add(slot, score, ids[row])


def _matrices(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of bounded size; shorter vectors end in zeros."""
    for batch in batches:
        lists = batch.column(2)
        longest = max(width, max(map(len, lists), default=0), 1)
        step = max(1, BATCH // longest)
        for at in range(0, batch.num_rows, step):
            part = lists.slice(at, step)
            length = np.diff(part.offsets.to_numpy())
            out = np.zeros((len(part), longest))
            out[np.arange(longest) < length[:, None]] = part.flatten().to_numpy(zero_copy_only=False)
            yield batch.column(0).slice(at, step).to_numpy(), batch.column(1).slice(at, step).to_numpy(), out


def _positive_walk(anchors: Anchors, k: int, floor: np.ndarray | None, batches) -> Best:
    best = Best(len(anchors.ids), k, floor)
    for ids, labels, vectors in _matrices(batches, anchors.vectors.shape[1]):

        def hits(left, scores, rows, ids=ids, labels=labels):
            found = (scores >= best.bar[left][:, None]) & (labels[rows] == anchors.labels[left][:, None]) & (ids[rows] != anchors.ids[left][:, None])
            i, j = np.nonzero(found)
            return left[i], scores[i, j], rows[j]

        anchors.walk(best, ids, labels, vectors, lambda left: best.bar[left], hits)
    return best


def _negative_walk(anchors: Anchors, low: np.ndarray, high: np.ndarray, k: int, floor: np.ndarray | None, batches) -> Best:
    """low and high: (anchor, positive) windows of scores; empty ones have low above high."""
    per = low.shape[1]
    # What a slot still takes begins at its window, at the k-th best so far or at the seed.
    start = np.where(low <= high, low, np.inf).ravel()
    best = Best(low.size, k, start if floor is None else np.maximum(start, floor))
    top = np.where(low <= high, high, -np.inf).max(1, initial=-np.inf)
    for ids, labels, vectors in _matrices(batches, anchors.vectors.shape[1]):

        def bar(left):
            return best.bar.reshape(-1, per)[left].min(1, initial=np.inf)

        def hits(left, scores, rows, labels=labels, bar=bar):
            found = (scores >= bar(left)[:, None]) & (scores <= top[left][:, None]) & (labels[rows] != anchors.labels[left][:, None])
            i, j = np.nonzero(found)
            score, slot = scores[i, j], left[i][:, None] * per + np.arange(per)
            into = (score[:, None] >= best.bar[slot]) & (score[:, None] <= high.ravel()[slot])
            which, p = np.nonzero(into)
            return slot[which, p], score[which], rows[j[which]]

        anchors.walk(best, ids, labels, vectors, bar, hits)
    return best


def vectors_of(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """id, label and whole components floor(scale * x) of all rows that take part.

    Rows with a null id, label or vector, or with a null or non-finite component, don't. Components
    beyond +-2^20 count as that, so that scores stay exact.
    """
    v = df[vector_col]
    whole = F.transform(v, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-1e15)), F.lit(1e15))))).cast("int"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(df[id_col].isNotNull() & df[label_col].isNotNull() & v.isNotNull()).where(~odd)
    return rows.select(df[id_col].cast("long").alias("id"), df[label_col].cast("long").alias("label"), whole.alias("vector"))


def _ranked(df: DataFrame, k: int) -> DataFrame:
    """The k best of each slot over all tasks, with their rank from 1."""
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
    return df.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    round_size: int = ROUND,
) -> DataFrame:
    """The first ``negatives`` rows of another label for each anchor and each of its ``positives`` best rows of its own.

    vectors has id, label, vector (whole components); anchors are the rows where is_anchor. Scores
    are inner products; higher ones come first, ties by smaller id. A negative's score is from
    ``low`` to ``high`` percent of its positive's, so a positive below zero has none. A row of the
    anchor's own id is never its positive. Rows of one id and score count once for an anchor, which
    includes repeated rows; repeated anchors count once. Vectors of different lengths are
    continued by zeros. Without anchors or rows the result is empty.

    Anchors are taken in rounds of bounded size against all rows, each row once for positives and
    once for negatives. Tasks keep the best of each anchor, so what is shuffled is bounded by
    anchors and tasks; a first walk over one in 64 rows gives thresholds that keep most of it
    back. No pair of rows is ever stored.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select("id", "label", "vector"))
    seeds = stored(rows.where(F.pmod(F.xxhash64("id"), F.lit(SEEDS)) == 0))
    anchors = stored(rows.where(is_anchor).distinct().withColumn("hash", F.xxhash64("id", "label", "vector")))
    size = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    rounds = math.ceil(size[0] * max(size[1], 1) / round_size)

    def best(walk, index, source, *args):
        def run(batches):
            slot, score, ids = walk(index.value, *args, batches).rows()
            for at in range(0, len(slot), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(slot[part]), pa.array(score[part]), pa.array(ids[part])], ["slot", "score", "id"])

        return source.mapInArrow(run, "slot long, score long, id long")

    def floors(found: DataFrame, slots: int, k: int) -> np.ndarray:
        out = np.full(slots, -np.inf)
        for r in _ranked(found, k).where(F.col("rank") == k).select("slot", "score").collect():  # one number for each slot of a round
            out[r.slot] = r.score
        return out

    results = []
    for r in range(rounds):
        mine_now = anchors.where(F.pmod("hash", F.lit(rounds)) == r).select("id", "label", "vector").orderBy("id", "label", "vector").toArrow()
        if not mine_now.num_rows:
            continue
        parts = list(_matrices(mine_now.combine_chunks().to_batches(), int(size[1])))
        ids, labels, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
        index = spark.sparkContext.broadcast(Anchors(ids, labels, matrix))
        n = len(ids)
        floor = floors(best(_positive_walk, index, seeds, positives, None), n, positives)
        found = _ranked(best(_positive_walk, index, rows, positives, floor), positives).collect()  # at most 5 rows for each anchor of a round
        score, which = np.full((n, positives), np.nan), np.zeros((n, positives), np.int64)
        for p in found:
            score[p.slot, p["rank"] - 1], which[p.slot, p["rank"] - 1] = p.score, p.id
        # 100 * score within low and high percent, in whole numbers.
        least, most = np.full((n, positives), np.inf), np.full((n, positives), -np.inf)
        for at in zip(*np.nonzero(~np.isnan(score)), strict=True):
            least[at], most[at] = -((-low * int(score[at])) // 100), (high * int(score[at])) // 100
        floor = floors(best(_negative_walk, index, seeds, least, most, negatives, None), n * positives, negatives)
        ranked = _ranked(best(_negative_walk, index, rows, least, most, negatives, floor), negatives)
        slots = pa.table({"slot": np.arange(n * positives), "anchor_id": np.repeat(ids, positives), "positive_id": which.ravel(), "positive_score": np.nan_to_num(score).astype(np.int64).ravel()})
        named = ranked.join(spark.createDataFrame(slots), "slot")
        results.append(stored(named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
        index.unpersist()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], empty)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors_of(rows.withColumn("label", label)), F.col("id") % 100 == 0)


OP13_SQL = """
WITH e AS (
    SELECT vec_id::BIGINT id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT l, [floor(256 * x::DOUBLE) FOR x IN embedding] q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id a, b.id b, a.l = b.l same, list_inner_product(a.q, b.q)::BIGINT v FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT a, b, v FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY v DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.v pv, s.b nb, s.v nv, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.v DESC, s.b) r
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.v <= 100 * s.v AND 100 * s.v <= 90 * p.v)
SELECT a anchor_id, b positive_id, r::INTEGER AS rank, nb negative_id, pv positive_score, nv negative_score FROM n WHERE r <= 10
"""
