"""Near copies by the Jaccard similarity of shingle sets: fingerprints and MinHash bands find pairs, the sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import bit_filter, offsets_of, stored, text_chunks
from tensorloom.llm.components import connected_components
from tensorloom.llm.simhash import SEED, fingerprint_of, first_of_each, grid_for, marked_rows, near_links, shingle_hashes

#: A pair of similarity s shares no band with a chance of (1 - s ** ROWS) ** BANDS: 7e-7 at 0.8.
ROWS, BANDS = 4, 27
#: Texts and shingles that a task compares at once, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; empty for no word."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray, block: int = 1 << 12) -> list[int]:
    """A signed key for each band of the MinHash of a shingle set; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), block):
        np.minimum(least, np.multiply.outer(FACTORS, hashes[k : k + block]).min(1), out=least)
    raw = least.tobytes()
    size = 8 * ROWS
    return [_long(xxhash.xxh64_intdigest(raw[k * size : (k + 1) * size], k)) for k in range(BANDS)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sketches(keyed: DataFrame, shingle: int) -> DataFrame:
    """(doc, body, fp, node, n, bands): the fingerprint, a hash of the whole shingle set, its size and band keys."""

    def run(batches):
        for batch in batches:
            seen = 0
            for ids, texts in text_chunks([batch.select([0, 2])]):
                hashes = [shingle_hashes(t, shingle) for t in texts]
                sets = [np.unique(h) for h in hashes]
                nodes = [_long(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets]
                prints = np.fromiter(map(fingerprint_of, hashes), np.uint64, len(hashes)).view(np.int64)
                columns = [ids, batch.column(1).slice(seen, len(texts)), pa.array(prints), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "body", "fp", "node", "n", "bands"])
                seen += len(texts)

    return keyed.select("doc", "body", "text").mapInArrow(run, "doc long, body long, fp long, node long, n long, bands array<long>")


def _sets(keyed: DataFrame, wanted: DataFrame, rows: int, shingle: int) -> DataFrame:
    """(node, hashes) of the wanted (node, least), computed again from the text of the least row."""
    key = F.xxhash64("doc", "body").alias("key")
    wanted = stored(wanted.select("node", F.col("least.doc").alias("doc"), F.col("least.body").alias("body")).select("*", key))
    few = bit_filter(wanted, "key", rows)(keyed.select("doc", "body", "text", key))
    other = wanted.select("node", F.col("doc").alias("doc2"), F.col("body").alias("body2"))
    on = F.col("doc").eqNullSafe(F.col("doc2")) & F.col("body").eqNullSafe(F.col("body2"))
    texts = few.join(other, on).select("node", "text")

    def run(batches):
        for ids, texts in text_chunks(batches):
            sets = [shingle_set(t, shingle).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def joined_nodes(sets: list[np.ndarray], roots: np.ndarray, percent: int, columns: int = 4096) -> np.ndarray:
    """The least position that each set reaches by similar pairs and by equal roots."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1  # what only one set has is in no common part
    owner, number = owner[often[number]], (np.cumsum(often) - 1)[number[often[number]]]
    by = np.argsort(number, kind="stable")
    owner, number = owner[by], number[by]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(often.sum()), columns):
        here = slice(*np.searchsorted(number, [low, low + columns]))
        has = np.zeros((len(sets), columns), np.float32)
        has[owner[here], number[here] - low] = 1
        common += has @ has.T
    linked = common * (100 + percent) >= percent * (sizes[:, None] + sizes)
    linked |= roots[:, None] == roots
    least = np.arange(len(sets))
    while True:
        new = np.where(linked, least, len(sets)).min(1)
        if (new == least).all():
            return least
        least = new


def _mixed_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what similar pairs of a cell join, of members (cell, node, n, root) of cells with several roots.

    A cell is dealt to blocks of some BLOCK nodes, and each pair of its blocks is compared in a
    task, all in bulk: no pair is a row, and no task gets a whole large cell.
    """
    sizes = members.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = members.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("cell", "node", "root", "own", other).select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "root")
    filled = dealt.join(sets, "node").select("cell", "low", "high", "node", "root", "hashes")

    def links(group: list) -> pa.RecordBatch:
        rows = pa.Table.from_batches(group)
        node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
        hashes = rows["hashes"].combine_chunks()
        flat, at = hashes.flatten().to_numpy(), offsets_of(pc.list_value_length(hashes).to_numpy(zero_copy_only=False))
        least = joined_nodes([flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], root, percent)
        # One node of each root that another root's node reaches.
        _, first = np.unique(root, return_index=True)
        first = first[root[least[first]] != root[first]]
        return pa.RecordBatch.from_arrays([pa.array(node[least[first]]), pa.array(node[first])], ["a", "b"])

    def run(batches):
        held, unit = [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if held and tuple(keys[low]) != unit:
                    yield links(held)
                    held = []
                unit = tuple(keys[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield links(held)

    units = filled.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    return units.mapInArrow(run, "a long, b long").distinct()


def similar_links(keyed: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between the nodes (node, n, fp, least, bands) that join what pairs of a common band join.

    A pair is linked if the Jaccard similarity of its shingle sets is at least ``percent``. Held
    against each other are, first, nodes with fingerprints of the grid join of ``near_links``;
    second, in each cell (the nodes of one key of a band), all nodes and the one that has the most
    cell mates, which in a group of copies with different changes is the one they come from. So a
    large group of near copies makes no pairs. What these links leave apart in a cell is compared
    exactly, in blocks.
    """
    total = nodes.count()
    cells = nodes.select("node", "n", F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(cells.join(shared, "cell"))
    fame = members.groupBy("node").agg(F.sum("size").alias("fame"))
    heads = members.join(fame, "node").groupBy("cell").agg(F.max_by(F.struct("node", "n"), F.struct("fame", "node")).alias("head"))
    sizes_near = F.expr(f"least(n, head.n) * 100 >= greatest(n, head.n) * {percent}")
    stars = members.join(heads, "cell").where("node != head.node").where(sizes_near).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()

    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    grid = near_links(firsts.select("fp"), 3, *grid_for(firsts.count()))
    grid = grid.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    alike = nodes.join(firsts, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = stored(stars.unionByName(grid).unionByName(alike).distinct())

    involved = members.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(_sets(keyed, involved.join(nodes.select("node", "least"), "node"), total, shingle))
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    links = stored(pairs.join(two, "b").join(one, "a").where(both * (100 + percent) >= percent * (F.size("x") + F.size("y"))).select("a", "b"))

    roots = stored(connected_components(links).withColumnRenamed("node", "of"))
    rooted = members.join(roots, members["node"] == roots["of"], "left").select("cell", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted)
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("cell")
    return stored(links.unionByName(_mixed_links(rooted.join(mixed, "cell"), sets, percent)))


def one_of_each_similar(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row of smallest id of each group of near copies (then of smallest text hash); all columns, of any name.

    A group is what pairs of at least ``percent`` Jaccard similarity of their sets of word shingles
    link, directly or through others. Texts without a word are one group. Rows without an id come
    after all others. Of rows equal in id and text, any one stays. A null text counts as empty; a
    very long one is sketched whole by one task. An empty table gives an empty result.
    """
    keyed = marked_rows(docs, id_col, text_col)
    rows = stored(_sketches(keyed, shingle))
    rank = F.struct(F.col("doc").isNull().alias("none"), "doc", "body")
    nodes = stored(rows.groupBy("node", "n").agg(F.min(rank).alias("least"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    roots = connected_components(similar_links(keyed, nodes, shingle, percent))
    rooted = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return first_of_each(keyed, rows, kept)
