"""SimHash near-duplicates by a grid join over per-segment bit counts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import boxed, stored, table, text_chunks
from tensorloom.llm.components import connected_components

SEED = 42
LOW_BITS = 0x5555555555555555
#: What the count of two random bits tells: two of them are equal with a chance of 2 ** -SEGMENT_BITS.
SEGMENT_BITS = 1.415


def _bit_counts(hashes: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """How many of the hashes have each of 64 bits set."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), block):
        total += np.unpackbits(hashes[k : k + block].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return total


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included; all words are one shingle of a shorter text."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes, repeats included; 0 for none."""
    if not len(hashes):
        return 0
    bits = _bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits).view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 for no word."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint of each whole text as a signed long; null texts have no word."""

    def run(batches):
        for ids, texts in text_chunks(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps)], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_for(nodes: int, most_bits: int = 3) -> tuple[int, int]:
    """(bands, chosen) of the grid for so many fingerprints: some 64 of them share a cell at most, if they are spread evenly.

    Halves and their adjacent cells (22 bits a cell) serve up to 2^28 fingerprints and 3 bits;
    beyond, a band more than the bound at least, of which all but ``most_bits`` are chosen.
    """
    if most_bits <= 3 and nodes <= 1 << 28:
        return 2, 1
    bands = most_bits + 2
    while bands < 32 and SEGMENT_BITS * 32 * (bands - most_bits) / bands < (nodes - 1).bit_length() - 6:
        bands += 1
    return bands, bands - most_bits


def near_links(points: DataFrame, most_bits: int = 3, bands: int = 2, chosen: int = 1) -> DataFrame:
    """(a, b) with a < b for distinct fingerprints ``fp`` that differ in at most ``most_bits`` bits.

    The embedding has a dimension for each of 32 segments of two bits: the segment's bit count.
    The Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints.
    The segments are cut into ``bands``; of differences within the bound, the ``chosen`` bands
    with the fewest hold at most a radius of 0 or 1. There is a grid over each choice of bands,
    its cells as wide as one count: a point meets the points of its own cell and, with radius 1,
    of the adjacent cells (one count larger by one). What meets is kept if the Manhattan distance
    over all segments and then the Hamming distance are within the bound, and in the first choice
    of bands that finds it only.

    A fingerprint has some 43,745 others within 3 bits at most, so links grow with the number of
    fingerprints, however large a group is.
    """
    spread, more = divmod(most_bits, bands)
    radius = chosen * spread + max(0, chosen - (bands - more))
    if radius > 1:
        raise ValueError(f"{chosen} of {bands} bands may hold {radius} differences; more bands or fewer chosen ones are needed")
    edges = [round(32 * k / bands) * 2 for k in range(bands + 1)]
    choices = [[s for k in c for s in range(edges[k], edges[k + 1], 2)] for c in combinations(range(bands), chosen)]
    masks = [_signed(sum(3 << s for s in segments)) for segments in choices]
    low = F.lit(LOW_BITS)
    half = F.shiftrightunsigned("fp", 1)
    either = F.col("fp").bitwiseOR(half).bitwiseAND(low)
    both = F.col("fp").bitwiseAND(half).bitwiseAND(low)
    # Counts 0, 1 and 2 are written 00, 01 and 11, so that the bits which differ are the Manhattan distance.
    embedded = points.select("fp", either.bitwiseOR(F.shiftleft(both, 1)).alias("counts"))

    def adjacent(mask: int, segments: list[int]) -> str:
        larger = f"(counts & {mask}L) | shiftleft(CASE WHEN shiftright(counts, s) & 1 = 0 THEN 1L ELSE 2L END, s)"
        return f"transform(filter(array({', '.join(map(str, segments))}), s -> shiftright(counts, s + 1) & 1 = 0), s -> {larger})"

    cells = [f"counts & {m}L" for m in masks]
    index = embedded.select("fp", "counts", F.posexplode(F.expr(f"array({', '.join(cells)})")).alias("choice", "cell"))
    probe = index.withColumn("own", F.lit(True))
    if radius:
        sides = ", ".join(adjacent(m, s) for m, s in zip(masks, choices, strict=True))
        lists = embedded.select("fp", "counts", F.posexplode(F.expr(f"array({sides})")).alias("choice", "cells"))
        probe = probe.unionByName(lists.select("fp", "counts", "choice", F.explode("cells").alias("cell"), F.lit(False).alias("own")))
    left = probe.select("choice", "cell", "own", F.col("fp").alias("a"), F.col("counts").alias("ca"))
    right = index.select(F.col("choice").alias("choice2"), F.col("cell").alias("cell2"), F.col("fp").alias("b"), F.col("counts").alias("cb"))
    first = "CASE " + " ".join(f"WHEN bit_count((ca ^ cb) & {m}L) <= {radius} THEN {k}" for k, m in enumerate(masks)) + " END"
    return left.join(
        right,
        (F.col("choice") == F.col("choice2"))
        & (F.col("cell") == F.col("cell2"))
        & F.expr("NOT own OR a < b")
        & F.expr(f"bit_count(ca ^ cb) <= {most_bits}")
        & F.expr(f"bit_count(a ^ b) <= {most_bits}")
        & F.expr(f"{first} = choice"),
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _components(prints: DataFrame, least, most_bits: int) -> DataFrame:
    """(fp, component): the smallest of ``least`` over the rows of prints(fp, ...) that a fingerprint's links reach."""
    nodes = stored(prints.groupBy("fp").agg(F.min(least).alias("least")))
    roots = connected_components(near_links(nodes.select("fp"), most_bits, *grid_for(nodes.count(), most_bits)))
    rooted = stored(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return stored(rooted.join(named, "root").select("fp", "component"))


def simhash_groups(docs: DataFrame, shingle: int = 3, most_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose fingerprints are linked, directly or through others.

    Equal fingerprints are one node, so copies make no pairs. Links, components and fingerprints
    stay in Spark. component_id is the smallest id that a document can reach; rows without an id
    join groups but never name one (a group without any id has null). Texts without a word have
    fingerprint 0 and link like others. Very long texts are hashed whole, in blocks. Repeated rows
    each have a row; further columns are not read. An empty table gives an empty result.

    Returns doc_id, fingerprint (16 hex digits), component_id.
    """
    rows = stored(fingerprints(docs, shingle, id_col, text_col))
    of = _components(rows, F.col("doc_id"), most_bits).withColumnRenamed("component", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def marked_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, doc, body, text): whole rows, and their id and a hash of their text, which tell them apart."""
    text = F.col(text_col).cast("string")
    return boxed(docs, doc=F.col(id_col).cast("long"), body=F.xxhash64(text), text=text)


def one_of_each_group(docs: DataFrame, shingle: int = 3, most_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row of smallest id of each group (then of smallest text hash); all columns.

    Rows without an id come after all others. Of rows equal in id and text, any one stays. Columns
    may have any name. An empty table gives an empty result.
    """
    keyed = marked_rows(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            # The hash travels with the id, to tell rows of one id apart.
            seen = 0
            for ids, texts in text_chunks([batch.select([0, 2])]):
                fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(seen, len(texts)), pa.array(fps)], ["doc", "body", "fp"])
                seen += len(texts)

    rows = stored(keyed.select("doc", "body", "text").mapInArrow(run, "doc long, body long, fp long"))
    rank = F.struct(F.col("doc").isNull().alias("none"), "doc", "body")
    return first_of_each(keyed, rows, _components(rows, rank, most_bits))


def first_of_each(keyed: DataFrame, rows: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of keyed that a component (none, doc, body) of ``of`` names, unpacked; rows has each (doc, body)."""
    kept = stored(of.select(F.col("component.doc").alias("doc2"), F.col("component.body").alias("body2")).distinct())
    stay = keyed.drop("text").join(kept, F.col("doc").eqNullSafe(F.col("doc2")) & F.col("body").eqNullSafe(F.col("body2")), "left_semi")
    if rows.groupBy("doc", "body").count().where("count > 1").limit(1).count():
        stay = stay.dropDuplicates(["doc", "body"])
    return stay.select("_row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
