"""Suffix-array deduplication of bytes, one bounded block of suffixes at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import winnow
from tensorloom.llm.common import offsets_of, stored, table
from tensorloom.llm.suffix_blocks import repeated_starts

#: A fixed random 64-bit symbol for each byte.
SYMBOLS = np.random.RandomState(20).randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def byte_symbols():
    return lambda texts: [SYMBOLS[np.frombuffer(t, np.uint8)] for t in texts]


def _contexts(asked: DataFrame, length: int) -> DataFrame:
    """(anchor, kind, second, left, count, span): the bytes that each listed anchor's windows span, and how many of them stand before it."""

    def run(batches):
        for batch in batches:
            for text, asks in winnow.lists_of(batch, ["place", "anchor", "kind", "second"]):
                pos, left, count = winnow.unpack(asks["place"])
                spans = [text[s : s + c - 1 + length] for s, c in zip((pos - left).tolist(), count.tolist(), strict=True)]
                cols = [*(pa.array(asks[c]) for c in ("anchor", "kind", "second")), pa.array(left.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(spans, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "kind", "second", "left", "count", "span"])

    return asked.mapInArrow(run, "anchor long, kind long, second long, left int, count int, span binary")


#: Windows that start in one stretch of so many places before an anchor share the rest of their bytes.
STRETCH = 16


def _cores(asked: DataFrame, length: int) -> DataFrame:
    """(doc, body, place, anchor, kind, second): each listed anchor's windows by stretch of starts, each under the hash of what a stretch's windows share.

    The stretches lie at the same places before every copy of an anchor, so equal windows come
    under equal hashes.
    """

    def run(batches):
        symbols = byte_symbols()
        for batch in batches:
            for k, (text, asks) in enumerate(winnow.lists_of(batch, ["place", "anchor", "kind", "second"])):
                pos, left, count = winnow.unpack(asks["place"])
                least = left - count + 1
                parts = left // STRETCH - least // STRETCH + 1
                owner = np.repeat(np.arange(len(pos)), parts)
                stretch = least[owner] // STRETCH + np.arange(len(owner)) - offsets_of(parts)[:-1][owner]
                high = np.minimum(left[owner], STRETCH * stretch + STRETCH - 1)
                low = np.maximum(least[owner], STRETCH * stretch)
                at = pos[owner]
                first = at - STRETCH * stretch
                begin, end = int(first.min()), int(first.max()) + length
                core = winnow.Rolling(symbols([text[begin:end]])[0]).of(first - begin, first - begin + length - STRETCH + 1)
                key = winnow.mix(core ^ winnow.mix(asks["anchor"][owner].view(np.uint64) + stretch.astype(np.uint64)))
                take = pa.array(np.full(len(owner), k))
                cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(winnow.pack(at, high, high - low + 1)), pa.array(key.view(np.int64)), pa.array(asks["kind"][owner]), pa.array(asks["second"][owner])]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "body", "place", "anchor", "kind", "second"])

    return asked.mapInArrow(run, "doc long, body long, place long, anchor long, kind long, second long")


def _sorted_blocks(contexts: DataFrame, length: int, block: int, bucket: int) -> DataFrame:
    """(kind, start, stop): the runs of bytes, by place from the anchor, of each context's windows that stand elsewhere too.

    A window does if a neighbour in the order of suffixes has its bytes. Of a context that occurs
    again there is a ``second`` copy, which is one suffix: it is sorted to its last byte and shares
    with its neighbour what all windows of the context hold, so they need no suffix of their own.

    Contexts of an anchor come together. Whole anchors are gathered to blocks of some ``block``
    suffixes (and 8 bytes for each), for which the cover sample is ranked, and sorted in buckets
    of some ``bucket``.
    """

    def finish(parts: list[pa.RecordBatch]):
        data = pa.Table.from_batches(parts).combine_chunks()
        windows = data.column("count").to_numpy().astype(np.int64)
        second = data.column("second").to_numpy() > 0
        count = np.where(second, 1, windows)
        spans = data.column("span").to_pylist()
        base = offsets_of([len(s) for s in spans])[:-1]
        owner = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(owner)) - offsets_of(count)[:-1][owner]
        anchor = data.column("anchor").to_numpy()
        group = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
        # Buckets end where an anchor does.
        suffixes = np.bincount(group, count).astype(np.int64)
        own_bucket = (offsets_of(suffixes)[:-1] // bucket)[group][owner]
        end = (base + windows - 1 + length)[owner]
        again, reach = repeated_starts(b"".join(spans), base[owner] + step, length, own_bucket, second[owner], end)
        # A suffix that shares more than one window with a neighbour marks the windows after its own too.
        more = np.flatnonzero((reach > length) & ~second[owner])
        depth = np.zeros(len(owner) + 1, np.int64)
        np.add.at(depth, more, 1)
        np.add.at(depth, more + reach[more] - length + 1, -1)
        again = (again | (np.cumsum(depth[:-1]) > 0)) & ~second[owner]
        edge = np.concatenate(([True], (owner[1:] != owner[:-1]) | (again[1:] != again[:-1])))
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(again)) - 1
        first, last = first[again[first]], last[again[first]]
        left = data.column("left").to_numpy().astype(np.int64)[owner[first]]
        kind = data.column("kind").to_numpy()[owner[first]]
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array((step[first] - left).astype(np.int32)), pa.array((step[last] + length - left).astype(np.int32))], ["kind", "start", "stop"])

    def run(batches):
        held, size, held_bytes = [], 0, 0
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            windows = batch.column(4).to_numpy().astype(np.int64)
            count = np.where(batch.column(2).to_numpy() > 0, 1, windows)
            begin = 0
            if not len(anchor):
                continue
            for cut in [*(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]:
                if (size >= block or held_bytes >= 8 * block) and (begin or held[-1].column(0)[-1].as_py() != anchor[0]):
                    yield finish(held)
                    held, size, held_bytes = [], 0, 0
                held.append(batch.slice(begin, cut - begin))
                size += int(count[begin:cut].sum())
                held_bytes += int(windows[begin:cut].sum()) + (length - 1) * (cut - begin)
                begin = cut
        if size:
            yield finish(held)

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "kind long, start int, stop int")


def suffix_dedup(
    docs: DataFrame,
    length: int = 200,
    gram: int = 32,
    block: int = 400_000,
    bucket: int = 100_000,
    most_contexts: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which starts anywhere else too.

    Suffixes that can't repeat are set aside first: equal strings have equal winnowed anchors at
    equal offsets, so a suffix belongs to the bucket of its anchor, and only anchors that occur
    twice are looked at. An anchor's windows span its context. Of each different context all
    suffixes of the first copy go to the suffix sort, and of one that occurs again the longest
    suffix of the last copy: blocks of whole anchors are sorted one at a time, long ties by ranks of
    a difference-cover sample of the block, and neighbours mark each other where they have
    ``length`` or more common bytes. What is marked in a context holds for all its copies. Anchors
    with more than ``most_contexts`` different contexts are first told apart by a longer part of
    their windows, and what is still as frequent is dealt out by the hash of each string instead,
    so that no task holds an unbounded group.

    Strings never cross documents. Repeated rows are places of their own, so each repeats the
    other. A null text is empty. Very long texts are read whole by one task, in parts. Further
    columns are not read. An empty table gives an empty result.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if
    ``with_text``, the kept bytes.
    """
    texts = winnow.keyed(docs, id_col, text_col)
    anchors = stored(winnow.anchor_table(texts, byte_symbols, length, gram))
    shared = winnow.shared_anchors(anchors)
    place = F.struct("doc", "body", "place")
    kind = F.xxhash64("anchor", "context").alias("kind")
    contexts = shared.groupBy("anchor", "context", "classes").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("copies"))
    copy = [F.struct(f"{c}.*", F.lit(k).cast("long").alias("second")) for k, c in enumerate(("first", "last"))]
    both = F.when(F.col("copies") > 1, F.array(*copy)).otherwise(F.array(copy[0]))
    asks = stored(contexts.select("anchor", kind, "classes", F.explode(both).alias("copy")).select("copy.*", "anchor", "kind", "classes"))

    def listed(asked: DataFrame) -> DataFrame:
        return winnow.with_lists(texts, winnow.per_doc(asked, "place", "anchor", "kind", "second"), "inner")

    few, many = asks.where(F.col("classes") <= most_contexts), asks.where(F.col("classes") > most_contexts)
    if many.limit(1).count():
        # Frequent anchors are told apart by more of their windows' bytes.
        cores = stored(_cores(listed(many), length))
        counts = stored(cores.groupBy("anchor").agg(F.sum(1 - F.col("second")).alias("classes"), F.count("*").alias("n")).where("n > 1").drop("n"))
        asks = stored(cores.join(counts, "anchor").select("doc", "body", "place", "anchor", "kind", "second", "classes"))
        few = few.unionByName(asks.where(F.col("classes") <= most_contexts))
        many = asks.where(F.col("classes") > most_contexts)
    found = _sorted_blocks(_contexts(listed(few), length), length, block, bucket)
    if many.limit(1).count():
        windows = stored(winnow.windows_of(listed(many), byte_symbols, length, ("kind", "second")))
        key = ["anchor", "offset", "window"]
        again = stored(windows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
        found = found.unionByName(windows.where("second = 0").join(again, key).select("kind", (-F.col("offset")).alias("start"), (length - F.col("offset")).alias("stop")))
    found = stored(found)
    anchor_at = F.shiftright("place", 20)
    covered = shared.select("doc", "body", anchor_at.alias("pos"), kind).join(found, "kind").select("doc", "body", (F.col("pos") + F.col("start")).cast("int").alias("start"), (F.col("pos") + F.col("stop")).cast("int").alias("stop"))
    lists = winnow.per_doc(covered, "start", "stop")

    def cut(batches):
        for batch in batches:
            sizes, removed, runs, digests, kept_texts = [], [], [], [], []
            for text, spans in winnow.lists_of(batch, ["start", "stop"]):
                kept, gone_runs = text, 0
                if len(spans["start"]):
                    gone = winnow.covered(len(text), spans["start"], spans["stop"])
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    gone_runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                sizes.append(len(text))
                removed.append(len(text) - len(kept))
                runs.append(gone_runs)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept_texts, pa.binary())] * with_text, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return winnow.with_lists(texts, lists, "left").mapInArrow(cut, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
