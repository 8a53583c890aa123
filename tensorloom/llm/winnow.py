"""Winnowed anchors, and the steps from anchors that texts share to the places they cover.

A window of ``length`` symbols (words or bytes) is owned by its anchor, the leftmost of its
lowest-hashed ``gram``-symbol substrings. Equal windows have equal anchors at equal offsets, so
only windows whose anchor occurs twice can repeat. The span that an anchor owns is its context:
the seed extended both ways as far as any of its windows reaches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import offsets_of, stored

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Symbols hashed at a time; a longer text is taken in overlapping parts.
PART = 1 << 20
#: Bits for a place in a chunk of up to PART symbols and an overlap; the rest of a hash orders windows' grams.
PLACE_BITS = 21
#: Most windows that an anchor may own, so that ``pack`` has room for their number.
MOST_WINDOWS = 1023


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Polynomial hashes of any substring of an array of 64-bit symbols."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if len(Rolling.powers) < n + 1:
            Rolling.powers = self._powers(MULTIPLIER, n + 1)
            Rolling.inverses = self._powers(INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * Rolling.powers[:n], out=self.sums[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * Rolling.inverses[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * Rolling.inverses[:n])


def anchors_of(symbols: np.ndarray, lengths: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of texts laid end to end: text number, place in it, windows to its left and in all, hashes."""
    n = len(symbols)
    if n < length:
        return {k: np.zeros(0, np.int64) for k in ("text", "pos", "left", "count", "anchor", "context")}
    rolling = Rolling(symbols)
    grams = rolling.all(gram)
    bits = PLACE_BITS  # the same for every chunk: equal windows must break ties alike
    low = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    pos = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(pos)]
    start = np.flatnonzero(ends - np.arange(len(pos)) >= length)
    if not len(start):
        return {k: np.zeros(0, np.int64) for k in ("text", "pos", "left", "count", "anchor", "context")}
    pos = pos[start]
    first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
    count = np.diff(np.append(first, len(pos)))
    at, begin = pos[first], start[first]
    text = np.searchsorted(np.cumsum(lengths), at, side="right")
    base = offsets_of(lengths)[text]
    shape = ((at - begin) * 1024 + count).astype(np.uint64)
    return {
        "text": text,
        "pos": at - base,
        "left": at - begin,
        "count": count,
        "anchor": grams[at].view(np.int64),
        "context": mix(rolling.of(begin, begin + count - 1 + length) + shape * np.uint64(MULTIPLIER)).view(np.int64),
    }


def pack(pos, left, count):
    """One long: where an anchor is, and the windows it owns, pos - left and on, count of them."""
    return (pos << 20) | (left << 10) | count


def unpack(place):
    return place >> 20, (place >> 10) & 1023, place & 1023


def parts(texts: list, length: int):
    """Texts by number, cut to bounded parts that overlap by length - 1 symbols: [(number, offset, part)] in groups."""
    group, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PART):
            part = t[at : at + PART + length - 1]
            if group and size + len(part) > PART:
                yield group
                group, size = [], 0
            group.append((k, at, part))
            size += len(part)
    if group:
        yield group


def anchor_table(docs: DataFrame, symbols_of, length: int, gram: int) -> DataFrame:
    """(doc, body, place, anchor, context) for the anchors of docs(doc, body, text).

    ``symbols_of`` makes, in each task, a function from a list of texts to arrays of symbols.
    """
    if length - gram + 1 > MOST_WINDOWS or gram > length:
        raise ValueError(f"windows of {length} with grams of {gram}: an anchor would own more than {MOST_WINDOWS} windows, or there is no gram")

    def run(batches):
        from tensorloom.llm.common import text_chunks

        symbols = symbols_of()
        for batch in batches:
            body = batch.column(1)
            seen = 0
            for ids, texts in text_chunks([batch.select([0, 2])]):
                bodies = body.slice(seen, len(texts))
                seen += len(texts)
                for group in parts(symbols(texts), length):
                    lengths = np.array([len(p) for _, _, p in group])
                    got = anchors_of(np.concatenate([p for _, _, p in group]), lengths, length, gram)
                    number = np.array([k for k, _, _ in group])[got["text"]] if len(got["text"]) else got["text"]
                    shift = np.array([at for _, at, _ in group])[got["text"]] if len(got["text"]) else got["text"]
                    take = pa.array(number)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), bodies.take(take), pa.array(pack(got["pos"] + shift, got["left"], got["count"])), pa.array(got["anchor"]), pa.array(got["context"])],
                        ["doc", "body", "place", "anchor", "context"],
                    )

    return docs.mapInArrow(run, "doc long, body long, place long, anchor long, context long")


def shared_anchors(anchors: DataFrame) -> DataFrame:
    """The stored anchors that occur at least twice, with ``classes``, their number of different contexts."""
    contexts = anchors.groupBy("anchor", "context").agg(F.count("*").alias("n"))
    seeds = contexts.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("classes")).where("n > 1")
    return stored(anchors.join(stored(seeds.select("anchor", "classes")), "anchor"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (doc, body, text); doc and body (a hash of the text) tell rows apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))


def per_doc(df: DataFrame, *cols: str) -> DataFrame:
    """One row for each document of df with a list of its rows; as long as the document at most."""
    return df.groupBy("doc", "body").agg(F.collect_list(F.struct(*cols)).alias("list"))


def with_lists(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """texts(doc, body, text) with the list of each row; ids may be null."""
    other = lists.select(F.col("doc").alias("doc2"), F.col("body").alias("body2"), "list")
    on = F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("body") == F.col("body2"))
    return texts.join(other, on, how).select("doc", "body", "text", "list")


def lists_of(batch: pa.RecordBatch, fields: list[str]):
    """(bytes of the text, {field: array}) for each row of a batch of (doc, body, text, list)."""
    lists = batch.column(3)
    flat = lists.flatten()
    values = {f: flat.field(f).to_numpy(zero_copy_only=False) for f in fields}
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = offsets_of(sizes)
    texts = batch.column(2).cast(pa.large_binary())
    for k in range(batch.num_rows):
        yield texts[k].as_py() or b"", {f: v[offsets[k] : offsets[k + 1]] for f, v in values.items()}


def windows_of(asked: DataFrame, symbols_of, length: int, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each window that the listed anchors (place, anchor) of each text own: its owner's hash, offset from it, own hash and place.

    ``also`` names further longs of the lists that each row takes along.
    """
    names = ["place", "anchor", *also]

    def run(batches):
        symbols = symbols_of()
        for batch in batches:
            for k, (text, asks) in enumerate(lists_of(batch, names)):
                pos, left, count = unpack(asks["place"])
                x = symbols([text])[0]
                for low in range(0, len(pos), 4096):
                    p, c = (pos - left)[low : low + 4096], count[low : low + 4096]
                    owner = np.repeat(np.arange(len(p)), c)
                    start = p[owner] + np.arange(len(owner)) - offsets_of(c)[owner]
                    begin = int(start.min())
                    rolling = Rolling(x[begin : int(start.max()) + length])
                    n = len(start)
                    columns = [
                        batch.column(0).take(pa.array(np.full(n, k))),
                        batch.column(1).take(pa.array(np.full(n, k))),
                        pa.array(start.astype(np.int32)),
                        pa.array(asks["anchor"][low : low + 4096][owner]),
                        pa.array((pos[low : low + 4096][owner] - start).astype(np.int32)),
                        pa.array(rolling.of(start - begin, start - begin + length).view(np.int64)),
                    ]
                    columns += [pa.array(asks[c][low : low + 4096][owner]) for c in also]
                    yield pa.RecordBatch.from_arrays(columns, fields)

    fields = ["doc", "body", "start", "anchor", "offset", "window", *also]
    return asked.mapInArrow(run, "doc long, body long, start int, anchor long, offset int, window long" + "".join(f", {c} long" for c in also))


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n symbols lie in an interval."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, stop, -1)
    return np.cumsum(depth[:-1]) > 0
