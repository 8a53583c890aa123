"""Benchmark decontamination: the q-gram lemma in diagonal bands, then banded alignment."""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import offsets_of, stored, table, text_chunks

#: ASCII letters lower-cased, digits kept, other ASCII characters as spaces; bytes of other letters kept.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(128)).lower() + bytes(range(128, 256))
#: A text longer than this is searched in overlapping parts.
PART = 1 << 21
#: A longer item is sought by overlapping passages of so many characters, every half of that.
PASSAGE = 400


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(FOLD).split())


def gram_hashes(data: bytes, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram of bytes, for q from 8 to 16."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    head = np.ndarray((n,), "<u8", data, 0, (1,))
    tail = np.ndarray((n,), "<u8", data, q - 8, (1,))
    return (head * np.uint64(0x9E3779B97F4A7C15)) ^ ((tail * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(9))


def banded_distance(item: np.ndarray, region: np.ndarray, band: int, spare: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of all of item with a part of region, on ``band`` diagonals.

    The first diagonal lies ``spare`` places before the region's start. Signs that match nothing
    stand before and after the region: a character that meets one has no partner.
    """
    padded = np.concatenate([np.full(spare, -1, np.int16), region.astype(np.int16), np.full(len(item) + band, -1, np.int16)])
    cost, steps = np.zeros(band, np.int64), np.arange(band)
    for i, c in enumerate(item):
        new = cost + (padded[i : i + band] != c)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)  # the item's character has no partner
        cost = np.minimum.accumulate(new - steps) + steps  # characters of the text have none
    best = int(cost.argmin())
    return int(cost[best]), min(len(region), max(0, len(item) + best - spare))


def passages(item: bytes) -> list[bytes]:
    """An item of up to PASSAGE characters itself; of a longer one, pieces of that length that overlap by half, up to its end."""
    if len(item) <= PASSAGE:
        return [item]
    starts = [*range(0, len(item) - PASSAGE, PASSAGE // 2), len(item) - PASSAGE]
    return [item[k : k + PASSAGE] for k in starts]


@dataclass
class QGramIndex:
    """The q-grams of the passages of a bounded block of items, each with its edit budget; items too short for that by themselves."""

    ids: list
    items: list[bytes]
    q: int
    edit_share: float

    def __post_init__(self):
        # Too short for the lemma: sought as whole words without edits.
        self.short: dict[bytes, list] = {}
        for i, x in zip(self.ids, self.items, strict=True):
            if 0 < len(x) < 2 * self.q:
                self.short.setdefault(b" " + x + b" ", []).append(i)
        self.words = ahocorasick.Automaton()
        for x in self.short:
            self.words.add_word(x.decode("latin-1"), x)
        if self.short:
            self.words.make_automaton()
        cut = [(i, p) for i, x in zip(self.ids, self.items, strict=True) if len(x) >= 2 * self.q for p in passages(x)]
        self.ids, self.items = [i for i, _ in cut], [p for _, p in cut]
        n = np.array([len(x) for x in self.items], np.int64)
        # The lemma needs n + 1 - q - k q shared q-grams, one at least.
        self.budget = np.minimum((n * self.edit_share).astype(np.int64), (n - self.q) // self.q)
        self.need = n + 1 - self.q - self.budget * self.q
        self.sizes = n
        codes = [gram_hashes(x, self.q) for x in self.items]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(n)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.codes, first, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        # What a task holds for each q-gram: its code, four short numbers, and some 32 to 64 bits of filter.
        self.first, self.counts = first.astype(np.int32), self.counts.astype(np.int32)
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.shift = np.uint64(64 - max(16, int(len(self.codes) * 32).bit_length()))
        bits = np.zeros(1 << int(64 - self.shift), bool)
        bits[self.codes >> self.shift] = True
        self.filter = np.packbits(bits, bitorder="little")

    @property
    def nbytes(self) -> int:
        """Bytes of the arrays that a task holds, without the items themselves."""
        return sum(a.nbytes for a in (self.codes, self.first, self.counts, self.owner, self.place, self.filter))

    def _maybe(self, codes: np.ndarray) -> np.ndarray:
        """The places of the codes that may be those of items."""
        bit = codes >> self.shift
        return np.flatnonzero(self.filter[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)

    def search(self, texts: list[bytes]) -> list[list[tuple]]:
        """For each normalised text, (id, start, end, edits) of regions within an item's budget."""
        reach = int((self.sizes + 4 * self.budget).max(initial=0)) + 8
        pieces = [(k, at, t[at : at + PART + reach]) for k, t in enumerate(texts) for at in range(0, max(1, len(t)), PART)]
        found: list[list[tuple]] = [[] for _ in texts]
        group: list[tuple] = []
        for piece in [*pieces, None]:
            if group and (piece is None or sum(len(p) for _, _, p in group) + len(piece[2]) > PART):
                self._search(group, found)
                group = []
            if piece is not None:
                group.append(piece)
        return [self._short(t) + self._merge(hits) for t, hits in zip(texts, found, strict=True)]

    def _short(self, text: bytes) -> list[tuple]:
        if not self.short:
            return []
        # A space more on both sides, so that a match's place is where its item begins, and the last sign one after its end.
        ends = self.words.iter(f" {text.decode('latin-1')} ")
        return sorted(((i, end + 1 - len(x), end - 1, 0) for end, x in ends for i in self.short[x]), key=lambda h: (h[0] is None, h[0] or 0, h[1]))

    def _search(self, pieces: list[tuple], found: list[list[tuple]]) -> None:
        gap = b"\n" * self.q  # in no item
        data = gap.join(p for _, _, p in pieces) + gap
        codes = gram_hashes(data, self.q)
        at = self._maybe(codes) if len(self.codes) else np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.codes, codes[at]), max(0, len(self.codes) - 1))
        hit = self.codes[k] == codes[at] if len(at) else np.zeros(0, bool)
        at, k = at[hit], k[hit]
        if not len(at):
            return
        begins = offsets_of([len(p) + len(gap) for _, _, p in pieces])
        n = self.counts[k].astype(np.int64)
        posting = np.repeat(self.first[k].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(offsets_of(n)[:-1], n)
        item, place, at = self.owner[posting].astype(np.int64), self.place[posting], np.repeat(at, n)
        piece = np.searchsorted(begins, at, side="right") - 1
        # Overlapping bands of diagonals: any range as wide as the budget allows lies in one.
        width = 2 * self.budget[item] + 1
        diagonal = at - begins[piece] - place
        band = diagonal // width
        key = (piece * len(self.items) + item << 24) + band + (1 << 23)
        keys, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        keys = keys[count >= self.need[(keys >> 24) % len(self.items)]]
        for x in keys.tolist():
            p, i, b = *divmod(x >> 24, len(self.items)), (x & (1 << 24) - 1) - (1 << 23)
            number, offset, text = pieces[p]
            low = int(b * (2 * self.budget[i] + 1))
            self._verify(i, text, max(0, low - int(self.budget[i])), low + 2 * (2 * int(self.budget[i]) + 1) + int(self.budget[i]), offset, found[number])

    def _verify(self, i: int, text: bytes, low: int, high: int, offset: int, hits: list[tuple]) -> None:
        item, budget = self.items[i], int(self.budget[i])
        if high <= low - budget:  # all of the band lies before the text
            return
        region = text[low : high + len(item)]
        exact = region.find(item)
        if exact >= 0:
            hits.append((i, offset + low + exact, offset + low + exact + len(item), 0))
            return
        a, r = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
        edits, end = banded_distance(a, r, high - low + budget + 1, budget)
        if edits <= budget:
            back, length = banded_distance(a[::-1], r[:end][::-1][: len(item) + budget], 2 * budget + 1, budget)
            hits.append((i, offset + low + max(0, end - length), offset + low + end, min(edits, back)))

    def _merge(self, hits: list[tuple]) -> list[tuple]:
        """Of hits of one passage that overlap, the first with the fewest edits; hits of an item's passages that overlap, as one."""
        kept: list[tuple] = []
        for hit in sorted(hits):
            if not kept or kept[-1][0] != hit[0] or hit[1] >= kept[-1][2]:
                kept.append(hit)
            elif hit[3] < kept[-1][3]:
                kept[-1] = hit
        out: list[tuple] = []
        for i, start, end, edits in sorted(((self.ids[i], *rest) for i, *rest in kept), key=lambda h: (h[0] is None, h[0] or 0, *h[1:])):
            if out and out[-1][0] == i and i is not None and start < out[-1][2]:
                out[-1] = (i, out[-1][1], max(end, out[-1][2]), out[-1][3] + edits)
            else:
                out.append((i, start, end, edits))
        return out


def index_blocks(benchmark: DataFrame, q: int, edit_share: float, block_bytes: int, id_col: str = "item_id", text_col: str = "text"):
    """(index, whether it is the last) for each block of items, one at a time; a block has some block_bytes of text, so that a task can hold it."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        # Written by block, so that each block is read by itself.
        rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).repartitionByRange("block").sortWithinPartitions("block"))
    for k in range(blocks):
        own = (rows.where(F.col("block") == k) if blocks > 1 else rows).select("item", "text").collect()
        own = sorted(own, key=lambda r: (r["item"] is None, r["item"] or 0, r["text"]))
        yield QGramIndex([r["item"] for r in own], [normal(r["text"].encode()) for r in own], q, edit_share), k == blocks - 1


def contaminated_regions(
    docs: DataFrame, benchmark: DataFrame, q: int = 10, edit_share: float = 0.08, block_bytes: int = 3 << 19, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Regions of whole texts that hold a benchmark item with at most ``edit_share`` edits.

    Case, punctuation and white space don't count (ASCII letters are folded, other signs are
    spaces). An item of n characters within k edits of a region shares n + 1 - q - k q of its
    q-grams with it, on diagonals at most k apart: q-grams are counted in overlapping bands of
    diagonals, bands with enough are kept and verified by a banded alignment. Items go to the
    tasks in blocks of ``block_bytes`` of text, which a task holds in some 30 times that, one block
    after another, and each block meets all texts: a benchmark of 100 MB takes 50 passes over them. An
    item of over 400 characters is found by overlapping passages of that length, each with its own
    budget, so that a text which quotes 600 of its characters is found too; a region then spans
    the passages found side by side, and its edits are theirs together.

    An item of fewer than 2 q normalised characters is found as whole words without edits; one
    without any letter or digit and a null item match nothing, null texts have no region. An
    item's budget is less where it is too short for the lemma. Very long texts are searched in
    overlapping parts. Repeated items each match (those without an id each by itself), repeated
    rows each have their regions, further columns are not read. Empty tables give an empty result.

    Returns doc_id, item_id, start, end (bytes of the normalised text) and edits.
    """
    schema = "doc_id long, item_id long, start long, end long, edits int"
    rows = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))

    def searcher(index: QGramIndex):
        def run(batches):
            for ids, texts in text_chunks(batches):
                hits = index.search([normal(t) for t in texts])
                owner = pa.array(np.repeat(np.arange(len(hits)), [len(h) for h in hits]))
                flat = [x for h in hits for x in h]
                cols = [pa.array([x[k] for x in flat], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.int32()))]
                yield pa.RecordBatch.from_arrays([ids.take(owner), *cols], ["doc_id", "item_id", "start", "end", "edits"])

        return run

    out = None
    for index, last in index_blocks(benchmark, q, edit_share, block_bytes):
        part = rows.mapInArrow(searcher(index), schema)
        part = part if last else stored(part)  # the driver lets go of a block before it takes the next
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 10, edit_share: float = 0.08, block_bytes: int = 3 << 19, text_col: str = "text") -> DataFrame:
    """docs without the rows that contaminated_regions would report; all columns, of any name, no shuffle.

    A null or empty text has no region, so its row stays; very long texts are searched whole, in
    overlapping parts. Repeated rows stay or go together, and ids play no part. Without items, or
    without docs, the table comes back as it is.
    """
    number = docs.columns.index(text_col)

    def keeper(index: QGramIndex):
        def run(batches):
            for batch in batches:
                keep = []
                for _, texts in text_chunks([pa.RecordBatch.from_arrays([batch.column(number)] * 2, ["a", "b"])]):
                    keep += [not h for h in index.search([normal(t) for t in texts])]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for index, last in index_blocks(benchmark, q, edit_share, block_bytes):
        docs = docs.mapInArrow(keeper(index), docs.schema)
        docs = docs if last else stored(docs)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
