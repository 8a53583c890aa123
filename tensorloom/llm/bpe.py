"""Byte-level BPE on length-bucketed padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tensorloom.llm.common import table, text_chunks

#: No rank: such a pair doesn't merge.
NONE = np.int64(1 << 40)
PAD = -1


class PairTable:
    """Open-addressed hash table from a pair of ids to the rank of its merge, looked up by column."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(rank) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        key = (left.astype(np.int64) << 20) | right
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] < 0
            winner = np.unique(slot[todo][free], return_index=True)[1]
            won = todo[free][winner]
            self.keys[slot[won]], self.ranks[slot[won]] = key[won], rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], NONE)
        left_over = np.flatnonzero((self.keys[slot] != key).ravel() & (self.keys[slot] >= 0).ravel())
        flat, keys, slots = out.reshape(-1), key.reshape(-1), slot.reshape(-1)
        for _ in range(self.probes - 1):
            if not len(left_over):
                break
            slots[left_over] = (slots[left_over] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots[left_over]]
            hit = there == keys[left_over]
            flat[left_over[hit]] = self.ranks[slots[left_over[hit]]]
            left_over = left_over[~hit & (there >= 0)]
        return flat.reshape(key.shape)


class ByteBPE:
    """Encoder and decoder for a file of ranks (base64 token, rank) and a splitting pattern."""

    #: Pieces longer than this are merged alone, all places of the lowest pair in one round.
    LONG = 64
    #: Distinct pieces that a task remembers.
    CACHE = 50_000

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.text_of = [str(i) for i in range(len(self.token))]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Each two-part split of a token whose parts are tokens merges to it.
        left, right, rank = [], [], []
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int64))
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece (a match of the pattern)."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        bucket = np.ceil(np.log2(np.maximum(lengths[order], 1)) * 2).astype(np.int64)
        for rows in np.split(order, np.flatnonzero(np.diff(bucket)) + 1) if len(order) else []:
            for rows in np.array_split(rows, -(-len(rows) // 8192)):
                if lengths[rows[-1]] > self.LONG:
                    for k in rows:
                        out[k] = tuple(self._merge_long(self.byte_id[np.frombuffer(pieces[k], np.uint8)]).tolist())
                elif lengths[rows[-1]]:
                    for k, ids in zip(rows.tolist(), self._merge_rows([pieces[k] for k in rows], lengths[rows]), strict=True):
                        out[k] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], lengths: np.ndarray) -> list[tuple[int, ...]]:
        n, width = len(pieces), int(lengths.max())
        cells = np.full((n, width), PAD, np.int64)
        filled = np.arange(width) < lengths[:, None]
        cells[filled] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        done: list[tuple[int, ...]] = [()] * n
        live, size = np.arange(n), lengths.copy()

        def pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where((a >= 0) & (b >= 0), self.pairs.look(np.maximum(a, 0), np.maximum(b, 0)), NONE)

        ranks = pair_ranks(cells[:, :-1], cells[:, 1:]) if width > 1 else np.full((n, 1), NONE)
        while True:
            at = ranks.argmin(1)  # the leftmost of the lowest
            best = ranks[np.arange(len(live)), at]
            ended = best == NONE
            if ended.any():
                for k in np.flatnonzero(ended):
                    done[live[k]] = tuple(cells[k, : size[k]].tolist())
                keep = ~ended
                live, size, at, best = live[keep], size[keep], at[keep], best[keep]
                if not len(live):
                    return done
                width = int(size.max())
                cells, ranks = cells[keep][:, :width], ranks[keep][:, : max(1, width - 1)]
            r, width = np.arange(len(live)), cells.shape[1]
            # Compact: what stands right of the merged pair moves one place left.
            cols = np.arange(width - 1)
            moved = cells[:, 1:]
            cells = np.where(cols > at[:, None], moved, cells[:, :-1])
            cells[r, at] = best
            size -= 1
            if width - 1 < 2:
                ranks = np.full((len(live), 1), NONE)
                continue
            cols = np.arange(width - 2)
            ranks = np.where(cols > at[:, None], ranks[:, 1:], ranks[:, :-1])
            inside = at < width - 2
            q = r[inside]
            ranks[q, at[inside]] = pair_ranks(cells[q, at[inside]], cells[q, at[inside] + 1])
            inside = at > 0
            q = r[inside]
            ranks[q, at[inside] - 1] = pair_ranks(cells[q, at[inside] - 1], cells[q, at[inside]])

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row: each round merges every place of the lowest pair, from the left.

        This equals merging the leftmost place again and again, as a merge of rank r never makes a
        pair of lower rank: that pair's token encodes to itself by ranks up to its own, its ends
        are ends of ids here, and pairs of ranks below r are exhausted, so its bytes would have
        become that token before. (A part of it may well have a rank above its own.)
        """
        while len(ids) > 1:
            ranks = self.pairs.look(ids[:-1], ids[1:])
            low = ranks.min()
            if low == NONE:
                break
            at = np.flatnonzero(ranks == low)
            if len(at) > 1:  # of places that overlap, every second of a run from its first
                run = np.concatenate(([0], np.cumsum(np.diff(at) > 1)))
                first = np.flatnonzero(np.concatenate(([True], np.diff(run) > 0)))
                at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            ids = ids.copy()
            ids[at] = low
            ids = np.delete(ids, at + 1)
        return ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.pattern.findall(t) for t in texts]
        if len(self.known) > self.CACHE:
            self.known.clear()
        new = list(set(chain.from_iterable(split)) - self.known.keys())
        self.known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        return [list(chain.from_iterable(map(self.known.__getitem__, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def bpe_roundtrip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text to ids and decode them again.

    The pattern splits a text; a null text counts as empty and has no ids, and a very long one is one
    unit of a task, whole. Each row stands alone,
    so repeated rows, ties and further columns change nothing; an empty table gives an empty one.

    Returns doc_id, n_tokens, ids_sha256 (of the ids joined by commas), decoded_sha256 and, if
    ``with_ids``, ids and decoded.
    """

    def run(batches):
        bpe = ByteBPE(rank_file, pattern)
        for ids, texts in text_chunks(batches, max_bytes=1 << 19):
            tokens = bpe.encode([t.decode() for t in texts])
            back = [bpe.decode(t) for t in tokens]
            cols = [
                ids,
                pa.array(map(len, tokens), pa.int64()),
                pa.array([hashlib.sha256(",".join(map(bpe.text_of.__getitem__, t)).encode()).hexdigest() for t in tokens], pa.string()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
            ]
            if with_ids:
                cols += [pa.array(tokens, pa.list_(pa.int32())), pa.array([b.decode() for b in back], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, schema)


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents"), *tokenizer_files())
