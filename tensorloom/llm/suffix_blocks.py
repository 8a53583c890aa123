"""Blockwise suffix sorting by a difference cover, for repeats of a fixed length in one block of text."""

from __future__ import annotations

import numpy as np

#: Period of the sample, and a difference cover of it: each residue is a difference of two members.
PERIOD = 13
COVER = (0, 1, 3, 9)


def _shift_table() -> np.ndarray:
    """[a, b]: the least d for which a + d and b + d are both in the cover; any two residues have one."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    table = np.full((PERIOD, PERIOD), -1)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(d for d in range(PERIOD) if inside[a + d] and inside[b + d])
    return table


SHIFT = _shift_table()


#: Whether a residue is in the cover.
INSIDE = np.isin(np.arange(PERIOD), COVER)


def _rank(key: np.ndarray) -> np.ndarray:
    """How many keys are lower than each."""
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]]))) if len(key) else order
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(first, np.diff(np.append(first, len(key))))
    return out


def _tied(rank: np.ndarray) -> np.ndarray:
    """Where a rank stands twice or more."""
    return np.flatnonzero(np.bincount(rank)[rank] > 1) if len(rank) else np.zeros(0, np.int64)


def _refined(rank: np.ndarray, second: np.ndarray, bits: int = 32) -> np.ndarray:
    """Ranks of whole ties, told apart by a second number of so many bits."""
    if not len(rank):
        return rank
    if int(rank.max()) >> (64 - bits):
        raise ValueError(f"a block may have 2^{64 - bits} places at most")
    key = (rank.astype(np.uint64) << np.uint64(bits)) | second.astype(np.uint64)
    order = np.argsort(key)
    key, old = key[order], rank[order]
    at = np.arange(len(key))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
    lead = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), at, 0))
    out = np.empty(len(key), np.int64)
    out[order] = old + first - lead
    return out


def _heads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of the first PERIOD bytes at each place (data is padded)."""
    raw = data.tobytes()
    n = len(data) - 8
    word = np.ndarray((n,), ">u8", raw, 0, (1,))
    rank = _rank(word[at].astype(np.uint64))
    ties = _tied(rank)
    bits = 8 * (PERIOD - 8)
    rank[ties] = _refined(rank[ties], word[at[ties] + 8].astype(np.uint64) >> np.uint64(64 - bits), bits)
    return rank


class CoverSample:
    """Ranks of the suffixes at sampled places of a text, by their first ``depth`` bytes at least."""

    def __init__(self, data: np.ndarray, size: int, depth: int):
        """data: bytes of the text and padding after it; size: bytes of the text."""
        places = np.arange(size + PERIOD)
        places = places[INSIDE[places % PERIOD]]
        rank = _heads(data, places)
        number = np.zeros(size + 2 * PERIOD, np.int64)
        number[places] = np.arange(len(places))
        known = PERIOD
        while known < depth:  # a sampled place plus a multiple of the period is sampled too
            ties = _tied(rank)
            ahead = places[ties] + known
            after = np.where(ahead < size + PERIOD, rank[number[np.minimum(ahead, size + 2 * PERIOD - 1)]] + 1, 0)
            rank[ties] = _refined(rank[ties], after)
            known *= 2
        self.rank = np.zeros(size + 2 * PERIOD, np.int64)
        self.rank[places] = rank


def sort_bucket(data: np.ndarray, sample: CoverSample, at: np.ndarray) -> np.ndarray:
    """The places ``at`` of one bucket in the order of their suffixes, by the sample's depth at least.

    Suffixes are ordered by their first PERIOD bytes. In each tie the first suffix's residue is
    the pivot: suffixes of that residue compare by the sample's ranks at one shift, and each
    suffix of another residue is placed among them at the shift that the cover has for the two
    residues. Suffixes that land in one gap, or beside one pivot, form the ties of the next round.
    """
    order = _heads(data, at)
    live = np.arange(len(at))
    for _ in range(PERIOD + 1):
        live = live[_tied(order[live])]
        if not len(live):
            break
        live = live[np.argsort(order[live])]
        group = order[live]
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(start, len(live)))
        tie = np.repeat(np.arange(len(start)), sizes)
        place = at[live]
        residue = place % PERIOD
        pivot = residue[start][tie]
        own = residue == pivot
        # Pivots in order: twice their rank among the tie's pivots, plus one.
        lead = np.flatnonzero(own)
        base = sample.rank[place[lead] + SHIFT[pivot[lead], pivot[lead]]]
        by = np.argsort((tie[lead] << 32) | base)
        lead, base = lead[by], base[by]
        step = np.concatenate(([True], (base[1:] != base[:-1]) | (tie[lead][1:] != tie[lead][:-1])))
        count = np.cumsum(step)
        first = np.concatenate(([True], tie[lead][1:] != tie[lead][:-1]))
        within = count - np.repeat(count[first], np.diff(np.append(np.flatnonzero(first), len(lead))))
        sub = np.zeros(len(live), np.int64)
        sub[lead] = 2 * within + 1
        # Others: between pivots, or level with one (then the pivot's own number).
        others = np.flatnonzero(~own)
        shifts = SHIFT[residue[others], pivot[others]]
        for shift in np.unique(shifts).tolist():
            rest = others[shifts == shift]
            asked = np.zeros(len(start), bool)
            asked[tie[rest]] = True
            heads = lead[INSIDE[(pivot[lead] + shift) % PERIOD] & asked[tie[lead]]]
            key = (tie[heads] << 32) | sample.rank[place[heads] + shift]
            want = (tie[rest] << 32) | sample.rank[place[rest] + shift]
            low, high = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
            level = high > low
            here = np.minimum(low, len(heads) - 1)
            left = np.maximum(low - 1, 0)
            after = np.where((low > 0) & (tie[heads[left]] == tie[rest]), sub[heads[left]] + 1, 0)
            sub[rest] = np.where(level, sub[heads[here]], after)
        order[live] = _refined(group, sub)
        # What is level with a pivot is ordered; only gaps (even numbers) hold ties still.
        live = live[sub % 2 == 0]
    return np.argsort(order)


def _shared(word: np.ndarray, a: np.ndarray, b: np.ndarray, known: int, limit: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b share, ``known`` at least and ``limit`` at most."""
    out = np.full(len(a), known)
    live = np.arange(len(a))
    while len(live):
        differ = word[a[live] + out[live]] ^ word[b[live] + out[live]]
        lowest = differ & (~differ + np.uint64(1))
        out[live] += np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)) // 8).astype(np.int64)
        live = live[(differ == 0) & (out[live] < limit[live])]
    return np.minimum(out, limit)


def _deep_neighbours(order: np.ndarray, same: np.ndarray, deep: np.ndarray, starts: np.ndarray, end: np.ndarray, raw: bytes, length: int):
    """Neighbours among the suffixes that share ``length`` bytes with a deep one, in the order of all bytes up to their ends.

    same: the places in ``order`` whose suffix shares ``length`` bytes with the next one.
    """
    run = np.cumsum(np.concatenate(([True], np.diff(same) > 1))) - 1
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    pairs = np.diff(np.append(first, len(run)))
    asked = np.bincount(run, deep[order[same]] | deep[order[same + 1]]) > 0
    two = same[first[asked & (pairs == 1)]]
    left, right = [order[two]], [order[two + 1]]
    for k in np.flatnonzero(asked & (pairs > 1)).tolist():
        members = order[same[first[k]] : same[first[k]] + pairs[k] + 1]
        rest = [raw[s + length : e] for s, e in zip(starts[members].tolist(), end[members].tolist(), strict=True)]
        members = members[sorted(range(len(rest)), key=rest.__getitem__)]
        left.append(members[:-1])
        right.append(members[1:])
    return np.concatenate(left), np.concatenate(right)


def repeated_starts(data: bytes, starts: np.ndarray, length: int, bucket: np.ndarray | None = None, deep: np.ndarray | None = None, end: np.ndarray | None = None):
    """Whether the ``length`` bytes at each start also stand at another start.

    The cover sample of the whole block is ranked once; then one bucket of suffixes at a time is
    sorted, and neighbours in its order are compared byte by byte. Starts of different buckets
    never hold equal bytes, so a bucket needs no other.

    With ``deep`` (a flag for each start) and ``end`` (where each suffix ends), suffixes that tie
    with a deep one are ordered by all their bytes, and a second array says how many bytes each of
    them shares with a neighbour in that order (0 for the others).
    """
    size = len(data)
    padded = np.frombuffer(data + b"\0" * (length + 4 * PERIOD + 16), np.uint8)
    sample = CoverSample(padded, size, length)
    out = np.zeros(len(starts), bool)
    reach = np.zeros(len(starts), np.int64)
    bucket = np.zeros(len(starts), np.int64) if bucket is None else bucket
    by = np.argsort(bucket, kind="stable")
    raw = padded.tobytes()
    word = np.ndarray((len(padded) - 8,), "<u8", raw, 0, (1,))
    for own in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
        if len(own) < 2:
            continue
        ordered = own[sort_bucket(padded, sample, starts[own])]
        a, b = starts[ordered[:-1]], starts[ordered[1:]]
        same = np.arange(len(a))
        for k in [*range(0, length - 7, 8), length - 8]:
            same = same[word[a[same] + k] == word[b[same] + k]]
        out[ordered[same]] = True
        out[ordered[same + 1]] = True
        if deep is not None and len(same):
            left, right = _deep_neighbours(ordered, same, deep, starts, end, raw, length)
            limit = np.minimum(end[left] - starts[left], end[right] - starts[right])
            common = _shared(word, starts[left], starts[right], length, limit)
            np.maximum.at(reach, left, common)
            np.maximum.at(reach, right, common)
    return out if deep is None else (out, reach)
