import hashlib
import random
from collections import Counter

import numpy as np

from tensorloom.llm.suffix_blocks import PERIOD, CoverSample, repeated_starts, sort_bucket


def messy(rng, n):
    out = b""
    while len(out) < n:
        kind = rng.randrange(4)
        if kind == 0 and out:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randrange(1, 300)]
        elif kind == 1:
            out += bytes([rng.choice(b"ab")]) * rng.randrange(1, 200)
        elif kind == 2:
            out += bytes(rng.choices(b"ab", k=rng.randrange(1, 9))) * rng.randrange(1, 60)
        else:
            out += bytes(rng.choices(b"abcd\xff\x00", k=rng.randrange(1, 120)))
    return out[:n]


def test_order_and_repeats_against_brute_force():
    rng = random.Random(13)
    for trial in range(60):
        data = messy(rng, rng.randrange(60, 1500))
        length = rng.choice([16, 25, 60])
        starts = np.array(sorted(rng.sample(range(len(data) - length + 1), rng.randrange(1, len(data) - length + 2))))
        padded = np.frombuffer(data + b"\0" * (length + 4 * PERIOD + 16), np.uint8)
        order = sort_bucket(padded, CoverSample(padded, len(data), length), starts)
        text = padded.tobytes()
        heads = [text[s : s + length] for s in starts[order].tolist()]
        assert heads == sorted(heads), trial
        count = Counter(data[s : s + length] for s in starts.tolist())
        want = [count[data[s : s + length]] > 1 for s in starts.tolist()]
        assert repeated_starts(data, starts, length).tolist() == want
        first = np.array([data[s] for s in starts.tolist()])
        assert repeated_starts(data, starts, length, first).tolist() == want


def brute(docs, length):
    count = Counter()
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        count.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = [False] * (len(b) + 1)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_operator_against_brute_force(spark):
    from tensorloom.llm.suffix_dedup import suffix_dedup

    rng = random.Random(14)
    pool = [messy(rng, 900).decode("latin1") for _ in range(8)]
    docs = []
    for i in range(70):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(p[a : a + rng.randrange(1, 700)])
            parts.append("".join(rng.choices("abcé😀", k=rng.randrange(30))))
        docs.append((i, "".join(parts)))
    docs += [(100, None), (101, ""), (102, "a" * 3000), (103, "ab" * 500), (5, docs[5][1]), (None, pool[0]), (104, docs[7][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int")
    for options in ({}, {"length": 60, "gram": 12, "block": 300, "bucket": 100}, {"length": 60, "gram": 12, "most_contexts": 3}):
        rows = suffix_dedup(df, **options).collect()
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
        assert got == brute(docs, options.get("length", 200)), options
    assert suffix_dedup(df.limit(0)).count() == 0


def test_the_sort_finds_all_that_goes(spark, monkeypatch):
    """Whole copies, parts of texts and rows that repeat are all marked by the sorted blocks; no other path is taken."""
    from tensorloom.llm import suffix_dedup as own

    found = []
    blocks = own._sorted_blocks

    def kept(*args):
        found.append(own.stored(blocks(*args)))
        return found[-1]

    monkeypatch.setattr(own, "_sorted_blocks", kept)
    monkeypatch.setattr(own.winnow, "windows_of", None)
    rng = random.Random(16)
    pool = [messy(rng, 600).decode("latin1") for _ in range(4)]
    docs = [(i, pool[i % 4][: 250 + 40 * i] + "".join(rng.choices("abc", k=300))) for i in range(8)] + [(20, pool[1]), (21, pool[1]), (20, pool[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in own.suffix_dedup(df).collect())
    assert got == brute(docs, 200) and sum(r[2] for r in got) > 1500
    assert len(found) == 1 and found[0].count() > 0


def test_a_second_copy_is_sorted_to_its_end():
    """What a deep suffix shares with its neighbours, against comparing it with all."""
    rng = random.Random(17)
    for trial in range(40):
        spans = [messy(rng, rng.randrange(20, 120)) for _ in range(6)]
        spans += [rng.choice(spans) for _ in range(4)] + [s[: rng.randrange(20, len(s) + 1)] + bytes(rng.choices(b"ab", k=5)) for s in rng.choices(spans, k=4)]
        length = 16
        base = np.cumsum([0] + [len(s) for s in spans])
        starts, end, deep = [], [], []
        for k, s in enumerate(spans):
            places = [0] if 6 <= k < 10 else range(len(s) - length + 1)
            starts += [base[k] + p for p in places]
            end += [base[k] + len(s) for _ in places]
            deep += [6 <= k < 10 for _ in places]
        data = b"".join(spans)
        again, reach = repeated_starts(data, np.array(starts), length, None, np.array(deep), np.array(end))
        suffixes = [data[s:e] for s, e in zip(starts, end)]
        heads = Counter(s[:length] for s in suffixes)
        assert again.tolist() == [heads[s[:length]] > 1 for s in suffixes]

        def common(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        for k, s in enumerate(suffixes):
            tied = [t for j, t in enumerate(suffixes) if j != k and t[:length] == s[:length]]
            asked = deep[k] or any(d and t[:length] == s[:length] for d, t in zip(deep, suffixes))
            assert reach[k] == (max((common(s, t) for t in tied), default=0) if asked else 0), trial


def test_marks_come_from_bytes(spark):
    """A second copy whose bytes differ from some place on marks what is equal before it, whatever its hash says."""
    from tensorloom.llm.suffix_dedup import _sorted_blocks

    rng = random.Random(18)
    span = bytes(rng.choices(range(256), k=284))
    other = span[:240] + bytes(255 - b for b in span[240:])
    schema = "anchor long, kind long, second long, left int, count int, span binary"
    for second, want in ((span, [(7, -30, 254)]), (other, [(7, -30, 210)]), (span[1:] + b"a", [(7, -29, 254)]), (other[::-1], [])):
        contexts = spark.createDataFrame([(1, 7, 0, 30, 85, bytearray(span)), (1, 7, 1, 30, 85, bytearray(second))], schema)
        assert [tuple(r) for r in _sorted_blocks(contexts, 200, 1000, 1000).collect()] == want


def test_long_texts_are_hashed_in_parts(spark, monkeypatch):
    from tensorloom.llm import winnow
    from tensorloom.llm.suffix_dedup import byte_symbols

    rng = random.Random(15)
    text = messy(rng, 5000)
    whole = winnow.anchors_of(byte_symbols()([text])[0], np.array([5000]), 100, 16)
    monkeypatch.setattr(winnow, "PART", 700)
    starts = []
    for group in winnow.parts([text], 100):
        for k, at, part in group:
            got = winnow.anchors_of(byte_symbols()([part])[0], np.array([len(part)]), 100, 16)
            first = got["pos"] + at - got["left"]
            starts += [(s, a) for f, c, a in zip(first.tolist(), got["count"].tolist(), got["anchor"].tolist()) for s in range(f, f + c)]
    want = [(s, a) for p, left, c, a in zip(*(whole[k].tolist() for k in ("pos", "left", "count", "anchor"))) for s in range(p - left, p - left + c)]
    assert [s for s, _ in sorted(starts)] == list(range(5000 - 100 + 1)) and sorted(starts) == sorted(want)
