import random

import numpy as np

from tensorloom.llm.decontaminate import QGramIndex, banded_distance, contaminated_regions, gram_hashes, normal, without_contaminated


def semi_global(item, text):
    """Fewest edits between item and any part of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    for _ in range(edits):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("abcxyz") + text[k:], text[:k] + rng.choice("abcxyz") + text[k + 1 :]])
    return text


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(150):
        item = "".join(rng.choices("abc", k=rng.randrange(1, 30)))
        text = "".join(rng.choices("abc", k=rng.randrange(0, 40)))
        got, _ = banded_distance(np.frombuffer(item.encode(), np.uint8), np.frombuffer(text.encode(), np.uint8), len(text) + 2 * len(item) + 1, len(item))
        assert got == semi_global(item, text)


def test_against_brute_force(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(80)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [say(rng.randrange(12, 30)) for _ in range(12)]
    docs = []
    for k in range(60):
        x = rng.choice(items)
        n = int(len(x) * 0.08)
        docs.append((k, f"{say(rng.randrange(30))} {edited(rng, x, rng.choice([0, 1, n // 2, n, n + 3, 2 * n]))} {say(rng.randrange(30))}"))
    docs += [(100, None), (101, ""), (102, items[0].upper().replace(" ", ",  ")), (103, say(3000) + " " + items[3] + " " + say(3000) + " " + items[3]), (None, items[1])]
    docs += [(200 + k, items[k][-60:] + (" " + items[k][-60:]) * 3) for k in range(6)]
    want = set()
    for i, t in docs:
        for k, x in enumerate(items):
            if t and semi_global(normal(x.encode()), normal(t.encode())) <= int(len(x) * 0.08) if len(t or "") < 2000 else x in t:
                want.add((i, k))
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "short"), (None, "short")], "item_id long, text string")
    for block in (1 << 22, 500):
        out = contaminated_regions(df, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want
        assert len([r for r in out if (r.doc_id, r.item_id) == (103, 3)]) == 2
        assert all(abs(r.end - r.start - len(items[r.item_id])) <= r.edits for r in out)
        kept = without_contaminated(df, bench, block_bytes=block)
        assert kept.columns == df.columns
        assert {r.item_id for r in kept.collect()} == {k for k, (i, _) in enumerate(docs)} - {k for k, (i, _) in enumerate(docs) if i in {d for d, _ in want}}
    assert contaminated_regions(df.limit(0), bench).count() == 0
    assert contaminated_regions(df, bench.limit(0)).count() == 0 and without_contaminated(df, bench.limit(0)).count() == len(docs)


def test_long_texts_are_searched_in_parts(spark, monkeypatch):
    from tensorloom.llm import decontaminate
    from tensorloom.llm.decontaminate import QGramIndex

    rng = random.Random(12)
    item = "".join(rng.choices("etaoin shr", k=200)).encode()
    filler = bytes(rng.choices(b"etaoinshr ", k=3000))
    index = QGramIndex([7], [normal(item)], 10, 0.08)
    text = normal(filler[:950] + b" " + item + b" " + filler[950:])
    whole = index.search([text, b"", text])
    monkeypatch.setattr(decontaminate, "PART", 300)
    assert index.search([text, b"", text]) == whole and len(whole[0]) == 1 and whole[1] == []


def test_short_items_and_parts_of_long_ones(spark):
    rng = random.Random(13)
    say = lambda n: " ".join("".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(n))
    long = say(400)
    items = [(1, "What is it?"), (2, "No."), (3, "..."), (4, long), (5, "What is it"), (None, "is it")]
    docs = [(1, "so what, is IT"), (2, "somewhat is it"), (3, "no"), (4, "nothing"), (5, f"{say(20)} {long[700:1350]} {say(9)}"), (6, long[:300]), (7, ""), (8, None), (9, edited(rng, long[900:1700], 12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, d[0]) for d in docs], "doc_id long, text string, item_id long")
    for block in (1 << 22, 100):
        out = contaminated_regions(df, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in out} == {(1, 1), (1, 5), (1, None), (2, None), (3, 2), (5, 4), (9, 4)}
        by = {(r.doc_id, r.item_id): r for r in out}
        assert (by[1, 1].start, by[1, 1].end) == (3, 13) and (by[3, 2].start, by[3, 2].end) == (0, 2)
        assert by[5, 4].end - by[5, 4].start >= 400 and by[9, 4].edits > 0
        assert sorted(r.doc_id for r in without_contaminated(df, bench, block_bytes=block).collect()) == [4, 6, 7, 8]


def test_a_full_block_stays_under_100_mb():
    """A block of the default size, of items whose passages overlap by half, which makes the most q-grams."""
    import inspect

    size = inspect.signature(contaminated_regions).parameters["block_bytes"].default
    rng = np.random.default_rng(1)
    items = [bytes(rng.integers(97, 123, 4000, dtype=np.uint8)) for _ in range(size // 4000 + 1)]
    index = QGramIndex(list(range(len(items))), items, 10, 0.08)
    assert index.nbytes < 100e6
    hits = index.search([b"xyz " + items[7][100:700] + b" zyx", items[3], b"of nothing at all"])
    assert [{h[0] for h in found} for found in hits] == [{7}, {3}, set()]


def test_the_packed_filter_loses_no_gram():
    items = [b"some words that make an item of the benchmark", b"and another one of those"]
    index = QGramIndex([1, 2], items, 10, 0.08)
    codes = np.concatenate([gram_hashes(x, 10) for x in items])
    assert list(index._maybe(codes)) == list(range(len(codes)))
    others = np.random.default_rng(2).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert len(index._maybe(others)) < 5000
