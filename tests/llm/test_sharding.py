import random
import zlib

from tensorloom.llm.sharding import minimax_cuts, shard


def needed(sizes, capacity):
    shards, left = 1, capacity
    for s in sizes:
        if s > left:
            shards, left = shards + 1, capacity
        left -= s
    return shards


def best(sizes, shards):
    low = max(sizes)
    return next(c for c in range(low, sum(sizes) + 1) if needed(sizes, c) <= shards)


def test_smallest_capacity(spark):
    rng = random.Random(16)
    for n, shards, fan in ((1, 3, 2), (40, 3, 2), (300, 8, 4), (300, 8, 4096), (7, 9, 16)):
        ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(n)] if n == 40 else rng.sample(range(10 * n), n)
        rows = sorted((i, rng.choice([1, 5, 40, 400])) for i in ids)
        capacity, starts = minimax_cuts(spark.createDataFrame(rows, "first_id long, size long"), shards, fan)
        assert capacity == best([s for _, s in rows], shards)
        cuts = [k for k, (i, _) in enumerate(rows) if i in starts]
        assert cuts[0] == 0 and len(starts) <= shards and len(cuts) == len(starts)
        assert all(sum(s for _, s in rows[a:b]) <= capacity for a, b in zip(cuts, [*cuts[1:], n]))


def test_shards(spark):
    rng = random.Random(17)
    pool = ["t%d " % k * rng.randrange(1, 60) for k in range(50)]
    docs = [(i, rng.choice(pool) if rng.random() < 0.5 else pool[0] if rng.random() < 0.3 else f"only {i} é" * rng.randrange(9)) for i in range(400)]
    docs += [(None, "no id"), (7, "another text of id 7"), (7, docs[7][1]), (500, None), (501, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, shard int")
    out = shard(df, shards=5, rows_per_slot_block=9).collect()
    assert len(out) == len(docs)
    by_text, slots, sizes = {}, {}, {}
    text_of = {}
    for i, t in docs:
        text_of.setdefault((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())), t or "")
    for r in out:
        text = text_of[r.doc_id, r.size, r.text_crc32]
        by_text.setdefault(text, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for i, t in docs:
        first, size = groups.get(t or "", (float("inf"), 0))
        groups[t or ""] = (min(first, -float("inf") if i is None else i), size + len((t or "").encode()) + 1)
    units = {}
    for first, size in groups.values():
        units[first] = units.get(first, 0) + size
    assert max(sizes.values()) <= best([s for _, s in sorted(units.items())], 5)
    assert shard(df.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in shard(df.where("doc_id = 500")).collect()] == [(0, 0)]
