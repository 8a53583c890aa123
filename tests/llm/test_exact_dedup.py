import hashlib
import random

from tensorloom.llm.exact_dedup import exact_dedup


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_against_brute_force(spark):
    rng = random.Random(18)
    docs = [(i, rng.choice(["Same", "same", "SAME", "É", "é", "", None, f"own {i}", f"Own {i // 2}"])) for i in range(300)]
    docs += [(None, "same"), (None, "none"), (None, "NONE"), (5, "again"), (5, "AGAIN"), (400, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, True) for i, t in docs], "doc_id long, text string, kept boolean")
    groups = {}
    for i, t in docs:
        groups.setdefault(low(t), []).append(i)
    # A small filter, none at all and one too large to broadcast all give the same rows.
    for options in ({}, {"bits_per_row": 1}, {"broadcast_bytes": 0}):
        out = exact_dedup(df, **options).collect()
        assert len(out) == len(docs)
        want = sorted((str(i), hashlib.sha256(low(t).encode()).hexdigest(), len(groups[low(t)]), str(max((x for x in groups[low(t)] if x is not None), default=None))) for i, t in docs)
        assert sorted((str(r.doc_id), r.text_sha256, r.group_size, str(r.keep_id)) for r in out) == want
        kept = [r for r in out if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup(df.limit(0)).count() == 0
