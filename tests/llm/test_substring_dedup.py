import hashlib
import random

from tensorloom.llm.substring_dedup import substring_dedup


def brute(docs, window):
    """{doc: (words, removed, digest)} with ids in order and all different."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = ["w%d" % k for k in range(60)]
    pool = [rng.choices(vocab, k=rng.randrange(20, 70)) for _ in range(12)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randrange(1, 60)] if rng.random() < 0.7 else rng.choices(vocab, k=rng.randrange(40))
        docs.append((i * 3, rng.choice([" ", "\n", "\t"]).join(words)))
    docs += [(1000, "a " * 300), (1001, "b a " * 40 + "a " * 90), (1002, docs[5][1]), (1003, None), (1004, ""), (1005, " ".join(pool[0] * 40))]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, place string")
    for window, gram in ((20, 6), (7, 3)):
        assert rows(substring_dedup(df, window, gram)) == brute(docs, window)


def test_edge_rows(spark):
    long = " ".join("w%d" % k for k in range(50))
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long), (1, "other " + long)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup(df).collect())
    assert got == [("1", 50, 50), ("1", 50, 50), ("1", 51, 50), ("2", 50, 50), ("None", 50, 0)]
    assert substring_dedup(df.limit(0)).count() == 0
    kept = {r.doc_id: r.kept for r in substring_dedup(df.where("doc_id is null"), with_text=True).collect()}
    assert kept == {None: long}
