import random

import corpus_pipeline
import numpy as np
import pytest
from test_simhash import brute_components

from tensorloom.llm import near_copies
from tensorloom.llm.near_copies import joined_nodes, one_of_each_similar
from tensorloom.llm.simhash import fingerprint


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def planted(rng):
    """Texts with copies of 0.7 to 0.97 similarity, made by changes of single words."""
    words = ["w%d" % k for k in range(500)]
    texts = []
    for n in (30, 60, 120, 300, 300, 800):
        for changes in (1, 2, 4, 6):
            own = rng.choices(words, k=n)
            copy = list(own)
            for k in rng.sample(range(n), max(1, changes * n // 300)):
                copy[k] = "new%d" % rng.randrange(10**6)
            texts += [" ".join(own), " ".join(copy)]
    return texts


def test_planted_pairs(spark):
    texts = planted(random.Random(4))
    sets = [shingles(t) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if similar(sets[a], sets[b])]
    wide = [p for p in near if (fingerprint(texts[p[0]].encode(), 5) ^ fingerprint(texts[p[1]].encode(), 5)).bit_count() > 3]
    assert len(near) > 15 and len(wide) > 5  # more than three bits apart: stayed before
    want = set(brute_components(range(len(texts)), near).values())
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_copy_stage(spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == want


def test_chains_and_edges(spark):
    """A chain whose ends aren't similar, a large group, equal sets of different texts, rows without a word or id."""
    rng = random.Random(5)
    base = ["v%d" % rng.randrange(900) for _ in range(200)]
    texts, own = [], list(base)
    for k in range(12):
        texts.append(" ".join(own))
        own[k * 16], own[k * 16 + 7] = f"x{k}", f"y{k}"
    texts += [" ".join([*base[:-1], f"z{k}"]) for k in range(40)] + ["a b c d e f", "A  B c d e f", "one two", "one", "", " \n", None]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "alone with no id"), (3, texts[3]), (3, texts[3])]
    sets = [shingles(t) for _, t in docs]
    root = brute_components(range(len(docs)), [(a, b) for a in range(len(docs)) for b in range(a) if similar(sets[a], sets[b])])
    want = sorted(str(docs[k][0]) for k in set(root.values()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in one_of_each_similar(df).collect()) == want
    assert one_of_each_similar(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 7])
def test_a_large_group_of_copies_of_one_text(spark, monkeypatch, block):
    """Copies with few and many changes: some are similar to the first text, some to other copies only, some to none."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(6)
    base = ["v%d" % rng.randrange(900) for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(120):
        own = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 9)):
            own[k] = "x%d" % rng.randrange(4)
        texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    root = brute_components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if similar(sets[a], sets[b])])
    want = set(root.values())
    assert 5 < len(want) < 100
    rows = [(k, t, "b", k, "d") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body string, doc long, node string")
    out = one_of_each_similar(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == want


def test_joined_nodes():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)] + [np.arange(100, 110), np.arange(100, 109), np.arange(500, 510)]
    roots = np.array([*range(30), 30, 31, 0])
    near = [(a, b) for a in range(33) for b in range(a) if roots[a] == roots[b] or 10 * len(np.intersect1d(sets[a], sets[b])) >= 7 * len(np.union1d(sets[a], sets[b]))]
    want = brute_components(range(33), near)
    for columns in (16, 4096):
        assert dict(enumerate(joined_nodes(sets, roots, 70, columns).tolist())) == want
