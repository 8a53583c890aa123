import random

import pytest
import xxhash

from tensorloom.llm.components import connected_components
from tensorloom.llm.simhash import grid_for, near_links, simhash_groups


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_near_links_find_every_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base) | {0, 1, 2**63, 2**64 - 1}
    for b in base:
        for n in (1, 2, 3, 4, 5):
            x = b
            for bit in rng.sample(range(64), n):
                x ^= 1 << bit
            fps.add(x)
    signed = lambda x: x - 2**64 if x >> 63 else x
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    for bands, chosen in ((2, 1), (5, 3), (4, 1), (6, 3), (8, 5)):
        got = near_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 3, bands, chosen).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_grids():
    assert grid_for(10**6) == (2, 1)
    assert grid_for(10**10) == (8, 5)
    with pytest.raises(ValueError):
        near_links(None, 3, 2, 2)


def test_components_with_hubs(spark):
    links = [(5, k) for k in range(6, 4000)] + [(k, 10_000 + k) for k in range(100, 3000)] + [(20_000, 20_001)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute_components({n for l in links for n in l}, links)


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 400)] + [(7, 7)]
    want = brute_components({n for a, b in links if a != b for n in (a, b)}, links)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_against_brute_force(spark):
    rng = random.Random(7)
    words = ["w%d" % k for k in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 300))) for _ in range(40)]
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts] + [t.upper() for t in texts[:5]]
    texts += [None, "", " \n", "one", "One", "two words", "Ünï\x1c x\x0by z", "a " * 30_000]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    fps = [brute_fp(t) for _, t in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = brute_components(range(len(docs)), links)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted((str(i), f"{fps[k]:016x}", least.get(root[k])) for k, (i, _) in enumerate(docs))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_groups(df).collect())
    assert got == want
    assert simhash_groups(df.limit(0)).count() == 0
