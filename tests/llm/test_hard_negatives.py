import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import hard_negatives
from tensorloom.llm.hard_negatives import OP13_SQL, Anchors, Best, mine, op13_hard_negatives, vectors_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, k=5, n=10):
    """rows of (id, vector, label), as a set of result rows."""
    use = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, v, c in use:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, d) for b, w, d in use]
        pos = sorted({(s, b) for s, b, d in scored if d == c and b != a})[:k]
        for s, b in pos:
            ok = sorted({(t, e) for t, e, d in scored if d != c and 30 * -s <= 100 * -t <= 90 * -s})[:n]
            out |= {(a, b, r, e, -s, -t) for r, (t, e) in enumerate(ok, 1)}
    return out


def corpus(seed, n=400, dim=5, spread=1.0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        rows.append((i, [x + rng.gauss(0, spread) * 0.2 for x in c], rng.randrange(4)))
    rows += [(n + i, [0.5] * dim, rng.randrange(4)) for i in range(n // 3)]  # copies: ties by id
    rows += [(2000, [0.0] * dim, 1), (2010, None, 1), (2020, [1.0] * dim, None), (2030, [1.0, None] + [0.0] * (dim - 2), 2), (2040, [float("nan")] * dim, 2), (2050, [float("inf")] * dim, 2), (None, [1.0] * dim, 2)]
    rows += [(2060, [1.0, 2.0], 3), (2070, [1.0] * (dim + 3), 3), (2080, [], 0), (-100, [0.3] * dim, 0)]
    rng.shuffle(rows)
    return rows + rows[:40]  # repeated rows


def found(df, **options):
    out = [tuple(r) for r in mine(vectors_of(df), F.col("id") % 10 == 0, **options).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize(("seed", "spread", "options"), [(1, 1.0, {}), (2, 0.05, {"round_size": 60}), (3, 4.0, {})])
def test_equals_brute_force(spark, monkeypatch, seed, spread, options):
    monkeypatch.setattr(hard_negatives, "STEP", 16)
    rows = corpus(seed, spread=spread)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", id string, score double").repartition(5)
    assert found(df, **options) == brute(rows)


def test_walk_ends_early_and_misses_nothing(monkeypatch):
    """On clustered vectors members stop long before the end of the list, with the best of all."""
    monkeypatch.setattr(hard_negatives, "STEP", 64)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 16)) * 100
    vectors = np.floor(centers[rng.integers(0, 20, 8000)] + rng.normal(size=(8000, 16)) * 3)
    anchors = Anchors(np.arange(200), np.zeros(200, np.int64), vectors[:200])
    best, looked = Best(200, 5), [0]

    def hits(left, scores, rows):
        looked[0] += scores.size
        i, j = np.nonzero(scores >= best.bar[left][:, None])
        return left[i], scores[i, j], rows[j]

    ids = np.arange(8000)
    anchors.walk(best, ids, ids, vectors, lambda left: best.bar[left], hits)
    want = np.sort(vectors[:200] @ vectors.T, 1)[:, ::-1][:, :5]
    assert (best.score == want).all()
    assert looked[0] < 0.5 * 200 * 8000


def test_bounds_hold_for_all_rows_behind():
    rng = np.random.default_rng(6)
    vectors = np.floor(rng.normal(size=(500, 8)) * 50)
    anchors = Anchors(np.arange(100), np.zeros(100, np.int64), vectors[:100])
    for members, order, bounds in anchors.lists(vectors):
        scores = anchors.vectors[members] @ vectors[order].T
        behind = np.maximum.accumulate(scores[:, ::-1], 1)[:, ::-1]
        assert (behind <= anchors.norms[members][:, None] * bounds + 1e-6).all()


def test_large_components_saturate(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38, 0.1], 1)], SCHEMA)
    assert vectors_of(df).first().vector == [1 << 20, -(1 << 20), 25]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mine(vectors_of(df), F.col("id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert mine(vectors_of(one), F.col("id") % 10 == 0).count() == 0


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rel = con.sql(OP13_SQL)
    got = sorted(map(tuple, op13_hard_negatives(spark, sf).select(*rel.columns).collect()))
    assert got and got == sorted(rel.fetchall())
