import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import line_dedup as module
from tensorloom.llm.line_dedup import line_dedup, line_report, op10_line_dedup


def distance(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(docs, edits, least):
    first = {}
    for i, t in sorted(docs):
        for p, line in enumerate((t or "").split("\n")):
            if len(line) >= least:
                first.setdefault(line, (i, p))
    gone = {x for x in first if any(first[y] < first[x] and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for y in first)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if len(x) < least or (x not in gone and first[x] == (i, p))) for i, t in docs}


@pytest.mark.parametrize("hot", [None, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    if hot:  # nearly every shared segment is cut a second time
        monkeypatch.setattr(module, "HOT_LINES", hot)
        monkeypatch.setattr(module, "HOT_SAMPLE", 1)
    rng = random.Random(10)
    letters = "abcde fgétz😀"
    base = ["".join(rng.choices(letters, k=rng.randrange(5, 40))) for _ in range(60)]

    def edit(x):
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(x) + 1)
            x = rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice(letters) + x[k:], x[:k] + rng.choice(letters) + x[k + 1 :]])
        return x

    docs = [(k, "\n".join(edit(rng.choice(base)) for _ in range(rng.randrange(1, 9)))) for k in range(90)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, base[0]), (104, "x" * 70_000 + "\n" + "x" * 699 + "\n" + "x" * 700)]
    df = spark.createDataFrame([(i, t, 1, i) for i, t in docs], "doc_id long, text string, n int, doc long")
    for edits, least in ((2, 10), (1, 3), (3, 12)):
        want = brute(docs, edits, least)
        out = line_dedup(df, edits, least)
        assert out.columns == df.columns
        assert {r.doc_id: r.text for r in out.collect()} == want
    report = {r.doc_id: r for r in line_report(df, 3, 12).collect()}
    assert {i: r.kept_sha256 for i, r in report.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in want.items()}
    assert (report[100].n_lines, report[100].n_removed, report[104].n_lines, report[104].n_removed) == (0, 0, 3, 1)


def test_edge_rows(spark):
    line = "the same line in all of the rows"
    df = spark.createDataFrame([(1, line), (1, line), (None, line + "\nmore"), (2, line + "\n" + line)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in line_dedup(df).collect())
    assert got == [("1", ""), ("1", ""), ("2", ""), ("None", line + "\nmore")]
    assert line_dedup(df.limit(0)).count() == 0


def test_op10_drops_exact_repeats_of_short_lines(spark, tmp_path):
    long = "a line of more than twenty characters"
    docs = [(1, "Les.\nabcd\n\n" + long), (2, "Les.\nLes!\n \n\nabcd"), (3, "x\nLes.\n \n" + long + "s\nx")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: docs[0][1], 2: "Les!\n \n", 3: "x\n "}
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (dict(docs)[i].count("\n") - t.count("\n"), hashlib.sha256(t.encode()).hexdigest()) for i, t in want.items()}


def test_columns_with_any_name(spark):
    line = "the same line in all of the rows"
    df = spark.createDataFrame([(1, line, "a", 1, 2, 3), (2, line + "\nmore", "b", 4, 5, 6)], "doc_id long, text string, body_2 string, doc_2 long, gone long, lines long")
    out = line_dedup(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, line, "a", 1, 2, 3), (2, "more", "b", 4, 5, 6)]
    dotted = df.withColumnsRenamed({"gone": "a.b"})
    assert sorted(r.text for r in line_dedup(dotted).collect()) == ["more", line]


def template(n, seed):
    rng = random.Random(seed)
    return [f"2024-05-06 INFO worker request {rng.randrange(10**17, 10**18)} handled by the service in time" for _ in range(n)]


def test_lines_of_one_template_make_no_row_for_each_pair(spark):
    """They have one length and differ in digits only; pairs grow with the square of their number, candidates don't."""
    made = {}
    for n in (2000, 8000):
        lines = spark.createDataFrame([(x,) for x in template(n, n)], "line string").withColumn("h1", F.xxhash64("line"))
        made[n] = module._candidates(lines, 2).count()
    assert made[8000] < 100 * 8000
    assert made[8000] < 0.01 * 8000 * 7999 / 2


def test_near_lines_of_one_template_are_found(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT_LINES", 32)
    monkeypatch.setattr(module, "HOT_SAMPLE", 1)
    rng = random.Random(3)
    lines = template(400, 5)
    for k in range(120):  # near ones: up to three edits at any place, so some are too far
        x = rng.choice(lines[:400])
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(x))
            x = rng.choice([x[:at] + x[at + 1 :], x[:at] + rng.choice("0123456789 aé") + x[at:], x[:at] + rng.choice("0123456789") + x[at + 1 :]])
        lines.append(x)
    docs = [(k, x) for k, x in enumerate(lines)]
    want = brute(docs, 2, 20)
    assert sum(t == "" for t in want.values()) > 50
    assert {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want
