import random
import re

import duckdb
import pytest

from tensorloom.llm.quality import OP11_SQL, RULES, STATS, Sampled, cascade_order, plan_cascade, quality_rules, repeated_words, try_all

SF = "/root/testdata/sf0.001"


def brute_repeated(words):
    n = len(words)
    covered = set()
    for i in range(n - 4):
        if any(words[i : i + 5] == words[j : j + 5] for j in range(n - 4) if j != i):
            covered |= set(range(i, i + 5))
    return len(covered)


def test_repeated_words_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = [bytes([97 + rng.randrange(rng.choice((1, 2, 3, 30)))]) for _ in range(rng.randrange(40))]
        assert repeated_words(words) == brute_repeated(words)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stats = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), brute_repeated(words))
    n, chars, symbols, dup, rep = stats
    failed = n < 10 or 100 * rep > 20 * n
    letters = sum(any(c.isascii() and c.isalpha() or not c.isascii() for c in w) for w in words)
    strip = " \t\n\v\f\r"
    bad = chars < 2 * n or chars > 15 * n or 4 * symbols > n or 100 * dup > 50 * len(lines) or 100 * letters < 60 * n
    bad = bad or 100 * sum(x.lstrip(strip)[:1] in "-*•" for x in lines) > 90 * len(lines) or 100 * sum(x.rstrip(strip).endswith(("...", "…")) for x in lines) > 30 * len(lines)
    return (*stats, failed, not failed and not bad)


ODD = ["", None, " \n\t", "a", "word " * 30, "é x y z " * 3, "- one two\n- three four\n* five six seven\n• eight nine ten", "# $ % " * 9, "ab cd ef gh ij kl mn op qr st\n" * 2, "so it goes...\nand goes…\nand on and on it goes, as ever", "1 2 3 4 5 6 7 8 9 10 11 12", "x\r\nx\r\nx\n\ny z", "w" * 200 + " a b c d e f g h i j"]


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(("tree", "house", "a", "1", "#", "é", "-\n", "go...\n", "line of words here\n")) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["long " + " ".join(str(rng.randrange(10**6)) + "x" for _ in range(50_000))]
    rows = [(i % 150 if i % 7 else None, t, "words", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int").repartition(3)
    out = quality_rules(docs, stats=STATS).collect()
    want = sorted(((i, *brute(t)) for i, t, _, _ in rows if t is None or len(t) < 10**5), key=str)
    assert sorted((tuple(r)[:-1] for r in out if r.n_words < 50_000), key=str) == want
    assert sum(r.n_words >= 50_000 for r in out) == 1
    assert all((r.rejected_by is None) == r.kept for r in out)


def test_order_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [r.name for r in RULES]
    one, two = (sorted((r.doc_id, r.kept, r.base_failed) for r in quality_rules(docs, order=o).collect()) for o in (names, names[::-1]))
    assert one == two
    assert 0 < sum(not kept for _, kept, _ in one) < len(one)
    with pytest.raises(ValueError):
        quality_rules(docs, order=names[1:])


def test_later_rules_are_not_asked():
    from tensorloom.llm import quality

    of = quality.Features(b"few")
    assert next(r.name for r in RULES if r.rejects(of)) == "few_words"
    assert set(of.found) == {"words", "n_words"}


def test_most_rejections_per_second_come_first():
    # "slow" rejects twice as much at ten times the cost; "shares" is free once "slow" has run.
    asked = {"slow": {"s"}, "cheap": {"c"}, "shares": {"s"}}
    seconds = {"s": 10.0, "c": 1.0}
    sample = [Sampled({"slow"}, asked, seconds)] * 4 + [Sampled({"slow", "cheap"}, asked, seconds)] * 2 + [Sampled({"shares"}, asked, seconds)] + [Sampled(set(), asked, seconds)] * 3
    order = cascade_order(sample, ["shares", "slow", "cheap"])
    assert [e.rule for e in order] == ["cheap", "slow", "shares"]
    assert [(e.reached, e.rejected, e.seconds) for e in order] == [(10, 0.2, 1.0), (8, 0.5, 10.0), (4, 0.25, 0.0)]
    # Greedy is within a factor of the best; here it is the best of all orders.
    from itertools import permutations

    def total(names):
        out = 0
        for s in sample:
            made = set()
            for n in names:
                out += sum(seconds[f] for f in asked[n] - made)
                made |= asked[n]
                if n in s.rejected:
                    break
        return out

    assert total([e.rule for e in order]) == min(map(total, permutations(asked)))


def test_the_sample_is_bounded_and_its_plan_names_every_rule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = plan_cascade(docs, sample=50)
    assert sorted(e.rule for e in plan) == sorted(r.name for r in RULES)
    assert 10 < plan[0].reached <= 200
    assert all(a.reached >= b.reached for a, b in zip(plan, plan[1:]))
    assert plan_cascade(docs.limit(0))[0].reached == 0


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string"), stats=STATS).count() == 0


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(OP11_SQL)
    names = rel.columns
    out = quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), stats=STATS).select(*names)
    assert sorted(map(tuple, out.collect())) == sorted(rel.fetchall())


def test_try_all_asks_each_rule_by_itself():
    s = try_all(b"too few", RULES)
    assert "few_words" in s.rejected
    assert s.asked["few_words"] == {"words", "n_words"} and s.seconds.keys() >= {"words", "lines"}
