import hashlib
import random

import corpus_pipeline
from test_bpe import FILE, PATTERN
from test_decontaminate import semi_global
from test_line_dedup import brute as brute_lines
from test_simhash import brute_components

from tensorloom.llm.bpe import ByteBPE
from tensorloom.llm.decontaminate import normal
from tensorloom.llm.language import UNKNOWN, fit_language, label_texts
from tensorloom.llm.near_copies import shingle_set
from tensorloom.llm.simhash import fingerprint, one_of_each_group

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage is held against a plain version over its own input."""
    small = spark.read.parquet(f"{SF}/documents.parquet").where("char_length(text) < 700").collect()
    passages = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage, rng = passages[0], random.Random(1)
    edited = list(max(passages, key=len))
    for k in rng.sample(range(len(edited)), len(edited) // 25):
        edited[k] = "q"
    # Texts of 100 words; of those with two words changed 0.81 of the shingles are common, with three 0.73.
    english = [r.text for r in small if r.lang == "en"]
    words = list(dict.fromkeys(" ".join(english).split()))[:100]
    changed = lambda *at: " ".join("other" if k in at else w for k, w in enumerate(words))
    planted = {5000: f"{small[1].text} {passage}", 5001: "12 %", 5002: f"{english[0]} {''.join(edited)}", 6000: changed(), 6001: changed(20, 45), 6002: changed(10, 35, 70)}
    planted |= {7000: "the one\nthe two of them here\n\n\nthe one", 7001: "the one\nand for this that with are"}
    small += [small[0].asDict() | {"doc_id": i, "text": t, "lang": "en"} for i, t in planted.items()]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame([tuple(r[c] for c in schema.names) if isinstance(r, dict) else tuple(r) for r in small], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    SF_DIR = str(tmp_path)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        steps[name] = (text(docs), out)
        if name != "tokens":
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    before, out = steps["language"]
    field = fit_language(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    labels = {r.doc_id: r for r in label_texts(spark.read.parquet(f"{SF_DIR}/documents.parquet"), field).collect()}
    assert set(text(out)) == {i for i, r in labels.items() if r.lang_pred != UNKNOWN and r.score >= 0.35}
    before, out = steps["lines"]
    long_lines, short = brute_lines(list(before.items()), 2, 20), set()
    for i, t in sorted(long_lines.items()):  # of short lines that aren't blank the first stays
        left = []
        for line in t.split("\n"):
            if len(line) < 20 and line.strip() and line in short:
                continue
            short |= {line} if len(line) < 20 else set()
            left.append(line)
        long_lines[i] = "\n".join(left)
    assert text(out) == long_lines
    assert text(out)[7000] == "the one\nthe two of them here\n\n" and text(out)[7001] == "and for this that with are"
    assert all(r.n_chars == len(r.text) for r in out.collect())
    before, out = steps["near_copies"]
    sets = {i: set(shingle_set(t.encode(), 5).tolist()) for i, t in before.items()}
    near = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    root = brute_components(before, [(a, b) for a in before for b in before if a < b and near(a, b)])
    assert set(text(out)) == set(root.values())
    assert {6000, 6002} <= set(text(out)) and 6001 not in text(out)
    # Pairs that fingerprints within 3 bits would not link.
    fps = {i: fingerprint(t.encode(), 5) for i, t in before.items()}
    assert (fps[6000] ^ fps[6001]).bit_count() > 3
    before, out = steps["benchmark"]
    items = [normal(r.text.encode()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    gone = set(before) - set(text(out))
    assert {5000, 5002} <= gone
    assert not any(x in normal(before[5002].encode()) for x in items)  # found by its edits only
    for i in gone:
        own = normal(before[i].encode())
        assert any(x in own for x in items) or any(semi_global(x, own) <= 0.08 * len(x) for x in items)
    assert not any(x in normal(t.encode()) for t in text(out).values() for x in items)
    before, out = steps["tokens"]
    bpe = ByteBPE(FILE, PATTERN)
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(before) and all(r.ids == bpe.encode([before[r.doc_id]])[0] and r.decoded == before[r.doc_id] for r in rows)
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert run == {r.doc_id: hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in rows}


def test_one_of_each_group_edges(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (None, "a b c d e f g"), (9, "x y z"), (9, "x y z"), (None, ""), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    out = one_of_each_group(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == [("3", "A b c d e f g"), ("9", "x y z"), ("None", "")]
    assert one_of_each_group(df.limit(0)).count() == 0
