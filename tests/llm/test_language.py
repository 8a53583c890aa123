import itertools
import zlib

import numpy as np

from tensorloom.llm import language
from tensorloom.llm.language import Labeller, forward_backward, identify_language, label_texts, train_field, word_features, words_of

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    real = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    marginal, pairs, logz = forward_backward(emit, trans, real)
    want_pairs, want_z = np.zeros((3, 3)), 0.0
    for s in range(3):
        t = int(real[s].sum())
        paths = list(itertools.product(range(3), repeat=t))
        w = np.exp([sum(emit[s, i, p[i]] for i in range(t)) + sum(trans[p[i], p[i + 1]] for i in range(t - 1)) for p in paths])
        want_z += np.log(w.sum())
        w /= w.sum()
        for p, x in zip(paths, w):
            for i in range(t - 1):
                want_pairs[p[i], p[i + 1]] += x
        for i in range(t):
            for k in range(3):
                assert np.isclose(marginal[s, i, k], sum(x for p, x in zip(paths, w) if p[i] == k))
    assert np.allclose(pairs, want_pairs) and np.isclose(logz, want_z)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    out = identify_language(docs, for_each=60).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(out) == docs.count()
    test = [r for r in out if r.held_out and any(c.isalpha() for c in r.text)]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.lang_pred == r.lang for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_edge_rows_and_switching(spark):
    samples = [("der die das und nicht ein", "de"), ("the of and to in is", "en")] * 50
    field = train_field(samples)
    rows = [(1, None), (2, ""), (3, "12 _ %%"), (None, "und nicht das"), (4, "the of " * 30_000), (5, "the and of is " * 9 + "und die der das " * 8), (5, "the")]
    out = label_texts(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()
    got = {(r.doc_id, r.n_words): (r.lang_pred, r.score) for r in out}
    assert [got[k, 0] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[None, 3][0] == "de" and got[4, 60_000][0] == "en" and got[5, 1][0] == "en"
    assert got[5, 68][0] == "en" and 0.45 < got[5, 68][1] < 0.6
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "CAST(NULL AS STRING) AS lang", "1 AS score")
    assert {(r.lang_pred, r.score) for r in identify_language(docs).collect()} == {("und", 0.0)}
    assert identify_language(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    """70 languages, of which one has long texts only: each gets its own documents."""
    rng = np.random.default_rng(3)
    letters = [chr(0x0531 + k) for k in range(38)] + [chr(0x10D0 + k) for k in range(33)]
    words = {f"l{k}": ["".join(rng.choice(letters, 5)) for _ in range(6)] for k in range(70)}
    rows = [(100 * k + n, " ".join(rng.choice(w, 4000 if k == 69 else 12)), lang) for k, (lang, w) in enumerate(words.items()) for n in range(12)]
    out = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), for_each=10).collect()
    right = [r.lang_pred == f"l{r.doc_id // 100}" for r in out]
    assert {r.lang_pred for r in out} == set(words) and sum(right) > 0.95 * len(right)
    assert all(r.lang_pred == "l69" for r in out if r.doc_id >= 6900)


def test_every_letter_of_a_long_run_counts(spark):
    field = train_field([("undder dasund derdas undundund", "de"), ("theof ofthe thethe oftheof", "en")] * 50)
    rows = [(1, "und" * 8 + "the" * 6000 + "und" * 8), (2, "the" * 8 + "und" * 6000 + "the" * 8)]
    out = {r.doc_id: r for r in label_texts(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    assert out[1].lang_pred == "en" and out[2].lang_pred == "de"
    assert out[1].n_words == out[2].n_words == 752


def test_words_and_texts_without_a_letter(spark):
    assert words_of("Été, हिन्दी x²3 ½ _a_ \u0301") == ["été", "हिन्दी", "x", "a"]
    docs = [(k, t) for k, t in enumerate(["½", "² ①", "Ⅷ", "\u0301\u0302", "هذا"])]
    field = train_field([("der die das", "de"), ("the of and", "en")] * 20)
    out = {r.doc_id: r for r in label_texts(spark.createDataFrame(docs, "doc_id long, text string"), field).collect()}
    assert [(out[k].lang_pred, out[k].n_words) for k in range(4)] == [("und", 0)] * 4 and out[4].n_words == 1


def test_stretches_give_what_the_whole_chain_gives(monkeypatch):
    field = train_field([("der die das und nicht ein", "de"), ("the of and to in is", "en")] * 50)
    text = ("the and of das und the nicht to die der " * 40).encode()
    texts = [text, b"das", b"", text[:500], text[3:1400], text[: len(text) // 2], b"the of and das nicht und in"]

    def score(text):
        words = words_of(text.decode())
        return forward_backward(field.emissions(words)[None], field.trans, np.ones((1, len(words)), bool))[0][0].mean(0).max() if words else 0

    want = [score(t) for t in texts]
    for span in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(language, "SPAN", span)
        assert np.allclose(Labeller(field)(texts)[1], want)


def test_features_and_a_training_step_against_plain_ones():
    """Equal words have equal features, places of features follow the word alone; one step of training by finite differences."""
    rows = word_features(["haus", "maus", "haus", "ab"], {"haus": 3}, 1 << 16)
    assert (rows[0] == rows[2]).all() and (rows[:, 6:][3] > 0).sum() < (rows[:, 6:][0] > 0).sum()
    shared = lambda a, b: len((set(rows[a]) & set(rows[b])) - {0})
    assert shared(0, 1) >= 6 and shared(0, 3) <= 1 and rows[0, 5] != rows[1, 5]
    rng = np.random.default_rng(5)
    emit, trans = rng.normal(size=(1, 6, 3)), rng.normal(size=(3, 3))
    real, gold = np.ones((1, 6), bool), rng.integers(0, 3, 6)

    def loss(e, t):
        _, _, z = forward_backward(e, t, real)
        return z - sum(e[0, i, gold[i]] for i in range(6)) - sum(t[gold[i], gold[i + 1]] for i in range(5))

    marginal, pairs, _ = forward_backward(emit, trans, real)
    slope = marginal[0].copy()
    slope[np.arange(6), gold] -= 1
    for i, k in ((0, 0), (2, 1), (5, 2)):
        step = np.zeros_like(emit)
        step[0, i, k] = 1e-5
        assert np.isclose(slope[i, k], (loss(emit + step, trans) - loss(emit - step, trans)) / 2e-5, atol=1e-6)
    np.add.at(pairs, (gold[:-1], gold[1:]), -1)
    for a, b in ((0, 1), (2, 2)):
        step = np.zeros_like(trans)
        step[a, b] = 1e-5
        assert np.isclose(pairs[a, b], (loss(emit, trans + step) - loss(emit, trans - step)) / 2e-5, atol=1e-6)


def test_rows_leave_the_language_stage_chunk_by_chunk():
    """A batch isn't copied whole: what is yielded at a time has 2 MB of text or so."""
    import pyarrow as pa

    from tensorloom.llm import language

    class Docs:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, schema):
            return run

    field = language.train_field([("the cat sat on the mat with the hat " * 9, "en"), ("der hund lag auf dem boden mit dem ball " * 9, "de")])
    texts = ["the cat sat on the mat " * 2000, "12 34", None] * 60
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = list(language.with_known_language(Docs(), field)([batch]))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(0, len(texts), 3))
    assert len(out) > 1 and max(sum(map(len, b.column(1).to_pylist())) for b in out) <= 2 << 20
