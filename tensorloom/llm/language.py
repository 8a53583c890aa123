"""Language ID: a linear-chain conditional random field over words."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import offsets_of, table, text_chunks

#: Most letters of a word; a longer run of letters is cut into words of so many.
WIDTH = 24
#: A run of letters and the marks on them, with a letter at least.
RUN = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
#: Words in one training sequence of the field, and in a stretch of a text that is labelled at a time, with the
#: messages that the stretches beside it pass on.
SPAN = 64
#: Words times labels of stretches that are labelled together.
CELLS = 1 << 18


def words_of(text: str) -> list[str]:
    """Lower-cased words of a text, in order."""
    runs = RUN.findall(text.lower())
    if max(map(len, runs), default=0) <= WIDTH:
        return runs
    return [r[k : k + WIDTH] for r in runs for k in range(0, len(r), WIDTH)]


def word_features(words: list[str], lexicon: dict[str, int], buckets: int) -> np.ndarray:
    """Hashed features of each word, one row: affixes of 1-3 letters, 2- and 3-grams, lexicon entry. 0 pads."""
    n = len(words)
    letters = np.array(words, dtype=f"<U{WIDTH}").view(np.uint32).reshape(n, WIDTH).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    framed = np.zeros((n, WIDTH + 2), np.uint64)  # 1 before a word, 2 after it
    framed[:, 0] = 1
    framed[:, 1:-1] = letters
    framed[np.arange(n), size + 1] = 2
    k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    last = size + 1

    def gram(*cols):
        h = np.full(n if cols[0].ndim == 1 else cols[0].shape, len(cols), np.uint64)
        for c in cols:
            h = (h ^ c) * k1
            h ^= h >> np.uint64(29)
        return h

    r = np.arange(n)
    at = lambda back: framed[r, np.maximum(last - back, 0)]
    out = [gram(framed[:, 1]) * k2, gram(at(1)) * k1]  # first and last letter
    out += [gram(framed[:, 0], framed[:, 1], framed[:, 2]), gram(framed[:, 1], framed[:, 2], framed[:, 3]) * k2, gram(at(3), at(2), at(1)) * k1]
    lex = np.fromiter((lexicon.get(w, 0) for w in words), np.uint64, n)
    out.append(gram(lex) ^ k2)
    fixed = (np.stack(out, 1) >> np.uint64(40)) % np.uint64(buckets - 1) + np.uint64(1)
    longest = int(size.max(initial=1))
    two = gram(framed[:, : longest + 1], framed[:, 1 : longest + 2])
    three = gram(framed[:, :longest], framed[:, 1 : longest + 1], framed[:, 2 : longest + 2])
    cols = np.arange(longest + 1)
    two = np.where(cols <= size[:, None], (two >> np.uint64(40)) % np.uint64(buckets - 1) + np.uint64(1), np.uint64(0))
    three = np.where(cols[:-1] < size[:, None], (three >> np.uint64(40)) % np.uint64(buckets - 1) + np.uint64(1), np.uint64(0))
    return np.concatenate([fixed, two, three], 1).astype(np.int64)


def forward_backward(emit: np.ndarray, trans: np.ndarray, real: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals, sums of pair marginals, log partition) of sequences: emit (n, t, labels), real (n, t) with padding last.

    Where sequences are stretches of a longer chain, ``before`` holds the forward message into
    each one's first word and ``after`` the backward message at its last word, both up to a factor.
    """
    n, t, k = emit.shape
    top = emit.max(2, keepdims=True)
    e = np.exp(emit - top)
    e[~real] = 1.0
    m = np.exp(trans)
    alpha, beta, scale = np.empty((n, t, k)), np.ones((n, t, k)), np.ones((n, t))
    for i in range(t):
        a = (alpha[:, i - 1] @ m) * e[:, i] if i else e[:, i] if before is None else before * e[:, i]
        s = a.sum(1)
        a = a / s[:, None]
        if i:
            a = np.where(real[:, i, None], a, alpha[:, i - 1])
            s = np.where(real[:, i], s, 1.0)
        alpha[:, i], scale[:, i] = a, s
    last = np.ones((n, k)) if after is None else after
    beta[:, t - 1] = last
    for i in range(t - 2, -1, -1):
        b = ((beta[:, i + 1] * e[:, i + 1]) @ m.T) / scale[:, i + 1, None]
        beta[:, i] = np.where(real[:, i + 1, None], b, last)
    marginal = alpha * beta
    marginal /= marginal.sum(2, keepdims=True)
    pairs = np.einsum("nta,ntb->ab", alpha[:, :-1] * real[:, 1:, None] / scale[:, 1:, None], beta[:, 1:] * e[:, 1:]) * m if t > 1 else np.zeros((k, k))
    return marginal, pairs, float((np.log(scale) + top[:, :, 0])[real].sum())


@dataclass
class WordField:
    """A trained field: labels, feature weights, transitions and lexicon (all of bounded size)."""

    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        for k in range(0, len(words), 8192):
            out[k : k + 8192] = self.weights[word_features(words[k : k + 8192], self.lexicon, len(self.weights))].sum(1)
        return out


def train_field(samples: list[tuple[str, str]], buckets: int = 1 << 16, rounds: int = 4, rate: float = 0.1, seed: int = 0) -> WordField:
    """Fit a field to (text, language) samples. A quarter of the sequences switch to another language's words midway."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in samples})
    index = {x: k for k, x in enumerate(labels)}
    seen: dict[str, Counter] = {}
    sequences = []
    for text, lang in samples:
        words = words_of(text)
        for w in words:
            seen.setdefault(w, Counter())[index[lang]] += 1
        sequences += [(words[k : k + SPAN], index[lang]) for k in range(0, len(words), SPAN)]
    # A word's entry tells in which languages it is common: its code is that set of languages.
    masks: dict[frozenset, int] = {}
    lexicon = {}
    for w, c in seen.items():
        if (total := c.total()) > 1:
            lexicon[w] = 1 + masks.setdefault(frozenset(k for k, x in c.items() if x * 4 > total), len(masks))
    types = list(seen)
    number = {w: k for k, w in enumerate(types)}
    features = np.concatenate([np.pad(f, ((0, 0), (0, 6 + 2 * WIDTH + 1 - f.shape[1]))) for f in (word_features(types[k : k + 8192], lexicon, buckets) for k in range(0, len(types), 8192))]) if types else np.zeros((0, 1), np.int64)
    ids = [np.array([number[w] for w in words]) for words, _ in sequences]
    gold = [np.full(len(i), lang) for i, (_, lang) in zip(ids, sequences, strict=True)]
    for k in np.flatnonzero(rng.random(len(ids)) < 0.25):
        other = int(rng.integers(len(ids)))
        cut, keep = int(rng.integers(1, len(ids[k]) + 1)), int(rng.integers(1, len(ids[other]) + 1))
        ids[k] = np.concatenate([ids[k][:cut], ids[other][:keep]])[:SPAN]
        gold[k] = np.concatenate([gold[k][:cut], gold[other][:keep]])[:SPAN]
    weights, trans = np.zeros((buckets, len(labels))), np.zeros((len(labels), len(labels)))
    square, square_t = np.full(weights.shape, 1e-2), np.full(trans.shape, 1e-2)
    for _ in range(rounds):
        order = rng.permutation(len(ids))
        for low in range(0, len(order), 128):
            batch = [k for k in order[low : low + 128] if len(ids[k])]
            if not batch:
                continue
            sizes = np.array([len(ids[k]) for k in batch])
            real = np.arange(sizes.max()) < sizes[:, None]
            flat, want = np.concatenate([ids[k] for k in batch]), np.concatenate([gold[k] for k in batch])
            kinds, of = np.unique(flat, return_inverse=True)
            emit = np.zeros((*real.shape, len(labels)))
            emit[real] = weights[features[kinds]].sum(1)[of]
            marginal, pairs, _ = forward_backward(emit, trans, real)
            wrong = marginal[real]
            wrong[np.arange(len(want)), want] -= 1
            slope = np.zeros((len(kinds), len(labels)))
            np.add.at(slope, of, wrong)
            # Only the rows of features that the batch has; 0 pads.
            rows, place = np.unique(features[kinds], return_inverse=True)
            full = np.zeros((len(rows), len(labels)))
            np.add.at(full, place.reshape(len(kinds), -1), slope[:, None, :])
            full[rows == 0] = 0
            square[rows] += full * full
            weights[rows] -= rate * full / np.sqrt(square[rows])
            tags = np.zeros(real.shape, np.int64)
            tags[real] = want
            both = real[:, 1:]
            np.add.at(pairs, (tags[:, :-1][both], tags[:, 1:][both]), -1)
            square_t += pairs * pairs
            trans -= rate * pairs / np.sqrt(square_t)
    return WordField(labels, weights.astype(np.float32), trans, lexicon)


def thinned(text: str, most_chars: int) -> str:
    """A text of up to most_chars characters as it is; of a longer one, runs of SPAN words at even steps over all of it, of so many in all."""
    if len(text) <= most_chars:
        return text
    words = words_of(text)
    runs = [" ".join(words[k : k + SPAN]) for k in range(0, len(words), SPAN)]
    return " ".join(runs[:: -(-sum(map(len, runs)) // most_chars) or 1])


def training_sample(docs: DataFrame, for_each: int, most_chars: int) -> list[tuple[str, str]]:
    """Up to for_each texts of each language, chosen by a hash of id; fewer with over 64 languages, so that their sum stays.

    At most 64 * for_each texts of some most_chars characters come to the driver; of a longer text
    words from all over it do.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("_all")).collect()
    if not sizes:
        return []
    each = max(1, min(for_each, 64 * for_each // len(sizes)))
    # Twice the share of ids, so that a language hardly ever gives less than it should.
    shares = docs.sparkSession.createDataFrame([(r["lang"], 2 * each / r["_all"] + 1e-6) for r in sizes], "lang string, _share double")
    point = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(shares), "lang").where(point < F.col("_share"))
    first = Window.partitionBy("lang").orderBy(point, "doc_id", F.xxhash64("text"))
    chosen = chosen.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= each).select("text", "lang", "doc_id")

    def run(batches):
        for batch in batches:
            texts = [thinned(t, most_chars) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1), batch.column(2)], ["text", "lang", "doc_id"])

    rows = chosen.mapInArrow(run, chosen.schema).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"]))]


class Labeller:
    """Labels texts by a field in one task, remembering the emissions of words it has seen."""

    CACHE = 50_000

    class Numbers(dict):
        """Word to a number; the first sight of a word gives the next one."""

        def __missing__(self, word):
            n = self[word] = len(self)
            return n

    def __init__(self, field: WordField):
        self.field, self.known = field, self.Numbers()
        self.emit = np.zeros((0, len(field.labels)))
        self.likely = self.emit  # exp of the emissions, 1 for a word's best label
        self.names = np.array([*field.labels, UNKNOWN], dtype=object)

    def __call__(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, words) of each text."""
        if len(self.known) > self.CACHE:
            self.known, self.emit, self.likely = self.Numbers(), self.emit[:0], self.likely[:0]
        before = len(self.known)
        numbers = [np.fromiter(map(self.known.__getitem__, words_of(t.decode())), np.int64) for t in texts]
        if len(self.known) > before:
            new = self.field.emissions(list(self.known)[before:])
            self.emit = np.concatenate([self.emit, new])
            self.likely = np.concatenate([self.likely, np.exp(new - new.max(1, keepdims=True))])
        sizes = np.array([len(x) for x in numbers], np.int64)
        flat = np.concatenate(numbers) if len(numbers) else np.zeros(0, np.int64)
        begin, labels = offsets_of(sizes)[:-1], len(self.field.labels)
        # Stretches of SPAN words; the last of a text may be shorter.
        parts = -(-sizes // SPAN)
        owner = np.repeat(np.arange(len(sizes)), parts)
        first = (np.arange(len(owner)) - offsets_of(parts)[:-1][owner]) * SPAN
        length = np.minimum(SPAN, sizes[owner] - first)
        into, after = self._messages(flat, begin, sizes, parts)
        total = np.zeros((len(sizes), labels))
        for low in range(0, len(owner), step := max(1, CELLS // (SPAN * labels))):
            b, n = (begin[owner] + first)[low : low + step], length[low : low + step]
            real = np.arange(int(n.max())) < n[:, None]
            at = np.minimum(b[:, None] + np.arange(int(n.max())), len(flat) - 1)
            marginal, _, _ = forward_backward(self.emit[flat[at]], self.field.trans, real, into[low : low + step], after[low : low + step])
            np.add.at(total, owner[low : low + step], (marginal * real[:, :, None]).sum(1))
        best = total.argmax(1)
        none = sizes == 0
        score = np.clip(np.where(none, 0.0, total[np.arange(len(sizes)), best] / np.maximum(sizes, 1)), 0, 1)
        return self.names[np.where(none, len(self.field.labels), best)].tolist(), score, sizes

    def _messages(self, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(into, after): forward messages into the first word of each stretch and backward ones at its last, up to a factor.

        All texts go through their words in step, from the first word on and from the last word
        back; only what passes from one stretch to another is kept.
        """
        into, after = (np.ones((int(parts.sum()), len(self.field.labels))) for _ in range(2))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > SPAN]
        if not len(order):
            return into, after
        size, start, stretch = sizes[order], begin[order], offsets_of(parts)[:-1][order]
        left = np.searchsorted(-size, -np.arange(size[0] + 1), "left")  # texts with more words than so many
        m, back = np.exp(self.field.trans), np.exp(self.field.trans).T.copy()
        a = b = np.ones((len(order), len(self.field.labels)))
        # The last word of a text is the first of a stretch after so many steps back, and every SPAN steps from there.
        residue = (size - 1) % SPAN
        turn = [np.flatnonzero(residue == r) for r in range(SPAN)]
        for i in range(int(size[0])):
            n = left[i]
            a = (a[:n] * self.likely[flat[start[:n] + i]]) @ m
            b = (b[:n] * self.likely[flat[start[:n] + size[:n] - 1 - i]]) @ back
            if i % 8 == 7:
                a /= a.sum(1, keepdims=True)
                b /= b.sum(1, keepdims=True)
            if (i + 1) % SPAN == 0 and (k := left[i + 1]):
                into[stretch[:k] + (i + 1) // SPAN] = a[:k]
            here = turn[i % SPAN]
            here = here[: np.searchsorted(here, left[i + 1])]
            if len(here):
                after[stretch[here] + (size[here] - 1 - i) // SPAN - 1] = b[here]
        return into, after


def label_texts(docs: DataFrame, field: WordField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words): the language with most posterior weight over the words of each whole text."""

    def run(batches):
        label = Labeller(field)
        for ids, texts in text_chunks(batches, max_bytes=2 << 20):
            names, score, sizes = label(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(score), pa.array(sizes)], ["doc_id", "lang_pred", "score", "n_words"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long")


def with_known_language(docs: DataFrame, field: WordField, least_score: float = 0.35, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text has no letter or whose best language scores less; all columns, no shuffle.

    A null text has no letter. Rows stand alone, so repeated rows and ties change nothing; a very long
    text is labelled whole. An empty table gives an empty one.
    """
    number = docs.columns.index(text_col)

    def run(batches):
        label = Labeller(field)
        for batch in batches:
            done = 0
            for _, texts in text_chunks([pa.RecordBatch.from_arrays([batch.column(number)] * 2, ["a", "b"])], max_bytes=1 << 20):
                names, score, _ = label(texts)
                keep = pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, score.tolist(), strict=True)], pa.bool_())
                # A chunk at a time: a whole batch is not copied once more.
                yield batch.slice(done, len(texts)).filter(keep)
                done += len(texts)

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """Whether crc32 of the id as text is a multiple of folds; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def fit_language(docs: DataFrame, for_each: int = 300, most_chars: int = 4_000) -> WordField:
    """Train on documents that are not held out: up to ``for_each`` of each language."""
    return train_field(training_sample(docs.select("doc_id", "text", "lang").where(~held_out()), for_each, most_chars))


def identify_language(docs: DataFrame, for_each: int = 300, most_chars: int = 4_000) -> DataFrame:
    """Predict the language of each whole text, after training on those that are not held out.

    A linear-chain conditional random field labels the words (runs of letters and marks, lower
    case): its emissions sum weights of hashed affixes, letter n-grams and lexicon entries, its
    transitions are learned, and forward-backward over the whole text gives each word's posterior;
    texts are worked through in stretches of 64 words that pass their messages on. The mean
    of the posteriors over a text is its score. Training sees up to ``for_each`` texts of each
    language (64 times as many in all), and only their text and language; of a text of over
    ``most_chars`` characters it sees words from all over it. A quarter of its sequences switch
    language.

    A text that is null, empty or without a letter is "und" with score 0, and so is each text if
    there is nothing to learn from. Of equally good languages the first by name is taken. Repeated
    rows get equal predictions; an empty table gives an empty result; further columns are not read.

    Returns doc_id, held_out, lang_pred, score.
    """
    field = fit_language(docs, for_each, most_chars)
    if not field.labels:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return label_texts(docs, field).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
