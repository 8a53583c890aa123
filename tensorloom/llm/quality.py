"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import table, text_chunks

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
#: All but spaces, ASCII letters and the bytes of other characters.
NO_LETTER = bytes(b for b in range(0x80) if not chr(b).isalpha() and b not in SPACE)
WINDOW = 5


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of so many words that the text holds twice or more."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(ids) <= window or len(number) == len(ids):
        return 0
    # Windows get exact numbers word by word: equal numbers mean equal words.
    key = ids
    for k in range(1, window):
        key = key[:-1] * len(number) + ids[k:]
        if k < window - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[where] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def _lines(of: Features) -> list[bytes]:
    return [line for line in of.text.split(b"\n") if line.strip()]


#: What rules look at, each made at most once for a text and only when it is asked for.
FEATURES: dict[str, Callable[[Features], object]] = {
    "words": lambda of: of.text.split(),
    "n_words": lambda of: len(of["words"]),
    "word_chars": lambda of: len(of.text.translate(None, SPACE + CONTINUATION)),
    "n_symbols": lambda of: len(of.text) - len(of.text.translate(None, SYMBOLS)),
    "lines": _lines,
    "n_lines": lambda of: len(of["lines"]),
    "n_dup_lines": lambda of: len(of["lines"]) - len(set(of["lines"])),
    "n_bullets": lambda of: sum(line.lstrip().startswith((b"-", b"*", "•".encode())) for line in of["lines"]),
    "n_ellipses": lambda of: sum(line.rstrip().endswith((b"...", "…".encode())) for line in of["lines"]),
    "n_letter_words": lambda of: len(of.text.translate(None, NO_LETTER).split()),
    "n_repeat_words": lambda of: repeated_words(of["words"]),
}


class Features:
    """The features of one text, with the seconds that each took (without those it is made from)."""

    def __init__(self, text: bytes):
        self.text, self.found, self.seconds = text, {}, {}
        self._inner = 0.0

    def __getitem__(self, name: str):
        if name not in self.found:
            outer, self._inner, start = self._inner, 0.0, time.perf_counter()
            self.found[name] = FEATURES[name](self)
            took = time.perf_counter() - start
            self.seconds[name] = took - self._inner
            self._inner = outer + took
        return self.found[name]


@dataclass(frozen=True)
class Rule:
    """A text goes if ``rejects`` holds for its features. ``base`` rules set base_failed."""

    name: str
    rejects: Callable[[Features], bool]
    base: bool = False


#: Whole numbers only, so that SQL says the same.
RULES = (
    Rule("few_words", lambda of: of["n_words"] < 10, True),
    Rule("repeated_windows", lambda of: 100 * of["n_repeat_words"] > 20 * of["n_words"], True),
    Rule("word_length", lambda of: not 2 * of["n_words"] <= of["word_chars"] <= 15 * of["n_words"]),
    Rule("symbols", lambda of: 4 * of["n_symbols"] > of["n_words"]),
    Rule("repeated_lines", lambda of: 100 * of["n_dup_lines"] > 50 * of["n_lines"]),
    Rule("no_letters", lambda of: 100 * of["n_letter_words"] < 60 * of["n_words"]),
    Rule("bullets", lambda of: 100 * of["n_bullets"] > 90 * of["n_lines"]),
    Rule("ellipses", lambda of: 100 * of["n_ellipses"] > 30 * of["n_lines"]),
)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Estimate:
    """A place in the cascade: of the sampled texts that come to this rule, the share it rejects, and its seconds for each."""

    rule: str
    reached: int
    rejected: float
    seconds: float


@dataclass
class Sampled:
    """One sampled text: the rules that reject it, what each rule looked at, and the seconds of every feature."""

    rejected: set[str]
    asked: dict[str, set[str]]
    seconds: dict[str, float] = field(default_factory=dict)


def try_all(text: bytes, rules: Iterable[Rule]) -> Sampled:
    """Every rule by itself, without a short cut. A feature costs what it took when first made."""
    out = Sampled(set(), {})
    for rule in rules:
        of = Features(text)
        if rule.rejects(of):
            out.rejected.add(rule.name)
        out.asked[rule.name] = set(of.found)
        for name, took in of.seconds.items():
            out.seconds.setdefault(name, took)
    return out


def cascade_order(sample: Sequence[Sampled], names: Sequence[str]) -> list[Estimate]:
    """Greedy order: of the sampled texts still alive, most rejections per second first.

    Rules share features, so a rule costs only what the rules before it have not made already. Both
    figures are taken again for each place, over the texts that would come to it. With equal
    figures, or no text left, the order of names stands.
    """
    alive, left, order = list(sample), list(names), []
    made: list[set[str]] = [set() for _ in sample]
    while left:
        best = None
        for name in left:
            gone = sum(name in s.rejected for s in alive)
            cost = sum(s.seconds[f] for s, m in zip(alive, made, strict=True) for f in s.asked[name] - m)
            rate = gone / max(cost, 1e-9)
            if best is None or rate > best[0]:
                best = rate, name, gone, cost
        _, name, gone, cost = best
        order.append(Estimate(name, len(alive), gone / max(len(alive), 1), cost / max(len(alive), 1)))
        left.remove(name)
        stay = [(s, m | s.asked[name]) for s, m in zip(alive, made, strict=True) if name not in s.rejected]
        alive, made = [s for s, _ in stay], [m for _, m in stay]
    return order


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000) -> list[Estimate]:
    """Estimates of each rule on some ``sample`` documents, in the order in which they should run.

    Documents are chosen by a hash of id and text, all over the table; tasks try every rule on
    them and send what they took to the driver (figures, not texts). The order decides what a run
    costs, never what it keeps. The choice reads ids and texts once.
    """
    n = docs.count()
    chosen = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    if n > sample:
        chosen = chosen.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) < sample)

    def run(batches):
        for _, texts in text_chunks(batches):
            tried = [try_all(t, rules) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sorted(t.rejected) for t in tried], pa.list_(pa.string())),
                    pa.array([list({k: sorted(v) for k, v in t.asked.items()}.items()) for t in tried], pa.map_(pa.string(), pa.list_(pa.string()))),
                    pa.array([list(t.seconds.items()) for t in tried], pa.map_(pa.string(), pa.float64())),
                ],
                ["rejected", "asked", "seconds"],
            )

    rows = chosen.mapInArrow(run, "rejected array<string>, asked map<string, array<string>>, seconds map<string, double>").limit(4 * sample).collect()
    tried = [Sampled(set(r.rejected), {k: set(v) for k, v in r.asked.items()}, r.seconds) for r in rows]
    return cascade_order(tried, [r.name for r in rules])


def quality_rules(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    order: Sequence[str] | None = None,
    stats: Sequence[str] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Hold every whole text against the rules, cheapest rejections first; the first that rejects it ends its cascade.

    ``order`` names the rules in the order to run them; without it a sample decides
    (``plan_cascade``). A document stays if no rule rejects it, so the order never changes
    ``kept``; ``rejected_by`` is the rule that came first. ``stats`` are features to return for
    all documents: those that the cascade has not made are made after it, so without stats only
    what the cascade asks for is ever computed.

    A null text counts as empty; a text of any length is one unit of work. Rows stand alone, so ties,
    repeated rows and null ids (returned as null) change nothing; further columns are not read;
    an empty table gives an empty one.

    Returns doc_id, the stats, base_failed (a base rule rejects it), kept and rejected_by.
    """
    if order is None:
        order = [e.rule for e in plan_cascade(docs, rules, id_col, text_col)]
    by_name = {r.name: r for r in rules}
    if sorted(order) != sorted(by_name):
        raise ValueError("order must name every rule once")
    cascade, base = [by_name[n] for n in order], [r for r in rules if r.base]

    def run(batches):
        for ids, texts in text_chunks(batches):
            made: list[list] = [[] for _ in range(len(stats) + 2)]
            for text in texts:
                of = Features(text)
                by = next((r.name for r in cascade if r.rejects(of)), None)
                failed = by is not None and (by_name[by].base or any(r.rejects(of) for r in base))
                for column, x in zip(made, (*(of[s] for s in stats), failed, by), strict=True):
                    column.append(x)
            kept = pa.array([by is None for by in made[-1]], pa.bool_())
            cols = [ids, *(pa.array(c, pa.int64()) for c in made[:-2]), pa.array(made[-2], pa.bool_()), kept, pa.array(made[-1], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *stats, "base_failed", "kept", "rejected_by"])

    schema = ", ".join(["doc_id long", *(f"{s} long" for s in stats), "base_failed boolean", "kept boolean", "rejected_by string"])
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, schema)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), stats=STATS).drop("rejected_by")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) i FROM d),
s AS (SELECT r, i, w, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END five
    FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w, five IS NOT NULL AND count(*) OVER (PARTITION BY r, five) > 1 twice FROM s),
m AS (SELECT r, w, max(twice::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) rep FROM c),
n AS (SELECT r, count(*) n_words, sum(length(w))::BIGINT word_chars, sum(rep)::BIGINT n_repeat_words, count(*) FILTER (regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')) letter_words FROM m GROUP BY r),
l AS (SELECT r, count(*) lines, count(*) - count(DISTINCT line) dup, count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) bullets, count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) ellipses
    FROM (SELECT r, unnest(string_split(t, chr(10))) line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0) n_words, coalesce(word_chars, 0) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words,
    coalesce(letter_words, 0) letter_words, coalesce(lines, 0) lines, coalesce(bullets, 0) bullets, coalesce(ellipses, 0) ellipses FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 4 * n_symbols > n_words
        OR 100 * n_dup_lines > 50 * lines OR 100 * letter_words < 60 * n_words OR 100 * bullets > 90 * lines OR 100 * ellipses > 30 * lines) AS kept
FROM a
"""
