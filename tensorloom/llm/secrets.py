"""Secret scans: fixed patterns, and strings that look random to character Markov models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import stored, table

#: Fixed patterns: kind, expression, group that holds the value, its least length.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # a longer run is one match; shorter ones would be dropped
]
MODEL_KIND = "random"
#: Signs of a string that the models judge.
SIGNS = "A-Za-z0-9+/_=-"
#: Alphabets of random strings, one model each: base 16, upper case and digits, lower case and digits, both, and base 64 in two forms.
ALPHABETS = [
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
]
#: The models' characters lie in this range of ASCII codes.
FIRST_CODE, CODES = 43, 80
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _running(values: str, merge: str, zero: str) -> str:
    """SQL for the running merge of an array of ints: ``merge`` of a and x, from zero.

    Blocks of about the square root of its length are run through one by one, so that an array of
    n takes some n ** 1.5 steps and not n ** 2.
    """

    def over(array: str, start: str) -> str:
        step = f"(s, x) -> named_struct('a', {merge.format(a='s.a', x='x')}, 'out', array_append(s.out, {merge.format(a='s.a', x='x')}))"
        return f"aggregate({array}, named_struct('a', {start}, 'out', CAST(array() AS array<int>)), {step}, s -> s.out)"

    width = f"greatest(1, CAST(ceil(sqrt(size({values}))) AS INT))"
    blocks = f"transform(sequence(0, (size({values}) - 1) DIV {width}), k -> slice({values}, k * {width} + 1, {width}))"
    whole = f"transform({blocks}, k -> aggregate(k, {zero}, (a, x) -> {merge.format(a='a', x='x')}))"
    begins = f"concat(array({zero}), {over(whole, zero)})"
    return f"CASE WHEN size({values}) > 0 THEN flatten(zip_with({blocks}, slice({begins}, 1, size({blocks})), (k, b) -> {over('k', 'b')})) ELSE CAST(array() AS array<int>) END"


def _matches(text: str, pattern: str, group: int, kind: int, least: int) -> tuple[list[dict], F.Column]:
    """Columns to add, in order, and the spans of a pattern's leftmost matches, without those too short.

    What stands between matches and the matches themselves, in turn, give the offsets in code points.
    """
    p = F.lit(pattern)
    has = F.col(text).rlike(pattern)
    between, whole, value, ends = (f"{x}{kind}" for x in ("between", "whole", "value", "ends"))
    steps = [
        {
            between: F.when(has, F.split(text, pattern, -1)),
            whole: F.when(has, F.regexp_extract_all(text, p, F.lit(0))),
            value: F.when(has, F.regexp_extract_all(text, p, F.lit(group))),
        },
        {ends: F.expr(f"zip_with(slice({between}, 1, size({whole})), {whole}, (a, b) -> char_length(a) + char_length(b))")},
        {ends: F.expr(f"CASE WHEN {whole} IS NOT NULL THEN {_running(ends, '{a} + {x}', '0')} END")},
    ]
    spans = F.expr(f"""
        CASE WHEN {whole} IS NULL THEN CAST(array() AS {SPAN}) ELSE
        filter(transform(arrays_zip({ends}, {whole}, {value}),
            x -> CAST(struct(x.{ends} - char_length(x.{whole}), {kind}, x.{ends}, x.{value}) AS struct<start:int,kind:int,stop:int,value:string>)),
            x -> char_length(x.value) >= {least}) END""")
    return steps, spans


def _bigrams(samples: DataFrame) -> dict:
    """Counts of character pairs of (model, value) rows by model: at most CODES squared rows of each model come to the driver."""
    chars = samples.where("char_length(value) > 1").select("model", F.split("value", "").alias("chars"))
    pairs = chars.select("model", F.explode(F.expr("zip_with(slice(chars, 1, size(chars) - 1), slice(chars, 2, size(chars) - 1), (a, b) -> concat(a, b))")).alias("pair"))
    counted = pairs.where(F.col("pair").rlike(f"^[.{SIGNS}]{{2}}$")).groupBy("model", "pair").count().collect()
    out: dict = {}
    for r in counted:
        out.setdefault(r["model"], {})[ord(r["pair"][0]) - FIRST_CODE, ord(r["pair"][1]) - FIRST_CODE] = r["count"]
    return out


def log_ratios(random: dict, ordinary: dict, smooth: float = 1.0) -> list[int]:
    """Thousandths of log P(next | char) under the random model over that under the ordinary one."""

    def logs(counts):
        total = [0] * CODES
        for (a, _), n in counts.items():
            total[a] += n
        return lambda a, b: math.log((counts.get((a, b), 0) + smooth) / (total[a] + smooth * CODES))

    p, q = logs(random), logs(ordinary)
    return [round(1000 * (p(a, b) - q(a, b))) for a in range(CODES) for b in range(CODES)]


def drawn_strings(spark: SparkSession, each: int, length: int = 40, seed: int = 7) -> DataFrame:
    """(model, value): ``each`` strings drawn evenly from every alphabet, the same ones always."""
    kinds = F.explode(F.expr(f"sequence(0, {len(ALPHABETS) - 1})")).alias("model")
    letters = F.element_at(F.array(*map(F.lit, ALPHABETS)), F.col("model") + 1)
    pick = lambda k: F.substring(F.col("letters"), (F.pmod(F.xxhash64(F.lit(seed), "id", "model", k), F.char_length("letters")) + 1).cast("int"), F.lit(1))
    return spark.range(each).select("id", kinds).withColumn("letters", letters).select("model", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), pick), "").alias("value"))


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 16,
    least_ratio: float = 0.5,
    ordinary_docs: int = 500,
    drawn: int = 2000,
) -> DataFrame:
    """Spans of secrets in every whole text: those of the fixed patterns, and further random strings.

    Character Markov models are trained from labelled samples. Random ones, a model for each
    alphabet: ``drawn`` strings drawn evenly from it, and the values that the patterns found in
    all documents, each under the first alphabet that holds it (digits alone, and values in
    letters of one case alone, are labelled neither way). Ordinary ones, one model: runs of six or
    more signs in some ``ordinary_docs`` documents, those whose ids hash lowest, but for what a
    fixed pattern matches. A string of ``least_length`` or more signs that overlaps no fixed span
    and has a digit and a letter, or letters of both cases, becomes a span of kind "random" if its mean
    log-likelihood ratio for each transition, under the model that suits it best, is
    ``least_ratio`` nats or more.

    A null text counts as empty. Long texts are scanned whole, in steps that grow with the number
    of matches to the power of 1.5. Spans of one start stand in order of kind; equal rows have
    equal spans. Each row stands alone and further columns are not read; an empty table gives an
    empty result.

    Returns doc_id, base and spans, arrays of (start, kind, stop, value) in order of start and kind.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = []
    patterns = [*KINDS, (MODEL_KIND, f"[{SIGNS}]{{{least_length},}}", 0, least_length)]
    for k, (_, pattern, group, least) in enumerate(patterns):
        steps, spans = _matches("text", pattern, group, k, least)
        for step in steps:
            rows = rows.withColumns(step)
        found.append(spans)
    base = F.array_sort(F.concat(*found[:-1]))
    scanned = stored(rows.select("doc_id", base.alias("base"), found[-1].alias("other")))

    labelled = scanned.select(F.explode("base").alias("x")).select("x.value").where(r"value RLIKE '[0-9]' AND value RLIKE '[A-Za-z]'")
    fits = "CASE " + " ".join(f"WHEN value RLIKE '^[{x.replace('-', '')}{'-' * ('-' in x)}]+$' THEN {k}" for k, x in enumerate(ALPHABETS)) + " END"
    random = _bigrams(labelled.select(F.expr(fits).alias("model"), "value").where("model IS NOT NULL").unionByName(drawn_strings(spark, drawn)))
    share = ordinary_docs / max(1, scanned.count())
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    for _, pattern, _, _ in KINDS:
        sample = sample.withColumn("text", F.regexp_replace("text", pattern, " "))
    ordinary = _bigrams(sample.select(F.lit(0).alias("model"), F.explode(F.regexp_extract_all("text", F.lit(f"[{SIGNS}]{{6,}}"), F.lit(0))).alias("value"))).get(0, {})
    tables = [",".join(map(str, log_ratios(random[k], ordinary))) for k in sorted(random)]
    # All spans in order, the last end of a fixed one up to each, and the first start of one from each on.
    every = scanned.where("size(other) > 0").withColumn("every", F.array_sort(F.concat("base", "other")))
    last = f"transform(every, x -> CASE WHEN x.kind < {len(KINDS)} THEN x.stop ELSE 0 END)"
    first = f"reverse(transform(every, x -> CASE WHEN x.kind < {len(KINDS)} THEN x.start ELSE {(1 << 31) - 1} END))"
    every = every.withColumns({"last": F.expr(last), "first": F.expr(first)})
    every = every.withColumns({"last": F.expr(_running("last", "greatest({a}, {x})", "0")), "first": F.reverse(F.expr(_running("first", "least({a}, {x})", str((1 << 31) - 1))))})
    mixed = "(y.every.value RLIKE '[0-9]' AND y.every.value RLIKE '[A-Za-z]' OR y.every.value RLIKE '[A-Z]' AND y.every.value RLIKE '[a-z]')"
    free = f"y.every.kind = {len(KINDS)} AND y.last <= y.every.start AND y.first >= y.every.stop AND {mixed}"
    every = every.withColumn("other", F.expr(f"transform(filter(arrays_zip(every, last, first), y -> {free}), y -> y.every)"))
    codes = F.expr(f"transform(other, x -> transform(split(x.value, ''), c -> ascii(c) - {FIRST_CODE}))")
    scores = {f"scores{k}": F.split(F.lit(t), ",").cast("array<int>") for k, t in enumerate(tables)}
    total = lambda k: f"aggregate(zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (p, q) -> scores{k}[p * {CODES} + q]), 0L, (a, s) -> a + s)"
    best = f"greatest({', '.join(total(k) for k in range(len(tables)))})"
    extra = F.expr(f"filter(zip_with(other, codes, (x, c) -> CASE WHEN {best} >= {round(1000 * least_ratio)}L * (size(c) - 1) THEN x END), x -> x IS NOT NULL)")
    judged = every.withColumns({"codes": codes, **scores}).select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("spans"))
    return scanned.where("size(other) = 0").select("doc_id", "base", F.col("base").alias("spans")).unionByName(judged)


def span_text(spans: str) -> F.Column:
    names = ", ".join(f"'{k[0]}'" for k in KINDS) + f", '{MODEL_KIND}'"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.kind], x.start, x.stop)), ',')")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, x -> x.kind = {k}))").cast("long").alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
