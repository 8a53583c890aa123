"""The corpus pipeline: language, lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the
shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.bpe import bpe_roundtrip, tokenizer_files
from tensorloom.llm.common import stored, table
from tensorloom.llm.decontaminate import without_contaminated
from tensorloom.llm.language import fit_language, with_known_language
from tensorloom.llm.line_dedup import line_dedup
from tensorloom.llm.near_copies import one_of_each_similar

#: Shingles of near duplicates here: five words; near copies share this Jaccard similarity, in percent.
SHINGLE = 5
SIMILAR = 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the field knows, go."""
    field = fit_language(docs)
    return with_known_language(docs, field) if field.labels else docs


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier already go, short ones if they are exact repeats; n_chars follows the text."""
    out = line_dedup(docs, short=True)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return one_of_each_similar(docs, shingle=SHINGLE, percent=SIMILAR)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and digests of them and of the text that they decode to."""
    return bpe_roundtrip(docs, *tokenizer_files(), with_ids=True)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

#: The language field, fingerprints, alignments and merges can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
