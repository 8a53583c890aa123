"""Small helpers that the text operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.storage import stored  # noqa: F401

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame, **columns) -> DataFrame:
    """Whole rows as one column ``_row`` beside the given ones, so that no name of docs can clash; ``_row.*`` unpacks."""
    return docs.select(F.struct("*").alias("_row"), *(c.alias(k) for k, c in columns.items()))


def ascii_lower(text) -> F.Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def text_chunks(batches, max_bytes: int = 4 << 20, max_rows: int = 1 << 12):
    """Cut Arrow batches of (id, text) into chunks of bounded size.

    Yields (id array, list of UTF-8 bytes); null texts are empty. A text larger than the bound
    makes a chunk of its own, so whole texts stay together.
    """
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        n, start, size = len(texts), 0, 0
        if n == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for i in range(n):
            if i > start and (size + lengths[i] > max_bytes or i - start >= max_rows):
                yield ids.slice(start, i - start), _bytes(texts.slice(start, i - start))
                start, size = i, 0
            size += int(lengths[i])
        yield ids.slice(start), _bytes(texts.slice(start))


def _bytes(texts) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def offsets_of(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def bit_filter(ids: DataFrame, col: str, rows: int, bits_per_row: int = 32, broadcast_bytes: int = 32 << 20):
    """A function that drops most rows of a DataFrame whose hash ``col`` is none of ids, and no other.

    The hashes set one bit each in a filter sized for ``rows`` hashes. It is broadcast if what is
    set takes no more than ``broadcast_bytes``; else nothing is dropped and the caller's exact
    join moves all rows. With ``invert`` the function returns the rows that are surely none.
    """
    words = 1 << max(6, (rows * bits_per_row // 64).bit_length())

    def word(c):
        return F.pmod(F.col(c), F.lit(words))

    bit = F.shiftrightunsigned(col, 58).cast("int")
    bits = stored(ids.select(word(col).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))
    fits = bits.count() * 16 <= broadcast_bytes

    def keep(df: DataFrame, c: str = col, invert: bool = False) -> DataFrame:
        if not fits:
            return df.limit(0) if invert else df
        joined = df.withColumn("_word", word(c)).join(F.broadcast(bits), "_word", "left")
        found = F.coalesce(F.expr(f"_bits & shiftleft(1L, cast(shiftrightunsigned({c}, 58) AS INT)) != 0"), F.lit(False))
        return joined.where(~found if invert else found).select(*df.columns)

    return keep
