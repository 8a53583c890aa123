"""Substring deduplication: seeds on winnowed anchors, extended both ways."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import winnow
from tensorloom.llm.common import stored, table


class WordHashes(dict):
    """Word to hash, remembered."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self) > self.MOST:
            self.clear()
        return [np.fromiter(map(self.__getitem__, t.split()), np.uint64) for t in texts]


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 6, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each word that a window of ``window`` words covers which also starts earlier.

    Words are runs of other than the six ASCII spaces. Seeds are winnowed anchors that occur
    twice; each is extended both ways over all windows that it owns. Where a whole extended seed
    (anchor and context) occurs earlier, all its windows do. Of an anchor with several contexts,
    the first place of each context is compared window by window, so each text is compared once
    and never with all of its partners. What the windows cover, joined, are the maximal repeats.

    Earlier means a smaller id, or the same row and an earlier start; a missing id comes before
    all. Rows equal in id and text are one place, so both keep what no other place has first; rows
    with equal ids and different texts are ordered by a hash of the text. A null text has no word.
    Very long texts are read whole by one task, in parts; further columns are not read. An empty
    table gives an empty result. Spans count as equal if an anchor's hash and the hash of all that
    it spans are, 128 bits together.

    Returns doc_id, n_words, n_removed, kept_sha256 and, if ``with_text``, the kept text.
    """
    texts = winnow.keyed(docs, id_col, text_col)
    anchors = stored(winnow.anchor_table(texts, WordHashes, window, gram))
    shared = winnow.shared_anchors(anchors)
    place = F.struct("doc", "body", "place")
    firsts = stored(shared.groupBy("anchor", "context").agg(F.min(place).alias("first")))
    ranked = stored(shared.join(firsts, ["anchor", "context"]).select("doc", "body", "place", "anchor", "classes", (place > F.col("first")).alias("later")))

    # Whole extended seeds that occur earlier.
    start = F.expr("cast((place >> 20) - ((place >> 10) & 1023) as int)")
    whole = ranked.where("later").select("doc", "body", start.alias("start"), (start + F.expr("cast(place & 1023 as int)") + (window - 1)).alias("stop"))
    # The windows of each different context of an anchor that has several.
    asks = winnow.per_doc(ranked.where("not later and classes > 1").select("doc", "body", "place", "anchor").distinct(), "place", "anchor")
    single = stored(winnow.windows_of(winnow.with_lists(texts, asks, "inner"), WordHashes, window))
    at = F.struct("doc", "body", "start")
    key = ["anchor", "offset", "window"]
    again = stored(single.groupBy(*key).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    partly = single.join(again, key).where(at > F.col("first")).select("doc", "body", "start", (F.col("start") + window).alias("stop"))
    lists = winnow.per_doc(whole.unionByName(partly), "start", "stop")

    def cut(batches):
        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, spans in winnow.lists_of(batch, ["start", "stop"]):
                words = text.split()
                if len(spans["start"]):
                    gone = winnow.covered(len(words), spans["start"], spans["stop"])
                    kept = b" ".join(compress(words, ~gone))
                    n_removed.append(int(gone.sum()))
                else:
                    kept = b" ".join(words)
                    n_removed.append(0)
                n_words.append(len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept_texts, pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return winnow.with_lists(texts, stored(lists), "left").mapInArrow(cut, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 19, 0) + 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, i + unnest(range(0, 20)) AS j FROM r)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) FILTER (g.j IS NULL) AS kept, count(g.j) AS n
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.j = g.j GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN y ON w.doc_id = y.doc_id
"""
