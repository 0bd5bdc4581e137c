"""Quality rules by the likelihood ratio of hashed n-grams.

Words and word pairs are hashed into buckets.  Two multinomials over buckets are counted: one over all documents (the raw corpus) and
one over the trusted documents.  A text's score is the sum over its n-grams of log(trusted / raw) divided by their
number, so length does not matter, and the verdict is the score against a fixed threshold: the same
text gets the same verdict wherever it stands.  Before that, base rules on counts can fail a text.

Counting is one pass over whole texts: tasks add up their buckets and send one row a bucket, ``BUCKETS`` rows in all
at any input size.  With add-one smoothing no ratio is infinite.

Defined results: null and empty texts have no words, fail the base rules, and have score 0; without trusted documents
the trusted counts are flat; a trusted id that stands on several rows makes each of them trusted; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm.frames import salted_join
from furlong.llm.text_stats import Words, base_counts
from furlong.llm.textblock import blocks

BUCKETS = 1 << 16
THRESHOLD = -0.15
LEAST_WORDS = 50
MOST_REPEATED = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every word and every pair of neighbouring words of a text."""
    inside = np.flatnonzero(words.doc[1:] == words.doc[:-1])
    pairs = (words.hashes[inside] * np.uint64(0x9E3779B97F4A7C15) + words.hashes[inside + 1]) * np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([words.hashes >> shift, pairs >> shift]).astype(np.int64), np.concatenate([words.doc, words.doc[inside]])


def count(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratio of every bucket; ``trusted`` has a column doc_id."""
    marks = trusted.select("doc_id").distinct().withColumn("_trusted", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for rows, block in blocks(batch, "text"):
                found, doc = buckets(Words(block))
                good = rows.column("_trusted").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
                sums[0] += np.bincount(found, minlength=BUCKETS)
                sums[1] += np.bincount(found[good[doc]], minlength=BUCKETS)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[0][some]), pa.array(sums[1][some])], ["bucket", "raw", "target"])

    # one plan at every size: trusted ids are not bounded, so they are never broadcast
    marked = docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id", "left").select("text", "_trusted")
    sums = marked.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in sums.toLocalIterator():  # at most BUCKETS rows
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def judge(docs: DataFrame, ratios: np.ndarray, kept: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``kept`` columns of ``docs`` (with text) plus the counts, base_failed, score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers
    fields = [*docs.select(*kept).schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS],
              T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            for rows, block in blocks(batch, "text"):
                words = Words(block)
                base = base_counts(words)
                found, doc = buckets(words)
                n = np.bincount(doc, minlength=len(block))
                score = np.bincount(doc, weight[found], len(block)) / np.maximum(n, 1)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in kept], *[pa.array(base[c].astype(np.int64)) for c in COUNTS], pa.array(failed), pa.array(score),
                     pa.array(~failed & (score >= threshold))], [f.name for f in fields])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, T.StructType(fields))
