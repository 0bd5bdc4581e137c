"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has its own chance, a logistic function of hashed
words and byte grams, and the document is toxic if any sentence is: 1 - prod(1 - p), the noisy-or.  Only
document labels are known; the gradient of the noisy-or hands their blame to the sentences.  After
training the same sentence chances locate what offends.

Training takes a bounded sample of labelled documents (``sample`` rows of each label, those with the smallest hash of their
id), turned into feature numbers on the executors.  Rows of a label weigh as much as they stand for, so the score
is a chance in the whole table.  Scoring is one pass over whole texts.

Defined results: empty and null texts score like a document with one empty sentence; a null doc_id hashes like empty text;
without labels of both kinds every sentence has chance 0; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm.frames import shielded
from furlong.llm.textblock import LOWER, Block, Rolling, blocks, code_points, spans

BUCKETS = 1 << 18
GRAM = 5
SAMPLE = 1500
#: A feature that fewer sampled documents have says nothing; its weight stays 0.
LEAST = 3
EPOCHS = 120
RATE = 0.3
PENALTY = 2e-4
STEP = 1 << 19
START = -5.0

#: What does not belong to a word: ASCII other than letters.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[65:91] = _OUTSIDE[97:123] = _OUTSIDE[128:] = False
#: Ends of sentences.
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?\n\r"]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence) of every occurrence; start, end and text number of every sentence.

    A text without sentences has one empty sentence.  Features are hashes of lower-cased words, and of all runs of
    ``GRAM`` bytes inside words, the word's edges marked.
    """
    low = LOWER[block.data]
    s0, s1, sdoc = spans(block, _STOPS)
    bare = np.setdiff1d(np.arange(len(block)), sdoc)
    s0, s1, sdoc = (np.concatenate(x) for x in ((s0, block.off[bare]), (s1, block.off[bare]), (sdoc, bare)))
    order = np.lexsort((s0, sdoc))
    s0, s1, sdoc = s0[order], s1[order], sdoc[order]
    w0, w1, _ = spans(block, _OUTSIDE)
    owner = np.searchsorted(s0, w0, "right") - 1 if len(w0) else w0
    rolling = Rolling(low)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    size = w1 - w0
    count = np.maximum(size - GRAM + 1, 0)
    word = np.repeat(np.arange(len(w0)), count)
    g0 = w0[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    # a gram at the start or the end of its word is another feature than inside
    edge = (g0 == w0[word]).astype(np.uint64) + np.uint64(2) * (g0 + GRAM == w1[word]).astype(np.uint64)
    grams = (rolling.of(g0, g0 + GRAM) + edge * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    found = np.concatenate([rolling.of(w0, w1) >> shift, grams >> shift]).astype(np.int32)
    return found, np.concatenate([owner, owner[word]]), s0, s1, sdoc


def sentence_chances(model: Model, found: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return model.bias + np.bincount(sentence, model.weights[found], n)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(bags: list[tuple[np.ndarray, np.ndarray, int, float]]) -> Model:
    """``bags``: features, their sentence, label, and weight of each document; the list is emptied.

    Full-batch Adam on the weighted log loss of the noisy-or; the occurrences are summed ``STEP`` at a time.
    """
    label = np.array([b[2] for b in bags], float)
    if not len(bags) or label.min() == label.max():
        return Model(np.zeros(BUCKETS, np.float32), -np.inf)
    weight = np.array([b[3] for b in bags])
    weight = weight / weight.sum()
    counts = np.array([int(b[1].max()) + 1 if len(b[1]) else 1 for b in bags])
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(bags)), counts)
    found = np.concatenate([b[0] for b in bags])
    sentence = np.concatenate([b[1] + at for b, at in zip(bags, first, strict=True)]).astype(np.int32)
    # only features of enough documents are learned; they are numbered anew
    docs_with = np.zeros(BUCKETS, np.int32)
    for b in bags:
        docs_with[np.unique(b[0])] += 1
    known = np.flatnonzero(docs_with >= LEAST)
    number = np.full(BUCKETS, -1, np.int32)
    number[known] = np.arange(len(known))
    keep = number[found] >= 0
    found, sentence = number[found[keep]], sentence[keep]
    n_docs = len(bags)
    bags.clear()
    steps = [slice(k, k + STEP) for k in range(0, len(found), STEP)]
    w, bias = np.zeros(len(known)), START
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for epoch in range(1, EPOCHS + 1):
        z = np.full(len(doc), bias)
        for k in steps:
            low, high = int(sentence[k].min()), int(sentence[k].max()) + 1
            z[low:high] += np.bincount(sentence[k] - low, w[found[k]], high - low)
        none = np.bincount(doc, softplus(z), n_docs)  # -log of the chance that no sentence offends
        blame = np.where(label > 0, -1.0 / np.expm1(np.clip(none, 1e-12, 50.0)), 1.0) * weight
        slope = blame[doc] * (0.5 + 0.5 * np.tanh(0.5 * z))
        pull = np.zeros(len(w))
        for k in steps:
            pull += np.bincount(found[k], slope[sentence[k]], len(w))
        grad = np.append(pull + PENALTY * np.sign(w) * (w != 0) + PENALTY * 0.1 * w, slope.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = RATE * (1.0 - epoch / (EPOCHS + 1)) * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-7)
        w, bias = w - step[:-1], bias - step[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[known] = w
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, target: str, learn: Column, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` documents of each label among those that ``learn`` (a column on doc_id) allows."""
    labelled = labels.filter(learn & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).cast("int").alias("_label"))
    totals = {r["_label"]: r["count"] for r in labelled.groupBy("_label").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = [labelled.filter(F.col("_label") == y).orderBy(order, "doc_id").limit(sample) for y in (0, 1)]  # at most 2 * sample ids
    met = docs.select("doc_id", F.struct("text").alias("_text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    one = F.min_by("_text", F.xxhash64("_text.text")).alias("_text")  # of several texts of one id always the same
    picked = met.groupBy("doc_id").agg(F.first("_label").alias("_label"), one).select("doc_id", "_label", "_text.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks(batch, "text"):
                found, sentence, _, _, sdoc = features(block)
                order = np.argsort(sdoc[sentence], kind="stable")
                found, sentence = found[order], sentence[order]
                ends = np.searchsorted(sdoc[sentence], np.arange(len(block) + 1))
                first = np.searchsorted(sdoc, np.arange(len(block)))
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), rows.column("_label"),
                    pa.array([found[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                    pa.array([(sentence[a:b] - s).astype(np.int32).tobytes() for a, b, s in zip(ends, ends[1:], first, strict=False)], pa.binary()),
                ], ["doc_id", "_label", "found", "sentence"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("_label").to_pylist(), b.column("found"), b.column("sentence"), strict=True)]
        rows.sort(key=lambda r: r[0])
        seen = {y: sum(r[1] == y for r in rows) for y in (0, 1)}
        bags = [(np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.int32), y, totals[y] / seen[y]) for _, y, f, s in rows]
        del rows
        model = fit(bags)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])

    kind = dict(docs.dtypes)["doc_id"]
    bounded = picked.mapInArrow(run, f"doc_id {kind}, _label int, found binary, sentence binary").repartition(1)  # the bounded sample; the driver gets the weights only
    model = bounded.mapInArrow(learned, "weights binary, bias double").collect()
    return Model(np.frombuffer(model[0]["weights"], np.float32), model[0]["bias"]) if model else fit([])


def clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under ``most``."""
    return shielded(docs, lambda d: score(d, model, d.columns).filter(F.col("score") < most))


def score(docs: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``docs`` (with text) plus score, n_offending, and worst_start and worst_length in code points.

    Offending sentences have a chance of 0.5 or more; the worst sentence is the first with the highest chance.
    """
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.bias))  # at most BUCKETS numbers
    schema = docs.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, bias = shared.value
        weights = np.zeros(BUCKETS, np.float32)
        weights[places] = values
        local = Model(weights, bias)
        for batch in batches:
            for rows, block in blocks(batch, "text"):
                found, sentence, s0, s1, sdoc = features(block)
                z = sentence_chances(local, found, sentence, len(s0))
                none = np.bincount(sdoc, softplus(z), len(block))
                offending = np.bincount(sdoc, z >= 0, len(block)).astype(np.int64)
                top = np.lexsort((s0, -z, sdoc))
                worst = top[np.searchsorted(sdoc[top], np.arange(len(block)))]
                points = code_points(block)
                yield pa.RecordBatch.from_arrays([
                    *[rows.column(c) for c in kept], pa.array(-np.expm1(-none)), pa.array(offending),
                    pa.array(points[s0[worst]] - points[block.off[:-1]]), pa.array(points[s1[worst]] - points[s0[worst]]),
                ], [*kept, "score", "n_offending", "worst_start", "worst_length"])

    out = T.StructType([*schema.fields, T.StructField("score", T.DoubleType()), *[
        T.StructField(c, T.LongType()) for c in ("n_offending", "worst_start", "worst_length")]])
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, out)
