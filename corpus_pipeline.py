"""The corpus pipeline: documents to packed sequences, in stages that each write their whole result.

Each stage reads what its predecessor kept and returns it with the columns of ``documents``; the last one returns
the packed pieces.  ``ORACLE_SQL`` is None: fitted models, fingerprints and tokens have no SQL.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from furlong.llm import best_fit, line_dedup, mix_histogram, near_texts, toxicity
from furlong.llm.frames import documents, held_out, labels, stored
from furlong.llm.ship import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is under one half; the model learns from the labels as in op1."""
    model = toxicity.train(docs, labels(spark, sf_dir), "toxic", ~held_out(0, 5))
    return toxicity.clean(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line repeats; a document that loses all its lines stays, empty."""
    return line_dedup.without_repeats(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word similarities of 0.8 or more: the one with the smallest doc_id.

    SimHash fingerprints and their trie join give the first candidates, verified on the whole sets; shared shingles find the pairs no fingerprint shows.
    """
    return near_texts.keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mix_histogram.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return best_fit.pack(docs)


def _shipped(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _shipped(without_toxic)),
    ("line dedup", _shipped(without_repeated_lines)),
    ("simhash near-dedup", _shipped(near_duplicates)),
    ("mixing to target weights", _shipped(mixing)),
    ("best-fit packing", _shipped(packing)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
