"""Small helpers on frames that the operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.session import scratch_path

#: One word: what lies between spaces and the control characters 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a new Parquet table in the shared folder: lineage ends, every executor can read it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame], added: tuple[str, ...] = ()) -> DataFrame:
    """``work`` on ``docs`` whose columns other than doc_id, text and source have names that no operator uses.

    The result has the columns of ``docs`` under their own names, then the ``added`` ones; a column of ``docs`` with the name of an added one gives way.
    """
    columns = [c for c in docs.columns if c not in added]
    inner = [c if c in ("doc_id", "text", "source") else f"_extra{k}" for k, c in enumerate(columns)]
    done = work(docs.select(*columns).toDF(*inner))
    return done.select(*inner, *added).toDF(*columns, *added)


def text_key() -> Column:
    """With doc_id it tells rows apart; rows that agree in both have the same results."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = SALTS, merged: bool = False) -> DataFrame:
    """Null-safe equi-join of many rows with one row a key: the rows of a hot key are dealt over ``salts`` tasks.

    ``right`` is repeated ``salts`` times, so it should be the small side; Spark still broadcasts it if
    its size is under the session's threshold.  Spark guesses that size from the files of ``right`` and not from its repeats, so where ``right``
    grows with the input, ``merged`` asks for a merge join: the repeats never pass through the driver.
    """
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int"))
    names = {k: f"_right_{k}" for k in keys}
    again = right.withColumnsRenamed(names).withColumn("_right_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()], F.col("_salt") == F.col("_right_salt"))
    again = again.hint("merge") if merged else again
    return spread.join(again, same, how).drop("_salt", "_right_salt", *names.values())


def held_out(rest: int, of: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder ``rest``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == rest


