"""Session helpers: where shared scratch data goes and how lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the checkpoint folder, or a part of the warehouse where the session names none."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    made = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_furlong"
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is ever written twice to one path."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table below the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and later plans start from it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def apart(df: DataFrame) -> DataFrame:
    """The same rows under a plan of their own: later plans start from it, and nothing is written.

    The rows are worked out wherever they are read, from shuffles that are made once.  For rows that are larger than what they are made from.
    """
    spark, made = df.sparkSession, df._jdf
    return type(df)(spark._jsparkSession.internalCreateDataFrame(made.queryExecution().toRdd(), made.schema(), False), spark)
