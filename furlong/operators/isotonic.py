"""ML06: the increasing step function closest to weighted points, pooled over range partitions.

Points with equal x are one point.  Every range partition pools its own points, so that its steps increase.  A border between two steps is
final where no step before it is higher than a step after it; the final borders cut the steps into segments, which are pooled each on its
own.  Segments lie around the borders of the partitions, so no task has all steps unless the function does not increase at all.  Where a segment is
still long, the steps are dealt to new ranges and pooled again first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.session import cut

STEPS = "low double, high double, value double, weight double"
#: Steps of a segment that one task pools.
LONG = 1_000_000


def _pools():
    """The two functions that tasks run; made here so that they travel whole."""
    names = ["low", "high", "value", "weight"]

    def pooled(frames: Iterator[pd.DataFrame]) -> list[tuple]:
        steps: list[tuple] = []
        for frame in frames:
            for low, high, value, weight in frame[names].itertuples(index=False):
                while steps and steps[-1][2] >= value:  # joins the steps that are not lower
                    low, _, before, mass = steps.pop()
                    value, weight = (before * mass + value * weight) / (mass + weight), mass + weight
                steps.append((low, high, value, weight))
        return steps

    def partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        yield pd.DataFrame(pooled(frames), columns=names).assign(part=TaskContext.get().partitionId())

    def segment(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(pooled(iter([frame.sort_values("low")])), columns=names)

    return partition, segment


def points(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """One step for each x: the mean of y, weighed by its rows; rows without x or y count nowhere."""
    known = rows.select(x.cast("double").alias("low"), y.cast("double").alias("_y")).filter("low is not null and not isnan(low) and _y is not null")
    return known.groupBy("low").agg(F.avg("_y").alias("value"), F.count(F.lit(1)).cast("double").alias("weight")).select("low", F.col("low").alias("high"), "value", "weight")


def segments(steps: DataFrame) -> DataFrame:
    """``steps`` with the lowest x of the segment each belongs to; a partition's steps increase."""
    inner, upto = Window.partitionBy("part").orderBy("low"), Window.partitionBy("part").orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    # one row for each partition
    sides = steps.groupBy("part").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    earlier, later = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    sides = sides.select("part", F.max("most").over(earlier).alias("_before"), F.min("least").over(later).alias("_after"))
    known = steps.join(F.broadcast(sides), "part").withColumn("_last", F.lag("value").over(inner))
    final = F.coalesce(F.greatest("_before", "_last") <= F.least("value", "_after"), F.lit(True))
    cuts = cut(known.withColumn("_cut", F.when(final, F.col("low"))).drop("_before", "_after", "_last"))
    heads = cuts.groupBy("part").agg(F.max("_cut").alias("_cut")).select("part", F.max("_cut").over(earlier).alias("_open"))
    return cuts.join(F.broadcast(heads), "part").withColumn("segment", F.coalesce(F.last("_cut", ignorenulls=True).over(upto), F.col("_open"))).drop("_cut", "_open")


def fitted(found: DataFrame, parts: int | None = None, long: int = LONG) -> DataFrame:
    """The increasing steps (low, high, value, weight) of ``points``."""
    partition, segment = _pools()
    steps, before = found, None
    while True:
        ranged = steps.repartitionByRange(parts, "low") if parts else steps.repartitionByRange("low")
        steps = cut(ranged.sortWithinPartitions("low").mapInPandas(partition, STEPS + ", part int"))
        placed = cut(segments(steps))
        longest = placed.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if longest <= long or longest == before:
            break
        before, steps = longest, steps.drop("part")
    several = placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("segment")))
    joined = several.filter("_n > 1").select("segment", "low", "high", "value", "weight").groupBy("segment").applyInPandas(segment, STEPS)
    return joined.unionByName(several.filter("_n = 1").select("low", "high", "value", "weight"))


def model(steps: DataFrame) -> IsotonicRegressionModel:
    """The steps as a model that joins their ends by lines; it only sees the two ends of each step."""
    ends = F.when(F.col("low") < F.col("high"), F.array("low", "high")).otherwise(F.array("low"))
    data = steps.select(F.explode(ends).alias("features"), F.col("value").alias("label"), (F.col("weight") / F.size(ends)).alias("weight"))
    return IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(data)
