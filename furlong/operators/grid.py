"""Returns for every pair of thresholds on chance and value.

A ticket counts in every cell whose thresholds it reaches.  Instead of one pass per cell, each
ticket goes to the highest cell it reaches; the cell table is small and fixed in size, and sums
over the cells above give every threshold pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.functions.columns import cell_of
from furlong.operators.settle import payout, whole_units

LEVELS = {"all": [], "kind": ["kind"], "race_no": ["race_no"], "both": ["kind", "race_no"]}


def cells(judged: DataFrame, stake: int = fixed.STAKE) -> DataFrame:
    """AG10b: points, hits and returns per highest cell, kind and race number."""
    binned = judged.filter(F.col("hit").isNotNull()).select(
        "kind", "race_no", "hit",
        payout(F.col("hit"), F.col("odds_lo"), stake).alias("paid"),
        cell_of(F.col("chance"), fixed.CHANCE_GRID).alias("i"), cell_of(F.col("value"), fixed.VALUE_GRID).alias("j"))
    return binned.filter((F.col("i") > 0) & (F.col("j") > 0)).groupBy("kind", "race_no", "i", "j").agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.col("hit").cast("long")).alias("hits"), F.sum("paid").alias("paid"))


def reached(cell_table: DataFrame) -> DataFrame:
    """JN09: every cell also counts for all lower thresholds."""
    lower = cell_table.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("i")))).withColumn(
        "j", F.explode(F.sequence(F.lit(1), F.col("j"))))
    chance = F.element_at(F.array(*[F.lit(t) for t in fixed.CHANCE_GRID]), F.col("i"))
    value = F.element_at(F.array(*[F.lit(t) for t in fixed.VALUE_GRID]), F.col("j"))
    return lower.withColumns({"min_chance": chance, "min_value": value}).drop("i", "j")


def threshold_grid(judged: DataFrame, stake: int = fixed.STAKE) -> DataFrame:
    """AG10: all four levels; NULL kind or race number means all of them; empty cells do not appear."""
    keys = ["min_chance", "min_value"]
    sets = [[*keys, *more] for more in LEVELS.values()]
    table = reached(cells(judged, stake))
    # race numbers outside 1..12 count overall and by kind only
    outside = ~F.coalesce(F.col("race_no").between(1, 12), F.lit(False))
    table = table.withColumn("race_no", F.when(outside, 0).otherwise(F.col("race_no")).cast("int"))
    level = F.grouping_id(*keys, "kind", "race_no")
    grouped = table.groupingSets(sets, *keys, "kind", "race_no").agg(
        level.alias("_level"), F.sum("points").alias("points"), F.sum("hits").alias("hits"), F.sum("paid").alias("_paid"))
    bet, whole = F.col("points") * stake, whole_units(F.col("_paid"))
    names = F.when(F.col("_level") == 3, "all").when(F.col("_level") == 1, "kind").when(F.col("_level") == 2, "race_no").otherwise("both")
    return grouped.filter(F.col("race_no").isNull() | (F.col("race_no") > 0)).select(
        names.alias("level"), *keys, "kind", "race_no", "points", "hits",
        (F.col("hits") / F.col("points") * 100).alias("hit_rate"), bet.alias("bet"), whole.alias("ret"),
        (whole - bet).alias("profit"), (F.col("_paid") / bet * 100).alias("roi"))


def value_column(threshold: float) -> str:
    return "ev_" + f"{threshold:g}".replace(".", "_")


def matrix(grid: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """AG11: thresholds on chance down, on value across."""
    names = F.element_at(
        F.create_map(*[F.lit(x) for t in fixed.VALUE_GRID for x in (float(t), value_column(t))]), F.col("min_value"))
    return grid.withColumn("_column", names).groupBy(*(by or []), "min_chance").pivot(
        "_column", [value_column(t) for t in fixed.VALUE_GRID]).agg(F.avg(value))


def best(grid: DataFrame, by: str, least_points: int = 0, n: int = 10) -> DataFrame:
    """SO05: the best cells over all kinds and races."""
    overall = grid.filter((F.col("level") == "all") & (F.col("points") >= least_points))
    return overall.orderBy(F.col(by).desc(), "min_chance", "min_value").limit(n)
