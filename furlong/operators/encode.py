"""Statistics of participants and dictionaries of categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.operators.groups import Hot, by_group, find_hot, lookup

TOTALS = {
    "runs": F.count,
    "wins": lambda c: F.sum((F.col(c) == 1).cast("long")),
    "top3": lambda c: F.sum((F.col(c) <= 3).cast("long")),
}


def _totals(finish: str = "finish") -> list[Column]:
    return [make(finish).alias(name) for name, make in TOTALS.items()]


def _rates(df: DataFrame, least: int) -> DataFrame:
    return df.filter(F.col("runs") >= least).withColumns({
        "win_rate": F.col("wins") / F.col("runs"), "top3_rate": F.col("top3") / F.col("runs")})


def role_totals(entries: DataFrame, role: str, least: int = fixed.MIN_ROLE_RUNS) -> DataFrame:
    """AG01: runs, wins and first-three finishes per name; NULL names have none."""
    return _rates(entries.filter(F.col(role).isNotNull()).groupBy(role).agg(*_totals()), least)


def pair_totals(entries: DataFrame, role: str, conditions: list[str], least: int = fixed.MIN_PAIR_RUNS) -> DataFrame:
    """AG02: the same per (name, condition value), all conditions in one pass."""
    values = entries.filter(F.col(role).isNotNull()).select(
        role, "finish", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in conditions])
    grouped = values.groupingSets([[role, c] for c in conditions], role, *conditions).agg(*_totals())
    named = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in conditions])
    return _rates(grouped.withColumns({"cond": named, "cond_value": F.coalesce(*conditions)}), least).select(
        role, "cond", "cond_value", "runs", "wins", "top3", "win_rate", "top3_rate")


def out_of_fold(
    entries: DataFrame, keys: list[str], hot: Hot, prefix: str, fold: str, train: Column,
    folds: int = fixed.FOLDS, least: int = fixed.MIN_ROLE_RUNS,
) -> DataFrame:
    """AG03: statistics of a name without the rows of the own fold.

    All-rows totals minus own-fold totals give every fold from one aggregation; the least number
    of runs applies after the subtraction.  Rows outside ``train`` see the totals of all train rows.
    """
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    learn = entries.filter(train & named)
    sums = []
    for name, make in TOTALS.items():
        sums.append(make("finish").alias(name))
        for f in range(folds):
            sums.append(_fold_total(name, fold, f).alias(f"{name}_{f}"))
    per_key = learn.groupBy(*keys).agg(*sums)
    present = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_has_{f}"), F.lit(0)) for f in range(folds)])
    spread = learn.agg(*[F.max(F.when(F.col(fold) == f, 1)).alias(f"_has_{f}") for f in range(folds)])
    single = spread.select(present.alias("n")).first()["n"] < 2
    options = [F.struct(F.lit(-1).alias("_fold"), *[F.col(n).alias(n) for n in TOTALS])]
    for f in range(folds):
        left = [F.col(n) if single else F.col(n) - F.coalesce(F.col(f"{n}_{f}"), F.lit(0)) for n in TOTALS]
        options.append(F.struct(F.lit(f).alias("_fold"), *[c.alias(n) for c, n in zip(left, TOTALS)]))
    table = _rates(per_key.select(*keys, F.inline(F.array(*options))), least).select(
        *keys, "_fold", *[F.col(n).alias(f"{prefix}_{n}") for n in ("runs", "win_rate", "top3_rate")])
    marked = entries.withColumn("_fold", F.when(train, F.col(fold)).otherwise(F.lit(-1)).cast("int"))
    return lookup(marked, table, [*keys, "_fold"], hot).drop("_fold")


def _fold_total(name: str, fold: str, f: int) -> Column:
    mine = F.col(fold) == f
    if name == "runs":
        return F.count(F.when(mine, F.col("finish")))
    limit = 1 if name == "wins" else 3
    return F.sum(F.when(mine, (F.col("finish") <= limit).cast("long")))


def attach_role(entries: DataFrame, table: DataFrame, role: str, hot: Hot, prefix: str) -> DataFrame:
    """JN01: unknown names have no statistics."""
    named = table.select(role, *[F.col(n).alias(f"{prefix}_{n}") for n in ("runs", "win_rate", "top3_rate")])
    return lookup(entries, named, [role], hot)


def attach_pairs(entries: DataFrame, table: DataFrame, role: str, conditions: list[str], hot: Hot) -> DataFrame:
    """JN02: statistics by (name, condition value), one join per condition."""
    for c in conditions:
        mine = table.filter(F.col("cond") == c).select(
            role, F.col("cond_value").alias("_value"),
            *[F.col(n).alias(f"{role}_{c}_{n}") for n in ("runs", "win_rate", "top3_rate")])
        marked = entries.withColumn("_value", F.coalesce(F.col(c).cast("string"), F.lit("nan")))
        entries = lookup(marked, mine, [role, "_value"], find_hot(marked, role, "_value") if hot.table is not None else hot).drop("_value")
    return entries


SNAPSHOT_PRE = 0.005
SNAPSHOT_LEAK = 0.3


def snapshot_report(entries: DataFrame) -> DataFrame:
    """AG04: when the career counters were taken, in one row.

    Needs ``name``, ``career_total`` and ``style_total``.  Counters that never change over a
    horse's races were fetched later and would leak; first-time starters mean they are from before.
    """
    horses = entries.groupBy("name").agg(
        F.count(F.lit(1)).alias("rows"), F.min("career_total").alias("low"), F.max("career_total").alias("high"))
    same = horses.filter(F.col("rows") >= 2).agg(
        F.count(F.lit(1)).alias("many"), F.avg((F.col("low") == F.col("high")).cast("double")).alias("same_share"))
    whole = entries.agg(
        F.avg((F.col("career_total") == 0).cast("double")).alias("zero_share"),
        F.median(F.col("style_total") - F.col("career_total")).alias("style_gap"))
    mode = F.when(F.col("zero_share").isNull(), "none").when(F.col("zero_share") >= SNAPSHOT_PRE, "pre").when(
        F.col("same_share") > SNAPSHOT_LEAK, "leak").otherwise("post")
    one = F.lit(1).alias("_one")
    return whole.select("*", one).join(same.select("*", one), "_one").drop("_one").withColumn("mode", mode)


def snapshot_mode(entries: DataFrame) -> str:
    """AG04 as the one value that decides how the feature plan is built."""
    if "career_total" not in entries.columns:
        return "none"
    return snapshot_report(entries).first()["mode"]


def category_maps(entries: DataFrame, columns: list[str], least: int = fixed.MIN_CATEGORY_ROWS) -> DataFrame:
    """AG05: values seen often enough, coded in sorted order per column; all values if none is frequent."""
    long = entries.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counted = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    hot = find_hot(counted, "column")

    def coded(df, g):
        df = g.add(df, _often=F.max("rows"))
        return g.number(df.filter((F.col("rows") >= least) | (F.col("_often") < least)).drop("_often"), "code", F.col("value"))

    return by_group(counted, hot, coded).select("column", "value", "rows", (F.col("code") - 1).alias("code"))


def apply_categories(entries: DataFrame, maps: DataFrame, columns: list[str], hot: dict[str, Hot] | None = None) -> DataFrame:
    """JN15: category text to code, values outside the dictionary are NULL."""
    for c in columns:
        codes = maps.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias(f"{c}_code"))
        marked = entries.withColumn("_value", F.col(c).cast("string"))
        large = (hot or {}).get(c) or find_hot(marked.select("_value"), "_value")
        entries = lookup(marked, codes, ["_value"], large).drop("_value")
    return entries
