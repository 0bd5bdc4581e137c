"""Columns relative to the rest of the contest.  ``g`` is the group plan chosen by ``by_group``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.operators.groups import Groups


def group_size(df: DataFrame, g: Groups, name: str = "heads") -> DataFrame:
    """WN01."""
    return g.add(df, **{name: F.count(F.lit(1))})


def deviations(df: DataFrame, g: Groups, values: list[str], suffix: str = "_dev") -> DataFrame:
    """WN02: distance to the group mean, NULL skipped; one pass for all columns."""
    df = g.add(df, **{f"_mean_{v}": F.avg(v) for v in values})
    df = df.withColumns({v + suffix: F.col(v) - F.col(f"_mean_{v}") for v in values})
    return df.drop(*[f"_mean_{v}" for v in values])


def average_rank(df: DataFrame, g: Groups, value: str, name: str) -> DataFrame:
    """WN03: descending rank, equal values share the mean of their places; NULL has none."""
    return g.average_ranks(df, {value: name})


def min_rank(df: DataFrame, g: Groups, value: str, name: str) -> DataFrame:
    """WN04: descending rank, equal values share the best place."""
    return g.rank(df, name, value)


def gaps(df: DataFrame, g: Groups, values: dict[str, int], top: str = "_top_gap", second: str = "_second_gap") -> DataFrame:
    """WN05: distance to the best and second best; sign -1 where small values are good.

    Several entrants at the top make the second best equal to the best.
    """
    signed = {v: (F.col(v) * F.lit(sign)) for v, sign in values.items()}
    df = g.add(df, **{f"_best_{v}": F.max(x) for v, x in signed.items()})
    aggregates = {}
    for v, x in signed.items():
        aggregates[f"_many_{v}"] = F.sum(F.when(x == F.col(f"_best_{v}"), 1).otherwise(0))
        aggregates[f"_next_{v}"] = F.max(F.when(x < F.col(f"_best_{v}"), x))
    df = g.add(df, **aggregates)
    made = {}
    for v, x in signed.items():
        made[v + top] = x - F.col(f"_best_{v}")
        made[v + second] = x - F.when(F.col(f"_many_{v}") < 2, F.col(f"_next_{v}")).otherwise(F.col(f"_best_{v}"))
    return df.withColumns(made).drop(*[f"{p}_{v}" for v in values for p in ("_best", "_many", "_next")])


def others(df: DataFrame, g: Groups, flags: dict[str, Column]) -> DataFrame:
    """WN06: how many other entrants have the flag."""
    df = df.withColumns({f"_flag_{n}": c.cast("double") for n, c in flags.items()})
    df = g.add(df, **{f"_all_{n}": F.sum(f"_flag_{n}") for n in flags})
    df = df.withColumns({n: F.col(f"_all_{n}") - F.col(f"_flag_{n}") for n in flags})
    return df.drop(*[f"{p}_{n}" for n in flags for p in ("_flag", "_all")])


def zscore(df: DataFrame, g: Groups, value: str, name: str) -> DataFrame:
    """WN08: population deviation, kept away from zero."""
    df = g.add(df, _mean=F.avg(value), _spread=F.stddev_pop(value))
    return df.withColumn(name, (F.col(value) - F.col("_mean")) / (F.col("_spread") + F.lit(1e-9))).drop("_mean", "_spread")


def class_of_race(df: DataFrame, g: Groups, wins: str, name: str) -> DataFrame:
    """WN09: class level by the median number of wins before the race (a handful of distinct counts)."""
    df = g.add(df, _median=F.median(wins))
    level = {label: float(i) for i, label in enumerate(fixed.CLASS_NAMES)}
    steps = [F.when(F.col("_median") <= limit, F.lit(level[label])) for limit, label in fixed.CLASS_BY_WINS]
    known = F.when(F.col("_median").isNotNull(), F.coalesce(*steps, F.lit(level[fixed.CLASS_OTHER])))
    return df.withColumn(name, known).drop("_median")


def top_pick(df: DataFrame, g: Groups, score: str) -> DataFrame:
    """WN10: the best-scored entrant of each group, the first of equals."""
    return g.first(df.filter(F.col(score).isNotNull()), 1, F.col(score).desc(), F.col("num"))


def pace(df: DataFrame, g: Groups, style: str = "main_style", front: str = "front_rate") -> DataFrame:
    """WN06, WN11: rivals per style and what they mean for the pace.

    ``style`` is 1 leader, 2 follower, 3 stalker, 4 closer, NULL without any run.
    """
    is_style = {n: F.coalesce(F.col(style) == i, F.lit(False)) for i, n in enumerate(("leader", "follower", "stalker", "closer"), 1)}
    df = others(df, g, {f"other_{n}s": flag for n, flag in is_style.items()})
    df = g.add(df, _heads=F.count(F.lit(1)), _front=F.avg(front))
    flag = {n: c.cast("double") for n, c in is_style.items()}
    leaders, followers = F.col("other_leaders") + flag["leader"], F.col("other_followers") + flag["follower"]
    df = df.withColumns({
        "front_share": (leaders + followers) / F.col("_heads"),
        "pace_index": (leaders * 2 + followers) / F.col("_heads"),
    })
    return df.withColumns({
        "pace_gain": F.col("pace_index") * (flag["stalker"] + flag["closer"] - flag["leader"] - flag["follower"]),
        "lone_leader": ((F.col("other_leaders") == 0) & is_style["leader"]).cast("double"),
        "rivals_ahead": F.col("other_leaders") + F.col("other_followers"),
        "front_rate_dev": F.col(front) - F.col("_front"),
    }).drop("_heads", "_front")


def running_total(days: DataFrame, value: str, name: str, order: str = "bet_date") -> DataFrame:
    """WN12: over a table with one row per day."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumn(name, F.sum(value).over(upto))


def fill_down(df: DataFrame, g: Groups, value: str, name: str, order: str) -> DataFrame:
    """WN13: the last value seen so far, for cells that span several rows."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    return g.running(df, "_seen", seen, "max", F.col(order)).withColumn(name, F.col("_seen.v")).drop("_seen")


def rank_label(df: DataFrame, g: Groups, name: str = "label") -> DataFrame:
    """WN14: group size minus finish, not below zero."""
    df = g.add(df, _heads=F.count(F.lit(1)))
    return df.withColumn(name, F.greatest(F.col("_heads") - F.col("finish"), F.lit(0)).cast("double")).drop("_heads")


def has_winner(df: DataFrame, g: Groups, name: str = "has_winner") -> DataFrame:
    """WN15."""
    return g.add(df, _first=F.min("finish")).withColumn(name, F.coalesce(F.col("_first") == 1, F.lit(False))).drop("_first")


def trends(df: DataFrame, fields: list[str], past: str = "past") -> DataFrame:
    """WN16: latest run against the one before."""
    latest, before = F.get(F.col(past), 0), F.get(F.col(past), 1)
    return df.withColumns({f"{f}_trend": latest[f] - before[f] for f in fields})
