"""Tickets against results and payouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.operators.groups import Aggregated, Hot, find_hot, lookup


def race_results(entries: DataFrame, hot: Hot) -> DataFrame:
    """Per contest with finishers: the first three in row order of equal finishes, all placed entrants, starters and ranked entrants."""
    row = F.struct("finish", "num", "frame")
    counts = [F.count(F.lit(1)).alias("starters"), F.count("finish").alias("ranked")]
    ranked = F.array_sort(F.collect_list(F.when(F.col("finish").isNotNull(), row)))
    out = _results(hot.cold(entries).groupBy("race_id").agg(*counts, ranked.alias("_order")))
    if hot.table is None:
        return out
    # a large contest hands on its placed entrants, dead heats included, and its leaders: a handful
    large = hot.rows(entries)
    finished = large.filter(F.col("finish").isNotNull())
    leaders = Aggregated(hot.keys).first(finished, 3, F.col("finish"), F.col("num")).filter(F.col("finish") > 3)
    few = leaders.unionByName(finished.filter(F.col("finish") <= 3))
    order = few.groupBy("race_id").agg(F.array_sort(F.collect_list(row)).alias("_order"))
    return out.unionByName(_results(large.groupBy("race_id").agg(*counts).join(order, "race_id")))


def _results(ordered: DataFrame) -> DataFrame:
    first = F.slice("_order", 1, 3)
    return ordered.filter(F.col("ranked") > 0).select(
        "race_id", "starters", "ranked", F.transform(first, lambda x: x["num"]).alias("top"), F.transform(first, lambda x: x["frame"]).alias("top_frames"),
        F.transform(F.filter("_order", lambda x: x["finish"] <= 3), lambda x: F.struct(x["num"].alias("num"), x["finish"].alias("finish"))).alias("_placed"))


def is_hit(kind: Column, legs: Column, top: Column, frames: Column, finish: Column, starters: Column) -> Column:
    """PL12: did the ticket win; ``finish`` is the finish of its first leg."""
    first, two, three = F.get(top, F.lit(0)), F.slice(top, 1, 2), F.slice(top, 1, 3)
    paid = F.when(starters <= fixed.SMALL_FIELD, 2).otherwise(3)
    f1, f2 = F.get(frames, F.lit(0)), F.get(frames, F.lit(1))
    return (
        F.when(kind == "win", F.get(legs, F.lit(0)) == first)
        .when(kind == "place", F.coalesce(finish <= paid, F.lit(False)))
        .when(kind == "frame", F.when(f1.isNotNull() & f2.isNotNull(), F.array_sort(legs) == F.array_sort(F.array(f1, f2))))
        .when(kind == "quinella", F.array_sort(legs) == F.array_sort(two))
        .when(kind == "wide", (F.size(F.array_except(legs, three)) == 0) & (F.size(F.array_distinct(legs)) == 2))
        .when(kind == "exacta", legs == two)
        .when(kind == "trio", F.array_sort(legs) == F.array_sort(three))
        .when(kind == "trifecta", legs == three)
    )


def judge(tickets: DataFrame, entries: DataFrame, hot: Hot, many: Hot | None = None) -> DataFrame:
    """JN07 and PL12: tickets with ``hit``; NULL where the contest has no usable result.

    ``hot`` are the contests with very many entrants, ``many`` those with very many tickets.
    """
    known = lookup(tickets, race_results(entries, hot), ["race_id"], many or find_hot(tickets, "race_id"))
    finish = F.get(F.filter("_placed", lambda x: x["num"] == F.get("legs", F.lit(0))), F.lit(0))["finish"]
    hit = is_hit(F.col("kind"), F.col("legs"), F.col("top"), F.col("top_frames"), finish, F.col("starters"))
    return known.withColumn("hit", F.when(F.coalesce(F.col("ranked") >= 3, F.lit(False)), hit)).drop(
        "_placed", "top", "top_frames", "ranked")


def kind_order(kind: Column | str) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.array_position(F.array(*[F.lit(k) for k in fixed.KINDS]), kind).cast("int")


def payout(hit: Column, odds: Column, stake: int) -> Column:
    """What a judged ticket pays at its quote; rounding noise of the product must not add up."""
    return F.when(hit, F.round(odds * stake, 6)).otherwise(0.0)


def whole_units(amount: Column) -> Column:
    """Money is cut to whole units, after the rounding noise of the sum is gone."""
    return F.floor(F.round(amount, 6))


def settlement_report(judged: DataFrame, stake: int = fixed.STAKE) -> DataFrame:
    """AG09: totals per kind and over all (kind NULL); tickets without a result are not counted."""
    paid = payout(F.col("hit"), F.col("odds_lo"), stake)
    summed = judged.filter(F.col("hit").isNotNull()).rollup("kind").agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.col("hit").cast("long")).alias("hits"), F.sum(paid).alias("_ret"))
    bet, whole = F.col("points") * stake, whole_units(F.col("_ret"))
    return summed.select(
        "kind", "points", "hits", (F.col("hits") / F.col("points") * 100).alias("hit_rate"), bet.alias("bet"),
        whole.alias("ret"), (whole - bet).alias("profit"), (F.col("_ret") / bet * 100).alias("roi"))


def first_payouts(payouts: DataFrame) -> DataFrame:
    """One payout per (contest, kind, legs): the first listed counts."""
    return payouts.groupBy("race_id", "kind", "legs").agg(F.min_by("per100", "seq").alias("per100"))


def settle(tickets: DataFrame, payouts: DataFrame, many: Hot | None = None, stake: Column | int = fixed.STAKE) -> DataFrame:
    """JN10 and PL13: ``ret`` is NULL while the kind has no payouts, 0 without a match, else whole units."""
    hot = many or find_hot(tickets, "race_id")
    # the payouts of a contest and kind are a short list
    listed = first_payouts(payouts).groupBy("race_id", "kind").agg(F.collect_list(F.struct("legs", "per100")).alias("_paid"))
    out = lookup(tickets, listed, ["race_id", "kind"], hot)
    per100 = F.get(F.filter("_paid", lambda p: p["legs"] == F.col("legs")), F.lit(0))["per100"]
    unit = F.lit(stake) if isinstance(stake, int) else stake
    won = F.coalesce(F.floor(per100 * unit / 100), F.lit(0))
    return out.withColumn("ret", F.when(F.col("_paid").isNotNull(), won).cast("long")).drop("_paid")


def day_summary(settled: DataFrame, races: DataFrame, payouts: DataFrame, stake: int = fixed.STAKE) -> DataFrame:
    """AG20: totals per day over contests with results, and how many contests with tickets lack them."""
    per_race = settled.groupBy("race_id").agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.when(F.col("ret") > 0, 1).otherwise(0)).alias("hits"),
        F.coalesce(F.sum("ret"), F.lit(0)).alias("ret"))
    known = payouts.select("race_id").distinct().withColumn("done", F.lit(True))
    days = races.select("race_id", "race_date").join(per_race, "race_id").join(known, "race_id", "left")
    done = F.coalesce(F.col("done"), F.lit(False))
    counted = {n: F.sum(F.when(done, c).otherwise(0)) for n, c in (
        ("points", F.col("points")), ("bet", F.col("points") * stake), ("hits", F.col("hits")), ("ret", F.col("ret")))}
    return days.groupBy("race_date").agg(
        *[c.alias(n) for n, c in counted.items()], F.sum(F.when(done, 0).otherwise(1)).alias("missing"))


def missing_races(tickets: DataFrame, races: DataFrame, payouts: DataFrame) -> DataFrame:
    """AG20: the contests with tickets and no payouts."""
    lacking = tickets.select("race_id").distinct().join(payouts.select("race_id").distinct(), "race_id", "left_anti")
    return races.select("race_id", "race_date").join(lacking, "race_id")
