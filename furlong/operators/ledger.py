"""Purchase ledger reports.  A ticket without a return is pending."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.operators.relative import running_total

TOTALS = ["points", "settled_points", "hits", "purchased", "bet", "pending_bet", "ret", "profit"]


def ticket_totals() -> list[Column]:
    """AG14, FL11: totals as aggregates over any grouping."""
    done = F.col("ret").isNotNull()
    bet = F.coalesce(F.sum(F.when(done, F.col("stake"))), F.lit(0))
    ret = F.coalesce(F.sum("ret"), F.lit(0))
    return [
        F.count(F.lit(1)).alias("points"), F.count("ret").alias("settled_points"),
        F.sum(F.when(F.col("ret") > 0, 1).otherwise(0)).alias("hits"),
        F.coalesce(F.sum("stake"), F.lit(0)).alias("purchased"), bet.alias("bet"),
        (F.coalesce(F.sum("stake"), F.lit(0)) - bet).alias("pending_bet"),
        ret.alias("ret"), (ret - bet).alias("profit"), F.when(bet > 0, ret / bet * 100).alias("roi"),
    ]


def totals(ledger: DataFrame, *keys: str) -> DataFrame:
    """AG14 without keys, AG16 by kind, AG17 by contest."""
    return ledger.groupBy(*keys).agg(*ticket_totals())


def by_day(ledger: DataFrame) -> DataFrame:
    """AG15, WN12: one row per day with the running profit."""
    return running_total(totals(ledger, "bet_date"), "profit", "cumulative_profit")


def by_race(ledger: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """AG17: per contest, with the reason while something is pending.

    ``reasons(race_id, reason)`` are known failures; without one the contest has no payouts at all
    or none for the pending kinds.  The tickets themselves stay rows of the ledger.
    """
    out = totals(ledger, "race_id")
    waiting = F.when(F.col("settled_points") == 0, "no payouts yet").otherwise("no payouts for the kind")
    if reasons is not None:
        out = out.join(reasons, "race_id", "left")
        waiting = F.coalesce(F.col("reason"), waiting)
    return out.withColumn("pending_reason", F.when(F.col("pending_bet") > 0, waiting)).select(
        "race_id", *TOTALS, "roi", "pending_reason")


def by_period(ledger: DataFrame) -> DataFrame:
    """AG18: day, month, year and whole, each from its own sums."""
    dated = ledger.withColumns({"yr": F.year("bet_date"), "mon": F.month("bet_date"), "dom": F.dayofmonth("bet_date")})
    return dated.rollup("yr", "mon", "dom").agg(*ticket_totals())


def month_spine(ledger: DataFrame, year: int) -> DataFrame:
    """JN16: the twelve months of a year, months without tickets as zeros, with the running profit."""
    first, last = (F.lit(datetime.date(year, m, 1)) for m in (1, 12))
    months = ledger.sparkSession.range(1).select(
        F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month"))
    mine = ledger.filter(F.year("bet_date") == year).withColumn("month", F.trunc("bet_date", "month"))
    joined = months.join(totals(mine, "month"), "month", "left")
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in TOTALS})
    return running_total(joined, "profit", "cumulative_profit", "month")


def in_scope(
    ledger: DataFrame, place=None, race_no=None, kind: str | None = None, first: str | None = None, last: str | None = None,
) -> DataFrame:
    """FL05: optional filters; they reach the scan."""
    if first and last and first > last:
        raise ValueError("the first day lies after the last")
    wanted = [
        (place, lambda v: F.col("place") == v), (race_no, lambda v: F.col("race_no") == v), (kind, lambda v: F.col("kind") == v),
        (first, lambda v: F.col("bet_date") >= F.lit(v).cast("date")), (last, lambda v: F.col("bet_date") <= F.lit(v).cast("date")),
    ]
    for value, test in wanted:
        if value is not None:
            ledger = ledger.filter(test(value))
    return ledger


def in_mode(tickets: DataFrame, mode: str, stake: int = fixed.STAKE) -> DataFrame:
    """FL06: what was bought at its own stake, or what was notified at one stake.

    ``tickets`` carry ``source`` (bought or notified) and ``unit``, the confirmed stake or NULL.
    """
    if mode == "actual":
        return tickets.filter((F.col("source") == "bought") & F.col("unit").isNotNull()).withColumn("stake", F.col("unit"))
    if mode != "simulation":
        raise ValueError("mode is actual or simulation")
    if not 100 <= stake <= 1_000_000 or stake % 100:
        raise ValueError("stake must be whole hundreds from 100 to 1,000,000")
    return tickets.filter(F.col("source") == "notified").withColumn("stake", F.lit(stake))


def source_counts(races: DataFrame) -> DataFrame:
    """AG19: ``races`` has one row per contest with place, race_date, unit and tickets (a count)."""
    bought = F.col("unit").isNotNull()
    return races.agg(
        F.count(F.lit(1)).alias("races"), F.count_if(bought).alias("purchased_races"),
        F.count_if(~bought & (F.col("tickets") > 0)).alias("unconfirmed_races"),
        F.count_distinct("place").alias("places"), F.count_distinct(F.year("race_date")).alias("years"))


def newest_first(races: DataFrame) -> DataFrame:
    """SO08."""
    return races.orderBy(F.col("start").desc(), F.col("race_id").desc())


def pending_order(races: DataFrame) -> DataFrame:
    """SO07: bought contests first, then the latest."""
    return races.orderBy(F.col("unit").isNotNull().desc(), F.col("start").desc())
