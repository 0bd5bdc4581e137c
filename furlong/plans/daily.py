"""Daily jobs: tickets from predictions and quotes, settlement, ledger and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.operators import evaluate, grid, ledger, settle, tickets
from furlong.operators.groups import find_hot, lookup
from furlong.session import cut
from furlong.sources import files, sinks


def propose_job(
    predictions: DataFrame, quotes: DataFrame, out: str | None = None, min_value: float = fixed.DEFAULT_MIN_VALUE,
    method: str = "order", rules: dict | None = None, venue: int | None = None, race_no: int | None = None,
) -> DataFrame:
    """PL09 over whole tables; contests with unusable chances are left out (PL10), filters reach the scans (FL05)."""
    for number, at in ((venue, 5), (race_no, 11)):
        if number is not None:
            wanted = F.substring("race_id", at, 2).cast("int") == number
            predictions, quotes = predictions.filter(wanted), quotes.filter(wanted)
    hot = find_hot(predictions, "race_id")
    faulty = tickets.field_faults(predictions).select("race_id", F.lit(True).alias("_faulty"))
    sound = lookup(predictions, faulty, ["race_id"], hot).filter(F.col("_faulty").isNull()).drop("_faulty")
    found = cut(tickets.propose(sound, quotes, hot, min_value, method, rules))
    if out:
        sinks.write_tickets(tickets.ranked(found), out)
    return found


def settle_job(found: DataFrame, results: DataFrame, min_chance: float = fixed.LEG_CHANCE, min_value: float = 2.0, stake: int = fixed.STAKE) -> dict[str, DataFrame]:
    """AG09, AG10, AG11: report of the tickets above the thresholds, and the grid over all of them."""
    hot = find_hot(results, "race_id")
    judged = cut(settle.judge(found, results, hot).withColumn("race_no", F.substring("race_id", 11, 2).cast("int")))
    chosen = judged.filter((F.col("chance") >= min_chance) & (F.col("value") >= min_value))
    cells = cut(grid.threshold_grid(judged, stake))
    return {
        "report": settle.settlement_report(chosen, stake), "unmatched": chosen.filter(F.col("hit").isNull()), "grid": cells,
        "roi": grid.matrix(cells.filter(F.col("level") == "all"), "roi"), "best": grid.best(cells, "roi", 30),
    }


def ledger_tables(contests: DataFrame, payouts: DataFrame, mode: str = "actual", stake: int = fixed.STAKE) -> DataFrame:
    """State documents and payouts to ledger rows (FL06, JN10)."""
    both = [
        contests.select("race_id", "race_date", "place", "race_no", "start", "unit", F.lit(s).alias("source"), F.inline(c))
        for s, c in (("bought", "tickets"), ("notified", "notified"))
    ]
    rows = ledger.in_mode(both[0].unionByName(both[1]), mode, stake)
    settled = settle.settle(rows, payouts, stake=F.col("stake"))
    return settled.withColumnRenamed("race_date", "bet_date")


def ledger_job(spark: SparkSession, states: str, payouts: str, mode: str = "actual", stake: int = fixed.STAKE, **scope) -> dict[str, DataFrame]:
    """AG14-AG19: all ledger reports from the folders of state and payout documents."""
    contests, rejects = files.read_state_log(spark, states)
    contests = cut(contests)
    rows = cut(ledger.in_scope(ledger_tables(contests, files.read_payouts(spark, payouts), mode, stake), **scope))
    counted = contests.withColumn("tickets", F.greatest(F.size("tickets"), F.size("notified")))
    return {
        "summary": ledger.totals(rows), "daily": ledger.by_day(rows), "by_kind": ledger.totals(rows, "kind").orderBy(settle.kind_order("kind")),
        "races": ledger.by_race(rows).join(contests.select("race_id", "start", "place", "race_no", "name"), "race_id"),
        "periods": ledger.by_period(rows), "sources": ledger.source_counts(counted), "tickets": rows, "warnings": rejects,
    }


def evaluate_job(predictions: DataFrame, results: DataFrame, top_n: int = 6) -> dict[str, DataFrame]:
    """FL08, JN12, AG12, AG13, PL14: losses, reliability and combination report of stored predictions."""
    hot = find_hot(predictions, "race_id")
    joined = predictions.join(results.select("race_id", "num", "finish"), ["race_id", "num"])
    matched = evaluate.keep_races(joined, evaluate.same_field(predictions, results), hot)
    rows = cut(evaluate.keep_races(matched, evaluate.valid_race(matched), hot))
    pairs = {f"top{k}": (f"p{k}", F.col("finish") <= k) for k in (1, 2, 3)}
    return {
        "rows": rows, "losses": evaluate.losses(rows, pairs), "reliability": evaluate.reliability(rows, "p1", F.col("finish") == 1),
        "combinations": evaluate.combination_report(evaluate.combinations(rows, hot, top_n)),
    }
