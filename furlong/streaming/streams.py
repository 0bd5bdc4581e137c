"""Streams of quotes, tickets, payouts and race events.

The operators take and return streaming DataFrames; ``drain`` runs one of them over everything
that has arrived and stops, keeping state in its checkpoint, so the next run goes on from there.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from furlong.session import cut
from furlong.sources.sinks import write_quotes

STATE_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEAD = "3 minutes"
RESULTS_AFTER = "20 minutes"
GIVE_UP = "60 minutes"
#: How long after its newest step a contest is kept.
GONE = timedelta(days=2)


def latest_quotes(quotes: DataFrame, late: str = "1 day") -> DataFrame:
    """ST01: the newest quote per ticket and day; run in update mode.

    State goes when the watermark has passed the day, so it holds the tickets of a few days; ``latest_results`` takes the newest over all days.
    """
    newest = F.max_by(F.struct("odds_lo", "odds_hi", "fetched_at"), "fetched_at")
    days = quotes.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", "1 day"), "race_id", "kind", "legs")
    return days.agg(newest.alias("q")).select("race_id", "kind", "legs", "q.*")


def due_races(schedule: DataFrame, clock: DataFrame) -> DataFrame:
    """ST02: contests due at a tick: from three minutes before the start up to it.

    Both sides carry the minute, so a tick meets the contests of four minutes and not the whole schedule.
    """
    minute = lambda c: F.date_trunc("minute", c)
    spread = schedule.withColumn("_minute", F.explode(F.sequence(
        minute(F.col("start") - F.expr(f"interval {LEAD}")), minute(F.col("start")), F.expr("interval 1 minute"))))
    ticks = clock.withColumn("_minute", minute(F.col("now")))
    due = (F.col("now") >= F.col("start") - F.expr(f"interval {LEAD}")) & (F.col("now") < F.col("start"))
    return ticks.join(spread, "_minute").filter(due).drop("_minute")


def tickets_once(proposals: DataFrame, time: str = "ts", within: str = "2 days") -> DataFrame:
    """ST03: one proposal per contest, also after a restart from the checkpoint.

    The proposals of a contest lie within ``within`` of each other; after that its state goes.
    """
    return proposals.withWatermark(time, within).dropDuplicatesWithinWatermark(["race_id"])


def settle_stream(tickets: DataFrame, payouts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST04: every ticket once, with its return; ``ret`` is NULL if no payouts of its kind arrive within the waiting time.

    ``tickets(race_id, kind, legs, stake, start, ...)``, ``payouts(race_id, kind, paid_at, entries)`` with the entries (legs, per100) of a
    contest and kind in their order.  The first payouts of a contest and kind count, and of its entries the first with the ticket's legs.
    """
    left = tickets.withWatermark("start", late)
    first = payouts.withWatermark("paid_at", late).dropDuplicatesWithinWatermark(["race_id", "kind"])
    right = first.withColumnsRenamed({"race_id": "_race", "kind": "_kind", "entries": "_entries"})
    inside = (
        (F.col("race_id") == F.col("_race")) & (F.col("kind") == F.col("_kind"))
        & (F.col("paid_at") >= F.col("start") + F.expr(f"interval {RESULTS_AFTER}"))
        & (F.col("paid_at") <= F.col("start") + F.expr(f"interval {GIVE_UP}"))
    )
    match = F.get(F.filter("_entries", lambda e: e["legs"] == F.col("legs")), F.lit(0))["per100"]
    ret = F.when(F.col("_entries").isNotNull(), F.coalesce(F.floor(match * F.col("stake") / 100), F.lit(0))).cast("long")
    return left.join(right, inside, "leftOuter").withColumn("ret", ret).drop("_race", "_kind", "_entries")


def daily_ledger(tickets: DataFrame, late: str = "1 day", time: str = "ts") -> DataFrame:
    """ST05, ST07: totals per day and kind; a day is final when the watermark has passed it."""
    done = F.col("ret").isNotNull()
    return tickets.withWatermark(time, late).groupBy(F.window(time, "1 day"), "kind").agg(
        F.count(F.lit(1)).alias("points"), F.count("ret").alias("settled_points"),
        F.sum(F.when(done, F.col("stake")).otherwise(0)).alias("bet"), F.sum(F.coalesce("ret", F.lit(0))).alias("ret"),
    ).withColumns({"bet_date": F.col("window.start").cast("date"), "profit": F.col("ret") - F.col("bet")}).drop("window")


STEPS = ["proposed", "purchased", "settled"]
TRANSITION = T.StructType([
    T.StructField("race_id", T.LongType()), T.StructField("step", T.StringType()), T.StructField("at", T.TimestampType())])


def _first_times():
    steps = list(STEPS)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch[batch["step"].isin(steps)]
            yield known.groupby(["race_id", "step"], as_index=False)["at"].min()

    return reduce


def _lifecycle(gone: int):
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Lifecycle(StatefulProcessor):
        """Per contest the first time of each step and how many steps were passed on."""

        steps = ["proposed", "purchased", "settled"]

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("steps", "first array<long>, passed int")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            stored = self.state.get()
            first, passed = (list(stored[0]), stored[1]) if stored is not None else ([-1, -1, -1], 0)
            for batch in rows:
                for step, at in batch.groupby("step")["at"].min().items():
                    i, value = self.steps.index(step), pd.Timestamp(at).as_unit("ns").value
                    first[i] = value if first[i] < 0 else min(first[i], value)
            out = []
            while passed < len(self.steps) and first[passed] >= 0:
                out.append((key[0], self.steps[passed], pd.Timestamp(max(first[: passed + 1]))))
                passed += 1
            self.state.update((first, passed))
            # the timer moves on with the contest's newest step
            last = max(first) // 1_000_000 + gone
            for timer in list(self.handle.listTimers()):
                last = max(last, timer)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last)
            yield pd.DataFrame(out, columns=["race_id", "step", "at"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.state.clear()
            yield pd.DataFrame([], columns=["race_id", "step", "at"])

        def close(self) -> None:
            pass

    return Lifecycle()


def lifecycle(events: DataFrame, late: str = "1 day", gone: timedelta = GONE) -> DataFrame:
    """ST06: proposed, purchased, settled - each passed on once, when the steps before it have been seen too.

    Only the first time of a step counts, so every Arrow batch is cut to one row per contest and step before the shuffle; state per contest is
    three times, a counter and a timer.  Settled or not, a contest leaves the state when the watermark has passed its newest step by ``gone``.
    """
    schema = T.StructType([T.StructField("race_id", T.LongType()), T.StructField("step", T.StringType()), T.StructField("at", T.TimestampType())])
    steps = events.select("race_id", "step", "at").mapInPandas(_first_times(), schema).withWatermark("at", late)
    return steps.groupBy("race_id").transformWithStateInPandas(
        statefulProcessor=_lifecycle(int(gone.total_seconds() * 1000)), outputStructType=TRANSITION, outputMode="Append", timeMode="EventTime")


QUOTE = "race_id long, legs array<int>, odds_lo double, odds_hi double, fetched_at timestamp, race_date date, kind string"


def merge_quotes(batch: DataFrame, table: str) -> None:
    """ST01: the newest quotes of a batch into the snapshot ``table``, which has one row a ticket and a folder for each day and kind.

    Only the days and kinds of the batch are read and written anew, all at the end.  The newest row of old and new is the same however often
    a batch comes, so a repeated batch changes nothing, and one that failed half-way may be repeated.
    """
    spark = batch.sparkSession
    columns = spark.createDataFrame([], QUOTE).columns
    keys = ["race_date", "kind", "race_id", "legs"]
    quote = ["fetched_at", "odds_lo", "odds_hi"]  # of equal times the higher quote

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max(F.struct(*quote)).alias("_q")).select(*keys, "_q.*").select(*columns)

    fresh = cut(newest(batch.select(*columns)))
    touched = fresh.select("race_date", "kind").distinct()
    old = spark.read.schema(QUOTE).parquet(table).join(touched, ["race_date", "kind"], "left_semi").select(*columns)
    write_quotes(cut(newest(old.unionByName(fresh))), table)


def snapshot(quotes: DataFrame, table: str, state: str) -> None:
    """ST01: brings the snapshot table up to what has arrived; a reader needs no history."""
    quotes.sparkSession.createDataFrame([], QUOTE).write.mode("append").partitionBy("race_date", "kind").parquet(table)
    run = quotes.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda batch, _: merge_quotes(batch, table)).start()
    run.awaitTermination()


def drain(stream: DataFrame, path: str, mode: str = "append") -> dict:
    """Process what is there and stop; results below ``path``/out, one folder per batch.

    A repeated batch overwrites its folder, so restarts neither lose nor repeat rows.  Returns how
    many rows came too late for the watermark, and the rows of state after every batch.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    seen = _Dropped()
    stream.sparkSession.streams.addListener(seen)
    try:
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
        run.awaitTermination()
        seen.ended(str(run.runId))
    finally:
        stream.sparkSession.streams.removeListener(seen)
    return {"dropped": seen.rows.get(str(run.runId), 0), "state": seen.state.get(str(run.runId), [])}


class _Dropped(StreamingQueryListener):
    """Rows that came too late, over all batches of a run, however many."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.state: dict[str, list[int]] = {}
        self.over: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + late
        self.state.setdefault(run, []).append(sum(o.numRowsTotal for o in event.progress.stateOperators))

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.over.add(str(event.runId))
            self.news.notify_all()

    def ended(self, run: str) -> None:
        """Events come in order, so after the last one all progress has been seen."""
        with self.news:
            self.news.wait_for(lambda: run in self.over, timeout=60)


def results(spark, path: str, schema: T.StructType) -> DataFrame:
    """Everything a drained stream has put out, with the batch number."""
    fields = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(fields).parquet(f"{path}/out")


def latest_results(rows: DataFrame, keys: list[str], time: str = "fetched_at") -> DataFrame:
    """The newest row of every key of an update-mode stream, of equal times the last version."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(time, "batch")).alias("v")).select(*keys, "v.*")
