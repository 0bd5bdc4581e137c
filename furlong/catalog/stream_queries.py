"""Streaming queries (ST01-ST07).  Events land in three steps; after each the stream runs over what is new and stops."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.catalog import views as v
from furlong.catalog.registry import query, with_
from furlong.session import scratch_path
from furlong.streaming import streams as st

CUTS = ["2024-01-11", "2024-01-21"]


def events(spark, sf) -> DataFrame:
    return v.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("race_id"), F.col("event_type").alias("kind"), "value")


def landed(spark, sf, chunks, work, path=None, mode="append"):
    """Write chunk after chunk to the landing folder and drain the stream after each."""
    path = path or scratch_path(spark, "stream")
    dropped = 0
    schema = None
    for chunk in chunks:
        chunk.write.mode("append").parquet(f"{path}/in")
        stream = work(spark.readStream.schema(chunk.schema).parquet(f"{path}/in"))
        schema = stream.schema
        dropped += st.drain(stream, path, mode)["dropped"]
    return path, schema, dropped


def by_time(df: DataFrame, column: str = "ts") -> list[DataFrame]:
    t = F.col(column)
    first, second = (F.lit(c).cast("timestamp") for c in CUTS)
    return [df.filter(t < first), df.filter((t >= first) & (t < second)), df.filter(t >= second)]


def out(spark, path, schema):
    return st.results(spark, path, schema)


def shown(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("st01_latest_quotes", """select race_id, kind, leg, round(odds, 6) as odds, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as fetched_at from (
 select user_id as race_id, event_type as kind, cast(event_id % 3 as int) as leg, value as odds, ts, row_number() over (partition by user_id, event_type, event_id % 3 order by ts desc) as n from events) where n = 1""")
def st01(spark, sf):
    rows = events(spark, sf).select(
        "race_id", "kind", F.array((F.col("event_id") % 3).cast("int")).alias("legs"), F.col("value").alias("odds_lo"), F.col("value").alias("odds_hi"), F.col("ts").alias("fetched_at"))
    path, schema, _ = landed(spark, sf, by_time(rows, "fetched_at"), st.latest_quotes, mode="update")
    last = st.latest_results(out(spark, path, schema), ["race_id", "kind", "legs"])
    return last.select("race_id", "kind", F.get("legs", F.lit(0)).alias("leg"), v.r6("odds_lo").alias("odds"), shown("fetched_at").alias("fetched_at"))


@query("st01_snapshot_table", """select ts::date as race_date, event_type as kind, user_id as race_id, cast(event_id % 3 as int) as leg, round(max(struct_pack(ts := ts, value := value)).value, 6) as odds,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as fetched_at from events group by 1, 2, 3, 4""")
def st01_snapshot(spark, sf):
    """Quotes arrive in three steps, the last day of the first two once more, and the last batch is merged again: one newest row for every ticket of a day."""
    rows = events(spark, sf).select(
        "race_id", F.array((F.col("event_id") % 3).cast("int")).alias("legs"), F.col("value").alias("odds_lo"), F.col("value").alias("odds_hi"),
        F.col("ts").alias("fetched_at"), F.col("ts").cast("date").alias("race_date"), "kind")
    path = scratch_path(spark, "stream")
    chunks = by_time(rows, "fetched_at")
    chunks[2] = chunks[2].unionByName(chunks[1].filter(F.col("fetched_at") >= F.lit("2024-01-20").cast("timestamp")))
    for chunk in chunks:
        chunk.write.mode("append").parquet(f"{path}/in")
        st.snapshot(spark.readStream.schema(chunk.schema).parquet(f"{path}/in"), f"{path}/table", f"{path}/state")
    st.merge_quotes(chunks[2], f"{path}/table")
    back = spark.read.schema(st.QUOTE).parquet(f"{path}/table")
    return back.select("race_date", "kind", "race_id", F.get("legs", F.lit(0)).alias("leg"), v.r6("odds_lo").alias("odds"), shown("fetched_at").alias("fetched_at"))


@query("st02_due_races", """select s.event_id as race_id, c.event_id as tick from events s join events c on c.ts >= s.ts - interval 3 minute and c.ts < s.ts
where s.event_type = 'purchase' and c.event_type = 'view'""")
def st02(spark, sf):
    rows = events(spark, sf)
    schedule = rows.filter(F.col("kind") == "purchase").select(F.col("event_id").alias("race_id"), F.col("ts").alias("start"))
    ticks = rows.filter(F.col("kind") == "view").select(F.col("event_id").alias("tick"), F.col("ts").alias("now"))
    path, schema, _ = landed(spark, sf, by_time(ticks, "now"), lambda s: st.due_races(schedule, s))
    return out(spark, path, schema).select("race_id", "tick")


@query("st03_tickets_once", "select distinct user_id * 100 + day(ts) as race_id from events where event_type = 'view'")
def st03(spark, sf):
    """A contest is a user's day."""
    rows = events(spark, sf).filter(F.col("kind") == "view").select((F.col("race_id") * 100 + F.dayofmonth("ts")).alias("race_id"), "ts", "value")
    path, schema, _ = landed(spark, sf, by_time(rows), st.tickets_once)
    return out(spark, path, schema).select("race_id")


def closed(rows: DataFrame, chunks: list[DataFrame], *times: str) -> list[DataFrame]:
    """One more chunk: a row long after all others, so that the watermark passes everything before it."""
    far = F.lit("2030-01-01").cast("timestamp")
    return [*chunks, rows.orderBy("event_id").limit(1).withColumns({t: far for t in times})]


_CONTEST = "(user_id % 7) * 1000 + day(ts) * 24 + hour(ts) as race_id"


@query("st04_settle_stream", f"""with t as (select event_id, {_CONTEST}, event_id % 3 as leg from events where event_type = 'purchase'),
p as (select {_CONTEST}, min(event_id) % 60 + 20 as minutes from events where event_type in ('click', 'view', 'signup') group by 1),
e as (select {_CONTEST}, event_id % 3 as leg, arg_min(floor(value * 10), event_id) as per100 from events where event_type in ('click', 'view', 'signup') group by 1, 2)
select t.event_id, cast(case when p.minutes <= 60 then coalesce(floor(e.per100 * 200 / 100), 0) end as bigint) as ret
from t left join p using (race_id) left join e on e.race_id = t.race_id and e.leg = t.leg""")
def st04(spark, sf):
    """Tickets and payouts arrive in one feed.  A contest is an hour of a few users; its payouts come 20 to 79 minutes after the start, and later than an hour is never."""
    rows = events(spark, sf)
    leg = F.array((F.col("event_id") % 3).cast("int"))
    named = rows.withColumns({"race_id": (F.col("race_id") % 7) * 1000 + F.dayofmonth("ts") * 24 + F.hour("ts"), "start": F.date_trunc("hour", "ts"), "legs": leg})
    tickets = named.filter(F.col("kind") == "purchase").select("event_id", "race_id", "legs", "start")
    entry = F.struct("event_id", "legs", F.floor(F.col("value") * 10).alias("per100"))
    paid = named.filter(F.col("kind").isin("click", "view", "signup")).groupBy("race_id", "start").agg(
        F.min("event_id").alias("event_id"), F.array_sort(F.collect_list(entry)).alias("entries"))
    minutes = F.make_dt_interval(mins=(F.col("event_id") % 60 + 20).cast("int"))
    paid = paid.select("event_id", "race_id", "start", (F.col("start") + minutes).alias("paid_at"), F.transform("entries", lambda e: F.struct(e["legs"].alias("legs"), e["per100"].alias("per100"))).alias("entries"))
    feed = tickets.unionByName(paid, allowMissingColumns=True)

    def work(stream):
        known = stream.withColumn("kind", F.lit("win"))
        bought = known.filter(F.col("paid_at").isNull()).select("event_id", "race_id", "kind", "legs", "start", F.lit(200).alias("stake"))
        return st.settle_stream(bought, known.filter(F.col("paid_at").isNotNull()).select("race_id", "kind", "paid_at", "entries"))

    ends = closed(tickets, [], "start") + closed(paid, [], "start", "paid_at")
    path, schema, _ = landed(spark, sf, by_time(feed, "start") + [ends[0].unionByName(ends[1], allowMissingColumns=True)], work)
    return out(spark, path, schema).select("event_id", "ret")


def _ledger(rows):
    ret = F.when(F.col("kind") == "error", F.lit(None)).when(F.col("value") > 60, F.floor(F.col("value") * 2)).otherwise(0)
    return rows.withColumns({"stake": F.lit(100), "ret": ret.cast("long")})


@query("st05_daily_ledger", with_(v.LEDGER_SQL, """select bet_date, kind, count(*) as points, count(ret) as settled_points, cast(coalesce(sum(case when ret is not null then stake end), 0) as bigint) as bet, cast(coalesce(sum(ret), 0) as bigint) as ret,
 cast(coalesce(sum(ret), 0) - coalesce(sum(case when ret is not null then stake end), 0) as bigint) as profit from ledger group by 1, 2"""))
def st05(spark, sf):
    rows = _ledger(events(spark, sf))
    path, schema, _ = landed(spark, sf, closed(rows, by_time(rows), "ts"), st.daily_ledger)
    return out(spark, path, schema).select("bet_date", "kind", "points", "settled_points", "bet", "ret", "profit")


@query("st06_lifecycle", """with t as (select user_id as race_id, min(case when event_type = 'view' then ts end) as a, min(case when event_type = 'purchase' then ts end) as b, min(case when event_type = 'click' then ts end) as c from events group by 1)
select race_id, 'proposed' as step, strftime(a, '%Y-%m-%d %H:%M:%S.%f') as at from t where a is not null
union all select race_id, 'purchased', strftime(greatest(a, b), '%Y-%m-%d %H:%M:%S.%f') from t where a is not null and b is not null
union all select race_id, 'settled', strftime(greatest(a, b, c), '%Y-%m-%d %H:%M:%S.%f') from t where a is not null and b is not null and c is not null""")
def st06(spark, sf):
    """Users' events as steps; a last row, long after all others, lets every contest leave the state."""
    names = F.when(F.col("kind") == "view", "proposed").when(F.col("kind") == "purchase", "purchased").when(F.col("kind") == "click", "settled").otherwise("other")
    rows = events(spark, sf).select("event_id", "race_id", names.alias("step"), F.col("ts").alias("at"))
    *_, end = closed(rows, [], "at")
    end = end.withColumns({"race_id": F.lit(-1).cast("long"), "step": F.lit("proposed")})
    before = spark.conf.get(st.STATE_STORE_KEY, None)
    spark.conf.set(st.STATE_STORE_KEY, st.STATE_STORE)
    try:
        work = lambda s: st.lifecycle(s, gone=timedelta(days=60))
        path, schema, _ = landed(spark, sf, by_time(rows, "at"), work)
        end.write.mode("append").parquet(f"{path}/in")
        state = st.drain(work(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), path)["state"]
        if not state or state[-1] >= max(state):
            raise RuntimeError("no contest has left the state")
    finally:
        if before is None:
            spark.conf.unset(st.STATE_STORE_KEY)
        else:
            spark.conf.set(st.STATE_STORE_KEY, before)
    return out(spark, path, schema).filter("race_id >= 0").select("race_id", "step", shown("at").alias("at"))


@query("st07_late_rows", with_(v.LEDGER_SQL, """select bet_date, kind, count(*) as points from ledger where not (kind = 'error' and bet_date in (date '2024-01-01', date '2024-01-02')) group by 1, 2"""))
def st07(spark, sf):
    """One kind of the 20th arrives late but in time, that of the first two days too late for the watermark."""
    rows = _ledger(events(spark, sf))
    day = F.col("ts").cast("date")
    early = F.col("ts") < F.lit("2024-01-21").cast("timestamp")
    held = (F.col("kind") == "error") & day.cast("string").isin("2024-01-01", "2024-01-02", "2024-01-20")
    chunks = closed(rows, [rows.filter(early & ~held), rows.filter(early & held), rows.filter(~early)], "ts")
    path, schema, dropped = landed(spark, sf, chunks, lambda s: st.daily_ledger(s, "3 days"))
    if dropped == 0:
        raise RuntimeError("late rows were not counted")
    return out(spark, path, schema).select("bet_date", "kind", "points")
