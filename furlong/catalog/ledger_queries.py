"""Queries on the purchase ledger (AG14-AG19, FL05, FL06, FL11, JN16, WN12, SO07, SO08, AG26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.catalog import views as v
from furlong.catalog.registry import query, with_
from furlong.operators import ledger as lg

LEDGER = v.LEDGER_SQL

_T = """count(*) as points, count(ret) as settled_points, cast(sum(case when ret > 0 then 1 else 0 end) as bigint) as hits, cast(sum(stake) as bigint) as purchased,
 cast(coalesce(sum(case when ret is not null then stake end), 0) as bigint) as bet, cast(coalesce(sum(case when ret is null then stake end), 0) as bigint) as pending_bet,
 cast(coalesce(sum(ret), 0) as bigint) as ret, cast(coalesce(sum(ret), 0) - coalesce(sum(case when ret is not null then stake end), 0) as bigint) as profit,
 case when count(ret) > 0 then round(sum(ret) / sum(case when ret is not null then stake end)::double * 100, 6) + 0 end as roi"""


def _shown(df, *keys):
    return df.select(*keys, *lg.TOTALS, v.r6("roi").alias("roi"))


@query("ag14_ledger_totals", with_(LEDGER, f"select {_T} from ledger"))
def ag14(spark, sf):
    return _shown(lg.totals(v.ledger(spark, sf)))


@query("ag15_ledger_by_day", with_(LEDGER, f"days as (select bet_date, {_T} from ledger group by bet_date)",
       "select *, cast(sum(profit) over (order by bet_date) as bigint) as cumulative_profit from days"))
def ag15(spark, sf):
    return _shown(lg.by_day(v.ledger(spark, sf)), "bet_date", "cumulative_profit")


@query("wn12_running_profit", with_(LEDGER, """days as (select bet_date, sum(coalesce(ret, 0) - case when ret is null then 0 else stake end) as profit from ledger group by 1)""",
       "select bet_date, cast(profit as bigint) as profit, cast(sum(profit) over (order by bet_date rows between unbounded preceding and current row) as bigint) as total from days"))
def wn12(spark, sf):
    from furlong.operators.relative import running_total

    profit = F.coalesce("ret", F.lit(0)) - F.when(F.col("ret").isNull(), 0).otherwise(F.col("stake"))
    days = v.ledger(spark, sf).groupBy("bet_date").agg(F.sum(profit).cast("long").alias("profit"))
    return running_total(days, "profit", "total")


@query("ag16_ledger_by_kind", with_(LEDGER, f"select kind, {_T} from ledger group by kind"))
def ag16(spark, sf):
    return _shown(lg.totals(v.ledger(spark, sf), "kind"), "kind")


@query("ag17_ledger_by_race", with_(LEDGER, f"t as (select race_id, {_T} from ledger group by race_id)", """
select *, case when pending_bet > 0 then case when race_id % 7 = 0 then 'refund in the payouts' when settled_points = 0 then 'no payouts yet' else 'no payouts for the kind' end end as pending_reason from t"""))
def ag17(spark, sf):
    rows = v.ledger(spark, sf)
    reasons = rows.filter(F.col("race_id") % 7 == 0).select("race_id", F.lit("refund in the payouts").alias("reason")).distinct()
    return _shown(lg.by_race(rows, reasons), "race_id", "pending_reason")


@query("ag18_ledger_by_period", with_(LEDGER, f"""select cast(year(bet_date) as int) as yr, cast(month(bet_date) as int) as mon, cast(day(bet_date) as int) as dom, {_T} from ledger
group by rollup(cast(year(bet_date) as int), cast(month(bet_date) as int), cast(day(bet_date) as int))"""))
def ag18(spark, sf):
    return _shown(lg.by_period(v.ledger(spark, sf)), "yr", "mon", "dom")


@query("jn16_month_spine", with_(LEDGER, f"""months as (select cast(unnest(generate_series(timestamp '2024-01-01', timestamp '2024-12-01', interval 1 month)) as date) as month),
t as (select cast(date_trunc('month', bet_date) as date) as month, {_T} from ledger where year(bet_date) = 2024 group by 1),
filled as (select m.month, {', '.join(f'coalesce(t.{c}, 0) as {c}' for c in lg.TOTALS)}, t.roi from months m left join t on t.month = m.month)""",
 "select *, cast(sum(profit) over (order by month) as bigint) as cumulative_profit from filled"))
def jn16(spark, sf):
    return _shown(lg.month_spine(v.ledger(spark, sf), 2024), "month", "cumulative_profit")


@query("fl05_scope_filters", with_(LEDGER, f"select kind, {_T} from ledger where place = 3 and bet_date between date '2024-01-05' and date '2024-01-20' group by kind"))
def fl05(spark, sf):
    rows = lg.in_scope(v.ledger(spark, sf), place=3, first="2024-01-05", last="2024-01-20")
    return _shown(lg.totals(rows, "kind"), "kind")


@query("fl06_purchase_modes", with_(LEDGER, """src as (select ticket_id, kind, ret, case when ticket_id % 3 = 0 then 'notified' else 'bought' end as source, case when ticket_id % 5 <> 0 then 300 end as unit from ledger),
modes as (select 'actual' as mode, kind, unit as stake from src where source = 'bought' and unit is not null union all select 'simulation', kind, 500 from src where source = 'notified')""",
 "select mode, kind, count(*) as points, cast(sum(stake) as bigint) as purchased from modes group by 1, 2"))
def fl06(spark, sf):
    rows = v.ledger(spark, sf).drop("stake").withColumns({
        "source": F.when(F.col("ticket_id") % 3 == 0, "notified").otherwise("bought"),
        "unit": F.when(F.col("ticket_id") % 5 != 0, F.lit(300))})
    both = [lg.in_mode(rows, m, 500).select(F.lit(m).alias("mode"), "kind", "stake") for m in ("actual", "simulation")]
    return both[0].unionByName(both[1]).groupBy("mode", "kind").agg(F.count(F.lit(1)).alias("points"), F.sum("stake").alias("purchased"))


@query("fl11_settled_or_pending", with_(LEDGER, "select ret is null as pending, count(*) as tickets, cast(sum(stake) as bigint) as stake from ledger group by 1"))
def fl11(spark, sf):
    return v.ledger(spark, sf).groupBy(F.col("ret").isNull().alias("pending")).agg(F.count(F.lit(1)).alias("tickets"), F.sum("stake").alias("stake"))


_RACES = """races as (select race_id, max(ts) as start, min(bet_date) as race_date, race_id % 10 as place, case when race_id % 3 = 0 then 300 end as unit, count(*) as tickets from ledger group by race_id)"""


def races(spark, sf):
    return v.ledger(spark, sf).groupBy("race_id").agg(
        F.max("ts").alias("start"), F.min("bet_date").alias("race_date"), F.count(F.lit(1)).alias("tickets")
    ).withColumns({"place": F.col("race_id") % 10, "unit": F.when(F.col("race_id") % 3 == 0, F.lit(300))})


@query("ag19_source_counts", with_(LEDGER, _RACES, """select count(*) as races, count(unit) as purchased_races, cast(sum(case when unit is null and tickets > 0 then 1 else 0 end) as bigint) as unconfirmed_races,
 count(distinct place) as places, count(distinct year(race_date)) as years from races"""))
def ag19(spark, sf):
    return lg.source_counts(races(spark, sf))


@query("so07_pending_order", with_(LEDGER, _RACES, "select race_id, unit is not null as bought, cast(row_number() over (order by (unit is not null) desc, start desc) as int) as place from races"))
def so07(spark, sf):
    return _ordered(lg.pending_order(races(spark, sf)), F.col("unit").isNotNull().desc(), F.col("start").desc()).select(
        "race_id", F.col("unit").isNotNull().alias("bought"), "place")


@query("so08_newest_first", with_(LEDGER, _RACES, "select race_id, cast(row_number() over (order by start desc, race_id desc) as int) as place from races"))
def so08(spark, sf):
    return _ordered(lg.newest_first(races(spark, sf)), F.col("start").desc(), F.col("race_id").desc()).select("race_id", "place")


def _ordered(df, *order):
    """The order as a column, numbered over range partitions."""
    from furlong.operators.groups import Aggregated

    return Aggregated(("_all",)).number(df.withColumn("_all", F.lit(0)), "place", *order).drop("_all").orderBy("place")


@query("ag26_quote_counts", with_(v.FIELD_SQL, v.QUOTES_SQL, "select kind, count(*) as quotes, count(distinct race_id) as races from quotes group by kind"))
def ag26(spark, sf):
    return v.quotes(v.field(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("quotes"), F.count_distinct("race_id").alias("races"))
