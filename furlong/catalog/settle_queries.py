"""Queries on settlement, payouts and threshold grids (JN07, JN09, JN10, PL12, PL13, AG09-AG11, AG20, SO05, SO09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.catalog import views as v
from furlong.catalog.registry import query, with_
from furlong.functions import fixed
from furlong.operators import grid, settle
from furlong.operators.groups import by_group

FIELD = v.FIELD_SQL

_TOP_SQL = """tops as (select race_id, count(*) as starters, count(finish) as ranked, max(case when finish = 1 then num end) as t1, max(case when finish = 2 then num end) as t2,
 max(case when finish = 3 then num end) as t3, max(case when finish = 1 then frame end) as f1, max(case when finish = 2 then frame end) as f2 from field group by race_id),
judged as (select q.*, t.starters, case when t.ranked >= 3 then case q.kind when 'win' then q.legs[1] = t1 when 'place' then f.finish <= case when t.starters <= 7 then 2 else 3 end
  when 'frame' then list_sort(q.legs) = list_sort([f1, f2]) when 'quinella' then list_sort(q.legs) = list_sort([t1, t2])
  when 'wide' then q.legs[1] in (t1, t2, t3) and q.legs[2] in (t1, t2, t3) and q.legs[1] <> q.legs[2]
  when 'exacta' then q.legs = [t1, t2] when 'trio' then list_sort(q.legs) = list_sort([t1, t2, t3]) when 'trifecta' then q.legs = [t1, t2, t3] end end as hit
 from {source} q left join tops t on t.race_id = q.race_id left join field f on f.race_id = q.race_id and f.num = q.legs[1])"""


def results(spark, sf):
    """Entrants with numbers, frames and finishes as the result table has them."""
    return v.field(spark, sf).select("race_id", "num", "frame", "finish")


@query("pl12_hits", with_(FIELD, v.QUOTES_SQL, _TOP_SQL.format(source="quotes"), """
select kind, array_to_string(legs, '-') as legs, race_id, case when hit is null then -1 when hit then 1 else 0 end as hit from judged"""))
def pl12(spark, sf):
    """Every quote judged; -1 where the contest has fewer than three finishers."""
    judged = settle.judge(v.quotes(v.field(spark, sf)), results(spark, sf), v.hot_races(spark, sf), v.hot_races(spark, sf))
    return judged.select("kind", v.leg_string().alias("legs"), "race_id", F.coalesce(F.col("hit").cast("int"), F.lit(-1)).alias("hit"))


@query("jn07_matched_tickets", with_(FIELD, v.QUOTES_SQL, _TOP_SQL.format(source="quotes"), """
select q.kind, count(*) as tickets, count(t.race_id) as matched, count(*) - count(t.race_id) as unmatched from quotes q
left join (select race_id from field where surface = 'R' group by race_id) t on t.race_id = q.race_id group by q.kind"""))
def jn07(spark, sf):
    """Results of some contests are missing; tickets without one are counted, not dropped."""
    known = results(spark, sf).join(v.field(spark, sf).filter(F.col("surface") == "R").select("race_id").distinct(), "race_id", "left_semi")
    judged = settle.judge(v.quotes(v.field(spark, sf)), known, v.hot_races(spark, sf), v.hot_races(spark, sf))
    return judged.groupBy("kind").agg(
        F.count(F.lit(1)).alias("tickets"), F.count("starters").alias("matched"), F.count_if(F.col("starters").isNull()).alias("unmatched"))


def judged_tickets(spark, sf):
    found = v.tickets(spark, sf).withColumn("race_no", (F.col("race_id") % 14).cast("int"))
    return settle.judge(found, results(spark, sf), v.hot_races(spark, sf), v.hot_races(spark, sf))


_JUDGED = [*v.TICKETS_SQL, "numbered as (select *, cast(race_id % 14 as int) as race_no from tickets)", _TOP_SQL.format(source="numbered")]


@query("ag09_settlement_report", with_(*_JUDGED, """
select kind, count(*) as points, cast(sum(case when hit then 1 else 0 end) as bigint) as hits, round(avg(case when hit then 100.0::double else 0 end), 6) + 0 as hit_rate,
 count(*) * 100 as bet, cast(floor(round(sum(case when hit then round(odds_lo * 100, 6) else 0 end), 4)) as bigint) as ret,
 cast(floor(round(sum(case when hit then round(odds_lo * 100, 6) else 0 end), 4)) as bigint) - count(*) * 100 as profit, round(sum(case when hit then round(odds_lo * 100, 6) else 0 end) / (count(*) * 100)::double * 100, 6) + 0 as roi
from judged where hit is not null group by rollup(kind)"""))
def ag09(spark, sf):
    report = settle.settlement_report(judged_tickets(spark, sf))
    return report.select("kind", "points", "hits", v.r6("hit_rate").alias("hit_rate"), "bet", "ret", "profit", v.r6("roi").alias("roi"))


_GRID = _JUDGED + ["mp(min_chance) as (select unnest([" + ", ".join(f"{t}::double" for t in fixed.CHANCE_GRID) + "]))",
    "mv(min_value) as (select unnest([" + ", ".join(f"{t}::double" for t in fixed.VALUE_GRID) + "]))",
    """grid as (select min_chance, min_value, kind, case when race_no between 1 and 12 then race_no else 0 end as race_no, count(*) as points,
 cast(sum(case when hit then 1 else 0 end) as bigint) as hits, sum(case when hit then round(odds_lo * 100, 6) else 0 end) as paid
 from judged, mp, mv where hit is not null and chance >= min_chance and value >= min_value group by 1, 2, 3, 4)"""]


@query("jn09_threshold_cells", with_(*_GRID, "select min_chance, min_value, cast(sum(points) as bigint) as points, cast(sum(hits) as bigint) as hits from grid group by 1, 2"))
def jn09(spark, sf):
    """Tickets per pair of thresholds, without a row per ticket and pair."""
    table = grid.reached(grid.cells(judged_tickets(spark, sf)))
    return table.groupBy("min_chance", "min_value").agg(F.sum("points").alias("points"), F.sum("hits").alias("hits"))


_LEVELS = " union all ".join(
    f"select '{level}' as level, min_chance, min_value, {'kind' if 'kind' in keys else 'null'} as kind, {'race_no' if 'race_no' in keys else 'null'} as race_no, "
    f"sum(points) as p, sum(hits) as h, sum(paid) as m from grid {'where race_no > 0' if 'race_no' in keys else ''} group by 2, 3{', 4' if 'kind' in keys else ''}{', 5' if 'race_no' in keys else ''}"
    for level, keys in grid.LEVELS.items())
_GRID_FULL = _GRID + [f"levels as ({_LEVELS})"]
_GRID_COLUMNS = """level, min_chance, min_value, kind, race_no, cast(p as bigint) as points, cast(h as bigint) as hits, round(h / p::double * 100, 6) + 0 as hit_rate, cast(p * 100 as bigint) as bet,
 cast(floor(round(m, 4)) as bigint) as ret, cast(floor(round(m, 4)) - p * 100 as bigint) as profit, round(m / (p * 100)::double * 100, 6) + 0 as roi"""


def _shown_grid(table):
    return table.select("level", "min_chance", "min_value", "kind", "race_no", "points", "hits", v.r6("hit_rate").alias("hit_rate"), "bet", "ret", "profit", v.r6("roi").alias("roi"))


@query("ag10_threshold_grid", with_(*_GRID_FULL, f"select {_GRID_COLUMNS} from levels"))
def ag10(spark, sf):
    return _shown_grid(grid.threshold_grid(judged_tickets(spark, sf)))


_PIVOT = ", ".join(f"round(avg(case when min_value = {t} then {{0}} end), 6) + 0 as {grid.value_column(t)}" for t in fixed.VALUE_GRID)


@query("ag11_roi_matrix", with_(*_GRID_FULL, f"select kind, min_chance, {_PIVOT.format('m / (p * 100)::double * 100')} from levels where level = 'kind' group by kind, min_chance"))
def ag11(spark, sf):
    table = grid.threshold_grid(judged_tickets(spark, sf)).filter(F.col("level") == "kind")
    out = grid.matrix(table, "roi", ["kind"])
    return out.select("kind", "min_chance", *[v.r6(c).alias(c) for c in out.columns[2:]])


@query("ag11_point_matrix", with_(*_GRID_FULL, f"select min_chance, {_PIVOT.format('p')} from levels where level = 'all' group by min_chance"))
def ag11_points(spark, sf):
    out = grid.matrix(grid.threshold_grid(judged_tickets(spark, sf)).filter(F.col("level") == "all"), "points")
    return out.select("min_chance", *[v.r6(c).alias(c) for c in out.columns[1:]])


@query("so05_best_cells", with_(*_GRID_FULL, f"""select 'roi' as by_what, {_GRID_COLUMNS} from (select * from levels where level = 'all' and p >= 30 order by m / (p * 100)::double * 100 desc, min_chance, min_value limit 10)
union all select 'profit', {_GRID_COLUMNS} from (select * from levels where level = 'all' and p >= 30 order by floor(round(m, 4)) - p * 100 desc, min_chance, min_value limit 10)"""))
def so05(spark, sf):
    table = v.cut(grid.threshold_grid(judged_tickets(spark, sf)))
    parts = [_shown_grid(grid.best(table, by, 30)).select(F.lit(by).alias("by_what"), "*") for by in ("roi", "profit")]
    return parts[0].unionByName(parts[1])


@query("so09_hit_details", with_(*_JUDGED, """
select race_id, kind, array_to_string(legs, '-') as legs, round(odds_lo, 6) as odds_lo, cast(floor(round(odds_lo * 100, 6)) as bigint) as paid from judged where hit
order by race_id, kind, array_to_string(legs, '-') limit 20"""))
def so09(spark, sf):
    """The detail list of the report shows twenty hits."""
    hits = judged_tickets(spark, sf).filter("hit")
    return hits.select(
        "race_id", "kind", v.leg_string().alias("legs"), v.r6("odds_lo").alias("odds_lo"), F.floor(F.round(F.col("odds_lo") * 100, 6)).alias("paid")
    ).orderBy("race_id", "kind", "legs").limit(20)


def payouts(spark, sf):
    """Payouts from the finishes: win, place, quinella, exacta and trio; some contests have none yet."""
    placed = by_group(results(spark, sf), v.hot_races(spark, sf), lambda df, g: g.add(df, heads=F.count(F.lit(1))))
    known = placed.filter((F.col("race_id") % 11 != 0) & (F.col("heads") >= 3))
    tops = known.groupBy("race_id").agg(*[F.max(F.when(F.col("finish") == k, F.col("num"))).alias(f"t{k}") for k in (1, 2, 3)], F.max("heads").alias("heads"))
    t1, t2, t3 = F.col("t1"), F.col("t2"), F.col("t3")

    def row(kind, seq, legs, factor):
        return F.struct(F.lit(kind).alias("kind"), F.lit(seq).alias("seq"), legs.alias("legs"), (100 + (F.col("race_id") * factor) % 900 * 10).cast("int").alias("per100"))

    rows = [row("win", 0, F.array(t1), 7), row("place", 0, F.array(t1), 3), row("place", 1, F.array(t2), 5),
            row("quinella", 0, F.array_sort(F.array(t1, t2)), 11), row("quinella", 1, F.array_sort(F.array(t1, t2)), 13),
            row("exacta", 0, F.array(t1, t2), 17), row("trio", 0, F.array_sort(F.array(t1, t2, t3)), 19)]
    return tops.select("race_id", F.inline(F.array(*rows)))


def _pay(kind, seq, legs, factor):
    return f"select race_id, '{kind}' as kind, {seq} as seq, {legs} as legs, cast(100 + (race_id * {factor}) % 900 * 10 as int) as per100 from paying"


_PAYOUTS = """paying as (select race_id, max(case when finish = 1 then num end) as t1, max(case when finish = 2 then num end) as t2, max(case when finish = 3 then num end) as t3
 from field where race_id % 11 <> 0 group by race_id having count(*) >= 3),
payouts as (""" + " union all ".join([
    _pay("win", 0, "[t1]", 7), _pay("place", 0, "[t1]", 3), _pay("place", 1, "[t2]", 5), _pay("quinella", 0, "list_sort([t1, t2])", 11),
    _pay("quinella", 1, "list_sort([t1, t2])", 13), _pay("exacta", 0, "[t1, t2]", 17), _pay("trio", 0, "list_sort([t1, t2, t3])", 19)]) + """),
settled as (select q.race_id, q.kind, q.legs, case when k.kind is not null then coalesce(cast(floor(p.per100 * 300 / 100) as bigint), 0) end as ret
 from quotes q left join (select distinct race_id, kind from payouts) k on k.race_id = q.race_id and k.kind = q.kind
 left join (select race_id, kind, legs, min_by(per100, seq) as per100 from payouts group by 1, 2, 3) p on p.race_id = q.race_id and p.kind = q.kind and p.legs = q.legs)"""


@query("jn10_payout_match", with_(FIELD, v.QUOTES_SQL, _PAYOUTS, "select race_id, kind, array_to_string(legs, '-') as legs, ret from settled"))
def jn10(spark, sf):
    out = settle.settle(v.quotes(v.field(spark, sf)).select("race_id", "kind", "legs"), payouts(spark, sf), v.hot_races(spark, sf), 300)
    return out.select("race_id", "kind", v.leg_string().alias("legs"), "ret")


@query("pl13_settled_totals", with_(FIELD, v.QUOTES_SQL, _PAYOUTS, """
select kind, count(*) as points, count(ret) as settled_points, cast(sum(case when ret > 0 then 1 else 0 end) as bigint) as hits, cast(coalesce(sum(ret), 0) as bigint) as ret from settled group by kind"""))
def pl13(spark, sf):
    out = settle.settle(v.quotes(v.field(spark, sf)).select("race_id", "kind", "legs"), payouts(spark, sf), v.hot_races(spark, sf), 300)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("points"), F.count("ret").alias("settled_points"),
                                   F.count_if(F.col("ret") > 0).alias("hits"), F.coalesce(F.sum("ret"), F.lit(0)).alias("ret"))


@query("ag20_day_summary", with_(FIELD, v.QUOTES_SQL, _PAYOUTS, """days as (select o_orderkey as race_id, cast(o_orderdate as date) as race_date from orders),
per as (select race_id, count(*) as points, sum(case when ret > 0 then 1 else 0 end) as hits, coalesce(sum(ret), 0) as ret from settled group by race_id),
joined as (select d.race_date, p.*, k.race_id is not null as done from days d join per p using (race_id) left join (select distinct race_id from payouts) k on k.race_id = p.race_id)""", """
select race_date, cast(sum(case when done then points else 0 end) as bigint) as points, cast(sum(case when done then points * 300 else 0 end) as bigint) as bet,
 cast(sum(case when done then hits else 0 end) as bigint) as hits, cast(sum(case when done then ret else 0 end) as bigint) as ret, cast(sum(case when done then 0 else 1 end) as bigint) as missing
from joined group by race_date"""))
def ag20(spark, sf):
    paid = payouts(spark, sf)
    settled = settle.settle(v.quotes(v.field(spark, sf)).select("race_id", "kind", "legs"), paid, v.hot_races(spark, sf), 300)
    return settle.day_summary(settled, races(spark, sf), paid, 300)


@query("ag20_missing_races", with_(FIELD, v.QUOTES_SQL, _PAYOUTS, """select o_orderkey as race_id, cast(o_orderdate as date) as race_date from orders
where o_orderkey in (select race_id from quotes) and o_orderkey not in (select race_id from payouts)"""))
def ag20_missing(spark, sf):
    return settle.missing_races(v.quotes(v.field(spark, sf)), races(spark, sf), payouts(spark, sf))


def races(spark, sf):
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("race_id"), F.col("o_orderdate").cast("date").alias("race_date"))
