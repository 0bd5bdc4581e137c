"""Queries on participant statistics and dictionaries (AG01-AG05, JN01, JN02, JN15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.catalog import views as v
from furlong.catalog.registry import query, with_
from furlong.operators import encode as enc

CONTEST = v.CONTEST_SQL
SPLIT = 2000

_TOTALS = "count(finish) as runs, cast(sum(case when finish = 1 then 1 else 0 end) as bigint) as wins, cast(sum(case when finish <= 3 then 1 else 0 end) as bigint) as top3"
_RATES = "round(wins / runs::double, 6) + 0 as win_rate, round(top3 / runs::double, 6) + 0 as top3_rate"


def hot_of(spark, sf, role):
    column = {"jockey": "l_suppkey", "horse": "l_partkey"}[role]
    return v.hot(spark, sf, "lineitem", column, role)


@query("ag01_role_totals", with_(CONTEST, f"""t as (select 'jockey' as role, cast(jockey as varchar) as name, {_TOTALS} from contest group by jockey
 union all select 'trainer', trainer, {_TOTALS} from contest group by trainer)""", f"select role, name, runs, wins, top3, {_RATES} from t where runs >= 3"))
def ag01(spark, sf):
    rows = v.contest(spark, sf)
    both = [enc.role_totals(rows, r).select(
        F.lit(r).alias("role"), F.col(r).cast("string").alias("name"), "runs", "wins", "top3",
        v.r6("win_rate").alias("win_rate"), v.r6("top3_rate").alias("top3_rate")) for r in ("jockey", "trainer")]
    return both[0].unionByName(both[1])


_PAIRS = " union all ".join(
    f"select jockey, '{c}' as cond, coalesce(cast({c} as varchar), 'nan') as cond_value, {_TOTALS} from contest group by 1, 3" for c in ("venue", "surface", "frame"))


@query("ag02_pair_totals", with_(CONTEST, f"t as ({_PAIRS})", f"select jockey, cond, cond_value, runs, wins, top3, {_RATES} from t where runs >= 2"))
def ag02(spark, sf):
    table = enc.pair_totals(v.contest(spark, sf), "jockey", ["venue", "surface", "frame"])
    return table.select("jockey", "cond", "cond_value", "runs", "wins", "top3", v.r6("win_rate").alias("win_rate"), v.r6("top3_rate").alias("top3_rate"))


_OOF = f"""folded as (select race_id, num, jockey, yr, finish, case when yr < {SPLIT} then cast(race_id % 5 as int) else -1 end as fold from contest),
own as (select jockey, fold, count(*) as r, sum(case when finish = 1 then 1 else 0 end) as w, sum(case when finish <= 3 then 1 else 0 end) as t
 from folded where fold >= 0 group by jockey, fold),
whole as (select jockey, sum(r) as r, sum(w) as w, sum(t) as t from own group by jockey)"""


@query("ag03_out_of_fold", with_(CONTEST, _OOF, """
select race_id, num, case when a.r - coalesce(o.r, 0) >= 3 then cast(a.r - coalesce(o.r, 0) as bigint) end as jockey_runs,
 case when a.r - coalesce(o.r, 0) >= 3 then round((a.w - coalesce(o.w, 0)) / (a.r - coalesce(o.r, 0))::double, 6) + 0 end as jockey_win_rate,
 case when a.r - coalesce(o.r, 0) >= 3 then round((a.t - coalesce(o.t, 0)) / (a.r - coalesce(o.r, 0))::double, 6) + 0 end as jockey_top3_rate
from folded f left join whole a on a.jockey = f.jockey left join own o on o.jockey = f.jockey and o.fold = f.fold"""))
def ag03(spark, sf):
    rows = v.contest(spark, sf).select("race_id", "num", "jockey", "yr", "finish").withColumn("fold", (F.col("race_id") % 5).cast("int"))
    out = enc.out_of_fold(rows, ["jockey"], hot_of(spark, sf, "jockey"), "jockey", "fold", F.col("yr") < SPLIT)
    return out.select("race_id", "num", "jockey_runs", v.r6("jockey_win_rate").alias("jockey_win_rate"), v.r6("jockey_top3_rate").alias("jockey_top3_rate"))


@query("ag03_out_of_fold_pairs", with_(CONTEST, _OOF.replace("jockey, yr", "jockey, venue, yr").replace("select jockey, fold, count", "select jockey, venue, fold, count")
       .replace("group by jockey, fold", "group by jockey, venue, fold").replace("select jockey, sum(r)", "select jockey, venue, sum(r)").replace("from own group by jockey", "from own group by jockey, venue"), """
select race_id, num, case when a.r - coalesce(o.r, 0) >= 2 then cast(a.r - coalesce(o.r, 0) as bigint) end as pair_runs,
 case when a.r - coalesce(o.r, 0) >= 2 then round((a.w - coalesce(o.w, 0)) / (a.r - coalesce(o.r, 0))::double, 6) + 0 end as pair_win_rate
from folded f left join whole a on a.jockey = f.jockey and a.venue = f.venue left join own o on o.jockey = f.jockey and o.venue = f.venue and o.fold = f.fold"""))
def ag03_pairs(spark, sf):
    rows = v.contest(spark, sf).select("race_id", "num", "jockey", "venue", "yr", "finish").withColumn("fold", (F.col("race_id") % 5).cast("int"))
    hot = enc.find_hot(rows, "jockey", "venue")
    out = enc.out_of_fold(rows, ["jockey", "venue"], hot, "pair", "fold", F.col("yr") < SPLIT, least=2)
    return out.select("race_id", "num", "pair_runs", v.r6("pair_win_rate").alias("pair_win_rate"))


@query("jn01_role_lookup", with_(CONTEST, f"t as (select jockey, {_TOTALS} from contest where yr < {SPLIT} and surface = 'A' group by jockey having count(*) >= 3)", """
select race_id, num, runs as jockey_runs, round(wins / runs::double, 6) + 0 as jockey_win_rate from contest left join t using (jockey)"""))
def jn01(spark, sf):
    rows = v.contest(spark, sf)
    table = enc.role_totals(rows.filter((F.col("yr") < SPLIT) & (F.col("surface") == "A")), "jockey")
    out = enc.attach_role(rows, table, "jockey", hot_of(spark, sf, "jockey"), "jockey")
    return out.select("race_id", "num", "jockey_runs", v.r6("jockey_win_rate").alias("jockey_win_rate"))


@query("jn02_pair_lookup", with_(CONTEST, f"""past as (select * from contest where yr < {SPLIT}),
a as (select jockey, venue, {_TOTALS} from past group by 1, 2 having count(*) >= 2), b as (select jockey, surface, {_TOTALS} from past group by 1, 2 having count(*) >= 2),
c as (select jockey, frame, {_TOTALS} from past group by 1, 2 having count(*) >= 2)""", """
select race_id, num, a.runs as venue_runs, round(a.win_rate, 6) + 0 as venue_win_rate, b.runs as surface_runs, c.runs as frame_runs, round(c.top3_rate, 6) + 0 as frame_top3_rate
from contest x left join (select *, wins / runs::double as win_rate from a) a on a.jockey = x.jockey and a.venue = x.venue
left join b on b.jockey = x.jockey and b.surface = x.surface left join (select *, top3 / runs::double as top3_rate from c) c on c.jockey = x.jockey and c.frame = x.frame"""))
def jn02(spark, sf):
    rows = v.contest(spark, sf)
    conditions = ["venue", "surface", "frame"]
    table = enc.pair_totals(rows.filter(F.col("yr") < SPLIT), "jockey", conditions)
    out = enc.attach_pairs(rows, table, "jockey", conditions, hot_of(spark, sf, "jockey"))
    return out.select(
        "race_id", "num", F.col("jockey_venue_runs").alias("venue_runs"), v.r6("jockey_venue_win_rate").alias("venue_win_rate"),
        F.col("jockey_surface_runs").alias("surface_runs"), F.col("jockey_frame_runs").alias("frame_runs"), v.r6("jockey_frame_top3_rate").alias("frame_top3_rate"))


@query("ag04_snapshot_mode", with_(CONTEST, """rows as (select horse, row_number() over (partition by horse order by race_date, race_id, num) as career,
 row_number() over (partition by horse order by race_date, race_id, num) + cast(num % 2 as int) as style from contest),
h as (select horse, count(*) as n, count(distinct career) as k from rows group by horse)""", """
select (select avg(case when career = 0 then 1.0::double else 0 end) from rows) as zero_share, (select median(style - career) from rows) as style_gap,
 (select count(*) from h where n >= 2) as many, (select round(avg(case when k = 1 then 1.0::double else 0 end), 6) + 0 from h where n >= 2) as same_share, 'post' as mode"""))
def ag04(spark, sf):
    """Counters that grow with every run: read right after the race."""
    from furlong.catalog.relative_queries import hot_horses

    rows = v.by_group(v.contest(spark, sf), hot_horses(spark, sf), lambda df, g: g.number(df, "career_total", F.col("race_date"), F.col("race_id"), F.col("num")))
    counted = rows.select(F.col("horse").alias("name"), "career_total", (F.col("career_total") + F.col("num") % 2).alias("style_total"))
    report = enc.snapshot_report(counted)
    return report.select("zero_share", F.col("style_gap").cast("double").alias("style_gap"), "many", v.r6("same_share").alias("same_share"), "mode")


_MAPS = """long as (select 'trainer' as col, cast(trainer as varchar) as value from contest union all select 'horse', cast(horse as varchar) from contest
 union all select 'surface', surface from contest),
counted as (select col, value, count(*) as rows from long group by 1, 2), most as (select col, max(rows) as m from counted group by 1),
maps as (select c.col, c.value, c.rows, cast(row_number() over (partition by c.col order by c.value) - 1 as int) as code from counted c join most using (col)
 where c.rows >= 30 or m < 30)"""


@query("ag05_category_maps", with_(CONTEST, _MAPS, "select col as \"column\", value, rows, code from maps"))
def ag05(spark, sf):
    return enc.category_maps(v.contest(spark, sf), ["trainer", "horse", "surface"])


@query("jn15_category_codes", with_(CONTEST, _MAPS, """select race_id, num, h.code as horse_code, t.code as trainer_code from contest x
left join maps h on h.col = 'horse' and h.value = cast(x.horse as varchar) left join maps t on t.col = 'trainer' and t.value = x.trainer"""))
def jn15(spark, sf):
    rows = v.contest(spark, sf)
    maps = enc.category_maps(rows, ["trainer", "horse"])
    return enc.apply_categories(rows, maps, ["trainer", "horse"]).select("race_id", "num", "horse_code", "trainer_code")
