"""Queries on validity, losses, calibration, ranking and blending (FL07-FL10, FL12, JN12-JN14, AG08, AG12, AG13, AG21, AG22, AG25, PL11, ML04, ML05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.catalog import views as v
from furlong.catalog.registry import query, with_
from furlong.functions import fixed
from furlong.operators import evaluate as ev

FIELD = v.FIELD_SQL
SCORED = [FIELD, v.CHANCES_SQL]

# a finish that repeats in some contests and is missing in others
_ODD = """odd as (select *, case when race_id % 13 = 0 and num = 2 then 1 when race_id % 17 = 0 and num = 1 then null else finish end as place from field),
facts as (select race_id, count(*) as n, count(distinct num) as k, sum(case when place is null or place not between 1 and 98 then 1 else 0 end) as bad,
 sum(case when place = 1 then 1 else 0 end) as c1, sum(case when place = 2 then 1 else 0 end) as c2, sum(case when place = 3 then 1 else 0 end) as c3 from odd group by race_id),
sound as (select race_id from facts where n >= 3 and k = n and bad = 0 and c1 = 1 and c2 = 1 and c3 = 1)"""


def odd_rows(rows):
    place = F.when((F.col("race_id") % 13 == 0) & (F.col("num") == 2), 1).when(
        (F.col("race_id") % 17 == 0) & (F.col("num") == 1), F.lit(None)).otherwise(F.col("finish"))
    return rows.withColumn("finish", place.cast("int"))


@query("fl07_valid_finish", with_(FIELD, _ODD, "select race_id from sound"))
def fl07(spark, sf):
    return ev.valid_finish(odd_rows(v.field(spark, sf)))


@query("fl08_valid_race", with_(*SCORED, _ODD, """
select c.race_id from chances c join sound s on s.race_id = c.race_id group by c.race_id
having abs(sum(case when c.race_id % 19 = 0 then 0.9 * c.p1 else c.p1 end) - 1) <= 1e-4 and sum(case when c.p1 <> 0 then 1 else 0 end) >= 3"""))
def fl08(spark, sf):
    rows = odd_rows(v.scored(spark, sf))
    return ev.valid_race(rows.withColumn("p1", F.when(F.col("race_id") % 19 == 0, F.col("p1") * 0.9).otherwise(F.col("p1"))))


@query("jn13_rows_of_valid_races", with_(FIELD, _ODD, "select race_id, num, place as finish from odd where race_id in (select race_id from sound)"))
def jn13(spark, sf):
    rows = odd_rows(v.field(spark, sf))
    return ev.keep_races(rows, ev.valid_finish(rows), v.hot_races(spark, sf)).select("race_id", "num", "finish")


@query("jn12_same_field", with_(FIELD, """p as (select race_id, num from field where surface <> 'A' or num > 1), r as (select race_id, num from field)""", """
select race_id from (select coalesce(p.race_id, r.race_id) as race_id, p.num is not null and r.num is not null as both_sides from p full join r on p.race_id = r.race_id and p.num = r.num)
group by race_id having bool_and(both_sides)"""))
def jn12(spark, sf):
    rows = v.field(spark, sf)
    return ev.same_field(rows.filter((F.col("surface") != "A") | (F.col("num") > 1)), rows)


@query("jn14_ambiguous_races", """with f as (select l_orderkey as race_id, l_linenumber as num, l_returnflag as file from lineitem)
select race_id, num, file from f where race_id not in (select race_id from f group by race_id having count(distinct file) > 1)""")
def jn14(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("num"), F.col("l_returnflag").alias("file"))
    return ev.drop_ambiguous(rows, v.hot_races(spark, sf))


@query("fl09_file_identity", """with f as (select l_suppkey as file, cast(2000 + l_suppkey % 120 as int) as year, cast(case when l_suppkey % 9 = 0 then l_partkey % 2 else l_suppkey % 12 end as int) as venue,
 cast(l_suppkey % 5 as int) as meeting from lineitem),
t as (select file, count(distinct year) = 1 and count(distinct venue) = 1 and count(distinct meeting) = 1 as one, min(year) as year, min(venue) as venue, min(meeting) as meeting from f group by file)
select file, case when not one then 'missing or mixed identity' when year not between 2000 and 2099 then 'year out of range' when venue not between 1 and 10 then 'unknown venue'
 when meeting < 1 then 'meeting out of range' end as reason from t""")
def fl09(spark, sf):
    k = F.col("l_suppkey")
    rows = v.table(spark, sf, "lineitem").select(
        k.alias("file"), (k % 120 + 2000).cast("int").alias("year"),
        F.when(k % 9 == 0, F.col("l_partkey") % 2).otherwise(k % 12).cast("int").alias("venue"), (k % 5).cast("int").alias("meeting"))
    return ev.file_identity(rows, ["year", "venue", "meeting"]).select("file", "reason")


@query("fl10_clean_and_rejects", with_(FIELD, """
select reason, count(*) as n, cast(sum(num) as bigint) as nums from (select num, case when carried < 5 then 'too light' when rate > 0.09 then 'rate too high' end as reason from field) group by reason"""))
def fl10(spark, sf):
    reason = F.when(F.col("carried") < 5, "too light").when(F.col("rate") > 0.09, "rate too high")
    clean, bad = ev.split_rejects(v.field(spark, sf).select("num", "carried", "rate"), reason)
    both = clean.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("num").alias("nums"))


_LL = "round(avg(-(y * ln(least(greatest(p, 1e-9), 1 - 1e-9)) + (1 - y) * ln(1 - least(greatest(p, 1e-9), 1 - 1e-9)))), 6) + 0"


@query("ag12_losses", with_(*SCORED, """long as (select 1 as k, p1 as p, cast(finish <= 1 as double) as y from chances union all select 2, p2, cast(finish <= 2 as double) from chances
 union all select 3, p3, cast(finish <= 3 as double) from chances)""", f"""
select k, count(*) as n, {_LL} as logloss, round(avg((p - y) * (p - y)), 6) + 0 as brier, round(avg(p), 6) + 0 as pred, round(avg(y), 6) + 0 as actual from long group by k"""))
def ag12(spark, sf):
    table = ev.losses(v.scored(spark, sf), {f"k{k}": (f"p{k}", F.col("finish") <= k) for k in (1, 2, 3)})
    return table.select("n", F.inline(F.array(*[F.struct(
        F.lit(k).alias("k"), *[v.r6(f"k{k}_{m}").alias(m) for m in ("logloss", "brier", "pred", "actual")]) for k in (1, 2, 3)])))


@query("ag12_losses_by_race", with_(*SCORED, f"""per as (select race_id, avg(-(y * ln(least(greatest(p, 1e-9), 1 - 1e-9)) + (1 - y) * ln(1 - least(greatest(p, 1e-9), 1 - 1e-9)))) as l
 from (select race_id, p2 as p, cast(finish <= 2 as double) as y from chances) group by race_id)""", "select count(*) as races, round(avg(l), 6) + 0 as logloss from per"))
def ag12_race(spark, sf):
    """Mean over contests of the mean over entrants."""
    per = ev.losses(v.scored(spark, sf), {"top2": ("p2", F.col("finish") <= 2)}, "race_id")
    return per.agg(F.count(F.lit(1)).alias("races"), v.r6(F.avg("top2_logloss")).alias("logloss"))


_EDGES = "[" + ", ".join(repr(e) for e in ev.linear_edges(10)) + "]::double[]"


@query("ag13_reliability", with_(*SCORED, f"""binned as (select round(p1, 12) as p, cast(finish = 1 as double) as y from chances)""", f"""
select cast(greatest(len(list_filter({_EDGES}, lambda e: e < p)), 1) as int) as bin, count(*) as n, round(avg(p), 6) + 0 as pred, round(avg(y), 6) + 0 as actual from binned group by 1"""))
def ag13(spark, sf):
    rows = v.scored(spark, sf).withColumn("p1", F.round("p1", 12))
    table = ev.reliability(rows, "p1", F.col("finish") == 1)
    return table.select("bin", "n", v.r6("pred").alias("pred"), v.r6("actual").alias("actual"))


def _hits_sql(score: str, name: str, position: int) -> str:
    return f"""select '{name}' as score, {position} as position, round(avg(cast(finish = 1 as double)), 6) + 0 as hit1, round(avg(cast(finish <= 3 as double)), 6) + 0 as top3, count(*) as races
 from (select finish, row_number() over (partition by race_id order by {score} desc, num) as place from field) where place = 1"""


def _shown_hits(df):
    return df.select("score", "position", v.r6("hit1").alias("hit1"), v.r6("top3").alias("top3"), "races")


@query("ag08_ranking_metrics", with_(FIELD, _hits_sql("score", "score", 0)))
def ag08(spark, sf):
    return _shown_hits(ev.ranking(v.field(spark, sf), {"score": F.col("score")}))


@query("ag25_baselines", with_(FIELD, " union all ".join(_hits_sql(s, n, i) for i, (s, n) in enumerate((("-rate", "lowest rate"), ("carried", "most carried"), ("-jockey", "first jockey"))))))
def ag25(spark, sf):
    scores = {"lowest rate": -F.col("rate"), "most carried": F.col("carried"), "first jockey": -F.col("jockey")}
    return _shown_hits(ev.ranking(v.field(spark, sf), scores))


_SURE = " union all ".join(f"""select {t}::double as threshold, round(avg(cast(p1 >= {t} as double)), 6) + 0 as share, round(avg(case when p1 >= {t} then cast(finish = 1 as double) end), 6) + 0 as hit1,
 round(avg(case when p1 >= {t} then cast(finish <= 3 as double) end), 6) + 0 as top3 from picks""" for t in fixed.CONFIDENCE_GRID)


@query("fl12_confidence", with_(*SCORED, "picks as (select round(p1, 12) as p1, finish from (select *, row_number() over (partition by race_id order by round(p1, 12) desc, num) as place from chances) where place = 1)", _SURE))
def fl12(spark, sf):
    rows = v.scored(spark, sf).withColumn("p1", F.round("p1", 12))
    return ev.confidence(rows, "p1", v.hot_races(spark, sf)).select("threshold", *[v.r6(c).alias(c) for c in ("share", "hit1", "top3")])


@query("ag21_temperature_losses", with_(FIELD, "temps as (select unnest(range(61)) as position, unnest([" + ", ".join(f"{t!r}::double" for t in fixed.TEMPERATURE_GRID) + "]) as t)",
 """sums as (select f.race_id, t.position, t.t, sum(exp((f.score - k.m) / t.t)) as z from field f join (select race_id, max(score) as m from field group by 1) k using (race_id), temps t group by 1, 2, 3),
wins as (select s.position, s.t, exp((f.score - k.m) / s.t) / s.z as p from field f join (select race_id, max(score) as m from field group by 1) k using (race_id) join sums s using (race_id) where f.finish = 1)""", """
select cast(position as int) as position, round(t, 9) + 0 as temperature, round(-avg(ln(least(greatest(p, 1e-9), 1))), 6) + 0 as loss from wins group by 1, 2"""))
def ag21(spark, sf):
    table = ev.temperature_losses(v.field(spark, sf), v.hot_races(spark, sf))
    return table.select("position", v.r6("temperature", 9).alias("temperature"), v.r6("loss").alias("loss"))


_Z = """z as (select race_id, num, finish, score, (score - avg(score) over w) / (stddev_pop(score) over w + 1e-9) as za, (carried - avg(carried) over w) / (stddev_pop(carried) over w + 1e-9) as zb
 from field window w as (partition by race_id))"""


@query("pl11_blend", with_(FIELD, _Z, "select race_id, num, round(za * 0.7 + zb * 0.3, 4) + 0 as mixed from z"))
def pl11(spark, sf):
    rows = v.field(spark, sf)
    return ev.blend(rows, v.hot_races(spark, sf), "score", "carried", 0.3).select("race_id", "num", v.r6("mixed", 4).alias("mixed"))


@query("ag22_blend_search", with_(FIELD, _Z, " union all ".join([
    """select '0' as score, 0 as position, round(avg(cast(finish = 1 as double)), 6) + 0 as hit1, round(avg(cast(finish <= 3 as double)), 6) + 0 as top3, count(*) as races
 from (select finish, row_number() over (partition by race_id order by score desc, num) as place from z) where place = 1"""] + [
    f"""select '{w:g}' as score, {i} as position, round(avg(cast(finish = 1 as double)), 6) + 0 as hit1, round(avg(cast(finish <= 3 as double)), 6) + 0 as top3, count(*) as races
 from (select finish, row_number() over (partition by race_id order by za * (1 - {w!r}) + zb * {w!r} desc, num) as place from z) where place = 1"""
    for i, w in enumerate(fixed.BLEND_GRIDS["other"], 1)])))
def ag22(spark, sf):
    rows = v.field(spark, sf)
    return _shown_hits(ev.blend_search(rows, v.hot_races(spark, sf), "score", "carried", fixed.BLEND_GRIDS["other"]))
