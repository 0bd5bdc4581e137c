"""Queries on group-relative columns, projections, filters, sorts and run histories (WN, PJ, FL01, AG06, AG07, SO, SE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.catalog import views as v
from furlong.catalog.registry import query, with_
from furlong.functions import columns as cols
from furlong.operators import relative as rel
from furlong.operators.groups import by_group

FIELD = v.FIELD_SQL
CONTEST = v.CONTEST_SQL


def _grouped(spark, sf, pipeline, rows=None):
    return by_group(rows if rows is not None else v.field(spark, sf), v.hot_races(spark, sf), pipeline)


def hot_horses(spark, sf):
    return v.hot(spark, sf, "lineitem", "l_partkey", "horse")


def with_past(spark, sf, fields, depth=5):
    """Entrants with their earlier runs, latest first: rows of the same horse by date, contest and number."""
    rows = v.contest(spark, sf)
    order = (F.col("race_date"), F.col("race_id"), F.col("num"))
    return by_group(rows, hot_horses(spark, sf), lambda df, g: g.past(df, "past", fields, depth, *order))


def lag_sql(field: str, n: int) -> str:
    return f"lag({field}, {n}) over (partition by horse order by race_date, race_id, num)"


@query("wn01_group_size", with_(FIELD, "select race_id, num, count(*) over (partition by race_id) as size from field"))
def wn01(spark, sf):
    return _grouped(spark, sf, lambda df, g: rel.group_size(df, g, "size")).select("race_id", "num", "size")


@query("wn02_group_deviation", with_(FIELD, """select race_id, num,
 round(jockey - avg(jockey) over (partition by race_id), 6) + 0 as jockey_dev,
 round(carried - avg(carried) over (partition by race_id), 6) + 0 as carried_dev from field"""))
def wn02(spark, sf):
    out = _grouped(spark, sf, lambda df, g: rel.deviations(df, g, ["jockey", "carried"]))
    return out.select("race_id", "num", v.r6("jockey_dev").alias("jockey_dev"), v.r6("carried_dev").alias("carried_dev"))


@query("wn03_rank_average", with_(FIELD, """, ranked as (select race_id, num, carried,
 rank() over (partition by race_id order by carried desc) as low, count(*) over (partition by race_id, carried) as same from field)""".lstrip(", "),
 "select race_id, num, low + (same - 1) / 2.0::double as rank_avg from ranked"))
def wn03(spark, sf):
    return _grouped(spark, sf, lambda df, g: rel.average_rank(df, g, "carried", "rank_avg")).select("race_id", "num", "rank_avg")


@query("wn05_gaps", with_(FIELD, """tops as (select race_id, max(carried) as top, max(-rate) as rtop from field group by race_id),
seconds as (select f.race_id, sum(case when f.carried = t.top then 1 else 0 end) as many, max(case when f.carried < t.top then f.carried end) as nxt,
 sum(case when -f.rate = t.rtop then 1 else 0 end) as rmany, max(case when -f.rate < t.rtop then -f.rate end) as rnxt
 from field f join tops t using (race_id) group by f.race_id)""", """
select f.race_id, f.num, f.carried - t.top as carried_top_gap, f.carried - case when s.many < 2 then s.nxt else t.top end as carried_second_gap,
 round(-f.rate - t.rtop, 6) + 0 as rate_top_gap, round(-f.rate - case when s.rmany < 2 then s.rnxt else t.rtop end, 6) + 0 as rate_second_gap
from field f join tops t using (race_id) join seconds s using (race_id)"""))
def wn05(spark, sf):
    out = _grouped(spark, sf, lambda df, g: rel.gaps(df, g, {"carried": 1, "rate": -1}))
    return out.select("race_id", "num", "carried_top_gap", "carried_second_gap", v.r6("rate_top_gap").alias("rate_top_gap"), v.r6("rate_second_gap").alias("rate_second_gap"))


@query("wn06_other_flags", with_(FIELD, """select race_id, num,
 cast(sum(case when surface = 'A' then 1 else 0 end) over (partition by race_id) - case when surface = 'A' then 1 else 0 end as double) as other_a,
 cast(sum(case when surface = 'N' then 1 else 0 end) over (partition by race_id) - case when surface = 'N' then 1 else 0 end as double) as other_n from field"""))
def wn06(spark, sf):
    flags = {"other_a": F.col("surface") == "A", "other_n": F.col("surface") == "N"}
    return _grouped(spark, sf, lambda df, g: rel.others(df, g, flags)).select("race_id", "num", "other_a", "other_n")


@query("wn08_zscore", with_(FIELD, """select race_id, num,
 round((score - avg(score) over w) / (stddev_pop(score) over w + 1e-9), 4) + 0 as z from field window w as (partition by race_id)"""))
def wn08(spark, sf):
    out = _grouped(spark, sf, lambda df, g: rel.zscore(df, g, "score", "z"))
    return out.select("race_id", "num", v.r6("z", 4).alias("z"))


@query("wn09_class_of_race", with_(FIELD, """med as (select race_id, median(floor(rate * 50)) as m from field group by race_id)""", """
select f.race_id, f.num, cast(case when m <= 0 then 1 when m <= 1 then 2 when m <= 2 then 3 when m <= 3 then 4 else 5 end as double) as class_level
from field f join med using (race_id)"""))
def wn09(spark, sf):
    rows = v.field(spark, sf).withColumn("wins", F.floor(F.col("rate") * 50))
    return _grouped(spark, sf, lambda df, g: rel.class_of_race(df, g, "wins", "class_level"), rows).select("race_id", "num", "class_level")


@query("wn10_top_pick", with_(FIELD, """select race_id, num, finish from (
 select *, row_number() over (partition by race_id order by score desc, num) as place from field) where place = 1"""))
def wn10(spark, sf):
    return _grouped(spark, sf, lambda df, g: rel.top_pick(df, g, "score")).select("race_id", "num", "finish")


@query("wn11_pace", with_(FIELD, """styled as (select *, cast(jockey % 5 as int) as style from field),
counts as (select race_id, sum(case when style = 1 then 1 else 0 end) as leaders, sum(case when style = 2 then 1 else 0 end) as followers,
 count(*) as n, avg(rate) as front from styled group by race_id)""", """
select race_id, num, round((leaders + followers) / n::double, 6) + 0 as front_share, round((2 * leaders + followers) / n::double, 6) + 0 as pace_index,
 round((2 * leaders + followers) / n::double * case when style in (3, 4) then 1 when style in (1, 2) then -1 else 0 end, 6) + 0 as pace_gain,
 cast(case when style = 1 and leaders = 1 then 1 else 0 end as double) as lone_leader,
 cast(leaders + followers - case when style in (1, 2) then 1 else 0 end as double) as rivals_ahead, round(rate - front, 6) + 0 as front_rate_dev
from styled join counts using (race_id)"""))
def wn11(spark, sf):
    rows = v.field(spark, sf).withColumn("style", (F.col("jockey") % 5).cast("int"))
    out = _grouped(spark, sf, lambda df, g: rel.pace(df, g, "style", "rate"), rows)
    return out.select("race_id", "num", *[v.r6(c).alias(c) for c in ("front_share", "pace_index", "pace_gain", "lone_leader", "rivals_ahead", "front_rate_dev")])


@query("wn13_fill_down", with_(FIELD, """marks as (select *, case when num % 2 = 1 then frame end as shown from field)""", """
select race_id, num, last_value(shown ignore nulls) over (partition by race_id order by num rows between unbounded preceding and current row) as frame from marks"""))
def wn13(spark, sf):
    """The frame is only shown in its first row and spans the next."""
    rows = v.field(spark, sf).withColumn("shown", F.when(F.col("num") % 2 == 1, F.col("frame")))
    out = _grouped(spark, sf, lambda df, g: rel.fill_down(df, g, "shown", "filled", "num"), rows)
    return out.select("race_id", "num", F.col("filled").alias("frame"))


@query("wn14_rank_label", with_(FIELD, "select race_id, num, cast(greatest(heads - finish, 0) as double) as label from field"))
def wn14(spark, sf):
    return _grouped(spark, sf, lambda df, g: rel.rank_label(df, g)).select("race_id", "num", "label")


@query("wn15_has_winner", with_(FIELD, """select race_id, num, coalesce(min(case when surface = 'R' then finish end) over (partition by race_id) = 1, false) as has_winner
 from field"""))
def wn15(spark, sf):
    """Only entrants of one surface have a known finish here, so some contests have no winner."""
    rows = v.field(spark, sf).withColumn("finish", F.when(F.col("surface") == "R", F.col("finish")))
    return _grouped(spark, sf, lambda df, g: rel.has_winner(df, g), rows).select("race_id", "num", "has_winner")


@query("wn16_run_trends", with_(CONTEST, f"""lags as (select race_id, num, {lag_sql('carried', 1)} as s1, {lag_sql('carried', 2)} as s2,
 {lag_sql('finish', 1)} as f1, {lag_sql('finish', 2)} as f2 from contest)""",
 "select race_id, num, round(s1 - s2, 6) + 0 as carried_trend, f1 - f2 as finish_trend from lags"))
def wn16(spark, sf):
    out = rel.trends(with_past(spark, sf, ["carried", "finish"]), ["carried", "finish"])
    return out.select("race_id", "num", v.r6("carried_trend").alias("carried_trend"), "finish_trend")


def _five(field):
    return [f"{lag_sql(field, i)} as {field[0]}{i}" for i in range(1, 6)]


def _list(letter, n=5):
    return "[" + ", ".join(f"{letter}{i}" for i in range(1, n + 1)) + "]"


@query("ag07_run_summaries", with_(CONTEST, "lags as (select race_id, num, surface, " + ", ".join(
    _five("carried") + _five("finish") + [f"{lag_sql('surface', i)} as u{i}" for i in range(1, 6)]) + " from contest)", f"""
select race_id, num, round(list_avg({_list('c')}), 6) + 0 as carried_mean, round(list_max({_list('c')}), 6) + 0 as carried_max, round(list_min({_list('c')}), 6) + 0 as carried_min,
 round(c1, 6) + 0 as carried_latest, cast(list_count({_list('c')}) as int) as carried_runs, round(list_avg({_list('c', 3)}), 6) + 0 as carried_mean3,
 round(list_stddev_samp({_list('f')}), 6) + 0 as finish_spread,
 round(list_avg([{', '.join(f'case when u{i} = surface then c{i} end' for i in range(1, 6))}]), 6) + 0 as same_surface_carried
from lags"""))
def ag07(spark, sf):
    rows = with_past(spark, sf, ["carried", "finish", "surface"])
    run = lambda i, f: F.get("past", F.lit(i))[f]
    weights, finishes = ([run(i, f).cast("double") for i in range(5)] for f in ("carried", "finish"))
    same = [F.when(run(i, "surface") == F.col("surface"), run(i, "carried")) for i in range(5)]
    return rows.select(
        "race_id", "num", v.r6(cols.mean_of(weights)).alias("carried_mean"), v.r6(cols.max_of(weights)).alias("carried_max"),
        v.r6(cols.min_of(weights)).alias("carried_min"), v.r6(weights[0]).alias("carried_latest"),
        cols.count_of(weights).alias("carried_runs"), v.r6(cols.mean_of(weights[:3])).alias("carried_mean3"),
        v.r6(cols.spread_of(finishes)).alias("finish_spread"), v.r6(cols.mean_of(same)).alias("same_surface_carried"))


@query("ag06_group_sizes", """with sizes as (select l_orderkey, count(*) as n from lineitem group by 1)
select min(n) as smallest, round(avg(n), 6) as average, max(n) as largest, count(*) as races from sizes""")
def ag06(spark, sf):
    sizes = v.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("smallest"), v.r6(F.avg("n")).alias("average"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("races"))


@query("fl01_training_rows", with_(FIELD, "select race_id, num, surface, finish from field where surface <> 'A' and finish < 9"))
def fl01(spark, sf):
    """Rows of one surface, and rows without a finish (ninth and later here), are no training rows."""
    rows = v.field(spark, sf).withColumn("finish", F.when(F.col("finish") < 9, F.col("finish")))
    return training_rows(rows, "A").select("race_id", "num", "surface", "finish")


def training_rows(rows, excluded):
    from furlong.plans.train import training_rows as keep

    return keep(rows, excluded)


@query("pj01_conform", with_(FIELD, "select race_id, num, carried, cast(null as double) as body_weight, cast(jockey as varchar) as jockey from field"))
def pj01(spark, sf):
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("race_id", T.LongType()), T.StructField("num", T.IntegerType()), T.StructField("carried", T.DoubleType()),
        T.StructField("body_weight", T.DoubleType()), T.StructField("jockey", T.StringType())])
    return cols.conform(v.field(spark, sf), schema)


@query("pj02_rename_career", "select o_orderkey as style4, o_custkey as career_all, o_orderstatus as career_a, o_totalprice as career_b, strftime(o_orderdate, '%Y-%m-%d') as career_c, o_orderpriority from orders")
def pj02(spark, sf):
    """The four columns after the marker column get canonical names."""
    rows = v.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "style4").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return cols.rename_after(rows, "style4", ["career_all", "career_a", "career_b", "career_c"])


@query("pj03_drop_by_pattern", "select l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def pj03(spark, sf):
    return cols.drop_matching(v.table(spark, sf, "lineitem"), r"key$(?<!orderkey)|^l_(return|line|ship)")


@query("nj34_drop_by_position", "select l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus from lineitem")
def nj34(spark, sf):
    return cols.drop_positions(v.table(spark, sf, "lineitem").drop("l_shipdate"), 3, 7)


@query("pj04_match_flag", with_(CONTEST, f"select race_id, num, cast(({lag_sql('venue', 1)} = venue) as double) as same_venue from contest"))
def pj04(spark, sf):
    rows = with_past(spark, sf, ["venue"], 1)
    return rows.select("race_id", "num", cols.match_flag(F.get("past", F.lit(0))["venue"], F.col("venue")).alias("same_venue"))


@query("pj05_subtract_current", with_(FIELD, """counted as (select race_id, num, finish, cast(carried * 60 as int) as distance,
 cast(num % 3 as int) as w, cast(jockey % 4 as int) as s, cast(horse % 3 as int) as t, cast(horse % 6 as int) as u from field)""", """
select race_id, num, case when finish = 1 then greatest(w - 1, 0) else w end as wins, case when finish = 2 then greatest(s - 1, 0) else s end as seconds,
 case when finish = 3 then greatest(t - 1, 0) else t end as thirds, case when finish >= 4 then greatest(u - 1, 0) else u end as unplaced,
 case when distance between 0 and 1400 and finish = 1 then greatest(w - 1, 0) else w end as short_wins,
 case when distance between 2001 and 99999 and finish >= 4 then greatest(u - 1, 0) else u end as long_unplaced,
 case when num % 4 = 0 then greatest(w - 1, 0) else w end as leader_runs from counted"""))
def pj05(spark, sf):
    from furlong.operators.features import subtract_current

    f = v.field(spark, sf)
    four = F.array(*[c.cast("int") for c in (F.col("num") % 3, F.col("jockey") % 4, F.col("horse") % 3, F.col("horse") % 6)])
    rows = f.withColumns({
        "distance": (F.col("carried") * 60).cast("int"), "style4": four, "career": F.array(four, four, four, four),
        "style_now": (F.col("num") % 4 + 1).cast("double")})
    out = subtract_current(rows)
    counter = lambda i, k: F.get(F.get("career", F.lit(i)), F.lit(k))
    return out.select(
        "race_id", "num", *[counter(0, k).alias(n) for k, n in enumerate(("wins", "seconds", "thirds", "unplaced"))],
        counter(1, 0).alias("short_wins"), counter(3, 3).alias("long_unplaced"), F.get("style4", F.lit(0)).alias("leader_runs"))


@query("pj06_safe_ratio", with_(FIELD, "select race_id, num, case when horse % 4 > 0 then round((num % 3) / (horse % 4)::double, 6) + 0 end as ratio from field"))
def pj06(spark, sf):
    ratio = cols.safe_ratio((F.col("num") % 3).cast("double"), (F.col("horse") % 4).cast("double"))
    return v.field(spark, sf).select("race_id", "num", v.r6(ratio).alias("ratio"))


@query("pj07_rest_flags", with_(CONTEST, f"""gaps as (select race_id, num, date_diff('day', {lag_sql('race_date', 1)}, race_date) as days from contest)""", """
select race_id, num, cast(days as int) as days, cast(days <= 14 as double) as quick_return, cast(days > 60 as double) as long_rest from gaps"""))
def pj07(spark, sf):
    from furlong.operators.features import rest_flags

    rows = with_past(spark, sf, ["race_date"], 1).withColumn("days", F.datediff("race_date", F.get("past", F.lit(0))["race_date"]))
    return rest_flags(rows, "days").select("race_id", "num", "days", "quick_return", "long_rest")


@query("so01_by_race", with_(FIELD, "select race_id, num, finish from field"))
def so01(spark, sf):
    return v.field(spark, sf).select("race_id", "num", "finish").orderBy("race_id", "num")


@query("so02_by_chance_in_race", with_(FIELD, v.CHANCES_SQL, "select race_id, num, round(p1, 9) + 0 as p1 from chances"))
def so02(spark, sf):
    """Best chance first within the contest; contests stay where the chances were computed."""
    return v.scored(spark, sf).sortWithinPartitions("race_id", F.col("p1").desc(), "num").select("race_id", "num", v.r6("p1", 9).alias("p1"))


@query("so04_top_entrants", with_(FIELD, """select race_id, num, score from (
 select *, row_number() over (partition by race_id order by score desc, num) as place from field) where place <= 3"""))
def so04(spark, sf):
    return _grouped(spark, sf, lambda df, g: g.first(df, 3, F.col("score").desc(), F.col("num"))).select("race_id", "num", "score")


@query("so06_schedule", "select o_orderkey as race_id, strftime(o_orderdate, '%Y-%m-%d') as start from orders")
def so06(spark, sf):
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("race_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start")).orderBy("start", "race_id")


@query("so10_by_number", with_(FIELD, "select race_id, coalesce(case when num % 5 <> 0 then num end, 999) as place, finish from field"))
def so10(spark, sf):
    """Entrants without a number come last."""
    shown = F.when(F.col("num") % 5 != 0, F.col("num"))
    return v.field(spark, sf).select("race_id", F.coalesce(shown, F.lit(999)).alias("place"), "finish").orderBy("race_id", "place")


@query("se01_union_by_name", with_(FIELD, """
select race_id, num, jockey, null::bigint as horse, 'a' as part from field where surface = 'A' union all
select race_id, num, null, horse, 'b' from field where surface <> 'A'"""))
def se01(spark, sf):
    rows = v.field(spark, sf)
    left = rows.filter(F.col("surface") == "A").select("race_id", "num", "jockey", F.lit("a").alias("part"))
    right = rows.filter(F.col("surface") != "A").select(F.lit("b").alias("part"), "horse", "num", "race_id")
    return left.unionByName(right, allowMissingColumns=True)


@query("se04_distinct_races", "select distinct l_orderkey as race_id from lineitem")
def se04(spark, sf):
    return v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("race_id")).distinct().orderBy("race_id")


@query("se05_missing_keys", "select o_orderkey as race_id from orders except select l_orderkey from lineitem")
def se05(spark, sf):
    """Required keys that are not there yet."""
    required = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("race_id"))
    return required.exceptAll(v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("race_id")).distinct())


@query("se06_leg_sets", with_(FIELD, v.QUOTES_SQL, """
select q.race_id, q.kind, array_to_string(q.legs, '-') as legs, list_sort(q.legs) = [1, 2, 3] as equal, len(list_filter(q.legs, x -> x > 3)) = 0 as inside
from quotes q""".replace("x -> x > 3", "lambda x: x > 3")))
def se06(spark, sf):
    rows = v.quotes(v.field(spark, sf))
    first = F.array(*[F.lit(i) for i in (1, 2, 3)])
    return rows.select(
        "race_id", "kind", v.leg_string().alias("legs"), (F.array_sort("legs") == first).alias("equal"),
        (F.size(F.array_except("legs", first)) == 0).alias("inside"))
