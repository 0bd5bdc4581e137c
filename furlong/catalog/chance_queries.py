"""Queries on finishing chances and tickets (PL, JN03-JN06, JN08, FL02-FL04, AG23, SE02, SO03)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.catalog import views as v
from furlong.catalog.registry import query, with_
from furlong.functions import fixed
from furlong.operators import chances as pl
from furlong.operators import evaluate, tickets as tk
from furlong.operators.groups import by_group
from furlong.session import cut


@query("pl01_top_three", with_(v.FIELD_SQL, v.CHANCES_SQL, """
select race_id, num, cast(heads as int) as heads, round(p1, 9) + 0 as p1, round(p2, 9) + 0 as p2, round(p3, 9) + 0 as p3 from chances"""))
def pl01(spark, sf):
    return v.scored(spark, sf).select("race_id", "num", F.col("heads").cast("int").alias("heads"), *[v.r6(f"p{k}", 9).alias(f"p{k}") for k in (1, 2, 3)])


@query("wn07_softmax", with_(v.FIELD_SQL, v.SOFTMAX_SQL, "select race_id, num, round(p1, 9) + 0 as p1 from soft"))
def wn07(spark, sf):
    out = by_group(v.field(spark, sf), v.hot_races(spark, sf), lambda df, g: pl.softmax(df, g))
    return out.select("race_id", "num", v.r6("p1", 9).alias("p1"))


@query("wn17_renormalise", with_(v.FIELD_SQL, """
best as (select race_id, max(score) as m from field group by race_id),
shares as (select race_id, sum(f.score / b.m) as t from field f join best b using (race_id) group by race_id)""", """
select f.race_id, f.num, round(f.score / b.m / s.t, 9) + 0 as p from field f join best b using (race_id) join shares s using (race_id)"""))
def wn17(spark, sf):
    out = by_group(v.field(spark, sf), v.hot_races(spark, sf), lambda df, g: pl.renormalise(df, g, "score", "p"))
    return out.select("race_id", "num", v.r6("p", 9).alias("p"))


_PREDICTED = """select race_id, num, frame, round(p1, 9) + 0 as p1,
 cast(rank() over (partition by race_id order by round(p1, 12) desc) as int) as rk1,
 cast(rank() over (partition by race_id order by round(p2, 12) desc) as int) as rk2,
 cast(rank() over (partition by race_id order by round(p3, 12) desc) as int) as rk3 from chances"""


@query("wn04_min_rank", with_(v.FIELD_SQL, v.CHANCES_SQL, _PREDICTED))
def wn04(spark, sf):
    """Ranks of the three chances; equal to twelve digits counts as equal."""
    entrants = v.scored(spark, sf).withColumns({f"r{k}": v.r6(f"p{k}", 12) for k in (1, 2, 3)})

    def ranks(df, g):
        for k in (1, 2, 3):
            df = g.rank(df, f"rk{k}", f"r{k}")
        return df

    out = by_group(entrants, v.hot_races(spark, sf), ranks)
    return out.select("race_id", "num", "frame", v.r6("p1", 9).alias("p1"), "rk1", "rk2", "rk3")


def _kind(name: str):
    sql = with_(*v.TICKETS_SQL, f"select race_id, array_to_string(legs, '-') as legs, round(odds_lo, 6) as odds_lo, round(chance, 9) + 0 as chance from usable where kind = '{name}'")

    def make(spark, sf):
        out = tk.priced(v.scored(spark, sf), v.quotes(v.field(spark, sf)), v.hot_races(spark, sf), kinds=[name], many=v.hot_races(spark, sf))
        return out.select("race_id", v.leg_string().alias("legs"), v.r6("odds_lo").alias("odds_lo"), v.r6("chance", 9).alias("chance"))

    return sql, make


for _id, _name in (("pl02", "exacta"), ("pl03", "quinella"), ("pl04", "trifecta"), ("pl05", "trio"), ("pl06", "wide"), ("pl07", "frame")):
    _sql, _make = _kind(_name)
    query(f"{_id}_{_name}_chance" if _name != "frame" else "pl07_frame_pair_chance", _sql)(_make)

_INDEPENDENT = """marg as (select race_id, num, frame, p1, p2, p3, heads from chances),
shares as (select race_id, frame, sum(p2) as share from marg where p2 >= 0.1 group by race_id, frame),
ind as (
 select q.race_id, q.kind, q.legs, case q.kind when 'win' then a.p1 when 'place' then case when a.heads <= 7 then a.p2 else a.p3 end
  when 'quinella' then a.p2 * b.p2 when 'wide' then a.p3 * b.p3 when 'exacta' then a.p1 * b.p2
  when 'trio' then a.p3 * b.p3 * c.p3 when 'trifecta' then a.p1 * b.p2 * c.p3 end as chance
 from quotes q join marg a on a.race_id = q.race_id and a.num = q.legs[1]
 left join marg b on b.race_id = q.race_id and b.num = q.legs[2] left join marg c on c.race_id = q.race_id and c.num = q.legs[3]
 where case q.kind when 'win' then a.p1 >= 0.1 when 'place' then case when a.heads <= 7 then a.p2 >= 0.1 else a.p3 >= 0.1 end
  when 'quinella' then a.p2 >= 0.1 and b.p2 >= 0.1 when 'wide' then a.p3 >= 0.1 and b.p3 >= 0.1
  when 'exacta' then a.p1 >= 0.1 and b.p2 >= 0.1 when 'trio' then a.p3 >= 0.1 and b.p3 >= 0.1 and c.p3 >= 0.1
  when 'trifecta' then a.p1 >= 0.1 and b.p2 >= 0.1 and c.p3 >= 0.1 else false end
 union all
 select q.race_id, q.kind, q.legs, f.share * h.share from quotes q join shares f on f.race_id = q.race_id and f.frame = q.legs[1]
 join shares h on h.race_id = q.race_id and h.frame = q.legs[2] where q.kind = 'frame'
)"""


@query("pl08_independent_chances", with_(v.FIELD_SQL, v.CHANCES_SQL, v.QUOTES_SQL, _INDEPENDENT,
       "select race_id, kind, array_to_string(legs, '-') as legs, round(chance, 8) + 0 as chance from ind"))
def pl08(spark, sf):
    out = tk.priced(v.scored(spark, sf), v.quotes(v.field(spark, sf)), v.hot_races(spark, sf), "independent", many=v.hot_races(spark, sf))
    return out.select("race_id", "kind", v.leg_string().alias("legs"), v.r6("chance", 8).alias("chance"))


@query("ag23_frame_shares", with_(v.FIELD_SQL, v.CHANCES_SQL, v.QUOTES_SQL, "shares as (select race_id, frame, sum(p2) as share from chances where p2 >= 0.1 group by race_id, frame)", """
select q.race_id, q.legs[1] as first, q.legs[2] as second, round(f.share * h.share, 8) + 0 as chance
from quotes q join shares f on f.race_id = q.race_id and f.frame = q.legs[1] join shares h on h.race_id = q.race_id and h.frame = q.legs[2] where q.kind = 'frame'"""))
def ag23(spark, sf):
    """The chance of a frame quote as the product of both frames' summed chances."""
    quoted = v.quoted(spark, sf).filter(F.col("kind") == "frame")
    found = tk.frame_quotes(quoted, tk.entrant_table(v.scored(spark, sf), v.hot_races(spark, sf)), "independent")
    return found.select("race_id", F.get("legs", F.lit(0)).alias("first"), F.get("legs", F.lit(1)).alias("second"), v.r6("chance", 8).alias("chance"))


_TICKET_COLUMNS = "race_id, kind, array_to_string(legs, '-') as legs, round(odds_lo, 6) as odds_lo, round(chance, 8) + 0 as chance, round(value, 7) + 0 as value"


def _shown(df):
    return df.select("race_id", "kind", v.leg_string().alias("legs"), v.r6("odds_lo").alias("odds_lo"),
                     v.r6("chance", 8).alias("chance"), v.r6("value", 7).alias("value"))


@query("pl09_tickets", with_(*v.TICKETS_SQL, f"select {_TICKET_COLUMNS} from tickets"))
def pl09(spark, sf):
    return _shown(v.tickets(spark, sf))


_RULES_SQL = "rules(kind, lo, vlo, vhi) as (values " + ", ".join(
    f"('{k}', {lo}::double, {vlo}::double, {'1e308' if vhi == float('inf') else vhi}::double)" for k, (lo, vlo, vhi) in fixed.TICKET_RULES.items()) + ")"


@query("fl04_rule_tickets", with_(*v.TICKETS_SQL, _RULES_SQL, f"""
select {_TICKET_COLUMNS.replace('kind', 't.kind', 1)} from tickets t join rules r on r.kind = t.kind and t.chance >= r.lo and t.value between r.vlo and r.vhi"""))
def fl04(spark, sf):
    return _shown(tk.by_rules(v.tickets(spark, sf)))


@query("jn08_rule_ranges", with_(*v.TICKETS_SQL, _RULES_SQL, """
select t.kind, count(*) as kept, round(sum(t.value), 4) + 0 as worth
from tickets t join rules r on r.kind = t.kind and t.chance >= r.lo and t.value between r.vlo and r.vhi group by t.kind"""))
def jn08(spark, sf):
    kept = tk.by_rules(v.tickets(spark, sf))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("kept"), v.r6(F.sum("value"), 4).alias("worth"))


@query("fl03_valid_tickets", with_(*v.TICKETS_SQL, """
select kind, count(*) as kept, round(sum(chance * odds_lo), 4) + 0 as worth from usable where chance between 0.1 and 1 and chance * odds_lo >= 2.4 group by kind"""))
def fl03(spark, sf):
    found = tk.priced(v.scored(spark, sf), v.quoted(spark, sf), v.hot_races(spark, sf), many=v.hot_races(spark, sf))
    return tk.valid(found, 2.4).groupBy("kind").agg(F.count(F.lit(1)).alias("kept"), v.r6(F.sum("value"), 4).alias("worth"))


@query("fl02_leg_flags", with_(v.FIELD_SQL, v.CHANCES_SQL, "select race_id, num, p1 >= 0.1 as ok1, p2 >= 0.1 as ok2, p3 >= 0.1 as ok3 from chances"))
def fl02(spark, sf):
    return tk.leg_ok(v.scored(spark, sf)).select("race_id", "num", "ok1", "ok2", "ok3")


@query("jn03_quotes_by_number", with_(v.FIELD_SQL, v.CHANCES_SQL, v.QUOTES_SQL, """
select q.race_id, q.legs[1] as num, q.kind, round(q.odds_lo, 6) as odds_lo, round(c.p1 * q.odds_lo, 8) + 0 as value
from quotes q join chances c on c.race_id = q.race_id and c.num = q.legs[1] where q.kind in ('win', 'place') and greatest(c.p1, c.p2, c.p3) >= 0.1"""))
def jn03(spark, sf):
    hot = v.hot_races(spark, sf)
    singles = v.quoted(spark, sf).filter(F.col("kind").isin("win", "place"))
    joined = tk.join_legs(singles, tk.entrant_table(v.scored(spark, sf), hot), 1, hot)
    return joined.select(
        "race_id", F.get("legs", F.lit(0)).alias("num"), "kind", v.r6("odds_lo").alias("odds_lo"), v.r6(F.col("a.p1") * F.col("odds_lo"), 8).alias("value"))


def _legs_joined(kinds: list[str], n: int):
    names = "abc"[:n]
    picks = ", ".join(f"{x}.num as num_{x}, round({x}.p1, 9) + 0 as p_{x}" for x in names)
    joins = " ".join(f"join chances {x} on {x}.race_id = q.race_id and {x}.num = q.legs[{i}]" for i, x in enumerate(names, 1))
    usable = " and ".join(f"greatest({x}.p1, {x}.p2, {x}.p3) >= 0.1" for x in names)
    sql = with_(v.FIELD_SQL, v.CHANCES_SQL, v.QUOTES_SQL, f"select q.race_id, q.kind, {picks} from quotes q {joins} where q.kind in ({', '.join(map(repr, kinds))}) and {usable}")

    def make(spark, sf):
        hot = v.hot_races(spark, sf)
        quoted = v.quotes(v.field(spark, sf)).filter(F.col("kind").isin(kinds))
        joined = tk.join_legs(quoted, tk.entrant_table(v.scored(spark, sf), hot), n, hot)
        out = [c for i, x in enumerate(names) for c in (
            F.get("legs", F.lit(i)).alias(f"num_{x}"), v.r6(F.col(x)["p1"], 9).alias(f"p_{x}"))]
        return joined.select("race_id", "kind", *out)

    return sql, make


for _id, _name, _n in (("jn04_pair_legs", ["quinella", "wide", "exacta"], 2), ("jn05_triple_legs", ["trio", "trifecta"], 3)):
    _sql, _make = _legs_joined(_name, _n)
    query(_id, _sql)(_make)


@query("pl10_field_faults", """
with facts as (select l_orderkey as race_id, count(*) as n, count(distinct l_linenumber) as numbers, sum(l_discount) as total, max(l_discount) as most from lineitem group by 1)
select race_id, case when most > 1 then 'chance outside 0..1' when not (total > 0) then 'no positive chance' when n <> numbers then 'repeated number'
 when abs(total - 1) > 1e-9 then 'chances do not sum to one' end as reason from facts
where most > 1 or not (total > 0) or n <> numbers or abs(total - 1) > 1e-9""")
def pl10(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("num"), F.col("l_discount").alias("p1"))
    return tk.field_faults(rows, "p1", normalised=True)


@query("so03_tickets_by_value", with_(*v.TICKETS_SQL, f"""
select {_TICKET_COLUMNS}, cast(row_number() over (partition by race_id order by round(value, 7) desc, kind, legs) as int) as place from tickets"""))
def so03(spark, sf):
    """Value order within the contest, as a place and as the order of the rows."""
    found = v.tickets(spark, sf).withColumn("value", v.r6("value", 7))
    placed = by_group(found, v.hot_races(spark, sf), lambda df, g: g.number(df, "place", F.col("value").desc(), F.col("kind"), F.col("legs")))
    return tk.ranked(placed).select(
        "race_id", "kind", v.leg_string().alias("legs"), v.r6("odds_lo").alias("odds_lo"), v.r6("chance", 8).alias("chance"), "value", "place")


@query("se02_union_of_kinds", with_(*v.TICKETS_SQL, "select kind, count(*) as tickets, round(sum(chance), 6) + 0 as chance_sum from tickets group by kind"))
def se02(spark, sf):
    """One list from the lists of the single kinds."""
    found = cut(v.tickets(spark, sf).select("kind", "chance"))
    whole = reduce(DataFrame.unionByName, [found.filter(F.col("kind") == name) for name in fixed.KINDS])
    return whole.groupBy("kind").agg(F.count(F.lit(1)).alias("tickets"), v.r6(F.sum("chance")).alias("chance_sum"))


_COMBOS = """picked as (select *, row_number() over (partition by race_id order by p1 desc, num) as pos from chances),
six as (select p.*, t.top1, t.top2, t.top3 from picked p join (
 select race_id, max(case when finish = 1 then num end) as top1, max(case when finish = 2 then num end) as top2,
  max(case when finish = 3 then num end) as top3 from chances group by race_id) t using (race_id) where pos <= 6),
pairs as (select a.race_id, a.num as n1, b.num as n2, a.pos as i, b.pos as j, a.p1 as a1, b.p1 as b1, a.p2 as a2, b.p2 as b2, a.p3 as a3, b.p3 as b3,
 a.top1, a.top2, a.top3, a.heads from six a join six b on a.race_id = b.race_id and a.num <> b.num),
wide6 as (select p.race_id, p.n1, p.n2, case when max(p.heads) = 2 then max(p.a1 * p.b1 / (1 - p.a1) + p.a1 * p.b1 / (1 - p.b1)) else
  least(1, sum(p.a1 * p.b1 * x.p1 * ((1 / (1 - p.a1) + 1 / (1 - p.b1)) / (1 - p.a1 - p.b1) + (1 / (1 - p.a1) + 1 / (1 - x.p1)) / (1 - p.a1 - x.p1)
  + (1 / (1 - p.b1) + 1 / (1 - x.p1)) / (1 - p.b1 - x.p1)))) end as pl
 from pairs p left join chances x on x.race_id = p.race_id and x.num <> p.n1 and x.num <> p.n2 where p.i < p.j group by p.race_id, p.n1, p.n2),
triples as (select p.*, c.num as n3, c.p1 as c1, c.p3 as c3, c.pos as k from pairs p join six c on c.race_id = p.race_id and c.num <> p.n1 and c.num <> p.n2),
combos as (
 select race_id, 'quinella' as kind, list_sort([n1, n2]) as legs, a2 * b2 as ind, a1 * b1 / (1 - a1) + a1 * b1 / (1 - b1) as pl,
  cast(list_sort([n1, n2]) = list_sort([top1, top2]) as int) as hit from pairs where i < j
 union all select p.race_id, 'wide', list_sort([p.n1, p.n2]), a3 * b3, w.pl,
  cast(p.n1 in (coalesce(top1, 0), coalesce(top2, 0), coalesce(top3, 0)) and p.n2 in (coalesce(top1, 0), coalesce(top2, 0), coalesce(top3, 0)) as int)
  from pairs p join wide6 w on w.race_id = p.race_id and w.n1 = p.n1 and w.n2 = p.n2 where i < j
 union all select race_id, 'exacta', [n1, n2], a1 * b2, a1 * b1 / (1 - a1), cast([n1, n2] = [top1, top2] as int) from pairs
 union all select race_id, 'trio', list_sort([n1, n2, n3]), a3 * b3 * c3, a1 * b1 * c1 * (
   (1 / (1 - a1) + 1 / (1 - b1)) / (1 - a1 - b1) + (1 / (1 - a1) + 1 / (1 - c1)) / (1 - a1 - c1) + (1 / (1 - b1) + 1 / (1 - c1)) / (1 - b1 - c1)),
  cast(list_sort([n1, n2, n3]) = list_sort([top1, top2, top3]) as int) from triples where i < j and j < k
 union all select race_id, 'trifecta', [n1, n2, n3], a1 * b2 * c3, a1 * b1 / (1 - a1) * c1 / (1 - a1 - b1), cast([n1, n2, n3] = [top1, top2, top3] as int) from triples
)"""


@query("jn06_top_combinations", with_(v.FIELD_SQL, v.CHANCES_SQL, _COMBOS, """
select race_id, kind, array_to_string(legs, '-') as legs, round(ind, 8) + 0 as ind, round(pl, 8) + 0 as pl, hit from combos
where race_id in (select race_id from field group by race_id having count(*) >= 3)"""))
def jn06(spark, sf):
    entrants = v.scored(spark, sf).filter(F.col("heads") >= 3)
    out = evaluate.combinations(entrants, v.hot_races(spark, sf))
    return out.select("race_id", "kind", v.leg_string().alias("legs"), v.r6("ind", 8).alias("ind"), v.r6("pl", 8).alias("pl"), "hit")


_LL = "avg(-(hit * ln(least(greatest({0}, 1e-9), 1 - 1e-9)) + (1 - hit) * ln(1 - least(greatest({0}, 1e-9), 1 - 1e-9))))"


@query("pl14_combination_report", with_(v.FIELD_SQL, v.CHANCES_SQL, _COMBOS, f"""
select kind, count(*) as n, round(avg(hit), 6) + 0 as hit_rate, round({_LL.format('ind')}, 6) + 0 as ind_logloss, round({_LL.format('pl')}, 6) + 0 as pl_logloss,
 round(avg((ind - hit) * (ind - hit)), 6) + 0 as ind_brier, round(avg((pl - hit) * (pl - hit)), 6) + 0 as pl_brier from combos
where race_id in (select race_id from field group by race_id having count(*) >= 3) group by kind"""))
def pl14(spark, sf):
    records = evaluate.combinations(v.scored(spark, sf).filter(F.col("heads") >= 3), v.hot_races(spark, sf))
    report = evaluate.combination_report(records)
    return report.select("kind", "n", *[v.r6(c).alias(c) for c in report.columns[2:]])
