"""Stand-in views: the star-schema tables seen as contests, quotes, results and a ledger.

Each view exists twice, as DataFrame and as SQL text for the check; both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions.columns import once
from furlong.operators.groups import Hot, by_group, find_hot, lookup
from furlong.session import cut

_profiles: dict[tuple, Hot] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hot(spark: SparkSession, sf: str, name: str, column: str, alias: str) -> Hot:
    """Large groups of a base table, profiled once per session; only the plan depends on it."""
    key = (spark.sparkContext.applicationId, sf, name, column, alias)
    if key not in _profiles:
        _profiles[key] = find_hot(table(spark, sf, name).select(F.col(column).alias(alias)), alias)
    return _profiles[key]


def hot_races(spark: SparkSession, sf: str) -> Hot:
    return hot(spark, sf, "lineitem", "l_orderkey", "race_id")


def r6(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, digits) + F.lit(0.0)


def field(spark: SparkSession, sf: str) -> DataFrame:
    """One row per entrant: what lineitem alone tells."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
    )

    def numbered(df, g):
        df = g.number(df, "num", *[F.col(c) for c in (
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")])
        df = g.number(df, "finish", F.col("l_quantity").desc(), F.col("num"))
        return g.add(df, heads=F.count(F.lit(1)))

    return by_group(lines, hot_races(spark, sf), numbered).select(
        "race_id", "num", F.floor((F.col("num") + 1) / 2).cast("int").alias("frame"),
        (F.col("l_extendedprice") / 20000).alias("score"), "finish", "heads",
        F.col("l_suppkey").alias("jockey"), F.col("l_returnflag").alias("surface"),
        F.col("l_partkey").alias("horse"), F.col("l_quantity").alias("carried"), F.col("l_discount").alias("rate"),
    )


FIELD_SQL = """lines as (
 select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate,
  l_quantity, l_extendedprice) as int) as num from lineitem
), field as (
 select l_orderkey as race_id, num, cast(floor((num + 1) / 2.0) as int) as frame, l_extendedprice / 20000 as score,
  cast(row_number() over (partition by l_orderkey order by l_quantity desc, num) as int) as finish,
  count(*) over (partition by l_orderkey) as heads,
  l_suppkey as jockey, l_returnflag as surface, l_partkey as horse, l_quantity as carried, l_discount as rate
 from lines
)"""


def contest(spark: SparkSession, sf: str) -> DataFrame:
    """Entrants with stable, venue and date."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("race_id"), F.col("o_custkey").alias("stable"),
        F.col("o_orderdate").cast("date").alias("race_date"), F.year("o_orderdate").alias("yr"),
    )
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("horse"), F.col("p_brand").alias("trainer"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("jockey"), F.col("s_nationkey").alias("venue"))
    rows = lookup(field(spark, sf), orders, ["race_id"], hot_races(spark, sf), "inner")
    rows = lookup(rows, parts, ["horse"], hot(spark, sf, "lineitem", "l_partkey", "horse"), "inner")
    return lookup(rows, suppliers, ["jockey"], hot(spark, sf, "lineitem", "l_suppkey", "jockey"), "inner")


CONTEST_SQL = FIELD_SQL + """, contest as (
 select f.*, p.p_brand as trainer, s.s_nationkey as venue, o.o_custkey as stable,
  cast(o.o_orderdate as date) as race_date, cast(year(o.o_orderdate) as int) as yr
 from field f join orders o on o.o_orderkey = f.race_id join part p on p.p_partkey = f.horse
 join supplier s on s.s_suppkey = f.jockey
)"""

# softmax, and the exact chances as joins over orders of finish
SOFTMAX_SQL = """peak as (select race_id, max(score) as m, count(*) as n from field group by race_id),
weights as (select f.race_id, f.num, f.frame, f.finish, f.score, exp(f.score - k.m) as w, k.n from field f join peak k on k.race_id = f.race_id),
totals as (select race_id, sum(w) as t from weights group by race_id),
soft as (select w.*, w.w / t.t as p1, t.t from weights w join totals t on t.race_id = w.race_id)"""

CHANCES_SQL = SOFTMAX_SQL + """, two as (
 select a.race_id, a.num, sum(b.w / a.t * a.w / (a.t - b.w)) as p from soft a join soft b on a.race_id = b.race_id and a.num <> b.num
 where a.n > 2 group by a.race_id, a.num
), three as (
 select a.race_id, a.num, sum(b.w / a.t * c.w / (a.t - b.w) * a.w / (a.t - b.w - c.w)) as p
 from soft a join soft b on a.race_id = b.race_id and a.num <> b.num
 join soft c on a.race_id = c.race_id and c.num <> a.num and c.num <> b.num
 where a.n > 3 group by a.race_id, a.num
), chances as (
 select s.race_id, s.num, s.frame, s.finish, s.score, s.n as heads, s.p1,
  case when s.n <= 2 then 1 else least(1, s.p1 + two.p) end as p2,
  case when s.n <= 3 then 1 else least(1, s.p1 + two.p + three.p) end as p3
 from soft s left join two on two.race_id = s.race_id and two.num = s.num
 left join three on three.race_id = s.race_id and three.num = s.num
)"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One row per ticket; no return yet means not settled."""
    events = table(spark, sf, "events")
    returned = F.when(F.col("event_type") == "error", F.lit(None)).when(
        F.col("value") > 60, F.floor(F.col("value") * 2)).otherwise(F.lit(0))
    return events.select(
        F.col("event_id").alias("ticket_id"), F.col("ts").cast("date").alias("bet_date"),
        (F.col("user_id") % 10).alias("place"), F.col("event_type").alias("kind"),
        F.lit(100).alias("stake"), returned.cast("long").alias("ret"),
        F.col("user_id").alias("race_id"), F.col("ts"),
    )


LEDGER_SQL = """ledger as (
 select event_id as ticket_id, cast(ts as date) as bet_date, user_id % 10 as place, event_type as kind, 100 as stake,
  cast(case when event_type = 'error' then null when value > 60 then floor(value * 2) else 0 end as bigint) as ret,
  user_id as race_id, ts from events
)"""


# every quote an entrant may open: kind, its legs as steps from the entrant's number, the factors of its stand-in odds, and how far those spread
_QUOTE_FORMS = [
    ("win", (0,), (31, 7, 0), 400, 0.0), ("place", (0,), (17, 5, 0), 60, 1.0), ("frame", (0, 1), (31, 7, 13), 400, 0.0),
    *[form for d in (1, 2) for form in (
        ("quinella", (0, d), (31, 7, 13), 400, 0.0), ("wide", (0, d), (13, 11, 7), 150, 2.0),
        ("exacta", (0, d), (29, 5, 3), 600, 0.0), ("exacta", (d, 0), (29, 5, 3), 600, 0.0))],
    ("trio", (0, 1, 2), (7, 3, 5), 900, 0.0), ("trifecta", (0, 1, 2), (11, 3, 5), 2000, 0.0), ("trifecta", (2, 0, 1), (11, 3, 5), 2000, 0.0),
]


def _forms(reach: int) -> Column:
    """The forms whose legs go no further than ``reach`` numbers on, as one constant."""
    def form(kind: str, steps: tuple[int, ...], weights: tuple[int, int, int], wide: int, spread: float) -> Column:
        padded = (*steps, *[0] * (3 - len(steps)))
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(len(steps)).alias("n"), *[F.lit(x).alias(f"step{i}") for i, x in enumerate(padded)],
            *[F.lit(w).cast("long").alias(f"w{i}") for i, w in enumerate(weights)], F.lit(wide).cast("long").alias("wide"), F.lit(spread).alias("spread"))

    return F.array(*[form(*f) for f in _QUOTE_FORMS if max(f[1]) <= reach])


def quotes(entrants: DataFrame) -> DataFrame:
    """Quotes of all eight kinds, a fixed number per entrant: single ones and neighbours by number.

    An entrant meets the list of forms it has room for; a row is worked out once its form is known.
    """
    left = F.col("heads") - F.col("num")
    form = F.explode(F.when(left >= 2, _forms(2)).when(left == 1, _forms(1)).otherwise(_forms(0))).alias("_form")
    rows = entrants.select("race_id", "num", form)
    f = {name: F.col("_form")[name] for name in ("kind", "n", "step0", "step1", "step2", "w0", "w1", "w2", "wide", "spread")}

    def leg(i: int) -> Column:
        number = F.col("num") + f[f"step{i}"]
        return F.when(f["kind"] == "frame", F.floor((number + 1) / 2).cast("int")).otherwise(number)

    last = F.when(f["n"] == 3, F.col("_l2")).otherwise(F.col("_l1"))
    lo = F.lit(1.05) + ((F.col("race_id") * f["w0"] + F.col("_l0") * f["w1"] + last * f["w2"]) % f["wide"]).cast("double") / 10
    legs = F.when(f["n"] == 1, F.array("_l0")).when(f["n"] == 2, F.array("_l0", "_l1")).otherwise(F.array("_l0", "_l1", "_l2"))
    rows = rows.select("race_id", "_form", *[leg(i).alias(f"_l{i}") for i in range(3)])
    made = once(F.struct(legs.alias("legs"), lo.alias("lo"))).alias("_made")
    rows = rows.select("race_id", "_form", made)
    odds = F.col("_made.lo")
    return rows.select("race_id", f["kind"].alias("kind"), F.col("_made.legs").alias("legs"), odds.alias("odds_lo"), (odds + f["spread"]).alias("odds_hi"))


def _quote_sql(kind: str, legs: str, weights: tuple[int, int, int], x: str, y: str, wide: int, there: str = "true", spread: int = 0) -> str:
    lo = f"cast(1.05 as double) + cast((race_id * {weights[0]} + {x} * {weights[1]} + {y} * {weights[2]}) % {wide} as double) / 10"
    return f"select race_id, '{kind}' as kind, {legs} as legs, {lo} as odds_lo, {lo} + {spread} as odds_hi from field where {there}"


_F = "cast(floor(({0} + 1) / 2.0) as int)"
QUOTES_SQL = "quotes as (\n " + "\n union all ".join([
    _quote_sql("win", "[num]", (31, 7, 0), "num", "0", 400),
    _quote_sql("place", "[num]", (17, 5, 0), "num", "0", 60, spread=1),
    _quote_sql("frame", f"[{_F.format('num')}, {_F.format('(num + 1)')}]", (31, 7, 13), _F.format("num"), _F.format("(num + 1)"), 400, "num + 1 <= heads"),
    *[text for d in (1, 2) for text in (
        _quote_sql("quinella", f"[num, num + {d}]", (31, 7, 13), "num", f"(num + {d})", 400, f"num + {d} <= heads"),
        _quote_sql("wide", f"[num, num + {d}]", (13, 11, 7), "num", f"(num + {d})", 150, f"num + {d} <= heads", 2),
        _quote_sql("exacta", f"[num, num + {d}]", (29, 5, 3), "num", f"(num + {d})", 600, f"num + {d} <= heads"),
        _quote_sql("exacta", f"[num + {d}, num]", (29, 5, 3), f"(num + {d})", "num", 600, f"num + {d} <= heads"),
    )],
    _quote_sql("trio", "[num, num + 1, num + 2]", (7, 3, 5), "num", "(num + 2)", 900, "num + 2 <= heads"),
    _quote_sql("trifecta", "[num, num + 1, num + 2]", (11, 3, 5), "num", "(num + 2)", 2000, "num + 2 <= heads"),
    _quote_sql("trifecta", "[num + 2, num, num + 1]", (11, 3, 5), "(num + 2)", "(num + 1)", 2000, "num + 2 <= heads"),
]) + "\n)"

# chances of every quote, written as sums over orders of finish
PRICED_SQL = """priced as (
 select q.race_id, q.kind, q.legs, q.odds_lo,
  case q.kind when 'win' then a.p1 when 'place' then case when a.heads <= 7 then a.p2 else a.p3 end
   when 'exacta' then a.p1 * b.p1 / (1 - a.p1)
   when 'quinella' then least(1, a.p1 * b.p1 / (1 - a.p1) + a.p1 * b.p1 / (1 - b.p1))
   when 'trifecta' then a.p1 * b.p1 / (1 - a.p1) * c.p1 / (1 - a.p1 - b.p1)
   when 'trio' then least(1, a.p1 * b.p1 * c.p1 * (
     (1 / (1 - a.p1) + 1 / (1 - b.p1)) / (1 - a.p1 - b.p1) + (1 / (1 - a.p1) + 1 / (1 - c.p1)) / (1 - a.p1 - c.p1)
     + (1 / (1 - b.p1) + 1 / (1 - c.p1)) / (1 - b.p1 - c.p1))) end as chance,
  a.p1 as a1, a.p2 as a2, a.p3 as a3, b.p1 as b1, b.p2 as b2, b.p3 as b3, c.p3 as c3, a.heads
 from quotes q join chances a on a.race_id = q.race_id and a.num = q.legs[1]
 left join chances b on b.race_id = q.race_id and b.num = q.legs[2]
 left join chances c on c.race_id = q.race_id and c.num = q.legs[3]
 where q.kind not in ('wide', 'frame')
), wides as (
 select q.race_id, q.kind, q.legs, q.odds_lo,
  case when max(a.heads) = 2 then least(1, max(a.p1 * b.p1 / (1 - a.p1) + a.p1 * b.p1 / (1 - b.p1))) else least(1, sum(a.p1 * b.p1 * x.p1 * (
   (1 / (1 - a.p1) + 1 / (1 - b.p1)) / (1 - a.p1 - b.p1) + (1 / (1 - a.p1) + 1 / (1 - x.p1)) / (1 - a.p1 - x.p1)
   + (1 / (1 - b.p1) + 1 / (1 - x.p1)) / (1 - b.p1 - x.p1)))) end as chance, max(a.p3) as a3, max(b.p3) as b3
 from quotes q join chances a on a.race_id = q.race_id and a.num = q.legs[1]
 join chances b on b.race_id = q.race_id and b.num = q.legs[2]
 left join chances x on x.race_id = q.race_id and x.num <> a.num and x.num <> b.num
 where q.kind = 'wide' group by q.race_id, q.kind, q.legs, q.odds_lo
), frames as (
 select q.race_id, q.kind, q.legs, q.odds_lo, least(1, coalesce(sum(a.p1 * b.p1 / (1 - a.p1)), 0)) as chance
 from quotes q join chances a on a.race_id = q.race_id
 join chances b on b.race_id = q.race_id and b.num <> a.num
  and ((a.frame = q.legs[1] and b.frame = q.legs[2]) or (a.frame = q.legs[2] and b.frame = q.legs[1]))
 where q.kind = 'frame' group by q.race_id, q.kind, q.legs, q.odds_lo
), usable as (
 select race_id, kind, legs, odds_lo, chance from priced where case kind
  when 'win' then a1 >= 0.1 when 'place' then case when heads <= 7 then a2 >= 0.1 else a3 >= 0.1 end
  when 'quinella' then a2 >= 0.1 and b2 >= 0.1 when 'exacta' then a1 >= 0.1 and b2 >= 0.1
  when 'trio' then a3 >= 0.1 and b3 >= 0.1 and c3 >= 0.1 when 'trifecta' then a1 >= 0.1 and b2 >= 0.1 and c3 >= 0.1 end
 union all select race_id, kind, legs, odds_lo, chance from wides where a3 >= 0.1 and b3 >= 0.1
 union all select race_id, kind, legs, odds_lo, chance from frames
), tickets as (
 select *, chance * odds_lo as value from usable where chance between 0.1 and 1 and odds_lo > 0 and chance * odds_lo >= 1
)"""

TICKETS_SQL = [FIELD_SQL, CHANCES_SQL, QUOTES_SQL, PRICED_SQL]


def quoted(spark: SparkSession, sf: str) -> DataFrame:
    """The quotes as a written table, as they would arrive."""
    return cut(quotes(field(spark, sf)))


def leg_string(column: str = "legs") -> Column:
    return F.array_join(F.col(column).cast("array<string>"), "-")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Entrants with their exact chances."""
    from furlong.operators.chances import chances

    return chances(field(spark, sf), hot_races(spark, sf))


def tickets(spark: SparkSession, sf: str, min_value: float = 1.0) -> DataFrame:
    from furlong.operators.tickets import propose

    hot = hot_races(spark, sf)
    return propose(scored(spark, sf), quotes(field(spark, sf)), hot, min_value, many=hot)
