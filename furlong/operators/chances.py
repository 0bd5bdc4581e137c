"""Finishing chances of a contest under the Plackett-Luce model.

With strengths w the chance of the order (j, k, i) is w_j/T * w_k/(T-w_j) * w_i/(T-w_j-w_k).
Summing over orders needs only group totals once the two strongest entrants are kept apart:
what is left after removing anybody else is at least a third of the total, so no difference
of close numbers occurs, and the two exceptions use totals summed without them.

The one double sum (neither of the first two is the strongest) is taken per entrant over the
entrants with a share above ``LIGHT`` (fewer than 1/LIGHT of them in any field) and over power
sums of the others, whose series is cut below double precision.  Work per entrant is bounded,
so a field of any size needs aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.groups import Groups, Hot, by_group

SMALL = 64
LIGHT = 1.0 / SMALL
POWERS = 11


def softmax(df: DataFrame, g: Groups, score: str = "score", temperature: float | str = 1.0, name: str = "p1") -> DataFrame:
    """WN07: group softmax, shifted by the group maximum."""
    heat = F.col(temperature) if isinstance(temperature, str) else F.lit(float(temperature))
    df = g.add(df, _top=F.max(F.col(score) / heat))
    df = df.withColumn("_w", F.exp(F.col(score) / heat - F.col("_top")))
    df = g.add(df, _sum=F.sum("_w"))
    return df.withColumn(name, F.col("_w") / F.col("_sum")).drop("_top", "_w", "_sum")


def renormalise(df: DataFrame, g: Groups, chance: str = "p1", name: str = "p") -> DataFrame:
    """WN17: shares of a group, divided by the largest first so that tiny values keep their ratio."""
    df = g.add(df, _top=F.max(chance)).withColumn("_w", F.col(chance) / F.col("_top"))
    df = g.add(df, _sum=F.sum("_w"))
    return df.withColumn(name, F.col("_w") / F.col("_sum")).drop("_top", "_w", "_sum")


def _leaders(df: DataFrame, g: Groups, value: str) -> DataFrame:
    """Mark the strongest and second strongest entrant; equal values go by number."""
    df = df.withColumn("_key", F.struct(F.col(value).alias("v"), (-F.col("num")).alias("n")))
    df = g.add(df, _best=F.max("_key"), heads=F.count(F.lit(1)))
    df = g.add(df, _next=F.max(F.when(F.col("_key") < F.col("_best"), F.col("_key"))))
    return df.withColumns({
        "lead": F.col("_key") == F.col("_best"),
        "second": F.coalesce(F.col("_key") == F.col("_next"), F.lit(False)),
    })


def _rivals(df: DataFrame, g: Groups, **more: Column) -> DataFrame:
    """Collect what the double sum needs: the heavy shares and the power sums of the light ones."""
    light = (F.col("heads") > SMALL) & (F.col("_p") <= LIGHT) & ~F.col("lead")
    heavy = ~F.col("lead") & ~light
    powers = {f"_m{t}": F.sum(F.when(light, F.pow("_p", F.lit(float(t))))) for t in range(1, POWERS + 1)}
    own = F.struct(F.col("num").alias("n"), F.col("_p").alias("p"))
    return g.add(df, _heavy=F.collect_list(F.when(heavy, own)), **powers, **more)


def _reach() -> Column:
    """Sum over the other non-leading x of p_x/(1-p-p_x) * (1/(1-p) + 1/(1-p_x)) for one entrant."""
    p = F.col("_p")
    a = 1 / (1 - p)
    heavy = F.aggregate(
        "_heavy", F.lit(0.0),
        lambda total, x: total + F.when(
            x["n"] != F.col("num"), x["p"] / (1 - p - x["p"]) * (a + 1 / (1 - x["p"]))
        ).otherwise(0.0),
    )
    # a**t and a + ... + a**t grow along the power sums; only wide fields evaluate this
    series = F.aggregate(
        F.array(*[f"_m{t}" for t in range(1, POWERS + 1)]),
        F.struct(F.lit(0.0).alias("total"), a.alias("power"), a.alias("steps")),
        lambda s, m: F.struct(
            (s["total"] + m * (s["power"] * a + s["steps"])).alias("total"),
            (s["power"] * a).alias("power"), (s["steps"] + s["power"] * a).alias("steps")),
        lambda s: s["total"],
    )
    own = F.when(p <= LIGHT, p / (1 - 2 * p) * (2 * a)).otherwise(0.0)
    light = F.when((F.col("heads") > SMALL) & F.col("_m1").isNotNull(), series - own).otherwise(0.0)
    return F.when(F.col("lead"), F.lit(0.0)).otherwise(heavy + light)


def top_three(df: DataFrame, g: Groups, score: str = "score", temperature: float = 1.0) -> DataFrame:
    """PL01: chance to finish first, in the first two and in the first three, exactly."""
    if not temperature > 0 or temperature == float("inf"):
        raise ValueError("temperature must be finite and positive")
    df = _leaders(df.withColumn("_x", F.col(score) / F.lit(float(temperature))), g, "_x")
    df = g.add(df, _third=F.max(F.when(~F.col("lead") & ~F.col("second"), F.col("_x"))))
    rest = ~F.col("lead") & ~F.col("second")
    x, m0, m1, m2 = F.col("_x"), F.col("_best.v"), F.col("_next.v"), F.col("_third")
    df = g.add(
        df,
        _z0=F.sum(F.exp(x - m0)),
        _z1=F.sum(F.when(~F.col("lead"), F.exp(x - m1))),
        _z2=F.sum(F.when(rest, F.exp(x - m2))),
    )
    # shares with nobody, the leader, and the two leaders removed, each on its own scale
    df = df.withColumns({
        "_p": F.exp(x - m0 - F.log("_z0")),
        "_q": F.exp(x - m1 - F.log("_z1")),
        "_e": F.exp(x - m2 - F.log("_z2")),
        "_pb": F.exp(-F.log("_z0")),
        "_pc": F.exp(m1 - m0 - F.log("_z0")),
        "_qc": F.exp(-F.log("_z1")),
    })
    df = df.withColumns({
        "_v": F.when(~F.col("lead"), F.col("_p") / (1 - F.col("_p"))),
        "_o": F.when(rest, F.col("_q") / (1 - F.col("_q"))),
        "_t": F.when(rest, F.col("_p") / ((1 - F.col("_p")) * (1 - F.col("_q")))),
    })
    df = _rivals(df, g, _vs=F.sum("_v"), _os=F.sum("_o"), _ts=F.sum("_t")).withColumn("_u", F.col("_p") * _reach())
    df = g.add(df, _us=F.sum("_u"))
    p, pb, pc, q, qc = (F.col(c) for c in ("_p", "_pb", "_pc", "_q", "_qc"))
    second = F.when(F.col("lead"), p * F.col("_vs")).otherwise(pb * q + p * (F.col("_vs") - F.col("_v")))
    among = p * (F.col("_us") / 2 - F.col("_u"))
    third = (
        F.when(F.col("lead"), p * F.col("_us") / 2)
        .when(F.col("second"), among + pb * qc * (F.col("_os") + F.col("_ts")))
        .otherwise(
            among
            + pb * (qc * F.col("_e") + q * (F.col("_os") - F.col("_o")))
            + pb * pc / (1 - pc) * F.col("_e")
            + pb * q * (F.col("_ts") - F.col("_t"))
        )
    )
    p2 = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p + second))
    p3 = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p2 + third))
    kept = [c for c in df.columns if not c.startswith("_") and c not in ("lead", "second", "p1", "p2", "p3")]
    return df.select(
        *kept, p.alias("p1"),
        F.when(F.col("heads") <= 2, 1.0).otherwise(p2).alias("p2"),
        F.when(F.col("heads") <= 3, 1.0).otherwise(p3).alias("p3"),
    )


def chances(entries: DataFrame, hot: Hot, score: str = "score", temperature: float = 1.0) -> DataFrame:
    """Entries with p1, p2, p3 for every contest of the table."""
    return by_group(entries, hot, lambda df, g: top_three(df, g, score, temperature))


def strengths(df: DataFrame, g: Groups, chance: str = "p1") -> DataFrame:
    """Per entrant what every order chance needs, from win chances of any scale.

    ``p`` share and ``rest`` the others' total; ``place`` 1 for the strongest, 2 for the second, else 0;
    ``rest_two`` the total without these two; ``among`` and ``beside`` the sums behind ``wide``.
    """
    df = renormalise(df, g, chance, "_p")
    df = _leaders(df, g, "_p")
    lead, other = F.col("lead"), ~F.col("lead") & ~F.col("second")
    df = _rivals(
        df, g, _t0=F.sum("_p"),
        _t1=F.sum(F.when(~lead, F.col("_p")).otherwise(0.0)), rest_two=F.sum(F.when(other, F.col("_p")).otherwise(0.0)))
    df = df.withColumns({
        "p": F.col("_p"), "rest": F.when(lead, F.col("_t1")).otherwise(F.col("_t0") - F.col("_p")), "_reach": _reach(),
        "place": F.when(lead, 1).when(F.col("second"), 2).otherwise(0),
    })
    p, t1, t2 = F.col("p"), F.col("_t1"), F.col("rest_two")
    beyond = F.when(other, _between(p, t1 - p, t1, F.col("rest"))).otherwise(0.0)
    df = g.add(df.withColumn("_y", beyond), _beyond=F.sum("_y"))
    best, runner = 1 - t1, t1 - t2
    past_lead = _between(best, F.when(F.col("second"), t2).otherwise(t1 - p), F.col("rest"), t1)
    kept = [c for c in df.columns if not c.startswith("_") and c not in ("lead", "second")]
    return df.select(
        *kept, F.when(lead, F.col("_beyond")).otherwise(F.col("_reach")).alias("among"),
        F.when(lead, _between(runner, t2, t1, 1 - runner)).otherwise(past_lead).alias("beside"))


def _between(p: Column, left: Column, rest_a: Column, rest_b: Column) -> Column:
    """p/left * (1/rest_a + 1/rest_b): one entrant before or between two others."""
    return F.when((p > 0) & (left > 0), p / left * (1 / rest_a + 1 / rest_b)).otherwise(0.0)


LEG_FIELDS = ["p", "rest", "rest_two", "place", "among", "beside", "heads"]


def _share(part: Column, whole: Column) -> Column:
    return F.when((whole > 0) & (part > 0), part / whole).otherwise(0.0)


def _at_most_one(chance: Column) -> Column:
    """Sums of floating point terms may pass 1 in the last digit."""
    return F.least(F.lit(1.0), chance)


def rest_of_two(a: Column, b: Column) -> Column:
    """Total strength left when a and b are gone."""
    both = a["place"] * b["place"] == 2
    return F.when(both, a["rest_two"]).when(b["place"] == 1, b["rest"] - a["p"]).otherwise(a["rest"] - b["p"])


def exacta(a: Column, b: Column) -> Column:
    """PL02: a first, b second."""
    return a["p"] * _share(b["p"], a["rest"])


def pair_terms(a: Column, b: Column) -> Column:
    """What the chances of pairs and triples share, to be worked out once a row: a before b, b before a, the strength left without both."""
    return F.struct(exacta(a, b).alias("ab"), exacta(b, a).alias("ba"), rest_of_two(a, b).alias("left"))


def _terms(a: Column, b: Column, pair: Column | None) -> tuple[Column, Column, Column]:
    return (exacta(a, b), exacta(b, a), rest_of_two(a, b)) if pair is None else (pair["ab"], pair["ba"], pair["left"])


def quinella(a: Column, b: Column, pair: Column | None = None) -> Column:
    """PL03: a and b first and second in any order."""
    ab, ba, _ = _terms(a, b, pair)
    return _at_most_one(ab + ba)


def trifecta(a: Column, b: Column, c: Column, pair: Column | None = None) -> Column:
    """PL04: a, b, c in this order."""
    ab, _, left = _terms(a, b, pair)
    return ab * _share(c["p"], left)


def trio(a: Column, b: Column, c: Column, pair: Column | None = None) -> Column:
    """PL05: a, b, c in any order."""
    _, _, left = _terms(a, b, pair)
    first = quinella(a, b, pair) * _share(c["p"], left)
    pairs = [(a, c, b), (b, c, a)]
    return _at_most_one(sum((quinella(x, y) * _share(z["p"], rest_of_two(x, y)) for x, y, z in pairs), F.lit(0.0) + first))


def wide(a: Column, b: Column, terms: Column | None = None) -> Column:
    """PL06: a and b both in the first three."""
    _, _, left = _terms(a, b, terms)
    pair = 1 / a["rest"] + 1 / b["rest"]

    def through(x: Column, y: Column) -> Column:
        """Somebody else before or between; ``among`` leaves out the one entrant ``beside`` stands for."""
        left_out = y["place"] == F.when(x["place"] == 1, 2).otherwise(1)
        return x["among"] + F.when(left_out, 0.0).otherwise(x["beside"] - y["p"] / left * pair)

    both = quinella(a, b, terms) + a["p"] * b["p"] * (through(a, b) + through(b, a))
    possible = (left > 0) & (a["p"] > 0) & (b["p"] > 0)
    return F.when(a["heads"] == 2, quinella(a, b, terms)).when(possible, _at_most_one(both)).otherwise(0.0)


def frame_sums() -> list[Column]:
    """The totals of one frame, from which ``frame_fields`` follow."""
    odds, lead = _share(F.col("p"), F.col("rest")), F.col("place") == 1
    return [
        F.sum("p").alias("share"),
        F.sum(odds).alias("odds"),
        F.sum(F.when(lead, 0.0).otherwise(F.col("p"))).alias("share_rest"),
        F.sum(F.when(lead, 0.0).otherwise(odds)).alias("odds_rest"),
        F.sum(F.when(lead, 0.0).otherwise(odds * F.col("p"))).alias("own_rest"),
        F.max(lead).alias("has_lead"),
        F.max(F.when(lead, odds)).alias("odds_lead"),
    ]


def frame_fields() -> list[Column]:
    """Share, odds sum and the chance that one frame fills the first two places."""
    inside = F.col("odds_rest") * F.col("share") - F.col("own_rest")
    return [
        F.col("share"), F.col("odds"),
        (inside + F.when(F.col("has_lead"), F.col("odds_lead") * F.col("share_rest")).otherwise(0.0)).alias("inside"),
    ]


def frame_strengths(entrants: DataFrame) -> DataFrame:
    """Per contest and frame what ``frame_pair`` needs."""
    summed = entrants.filter(F.col("frame").isNotNull()).groupBy("race_id", "frame").agg(*frame_sums())
    return summed.select("race_id", "frame", *frame_fields())


def frame_pair(f: Column, h: Column, same: Column) -> Column:
    """PL07: the first two come from the two frames, in either order."""
    return _at_most_one(F.when(same, f["inside"]).otherwise(f["odds"] * h["share"] + h["odds"] * f["share"]))
