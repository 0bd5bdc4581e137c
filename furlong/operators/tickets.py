"""PL09: quotes joined with chances, valued, filtered and ranked."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.functions.columns import finite, once
from furlong.operators import chances
from furlong.operators.groups import Hot, by_group, find_hot, lookup
from furlong.session import cut

ENTRANT = chances.LEG_FIELDS + ["p1", "p2", "p3"]


def entrant_rows(entries: DataFrame, hot: Hot) -> DataFrame:
    """One row per entrant with everything its tickets need."""
    rows = entries.select("race_id", "num", "frame", "p1", "p2", "p3")
    return by_group(rows, hot, lambda df, g: chances.strengths(df, g, "p1"))


def entrant_table(entries: DataFrame, hot: Hot) -> DataFrame:
    """The same, written once, for plans that join it several times."""
    return cut(entrant_rows(entries, hot))


def leg_ok(entrants: DataFrame) -> DataFrame:
    """FL02: what each entrant may be used for."""
    enough = fixed.LEG_CHANCE
    return entrants.withColumns({f"ok{k}": F.col(f"p{k}") >= enough for k in (1, 2, 3)})


def join_legs(quotes: DataFrame, entrants: DataFrame, n: int, hot: Hot | None = None) -> DataFrame:
    """JN03, JN04, JN05: quotes with ``n`` legs and the entrant of every leg as columns a, b, c.

    Contests of ordinary size bring their entrants as one short map, so a quote is shuffled once
    whatever its number of legs.  Wide fields and contests with very many quotes are joined leg by
    leg on (contest, number), which spreads them.  Entrants no ticket can use are left out first;
    repeated legs and unknown numbers drop the quote.
    """
    hot = hot or find_hot(quotes, "race_id")
    quotes, legs = _of_size(quotes, n), _legs(entrants)
    short, wide = legs.filter(F.col("heads") <= chances.SMALL), legs.filter(F.col("heads") > chances.SMALL)
    parts = [_legs_by_map(hot.cold(quotes), short, n)]
    if hot.table is not None:
        parts.append(_legs_by_join(hot.rows(quotes), short, n))
    if not wide.isEmpty():
        parts.append(_legs_by_join(quotes, wide, n))
    return reduce(DataFrame.unionByName, parts)


def _of_size(quotes: DataFrame, n: int) -> DataFrame:
    return quotes.filter((F.size("legs") == n) & (F.size(F.array_distinct("legs")) == n))


def _legs(entrants: DataFrame) -> DataFrame:
    usable = entrants.filter(F.greatest("p1", "p2", "p3") >= fixed.LEG_CHANCE)
    return usable.select("race_id", "num", "heads", F.struct(*ENTRANT).alias("leg"))


def _legs_by_map(quotes: DataFrame, legs: DataFrame, n: int) -> DataFrame:
    fields = legs.groupBy("race_id").agg(F.map_from_entries(F.collect_list(F.struct("num", "leg"))).alias("_field"))
    joined = quotes.join(fields, "race_id")
    for i, name in enumerate("abc"[:n]):
        joined = joined.withColumn(name, F.try_element_at("_field", F.get("legs", F.lit(i))))
    known = reduce(lambda x, y: x & y, [F.col(name).isNotNull() for name in "abc"[:n]])
    return joined.drop("_field").filter(known)


def _legs_by_join(quotes: DataFrame, legs: DataFrame, n: int) -> DataFrame:
    out = quotes
    for i, name in enumerate("abc"[:n]):
        one = legs.select("race_id", F.col("num").alias("_n"), F.col("leg").alias(name))
        out = out.withColumn("_n", F.get("legs", F.lit(i))).join(one, ["race_id", "_n"]).drop("_n")
    return out


def _ok(leg: Column, k: int) -> Column:
    return leg[f"p{k}"] >= fixed.LEG_CHANCE


def single_chance(kind: Column, a: Column) -> tuple[Column, Column]:
    """Whether the leg may be used (FL02) and the chance; place pays two in small fields."""
    small = a["heads"] <= fixed.SMALL_FIELD
    place = F.when(small, a["p2"]).otherwise(a["p3"])
    chance = F.when(kind == "win", a["p1"]).when(kind == "place", place)
    return chance >= fixed.LEG_CHANCE, chance


def pair_chance(kind: Column, a: Column, b: Column, method: str, pair: Column | None = None) -> tuple[Column, Column]:
    may = (
        F.when(kind == "quinella", _ok(a, 2) & _ok(b, 2)).when(kind == "wide", _ok(a, 3) & _ok(b, 3))
        .when(kind == "exacta", _ok(a, 1) & _ok(b, 2))
    )
    if method == "independent":
        chance = F.when(kind == "quinella", a["p2"] * b["p2"]).when(kind == "wide", a["p3"] * b["p3"]).otherwise(a["p1"] * b["p2"])
    else:
        chance = F.when(kind == "quinella", chances.quinella(a, b, pair)).when(kind == "wide", chances.wide(a, b, pair)).otherwise(
            chances.exacta(a, b) if pair is None else pair["ab"])
    return may, chance


def triple_chance(kind: Column, a: Column, b: Column, c: Column, method: str, pair: Column | None = None) -> tuple[Column, Column]:
    may = F.when(kind == "trio", _ok(a, 3) & _ok(b, 3) & _ok(c, 3)).when(kind == "trifecta", _ok(a, 1) & _ok(b, 2) & _ok(c, 3))
    if method == "independent":
        chance = F.when(kind == "trio", a["p3"] * b["p3"] * c["p3"]).otherwise(a["p1"] * b["p2"] * c["p3"])
    else:
        chance = F.when(kind == "trio", chances.trio(a, b, c, pair)).otherwise(chances.trifecta(a, b, c, pair))
    return may, chance


def frame_quotes(quotes: DataFrame, entrants: DataFrame, method: str = "order", many: Hot | None = None) -> DataFrame:
    """PL07 and AG23: frame quotes with their chance; a contest brings its frames, at most eight, as one map."""
    if method == "independent":
        eligible = entrants.filter((F.col("p2") >= fixed.LEG_CHANCE) & F.col("frame").isNotNull())
        frames = eligible.groupBy("race_id", "frame").agg(F.sum("p2").alias("share"))
        chance = F.col("f")["share"] * F.col("h")["share"]
    else:
        frames = chances.frame_strengths(entrants)
        chance = chances.frame_pair(F.col("f"), F.col("h"), F.get("legs", F.lit(0)) == F.get("legs", F.lit(1)))
    fields = [c for c in frames.columns if c not in ("race_id", "frame")]
    framed = frames.groupBy("race_id").agg(F.map_from_entries(F.collect_list(F.struct("frame", F.struct(*fields)))).alias("_frames"))
    out = lookup(quotes, framed, ["race_id"], many or find_hot(quotes, "race_id"), "inner")
    out = out.withColumns({name: F.try_element_at("_frames", F.get("legs", F.lit(i))) for i, name in enumerate("fh")})
    return out.filter(F.col("f").isNotNull() & F.col("h").isNotNull()).select(*quotes.columns, once(chance).alias("chance"))


GROUPS = [["win", "place"], ["quinella", "wide", "exacta"], ["trio", "trifecta"]]


def contest_cards(entrants: DataFrame, method: str = "order") -> DataFrame:
    """One row per contest of ordinary size: its usable entrants by number and its frames, each as one short map."""
    usable = F.greatest("p1", "p2", "p3") >= fixed.LEG_CHANCE
    leg = F.collect_list(F.when(usable, F.struct("num", F.struct(*ENTRANT).alias("leg")))).alias("_legs")
    if method == "independent":
        sums, fields = [F.sum(F.when(F.col("p2") >= fixed.LEG_CHANCE, F.col("p2"))).alias("share")], [F.col("share")]
    else:
        sums, fields = chances.frame_sums(), chances.frame_fields()
    by_frame = entrants.groupBy("race_id", "frame").agg(leg, *sums)
    listed = F.when(F.col("frame").isNotNull() & F.col("share").isNotNull(), F.struct("frame", F.struct(*fields).alias("sums")))
    return by_frame.groupBy("race_id").agg(
        F.map_from_entries(F.flatten(F.collect_list("_legs"))).alias("_field"), F.map_from_entries(F.collect_list(listed)).alias("_frames"))


def _by_card(quotes: DataFrame, entrants: DataFrame, method: str) -> DataFrame:
    """Quotes of all kinds priced in one pass: a quote meets its contest's card once, whatever its number of legs.

    The join is a merge join by hint: the size Spark guesses for quotes that a generator made, or that come from a checkpoint, is
    far too low, and it would send them to every task.
    """
    kind, columns = F.col("kind"), quotes.columns
    first, second, third = (F.get("legs", F.lit(i)) for i in range(3))
    one, two, three = (kind.isin(group) for group in GROUPS)
    size = F.size("legs")
    fits = F.when(one, size == 1).when(two, (size == 2) & (first != second)).when(
        three, (size == 3) & (first != second) & (first != third) & (second != third)).otherwise(kind == "frame")
    joined = quotes.filter(fits).hint("merge").join(contest_cards(entrants, method), "race_id")
    framed = kind == "frame"
    legs = {name: F.when(~framed, F.try_element_at("_field", leg)) for name, leg in zip("abc", (first, second, third), strict=True)}
    frames = {name: F.when(framed, F.try_element_at("_frames", leg)) for name, leg in zip("fh", (first, second), strict=True)}
    rows = joined.select(*columns, once(F.struct(*[c.alias(name) for name, c in {**legs, **frames}.items()])).alias("_met"))
    a, b, c, f, h = (F.col("_met")[name] for name in "abcfh")
    may = F.when(framed, f.isNotNull() & h.isNotNull()).when(one, single_chance(kind, a)[0]).when(
        two, pair_chance(kind, a, b, method)[0]).otherwise(triple_chance(kind, a, b, c, method)[0])
    rows = rows.filter(may)
    pair = None
    if method == "order":
        rows = rows.select("*", once(F.when(two | three, chances.pair_terms(a, b))).alias("_pair"))
        pair = F.col("_pair")
    frame = f["share"] * h["share"] if method == "independent" else chances.frame_pair(f, h, first == second)
    chance = F.when(framed, frame).when(one, single_chance(kind, a)[1]).when(
        two, pair_chance(kind, a, b, method, pair)[1]).otherwise(triple_chance(kind, a, b, c, method, pair)[1])
    return rows.select(*columns, once(chance).alias("chance"))


def _by_leg(quotes: DataFrame, entrants: DataFrame, method: str, many: Hot) -> DataFrame:
    """The same for wide fields and contests with very many quotes: legs are joined one by one, which spreads them."""
    kind, a, b, c = (F.col(n) for n in ("kind", "a", "b", "c"))
    runners = [single_chance(kind, a), pair_chance(kind, a, b, method), triple_chance(kind, a, b, c, method)]
    lists = []
    for n, (group, (may, chance)) in enumerate(zip(GROUPS, runners, strict=True), 1):
        joined = _legs_by_join(_of_size(quotes.filter(kind.isin(group)), n), _legs(entrants), n)
        lists.append(joined.filter(may).select(*quotes.columns, once(chance).alias("chance")))
    lists.append(frame_quotes(quotes.filter(kind == "frame"), entrants, method, many))
    return reduce(DataFrame.unionByName, lists)


def priced(
    entries: DataFrame, quotes: DataFrame, hot: Hot, method: str = "order", kinds: list[str] | None = None,
    many: Hot | None = None,
) -> DataFrame:
    """Every quote whose legs may be used, with its chance; SE02: one list of all kinds.

    ``hot`` are the contests with very many entrants, ``many`` those with very many quotes.  Where neither these nor wide fields
    exist, entries and quotes are read once each and nothing is written in between.
    """
    quotes = quotes.filter(F.col("kind").isin(kinds or fixed.KINDS))
    many = many or find_hot(quotes, "race_id")
    wide = find_hot(entries, "race_id", rows=chances.SMALL)
    if many.table is None and wide.table is None:
        return _by_card(quotes, entrant_rows(entries, hot), method)
    entrants = entrant_table(entries, hot)
    usual = wide.cold(quotes)
    spread = wide.rows(quotes).unionByName(many.rows(usual))
    short = entrants.filter(F.col("heads") <= chances.SMALL)
    return _by_card(many.cold(usual), short, method).unionByName(_by_leg(spread, entrants, method, many))


def valid(df: DataFrame, min_value: float = fixed.DEFAULT_MIN_VALUE) -> DataFrame:
    """FL03: finite, likely enough, worth enough; tested on unrounded values."""
    value = F.col("chance") * F.col("odds_lo")
    return df.filter(
        finite(F.col("chance")) & finite(F.col("odds_lo")) & F.col("chance").between(fixed.LEG_CHANCE, 1.0) & (F.col("odds_lo") > 0)
    ).withColumn("value", value).filter(finite(F.col("value")) & (F.col("value") >= min_value))


def rule_table(spark, rules: dict | None = None) -> DataFrame:
    rows = [(k, *map(float, r)) for k, r in (rules or fixed.TICKET_RULES).items()]
    return spark.createDataFrame(rows, "kind string, min_chance double, min_value double, max_value double")


def by_rules(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """FL04, JN08: kinds with a rule, chance and value within its inclusive bounds (one row per kind)."""
    table = F.broadcast(rule_table(df.sparkSession, rules).withColumnRenamed("kind", "_kind"))
    within = (F.col("kind") == F.col("_kind")) & F.col("chance").between(F.col("min_chance"), 1.0) & F.col("value").between(
        F.col("rule_min"), F.col("rule_max"))
    table = table.withColumnsRenamed({"min_value": "rule_min", "max_value": "rule_max"})
    return df.join(table, within).drop("_kind", "min_chance", "rule_min", "rule_max")


def propose(
    entries: DataFrame, quotes: DataFrame, hot: Hot, min_value: float = fixed.DEFAULT_MIN_VALUE,
    method: str = "order", rules: dict | None = None, many: Hot | None = None,
) -> DataFrame:
    """PL09: tickets worth buying.  Entries need num, frame, p1, p2, p3; quotes kind, legs, odds_lo."""
    out = valid(priced(entries, quotes, hot, method, many=many), min_value)
    out = by_rules(out, rules) if rules else out
    note = F.when(F.col("kind") == "place", "lower quote").when(F.col("kind") == "wide", "lower quote")
    return out.withColumn("note", note)


def ranked(tickets: DataFrame) -> DataFrame:
    """SO03: best value first within the contest, ties by kind and legs."""
    return tickets.orderBy("race_id", F.col("value").desc(), "kind", "legs")


def field_faults(entries: DataFrame, chance: str = "p1", normalised: bool = False) -> DataFrame:
    """PL10: contests whose chances or numbers cannot be used, with the first reason."""
    p = F.col(chance)
    bad = ~F.coalesce(finite(p) & p.between(0.0, 1.0), F.lit(False))
    facts = entries.groupBy("race_id").agg(
        F.max(bad).alias("bad"), F.sum(F.when(~bad, p)).alias("total"),
        F.count(F.lit(1)).alias("rows"), F.count_distinct("num").alias("numbers"))
    reason = F.when(F.col("bad"), "chance outside 0..1").when(~(F.coalesce(F.col("total"), F.lit(0.0)) > 0), "no positive chance").when(
        F.col("rows") != F.col("numbers"), "repeated number")
    if normalised:
        reason = reason.when(F.abs(F.col("total") - 1) > 1e-9, "chances do not sum to one")
    return facts.select("race_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


