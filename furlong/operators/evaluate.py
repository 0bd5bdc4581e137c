"""Checks of results and chances, losses, calibration and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.functions.columns import bin_of, brier, finite, linear_edges, logloss, once
from furlong.operators import chances as pl
from furlong.operators.groups import Hot, by_group, lookup
from furlong.operators.relative import zscore
from furlong.session import apart


def _finish_facts() -> list[Column]:
    num, finish = F.col("num").cast("double"), F.col("finish").cast("double")
    fair_num = finite(num) & (num > 0) & (num == F.floor(num))
    fair_finish = finite(finish) & finish.between(1, 98) & (finish == F.floor(finish))
    return [
        F.count(F.lit(1)).alias("_rows"), F.count_distinct("num").alias("_numbers"),
        F.min(F.coalesce(fair_num & fair_finish, F.lit(False))).alias("_fair"),
        *[F.count_if(finish == k).alias(f"_at{k}") for k in (1, 2, 3)],
    ]


def _finish_ok() -> Column:
    once = (F.col("_at1") == 1) & (F.col("_at2") == 1) & (F.col("_at3") == 1)
    return (F.col("_rows") >= 3) & (F.col("_numbers") == F.col("_rows")) & F.col("_fair") & once


def valid_finish(entries: DataFrame) -> DataFrame:
    """FL07: ids of contests with distinct numbers, known finishes and exactly one first, second and third."""
    return entries.groupBy("race_id").agg(*_finish_facts()).filter(_finish_ok()).select("race_id")


def valid_race(entries: DataFrame) -> DataFrame:
    """FL08: FL07 and chances that are finite, in range, ordered and whole."""
    p1, p2, p3 = (F.col(c) for c in ("p1", "p2", "p3"))
    sane = finite(p1) & finite(p2) & finite(p3)
    for p in (p1, p2, p3):
        sane = sane & p.between(0.0, 1.0)
    ordered = (p1 <= p2 + 1e-6) & (p2 <= p3 + 1e-6)
    facts = [
        F.min(F.coalesce(sane & ordered, F.lit(False))).alias("_sane"), F.sum("p1").alias("_sum"),
        F.count_if(p1 != 0).alias("_positive"),
    ]
    good = _finish_ok() & F.col("_sane") & (F.abs(F.col("_sum") - 1) <= 1e-4) & (F.col("_positive") >= 3)
    return entries.groupBy("race_id").agg(*_finish_facts(), *facts).filter(good).select("race_id")


def keep_races(rows: DataFrame, races: DataFrame, hot: Hot) -> DataFrame:
    """JN13: rows of the listed contests."""
    return lookup(rows, races.select("race_id").withColumn("_in", F.lit(True)), ["race_id"], hot, "inner").drop("_in")


def ambiguous_races(rows: DataFrame, file: str = "file") -> DataFrame:
    """JN14: contests that come from more than one file."""
    seen = rows.groupBy("race_id").agg(F.min(file).alias("low"), F.max(file).alias("high"))
    return seen.filter(F.col("low") != F.col("high")).select("race_id")


def drop_ambiguous(rows: DataFrame, hot: Hot, file: str = "file") -> DataFrame:
    bad = ambiguous_races(rows, file).withColumn("_bad", F.lit(True))
    return lookup(rows, bad, ["race_id"], hot).filter(F.col("_bad").isNull()).drop("_bad")


def same_field(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """JN12: contests whose predictions and results name exactly the same numbers."""
    left = predictions.select("race_id", "num").distinct().withColumn("_p", F.lit(1))
    right = results.select("race_id", "num").distinct().withColumn("_r", F.lit(1))
    both = left.join(right, ["race_id", "num"], "full")
    return both.groupBy("race_id").agg(F.min((F.col("_p") + F.col("_r")).isNotNull()).alias("_same")).filter("_same").select("race_id")


def split_rejects(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """FL10: clean rows, and the others with the reason; the rows are worked out once, the test does not repeat their expressions."""
    marked = rows.withColumn("reason", F.explode(F.array(reason)))
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def file_identity(rows: DataFrame, keys: list[str], file: str = "file") -> DataFrame:
    """FL09: per file the reason why its contest identity cannot be used, NULL if it can."""
    same = [F.coalesce(F.min(k) == F.max(k), F.lit(False)) for k in keys]
    whole = [F.count(k) == F.count(F.lit(1)) for k in keys]
    ok = same[0]
    for test in (*same[1:], *whole):
        ok = ok & test
    facts = rows.groupBy(file).agg(ok.alias("_one"), *[F.min(k).alias(k) for k in keys])
    reason = F.when(~F.col("_one"), "missing or mixed identity")
    if "year" in keys:
        reason = reason.when(~F.col("year").between(2000, 2099), "year out of range")
    if "venue" in keys:
        reason = reason.when(~F.col("venue").between(1, len(fixed.VENUE_NAMES)), "unknown venue")
    rest = [k for k in keys if k not in ("year", "venue", "race_id")]
    for k in rest:
        reason = reason.when(F.col(k) < 1, f"{k} out of range")
    if "race_id" in keys:
        parts = [F.pmod(F.col("year"), F.lit(100)), *[F.col(k) for k in keys if k not in ("year", "race_id")]]
        code = F.concat(*[F.lpad(p.cast("string"), 2, "0") for p in parts])
        reason = reason.when(F.col("race_id") != code, "id disagrees with the fields")
    return facts.select(file, *keys, reason.alias("reason"))


def losses(rows: DataFrame, pairs: dict[str, tuple[str, Column]], *keys: str) -> DataFrame:
    """AG12: logloss, brier, mean chance and hit rate for several (chance, hit) columns in one pass."""
    aggregates = []
    for name, (chance, hit) in pairs.items():
        p, y = F.col(chance), hit.cast("double")
        aggregates += [
            F.avg(logloss(p, y)).alias(f"{name}_logloss"), F.avg(brier(p, y)).alias(f"{name}_brier"),
            F.avg(p).alias(f"{name}_pred"), F.avg(y).alias(f"{name}_actual"),
        ]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggregates)


def reliability(rows: DataFrame, chance: str, hit: Column, bins: int = 10) -> DataFrame:
    """AG13: chance against hit rate per bin, empty bins left out."""
    binned = rows.select(F.col(chance).alias("p"), hit.cast("double").alias("y")).withColumn(
        "bin", bin_of(F.col("p"), linear_edges(bins)))
    return binned.filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("pred"), F.avg("y").alias("actual"))


def _leader(score: Column) -> Column:
    """The finish of the best-scored entrant; equal scores go to the lower number."""
    found = F.max(F.when(score.isNotNull(), F.struct(score.alias("s"), (-F.col("num")).alias("n"), F.col("finish").alias("f"))))
    return found["f"]


def ranking(rows: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """AG08, AG25, AG22: hit@1 and first-three rate of several scores in one pass over the table.

    One partial aggregate per score, so neither rows nor pairs are multiplied; only contests with a winner count.
    """
    names = list(scores)
    tops = rows.groupBy("race_id").agg(
        *[_leader(scores[n]).alias(f"_f{i}") for i, n in enumerate(names)], F.min("finish").alias("_best"))
    won = tops.filter(F.col("_best") == 1)
    facts = []
    for i in range(len(names)):
        f = F.col(f"_f{i}")
        facts += [
            F.avg((f == 1).cast("double")).alias(f"_hit{i}"), F.avg((f <= 3).cast("double")).alias(f"_three{i}"),
            F.count(f).alias(f"_n{i}"),
        ]
    wide = won.agg(*facts)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("score"), F.lit(i).alias("position"), F.col(f"_hit{i}").alias("hit1"),
                 F.col(f"_three{i}").alias("top3"), F.col(f"_n{i}").alias("races"))
        for i, n in enumerate(names)
    ])))


def confidence(rows: DataFrame, chance: str, hot: Hot, thresholds: list[float] | None = None) -> DataFrame:
    """FL12: share of contests and hit rates when only picks above a chance count."""
    thresholds = thresholds or fixed.CONFIDENCE_GRID
    picks = by_group(rows.select("race_id", "num", "finish", chance), hot, lambda df, g: g.first(df, 1, F.col(chance).desc(), F.col("num")))
    p, f = F.col(chance), F.col("finish")
    facts = []
    for i, t in enumerate(thresholds):
        sure = p >= t
        facts += [
            F.avg(sure.cast("double")).alias(f"_share{i}"), F.avg(F.when(sure, (f == 1).cast("double"))).alias(f"_hit{i}"),
            F.avg(F.when(sure, (f <= 3).cast("double"))).alias(f"_three{i}"),
        ]
    table = picks.agg(*facts).select(F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_share{i}").alias("share"), F.col(f"_hit{i}").alias("hit1"),
                 F.col(f"_three{i}").alias("top3")) for i, t in enumerate(thresholds)])))
    return table.filter(F.col("share") > 0)


def temperature_losses(rows: DataFrame, hot: Hot, score: str = "score", grid: list[float] | None = None) -> DataFrame:
    """AG21: mean loss of the winner's chance for every temperature.

    Per contest one sum per temperature; rows are never multiplied by the grid.
    """
    grid = grid or fixed.TEMPERATURE_GRID
    shifted = by_group(
        rows.select("race_id", "finish", score), hot, lambda df, g: g.add(df, _top=F.max(score))
    ).select("race_id", "finish", (F.col(score) - F.col("_top")).alias("_x"))
    x = F.col("_x")
    sums = shifted.groupBy("race_id").agg(*[F.sum(F.exp(x / F.lit(t))).alias(f"_z{i}") for i, t in enumerate(grid)])
    won = shifted.filter(F.col("finish") == 1).join(sums, "race_id")
    facts = [
        F.avg(-F.log(F.least(F.greatest(F.exp(x / F.lit(t)) / F.col(f"_z{i}"), F.lit(1e-9)), F.lit(1.0)))).alias(f"_l{i}")
        for i, t in enumerate(grid)
    ]
    return won.agg(*facts).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(t).alias("temperature"), F.col(f"_l{i}").alias("loss"))
        for i, t in enumerate(grid)])))


def best_temperature(table: DataFrame) -> tuple[float, float]:
    """The first smallest loss of a grid of fixed size."""
    row = table.orderBy("loss", "position").first()
    return row["temperature"], row["loss"]


def checked(value: Column, fits: Column, message: str) -> Column:
    """The value; a row that does not fit stops the job.  NULL is let through."""
    value = value.cast("double")
    return F.when(value.isNull() | fits, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), value.cast("string"))).cast("double"))


def finite_score(value: Column) -> Column:
    return checked(value, F.abs(value) < float("inf"), "scores must be finite")  # NaN is larger than all numbers


def log_odds(chance: Column) -> Column:
    p = F.least(F.greatest(chance, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def blend(rows: DataFrame, hot: Hot, score: str, other: str, weight: float, win_chances: bool = False, name: str = "mixed") -> DataFrame:
    """PL11: weighted z-scores of two scores within the contest; weight 0 keeps the scores."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie in 0..1")
    if weight == 0:
        return rows.withColumn(name, F.col(score))
    return with_zscores(rows, hot, score, other, win_chances).withColumn(
        name, F.col("_z") * (1 - weight) + F.col("_zo") * weight).drop("_z", "_zo")


def with_zscores(rows: DataFrame, hot: Hot, score: str, other: str, win_chances: bool = False) -> DataFrame:
    chance = checked(F.col(other), F.col(other).between(0, 1), "win chances must lie in 0..1")
    rows = rows.withColumns({"_other": log_odds(chance) if win_chances else finite_score(F.col(other)), score: finite_score(F.col(score))})
    return by_group(rows, hot, lambda df, g: zscore(zscore(df, g, score, "_z"), g, "_other", "_zo")).drop("_other")


def blend_search(rows: DataFrame, hot: Hot, score: str, other: str, weights: list[float], win_chances: bool = False) -> DataFrame:
    """AG22: hit rates of every weight, position 0 is the score alone."""
    table = with_zscores(rows, hot, score, other, win_chances)
    mixes = {f"{w:g}": F.col("_z") * (1 - w) + F.col("_zo") * w for w in weights}
    return ranking(table, {"0": F.col(score)} | mixes)


def blend_candidates(rows: DataFrame, hot: Hot, score: str, others: dict[str, tuple[str, list[float], bool]]) -> DataFrame:
    """AG22 over several candidates: hit rates of the score alone (position 0) and of every weight of every other score.

    ``others`` names (column, weights, whether it is a win chance).  The result's ``score`` is "name:weight".
    """
    mixes = {"0": F.col(score)}
    for name, (column, weights, win_chances) in others.items():
        rows = with_zscores(rows, hot, score, column, win_chances).withColumnsRenamed({"_z": f"_z_{name}", "_zo": f"_zo_{name}"})
        mixes |= {f"{name}:{w!r}": F.col(f"_z_{name}") * (1 - w) + F.col(f"_zo_{name}") * w for w in weights}
    return ranking(rows, mixes)


def select_blend(table: DataFrame) -> DataFrame:
    """The first weight with the highest hit rate; the score alone unless strictly better."""
    return table.orderBy(F.col("hit1").desc(), "position").limit(1)


def combinations(rows: DataFrame, hot: Hot, top_n: int = 6) -> DataFrame:
    """PL14, JN06: every ticket of pairs and triples among the ``top_n`` best chances of a contest.

    Chances use the whole field; only the tickets are limited to the first ``top_n``, as the report is.
    """
    if top_n < 3:
        raise ValueError("top_n must be at least 3")

    def pick(df, g):
        first = {f"top{k}": F.max(F.when(F.col("finish") == k, F.col("num"))) for k in (1, 2, 3)}
        return g.first(pl.strengths(g.add(df, **first), g, "p1"), top_n, F.col("p1").desc(), F.col("num"))

    chosen = by_group(rows, hot, pick)
    one = F.struct("num", *pl.LEG_FIELDS, "p1", "p2", "p3")
    races = chosen.groupBy("race_id", "top1", "top2", "top3").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("p1")).alias("o"), F.col("num").alias("n"), one.alias("leg")))).alias("_legs"))
    picks = apart(races.withColumn("_legs", F.transform("_legs", lambda x: x["leg"])))  # worked out for pairs and for triples, not written
    pair = picks.select("race_id", "top1", "top2", "top3", "_legs", F.posexplode("_legs").alias("i", "a"))
    pair = pair.select("*", F.posexplode("_legs").alias("j", "b")).filter(F.col("i") != F.col("j"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    t1, t2, t3 = F.col("top1"), F.col("top2"), F.col("top3")
    two, three = F.sort_array(F.array(t1, t2)), F.sort_array(F.array(t1, t2, t3))
    kind, rising = F.col("kind"), F.col("i") < F.col("j")

    def listed(rows: DataFrame, both: Column, sorted_kinds: list[str], every: str) -> DataFrame:
        """One row a kind: the kinds without an order only where the places rise."""
        kinds = F.when(both, F.array(*[F.lit(k) for k in (*sorted_kinds, every)])).otherwise(F.array(F.lit(every)))
        return rows.select("*", F.explode(kinds).alias("kind"))

    def shown(rows: DataFrame, legs: Column, independent: Column, order: Column, hit: Column) -> DataFrame:
        return rows.select("race_id", "kind", legs.alias("legs"), independent.alias("ind"), order.alias("pl"), hit.cast("int").alias("hit"))

    ordered, pairs = F.array(a["num"], b["num"]), F.sort_array(F.array(a["num"], b["num"]))
    terms = F.col("_pair")
    pair = pair.select("*", once(pl.pair_terms(a, b)).alias("_pair"))
    two_leg = shown(
        listed(pair, rising, ["quinella", "wide"], "exacta"), F.when(kind == "exacta", ordered).otherwise(pairs),
        F.when(kind == "quinella", a["p2"] * b["p2"]).when(kind == "wide", a["p3"] * b["p3"]).otherwise(a["p1"] * b["p2"]),
        F.when(kind == "quinella", pl.quinella(a, b, terms)).when(kind == "wide", pl.wide(a, b, terms)).otherwise(terms["ab"]),
        F.when(kind == "quinella", pairs == two).when(kind == "wide", F.size(F.array_except(pairs, three)) == 0).otherwise(ordered == F.array(t1, t2)))
    triple = pair.select("*", F.posexplode("_legs").alias("k", "c")).filter((F.col("k") != F.col("i")) & (F.col("k") != F.col("j")))
    ordered3 = F.array(a["num"], b["num"], c["num"])
    sorted3 = F.sort_array(ordered3)
    three_leg = shown(
        listed(triple, rising & (F.col("j") < F.col("k")), ["trio"], "trifecta"), F.when(kind == "trio", sorted3).otherwise(ordered3),
        F.when(kind == "trio", a["p3"] * b["p3"] * c["p3"]).otherwise(a["p1"] * b["p2"] * c["p3"]),
        F.when(kind == "trio", pl.trio(a, b, c, terms)).otherwise(pl.trifecta(a, b, c, terms)),
        F.when(kind == "trio", sorted3 == three).otherwise(ordered3 == F.array(t1, t2, t3)))
    return two_leg.unionByName(three_leg)


def combination_report(records: DataFrame) -> DataFrame:
    """PL14: hit rate and losses of both methods per kind."""
    hit = F.col("hit")
    table = losses(records, {"ind": ("ind", hit), "pl": ("pl", hit)}, "kind")
    return table.select("kind", "n", F.col("pl_actual").alias("hit_rate"), "ind_logloss", "pl_logloss", "ind_brier", "pl_brier")
