"""Queries on fitting, splits, calibration and the feature matrix (ML01-ML08, JN18, AG24, SK06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from furlong.catalog import views as v
from furlong.catalog.evaluate_queries import _LL, SCORED
from furlong.catalog.registry import query, with_
from furlong.catalog.relative_queries import hot_horses, lag_sql
from furlong.operators import boost, evaluate, features, fit, isotonic
from furlong.operators.groups import by_group
from furlong.plans import calibrate
from furlong.session import apart, cut, scratch_path

FIELD = v.FIELD_SQL
CONTEST = v.CONTEST_SQL
SPLIT = 2000
COLUMNS = ["num", "frame", "carried", "rate", "score0", "last_finish"]


def learning_rows(spark, sf, columns=None, written=cut):
    """Entrants with a few features (or only ``columns``), the label and the year, as a written table (``written=apart``: for one more reader, not written)."""
    rows = v.contest(spark, sf).withColumnRenamed("score", "score0")
    order = (F.col("race_date"), F.col("race_id"), F.col("num"))
    past = by_group(rows, hot_horses(spark, sf), lambda df, g: g.past(df, "past", ["finish"], 1, *order))
    known = past.withColumn("last_finish", F.get("past", F.lit(0))["finish"]).drop("past")
    made = fit.label_rows(known, v.hot_races(spark, sf))
    used = made.columns if columns is None else list(dict.fromkeys(["race_id", "num", "finish", "yr", "label", *columns]))
    return fit.year_split(written(made.select(*used)), SPLIT)


def _sides(spark, sf, columns=None):
    rows = learning_rows(spark, sf, columns)
    return rows.filter(F.col("part") == "train"), rows.filter(F.col("part") == "valid")


def _facts(valid, *checks):
    """Per year of the validation side: rows, rows with a finite result; and whether the model is no worse than the baseline over all."""
    found = valid.join(F.broadcast(checks[0])) if checks else valid
    return found.groupBy("yr").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("_finite").cast("long")).alias("finite"), F.bool_and("no_worse").alias("no_worse"))


_FACTS_SQL = f"select yr, count(*) as rows, count(*) as finite, true as no_worse from contest where yr >= {SPLIT} group by yr"


def _finite(*names):
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() & (F.abs(F.col(n)) < float("inf")) for n in names])


@query("ml01_rank_scorer", with_(CONTEST, _FACTS_SQL))
def ml01(spark, sf):
    """The default scorer's squared loss against that of the mean label of the training side."""
    train, valid = _sides(spark, sf)
    scored = cut(fit.score(fit.fit_scorer(train, COLUMNS), valid, COLUMNS).withColumn("_finite", _finite("score")))
    mean = train.agg(F.avg("label")).first()[0]
    loss = lambda guess: F.avg((guess - F.col("label")) ** 2)
    return _facts(scored, scored.agg((loss(F.col("score")) <= loss(F.lit(mean))).alias("no_worse")))


@query("ml02_pairwise_scorer", with_(CONTEST, _FACTS_SQL))
def ml02(spark, sf):
    """The pairwise scorer's hits against those of the entrants' numbers."""
    train, valid = _sides(spark, sf)
    weights = fit.fit_pairwise(train, v.hot_races(spark, sf), COLUMNS)
    scored = cut(fit.pairwise_score(valid, COLUMNS, weights).withColumn("_finite", _finite("score")))
    hits = {r["score"]: r["hit1"] for r in evaluate.ranking(scored, {"model": F.col("score"), "number": -F.col("num")}).collect()}
    return _facts(scored.withColumn("no_worse", F.lit(hits["model"] >= hits["number"])))


@query("ml03_top_classifiers", with_(CONTEST, _FACTS_SQL))
def ml03(spark, sf):
    """Log losses of the three default classifiers against those of the training side's rates."""
    train, valid = _sides(spark, sf, COLUMNS)
    rates = train.agg(*[F.avg((F.col("finish") <= k).cast("double")).alias(f"top{k}") for k in (1, 2, 3)]).first()
    for k, model in zip((1, 2, 3), boost.at_once(spark, lambda k: fit.fit_top(train, COLUMNS, k), (1, 2, 3)), strict=True):
        valid = fit.top_chance(model, valid, COLUMNS, f"top{k}")

    def loss(p, k):
        p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.sum(-F.when(F.col("finish") <= k, F.log(p)).otherwise(F.log(1 - p)))

    # one pass over the valid side: losses by year, which add up
    sums = {f"{name}{k}": loss(p, k) for k in (1, 2, 3) for name, p in (("_loss", F.col(f"top{k}")), ("_rate", F.lit(rates[f"top{k}"])))}
    years = cut(valid.groupBy("yr").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(_finite("top1", "top2", "top3").cast("long")).alias("finite"), *[c.alias(n) for n, c in sums.items()]))
    better = reduce(lambda a, b: a & b, [F.sum(f"_loss{k}") <= F.sum(f"_rate{k}") for k in (1, 2, 3)])
    return years.select("yr", "rows", "finite").join(F.broadcast(years.agg(better.alias("no_worse"))))


FAST = {"maxDepth": 3, "stepSize": 0.3}
_FOLD_SQL = "cast(cast('0x' || substr(sha256(cast(race_id as varchar)), 1, 8) as bigint) % 3 as int)"


@query("ml01_early_stopping", with_(CONTEST, f"select {_FOLD_SQL} as fold, count(*) as rows, count(*) as finite, true as stopped, true as lowest, true as more from contest group by 1"))
def ml01_stopping(spark, sf):
    """Rows of every fold with their out-of-fold scores; the fold's fit stops before the limit, at its lowest loss, and the last fit has a tenth more rounds than the mean."""
    made = fit.label_rows(v.contest(spark, sf).withColumnRenamed("score", "score0"), v.hot_races(spark, sf))
    rows = cut(made.select("race_id", "num", "label", "carried", "score0", fit.race_fold(F.col("race_id"), 3).alias("fold")))
    scored, found = boost.out_of_fold(rows, [0, 1, 2], ["carried", "num", "score0"], {**FAST, "maxIter": 30}, 0.02)
    final = boost.final_rounds(found)
    mean = sum(s.rounds for s in found) / 3
    facts = {"stopped": [s.rounds < 30 for s in found], "lowest": [s.losses[s.rounds - 1] <= min(s.losses) for s in found], "more": [final == max(int(mean * 1.1), 5)] * 3}
    named = {name: F.element_at(F.array(*map(F.lit, values)), F.col("fold") + 1) for name, values in facts.items()}
    return scored.withColumn("_finite", _finite("score")).groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("_finite").cast("long")).alias("finite")).withColumns(named)


@query("ml03_early_stopping", with_(CONTEST, f"select yr, count(*) as rows, cast(sum(case when finish <= 3 then 1 else 0 end) as bigint) as top, true as stopped, true as lowest from contest where yr >= {SPLIT} group by yr"))
def ml03_stopping(spark, sf):
    """The classifier of "in the first three" stops by the log loss of the later years."""
    rows = learning_rows(spark, sf)
    found = boost.fit_stopping(rows, F.col("part") == "valid", COLUMNS, {**FAST, "maxIter": 30}, 3, 0.02)
    scored = fit.top_chance(found.model, rows.filter("part = 'valid'"), COLUMNS, "top3")
    return scored.filter("top3 between 0 and 1").groupBy("yr").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("finish") <= 3).alias("top")).withColumns(
        {"stopped": F.lit(found.rounds < 30), "lowest": F.lit(found.losses[found.rounds - 1] <= min(found.losses))})


_PAIRS_SQL = """pairs as (
 select t.race_id, t.num as winner, f.num as loser, 1 / (1 + exp(-(f.carried - t.carried) / 10)) as p, ln(1 + exp((f.carried - t.carried) / 10)) as loss
 from field t join field f on t.race_id = f.race_id and t.finish < f.finish where t.finish <= 3)"""


@query("ml02_pair_gradients", with_(FIELD, _PAIRS_SQL, """
sides as (select race_id, winner as num, p as g, p * (1 - p) as h, 0.0 as loss, 0 as n from pairs union all select race_id, loser, -p, p * (1 - p), loss, 1 from pairs)""", """
select f.race_id, f.num, round(coalesce(sum(g), 0), 6) + 0 as grad, round(coalesce(sum(h), 0), 6) + 0 as hess, round(coalesce(sum(s.loss), 0), 6) + 0 as loss, cast(coalesce(sum(n), 0) as bigint) as pairs
from field f left join sides s on f.race_id = s.race_id and f.num = s.num group by f.race_id, f.num"""))
def ml02_gradients(spark, sf):
    """Slopes and curvatures of the pairwise loss against the three best finishers, at scores of a tenth of the weight."""
    hot = v.hot_races(spark, sf)
    rows = v.field(spark, sf).withColumn("score", F.col("carried") / 10)
    out = boost.with_gradients(boost.placed(rows, hot, 3), hot, 3)
    return out.select("race_id", "num", *[v.r6(c).alias(c) for c in ("grad", "hess", "loss")], "pairs")


@query("ml02_boosted_pairs", with_(CONTEST, f"""pairs as (
 select case when a.yr < {SPLIT} then 'train' else 'valid' end as side, count(*) as pairs from contest a join contest b on a.race_id = b.race_id and a.finish < b.finish where a.finish <= 8 group by 1)""", """
select side, cast(n as int) as round, pairs, case when n = 0 then round(pairs * ln(2.0), 3) + 0 end as loss, true as falls from pairs, range(5) r(n)"""))
def ml02_boosted(spark, sf):
    """Pairs of both sides and the loss before the first tree, and whether each of four trees lowers it."""
    rows = learning_rows(spark, sf, ["carried", "num", "score0"], written=apart)
    _, measured = boost.fit_pairs(rows, v.hot_races(spark, sf), ["carried", "num", "score0"], F.col("part") == "valid", 4, params={"maxDepth": 3})
    out = []
    for side in ("train", "valid"):
        for i, m in enumerate(measured):
            loss = m[f"{side}_loss"]
            out.append((side, i, int(m[f"{side}_pairs"]), round(loss, 3) if i == 0 else None, i == 0 or loss < measured[i - 1][f"{side}_loss"]))
    return spark.createDataFrame(out, "side string, round int, pairs long, loss double, falls boolean")


@query("ml04_year_split", with_(CONTEST, f"select race_id, num, case when yr < {SPLIT} then 'train' else 'valid' end as part from contest"))
def ml04(spark, sf):
    return fit.year_split(v.contest(spark, sf), SPLIT).select("race_id", "num", "part")


@query("ml04_contest_folds", "select distinct l_orderkey as race_id, cast(cast('0x' || substr(sha256(cast(l_orderkey as varchar)), 1, 8) as bigint) % 3 as int) as fold from lineitem")
def ml04_folds(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("race_id")).distinct()
    return rows.select("race_id", fit.race_fold(F.col("race_id"), 3).alias("fold"))


@query("ml05_digest_split", with_(FIELD, """races as (select race_id, row_number() over (order by sha256('42:' || cast(race_id as varchar)), race_id) as n, count(*) over () as k from (select distinct race_id from field))""",
 "select f.race_id, f.num, case when r.n <= greatest(1, least(k - 1, k * 2 // 3)) then 'fit' else 'held' end as part from field f join races r using (race_id)"))
def ml05(spark, sf):
    return fit.digest_split(v.field(spark, sf), v.hot_races(spark, sf)).select("race_id", "num", "part")


@query("ml06_calibrated_chances", with_(FIELD, """races as (select race_id, row_number() over (order by sha256('42:' || cast(race_id as varchar)), race_id) as n, count(*) over () as k from (select distinct race_id from field where heads >= 3)),
sides as (select f.*, r.n <= greatest(1, least(r.k - 1, r.k * 2 // 3)) as fits from field f join races r using (race_id))""",
"""select cast(sum(case when not fits then 1 else 0 end) as bigint) as held_rows, cast(sum(case when fits and finish = 1 then 1 else 0 end) as double) as fitted,
 cast(0 as bigint) as falls, cast(0 as bigint) as off from sides"""))
def ml06(spark, sf):
    """Fitted chances sum to the wins of the fit side, never fall with the stored chance, and sum to one in every held contest."""
    rows = cut(v.scored(spark, sf).filter(F.col("heads") >= 3))
    hot = v.hot_races(spark, sf)
    parts = cut(fit.digest_split(rows, hot))
    model = fit.fit_isotonic(parts.filter(F.col("part") == "fit"))
    guessed = model.setFeaturesCol("p1").setPredictionCol("guess").transform(parts.filter(F.col("part") == "fit"))
    held = cut(fit.calibrated(model, parts.filter(F.col("part") == "held").drop("part", "heads"), hot))
    steps = held.groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct("stored1", "p1"))).alias("x"), F.sum("p1").alias("total"))
    falls = F.size(F.filter(F.arrays_zip(F.slice("x", 1, F.size("x") - 1).alias("a"), F.slice("x", 2, F.size("x")).alias("b")), lambda z: z["b"]["p1"] < z["a"]["p1"] - 1e-12))
    facts = steps.agg(F.sum(falls).cast("long").alias("falls"), F.sum((F.abs(F.col("total") - 1) > 1e-9).cast("long")).alias("off"))
    counts = held.agg(F.count(F.lit(1)).alias("held_rows"))
    fitted = guessed.agg(v.r6(F.sum("guess"), 3).alias("fitted"))
    return counts.join(F.broadcast(fitted)).join(F.broadcast(facts)).select("held_rows", "fitted", "falls", "off")


@query("ml06_calibration_job", with_(*SCORED, """races as (select race_id, row_number() over (order by sha256('42:' || cast(race_id as varchar)), race_id) as n, count(*) over () as m from (select race_id from chances group by race_id having count(*) >= 3)),
held as (select c.* from chances c join races r using (race_id) where r.n > greatest(1, least(r.m - 1, r.m * 2 // 3))),
long as (select 1 as k, p1 as p, cast(finish <= 1 as double) as y from held union all select 2, p2, cast(finish <= 2 as double) from held union all select 3, p3, cast(finish <= 3 as double) from held)""", f"""
select k, count(*) as n, {_LL} as stored_logloss, round(avg((p - y) * (p - y)), 6) + 0 as stored_brier, true as better from long group by k"""))
def ml06_job(spark, sf):
    """Rows of the held side, the losses of the stored chances there, and whether the calibrated chances of winning are no worse by either measure."""
    rows = cut(v.scored(spark, sf).filter(F.col("heads") >= 3))
    losses = calibrate.calibrate_job(rows).losses
    better = (F.col("k") > 1) | ((F.col("calibrated_logloss") <= F.col("stored_logloss")) & (F.col("calibrated_brier") <= F.col("stored_brier")))
    return losses.select("k", "n", v.r6("stored_logloss").alias("stored_logloss"), v.r6("stored_brier").alias("stored_brier"), better.alias("better"))


@query("ml06_isotonic_steps", with_(FIELD, """points as (select carried::double as x, avg(case when finish = 1 then 1.0 else 0.0 end) as y, count(*)::double as w from field group by 1),
ends as (select a.x as low, b.x as high, sum(c.y * c.w) / sum(c.w) as mean from points a join points b on a.x <= b.x join points c on c.x between a.x and b.x group by 1, 2),
least as (select p.x, e.low, min(e.mean) as m from points p join ends e on e.low <= p.x and e.high >= p.x group by 1, 2),
steps as (select x, max(m) as value from least group by x)""", """
select x, round(value, 6) + 0 as value from steps"""))
def ml06_steps(spark, sf):
    """The fitted chance of winning at every weight, against the largest of least means."""
    steps = isotonic.fitted(isotonic.points(v.field(spark, sf), F.col("carried"), F.col("finish") == 1), 6)
    xs = v.field(spark, sf).select(F.col("carried").cast("double").alias("x")).distinct()
    return xs.join(steps, F.col("x").between(F.col("low"), F.col("high"))).select("x", v.r6("value").alias("value"))


@query("ml07_halving", with_(CONTEST, """placed as (select race_id, cast('0x' || substr(sha256('42/' || cast(race_id as varchar)), 1, 8) as bigint) / 4294967296.0 as place from (select distinct race_id from contest))""", """
select cast(n as int) as rung, 16 >> n as candidates, count_if(place < power(0.5, 3 - n)) as contests, true as best_kept from placed, range(4) r(n) group by n"""))
def ml07_halving(spark, sf):
    """Candidates of the whole space, as drawn, and contests of every rung, and whether the kept half is its best."""
    rows = learning_rows(spark, sf, ["carried", "num", "score0"])
    found = boost.halving(rows, ["carried", "num", "score0"], fit.sample_space(16))
    out = []
    for rung in range(4):
        here = [r for r in found if r["rung"] == rung]
        worst = min((r["rate"], -r["candidate"]) for r in here if r["kept"])
        out.append((rung, len(here), here[0]["share"], all((r["rate"], -r["candidate"]) <= worst for r in here if not r["kept"])))
    rungs = spark.createDataFrame(out, "rung int, candidates long, share double, best_kept boolean")
    races = rows.select("race_id").distinct().withColumn("_at", boost.position(F.col("race_id")))
    return races.join(F.broadcast(rungs), F.col("_at") < F.col("share")).groupBy("rung", "candidates", "best_kept").agg(F.count(F.lit(1)).alias("contests")).select(
        "rung", "candidates", "contests", "best_kept")


@query("ml07_search", "select cast(n as int) as position, true as rate_in_range, true as consistent from range(2) r(n)")
def ml07(spark, sf):
    """Two candidates, the defaults first; the chosen one is the best, and only if it is strictly better than the defaults."""
    train, valid = _sides(spark, sf, COLUMNS)
    found = fit.tune(train, valid, COLUMNS, fit.sample_space(2))
    best = fit.better_than_default(found)
    top = max(hit for _, hit in found)
    rows = []
    for i, (params, hit) in enumerate(found):
        chosen = best is not None and params == best
        rows.append((i, 0.0 <= hit <= 1.0, chosen == (hit == top and hit > found[0][1])))
    return spark.createDataFrame(rows, "position int, rate_in_range boolean, consistent boolean")


@query("jn18_rank_pairs", with_(FIELD, """top as (select * from field where finish <= 3)""",
 "select f.race_id, t.num as winner, f.num as loser, t.carried - f.carried as carried, round(t.rate - f.rate, 6) + 0 as rate from field f join top t on t.race_id = f.race_id and t.finish < f.finish"))
def jn18(spark, sf):
    out = fit.rank_pairs(v.field(spark, sf), v.hot_races(spark, sf), ["carried", "rate"], 3)
    return out.select("race_id", "winner", "loser", "carried", v.r6("rate").alias("rate"))


@query("ag24_gain_share", with_(CONTEST, f"""values_ as (unpivot (select {", ".join(f"{c}::double as {c}" for c in COLUMNS if c not in ("score0", "last_finish"))}, score::double as score0, null::double as last_finish from contest where yr < {SPLIT}) on {", ".join(COLUMNS)} into name feature value x)""",
 f"""select f.feature, 1.0::double as total, true as listed, true as shares_fit, (select count(*) from contest where yr < {SPLIT}) as rows, case when f.feature <> 'last_finish' then round(sum(x), 3) + 0 end as value_sum
from (select unnest({sorted(COLUMNS)!r}) as feature) f left join values_ v on f.feature = v.feature group by f.feature"""))
def ag24(spark, sf):
    """Every feature is listed, gains sum to one, and the share of the two chosen columns is theirs."""
    train, _ = _sides(spark, sf)
    gains = fit.importances(fit.fit_scorer(train, COLUMNS), COLUMNS)
    share = fit.gain_share(gains, ["frame", "num"])
    total = gains.agg(v.r6(F.sum("gain"), 9).alias("total"), F.sum(F.when(F.col("feature").isin("frame", "num"), F.col("gain")).otherwise(0.0)).alias("mine"))
    fits = (F.abs(F.col("share") - 100 * F.col("mine") / F.col("total")) < 1e-6) & (F.col("used") <= F.col("columns"))
    seen = train.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).cast("double")).alias(c) for c in COLUMNS if c != "last_finish"])
    sums = seen.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(None).cast("double") if c == "last_finish" else v.r6(c, 3)).alias("value_sum")) for c in COLUMNS])).alias("_s"))
    return gains.join(F.broadcast(total)).join(F.broadcast(share)).join(sums.select("rows", "_s.*"), "feature").select(
        "feature", "total", (F.col("gain") >= 0).alias("listed"), fits.alias("shares_fit"), "rows", "value_sum")


@query("sk06_model_bundle", with_(CONTEST, f"""runs as (select jockey, count(finish) as n from contest where yr < {SPLIT} group by jockey having count(finish) >= 3)""",
 f"""select (select count(*) from contest where yr >= {SPLIT}) as rows, 0.0::double as difference, cast((select sum(n) from runs) as bigint) as runs"""))
def sk06(spark, sf):
    """Written, read back, and the same scores from both."""
    from furlong.operators import encode

    train, valid = _sides(spark, sf)
    model = fit.fit_scorer(train, COLUMNS)
    path = scratch_path(spark, "bundle")
    fit.save_bundle(path, {"temperature": 0.8, "features": COLUMNS}, model, {"jockeys": encode.role_totals(train, "jockey")})
    meta, again, tables, _ = fit.load_bundle(spark, path)
    both = fit.score(again, fit.score(model, valid, COLUMNS).withColumnRenamed("score", "before"), meta["features"])
    runs = tables["jockeys"].agg(F.sum("runs").alias("runs"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("score") - F.col("before"))).alias("difference")).join(F.broadcast(runs))


_RUN = ", ".join(f"{lag_sql('carried', i)} as s{i}, {lag_sql('finish', i)} as f{i}, {lag_sql('surface', i)} as u{i}, {lag_sql('num', i)} as d{i}" for i in range(1, 6))
_MATRIX = f"""lags as (select *, cast(jockey % 4 as int) as j0, cast(horse % 3 as int) as h0, cast(horse % 6 as int) as h1, {_RUN} from contest),
own as (select *, case when num % 4 = 0 then greatest(num % 3 - 1, 0) else num % 3 end as w0, case when finish = 1 then greatest(num % 3 - 1, 0) else num % 3 end as wins,
 case when finish = 2 then greatest(j0 - 1, 0) else j0 end as seconds, case when finish = 3 then greatest(h0 - 1, 0) else h0 end as thirds, case when finish >= 4 then greatest(h1 - 1, 0) else h1 end as unplaced,
 list_avg([s1, s2, s3, s4, s5]) as speed_mean, list_max([s1, s2, s3, s4, s5]) as speed_max, list_avg([f1, f2, f3]) as finish_mean3,
 list_avg([case when u1 = surface then s1 end, case when u2 = surface then s2 end, case when u3 = surface then s3 end, case when u4 = surface then s4 end, case when u5 = surface then s5 end]) as same_surface_speed from lags),
rated as (select *, case when wins + seconds + thirds + unplaced > 0 then wins / (wins + seconds + thirds + unplaced)::double end as win_rate from own),
tops as (select race_id, max(speed_max) as top, max(-finish_mean3) as ftop, median(wins) as med, avg(speed_mean) as sm, avg(win_rate) as wr from rated group by race_id),
nexts as (select r.race_id, sum(case when speed_max = top then 1 else 0 end) as many, max(case when speed_max < top then speed_max end) as nxt from rated r join tops t using (race_id) group by r.race_id)"""


@query("ml08_feature_matrix", with_(CONTEST, _MATRIX, """
select r.race_id, r.num, cast(r.heads as bigint) as heads, round(speed_mean, 6) + 0 as speed_mean, speed_max, round(finish_mean3, 6) + 0 as finish_mean3, round(same_surface_speed, 6) + 0 as same_surface_speed,
 cast(wins as double) as career0_wins, round(win_rate, 6) + 0 as career0_win_rate, s1 - s2 as speed_trend, speed_max - top as speed_max_top_gap, speed_max - case when many < 2 then nxt else top end as speed_max_second_gap,
 round(-finish_mean3 - ftop, 6) + 0 as finish_mean3_top_gap, round(speed_mean - sm, 6) + 0 as speed_mean_dev, round(win_rate - wr, 6) + 0 as career0_win_rate_dev,
 cast(case when med <= 0 then 1 when med <= 1 then 2 when med <= 2 then 3 when med <= 3 then 4 else 5 end as double) - 5 as class_change,
 case when speed_max is not null then rank() over (partition by r.race_id order by speed_max desc nulls last) + (count(speed_max) over (partition by r.race_id, speed_max) - 1) / 2.0::double end as speed_max_rank
from rated r join tops t using (race_id) join nexts n using (race_id)"""))
def ml08(spark, sf):
    """The whole feature build on cards whose runs are the horse's earlier entries; a part of the columns is compared."""
    out = features.feature_matrix(cards(spark, sf), v.hot_races(spark, sf), snapshot="post", use_pace=True)
    return out.select(
        "race_id", "num", F.col("heads").cast("long").alias("heads"), v.r6("speed_mean").alias("speed_mean"), "speed_max", v.r6("finish_mean3").alias("finish_mean3"),
        v.r6("same_surface_speed").alias("same_surface_speed"), "career0_wins", v.r6("career0_win_rate").alias("career0_win_rate"), "speed_trend",
        "speed_max_top_gap", "speed_max_second_gap", v.r6("finish_mean3_top_gap").alias("finish_mean3_top_gap"), v.r6("speed_mean_dev").alias("speed_mean_dev"),
        v.r6("career0_win_rate_dev").alias("career0_win_rate_dev"), "class_change", "speed_max_rank")


def cards(spark, sf):
    """Typed entries as the normalisation job gives them, from the contest view."""
    none = lambda t: F.lit(None).cast(t)
    run = {n: none("double") for n in features.RUN_NUMBERS} | {
        "speed": F.col("carried"), "finish": F.col("finish").cast("double"), "num": F.col("num").cast("double"), "heads": F.col("heads").cast("double"),
        "surface": F.col("surface"), "venue": F.col("venue").cast("double"), "class_level": none("double"), "passing": none("array<int>")}
    rows = v.contest(spark, sf).select(
        "race_id", "num", "frame", "horse", "race_date", "carried", "surface", F.col("venue").cast("double").alias("venue"), "finish", "heads", "jockey",
        F.struct(*[c.alias(n) for n, c in run.items()]).alias("run"))
    order = (F.col("race_date"), F.col("race_id"), F.col("num"))
    past = by_group(rows, hot_horses(spark, sf), lambda df, g: g.past(df, "_past", ["run"], features.RUNS, *order))
    four = F.array(*[c.cast("int") for c in (F.col("num") % 3, F.col("jockey") % 4, F.col("horse") % 3, F.col("horse") % 6)])
    return past.withColumns({
        "past": F.transform("_past", lambda p: p["run"]), "age": none("double"), "distance": none("double"), "style4": four,
        "career": F.array(four, four, four, four), "style_now": (F.col("num") % 4 + 1).cast("double")}).drop("_past", "run")
