"""Boosting that chooses its rounds (ML01, ML03), boosted trees on the pairs of a contest (ML02), and the search for parameters (ML07)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import fit
from furlong.operators.groups import Groups, Hot, by_group
from furlong.session import cut, dropped, scratch_path

MAX_ROUNDS = 200
#: Part of the validation loss by which a round must lower it for the fit to go on.
TOLERANCE = 1e-3
LEAST_ROUNDS = 5
#: Fits that run at the same time; Spark shares the executors among their jobs.
AT_ONCE = 4
BEST = 8


def at_once(spark: SparkSession, work: Callable, items: Iterable) -> list:
    """``work`` on every item, a few at a time; the results keep their order."""
    def run(item):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "fits")
        return work(item)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), item) for item in items]]


# ---------------------------------------------------------------- rounds by validation
@dataclass
class Stopped:
    """A model, the rounds with the least validation loss, and that loss after every round that was kept."""

    model: PipelineModel
    rounds: int
    losses: list[float] = field(default_factory=list)


def fit_stopping(
    rows: DataFrame, valid: Column, features: list[str], params: dict | None = None, top: int | None = None, tolerance: float = TOLERANCE,
) -> Stopped:
    """ML01 (rank label) or ML03 (``top``: finishes in the first ``top``): rounds are added until the loss of the ``valid`` rows stops falling."""
    label = F.col("label") if top is None else (F.col("finish") <= top).cast("double")
    data = fit.tree_rows(rows, features, label, valid)
    wanted = data.params({**fit.DEFAULTS, "maxIter": MAX_ROUNDS, **(params or {}), "validationIndicatorCol": "_valid", "validationTol": tolerance})
    if top is None:
        tree = GBTRegressor(featuresCol="features", labelCol="_label", predictionCol="score", **wanted).fit(data.table)
        losses = tree.evaluateEachIteration(data.table.filter("_valid"), "squared")
    else:
        tree = GBTClassifier(featuresCol="features", labelCol="_label", **wanted).fit(data.table)
        losses = tree.evaluateEachIteration(data.table.filter("_valid"))
    return Stopped(PipelineModel([*data.stages, tree]), losses.index(min(losses)) + 1, list(losses))


def out_of_fold(rows: DataFrame, folds: list[int], features: list[str], params: dict | None = None, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[Stopped]]:
    """Every row scored by the model that its ``fold`` stopped and did not train, and the models of all folds."""
    found = at_once(rows.sparkSession, lambda k: fit_stopping(rows, F.col("fold") == k, features, params, tolerance=tolerance), folds)
    parts = [fit.score(s.model, rows.filter(F.col("fold") == k), features) for k, s in zip(folds, found, strict=True)]
    return reduce(DataFrame.unionByName, parts), found


def final_rounds(found: list[Stopped], least: int = LEAST_ROUNDS) -> int:
    """A tenth more than the mean of the folds, as the last fit has all rows."""
    return max(int(sum(s.rounds for s in found) / len(found) * 1.1), least)


# ---------------------------------------------------------------- pairs
def with_gradients(rows: DataFrame, hot: Hot, k: int = BEST, score: str = "score") -> DataFrame:
    """ML02: slope ``grad``, curvature ``hess``, ``loss`` and number ``pairs`` of the pairwise logistic loss of every entrant.

    An entrant meets the ``k`` best finishers of its contest that beat it.  Their scores are ``k`` totals of the contest, and what the
    others give back to each of them are ``k`` more; there is no table of pairs and no list of entrants.  Columns ``_place`` and
    ``finish`` tell the best.  ``loss`` and ``pairs`` stand with the beaten entrant.
    """
    places = range(1, k + 1)
    zero = F.lit(0.0)

    def pipeline(df: DataFrame, g: Groups) -> DataFrame:
        best = {f"_{name}{r}": F.max(F.when(F.col("_place") == r, F.col(c))) for r in places for name, c in (("s", score), ("f", "finish"))}
        met = g.add(df, **best)
        met = met.withColumns({f"_x{r}": F.when(F.col(f"_f{r}") < F.col("finish"), F.col(score) - F.col(f"_s{r}")) for r in places})
        met = met.withColumns({f"_p{r}": 1 / (1 + F.exp(-F.col(f"_x{r}"))) for r in places})
        back = {f"_{name}{r}": F.sum(c) for r in places for name, c in (("b", F.col(f"_p{r}")), ("c", F.col(f"_p{r}") * (1 - F.col(f"_p{r}"))))}
        known = g.add(met, **back)
        own = lambda name: reduce(lambda a, r: F.when(F.col("_place") == r, F.coalesce(F.col(f"_{name}{r}"), zero)).otherwise(a), places, zero)
        each = lambda make: reduce(lambda a, b: a + b, [F.coalesce(make(r), zero) for r in places])
        p = lambda r: F.col(f"_p{r}")
        softplus = lambda x: F.greatest(x, zero) + F.log1p(F.exp(-F.abs(x)))
        return known.withColumns({
            "grad": own("b") - each(p), "hess": own("c") + each(lambda r: p(r) * (1 - p(r))),
            "loss": each(lambda r: softplus(F.col(f"_x{r}"))), "pairs": each(lambda r: F.col(f"_x{r}").isNotNull().cast("long")).cast("long"),
        }).drop(*[f"_{name}{r}" for r in places for name in "sfxpbc"])

    return by_group(rows, hot, pipeline)


def placed(rows: DataFrame, hot: Hot, k: int = BEST) -> DataFrame:
    """``_place``: 1 to ``k`` for the best finishers of a contest, else NULL."""
    def pipeline(df: DataFrame, g: Groups) -> DataFrame:
        return g.number(df, "_place", F.col("finish").asc_nulls_last(), F.col("num"))

    known = by_group(rows, hot, pipeline)
    return known.withColumn("_place", F.when((F.col("_place") <= k) & F.col("finish").isNotNull(), F.col("_place")))


def fit_pairs(
    rows: DataFrame, hot: Hot, features: list[str], valid: Column | None = None, rounds: int = 30, step: float = 0.3, patience: int = 3, k: int = BEST,
    params: dict | None = None,
) -> tuple[Stopped, list[dict]]:
    """ML02: trees fitted one after the other to the slopes of the pairwise loss, each leaf worth its slopes over its curvature.

    With ``valid`` rows the fit ends when their loss has not fallen for ``patience`` rounds, and the best rounds are kept.  Also
    returns the loss and the pairs of both sides before every round and after the last.
    """
    wanted = {"maxDepth": fit.DEFAULTS["maxDepth"], "minInstancesPerNode": fit.DEFAULTS["minInstancesPerNode"], "seed": fit.DEFAULTS["seed"], **(params or {})}
    spark, made, vectors = rows.sparkSession, fit.names(features), fit.assembler(features)
    known = fit.filled(rows.withColumn("_valid", F.lit(False) if valid is None else valid), features)
    state = cut(placed(known.select("race_id", "num", "finish", "_valid", *made), hot, k))
    trees, measured, best, path = [], [], 0, None
    for n in range(rounds + 1):
        # scores follow from the trees, so a round writes what its tree is fitted to and no more, in the place of the round before
        scored = vectors.transform(state).withColumn("score", F.lit(0.0))
        for tree in trees:
            scored = tree.transform(scored).withColumn("score", F.col("score") + F.lit(step) * F.col(tree.getPredictionCol())).drop(tree.getPredictionCol())
        before, path = path, scratch_path(spark, "slopes")
        slopes = with_gradients(scored.drop("features"), hot, k).select("_valid", *made, "grad", "hess", "loss", "pairs")
        slopes.write.parquet(path)
        if before:
            dropped(spark, before)
        known = spark.read.schema(slopes.schema).parquet(path)
        sums = {r["_valid"]: r for r in known.groupBy("_valid").agg(F.sum("loss").alias("loss"), F.sum("pairs").alias("pairs")).collect()}
        measured.append({"round": n} | {f"{side}_{c}": sums[flag][c] if flag in sums else 0 for side, flag in (("train", False), ("valid", True)) for c in ("loss", "pairs")})
        judged = "valid_loss" if valid is not None else "train_loss"
        best = n if measured[n][judged] < measured[best][judged] else best
        if n == rounds or (valid is not None and n - best >= patience):
            break
        data = known.filter(~F.col("_valid") & (F.col("hess") > 0)).withColumn("_target", F.col("grad") / F.col("hess"))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="_target", weightCol="hess", predictionCol=f"_t{n}", **wanted)
        trees.append(tree.fit(vectors.transform(data)))
    dropped(spark, path)
    kept = trees[:best]
    names = [t.getPredictionCol() for t in kept]
    total = f"{step} * ({' + '.join(names)})" if names else "0.0D"
    left = f"* except ({', '.join(names)})" if names else "*"
    model = PipelineModel([fit.assembler(features), *kept, SQLTransformer(statement=f"select {left}, {total} as score from __THIS__")])
    return Stopped(model, best, [m[judged] for m in measured]), measured


# ---------------------------------------------------------------- search
def position(race_id: Column, seed: int = 42) -> Column:
    """A contest's place from 0 to 1 by the digest of its id: a larger share of the contests holds every smaller one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}/"), race_id.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def halving(
    rows: DataFrame, features: list[str], candidates: list[dict], seed: int = 42, judge: Callable[[DataFrame, dict], float] | None = None,
) -> list[dict]:
    """ML07: all candidates on a part of the contests, the better half on twice as much, until two are left on all.

    Column ``part`` tells the sides; ``rows`` are a written table, since the last rung reads them as they are.  The candidates of a rung
    share one pass over either side (``fit.rates``).  One row for each candidate and rung: its rate of first picks that win, and whether it goes on;
    ties go to the earlier candidate.
    """
    if not candidates:
        raise ValueError("a search needs a candidate")

    def judged(part: DataFrame, alive: list[int]) -> list[float]:
        if judge is not None:
            return at_once(rows.sparkSession, lambda c: judge(part, candidates[c]), alive)
        train, valid = (part.filter(F.col("part") == side) for side in ("train", "valid"))
        return fit.rates(train, valid, features, [candidates[c] for c in alive], lambda work, items: at_once(rows.sparkSession, work, items))

    rungs = max(1, (len(candidates) - 1).bit_length())
    alive, found = list(range(len(candidates))), []
    for rung in range(rungs):
        share = 0.5 ** (rungs - 1 - rung)
        part = rows if share == 1 else cut(rows.filter(position(F.col("race_id"), seed) < share))
        rates = judged(part, alive)
        order = sorted(range(len(alive)), key=lambda i: (-rates[i], alive[i]))
        on = {alive[i] for i in order[:max(1, len(alive) // 2)]}
        found += [{"rung": rung, "share": share, "candidate": c, "rate": r, "kept": c in on} for c, r in zip(alive, rates, strict=True)]
        alive = sorted(on)
    return found


def winner(found: list[dict]) -> int:
    """The candidate that the last rung kept."""
    return next(r["candidate"] for r in found if r["kept"] and r["rung"] == found[-1]["rung"])
