"""Fitting and applying scorers with MLlib (ML01-ML07), and the bundle they are kept in (SK06)."""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, IsotonicRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import chances, evaluate, isotonic, relative
from furlong.operators.groups import Aggregated, Groups, Hot, by_group, lookup
from furlong.session import cut

BUNDLE_VERSION = 8
DEFAULTS = {"maxDepth": 5, "stepSize": 0.1, "maxIter": 20, "subsamplingRate": 0.8, "minInstancesPerNode": 30, "seed": 42}

#: Values of a feature that a tree tells apart (MLlib's ``maxBins``).
BINS = 32
#: Where there are fewer cells, the rows of one are dealt to up to ``DEALS`` parts, so that the draws of ``subsamplingRate`` stay draws of few rows.
DRAWN, DEALS = 200_000, 16

# Search space as (type, low, high, scale).
SEARCH_SPACE = {
    "stepSize": ("float", 0.01, 0.08, "log"), "maxDepth": ("int", 3, 7, None), "minInstancesPerNode": ("int", 5, 100, "log"),
    "subsamplingRate": ("float", 0.6, 0.95, None), "maxIter": ("int", 10, 40, None),
}


def numeric_features(df: DataFrame, excluded: list[str]) -> list[str]:
    plain = {"double", "float", "int", "bigint"}
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in plain and f.name not in excluded]


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    """MLlib trees have no branch for missing values: a flag column keeps the information."""
    made = {}
    for c in features:
        made[f"f_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        made[f"f_{c}_missing"] = F.col(c).isNull().cast("double")
    return df.withColumns(made)


def assembler(features: list[str]) -> VectorAssembler:
    names = [n for c in features for n in (f"f_{c}", f"f_{c}_missing")]
    return VectorAssembler(inputCols=names, outputCol="features")


def fit_scorer(rows: DataFrame, features: list[str], params: dict | None = None) -> PipelineModel:
    """ML01: boosted trees on the rank label (column ``label``)."""
    tree = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="score", **{**DEFAULTS, **(params or {})})
    return Pipeline(stages=[assembler(features), tree]).fit(filled(rows, features))


def score(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(filled(rows, features)).drop("features", *_made(features))


def fit_other(rows: DataFrame, features: list[str], params: dict | None = None) -> PipelineModel:
    """PL11: a second scorer of another kind, a random forest on the rank label."""
    wanted = {"numTrees": 40, "maxDepth": 7, "minInstancesPerNode": DEFAULTS["minInstancesPerNode"], "seed": DEFAULTS["seed"], **(params or {})}
    forest = RandomForestRegressor(featuresCol="features", labelCol="label", predictionCol="score", **wanted)
    return Pipeline(stages=[assembler(features), forest]).fit(filled(rows, features))


def fit_top(rows: DataFrame, features: list[str], k: int, params: dict | None = None) -> PipelineModel:
    """ML03: boosted trees for "finishes in the first k", on cells where rows share them."""
    data = tree_rows(rows, features, (F.col("finish") <= k).cast("double"))
    tree = GBTClassifier(featuresCol="features", labelCol="_label", **data.params({**DEFAULTS, **(params or {})}))
    return PipelineModel([*data.stages, tree.fit(data.table)])


def top_chance(model: PipelineModel, rows: DataFrame, features: list[str], name: str) -> DataFrame:
    out = model.transform(filled(rows, features)).withColumn(name, F.get(vector_to_array("probability"), F.lit(1)))
    return out.drop("features", "prediction", "rawPrediction", "probability", *_made(features))


def rank_pairs(rows: DataFrame, hot: Hot, columns: list[str], k: int = 8) -> DataFrame:
    """JN18: each entrant against the ``k`` best finishers of its contest that beat it.

    The best are one short array per contest, so the pairs grow with the entrants, not with their square.
    """
    needed = rows.select("race_id", "num", "finish", *columns)
    best = by_group(needed, hot, lambda df, g: g.first(df, k, F.col("finish"), F.col("num")))
    lists = best.groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct("finish", "num", *columns))).alias("_best"))
    beaten = lookup(needed, lists, ["race_id"], hot).withColumn("_winner", F.explode("_best"))
    winner = F.col("_winner")
    return beaten.filter(winner["finish"] < F.col("finish")).select(
        "race_id", winner["num"].alias("winner"), F.col("num").alias("loser"),
        *[(winner[c] - F.col(c)).alias(c) for c in columns])


def fit_pairwise(rows: DataFrame, hot: Hot, features: list[str], k: int = 8, regularise: float = 0.01) -> list[float]:
    """ML02: weights of a linear score whose differences tell who finishes in front."""
    names = [f"f_{c}" for c in features]
    known = rows.select("race_id", "num", "finish", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(features, names)])
    pairs = rank_pairs(known, hot, names, k)
    # half of the pairs are turned round so that both outcomes occur
    side = F.when(F.pmod(F.xxhash64("race_id", "winner", "loser"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    turned = pairs.withColumn("_side", side).select(
        (F.col("_side") > 0).cast("double").alias("label"), *[(F.col(n) * F.col("_side")).alias(n) for n in names])
    data = VectorAssembler(inputCols=names, outputCol="features").transform(turned)
    model = LogisticRegression(fitIntercept=False, regParam=regularise, standardization=True).fit(data)
    return [float(w) for w in model.coefficients]


def pairwise_score(rows: DataFrame, features: list[str], weights: list[float]) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(w) for c, w in zip(features, weights)]
    return rows.withColumn("score", sum(parts, F.lit(0.0)))


def race_fold(race_id: Column, k: int) -> Column:
    """ML04: fold of a contest by the digest of its id, the same in every run and engine."""
    digest = F.sha2(race_id.cast("string"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def year_split(rows: DataFrame, year: int, k: int = 3) -> DataFrame:
    """ML04: ``part`` is train or valid by year; without rows on both sides contests are split into k folds."""
    sides = rows.agg(F.max(F.col("yr") < year).alias("a"), F.max(F.col("yr") >= year).alias("b")).first()
    if sides["a"] and sides["b"]:
        return rows.withColumn("part", F.when(F.col("yr") < year, "train").otherwise("valid"))
    return rows.withColumn("part", F.when(race_fold(F.col("race_id"), k) == 0, "valid").otherwise("train"))


def digest_split(rows: DataFrame, hot: Hot, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """ML05: the two thirds of the contests with the smallest digests are ``fit``, at least one on each side.

    Contests are numbered over range partitions, not in one task.
    """
    keys = keys or ["race_id"]
    races = rows.select("race_id", *[k for k in keys if k != "race_id"]).distinct()
    text = F.concat(F.lit(f"{seed}:"), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    numbered = Aggregated(("_all",)).number(
        races.withColumns({"_all": F.lit(0), "_digest": F.sha2(text, 256)}), "_n", F.col("_digest"), *[F.col(k) for k in keys])
    n = races.count()
    if n < 2:
        raise ValueError("at least two contests are needed")
    limit = max(1, min(n - 1, n * 2 // 3))
    marks = numbered.select("race_id", F.when(F.col("_n") <= limit, "fit").otherwise("held").alias("part"))
    return lookup(rows, marks, ["race_id"], hot)


def fit_isotonic(rows: DataFrame) -> IsotonicRegressionModel:
    """ML06: chance of winning as an increasing function of p1."""
    return isotonic.model(isotonic.fitted(isotonic.points(rows, F.col("p1"), F.col("finish") == 1)))


def calibrated(model: IsotonicRegressionModel, rows: DataFrame, hot: Hot) -> DataFrame:
    """ML06: calibrated strengths, normalised per contest, as new p1, p2, p3 (the old ones as stored1..3)."""
    stored = rows.withColumnsRenamed({f"p{k}": f"stored{k}" for k in (1, 2, 3)})
    out = model.setFeaturesCol("stored1").setPredictionCol("_raw").transform(stored)
    strength = F.greatest(F.least(F.greatest(F.col("_raw"), F.lit(1e-6)), F.lit(1 - 1e-6)), F.lit(1e-12))
    marked = out.withColumn("_score", F.log(strength)).drop("_raw")
    return by_group(marked.withColumnRenamed("_score", "strength"), hot, lambda df, g: chances.top_three(df, g, "strength"))


def sample_space(trials: int, seed: int = 42) -> list[dict]:
    """ML07: the defaults first, then seeded draws from the space."""
    draw = random.Random(seed)
    out = [{k: DEFAULTS[k] for k in SEARCH_SPACE}]
    for _ in range(trials - 1):
        one = {}
        for name, (kind, low, high, scale) in SEARCH_SPACE.items():
            value = math.exp(draw.uniform(math.log(low), math.log(high))) if scale == "log" else draw.uniform(low, high)
            one[name] = int(round(value)) if kind == "int" else value
        out.append(one)
    return out


@dataclass
class Cells:
    """Rows that no tree can tell apart, as one row with their mean label and their number; the same table serves every candidate."""

    bins: Bucketizer | None
    features: list[str]
    table: DataFrame
    rows: float

    def vectors(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the vector of their bins."""
        return self._assembler().transform(_binned(filled(rows, self.features), self.bins)).drop(*_binned_names(self.features, self.bins), *names(self.features))

    def fit(self, params: dict, name: str = "score") -> GBTRegressionModel:
        """Boosted trees on the cells, for vectors of bins; the least rows of a node are a least weight."""
        wanted = {**DEFAULTS, **params}
        least = min(wanted.pop("minInstancesPerNode") / max(self.rows, 1.0), 0.499)
        tree = GBTRegressor(featuresCol="features", labelCol="label", weightCol="weight", predictionCol=name, minInstancesPerNode=1, minWeightFractionPerNode=least, maxBins=BINS, **wanted)
        return tree.fit(self.table)

    def _assembler(self) -> VectorAssembler:
        return VectorAssembler(inputCols=_binned_names(self.features, self.bins), outputCol="features")


@dataclass
class TreeRows:
    """What boosted trees are fitted on: ``features``, ``_label`` and maybe ``_valid``, and the stages that make ``features`` of filled rows.

    ``rows`` is the number of training rows behind weighted cells, or None where each row stands for itself.
    """

    table: DataFrame
    stages: list
    rows: float | None = None

    def params(self, wanted: dict) -> dict:
        """The least rows of a node are a least weight of cells."""
        if self.rows is None:
            return wanted
        wanted = {"minInstancesPerNode": 1, **wanted}
        least = min(wanted["minInstancesPerNode"] / max(self.rows, 1.0), 0.499)
        return {"maxBins": BINS, **wanted, "minInstancesPerNode": 1, "minWeightFractionPerNode": least, "weightCol": "weight"}


def tree_rows(rows: DataFrame, features: list[str], label: Column, valid: Column | None = None) -> TreeRows:
    """Rows that no tree can tell apart and that agree in label and side, as one weighted row; rows that mostly differ stay as they are.

    Losses over these cells are those over the rows.  Borders of bins are the training side's.
    """
    sides = {} if valid is None else {"_valid": valid}
    marked = rows.withColumns({"_label": label.cast("double"), **sides})
    train = marked if valid is None else marked.filter(~F.col("_valid"))
    bins = bin_features(train, features)
    keys = [*_binned_names(features, bins), "_label", *sides]
    own = [c for c in ("race_id", "num") if c in rows.columns]
    known = _binned(filled(marked, features), bins).select(*own, *keys)
    counted = F.lit(1.0) if valid is None else F.when(~F.col("_valid"), 1.0)
    n, learnt, different = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(counted), F.lit(0.0)), F.approx_count_distinct(F.xxhash64(*keys))).first()
    deals = max(1, min(DEALS, DRAWN // max(different, 1)))
    if different * deals * 2 >= n:
        return TreeRows(assembler(features).transform(filled(marked, features)).select("features", "_label", *sides), [assembler(features)])
    dealt = known.withColumn("_deal", F.pmod(F.xxhash64(*(own or keys)), F.lit(deals)))
    summed = dealt.groupBy(*keys, "_deal").agg(F.count(F.lit(1)).cast("double").alias("weight")).sortWithinPartitions(*keys, "_deal")
    vectors = VectorAssembler(inputCols=_binned_names(features, bins), outputCol="features")
    table = cut(vectors.transform(summed).select("features", "_label", "weight", *sides))
    return TreeRows(table, [*([] if bins is None else [bins]), vectors], float(learnt))


def _made(features: list[str]) -> list[str]:
    """The columns that a scorer adds to the rows."""
    return [*names(features), *[f"f_{c}_bin" for c in features]]


def names(features: list[str]) -> list[str]:
    """The columns that ``filled`` makes."""
    return [f"f_{c}{s}" for c in features for s in ("", "_missing")]


def _binned_names(features: list[str], bins: Bucketizer | None) -> list[str]:
    done = {} if bins is None else dict(zip(bins.getInputCols(), bins.getOutputCols(), strict=True))
    return [done.get(n, n) for n in names(features)]


def _binned(known: DataFrame, bins: Bucketizer | None) -> DataFrame:
    """Bins are numbers in order; the mark of a category, by which trees would forget the order, is taken off."""
    return known if bins is None else bins.transform(known).withColumns({n: F.col(n) + F.lit(0.0) for n in bins.getOutputCols()})


def bin_features(rows: DataFrame, features: list[str]) -> Bucketizer | None:
    """Borders at the quantiles for features of more than ``BINS`` values; one pass."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    names = [f"f_{c}" for c in features]
    facts = filled(rows, features).agg(*[x for n in names for x in (
        F.approx_count_distinct(n).alias(f"n_{n}"), F.percentile_approx(n, shares, F.lit(1000)).alias(f"q_{n}"))]).first()
    borders = {n: sorted({x for x in facts[f"q_{n}"] if math.isfinite(x)}) for n in names if facts[f"n_{n}"] > BINS}
    if not borders:
        return None
    return Bucketizer(
        splitsArray=[[-math.inf, *b, math.inf] for b in borders.values()], inputCols=list(borders), outputCols=[f"{n}_bin" for n in borders])


def cells(rows: DataFrame, features: list[str]) -> Cells:
    """The cells of all ``rows``; where rows mostly differ (many features) each stays a row of its own."""
    bins = bin_features(rows, features)
    keys = _binned_names(features, bins)
    known = _binned(filled(rows, features), bins).select("race_id", "num", *keys, F.col("label").cast("double").alias("label"))
    n, different = known.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).first()
    deals = max(1, min(DEALS, DRAWN // max(different, 1)))
    if different * deals * 2 < n:
        dealt = known.withColumn("_deal", F.pmod(F.xxhash64("race_id", "num"), F.lit(deals)))
        known = dealt.groupBy(*keys, "_deal").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight")).sortWithinPartitions(*keys, "_deal")
    else:
        known = known.withColumn("weight", F.lit(1.0))
    made = Cells(bins, features, known, float(n))
    made.table = cut(made._assembler().transform(known).select("features", "label", "weight"))
    return made


def rates(train: DataFrame, valid: DataFrame, features: list[str], candidates: list[dict], run=None) -> list[float]:
    """ML07: hit rate of the first pick of every candidate; one pass over either side serves all of them.

    ``run(work, items)`` may fit several candidates at a time.
    """
    known = cells(train, features)
    names = [f"_score{i}" for i in range(len(candidates))]
    work = lambda i: known.fit(candidates[i], names[i])
    models = (run or (lambda f, items: [f(i) for i in items]))(work, list(range(len(candidates))))
    scored = known.vectors(valid.select("race_id", "num", "finish", *[c for c in features if c not in ("race_id", "num", "finish")]))
    for model in models:
        scored = model.transform(scored)
    found = evaluate.ranking(scored.select("race_id", "num", "finish", *names), {n: F.col(n) for n in names})
    hits = {r["score"]: r["hit1"] or 0.0 for r in found.collect()}
    return [hits[n] for n in names]


def tune(train: DataFrame, valid: DataFrame, features: list[str], candidates: list[dict]) -> list[tuple[dict, float]]:
    """ML07: hit rate of the first pick per candidate; the best may be used if it beats the first."""
    return list(zip(candidates, rates(train, valid, features, candidates), strict=True))


def better_than_default(results: list[tuple[dict, float]]) -> dict | None:
    best = max(results, key=lambda r: r[1])
    return best[0] if best[1] > results[0][1] else None


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """AG24: share of the gain per feature, best first; a flag counts for its column."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(values[2 * i] + values[2 * i + 1])) for i, c in enumerate(features)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.col("gain").desc(), "feature")


def gain_share(gains: DataFrame, categories: list[str]) -> DataFrame:
    """AG24: how much of the gain the category columns have, and how many of them are used."""
    mine = F.col("feature").isin(categories)
    return gains.agg(
        (F.coalesce(F.sum(F.when(mine, F.col("gain"))), F.lit(0.0)) / F.sum("gain") * 100).alias("share"),
        F.count_if(mine & (F.col("gain") > 0)).alias("used"), F.lit(len(categories)).alias("columns"))


def label_rows(rows: DataFrame, hot: Hot) -> DataFrame:
    def labelled(df: DataFrame, g: Groups) -> DataFrame:
        return relative.rank_label(df, g)

    return by_group(rows, hot, labelled)


def check_bundle(meta: dict) -> None:
    """SK06: what must hold when a bundle is written or read."""
    if meta.get("version") != BUNDLE_VERSION:
        raise ValueError("the bundle has another version; train again")
    heat = meta.get("temperature")
    if not isinstance(heat, (int, float)) or not math.isfinite(heat) or heat <= 0:
        raise ValueError("temperature must be finite and positive")
    for name in ("other", "win"):
        weight = meta.get(f"{name}_weight", 0.0)
        if not math.isfinite(weight) or not 0 <= weight <= 1:
            raise ValueError("blend weights must be finite and in 0..1")
        if bool(meta.get(f"has_{name}")) != (weight > 0):
            raise ValueError("a blend model and a nonzero weight belong together")
    if meta.get("other_weight", 0.0) > 0 and meta.get("win_weight", 0.0) > 0:
        raise ValueError("only one blend model may be selected")


def save_bundle(path: str, meta: dict, model: PipelineModel, tables: dict[str, DataFrame], extra: dict[str, PipelineModel] | None = None) -> None:
    """SK06: one folder per part; metadata last, so an unfinished bundle has none."""
    meta = {"version": BUNDLE_VERSION, **meta, **{f"has_{n}": True for n in (extra or {})}, "tables": sorted(tables)}
    check_bundle(meta)
    model.write().overwrite().save(f"{path}/model")
    for name, part in (extra or {}).items():
        part.write().overwrite().save(f"{path}/model_{name}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict, PipelineModel, dict[str, DataFrame], dict[str, PipelineModel]]:
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    check_bundle(meta)
    extra = {n: PipelineModel.load(f"{path}/model_{n}") for n in ("other", "win") if meta.get(f"has_{n}")}
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
    return meta, PipelineModel.load(f"{path}/model"), tables, extra


