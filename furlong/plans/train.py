"""Training job: cards to a model bundle; tuning job: cards to the parameters that the next training uses.

scan -> typed entries -> training rows -> features -> out-of-fold statistics -> scorers that stop by the validation side -> blend -> temperature -> refit -> bundle
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.operators import boost, encode, evaluate, features, fit
from furlong.operators.chances import softmax
from furlong.operators.groups import Hot, by_group, find_hot
from furlong.operators.normalize import normalize_entries
from furlong.session import cut
from furlong.sources.files import career_bands, read_entries

ROLE_CONDITIONS = ["venue", "surface", "main_style_name"]
CATEGORIES = ["venue_name", "sex", "direction", "sire", "damsire"]
NOT_FEATURES = [
    "race_id", "num_key", "finish", "label", "fold", "year", "yr", "meeting", "day", "main_style", "score", "p1", "p2", "p3",
    "career_total", "style_total",
]


@dataclass(frozen=True)
class TrainConfig:
    split_year: int = 2025
    use_pace: bool = False
    drop_career: bool = False
    params: dict = field(default_factory=dict)
    other_params: dict = field(default_factory=dict)
    #: Folder of parameters that a tuning job has written; those in ``params`` come before them.
    tuned: str | None = None
    tolerance: float = boost.TOLERANCE


def with_blend(scored: DataFrame, hot: Hot, chosen: str, weight: float) -> DataFrame:
    """PL11: ``score`` mixed with the chosen candidate's column; without one it stays."""
    if not chosen:
        return scored
    return evaluate.blend(scored, hot, "score", chosen, weight, win_chances=chosen == "win", name="score")


def choose_blend(scored: DataFrame, hot: Hot) -> tuple[str, float, dict]:
    """AG22: the candidate and weight that beat the scorer alone on (score, other, win), or none; and the measures of the choice."""
    candidates = {"other": ("other", fixed.BLEND_GRIDS["other"], False), "win": ("win", fixed.BLEND_GRIDS["win"], True)}
    best = evaluate.select_blend(evaluate.blend_candidates(scored, hot, "score", candidates)).first().asDict()
    name, _, weight = best["score"].partition(":")
    return ("", 0.0, best) if best["score"] == "0" else (name, float(weight), best)


def report(scored: DataFrame, hot: Hot, temperature: float) -> dict[str, list]:
    """AG25 and FL12 on the validation side: simple rankings, and hits by confidence."""
    simple = {"number": -F.col("num"), "score": F.col("score"), "other": F.col("other"), "win": F.col("win")}
    chances = by_group(scored, hot, lambda df, g: softmax(df, g, "score", temperature, "p1"))
    return {"baselines": [r.asDict() for r in evaluate.ranking(scored, simple).collect()], "confidence": [r.asDict() for r in evaluate.confidence(chances, "p1", hot).collect()]}


def training_rows(entries: DataFrame, excluded_surface: str = fixed.STEEPLECHASE) -> DataFrame:
    """FL01: rows with a finish, without steeplechases."""
    surface = F.coalesce(F.col("surface"), F.lit(fixed.SURFACE_MISSING))
    return entries.filter((surface != excluded_surface) & F.col("finish").isNotNull())


def counters(entries: DataFrame) -> DataFrame:
    """AG04 input: career and style totals per entry."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return entries.withColumns({"career_total": total(F.get("career", F.lit(0))), "style_total": total(F.col("style4"))})


def encoded(entries: DataFrame, race_hot: Hot, snapshot: str, cfg: TrainConfig, bands: dict | None) -> DataFrame:
    """ML08 with AG03: features and out-of-fold statistics of jockeys and trainers."""
    made = features.feature_matrix(entries, race_hot, snapshot, bands, cfg.use_pace, cfg.drop_career)
    made = made.withColumn("fold", fit.race_fold(F.col("race_id"), fixed.FOLDS))
    train = F.col("year") < cfg.split_year
    for role in ("jockey", "trainer"):
        made = cut(encode.out_of_fold(made, [role], find_hot(made, role), role, "fold", train))
    for condition in ROLE_CONDITIONS:
        keys = ["jockey", condition]
        known = made.withColumn(condition, F.coalesce(F.col(condition).cast("string"), F.lit("nan")))
        found = encode.out_of_fold(
            known, keys, find_hot(known, *keys), f"jockey_{condition}", "fold", train, least=fixed.MIN_PAIR_RUNS)
        made = cut(found)
    return made


@dataclass(frozen=True)
class Prepared:
    """The matrix of a training: entries, labelled features with their side in ``part``, and what applying them again needs."""

    rows: DataFrame
    parts: DataFrame
    race_hot: Hot
    columns: list[str]
    snapshot: str
    bands: dict
    maps: DataFrame


def prepare(spark: SparkSession, cards: str, cfg: TrainConfig) -> Prepared:
    bronze = read_entries(spark, cards)
    bands = career_bands(bronze.columns)
    entries, _ = normalize_entries(bronze)
    rows = cut(training_rows(counters(entries)))
    snapshot = encode.snapshot_mode(rows)
    race_hot = find_hot(rows, "race_id")
    made = fit.label_rows(encoded(rows, race_hot, snapshot, cfg, bands), race_hot)
    maps = cut(encode.category_maps(made, CATEGORIES))
    made = cut(encode.apply_categories(made, maps, CATEGORIES))
    parts = fit.year_split(made.withColumn("yr", F.col("year")), cfg.split_year)
    return Prepared(rows, parts, race_hot, fit.numeric_features(made, NOT_FEATURES), snapshot, bands, maps)


def parameters(spark: SparkSession, cfg: TrainConfig) -> dict:
    """The tuned parameters under the given ones."""
    if cfg.tuned is None:
        return cfg.params
    return {**json.loads(spark.read.schema("params string").json(cfg.tuned).first()["params"]), **cfg.params}


def tune_job(spark: SparkSession, cards: str, out: str, trials: int = 16, cfg: TrainConfig | None = None) -> dict:
    """ML07: search by halving over all card files; the winner is written for the next training, unless the default parameters were no worse where both were tried."""
    cfg = cfg or TrainConfig()
    made = prepare(spark, cards, cfg)
    candidates = [{**c, **cfg.params} for c in fit.sample_space(trials)]
    found = boost.halving(made.parts, made.columns, candidates)
    best = boost.winner(found)
    rates = {(r["rung"], r["candidate"]): r["rate"] for r in found}
    last = max(rung for rung, c in rates if c == 0)  # how far the defaults came
    better = best != 0 and rates[last, best] > rates[last, 0]
    if better:
        spark.createDataFrame([(json.dumps(candidates[best]),)], "params string").coalesce(1).write.mode("overwrite").json(out)
    return {"rungs": found, "winner": best, "written": better, "params": candidates[best] if better else None}


def gains(model, columns: list[str], n: int = 15) -> dict:
    """AG24: the ``n`` features with the largest part of the gain, and the part of the category columns."""
    table = fit.importances(model, columns)
    share = fit.gain_share(table, [f"{c}_code" for c in CATEGORIES]).first().asDict()
    return {"top": [r.asDict() for r in table.limit(n).collect()], "categories": share}


def train_job(spark: SparkSession, cards: str, bundle: str, cfg: TrainConfig | None = None) -> dict:
    """Train on all card files below ``cards`` and write the bundle; returns what was measured."""
    cfg = cfg or TrainConfig()
    params = parameters(spark, cfg)
    made = prepare(spark, cards, cfg)
    parts, columns, race_hot = made.parts, made.columns, made.race_hot
    train, valid = (parts.filter(F.col("part") == side) for side in ("train", "valid"))
    on_valid = F.col("part") == "valid"
    stopped = {
        "score": boost.fit_stopping(parts, on_valid, columns, params, tolerance=cfg.tolerance),
        "win": boost.fit_stopping(parts, on_valid, columns, params, 1, cfg.tolerance)}
    rounds = {name: boost.final_rounds([s]) for name, s in stopped.items()}
    scored = fit.score(fit.fit_other(train, columns, cfg.other_params), valid, columns).withColumnRenamed("score", "other")
    scored = fit.top_chance(stopped["win"].model, scored, columns, "win")
    scored = cut(fit.score(stopped["score"].model, scored, columns).select("race_id", "num", "finish", "score", "other", "win"))
    chosen, weight, measured = choose_blend(scored, race_hot)
    mixed = cut(with_blend(scored, race_hot, chosen, weight))
    temperature, loss = evaluate.best_temperature(evaluate.temperature_losses(mixed, race_hot))
    meta = {
        "temperature": temperature, "features": columns, "snapshot": made.snapshot, "use_pace": cfg.use_pace, "rounds": rounds["score"],
        "drop_career": cfg.drop_career or made.snapshot == "leak", "bands": {k: list(b) for k, b in made.bands.items()},
        **({f"{chosen}_weight": weight} if chosen else {}),
    }
    tables = {"categories": made.maps, "pairs": encode.pair_totals(made.rows, "jockey", ROLE_CONDITIONS)}
    tables |= {role: encode.role_totals(made.rows, role) for role in ("jockey", "trainer")}
    # the last fits have all rows, and as many rounds as the validation side asked for
    second = {
        "other": lambda: fit.fit_other(parts, columns, cfg.other_params),
        "win": lambda: fit.fit_top(parts, columns, 1, {**params, "maxIter": rounds["win"]})}
    final = fit.fit_scorer(parts, columns, {**params, "maxIter": rounds["score"]})
    fit.save_bundle(bundle, meta, final, tables, {chosen: second[chosen]()} if chosen else {})
    return {
        **measured, "blend": chosen, "weight": weight, "temperature": temperature, "loss": loss, "snapshot": made.snapshot, "features": len(columns),
        "stopped": {name: s.rounds for name, s in stopped.items()}, "rounds": rounds, "gains": gains(final, columns), **report(mixed, race_hot, temperature)}
