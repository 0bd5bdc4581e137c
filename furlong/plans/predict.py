"""Prediction job: cards and a bundle to chances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import chances, encode, evaluate, features, fit
from furlong.operators.groups import by_group, find_hot
from furlong.operators.normalize import normalize_entries
from furlong.plans.train import CATEGORIES, ROLE_CONDITIONS, with_blend
from furlong.session import cut
from furlong.sources.files import read_entries
from furlong.sources.sinks import write_predictions


def identified(bronze: DataFrame) -> DataFrame:
    """FL09: every contest in exactly one file and every file with one contest, or the job stops."""
    entries, rejects = normalize_entries(bronze, file="file")
    if not rejects.isEmpty():
        first = rejects.select("file", "reason").first()
        raise ValueError(f"{first['file']}: {first['reason']}")
    mixed = entries.groupBy("file").agg((F.min("race_id") != F.max("race_id")).alias("bad")).filter("bad")
    if not mixed.isEmpty():
        raise ValueError(f"more than one contest in {mixed.first()['file']}")
    if not evaluate.ambiguous_races(entries).isEmpty():
        raise ValueError("a contest is in more than one file")
    return entries.drop("file")


def predicted(spark: SparkSession, entries: DataFrame, bundle: str) -> DataFrame:
    """Features, lookups, score, chances and ranks for typed entries."""
    meta, model, tables, extra = fit.load_bundle(spark, bundle)
    entries = cut(entries)
    race_hot = find_hot(entries, "race_id")
    bands = {k: tuple(b) for k, b in meta["bands"].items()}
    rows = features.feature_matrix(entries, race_hot, meta["snapshot"], bands, meta["use_pace"], meta["drop_career"])
    for role in ("jockey", "trainer"):
        rows = encode.attach_role(rows, tables[role], role, find_hot(entries, role), role)
    rows = encode.attach_pairs(rows, tables["pairs"], "jockey", ROLE_CONDITIONS, find_hot(entries, "jockey"))
    rows = encode.apply_categories(rows, tables["categories"], CATEGORIES, {c: find_hot(
        entries.select(F.col(c).cast("string").alias("_value")), "_value") for c in CATEGORIES})
    missing = [c for c in meta["features"] if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else rows
    chosen = next(iter(extra), "")
    if chosen == "other":
        rows = fit.score(extra["other"], rows, meta["features"]).withColumnRenamed("score", "other")
    elif chosen == "win":
        rows = fit.top_chance(extra["win"], rows, meta["features"], "win")
    needed = ["race_id", "num", "frame", "name", "jockey", "score", *extra]
    scored = cut(fit.score(model, rows, meta["features"]).select(*needed))
    scored = cut(with_blend(scored, race_hot, chosen, meta.get(f"{chosen}_weight", 0.0)).drop(*extra)) if chosen else scored

    def finish(df, g):
        df = chances.top_three(df, g, "score", meta["temperature"])
        for k in (1, 2, 3):
            df = g.rank(df, f"rk{k}", f"p{k}")
        return df

    return by_group(scored, race_hot, finish)


def predict_job(spark: SparkSession, cards: str, bundle: str, out: str, race_id: str | None = None) -> DataFrame:
    """Predict all contests below ``cards``, or one, and write the predictions."""
    entries = identified(read_entries(spark, cards))
    if race_id is not None:
        entries = entries.filter(F.col("race_id") == race_id)
        if entries.isEmpty():
            raise ValueError(f"no contest {race_id}")
    result = cut(predicted(spark, entries, bundle))
    write_predictions(result, out)
    return result


