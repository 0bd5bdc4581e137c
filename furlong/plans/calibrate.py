"""Calibration job: stored chances and results to the losses before and after an isotonic fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.operators import evaluate, fit
from furlong.operators.groups import by_group, find_hot, lookup
from furlong.session import cut


@dataclass(frozen=True)
class Calibrated:
    """``losses``: per number of places the measures of the stored and of the calibrated chances; ``sides``: contests and rows of both sides."""

    chances: DataFrame
    losses: DataFrame
    sides: DataFrame


def calibrate_job(rows: DataFrame, seed: int = 42, keys: list[str] | None = None) -> Calibrated:
    """FL08, ML05 and ML06 as one plan over (race_id, num, finish, p1, p2, p3).

    Contests with faults are left out; the first chances of the others are made to sum to one.  Two thirds of the contests fit the steps, the
    others are judged.  Raises ValueError where fewer than two contests are sound.
    """
    hot = find_hot(rows, "race_id")
    sound = evaluate.valid_race(rows).withColumn("_sound", F.lit(True))
    known = lookup(rows, sound, ["race_id"], hot, "inner").drop("_sound")
    whole = cut(by_group(known, hot, lambda df, g: g.add(df, _sum=F.sum("p1")).withColumn("p1", F.col("p1") / F.col("_sum")).drop("_sum")))
    parts = cut(fit.digest_split(whole, hot, seed, keys))
    steps = fit.fit_isotonic(parts.filter("part = 'fit'"))
    held = cut(fit.calibrated(steps, parts.filter("part = 'held'").drop("part"), hot))
    measures = ("logloss", "brier")
    table = evaluate.losses(held, {f"{name}{k}": (f"{column}{k}", F.col("finish") <= k) for name, column in (("s", "stored"), ("c", "p")) for k in (1, 2, 3)})
    losses = table.select("n", F.inline(F.array(*[F.struct(
        F.lit(k).alias("k"), *[F.col(f"{side}{k}_{m}").alias(f"{name}_{m}") for side, name in (("s", "stored"), ("c", "calibrated")) for m in measures]) for k in (1, 2, 3)])))
    sides = parts.groupBy("part", "race_id").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.count(F.lit(1)).alias("races"), F.sum("n").alias("rows"))
    return Calibrated(held, losses, sides)
