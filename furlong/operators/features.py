"""ML08: the feature matrix of a card table.

Stage one is one projection (own values, last five runs), stage two the group-relative columns,
which all share the partitioning by contest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.functions.columns import (
    count_of, drop_matching, match_flag, max_of, mean_of, min_of, safe_ratio, spread_of,
)
from furlong.operators import relative
from furlong.operators.groups import FIELD, Groups, Hot, by_group, find_hot

RUNS = 5
RUN_NUMBERS = [
    "speed", "front_index", "pace_index", "closing_index", "margin", "finish", "popularity", "heads", "num",
    "distance", "carried", "weight_delta", "last3f_rank", "last3f", "body_weight", "going", "style", "days",
]
SUMMARISED = ["speed", "front_index", "pace_index", "closing_index", "finish", "popularity", "margin", "last3f", "class_level"]
RECENT = ["speed", "finish", "last3f", "margin"]
RANKED = [
    "speed_latest", "speed_mean", "speed_max", "finish_mean3", "past1_popularity", "career0_win_rate",
    "career0_top3_rate", "carried", "age", "same_surface_speed", "same_distance_speed", "style_position",
]
GAPPED = {
    "speed_max": 1, "speed_latest": 1, "speed_mean": 1, "same_distance_speed": 1, "same_surface_speed": 1,
    "career0_win_rate": 1, "career0_top3_rate": 1, "finish_mean3": -1, "past1_popularity": -1,
}
CAREER_FEATURES = (
    r"^career|^style_|^class_change|^other_(leader|follower|stalker|closer)s$|^front_share$|^pace_index$|"
    r"^pace_gain$|^lone_leader$|^rivals_ahead$|^front_rate_dev$|^jockey_main_style_|^front_rate$"
)
PACE_FEATURES = (
    r"^(other_stalkers|other_closers|front_share|pace_index|pace_gain|lone_leader|rivals_ahead|front_rate_dev)$"
)
NEAR = 200


def subtract_current(df: DataFrame, bands: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """PJ05: take the race itself out of counters that were read after it; never below zero.

    ``style4`` loses one run of the style shown, ``career`` one result in every band that holds the distance.
    """
    bands = {**fixed.CAREER_BANDS, **(bands or {})}
    ran = F.col("finish").isNotNull()
    style = F.array(*[
        F.when(ran & (F.col("style_now") == k + 1), F.greatest(F.get("style4", F.lit(k)) - 1, F.lit(0)))
        .otherwise(F.get("style4", F.lit(k))) for k in range(4)
    ])
    careers = []
    for i, name in enumerate(fixed.CAREER_COLUMNS):
        counters = F.get("career", F.lit(i))
        applies = ran
        if name in bands:
            applies = ran & F.coalesce(F.col("distance").between(*bands[name]), F.lit(False))
        placed = [F.col("finish") == k for k in (1, 2, 3)] + [F.col("finish") >= 4]
        careers.append(F.array(*[
            F.when(applies & hit, F.greatest(F.get(counters, F.lit(k)) - 1, F.lit(0))).otherwise(F.get(counters, F.lit(k)))
            for k, hit in enumerate(placed)
        ]))
    return df.withColumns({"style4": style, "career": F.array(*careers)})


def style_features(df: DataFrame) -> DataFrame:
    counts = [F.get("style4", F.lit(k)).cast("double") for k in range(4)]
    total = sum(counts, F.lit(0.0))
    strongest = F.array_position("style4", F.array_max("style4")).cast("int")
    names = ("leader", "follower", "stalker", "closer")
    return df.withColumns({f"style_{n}": c for n, c in zip(names, counts)} | {
        "front_rate": safe_ratio(counts[0] + counts[1], total),
        "style_position": safe_ratio(sum((c * (k + 1) for k, c in enumerate(counts)), F.lit(0.0)), total),
        "main_style": F.when(total > 0, strongest),
    })


def career_features(df: DataFrame) -> DataFrame:
    made = {}
    for i in range(len(fixed.CAREER_COLUMNS)):
        c = [F.get(F.get("career", F.lit(i)), F.lit(k)).cast("double") for k in range(4)]
        runs = c[0] + c[1] + c[2] + c[3]
        made |= {f"career{i}_{n}": v for n, v in zip(("wins", "seconds", "thirds", "unplaced"), c)}
        made |= {
            f"career{i}_runs": runs, f"career{i}_win_rate": safe_ratio(c[0], runs),
            f"career{i}_top3_rate": safe_ratio(c[0] + c[1] + c[2], runs),
        }
    return df.withColumns(made)


def _run(i: int, name: str, past: str = "past") -> Column:
    return F.get(F.col(past), F.lit(i))[name]


def _values(name: str, runs: int = RUNS) -> list[Column]:
    return [F.col(f"past{i + 1}_{name}") for i in range(runs)]


def run_features(df: DataFrame) -> DataFrame:
    """The last five runs, one set of columns per run."""
    made = {}
    here = F.coalesce(F.col("surface"), F.lit(fixed.SURFACE_MISSING))
    open_class = float(fixed.CLASS_NAMES.index(fixed.CLASS_OTHER))
    for i in range(RUNS):
        at = f"past{i + 1}_"
        made |= {at + name: _run(i, name).cast("double") for name in RUN_NUMBERS}
        passing = _run(i, "passing")
        last = F.get(passing, F.lit(3)).cast("double")
        made |= {
            at + "distance_gap": F.col("distance") - _run(i, "distance"),
            at + "passing1": F.get(passing, F.lit(0)).cast("double"),
            at + "passing4": last,
            at + "passing4_rate": safe_ratio(last, _run(i, "heads")),
            at + "class_level": F.coalesce(_run(i, "class_level"), F.lit(open_class)),
            at + "same_surface": match_flag(F.coalesce(_run(i, "surface"), F.lit(fixed.SURFACE_MISSING)), here),
            at + "same_venue": match_flag(_run(i, "venue"), F.col("venue")),
        }
    return df.withColumns(made)


def run_summaries(df: DataFrame) -> DataFrame:
    """AG07: mean, max, min, latest, count over five runs; mean of three; spread; like-for-like means."""
    made = {}
    for name in SUMMARISED:
        values = _values(name)
        made |= {
            f"{name}_mean": mean_of(values), f"{name}_max": max_of(values), f"{name}_min": min_of(values),
            f"{name}_latest": values[0], f"{name}_runs": count_of(values),
        }
    made |= {f"{name}_mean3": mean_of(_values(name, 3)) for name in RECENT}
    speed = _values("speed")
    made |= {
        "finish_spread": spread_of(_values("finish")),
        "same_surface_speed": mean_of([F.when(same == 1, v) for same, v in zip(_values("same_surface"), speed)]),
        "same_distance_speed": mean_of([F.when(F.abs(gap) <= NEAR, v) for gap, v in zip(_values("distance_gap"), speed)]),
        "days_latest": F.col("past1_days"), "days_mean": mean_of(_values("days")),
        "speed_trend": F.col("past1_speed") - F.col("past2_speed"),
        "finish_trend": F.col("past1_finish") - F.col("past2_finish"),
    }
    return rest_flags(df.withColumns(made), "days_latest")


def rest_flags(df: DataFrame, days: str) -> DataFrame:
    """PJ07: back within two weeks, away for more than sixty days; NULL stays NULL."""
    return df.withColumns({
        "quick_return": (F.col(days) <= 14).cast("double"), "long_rest": (F.col(days) > 60).cast("double")})


def relative_features(df: DataFrame, g: Groups) -> DataFrame:
    """Group stage: class change, ranks, deviations, gaps, pace."""
    df = relative.group_size(df, g)
    df = relative.class_of_race(df, g, "career0_wins", "_class")
    df = df.withColumn("class_change", F.col("_class") - F.col("past1_class_level")).drop("_class")
    df = relative.deviations(df, g, RANKED)
    df = relative.gaps(df, g, GAPPED)
    df = relative.pace(df, g)
    return g.average_ranks(df, {value: f"{value}_rank" for value in RANKED})


def feature_matrix(
    entries: DataFrame, hot: Hot, snapshot: str = "post", bands: dict | None = None,
    use_pace: bool = False, drop_career: bool = False,
) -> DataFrame:
    """Entries plus all features; results of the race itself are used only to correct counters."""
    if snapshot == "post" and "finish" in entries.columns:
        entries = subtract_current(entries, bands)
    rows = run_summaries(run_features(career_features(style_features(entries))))
    made = by_group(rows, hot, relative_features, find_hot(entries, *hot.keys, rows=FIELD)).drop("past", "style4", "career")
    if drop_career or snapshot == "leak":
        made = drop_matching(made, CAREER_FEATURES)
    return made if use_pace else drop_matching(made, PACE_FEATURES)
