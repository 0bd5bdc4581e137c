"""The plan for large groups gives the rows of the plan for ordinary ones."""

import math

import pytest
from pyspark.sql import functions as F

from furlong.operators import chances, relative, settle, tickets
from furlong.operators.groups import FIELD, Hot, by_group, find_hot, lookup


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one contest, repeated values, NULLs."""
    n = 300
    rows = [(1, i + 1, round(math.sin(i * 1.7) * 3, 1), None if i % 17 == 0 else float(i % 11), i % 40 + 1) for i in range(n)]
    for race in range(2, 102):
        size = race % 9 + 1
        rows += [(race, k + 1, round(math.cos(race * k) * 2, 1), None if (race + k) % 7 == 0 else float(k % 3), k + 1) for k in range(size)]
    return spark.createDataFrame(rows, "race_id long, num int, score double, x double, finish int").withColumns(
        {"frame": F.floor((F.col("num") + 1) / 2).cast("int"), "horse": F.col("num") % 5})


def both(df, pipeline, columns):
    hot = find_hot(df, "race_id", rows=50)
    assert hot.table is not None
    plain = by_group(df, Hot(("race_id",)), pipeline).select(*columns)
    split = by_group(df, hot, pipeline).select(*columns)
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r[:2])
    a, b = sorted(plain.collect(), key=key), sorted(split.collect(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or p == pytest.approx(q, rel=1e-9, abs=1e-12), (x, y)


@pytest.mark.parametrize("name", ["softmax", "ranks", "gaps", "past", "fill", "first", "running", "zscore", "top_three", "strengths", "pace"])
def test_plans_agree(skewed, name):
    ordered = (F.col("finish"), F.col("num"))
    pipelines = {
        "softmax": (lambda df, g: chances.softmax(df, g), ["p1"]),
        "ranks": (lambda df, g: relative.average_rank(relative.min_rank(df, g, "x", "low"), g, "x", "mid"), ["low", "mid"]),
        "gaps": (lambda df, g: relative.gaps(df, g, {"x": 1, "score": -1}), ["x_top_gap", "x_second_gap", "score_top_gap", "score_second_gap"]),
        "past": (lambda df, g: g.past(df, "past", ["x", "finish"], 3, F.col("num")), ["past"]),
        "fill": (lambda df, g: relative.fill_down(df, g, "x", "filled", "num"), ["filled"]),
        "first": (lambda df, g: g.first(df, 3, *ordered), ["finish"]),
        "running": (lambda df, g: g.running(df, "total", F.col("x"), "sum", F.col("num")), ["total"]),
        "zscore": (lambda df, g: relative.zscore(df, g, "score", "z"), ["z"]),
        "top_three": (lambda df, g: chances.top_three(df, g), ["p1", "p2", "p3"]),
        "strengths": (lambda df, g: chances.strengths(df.withColumn("p1", F.exp("score")), g), ["p", "rest", "rest_two", "place", "among", "beside"]),
        "pace": (lambda df, g: relative.pace(df.withColumns({"main_style": F.col("num") % 5, "front_rate": F.col("x")}), g), ["pace_index", "rivals_ahead", "front_rate_dev"]),
    }
    pipeline, columns = pipelines[name]
    both(skewed, pipeline, ["race_id", "num", *columns])


def test_counted_ranks(spark, skewed):
    """Ranks counted in the fields of at most 64, sorted in the field of 300, or ranked by range partitions: all equal a plain count."""
    odd = spark.createDataFrame(
        [(200, i + 1, v, v) for i, v in enumerate([0.0, -0.0, math.nan, math.nan, math.inf, None, -1.0])] + [(201, 1, None, None), (None, 1, 2.0, 3.0), (None, 1, 2.0, 4.0)],
        "race_id long, num int, score double, x double")
    df = skewed.select("race_id", "num", "score", "x").unionByName(odd)
    wide, hot = find_hot(df, "race_id", rows=FIELD), find_hot(df, "race_id", rows=50)
    pipeline = lambda d, g: g.average_ranks(d, {"score": "by_score", "x": "by_x"})
    columns = ["race_id", "num", "score", "x", "by_score", "by_x"]
    results = [sorted(map(repr, by_group(df, h, pipeline, w).select(columns).collect()))
               for h, w in ((Hot(("race_id",)), None), (Hot(("race_id",)), wide), (hot, wide), (hot, Hot(("race_id",))))]
    assert len(results[0]) == df.count() and all(r == results[0] for r in results[1:])
    field = {r["num"]: r["by_score"] for r in by_group(odd.filter("race_id = 200"), Hot(("race_id",)), pipeline, Hot(("race_id",))).collect()}
    assert field == {1: 4.5, 2: 4.5, 3: 1.5, 4: 1.5, 5: 3.0, 6: None, 7: 6.0}
    plan = by_group(df, Hot(("race_id",)), pipeline, Hot(("race_id",)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_results_of_large_contests(spark):
    """First three, placed and counted entrants: dead heats, a repeated row, finishes that start at four, nobody ranked."""
    rows = [(1, i, i % 8 + 1, i if i > 2 else 1) for i in range(1, 21)] + [(2, i, 1, i + 3) for i in range(1, 12)] + [(2, 1, 1, 4)]
    rows += [(3, i, 1, None) for i in range(1, 12)] + [(4, 1, 1, 2), (4, 2, 1, None)]
    df = spark.createDataFrame(rows, "race_id long, num int, frame int, finish int")
    shown = lambda hot: {r["race_id"]: (r["starters"], r["ranked"], r["top"], r["top_frames"], [tuple(x) for x in r["_placed"]]) for r in settle.race_results(df, hot).collect()}
    want = {1: (20, 20, [1, 2, 3], [2, 3, 4], [(1, 1), (2, 1), (3, 3)]), 2: (12, 12, [1, 1, 2], [1, 1, 1], []), 4: (2, 1, [1], [1], [(1, 2)])}
    assert shown(Hot(("race_id",))) == want
    assert shown(find_hot(df, "race_id", rows=7)) == want


def test_wide_field_of_small_shares(spark):
    """Fields beyond the heavy limit use power sums; compared with direct double sums."""
    import numpy as np

    n = 150
    rng = np.random.default_rng(5)
    s = np.concatenate([[4.0, 3.0], rng.normal(0, 1, n - 2)])
    df = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate(s)], "race_id long, num int, score double")
    got = {r["num"]: r for r in chances.chances(df, Hot(("race_id",))).collect()}
    p = np.exp(s) / np.exp(s).sum()
    for i in (0, 1, 2, 77, 149):
        p2 = p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(n) if j != i)
        third = sum(
            p[j] * p[k] / (1 - p[j]) * p[i] / (1 - p[j] - p[k]) for j in range(n) for k in range(n) if len({i, j, k}) == 3)
        assert got[i + 1]["p2"] == pytest.approx(p2, rel=1e-11)
        assert got[i + 1]["p3"] == pytest.approx(p2 + third, rel=1e-11)
    assert sum(r["p3"] for r in got.values()) == pytest.approx(3)
    entrants = tickets.entrant_table(df.withColumns({"p1": F.lit(0.0), "p2": F.lit(1.0), "p3": F.lit(1.0), "frame": F.lit(1)}).drop("p1").join(
        spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(p)], "num int, p1 double"), "num"), Hot(("race_id",)))
    pairs = spark.createDataFrame([(1, "wide", list(x), 1.0) for x in ((1, 2), (1, 5), (2, 9), (30, 31))], "race_id long, kind string, legs array<int>, odds_lo double")
    for r in tickets.join_legs(pairs, entrants, 2).select("legs", chances.wide(F.col("a"), F.col("b")).alias("c")).collect():
        a, b = (x - 1 for x in r["legs"])
        order = lambda x, y, z: p[x] * p[y] / (1 - p[x]) * p[z] / (1 - p[x] - p[y])
        want = sum(order(*o) for x in range(n) if x not in (a, b) for o in ((a, b, x), (b, a, x), (a, x, b), (b, x, a), (x, a, b), (x, b, a)))
        assert r["c"] == pytest.approx(want, rel=1e-11)


def test_lookup_keeps_all_rows(spark, skewed):
    table = skewed.groupBy("race_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("race_id") % 3 != 0)
    hot = find_hot(skewed, "race_id", rows=50)
    rows = skewed.unionByName(skewed.limit(5).withColumn("race_id", F.lit(None).cast("long")))
    a = lookup(rows, table, ["race_id"], hot)
    b = rows.join(table, "race_id", "left")
    assert a.exceptAll(b.select(a.columns)).isEmpty() and a.count() == b.count()


def test_large_null_group_is_not_shuffled_together(spark):
    df = spark.createDataFrame([(None, i) for i in range(60)] + [(1, 1)], "k long, v int")
    hot = find_hot(df, "k", rows=50)
    table = spark.createDataFrame([(1, "one")], "k long, name string")
    out = lookup(df, table, ["k"], hot)
    assert out.count() == 61 and out.filter("name is not null").count() == 1


def test_results_do_not_depend_on_the_limit(spark, sf, low_limit):
    """Whole queries with nearly every contest treated as large."""
    from furlong.catalog import load, views

    names = ["wn03_rank_average", "pl12_hits", "ag03_out_of_fold", "jn18_rank_pairs", "fl12_confidence", "ag21_temperature_losses"]
    queries = load()[0]
    large = {n: sorted(map(repr, queries[n](spark, sf).collect())) for n in names}
    spark.conf.unset("spark.furlong.hotRows")
    views._profiles.clear()
    for n in names:
        assert large[n] == sorted(map(repr, queries[n](spark, sf).collect())), n


def test_groups_do_not_leak(spark, skewed):
    """A contest alone gives what it gives among all others."""
    one = skewed.filter("race_id = 8")
    pipeline = lambda df, g: relative.zscore(relative.gaps(df, g, {"x": 1}), g, "score", "z")
    alone = by_group(one, Hot(("race_id",)), pipeline)
    among = by_group(skewed, Hot(("race_id",)), pipeline).filter("race_id = 8")
    assert sorted(map(repr, alone.collect())) == sorted(map(repr, among.collect()))


def test_every_large_group_is_found(spark, skewed):
    sizes = {r["race_id"]: r["count"] for r in skewed.groupBy("race_id").count().collect()}
    hot = find_hot(skewed, "race_id", rows=1)
    assert {r["race_id"] for r in hot.table.collect()} == {k for k, n in sizes.items() if n > 1}
    assert hot.rows(skewed).count() + hot.cold(skewed).count() == skewed.count()
