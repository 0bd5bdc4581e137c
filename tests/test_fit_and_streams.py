"""Calibration, splits, bundles, and streams that are stopped and started again."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from furlong.operators import evaluate, features, fit
from furlong.operators.groups import Hot
from furlong.streaming import streams as st

HOT = Hot(("race_id",))


def pooled(points):
    """Pool adjacent violators on (x, y) sorted by x."""
    blocks = []
    for x, y in sorted(points):
        blocks.append([y, 1, [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, n2, x2 = blocks.pop()
            blocks[-1][0] += y2
            blocks[-1][1] += n2
            blocks[-1][2] += x2
    return {x: y / n for y, n, xs in blocks for x in xs}


def test_isotonic_against_pooling(spark):
    points = [(i / 50 + 0.001, float((i * 7919) % 10 < i / 6)) for i in range(50)]
    df = spark.createDataFrame([(1, x, 1 if y else 2) for x, y in points], "race_id long, p1 double, finish int")
    model = fit.fit_isotonic(df)
    got = {r["p1"]: r["out"] for r in model.setFeaturesCol("p1").setPredictionCol("out").transform(df).collect()}
    want = pooled(points)
    assert all(got[x] == pytest.approx(want[x]) for x, _ in points)


def test_digest_split(spark):
    df = spark.createDataFrame([(r, n) for r in range(1, 32) for n in (1, 2)], "race_id long, num int")
    got = {r["race_id"]: r["part"] for r in fit.digest_split(df, HOT).collect()}
    ordered = sorted(range(1, 32), key=lambda r: (hashlib.sha256(f"42:{r}".encode()).digest(), r))
    assert {r for r, p in got.items() if p == "fit"} == set(ordered[: 31 * 2 // 3])
    with pytest.raises(ValueError):
        fit.digest_split(df.filter("race_id = 1"), HOT)


def test_year_split_fallback(spark):
    df = spark.createDataFrame([(r, 1, 2020) for r in range(40)], "race_id long, num int, yr int")
    parts = {r["part"] for r in fit.year_split(df, 2025).collect()}
    assert parts == {"train", "valid"}


def test_pairwise_and_trees_learn(spark):
    rows = [(r, n, float(n + (r * n) % 3), n) for r in range(120) for n in range(1, 7)]
    df = spark.createDataFrame(rows, "race_id long, num int, x double, finish int")
    weights = fit.fit_pairwise(df, HOT, ["x"])
    assert weights[0] < 0
    assert evaluate.ranking(fit.pairwise_score(df, ["x"], weights), {"s": F.col("score")}).first()["hit1"] > 0.6
    labelled = fit.label_rows(df, HOT)
    model = fit.fit_scorer(labelled, ["x"], {"maxIter": 3, "minInstancesPerNode": 1})
    assert evaluate.ranking(fit.score(model, labelled, ["x"]), {"s": F.col("score")}).first()["hit1"] > 0.5
    assert fit.better_than_default([({"a": 1}, 0.5), ({"a": 2}, 0.5)]) is None
    assert fit.better_than_default([({"a": 1}, 0.5), ({"a": 2}, 0.6)]) == {"a": 2}


def test_bundle_checks():
    good = {"version": fit.BUNDLE_VERSION, "temperature": 1.0}
    fit.check_bundle(good)
    fit.check_bundle({**good, "has_win": True, "win_weight": 0.3})
    for bad in ({"version": 7}, {"temperature": 0.0}, {"temperature": float("nan")}, {"temperature": None}, {"has_other": True}, {"other_weight": 0.3},
                {"has_win": True, "win_weight": 1.2}, {"has_win": True, "win_weight": 0.2, "has_other": True, "other_weight": 0.2}):
        with pytest.raises(ValueError):
            fit.check_bundle({**good, **bad})


def test_blend_per_contest_and_weights(spark):
    rows = [(g, i, s, o, f) for g, i, s, o, f in [(1, 1, 1.0, 0.9, 1), (1, 2, 3.0, 0.1, 2), (2, 1, 5.0, 0.5, 2), (2, 2, 4.0, 0.6, 1), (3, 1, 0.0, 0.2, 1), (3, 2, 1.0, 0.3, 2)]]
    df = spark.createDataFrame(rows, "race_id long, num int, s double, o double, finish int")
    whole = {(r["race_id"], r["num"]): r["mixed"] for r in evaluate.blend(df, HOT, "s", "o", 0.4, True).collect()}
    for g in (1, 2, 3):
        for r in evaluate.blend(df.filter(F.col("race_id") == g), HOT, "s", "o", 0.4, True).collect():
            assert whole[g, r["num"]] == pytest.approx(r["mixed"])
    assert [r["mixed"] for r in evaluate.blend(df, HOT, "s", "o", 0.0).orderBy("race_id", "num").collect()] == [r[2] for r in rows]
    with pytest.raises(ValueError):
        evaluate.blend(df, HOT, "s", "o", 1.5)
    for bad in (float("nan"), float("inf"), -0.1, 1.1):
        odd = df.withColumn("o", F.when(F.col("num") == 1, bad).otherwise(F.col("o")))
        with pytest.raises(Exception, match="0..1|finite"):
            evaluate.blend(odd, HOT, "s", "o", 0.4, True).collect()
    table = evaluate.blend_search(df, HOT, "s", "o", [0.5, 0.9], True)
    assert evaluate.select_blend(table).count() == 1


def test_result_columns_do_not_reach_features(spark):
    """Changing the finish of the race itself changes no feature once counters are from before the race."""
    run = "struct<speed:double,front_index:double,pace_index:double,closing_index:double,margin:double,finish:double,popularity:double,heads:double,num:double,distance:double,carried:double,weight_delta:double,last3f_rank:double,last3f:double,body_weight:double,going:double,style:double,days:double,passing:array<int>,class_level:double,surface:string,venue:double>"
    df = spark.createDataFrame([(1, n, n, float(50 + n), 3.0, n) for n in range(1, 5)], "race_id long, num int, frame int, carried double, age double, finish int").withColumns({
        "distance": F.lit(1600.0), "venue": F.lit(5.0), "surface": F.lit("芝"), "style4": F.array(*[F.lit(k) for k in (1, 0, 2, 0)]), "style_now": F.lit(1.0),
        "career": F.array(*[F.array(*[F.lit(k) for k in (1, 0, 0, 3)])] * 4), "past": F.array(F.lit(None).cast(run))})
    a = features.feature_matrix(df, HOT, "pre").drop("finish")
    b = features.feature_matrix(df.withColumn("finish", 5 - F.col("finish")), HOT, "pre").drop("finish")
    assert a.exceptAll(b).isEmpty() and len(a.columns) > 200
    post = features.feature_matrix(df, HOT, "post").orderBy("num").collect()
    assert [r["career0_wins"] for r in post] == [0.0, 1.0, 1.0, 1.0] and [r["career0_unplaced"] for r in post] == [3.0, 3.0, 3.0, 2.0]
    assert [r["career2_wins"] for r in post] == [0.0, 1.0, 1.0, 1.0] and [r["career1_wins"] for r in post] == [1.0] * 4
    dropped = features.feature_matrix(df, HOT, "pre", drop_career=True).columns
    assert not [c for c in dropped if c.startswith(("career", "style_"))]


def test_due_window_edges(spark):
    start = dt.datetime(2026, 9, 6, 15, 40)
    races = spark.createDataFrame([("r", start)], "race_id string, start timestamp")
    ticks = [start + dt.timedelta(seconds=s) for s in (-181, -180, -60, -1, 0, 30)]
    clock = spark.createDataFrame([(t,) for t in ticks], "now timestamp")
    assert sorted(r["now"] for r in st.due_races(races, clock).collect()) == ticks[1:4]


def test_tickets_once_survives_a_restart(spark, tmp_path):
    schema = "race_id long, v int, ts timestamp"
    day = dt.datetime(2026, 9, 6)
    for part in ([(1, 1, day), (1, 2, day), (2, 1, day)], [(2, 9, day), (3, 1, day)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = st.tickets_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        st.drain(stream, str(tmp_path))
    got = st.results(spark, str(tmp_path), stream.schema).groupBy("race_id").count().collect()
    assert {r["race_id"]: r["count"] for r in got} == {1: 1, 2: 1, 3: 1}


def test_snapshot_keeps_the_newest_quotes(spark, tmp_path):
    """Old quotes that come late change nothing, other days stay as files, and a repeated batch leaves the same rows."""
    day, minute = dt.datetime(2026, 9, 6, 9), dt.timedelta(minutes=1)
    one = [(1, [1], 2.0, 2.5, day, day.date(), "win"), (1, [1], 3.0, 3.5, day + minute, day.date(), "win"), (1, [1], 1.0, 1.5, day, day.date(), "place"), (2, [4], 9.0, 9.0, day, dt.date(2026, 9, 5), "win")]
    two = [(1, [1], 7.0, 7.5, day, day.date(), "win"), (1, [2], 5.0, 5.5, day, day.date(), "win"), (1, [1], 3.0, 3.6, day + minute, day.date(), "win")]
    table = str(tmp_path / "table")
    for part in (one, two):
        spark.createDataFrame(part, st.QUOTE).write.mode("append").parquet(str(tmp_path / "in"))
        st.snapshot(spark.readStream.schema(st.QUOTE).parquet(str(tmp_path / "in")), table, str(tmp_path / "state"))
    read = lambda: sorted(tuple(r) for r in spark.read.schema(st.QUOTE).parquet(table).collect())
    want = sorted([(1, [1], 3.0, 3.6, day + minute, day.date(), "win"), (1, [2], 5.0, 5.5, day, day.date(), "win"), one[2], one[3]])
    files = lambda: sorted((tmp_path / "table" / "race_date=2026-09-05").rglob("*.parquet"))
    assert read() == want
    st.merge_quotes(spark.createDataFrame(one, st.QUOTE), table)
    assert read() == want
    kept = files()
    st.merge_quotes(spark.createDataFrame(two, st.QUOTE), table)
    st.merge_quotes(spark.createDataFrame(two, st.QUOTE), table)
    assert read() == want and kept and files() == kept


def test_contests_leave_the_state(spark, tmp_path):
    """A contest goes when the watermark has passed its newest step; until then steps in any order are passed on once."""
    day = dt.datetime(2026, 9, 6)
    hour = dt.timedelta(hours=1)
    chunks = [[(1, "purchased", day + hour), (2, "proposed", day), (2, "odd", day)], [(1, "proposed", day), (1, "purchased", day + 3 * hour)], [(3, "proposed", day + dt.timedelta(days=30))]]
    schema = "race_id long, step string, at timestamp"
    before = spark.conf.get(st.STATE_STORE_KEY, None)
    spark.conf.set(st.STATE_STORE_KEY, st.STATE_STORE)
    try:
        for chunk in chunks:
            spark.createDataFrame(chunk, schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = st.lifecycle(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            state = st.drain(stream, str(tmp_path))["state"]
    finally:
        spark.conf.unset(st.STATE_STORE_KEY) if before is None else spark.conf.set(st.STATE_STORE_KEY, before)
    got = {(r["race_id"], r["step"], r["at"]) for r in st.results(spark, str(tmp_path), stream.schema).collect()}
    assert got == {(1, "proposed", day), (1, "purchased", day + hour), (2, "proposed", day), (3, "proposed", day + dt.timedelta(days=30))}
    assert max(state) == 3 and state[-1] == 1


def test_settled_stream_gives_every_ticket_once(spark, tmp_path):
    """The first payouts of a contest count, and of those the first with the legs; without payouts the return stays unknown."""
    start, far = dt.datetime(2026, 9, 6, 15), dt.datetime(2030, 1, 1)
    minute = dt.timedelta(minutes=1)
    tickets = [(1, 7, [1, 2], 100, start, None, None), (2, 7, [2, 3], 100, start, None, None), (3, 7, [9, 9], 200, start, None, None), (4, 8, [1, 2], 100, start, None, None), (0, 0, [1], 100, far, None, None)]
    paid = [(0, 7, None, None, None, start + 25 * minute, [([1, 2], 310), ([1, 2], 999), ([2, 3], 1055)]), (0, 7, None, None, None, start + 30 * minute, [([1, 2], 5)]),
            (0, 8, None, None, None, start + 70 * minute, [([1, 2], 5)]), (0, 0, None, None, None, far, [([1], 1)])]
    schema = "id long, race_id long, legs array<int>, stake int, start timestamp, paid_at timestamp, entries array<struct<legs: array<int>, per100: long>>"
    spark.createDataFrame(tickets + paid, schema).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("kind", F.lit("wide"))
    stream = st.settle_stream(
        feed.filter("paid_at is null").select("id", "race_id", "kind", "legs", "stake", "start"), feed.filter("paid_at is not null").select("race_id", "kind", "paid_at", "entries"))
    st.drain(stream, str(tmp_path))
    got = {r["id"]: r["ret"] for r in st.results(spark, str(tmp_path), stream.schema).collect()}
    assert got == {1: 310, 2: 1055, 3: 0, 4: None}


def test_validity(spark):
    rows = [(1, n, n, 0.25, 0.5, 0.75) for n in range(1, 5)] + [(2, n, min(n, 3), 0.25, 0.5, 0.75) for n in range(1, 5)]
    rows += [(3, n, n, 0.2, 0.5, 0.75) for n in range(1, 5)] + [(4, 1, n, 0.25, 0.5, 0.75) for n in range(1, 5)] + [(5, n, n, 0.25, 0.2, 0.75) for n in range(1, 5)]
    rows += [(6, n, n if n < 4 else None, 0.25, 0.5, 0.75) for n in range(1, 5)] + [(7, n, n, 0.5, 1.0, 1.0) for n in (1, 2)] + [(8, n, n if n < 4 else 99, 0.25, 0.5, 0.75) for n in range(1, 5)]
    df = spark.createDataFrame(rows, "race_id long, num int, finish int, p1 double, p2 double, p3 double")
    assert sorted(r["race_id"] for r in evaluate.valid_finish(df).collect()) == [1, 3, 5]
    assert sorted(r["race_id"] for r in evaluate.valid_race(df).collect()) == [1]
