"""Boosting that stops, pairs of a contest, isotonic steps over partitions, the search, and the jobs that use them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from furlong.operators import boost, evaluate, fit, isotonic
from furlong.operators.groups import Hot, find_hot
from furlong.plans import calibrate

HOT = Hot(("race_id",))
SMALL = {"maxDepth": 3, "minInstancesPerNode": 2, "stepSize": 0.3}


@pytest.fixture(scope="module")
def contests(spark):
    """The strength decides with some luck; a second column says nothing."""
    rng = random.Random(5)
    rows = []
    for race in range(240):
        field = [(n, rng.random(), rng.random()) for n in range(1, 3 + race % 7)]
        order = sorted(field, key=lambda e: -(e[1] + 0.25 * rng.gauss(0, 1)))
        rows += [(race, n, x, z if n % 5 else None, order.index((n, x, z)) + 1, race % 3) for n, x, z in field]
    return fit.label_rows(spark.createDataFrame(rows, "race_id long, num int, x double, z double, finish int, fold int"), HOT).cache()


def hits(scored):
    return evaluate.ranking(scored, {"s": F.col("score")}).first()["hit1"]


def test_rounds_stop_where_the_loss_stops_falling(contests):
    found = boost.fit_stopping(contests, F.col("fold") == 0, ["x", "z"], {**SMALL, "maxIter": 60}, tolerance=0.02)
    assert 1 <= found.rounds <= len(found.losses) < 60 and found.losses[found.rounds - 1] == min(found.losses)
    assert hits(fit.score(found.model, contests.filter("fold = 0"), ["x", "z"])) > 0.4
    top = boost.fit_stopping(contests, F.col("fold") == 0, ["x", "z"], {**SMALL, "maxIter": 60}, 2, 0.02)
    assert top.rounds < 60 and len(fit.top_chance(top.model, contests, ["x", "z"], "p").filter("p between 0 and 1").collect()) == contests.count()


def test_out_of_fold_scores_come_from_the_other_folds(contests):
    scored, found = boost.out_of_fold(contests, [0, 1, 2], ["x"], {**SMALL, "maxIter": 3})
    assert scored.count() == contests.count() and len(found) == 3
    again = {(r["race_id"], r["num"]): r["score"] for r in fit.score(found[1].model, contests.filter("fold = 1"), ["x"]).collect()}
    assert {(r["race_id"], r["num"]): r["score"] for r in scored.filter("fold = 1").collect()} == again
    assert boost.final_rounds([boost.Stopped(None, n) for n in (10, 20, 33)]) == 23 and boost.final_rounds([boost.Stopped(None, 1)]) == boost.LEAST_ROUNDS


def slopes(rows, k):
    """Pair by pair."""
    grad, hess, loss, pairs = ({(r["race_id"], r["num"]): 0.0 for r in rows} for _ in range(4))
    races = {}
    for r in rows:
        races.setdefault(r["race_id"], []).append(r)
    for mine in races.values():
        best = sorted((r for r in mine if r["finish"] is not None), key=lambda r: (r["finish"], r["num"]))[:k]
        for w in best:
            for f in mine:
                if f["finish"] is not None and w["finish"] < f["finish"]:
                    p = 1 / (1 + math.exp(w["score"] - f["score"]))
                    a, b = (w["race_id"], w["num"]), (f["race_id"], f["num"])
                    grad[a] += p
                    grad[b] -= p
                    hess[a] += p * (1 - p)
                    hess[b] += p * (1 - p)
                    loss[b] += math.log1p(math.exp(f["score"] - w["score"]))
                    pairs[b] += 1
    return grad, hess, loss, pairs


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_gradients_are_sums_over_pairs(contests, limit):
    """In both group plans; dead heats and entrants without a finish as well."""
    rows = contests.withColumns({
        "score": F.col("x") * 3 - 1, "finish": F.when(F.col("num") == 4, None).when(F.col("race_id") % 4 == 0, F.ceil(F.col("finish") / 2)).otherwise(F.col("finish")).cast("int")})
    rows = rows.filter("race_id < 60")
    hot = find_hot(rows, "race_id", rows=limit)
    got = {(r["race_id"], r["num"]): r for r in boost.with_gradients(boost.placed(rows, hot, 3), hot, 3).collect()}
    for name, want in zip(("grad", "hess", "loss", "pairs"), slopes(rows.collect(), 3), strict=True):
        assert {k: r[name] for k, r in got.items()} == pytest.approx(want), name


def test_boosted_pairs_learn_and_are_kept(contests, tmp_path):
    from pyspark.ml import PipelineModel

    found, measured = boost.fit_pairs(contests, HOT, ["x", "z"], F.col("fold") == 0, 4, params={"maxDepth": 2, "minInstancesPerNode": 2})
    losses = [m["train_loss"] for m in measured]
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False)) and measured[0]["train_loss"] == pytest.approx(measured[0]["train_pairs"] * math.log(2))
    assert found.rounds == min(range(len(found.losses)), key=found.losses.__getitem__)
    found.model.write().save(str(tmp_path / "pairs"))
    scored = fit.score(PipelineModel.load(str(tmp_path / "pairs")), contests, ["x", "z"])
    assert set(scored.columns) == {*contests.columns, "score"} and hits(scored) > 0.45
    none, _ = boost.fit_pairs(contests.limit(0), HOT, ["x"], None, 0)
    assert {r["score"] for r in fit.score(none.model, contests.limit(5), ["x"]).collect()} == {0.0}


def pooled(points):
    blocks = []
    for x, y, w in sorted(points):
        blocks.append([y * w, w, [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: s / n for s, n, xs in blocks for x in xs}


@pytest.mark.parametrize(("shape", "parts"), [("noise", 1), ("noise", 7), ("rising", 7), ("falling", 7), ("steps", 7), ("one", 7), ("hill", 7)])
def test_steps_over_partitions(spark, shape, parts):
    rng = random.Random(shape)
    make = {"noise": lambda i: rng.random(), "rising": lambda i: i, "falling": lambda i: -i, "steps": lambda i: i // 40 + rng.random() * 5, "one": lambda i: 1.0, "hill": lambda i: -abs(i - 150)}
    points = [(i / 7, float(make[shape](i)), float(rng.randrange(1, 5))) for i in range(300)]
    df = spark.createDataFrame([(x, x, y, w) for x, y, w in points], "low double, high double, value double, weight double")
    steps = sorted((r["low"], r["high"], r["value"]) for r in isotonic.fitted(df, parts).collect())
    assert all(a[1] < b[0] and a[2] <= b[2] + 1e-12 for a, b in zip(steps, steps[1:], strict=False))
    want = pooled(points)
    assert {x: next(v for a, b, v in steps if a <= x <= b) for x in want} == pytest.approx(want)


def test_long_segments_are_dealt_anew(spark):
    points = [(float(i), float(-i), 1.0) for i in range(200)]
    df = spark.createDataFrame([(x, x, y, w) for x, y, w in points], "low double, high double, value double, weight double")
    assert [(r["low"], r["high"], r["value"]) for r in isotonic.fitted(df, 8, long=2).collect()] == [(0.0, 199.0, pytest.approx(-99.5))]


def test_points_without_numbers(spark):
    rows = spark.createDataFrame([(0.1, 1), (0.1, 2), (None, 1), (float("nan"), 1), (0.4, None), (0.3, 1)], "p1 double, finish int")
    got = {r["low"]: (r["value"], r["weight"]) for r in isotonic.points(rows, F.col("p1"), F.col("finish") == 1).collect()}
    assert got == {0.1: (0.5, 2.0), 0.3: (1.0, 1.0)}


def test_halving_keeps_the_better_half(spark, contests):
    rows = contests.withColumn("part", F.when(F.col("fold") == 0, "valid").otherwise("train"))
    seen = []

    def judge(part, params):
        seen.append((params["c"], {r["race_id"] for r in part.select("race_id").distinct().collect()}))
        return params["c"] % 5 / 10

    found = boost.halving(rows, ["x"], [{"c": c} for c in range(11)], judge=judge)
    assert [[r["candidate"] for r in found if r["rung"] == k] for k in range(4)] == [list(range(11)), [3, 4, 8, 9, 2], [4, 9], [4]] or [
        sorted(r["candidate"] for r in found if r["rung"] == k) for k in range(4)] == [list(range(11)), [2, 3, 4, 8, 9], [4, 9], [4]]
    assert boost.winner(found) == 4
    sets = {}
    for c, races in seen:
        sets.setdefault(len(races), races)
    sizes = sorted(sets)
    assert all(sets[a] < sets[b] for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] == 240
    with pytest.raises(ValueError):
        boost.halving(rows, ["x"], [])


def test_halving_query_searches_the_whole_space(spark, contests, monkeypatch):
    """The registered query gives the search the candidates as they are drawn, with all their rounds and depths."""
    from furlong.catalog import fit_queries

    seen = []

    def halving(rows, features, candidates):
        seen.extend(candidates)
        return [{"rung": k, "share": 0.5 ** (3 - k), "candidate": c, "rate": 0.0, "kept": c < 8 >> k} for k in range(4) for c in range(16 >> k)]

    monkeypatch.setattr(fit_queries, "learning_rows", lambda *_: contests)
    monkeypatch.setattr(boost, "halving", halving)
    assert {r["rung"]: r["candidates"] for r in fit_queries.ml07_halving(spark, "").collect()} == {0: 16, 1: 8, 2: 4, 3: 2}
    assert seen == fit.sample_space(16) and max(c["maxIter"] for c in seen) > 20 and max(c["maxDepth"] for c in seen) > 5


def test_equal_rows_are_one_cell(spark):
    """Without draws the trees on cells are those on rows; many rows are few cells, and no row is lost."""
    rows = spark.range(30000).selectExpr("id div 10 as race_id", "cast(id % 10 as int) as num", "if(id % 7 = 0, null, id % 5) as x", "cast(id * id % 11 as double) as y").withColumn(
        "label", (F.col("num") % 4 + F.col("y") % 3 + F.coalesce("x", F.lit(9))).cast("double"))
    params = {"maxIter": 4, "maxDepth": 4, "minInstancesPerNode": 40, "subsamplingRate": 1.0}
    known = fit.cells(rows, ["x", "y"])
    assert known.bins is None and known.table.count() <= 6 * 11 * fit.DEALS and known.table.agg(F.sum("weight")).first()[0] == 30000 == known.rows
    want = fit.score(fit.fit_scorer(rows, ["x", "y"], params), rows, ["x", "y"]).withColumnRenamed("score", "want")
    both = known.fit(params).transform(known.vectors(want))
    assert both.agg(F.max(F.abs(F.col("score") - F.col("want")))).first()[0] < 1e-9


def test_rounds_of_pairs_leave_nothing_behind(spark, contests, monkeypatch):
    """The state is written once; what a round writes gives way to the next one."""
    import os

    from furlong.session import shared_dir

    written, cut = [], boost.cut
    monkeypatch.setattr(boost, "cut", lambda df: written.append(df.columns) or cut(df))
    found, measured = boost.fit_pairs(contests, HOT, ["x"], F.col("fold") == 0, 3, params={"maxDepth": 2, "minInstancesPerNode": 2})
    assert len(measured) == 4 and len(written) == 1 and "grad" not in written[0]
    assert not [f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("slopes-")]
    assert measured[3]["train_loss"] < measured[0]["train_loss"] and found.losses == [m["valid_loss"] for m in measured]


def test_stopping_and_classifying_on_cells_is_that_on_rows(spark):
    """Equal rows of one label and side are one weighted row; rounds, losses and chances are those of all rows, and no row is lost."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    rows = spark.range(30000).selectExpr("id div 10 as race_id", "cast(id % 10 as int) as num", "if(id % 7 = 0, null, id % 5) as x", "cast(id * id % 11 as double) as y", "id % 3 = 0 as held").withColumns(
        {"label": (F.col("num") % 4 + F.col("y") % 3).cast("double"), "finish": (F.col("num") * 7 % 10 + F.col("y") % 2).cast("int")}).cache()
    held, features, limits = F.col("held"), ["x", "y"], {"maxIter": 6, "maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 40, "subsamplingRate": 1.0}
    few = fit.tree_rows(rows, features, F.col("label"), held)
    assert few.table.count() < 15000 and few.table.agg(F.sum("weight")).first()[0] == 30000 and few.rows == 20000
    plain = fit.assembler(features).transform(fit.filled(rows.withColumns({"_valid": held, "top": (F.col("finish") <= 3).cast("double")}), features))
    more = {**fit.DEFAULTS, **limits}
    for top, kind, label in ((None, GBTRegressor, "label"), (3, GBTClassifier, "top")):
        found = boost.fit_stopping(rows, held, features, limits, top, 0.001)
        want = kind(labelCol=label, validationIndicatorCol="_valid", validationTol=0.001, **more).fit(plain)
        losses = want.evaluateEachIteration(plain.filter("_valid"), *([] if top else ["squared"]))
        assert found.losses == pytest.approx(list(losses), rel=1e-9)
    got = fit.top_chance(fit.fit_top(rows, features, 3, limits), rows, features, "p")
    assert got.columns == [*rows.columns, "p"]
    want = fit.top_chance(fit.PipelineModel([fit.assembler(features), GBTClassifier(labelCol="top", **more).fit(plain)]), rows, features, "q")
    assert got.join(want, ["race_id", "num"]).agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
    apart = fit.tree_rows(rows.withColumn("z", F.xxhash64("race_id", "num").cast("double")).limit(300), ["z"], F.col("label"))
    assert apart.rows is None and apart.table.count() == 300 and apart.params({"a": 1}) == {"a": 1}


def test_many_values_are_binned(spark):
    """Borders at the quantiles; values that are missing keep their flag, and rows that mostly differ stay rows."""
    rows = spark.range(20000).selectExpr("id div 10 as race_id", "cast(id % 10 as int) as num", "if(id % 9 = 0, null, id / 7) as x", "id * 1.5 as y", "cast(id % 10 as double) as label")
    one = fit.cells(rows, ["x"])
    assert one.table.count() < 20000 // 2 and one.table.agg(F.sum("weight")).first()[0] == 20000
    assert 25 <= one.table.select("features").distinct().count() <= fit.BINS + 1  # a ninth of the values are one
    assert "in {" not in one.fit({"maxIter": 2}).toDebugString  # bins keep their order
    wide = fit.cells(rows.withColumns({f"z{i}": F.xxhash64("race_id", "num", F.lit(i)).cast("double") for i in range(6)}), ["x", "y", *[f"z{i}" for i in range(6)]])
    assert wide.table.count() == 20000 and wide.table.select("weight").distinct().count() == 1


def test_search_rates_are_those_of_each_candidate(contests):
    rows = contests.withColumn("part", F.when(F.col("fold") == 0, "valid").otherwise("train"))
    train, valid = rows.filter("part = 'train'"), rows.filter("part = 'valid'")
    weak, strong = {**SMALL, "maxIter": 1, "maxDepth": 1, "subsamplingRate": 1.0}, {**SMALL, "maxIter": 8, "subsamplingRate": 1.0}
    found = fit.tune(train, valid, ["x", "z"], [weak, strong])
    assert [p for p, _ in found] == [weak, strong]
    alone = [fit.tune(train, valid, ["x", "z"], [p])[0][1] for p in (weak, strong)]
    assert [r for _, r in found] == alone and alone[1] > 0.4
    assert boost.halving(rows, ["x"], [weak, strong])[0]["share"] == 1


def test_calibration_job(spark):
    """Stored chances that are too flat are made steeper; a contest with a fault is left out."""
    rng = random.Random(3)
    rows = []
    for race in range(300):
        weight = [rng.random() ** 3 + 0.01 for _ in range(5)]
        left, order = list(range(5)), []
        while left:
            pick = rng.choices(left, [weight[i] for i in left])[0]
            order.append(pick)
            left.remove(pick)
        flat = [math.sqrt(w) for w in weight]
        p = [f / sum(flat) for f in flat]
        rows += [(race, i + 1, order.index(i) + 1, p[i], min(1.0, 2 * p[i]), min(1.0, 3 * p[i])) for i in range(5)]
    rows += [(999, 1, 1, 0.5, 0.6, 0.7), (999, 2, 1, 0.5, 0.6, 0.7), (999, 3, 2, 0.5, 0.6, 0.7)]
    df = spark.createDataFrame(rows, "race_id long, num int, finish int, p1 double, p2 double, p3 double")
    done = calibrate.calibrate_job(df)
    assert {r["part"]: (r["races"], r["rows"]) for r in done.sides.collect()} == {"fit": (200, 1000), "held": (100, 500)}
    first = done.losses.filter("k = 1").first()
    assert first["n"] == 500 and first["calibrated_logloss"] < first["stored_logloss"] and first["calibrated_brier"] < first["stored_brier"]
    assert done.chances.filter("race_id = 999").count() == 0
    with pytest.raises(ValueError):
        calibrate.calibrate_job(df.filter("race_id in (1, 999)"))
