"""The jobs end to end on small files."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from furlong.operators import fit
from furlong.operators.groups import Hot
from furlong.plans import daily, predict, train
from furlong.sources import files


def card(code, size, salt, with_result=True):
    rows = []
    for n in range(1, size + 1):
        skill = (n * 7 + salt * 3) % 11
        row = {
            "URLコード": code, "枠番": (n + 1) // 2, "馬番": n, "馬名": f"ウマ{(n + salt) % 40}", "性別": "牡" if n % 2 else "牝", "年齢": 3 + n % 3,
            "騎手": f"騎手{(n * salt) % 9}", "調教師": f"師{(n + salt) % 6}", "父馬": "父", "母父馬": "母父", "競馬場": 5, "レース": int(code[8:]),
            "芝orダート": "芝" if salt % 2 else "ダート", "距離": 1600, "回り": "左", "馬場": "良", "斤量": f"{50 + n}", "馬体重": 470 + n, "体重増減": "+2",
            "脚質": "逃先差追"[n % 4], "脚質:逃先差追": f"{n % 3:02d}{salt % 4:02d}0102", "全": f"{n % 3}-0-{salt % 2}-2", "~1400": "0-0-0-1", "1401-2000": "1-0-0-1", "2001以上": "0-0-0-0",
            "前走のスピード指数": 60 + skill, "前走の着順": 1 + (11 - skill) % size, "前走の人気": 1 + skill % size, "前走の距離": 1600, "前走の芝orダート": "芝", "前走からの日数": 20 + n,
            "前走のレース名": "2勝クラス", "前走の頭数": size, "前走の競馬場": "東", "2走前のスピード指数": 55 + skill,
        }
        if with_result:
            row["着順"] = f"{1 + sorted(range(1, size + 1), key=lambda k: (-((k * 7 + salt * 3) % 11), k)).index(n)}着"
        rows.append(row)
    return rows


def write(folder, code, rows):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / f"horse_racing_data_{code}.csv", "w", encoding="utf-8-sig", newline="") as fh:
        out = csv.DictWriter(fh, rows[0].keys())
        out.writeheader()
        out.writerows(rows)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("world")
    salt = 0
    for year in (24, 25):
        for day in range(1, 4):
            for race in range(1, 9):
                salt += 1
                write(base / "past", f"{year}0501{day:01d}{race:02d}".replace(f"01{day}", f"010{day}"), card(f"{year}05010{day}{race:02d}", 5 + salt % 4, salt))
    for race in (1, 2):
        write(base / "next", f"26050101{race:02d}", card(f"26050101{race:02d}", 8, 100 + race, with_result=False))
    cfg = train.TrainConfig(split_year=2025, params={"maxIter": 3, "maxDepth": 3, "minInstancesPerNode": 2}, other_params={"numTrees": 3, "maxDepth": 3, "minInstancesPerNode": 2})
    measured = train.train_job(spark, str(base / "past"), str(base / "bundle"), cfg)
    predictions = predict.predict_job(spark, str(base / "next"), str(base / "bundle"), str(base / "predictions"))
    return base, measured, predictions


def test_training(spark, world):
    base, measured, _ = world
    assert measured["races"] == 24 and 0 <= measured["hit1"] <= 1 and measured["temperature"] > 0
    meta, _, tables, _ = fit.load_bundle(spark, str(base / "bundle"))
    assert meta["features"] and not [c for c in meta["features"] if c in ("finish", "label")]
    assert {"jockey_runs", "jockey_surface_win_rate", "speed_mean", "sex_code"} <= set(meta["features"])
    assert set(tables) == {"categories", "pairs", "jockey", "trainer"}
    assert {b["score"] for b in measured["baselines"]} == {"number", "score", "other", "win"} and measured["confidence"][0]["share"] == 1.0
    assert (measured["blend"] == "") == (measured["weight"] == 0.0) and measured["hit1"] >= next(b["hit1"] for b in measured["baselines"] if b["score"] == "number") - 1


def test_training_stops_and_fits_again(world):
    _, measured, _ = world
    assert all(1 <= n <= 3 for n in measured["stopped"].values()) and measured["rounds"] == {"score": 5, "win": 5}
    assert 1 <= len(measured["gains"]["top"]) <= 15 and 0 <= measured["gains"]["categories"]["share"] <= 100


def test_tuned_parameters_are_used(spark, world, tmp_path):
    """The search returns its rungs; a training takes what was written, and given parameters come before it."""
    base, _, _ = world
    cfg = train.TrainConfig(split_year=2025, params={"maxIter": 2})
    found = train.tune_job(spark, str(base / "past"), str(tmp_path / "tuned"), 4, cfg)
    assert [r["rung"] for r in found["rungs"]] == [0] * 4 + [1] * 2 and found["winner"] in {r["candidate"] for r in found["rungs"] if r["rung"] == 1}
    if not found["written"]:
        spark.createDataFrame([(json.dumps({"maxDepth": 4, "maxIter": 9}),)], "params string").write.mode("overwrite").json(str(tmp_path / "tuned"))
    params = train.parameters(spark, train.TrainConfig(params={"maxIter": 2}, tuned=str(tmp_path / "tuned")))
    assert params["maxIter"] == 2 and "maxDepth" in params and train.parameters(spark, cfg) == {"maxIter": 2}


def test_blend_is_chosen_only_if_strictly_better(spark):
    """The other score finds the winners of contests 1 and 2, the own score that of contest 1; equal hits keep the own score."""
    rows = [(g, n, 1 if n == 1 else 2, float(n if g == 2 else -n), float(-n) * 9) for g in (1, 2) for n in (1, 2, 3)]
    df = spark.createDataFrame(rows, "race_id long, num int, finish int, score double, other double").withColumn("win", F.lit(0.3))
    name, weight, best = train.choose_blend(df, Hot(("race_id",)))
    assert name == "other" and weight > 0.5 - 1e-9 and best["hit1"] == 1.0
    assert train.choose_blend(df.withColumn("score", F.col("other")), Hot(("race_id",)))[:2] == ("", 0.0)


def test_prediction_uses_the_blend(spark, world):
    """Two bundles with the same scorer and different blend models give different chances, both sound."""
    base, _, _ = world
    meta, model, tables, _ = fit.load_bundle(spark, str(base / "bundle"))
    plain = {k: v for k, v in meta.items() if not k.startswith(("has_", "other_", "win_", "tables", "version"))}
    numbers = spark.createDataFrame([(n, 1 if n == 8 else 2, float(n)) for n in range(1, 9)] * 4, "num int, finish int, label double")
    numbers = numbers.withColumns({c: F.lit(0.0) for c in meta["features"] if c not in numbers.columns})
    small = {"maxDepth": 3, "minInstancesPerNode": 1}
    models = {"other": fit.fit_other(numbers, meta["features"], {**small, "numTrees": 3}), "win": fit.fit_top(numbers, meta["features"], 1, {**small, "maxIter": 2})}
    found = {}
    for name, extra in models.items():
        fit.save_bundle(str(base / name), {**plain, f"{name}_weight": 0.9}, model, tables, {name: extra})
        out = predict.predict_job(spark, str(base / "next"), str(base / name), str(base / f"out-{name}"))
        found[name] = {(r["race_id"], r["num"]): r["p1"] for r in out.collect()}
        for race in {k[0] for k in found[name]}:
            assert sum(p for k, p in found[name].items() if k[0] == race) == pytest.approx(1)
    assert found["other"].keys() == found["win"].keys() and any(abs(found["other"][k] - found["win"][k]) > 1e-6 for k in found["win"])


def test_predictions(spark, world):
    base, _, predictions = world
    rows = predictions.collect()
    assert len(rows) == 16 and {r["race_id"] for r in rows} == {"202605010101", "202605010102"}
    for race in {r["race_id"] for r in rows}:
        mine = [r for r in rows if r["race_id"] == race]
        assert sum(r["p1"] for r in mine) == pytest.approx(1) and sum(r["p3"] for r in mine) == pytest.approx(3)
        assert min(r["rk1"] for r in mine) == 1
    assert spark.read.parquet(str(base / "predictions")).count() == 16
    one = predict.predict_job(spark, str(base / "next"), str(base / "bundle"), str(base / "one"), race_id="202605010102")
    both = {(r["num"]): r["p1"] for r in rows if r["race_id"] == "202605010102"}
    assert {r["num"]: r["p1"] for r in one.collect()} == pytest.approx(both)
    with pytest.raises(ValueError):
        predict.predict_job(spark, str(base / "next"), str(base / "bundle"), str(base / "none"), race_id="202605010112")


def test_identity_checks(spark, tmp_path):
    write(tmp_path / "a", "2605010101", card("2605010101", 3, 1))
    write(tmp_path / "a", "2605010102", card("2605010101", 3, 1))
    with pytest.raises(ValueError, match="more than one file"):
        predict.identified(files.read_entries(spark, str(tmp_path / "a")))
    write(tmp_path / "b", "2605010101", card("2605010101", 2, 1) + card("2605010102", 2, 1))
    with pytest.raises(ValueError, match="more than one contest"):
        predict.identified(files.read_entries(spark, str(tmp_path / "b")))
    write(tmp_path / "c", "2605010101", card("2611010101", 2, 1))
    with pytest.raises(ValueError, match="out of range"):
        predict.identified(files.read_entries(spark, str(tmp_path / "c")))


def test_tickets_to_reports(spark, world):
    base, _, predictions = world
    quotes = predictions.select("race_id", F.inline(F.array(
        F.struct(F.lit("win").alias("kind"), F.array("num").alias("legs"), F.lit(30.0).alias("odds_lo")),
        F.struct(F.lit("quinella").alias("kind"), F.array(F.least(F.col("num"), F.lit(7)), F.lit(8)).alias("legs"), F.lit(60.0).alias("odds_lo")))))
    quotes = quotes.filter(F.size(F.array_distinct("legs")) == F.size("legs")).dropDuplicates(["race_id", "kind", "legs"])
    found = daily.propose_job(predictions, quotes, str(base / "tickets"))
    assert found.count() > 0 and found.filter("value < 1 or chance < 0.1").isEmpty()
    assert daily.propose_job(predictions, quotes, race_no=2).select("race_id").distinct().count() <= 1
    results = predictions.select("race_id", "num", "frame", F.col("num").alias("finish"))
    reports = daily.settle_job(found, results, min_value=1.0)
    whole = reports["report"].filter("kind is null").first()
    assert whole["points"] == found.count() and whole["profit"] == whole["ret"] - whole["bet"]
    assert reports["grid"].filter("level = 'all' and min_chance = 0.1 and min_value = 1.0").first()["points"] == found.count()
    evaluated = daily.evaluate_job(predictions.select("race_id", "num", "p1", "p2", "p3"), results)
    assert evaluated["losses"].first()["n"] == 16 and evaluated["combinations"].count() == 5


def test_ledger_reports(spark, tmp_path):
    head = "東京 {}R 杯 発走 2026/01/0{} 15:40 JST"
    line = "単勝 {} ア | 確率 20.00% | オッズ 6 | 期待値 1.200"
    for i, (bought, number) in enumerate(((True, 1), (True, 2), (False, 1))):
        doc = {"messages": [head.format(i + 1, i + 1) + "\n" + line.format(number)], "sent": 1, "done": True}
        if bought:
            doc["auto_bet_result"] = "IPATで 1点 300円を自動購入しました"
        (tmp_path / "s").mkdir(exist_ok=True)
        (tmp_path / "s" / f"20260501010{i + 1}.json").write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "p").mkdir()
    for i in (1, 3):
        (tmp_path / "p" / f"20260501010{i}.json").write_text(json.dumps({"race_id": f"20260501010{i}", "payouts": {"単勝": [[[1], 530]]}}, ensure_ascii=False), encoding="utf-8")
    actual = daily.ledger_job(spark, str(tmp_path / "s"), str(tmp_path / "p"))
    total = actual["summary"].first()
    assert (total["points"], total["settled_points"], total["bet"], total["pending_bet"], total["ret"], total["profit"]) == (2, 1, 300, 300, 1590, 1290)
    assert [r["cumulative_profit"] for r in actual["daily"].orderBy("bet_date").collect()] == [1290, 1290]
    assert {r["race_id"]: r["pending_reason"] for r in actual["races"].collect()} == {"202605010101": None, "202605010102": "no payouts yet"}
    counts = actual["sources"].first()
    assert (counts["races"], counts["purchased_races"], counts["unconfirmed_races"]) == (3, 2, 1)
    simulated = daily.ledger_job(spark, str(tmp_path / "s"), str(tmp_path / "p"), "simulation", 100, first="2026-01-02")
    assert simulated["summary"].first()["points"] == 2 and simulated["summary"].first()["ret"] == 530
