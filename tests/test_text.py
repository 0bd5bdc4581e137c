"""Literal cases of the text functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from furlong.functions import fixed, text


def read(spark, values, make, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_date_place_weather(spark):
    cases = {
        "08/02小晴": ("08/02", "小", "晴"), "08/02小曇": ("08/02", "小", "曇"), "08/02小雨": ("08/02", "小", "雨"),
        "08/02小小": ("08/02", "小", "小"), "08/02小小雨": ("08/02", "小", "小雨"), "08/02小雪": ("08/02", "小", "雪"),
        "08/02小": ("08/02", "小", None), "08/02中曇": ("08/02", "中", "曇"), "08/02東小": ("08/02", "東", "小"),
        "08/02東小雨": ("08/02", "東", "小雨"), "08/02": ("08/02", None, None), "": (None, None, None),
    }
    assert [tuple(x) for x in read(spark, cases, text.date_place_weather)] == list(cases.values())


def test_weight_delta_rank(spark):
    cases = {
        "480": ("480", None, None), "554(+4)1": ("554", "+4", "1"), "480(-2)12": ("480", "-2", "12"), "480(0)": ("480", "0", None),
        "480()3": ("480", None, "3"), "計不": ("計不", None, None), "": (None, None, None),
    }
    assert [tuple(x) for x in read(spark, cases, text.weight_delta_rank)] == list(cases.values())


def test_days_since(spark):
    day = datetime.date(2025, 8, 30)
    got = read(spark, ["08/02", "12/31", "02/30", "x", None, "8/30"], lambda c: text.days_since(F.lit(day), c))
    assert got == [28, 242, None, None, None, 0]


def test_numbers(spark):
    assert read(spark, ["3.5kg", "-.5", "x", None, "１２"], text.num) == [3.5, -0.5, None, None, 12.0]
    assert read(spark, ["1着", " 12着", "中止", None, "3"], text.placing) == [1, 12, None, None, None]
    assert read(spark, ["3着", "中止", None], text.first_int) == [3, None, None]
    assert [tuple(x) for x in read(spark, ["▲54.0", "57", None, "☆"], text.carried)] == [(54.0, 1), (57.0, 0), (None, 0), (None, 1)]


def test_counters(spark):
    assert read(spark, ["00010102", "102", "0001010203", None], text.style4) == [[0, 1, 1, 2], [0, 0, 1, 2], [0, 1, 1, 2], [0, 0, 0, 0]]
    assert read(spark, ["2-3-1-4", "5", "1-2-3-4-5", None], text.career4) == [[2, 3, 1, 4], [5, 0, 0, 0], [1, 2, 3, 4], [0, 0, 0, 0]]
    assert read(spark, ["01000302", None], text.passing4) == [[1, None, 3, 2], [None] * 4]
    assert read(spark, ["00010102", "02020000", "", None], text.dominant_style) == ["追込", "逃げ", "不明", "不明"]


def test_names_and_levels(spark):
    assert read(spark, ["札", "東京競馬場", "中", "11", "?", None], text.place_code) == [1.0, 5.0, 6.0, 11.0, None, None]
    assert read(spark, ["芝", "ダ1800", "障害芝", "障", "砂", None, " "], text.surface) == ["芝", "ダート", "芝", "障害", "砂", "NA", "NA"]
    assert read(spark, ["G1", "GII", "GIII", "G2", "L", "Lap", "2勝クラス", None], text.race_class) == [8.0, 8.0, 8.0, 7.0, 5.0, 5.0, 3.0, 5.0]
    names = ["シケlダ", "(地)ｱｲ ｳ", "ア｜イ", "Invincible"]
    assert read(spark, names, text.name_norm) == ["シケーダ", "アイウ", "アーイ", "Invincible"]


def test_composites(spark):
    assert [tuple(x) for x in read(spark, ["ダ1800不", "芝2000稍", "1200良", "中止"], text.course)] == [
        ("ダート", 1800, "不良"), ("芝", 2000, "稍重"), (None, 1200, "良"), ("中止", None, None)]
    assert [tuple(x) for x in read(spark, ["1.53.4④", "1.53.4 12着", "中止", "1:10.2", ""], text.time_finish)] == [
        ("1.53.4", 4), ("1.53.4", 12), ("中止", None), ("1:10.2", None), (None, None)]
    assert [tuple(x) for x in read(spark, ["J.コレ57", "武豊"], text.name_trailing_number)] == [("J.コレ", 57.0), ("武豊", None)]
    assert [tuple(x) for x in read(spark, ["15ﾄ4番13", "15"], text.three_ints)] == [(15, 4, 13), (None, None, None)]
    assert [tuple(x) for x in read(spark, ["M追36.1", "36.1", "M"], text.pace_style_time)] == [("M", "追", 36.1), (None, None, 36.1), ("M", None, None)]
    assert [tuple(x) for x in read(spark, ["ﾓﾓﾝｳ(0.4)", "x"], text.text_paren)] == [("ﾓﾓﾝｳ", "0.4"), ("x", None)]
    assert [tuple(x) for x in read(spark, ["牡3", "セン5", "セ4", "せん6", "不"], text.sex_age)] == [("牡", 3), ("セン", 5), ("セ", 4), ("せん", 6), ("不", None)]
    assert [tuple(x) for x in read(spark, ["27.8-29.9", "27.8"], text.quote_range)] == [(27.8, 29.9), (None, None)]


def test_bands():
    cases = {"~1400": (0, 1400), "1401-1800": (1401, 1800), "1801~": (1801, 99999), "1400以下": (0, 1400), "全": None, "1600": None, "２０００以上": (2000, 99999)}
    assert {k: text.band_of(k) for k in cases} == cases


def test_race_ids(spark):
    good = read(spark, ["2606040601", "202606040601", " 2606040612 "], text.canonical_race_id)
    assert good == ["202606040601", "202606040601", "202606040612"]
    assert read(spark, ["2611040601", "2606000601", "2606040013", "26060406", "x", None, "2606040613"], text.canonical_race_id) == [None] * 7


@pytest.mark.parametrize("protected", ["{}", '="{}"', '  ="{}"  '])
def test_legs(spark, protected):
    cases = [
        ("win", "1 Horse", [1]), ("place", "2 Horse", [2]), ("frame", "枠1-枠1", [1, 1]), ("quinella", "1-2", [1, 2]), ("wide", "1-3", [1, 3]),
        ("exacta", "1→2", [1, 2]), ("trio", "1-2-3", [1, 2, 3]), ("trifecta", "1→2→3", [1, 2, 3]), ("frame", "枠2-枠1", [1, 2]),
        ("quinella", "10-2", [2, 10]), ("exacta", "2→1", [2, 1]), ("trio", "14-2-1", [1, 2, 14]), ("trifecta", "2→1→14", [2, 1, 14]),
    ]
    df = spark.createDataFrame([(k, protected.format(t), want) for k, t, want in cases], "kind string, t string, want array<int>")
    assert df.filter(~text.legs("kind", "t").eqNullSafe(F.col("want"))).isEmpty()


def test_unreadable_and_strict_legs(spark):
    bad = [("quinella", t) for t in (None, "", '="1-2', "=SUM(1,2)", '="bad"', "1→2")] + [("win", "馬名"), ("other", "1-2"), ("exacta", "1-2")]
    df = spark.createDataFrame(bad, "kind string, t string")
    assert df.filter(text.legs("kind", "t").isNotNull()).isEmpty()
    strict = [("frame", "枠1-枠1", False), ("frame", "枠1-枠9", False), ("quinella", "3-3", False), ("win", "19 x", False), ("win", "18 x", True), ("trio", "1-2-3", True), ("exacta", "2→1", True)]
    df = spark.createDataFrame(strict, "kind string, t string, ok boolean")
    assert df.filter(text.legs("kind", "t", strict=True).isNotNull() != F.col("ok")).isEmpty()


def test_leg_text_round_trip(spark):
    rows = [(k, list(range(1, fixed.KIND_LEGS[k] + 1))) for k in fixed.KINDS]
    df = spark.createDataFrame(rows, "kind string, legs array<int>")
    back = df.withColumn("back", text.legs("kind", text.protect(text.leg_text("kind", "legs"))))
    assert back.filter("legs <> back").isEmpty()


def test_missing_leg_has_no_text(spark):
    from furlong.functions import text

    rows = spark.createDataFrame([("exacta", [1]), ("trio", [1, 2, 3]), ("frame", [4, 4])], "kind string, legs array<int>")
    assert [r[0] for r in rows.select(text.leg_text("kind", "legs")).collect()] == [None, "1-2-3", "枠4-枠4"]


def test_race_ids_keep_line_ends(spark):
    assert read(spark, ["2606040601\r\n", "202606040601\n", "202606100612"], text.canonical_race_id) == ["202606040601\r\n", "202606040601\n", "202606100612"]


def test_ticket_lines_without_lambdas(spark):
    """The text ends where the pattern ends it; whole rows and single columns read the same legs."""
    lines = [
        "単勝 1 馬 | 確率 12% | オッズ 5 | 期待値 1", "複勝  | 確率 1 | 確率 2 | オッズ 5 | 期待値 1", "3連単 1→2→3 | 確率 1 | 確率 2 | オッズ 5 | 期待値 1",
        "枠連 =\"枠2-枠1\" | 確率 1 | オッズ 5 | 期待値 1", "馬連 | 確率 1 | オッズ 5 | 期待値 1", "単勝 2 | 確率 1 | オッズ 5 | 期待値 ", "x単勝 2 | 確率 1 | オッズ 5 | 期待値 1"]
    pattern = fixed.PATTERNS["bet_line"]
    df = spark.createDataFrame([(["\n".join(lines), "馬単 1→2 | 確率 1 | オッズ 5 | 期待値 1"], n) for n in range(3)], "messages array<string>, sent int")
    read = df.select("sent", F.explode(text.bet_lines(F.col("messages"), F.col("sent"))).alias("line"))
    assert [r["n"] for r in read.groupBy("sent").agg(F.count("line").alias("n")).orderBy("sent").collect()] == [4, 5]
    by_pattern = F.struct(text.mapped(F.regexp_extract("line", pattern, 1), {v: k for k, v in fixed.KIND_LABELS.items()}).alias("kind"), F.regexp_extract("line", pattern, 2).alias("text"))
    assert read.filter(text.bet_of("line") != by_pattern).isEmpty() and read.select(text.bet_of("line")["text"].alias("t")).filter("t is null or t = ''").isEmpty()
    whole = text.with_legs(read.select("line", text.bet_of("line").alias("b")).select("line", "b.*"))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    odd = [("trio", "14-2-99999999999"), ("quinella", "99999999999-3"), ("frame", "枠0-枠3"), ("exacta", "2→99999999999"), ("trio", "3-3-1"), ("win", "x"), ("other", "1-2"), ("wide", None), (None, "1-2")]
    rows = spark.createDataFrame(odd, "kind string, text string")
    for strict in (False, True):
        both = text.with_legs(rows, strict=strict).withColumn("one", text.legs("kind", "text", strict=strict))
        assert both.filter(~F.col("legs").eqNullSafe(F.col("one"))).isEmpty()
    assert [r["legs"] for r in text.with_legs(rows).collect()] == [[2, 14, None], [3, None], [0, 3], [2, None], [1, 3, 3], None, None, None, None]
    assert {tuple(r["legs"] or ()) for r in text.with_legs(rows, strict=True).collect()} == {()}
