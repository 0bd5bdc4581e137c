"""Files and pages on literal input."""

import json

import pytest
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.operators import normalize
from furlong.operators.groups import Hot, find_hot
from furlong.sources import files, pages, sinks

def paid(kind, legs, amount):
    items = "".join("<ul>" + "".join(f"<li><span>{n}</span></li>" for n in group) + "</ul>" for group in legs)
    return f'<tr class="{kind}"><td class="Result">{items}</td><td class="Payout"><span>{amount}</span></td></tr>'


#: Two tables of one page; a refunded row and an amount that cannot be read.
PAYOUT_PAGE = f"""<body><table class="Payout_Detail_Table">
{paid("Tan3", [[9, 4, 11]], "8,120円")}{paid("Fuku3", [[11, 9, 4]], "返還")}{paid("Tansho", [[9]], "270円")}
</table><p>x</p><table class="Payout_Detail_Table">
{paid("Wide", [[9, 4], [11, 9]], "310円<br />1,050円")}{paid("Umaren", [[4, 9]], "?")}{paid("Tansho", [[9]], "999円")}
</table></body>"""


def write(path, name, text, bom=True):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8-sig" if bom else "utf-8")


def test_cards_with_different_headers(spark, tmp_path):
    write(tmp_path, "horse_racing_data_2606040601.csv", "URLコード,馬番,馬名\n2606040601,1,ア\n2606040601,2,イ\n")
    write(tmp_path, "horse_racing_data_2606040602.csv", '馬番,着順,URLコード\n1,"1着",2606040602\n')
    write(tmp_path, "other.csv", "馬番,馬名\n1,x\n")
    write(tmp_path, "empty.csv", "")
    rows = files.read_entries(spark, str(tmp_path))
    got = {(r["URLコード"], r["馬番"], r["馬名"], r["着順"]) for r in rows.collect()}
    assert got == {("2606040601", "1", "ア", None), ("2606040601", "2", "イ", None), ("2606040602", "1", None, "1着")}
    ids = [r["race_id"] for r in files.read_ids_from_paths(spark, str(tmp_path)).collect()]
    assert ids == ["202606040601", "202606040602"]
    there = {r["column"]: r["present"] for r in files.peek_columns(spark, str(tmp_path), "URLコード", ["着順", "調教師"]).collect()}
    assert there == {"着順": True, "調教師": False}


def test_career_columns_by_position(spark, tmp_path):
    write(tmp_path, "horse_racing_data_2606040601.csv", "URLコード,馬番,脚質:逃先差追,全,~1400,1401-2000,2001以上,x\n2606040601,1,01000002,1-0-0-2,1-0-0-0,0-0-0-2,,y\n")
    raw = files.read_named(spark, str(tmp_path), "URLコード")
    assert files.career_bands(raw.columns) == {"career_a": (0, 1400), "career_b": (1401, 2000), "career_c": (2001, 99999)}
    entries, rejects = normalize.normalize_entries(files.read_entries(spark, str(tmp_path)))
    row = entries.first()
    assert row["career"][0] == [1, 0, 0, 2] and row["style4"] == [1, 0, 0, 2] and row["career"][3] == [0, 0, 0, 0]
    assert rejects.isEmpty()


def test_quote_files(spark, tmp_path):
    base = "odds_20260906_札幌2回6日_11R_"
    write(tmp_path, base + "tanpuku.csv", "レース番号,枠番,馬番,馬名,単勝オッズ,複勝オッズ下限,複勝オッズ上限\n11R,1,1,ア,3.5,1.2,1.5\n11R,1,x,イ,3,1,2\n")
    write(tmp_path, base + "wide.csv", "レース番号,馬番1,馬番2,ワイドオッズ\n11R,1,2,27.8-29.9\n")
    write(tmp_path, base + "wakuren.csv", "レース番号,枠番1,枠番2,枠色1,枠色2,枠連オッズ\n11R,1,1,白,白,10\n")
    write(tmp_path, base + "tan3.csv", "レース番号,1着馬番,2着馬番,3着馬番,3連単オッズ\n11R,3,1,2,1234.5\n")
    got = {(r["kind"], tuple(r["legs"]), r["odds_lo"], r["odds_hi"]) for r in files.read_quotes(spark, str(tmp_path)).collect()}
    assert got == {("win", (1,), 3.5, 3.5), ("place", (1,), 1.2, 1.5), ("wide", (1, 2), 27.8, 29.9), ("frame", (1, 1), 10.0, 10.0), ("trifecta", (3, 1, 2), 1234.5, 1234.5)}
    one = files.read_quotes(spark, str(tmp_path)).first()
    assert one["race_id"] == "202601020611" and str(one["race_date"]) == "2026-09-06"


def test_prediction_and_result_files(spark, tmp_path):
    head = "開催日,競馬場,レース番号,枠番,馬番,馬名,1着確率,2着以内確率,3着以内確率\n"
    write(tmp_path / "p", "pred_1.csv", head + "2026年 第4回6日目,東京,11R,1,1,ア,0.6,1,1\n2026年 第4回6日目,東京,11R,1,2,イ,0.4,1,x\n")
    write(tmp_path / "p", "pred_2.csv", head + "2026年 第4回6日,東京,11R,1,1,ア,0.6,1,1\n")
    clean, rejects = files.read_predictions(spark, str(tmp_path / "p"))
    assert {(r["race_id"], r["num"], r["p1"]) for r in clean.collect()} == {("202605040611", 1, 0.6), ("202605040611", 2, 0.4)}
    assert rejects.count() == 1
    assert files.read_predictions(spark, str(tmp_path / "p"), strict=True)[1].count() == 2
    write(tmp_path / "r", "horse_racing_data_1.csv", "年,競馬場,回,日,レース,馬番,枠番,着順\n2026,5,4,6,11,1,1,1着\n2026,5,4,6,11,2,1,中止\n2026,11,4,6,11,2,1,2着\n")
    good, bad = files.read_results(spark, str(tmp_path / "r"))
    assert {(r["race_id"], r["num"], r["finish"]) for r in good.collect()} == {("202605040611", 1, 1), ("202605040611", 2, None)} and bad.count() == 1


def test_identities_are_worked_out_once(spark, tmp_path):
    """A row's identity is read by one pattern; neither its parts nor the test for rejects repeat the expressions below it."""
    head = "開催日,競馬場,レース番号,枠番,馬番,馬名,1着確率,2着以内確率,3着以内確率\n"
    write(tmp_path / "p", "pred_1.csv", head + "2026年 第4回6日目,東京,11R,1,1,ア,0.6,1,1\n")
    clean, _ = files.read_predictions(spark, str(tmp_path / "p"), strict=True)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert clean.count() == 1 and plan(clean).count("regexp_extract(") <= 8
    cards = spark.createDataFrame([("2605040611", "1番", "1着")], "`URLコード` string, `馬番` string, `着順` string")
    entries, _ = normalize.normalize_entries(cards)
    assert entries.first()["race_id"] == "202605040611" and plan(entries.select("race_id", "num", "venue")).count("RLIKE") <= 6


def state(messages, **more):
    return json.dumps({"messages": messages, **more}, ensure_ascii=False)


def test_state_documents(spark, tmp_path):
    head = "_ _\n東京 11R 杯 発走 2026/09/06 15:40 JST"
    line = "単勝 3 ア | 確率 20.00% | オッズ 6 | 期待値 1.200\n馬連 1-2 | 確率 20.00% | オッズ 6 | 期待値 1.200"
    done = "IPATで 2点 600円を自動購入しました"
    docs = {
        "202605040611": state([f"{head}\n{line}"], sent=1, done=True, bets=[{"式別": "馬連", "買い目": "2-1"}, {"式別": "単勝", "買い目": "3 ア"}], auto_bet_result=done),
        "202605040612": state([f"{head}\n{line}", done], done=True), "202605040610": state(["x"], done=True),
        "202605040609": state([head], sent=3), "202605040608": state([f"{head}\n馬単 1-2 | 確率 1% | オッズ 6 | 期待値 1"], sent=1),
        "202605040607": state([f"{head}\n{line}", done, done.replace("600", "800")], sent=1), "202605040606": "{broken", "schedule_20260906": "{}",
    }
    for name, text in docs.items():
        write(tmp_path, f"{name}.json", text, bom=False)
    clean, rejects = files.read_state_log(spark, str(tmp_path))
    got = {r["race_id"]: r for r in clean.collect()}
    assert set(got) == {"202605040611", "202605040612"}
    assert got["202605040611"]["unit"] == 300 and [t["legs"] for t in got["202605040611"]["tickets"]] == [[1, 2], [3]]
    assert got["202605040612"]["unit"] == 300 and len(got["202605040612"]["notified"]) == 2 and got["202605040611"]["place"] == "東京"
    assert {r["race_id"] for r in rejects.collect()} == {f"2026050406{n:02d}" for n in (6, 7, 8, 9, 10)}


def test_payout_documents(spark, tmp_path):
    good = {"race_id": "202605040611", "payouts": {"単勝": [[[2], 530]], "ワイド": [[[1, 2], 1680], [[2, 14], 400]]}}
    bad = [{"race_id": "1", "payouts": {}}, {"race_id": "2", "payouts": {"単勝": []}}, {"race_id": "3", "payouts": {"別": [[[1], 1]]}}, {"race_id": "4", "payouts": {"単勝": [[[1], -5]]}}, {"race_id": "x", "payouts": {"単勝": [[[1], 5]]}}]
    write(tmp_path, "202605040611.json", json.dumps(good, ensure_ascii=False), bom=False)
    for i, doc in enumerate(bad):
        write(tmp_path, f"{i + 1}.json", json.dumps(doc, ensure_ascii=False), bom=False)
    write(tmp_path, "9.json", "{", bom=False)
    got = {(r["race_id"], r["kind"], tuple(r["legs"]), r["per100"]) for r in files.read_payouts(spark, str(tmp_path)).collect()}
    assert got == {("202605040611", "win", (2,), 530), ("202605040611", "wide", (1, 2), 1680), ("202605040611", "wide", (2, 14), 400)}


def test_payout_page(spark):
    html = spark.createDataFrame([(1, PAYOUT_PAGE), (2, "<html></html>"), (3, None)], "page_id long, html string")
    got = [(r["kind"], tuple(r["legs"]), r["per100"]) for r in pages.payouts_from_cells(pages.extract_cells(html)).orderBy("seq").collect()]
    assert got == [("trifecta", (9, 4, 11), 8120), ("win", (9,), 270), ("wide", (4, 9), 310), ("wide", (9, 11), 1050), ("win", (9,), 999)]


def test_first_payout_over_all_tables_of_a_page(spark):
    from furlong.operators.settle import first_payouts

    html = spark.createDataFrame([(1, PAYOUT_PAGE)], "page_id long, html string")
    found = pages.payouts_from_cells(pages.extract_cells(html)).withColumnRenamed("page_id", "race_id")
    assert {r["per100"] for r in first_payouts(found).filter("kind = 'win'").collect()} == {270}


def test_unreadable_place_quote_moves_no_other(spark):
    def row(n, low, high):
        return f'<tr><td class="num">{n}</td><td class="odds_tan">3</td><td class="odds_fuku"><span class="min">{low}</span>-<span class="max">{high}</span></td></tr>'

    html = f'<table class="tanpuku">{row(1, "1.5", "2.5")}{row(2, "---", "2.5")}{row(3, "1.5", "---")}</table>'
    rows = pages.single_quotes_from_cells(pages.extract_cells(spark.createDataFrame([(1, html)], "page_id long, html string"))).collect()
    assert {r["num"]: (r["place_lo"], r["place_hi"]) for r in rows} == {1: (1.5, 2.5), 2: (None, 2.5), 3: (1.5, None)}


def test_only_the_first_line_is_a_header(spark, tmp_path):
    write(tmp_path, "a.csv", "k,n\n1,2\n3,k\n")
    write(tmp_path, "b.csv", "n,k\nk,5\n")
    write(tmp_path, "c.csv", "\nn,k\n7,6\n")
    write(tmp_path, "d.csv", "n,m\nk,1\n")
    rows = files.read_named(spark, str(tmp_path), "k")
    assert set(rows.columns) == {"k", "n", "_broken", "file"}
    assert sorted((r["k"], r["n"]) for r in rows.collect()) == [("1", "2"), ("3", "k"), ("5", "k"), ("6", "7")]


def test_trio_page_and_nested_tables(spark):
    html = '<table class="fuku3"><caption>1-2</caption><tr><th>3</th><td>12.5</td></tr><tr><th>4</th><td></td></tr></table><table class="c1"><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>'
    cells = pages.extract_cells(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [(r["kind"], tuple(r["legs"]), r["odds_lo"]) for r in pages.quotes_from_cells(cells).collect()] == [("trio", (1, 2, 3), 12.5)]
    assert {(r["table_class"], r["col_ix"], r["text"]) for r in cells.filter("table_class <> 'fuku3'").collect()} == {("c1", 0, "a b"), ("c1", 1, "c"), ("", 0, "b")}


def test_tickets_file_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("202605040611", k, list(range(1, fixed.KIND_LEGS[k] + 1)), 0.12345, 9.5, 1.17277, "n") for k in fixed.KINDS],
                                 "race_id string, kind string, legs array<int>, chance double, odds_lo double, value double, note string")
    path = str(tmp_path / "t")
    sinks.write_tickets(rows, path)
    raw = files.read_named(spark, path, "買い目").select(F.col("式別").alias("label"), F.col("買い目").alias("text"), F.col("`的中確率(推定)`").alias("c"))
    clean, rejects = normalize.normalize_tickets(raw)
    assert {(r["kind"], tuple(r["legs"]), r["c"]) for r in clean.collect()} == {(k, tuple(range(1, fixed.KIND_LEGS[k] + 1)), "0.1234") for k in fixed.KINDS}
    assert rejects.isEmpty()
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in (tmp_path / "t").glob("*.csv"))


def test_card_to_entries(spark):
    """Vertical card, composite cells split, then typed."""
    block = ["08/02東晴", "春G2", "芝2000稍", "武57", "15ﾄ4番13", "1.59.1②", "M先35.1", "01020304", "ア(0.4)", "480(+2)3", "1", "2", "3", "88"]
    now = ["1着", "2.5", "1.58.0", "M追34.0", "04030201", "482(+2)1", "11", "12", "13", "99"]
    labels = ["馬番", "馬名", "性齢", "調教師", *["?"] * 10, "前走の成績", *["?"] * 13]
    values = ["1", "ア", "牡3", "師", *now, *block]
    cells = [(1, i, 0, v) for i, v in enumerate(values)] + [(1, i, 1, label) for i, label in enumerate(labels)]
    df = spark.createDataFrame(cells, "race_id long, row_ix int, col_ix int, text string")
    card = normalize.split_runs(normalize.reshape_vertical_card(df, ["馬番", "性齢", "調教師"]).withColumn("race_date", F.lit("2025-08-30").cast("date")), "race_date")
    bronze = card.withColumns({"URLコード": F.lit("2505040611")})
    row = normalize.normalize_entries(bronze)[0].first()
    assert (row["num"], row["sex"], row["age"], row["finish"], row["body_weight"], row["weight_delta"], row["style_now"]) == (1, "牡", 3.0, 1, 482.0, 2.0, 4.0)
    run = row["past"][0]
    assert (run["venue"], run["weather"], run["days"], run["surface"], run["distance"], run["going"]) == (5.0, "晴", 28.0, "芝", 2000.0, 2.0)
    assert (run["carried"], run["heads"], run["num"], run["popularity"], run["finish"], run["speed"], run["class_level"]) == (57.0, 15.0, 4.0, 13.0, 2.0, 88.0, 7.0)
    assert run["passing"] == [1, 2, 3, 4] and run["margin"] == 0.4 and run["last3f_rank"] == 3.0 and len(row["past"]) == 5


def test_card_plans_agree(spark, low_limit):
    """Both plans of the vertical card: repeated labels, short lines, a line without a label and a line of the entrant names."""
    texts = {0: ["1", "2", "3", "馬番"], 1: ["a", "b", "c", "馬名"], 2: ["o1", "o2", "o3", "備 考"], 3: ["p1", None, "備考"], 4: ["x", "y", "z"], 5: ["t1", "t2", "t3", "調教師"],
             6: ["f1", "f2", "f3", "?"], 7: ["q1", "備考"], 8: ["z1", "z2", "z3", None]}
    cells = [(race, i, j, x) for race in (1, 2) for i, line in texts.items() for j, x in enumerate(line)]
    df = spark.createDataFrame(cells, "race_id long, row_ix int, col_ix int, text string")
    one, many = (normalize.reshape_vertical_card(df.filter(f"race_id <= {most}"), ["馬番", "備考", "調教師"], hot) for most, hot in ((2, Hot(("race_id",))), (2, None)))
    assert find_hot(df, "race_id").table is not None
    seen = [sorted((r["race_id"], r["col_ix"], r["馬番"], r["備考"], r["調教師"], r["着順"]) for r in part.collect()) for part in (one, many)]
    assert seen[0] == seen[1] == [(race, *rest) for race in (1, 2) for rest in ((0, "1", "o1", "t1", "f1"), (1, "2", "o2", "t2", "f2"), (2, "3", "o3", "t3", "f3"))]


def test_card_sorts_no_cells(spark, sf):
    """Whole cards are reshaped where they are: the only shuffle is that of the entrants."""
    from furlong.catalog import source_queries

    plan = source_queries.nj33(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "PivotFirst" not in plan


def test_files_are_put_by_tasks(spark, tmp_path, monkeypatch):
    """No row passes through the driver; a path may be a URI."""
    from pyspark.sql import DataFrame

    from furlong.catalog import source_queries

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("rows in the driver"))
    rows = spark.range(300).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("東"), F.col("id").cast("string")).alias("text"))
    for folder in (str(tmp_path / "a"), f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        source_queries.put_files(spark, folder, rows)
    for one in "abc":
        assert {f.name: f.read_text(encoding="utf-8") for f in (tmp_path / one).iterdir()} == {f"f{i}.txt": f"東{i}" for i in range(300)}


def test_plain_pages_read_as_the_parser_reads(spark):
    """A leading comment sends a page through the parser; without one plain pages take the shorter way, with the same cells."""
    odd = ['<TABLE class="a b"><tr class=x><td>1</td><td CLASS="y">2<br/>3', "<table><tr><td>a &amp; b<td>c</table>", '<table><tr><td title="1>2">x</td></tr></table> < y', "<table><tr><td>a<p>b</p>c</td></tr></table>tail"]
    nested = '<h4>h <b>i</b></h4><table class="c1"><caption>1<img src="/p.png"/></caption><tr class="r"><td>a<table><tr><td>b</td></tr></table></td><th>c<ul><li>1</li><li>2</li></ul></th></tr></table>'
    shown = [*odd, nested, PAYOUT_PAGE, "", "no table"]
    html = spark.createDataFrame([(2 * i + k, before + page) for i, page in enumerate(shown) for k, before in enumerate(("", "<!-- -->"))], "page_id long, html string")
    cells = [tuple(r) for r in pages.extract_cells(html).collect()]
    short, long = (sorted((c[0] // 2, *map(repr, c[1:])) for c in cells if c[0] % 2 == k) for k in (0, 1))
    assert short == long and len(short) > 20


def test_quotes_from_rows_need_no_shuffle(spark):
    html = '<table class="wide"><caption>1</caption><tr><th>2</th><td>1.5-2.5</td></tr><tr><th>3</th><td></td></tr></table><table class="umaren"><caption>4</caption><tr><th>5</th><td>7.5</td></tr></table>'
    listed = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows, cells = pages.quotes_from_rows(pages.extract_rows(listed)), pages.quotes_from_cells(pages.extract_cells(listed))
    assert sorted(rows.collect()) == sorted(cells.collect()) and rows.count() == 2
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_missing_columns(spark, tmp_path):
    write(tmp_path, "pred_1.csv", "馬番,1着確率\n1,0.5\n")
    with pytest.raises(ValueError):
        files.read_predictions(spark, str(tmp_path))


@pytest.mark.parametrize("name", ["sc03_read_quotes", "sk02_write_quotes"])
def test_snapshots_are_written_without_a_checkpoint(spark, sf, monkeypatch, name):
    from furlong import catalog
    from furlong.catalog import views

    def never(df):
        raise AssertionError("the quotes are written once, as the snapshot")

    monkeypatch.setattr(views, "cut", never)
    assert catalog.load()[0][name](spark, sf).count() > 0
