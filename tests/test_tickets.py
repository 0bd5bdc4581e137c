"""Ticket rules, settlement figures and grids."""

import math

import pytest
from pyspark.sql import functions as F

from furlong.functions import fixed
from furlong.operators import evaluate, grid, ledger, settle, tickets as tk
from furlong.operators.groups import Hot

HOT = Hot(("race_id",))


def entrants(spark, p, p2=0.5, p3=0.75, frames=None, race=1):
    rows = [(race, i + 1, (frames or range(1, len(p) + 1))[i], float(v), float(p2), float(p3)) for i, v in enumerate(p)]
    return spark.createDataFrame(rows, "race_id long, num int, frame int, p1 double, p2 double, p3 double")


def quotes(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "race_id long, kind string, legs array<int>, odds_lo double")


def test_frame_tickets(spark):
    found = tk.propose(entrants(spark, [0.25] * 4, frames=[1, 1, 2, 3]), quotes(spark, ("frame", [1, 1], 10.0), ("frame", [1, 2], 10.0), ("frame", [2, 3], 10.0)), HOT, 0)
    assert {tuple(r["legs"]): round(r["chance"], 4) for r in found.collect()} == {(1, 1): 0.1667, (1, 2): 0.3333, (2, 3): 0.1667}


def test_independent_method(spark):
    rows = entrants(spark, [0.4, 0.3, 0.2, 0.1])
    found = tk.propose(rows, quotes(spark, ("exacta", [1, 2], 10.0), ("frame", [1, 2], 10.0)), HOT, 0, method="independent")
    assert {r["kind"]: r["chance"] for r in found.collect()} == {"exacta": pytest.approx(0.2), "frame": pytest.approx(0.25)}


def test_place_pays_by_field_size(spark):
    for field, want in ((7, 0.4), (8, 0.7)):
        rows = entrants(spark, [0.4] + [0.1] * (field - 1)).withColumns({"p2": F.lit(0.4), "p3": F.lit(0.7)})
        found = tk.propose(rows, quotes(spark, ("place", [1], 10.0)), HOT, 0).collect()
        assert [r["chance"] for r in found] == [want]
    rows = entrants(spark, [0.4] + [0.1] * 6).withColumns({"p2": F.lit(0.05), "p3": F.lit(0.9)})
    assert tk.propose(rows, quotes(spark, ("place", [1], 10.0)), HOT, 0).isEmpty()


def test_unusable_quotes(spark):
    rows = entrants(spark, [0.5, 0.5])
    bad = [("win", [1], v) for v in (math.nan, math.inf, -math.inf, -1.0, 0.0, None)]
    assert tk.propose(rows, quotes(spark, *bad), HOT, 0).isEmpty()
    repeated = [("quinella", [1, 1], 10.0), ("wide", [1, 1], 10.0), ("exacta", [1, 1], 10.0), ("trio", [1, 2, 1], 10.0), ("trifecta", [1, 2, 1], 10.0), ("win", [9], 5.0)]
    assert tk.propose(entrants(spark, [0.4, 0.3, 0.3]), quotes(spark, *repeated), HOT, 0).isEmpty()


def test_rule_bounds_are_inclusive_and_unrounded(spark):
    df = spark.createDataFrame([("quinella", 0.5, o) for o in (2.3992, 2.4, 2.4008)] + [("quinella", 0.15, 20.0), ("quinella", 0.1499, 20.0), ("win", 0.5, 4.0)], "kind string, chance double, odds_lo double")
    kept = [r["odds_lo"] for r in tk.by_rules(tk.valid(df, 1.0)).orderBy("odds_lo").collect()]
    assert kept == [2.4, 2.4008, 20.0]
    edges = [(k, c, v) for k, (c, lo, hi) in fixed.TICKET_RULES.items() for v in (lo, hi if hi < math.inf else 1e6)]
    df = spark.createDataFrame([(k, c, v, v / c) for k, c, v in edges], "kind string, chance double, value double, odds_lo double")
    assert tk.by_rules(df).count() == len(edges)


def payout_rows(spark):
    rows = [("win", 0, [2], 530), ("place", 0, [2], 160), ("place", 1, [1], 520), ("place", 2, [14], 140), ("frame", 0, [1, 2], 7440), ("quinella", 0, [1, 2], 7210),
            ("wide", 0, [1, 2], 1680), ("wide", 1, [2, 14], 400), ("wide", 2, [1, 14], 1500), ("exacta", 0, [2, 1], 14150), ("trio", 0, [1, 2, 14], 5840), ("trifecta", 0, [2, 1, 14], 59180)]
    return spark.createDataFrame([(1, *r) for r in rows], "race_id long, kind string, seq int, legs array<int>, per100 long")


def test_settlement_figures(spark):
    bets = spark.createDataFrame([(1, "quinella", [1, 2]), (1, "win", [1]), (1, "trifecta", [2, 1, 14]), (1, "exacta", [1, 2])], "race_id long, kind string, legs array<int>")
    out = settle.settle(bets, payout_rows(spark), HOT)
    total = out.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("ret") > 0).alias("hits"), F.sum("ret").alias("ret")).first()
    assert (total["points"], total["hits"], total["ret"]) == (4, 2, 66390)


def test_pending_and_first_match(spark):
    paid = payout_rows(spark).filter("kind <> 'win'").unionByName(spark.createDataFrame([(1, "quinella", 1, [1, 2], 1)], payout_rows(spark).schema))
    bets = spark.createDataFrame([(1, "quinella", [1, 2]), (1, "win", [2]), (2, "win", [2]), (1, "wide", [3, 4])], "race_id long, kind string, legs array<int>")
    got = {(r["race_id"], r["kind"], tuple(r["legs"])): r["ret"] for r in settle.settle(bets, paid, HOT, 250).collect()}
    assert got == {(1, "quinella", (1, 2)): 18025, (1, "win", (2,)): None, (2, "win", (2,)): None, (1, "wide", (3, 4)): 0}


@pytest.mark.parametrize("starters, number, hit", [(7, 2, True), (7, 3, False), (8, 3, True), (8, 4, False)])
def test_place_hits(spark, starters, number, hit):
    rows = spark.createDataFrame([(1, i, i, i) for i in range(1, starters + 1)], "race_id long, num int, frame int, finish int")
    bets = spark.createDataFrame([(1, "place", [number])], "race_id long, kind string, legs array<int>")
    assert settle.judge(bets, rows, HOT).first()["hit"] is hit


def test_scratched_starters_and_dead_heats(spark):
    rows = spark.createDataFrame([(1, i, 1, i if i < 8 else None) for i in range(1, 9)], "race_id long, num int, frame int, finish int")
    bets = spark.createDataFrame([(1, "place", [3]), (2, "win", [1]), (3, "win", [1])], "race_id long, kind string, legs array<int>")
    few = spark.createDataFrame([(3, 1, 1, 1), (3, 2, 1, 2)], rows.schema)
    got = {r["race_id"]: r["hit"] for r in settle.judge(bets, rows.unionByName(few), HOT).collect()}
    assert got == {1: True, 2: None, 3: None}
    level = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 2, 1), (1, 3, 3, 3), (1, 4, None, 4)], rows.schema)
    bets = spark.createDataFrame([(1, "exacta", [1, 2]), (1, "exacta", [2, 1]), (1, "frame", [1, 2]), (1, "wide", [1, 3]), (1, "wide", [3, 3])], "race_id long, kind string, legs array<int>")
    got = {(r["kind"], tuple(r["legs"])): r["hit"] for r in settle.judge(bets, level, HOT).collect()}
    assert got == {("exacta", (1, 2)): True, ("exacta", (2, 1)): False, ("frame", (1, 2)): True, ("wide", (1, 3)): True, ("wide", (3, 3)): False}


def test_grid_equals_masks(spark):
    rows = [(fixed.KINDS[i % 8], i % 14, i % 3 == 0, 2.0 + i % 7, 0.1 + (i * 37 % 60) / 100, 1.0 + (i * 13 % 400) / 10) for i in range(400)]
    df = spark.createDataFrame(rows, "kind string, race_no int, hit boolean, odds_lo double, chance double, value double")
    got = {(r["level"], r["min_chance"], r["min_value"], r["kind"], r["race_no"]): (r["points"], r["hits"], r["ret"]) for r in grid.threshold_grid(df).collect()}
    want = {}
    for mp in fixed.CHANCE_GRID:
        for mv in fixed.VALUE_GRID:
            for k, n, hit, odds, chance, value in rows:
                if chance >= mp and value >= mv:
                    inside = [("all", None, None), ("kind", k, None)] + ([("race_no", None, n), ("both", k, n)] if 1 <= n <= 12 else [])
                    for level, kk, nn in inside:
                        p, h, m = want.get((level, mp, mv, kk, nn), (0, 0, 0.0))
                        want[level, mp, mv, kk, nn] = (p + 1, h + hit, m + (odds * 100 if hit else 0))
    assert got == {k: (p, h, int(m)) for k, (p, h, m) in want.items()}


def test_ledger_filters(spark):
    df = spark.createDataFrame([(1, "bought", 300), (2, "bought", None), (3, "notified", None)], "id int, source string, unit int")
    assert [r["stake"] for r in ledger.in_mode(df, "actual").collect()] == [300]
    assert [r["stake"] for r in ledger.in_mode(df, "simulation", 500).collect()] == [500]
    for mode, stake in (("other", 100), ("simulation", 50), ("simulation", 150), ("simulation", 2_000_000)):
        with pytest.raises(ValueError):
            ledger.in_mode(df, mode, stake)
    with pytest.raises(ValueError):
        ledger.in_scope(df, first="2024-02-01", last="2024-01-01")


def test_ordinary_contests_are_priced_in_one_pass(spark, monkeypatch):
    """Nothing is written in between, quotes are joined once, and wide fields or many quotes give the same chances."""
    rows = entrants(spark, [0.4, 0.3, 0.2, 0.1], frames=[1, 1, 2, 2])
    asked = quotes(
        spark, ("win", [1], 5.0), ("place", [2], 5.0), ("frame", [1, 1], 5.0), ("frame", [1, 2], 5.0), ("quinella", [1, 2], 5.0), ("wide", [1, 3], 5.0),
        ("exacta", [2, 1], 5.0), ("trio", [1, 2, 3], 9.0), ("trifecta", [2, 1, 3], 9.0), ("win", [1, 2], 5.0), ("exacta", [1, 1], 5.0), ("trio", [1, 2], 5.0))
    known = Hot(("race_id",), spark.createDataFrame([(1,)], "race_id long"))
    apart = {(r["kind"], *r["legs"]): r["chance"] for r in tk.priced(rows, asked, HOT, many=known).collect()}
    monkeypatch.setattr(tk, "cut", lambda df: pytest.fail("written in between"))
    found = tk.priced(rows, asked, HOT)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert len(apart) == 9 and {(r["kind"], *r["legs"]): r["chance"] for r in found.collect()} == pytest.approx(apart)


def test_combinations_are_compiled(spark):
    """Chances inside a generator with a lambda were interpreted row by row."""
    rows = entrants(spark, [0.4, 0.3, 0.2, 0.1]).withColumns({"heads": F.lit(4).cast("long"), "finish": F.col("num")})
    found = evaluate.combinations(rows, HOT)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    counts = {r["kind"]: (r["n"], r["hits"]) for r in found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).collect()}
    assert counts == {"quinella": (6, 1), "wide": (6, 3), "exacta": (12, 1), "trio": (4, 1), "trifecta": (24, 1)}


@pytest.fixture
def small_tables(spark, tmp_path, monkeypatch):
    """A folder with entrants only: contests of one to nine, with ties, and one without an id."""
    from furlong.catalog import views

    rows = [(race or None, n + 1, n, 1, None, float(n * 7 % 5), 20000.0 * (n * race % 3), 0.1, "A") for race in range(10) for n in range(race or 2)]
    spark.createDataFrame(rows, """l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double,
        l_extendedprice double, l_discount double, l_returnflag string""").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(views, "_profiles", {})
    return str(tmp_path)


def test_independent_chances_are_not_written_in_between(spark, small_tables, monkeypatch):
    """Quotes are many times their entrants: they are priced where they are made, and give the rows they gave when they were written first."""
    from furlong.catalog import chance_queries, views

    shown = lambda df: sorted(map(repr, df.collect()))
    entries, hot = views.scored(spark, small_tables), views.hot_races(spark, small_tables)
    found = tk.priced(entries, views.quoted(spark, small_tables), hot, "independent", many=hot)
    want = shown(found.select("race_id", "kind", views.leg_string().alias("legs"), views.r6("chance", 8).alias("chance")))
    monkeypatch.setattr(views, "cut", lambda df: pytest.fail("written in between"))
    assert shown(chance_queries.pl08(spark, small_tables)) == want and len(want) > 50


def test_combinations_are_not_written_in_between(spark, small_tables, monkeypatch):
    """All tickets of pairs and triples among the best six of every contest, without a checkpoint that pairs and triples share."""
    from collections import Counter

    from furlong.catalog import chance_queries

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.checkpoint", lambda *_: pytest.fail("written in between"))
    got = Counter((r["race_id"], r["kind"]) for r in chance_queries.jn06(spark, small_tables).collect())
    want = {}
    for race in range(3, 10):
        n = min(race, 6)
        pairs, triples = n * (n - 1) // 2, n * (n - 1) * (n - 2) // 6
        want |= {(race, "quinella"): pairs, (race, "wide"): pairs, (race, "exacta"): 2 * pairs, (race, "trio"): triples, (race, "trifecta"): 6 * triples}
    assert got == want
