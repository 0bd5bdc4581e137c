"""Every operator on odd rows and on an empty table: a row for each row, no crash, and the results the doc strings define."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from furlong.llm import best_fit, line_dedup, mix_histogram, prefix_hash, rule_ensemble, simhash_trie, suffix_groups, surrogates, target_ratio, toxicity


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def toxic(docs, labels):
    return toxicity.score(docs, toxicity.train(docs, labels, "toxic", F.lit(True)), ["doc_id"])


def quality(docs, labels):
    stats = rule_ensemble.with_statistics(docs)
    return stats.select("doc_id", rule_ensemble.fit(stats, labels, "quality", F.lit(True)).score().alias("score"))


def ratio(docs, labels):
    return target_ratio.judge(docs, target_ratio.count(docs, labels), ["doc_id"])


PER_ROW = {
    "toxicity": toxic, "surrogates": lambda d, _: surrogates.with_surrogates(d), "lines": lambda d, _: line_dedup.without_repeats(d), "rules": quality,
    "strings": lambda d, _: suffix_groups.without_repeats(d), "ratio": ratio, "prints": lambda d, _: prefix_hash.compare(d),
    "simhash": lambda d, _: simhash_trie.groups(d), "mix": lambda d, _: mix_histogram.mix(d.select("doc_id", "text", "source")),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_row_for_each_row(odd, no_labels, name):
    got = collections.Counter(r["doc_id"] for r in PER_ROW[name](odd, no_labels).collect())
    assert got == collections.Counter(r["doc_id"] for r in odd.collect())


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(odd, no_labels, name):
    assert PER_ROW[name](odd.limit(0), no_labels).count() == 0


def test_packing_of_odd_rows(odd):
    rows = best_fit.pack(odd).collect()
    assert collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in odd.collect())
    assert {(r["length"], r["start"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(1, 0)}
    assert best_fit.pack(odd.limit(0)).count() == 0


def test_stages_keep_the_columns(spark, odd, tmp_path):
    """Own columns pass through all stages unchanged, whatever their names."""
    spark.createDataFrame([(1, 1, 0), (4, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
        assert {(r["score"], r["_key"], r["h"]) for r in docs.collect()} <= {(0.25, 7, "x")}, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert "sequence_id" in last.columns


def test_stages_on_an_empty_table(spark, odd, no_labels, tmp_path):
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_null_ids_have_targets(spark):
    """Texts without ids are told apart: a source of them comes as near its target as any other."""
    rows = [(None, f"w{k} " * 20, s) for s in "ab" for k in range(500)] + [(3, f"v{k} " * 20, "c") for k in range(300)]
    found = mix_histogram.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(
        F.sum(F.col("_copies") * F.col("_size")).alias("taken"), F.first("_target").alias("target")).collect()
    assert len(found) == 3 and all(abs(r["taken"] - r["target"]) <= 10 for r in found)


def test_texts_without_ids_keep_their_own_bytes(spark):
    """Two texts whose 32-bit hashes are equal, one of them a copy of a third: each loses its own bytes only."""
    made = spark.range(300_000).select(F.concat(F.lit("some words "), F.col("id"), F.lit(" "), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    pair = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter(F.size("t") > 1).first()["t"][:2]
    tail = " " + "tail of the text, " * 12
    one, other = pair[0] + tail, pair[1]
    rows = [(None, one), (None, one + " and more"), (None, other), (5, other[:30]), (5, one[20:])]
    got = collections.Counter((r["n_bytes"], r["n_removed"]) for r in suffix_groups.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = collections.Counter()
    texts = [t.encode() for _, t in rows]
    seen = collections.Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        gone = {j for i in range(len(t) - 199) if seen[t[i:i + 200]] > 1 for j in range(i, i + 200)}
        want[len(t), len(gone)] += 1
    assert got == want
