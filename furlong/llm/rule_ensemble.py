"""Quality by a sparse ensemble of rules.

Every text has a row of statistics.  A forest of shallow trees is grown on labelled rows; each path from a root to an
inner node or leaf is a rule, a conjunction of bounds on statistics.  A logistic model with an L1 penalty (lasso) keeps the few
rules that matter, and rules and weights become one Spark column expression over the statistics, so a score is
plain arithmetic in the scan of the statistics table and can be read by people.

Statistics are computed once, in one pass over whole texts, and stored; trees and weights use at most ``sample`` labelled rows
(numbers only), the ones with the smallest hash of their id.  Grown trees give the same rules again because the
forest's seed is fixed and its input is ordered.

Defined results: null and empty texts have statistics 0 and a score like any other; without labels of both kinds all scores
are the share of label 1, or 0.5 without any label; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.text_stats import STATISTICS, Words, statistics
from furlong.llm.textblock import blocks

TREES = 24
DEPTH = 3
SAMPLE = 20_000
PENALTY = 0.001
SEED = 7


@dataclass(frozen=True)
class Rule:
    """All bounds hold: (statistic, above the bound?, bound)."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        parts = [F.col(name) > F.lit(cut) if above else F.col(name) <= F.lit(cut) for name, above, cut in self.bounds]
        return reduce(lambda a, b: a & b, parts).cast("double")


@dataclass
class Ensemble:
    base: float
    weights: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """The compiled ensemble: a chance between 0 and 1 over the columns ``STATISTICS``."""
        logit = reduce(lambda a, b: a + b, [F.lit(w) * rule.column() for rule, w in self.weights], F.lit(self.base))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the columns ``STATISTICS``) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks(batch, "text"):
                found = statistics(Words(block))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(found[c]) for c in STATISTICS]], ["doc_id", *STATISTICS])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{c} double" for c in STATISTICS]]))


def paths(description: str) -> list[Rule]:
    """The rules of a forest's description: one for each branch of each tree, written as indented If and Else lines."""
    rules: dict[Rule, None] = {}
    stack: list[tuple[int, tuple[str, bool, float]]] = []
    for line in description.splitlines():
        at = len(line) - len(line.lstrip())
        if line.strip().startswith("Tree"):
            stack = []
        found = re.search(r"(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            while stack and stack[-1][0] >= at:
                stack.pop()
            stack.append((at, (STATISTICS[int(found[1])], found[2] == ">", float(found[3]))))
            rules[tightest([b for _, b in stack])] = None
    return list(rules)


def tightest(bounds: list[tuple[str, bool, float]]) -> Rule:
    """Of several bounds of one statistic on one side only the tightest stays."""
    kept: dict[tuple[str, bool], float] = {}
    for name, above, cut in bounds:
        old = kept.get((name, above))
        kept[name, above] = cut if old is None else (max if above else min)(old, cut)
    return Rule(tuple(sorted((name, above, cut) for (name, above), cut in kept.items())))


def fit(stats: DataFrame, labels: DataFrame, target: str, learn: Column, sample: int = SAMPLE) -> Ensemble:
    """Learns from at most ``sample`` labelled rows that ``learn`` (a column on doc_id) allows."""
    labelled = labels.filter(learn & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).cast("double").alias("_label"))
    ids = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = F.min(F.struct("_label", *STATISTICS)).alias("_row")  # of several rows of one id always the same
    rows = stats.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "_row.*").orderBy("doc_id").coalesce(1).cache()  # at most ``sample`` rows of numbers
    shares = rows.agg(F.count("*").alias("n"), F.avg("_label").alias("share")).first()
    if not shares["n"]:
        return Ensemble(0.0)
    if shares["share"] in (0.0, 1.0):
        return Ensemble(40.0 if shares["share"] else -40.0)
    grown = RandomForestClassifier(
        featuresCol="_x", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", subsamplingRate=0.7,
    ).fit(VectorAssembler(inputCols=STATISTICS, outputCol="_x").transform(rows))
    rules = paths(grown.toDebugString)
    columns = [f"_rule{k}" for k in range(len(rules))]
    held = VectorAssembler(inputCols=columns, outputCol="_r").transform(rows.select("_label", *[r.column().alias(c) for r, c in zip(rules, columns, strict=True)]))
    lasso = LogisticRegression(featuresCol="_r", labelCol="_label", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(held)
    rows.unpersist()
    return Ensemble(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w])
