"""Group-relative work that stays whole when one group holds a large share of all rows.

A pipeline is written once against the small interface below and may run in these plans:

* ``Windowed``   - groups of ordinary size: window functions, all passes share one exchange;
* ``Counted``    - the same for groups of at most ``FIELD`` rows: ranks by counting in the group's values, without a sort;
* ``Aggregated`` - the few large groups: partial aggregates before the shuffle, the group
  results joined back by salted keys, order statistics by range partitioning.

``by_group`` sends every row through exactly one of them and unions the results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.session import cut, scratch_path

HOT_ROWS = 1_000_000
#: Rows of a group up to which counting in its values is cheaper than one more sort of wide rows.
FIELD = 64
#: Tasks over which the rows of a large group are dealt when they meet a table with one row per key.
SALTS = 32
HOT_ROWS_KEY = "spark.furlong.hotRows"


@dataclass(frozen=True)
class Hot:
    """The keys of all groups beyond the row limit, a table in the shared folder, or no table at all."""

    keys: tuple[str, ...]
    table: DataFrame | None = None

    def cold(self, df: DataFrame) -> DataFrame:
        return df if self.table is None else self._match(df, "left_anti")

    def rows(self, df: DataFrame) -> DataFrame:
        return df.limit(0) if self.table is None else self._match(df, "left_semi")

    def _match(self, df: DataFrame, how: str) -> DataFrame:
        return spread_join(df, self.table.select(*self.keys), self.keys, how)


def spread_join(rows: DataFrame, table: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Null-safe join of many rows with a small table of one row per key: the rows of a key are dealt over ``SALTS`` tasks.

    Spark broadcasts the table where its size is known to be under the session's threshold; nothing here asks for it.
    """
    hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind]  # maps have no hash
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))
    named = table.withColumnsRenamed({k: f"_key_{k}" for k in keys}).withColumn("_key_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_salt") == F.col("_key_salt"))
    return salted.join(named, same, how).drop("_salt", "_key_salt", *[f"_key_{k}" for k in keys])


def find_hot(df: DataFrame, *keys: str, rows: int | None = None) -> Hot:
    """One pass over the key columns, counted before the shuffle."""
    limit = rows or int(df.sparkSession.conf.get(HOT_ROWS_KEY, str(HOT_ROWS)))
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit).select(*keys)
    path = scratch_path(df.sparkSession, "hot")
    large.write.parquet(path)
    kept = df.sparkSession.read.schema(large.schema).parquet(path)
    return Hot(tuple(keys)) if kept.isEmpty() else Hot(tuple(keys), kept)


class Windowed:
    """Plan for groups of ordinary size."""

    def __init__(self, keys: tuple[str, ...]):
        self.keys = keys

    def add(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        whole = Window.partitionBy(*self.keys)
        return df.withColumns({name: agg.over(whole) for name, agg in aggregates.items()})

    def number(self, df: DataFrame, name: str, *order: Column) -> DataFrame:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order)))

    def running(self, df: DataFrame, name: str, value: Column, how: str, *order: Column) -> DataFrame:
        """Running ``sum`` or ``max`` of a value up to the row."""
        upto = Window.partitionBy(*self.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, (F.sum(value) if how == "sum" else F.max(value)).over(upto))

    def past(self, df: DataFrame, name: str, fields: list[str], depth: int, *order: Column) -> DataFrame:
        """The ``depth`` rows before this one, latest first."""
        before = Window.partitionBy(*self.keys).orderBy(*order).rowsBetween(-depth, -1)
        return df.withColumn(name, F.reverse(F.collect_list(F.struct(*fields)).over(before)))

    def rank(self, df: DataFrame, name: str, value: str) -> DataFrame:
        """Lowest rank of the value in descending order; NULL has no rank."""
        ordered = Window.partitionBy(*self.keys).orderBy(F.col(value).desc_nulls_last())
        return df.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(ordered)))

    def ties(self, df: DataFrame, name: str, value: str) -> DataFrame:
        peers = Window.partitionBy(*self.keys).orderBy(F.col(value).desc_nulls_last()).rangeBetween(
            Window.currentRow, Window.currentRow)  # the order of rank, so both use one sort
        return df.withColumn(name, F.count(value).over(peers))

    def average_ranks(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        """Descending ranks, one column ``names[value]`` per value; equal values share the mean of their places, NULL has no rank."""
        return _ranks_by_order(self, df, names)

    def first(self, df: DataFrame, n: int, *order: Column) -> DataFrame:
        return self.number(df, "_place", *order).filter(F.col("_place") <= n).drop("_place")


class Counted(Windowed):
    """Plan for groups of at most ``FIELD`` rows."""

    def average_ranks(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        """A row's place is half, and half of each value equal to its own (itself included), and each greater value."""
        df = self.add(df, **{f"_all_{v}": F.collect_list(v) for v in names})

        def place(v: str) -> Column:
            own = F.col(v)
            step = lambda total, x: total + F.when(x > own, 1.0).when(x == own, 0.5).otherwise(0.0)
            return F.when(own.isNotNull(), F.aggregate(f"_all_{v}", F.lit(0.5), step))

        return df.withColumns({name: place(v) for v, name in names.items()}).drop(*[f"_all_{v}" for v in names])


class Aggregated:
    """Plan for the large groups; never brings a group together in one task."""

    def __init__(self, keys: tuple[str, ...]):
        self.keys = keys

    def add(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        stats = cut(df.groupBy(*self.keys).agg(*[agg.alias(name) for name, agg in aggregates.items()]))
        return _attach(df.drop(*aggregates), stats, self.keys)

    def running(self, df: DataFrame, name: str, value: Column, how: str, *order: Column) -> DataFrame:
        """Running total inside each range partition, plus the totals of the partitions before it."""
        combine = F.sum if how == "sum" else F.max
        parts = self._ranged(df.withColumn("_value", value), *order)
        upto = Window.partitionBy(*self.keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        totals = cut(parts.groupBy(*self.keys, "_part").agg(combine("_value").alias("_total")))
        earlier = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*self.keys, "_part", combine("_total").over(earlier).alias("_before"))
        placed = _attach(parts.withColumn("_local", combine("_value").over(upto)), before, (*self.keys, "_part"))
        if how == "sum":
            known = F.col("_local").isNotNull() | F.col("_before").isNotNull()
            result = F.when(known, F.coalesce("_local", F.lit(0)) + F.coalesce("_before", F.lit(0)))
        else:
            result = F.coalesce(F.greatest("_local", "_before"), F.col("_local"), F.col("_before"))
        return placed.withColumn(name, result).drop("_part", "_value", "_local", "_before")

    def number(self, df: DataFrame, name: str, *order: Column) -> DataFrame:
        placed = self.running(df, name, F.lit(1), "sum", *order)
        return placed.withColumn(name, F.col(name).cast("int"))

    def rank(self, df: DataFrame, name: str, value: str) -> DataFrame:
        counted = df.filter(F.col(value).isNotNull()).groupBy(*self.keys, value).agg(F.count(F.lit(1)).alias("_n"))
        upto = self.running(counted, "_upto", F.col("_n"), "sum", F.col(value).desc())
        ranks = upto.select(*self.keys, value, (F.col("_upto") - F.col("_n") + 1).cast("int").alias(name))
        return lookup(df, ranks, [*self.keys, value], find_hot(df, *self.keys, value))

    def past(self, df: DataFrame, name: str, fields: list[str], depth: int, *order: Column) -> DataFrame:
        placed = self.number(df, "_n", *order)
        row = F.struct(*fields)
        ahead = placed.select(*self.keys, row.alias("_row"), "_n", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("_lag"))
        seen = ahead.groupBy(*self.keys, (F.col("_n") + F.col("_lag")).alias("_n")).agg(
            F.array_sort(F.collect_list(F.struct("_lag", "_row"))).alias("_seen"))
        joined = placed.join(seen, [*self.keys, "_n"], "left")
        runs = F.coalesce(F.transform("_seen", lambda s: s["_row"]), F.array().cast(_array_of(df, fields)))
        return joined.withColumn(name, runs).drop("_n", "_seen")

    def ties(self, df: DataFrame, name: str, value: str) -> DataFrame:
        counted = df.groupBy(*self.keys, value).agg(F.count(value).alias(name))
        return lookup(df, counted, [*self.keys, value], find_hot(df, *self.keys, value))

    def average_ranks(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        return _ranks_by_order(self, df, names)

    def first(self, df: DataFrame, n: int, *order: Column) -> DataFrame:
        """Leaders of slices first, so the last step sees n rows per slice."""
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(1000)))
        leaders = Windowed((*self.keys, "_slice")).first(sliced, n, *order).drop("_slice")
        return Windowed(self.keys).first(leaders, n, *order)

    def _ranged(self, df: DataFrame, *order: Column) -> DataFrame:
        return cut(df.repartitionByRange(*[F.col(k) for k in self.keys], *order).withColumn("_part", F.spark_partition_id()))


Groups = Windowed | Aggregated
Pipeline = Callable[[DataFrame, Groups], DataFrame]


def by_group(df: DataFrame, hot: Hot, pipeline: Pipeline, wide: Hot | None = None) -> DataFrame:
    """Run a group pipeline over all rows, large groups in their own plan.

    ``wide`` are the groups beyond ``FIELD`` rows; where it is given, all other groups run in the plan ``Counted``.
    """
    usual = hot.cold(df)
    if wide is None:
        parts = [pipeline(usual, Windowed(hot.keys))]
    else:
        parts = [pipeline(wide.cold(usual), Counted(hot.keys))]
        if wide.table is not None:
            parts.append(pipeline(wide.rows(usual), Windowed(hot.keys)))
    if hot.table is not None:
        parts.append(pipeline(hot.rows(df), Aggregated(hot.keys)))
    return reduce(DataFrame.unionByName, parts)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot: Hot, how: str = "left") -> DataFrame:
    """Join rows to a table with one row per key; the rows of large keys are dealt over several tasks."""
    usual = hot.cold(rows).join(table, keys, how)
    if hot.table is None:
        return usual
    return usual.unionByName(spread_join(hot.rows(rows), hot.rows(table), tuple(keys), how))


def _ranks_by_order(g: Groups, df: DataFrame, names: dict[str, str]) -> DataFrame:
    for value, name in names.items():
        df = g.ties(g.rank(df, "_low", value), "_same", value)
        df = df.withColumn(name, F.col("_low") + (F.col("_same") - 1) / 2).drop("_low", "_same")
    return df


def _array_of(df: DataFrame, fields: list[str]) -> str:
    inner = ",".join(f"`{f}`:{df.schema[f].dataType.simpleString()}" for f in fields)
    return f"array<struct<{inner}>>"


def _attach(df: DataFrame, stats: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return spread_join(df, stats, keys, "inner")
