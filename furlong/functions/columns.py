"""Small column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """PJ06: NULL unless the divisor is positive."""
    return F.when(b > 0, a / b)


def match_flag(a: Column, b: Column) -> Column:
    """PJ04: 1 or 0, NULL if either side is."""
    return (a == b).cast("double")


def mean_of(values: list[Column]) -> Column:
    """Mean of the values that are there."""
    return safe_ratio(sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)), count_of(values))


def count_of(values: list[Column]) -> Column:
    return sum((v.isNotNull().cast("int") for v in values), F.lit(0))


def max_of(values: list[Column]) -> Column:
    return F.greatest(*values)


def min_of(values: list[Column]) -> Column:
    return F.least(*values)


def spread_of(values: list[Column]) -> Column:
    """Sample standard deviation; needs two values."""
    mean, n = mean_of(values), count_of(values)
    squares = sum((F.coalesce(F.pow(v - mean, 2), F.lit(0.0)) for v in values), F.lit(0.0))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def logloss(chance: Column, hit: Column) -> Column:
    """AG12 per row; the mean over rows is the loss."""
    p = F.least(F.greatest(chance, F.lit(1e-9)), F.lit(1 - 1e-9))
    return -(hit * F.log(p) + (1 - hit) * F.log(1 - p))


def brier(chance: Column, hit: Column) -> Column:
    """AG12 per row."""
    return F.pow(chance - hit, 2)


def bin_of(value: Column, edges: list[float]) -> Column:
    """AG13: right-closed bin, the lowest edge belongs to the first bin; outside is NULL."""
    inside = value.between(edges[0], edges[-1])
    above = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < value))
    return F.when(inside, F.greatest(above, F.lit(1)))


def linear_edges(n: int) -> list[float]:
    return [i / n for i in range(n)] + [1.0]


def cell_of(value: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds the value reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= value))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < math.inf)


def conform(df: DataFrame, schema) -> DataFrame:
    """PJ01: exactly the columns of the schema, missing ones NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """PJ03: drop a family of columns by name pattern."""
    import re

    return df.select([c for c in df.columns if not re.search(pattern, c)])


def drop_positions(df: DataFrame, first: int, last: int) -> DataFrame:
    """NJ34: drop the columns at the positions first..last, counted from zero."""
    return df.drop(*df.columns[first:last + 1])


def rename_after(df: DataFrame, marker: str, names: list[str]) -> DataFrame:
    """PJ02: the columns right after the marker get the given names."""
    if marker not in df.columns:
        return df
    at = df.columns.index(marker) + 1
    return df.withColumnsRenamed(dict(zip(df.columns[at:at + len(names)], names)))


def once(value: Column) -> Column:
    """Evaluate a long expression once per row: later filters read the result instead of repeating it."""
    return F.explode(F.array(value))
