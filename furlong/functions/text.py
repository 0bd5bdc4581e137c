"""Text columns to typed columns.  Missing or unreadable text gives NULL unless a function says otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from furlong.functions import fixed
from furlong.functions.fixed import PATTERNS


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _ascii(c: Column | str) -> Column:
    """Full-width digits as ASCII, inside the JVM."""
    return F.translate(_c(c), "０１２３４５６７８９", "0123456789")


def part(c: Column | str, pattern: str, group: int = 1) -> Column:
    """One group of the first match; no match or an empty group is NULL."""
    return F.nullif(F.regexp_extract(_c(c), pattern, group), F.lit(""))


def mapped(c: Column, values: dict) -> Column:
    """Lookup in a fixed small table."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.element_at(F.create_map(*pairs), c)


def _nfkc_udf():
    def normalise(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    return F.pandas_udf(normalise, StringType())


def nfkc(c: Column, once: bool = False) -> Column:
    """Unicode NFKC in Arrow batches; Spark has no such function.  With ``once`` no filter or generator repeats it."""
    made = _nfkc_udf()
    return (made.asNondeterministic() if once else made)(c)


def text_norm(c: Column | str) -> Column:
    """NJ14: NFKC and trim, empty is NULL."""
    return F.nullif(F.trim(nfkc(_c(c))), F.lit(""))


def num(c: Column | str) -> Column:
    """NJ01: first number as double."""
    return part(_ascii(c), PATTERNS["number"], 0).cast("double")


def first_int(c: Column | str) -> Column:
    """NJ02: first run of digits."""
    return part(_ascii(c), PATTERNS["digits"]).cast("int")


def placing(c: Column | str) -> Column:
    """NJ02, anchored: '1着' is 1, any other text has no finish."""
    return part(_ascii(c), PATTERNS["placing"]).cast("int")


def carried(c: Column | str) -> Column:
    """NJ03: weight and allowance flag."""
    text = F.trim(_c(c))
    return F.struct(
        part(text, PATTERNS["decimal"]).try_cast("double").alias("value"),
        F.coalesce(text.rlike(PATTERNS["allowance"]), F.lit(False)).cast("int").alias("allowance"),
    )


def style4(c: Column | str) -> Column:
    """NJ04: four two-digit counts; short text is filled from the left, NULL is all zero."""
    digits = F.lpad(F.regexp_replace(F.coalesce(_ascii(c), F.lit("")), r"\D", ""), 8, "0")
    return F.array(*[F.substring(digits, i, 2).cast("int") for i in (1, 3, 5, 7)])


def career4(c: Column | str) -> Column:
    """NJ05: up to four counts, filled with zeros; NULL is all zero."""
    found = F.transform(F.regexp_extract_all(_ascii(c), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    zeros = F.array(*[F.lit(0)] * 4)
    return F.slice(F.concat(F.coalesce(found, zeros), zeros), 1, 4)


def passing4(c: Column | str) -> Column:
    """NJ06: as style4, but zero is NULL and NULL gives four NULLs."""
    return F.transform(style4(c), lambda x: F.when(_c(c).isNotNull() & (x != 0), x))


def place_code(c: Column | str) -> Column:
    """NJ07: venue from its short form, its name or a number."""
    text = text_norm(c)
    named = [F.when(text.startswith(name), F.lit(code)) for code, name in fixed.VENUE_NAMES.items()]
    return F.coalesce(*[code.cast("double") for code in (mapped(text, fixed.VENUE_SHORT), *named)], num(text))


def surface(c: Column | str) -> Column:
    """NJ08: first surface mark the text contains, else the text; NULL is 'NA'."""
    text = text_norm(c)
    marks = [F.when(text.contains(mark), F.lit(name)) for mark, name in fixed.SURFACE_MARKS.items()]
    return F.coalesce(*marks, text, F.lit(fixed.SURFACE_MISSING))


def style_level(c: Column | str) -> Column:
    """NJ09: running style by its first character."""
    return mapped(F.substring(text_norm(c), 1, 1), fixed.STYLE_LEVELS)


def going(c: Column | str) -> Column:
    """NJ10: going as a level."""
    return mapped(text_norm(c), fixed.GOING_LEVELS)


def race_class(c: Column | str) -> Column:
    """NJ11: class level; the first matching rule counts, no match is an open race."""
    text = F.coalesce(_c(c), F.lit(""))
    rules = [F.when(text.rlike("(?U)" + pattern), F.lit(name)) for pattern, name in fixed.CLASS_PATTERNS]
    levels = {name: float(i) for i, name in enumerate(fixed.CLASS_NAMES)}
    return mapped(F.coalesce(*rules, F.lit(fixed.CLASS_OTHER)), levels)


def dominant_style(c: Column | str) -> Column:
    """NJ12: most frequent style, the first of equals; no runs at all is 'unknown'."""
    counts = style4(c)
    best = F.array_position(counts, F.array_max(counts)).cast("int")
    names = F.array(*[F.lit(n) for n in fixed.STYLE_NAMES])
    return F.when(F.array_max(counts) == 0, F.lit(fixed.STYLE_UNKNOWN)).otherwise(F.element_at(names, best))


def band_of(header: str) -> tuple[int, int] | None:
    """NJ13: distance band a career column header names; schema information, so plain Python."""
    text = unicodedata.normalize("NFKC", header).strip()
    numbers = [int(n) for n in re.findall(PATTERNS["band_number"], text)]
    if len(numbers) > 1:
        return min(numbers), max(numbers)
    if numbers and re.search(PATTERNS["band_upper"], text):
        return 0, numbers[0]
    if numbers and re.search(PATTERNS["band_lower"], text):
        return numbers[0], 99999
    return None


def name_norm(c: Column | str) -> Column:
    """NJ15: entrant names in one spelling."""
    bars = F.translate(_c(c), fixed.NAME_BARS, fixed.NAME_LONG * len(fixed.NAME_BARS))
    text = F.regexp_replace(nfkc(bars), r"(?U)\s+", "")
    text = F.regexp_replace(text, PATTERNS["name_tag"], "")
    text = F.regexp_replace(text, PATTERNS["katakana_l"], fixed.NAME_LONG)
    return F.replace(text, F.lit(fixed.NAME_REPAIR[0]), F.lit(fixed.NAME_REPAIR[1]))


def course(c: Column | str) -> Column:
    """NJ16: surface, distance, going of 'ダ1800不'; other text is kept as surface."""
    text = F.trim(_c(c))
    fits = text.rlike(PATTERNS["course"])
    long_surface = {"芝": "芝", "ダ": "ダート", "障": "障", "ダート": "ダート"}
    long_going = {"良": "良", "稍重": "稍重", "稍": "稍重", "重": "重", "不良": "不良", "不": "不良"}
    return F.struct(
        F.when(fits, mapped(part(text, PATTERNS["course"], 1), long_surface)).otherwise(F.nullif(text, F.lit(""))).alias("surface"),
        part(text, PATTERNS["course"], 2).cast("int").alias("distance"),
        mapped(part(text, PATTERNS["course"], 3), long_going).alias("going"),
    )


def time_finish(c: Column | str) -> Column:
    """NJ17: clock text and finish of '1.53.4④'; abandoned runs keep their text and have no finish."""
    text = F.trim(_c(c))
    words = F.split(text, r"\s+")
    joined = F.regexp_replace(text, r"\s+", "")
    clock = part(joined, PATTERNS["clock"])
    after = F.regexp_extract(joined, PATTERNS["clock"] + "(.*)$", 2)
    spoken = F.size(words) > 1
    time = F.when(spoken, F.element_at(words, 1)).otherwise(F.coalesce(clock, joined))
    tail = F.when(spoken, F.array_join(F.slice(words, 2, F.size(words)), "")).otherwise(after)
    gone = text.rlike(PATTERNS["abandoned"])
    return F.struct(
        F.when(gone, text).otherwise(F.nullif(nfkc(time), F.lit(""))).alias("time"),
        F.when(~gone, part(nfkc(tail), r"([0-9]+)").cast("int")).alias("finish"),
    )


def days_since(race_date: Column | str, month_day: Column | str) -> Column:
    """NJ18: days from 'MM/DD' to the race; a later day belongs to the year before."""
    month = F.lpad(part(F.trim(_c(month_day)), PATTERNS["month_day"], 1), 2, "0")
    day = F.lpad(part(F.trim(_c(month_day)), PATTERNS["month_day"], 2), 2, "0")

    def on(year: Column) -> Column:
        written = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month, day)
        return F.when(month.isNotNull(), F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date"))

    same = on(F.year(race_date))
    past = F.when(same <= _c(race_date), same).when(same.isNotNull(), on(F.year(race_date) - 1))
    return F.datediff(_c(race_date), past)


def date_place_weather(c: Column | str) -> Column:
    """NJ19: '08/02中曇'; other text is kept as date."""
    text = F.trim(_c(c))
    pattern = PATTERNS["date_place_weather"]
    whole = F.when(text.rlike(pattern), part(text, pattern, 1)).otherwise(F.nullif(text, F.lit("")))
    return F.struct(whole.alias("date"), part(text, pattern, 2).alias("place"), part(text, pattern, 3).alias("weather"))


def name_trailing_number(c: Column | str) -> Column:
    """NJ20: 'J.コレ57'; text without a number is all name."""
    text = F.trim(_c(c))
    pattern = PATTERNS["name_number"]
    name = F.when(text.rlike(pattern), F.trim(part(text, pattern, 1))).otherwise(F.nullif(text, F.lit("")))
    return F.struct(name.alias("name"), part(text, pattern, 2).try_cast("double").alias("number"))


def three_ints(c: Column | str) -> Column:
    """NJ21: three runs of digits."""
    return F.struct(*[part(c, PATTERNS["three_ints"], i).cast("int").alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))])


def pace_style_time(c: Column | str) -> Column:
    """NJ22: 'M追36.1'."""
    text, pattern = F.trim(_c(c)), PATTERNS["pace_style_time"]
    return F.struct(
        part(text, pattern, 1).alias("pace"), part(text, pattern, 2).alias("style"),
        part(text, pattern, 3).try_cast("double").alias("time"),
    )


def text_paren(c: Column | str) -> Column:
    """NJ23: 'name(margin)'; text without brackets is all name."""
    text, pattern = F.trim(_c(c)), PATTERNS["text_paren"]
    name = F.when(text.rlike(pattern), F.nullif(F.trim(part(text, pattern, 1)), F.lit(""))).otherwise(F.nullif(text, F.lit("")))
    return F.struct(name.alias("text"), F.trim(part(text, pattern, 2)).alias("inside"))


def weight_delta_rank(c: Column | str) -> Column:
    """NJ24: '554(+4)1'; other text is kept as weight."""
    text, pattern = F.trim(_c(c)), PATTERNS["weight_delta_rank"]
    weight = F.when(text.rlike(pattern), F.trim(part(text, pattern, 1))).otherwise(F.nullif(text, F.lit("")))
    return F.struct(weight.alias("weight"), part(text, pattern, 2).alias("delta"), part(text, pattern, 3).alias("rank"))


def sex_age(c: Column | str) -> Column:
    """NJ25: '牡3'; other text is kept as sex."""
    text, pattern = F.trim(_c(c)), PATTERNS["sex_age"]
    sex = F.when(text.rlike(pattern), part(text, pattern, 1)).otherwise(F.nullif(text, F.lit("")))
    return F.struct(sex.alias("sex"), part(text, pattern, 2).cast("int").alias("age"))


def decode_race_id(c: Column | str) -> Column:
    """NJ26: the five two-digit fields of a ten-digit id; NULL fields for anything else."""
    text = F.trim(_c(c))
    good = text.rlike(r"^\d{10}$")
    cuts = [F.when(good, F.substring(text, i, 2)).cast("int") for i in (1, 3, 5, 7, 9)]
    return F.struct(
        (cuts[0] + 2000).alias("year"), cuts[1].alias("venue"), cuts[2].alias("meeting"), cuts[3].alias("day"),
        cuts[4].alias("race_no"),
        F.when(good, F.coalesce(mapped(cuts[1], fixed.VENUE_NAMES), F.concat(F.lit("競馬場"), F.substring(text, 3, 2)))).alias("venue_name"),
    )


def canonical_race_id(c: Column | str) -> Column:
    """NJ27: twelve digits, ten-digit ids get the century; ids out of range are NULL."""

    def wide(text: Column) -> Column:
        whole = F.when(F.substring(text, 11, 1).between("0", "9"), text).otherwise(F.concat(F.lit("20"), text))
        return F.when(text.rlike(r"^([0-9]{2})?[0-9]{2}(0[1-9]|10)(?!00)[0-9]{2}(?!00)[0-9]{2}(0[1-9]|1[0-2])$"), whole)

    return _let(F.trim(_c(c)), wide)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unprotect(c: Column | str) -> Column:
    """Text without the ="..." that keeps spreadsheets from reading it as a date."""
    return _let(F.trim(_c(c)), _bare)


def _bare(text: Column) -> Column:
    inner = F.trim(F.replace(text.substr(F.lit(3), F.length(text) - 3), F.lit('""'), F.lit('"')))
    return F.when(text.startswith('="') & text.endswith('"') & (F.length(text) >= 3), inner).otherwise(text)


def _runs(kind: Column, text: Column) -> Column:
    """The numbers of a bare text that has the form of its kind."""
    fits = F.lit(False)
    for pattern in dict.fromkeys(fixed.LEG_PATTERNS.values()):
        fits = fits | (kind.isin(*[name for name, p in fixed.LEG_PATTERNS.items() if p == pattern]) & text.rlike(pattern))
    single = F.array(F.regexp_extract(text, r"^(\d+)", 1))
    runs = F.when(kind.isin("win", "place"), single).otherwise(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)))
    return F.when(fits, runs.try_cast("array<int>"))


def _ordered(kind: Column, numbers: Column, sort: bool, strict: bool) -> Column:
    """No lambda, which would keep the row out of generated code: a number too large for an int is kept as NULL, and stands last."""
    beyond = F.lit(1 << 40)
    by_size = F.sort_array(F.array(*[F.coalesce(F.get(numbers, i).cast("long"), beyond) for i in range(3)]))
    placed = [F.nullif(F.get(by_size, i), beyond).cast("int") for i in range(3)]
    unordered = F.when(numbers.isNotNull(), F.slice(F.array(*placed), 1, F.size(numbers)))
    out = F.when(kind.isin(*fixed.UNORDERED_KINDS), unordered).otherwise(numbers) if sort or strict else numbers
    if not strict:
        return out
    most = F.when(kind == "frame", fixed.MAX_FRAME).otherwise(fixed.MAX_NUMBER)
    whole = F.array_contains(numbers, F.lit(0)).isNotNull()  # NULL where a number is
    good = whole & (F.size(F.array_distinct(numbers)) == F.size(numbers)) & (F.array_min(numbers) >= 1) & (F.array_max(numbers) <= most)
    return F.when(good, out)


def legs(kind: Column | str, c: Column | str, sort: bool = True, strict: bool = False) -> Column:
    """NJ28: the numbers of a ticket text.

    ``sort`` orders the legs of unordered kinds; ``strict`` also wants distinct numbers in range.
    """
    kind = _c(kind)
    return _let(_let(unprotect(c), lambda t: _runs(kind, t)), lambda n: _ordered(kind, n, sort, strict))


def with_legs(rows: DataFrame, name: str = "legs", kind: str = "kind", c: str = "text", sort: bool = True, strict: bool = False) -> DataFrame:
    """``legs`` of whole rows, step by step in generated code; a method of more than 8,000 bytes would not be compiled, so callers keep long expressions in steps of their own."""
    steps = rows.withColumn("_bare", F.trim(F.col(c))).withColumn("_bare", _bare(F.col("_bare")))
    steps = steps.withColumn("_runs", _runs(F.col(kind), F.col("_bare")))
    return steps.withColumn(name, _ordered(F.col(kind), F.col("_runs"), sort, strict)).drop("_bare", "_runs")


def leg_text(kind: Column | str, numbers: Column | str) -> Column:
    """Legs back to ticket text; NULL if one is missing."""
    kind, numbers = _c(kind), _c(numbers)

    def form(name: str) -> Column:
        first, *more = fixed.LEG_FORMS[name].split("%d")
        written = [x for i, after in enumerate(more) for x in (F.get(numbers, i).cast("string"), F.lit(after))]
        return F.concat(F.lit(first), *written)

    return F.coalesce(*[F.when(kind == name, form(name)) for name in fixed.KINDS])


def protect(c: Column | str) -> Column:
    return F.concat(F.lit('="'), _c(c), F.lit('"'))


def quote_range(c: Column | str) -> Column:
    """NJ29: '27.8-29.9'."""
    return F.struct(*[part(c, PATTERNS["quote_range"], i).try_cast("double").alias(n) for i, n in ((1, "lo"), (2, "hi"))])


def meeting_key(c: Column | str) -> Column:
    """NJ30: '2026年 第4回6日目'."""
    return F.struct(*[part(c, PATTERNS["meeting_text"], i).cast("int").alias(n) for i, n in ((1, "year"), (2, "meeting"), (3, "day"))])


def race_number(c: Column | str) -> Column:
    """NJ30: '11R'."""
    return part(F.trim(_c(c)), PATTERNS["race_text"]).cast("int")


def receipt(texts: Column, points: Column) -> Column:
    """NJ31: stake per point from the purchase messages.

    ``stated`` says whether any receipt exists; ``stake`` is NULL unless there is exactly one
    distinct receipt, its points equal ``points`` and its amount is whole hundreds per point.
    """
    found = F.array_distinct(F.flatten(F.transform(
        texts, lambda t: F.regexp_extract_all(t, F.lit(PATTERNS["receipt"]), F.lit(0)))))
    one = F.get(found, 0)
    stated = part(one, PATTERNS["receipt"], 1).cast("int")
    amount = F.regexp_replace(part(one, PATTERNS["receipt"], 2), ",", "").cast("long")
    fits = (F.size(found) == 1) & (stated > 0) & (stated == points) & (amount > 0) & (F.try_mod(amount, stated * 100) == 0)
    return F.struct(
        (F.size(found) > 0).alias("stated"), F.when(F.size(found) == 1, stated).alias("points"),
        F.when(fits, F.floor(amount / stated)).cast("long").alias("stake"),
    )


def bet_lines(messages: Column, sent: Column) -> Column:
    """NJ32: every ticket line in the first ``sent`` messages."""
    joined = F.array_join(F.slice(messages, 1, sent), "\n")
    return F.regexp_extract_all(joined, F.lit(PATTERNS["bet_line"]), F.lit(0))


def bet_of(line: Column | str) -> Column:
    """(kind, text) of a ticket line: the label ends at the first blank, the text at the next mark after one character."""
    line = _c(line)
    labels = {label: kind for kind, label in fixed.KIND_LABELS.items()}
    label = F.substring_index(line, " ", 1)
    start = F.length(label) + 2
    text = line.substr(start, F.position(F.lit(" | 確率 "), line, start + 1) - start)
    return F.struct(mapped(label, labels).alias("kind"), text.alias("text"))


def bets_from_messages(messages: Column, sent: Column) -> Column:
    """NJ32: (kind, text) of every ticket line in the first ``sent`` messages."""
    return F.transform(bet_lines(messages, sent), bet_of)
