"""Files to tables.  Every reader plans a scan; before it, header lines are looked at, by a pass over the files' text."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong import schemas
from furlong.functions import fixed, text
from furlong.functions.fixed import PATTERNS
from furlong.operators.evaluate import split_rejects
from furlong.operators.groups import spread_join
from furlong.session import cut


def _layouts(spark: SparkSession, path: str, key: str, glob: str | None) -> tuple[list[str], DataFrame, bool]:
    """The distinct header lines that name the key column, (file, header) of all files, and whether all have the same header.

    A header is the first line of its file that is not blank: of the lines of the block that starts the file, the one that is read first.  Only header lines, which are
    schema information, come to the driver; file names stay in the table.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("read"))
    first = cut(lines.filter((F.col("start") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.min_by("value", "read").alias("header")))
    layouts = [r["header"] for r in first.select("header").distinct().collect()]
    named = sorted(line for line in layouts if key in _names(line))
    return named, first, len(layouts) == 1


def _names(line: str) -> list[str]:
    return next(csv.reader(io.StringIO(line.lstrip("\ufeff"))))


def read_named(spark: SparkSession, path: str, key: str, glob: str | None = None) -> DataFrame:
    """SC01: all CSV files below a path as one all-text table, matched by column name.

    Files without the key column are left out, columns a file lacks are NULL, broken lines are
    kept in ``_broken``.  Files with equal headers share one scan.
    """
    layouts, headers, alike = _layouts(spark, path, key, glob)
    out = None
    for line in layouts:
        fields = [T.StructField(n, T.StringType()) for n in _names(line)] + [T.StructField("_broken", T.StringType())]
        reader = spark.read.schema(T.StructType(fields)).options(
            header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", recursiveFileLookup=True, escape='"')
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        one = reader.csv(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"))
        if not alike:
            one = spread_join(one, headers.filter(F.col("header") == line).select(F.col("file").alias("_path")), ("_path",), "left_semi")
        one = one.drop("_path")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in (key, "_broken", "file")]))
    return out


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """SC01: card files, career columns renamed by position (PJ02)."""
    from furlong.functions.columns import rename_after

    return rename_after(read_named(spark, path, schemas.CARD_KEY), schemas.STYLE_HEADER, fixed.CAREER_COLUMNS)


def career_bands(columns: list[str]) -> dict[str, tuple[int, int]]:
    """NJ13: distance bands named by the original career headers."""
    if schemas.STYLE_HEADER not in columns:
        return {}
    at = columns.index(schemas.STYLE_HEADER) + 1
    found = {name: text.band_of(header) for name, header in zip(fixed.CAREER_COLUMNS, columns[at:at + 4])}
    return {name: band for name, band in found.items() if band and name != fixed.CAREER_COLUMNS[0]}


def race_id_of(year: Column, venue: Column, meeting: Column, day: Column, race_no: Column) -> Column:
    """The twelve-digit id with the year, NULL if any part is out of range."""
    parts = [F.lpad(c.cast("int").cast("string"), 2, "0") for c in (venue, meeting, day, race_no)]
    return text.canonical_race_id(F.concat(F.lpad(year.cast("int").cast("string"), 4, "0"), *parts))


def _venue_code(name: Column) -> Column:
    return text.mapped(F.trim(name), {n: c for c, n in fixed.VENUE_NAMES.items()})


def read_predictions(spark: SparkSession, path: str, strict: bool = False, glob: str | None = "pred_*.csv") -> tuple[DataFrame, DataFrame]:
    """SC02: prediction files; the contest comes from the text date.  Strict also rejects rows with unusable numbers."""
    raw = read_named(spark, path, "1着確率", glob)
    missing = [h for h in schemas.PREDICTION_NEEDED if h not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    known = {h: n for h, n in schemas.PREDICTION_HEADERS.items() if h in raw.columns}
    rows = raw.select("file", *[F.col(f"`{h}`").alias(n) for h, n in known.items()])
    key = text.meeting_key("meeting_text")
    rows = rows.withColumns({
        "race_id": race_id_of(key["year"], _venue_code(F.col("venue_name")), key["meeting"], key["day"], text.race_number("race_text")),
        "num": F.col("num").try_cast("double").cast("int"),
        **{p: F.col(p).try_cast("double") for p in ("p1", "p2", "p3")},
        "frame": F.col("frame").try_cast("double").cast("int") if "frame" in known.values() else F.lit(None).cast("int"),
    })
    reason = F.when(F.col("race_id").isNull(), "no usable contest identity")
    if strict:
        reason = reason.when(F.col("num").isNull() | F.col("p1").isNull() | F.col("p2").isNull() | F.col("p3").isNull(), "unreadable number")
    clean, rejects = split_rejects(rows, reason)
    return clean.drop("meeting_text", "venue_name", "race_text", "code"), rejects


def read_results(spark: SparkSession, path: str, glob: str | None = "horse_racing_data_*.csv") -> tuple[DataFrame, DataFrame]:
    """SC04: result files; '1着' is finish 1, scratched entrants have no finish but count as starters."""
    raw = read_named(spark, path, "着順", glob)
    missing = [h for h in schemas.RESULT_NEEDED if h not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def number(header: str) -> Column:
        return F.col(f"`{header}`").try_cast("double").cast("int") if header in raw.columns else F.lit(None).cast("int")

    year = F.coalesce(number("年"), F.lit(2000) + F.substring(F.col(schemas.CARD_KEY), 1, 2).try_cast("int")) if schemas.CARD_KEY in raw.columns else number("年")
    rows = raw.select(
        "file", race_id_of(year, number("競馬場"), number("回"), number("日"), number("レース")).alias("race_id"),
        number("馬番").alias("num"), number("枠番").alias("frame"), text.placing("着順").alias("finish"))
    reason = F.when(F.col("race_id").isNull(), "no usable contest identity").when(F.col("num").isNull(), "no entrant number")
    return split_rejects(rows, reason)


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """SC03: quote files; date, contest and kind come from the file name."""
    out = None
    for key, headers in schemas.QUOTE_HEADERS.items():
        *legs, last = headers
        raw = read_named(spark, path, headers[0], f"odds_*_{key}.csv")
        if any(h not in raw.columns for h in headers):
            continue

        def number(h: str) -> Column:
            return F.col(f"`{h}`").try_cast("double")

        if key == fixed.QUOTE_FILE_BOTH:
            leg = F.array(number(headers[0]).cast("int"))
            rows = [
                F.struct(F.lit("win").alias("kind"), leg.alias("legs"), number(headers[1]).alias("odds_lo"), number(headers[1]).alias("odds_hi")),
                F.struct(F.lit("place").alias("kind"), leg.alias("legs"), number(headers[2]).alias("odds_lo"), number(headers[3]).alias("odds_hi")),
            ]
        else:
            kind = fixed.QUOTE_FILE_KINDS[key]
            span = text.quote_range(f"`{last}`")
            lo, hi = (span["lo"], span["hi"]) if kind == "wide" else (number(last), number(last))
            rows = [F.struct(F.lit(kind).alias("kind"), F.array(*[number(h).cast("int") for h in legs]).alias("legs"),
                             lo.alias("odds_lo"), hi.alias("odds_hi"))]
        one = raw.select("file", F.inline(F.array(*rows))).filter(F.forall("legs", lambda x: x.isNotNull()))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no quote files below {path}")
    name = PATTERNS["quote_file"]
    date, venue, meeting, day, race = (F.regexp_extract("file", name, i) for i in range(1, 6))
    identified = out.withColumns({
        "race_id": race_id_of(F.substring(date, 1, 4), _venue_code(venue), meeting, day, race),
        "race_date": F.try_to_timestamp(date, F.lit("yyyyMMdd")).cast("date")})
    return identified.filter(F.col("race_id").isNotNull()).select([f.name for f in schemas.QUOTES.fields])


def peek_columns(spark: SparkSession, path: str, key: str, required: list[str]) -> DataFrame:
    """SC07: per required column whether the files below the path have it; headers only."""
    names = {name for line in _layouts(spark, path, key, None)[0] for name in _names(line)}
    return spark.createDataFrame([(c, c in names) for c in required], "column string, present boolean")


def read_ids_from_paths(
    spark: SparkSession, path: str, glob: str = "horse_racing_data_*.csv", pattern: str = PATTERNS["card_file"] + "$",
) -> DataFrame:
    """SC08: contests named by card files, from the file listing alone."""
    files = spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup=True).load(path).select("path")
    code = text.part("path", pattern)
    return files.select(text.canonical_race_id(code).alias("race_id")).filter(F.col("race_id").isNotNull()).distinct().orderBy("race_id")


STATE = T.StructType([
    T.StructField("messages", T.ArrayType(T.StringType())), T.StructField("sent", T.IntegerType()),
    T.StructField("done", T.BooleanType()), T.StructField("auto_bet_result", T.StringType()),
    T.StructField("bets", T.ArrayType(T.StructType([T.StructField("式別", T.StringType()), T.StructField("買い目", T.StringType())]))),
    T.StructField("_broken", T.StringType()),
])


def read_state_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC05: contest state documents (one JSON per twelve-digit file name) to contests and rejects."""
    raw = spark.read.schema(STATE).options(
        multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", recursiveFileLookup=True, pathGlobFilter="*.json"
    ).json(path).withColumn("file", F.col("_metadata.file_name"))
    rows = raw.filter(F.col("file").rlike(r"^\d{12}\.json$")).withColumn("race_id", F.substring("file", 1, 12))
    return state_documents(rows)


def state_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contest per document: header, bets, notified bets and the confirmed stake; what does not fit is a reject."""
    messages = F.coalesce("messages", F.array().cast("array<string>"))
    head = F.regexp_extract(F.array_join(messages, "\n"), PATTERNS["message_head"], 0)
    labels = {label: kind for kind, label in fixed.KIND_LABELS.items()}
    sent = F.coalesce("sent", F.when(F.col("done"), F.size(messages)).otherwise(0))
    rows = rows.withColumns({"messages": messages, "sent": sent, "_head": F.nullif(head, F.lit(""))})
    notified = text.bets_from_messages(F.col("messages"), F.col("sent"))
    own = F.transform("bets", lambda b: F.struct(text.mapped(b["式別"], labels).alias("kind"), b["買い目"].alias("text")))
    in_range = F.col("sent").between(0, F.size("messages"))
    rows = rows.withColumn("notified", F.when(in_range, notified)).withColumn("tickets", F.coalesce(own, F.col("notified")))

    def read(tickets: str) -> Column:
        return F.transform(tickets, lambda t: F.struct(t["kind"].alias("kind"), t["text"].alias("text"), text.legs(t["kind"], t["text"], strict=True).alias("legs")))

    rows = rows.withColumns({"notified": read("notified"), "tickets": read("tickets")})
    texts = F.concat(F.array(F.coalesce("auto_bet_result", F.lit(""))), F.col("messages"))
    rows = rows.withColumn("_receipt", text.receipt(texts, F.size("tickets")))
    head = [F.regexp_extract("_head", PATTERNS["message_head"], i) for i in range(1, 5)]
    start = F.try_to_timestamp(head[3], F.lit("yyyy/MM/dd HH:mm"))
    unread = lambda c: F.exists(c, lambda t: t["legs"].isNull())
    reason = (
        F.when(F.col("_broken").isNotNull(), "not a state document").when(F.col("_head").isNull() | start.isNull(), "no start time")
        .when(~in_range, "messages sent out of range").when(unread("tickets") | unread("notified"), "unreadable ticket")
        .when(F.col("_receipt.stated") & F.col("_receipt.stake").isNull(), "receipt does not fit the tickets")
    )
    shown = rows.withColumns({
        "place": head[0], "race_no": head[1].try_cast("int"), "name": head[2], "start": start, "race_date": start.cast("date"),
        "unit": F.col("_receipt.stake")})
    clean, rejects = split_rejects(shown, reason)
    return (
        clean.select("race_id", "race_date", "start", "place", "race_no", "name", "tickets", "notified", "unit"),
        rejects.select("race_id", "reason"),
    )


def read_payouts(spark: SparkSession, path: str) -> DataFrame:
    """SC06: payout documents; an invalid document counts as absent."""
    schema = "race_id string, payouts map<string, array<array<string>>>, _broken string"
    raw = spark.read.schema(schema).options(
        multiLine=True, columnNameOfCorruptRecord="_broken", recursiveFileLookup=True, pathGlobFilter="*.json"
    ).json(path).withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    return payout_documents(raw.filter(F.col("_broken").isNull() & (F.col("stem") == F.col("race_id"))))


def payout_documents(rows: DataFrame) -> DataFrame:
    """Documents (race_id, payouts) to one row per payout; a document with any unusable entry is left out."""
    labels = {label: kind for kind, label in fixed.KIND_LABELS.items()}
    entries = F.flatten(F.transform(F.map_entries("payouts"), lambda k: F.transform(k["value"], lambda e, i: F.struct(
        text.mapped(k["key"], labels).alias("kind"), i.alias("seq"),
        F.from_json(F.get(e, 0), "array<int>").alias("legs"), F.get(e, 1).try_cast("long").alias("per100")))))
    listed = rows.filter(F.size("payouts") > 0).withColumn("_entries", entries)
    filled = F.forall(F.map_values("payouts"), lambda v: F.size(v) > 0)
    sound = F.forall("_entries", lambda e: e["kind"].isNotNull() & (F.size(e["legs"]) > 0) & F.forall(
        e["legs"], lambda n: n.isNotNull()) & (e["per100"] >= 0))
    return listed.filter(filled & F.coalesce(sound, F.lit(False))).select("race_id", F.inline("_entries"))


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """JN17: what still has to be processed."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def attach_quotes(predictions: DataFrame, quotes: DataFrame) -> DataFrame:
    """JN11: win and place quotes by number, by name where the number finds none.

    ``quotes(race_id, num, name, win_odds, place_lo, place_hi, fetched_at)``, one row per entrant.
    """
    fields = ["win_odds", "place_lo", "place_hi", "fetched_at"]
    by_num = quotes.select("race_id", "num", F.struct(*fields).alias("_by_num"))
    by_name = quotes.filter(F.col("name").isNotNull()).groupBy("race_id", "name").agg(F.max_by(F.struct(*fields), "num").alias("_by_name"))
    out = predictions.withColumn("name", F.trim("name")).join(by_num, ["race_id", "num"], "left").join(by_name, ["race_id", "name"], "left")
    found = F.coalesce("_by_num", "_by_name")
    return out.select(*predictions.columns, *[found[f].alias(f) for f in fields])
