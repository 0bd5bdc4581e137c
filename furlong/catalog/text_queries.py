"""Queries on the text jobs (NJ01-NJ33).  Texts are written from typed columns and must read back as those."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.catalog import views as v
from furlong.catalog.registry import query, with_
from furlong.functions import fixed, text

FIELD = v.FIELD_SQL
CONTEST = v.CONTEST_SQL


def _f(spark, sf):
    return v.field(spark, sf)


def s(name):
    return F.col(name).cast("string")


def i(name):
    return F.col(name).cast("int").cast("string")


@query("nj01_number", with_(FIELD, "select race_id, num, carried as plain, -rate + 0 as signed, case when num % 3 = 0 then null else cast(jockey as double) end as spaced from field"))
def nj01(spark, sf):
    return _f(spark, sf).select(
        "race_id", "num", text.num(F.concat(s("carried"), F.lit("kg"))).alias("plain"),
        (text.num(F.concat(F.lit("差 -"), s("rate"))) + 0.0).alias("signed"),
        text.num(F.when(F.col("num") % 3 == 0, F.lit("なし")).otherwise(F.concat(F.lit("no "), s("jockey"), F.lit(" x9")))).alias("spaced"))


@query("nj02_finish", with_(FIELD, "select race_id, num, finish as any_digits, case when finish % 4 <> 0 then finish end as anchored from field"))
def nj02(spark, sf):
    shown = F.when(F.col("finish") % 4 == 0, F.concat(F.lit("中止"), i("finish"))).otherwise(F.concat(F.lit(" "), i("finish"), F.lit("着")))
    return _f(spark, sf).select("race_id", "num", text.first_int(shown).alias("any_digits"), text.placing(shown).alias("anchored"))


@query("nj03_carried", with_(FIELD, "select race_id, num, case when num % 5 <> 0 then carried end as value, cast(num % 5 <> 0 and num % 2 = 0 as int) as allowance from field"))
def nj03(spark, sf):
    marked = F.when(F.col("num") % 5 != 0, F.concat(F.when(F.col("num") % 2 == 0, "▲").otherwise(""), s("carried")))
    out = _f(spark, sf).withColumn("w", text.carried(marked))
    return out.select("race_id", "num", "w.value", "w.allowance")


@query("nj04_style_counts", with_(FIELD, "select race_id, num, cast(jockey % 100 as int) as a, cast(num as int) as b, cast(finish as int) as c, cast(horse % 90 as int) as d from field"))
def nj04(spark, sf):
    two = lambda c: F.lpad((c).cast("int").cast("string"), 2, "0")
    packed = F.concat(two(F.col("jockey") % 100), F.lit("-"), two(F.col("num")), two(F.col("finish")), F.lit(" "), two(F.col("horse") % 90))
    out = _f(spark, sf).withColumn("x", text.style4(F.regexp_replace(packed, "^0+(?=\\d)", "")))
    return out.select("race_id", "num", *[F.get("x", F.lit(k)).alias(n) for k, n in enumerate("abcd")])


@query("nj05_career_counts", with_(FIELD, "select race_id, num, cast(case when num % 6 = 0 then 0 else jockey end as int) as a, cast(case when num % 6 = 0 then 0 else num end as int) as b, cast(case when num % 6 = 0 or num % 4 = 0 then 0 else finish end as int) as c from field"))
def nj05(spark, sf):
    packed = F.when(F.col("num") % 6 != 0, F.concat_ws("-", i("jockey"), i("num"), F.when(F.col("num") % 4 != 0, i("finish"))))
    out = _f(spark, sf).withColumn("x", text.career4(packed))
    return out.select("race_id", "num", *[F.get("x", F.lit(k)).alias(n) for k, n in enumerate("abc")])


@query("nj06_passing", with_(FIELD, "select race_id, num, cast(nullif(num % 3, 0) as int) as first, cast(finish as int) as last from field"))
def nj06(spark, sf):
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    out = _f(spark, sf).withColumn("x", text.passing4(F.concat_ws("-", two(F.col("num") % 3), F.lit("00"), two(F.col("num")), two(F.col("finish")))))
    return out.select("race_id", "num", F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(3)).alias("last"))


_VENUES = "venues(code, name, short) as (values " + ", ".join(f"({c}, '{n}', '{sh}')" for (c, n), sh in zip(fixed.VENUE_NAMES.items(), fixed.VENUE_SHORT)) + ")"


@query("nj07_venue_code", with_(FIELD, "select race_id, num, cast(jockey % 10 + 1 as double) as code from field"))
def nj07(spark, sf):
    """Venues written as short form, name with addition, full-width or plain number."""
    code = (F.col("jockey") % 10 + 1).cast("int")
    short = text.mapped(code, {c: sh for sh, c in fixed.VENUE_SHORT.items()})
    shown = F.when(F.col("num") % 4 == 0, short).when(F.col("num") % 4 == 1, F.concat(text.mapped(code, fixed.VENUE_NAMES), F.lit("競馬場"))).when(
        F.col("num") % 4 == 2, F.translate(code.cast("string"), "0123456789", "０１２３４５６７８９")).otherwise(F.concat(F.lit(" "), code.cast("string")))
    return _f(spark, sf).select("race_id", "num", text.place_code(shown).alias("code"))


@query("nj08_surface", with_(FIELD, "select race_id, num, case surface when 'A' then '芝' when 'N' then 'ダート' else case when num % 2 = 0 then '障害' else 'NA' end end as surface from field"))
def nj08(spark, sf):
    shown = F.when(F.col("surface") == "A", "芝1200").when(F.col("surface") == "N", "ダ").when(F.col("num") % 2 == 0, " 障害")
    return _f(spark, sf).select("race_id", "num", text.surface(shown).alias("surface"))


@query("nj09_nj10_levels", with_(FIELD, """select race_id, num, cast(case jockey % 7 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 3 when 5 then 3 end as double) as style,
 cast(case horse % 7 when 0 then 1 when 1 then 2 when 2 then 2 when 3 then 3 when 4 then 4 when 5 then 4 end as double) as going from field"""))
def nj09(spark, sf):
    styles, goings = ["逃げ", "先行", "差し", "追込", "マクリ", "捲り", "?"], ["良", "稍", "稍重", "重", "不", "不良", "雪"]
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (c % 7 + 1).cast("int"))
    return _f(spark, sf).select("race_id", "num", text.style_level(pick(styles, F.col("jockey"))).alias("style"), text.going(pick(goings, F.col("horse"))).alias("going"))


#: Every spelling of every class, and names without one.
_NAMES = [
    "春G1", "GI賞", "杯GⅠ", "天皇賞ＧＩ", "GII記念", "GIII記念", "G2杯", "GⅡ", "春ＧⅡ", "G3", "GⅢ杯", "ＧⅢ", "オープン", "夏OP", "リステッド", "春 L", "1600万下", "3勝クラス",
    "1000万", "2勝クラス", "500万", "1勝", "未勝利", "新馬", "特別", "夏Ｇ3", "Large",
]
_LEVELS = [8, 8, 8, 8, 8, 8, 7, 7, 7, 6, 6, 6, 5, 5, 5, 5, 4, 4, 3, 3, 2, 2, 1, 0, 5, 5, 5]


@query("nj11_race_class", with_(FIELD, "select race_id, num, cast(case horse % 28 " + " ".join(f"when {k} then {n}" for k, n in enumerate(_LEVELS)) + " else 5 end as double) as level from field"))
def nj11(spark, sf):
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("horse") % 28).cast("int"))
    return _f(spark, sf).select("race_id", "num", text.race_class(name).alias("level"))


@query("nj12_dominant_style", with_(FIELD, """c as (select race_id, num, [cast(jockey % 4 as int), cast(num % 4 as int), cast(finish % 4 as int), cast(horse % 4 as int)] as x from field)""",
 "select race_id, num, case when list_max(x) = 0 then '不明' else ['逃げ', '先行', '差し', '追込'][list_position(x, list_max(x))] end as style from c"))
def nj12(spark, sf):
    packed = F.concat(*[F.lpad((F.col(c) % 4).cast("int").cast("string"), 2, "0") for c in ("jockey", "num", "finish", "horse")])
    return _f(spark, sf).select("race_id", "num", text.dominant_style(packed).alias("style"))


@query("nj13_distance_bands", with_(FIELD, """select race_id, num, case when carried * 60 <= 1400 then 'career_a' when carried * 60 <= 2000 then 'career_b' when carried * 60 >= 2001 then 'career_c' end as band from field"""))
def nj13(spark, sf):
    """Bands named by headers, joined to the distances as a small constant table."""
    bands = {n: text.band_of(h) for n, h in (("career_a", "～1400"), ("career_b", "1401-2000"), ("career_c", "2001以上"))}
    table = F.broadcast(spark.createDataFrame([(n, lo, hi) for n, (lo, hi) in bands.items()], "band string, lo int, hi int"))
    rows = _f(spark, sf).withColumn("distance", F.col("carried") * 60)
    return rows.join(table, F.col("distance").between(F.col("lo"), F.col("hi")), "left").select("race_id", "num", "band")


@query("nj14_text_norm", "select doc_id, nullif(trim(nfc_normalize(lang)), '') as lang, n_chars as chars from documents")
def nj14(spark, sf):
    """Language codes written full-width, and whole texts that NFKC leaves unchanged in length or not."""
    wide = F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")
    return v.table(spark, sf, "documents").select("doc_id", text.text_norm(F.concat(F.lit("　"), wide, F.lit(" "))).alias("lang"), F.col("n_chars").alias("chars"))


@query("nj15_name_norm", with_(FIELD, "select race_id, num, 'ア' || cast(jockey as varchar) || 'ー' || 'ダ' as name from field"))
def nj15(spark, sf):
    wide = F.translate(s("jockey"), "0123456789", "０１２３４５６７８９")
    shown = F.concat(F.when(F.col("num") % 2 == 0, "(地)").otherwise(""), F.lit("ｱ "), wide, F.when(F.col("num") % 3 == 0, "｜").when(F.col("num") % 3 == 1, "ー").otherwise("¦"), F.lit("ダ"))
    return _f(spark, sf).select("race_id", "num", text.name_norm(shown).alias("name"))


@query("nj16_course", with_(FIELD, "select race_id, num, case when num % 2 = 0 then 'ダート' else '芝' end as surface, cast(1000 + carried * 20 as int) as distance, case finish % 3 when 0 then '稍重' when 1 then '不良' end as going from field"))
def nj16(spark, sf):
    shown = F.concat(F.when(F.col("num") % 2 == 0, "ダ").otherwise("芝"), (F.col("carried") * 20 + 1000).cast("int").cast("string"), F.when(F.col("finish") % 3 == 0, "稍").when(F.col("finish") % 3 == 1, "不").otherwise(""))
    return _f(spark, sf).select("race_id", "num", text.course(shown).alias("x")).select("race_id", "num", "x.*")


@query("nj17_time_finish", with_(FIELD, """select race_id, num, case when num % 9 = 0 then '中止' else '1.' || cast(cast(carried as int) + 10 as varchar) || '.' || cast(jockey % 10 as varchar) end as time,
 case when num % 9 <> 0 then cast(finish as int) end as finish from field"""))
def nj17(spark, sf):
    circled = F.element_at(F.array(*[F.lit(chr(0x2460 + k)) for k in range(20)]), F.col("finish"))
    clock = F.concat(F.lit("1."), (F.col("carried").cast("int") + 10).cast("string"), F.lit("."), (F.col("jockey") % 10).cast("string"))
    shown = F.when(F.col("num") % 9 == 0, "中止").when(F.col("num") % 2 == 0, F.concat(clock, circled)).otherwise(F.concat(clock, F.lit(" "), i("finish"), F.lit("着")))
    return _f(spark, sf).select("race_id", "num", text.time_finish(shown).alias("x")).select("race_id", "num", "x.*")


@query("nj18_days_since", with_(CONTEST, """select race_id, num, cast(case when num % 8 = 0 then null else jockey % 300 + 1 end as int) as days from contest"""))
def nj18(spark, sf):
    """Dates written without the year, the 29th of February too."""
    back = F.date_sub("race_date", (F.col("jockey") % 300 + 1).cast("int"))
    rows = v.contest(spark, sf).withColumn("back", back)
    shown = F.when(F.col("num") % 8 == 0, "02/30").otherwise(F.concat_ws("/", F.month("back").cast("string"), F.dayofmonth("back").cast("string")))
    return rows.select("race_id", "num", text.days_since("race_date", shown).alias("days"))


@query("nj19_date_place_weather", with_(CONTEST, "select race_id, num, strftime(race_date, '%m/%d') as date, case when num % 2 = 0 then '東' else '小' end as place, case finish % 3 when 0 then '小雨' when 1 then '晴' end as weather from contest"))
def nj19(spark, sf):
    shown = F.concat(F.date_format("race_date", "MM/dd"), F.when(F.col("num") % 2 == 0, "東").otherwise("小"), F.when(F.col("finish") % 3 == 0, "小雨").when(F.col("finish") % 3 == 1, "晴").otherwise(""))
    return v.contest(spark, sf).select("race_id", "num", text.date_place_weather(shown).alias("x")).select("race_id", "num", "x.*")


@query("nj20_name_number", with_(CONTEST, "select race_id, num, trainer || '.J' as name, carried as number from contest"))
def nj20(spark, sf):
    return v.contest(spark, sf).select("race_id", "num", text.name_trailing_number(F.concat(F.col("trainer"), F.lit(".J"), s("carried"))).alias("x")).select("race_id", "num", "x.*")


@query("nj21_three_ints", with_(FIELD, "select race_id, num, cast(heads as int) as a, cast(num as int) as b, cast(finish as int) as c from field"))
def nj21(spark, sf):
    return _f(spark, sf).select("race_id", "num", text.three_ints(F.concat(i("heads"), F.lit("ﾄ"), i("num"), F.lit("番"), i("finish"))).alias("x")).select("race_id", "num", "x.*")


@query("nj22_pace_style_time", with_(FIELD, "select race_id, num, case when num % 3 <> 0 then 'M' end as pace, case when num % 4 <> 0 then '追' end as style, carried + 0.5 as time from field"))
def nj22(spark, sf):
    shown = F.concat(F.when(F.col("num") % 3 != 0, "M").otherwise(""), F.when(F.col("num") % 4 != 0, "追").otherwise(""), (F.col("carried") + 0.5).cast("string"))
    return _f(spark, sf).select("race_id", "num", text.pace_style_time(shown).alias("x")).select("race_id", "num", "x.*")


@query("nj23_text_paren", with_(CONTEST, "select race_id, num, trainer as text, case when num % 4 <> 0 then cast(finish as varchar) || '.5' end as inside from contest"))
def nj23(spark, sf):
    shown = F.concat(F.col("trainer"), F.when(F.col("num") % 4 != 0, F.concat(F.lit("("), i("finish"), F.lit(".5)"))).otherwise(""))
    return v.contest(spark, sf).select("race_id", "num", text.text_paren(shown).alias("x")).select("race_id", "num", "x.*")


@query("nj24_weight_delta_rank", with_(FIELD, "select race_id, num, cast(400 + cast(carried as int) as varchar) as weight, case when num % 3 <> 0 then '+' || cast(num as varchar) end as delta, case when num % 3 <> 0 then cast(finish as varchar) end as rank from field"))
def nj24(spark, sf):
    shown = F.concat((F.col("carried").cast("int") + 400).cast("string"), F.when(F.col("num") % 3 != 0, F.concat(F.lit("(+"), i("num"), F.lit(")"), i("finish"))).otherwise(""))
    return _f(spark, sf).select("race_id", "num", text.weight_delta_rank(shown).alias("x")).select("race_id", "num", "x.*")


@query("nj25_sex_age", with_(FIELD, "select race_id, num, case num % 3 when 0 then '牡' when 1 then 'セン' else '不詳' end as sex, case when num % 3 <> 2 then cast(finish as int) end as age from field"))
def nj25(spark, sf):
    shown = F.when(F.col("num") % 3 == 0, F.concat(F.lit("牡"), i("finish"))).when(F.col("num") % 3 == 1, F.concat(F.lit("セン"), i("finish"))).otherwise("不詳")
    return _f(spark, sf).select("race_id", "num", text.sex_age(shown).alias("x")).select("race_id", "num", "x.*")


_ID = "lpad(cast(race_id % 100 as varchar), 2, '0') || lpad(cast(race_id % 12 as varchar), 2, '0') || lpad(cast(num as varchar), 2, '0') || lpad(cast(finish as varchar), 2, '0') || lpad(cast(jockey % 14 as varchar), 2, '0')"


def race_code():
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(two(F.col("race_id") % 100), two(F.col("race_id") % 12), two(F.col("num")), two(F.col("finish")), two(F.col("jockey") % 14))


@query("nj26_decode_race_id", with_(FIELD, _VENUES, """select race_id, num, cast(2000 + race_id % 100 as int) as year, cast(race_id % 12 as int) as venue, cast(num as int) as meeting, cast(finish as int) as day,
 cast(jockey % 14 as int) as race_no, coalesce(v.name, '競馬場' || lpad(cast(race_id % 12 as varchar), 2, '0')) as venue_name from field left join venues v on v.code = race_id % 12"""))
def nj26(spark, sf):
    return _f(spark, sf).select("race_id", "num", text.decode_race_id(race_code()).alias("x")).select("race_id", "num", "x.*")


@query("nj27_canonical_race_id", with_(FIELD, f"select race_id, num, case when race_id % 12 between 1 and 10 and jockey % 14 between 1 and 12 then '20' || {_ID} end as code from field"))
def nj27(spark, sf):
    shown = F.when(F.col("num") % 2 == 0, race_code()).otherwise(F.concat(F.lit("20"), race_code()))
    return _f(spark, sf).select("race_id", "num", text.canonical_race_id(shown).alias("code"))


@query("nj28_legs", with_(FIELD, v.QUOTES_SQL, "select race_id, kind, array_to_string(legs, '-') as written, array_to_string(case when kind in ('frame', 'quinella', 'wide', 'trio') then list_sort(legs) else legs end, '-') as legs from quotes"))
def nj28(spark, sf):
    """Ticket texts of every kind, half of them protected, read back to legs."""
    rows = v.quotes(v.field(spark, sf)).withColumn("shown", text.leg_text("kind", "legs"))
    shown = F.when(F.col("kind").isin("win", "place"), F.concat("shown", F.lit(" 馬"))).otherwise(F.col("shown"))
    shown = F.when(F.col("race_id") % 2 == 0, text.protect(shown)).otherwise(shown)
    read = rows.withColumn("read", text.legs("kind", shown))
    return read.select("race_id", "kind", v.leg_string().alias("written"), v.leg_string("read").alias("legs"))


@query("nj28_strict_legs", with_(FIELD, v.QUOTES_SQL, """select kind, count(*) as tickets, cast(sum(case when len(list_distinct(legs)) = len(legs) and list_max(legs) <= case when kind = 'frame' then 8 else 18 end then 1 else 0 end) as bigint) as accepted from quotes group by kind"""))
def nj28_strict(spark, sf):
    rows = v.quotes(v.field(spark, sf)).withColumn("read", text.legs("kind", text.leg_text("kind", "legs"), strict=True))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("tickets"), F.count("read").alias("accepted"))


@query("nj29_quote_range", with_(FIELD, "select race_id, num, carried + 0.5 as lo, carried + 2.5 as hi from field"))
def nj29(spark, sf):
    shown = F.concat((F.col("carried") + 0.5).cast("string"), F.lit(" - "), (F.col("carried") + 2.5).cast("string"))
    return _f(spark, sf).select("race_id", "num", text.quote_range(shown).alias("x")).select("race_id", "num", "x.*")


@query("nj30_meeting_key", with_(CONTEST, "select race_id, num, yr as year, cast(jockey % 6 + 1 as int) as meeting, cast(finish as int) as day, cast(num as int) as race_no from contest"))
def nj30(spark, sf):
    shown = F.concat(s("yr"), F.lit("年 第"), (F.col("jockey") % 6 + 1).cast("string"), F.lit("回"), i("finish"), F.lit("日目"))
    return v.contest(spark, sf).select("race_id", "num", text.meeting_key(shown).alias("x"), text.race_number(F.concat(i("num"), F.lit("R"))).alias("race_no")).select("race_id", "num", "x.*", "race_no")


@query("nj31_receipts", "select event_id, cast(case when event_id % 3 = 0 then (user_id % 5 + 1) * 100 end as bigint) as stake, event_id % 4 <> 3 as stated from events where event_id % 4 <> 3 and event_id % 3 = 0 union all select event_id, null, event_id % 4 <> 3 from events where event_id % 4 = 3 or event_id % 3 <> 0")
def nj31(spark, sf):
    """A third of the receipts states the right number of points, a quarter of the messages has none."""
    points = (F.col("user_id") % 4 + 1).cast("int")
    amount = F.format_number((F.col("user_id") % 5 + 1) * 100 * points, 0)
    stated = F.when(F.col("event_id") % 3 == 0, points).otherwise(points + 1).cast("string")
    message = F.when(F.col("event_id") % 4 != 3, F.concat(F.lit("IPATで "), stated, F.lit("点 "), amount, F.lit("円を自動購入しました"))).otherwise("なし")
    out = v.table(spark, sf, "events").select("event_id", text.receipt(F.array(message, message, F.lit("")), points).alias("x"))
    return out.select("event_id", "x.stake", "x.stated")


@query("nj32_ticket_lines", with_(FIELD, v.QUOTES_SQL, """select race_id, kind, array_to_string(legs, '-') as legs from quotes where legs[1] <= 2"""))
def nj32(spark, sf):
    """Two messages per quote, of which the first was sent when the first number is at most two."""
    label = text.mapped(F.col("kind"), fixed.KIND_LABELS)
    line = F.concat(label, F.lit(" "), text.leg_text("kind", "legs"), F.lit(" | 確率 12.00% | オッズ 5 | 期待値 1.2"))
    sent = F.when(F.get("legs", F.lit(0)) <= 2, 1).otherwise(0)
    rows = v.quotes(v.field(spark, sf)).select("race_id", line.alias("line"), sent.alias("sent"))
    messages = F.array(F.concat(F.lit("頭\n"), "line", F.lit("\n\n注")), F.concat("line", F.lit("\n")))
    lines = rows.select("race_id", messages.alias("messages"), "sent").select("race_id", F.explode(text.bet_lines(F.col("messages"), F.col("sent"))).alias("line"))
    found = lines.select("race_id", text.bet_of("line").alias("bet")).select("race_id", "bet.*")
    return text.with_legs(found).select("race_id", "kind", v.leg_string().alias("legs"))
