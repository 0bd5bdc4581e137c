"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import best_fit, collocations, leak_scan, line_dedup, mix_histogram, prefix_hash, rule_ensemble, simhash_trie, suffix_groups, surrogates, target_ratio, token_align, toxicity
from furlong.llm.frames import documents, held_out, labels, stored
from furlong.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return register


@query("op1_toxicity_noisy_or")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and its worst sentence."""
    docs, apart = documents(spark, sf_dir), held_out(0, 5)
    model = toxicity.train(docs, labels(spark, sf_dir), "toxic", ~apart)
    return toxicity.score(docs, model, ["doc_id"]).withColumns({"held_out": apart, "predicted": (F.col("score") >= 0.5).cast("int")})


@query("op2_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data."""
    return surrogates.with_surrogates(documents(spark, sf_dir).select("doc_id", "text"))


@query("op3_line_neighbourhood", r"""
with lines as (
  select doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from (select doc_id, unnest(range(len(parts))) as line_no, unnest(parts) as line from (select doc_id, string_split(text, chr(10)) as parts from documents))),
worded as (select * from lines where len(words) > 0),
firsts as (select array_to_string(words, ' ') as w, any_value(words) as words, min((doc_id, line_no)) as place from worded group by 1),
spots as (select w, place, words, len(words) as n, unnest(range(len(words) + 1)) as p from firsts where len(words) >= 5),
variants as (
  select w, place, n - 1 as m, p, 'd' as kind, array_to_string(list_concat(words[1:p], words[p + 2:]), ' ') as v from spots where p < n
  union all select w, place, n, p, 'd', w from spots
  union all select w, place, n, p, 'r', array_to_string(list_concat(words[1:p], words[p + 2:]), ' ') from spots where p < n),
near as (
  select distinct a.w from variants a join (select m, p, kind, v, min(place) as place from variants group by all) b
  on a.m = b.m and a.p = b.p and a.kind = b.kind and a.v = b.v and b.place < a.place),
gone as (
  select l.doc_id, l.line_no from worded l join firsts f on array_to_string(l.words, ' ') = f.w left join near n on f.w = n.w
  where n.w is not null or (l.doc_id, l.line_no) <> f.place),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.line_no) filter (where g.line_no is null) as text, count(*) filter (where len(l.words) > 0) as n_lines, count(g.line_no) as n_removed
  from lines l left join gone g on l.doc_id = g.doc_id and l.line_no = g.line_no group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed,
  case when d.text is not null then md5(coalesce(k.text, '')) end as kept_md5
from documents d left join kept k on d.doc_id = k.doc_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and the digest of what is kept of every document."""
    found = line_dedup.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@query("op4_rule_ensemble")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the compiled rules."""
    apart = held_out(2, 4)
    stats = stored(rule_ensemble.with_statistics(documents(spark, sf_dir)), "statistics")
    model = rule_ensemble.fit(stats, labels(spark, sf_dir), "quality", ~apart)
    return stats.select("doc_id", apart.alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op5_suffix_groups", r"""
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
strings as (
  select doc_id, i, md5(substr(x, 2 * i + 1, 400)) as s from (select doc_id, x, unnest(range(len(x) // 2 - 199)) as i from texts)),
again as (select s from strings group by s having count(*) > 1),
starts as (
  select doc_id, i, max(i + 200) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as upto from strings where s in (from again)),
runs as (
  select doc_id, min(i) as a, max(i) + 200 as b from (
    select *, sum((upto is null or i > upto)::int) over (partition by doc_id order by i) as run from starts) group by doc_id, run),
gaps as (
  select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before, row_number() over (partition by doc_id order by a desc) = 1 as final from runs),
cut as (
  select t.doc_id, any_value(len(t.x) // 2) as n_bytes, coalesce(sum(g.b - g.a), 0) as n_removed, count(g.a) as n_spans,
    case when count(g.a) = 0 then any_value(t.x)
      else string_agg(substr(t.x, 2 * g.before + 1, 2 * (g.a - g.before)), '' order by g.a) || any_value(substr(t.x, 2 * g.b + 1)) filter (where g.final) end as kept
  from texts t left join gaps g on t.doc_id = g.doc_id group by t.doc_id)
select doc_id, n_bytes::bigint as n_bytes, n_removed::bigint as n_removed, n_spans::bigint as n_spans, sha256(unhex(kept)) as kept_sha256 from cut
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 200-byte strings."""
    return suffix_groups.without_repeats(documents(spark, sf_dir)).drop("kept")


@query("op6_target_ratio")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; the trusted documents are those labelled of quality 1."""
    docs = documents(spark, sf_dir)
    ratios = target_ratio.count(docs, labels(spark, sf_dir).filter("quality = 1"))
    return target_ratio.judge(docs, ratios, ["doc_id"])


@query("op7_prefix_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return prefix_hash.compare(documents(spark, sf_dir))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents packed into sequences of 2048."""
    return best_fit.pack(documents(spark, sf_dir))


@query("op9_simhash_trie")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_trie.groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_hash_threshold_mix", r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ' ' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][((row_number() over (order by encode(source) nulls last) - 1) % 3) + 1]::double as w
  from sized group by source),
ordered as (
  select *, row_number() over (order by source_size / w, encode(source) nulls last) as place from sources),
levels as (
  select *, 1.5 * sum(source_size::double) over () - 2.0 * coalesce(sum(source_size::double) over (order by place rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over () - coalesce(sum(w) over (order by place rows between unbounded preceding and 1 preceding), 0) as w_left
  from ordered),
level as (select rest, w_left from levels where not (w * rest / w_left > 2.0 * source_size) order by place limit 1),
targets as (
  select l.source, l.source_size, case when v.rest is null or l.w * v.rest / v.w_left > 2.0 * l.source_size then 2.0 * l.source_size else l.w * v.rest / v.w_left end::double as target
  from levels l left join level v on true),
passes as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as passes from targets),
sums as (select source, h, sum(size) as s from sized where size > 0 group by source, h),
running as (select *, sum(s) over (partition by source order by h) as upto from sums),
edges as (
  select p.source, min(struct_pack(h := r.h, upto := r.upto, s := r.s)) as e
  from passes p join running r on p.source is not distinct from r.source
  where r.upto > p.target - p.passes * p.source_size group by p.source),
cuts as (
  select p.*, case when e.source is null and e.e is null then 1152921504606846976
    else e.e.h + (e.e.s - (p.target - p.passes * p.source_size - (e.e.upto - e.e.s)) < p.target - p.passes * p.source_size - (e.e.upto - e.e.s))::bigint end as threshold
  from passes p left join edges e on p.source is not distinct from e.source)
select d.doc_id, d.size::bigint as size, c.source_size, c.target,
  case when d.size > 0 then d.size * (c.passes + (d.h < c.threshold)::bigint) else 0 end::bigint as taken
from sized d join cuts c on d.source is not distinct from c.source
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix_histogram.mix(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"))


@query("op12_wu_manber", r"""
with texts as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
tests as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[p + 1:p + least(len(w), 10)], ' ') as s
  from (select *, unnest(range(greatest(len(w) - 9, 1))) as p from items where len(w) > 0)),
places as (
  select r, p, n, array_to_string(w[p + 1:p + n], ' ') as s
  from (select r, w, n, unnest(range(len(w) - n + 1)) as p from texts, (select distinct n from tests) where len(w) >= n)),
found as (select p.r, p.p, p.n, t.item from places p join tests t on p.n = t.n and p.s = t.s),
hit as (select r, count(distinct place) as n_hit from (select r, unnest(range(p, p + n)) as place from found) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by encode(item)) as ids from (select distinct r, item from found) group by r)
select t.doc_id, len(t.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(n.n_items, 0)::bigint as n_items,
  sha256(coalesce(n.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from texts t left join hit h on t.r = h.r left join named n on t.r = n.r
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and benchmark items of every document that windows of the benchmark hit."""
    found = leak_scan.mark(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query("op13_token_align")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups, links and link counts of every document under two vocabularies."""
    found = token_align.aligned(documents(spark, sf_dir))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return token_align.counted(found.withColumn("groups_sha256", digest).drop("groups")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op11_suffix_phrases", r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
n_words as (select lang, sum(len(w))::bigint as n from words group by lang),
phrases as (
  select lang, m, array_to_string(w[p + 1:p + m], ' ') as phrase, count(*) as f
  from (select lang, w, m, unnest(range(len(w) - m + 1)) as p from words, (select unnest(range(1, 5)) as m) where len(w) >= m) group by all having count(*) >= 30),
parts as (select lang, m, phrase, f, string_split(phrase, ' ') as w from phrases),
cuts as (
  select c.lang, c.phrase, c.m, c.f as a, c.k, x.f as l, y.f as r, ((2000000::hugeint * c.f) // (x.f + y.f))::bigint as score
  from (select *, unnest(range(1, m)) as k from parts where m > 1) c
  join phrases x on c.lang = x.lang and x.phrase = array_to_string(c.w[1:c.k], ' ')
  join phrases y on c.lang = y.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
scored as (select lang, phrase, m, a, l, r, score from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, array_to_string(w[i + 1:i + s], ' ') as phrase, max(f) as most
  from (select *, unnest(range(m - s + 1)) as i from (select *, unnest(range(2, m)) as s from parts where m > 2)) group by 1, 2),
kept as (select s.* from scored s left join inside i on s.lang = i.lang and s.phrase = i.phrase where i.most is null or 100 * i.most::hugeint < 80 * s.a::hugeint),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept qualify rank <= 2000)
select r.lang, r.rank::bigint as rank, r.phrase, r.a::bigint as a, r.l::bigint as l, r.r::bigint as r, n.n, r.score from ranked r join n_words n on r.lang = n.lang
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language whose words go together most."""
    return collocations.collocations(documents(spark, sf_dir))
