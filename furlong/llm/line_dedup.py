"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is its sequence of words.  It goes if an earlier line (by doc_id, then line number) has the same words, or, both having at least
``LEAST`` words, is one word edit away: one word replaced, added or left out, which is a similarity of 0.8 or more.
What is earlier is judged on the input.

A line emits all variants within the bound: itself with one word deleted, for each place, and itself undeleted at
each place where a longer line may have a word more.  A variant's key is the hash of its length, the place, and the words before and
after it.  Lines with an equal key are one edit apart, so a key needs only its earliest line, and a key has no
more distinct lines than there are words for one place.  Found pairs are then verified on the words themselves.

Long texts are mostly unique, so variants are emitted by halving first: lines one edit apart agree in the words before or after the edited
part of ``m`` words, where the part is one of two halves, then one of ``PARTS`` pieces.  Only lines that share such a key with a
different line go on; nothing is lost, and full variants are made only inside the pieces that are left.
Copies of a line are collapsed before anything else, and joined back by salted keys.

Defined results: lines are split at \\n, lines without a word stay and count neither as lines nor as removed; a null text gives null, an empty one
stays empty; null ids come last; of repeated rows the hash of the text, then nothing else tells them apart, so equal rows are treated alike;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.frames import salted_join, shielded, stored, text_key

LEAST = 5
PARTS = 16
BLOCK = 64
SALTS = 16


def spaced(text: Column) -> Column:
    """All white space but \\n as spaces."""
    for other in ("\t", "\x0b", "\x0c", "\r"):
        text = F.replace(text, F.lit(other), F.lit(" "))
    return text


def words_of(line: Column) -> Column:
    """The words of a line of a ``spaced`` text."""
    return F.array_remove(F.split(line, " "), "")


def has_word(line: Column) -> Column:
    return F.length(F.trim(line)) > 0


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line_no, words) of every line with a word; line_no counts from 0."""
    rows = docs.select("doc_id", text_key().alias("key"), F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line_no", "_line"))
    return rows.filter(has_word(F.col("_line"))).withColumn("words", words_of(F.col("_line"))).drop("_line")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"), F.col("line_no"))


def _identity(words: Column) -> list[Column]:
    return [F.xxhash64(words).alias("h"), F.hash(words).alias("g")]


def _halves(words: Column, n: Column) -> Column:
    """Keys of a line whose edit is in the second or the first half, for both lengths that the shorter line may have."""
    codes = []
    for m in (n, n - 1):
        half = F.shiftright(m, 1)
        codes += [F.xxhash64(F.lit(1), m, F.slice(words, F.lit(1), half)), F.xxhash64(F.lit(0), m, F.slice(words, n - (m - half) + 1, m - half))]
    return F.array(*codes)


def _parts(words: Column, n: Column, pieces: int) -> Column:
    """Keys of a line for every piece that the edit may be in: struct(m, piece, code), m being the words of the shorter line."""

    def keys(m: Column) -> Column:
        def one(j: Column) -> Column:
            before, after = F.floor(m * j / pieces).cast("int"), (m - F.floor(m * (j + 1) / pieces)).cast("int")
            code = F.xxhash64(m, j, F.slice(words, F.lit(1), before), F.slice(words, n - after + 1, after))
            return F.struct(m.alias("m"), j.alias("piece"), code.alias("code"))

        return F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), one)

    return F.concat(keys(n), keys(n - 1))


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (``keys``, h) whose key stands on different lines; a key with very many lines is counted before it is shuffled."""
    several = rows.groupBy(*keys).agg(F.min("h").alias("_a"), F.max("h").alias("_b")).filter("_a <> _b").select(*keys)
    return rows.join(several, keys, "left_semi")


def _running(blocks: Column) -> Column:
    """Hash of all blocks before each block, and of all."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(blocks, start, lambda sums, b: F.concat(sums, F.array(F.xxhash64(F.element_at(sums, -1), b))))


def _blocks(words: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(words, b * BLOCK + 1, F.lit(BLOCK)))


def _variants(lines: DataFrame, pieces: DataFrame) -> DataFrame:
    """(code, h, place) of the variants of every line inside its pieces.

    The words before a place are hashed as whole blocks from the start and a rest, those after it as whole blocks from the end and a rest, so a
    variant costs a block and not the line.
    """
    cut = lines.withColumn("_turned", F.reverse("words")).withColumns({"_f": _blocks(F.col("words"), F.col("n")), "_b": _blocks(F.col("_turned"), F.col("n"))})
    cut = cut.withColumns({"_fs": _running(F.col("_f")), "_bs": _running(F.col("_b"))})

    def upto(blocks: str, sums: str, size: Column) -> Column:
        at = F.floor(size / BLOCK).cast("int")
        rest = F.when(size % BLOCK == 0, F.array().cast("array<string>")).otherwise(F.slice(F.get(F.col(blocks), at), F.lit(1), (size % BLOCK).cast("int")))
        return F.xxhash64(F.get(F.col(sums), at), rest)

    low, high = F.floor(F.col("m") * F.col("piece") / PARTS).cast("int"), F.floor(F.col("m") * (F.col("piece") + 1) / PARTS).cast("int")
    # a replaced or left-out word stands in low..high-1 of the shorter line, an added one before a word in low..high
    longest = F.when(F.col("n") == F.col("m"), high).otherwise(F.least(high, F.col("n") - 1))
    spread = cut.join(pieces, "h").filter(longest >= low).withColumn("_p", F.explode(F.sequence(low, longest)))
    p, m, n = F.col("_p"), F.col("m"), F.col("n")
    deleted = F.xxhash64(m, p, upto("_f", "_fs", p), upto("_b", "_bs", m - p))
    # of a line of m words: the word at p deleted meets lines of m words, the place before p meets lines with a word more
    replaced = F.xxhash64(F.lit("r"), m, p, upto("_f", "_fs", p), upto("_b", "_bs", m - p - 1))
    codes = F.when((n == m) & (p < m), F.array(deleted, replaced)).otherwise(F.array(deleted))
    return spread.select(F.explode(codes).alias("code"), "h", "place").distinct()


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word sequences are at most one word edit apart: the words they share at both ends leave at most one."""
    def common(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda v, w: v.eqNullSafe(w)), F.lit(False))
        return F.when(first == 0, F.least(F.size(x), F.size(y))).otherwise(F.least(first - 1, F.least(F.size(x), F.size(y))))

    longer = F.greatest(F.size(a), F.size(b))
    return (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longer - 1) & (F.abs(F.size(a) - F.size(b)) <= 1)


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, key, line_no) of every line that goes."""
    found = _lines(docs).withColumn("n", F.size("words"))
    keys = F.when(F.col("n") >= least, _halves(F.col("words"), F.col("n")))
    held = stored(found.select(*_identity(F.col("words")), "n", "doc_id", "key", "line_no", keys.alias("codes")), "lines")
    distinct = stored(held.groupBy("h", "g", "n").agg(F.min(_place()).alias("place"), F.count(F.lit(1)).alias("copies"), F.first("codes").alias("codes")), "distinct")

    # halves are compared for all distinct lines
    ids = ["doc_id", "key", "line_no"]
    halves = distinct.select("h", F.explode("codes").alias("code"))
    alive = stored(_shared(halves, ["code"]).select("h").distinct(), "alive")

    firsts = distinct.join(alive, "h", "left_semi").select("h", "n", "place")
    wanted = firsts.select("h", "n", "place", F.col("place.doc_id").alias("doc_id"), F.col("place.key").alias("key"), F.col("place.line_no").alias("line_no"))
    by_text = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("line_no", "h", "n", "place")).alias("_wanted"))  # lines of one text
    texts = docs.select(F.col("doc_id").alias("_doc"), text_key().alias("_key"), "text").join(
        by_text, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")))
    taken = texts.withColumn("_all", F.split(spaced(F.col("text")), "\n")).select("_all", F.explode("_wanted").alias("_w")).select(
        F.col("_w.h").alias("h"), F.col("_w.n").alias("n"), F.col("_w.place").alias("place"), words_of(F.get("_all", F.col("_w.line_no"))).alias("words"))
    lines = stored(taken.dropDuplicates(["h"]), "candidates")

    small = lines.select("h", F.explode(_parts(F.col("words"), F.col("n"), PARTS)).alias("_k")).select(F.col("_k.m").alias("m"), F.col("_k.piece").alias("piece"), F.col("_k.code").alias("code"), "h")
    pieces = _shared(small, ["m", "piece", "code"]).select("h", "m", "piece").distinct()
    variants = stored(_variants(lines, pieces), "variants")
    earliest = variants.groupBy("code").agg(F.min(F.struct("place", "h")).alias("_first"), F.max("place").alias("_last")).filter(F.col("_first.place") < F.col("_last"))
    pairs = variants.join(earliest, "code").filter(F.col("place") > F.col("_first.place")).select("h", F.col("_first.h").alias("other")).distinct()
    mine = lines.select("h", F.col("words").alias("_a"))
    theirs = lines.select(F.col("h").alias("other"), F.col("words").alias("_b"))
    near = pairs.join(mine, "h").join(theirs, "other").filter(one_edit(F.col("_a"), F.col("_b"))).select("h").distinct().withColumn("_near", F.lit(True))

    # only lines with copies or an earlier near line lose any of their places
    losing = distinct.join(near, "h", "left").filter((F.col("copies") > 1) | F.col("_near")).select(
        "h", "g", F.col("place").alias("_kept"), F.coalesce("_near", F.lit(False)).alias("_near"))
    losing = stored(losing, "losing")
    return salted_join(held, losing, ["h", "g"], "inner", SALTS).filter(F.col("_near") | (_place() != F.col("_kept"))).select(*ids)


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the kept lines in ``text``, plus n_lines and n_removed."""
    return shielded(docs, lambda d: _rewritten(d, least), ("n_lines", "n_removed"))


def _rewritten(docs: DataFrame, least: int) -> DataFrame:
    gone = repeated_lines(docs, least).groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("_gone"))  # lines of one text
    gone = gone.withColumnsRenamed({"doc_id": "_gone_doc", "key": "_gone_key"})
    rows = docs.withColumn("_key", text_key()).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_gone_doc")) & (F.col("_key") == F.col("_gone_key")), "left")
    lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_gone")), lambda i: F.get("_all", i))
    counted = F.size(F.filter(F.split(spaced(F.col("text")), "\n"), has_word))
    return rows.withColumn("_all", lines).withColumns({
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(counted).cast("long"),
        "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}).select(*docs.columns, "n_lines", "n_removed")
