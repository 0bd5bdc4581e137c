"""Removal of repeated byte strings with suffix orders.

A byte goes if it lies in a ``LENGTH``-byte string that starts at another place too, in any document.  The work is dealt out by anchors: of all
``GRAM``-byte grams in a string, the leftmost one with the smallest hash is its anchor, so equal strings have equal anchors at equal places
in them.  Each anchor of a text owns the strings that start in one stretch, its context; strings of different anchor hashes are
never equal.  That leaves, by anchor hash:

* contexts that are equal as a whole, in the middle of copies: all their strings repeat, and one aggregate says so;
* different contexts with one anchor hash, at the edges of copies: their bytes are fetched, one for each distinct context, and a suffix order
  decides.  Contexts are cut into blocks counted from the anchor, blocks are numbered, and ``grouping.suffix_order`` sorts the
  sequences of numbers.  Suffixes that agree in ``CORE`` blocks stand together; strings that contain the same core are equal if the few
  bytes around it are.

A group of more than ``GROUP`` contexts is not brought into one task: its strings are hashed one by one and counted over the whole
cluster.  Texts are shuffled by document for the fetch and for the final cut; everything else that moves is about one row for
every seventy bytes.

Defined results: a null text is empty and keeps nothing; a text shorter than ``LENGTH`` loses nothing; rows with the same id and text
are copies of each other like any others; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.frames import salted_join, stored
from furlong.llm.grouping import suffix_order
from furlong.llm.textblock import Block, Rolling, blocks, mixed

LENGTH = 200
GRAM = 40
BLOCK = 25
CORE = LENGTH // BLOCK - 1
GROUP = 50_000
#: Bytes of contexts that are sorted together, unless one group has more.
BATCH = 4 << 20
SALTS = 16

_PLACE = np.uint64((1 << 24) - 1)


def anchors(block: Block) -> tuple[np.ndarray, ...]:
    """(text, lo, strings, anchor, hash, context) of every anchor: it owns the ``strings`` strings that start at lo, lo + 1, ... of its text.

    ``anchor`` is its distance from lo.  ``hash`` is that of its gram, ``context`` that of all its bytes and distances.
    """
    width = LENGTH - GRAM + 1
    n = len(block.data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(block.data)
    grams = mixed((rolling.sums[GRAM:] - rolling.sums[:-GRAM]) * rolling.down[:n - GRAM + 1])
    # smallest of each stretch of grams by doubling; the low bits hold the place, so the leftmost of equals wins
    least, done = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * done <= width:
        least, done = np.minimum(least[:-done], least[done:]), 2 * done
    if done < width:
        least = np.minimum(least[:len(least) - (width - done)], least[width - done:])
    at = (least & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(block)), np.diff(block.off))[:len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + LENGTH <= block.off[owner + 1])
    at = at[starts]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    new = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = np.flatnonzero(new)
    lo, a = starts[first], at[first]
    strings = np.diff(np.r_[first, len(starts)])
    end = lo + strings - 1 + LENGTH
    two = rolling.raw(lo, end) + mixed((strings << 32 | (a - lo)).astype(np.uint64))
    text = owner[lo]
    return text, lo - block.off[text], strings, a - lo, grams[a], mixed(two * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _packed(lo: np.ndarray, strings: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return lo << 16 | strings << 8 | anchor


def contexts(docs: DataFrame) -> DataFrame:
    """(doc_id, check, gram, context, place) of every anchor; place packs lo, the number of strings and the anchor's distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks(batch, "text"):
                parts = [anchors(block)] if len(block.data) <= int(_PLACE) else [_long(block)]
                for text, lo, strings, anchor, gram, context in parts:
                    yield pa.RecordBatch.from_arrays([
                        rows.column("doc_id").take(pa.array(text)), rows.column("check").take(pa.array(text)), pa.array(gram.view(np.int64)),
                        pa.array(context.view(np.int64)), pa.array(_packed(lo, strings, anchor))], ["doc_id", "check", "gram", "context", "place"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, check long, gram long, context long, place long")


def _long(block: Block) -> tuple[np.ndarray, ...]:
    """The anchors of one very long text, by stretches that share ``LENGTH - 1`` bytes; a stretch's edge may split the strings of an anchor."""
    step = int(_PLACE) // 2
    found = []
    for start in range(0, len(block.data), step):
        part = block.data[start:start + step + LENGTH - 1]
        text, lo, *rest = anchors(Block(part, np.array([0, len(part)])))
        found.append((text, lo + start, *rest))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def row_check() -> Column:
    """With doc_id it tells rows apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _lo() -> Column:
    return F.shiftright("place", 16)


def _strings() -> Column:
    return F.shiftright("place", 8).bitwiseAND(F.lit(255))


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, check, spans) of every text that loses bytes; spans are (start, end) and may overlap."""
    rows = docs.select("doc_id", row_check().alias("check"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = contexts(rows)
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"), F.min("context").alias("_a"), F.max("context").alias("_b")).filter("_n > 1")
    grams = stored(grams.select("gram", (F.col("_a") != F.col("_b")).alias("several")), "grams")
    again = stored(contexts(rows).join(grams, "gram"), "repeated")
    whole = again.filter("not several")

    # different contexts of one gram: those that stand several times repeat as a whole, all are compared with each other
    several = again.filter("several")
    distinct = stored(several.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "check", "place")).alias("one")), "contexts")
    copied = distinct.filter("copies > 1").select("gram", "context")
    whole = whole.select("doc_id", "check", "place").unionByName(salted_join(several, copied, ["gram", "context"], "inner", SALTS).select("doc_id", "check", "place"))
    spans = whole.select("doc_id", "check", _lo().alias("start"), (_lo() + _strings() - 1 + LENGTH).alias("end"))

    crowded = stored(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > GROUP).select("gram"), "crowded")
    asked = distinct.select("gram", F.col("one.doc_id").alias("doc_id"), F.col("one.check").alias("check"), F.col("one.place").alias("place"), (F.col("copies") == 1).alias("alone"))
    bytes_ = stored(_fetched(rows, asked), "bytes")
    edges = _compared(bytes_.join(crowded, "gram", "left_anti"))
    if not crowded.isEmpty():
        edges = edges.unionByName(_counted(bytes_.join(crowded, "gram", "left_semi")))
    return spans.unionByName(edges).groupBy("doc_id", "check").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _fetched(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with the bytes of its contexts."""
    by_text = asked.groupBy("doc_id", "check").agg(F.collect_list(F.struct("gram", "place", "alone")).alias("asked"))  # contexts of one text
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, "text", 1 << 20):
                lists = part.column("asked")
                wanted, size = lists.flatten(), lists.value_lengths().to_numpy()
                gram, place, alone = (wanted.field(k) for k in range(3))
                text = np.repeat(np.arange(len(block)), size)
                p = place.to_numpy()
                start = block.off[text] + (p >> 16)
                raw = block.data.tobytes()
                cut = [raw[a:b] for a, b in zip(start.tolist(), (start + (p >> 8 & 255) - 1 + LENGTH).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(text)), part.column("check").take(pa.array(text)), gram, place, alone, pa.array(cut, pa.binary())],
                    ["doc_id", "check", "gram", "place", "alone", "bytes"])

    met = _matched(rows, by_text, "inner").dropDuplicates(["doc_id", "check"])
    return met.select("doc_id", "check", "text", "asked").mapInArrow(run, f"doc_id {kind}, check long, gram long, place long, alone boolean, bytes binary")


def _matched(rows: DataFrame, by_text: DataFrame, how: str) -> DataFrame:
    other = by_text.withColumnsRenamed({"doc_id": "_doc", "check": "_check"})
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("check") == F.col("_check")), how)


def repeated_strings(gram: np.ndarray, place: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, string) numbers of all strings of the contexts that another context of the same gram has too."""
    strings, anchor = place >> 8 & 255, place & 255
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(size) - size
    first = anchor % BLOCK
    count = (size - first) // BLOCK
    context = np.repeat(np.arange(len(texts)), count)
    within = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
    cut = base[context] + first[context] + within * BLOCK
    cells = np.ascontiguousarray(data[cut[:, None] + np.arange(BLOCK)]).view(f"V{BLOCK}").ravel()
    numbers = np.unique(cells, return_inverse=True)[1]
    # one closing value after every context, and the smallest at the very end
    sequence = np.ones(len(cells) + len(texts) + 1, np.int64)
    spot = np.arange(len(cells)) + context
    sequence[spot] = numbers + 2
    sequence[-1] = 0
    order = suffix_order(sequence)
    inner = np.full(len(sequence), -1)
    inner[spot[within + CORE <= count[context]]] = 0  # a core fits from here
    order = order[inner[order] == 0]
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(CORE):
        same &= sequence[order[1:] + k] == sequence[order[:-1] + k]
    core = np.full(len(sequence), -1)
    core[order] = np.cumsum(np.r_[True, ~same][:len(order)])
    # every string has one core: that of the first block that starts in it
    owner = np.repeat(np.arange(len(texts)), strings)
    string = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    block = -((first[owner] - string) // BLOCK)
    lead = first[owner] + block * BLOCK - string
    start = base[owner] + string
    begin = np.cumsum(count + 1) - (count + 1)
    rolling = Rolling(data)
    inside = start + lead
    key = mixed(core[begin[owner] + block].astype(np.uint64) * np.uint64(64) + lead.astype(np.uint64)) ^ gram[owner].view(np.uint64)
    key = mixed(key + rolling.of(start, inside)) + mixed(rolling.of(inside + CORE * BLOCK, start + LENGTH))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[back] > 1
    return owner[again], string[again]


def _compared(rows: DataFrame) -> DataFrame:
    """(doc_id, check, start, end) of the repeated strings of contexts that stand once, by suffix orders of whole groups."""
    kind = dict(rows.dtypes)["doc_id"]

    def judged(table: pa.Table) -> pa.RecordBatch:
        gram, place = table.column("gram").to_numpy(), table.column("place").to_numpy()
        context, string = repeated_strings(gram, place, table.column("bytes").to_pylist())
        alone = table.column("alone").to_numpy()[context]
        context, string = context[alone], string[alone]
        new = np.r_[True, (context[1:] != context[:-1]) | (string[1:] != string[:-1] + 1)][:len(context)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, len(context) - 1][:len(first)]
        lo = place[context[first]] >> 16
        own = pa.array(context[first])
        return pa.RecordBatch.from_arrays([
            table.column("doc_id").take(own).combine_chunks(), table.column("check").take(own).combine_chunks(), pa.array(lo + string[first]),
            pa.array(lo + string[last] + LENGTH)], ["doc_id", "check", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size > BATCH:
                table = pa.Table.from_batches(held).combine_chunks()
                gram = table.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))  # the last group may go on
                if cut:
                    yield judged(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(b.column("bytes").nbytes for b in held)
        if held:
            yield judged(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, f"doc_id {kind}, check long, start long, end long")


def _counted(rows: DataFrame) -> DataFrame:
    """The same for groups of any size: every string hashed twice and counted over the cluster."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, "bytes"):
                place = part.column("place").to_numpy()
                strings = place >> 8 & 255
                owner = np.repeat(np.arange(len(block)), strings)
                string = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
                start = block.off[owner] + string
                one = Rolling(block.data).of(start, start + LENGTH)
                two = Rolling(block.data[::-1]).of(len(block.data) - start - LENGTH, len(block.data) - start)
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c).take(pa.array(owner)) for c in ("doc_id", "check", "gram", "alone")], pa.array((place[owner] >> 16) + string),
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "check", "gram", "alone", "start", "one", "two"])

    every = rows.mapInArrow(run, f"doc_id {kind}, check long, gram long, alone boolean, start long, one long, two long")
    twice = every.groupBy("gram", "one", "two").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    found = salted_join(every.filter("alone"), twice, ["gram", "one", "two"], "inner", SALTS)
    return found.select("doc_id", "check", "start", (F.col("start") + LENGTH).alias("end"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept holds the remaining bytes."""
    spans = covered(docs)
    rows = docs.select("doc_id", row_check().alias("check"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, "text"):
                lists = part.column("spans")
                size = lists.value_lengths().fill_null(0).to_numpy()
                wanted = lists.flatten()
                text = np.repeat(np.arange(len(block)), size)
                start, end = wanted.field(0).to_numpy(), wanted.field(1).to_numpy()
                if (end > np.diff(block.off)[text]).any():
                    raise ValueError("two texts under one id share a 64-bit hash")
                base = block.off[text]
                change = np.zeros(len(block.data) + 1, np.int64)
                np.add.at(change, base + start, 1)
                np.add.at(change, base + end, -1)
                gone = np.cumsum(change)[:-1] > 0
                before = np.r_[False, gone][:len(gone)]
                before[block.off[:-1][block.off[:-1] < len(gone)]] = False  # a run ends with its text
                runs, sums = np.r_[0, np.cumsum(gone & ~before)], np.r_[0, np.cumsum(gone)]
                stay = ~gone
                kept = [block.data[a:b][stay[a:b]].tobytes() for a, b in zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(block.off)), pa.array(np.diff(sums[block.off])), pa.array(np.diff(runs[block.off])),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    met = _matched(rows, spans, "left").select("doc_id", "text", "spans")
    return met.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
