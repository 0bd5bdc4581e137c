"""Benchmark decontamination by Wu-Manber search over words.

The test strings are the windows of ``WINDOW`` consecutive words of every benchmark item; an item of fewer words, but
not none, is one shorter window.  Windows of one number of words form a class with tables of its own, so that a short item
does not shorten the shifts of the others.  In a class of m-word windows

* the shift table says for every hash of a block of ``BLOCK`` words how far the search may go on from a position at which the
  block ends: m - BLOCK + 1 words if no window holds the block, and else the distance from its last place to the window's end;
* where the shift is zero, the bucket of the hash of the window's last block lists the windows that end so, in the order of their whole hash;
* the window that is found there is compared with the text byte by byte.

Texts are searched a block at a time: the words of a block are dealt to lanes, and all lanes go on together, each by its own shift.

Windows and their items are a table.  It is searched in parts of about ``PART_BYTES``, dealt by hash, which bounds what is broadcast and what a
worker holds at any size of the benchmark; a window that many items share is dealt over the parts as well.

Words are runs of digits, letters a-z and characters beyond ASCII, A-Z in lower case.  Defined results: null and empty texts
have no words and no hits; an item without words has no window; an item id names one item, whichever rows carry it, and a null id is an item
named by the empty string; every row of the documents gives a row, repeated ones too; without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.frames import salted_join, stored
from furlong.llm.textblock import LOWER, Block, Rolling, blocks, expanded, spans

WINDOW = 10
BLOCK = 2
PART_BYTES = 8 << 20
#: Word places that a lane goes through.
LANE = 128
#: Bits of the hash that the shift table is read by.
SHIFT_BITS = 20

#: Bytes that are in no word: all of ASCII but digits and letters.
OUTSIDE = np.ones(256, bool)
OUTSIDE[48:58] = OUTSIDE[65:91] = OUTSIDE[97:123] = False
OUTSIDE[128:] = False


@dataclass
class Words:
    """``data`` holds the words of all texts with one space after each; word i is ``data[start[i]:end[i]]``, of text ``doc[i]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    rolling: Rolling

    def hashes(self, first: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from ``first`` on."""
        return self.rolling.of(self.start[first], self.end[first + n - 1])


def words(block: Block) -> Words:
    start, end, doc = spans(block, OUTSIDE)
    size = end - start
    at = np.cumsum(size + 1) - size - 1
    data = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    data[expanded(at, size)] = LOWER[block.data[expanded(start, size)]]
    return Words(data, at, at + size, doc, Rolling(data))


def merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges [first, last) of every row with overlapping and adjacent ones joined, in order."""
    if not len(row):
        return row, first, last
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    wide = int(last.max()) + 1
    reach = np.maximum.accumulate(last + row * wide) - row * wide  # rows before have smaller sums
    new = np.r_[True, (row[1:] != row[:-1]) | (first[1:] > reach[:-1])]
    heads = np.flatnonzero(new)
    return row[heads], first[heads], reach[np.r_[heads[1:] - 1, len(row) - 1]]


# ---------------------------------------------------------------- tables
class Windows:
    """The tables of all windows of ``n`` words."""

    def __init__(self, texts: list[bytes], numbers: np.ndarray, n: int):
        self.n, self.block, self.numbers = n, min(BLOCK, n), numbers
        raw = Block(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        found = words(raw)
        self.data, first = found.data, np.arange(len(texts)) * n
        self.start, self.end = found.start[first], found.end[first + n - 1]
        self.shift = np.full(1 << SHIFT_BITS, n - self.block + 1, np.uint8 if n < 256 else np.int64)
        for j in range(n - self.block + 1):
            at = found.hashes(first + j, self.block) >> np.uint64(64 - SHIFT_BITS)
            np.minimum.at(self.shift, at.astype(np.int64), n - self.block - j)
        tail, whole = found.hashes(first + n - self.block, self.block), found.hashes(first, n)
        order = np.lexsort((whole, tail))
        self.tail, self.whole, self.order = tail[order], whole[order], order

    def search(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences, and the numbers of the windows that occur there."""
        places, tails = self._stops(text)
        inside = text.doc[places - self.n + 1] == text.doc[places]
        first, tails = places[inside] - self.n + 1, tails[inside]
        low, high = np.searchsorted(self.tail, tails, "left"), np.searchsorted(self.tail, tails, "right")
        full = np.flatnonzero(low < high)
        first, low, high = first[full], low[full], high[full]
        whole = text.hashes(first, self.n)
        at, top = low, high
        while (open_ := at < top).any():  # the first place in the bucket whose hash is not smaller
            middle = (at + top) // 2
            less = open_ & (self.whole[np.minimum(middle, len(self.whole) - 1)] < whole)
            at, top = np.where(less, middle + 1, at), np.where(less | ~open_, top, middle)
        starts, numbers = [], []
        while len(at):  # as many rounds as different windows share a hash
            same = (at < high) & (self.whole[np.minimum(at, len(self.whole) - 1)] == whole)
            first, at, high, whole = first[same], at[same], high[same], whole[same]
            equal = self._equal(text, first, self.order[at])
            starts.append(first[equal])
            numbers.append(self.numbers[self.order[at[equal]]])
            at = at + 1
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *numbers])

    def _stops(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """Last words of the places where the shift is zero, with the hash of the block there."""
        n = len(text.start)
        at = np.arange(self.n - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        places, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while len(at):
            tail = text.hashes(at - self.block + 1, self.block)
            shift = self.shift[(tail >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)].astype(np.int64)
            zero = shift == 0
            places.append(at[zero])
            tails.append(tail[zero])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(places), np.concatenate(tails)

    def _equal(self, text: Words, first: np.ndarray, window: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
        """Whether the words from ``first`` on are those of the window, byte by byte."""
        a, b = text.start[first], self.start[window]
        size = text.end[first + self.n - 1] - a
        equal = size == self.end[window] - b
        for k in range(0, len(first), chunk):
            part = np.flatnonzero(equal[k:k + chunk]) + k
            differ = text.data[expanded(a[part], size[part])] != self.data[expanded(b[part], size[part])]
            if differ.any():
                equal[part[np.unique(np.repeat(np.arange(len(part)), size[part])[differ])]] = False
        return equal


class Finder:
    """The tables of one part of the windows, a class for each number of words, with the items of every window."""

    def __init__(self, table: pa.Table):
        pairs = table.group_by(["n", "window"], use_threads=False).aggregate([("item", "list")])
        sizes, texts = pairs.column("n").to_numpy(), pairs.column("window").cast(pa.binary()).to_pylist()
        self.items = pairs.column("item_list").to_pylist()
        self.classes = [
            Windows([texts[k] for k in of], of, int(n)) for n in np.unique(sizes) for of in [np.flatnonzero(sizes == n)]]

    def found(self, block: Block) -> tuple[np.ndarray, tuple[np.ndarray, ...], dict[int, list[str]]]:
        """Numbers of words by text, the hit ranges of words (text, first, last), and the items by hit text."""
        text = words(block)
        count = np.bincount(text.doc, minlength=len(block))
        before = np.cumsum(count) - count
        none = np.zeros(0, np.int64)
        rows, firsts, lasts, pairs = [none], [none], [none], [np.zeros((0, 2), np.int64)]
        for windows in self.classes:
            first, number = windows.search(text)
            doc = text.doc[first]
            rows.append(doc)
            firsts.append(first - before[doc])
            lasts.append(first - before[doc] + windows.n)
            pairs.append(np.unique(np.stack([doc, number], 1), axis=0))
        ranges = merged(np.concatenate(rows), np.concatenate(firsts), np.concatenate(lasts))
        items: dict[int, list[str]] = {}
        known: dict[bytes, list[str]] = {}
        pair = np.concatenate(pairs)
        pair = pair[np.argsort(pair[:, 0], kind="stable")]
        heads = np.flatnonzero(np.r_[True, pair[1:, 0] != pair[:-1, 0]]) if len(pair) else none
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(pair))[:len(heads)].tolist(), strict=True):
            numbers = pair[a:b, 1]
            key = numbers.tobytes()
            if key not in known:  # copies have the same windows
                known[key] = sorted({item for k in numbers.tolist() for item in self.items[k]})
            items[int(pair[a, 0])] = known[key]
        return count, ranges, items


# ---------------------------------------------------------------- Spark
HITS = "array<struct<first:int,last:int>>"


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(n, window, item), each once: the windows of all items, as words between single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks(batch, "text"):
                text = words(block)
                count = np.bincount(text.doc, minlength=len(block))
                each = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
                size = np.repeat(np.minimum(count, n), each)
                first = expanded(np.cumsum(count) - count, each)
                raw = text.data.tobytes()
                found = [raw[a:b].decode() for a, b in zip(text.start[first].tolist(), text.end[first + size - 1].tolist(), strict=True)]
                names = rows.column("item").take(pa.array(np.repeat(np.arange(len(block)), each)))
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(found, pa.string()), names], ["n", "window", "item"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(run, "n int, window string, item string").distinct()


def _ranges(count: int, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    off = np.searchsorted(row, np.arange(count + 1))
    pair = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pair)


def scan(docs: DataFrame, table: pa.Table, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of every row, n_words, the hit ranges and the items of the windows in ``table``."""
    finder = docs.sparkSession.sparkContext.broadcast(Finder(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks(batch, "text"):
                count, ranges, items = finder.value.found(block)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in kept), pa.array(count, pa.int64()), _ranges(len(block), *ranges),
                     pa.array([items.get(k, []) for k in range(len(block))], pa.list_(pa.string()))],
                    [*kept, "n_words", "hits", "items"])

    types = dict(docs.dtypes)
    return docs.select(*kept, "text").mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"n_words long, hits {HITS}, items array<string>"]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping ranges of every row joined."""
    for batch in batches:
        lists = batch.column("hits")
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        pair = lists.flatten()
        ranges = merged(row, pair.field("first").to_numpy().astype(np.int64), pair.field("last").to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("_text"), _ranges(len(lists), *ranges), batch.column("items")], ["_text", "hits", "items"])


def mark(docs: DataFrame, items: DataFrame, n: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, items) of every row of ``docs``.

    ``hits`` are the maximal ranges [first, last) of words inside windows of ``items``, ``items`` the sorted ids as text.
    """
    spark = docs.sparkSession
    tests = stored(windows(items, n), "windows")
    size = tests.agg(F.sum(F.length("window") + F.length("item") + F.lit(64)).alias("s")).first()["s"] or 0
    parts = max(1, -(-size // part_bytes))
    dealt = tests.withColumn("_part", F.pmod(F.xxhash64("window", "item"), F.lit(parts)))
    tables = [dealt.filter(F.col("_part") == k).drop("_part") for k in range(parts)]
    if parts == 1:
        return scan(docs, tables[0].toArrow(), ["doc_id"])
    # results follow from the text alone: parts meet by its digest
    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text"), "text")
    first = stored(scan(keyed, tables[0].toArrow(), ["doc_id", "_text"]), "part")
    found = first.select("_text", "hits", "items")
    for table in tables[1:]:
        found = found.union(stored(scan(keyed, table.toArrow(), ["_text"]).filter(F.size("hits") > 0).drop("n_words"), "part"))
    grouped = found.filter(F.size("hits") > 0).groupBy("_text").agg(
        F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    ranges = grouped.mapInArrow(_joined, f"_text string, hits {HITS}, items array<string>")
    return salted_join(first.select("doc_id", "_text", "n_words"), ranges, ["_text"]).select(
        "doc_id", "n_words", F.coalesce("hits", F.array().cast(HITS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
