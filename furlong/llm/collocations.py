"""Phrases of two to four words by a multikey three-way quicksort of suffix pointers.

Texts are cut into pieces at punctuation and line ends, pieces into words.  A suffix is the place of a word with what follows in its piece, up to
``DEEPEST`` words.  The pointers of a set of suffixes are sorted word by word: a pivot splits them by their next word into smaller, equal
and larger ones; the equal part shares one word more and is sorted on by the word after it.  Its size is the count of the phrase it shares.

1. Every task sorts the suffixes of its blocks, which sums equal ones: one record a distinct suffix, one a distinct word.
2. Records are routed over the cluster by their two leading words, so that all suffixes of a phrase meet; those of one block and one bucket of routes travel in
   one compressed packet.  Pairs of words that hold a large part of all places are dealt by all words of their records instead: at most ``SHARES`` pairs, and each
   that has one place in 400 (a first pass sums the pairs with one in ``SHARES`` / 4 of some block, which hides less than that part).
3. Every task sorts the records of its buckets, a bounded number at a time, and abandons partitions below ``LEAST``.  Of dealt pairs, and of a bucket too large for
   one go, it gives all partial sums, which one aggregate adds up.
4. Phrases are scored by joins with the counts of their parts, and compared with the longer phrases that hold them.

Counts are per language.  Defined results: null texts are empty, a null language is ``und``; repeated rows count each; texts without words, and an
empty table, give no phrase; a language with fewer phrases gives what it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm.frames import salted_join, stored
from furlong.llm.textblock import LOWER, Block, Rolling, blocks, expanded, mixed, spans

DEEPEST = 4
LEAST = 30
TOP = 2000
#: A longer phrase that is this part of a shorter one's occurrences takes its place, in hundredths.
COVER = 80
SCALE = 2_000_000
SHARES = 2000
BLOCK_BYTES = 2 << 20
#: Records that are sorted at a time, and the size below which partitions are finished together by one sort.
CHUNK = 400_000
SMALL = 1 << 14

#: Bytes that end a piece, and bytes that end a word.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
OUTSIDE = ENDS.copy()
OUTSIDE[[0x20, 0x09]] = True


# ---------------------------------------------------------------- sorting
@dataclass
class Parts:
    """Partitions: a pointer into each, how many words its suffixes share, and their weight."""

    pointer: np.ndarray
    words: np.ndarray
    weight: np.ndarray


class _Found:
    def __init__(self):
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]

    def add(self, pointer: np.ndarray, words: int, weight: np.ndarray) -> None:
        self.rows.append((pointer, np.full(len(pointer), words, np.int64), weight))

    def parts(self) -> Parts:
        return Parts(*map(np.concatenate, zip(*self.rows, strict=True)))


def quicksort(key: Callable[[np.ndarray, int], np.ndarray], pointers: np.ndarray, weights: np.ndarray, least: int = 1, deepest: int = DEEPEST) -> tuple[Parts, Parts]:
    """All equal partitions, and those at which the sorting ends: at ``deepest`` words or at the end of the suffix.

    ``key(pointers, depth)`` is the number of the word at this depth, -1 past the end.  Partitions whose weight is below ``least`` are not sorted on.
    """
    equal, last = _Found(), _Found()
    small: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(deepest)]
    open_ = [(pointers, weights, 0)]
    while open_:
        pointer, weight, depth = open_.pop()
        if len(pointer) <= SMALL:
            small[depth].append((pointer, weight))
            continue
        word = key(pointer, depth)
        pivot = np.partition(word[::len(word) // 63], 31)[31]
        for part in (word < pivot, word > pivot):
            if part.any():
                open_.append((pointer[part], weight[part], depth))
        same = word == pivot
        pointer, weight = pointer[same], weight[same]
        total = weight.sum()
        if pivot < 0:
            last.add(pointer[:1], depth, np.array([total]))
            continue
        equal.add(pointer[:1], depth + 1, np.array([total]))
        if total >= least:
            if depth + 1 < deepest:
                open_.append((pointer, weight, depth + 1))
            else:
                last.add(pointer[:1], deepest, np.array([total]))
    none = np.zeros(0, np.int64)
    pointer, weight, part = none, none, none  # small partitions of one depth are sorted together
    for depth in range(deepest):
        sizes = np.array([len(p) for p, _ in small[depth]], np.int64)
        base = int(part[-1]) + 1 if len(part) else 0
        part = np.concatenate([part, np.repeat(np.arange(len(sizes)) + base, sizes)])
        pointer = np.concatenate([pointer, *(p for p, _ in small[depth])])
        weight = np.concatenate([weight, *(w for _, w in small[depth])])
        if not len(pointer):
            continue
        word = key(pointer, depth) + 1
        both = part * (int(word.max()) + 1) + word
        order = np.argsort(both)
        both, pointer, weight, word = both[order], pointer[order], weight[order], word[order]
        heads = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        size = np.diff(np.append(heads, len(both)))
        total = np.add.reduceat(weight, heads)
        ended = word[heads] == 0
        last.add(pointer[heads[ended]], depth, total[ended])
        equal.add(pointer[heads[~ended]], depth + 1, total[~ended])
        on = ~ended & (total >= least)
        if depth + 1 == deepest:
            last.add(pointer[heads[on]], deepest, total[on])
        kept = np.repeat(on, size)
        part = np.repeat(np.cumsum(on) - 1, size)[kept]
        pointer, weight = pointer[kept], weight[kept]
    return equal.parts(), last.parts()


# ---------------------------------------------------------------- words
@dataclass
class Words:
    """Words with one space after each; ``number`` is equal for equal words of one language, ``room`` the words from one to the end of its piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    number: np.ndarray
    room: np.ndarray
    group: np.ndarray

    def key(self, pointers: np.ndarray, depth: int) -> np.ndarray:
        return np.where(self.room[pointers] > depth, self.number[np.minimum(pointers + depth, len(self.number) - 1)], -1)

    def phrases(self, parts: Parts) -> pa.Array:
        start = self.start[parts.pointer]
        size = self.end[parts.pointer + parts.words - 1] - start
        return texts(self.data[expanded(start, size)], size)


def texts(data: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))


def words(block: Block, outside: np.ndarray, ends: np.ndarray, groups: np.ndarray) -> Words:
    """The words between bytes ``outside``, in pieces between bytes in ``ends``; ``groups`` numbers the language of every text."""
    start, end, doc = spans(block, outside)
    size = end - start
    plain = LOWER[block.data[expanded(start, size)]]
    number = texts(plain, size).cast(pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    group = groups[doc]
    number = number + group * (int(number.max()) + 1 if len(number) else 1)
    at = np.cumsum(size + 1) - size - 1
    data = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    data[expanded(at, size)] = plain
    closed = np.concatenate([[0], np.cumsum(ends[block.data])])
    final = np.ones(len(start), bool)
    final[:-1] = (doc[1:] != doc[:-1]) | (closed[start[1:]] > closed[end[:-1]])
    stops = np.flatnonzero(final)
    room = stops[np.searchsorted(stops, np.arange(len(start)))] - np.arange(len(start)) + 1 if len(start) else size
    return Words(data, at, at + size, number, room, group)


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct languages, their hashes, and the number of every row's language."""
    coded = batch.column("lang").dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = [int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "little") for s in names]
    return names, np.array(hashes, np.uint64), coded.indices.to_numpy().astype(np.int64)


def _routes(found: Words, rolling: Rolling, pointers: np.ndarray, n: np.ndarray | int, hashes: np.ndarray) -> np.ndarray:
    """Hashes of language and the first ``n`` words."""
    return mixed(rolling.of(found.start[pointers], found.end[pointers + n - 1]) + hashes[found.group[pointers]])


# ---------------------------------------------------------------- Spark
def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words by language, and the hashes of pairs of words with one place in ``SHARES`` / 4 of a block or more, with their places."""
    for batch in batches:
        for rows, block in blocks(batch, "text", BLOCK_BYTES):
            names, hashes, groups = _languages(rows)
            found = words(block, OUTSIDE, ENDS, groups)
            pointers = np.flatnonzero(found.room > 1)
            lead, times = np.unique(_routes(found, Rolling(found.data), pointers, 2, hashes), return_counts=True)
            many = times * (SHARES // 4) >= len(pointers)
            lead, times = lead[many].view(np.int64).tolist(), times[many].tolist()
            n = np.bincount(found.group, minlength=len(names)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names + [None] * len(lead), pa.string()), pa.array([None] * len(names) + lead, pa.int64()), pa.array(n + times, pa.int64())],
                ["lang", "lead", "c"])


PACKETS = "bucket long, dealt boolean, n long, names array<string>, records binary"


def _packed(found: Words, parts: Parts, names: list[str], bucket: np.ndarray, dealt: np.ndarray) -> pa.RecordBatch:
    """One row for the records of each bucket: counts, numbers of languages and phrases, compressed together."""
    order = np.lexsort((bucket, dealt))
    parts = Parts(parts.pointer[order], parts.words[order], parts.weight[order])
    bucket, dealt = bucket[order], dealt[order]
    start = found.start[parts.pointer]
    size = found.end[parts.pointer + parts.words - 1] + 1 - start
    data = found.data[expanded(start, size)]
    off = np.concatenate([[0], np.cumsum(size)])
    data[off[1:] - 1] = 0x0A
    heads = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (dealt[1:] != dealt[:-1])]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(bucket))[:len(heads)]
    weight, group = parts.weight.astype("<i8"), found.group[parts.pointer].astype("<i4")
    records = [
        pa.compress(weight[a:b].tobytes() + group[a:b].tobytes() + data[x:y].tobytes(), "zstd", asbytes=True)
        for a, b, x, y in zip(heads.tolist(), ends.tolist(), off[heads].tolist(), off[ends].tolist(), strict=True)]
    sizes = (ends - heads) * 12 + off[ends] - off[heads]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[heads]), pa.array(dealt[heads]), pa.array(ends - heads), pa.array([names] * len(heads), pa.list_(pa.string())),
         pa.array([int(n).to_bytes(8, "little") + r for n, r in zip(sizes, records, strict=True)], pa.binary())],
        ["bucket", "dealt", "n", "names", "records"])


def suffixes(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """All distinct suffixes of two words or more, and all distinct words, of every block, in packets by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks(batch, "text", BLOCK_BYTES):
                names, hashes, groups = _languages(rows)
                found = words(block, OUTSIDE, ENDS, groups)
                pointers = np.arange(len(found.start))
                equal, last = quicksort(found.key, pointers, np.ones(len(pointers), np.int64))
                single, long = equal.words == 1, last.words > 1
                rolling = Rolling(found.data)
                route = _routes(found, rolling, last.pointer[long], 2, hashes)
                dealt = np.isin(route, hot)
                route[dealt] = _routes(found, rolling, last.pointer[long][dealt], last.words[long][dealt], hashes)
                route = np.concatenate([_routes(found, rolling, equal.pointer[single], 1, hashes), route])
                parts = Parts(*(np.concatenate([a[single], b[long]]) for a, b in zip(
                    (equal.pointer, equal.words, equal.weight), (last.pointer, last.words, last.weight), strict=True)))
                bucket = (route % np.uint64(buckets)).astype(np.int64)
                yield _packed(found, parts, names, bucket, np.concatenate([np.zeros(int(single.sum()), bool), dealt]))

    return docs.mapInArrow(run, PACKETS)


BETWEEN = np.zeros(256, bool)
BETWEEN[[0x20, 0x0A]] = True
LINE_ENDS = np.zeros(256, bool)
LINE_ENDS[0x0A] = True


def _counted(packets: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of all phrases that begin the records; those below ``least`` are abandoned."""
    if not packets.num_rows:
        return
    known: dict[str, int] = {}
    weights, groups, data = [], [], []
    for n, names, records in zip(*(packets.column(c).to_pylist() for c in ("n", "names", "records")), strict=True):
        raw = pa.decompress(records[8:], int.from_bytes(records[:8], "little"), "zstd", asbytes=True)
        weights.append(np.frombuffer(raw, "<i8", n))
        code = np.array([known.setdefault(name, len(known)) for name in names], np.int64)
        groups.append(code[np.frombuffer(raw, "<i4", n, 8 * n)])
        data.append(np.frombuffer(raw, np.uint8, offset=12 * n))
    joined = np.concatenate(data)
    off = np.concatenate([[0], np.flatnonzero(joined == 0x0A) + 1])
    found = words(Block(joined, off), BETWEEN, LINE_ENDS, np.concatenate(groups))
    heads = np.flatnonzero(np.r_[True, found.room[:-1] == 1])  # every record is one piece
    weight, alone = np.concatenate(weights), found.room[heads] == 1
    first, of = np.unique(found.number[heads[alone]], return_index=True, return_inverse=True)[1:]
    single = Parts(heads[alone][first], np.ones(len(first), np.int64), np.bincount(of, weight[alone], len(first)).astype(np.int64))
    equal, _ = quicksort(found.key, heads[~alone], weight[~alone], least)
    names = pa.array(list(known), pa.string())
    for parts, fewest in ((single, 1), (equal, 2)):
        kept = (parts.words >= fewest) & (parts.weight >= least)
        parts = Parts(parts.pointer[kept], parts.words[kept], parts.weight[kept])
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(found.group[parts.pointer])), found.phrases(parts), pa.array(parts.words, pa.int32()), pa.array(parts.weight)],
            ["lang", "phrase", "words", "c"])


def _sorted_buckets(least: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packets come by bucket; as many whole buckets as make up ``chunk`` records are sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        records, partial = 0, None  # the bucket that a cut went through

        def sort(table: pa.Table, cut: int | None) -> Iterator[pa.RecordBatch]:
            open_ = table.column("dealt").to_numpy() | np.isin(table.column("bucket").to_numpy(), [b for b in (partial, cut) if b is not None])
            yield from _counted(table.filter(pa.array(~open_)), least)
            yield from _counted(table.filter(pa.array(open_)), 1)

        for batch in batches:
            for k in range(batch.num_rows):
                held.append(batch.slice(k, 1))
                records += held[-1].column("n")[0].as_py()
                if records < chunk:
                    continue
                table = pa.Table.from_batches(held)
                bucket = table.column("bucket").to_numpy()
                first = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if not first and records < 2 * chunk:
                    continue
                cut = None if first else int(bucket[-1])
                yield from sort(table.slice(0, first or len(bucket)), cut)
                partial = cut
                held = held[first:] if first else []
                records = sum(b.column("n")[0].as_py() for b in held)
        if held:
            yield from sort(pa.Table.from_batches(held), None)

    return run


def counts(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, shares: int = SHARES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to ``DEEPEST`` words found ``least`` times or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    first = stored(rows.mapInArrow(_first_pass, "lang string, lead long, c long").groupBy("lang", "lead").agg(F.sum("c").alias("c")), "leads")
    sizes = first.filter(F.col("lead").isNull()).select("lang", F.col("c").alias("n"))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    # the sums hide less than one place in SHARES / 4 of a pair
    heavy = first.filter(F.col("lead").isNotNull() & (F.col("c") * shares >= total)).select("lead").collect()  # at most ``shares``
    hot = np.array(sorted(r["lead"] for r in heavy), np.int64).view(np.uint64)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // chunk))
    found = suffixes(rows, hot, buckets).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _sorted_buckets(least, chunk), "lang string, phrase string, words int, c long")
    phrases = found.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
    return stored(phrases, "phrases"), sizes


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every phrase of two words or more, by its lowest-scoring cut."""
    part = F.split("phrase", " ")
    cut = phrases.filter("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({
        "_first": F.array_join(F.slice(part, 1, F.col("k")), " "),
        "_rest": F.array_join(F.slice(part, F.col("k") + 1, F.col("words")), " ")}).withColumnRenamed("f", "a")
    of = phrases.filter(F.col("words") < DEEPEST)
    for side, name in (("_first", "l"), ("_rest", "r")):
        cut = salted_join(cut, of.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], "inner", 8)
    exact = F.expr(f"cast(cast({SCALE} as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    best = F.min(F.struct(exact.alias("score"), "k", "l", "r"))
    return cut.groupBy("lang", "phrase", "words", "a").agg(best.alias("_best")).select("lang", "phrase", "words", "a", "_best.l", "_best.r", "_best.score")


def uncovered(found: DataFrame, cover: int = COVER) -> DataFrame:
    """``found`` without the phrases inside a longer one that has ``cover`` hundredths of their occurrences."""
    part = F.split("phrase", " ")
    inside = found.filter("words > 2").select(
        "lang", "a", part.alias("_part"), "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("_size")).select(
        "lang", "a", F.explode(F.transform(
            F.sequence(F.lit(1), F.col("words") - F.col("_size") + 1), lambda i: F.array_join(F.slice("_part", i, F.col("_size")), " "))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    return found.join(most, ["lang", "phrase"], "left").filter(
        F.col("_most").isNull() | (F.col("_most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover)).drop("_most")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, **plan: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language."""
    phrases, sizes = counts(docs, least, **plan)
    found = uncovered(stored(scored(phrases), "scored"), cover)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = found.withColumn("rank", place).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
