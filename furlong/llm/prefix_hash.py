"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for two primes, the polynomial hash of every prefix; the hash of any span is a
difference of two entries, shifted to a common power.  So span equality takes constant time (``Prefixes.same``) and the longest common
extension of two places a binary search over lengths (``extension``).

A fingerprint is the length and hash of the whole text, plus a bottom sketch: the ``SKETCH`` smallest scrambled hashes among
all spans of ``SPAN`` bytes, each counted once.  Two fingerprints have the likeness of their span sets (Jaccard, estimated from the smallest
hashes of the union), 1 if the whole texts are equal.  Arrays are built a block of texts at a time.

Defined results: null and empty texts have one common fingerprint, of likeness 1 to itself and 0 to others; a text shorter than a
span is one span.  Rows are ordered by doc_id descending, null ids last, then by their text's hash; with repeated ids
this order stays total except among equal rows, which are interchangeable.

The order is cut into stretches by quantiles of the ids; an id (or null) that holds more than a stretch is cut further by its texts' hashes, so no
stretch grows with a hot id.  Only rows equal in both id and text stay in one stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.frames import text_key
from furlong.llm.textblock import BLOCK_BYTES, blocks, code_points, mixed

#: Bytes of text whose arrays, and those of the edited texts, are held at once.
HELD = 1 << 20
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244)
SPAN = 24
SKETCH = 48
#: Stretches of the descending order for each shuffle partition.
STRETCHES = 8

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base k and of its inverse modulo prime k, by doubling."""
    if k not in _tables or len(_tables[k][0]) < n + 1:
        size, p = max(n + 1, BLOCK_BYTES + 1), PRIMES[k]
        made = []
        for base in (BASES[k], pow(BASES[k], -1, p)):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = min(done, size - done)
                table[done:done + step] = table[:step] * np.uint64(pow(base, done, p)) % np.uint64(p)
                done += step
            made.append(table)
        _tables[k] = (made[0], made[1])
    return _tables[k]


class Prefixes:
    """Prefix arrays of a byte array."""

    def __init__(self, data: np.ndarray):
        self.sums, self.down = [], []
        for k, p in enumerate(PRIMES):
            up, down = _powers(k, len(data))
            sums = np.zeros(len(data) + 1, np.uint64)  # a running sum of 2**33 terms under 2**31 still fits
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)] % np.uint64(p), out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One 62-bit hash of each span."""
        one, two = ((s[ends] - s[starts]) % np.uint64(p) * d[starts] % np.uint64(p) for s, d, p in zip(self.sums, self.down, PRIMES, strict=True))
        return (one << np.uint64(31)) | two

    def windows(self, width: int) -> np.ndarray:
        """The hashes of all spans of one width, by start."""
        one, two = ((s[width:] - s[:-width]) % np.uint64(p) * d[:len(s) - width] % np.uint64(p) for s, d, p in zip(self.sums, self.down, PRIMES, strict=True))
        return (one << np.uint64(31)) | two

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.hashes(a, a + length) == self.hashes(b, b + length)


def extension(prefixes: Prefixes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common extension of the places a and b, at most ``most``: a binary search over span equality."""
    low, high = np.zeros(len(a), np.int64), np.asarray(most, np.int64).copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = prefixes.same(a, b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sketches(prefixes: Prefixes, off: np.ndarray) -> list[np.ndarray]:
    """The smallest distinct scrambled span hashes of every text, ascending."""
    n = int(off[-1])
    every = mixed(prefixes.windows(SPAN)) if n >= SPAN else np.zeros(0, np.uint64)
    found = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a < SPAN:
            found.append(mixed(prefixes.hashes(np.array([a]), np.array([b]))) if b > a else np.zeros(0, np.uint64))
            continue
        own = every[a:b - SPAN + 1]
        take = 2 * SKETCH
        while True:  # repeats may hide distinct values behind the first ones
            few = own if take >= len(own) else np.partition(own, take)[:take]
            distinct = np.unique(few)
            if len(distinct) >= SKETCH or take >= len(own):
                found.append(distinct[:SKETCH])
                break
            take *= 8
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common values among the ``SKETCH`` smallest of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    return float(len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union))


def written(size: int, whole: int, sketch: np.ndarray) -> str:
    return f"{size:x}-{whole:016x}-" + sketch.astype(">u8").tobytes().hex()


def _fingerprints(data: np.ndarray, off: np.ndarray) -> tuple[Prefixes, list[np.ndarray], np.ndarray]:
    prefixes = Prefixes(data)
    return prefixes, sketches(prefixes, off), prefixes.hashes(off[:-1], off[1:])


def _heads(ids: DataFrame) -> list[tuple]:
    """(stretch, doc_id, key) of the first row of every stretch that has rows, in order: one row a stretch."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.negative("doc_id").alias("down"), F.col("key"))).alias("first")
    rows = ids.groupBy("stretch").agg(first).orderBy("stretch").collect()
    return [(r["stretch"], None if r["first"]["none"] else -r["first"]["down"], r["first"]["key"]) for r in rows]


def in_order(docs: DataFrame) -> DataFrame:
    """(stretch, guest, doc_id, key, text), one stretch of the descending order after the other inside partitions; one shuffle of the texts.

    The first row of each stretch is also sent to the end of the stretch before it, as a guest, and the first of all to the end of the last.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    stretch = _stretches(docs)
    rows = docs.select("doc_id", text_key().alias("key"), "text").withColumn("stretch", stretch("doc_id", "key"))
    heads = _heads(rows.select("stretch", "doc_id", "key"))
    targets = [heads[k - 1][0] for k in range(len(heads))]  # of the first, the last
    table = spark.createDataFrame([(t, h[1], h[2]) for t, h in zip(targets, heads, strict=True)], f"_target int, _head {kind}, _key long")
    met = rows.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("key") == F.col("_key")))
    guests = met.groupBy("_target").agg(*[F.first(c).alias(c) for c in ("doc_id", "key", "text")])  # equal rows: one is enough
    columns = ["doc_id", "key", "text"]
    both = rows.select("stretch", F.lit(0).alias("guest"), *columns).unionByName(guests.select(F.col("_target").alias("stretch"), F.lit(1).alias("guest"), *columns))
    return both.repartition("stretch").sortWithinPartitions("stretch", "guest", F.col("doc_id").desc_nulls_last(), "key")


def _stretches(docs: DataFrame):
    """A column function of (doc_id, key) that numbers the stretches in the descending order.

    The ids between two quantiles are an interval, an id that is several quantiles has one of its own, and null ids have the last.  The keys
    of an interval, which are hashes, are cut evenly into as many stretches as its rows need.  Only the quantiles come to the driver, a fixed number.
    """
    n = STRETCHES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = docs.agg(
        F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("cuts"), F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids")).first()
    cuts, times = np.unique(np.array(facts["cuts"] or [], np.int64), return_counts=True)
    heavy = cuts[times > 1]
    bounds = np.union1d(cuts, heavy[heavy < np.iinfo(np.int64).max] + 1)
    parts = np.ones(len(bounds) + 2, np.uint64)
    parts[len(bounds) - np.searchsorted(bounds, heavy, "right")] = times[times > 1] + 1
    parts[-1] = 1 + n * (facts["rows"] - facts["ids"]) // max(1, facts["rows"])
    before = (np.cumsum(parts) - parts).astype(np.int64)

    @F.arrow_udf("int")
    def stretch(ids: pa.Array, key: pa.Array) -> pa.Array:
        above = len(bounds) - np.searchsorted(bounds, ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), "right")
        interval = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, above)
        rank = (key.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # of the signed key, from 0
        return pa.array((before[interval] + (rank * parts[interval] >> np.uint64(32)).astype(np.int64)).astype(np.int32), pa.int32())

    return stretch


OUTPUT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_start_edited", "same_start_next"]


def compare(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs``: its fingerprint, that of its edited text, how like they are to each other and to the next document's.

    ``same_start_*`` are the bytes that the text and the edited or the next text have in common at their start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.RecordBatch | None = None  # the row that still waits for the next one
        for batch in batches:
            for rows, _ in blocks(batch, "text", HELD):
                held = rows if carried is None else pa.concat_batches([carried, rows])
                if len(held) > 1:
                    yield _compared(held)
                carried = held.slice(len(held) - 1)

    kind = dict(docs.dtypes)["doc_id"]
    return in_order(docs).mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "same_start_edited long, same_start_next long")


def _compared(held: pa.RecordBatch) -> pa.RecordBatch:
    """The results of all rows but the last, which is only looked at; guests give none."""
    block = next(b for _, b in blocks(held, "text", 1 << 62))
    data, off, last = block.data, block.off, len(block) - 1
    points = code_points(block)
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    size = np.diff(points[off])
    first = points[off[:-1]]
    third = size // 3
    kept_end = np.where(third[:-1] > 0, places[first[:-1] + size[:-1] - third[:-1]], off[1:-1])
    taken = np.minimum(third[:-1], size[1:])
    next_end = np.where(taken > 0, places[first[1:] + taken], off[1:-1])
    raw = data.tobytes()
    edited = [raw[a:b] + raw[b2:c] for a, b, b2, c in zip(off[:-2].tolist(), kept_end.tolist(), off[1:-1].tolist(), next_end.tolist(), strict=True)]
    ends = np.cumsum([0, *map(len, edited)])
    every = np.concatenate([data, np.frombuffer(b"".join(edited), np.uint8)])
    both = np.concatenate([off, off[-1] + ends[1:]])
    prefixes, sketch, whole = _fingerprints(every, both)
    mine, other = both[:last], both[last + 1:-1]
    n_mine, n_other = np.diff(both)[:last], np.diff(both)[last + 1:]
    same_edited = extension(prefixes, mine, other, np.minimum(n_mine, n_other))
    same_next = extension(prefixes, mine, both[1:last + 1], np.minimum(n_mine, np.diff(both)[1:last + 1]))

    def near(i: int, j: int) -> float:
        equal = whole[i] == whole[j] and both[i + 1] - both[i] == both[j + 1] - both[j]
        return 1.0 if equal else likeness(sketch[i], sketch[j])

    lengths = np.diff(both)
    print_ = [written(int(n), int(w), s) for n, w, s in zip(lengths, whole, sketch, strict=True)]
    own = np.flatnonzero(held.column("guest").to_numpy()[:last] == 0)
    e = last + 1
    values = {
        "n_chars": pa.array(size[own]), "edited_sha256": pa.array([hashlib.sha256(edited[i]).hexdigest() for i in own], pa.string()),
        "fingerprint": pa.array([print_[i] for i in own], pa.string()), "edited_fingerprint": pa.array([print_[e + i] for i in own], pa.string()),
        "near_edited": pa.array([near(i, e + i) for i in own], pa.float64()), "near_next": pa.array([near(i, i + 1) for i in own], pa.float64()),
        "same_start_edited": pa.array(same_edited[own]), "same_start_next": pa.array(same_next[own])}
    return pa.RecordBatch.from_arrays([held.column("doc_id").take(pa.array(own)), *[values[c] for c in OUTPUT]], ["doc_id", *OUTPUT])
