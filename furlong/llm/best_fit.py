"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents become token ids, are cut into pieces of at most ``ROOM`` tokens, and the pieces are
range-sorted: a piece is its length and its rank among the pieces of that length.  Lengths are whole numbers up
to ``ROOM``, so sorted pieces, and sorted gaps, are runs: at most ``ROOM`` runs of equal lengths at any input size.  A round
sweeps pieces and gaps once from long to short; every piece takes the last gap that was passed and is still
free, which is its successor, the tightest one that holds it.  Where several pieces have the same successor, ranks
decide: the lower rank gets it, the others the next gap up.  Then gaps shrink by what they got and the next round
starts.  When no piece fits any gap, the longest pieces open sequences, as many as the remaining tokens need
at least.

The sweeps work on runs only, and give runs: "ranks r to r + n of length l go to sequences s to s + n at
this place".  Every row finds its run by (length, rank) in a broadcast table whose size is bounded by rounds times
``ROOM``, never by the number of rows.

Defined results: a null or empty text is one piece, the closing id alone; repeated rows are packed each; an empty
table gives no piece.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm.frames import stored
from furlong.llm.textblock import LOWER, WHITE, Block, Rolling, blocks, mixed, spans

ROOM = 2048
CLOSE = 0
VOCABULARY = "word_bpe_49k.json"
#: Units whose ids a worker remembers; beyond it the memory starts anew.
KNOWN = 600_000
SALTS = 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Byte-level vocabularies write the bytes that have no printable Latin-1 character as the characters from 256 on.
_BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- tokens
class Units:
    """Ids of texts by units that the vocabulary never crosses, so each distinct unit is encoded once.

    White space always ends a unit.  Words of ASCII and Latin-1 letters, without an apostrophe or the string of a special token, are also cut between letters and
    other characters, and compared in lower case, as the vocabulary does; all other words are one unit.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted keys, and where their ids are listed
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.filled = 0

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys, -1 for new ones."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, self.places[at], -1) if len(self.keys) else np.full(len(keys), -1)

    def _encoded(self, unit: bytes) -> list[int]:
        """Plain letters are one word of the model; everything else takes the whole way."""
        if _PLAIN.fullmatch(unit):
            return [t.id for t in self.tokenizer.model.tokenize(unit.decode().lower().encode().decode("latin-1").translate(_BYTES))]
        return self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        found = [self._encoded(unit) for unit in units]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while self.filled + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.filled:self.filled + total] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, total)
        places = np.arange(len(self.starts), len(self.starts) + len(keys))
        self.starts = np.concatenate([self.starts, self.filled + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.filled += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.places = np.insert(self.keys, at, keys), np.insert(self.places, at, places)

    def _cut(self, block: Block) -> tuple[np.ndarray, ...]:
        """Starts, ends, text numbers and keys of the units."""
        data = block.data
        starts, ends, doc = spans(block, WHITE)
        high = data >= 0x80
        after = np.zeros(len(data), bool)  # second byte of a character from U+00C0 to U+00FF
        after[1:] = (data[:-1] == 0xC3) & high[1:]
        odd = (data == 0x27) | (high & ~after & (data != 0xC3)) | (after & ((data == 0x97) | (data == 0xB7)))
        raw = data.tobytes()
        marked = [m.start() for t in self.special for m in re.finditer(re.escape(t), raw)]
        odd[marked] = True
        sums = np.concatenate([[0], np.cumsum(odd)])
        plain = sums[ends] == sums[starts]
        letter = _LETTER[data]
        turn = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        word = np.searchsorted(starts, turn, "right") - 1
        turn = turn[(word >= 0) & (turn > starts[word]) & (turn < ends[word]) & plain[word]] if len(starts) else turn[:0]
        low = LOWER[data]
        low[after & (data < 0x9F) & (data != 0x97)] += 0x20
        cut = np.sort(np.concatenate([starts, turn]))
        end = np.sort(np.concatenate([ends, turn]))
        keys = Rolling(low).of(cut, end)
        if marked:  # the case of special tokens matters
            whole = np.unique(np.searchsorted(cut, marked, "right") - 1)
            keys[whole] = mixed(Rolling(data).of(cut[whole], end[whole]) + np.uint64(1))
        return cut, end, np.searchsorted(block.off, cut, "right") - 1, keys

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, each text closed by ``CLOSE``, and the offsets of the texts."""
        starts, ends, doc, keys = self._cut(block)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = self._known(distinct)
        if (new := np.flatnonzero(at < 0)).size:
            if len(self.keys) + len(new) > KNOWN:
                self._clear()
                new = np.arange(len(distinct))
            raw = block.data.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = self._known(distinct)
        at = at[back]
        size = self.sizes[at]
        off = np.concatenate([[0], np.cumsum(np.bincount(doc, size, len(block)).astype(np.int64) + 1)])
        out = np.full(off[-1], CLOSE, np.uint32)
        before = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(before, size)
        out[np.repeat(before + doc, size) + inner] = self.ids[np.repeat(self.starts[at], size) + inner]  # one closing id for each earlier text
        return out, off


_units: dict[str, Units] = {}


def _of_worker(path: str) -> Units:
    """The units that this worker's earlier tasks have met stay known."""
    if path not in _units:
        _units[path] = Units(path)
    return _units[path]


def pieces(docs: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _of_worker(path)
        for batch in batches:
            for rows, block in blocks(batch, "text", 1 << 20):
                ids, off = units.block(block)
                size = np.diff(off)
                count = -(-size // room)
                doc = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * room
                length = np.minimum(size[doc] - start, room)
                raw = ids.astype("<u4").view(np.uint8).data
                at = (off[doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- rounds
def rounds(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) that place ``counts[length]`` pieces of every length."""
    placed: list[tuple[int, int, int, int, int]] = []
    waiting = {length: [0, n] for length, n in counts.items() if n > 0}  # next rank, how many
    gaps: dict[int, list[list[int]]] = {}  # gap -> runs [first sequence, number]
    opened = 0

    def place(length: int, first: int, n: int, gap: int) -> None:
        placed.append((length, waiting[length][0], n, first, room - gap))
        waiting[length][0] += n
        waiting[length][1] -= n
        if gap > length:
            fresh.setdefault(gap - length, []).append([first, n])

    while any(n for _, n in waiting.values()):
        fresh: dict[int, list[list[int]]] = {}
        took = False
        free: list[tuple[int, list[int]]] = []  # gaps passed and not taken, the tightest last
        for size in sorted(set(gaps) | {k for k, v in waiting.items() if v[1]}, reverse=True):
            free += [(size, run) for run in gaps.get(size, ())]
            while size in waiting and waiting[size][1] and free:
                gap, run = free[-1]
                n = min(run[1], waiting[size][1])
                place(size, run[0], n, gap)
                run[0], run[1], took = run[0] + n, run[1] - n, True
                if not run[1]:
                    free.pop()
        for gap, run in free:
            fresh.setdefault(gap, []).append(run)
        if not took:
            left = sorted((k for k, v in waiting.items() if v[1]), reverse=True)
            need = -(-sum(k * waiting[k][1] for k in left) // room)
            # pieces over half the room never share: each opens a sequence
            need = max(need, sum(waiting[k][1] for k in left if 2 * k > room))
            for length in left:
                n = min(need, waiting[length][1])
                if n:
                    place(length, opened, n, room)
                    opened, need = opened + n, need - n
        gaps = fresh
    return placed


def packed(found: DataFrame, room: int = ROOM) -> DataFrame:
    """``found`` (with length) plus sequence_id and offset."""
    spark = found.sparkSession
    # rank among equal lengths: place within (length, salt), after the rows of the salts before; no length is ranked in one task
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    salted = found.withColumn("_salt", salt)
    cells = stored(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "cells")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``room`` rows
    runs = rounds(counts, room)
    plan = spark.createDataFrame(
        pa.table({name: pa.array([r[k] for r in runs], pa.int64()) for k, name in enumerate(("_length", "_first", "_count", "_sequence", "offset"))}).to_pandas()
        if runs else [], "_length long, _first long, _count long, _sequence long, offset long")
    inner = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_inner", inner).join(
        cells.select(F.col("length").alias("_of"), F.col("_salt").alias("_cell"), before.alias("_before")),
        (F.col("length") == F.col("_of")) & (F.col("_salt") == F.col("_cell")))
    rank = ranked.withColumn("_rank", F.col("_before") + F.col("_inner"))
    return rank.join(
        F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    ).withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_first")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(docs: DataFrame, path: str | None = None, room: int = ROOM) -> DataFrame:
    return packed(stored(pieces(docs, path or vocabulary(), room), "pieces"), room)
