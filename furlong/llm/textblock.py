"""Texts of an Arrow batch as one byte array, so that word, line and span work is done on whole blocks at once.

All helpers take UTF-8 bytes.  A null text counts as empty.  A block holds whole texts only; its
size is bounded by ``BLOCK_BYTES`` unless a single text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
MULTIPLIER = 0x9E3779B97F4A7C15

#: Space and the five control characters 0x09-0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@dataclass
class Block:
    """``data`` holds the bytes of all texts, text i at ``off[i]:off[i + 1]``."""

    data: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.off[i]:self.off[i + 1]].tobytes()


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """The rows of a batch in slices of about ``limit`` bytes of text."""
    array = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    if not len(array):
        return
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    store = array.buffers()[2]
    data = np.frombuffer(store, np.uint8) if store is not None and store.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(array):
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        end = min(end, len(array))
        yield batch.slice(start, end - start), Block(data[off[start]:off[end]], off[start:end + 1] - off[start])
        start = end


def expanded(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges of ``size`` places from ``start`` on, one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def spans(block: Block, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes that are not ``outside``; runs end with their text."""
    data, off = block.data, block.off
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~outside[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the \\n-split lines, empty ones included; an empty text has one empty line."""
    data, off = block.data, block.off
    cuts = np.flatnonzero(data == 10)
    owner = np.searchsorted(off, cuts, "right") - 1
    starts = np.concatenate([off[:-1], cuts + 1])
    doc = np.concatenate([np.arange(len(block)), owner])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    ends = np.where(last, off[doc + 1], np.r_[starts[1:] - 1, 0] if len(starts) else starts)
    return starts, ends, doc


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, kept and grown as needed."""
    if len(_powers[0]) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        for k, base in enumerate((MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[k] = table
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any spans of a byte array from one running sum of ``byte * multiplier ** place``."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def totals(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts, or sums of weights, by text number."""
    found = np.bincount(doc, weights, minlength=n)
    return found if weights is None else np.rint(found).astype(np.int64)


def code_points(block: Block) -> np.ndarray:
    """Running count of code points; of a span it is the difference of its ends."""
    found = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=found[1:])
    return found
