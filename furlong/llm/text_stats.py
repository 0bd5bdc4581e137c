"""Counts of whole texts that quality rules use, computed a block of texts at a time."""

from __future__ import annotations

import numpy as np

from furlong.llm.textblock import WHITE, Block, Rolling, code_points, lines, spans, totals

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True


class Words:
    """The words of a block, their text numbers and hashes."""

    def __init__(self, block: Block):
        self.block = block
        self.rolling = Rolling(block.data)
        self.starts, self.ends, self.doc = spans(block, WHITE)
        self.hashes = self.rolling.of(self.starts, self.ends)
        self.count = totals(self.doc, len(block))


def seen_before(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether an earlier element of the same text has the same key."""
    order = np.lexsort((key, doc))
    again = np.zeros(len(doc), bool)
    if len(doc):
        again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
    return again


def found_twice(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the same text has the key at least twice; the first time is included."""
    order = np.lexsort((key, doc))
    twice = np.zeros(len(doc), bool)
    if len(doc):
        same = (doc[order[1:]] == doc[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
    return twice


def in_class(block: Block, table: np.ndarray) -> np.ndarray:
    """Bytes of every text that are in a class."""
    sums = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(table[block.data], out=sums[1:])
    return sums[block.off[1:]] - sums[block.off[:-1]]


def base_counts(words: Words, window: int = 3) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text of a block."""
    block, n = words.block, len(words.block)
    points = code_points(block)
    chars = totals(words.doc, n, points[words.ends] - points[words.starts])
    l0, l1, ldoc = lines(block)
    has_word = np.searchsorted(words.starts, l1) > np.searchsorted(words.starts, l0)
    l0, l1, ldoc = l0[has_word], l1[has_word], ldoc[has_word]
    again = seen_before(ldoc, words.rolling.of(l0, l1))
    repeated = np.zeros(len(words.doc) + window, np.int64)
    if len(words.doc) >= window:
        last = len(words.doc) - window + 1
        inside = words.doc[:last] == words.doc[window - 1:]
        key = words.hashes[:last].copy()
        for k in range(1, window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + words.hashes[k:last + k]
        at = np.flatnonzero(inside)
        at = at[found_twice(words.doc[at], key[at])]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + window, -1)
    covered = np.cumsum(repeated)[:len(words.doc)] > 0
    return {
        "n_words": words.count, "word_chars": chars, "n_symbols": in_class(block, _SYMBOL),
        "n_dup_lines": totals(ldoc[again], n), "n_repeat_words": totals(words.doc[covered], n)}


#: Ratios that rules are made of, in this order.
STATISTICS = [
    "n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "letter_share", "mark_share", "repeat_share", "dup_line_share",
    "distinct_share", "adjacent_share", "bang_share", "pipe_share", "words_per_line", "longest_word", "one_letter_share", "top_word_share", "wide_share",
]


def statistics(words: Words) -> dict[str, np.ndarray]:
    """The columns ``STATISTICS`` of every text of a block; ratios of nothing are 0."""
    block, n = words.block, len(words.block)
    base = base_counts(words)
    size = np.diff(block.off)

    def share(part, whole):
        return np.divide(part, whole, out=np.zeros(n), where=np.asarray(whole) > 0)

    def one(c: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[ord(c)] = True
        return in_class(block, table)

    length = words.ends - words.starts
    new = ~seen_before(words.doc, words.hashes)
    adjacent = np.zeros(len(words.doc), bool)
    adjacent[1:] = (words.doc[1:] == words.doc[:-1]) & (words.hashes[1:] == words.hashes[:-1])
    order = np.lexsort((words.hashes, words.doc))
    starts = np.flatnonzero(np.r_[True, (words.doc[order][1:] != words.doc[order][:-1]) | (words.hashes[order][1:] != words.hashes[order][:-1])]) if len(order) else order
    runs = np.diff(np.r_[starts, len(order)])
    most, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(most, words.doc[order][starts], runs)
    np.maximum.at(longest, words.doc, length)
    l0, l1, ldoc = lines(block)
    wide = np.zeros(256, bool)
    wide[128:] = True
    letters = in_class(block, _LETTER)
    found = {
        "n_words": base["n_words"], "mean_word": share(totals(words.doc, n, length), words.count), "symbol_share": share(base["n_symbols"], size),
        "upper_share": share(in_class(block, _UPPER), letters), "digit_share": share(in_class(block, _DIGIT), size), "letter_share": share(letters, size),
        "mark_share": share(in_class(block, _MARK), size), "repeat_share": share(base["n_repeat_words"], words.count), "dup_line_share": share(base["n_dup_lines"], totals(ldoc, n)),
        "distinct_share": share(totals(words.doc[new], n), words.count), "adjacent_share": share(totals(words.doc[adjacent], n), words.count),
        "bang_share": share(one("!"), size), "pipe_share": share(one("|"), size), "words_per_line": share(words.count, totals(ldoc, n)),
        "longest_word": longest, "one_letter_share": share(totals(words.doc[length == 1], n), words.count), "top_word_share": share(most, words.count),
        "wide_share": share(in_class(block, wide), size)}
    return {name: np.asarray(found[name], float) for name in STATISTICS}
