"""Alignment of the tokens of two tokenizers by anchors at white space.

Every whole text is encoded by both vocabularies, a space before it.  Tokens are bytes, so both sides have byte offsets; where the
tokens of both end, a group ends.  Anchors are shared ends before a token that begins with a space on both sides.  They cut the token
lists into windows of about a word.  A window's groups, links and their text follow from its two tuples of ids alone: they are found once
for each pair of tuples that a worker meets, and remembered.

Encoding goes by units that neither vocabulary crosses: a single space between two characters that are surely no white space begins a new unit.  Ids
of a unit are those it has inside any text, so each unit is encoded once as well.

Links are all pairs of one token of either side in one group.  An id pair counts in every document that holds it linked.  The counts are one
aggregate over the distinct pairs of every document.  They return to the documents in two ways that give the same sums: the most frequent pairs,
at most ``FREQUENT`` of them, as a broadcast table, and all others by a shuffle, in which no pair is hot since at least ``FREQUENT`` others are about as frequent.

Defined results: texts that are null or empty, or whose tokens on either side do not spell the text, have no tokens, zeros and empty
groups; repeated rows are rows of their own and count each; an empty table gives none.
"""

from __future__ import annotations

import itertools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.frames import stored
from furlong.llm.textblock import Block, Rolling, blocks, expanded, mixed

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
FREQUENT = 1 << 18
#: Units and windows that a worker remembers before it starts anew, and the most bytes of a unit and ids of a window; longer ones are worked out each time.
KNOWN = 125_000
LONG_UNIT, LONG_WINDOW = 64, 64
#: Groups with more pairs than this are paired by their distinct ids at once.
LARGE = 4096
PAIRS = "array<struct<a:int,b:int,n:int>>"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- vocabularies
def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 characters stand for themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


class Side:
    """Bytes of all tokens by id, their lengths, and whether they begin with a space."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.space = np.fromiter((t[:1] == b" " for t in tokens), bool, len(tokens))
        digits = [str(k).encode() for k in range(len(tokens))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_size = np.fromiter(map(len, digits), np.int64, len(digits))
        self.digit_start = np.cumsum(self.digit_size) - self.digit_size

    def spells(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids)) == raw


class ByteLevel(Side):
    """A byte-level vocabulary file: its ids are the ranks of its merges.  The strings of special tokens are plain text.

    Its pattern cuts before a single space between two characters that are no white space, and merges stay inside what it cuts.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        special = {t["id"] for t in found["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): k for token, k in found["model"]["vocab"].items() if k not in special}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            tokens[k] = token
        super().__init__(tokens)
        self.encoding = tiktoken.Encoding("left", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space."""
        return [self.encoding.encode_ordinary(t) for t in texts]


class Pieces(Side):
    """A piece model, which puts the first space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        super().__init__([
            bytes([int(name[3:5], 16)]) if self.model.is_byte(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)])
        if any(b" " in t.lstrip(b" ") for t in self.tokens):
            raise ValueError("a piece has a space after another character, so units at spaces would not be whole")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


# ---------------------------------------------------------------- lists that grow
class Lists:
    """Lists of numbers one after the other in one array; list k is ``values[starts[k]:starts[k + 1]]``."""

    def __init__(self, kind: str):
        self.values, self.starts = array(kind), array("q", [0])

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.starts.extend((self.starts[-1] + np.cumsum(sizes)).tolist())
        self.values.frombytes(values.astype(self.values.typecode).tobytes())

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these lists in turn, and their sizes."""
        starts = np.array(self.starts)
        size = starts[numbers + 1] - starts[numbers]
        return np.array(self.values)[expanded(starts[numbers], size)], size


def numbered(hashes: np.ndarray, same) -> tuple[np.ndarray, np.ndarray]:
    """First places of distinct values and the number of every value's distinct one; equal hashes count only where ``same(places, firsts)`` confirms them."""
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    alone = np.flatnonzero(~same(np.arange(len(hashes)), first[back]))
    back[alone] = len(first) + np.arange(len(alone))
    return np.concatenate([first, alone]), back


def equal_ranges(values: np.ndarray, start: np.ndarray, size: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether range ``one[k]`` of ``values`` equals range ``other[k]``."""
    equal = size[one] == size[other]
    part = np.flatnonzero(equal)
    n = size[one[part]]
    differ = values[expanded(start[one[part]], n)] != values[expanded(start[other[part]], n)]
    if differ.any():
        equal[part[np.repeat(np.arange(len(part)), n)[differ]]] = False
    return equal


# ---------------------------------------------------------------- units
#: Bytes of ASCII that are surely no white space, and first bytes of the characters U+00C0 to U+07FF.
GRAPHIC = np.zeros(256, bool)
GRAPHIC[0x21:0x7F] = True
TWO = np.zeros(256, bool)
TWO[0xC3:0xE0] = True


def units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a space before each, and where their units begin and which text they belong to."""
    size, n = np.diff(block.off), len(block)
    heads = block.off[:-1] + np.arange(n)
    data = np.full(len(block.data) + n, 0x20, np.uint8)
    data[expanded(heads + 1, size)] = block.data
    left, right = np.zeros(len(data), bool), np.zeros(len(data), bool)
    left[1:] = GRAPHIC[data[:-1]]
    left[2:] |= ((data[1:-1] & 0xC0) == 0x80) & TWO[data[:-2]]
    right[:-1] = GRAPHIC[data[1:]] | TWO[data[1:]]
    cut = (data == 0x20) & left & right
    cut[heads] = True
    start = np.flatnonzero(cut)
    return data, start, np.searchsorted(heads, start, "right") - 1


# ---------------------------------------------------------------- windows
class Aligner:
    def __init__(self, left: Side, right: Side):
        self.left, self.right = left, right
        self.forget_units()
        self.forget_windows()

    def forget_units(self) -> None:
        self.units: dict[bytes, int] = {}
        self.of_left, self.of_right, self.spelled = Lists("I"), Lists("I"), array("b")

    def forget_windows(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.written: list[str] = []
        self.groups, self.links = array("q"), array("q")
        self.codes, self.times = Lists("q"), Lists("q")

    # ---- ids
    def encoded(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides with the text each belongs to, and which texts are spelled by both."""
        if len(self.spelled) > KNOWN:
            self.forget_units()
        data, start, text = units(block)
        size = np.diff(np.append(start, len(data)))
        first, back = numbered(Rolling(data).of(start, start + size), lambda a, b: equal_ranges(data, start, size, a, b))
        raw = data.tobytes()
        names = [raw[i:i + n] for i, n in zip(start[first].tolist(), size[first].tolist(), strict=True)]
        at = [self.units.get(name, -1) for name in names]
        new = [k for k, number in enumerate(at) if number < 0]
        if new:
            fresh = [names[k] for k in new]
            texts = [name.decode() for name in fresh]
            a, b = self.left.encode(texts), self.right.encode(texts)
            number = len(self.spelled)
            for k, name, x, y in zip(new, fresh, a, b, strict=True):
                self.spelled.append(self.left.spells(x, name) and self.right.spells(y, name))
                if len(name) <= LONG_UNIT:
                    self.units[name] = number
                at[k] = number
                number += 1
            for lists, ids in ((self.of_left, a), (self.of_right, b)):
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                lists.add(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        number = np.array(at, np.int64)[back]
        good = np.diff(block.off) > 0
        good[text[~np.array(self.spelled, bool)[number]]] = False
        kept = good[text]
        number, text = number[kept], text[kept]
        (a, n_a), (b, n_b) = self.of_left.of(number), self.of_right.of(number)
        return a, np.repeat(text, n_a), b, np.repeat(text, n_b), good

    # ---- windows
    def windows(self, a: np.ndarray, text: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all windows in turn, and the text each is in."""
        to_a, to_b = np.cumsum(self.left.size[a]), np.cumsum(self.right.size[b])
        at = np.minimum(np.searchsorted(to_b, to_a), len(to_b) - 1)
        end_a = np.flatnonzero(to_b[at] == to_a) + 1  # groups end there
        end_b = at[end_a - 1] + 1
        following = np.minimum(end_a, len(a) - 1), np.minimum(end_b, len(b) - 1)
        anchor = (self.left.space[a[following[0]]] & self.right.space[b[following[1]]]) | (text[following[0]] != text[end_a - 1])
        anchor[-1] = True
        last = np.flatnonzero(anchor)
        ends = [end_a[last], end_b[last]]
        starts = [np.r_[0, e[:-1]] for e in ends]
        size_a, size_b = ends[0] - starts[0], ends[1] - starts[1]
        hashes = mixed(Rolling(a).of(starts[0], ends[0]) * np.uint64(3) + Rolling(b).of(starts[1], ends[1]))
        first, back = numbered(hashes, lambda x, y: equal_ranges(a, starts[0], size_a, x, y) & equal_ranges(b, starts[1], size_b, x, y))
        raw_a, raw_b, wide = a.tobytes(), b.tobytes(), a.itemsize
        ranges = [(wide * e[first]).tolist() for e in (starts[0], ends[0], starts[1], ends[1])]
        keys = [(raw_a[i:j], raw_b[k:m]) for i, j, k, m in zip(*ranges, strict=True)]
        found = [self.known.get(key, -1) for key in keys]
        new = [k for k, number in enumerate(found) if number < 0]
        if new:
            head = np.r_[0, last[:-1] + 1]
            fresh = first[new]
            groups = expanded(head[fresh], last[fresh] + 1 - head[fresh])
            number = len(self.written)
            self.learn(a, b, np.r_[0, end_a[:-1]][groups], end_a[groups], np.r_[0, end_b[:-1]][groups], end_b[groups], last[fresh] + 1 - head[fresh])
            for k in new:
                found[k] = number
                if len(keys[k][0]) + len(keys[k][1]) <= LONG_WINDOW * wide:
                    self.known[keys[k]] = number
                number += 1
        return np.array(found, np.int64)[back], text[ends[0] - 1]

    def learn(self, a: np.ndarray, b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, count: np.ndarray) -> None:
        """Lists the windows that consist of ``count`` groups each; group k is ``a[a0[k]:a1[k]]`` and ``b[b0[k]:b1[k]]``."""
        n_a, n_b = a1 - a0, b1 - b0
        window = np.repeat(np.arange(len(count)), count)
        links = np.zeros(len(count), np.int64)
        np.add.at(links, window, n_a * n_b)
        self.groups.extend(count.tolist())
        self.links.extend(links.tolist())
        # distinct pairs of every window
        wide = len(self.right.tokens)
        small = np.flatnonzero(n_a * n_b <= LARGE)
        pairs = (n_a * n_b)[small]
        inner = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        of_b = np.repeat(n_b[small], pairs)
        x, y = a[np.repeat(a0[small], pairs) + inner // of_b], b[np.repeat(b0[small], pairs) + inner % of_b]
        owners, codes, times = [np.repeat(window[small], pairs)], [x.astype(np.int64) * wide + y], [np.ones(len(x), np.int64)]
        for k in np.flatnonzero(n_a * n_b > LARGE).tolist():
            (x, n), (y, m) = np.unique(a[a0[k]:a1[k]], return_counts=True), np.unique(b[b0[k]:b1[k]], return_counts=True)
            codes.append((x.astype(np.int64)[:, None] * wide + y).ravel())
            times.append((n[:, None] * m).ravel())
            owners.append(np.full(len(codes[-1]), window[k]))
        owner, code, time = summed(np.concatenate(owners), np.concatenate(codes), np.concatenate(times), len(self.left.tokens) * wide)
        size = np.bincount(owner, minlength=len(count))
        self.codes.add(code, size)
        self.times.add(time, size)
        # the groups as text: digits of every id and the sign after it
        items = n_a + n_b
        head = np.cumsum(items) - items
        first, second = expanded(head, n_a), expanded(head + n_a, n_b)
        ids_a, ids_b = a[expanded(a0, n_a)], b[expanded(b0, n_b)]
        size, start, sign = np.zeros(int(items.sum()), np.int64), np.zeros(int(items.sum()), np.int64), np.full(int(items.sum()), ord(","), np.uint8)
        for side, place, ids, shift in ((self.left, first, ids_a, 0), (self.right, second, ids_b, len(self.left.digits))):
            size[place], start[place] = side.digit_size[ids], side.digit_start[ids] + shift
        sign[head + n_a - 1], sign[head + items - 1] = ord("|"), ord(";")
        at = np.cumsum(size + 1) - size - 1
        out = np.empty(int((size + 1).sum()), np.uint8)
        out[expanded(at, size)] = np.concatenate([self.left.digits, self.right.digits])[expanded(start, size)]
        out[at + size] = sign
        text = out.tobytes().decode()
        ends = (at + size)[(head + items - 1)[np.cumsum(count) - 1]].tolist()
        begin = 0
        for end in ends:
            self.written.append(text[begin:end])
            begin = end + 1

    def block(self, block: Block) -> tuple[list[np.ndarray], list[str], tuple[np.ndarray, ...]]:
        """Of every text: numbers of tokens, groups and links; the groups as text; and (text, a, b, links) of all distinct pairs."""
        if len(self.written) > KNOWN:
            self.forget_windows()
        n, none = len(block), np.zeros(0, np.int64)
        counts, written = [np.zeros(n, np.int64) for _ in range(4)], [""] * n
        a, text_a, b, text_b, good = self.encoded(block)
        if not len(a):
            return counts, written, (none, none, none, none)
        number, text = self.windows(a, text_a, b)
        counts[0], counts[1] = np.bincount(text_a, minlength=n), np.bincount(text_b, minlength=n)
        for k, table in ((2, self.groups), (3, self.links)):
            np.add.at(counts[k], text, np.array(table)[number])
        cuts = np.searchsorted(text, np.arange(n + 1)).tolist()
        parts, names = self.written, number.tolist()
        for k in np.flatnonzero(good).tolist():
            written[k] = ";".join([parts[x] for x in names[cuts[k]:cuts[k + 1]]])
        # distinct pairs of every text: its distinct windows, then their pairs
        seen, times = np.unique(text * len(parts) + number, return_counts=True)
        text, number = seen // len(parts), seen % len(parts)
        code, size = self.codes.of(number)
        weight = self.times.of(number)[0] * np.repeat(times, size)
        text, code, weight = summed(np.repeat(text, size), code, weight, len(self.left.tokens) * len(self.right.tokens))
        return counts, written, (text, code // len(self.right.tokens), code % len(self.right.tokens), weight)


def summed(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of weights by (owner, code), in this order; codes are below ``wide``."""
    key = owner * wide + code
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight[order], heads) if len(key) else weight
    return key[heads] // wide, key[heads] % wide, total


_aligners: dict[tuple[str, str], Aligner] = {}


def _of_worker(left: str, right: str) -> Aligner:
    """What earlier tasks of this worker have aligned stays known."""
    if (left, right) not in _aligners:
        _aligners[left, right] = Aligner(ByteLevel(left), Pieces(right))
    return _aligners[left, right]


# ---------------------------------------------------------------- Spark
def aligned(docs: DataFrame, left: str | None = None, right: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs) of every row.

    ``groups`` lists the ids of either side by group, "a1,a2|b1;a3|b2,b3"; ``pairs`` the distinct linked ids with their number of links.
    """
    paths = left or vocabulary(LEFT), right or vocabulary(RIGHT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _of_worker(*paths)
        for batch in batches:
            for rows, block in blocks(batch, "text", 1 << 20):
                counts, written, (text, a, b, n) = aligner.block(block)
                off = pa.array(np.searchsorted(text, np.arange(len(rows) + 1)), pa.int32())
                pairs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (a, b, n)], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(written, pa.string()), pa.ListArray.from_arrays(off, pairs)],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs {PAIRS}")


def counted(found: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``found`` without ``pairs``, plus n_best and count_sum: links whose pair is the most counted of its id a, and the sum of all links' counts."""
    rows = stored(found.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    each = rows.select("_row", F.explode("pairs").alias("_pair")).select("_row", "_pair.a", "_pair.b", "_pair.n")
    counts = stored(each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("c").alias("_most"))
    table = stored(counts.join(most, "a").select("a", "b", "c", (F.col("c") == F.col("_most")).cast("int").alias("best")), "pair-counts")
    # the least power of two that at most ``frequent`` pairs reach; a histogram of 64 rows
    level = F.floor(F.log2("c")).cast("int")
    least, reached = 64, 0
    for r in table.groupBy(level.alias("k")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("k")).collect():
        reached += r["m"]
        if reached > frequent:
            break
        least = r["k"]
    often, seldom = table.filter(level >= least), table.filter(level < least)
    sums = [F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("c")).alias("count_sum")]
    parts = each.join(F.broadcast(often), ["a", "b"]).groupBy("_row").agg(*sums)
    if reached > frequent:
        rest = each.join(F.broadcast(often.select("a", "b")), ["a", "b"], "left_anti").join(seldom.hint("merge"), ["a", "b"]).groupBy("_row").agg(*sums)
        parts = parts.union(rest).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs").join(parts, "_row", "left").drop("_row").fillna(0, ["n_best", "count_sum"])
