"""SimHash fingerprints and their near-duplicate groups by a binary trie self-join.

Fingerprints are leaves of a binary trie.  The join goes down pairs of nodes together and carries the
number of bits in which their paths differ; a pair of nodes is left as soon as that number is over the
budget.  With a budget of ``k`` bits, two fingerprints within it agree in one of ``k + 1`` parts of their
bits, so there are ``k + 1`` tries, each with another part turned to the top: a pair of nodes starts there
as one node, the root of a group that agrees in that part.  Groups are dealt over the cluster.  A group of
more than ``GROUP`` fingerprints is not joined in one task: its node pairs are first opened by ``OPEN`` more
bits, over the whole cluster, and so on until they are small.

Copies of a text have one fingerprint and are counted, not paired.  Components come from labels that move
along links and are then followed to their own label (pointer jumping); a fingerprint has at most
C(64, 1) + C(64, 2) others within two bits, so no vertex is hot.

Defined results: a null or wordless text has fingerprint zero and links like any other; repeated rows are rows of one
component; a null doc_id is the smallest of its component only if there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm.frames import salted_join, shielded, stored, text_key
from furlong.llm.textblock import blocks

BITS = 64
BUDGET = 2
SHINGLE = 3
SEED = 42
GROUP = 4096
OPEN = 6
#: Node pairs that are opened at once, which bounds the memory of a task.
FRONT = 1 << 18
#: Pairs of leaves below a pair of nodes that are compared directly.
LEAVES = 16


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the hashes of all word shingles, repeats included; zero without words."""
    words = text.lower().split()  # on bytes: A-Z, and the six white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    places = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=places[1:])
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    starts, ends = places[:len(words) - width + 1].tolist(), (places[width:] - 1).tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    major = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(major.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp) of every row; key tells rows of one doc_id apart, fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks(batch, "text"):
                found = np.array([fingerprint(block.text(i), shingle) for i in range(len(block))], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), pa.array(found)], ["doc_id", "key", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, fp long")


# ---------------------------------------------------------------- the join
def turns(budget: int) -> tuple[list[int], int]:
    """By how much each trie is turned, and the bits that its groups share at the top."""
    return [BITS * k // (budget + 1) for k in range(budget + 1)], BITS // (budget + 1)


def turned(fp: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return np.where(by == 0, fp, (fp << by) | (fp >> ((np.uint64(BITS) - by) % np.uint64(BITS))))


def join_nodes(values: np.ndarray, a0, a1, b0, b1, far, bit: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within the budget, found below pairs of trie nodes.

    A node is a range of ``values`` whose members agree in all bits above ``bit``; node a0:a1 meets node b0:b1, which
    is the same or lies apart from it, and ``far`` bits of their paths differ.  Pairs of nodes are opened
    level by level.  At most ``FRONT`` pairs are opened at once, the rest waits on the stack.
    """
    stack = [(a0, a1, b0, b1, far, bit)]
    while stack:
        a0, a1, b0, b1, far, bit = stack.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            stack += [(a0[cut], a1[cut], b0[cut], b1[cut], far[cut], bit) for cut in (slice(0, half), slice(half, None))]
            continue
        # the few leaves below a pair are compared at once; distinct values have no bits left only as single leaves
        small = ((a1 - a0) * (b1 - b0) <= LEAVES) | (bit < 0)
        if small.any():
            yield _leaves(values, a0[small], a1[small], b0[small], b1[small], budget)
            big = ~small
            a0, a1, b0, b1, far = a0[big], a1[big], b0[big], b1[big], far[big]
        if not len(a0):
            continue
        mask = np.uint64(1 << bit)
        am, bm = _split(values, a0, a1, mask), _split(values, b0, b1, mask)
        apart = a0 != b0
        always = np.ones(len(a0), bool)
        found = []
        # children on the same side, then on different sides, which costs a bit; of a node with itself one order is enough
        for x0, x1, y0, y1, cost, wanted in (
            (a0, am, b0, bm, 0, always), (am, a1, bm, b1, 0, always), (a0, am, bm, b1, 1, always), (am, a1, b0, bm, 1, apart),
        ):
            ok = wanted & (x0 < x1) & (y0 < y1) & (far + cost <= budget)
            ok &= (x0 != y0) | (x1 - x0 > 1)  # a leaf alone has no partner
            found.append((x0[ok], x1[ok], y0[ok], y1[ok], far[ok] + cost))
        stack.append((*[np.concatenate(x) for x in zip(*found, strict=True)], bit - 1))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, mask: np.uint64) -> np.ndarray:
    """First place of every range whose value has the bit; the members of a range agree in all higher bits."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        has = np.zeros(len(lo), bool)
        has[open_] = (values[mid[open_]] & mask) != 0
        hi = np.where(open_ & has, mid, hi)
        lo = np.where(open_ & ~has, mid + 1, lo)
    return lo


def _leaves(values: np.ndarray, a0, a1, b0, b1, budget: int) -> tuple[np.ndarray, np.ndarray]:
    wide = b1 - b0
    count = (a1 - a0) * wide
    pair = np.repeat(np.arange(len(a0)), count)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    i, j = a0[pair] + place // wide[pair], b0[pair] + place % wide[pair]
    ok = (np.bitwise_count(values[i] ^ values[j]) <= budget) & ((a0 != b0)[pair] | (i < j))
    return i[ok], j[ok]


def links(prints: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """Distinct pairs a < b of distinct fingerprints ``fp`` that differ in at most ``budget`` bits."""
    by, shared = turns(budget)
    trees = F.array(*[F.struct(F.lit(k).alias("tree"), _turned(F.col("fp"), n).alias("code")) for k, n in enumerate(by)])
    # a row of a node pair: the tree, the paths u and v of both nodes, the side the row is on, and its turned bits
    top = F.call_function("shiftrightunsigned", F.col("_t.code"), F.lit(BITS - shared))
    work = prints.select(F.explode(trees).alias("_t")).select(
        F.col("_t.tree").alias("tree"), top.alias("u"), top.alias("v"), F.lit(0).alias("side"), F.col("_t.code").alias("code"))
    node, depth, found = ["tree", "u", "v"], shared, None
    while True:
        left, right = (F.count(F.when(F.col("side") == k, 1)) for k in (0, 1))
        sizes = work.groupBy(*node).agg(left.alias("_left"), right.alias("_right"))
        busy = sizes.filter(F.when(F.col("u") == F.col("v"), F.col("_left") > 1).otherwise((F.col("_left") > 0) & (F.col("_right") > 0)))
        rows = F.col("_left") + F.col("_right")
        large = stored(busy.filter(rows > group).select(*node), "trie") if depth + OPEN <= BITS else None
        hot = large is not None and not large.isEmpty()
        small = (busy.filter(rows <= group) if hot else busy).select(*node)
        here = work.join(small, node, "left_semi").select(*node, "side", "code").repartition(*node).sortWithinPartitions(*node, "side", "code").mapInArrow(
            _joiner(by, depth, budget), "a long, b long")
        found = here if found is None else found.unionByName(here)
        if not hot:
            return found.distinct()
        work = stored(_opened(salted_join(work, large, node, "inner", merged=True), depth, budget), "trie")
        depth += OPEN


def _turned(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _opened(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """Every node pair opened by ``OPEN`` bits: a row goes to each pair of child nodes within the budget that has its own child.

    Of a node paired with itself only the child pairs u <= v are made.
    """
    own = F.call_function("shiftrightunsigned", F.col("code"), F.lit(BITS - depth - OPEN))
    flips = F.array(*[F.lit(x).cast("long") for x in range(1 << OPEN) if x.bit_count() <= budget])
    other = F.when(F.col("side") == 0, F.col("v")).otherwise(F.col("u"))
    opened = rows.withColumn("_own", own).withColumn("_flip", F.explode(flips))
    mate = F.shiftleft(other, OPEN).bitwiseOR(F.col("_own").bitwiseAND(F.lit((1 << OPEN) - 1)).bitwiseXOR(F.col("_flip")))
    opened = opened.withColumn("_mate", mate).filter(F.bit_count(F.col("_own").bitwiseXOR(F.col("_mate"))) <= budget)
    first = F.when(F.col("u") == F.col("v"), F.col("_own") <= F.col("_mate")).otherwise(F.col("side") == 0)
    return opened.select(
        "tree", F.when(first, F.col("_own")).otherwise(F.col("_mate")).alias("u"), F.when(first, F.col("_mate")).otherwise(F.col("_own")).alias("v"),
        F.when(first, 0).otherwise(1).alias("side"), "code")


def _joiner(by: list[int], depth: int, budget: int):
    """Joins the node pairs of a sorted partition, many at once; a pair whose rows may go on in the next batch waits for it."""

    def joined(table: pa.Table) -> pa.RecordBatch:
        tree, u, v, side, code = (table.column(c).to_numpy() for c in ("tree", "u", "v", "side", "code"))
        code = code.view(np.uint64)
        new = np.r_[True, (tree[1:] != tree[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(code)]
        itself = u[start] == v[start]
        cut = start + np.add.reduceat((side == 0).astype(np.int64), start)
        a0, a1 = start, np.where(itself, end, cut)
        b0, b1 = np.where(itself, start, cut), end
        far = np.bitwise_count((u ^ v)[start].view(np.uint64)).astype(np.int64)
        pairs = list(join_nodes(code, a0, a1, b0, b1, far, BITS - 1 - depth, budget))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        back = (BITS - np.array(by)) % BITS
        a, b = (turned(code[k], back[tree[k]]).view(np.int64) for k in (i, j))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("tree", "u", "v")]
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
            cut = int(last[-1]) + 1 if len(last) else 0
            before = held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("tree", "u", "v"))
            if cut or before:
                yield joined(pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield joined(pa.Table.from_batches(held))

    return run


# ---------------------------------------------------------------- components
def components(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(vertex, label) of every vertex of ``pairs`` (a, b): the smallest ``value`` that is reachable.

    ``values`` has one (vertex, value) for each vertex.  A round takes the smallest label among the neighbours, then
    the label of the vertex that owns it; rounds go on until none changes.
    """
    edges = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    own = F.struct(F.col("value").alias("value"), F.col("vertex").alias("root"))
    label = stored(edges.select(F.col("a").alias("vertex")).distinct().join(values, "vertex").select("vertex", own.alias("label")), "labels")
    while True:
        near = edges.join(label, F.col("b") == F.col("vertex")).groupBy("a").agg(F.min("label").alias("_near"))
        met = label.join(near, F.col("vertex") == F.col("a")).select("vertex", F.least("label", "_near").alias("_met"), "label")
        met = met.withColumn("_root", F.col("_met.root"))
        # many vertices may follow one root
        roots = label.join(label.select(F.col("label.root").alias("vertex")).distinct(), "vertex", "left_semi").select(F.col("vertex").alias("_root"), F.col("label").alias("_next"))
        jumped = salted_join(met, roots, ["_root"], merged=True)
        label = stored(jumped.select(
            "vertex", F.least("_met", F.coalesce("_next", "_met")).alias("_new"), F.col("label").alias("_old")
        ).select("vertex", F.col("_new").alias("label"), (F.col("_new") != F.col("_old")).alias("changed")), "labels")
        if label.filter("changed").isEmpty():
            return label.select("vertex", F.col("label.value").alias("label"))
        label = label.select("vertex", "label")


def labelled(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp, first) of every row of ``docs``; ``first`` is the first (doc_id, key) of its component, null ids last."""
    marked = stored(fingerprints(docs, shingle), "prints")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))
    firsts = stored(marked.groupBy(F.col("fp").alias("vertex")).agg(F.min(own).alias("value"), F.count(F.lit(1)).alias("rows")), "firsts")
    found = components(links(firsts.select(F.col("vertex").alias("fp")), budget), firsts.select("vertex", "value"))
    # a fingerprint with one row and no link is its own component and needs no join
    shared = firsts.join(found, "vertex", "left").filter((F.col("rows") > 1) | F.col("label").isNotNull())
    lookup = stored(shared.select(F.col("vertex").alias("fp"), F.coalesce("label", "value").alias("_label")), "shared")
    return salted_join(marked, lookup, ["fp"], merged=True).select("doc_id", "key", "fp", F.coalesce("_label", own).alias("first"))


def groups(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    return labelled(docs, budget, shingle).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id; of rows with this id one, by the hash of its text."""
    return shielded(docs, lambda d: first_rows(d, labelled(d, budget, shingle)))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each component of ``found`` (doc_id, key, first)."""
    kept = found.filter((F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    kept = kept.select(name, F.col("key").alias("_key")).distinct()
    rows = docs.select("*", name, text_key().alias("_key")).join(kept, ["_id", "_key"], "left_semi")
    place = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(0)))  # repeated rows; keeps the join's partitioning
    return rows.withColumn("_place", place).filter("_place = 1").select(*docs.columns)
