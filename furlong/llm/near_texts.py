"""Near-duplicate texts: all pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: each text has a fingerprint of its five-word shingles, and the trie join of ``simhash_trie`` gives the pairs of fingerprints
that differ in at most ``BUDGET`` bits.  They are candidates, verified on the whole sets.  Copies of one text are one vertex and need no pair.

No number of bits finds every pair of this similarity, so the shingles themselves are keys for the pairs the fingerprints miss.  All shingles have one order, rare ones first (by the
rows of their bucket, then by their hash).  Two sets of similarity ``p / q`` share at least ``ceil(p / q * n)`` of the ``n`` shingles of either, so the
first ``n - ceil(p / q * n) + 1`` of both have one in common: only these are emitted, and no pair is missed.
Every pair found is then verified, by the first shingles it shares and then on the whole sets.

A pair counts at the first shingle it has in common, and there its places say more: from the places ``i`` and ``j`` on, sets of ``m`` and ``n`` shingles have at most
``min(m - i, n - j)`` in common, and they need ``p / (p + q) * (m + n)``.  So a member of a key has a largest size, ``most``, that its partner may have there.
A member whose ``most`` is under its own size is never the smaller of a pair; a key without any that may be gives no pair.  Pages of one template whose own
words make them unlike, and that are rarer than the template, therefore meet nowhere, however many there are.

Only components are wanted, not all pairs: first the members of a key are compared with one of them, then, among keys whose members
are still in several components, those in different ones, by bands of sizes.  A group of near copies therefore costs its size and not its square.

Defined results: texts are their words in lower case (A-Z), a text of fewer than five words is one shingle; texts of equal words are copies, wordless and
null ones too; repeated rows are rows of one component; a null doc_id is the smallest of its component only if there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.frames import salted_join, shielded, stored, text_key
from furlong.llm.simhash_trie import BITS, components, first_rows
from furlong.llm.simhash_trie import links as within
from furlong.llm.textblock import LOWER, MULTIPLIER, WHITE, Block, Rolling, blocks, mixed, spans

SHINGLE = 5
#: The least similarity, as a fraction.
ALIKE = (4, 5)
BUCKETS = 1 << 16
SALTS = 16
#: Bits in which the fingerprints of candidates may differ, and shingles whose bits are counted at once.
BUDGET = 3
AT_ONCE = 1 << 15


# ---------------------------------------------------------------- shingles
def shingles(block: Block, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the words of every text (zero without words); text numbers and hashes of its different shingles."""
    data = LOWER[block.data]
    starts, ends, doc = spans(Block(data, block.off), WHITE)
    whole = np.zeros(len(block), np.uint64)
    if not len(starts):
        return whole, doc, whole[:0]
    words = Rolling(data).of(starts, ends)
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[new, len(doc)])
    place = (np.arange(len(doc)) - np.repeat(new, count)).astype(np.uint64)
    whole[doc[new]] = mixed(np.add.reduceat(mixed(words ^ (place * np.uint64(MULTIPLIER))), new) + count.astype(np.uint64))
    full = np.flatnonzero(doc[width - 1:] == doc[:len(doc) - width + 1]) if len(doc) >= width else np.zeros(0, np.int64)
    codes = np.zeros(len(full), np.uint64)
    for k in range(width):
        codes = mixed(codes * np.uint64(MULTIPLIER) + words[full + k])
    short = doc[new[count < width]]
    doc, codes = np.r_[doc[full], short], np.r_[codes, whole[short]]
    order = np.lexsort((codes, doc))
    doc, codes = doc[order], codes[order]
    first = np.r_[True, (doc[1:] != doc[:-1]) | (codes[1:] != codes[:-1])]
    return whole, doc[first], codes[first]


def prints(doc: np.ndarray, codes: np.ndarray, rows: int) -> np.ndarray:
    """The SimHash fingerprint of every text: the majority of each bit of its different shingles; zero without words."""
    ones, size = np.zeros((rows, BITS), np.int32), np.bincount(doc, minlength=rows)
    for at in range(0, len(doc), AT_ONCE):
        here = doc[at:at + AT_ONCE]
        bits = np.unpackbits(codes[at:at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        ones[here[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes % np.uint64(BUCKETS)).astype(np.int64)


def bucket_rows(docs: DataFrame, width: int = SHINGLE) -> np.ndarray:
    """How many shingles of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, block in blocks(batch, "text"):
                sums += np.bincount(_bucket(shingles(block, width)[2]), minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "rows"])

    sums = docs.select("text").mapInArrow(run, "bucket long, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows")).toArrow()  # at most BUCKETS rows
    total = np.zeros(BUCKETS, np.int64)
    total[sums["bucket"].to_numpy()] = sums["rows"].to_numpy()
    return total


def prefixes(docs: DataFrame, rows: np.ndarray, width: int = SHINGLE, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """(doc_id, key, vertex, fp, size, codes) of every row: the hash of its words, its fingerprint, its number of shingles, and the first of them."""
    p, q = alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, "text"):
                whole, doc, codes = shingles(block, width)
                fp = prints(doc, codes, len(block))
                order = np.lexsort((codes, rows[_bucket(codes)], doc))
                doc, codes = doc[order], codes[order]
                size = np.bincount(doc, minlength=len(block))
                place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                wanted = np.where(size > 0, size - -(-p * size // q) + 1, 0)
                taken = codes[place < wanted[doc]]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(wanted)].astype(np.int32)), pa.array(taken.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(whole.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int64)), lists],
                    ["doc_id", "key", "vertex", "fp", "size", "codes"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, vertex long, fp long, size long, codes array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(vertex, codes) with all shingles of the texts (vertex, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, "text"):
                _, doc, codes = shingles(block, width)
                ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(block)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("vertex"), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.view(np.int64)))], ["vertex", "codes"])

    return texts.mapInArrow(run, "vertex long, codes array<long>")


# ---------------------------------------------------------------- pairs
def _most(size: Column, place: Column, alike: tuple[int, int]) -> Column:
    """The largest size of a set that is alike, if the shingle at ``place`` (from 0) is the first that both have."""
    p, q = alike
    return F.floor((size - place) * (p + q) / p) - size


def _band(size: str) -> Column:
    """Bands of sizes, four for each doubling; a larger size never has a smaller band."""
    return F.expr(f"4L * length(bin({size})) + shiftright(4L * {size}, length(bin({size})) - 1)")


def members_of(marked: DataFrame, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """(code, vertex, size, most) of every first shingle that several texts of ``prefixes`` have."""
    emitted = marked.select(F.posexplode("codes").alias("_place", "code"), "vertex", "size")
    emitted = emitted.select("code", "vertex", "size", _most(F.col("size"), F.col("_place"), alike).alias("most"))
    several = emitted.groupBy("code").agg(F.min("vertex").alias("_a"), F.max("vertex").alias("_b")).filter("_a <> _b").select("code")
    return emitted.join(several, "code", "left_semi").distinct()


def print_pairs(marked: DataFrame, budget: int = BUDGET, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """(a, b), a < b: texts whose fingerprints differ in at most ``budget`` bits and whose sizes allow the similarity.

    Texts of one fingerprint meet its first text only, and so do those of a linked fingerprint: a star for each fingerprint and link.
    """
    p, q = alike
    texts = marked.filter("size > 0").select("fp", "vertex", "size").distinct()
    firsts = stored(texts.groupBy("fp").agg(F.min(F.struct("vertex", "size")).alias("first")), "prints")
    found = within(firsts.select("fp"), budget)
    ends = found.select(F.col("a").alias("fp"), F.col("b").alias("_other")).unionByName(found.select(F.col("b").alias("fp"), F.col("a").alias("_other")))
    stars = firsts.select("fp", F.col("fp").alias("_other")).unionByName(ends)
    stars = stars.join(firsts.select(F.col("fp").alias("_other"), "first"), "_other").groupBy("fp").agg(F.collect_list("first").alias("_firsts"))
    met = salted_join(texts, stars, ["fp"], "inner", SALTS).select("vertex", "size", F.explode("_firsts").alias("_first"))
    near = met.filter((F.col("vertex") != F.col("_first.vertex")) & (F.least("size", "_first.size") * q >= F.greatest("size", "_first.size") * p))
    return near.select(F.least("vertex", "_first.vertex").alias("a"), F.greatest("vertex", "_first.vertex").alias("b")).distinct()


def central_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b: each member with the first of its key, where the key allows both sizes."""
    centres = members.groupBy("code").agg(F.min(F.struct("vertex", "size", "most")).alias("_first"))
    near = salted_join(members, centres, ["code"], "inner", SALTS).filter(
        (F.col("vertex") != F.col("_first.vertex")) & (F.col("size") <= F.col("_first.most")) & (F.col("_first.size") <= F.col("most")))
    return near.select(F.col("_first.vertex").alias("a"), F.col("vertex").alias("b")).distinct()


def apart_pairs(placed: DataFrame) -> DataFrame:
    """(a, b), a < b: members of one key with different labels, where the key allows both sizes.

    Members that no other of their key can meet are left out before any are joined; the rest meets by bands of sizes.
    """
    smaller = F.col("most") >= F.col("size")
    open_ = placed.groupBy("code").agg(
        F.min("label").alias("_p"), F.max("label").alias("_q"), F.min(F.when(smaller, F.col("size"))).alias("_low"), F.max(F.when(smaller, F.col("most"))).alias("_high"))
    open_ = open_.filter("_p <> _q and _low is not null").select("code", "_low", "_high")
    left = stored(salted_join(placed, open_, ["code"], "inner", SALTS).filter("most >= _low and size <= _high").drop("_low", "_high"), "left")
    ones = left.filter(smaller).select(
        "code", F.col("vertex").alias("a"), F.col("size").alias("_m"), F.col("most").alias("_x"), F.col("label").alias("_p"), F.pmod("vertex", F.lit(SALTS)).alias("_salt"),
        F.explode(F.sequence(_band("size"), _band("most"))).alias("_band"))
    others = left.select(
        "code", F.col("vertex").alias("b"), F.col("size").alias("_n"), F.col("most").alias("_y"), F.col("label").alias("_q"), _band("size").alias("_band"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    met = ones.join(others, ["code", "_band", "_salt"]).filter("(_m < _n or _m = _n and a < b) and _n <= _x and _m <= _y and _p <> _q")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _share(pairs: DataFrame, keys: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) that share enough of their first shingles to be alike.

    Of two sets, the one whose first shingles end earlier has no others in common with the first ones of the other set, so the sets share at
    most the first shingles they share and the rest of one of them.
    """
    p, q = alike
    met = pairs.join(keys.select(F.col("vertex").alias("b"), F.col("size").alias("_n"), F.col("keys").alias("_y")), "b")
    met = met.join(keys.select(F.col("vertex").alias("a"), F.col("size").alias("_m"), F.col("keys").alias("_x")), "a")
    rest = F.ceil(F.greatest("_m", "_n") * p / q) - 1
    return met.filter((F.size(F.array_intersect("_x", "_y")) + rest) * (p + q) >= (F.col("_m") + F.col("_n")) * p).select("a", "b")


def _alike(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, width: int, alike: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets are alike."""
    p, q = alike
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().join(firsts, "vertex").select(
        "vertex", F.col("value.doc_id").alias("_doc"), F.col("value.key").alias("_key"))
    texts = docs.select("doc_id", text_key().alias("key"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))
    sets = stored(_sets(texts.select("vertex", "text").dropDuplicates(["vertex"]), width), "sets")
    met = pairs.join(sets.select(F.col("vertex").alias("b"), F.col("codes").alias("_y")), "b")
    met = met.join(sets.select(F.col("vertex").alias("a"), F.col("codes").alias("_x")), "a")
    both = F.size(F.array_intersect("_x", "_y"))
    return met.filter(both * q >= (F.size("_x") + F.size("_y") - both) * p).select("a", "b")


def labelled(docs: DataFrame, width: int = SHINGLE, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """(doc_id, key, first) of every row of ``docs``; ``first`` is the first (doc_id, key) of its component, null ids last."""
    marked = stored(prefixes(docs, bucket_rows(docs, width), width, alike), "prefixes")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))
    firsts = stored(marked.groupBy("vertex").agg(F.min(own).alias("value"), F.count(F.lit(1)).alias("rows")), "firsts")

    members = stored(members_of(marked, alike), "members")
    keys = stored(members.groupBy("vertex").agg(F.first("size").alias("size"), F.collect_list("code").alias("keys")), "keys")

    # the pairs of near fingerprints, then each member with the first of its key
    near = stored(print_pairs(marked, alike=alike), "pairs")
    central = stored(central_pairs(members).join(near, ["a", "b"], "left_anti"), "pairs")
    pairs = near.unionByName(central)
    links = stored(_alike(docs, stored(near.unionByName(_share(central, keys, alike)), "near"), firsts, width, alike), "links")
    found = components(links, firsts.select("vertex", "value"))

    # then members of one key in different components
    placed = salted_join(members, stored(found, "placed"), ["vertex"], "left", SALTS).join(firsts.select("vertex", "value"), "vertex")
    placed = placed.select("code", "vertex", "size", "most", F.coalesce("label", "value").alias("label"))
    more = apart_pairs(placed).join(pairs, ["a", "b"], "left_anti")
    added = stored(_alike(docs, stored(_share(more, keys, alike), "near"), firsts, width, alike), "links")
    if not added.isEmpty():
        found = components(links.unionByName(added), firsts.select("vertex", "value"))

    shared = firsts.join(found, "vertex", "left").filter((F.col("rows") > 1) | F.col("label").isNotNull())
    lookup = stored(shared.select("vertex", F.coalesce("label", "value").alias("_label")), "shared")
    return salted_join(marked.select("doc_id", "key", "vertex"), lookup, ["vertex"]).select("doc_id", "key", F.coalesce("_label", own).alias("first"))


def keep_first(docs: DataFrame, width: int = SHINGLE, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id; of rows with this id one, by the hash of its text."""
    return shielded(docs, lambda d: first_rows(d, labelled(d, width, alike)))
