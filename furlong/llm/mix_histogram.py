"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id and text.  A source takes whole passes over its documents, and one
further copy of the documents whose hash lies below the source's threshold.  The threshold is found
from sums of sizes by source and hash bucket: the bucket in which the running sum passes the budget is
the boundary, and only its documents are summed again, by the next bits, until the hash is used up.
Documents are never sorted and thresholds are nested: a larger budget takes a superset.

Defined results: a null text has size 0 and is never taken; null is a source of its own, the last one; sources
without any words have target 0; rows that agree in doc_id and text share a hash and are taken or left together, rows of one
doc_id, or of none, with different texts are not; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm.frames import WORD, salted_join, shielded, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BITS = 60
STEP = 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the id, a space and the text; nulls count as empty."""
    parts = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of every source from (source, source_size): shares by weight, cut at ``most`` times the size.

    Cutting and sharing the excess again by weight ends at one level for all: a source is cut if its
    size per weight is below the level.  So the cut sources are the first ones in the order of size
    per weight, and the level follows from running sums.
    """
    # the table has one row a source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_need = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    size = F.col("source_size").cast("double")
    budget = F.lit(share) * F.sum(size).over(everything)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = budget - F.lit(most) * F.coalesce(F.sum(size).over(before), F.lit(0.0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    levels = ranked.withColumns({"_rest": rest, "_left": weight_left})
    above = F.col("_weight") * F.col("_rest") / F.col("_left") > F.lit(most) * size
    # the first source that is not cut sets the level for all after it
    first = F.min(F.when(~above, F.struct((F.col("source_size") / F.col("_weight")).alias("need"), F.col("source").isNull().alias("last"), F.col("source"), F.col("_rest"), F.col("_left"))))
    levels = levels.withColumn("_above", above).withColumn("_level", first.over(everything))
    want = F.col("_weight") * F.col("_level._rest") / F.col("_level._left")
    target = F.when(F.col("_level").isNull() | (want > F.lit(most) * size), F.lit(most) * size).otherwise(want)
    return levels.select("source", "source_size", target.alias("target"))


def thresholds(hashed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, target, passes, threshold): one copy more of all documents with a hash below the threshold.

    ``hashed`` has (source, size, hash).  The boundary document is taken if that brings the sum nearer to the target.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = wanted.withColumn("passes", passes).withColumns({
        "_need": F.col("target") - F.col("passes") * F.col("source_size"), "_low": F.lit(0).cast("long")})
    rows = hashed.filter(F.col("size") > 0)
    for shift in range(BITS - STEP, -1, -STEP):
        part = rows.withColumn("_bucket", F.shiftright("hash", shift))
        if shift < BITS - STEP:  # only the boundary bucket is looked at again
            prefix = state.select("source", F.shiftright("_low", shift + STEP).alias("_prefix"))
            part = salted_join(part, prefix, ["source"], "inner").filter(F.shiftright("hash", shift + STEP) == F.col("_prefix")).drop("_prefix")
        sums = part.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket"))
        edge = (
            sums.withColumn("_upto", upto)
            .join(state.select(F.col("source").alias("_source"), "_need"), F.col("source").eqNullSafe(F.col("_source")))
            .filter(F.col("_upto") > F.col("_need"))
            .groupBy("source").agg(F.min(F.struct("_bucket", "_upto", "_sum")).alias("_edge"))
            .select(F.col("source").alias("_source"), "_edge"))
        state = stored(
            state.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").select(
                "source", "source_size", "target", "passes",
                F.when(F.col("_edge").isNull(), F.col("_need")).otherwise(F.col("_need") - (F.col("_edge._upto") - F.col("_edge._sum"))).alias("_need"),
                # without an edge the budget is past all documents of the source
                F.when(F.col("_edge").isNull(), F.lit(1 << BITS)).otherwise(F.shiftleft(F.col("_edge._bucket"), shift)).cast("long").alias("_low"),
                F.col("_edge._sum").alias("_sum")), "mix")
    nearer = (F.col("_low") < F.lit(1 << BITS)) & (F.col("_sum") - F.col("_need") < F.col("_need"))
    return state.select("source", "source_size", "target", "passes", (F.col("_low") + nearer.cast("long")).alias("threshold"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    def copies(inner: DataFrame) -> DataFrame:
        return mix(inner, weights, share, most).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))

    return shielded(docs, copies)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """All rows of ``docs`` with _size, _source_size, _target and _copies, how often the mix takes the row."""
    sized = docs.withColumns({"_size": words(F.col("text")), "_hash": row_hash(F.col("doc_id"), F.col("text"))})
    narrow = stored(sized.select("source", F.col("_size").alias("size"), F.col("_hash").alias("hash")), "sizes")
    wanted = stored(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    found = thresholds(narrow, wanted).select(
        "source", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("passes").alias("_passes"), F.col("threshold").alias("_threshold"))
    joined = salted_join(sized, found, ["source"])
    copies = F.when(F.col("_size") > 0, F.col("_passes") + (F.col("_hash") < F.col("_threshold")).cast("long")).otherwise(F.lit(0).cast("long"))
    return joined.withColumn("_copies", copies).drop("_passes", "_threshold", "_hash")
