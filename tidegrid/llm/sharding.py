"""Sharding by a k-d tree: leaves are split at weighted medians along the widest metadata dimension.

Points are groups of equal texts (weight: their bytes), so copies stay together. Only a group above HEAVY of a shard's
share of all bytes enters row by row, with the rows of a group side by side in every dimension; so just a group that a
median falls into is torn, at most one a cut. Dimensions are the size of a text, its source and language (in code point
order of their names' first bytes, then hashed), and the text's hash; each is mapped to 0..2^20 - 1, with the group's
and then the row's hash as tie-break below. A leaf above the target size (all bytes / shards) is cut along the dimension
whose values spread widest by weight (interquartile, in units of the whole table's spread), at the weighted median,
found by histograms that are refined digit by digit. A histogram has BINS bins a node and dimension, is added up before
it is shuffled, and stays in a table; the driver holds the tree's open nodes alone. Law: ``bytes``. Only DataFrame
functions run.

A null text has size 1 and crc32 0 and is in one group with the empty text. Null sources and languages are values of
their own. Repeated rows are rows like others and each gets a slot. Very long texts weigh what they hold: a shard may
differ from the others by its largest document. Empty tables give empty results; shards may be empty if there are fewer
points. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, discard, materialize

#: A group of copies above this part of a shard's bytes may be torn where a median falls into it.
HEAVY = 0.02
#: A dimension is DIGITS base-BINS digits: so many passes find a median.
BITS, DIGITS = 13, 4
BINS = 1 << BITS
#: Bits of a dimension's value, of the group's tie-break and of the row's.
VALUE, OF_GROUP, OF_ROW = 20, 21, 11
#: Rows of a chunk within which slots are numbered, about.
CHUNK = 20_000
DIMENSIONS = ("by_size", "by_source", "by_lang", "by_hash")
KEY = ["text_crc32", "h", "size"]


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _coordinate(value: Column) -> Column:
    """value (0..2^20 - 1) above the tie-breaks."""
    return F.shiftleft(value.cast("long"), OF_GROUP + OF_ROW).bitwiseOR(F.shiftleft(_low(F.col("tie"), OF_GROUP), OF_ROW)).bitwiseOR(F.col("own"))


def _named(c: str) -> Column:
    """A name as 20 bits in code point order of its first two bytes, then by hash."""
    first = F.conv(F.rpad(F.substring(F.hex(F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8")), 1, 4), 4, "0"), 16, 10).cast("long")
    return F.shiftright(first, 2).bitwiseAND(F.lit(0x3FFF)) * 64 + F.pmod(F.xxhash64(c), F.lit(64))


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, h (the text's hash), and the dimensions of every row."""
    docs = columns(docs, "doc_id", "text", "source", "lang")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    log_size = F.least(F.lit((1 << VALUE) - 1), F.floor(F.log2(F.col("size").cast("double")) * (1 << 15)))
    return rows.select("doc_id", "size", "text_crc32", "h", log_size.alias("v_size"), _named("source").alias("v_source"), _named("lang").alias("v_lang"))


def shards(docs: DataFrame, count: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null) of every row."""
    if count < 1:
        raise ValueError("count must be at least 1")
    rows = materialize(points(docs), "points")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    groups = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min("v_source").alias("v_source"), F.min("v_lang").alias("v_lang"), F.min("v_size").alias("v_size"))
    heavy = (F.col("copies") > 1) & (F.col("copies") * F.col("size") > HEAVY * total / count)
    groups = materialize(groups.withColumn("heavy", heavy), "groups")
    hot = F.broadcast(groups.where("heavy").select(*KEY, "v_source", "v_lang"))  # at most count / HEAVY groups
    light = groups.where("not heavy").select(*KEY, F.lit(None).cast("long").alias("doc_id"), (F.col("copies") * F.col("size")).alias("weight"), "v_size", "v_source", "v_lang", F.lit(0).cast("long").alias("own"))
    single = rows.drop("v_source", "v_lang").join(hot, KEY).select(*KEY, F.col("doc_id").cast("long").alias("doc_id"), F.col("size").alias("weight"), "v_size", "v_source", "v_lang", F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << OF_ROW)).alias("own"))
    each = light.withColumn("hot", F.lit(False)).unionByName(single.withColumn("hot", F.lit(True))).withColumn("tie", F.xxhash64("h", "text_crc32"))
    by_hash = F.shiftleft(F.shiftrightunsigned("tie", 64 - VALUE - OF_GROUP), OF_ROW).bitwiseOR(F.col("own"))
    each = each.select(*KEY, "doc_id", "hot", "weight", *[_coordinate(F.col(v)).alias(d) for v, d in zip(("v_size", "v_source", "v_lang"), DIMENSIONS, strict=False)], by_hash.alias("by_hash"))
    each = materialize(each.withColumn("node", F.lit(0 if count > 1 else -1)), "nodes")
    # the first shard and the number of shards of each node still to be cut, by its number; a finished one's is -1 - shard
    nodes = [(0, count)] if total and count > 1 else []
    root: list[int] = []
    while nodes:
        plan, after = [], []
        for k, (first, s) in enumerate(nodes):
            sides = []
            for f, size in ((first, s // 2), (first + s // 2, s - s // 2)):
                if size > 1:
                    after.append((f, size))
                sides.append(len(after) - 1 if size > 1 else -1 - f)
            plan.append((k, s // 2 / s, *sides))
        values = ", ".join(f"({k}, {share!r}D, {below}, {above})" for k, share, below, above in plan)
        plan = each.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(node, share, below, above)")
        widest = materialize(_widest(each, plan), "widest")
        if not root:
            root = [max(1, r.spread) for r in widest.orderBy("d").collect()]  # a row a dimension
        cuts = _cuts(each, widest, root).join(plan, "node")
        v = F.get(F.array(*DIMENSIONS), F.col("d"))
        moved = each.join(F.broadcast(cuts), "node", "left")  # a row an open node
        moved = moved.select(*KEY, "doc_id", "hot", "weight", *DIMENSIONS, F.when(F.col("d").isNull(), F.col("node")).when(v <= F.col("prefix"), F.col("below")).otherwise(F.col("above")).alias("node"))
        moved = materialize(moved, "nodes")
        discard(each, widest)
        each, nodes = moved, after
    placed = each.select(*KEY, "doc_id", "hot", (-1 - F.col("node")).alias("shard"))
    of_light = rows.select("doc_id", *KEY).join(hot, KEY, "left_anti").join(placed.where("not hot").select(*KEY, "shard"), KEY)
    return _slots(of_light.select("doc_id", *KEY, "shard").unionByName(placed.where("hot").select("doc_id", *KEY, "shard")), n)


def _reached(wanted: Column, of: Column) -> Column:
    """``of`` at the first bin in which the running weight reaches ``wanted``; rounding may leave the last."""
    whole = F.struct("bin", of.alias("of"))
    return F.coalesce(F.min(F.when(F.col("run") >= wanted, whole)), F.max(whole))["of"]


def _widest(each: DataFrame, plan: DataFrame) -> DataFrame:
    """Of each open node and dimension: spread (of the middle half), and prefix and rest: the bin with the cut and what is wanted within."""
    top = BITS * (DIGITS - 1)
    every = each.where("node >= 0").select("node", "weight", F.posexplode(F.array(*[F.shiftright(F.col(d), top) for d in DIMENSIONS])).alias("d", "bin"))
    bins = every.groupBy("node", "d", "bin").agg(F.sum("weight").alias("w"))
    node = W.partitionBy("node", "d")  # at most BINS rows
    bins = bins.withColumns({"run": F.sum("w").over(node.orderBy("bin")), "whole": F.sum("w").over(node)}).join(F.broadcast(plan), "node")
    wanted = F.col("share") * F.col("whole")
    cut = _reached(wanted, F.struct(F.col("bin").alias("prefix"), (wanted - F.col("run") + F.col("w")).alias("rest")))
    spread = _reached(0.75 * F.col("whole"), F.col("bin")) - _reached(0.25 * F.col("whole"), F.col("bin"))
    return bins.groupBy("node", "d").agg(spread.alias("spread"), cut.alias("cut")).select("node", "d", "spread", "cut.prefix", "cut.rest")


def _cuts(each: DataFrame, widest: DataFrame, root: list[int]) -> DataFrame:
    """node, d, prefix: each open node's dimension and the value there up to which its share of the weight lies."""
    width = F.col("spread") / F.get(F.array(*[F.lit(float(x)) for x in root]), F.col("d"))
    found = widest.groupBy("node").agg(F.max_by(F.struct("d", "prefix", "rest"), F.struct(width, -F.col("d"))).alias("x")).select("node", "x.*")
    rows = each.where("node >= 0").select("node", "weight", *DIMENSIONS)
    v = F.get(F.array(*DIMENSIONS), F.col("d"))
    for digit in range(1, DIGITS):  # refine all nodes' bins at once
        shift = BITS * (DIGITS - 1 - digit)
        inside = rows.join(F.broadcast(found), "node").where(F.shiftright(v, shift + BITS) == F.col("prefix"))
        bins = inside.groupBy("node", "d", "rest", F.shiftright(v, shift).alias("bin")).agg(F.sum("weight").alias("w"))
        bins = bins.withColumn("run", F.sum("w").over(W.partitionBy("node").orderBy("bin")))
        rest = F.col("rest") - F.col("run") + F.col("w")
        # at the last digit, leave the value out if that comes nearer
        at = F.col("bin") - F.when(rest < F.col("w") / 2, 1).otherwise(0) if digit == DIGITS - 1 else F.col("bin")
        found = bins.groupBy("node", "d").agg(_reached(F.col("rest"), F.struct(at.alias("prefix"), rest.alias("rest"))).alias("x")).select("node", "d", "x.*")
    return found.select("node", "d", "prefix")


def _slots(found: DataFrame, n: int) -> DataFrame:
    chunk = F.pmod(F.xxhash64("doc_id", "h", "size"), F.lit(max(1, n // CHUNK)))
    found = found.withColumn("chunk", chunk)
    sums = found.groupBy("shard", "chunk").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("shard", "chunk", before.alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "h", "size"))
    return found.withColumn("number", number).join(sums, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
