"""Mixing sources to target weights by a time-varying curriculum.

Each source gets a target (its weight's share of the mix, stopped at ``most`` times its size, the excess reshared) and
a weight schedule over training time t in [0, 1]. The schedule's integral is the source's cumulative token demand. A
document has its place in the source's order, and one more a source size later for each further pass; the demand's
inverse at such a place gives the pass its training position, by which passes are range-sorted. The order within a
source is that of md5(doc_id), then doc_id and text, so reruns agree. A pass is taken as far as its words lie before the
target, and what the mix takes of a document is the sum over its positioned passes. Only DataFrame functions run.

A null text has size 0, and nothing is taken of it. Null is a source of its own, the last. Rows without a doc_id are
ordered by their text's hash, so many of them don't fall into one chunk. Rows that repeat are rows like others and have
places of their own. Very long texts count whole: a pass that the target cuts is taken in part. An empty table gives an
empty mix. If all sizes are 0, targets are 0 and nothing has a position. Other columns are carried along or ignored.

A hot source is cut into chunks of its order, whose sums are added up first; no task gathers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: A source's weight at time t is its weight times (1 - slope + 2 * slope * t); slopes repeat like the weights.
SLOPES = (-0.5, 0.0, 0.5)
#: Rows of a chunk, about.
CHUNK = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _repeating(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """source_size and source (one row each) with rank, weight, slope and target; target = min(most * size, level * weight)."""
    one = W.orderBy(F.col("source").isNull(), "source")  # a row a source
    t = sizes.withColumn("rank", F.row_number().over(one)).withColumns({"weight": _repeating(weights, F.col("rank")), "slope": _repeating(slopes, F.col("rank"))})
    t = t.withColumns({"cap": F.lit(float(most)) * F.col("source_size"), "ratio": F.lit(float(most)) * F.col("source_size") / F.col("weight")})
    by_ratio = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    t = t.withColumns({
        "capped": F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)), "lighter": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)),
        "mix": F.lit(float(share)) * F.sum("source_size").over(everything), "heavy": F.sum("weight").over(everything),
    })
    # with all of a smaller ratio at their caps, the level that the others share
    t = t.withColumn("level", (F.col("mix") - F.col("capped")) / (F.col("heavy") - F.col("lighter")))
    t = t.withColumn("fits", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    return t.select("source", "source_size", "rank", "weight", "slope", F.coalesce(F.least(F.col("cap"), F.col("fits") * F.col("weight")), F.col("cap")).alias("target"))


def _sized(docs: DataFrame, *carried: str) -> DataFrame:
    """row (the carried columns), source, size, and what orders a source's rows: key and tie."""
    text, doc_id = F.col("`text`"), F.col("`doc_id`").cast("string")
    key = F.md5(F.coalesce(doc_id, F.concat(F.lit("~"), F.xxhash64(text).cast("string"))))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("`doc_id`").alias("id"), F.col("`source`").alias("source"), words(text).alias("size"), key.alias("key"), F.crc32(text).alias("tie"))


def _placed(rows: DataFrame, share: float, most: float, weights: tuple[float, ...], slopes: tuple[float, ...]) -> DataFrame:
    """rows with source_size, target and passes: an array of (pass from 0, taken, position) of those that take words."""
    if most < share:
        raise ValueError("targets can't add up to the mix")
    n = rows.count()
    digits = max(1, -(-(max(1, n // CHUNK) - 1).bit_length() // 4))  # hex digits of the key that name a chunk
    rows = rows.withColumns({"chunk": F.substring("key", 1, digits), "named": F.col("source").isNotNull(), "name": F.coalesce("source", F.lit(""))})
    chunks = materialize(rows.groupBy("named", "name", "chunk").agg(F.sum("size").alias("chunk_size")), "chunks")
    by_source = W.partitionBy("named", "name")
    before = F.coalesce(F.sum("chunk_size").over(by_source.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = chunks.groupBy("named", "name").agg(F.sum("chunk_size").alias("source_size")).select(F.when(F.col("named"), F.col("name")).alias("source"), "source_size")
    goals = targets(sizes, share, most, weights, slopes).withColumns({"named": F.col("source").isNotNull(), "name": F.coalesce("source", F.lit(""))}).drop("source")
    places = chunks.withColumn("before", before).drop("chunk_size").join(goals, ["named", "name"])
    in_chunk = W.partitionBy("named", "name", "chunk").orderBy("key", "id", "tie", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(in_chunk), F.lit(0))).join(places, ["named", "name", "chunk"])
    size, total, goal, a = F.col("size"), F.col("source_size"), F.floor(F.col("target")).cast("long"), F.col("slope")

    def one(number: int) -> Column:
        begin = F.col("before") + F.col("within") + number * total
        taken = F.greatest(F.lit(0).cast("long"), F.least(size, goal - begin)).cast("long")
        # demand D(t) = target * ((1 - slope) * t + slope * t ** 2); t where it reaches the pass
        u = F.least(F.lit(1.0), begin / F.when(F.col("target") > 0, F.col("target")))
        t = F.when(a == 0, u).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * F.when(a != 0, a))) + 0.0
        return F.struct(F.lit(number).alias("pass"), taken.alias("taken"), t.alias("position"))

    passes = F.filter(F.array(*[one(k) for k in range(int(-(-most // 1)))]), lambda p: p["taken"] > 0)
    return rows.select("row", "id", "key", "tie", "source", "size", "source_size", "target", passes.alias("passes"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), passes (how many take any), first_position and
    last_position (of its passes, null without) of every document, in the order of the first."""
    placed = _placed(materialize(_sized(docs, "doc_id"), "sizes"), share, most, weights, slopes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda x, p: x + p["taken"])
    at = F.col("passes.position")
    out = placed.select(F.col("row.doc_id").alias("doc_id"), "source", "size", "source_size", "target", taken.alias("taken"), F.size("passes").alias("passes"), F.array_min(at).alias("first_position"), F.array_max(at).alias("last_position"))
    return out.orderBy("first_position", "doc_id")


def training_rows(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """doc_id, source, size, pass (from 0), taken and position of every pass that takes words, range-sorted by position."""
    placed = _placed(materialize(_sized(docs, "doc_id"), "sizes"), share, most, weights, slopes)
    each = placed.select(F.col("row.doc_id").alias("doc_id"), "source", "size", "key", F.inline("passes"))
    return each.orderBy("position", "key", "pass").drop("key")


def mixed_rows(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """The rows of ``docs``, all columns, once for each pass that takes at least half of their words, in training order.

    Each row has its own places, so rows that share a doc_id or have none are taken as often as their own places say."""
    placed = _placed(_sized(docs, *docs.columns), share, most, weights, slopes)
    each = placed.select("row", "size", "key", "tie", F.inline("passes")).where("2 * taken >= size")
    return each.orderBy("position", "key", "tie", "pass").select("row.*")
