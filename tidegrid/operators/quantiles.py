"""Exact percentiles of large groups.

No task holds a group: order statistics are found by histograms of BINS bins, added up before they are shuffled, and the
bin with the wanted rank is cut into bins again, from the least to the largest value in it, until it holds one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import discard, materialize

BINS = 4096


def order_statistics(data: DataFrame, wanted: DataFrame) -> DataFrame:
    """data: k, v (neither null nor NaN). wanted: k, rank (from 0, below the number of k's values). k, rank and the value there."""
    ends = data.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = materialize(wanted.distinct().join(ends, "k").withColumn("below", F.lit(0).cast("long")), "ranks")
    while not state.where("lo < hi").isEmpty():
        spans = state.where("lo < hi").select("k", "lo", "hi").distinct()
        inside = data.join(spans, "k").where("v between lo and hi")
        # halves first, as hi - lo may be beyond the largest double
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)).cast("int")
        bins = inside.groupBy("k", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(W.partitionBy("k", "lo", "hi").orderBy("bin"))  # at most BINS rows
        bins = bins.withColumn("upto", upto)
        open_ = state.where("lo < hi").join(bins, ["k", "lo", "hi"]).where("rank < below + upto and rank >= below + upto - n")
        after = open_.select("k", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"))
        new = materialize(state.where("lo = hi").unionByName(after), "ranks")
        discard(state)
        state = new
    return state.select("k", "rank", F.col("lo").alias("v"))


def percentiles(rows: DataFrame, keys: list[str], value: Column, shares: list[float]) -> DataFrame:
    """The keys, n (values that are neither null nor NaN) and p: the exact percentiles, interpolated between neighbours.

    Null keys are a group; a group without values has n 0 and no percentiles."""
    data = materialize(rows.select(F.struct(*keys).alias("k"), value.cast("double").alias("v")).where("v is null or not isnan(v)"), "values")
    groups = materialize(data.groupBy("k").agg(F.count("v").alias("n")), "groups")
    data = data.where("v is not null")
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    ranks = groups.where("n > 0").select("k", F.explode(F.array_distinct(F.concat(*[F.array(F.floor(x), F.ceil(x)) for x in at]))).alias("rank"))
    found = order_statistics(data, ranks)
    by_rank = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))  # two ranks a share
    low, high = [F.element_at("m", F.floor(x)) for x in at], [F.element_at("m", F.ceil(x)) for x in at]
    p = [a + (b - a) * (x - F.floor(x)) for a, b, x in zip(low, high, at, strict=True)]
    return groups.join(by_rank, "k", "left").select("k.*", "n", F.when(F.col("m").isNotNull(), F.array(*p)).alias("p"))
