"""Profilers over messages (one row each, n_readings) and readings (one row each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ratio, stats
from ..model import DEFAULTS, MOST_DROPS, MOST_OUTAGES, NATURAL_KEY, QUIRKS, Thresholds
from ..scratch import materialize
from .quantiles import percentiles
from .stage1 import timestamp_reason

GROUP = ("device_class", "firmware_version")


def clock_rates(readings: DataFrame) -> DataFrame:
    r = readings.withColumn("reason", timestamp_reason(F.col("device_ts_ms"), F.col("arrival_ts_ms")))
    share = lambda k: F.round(F.avg((F.coalesce(F.col("reason") == k, F.lit(False))).cast("double")), 6)
    return r.groupBy(*GROUP).agg(F.count("*").alias("total"), share("missing_timestamp").alias("missing_rate"), share("epoch_default_timestamp").alias("epoch_rate"), share("future_timestamp").alias("future_rate"))


def clock_drift(readings: DataFrame) -> DataFrame:
    ok = readings.where(timestamp_reason(F.col("device_ts_ms"), F.col("arrival_ts_ms")).isNull())
    each = ok.groupBy(*GROUP, "device_id").agg(F.percentile((F.col("arrival_ts_ms") - F.col("device_ts_ms")) / 1000.0, F.lit(0.5)).alias("d"))
    p = F.percentile("d", F.array(F.lit(0.5), F.lit(0.9)))
    return each.groupBy(*GROUP).agg(F.count("*").alias("devices"), F.round(F.min("d"), 6).alias("min_s"), F.round(p[0], 6).alias("median_s"), F.round(p[1], 6).alias("p90_s"), F.round(F.max("d"), 6).alias("max_s"))


def lateness(readings: DataFrame) -> DataFrame:
    """By class: how late readings arrive, over plausible times. Percentiles are exact and no task holds a class."""
    ok = (F.col("device_ts_ms") > 0) & F.col("arrival_ts_ms").isNotNull()
    x = F.when(ok, F.col("arrival_ts_ms") - F.col("device_ts_ms"))
    rows = materialize(readings.select("device_class", x.alias("late_ms")), "lateness")
    p = percentiles(rows, ["device_class"], F.col("late_ms"), [0.5, 0.9, 0.99])
    ends = rows.groupBy("device_class").agg(F.count_if(F.col("late_ms").isNull()).alias("skipped"), (F.min("late_ms") / 1000.0).alias("min_s"), (F.max("late_ms") / 1000.0).alias("max_s"))
    at = lambda i, name: F.round(F.col("p")[i] / 1000.0, 6).alias(name)
    same = p["device_class"].eqNullSafe(ends["device_class"])
    return p.join(ends, same).select(p["device_class"], "n", "skipped", "min_s", at(0, "median_s"), at(1, "p90_s"), at(2, "p99_s"), "max_s")


def duplicate_keys(readings: DataFrame) -> DataFrame:
    keys = readings.groupBy("device_class", *NATURAL_KEY).agg(F.count("*").alias("n"))
    inst, distinct, dup = F.sum("n"), F.count("*"), F.count_if(F.col("n") > 1)
    return keys.groupBy("device_class").agg(inst.alias("instances"), distinct.alias("distinct_keys"), dup.alias("duplicated_keys"), ratio(dup, distinct).alias("duplicate_key_rate"), ratio(inst - distinct, inst).alias("excess_rate"))


def message_duplicates(readings: DataFrame) -> DataFrame:
    """Messages whose keys were all (pure) or partly (partial) on an earlier message of the class.

    A key's first message is a plain minimum, so no window orders a whole class."""
    place = F.struct(F.coalesce("arrival_ts_ms", F.lit(0)).alias("a"), F.coalesce("message_id", F.lit("")).alias("m"))
    keyed = readings.select("device_class", *NATURAL_KEY, place.alias("place")).distinct()
    first = keyed.groupBy("device_class", *NATURAL_KEY).agg(F.min("place").alias("first"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("device_class", *NATURAL_KEY)]
    seen = keyed.alias("k").join(first.alias("f"), same).select(F.col("k.device_class").alias("device_class"), F.col("k.place").alias("place"), (F.col("f.first") < F.col("k.place")).alias("seen"))
    each = seen.groupBy("device_class", "place").agg(F.bool_and("seen").alias("every"), F.bool_or("seen").alias("some"))
    return each.groupBy("device_class").agg(F.count("*").alias("messages"), F.count_if("every").alias("pure"), F.count_if(F.col("some") & ~F.col("every")).alias("partial"))


def class_profile(readings: DataFrame) -> DataFrame:
    """Lateness, duplicate keys and duplicate messages of each class in one row."""
    late, keys, messages = lateness(readings), duplicate_keys(readings), message_duplicates(readings)
    out = late.join(keys, late["device_class"].eqNullSafe(keys["device_class"]), "left").drop(keys["device_class"])
    out = out.join(messages, late["device_class"].eqNullSafe(messages["device_class"]), "left").drop(messages["device_class"])
    rates = {f"{k}_rate": ratio(F.col(k), F.col("messages")) for k in ("pure", "partial")}
    return out.withColumns(rates)


def interarrival(messages: DataFrame) -> DataFrame:
    w = W.partitionBy(*GROUP, "device_id").orderBy("arrival_ts_ms", "message_id")
    gaps = messages.withColumn("gap", (F.col("arrival_ts_ms") - F.lag("arrival_ts_ms").over(w)) / 1000.0)
    return gaps.groupBy(*GROUP).agg(*stats(F.col("gap")))


def batch_sizes(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*GROUP).agg(*stats(F.col("n_readings")))


def protocol_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*GROUP, "protocol").agg(F.count("*").alias("n"))


def batch_histogram(messages: DataFrame) -> DataFrame:
    """A row for each size from 1 to the group's largest, also those that don't occur."""
    spine = messages.groupBy(*GROUP).agg(F.max("n_readings").cast("int").alias("top")).where("top >= 1").select(*GROUP, F.explode(F.sequence(F.lit(1), "top")).alias("batch_size"))
    counts = messages.groupBy(*GROUP, F.col("n_readings").cast("int").alias("batch_size")).agg(F.count("*").alias("c"))
    return spine.join(counts, [*GROUP, "batch_size"], "left").select(*GROUP, "batch_size", F.coalesce("c", F.lit(0)).alias("n"))


def size_labels(edges: tuple[int, ...] = DEFAULTS.size_edges) -> list[str]:
    return [f"{a}-{b - 1}" for a, b in zip((0, *edges[:-1]), edges, strict=True)] + [f"{edges[-1]}+"]


def size_label(size: Column, edges: tuple[int, ...] = DEFAULTS.size_edges) -> Column:
    labels = size_labels(edges)
    out = F.when(size < edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:], strict=False):
        out = out.when(size < e, label)
    return out.otherwise(labels[-1])


def message_size(raw: Column) -> Column:
    """Bytes of a message's text as landed, in UTF-8."""
    return F.octet_length(raw).cast("long")


def size_histogram(messages: DataFrame, edges: tuple[int, ...] = DEFAULTS.size_edges) -> DataFrame:
    """messages: with n_bytes. Every label of every group, also those that don't occur."""
    counts = messages.groupBy(*GROUP, size_label(F.col("n_bytes"), edges).alias("label")).agg(F.count("*").alias("c"))
    spine = messages.select(*GROUP).distinct().select(*GROUP, F.explode(F.array(*[F.lit(x) for x in size_labels(edges)])).alias("label"))
    return spine.join(counts, [*GROUP, "label"], "left").select(*GROUP, "label", F.coalesce("c", F.lit(0)).alias("n"))


def arrival_shape(messages: DataFrame) -> DataFrame:
    """The group report: messages, readings, devices and the statistics of batch sizes."""
    return messages.groupBy(*GROUP).agg(F.count("*").alias("messages"), F.sum("n_readings").alias("readings"), F.countDistinct("device_id").alias("devices"), *stats(F.col("n_readings"), "batch_"))


def burst_events(messages: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Messages after a long gap with a large batch, both against the device's medians."""
    dev = [*GROUP, "device_id"]
    w = W.partitionBy(*dev).orderBy("arrival_ts_ms", "message_id")
    m = messages.withColumn("gap", F.col("arrival_ts_ms") - F.lag("arrival_ts_ms").over(w))
    med = m.groupBy(*dev).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.percentile("n_readings", F.lit(0.5)).alias("median_batch"), F.count("*").alias("n"))
    med = med.where((F.col("n") >= limits.burst_least_messages) & (F.col("median_gap") > 0) & (F.col("median_batch") > 0))
    hit = (F.col("gap") / F.col("median_gap") > limits.burst_gap_ratio) & (F.col("n_readings") / F.col("median_batch") > limits.burst_batch_ratio)
    return m.join(med, dev).where(hit).select(*dev, "message_id", (F.col("gap") / 1000.0).alias("gap_s"), F.round(F.col("gap") / F.col("median_gap"), 6).alias("gap_ratio"), F.round(F.col("n_readings") / F.col("median_batch"), 6).alias("batch_ratio"))


def burst_groups(messages: DataFrame, events: DataFrame) -> DataFrame:
    devices = messages.groupBy(*GROUP).agg(F.countDistinct("device_id").alias("devices"))
    hits = events.groupBy(*GROUP).agg(F.countDistinct("device_id").alias("d"), F.count("*").alias("e"))
    return devices.join(hits, list(GROUP), "left").select(*GROUP, "devices", F.coalesce("d", F.lit(0)).alias("devices_with_bursts"), F.coalesce("e", F.lit(0)).alias("burst_events"))


def firmware_metrics(messages: DataFrame, readings: DataFrame, events: DataFrame, outages: DataFrame, outage: float = 0.25, drop: float = 0.1, quirks: dict[str, float] | None = None) -> DataFrame:
    """By firmware: what was injected, and how well the burst detector does against it; shares are null where nothing divides.

    messages: with issues (array: post_outage_burst, late_arrival, duplicate_of:...). outages: a row for each outage of a
    device: firmware_version, buffered and dropped readings. outage and drop: what is expected of a usual firmware."""
    quirks = QUIRKS if quirks is None else quirks
    firmware = F.col("firmware_version")
    has = lambda kind: F.exists("issues", lambda x: x.startswith(kind))
    flagged = events.select("message_id").distinct().withColumn("_f", F.lit(True))
    m = messages.join(flagged, "message_id", "left").withColumns({"_f": F.coalesce("_f", F.lit(False)), "_t": F.coalesce(has("post_outage_burst"), F.lit(False))})
    # by device first, so the distinct counts are sums
    dev = m.groupBy("firmware_version", "device_id").agg(
        F.collect_set("device_class").alias("classes"), F.count("*").alias("messages"), F.sum("n_readings").alias("readings"), F.count_if("_t").alias("true"), F.count_if("_f").alias("flagged"), F.count_if(F.col("_f") & F.col("_t")).alias("hits"),
        F.count_if(has("late_arrival")).alias("late"), F.count_if(has("duplicate_of:")).alias("again"),
    )
    g = dev.groupBy("firmware_version").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("classes")))), "/").alias("device_classes"), F.count("*").alias("devices"), F.sum("messages").alias("messages"), F.sum("readings").alias("readings"),
        F.sum("true").alias("true_bursts"), F.sum("flagged").alias("flagged"), F.sum("hits").alias("hits"), F.sum("late").alias("late_messages"), F.sum("again").alias("duplicate_messages"),
        F.count_if(F.col("true") > 0).alias("devices_true"), F.count_if((F.col("true") > 0) & (F.col("hits") > 0)).alias("devices_hit"),
    )
    reason = timestamp_reason(F.col("device_ts_ms"), F.col("arrival_ts_ms"))
    kinds = {"missing_timestamp_readings": "missing_timestamp", "epoch_default_timestamp_readings": "epoch_default_timestamp", "future_timestamp_readings": "future_timestamp"}
    clocks = readings.withColumn("_r", reason).groupBy("firmware_version").agg(*[F.count_if(F.col("_r") == k).alias(name) for name, k in kinds.items()])
    out = outages.groupBy("firmware_version").agg(F.count("*").alias("outage_events"), F.sum("buffered").alias("outage_readings_buffered"), F.sum("dropped").alias("outage_readings_dropped"))
    j = g.join(clocks, "firmware_version", "left").join(out, "firmware_version", "left")
    zero = [*kinds, "outage_events", "outage_readings_buffered", "outage_readings_dropped"]
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    times = F.lit(1.0)
    for name, x in quirks.items():
        times = F.when(firmware == name, x).otherwise(times)
    c = F.col
    j = j.withColumns({"quirk_multiplier": times, "clock_issues": sum((c(k) for k in list(kinds)[1:]), c(list(kinds)[0]))})
    return j.withColumns({
        "post_outage_burst_messages": c("true_bursts"), "expected_outage_probability": F.round(F.least(F.lit(MOST_OUTAGES), outage * c("quirk_multiplier")), 6), "expected_drop_rate": F.round(F.least(F.lit(MOST_DROPS), drop * c("quirk_multiplier")), 6),
        "recall": ratio(c("hits"), c("true_bursts")), "precision": ratio(c("hits"), c("flagged")), "device_recall": ratio(c("devices_hit"), c("devices_true")),
        "drop_rate": ratio(c("outage_readings_dropped"), c("outage_readings_buffered") + c("outage_readings_dropped")), "outage_rate": ratio(c("outage_events"), c("devices")), "clock_issue_rate": ratio(c("clock_issues"), c("readings")),
    })
