"""Envelopes: reading, validation and idempotent landing by arrival hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import utc
from ..model import CLASSES, ENVELOPE, ENVELOPE_REQUIRED
from ..operators.stage1 import ReconciliationError
from ..scratch import put_json


def read_envelopes(spark: SparkSession, root: str) -> DataFrame:
    """JSON lines of all groups with their text: raw, the envelope's columns, and readings as an array of JSON texts (null if it is no array)."""
    return parse_raw(spark.read.text(f"{root}/*/*/*").withColumnRenamed("value", "raw"))


def parse_raw(raw: DataFrame) -> DataFrame:
    schema = f"{ENVELOPE}, readings array<string>"
    return raw.withColumn("m", F.from_json("raw", schema)).select("raw", "m.*")


def write_envelopes(messages: DataFrame, root: str, about: dict | None = None) -> dict:
    """JSON lines under <root>/<class>/<firmware>/, and manifest.json: ``about``, and of each group its messages, readings
    and injected issues by kind. messages: as parse_raw returns them."""
    issues = F.from_json("raw", "_debug_injected_issues array<string>")["_debug_injected_issues"]
    group = ["device_class", "firmware_version"]
    counts = messages.groupBy(*group).agg(F.count("*").alias("messages"), F.sum(F.size("readings")).alias("readings")).collect()  # a row a class and firmware
    found = messages.select(*group, F.explode(issues).alias("issue")).groupBy(*group, F.split("issue", ":")[0].alias("kind")).count().collect()
    groups = {f"{r.device_class}/{r.firmware_version}": {"messages": r.messages, "readings": r.readings} for r in counts}
    for r in found:
        groups[f"{r.device_class}/{r.firmware_version}"][r.kind] = r["count"]
    for r in counts:
        mine = messages.where(F.col("device_class").eqNullSafe(r.device_class) & F.col("firmware_version").eqNullSafe(r.firmware_version))
        mine.select("raw").write.mode("errorifexists").text(f"{root}/{r.device_class}/{r.firmware_version}/messages.jsonl")
    manifest = {**(about or {}), "groups": groups}
    put_json(messages.sparkSession, f"{root}/manifest.json", manifest)
    return manifest


def reject_reason(frame: DataFrame) -> Column:
    """The first rule that an envelope breaks, null if none."""
    reason = F.lit(None).cast("string")
    reason = F.when(F.col("readings").isNull() | (F.size("readings") < 1), "readings_not_a_non_empty_list").otherwise(reason)
    reason = F.when(~F.col("device_class").isin(*CLASSES), F.concat(F.lit("unsupported_device_class: "), "device_class")).otherwise(reason)
    for name in reversed(ENVELOPE_REQUIRED[:-1]):
        reason = F.when(F.col(name).isNull(), f"missing_field: {name}").otherwise(reason)
    return reason


def arrival_partitions(messages: DataFrame) -> DataFrame:
    """With arrival_date and hour."""
    return messages.withColumns({"arrival_date": utc(F.col("arrival_ts_ms"), "yyyy-MM-dd"), "hour": utc(F.col("arrival_ts_ms"), "HH")})


def first_of_each(messages: DataFrame, order: list[str]) -> DataFrame:
    """Of rows with one (arrival hour, message_id), the first by ``order``."""
    values = [c for c in messages.columns if c not in ("arrival_date", "hour", "message_id")]
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("v")
    return messages.groupBy("arrival_date", "hour", "message_id").agg(first).select("arrival_date", "hour", "message_id", "v.*")


def not_landed(batch: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows whose key isn't there yet; only the batch's arrival hours are read."""
    return batch.join(landed.select("arrival_date", "hour", "message_id"), ["arrival_date", "hour", "message_id"], "left_anti")


def landed_rows(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    landed = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    return landed.withColumns({c: F.col(c).cast("string") for c in ("arrival_date", "hour")}).withColumn("hour", F.lpad("hour", 2, "0"))


def land(messages: DataFrame, path: str, order: list[str] | None = None) -> dict[str, int]:
    """Append what isn't there; never overwrite. Returns counts that are taken each on its own: seen, written, present
    (there before, or a repeat within the batch) and landed (the batch's messages that are there afterwards)."""
    spark = messages.sparkSession
    bad = messages.where(~F.col("device_class").isin(*CLASSES)).select("device_class").limit(1).collect()
    if bad:
        raise ValueError(f"unsupported device class: {bad[0][0]}")
    key = ["arrival_date", "hour", "message_id"]
    batch = arrival_partitions(messages)
    once = first_of_each(batch, order or ["arrival_ts_ms", "raw"]).persist()
    hours = batch.select("arrival_date", "hour").distinct()
    before, there, fresh = landed_rows(spark, path), 0, once
    if before is not None:
        before = before.join(hours, ["arrival_date", "hour"], "left_semi")
        there = once.join(before.select(*key), key, "left_semi").count()
        fresh = not_landed(once, before)
    fresh = fresh.persist()
    seen, distinct, written = messages.count(), once.count(), fresh.count()
    if written:
        fresh.write.mode("append").partitionBy("arrival_date", "hour").parquet(path)
    after = landed_rows(spark, path)
    landed = once.join(after.select(*key), key, "left_semi").count() if after is not None else 0
    fresh.unpersist()
    once.unpersist()
    return {"seen": seen, "written": written, "present": seen - distinct + there, "landed": landed, "distinct": distinct}


def reconcile(result: dict[str, int]) -> None:
    """Every message that was seen is written or was present, and all that differ are there now."""
    if result["written"] + result["present"] != result["seen"] or result["landed"] != result["distinct"]:
        raise ReconciliationError(str(result))


def window_scan(messages: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """start <= arrival < end."""
    return messages.where((F.col("arrival_ts_ms") >= start_ms) & (F.col("arrival_ts_ms") < end_ms))
