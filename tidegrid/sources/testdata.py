"""The driver's ``events`` table seen as telemetry: readings (a row each) and message envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import message_size

CLASS = "CASE WHEN user_id % 5 < 3 THEN 'stall' ELSE 'cabinet' END"
FIRMWARE = "CASE user_id % 5 WHEN 0 THEN '2.1.4' WHEN 1 THEN '2.3.0' WHEN 2 THEN '3.0.1' WHEN 3 THEN '1.8.2' ELSE '1.9.0' END"
STATE = "CASE event_type WHEN 'signup' THEN 'plugged_in' WHEN 'error' THEN 'fault' WHEN 'purchase' THEN 'session_complete' ELSE 'charging' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With injected clock errors, and retransmitted messages: whole ones (pure) and in part (partial)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("t"))
    ev = ev.withColumns({"true_ts_ms": F.unix_millis("t"), "day": F.to_date("t")}).drop("t")
    env = ev.groupBy("user_id", "day").agg(F.max("true_ts_ms").alias("last_ms"), F.min("event_id").alias("first_event"))
    slow = F.when((F.col("user_id") + F.dayofmonth("day")) % 17 == 0, 10_800_000).otherwise(0)
    env = env.select("user_id", "day", "first_event", (F.col("last_ms") + (F.col("user_id") * 7919) % 900 * 1000 + slow).alias("arrival_ts_ms"))
    r = ev.join(env, ["user_id", "day"])
    t, e = F.col("true_ts_ms"), F.col("event_id")
    r = r.select(
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"), F.expr(CLASS).alias("device_class"), F.expr(FIRMWARE).alias("firmware_version"),
        F.concat(F.lit("site-"), (F.col("user_id") % 7).cast("string")).alias("site_id"),
        F.concat(F.lit("msg-"), F.col("user_id").cast("string"), F.lit("-"), F.col("day").cast("string")).alias("message_id"), "arrival_ts_ms",
        F.when(e % 97 == 0, None).when(e % 89 == 0, 0).when(e % 101 == 0, t + 144_000_000).otherwise(t).cast("long").alias("device_ts_ms"),
        F.left(F.sha1(e.cast("string").cast("binary")), F.lit(16)).alias("payload_hash"), "event_id", F.expr(STATE).alias("session_state"), (F.col("event_type") != "error").alias("contactor_closed"),
        "value", "user_id", F.dayofmonth("day").alias("dom"), (e == F.col("first_event")).alias("is_first"),
    )
    again = r.withColumns({"message_id": F.concat("message_id", F.lit("-retry")), "arrival_ts_ms": F.col("arrival_ts_ms") + 5000})
    key = F.col("user_id") + F.col("dom")
    pure, part = again.where(key % 40 == 0), again.where((key % 41 == 0) & F.col("is_first"))
    made_up = part.withColumn("payload_hash", F.concat(F.lit("made-"), "payload_hash"))
    return r.unionByName(pure).unionByName(part).unionByName(made_up)


def messages(r: DataFrame) -> DataFrame:
    """One row a message: the profilers' input, with its text (raw), the text's size, and what was injected."""
    protocol = F.when(F.col("device_class") == "stall", "mqtt_batch").otherwise("https_poll")
    reading = F.concat(F.lit('{"device_ts_ms":'), F.coalesce(F.col("device_ts_ms").cast("string"), F.lit("null")), F.lit(',"payload_hash":"'), F.col("payload_hash"), F.lit('"}'))
    head = F.concat(F.lit('{"arrival_ts_ms":'), F.col("arrival_ts_ms").cast("string"), F.lit(',"device_id":"'), F.col("device_id"), F.lit('","message_id":"'), F.col("message_id"), F.lit('","readings":['))
    m = r.groupBy("message_id", "device_id", "device_class", "firmware_version", "site_id", "arrival_ts_ms").agg(F.count("*").alias("n_readings"), F.sort_array(F.collect_list(reading)).alias("texts"))
    true = F.ascii(F.right(F.replace("message_id", F.lit("-retry"), F.lit("")), F.lit(1))) % 4 == 0
    again = F.col("message_id").endswith("-retry")
    issues = F.array_compact(F.array(F.when(true, F.lit("post_outage_burst")), F.when(~true & (F.col("arrival_ts_ms") % 7 == 0), F.lit("late_arrival")), F.when(again, F.concat(F.lit("duplicate_of:"), F.replace("message_id", F.lit("-retry"), F.lit(""))))))
    m = m.withColumns({"raw": F.concat(head, F.array_join("texts", ","), F.lit("]}")), "protocol": protocol, "issues": issues})
    return m.withColumn("n_bytes", message_size(F.col("raw"))).drop("texts")


def outage_counts(r: DataFrame) -> DataFrame:
    """A row for each made-up outage of a device: its firmware, and the readings held back and dropped."""
    d = r.select("user_id", "firmware_version").distinct().where("user_id % 4 = 0")
    return d.select("firmware_version", (F.col("user_id") % 50).cast("long").alias("buffered"), (F.col("user_id") % 7).cast("long").alias("dropped"))


def envelopes(r: DataFrame) -> DataFrame:
    """Messages with their readings as JSON texts, as landed."""
    stall = F.to_json(F.struct(F.col("dom").cast("string").alias("session_id"), F.col("session_state").alias("state"), *[F.col("value").alias(c) for c in ("output_voltage_v", "output_current_a", "output_power_kw", "connector_temp_c", "energy_delivered_kwh")], F.lit(0).alias("fault_code"), F.coalesce("device_ts_ms", F.lit(-1)).alias("device_ts_ms"), "payload_hash"))
    cabinet = F.to_json(F.struct(*[F.col("value").alias(c) for c in ("grid_voltage_v", "grid_frequency_hz", "transformer_temp_c", "aggregate_power_kw")], "contactor_closed", F.lit(1).alias("active_stall_count"), F.lit(0).alias("fault_code"), F.coalesce("device_ts_ms", F.lit(-1)).alias("device_ts_ms"), "payload_hash"))
    reading = F.when(F.col("device_class") == "stall", stall).otherwise(cabinet)
    return r.groupBy("message_id", "device_id", "device_class", "firmware_version", "site_id", "arrival_ts_ms").agg(F.collect_list(reading).alias("readings"))


#: The same readings in DuckDB's SQL, as common table expressions.
SQL = f"""
ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS true_ts_ms, CAST(ts AS DATE) AS day FROM events),
env AS (SELECT user_id, day, min(event_id) AS first_event,
        max(true_ts_ms) + (user_id * 7919) % 900 * 1000 + CASE WHEN (user_id + day(day)) % 17 = 0 THEN 10800000 ELSE 0 END AS arrival_ts_ms FROM ev GROUP BY user_id, day),
r0 AS (SELECT 'dev-' || user_id AS device_id, {CLASS} AS device_class, {FIRMWARE} AS firmware_version, 'site-' || (user_id % 7) AS site_id,
        'msg-' || user_id || '-' || strftime(day, '%Y-%m-%d') AS message_id, arrival_ts_ms,
        CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 0 WHEN event_id % 101 = 0 THEN true_ts_ms + 144000000 ELSE true_ts_ms END AS device_ts_ms,
        left(sha1(CAST(event_id AS VARCHAR)), 16) AS payload_hash, event_id, {STATE} AS session_state, event_type <> 'error' AS contactor_closed, value, user_id,
        day(day) AS dom, event_id = first_event AS is_first FROM ev JOIN env USING (user_id, day)),
again AS (SELECT * REPLACE (message_id || '-retry' AS message_id, arrival_ts_ms + 5000 AS arrival_ts_ms) FROM r0),
part AS (SELECT * FROM again WHERE (user_id + dom) % 41 = 0 AND is_first),
readings AS (SELECT * FROM r0 UNION ALL SELECT * FROM again WHERE (user_id + dom) % 40 = 0 UNION ALL SELECT * FROM part
        UNION ALL SELECT * REPLACE ('made-' || payload_hash AS payload_hash) FROM part),
messages AS (SELECT message_id, device_id, device_class, firmware_version, site_id, arrival_ts_ms, count(*) AS n_readings,
        strlen('{{"arrival_ts_ms":' || arrival_ts_ms || ',"device_id":"' || device_id || '","message_id":"' || message_id || '","readings":[' || string_agg('{{"device_ts_ms":' || coalesce(CAST(device_ts_ms AS VARCHAR), 'null') || ',"payload_hash":"' || payload_hash || '"}}', ',') || ']}}') AS n_bytes,
        CASE WHEN device_class = 'stall' THEN 'mqtt_batch' ELSE 'https_poll' END AS protocol FROM readings GROUP BY 1, 2, 3, 4, 5, 6),
judged AS (SELECT *, CASE WHEN device_ts_ms IS NULL THEN 'missing_timestamp' WHEN device_ts_ms = 0 THEN 'epoch_default_timestamp' WHEN device_ts_ms - arrival_ts_ms > 21600000 THEN 'future_timestamp' END AS reason FROM readings),
good AS (SELECT * FROM judged WHERE reason IS NULL),
cut AS (SELECT max(arrival_ts_ms) - 10 * 86400000 AS cut_ms FROM readings),
store AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, device_ts_ms, payload_hash ORDER BY arrival_ts_ms, message_id, event_id) AS rn FROM good WHERE event_id % 6 <> 0) WHERE rn = 1),
late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, device_ts_ms, payload_hash ORDER BY arrival_ts_ms, message_id, event_id) AS rn FROM good WHERE event_id % 6 = 0) l WHERE rn = 1
        AND NOT EXISTS (SELECT 1 FROM store s WHERE s.device_id = l.device_id AND s.device_ts_ms = l.device_ts_ms AND s.payload_hash = l.payload_hash)),
merged AS (SELECT * FROM store UNION ALL SELECT * FROM late),
hours AS (SELECT *, strftime(make_timestamp(device_ts_ms * 1000), '%Y-%m-%dT%H') AS event_hour FROM merged),
dirty AS (SELECT DISTINCT device_id, strftime(make_timestamp(device_ts_ms * 1000), '%Y-%m-%dT%H') AS event_hour FROM late
        INTERSECT SELECT DISTINCT device_id, strftime(make_timestamp(device_ts_ms * 1000), '%Y-%m-%dT%H') FROM store),
series AS (SELECT *, CASE WHEN device_class = 'stall' THEN session_state WHEN contactor_closed THEN 'energized' ELSE 'de_energized' END AS mode FROM merged),
buckets AS (SELECT * FROM (SELECT device_id, device_class, device_ts_ms - ((device_ts_ms % 60000) + 60000) % 60000 AS bucket_start_ms, mode,
        count(*) OVER (PARTITION BY device_id, device_ts_ms - ((device_ts_ms % 60000) + 60000) % 60000) AS reading_count,
        row_number() OVER (PARTITION BY device_id, device_ts_ms - ((device_ts_ms % 60000) + 60000) % 60000 ORDER BY device_ts_ms DESC, event_id, payload_hash) AS rn FROM series) WHERE rn = 1)
"""
