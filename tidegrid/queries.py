"""One query for each operator over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as fn
from .model import CABINET_SIGNALS, CATALOG, STALL_SIGNALS
from .operators import profile, quantiles, stage1, stage2, stage3
from .operators.stores import Stage1Store
from .plans import detectors, late_data, observability, stage4
from .scratch import materialize, shared_dir
from .sources import landing, testdata
from .sources.testdata import SQL, messages, readings, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW_MS = 1_706_745_600_000  # 2024-02-01T00:00:00Z, after the last event
TIES = ["event_id", "payload_hash"]


def query(sql: str, base: bool = True) -> Callable[[Query], Query]:
    """base: the SQL goes on after the common table expressions of the readings."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        more = "" if sql.lstrip().startswith("SELECT") else ","
        ORACLE_SQL[f.__name__] = f"WITH {SQL}{more} {sql}" if base else sql
        return f

    return add


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_data.accepted(readings(spark, sf_dir))


def batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = good(spark, sf_dir)
    return g.where("event_id % 6 <> 0"), g.where("event_id % 6 = 0")


def with_mode(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mode", stage3.mode(F.col("device_class"), F.col("session_state"), F.col("contactor_closed")))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_data.merged_rows(*batches(spark, sf_dir))


# Landing


@query("""b AS (SELECT CAST(right(message_id, 1) AS VARCHAR) AS x FROM messages)
SELECT CASE x WHEN '0' THEN 'missing_field: message_id' WHEN '1' THEN 'missing_field: device_id' WHEN '2' THEN 'missing_field: device_class' WHEN '3' THEN 'missing_field: arrival_ts_ms' WHEN '4' THEN 'unsupported_device_class: boat' WHEN '5' THEN 'readings_not_a_non_empty_list' WHEN '6' THEN 'readings_not_a_non_empty_list' END AS reason, count(*) AS n FROM b GROUP BY 1""")
def in1_envelope_validation(spark, sf_dir):
    """Envelopes of which the last character of the message's name says what is wrong: each rule breaks some."""
    env = testdata.envelopes(readings(spark, sf_dir))
    x = F.right("message_id", F.lit(1))
    env = env.select(
        F.when(x != "0", F.col("message_id")).alias("message_id"), F.when(x != "1", F.col("device_id")).alias("device_id"), F.when(x == "4", F.lit("boat")).when(x != "2", F.col("device_class")).alias("device_class"),
        F.when(x != "3", F.col("arrival_ts_ms")).alias("arrival_ts_ms"), F.when(x == "5", F.array().cast("array<string>")).when(x != "6", F.col("readings")).alias("readings"),
    )
    return env.groupBy(landing.reject_reason(env).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT strftime(make_timestamp(arrival_ts_ms * 1000), '%Y-%m-%d') AS arrival_date, strftime(make_timestamp(arrival_ts_ms * 1000), '%H') AS hour, count(*) AS n FROM messages GROUP BY 1, 2")
def s0_arrival_partitions(spark, sf_dir):
    return landing.arrival_partitions(messages(readings(spark, sf_dir))).groupBy("arrival_date", "hour").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT message_id, device_id, n_readings FROM messages")
def s0_idempotent_landing(spark, sf_dir):
    """Half of the messages are there; all are sent; those that were there aren't landed again."""
    every = landing.arrival_partitions(messages(readings(spark, sf_dir)))
    first = landing.first_of_each(every.where(F.col("message_id").endswith("-retry")), ["arrival_ts_ms"])
    more = landing.not_landed(landing.first_of_each(every, ["arrival_ts_ms"]), first)
    return first.unionByName(more).select("message_id", "device_id", "n_readings")


@query("SELECT message_id, arrival_ts_ms FROM messages WHERE arrival_ts_ms >= 1704672000000 AND arrival_ts_ms < 1704758400000")
def s0_window_scan(spark, sf_dir):
    return landing.window_scan(messages(readings(spark, sf_dir)), 1_704_672_000_000, 1_704_758_400_000).select("message_id", "arrival_ts_ms")


# Stage 1


@query("SELECT device_class, firmware_version, count(*) AS n_rows, count(DISTINCT message_id) AS n_messages, count(DISTINCT payload_hash) AS n_hashes FROM readings WHERE firmware_version <> '1.9.0' GROUP BY 1, 2")
def p1_parse_dispatch(spark, sf_dir):
    registry = {k: v for k, v in stage1.default_registry().items() if k[1] != "1.9.0"}
    rows, _ = stage1.parse_messages(testdata.envelopes(readings(spark, sf_dir)), registry)
    return rows.groupBy("device_class", "firmware_version").agg(F.count("*").alias("n_rows"), F.countDistinct("message_id").alias("n_messages"), F.countDistinct("payload_hash").alias("n_hashes"))


@query("SELECT 'no_parser_registered_for_(cabinet, 1.9.0)' AS reason, count(*) AS n FROM messages WHERE firmware_version = '1.9.0' HAVING count(*) > 0")
def p1_quarantine(spark, sf_dir):
    registry = {k: v for k, v in stage1.default_registry().items() if k[1] != "1.9.0"}
    _, bad = stage1.parse_messages(testdata.envelopes(readings(spark, sf_dir)), registry)
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT device_class, reason, count(*) AS n FROM judged GROUP BY 1, 2")
def t1_timestamp_reasons(spark, sf_dir):
    reason = stage1.timestamp_reason(F.col("device_ts_ms"), F.col("arrival_ts_ms"))
    return readings(spark, sf_dir).groupBy("device_class", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM messages) AS seen, (SELECT count(*) FROM messages WHERE firmware_version <> '1.9.0') AS outcome_0, (SELECT count(*) FROM messages WHERE firmware_version = '1.9.0') AS outcome_1")
def p7_message_reconciliation(spark, sf_dir):
    """Messages seen, parsed and quarantined, each counted on its own."""
    registry = {k: v for k, v in stage1.default_registry().items() if k[1] != "1.9.0"}
    env = testdata.envelopes(readings(spark, sf_dir))
    rows, bad = stage1.parse_messages(env, registry)
    return spark.createDataFrame([tuple(stage1.reconcile(env, rows, bad, of="message_id").values())], "seen long, outcome_0 long, outcome_1 long")


@query("SELECT count(*) AS seen, count(*) FILTER (reason IS NULL) AS outcome_0, count(reason) AS outcome_1 FROM judged")
def t2_row_reconciliation(spark, sf_dir):
    r = readings(spark, sf_dir)
    return spark.createDataFrame([tuple(stage1.reconcile(r, *stage1.check_timestamps(r)).values())], "seen long, outcome_0 long, outcome_1 long")


@query("SELECT device_id, device_ts_ms, payload_hash, message_id, arrival_ts_ms FROM merged")
def m2_merge_dedup(spark, sf_dir):
    return merged(spark, sf_dir).select("device_id", "device_ts_ms", "payload_hash", "message_id", "arrival_ts_ms")


def stored(spark, sf_dir) -> Stage1Store:
    """Both batches through the store, the second one sent twice."""
    store = Stage1Store(spark, f"{shared_dir(spark)}/stage1-{uuid.uuid4().hex}", ("event_date",))
    for number, batch in ((0, 0), (1, 1), (1, 1)):
        store.merge(number, batches(spark, sf_dir)[batch], late_data.ORDER)
    return store


@query("SELECT device_id, device_ts_ms, payload_hash, message_id, arrival_ts_ms, event_id, CAST(CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS batch_id FROM merged")
def m2_store_merge(spark, sf_dir):
    """Rows by the store, after compaction."""
    store = stored(spark, sf_dir)
    store.compact()
    return store.rows().select("device_id", "device_ts_ms", "payload_hash", "message_id", "arrival_ts_ms", "event_id", "batch_id")


@query("SELECT * FROM dirty WHERE event_hour < '2024-01-10T00' OR event_hour >= '2024-01-20T00'")
def dk2_dirty_table(spark, sf_dir):
    """Dirty keys by the store, of which a consumer has cleared some."""
    store = stored(spark, sf_dir)
    keys, upto = store.dirty("grid")
    store.clear(keys.where("event_hour >= '2024-01-10T00' and event_hour < '2024-01-20T00'"), upto, "grid")
    return store.dirty("grid")[0]


@query("SELECT DISTINCT device_id, CAST(('0x' || right(sha1(device_id), 1)) AS INT) AS device_bucket FROM readings")
def m3_device_bucket(spark, sf_dir):
    return readings(spark, sf_dir).select("device_id").distinct().withColumn("device_bucket", fn.device_bucket(F.col("device_id")))


@query("SELECT device_class, strftime(make_timestamp(device_ts_ms * 1000), '%Y-%m-%d') AS event_date, strftime(make_timestamp(device_ts_ms * 1000), '%H') AS hour, CAST(('0x' || right(sha1(device_id), 1)) AS INT) AS device_bucket, count(*) AS n FROM merged GROUP BY 1, 2, 3, 4")
def m4_partition_keys(spark, sf_dir):
    return stage1.partition_columns(merged(spark, sf_dir)).groupBy("device_class", "event_date", "hour", "device_bucket").agg(F.count("*").alias("n"))


@query("SELECT * FROM dirty")
def dk1_dirty_hours(spark, sf_dir):
    return late_data.merged(*batches(spark, sf_dir))[1]


# Stage 2


@query("SELECT device_id, CAST(round_even(quantile_cont(arrival_ts_ms - device_ts_ms, 0.5), 0) AS BIGINT) AS offset_ms FROM good GROUP BY 1")
def a1_clock_offset(spark, sf_dir):
    return stage2.estimate_offsets(good(spark, sf_dir))


@query("""o AS (SELECT device_id, CAST(round_even(quantile_cont(arrival_ts_ms - device_ts_ms, 0.5), 0) AS BIGINT) AS off FROM good WHERE user_id % 3 > 0 GROUP BY 1)
SELECT device_id, device_ts_ms, payload_hash, coalesce(off, 0) AS offset_ms, device_ts_ms + coalesce(off, 0) AS corrected_event_ts_ms, off IS NOT NULL AS is_estimated FROM merged LEFT JOIN o USING (device_id)""")
def o1_corrected_time(spark, sf_dir):
    offsets = stage2.estimate_offsets(good(spark, sf_dir).where("user_id % 3 > 0"))
    return stage2.corrected_time(merged(spark, sf_dir), offsets).select("device_id", "device_ts_ms", "payload_hash", "offset_ms", "corrected_event_ts_ms", "is_estimated")


@query("""o AS (SELECT device_id, CAST(round_even(quantile_cont(arrival_ts_ms - device_ts_ms, 0.5), 0) AS BIGINT) AS off, dom < 15 AS early FROM good GROUP BY 1, 3)
SELECT device_id, coalesce(max(off) FILTER (NOT early), max(off)) AS offset_ms FROM o GROUP BY 1""")
def o2_offset_upsert(spark, sf_dir):
    g = good(spark, sf_dir)
    return stage2.update_offsets(stage2.estimate_offsets(g.where("dom < 15")), stage2.estimate_offsets(g.where("dom >= 15")))


def raw_texts(spark, sf_dir):
    """Values as text, some of which strict casts refuse."""
    e = F.col("event_id")
    bad = F.when(e % 11 == 0, "yes").when(e % 13 == 0, " TRUE ").otherwise(F.when(F.col("event_type") != "error", "true").otherwise("false"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"), F.lit("cabinet").alias("device_class"), e.cast("string").alias("payload_hash"),
        F.when(e % 17 == 0, "1_0 V").when(e % 29 == 0, F.concat(F.lit("\t"), (e % 100).cast("string"), F.lit(".0e0\n"))).otherwise((e % 100).cast("string")).alias("grid_voltage_v"), bad.alias("contactor_closed"), F.when(e % 19 == 0, "1.5").when(e % 23 == 0, "2.0").otherwise((e % 9).cast("string")).alias("active_stall_count"), F.lit("x").alias("site_id"), F.lit("y").alias("extra"),
    )


RAW_SQL = """WITH t AS (SELECT event_id, 'dev-' || user_id AS device_id, CAST(event_id AS VARCHAR) AS payload_hash, event_id % 17 = 0 AS bad_v, event_id % 11 = 0 AS bad_b, event_id % 19 = 0 OR event_id % 23 = 0 AS bad_i,
CAST(event_id % 100 AS DOUBLE) AS grid_voltage_v, event_id % 13 = 0 OR event_type <> 'error' AS contactor_closed, event_id % 9 AS active_stall_count FROM events) """


@query(RAW_SQL + "SELECT device_id, payload_hash, grid_voltage_v, contactor_closed, active_stall_count FROM t WHERE NOT (bad_v OR bad_b OR bad_i)", base=False)
def c3_strict_cast(spark, sf_dir):
    ok, _ = stage2.split_failed(stage2.canonicalize(raw_texts(spark, sf_dir), CABINET_SIGNALS))
    return ok.select("device_id", "payload_hash", "grid_voltage_v", "contactor_closed", "active_stall_count")


@query(RAW_SQL + ", e AS (SELECT unnest([CASE WHEN bad_v THEN 'grid_voltage_v' END, CASE WHEN bad_b THEN 'contactor_closed' END, CASE WHEN bad_i THEN 'active_stall_count' END]) AS field FROM t) SELECT field, count(*) AS n FROM e WHERE field IS NOT NULL GROUP BY 1", base=False)
def c3_failed_fields(spark, sf_dir):
    _, bad = stage2.split_failed(stage2.canonicalize(raw_texts(spark, sf_dir), CABINET_SIGNALS))
    return bad.select(F.explode("errors").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query(RAW_SQL + "SELECT field, count(*) AS n FROM t, (VALUES ('site_id'), ('extra')) f(field) WHERE NOT (bad_v OR bad_b OR bad_i) GROUP BY 1", base=False)
def a16_dropped_fields(spark, sf_dir):
    ok, _ = stage2.split_failed(stage2.canonicalize(raw_texts(spark, sf_dir), CABINET_SIGNALS))
    return stage2.dropped_field_counts(ok)


def signals_of(rows: DataFrame) -> DataFrame:
    """Canonical stall rows: whole numbers of value as signals that move, repeat, fall and leave their ranges."""
    v = F.floor("value").cast("double")
    return rows.where("device_class = 'stall'").select(
        "device_id", "device_ts_ms", "payload_hash", "event_id", F.concat(F.lit("s"), F.floor(F.col("dom") / 3).cast("string")).alias("session_id"),
        (v % 60 + 370).alias("output_voltage_v"), (v % 3 + 41).alias("connector_temp_c"), (v % 50).alias("energy_delivered_kwh"),
    )


FLAG_SQL = """s AS (SELECT device_id, device_ts_ms, payload_hash, event_id, 's' || CAST(floor(dom / 3) AS INT) AS session_id, floor(value) % 60 + 370 AS volt, floor(value) % 3 + 41 AS temp, floor(value) % 50 AS energy FROM merged WHERE device_class = 'stall'),
p AS (SELECT *, lag(session_id) OVER w AS ps, lag(volt) OVER w AS pv, lag(temp) OVER w AS pt, lag(energy) OVER w AS pe, (device_ts_ms - lag(device_ts_ms) OVER w) / 1000.0 AS dt FROM s WINDOW w AS (PARTITION BY device_id ORDER BY device_ts_ms, event_id, payload_hash)),
i AS (SELECT *, sum(CASE WHEN temp = pt THEN 0 ELSE 1 END) OVER w AS ti, sum(CASE WHEN energy = pe THEN 0 ELSE 1 END) OVER w AS ei FROM p WINDOW w AS (PARTITION BY device_id ORDER BY device_ts_ms, event_id, payload_hash)),
r AS (SELECT *, row_number() OVER (PARTITION BY device_id, ti ORDER BY device_ts_ms, event_id, payload_hash) AS tr, row_number() OVER (PARTITION BY device_id, ei ORDER BY device_ts_ms, event_id, payload_hash) AS er, coalesce(ps <> session_id, FALSE) AS ns FROM i),
flags AS (
SELECT device_id, event_id, payload_hash, 'range' AS kind, 'output_voltage_v' AS field FROM r WHERE volt < 390 OR volt > 410
UNION ALL SELECT device_id, event_id, payload_hash, 'range', 'connector_temp_c' FROM r WHERE temp < 29 OR temp > 43.7
UNION ALL SELECT device_id, event_id, payload_hash, 'range', 'energy_delivered_kwh' FROM r WHERE energy < 0
UNION ALL SELECT device_id, event_id, payload_hash, 'stuck', 'connector_temp_c' FROM r WHERE tr >= 5
UNION ALL SELECT device_id, event_id, payload_hash, 'stuck', 'energy_delivered_kwh' FROM r WHERE er >= 5
UNION ALL SELECT device_id, event_id, payload_hash, 'counter_reset', 'energy_delivered_kwh' FROM r WHERE energy < pe AND NOT ns
UNION ALL SELECT device_id, event_id, payload_hash, 'jump', 'output_voltage_v' FROM r WHERE dt > 0 AND abs(volt - pv) / dt > 10 AND NOT ns
UNION ALL SELECT device_id, event_id, payload_hash, 'jump', 'connector_temp_c' FROM r WHERE dt > 0 AND abs(temp - pt) / dt > 2 AND NOT ns
UNION ALL SELECT device_id, event_id, payload_hash, 'jump', 'energy_delivered_kwh' FROM r WHERE dt > 0 AND abs(energy - pe) / dt > 0.05 AND NOT ns)
"""


def flagged(spark, sf_dir):
    return stage2.flag_rows(signals_of(merged(spark, sf_dir)), STALL_SIGNALS, ["device_ts_ms", *TIES])


def flags_of(kind: str) -> Query:
    def run(spark, sf_dir):
        return flagged(spark, sf_dir).select("device_id", "event_id", "payload_hash", F.explode("flags").alias("f")).where(F.col("f.kind") == kind).select("device_id", "event_id", "payload_hash", F.col("f.kind").alias("kind"), F.col("f.field").alias("field"))

    return run


for _name, _kind in (("q1_range", "range"), ("w1_stuck", "stuck"), ("w2_counter_reset", "counter_reset"), ("w3_jump", "jump")):
    _f = flags_of(_kind)
    _f.__name__ = _name
    query(FLAG_SQL + f"SELECT * FROM flags WHERE kind = '{_kind}'")(_f)


@query(FLAG_SQL + "SELECT kind, field, count(*) AS n FROM flags GROUP BY 1, 2")
def a14_flag_counts(spark, sf_dir):
    return stage2.flag_counts(flagged(spark, sf_dir))


#: The raw fields that readings of each class have here.
RAW_FIELDS = {"stall": frozenset({"state", "output_voltage_v"}), "cabinet": frozenset({"contactor_closed", "active_stall_count"})}
KEPT = ("event_id", "extra_column")


def raw_fields(rows: DataFrame) -> DataFrame:
    """Stage 1 rows of both classes with raw fields: text, numbers and booleans, some of which strict casts refuse."""
    stall, e = F.col("device_class") == "stall", F.col("event_id")
    return rows.select(
        "device_id", "device_class", "firmware_version", "device_ts_ms", "payload_hash", "arrival_ts_ms", "event_id", F.lit("x").alias("extra_column"), F.when(stall, F.col("session_state")).alias("state"),
        F.when(stall, F.when(e % 17 == 0, F.lit("1.5 V")).otherwise(F.col("value").cast("string"))).alias("output_voltage_v"), F.when(~stall, F.col("contactor_closed")).alias("contactor_closed"),
        F.when(~stall, F.when(e % 19 == 0, 1.5).when(e % 31 == 0, None).otherwise((e % 9).cast("double"))).alias("active_stall_count"),
    )


def stage1_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Raw rows after both merges and the dirty hours, with one of a device that has no rows."""
    rows, dirty = late_data.merged(*batches(spark, sf_dir))
    ghost = spark.createDataFrame([("dev-none", "2024-01-03T04")], "device_id string, event_hour string")
    return raw_fields(rows), materialize(dirty.unionByName(ghost), "dirty")


RECOMPUTE_SQL = """keys AS (SELECT device_id, event_hour FROM dirty UNION ALL SELECT 'dev-none', '2024-01-03T04'),
canon AS (SELECT *, CASE WHEN device_class = 'stall' THEN session_state WHEN contactor_closed THEN 'energized' ELSE 'de_energized' END AS mode, device_class = 'stall' AND event_id % 17 = 0 OR device_class = 'cabinet' AND (event_id % 19 = 0 OR event_id % 31 = 0) AS failed FROM hours),
hit AS (SELECT c.* FROM canon c JOIN keys USING (device_id, event_hour))
"""


@query(RECOMPUTE_SQL + ", g AS (SELECT device_id, event_hour, count(*) AS n, count(*) FILTER (failed) AS f FROM hit GROUP BY 1, 2) SELECT device_id, event_hour, coalesce(n, 0) AS rows_seen, coalesce(n - f, 0) AS rows_recomputed, coalesce(f, 0) AS rows_failed FROM keys LEFT JOIN g USING (device_id, event_hour)")
def r2_targeted_recompute(spark, sf_dir):
    """Of each dirty hour: rows seen, canonicalised and failed."""
    return stage2.recompute(*stage1_tables(spark, sf_dir), CATALOG, KEPT, RAW_FIELDS).per_key


@query(RECOMPUTE_SQL + """SELECT device_id, event_id, payload_hash, session_state, contactor_closed, output_voltage_v, active_stall_count FROM (SELECT device_id, event_id, payload_hash, CASE WHEN device_class = 'stall' THEN session_state END AS session_state, CASE WHEN device_class = 'cabinet' THEN contactor_closed END AS contactor_closed,
CASE WHEN device_class = 'stall' THEN value END AS output_voltage_v, CASE WHEN device_class = 'cabinet' THEN event_id % 9 END AS active_stall_count FROM hit WHERE NOT failed)""")
def r2_recomputed_rows(spark, sf_dir):
    """The canonical rows of dirty hours, each by its own class and firmware."""
    rows = stage2.recompute(*stage1_tables(spark, sf_dir), CATALOG, KEPT, RAW_FIELDS).rows
    return rows.select("device_id", "event_id", "payload_hash", "session_state", "contactor_closed", "output_voltage_v", "active_stall_count")


@query(RECOMPUTE_SQL + ", e AS (SELECT device_class, CASE WHEN event_id % 17 = 0 AND device_class = 'stall' THEN 'output_voltage_v' ELSE 'active_stall_count' END AS field FROM canon WHERE failed) SELECT device_class, field, count(*) AS n FROM e GROUP BY 1, 2")
def j5_mixed_catalog(spark, sf_dir):
    """Refused fields of all rows, by class, in one pass over both."""
    bad = stage2.split_failed(stage2.canonicalize_mixed(raw_fields(merged(spark, sf_dir)), CATALOG, KEPT, RAW_FIELDS))[1]
    return bad.select("device_class", F.explode("errors").alias("field")).groupBy("device_class", "field").agg(F.count("*").alias("n"))


@query("""o AS (SELECT device_class, firmware_version, value AS v FROM merged)
SELECT device_class, firmware_version, count(*) AS n_rows, CAST(count(*) FILTER (device_class = 'stall' AND firmware_version <> '3.0.1' AND (v < 390 OR v > 410)) AS BIGINT) AS n_range FROM o GROUP BY 1, 2""")
def q2_mixed_flags(spark, sf_dir):
    """Range flags over devices of all classes and firmware; for one firmware the catalog has no entries."""
    catalog = {k: v for k, v in CATALOG.items() if k[1] != "3.0.1"}
    rows = merged(spark, sf_dir).select("device_id", "device_class", "firmware_version", "device_ts_ms", "payload_hash", "event_id", F.when(F.col("device_class") == "stall", F.col("value")).alias("output_voltage_v"))
    flags = stage2.flag_mixed(rows, catalog, ["device_ts_ms", *TIES])
    ranged = F.exists("flags", lambda f: f["kind"] == "range")
    return flags.groupBy("device_class", "firmware_version").agg(F.count("*").alias("n_rows"), F.count_if(ranged).alias("n_range"))


# Stage 3

GRID_SQL = RECOMPUTE_SQL + """,
cb AS (SELECT * FROM (SELECT device_id, device_class, device_ts_ms - ((device_ts_ms % 60000) + 60000) % 60000 AS bucket_start_ms, mode,
        count(*) OVER (PARTITION BY device_id, device_ts_ms - ((device_ts_ms % 60000) + 60000) % 60000) AS reading_count,
        row_number() OVER (PARTITION BY device_id, device_ts_ms - ((device_ts_ms % 60000) + 60000) % 60000 ORDER BY device_ts_ms DESC, event_id, payload_hash) AS rn FROM canon WHERE NOT failed) WHERE rn = 1),
d AS (SELECT DISTINCT device_id, device_class, event_hour, epoch_ms(strptime(event_hour, '%Y-%m-%dT%H')) AS s FROM hit WHERE NOT failed),
spine AS (SELECT device_id, device_class, s AS range_start_ms, s + 60000 * unnest(range(60)) AS bucket_start_ms FROM d),
g AS (SELECT p.*, b.mode AS m, b.reading_count AS n FROM spine p LEFT JOIN cb b USING (device_id, device_class, bucket_start_ms)),
grid AS (SELECT device_id, device_class, range_start_ms, bucket_start_ms, CASE WHEN n IS NULL THEN 'gap' ELSE 'measured' END AS coverage,
last_value(m IGNORE NULLS) OVER (PARTITION BY device_id, range_start_ms ORDER BY bucket_start_ms ROWS UNBOUNDED PRECEDING) AS mode, coalesce(n, 0) AS reading_count FROM g)
"""


@query("SELECT device_id, device_class, bucket_start_ms, mode, reading_count FROM buckets")
def w9_latest_in_bucket(spark, sf_dir):
    return stage3.latest_in_bucket(with_mode(merged(spark, sf_dir)), TIES)


def recomputed(spark, sf_dir) -> stage2.Recompute:
    r = stage2.recompute(*stage1_tables(spark, sf_dir), CATALOG, KEPT, RAW_FIELDS)
    return stage2.Recompute(materialize(r.rows.select("device_id", "device_class", "device_ts_ms", "payload_hash", "event_id", "event_hour", "session_state", "contactor_closed"), "recomputed"), r.failed, r.per_key)


@query(GRID_SQL + "SELECT * FROM grid")
def r3_grid_rebuild(spark, sf_dir):
    return late_data.rebuilt_grid(recomputed(spark, sf_dir), TIES)


@query(GRID_SQL + """, n AS (SELECT device_id, event_hour, count(*) AS n, count(*) FILTER (failed) AS f FROM hit GROUP BY 1, 2), b AS (SELECT device_id, range_start_ms, min(device_class) AS device_class, count(*) AS buckets, count(*) FILTER (coverage = 'measured') AS measured FROM grid GROUP BY 1, 2)
SELECT k.device_id, k.event_hour, b.device_class, coalesce(n, 0) AS rows_seen, coalesce(f, 0) AS rows_failed, coalesce(buckets, 0) AS buckets, coalesce(measured, 0) AS measured FROM keys k LEFT JOIN n USING (device_id, event_hour) LEFT JOIN b ON b.device_id = k.device_id AND b.range_start_ms = epoch_ms(strptime(k.event_hour, '%Y-%m-%dT%H'))""")
def r3_rebuilt_hours(spark, sf_dir):
    """Every dirty hour, also those whose rows are all gone or all failed."""
    r = recomputed(spark, sf_dir)
    return late_data.rebuilt_hours(r, late_data.rebuilt_grid(r, TIES))


DAY_SQL = """w AS (SELECT *, bucket_start_ms // 86400000 * 86400000 AS day_start_ms, CAST(bucket_start_ms % 86400000 // 60000 AS INT) AS ix FROM buckets),
x AS (SELECT *, lag(ix) OVER v AS b, lead(ix) OVER v AS a FROM w WINDOW v AS (PARTITION BY device_id, day_start_ms ORDER BY ix)),
days AS (SELECT device_id, device_class, day_start_ms, CAST(1440 AS BIGINT) AS bucket_count, count(*) AS measured_count, 1440 - count(*) AS gap_count, round(count(*) / 1440, 6) AS coverage_ratio,
CAST(sum(reading_count) AS BIGINT) AS reading_total, CAST(max(greatest(CASE WHEN b IS NULL THEN ix ELSE ix - b - 1 END, CASE WHEN a IS NULL THEN 1439 - ix ELSE 0 END)) AS BIGINT) AS longest_gap FROM x GROUP BY 1, 2, 3)
"""
#: The dense way: every minute of every device-day, modes carried forward.
DENSE_SQL = """dd AS (SELECT DISTINCT device_id, bucket_start_ms // 86400000 * 86400000 AS day_start_ms FROM buckets),
spine AS (SELECT device_id, day_start_ms, day_start_ms + 60000 * unnest(range(1440)) AS bucket_start_ms FROM dd),
m AS (SELECT p.device_id, p.day_start_ms, last_value(b.mode IGNORE NULLS) OVER (PARTITION BY p.device_id, p.day_start_ms ORDER BY p.bucket_start_ms ROWS UNBOUNDED PRECEDING) AS mode FROM spine p LEFT JOIN buckets b USING (device_id, bucket_start_ms))
"""


@query(DAY_SQL + "SELECT * FROM days")
def a15_device_day(spark, sf_dir):
    return stage3.device_days(stage3.day_buckets(with_mode(merged(spark, sf_dir)), TIES))


@query(DENSE_SQL + "SELECT device_id, day_start_ms, mode, count(*) AS minutes FROM m GROUP BY 1, 2, 3")
def a15_mode_minutes(spark, sf_dir):
    return stage3.mode_minutes(stage3.day_buckets(with_mode(merged(spark, sf_dir)), TIES))


@query(GRID_SQL + """, w AS (SELECT *, strftime(make_timestamp(bucket_start_ms * 1000), '%Y-%m-%d') AS event_day, CAST(bucket_start_ms % 86400000 // 60000 AS INT) AS ix FROM cb),
x AS (SELECT *, lag(ix) OVER v AS b, lead(ix) OVER v AS a FROM w WINDOW v AS (PARTITION BY device_id, event_day ORDER BY ix)),
days AS (SELECT device_id, device_class, event_day, CAST(1440 AS BIGINT) AS bucket_count, count(*) AS measured_count, 1440 - count(*) AS gap_count, round(count(*) / 1440, 6) AS coverage_ratio,
CAST(sum(reading_count) AS BIGINT) AS reading_total, CAST(max(greatest(CASE WHEN b IS NULL THEN ix ELSE ix - b - 1 END, CASE WHEN a IS NULL THEN 1439 - ix ELSE 0 END)) AS BIGINT) AS longest_gap FROM x GROUP BY 1, 2, 3),
dk AS (SELECT device_id, left(event_hour, 10) AS event_day, count(*) AS dirty_hours FROM keys GROUP BY 1, 2),
n AS (SELECT device_id, left(event_hour, 10) AS event_day, count(*) AS n, count(*) FILTER (failed) AS f FROM canon GROUP BY 1, 2)
SELECT dk.device_id, dk.event_day, dirty_hours, coalesce(n, 0) AS rows_seen, coalesce(f, 0) AS rows_failed, days.device_class, bucket_count, measured_count, gap_count, coverage_ratio, reading_total, longest_gap FROM dk LEFT JOIN n USING (device_id, event_day) LEFT JOIN days USING (device_id, event_day)""")
def r4_device_day_rebuild(spark, sf_dir):
    """Every day with a dirty hour, from all its rows; a day without any keeps its key."""
    return late_data.rebuilt_days(*stage1_tables(spark, sf_dir), CATALOG, TIES, KEPT, RAW_FIELDS)


@query("""WITH h AS (SELECT o_custkey, o_orderdate, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
p AS (SELECT o.o_custkey, l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT p.o_custkey, p.l_shipdate, p.l_orderkey, p.l_linenumber, p.l_partkey, h.o_orderstatus AS status, h.o_orderkey AS as_of_key FROM p ASOF LEFT JOIN h ON p.o_custkey = h.o_custkey AND p.l_shipdate >= h.o_orderdate""", base=False)
def j1_asof(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    probes = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    history = orders.select("o_custkey", "o_orderdate", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("as_of_key"))
    return stage3.as_of(probes, history, "o_custkey", "l_shipdate", "o_orderdate", ["status", "as_of_key"], ["as_of_key"])


OUTAGE_SQL = "outages AS (SELECT 'site-' || (o_orderkey % 7) AS site_id, o_orderkey AS outage_id, epoch_ms(TIMESTAMP '2024-01-01') + (o_orderkey * 7919) % 2505600 * 1000 AS start_ts, CASE WHEN o_orderkey % 1000 = 0 THEN NULL ELSE epoch_ms(TIMESTAMP '2024-01-01') + (o_orderkey * 7919) % 2505600 * 1000 + 600000 END AS end_ts FROM orders) "


def outages(spark, sf_dir):
    """An outage of ten minutes for every order, some still open."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    start = 1_704_067_200_000 + k * 7919 % 2_505_600 * 1000
    return o.select(F.concat(F.lit("site-"), (k % 7).cast("string")).alias("site_id"), k.alias("outage_id"), start.alias("start_ts"), F.when(k % 1000 != 0, start + 600_000).alias("end_ts"))


@query(OUTAGE_SQL + "SELECT m.site_id, outage_id, count(*) AS n FROM merged m JOIN outages o ON m.site_id = o.site_id AND device_ts_ms >= start_ts AND (end_ts IS NULL OR device_ts_ms < end_ts) GROUP BY 1, 2")
def j10_interval_join(spark, sf_dir):
    return stage3.during(merged(spark, sf_dir), outages(spark, sf_dir), "site_id", "device_ts_ms", "start_ts", "end_ts").groupBy("site_id", "outage_id").agg(F.count("*").alias("n"))


# Profilers

STATS = "count(x) AS n, min(x) AS min, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90, max(x) AS max, round(avg(x), 6) AS mean"


@query("SELECT device_class, firmware_version, count(*) AS messages, CAST(sum(n_readings) AS BIGINT) AS readings, count(DISTINCT device_id) AS devices, " + STATS.replace("(x", "(n_readings").replace(" AS ", " AS batch_") + " FROM messages GROUP BY 1, 2")
def a8_arrival_shape(spark, sf_dir):
    return profile.arrival_shape(messages(readings(spark, sf_dir)))


@query(f"SELECT device_class, firmware_version, {STATS.replace('(x', '(n_readings')} FROM messages GROUP BY 1, 2")
def a3_batch_stats(spark, sf_dir):
    return profile.batch_sizes(messages(readings(spark, sf_dir)))


@query("SELECT device_class, firmware_version, protocol, count(*) AS n FROM messages GROUP BY 1, 2, 3")
def a4_protocol_counts(spark, sf_dir):
    return profile.protocol_counts(messages(readings(spark, sf_dir)))


@query("""t AS (SELECT device_class, firmware_version, max(n_readings) AS top FROM messages GROUP BY 1, 2), sp AS (SELECT device_class, firmware_version, CAST(unnest(range(1, top + 1)) AS INT) AS batch_size FROM t)
SELECT sp.device_class, sp.firmware_version, batch_size, count(m.message_id) AS n FROM sp LEFT JOIN messages m ON sp.device_class = m.device_class AND sp.firmware_version = m.firmware_version AND batch_size = n_readings GROUP BY 1, 2, 3""")
def a5_batch_histogram(spark, sf_dir):
    return profile.batch_histogram(messages(readings(spark, sf_dir)))


@query("""l AS (SELECT unnest(['0-255', '256-511', '512-1023', '1024-2047', '2048-4095', '4096-8191', '8192+']) AS label), g AS (SELECT DISTINCT device_class, firmware_version FROM messages),
c AS (SELECT device_class, firmware_version, CASE WHEN n_bytes < 256 THEN '0-255' WHEN n_bytes < 512 THEN '256-511' WHEN n_bytes < 1024 THEN '512-1023' WHEN n_bytes < 2048 THEN '1024-2047' WHEN n_bytes < 4096 THEN '2048-4095' WHEN n_bytes < 8192 THEN '4096-8191' ELSE '8192+' END AS label, count(*) AS n FROM messages GROUP BY 1, 2, 3)
SELECT g.device_class, g.firmware_version, l.label, coalesce(c.n, 0) AS n FROM g CROSS JOIN l LEFT JOIN c ON c.device_class = g.device_class AND c.firmware_version = g.firmware_version AND c.label = l.label""")
def a6_size_histogram(spark, sf_dir):
    return profile.size_histogram(messages(readings(spark, sf_dir)))


@query(f"SELECT device_class, firmware_version, {STATS.replace('(x', '(n_bytes')} FROM messages GROUP BY 1, 2")
def a7_message_size(spark, sf_dir):
    """Bytes of each message's text."""
    m = messages(readings(spark, sf_dir))
    return m.groupBy("device_class", "firmware_version").agg(*fn.stats(profile.message_size(F.col("raw"))))


@query(f"g AS (SELECT device_class, firmware_version, (arrival_ts_ms - lag(arrival_ts_ms) OVER (PARTITION BY device_class, firmware_version, device_id ORDER BY arrival_ts_ms, message_id)) / 1000.0 AS x FROM messages) SELECT device_class, firmware_version, {STATS} FROM g GROUP BY 1, 2")
def w5_interarrival(spark, sf_dir):
    return profile.interarrival(messages(readings(spark, sf_dir)))


@query("SELECT device_class, firmware_version, count(*) AS total, round(avg(CASE WHEN reason = 'missing_timestamp' THEN 1.0 ELSE 0.0 END), 6) AS missing_rate, round(avg(CASE WHEN reason = 'epoch_default_timestamp' THEN 1.0 ELSE 0.0 END), 6) AS epoch_rate, round(avg(CASE WHEN reason = 'future_timestamp' THEN 1.0 ELSE 0.0 END), 6) AS future_rate FROM judged GROUP BY 1, 2")
def a9_clock_rates(spark, sf_dir):
    return profile.clock_rates(readings(spark, sf_dir))


@query("e AS (SELECT device_class, firmware_version, device_id, quantile_cont((arrival_ts_ms - device_ts_ms) / 1000.0, 0.5) AS d FROM good GROUP BY 1, 2, 3) SELECT device_class, firmware_version, count(*) AS devices, round(min(d), 6) AS min_s, round(quantile_cont(d, 0.5), 6) AS median_s, round(quantile_cont(d, 0.9), 6) AS p90_s, round(max(d), 6) AS max_s FROM e GROUP BY 1, 2")
def a10_drift(spark, sf_dir):
    return profile.clock_drift(readings(spark, sf_dir))


@query("l AS (SELECT device_class, CASE WHEN device_ts_ms > 0 THEN (arrival_ts_ms - device_ts_ms) / 1000.0 END AS x FROM readings) SELECT device_class, count(x) AS n, count(*) - count(x) AS skipped, min(x) AS min_s, round(quantile_cont(x, 0.5), 6) AS median_s, round(quantile_cont(x, 0.9), 6) AS p90_s, round(quantile_cont(x, 0.99), 6) AS p99_s, max(x) AS max_s FROM l GROUP BY 1")
def a11_lateness(spark, sf_dir):
    return profile.lateness(readings(spark, sf_dir))


@query("k AS (SELECT device_class, count(*) AS n FROM readings GROUP BY device_class, device_id, device_ts_ms, payload_hash) SELECT device_class, CAST(sum(n) AS BIGINT) AS instances, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicated_keys, round(count(*) FILTER (n > 1) / count(*), 6) AS duplicate_key_rate, round((sum(n) - count(*)) / sum(n), 6) AS excess_rate FROM k GROUP BY 1")
def a12_duplicate_keys(spark, sf_dir):
    return profile.duplicate_keys(readings(spark, sf_dir))


@query("""k AS (SELECT DISTINCT device_class, arrival_ts_ms, message_id, device_id, device_ts_ms, payload_hash FROM readings),
f AS (SELECT *, row_number() OVER (PARTITION BY device_class, device_id, device_ts_ms, payload_hash ORDER BY arrival_ts_ms, message_id) > 1 AS seen FROM k),
m AS (SELECT device_class, arrival_ts_ms, message_id, bool_and(seen) AS e, bool_or(seen) AS s FROM f GROUP BY 1, 2, 3)
SELECT device_class, count(*) AS messages, count(*) FILTER (e) AS pure, count(*) FILTER (s AND NOT e) AS partial FROM m GROUP BY 1""")
def w6_message_duplicates(spark, sf_dir):
    return profile.message_duplicates(readings(spark, sf_dir))


@query("""l AS (SELECT device_class, CASE WHEN device_ts_ms > 0 THEN (arrival_ts_ms - device_ts_ms) / 1000.0 END AS x FROM readings), la AS (SELECT device_class, count(x) AS n, count(*) - count(x) AS skipped, min(x) AS min_s, round(quantile_cont(x, 0.5), 6) AS median_s, round(quantile_cont(x, 0.9), 6) AS p90_s, round(quantile_cont(x, 0.99), 6) AS p99_s, max(x) AS max_s FROM l GROUP BY 1),
k AS (SELECT device_class, count(*) AS n FROM readings GROUP BY device_class, device_id, device_ts_ms, payload_hash), ka AS (SELECT device_class, CAST(sum(n) AS BIGINT) AS instances, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicated_keys, round(count(*) FILTER (n > 1) / count(*), 6) AS duplicate_key_rate, round((sum(n) - count(*)) / sum(n), 6) AS excess_rate FROM k GROUP BY 1),
q AS (SELECT DISTINCT device_class, arrival_ts_ms, message_id, device_id, device_ts_ms, payload_hash FROM readings), f AS (SELECT *, row_number() OVER (PARTITION BY device_class, device_id, device_ts_ms, payload_hash ORDER BY arrival_ts_ms, message_id) > 1 AS seen FROM q),
m AS (SELECT device_class, arrival_ts_ms, message_id, bool_and(seen) AS e, bool_or(seen) AS s FROM f GROUP BY 1, 2, 3), ma AS (SELECT device_class, count(*) AS messages, count(*) FILTER (e) AS pure, count(*) FILTER (s AND NOT e) AS partial FROM m GROUP BY 1)
SELECT *, round(pure / messages, 6) AS pure_rate, round(partial / messages, 6) AS partial_rate FROM la JOIN ka USING (device_class) JOIN ma USING (device_class)""")
def a13_class_profile(spark, sf_dir):
    return profile.class_profile(materialize(readings(spark, sf_dir), "readings"))


BURST_SQL = """b AS (SELECT *, arrival_ts_ms - lag(arrival_ts_ms) OVER (PARTITION BY device_id ORDER BY arrival_ts_ms, message_id) AS gap FROM messages),
md AS (SELECT device_id, quantile_cont(gap, 0.5) AS mg, quantile_cont(n_readings, 0.5) AS mb FROM b GROUP BY 1 HAVING count(*) >= 4),
bursts AS (SELECT device_class, firmware_version, device_id, message_id, gap / 1000.0 AS gap_s, round(gap / mg, 6) AS gap_ratio, round(n_readings / mb, 6) AS batch_ratio FROM b JOIN md USING (device_id) WHERE mg > 0 AND mb > 0 AND gap / mg > 3.0 AND n_readings / mb > 0.5)
"""


@query(BURST_SQL + "SELECT * FROM bursts")
def w7_buffer_burst(spark, sf_dir):
    return profile.burst_events(messages(readings(spark, sf_dir)))


@query(BURST_SQL + "SELECT g.device_class, g.firmware_version, count(DISTINCT g.device_id) AS devices, count(DISTINCT u.device_id) AS devices_with_bursts, count(u.message_id) AS burst_events FROM messages g LEFT JOIN bursts u USING (message_id) GROUP BY 1, 2")
def a18_burst_groups(spark, sf_dir):
    m = messages(readings(spark, sf_dir))
    return profile.burst_groups(m, profile.burst_events(m))


@query(BURST_SQL + """, m AS (SELECT g.*, u.message_id IS NOT NULL AS f, ascii(right(replace(g.message_id, '-retry', ''), 1)) % 4 = 0 AS t, ends_with(g.message_id, '-retry') AS again FROM messages g LEFT JOIN bursts u USING (message_id)),
d AS (SELECT firmware_version, device_id, bool_or(t) AS dt, bool_or(t AND f) AS dh FROM m GROUP BY 1, 2),
dd AS (SELECT firmware_version, count(*) AS devices, count(*) FILTER (dt) AS devices_true, count(*) FILTER (dh) AS devices_hit FROM d GROUP BY 1),
r AS (SELECT firmware_version, count(*) AS readings, count(*) FILTER (reason = 'missing_timestamp') AS missing_timestamp_readings, count(*) FILTER (reason = 'epoch_default_timestamp') AS epoch_default_timestamp_readings, count(*) FILTER (reason = 'future_timestamp') AS future_timestamp_readings, count(reason) AS clock_issues FROM judged GROUP BY 1),
a AS (SELECT firmware_version, min(device_class) AS device_classes, count(*) AS messages, count(*) FILTER (t) AS true_bursts, count(*) FILTER (f) AS flagged, count(*) FILTER (t AND f) AS hits, count(*) FILTER (NOT t AND arrival_ts_ms % 7 = 0) AS late_messages, count(*) FILTER (again) AS duplicate_messages FROM m GROUP BY 1),
o AS (SELECT firmware_version, count(*) AS outage_events, CAST(sum(user_id % 50) AS BIGINT) AS outage_readings_buffered, CAST(sum(user_id % 7) AS BIGINT) AS outage_readings_dropped FROM (SELECT DISTINCT user_id, firmware_version FROM readings WHERE user_id % 4 = 0) GROUP BY 1),
j AS (SELECT *, CAST(CASE firmware_version WHEN '2.1.4' THEN 2.5 WHEN '2.3.0' THEN 1.3 WHEN '3.0.1' THEN 0.5 WHEN '1.8.2' THEN 2.5 WHEN '1.9.0' THEN 1.3 ELSE 1 END AS DOUBLE) AS quirk_multiplier FROM a JOIN dd USING (firmware_version) JOIN r USING (firmware_version) LEFT JOIN o USING (firmware_version)),
z AS (SELECT * REPLACE (coalesce(outage_events, 0) AS outage_events, coalesce(outage_readings_buffered, 0) AS outage_readings_buffered, coalesce(outage_readings_dropped, 0) AS outage_readings_dropped) FROM j)
SELECT *, true_bursts AS post_outage_burst_messages, round(least(0.95, 0.25 * quirk_multiplier), 6) AS expected_outage_probability, round(least(0.9, 0.1 * quirk_multiplier), 6) AS expected_drop_rate, round(hits / nullif(true_bursts, 0), 6) AS recall, round(hits / nullif(flagged, 0), 6) AS precision, round(devices_hit / nullif(devices_true, 0), 6) AS device_recall,
round(outage_readings_dropped / nullif(outage_readings_buffered + outage_readings_dropped, 0), 6) AS drop_rate, round(outage_events / nullif(devices, 0), 6) AS outage_rate, round(clock_issues / nullif(readings, 0), 6) AS clock_issue_rate FROM z""")
def a17_firmware_metrics(spark, sf_dir):
    r = materialize(readings(spark, sf_dir), "readings")
    m = messages(r)
    return profile.firmware_metrics(m, r, profile.burst_events(m), testdata.outage_counts(r))


@query("g AS (SELECT device_class, session_state, CAST(value AS DOUBLE) AS x FROM readings) SELECT device_class, session_state, count(x) AS n, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.999), 6) AS p999 FROM g GROUP BY 1, 2")
def a2_exact_percentiles(spark, sf_dir):
    """Exact percentiles by histograms that are refined."""
    p = quantiles.percentiles(readings(spark, sf_dir), ["device_class", "session_state"], F.col("value"), [0.05, 0.5, 0.999])
    return p.select("device_class", "session_state", "n", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p05", "p50", "p999"))])


# Specified in prose only


@query(f"SELECT max(device_ts_ms) AS latest_ms, count(*) AS n_rows, {NOW_MS} - max(device_ts_ms) AS age_ms FROM merged")
def x2_freshness(spark, sf_dir):
    return stage4.freshness(merged(spark, sf_dir), "device_ts_ms", NOW_MS)


SESSION_SQL = "'s' || CAST(floor(dom / 3) AS INT)"


def in_sessions(rows: DataFrame) -> DataFrame:
    """With the session that the device names; some readings have none."""
    return rows.withColumn("session_id", F.when(F.col("event_id") % 8 != 0, F.concat(F.lit("s"), F.floor(F.col("dom") / 3).cast("string"))))


def dispatch_windows(spark, sf_dir) -> DataFrame:
    """A visit of four hours to a device for every customer."""
    k = F.col("c_custkey")
    start = 1_704_067_200_000 + k * 104_729 % 2_505_600 * 1000
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("dev-"), (k % 1000).cast("string")).alias("device_id"), start.alias("window_start"), F.when(k % 50 != 0, start + 14_400_000).alias("window_end"))


@query(f"""{OUTAGE_SQL}, v AS (SELECT 'dev-' || (c_custkey % 1000) AS device_id, epoch_ms(TIMESTAMP '2024-01-01') + (c_custkey * 104729) % 2505600 * 1000 AS ws, CASE WHEN c_custkey % 50 <> 0 THEN epoch_ms(TIMESTAMP '2024-01-01') + (c_custkey * 104729) % 2505600 * 1000 + 14400000 END AS we FROM customer),
s AS (SELECT device_id, {SESSION_SQL} AS session_id, min(device_ts_ms) AS start_ms, max(device_ts_ms) AS end_ms, count(*) AS readings, min(site_id) AS site_id FROM merged WHERE event_id % 8 <> 0 GROUP BY 1, 2),
d AS (SELECT s.device_id, session_id, count(ws) AS dispatches FROM s LEFT JOIN v ON s.device_id = v.device_id AND ws <= end_ms AND (we IS NULL OR we > start_ms) GROUP BY 1, 2),
u AS (SELECT s.device_id, session_id, count(o.start_ts) AS outages FROM s LEFT JOIN outages o ON s.site_id = o.site_id AND o.start_ts <= s.end_ms AND (o.end_ts IS NULL OR o.end_ts > s.start_ms) GROUP BY 1, 2)
SELECT * FROM s JOIN d USING (device_id, session_id) JOIN u USING (device_id, session_id)""")
def x3_event_table(spark, sf_dir):
    """Sessions by the device's own name for them, with the visits and outages that they meet."""
    down = outages(spark, sf_dir).select("site_id", F.col("start_ts").alias("window_start"), F.col("end_ts").alias("window_end"))
    return stage4.event_table(in_sessions(merged(spark, sf_dir)), dispatch_windows(spark, sf_dir), down)


@query("""h AS (SELECT device_id, device_ts_ms // 3600000 AS h, count(*) FILTER (arrival_ts_ms - device_ts_ms <= 43200000) AS on_time, count(*) FILTER (arrival_ts_ms - device_ts_ms > 43200000) AS late FROM merged GROUP BY 1, 2),
sp AS (SELECT device_id, unnest(range(min(h), max(h) + 1)) AS h FROM h GROUP BY 1)
SELECT device_id, strftime(make_timestamp(h * 3600000000), '%Y-%m-%dT%H') AS event_hour, CAST(2 AS BIGINT) AS expected, coalesce(on_time, 0) AS on_time, coalesce(late, 0) AS late, greatest(2 - coalesce(on_time, 0) - coalesce(late, 0), 0) AS missing FROM sp LEFT JOIN h USING (device_id, h)""")
def x4_completeness(spark, sf_dir):
    return stage4.completeness(merged(spark, sf_dir), 2, 43_200_000)


@query(f"d AS (SELECT DISTINCT device_id, device_ts_ms FROM merged), l AS (SELECT *, lead(device_ts_ms) OVER (PARTITION BY device_id ORDER BY device_ts_ms) AS c FROM d) SELECT device_id, device_ts_ms AS opened_ms, c AS closed_ms, 'unknown' AS cause FROM l WHERE coalesce(c, {NOW_MS}) - device_ts_ms > 1800000")
def x5_silence(spark, sf_dir):
    return stage4.silence_episodes(merged(spark, sf_dir), now_ms=NOW_MS)


@query(f"l AS (SELECT site_id, device_id, max(device_ts_ms) AS t FROM merged GROUP BY 1, 2), g AS (SELECT site_id, count(*) AS devices, count(*) FILTER ({NOW_MS} - t > 259200000) AS silent FROM l GROUP BY 1) SELECT site_id, devices, silent, round(silent / devices, 6) AS silent_share, CASE WHEN silent = 0 THEN 'none' WHEN silent / devices >= 0.5 THEN 'correlated' ELSE 'isolated' END AS kind FROM g")
def x6_dropout(spark, sf_dir):
    return stage4.dropout(stage4.last_seen(merged(spark, sf_dir), ("site_id", "device_id")), "site_id", NOW_MS, 3 * 86_400_000)


@query("c AS (SELECT DISTINCT device_id, event_hour FROM hours WHERE session_state = 'fault') SELECT device_id, event_hour, sha256(device_id || '|' || event_hour) AS finding_id FROM c WHERE event_hour >= '2024-01-15T00'")
def x7_findings(spark, sf_dir):
    """Faults by hour; those of the first two weeks are stored already."""
    rows = merged(spark, sf_dir).where("session_state = 'fault'").select("device_id", fn.event_hour(F.col("device_ts_ms")).alias("event_hour"))
    content = ["device_id", "event_hour"]
    stored = stage4.new_findings(rows.where("event_hour < '2024-01-15T00'"), None, content)
    return stage4.new_findings(rows, stored, content)


@query(f"f AS (SELECT *, {SESSION_SQL} AS session_id FROM merged WHERE event_id % 8 <> 0) SELECT device_id, session_id, max_by(session_state, (device_ts_ms, event_id)) AS last_state, count(*) FILTER (session_state = 'fault') AS faults FROM (SELECT DISTINCT device_id, session_id, device_ts_ms, event_id, session_state FROM f) GROUP BY 1, 2 HAVING max_by(session_state, (device_ts_ms, event_id)) = 'fault'")
def x8_session_failures(spark, sf_dir):
    return stage4.session_failures(in_sessions(merged(spark, sf_dir)).select("device_id", "session_id", "device_ts_ms", "event_id", "session_state").distinct())


@query("""h AS (SELECT DISTINCT device_id, event_hour, epoch_ms(strptime(event_hour, '%Y-%m-%dT%H')) + 3600000 AS e FROM hours),
a AS (SELECT *, CASE WHEN e + 86400000 <= 1705708800000 THEN 'final' ELSE 'provisional' END AS s1, CASE WHEN e + 86400000 <= 1706140800000 THEN 'final' ELSE 'provisional' END AS s2 FROM h)
SELECT device_id, event_hour, s1 AS status, CAST(1 AS BIGINT) AS version FROM a UNION ALL SELECT device_id, event_hour, s2, 2 FROM a WHERE s1 = 'provisional' AND s2 = 'final'""")
def x9_finalise(spark, sf_dir):
    """All versions after three runs, of which the last finds nothing new."""
    hours = stage1.device_hours(merged(spark, sf_dir))
    hours = materialize(hours.withColumn("hour_end_ms", fn.hour_range_start(F.col("event_hour")) + fn.HOUR_MS), "hours")
    stored = None
    for now in (1_705_708_800_000, 1_706_140_800_000, 1_706_140_800_000):
        new = materialize(stage4.new_versions(stage4.hour_status(hours, now), stored), "versions")
        stored = new if stored is None else stored.unionByName(new)
    return stored


COHORT_SQL = """WITH m AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.5) AS median, count(*) AS n FROM lineitem GROUP BY 1, 2),
a AS (SELECT l_returnflag, l_linestatus, quantile_cont(abs(l_extendedprice - median), 0.5) AS mad FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY 1, 2) """


@query(COHORT_SQL + "SELECT l_returnflag, l_linestatus, n, round(median, 4) AS median, round(mad, 4) AS mad FROM m JOIN a USING (l_returnflag, l_linestatus)", base=False)
def x10_cohort_mad(spark, sf_dir):
    s = stage4.cohort_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return s.select("l_returnflag", "l_linestatus", "n", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


@query(COHORT_SQL + "SELECT l_returnflag, l_linestatus, count(*) AS outliers FROM lineitem JOIN m USING (l_returnflag, l_linestatus) JOIN a USING (l_returnflag, l_linestatus) WHERE abs(0.6745 * (l_extendedprice - median) / nullif(mad, 0)) > 1.2 GROUP BY 1, 2", base=False)
def x11_robust_z(spark, sf_dir):
    out = stage4.robust_outliers(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 1.2)
    return out.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("outliers"))


@query("f AS (SELECT device_id, min(device_ts_ms) AS t FROM merged WHERE session_state = 'fault' GROUP BY 1), c AS (SELECT device_id, device_ts_ms AS o FROM merged WHERE session_state = 'session_complete'), g AS (SELECT f.device_id, t, min(o) AS o FROM f LEFT JOIN c ON f.device_id = c.device_id AND o >= t AND o <= t + 172800000 GROUP BY 1, 2) SELECT count(*) AS findings, count(o) AS hits, round(count(o) / count(*), 6) AS precision, quantile_cont((o - t) / 3600000, 0.5) AS median_lead_h FROM g")
def x12_backtest(spark, sf_dir):
    rows = merged(spark, sf_dir)
    findings = rows.where("session_state = 'fault'").groupBy("device_id").agg(F.min("device_ts_ms").alias("found_ms"))
    cases = rows.where("session_state = 'session_complete'").select("device_id", F.col("device_ts_ms").alias("opened_ms"))
    return stage4.backtest(findings, cases, 172_800_000)


@query("""WITH f AS (SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey) AS entities, round(avg(c_acctbal), 6) AS mean_value FROM customer GROUP BY 1, 2),
s AS (SELECT c_nationkey, count(DISTINCT c_custkey) AS entities, round(avg(c_acctbal), 6) AS mean_value FROM customer JOIN (SELECT c_nationkey, c_mktsegment FROM f WHERE entities < 20) USING (c_nationkey, c_mktsegment) GROUP BY 1 HAVING count(DISTINCT c_custkey) >= 20)
SELECT c_nationkey, c_mktsegment, entities, mean_value FROM f WHERE entities >= 20 UNION ALL SELECT c_nationkey, NULL, entities, mean_value FROM s""", base=False)
def x13_suppression(spark, sf_dir):
    return stage4.suppressed(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], ["c_nationkey"], "c_custkey", "c_acctbal", 20)


@query("""WITH k AS (SELECT kind, cutoff FROM (VALUES ('rows', TIMESTAMP '1997-01-15'), ('features', TIMESTAMP '1996-02-15'), ('linkage', TIMESTAMP '1997-11-17')) t(kind, cutoff))
SELECT kind, count(o_orderkey) AS kept FROM k LEFT JOIN orders ON CAST(o_orderdate AS TIMESTAMP) >= cutoff GROUP BY 1""", base=False)
def x14_retention(spark, sf_dir):
    """What each class of retention keeps on 1998-02-15."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t"))
    kept = [stage4.retained(orders, "t", 887_500_800_000, k).agg(F.count("*").alias("kept")).select(F.lit(k).alias("kind"), "kept") for k in ("rows", "features", "linkage")]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query("SELECT device_id, device_ts_ms, event_id, payload_hash, session_state FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY device_ts_ms DESC, event_id DESC, payload_hash DESC) AS newest FROM merged) WHERE newest = 1")
def x15_device_snapshot(spark, sf_dir):
    return stage4.device_snapshot(merged(spark, sf_dir), ("device_ts_ms", "event_id", "payload_hash")).select("device_id", "device_ts_ms", "event_id", "payload_hash", "session_state")


@query("SELECT CASE WHEN arrival_ts_ms >= 1706745600000 - 10 * 86400000 THEN 'hot' ELSE 'cold' END AS tier, count(*) AS messages, CAST(sum(n_readings) AS BIGINT) AS readings FROM messages GROUP BY 1")
def x18_tiers(spark, sf_dir):
    """Landed messages after the cold ones were rewritten to another prefix."""
    m = landing.arrival_partitions(messages(readings(spark, sf_dir)).select("message_id", "arrival_ts_ms", "n_readings"))
    landed = materialize(m, "landed")
    both = stage4.compact_cold(landed, f"{shared_dir(spark)}/cold-{uuid.uuid4().hex}", NOW_MS, 10, ("arrival_date",))
    return both.groupBy(stage4.tier(F.col("arrival_ts_ms"), NOW_MS, 10).alias("tier")).agg(F.count("*").alias("messages"), F.sum("n_readings").alias("readings"))


@query(DAY_SQL + "SELECT device_class, day_start_ms, CAST(grouping_id(device_class, day_start_ms) AS BIGINT) AS level, count(*) AS device_days, CAST(sum(reading_total) AS BIGINT) AS readings, round(avg(coverage_ratio), 6) AS mean_coverage FROM days GROUP BY ROLLUP (device_class, day_start_ms)")
def x15_marts(spark, sf_dir):
    return stage4.mart(stage3.device_days(stage3.day_buckets(with_mode(merged(spark, sf_dir)), TIES)), ["device_class", "day_start_ms"])


@query("""l AS (SELECT firmware_version, device_id, CAST((max(device_ts_ms) - min(device_ts_ms)) // 86400000 AS BIGINT) AS duration, max(device_ts_ms) < 1706486400000 AS failed FROM merged GROUP BY 1, 2),
t AS (SELECT firmware_version, duration, count(*) AS n, CAST(count(*) FILTER (failed) AS BIGINT) AS failures FROM l GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY firmware_version ORDER BY duration DESC) AS BIGINT) AS at_risk FROM t)
SELECT firmware_version, duration, at_risk, failures, round(product(1 - failures / at_risk) OVER (PARTITION BY firmware_version ORDER BY duration), 6) AS survival FROM r QUALIFY failures > 0""")
def x16_survival(spark, sf_dir):
    lives = merged(spark, sf_dir).groupBy("firmware_version", "device_id").agg(F.floor((F.max("device_ts_ms") - F.min("device_ts_ms")) / 86_400_000).alias("duration"), (F.max("device_ts_ms") < 1_706_486_400_000).alias("failed"))
    return stage4.survival(lives, "firmware_version")


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS differing FROM merged")
def x17_replay(spark, sf_dir):
    """The same readings in two batches of another split merge to the same rows, in every column."""
    g = good(spark, sf_dir)
    a = materialize(merged(spark, sf_dir), "replay")
    other = late_data.merged_rows(g.where("event_id % 4 = 1"), g.where("event_id % 4 <> 1"))
    both = a.select(F.lit(1).alias("n"), F.lit(0).alias("d")).unionByName(stage4.replay_difference(a, other).select(F.lit(0).alias("n"), F.lit(1).alias("d")))
    return both.agg(F.sum("n").alias("n_rows"), F.sum("d").alias("differing"))


@query(OUTAGE_SQL + ", h AS (SELECT DISTINCT device_id, site_id, event_hour, epoch_ms(strptime(event_hour, '%Y-%m-%dT%H')) AS t FROM hours) SELECT device_id, event_hour, CASE WHEN EXISTS (SELECT 1 FROM outages o WHERE o.site_id = h.site_id AND t >= start_ts AND (end_ts IS NULL OR t < end_ts)) THEN 0 ELSE 2 END AS expected FROM h")
def x20_expected_by_mode(spark, sf_dir):
    """No readings are expected of a device-hour that begins within an outage of its site."""
    rows = merged(spark, sf_dir)
    hours = rows.select("device_id", "site_id", fn.event_hour(F.col("device_ts_ms")).alias("event_hour")).distinct().withColumn("t", fn.hour_range_start(F.col("event_hour")))
    out = stage3.during(hours, outages(spark, sf_dir), "site_id", "t", "start_ts", "end_ts").select("device_id", "event_hour").distinct().withColumn("o", F.lit(True))
    return hours.join(out, ["device_id", "event_hour"], "left").select("device_id", "event_hour", F.when(F.col("o"), 0).otherwise(2).alias("expected"))


FAULT_SQL = "f AS (SELECT *, CASE WHEN session_state = 'fault' THEN CASE event_id % 3 WHEN 0 THEN 1001 WHEN 1 THEN 1042 ELSE 2010 END ELSE 0 END AS code FROM merged WHERE device_class = 'stall')"


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stalls' readings with a fault code made up from the event's id."""
    code = F.when(F.col("session_state") == "fault", F.when(F.col("event_id") % 3 == 0, 1001).when(F.col("event_id") % 3 == 1, 1042).otherwise(2010)).otherwise(0)
    return merged(spark, sf_dir).where("device_class = 'stall'").withColumn("stall_fault_code", code)


def episodes_sql(rule: str, code: int) -> str:
    return FAULT_SQL + f""", g AS (SELECT *, row_number() OVER o - row_number() OVER (PARTITION BY device_id, code = {code} ORDER BY device_ts_ms, event_id) AS run FROM f WINDOW o AS (PARTITION BY device_id ORDER BY device_ts_ms, event_id))
SELECT '{rule}' AS rule, device_id, min(device_ts_ms) AS start_ms, max(device_ts_ms) AS end_ms, count(*) AS readings FROM g WHERE code = {code} GROUP BY device_id, run"""


@query(episodes_sql("module_fault_v1", 1001))
def x8_module_faults(spark, sf_dir):
    return detectors.module_faults(faulty(spark, sf_dir))


@query(FAULT_SQL + """, g AS (SELECT *, row_number() OVER o - row_number() OVER (PARTITION BY device_id, code ORDER BY device_ts_ms, event_id) AS run FROM f WINDOW o AS (PARTITION BY device_id ORDER BY device_ts_ms, event_id)),
e AS (SELECT CASE code WHEN 1001 THEN 'module_fault' ELSE 'thermal_event' END AS detector, CAST(1 AS INT) AS detector_version, device_id, min(device_ts_ms) AS start_ms, max(device_ts_ms) AS end_ms FROM g WHERE code IN (1001, 1042) GROUP BY device_id, code, run)
SELECT DISTINCT *, sha256(detector || '|1|' || device_id || '|' || start_ms || '|' || end_ms) AS finding_id FROM e WHERE start_ms >= 1705276800000 OR detector <> 'module_fault'""")
def x7_declared_detectors(spark, sf_dir):
    """Findings of all declared rules; those of one rule before the middle of the month are stored already."""
    rows = materialize(faulty(spark, sf_dir).select("device_id", "device_ts_ms", "event_id", "stall_fault_code"), "faulty")
    old = detectors.findings(rows, detectors.DECLARED[:1]).where("start_ms < 1705276800000")
    return detectors.findings(rows, detectors.DECLARED, old)


@query(episodes_sql("thermal_event_v1", 1042))
def x8_thermal_events(spark, sf_dir):
    return detectors.thermal_events(faulty(spark, sf_dir))


@query("""w AS (SELECT device_id, device_ts_ms, value, lag(value) OVER o AS b, max(value) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak,
max(value) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) - min(value) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS spread, count(*) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n
FROM merged WHERE device_class = 'stall' WINDOW o AS (PARTITION BY device_id ORDER BY device_ts_ms, event_id))
SELECT 'derate_v1' AS rule, device_id, device_ts_ms AS found_ms, b AS power_before, value AS power_after FROM w WHERE b - value >= CAST(0.2 AS DOUBLE) * peak AND spread <= CAST(0.1 AS DOUBLE) * peak AND n = 3 AND peak > 0""")
def x8_derates(spark, sf_dir):
    rows = merged(spark, sf_dir).where("device_class = 'stall'")
    return detectors.derates(rows, ["device_id"], "value", drop=0.2, band=0.1, plateau=3)


@query(f"""h AS (SELECT DISTINCT device_id, CAST(floor(device_ts_ms / 3600000) AS BIGINT) AS h, count(*) OVER (PARTITION BY device_id, CAST(floor(device_ts_ms / 3600000) AS BIGINT)) AS n FROM merged),
s AS (SELECT device_id, max(h) - min(h) + 1 AS hours FROM h GROUP BY 1)
SELECT 'freshness_ms' AS metric, 'readings' AS feed, CAST({NOW_MS} - max(device_ts_ms) AS DOUBLE) AS value, 'ok' AS status FROM merged UNION ALL SELECT 'freshness_ms', 'orders', CAST({NOW_MS} - max(epoch_ms(o_orderdate)) AS DOUBLE), 'breached' FROM orders
UNION ALL SELECT 'completeness', 'readings', CAST((SELECT sum(least(n, 2)) FROM h) / (SELECT 2 * sum(hours) FROM s) AS DOUBLE), 'breached' UNION ALL SELECT 'cost_bytes', 'readings', NULL, 'missing'""")
def x19_watchdog(spark, sf_dir):
    rows = materialize(merged(spark, sf_dir).select("device_id", "device_ts_ms", "arrival_ts_ms"), "rows")
    orders = table(spark, sf_dir, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t"))
    metrics = observability.freshness_metrics({"readings": (rows, "device_ts_ms"), "orders": (orders, "t")}, NOW_MS)
    metrics = metrics.unionByName(observability.completeness_metric(stage4.completeness(rows, 2, 3_600_000), "readings"))
    week = 7.0 * 86_400_000
    limits = [("freshness_ms", "readings", None, week), ("freshness_ms", "orders", 0.0, week), ("completeness", "readings", 0.99, None), ("cost_bytes", "readings", None, 1e12)]
    return observability.watchdog(metrics, spark.createDataFrame(limits, "metric string, feed string, least double, most double"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device-day features of the merged readings."""
    return a15_device_day(spark, sf_dir)
