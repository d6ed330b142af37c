"""Made-up telemetry and external feeds, deterministic for a seed: every value is a hash of the seed and the row's key,
so any partitioning gives the same rows and nothing passes through the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, HOUR_MS, payload_hash
from ..model import CABINET, CATALOG, QUIRKS, STALL

#: Firmware of each class, and how much more (or less) than usual it loses touch.
FIRMWARE = {c: {v: QUIRKS[v] for k, v in CATALOG if k == c} for c in (STALL, CABINET)}
#: Time between readings, and rows of the feeds.
CADENCE_MS = {STALL: 15_000, CABINET: 60_000}
FEEDS = {"rma": 150, "tickets": 200, "dispatch": 120, "outage": 80}


@dataclass(frozen=True)
class Config:
    """Counts, rates and times of the default corpus."""

    seed: int = 1337
    devices_per_firmware: int = 4
    sessions: int = 3
    session_readings: int = 120
    cabinet_hours: int = 24
    sites: int = 6
    now_ms: int = 1_780_358_400_000
    late: float = 0.06
    duplicate: float = 0.03
    missing_ts: float = 0.01
    epoch_ts: float = 0.015
    future_ts: float = 0.01
    drift_s: int = 600
    outage: float = 0.25
    outage_drop: float = 0.1


def uniform(c: Config, name: str, *key: Column) -> Column:
    """In [0, 1), by the seed, the name and the key."""
    return F.pmod(F.xxhash64(F.lit(c.seed), F.lit(name), *key), F.lit(1 << 30)) / float(1 << 30)


def between(u: Column, low: int, high: int) -> Column:
    return (F.lit(low) + F.floor(u * (high - low + 1))).cast("long")


def devices(spark: SparkSession, c: Config) -> DataFrame:
    """device_id, device_class, firmware_version, site_id, factor, number (from 0)."""
    pairs = [(k, v, x) for k, of in FIRMWARE.items() for v, x in of.items()]
    kinds = F.array(*[F.struct(F.lit(k).alias("device_class"), F.lit(v).alias("firmware_version"), F.lit(x).alias("factor")) for k, v, x in pairs])
    d = spark.range(len(pairs) * c.devices_per_firmware).select(F.inline(F.array(F.element_at(kinds, (F.col("id") % len(pairs) + 1).cast("int")))), F.floor(F.col("id") / len(pairs)).alias("n"), F.col("id").alias("number"))
    short = F.when(F.col("device_class") == STALL, "stall").otherwise("cab")
    name = F.concat(short, F.lit("-"), F.replace("firmware_version", F.lit("."), F.lit("")), F.lit("-"), F.lpad(F.col("n").cast("string"), 4, "0"))
    return d.withColumn("device_id", name).withColumn("site_id", F.format_string("site-%03d", between(uniform(c, "site", F.col("device_id")), 0, c.sites - 1))).drop("n")


def telemetry(spark: SparkSession, c: Config = Config()) -> DataFrame:  # noqa: B008
    """raw: envelopes as JSON lines, late, repeated, dropped and with bad clocks as often as ``c`` says."""
    d, key = devices(spark, c), F.col("device_id")
    start = c.now_ms - 2 * DAY_MS
    n = F.when(F.col("device_class") == STALL, c.session_readings).otherwise(c.cabinet_hours * 60)
    d = d.withColumn("session", F.explode(F.sequence(F.lit(0), F.when(F.col("device_class") == STALL, c.sessions - 1).otherwise(0))))
    begin = F.lit(start) + F.when(F.col("device_class") == STALL, F.col("session").cast("long") * 8 * HOUR_MS + between(uniform(c, "begin", key, F.col("session")), 0, 4 * HOUR_MS)).otherwise(0)
    d = d.withColumns({"begin": begin, "n": n, "batch": between(uniform(c, "batch", key, F.col("session")), 1, 12), "fault_at": F.when(uniform(c, "fault", key, F.col("session")) < 0.1, between(uniform(c, "fault_at", key, F.col("session")), 1, c.session_readings - 1))})
    r = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = (key, F.col("session"), F.col("i"))
    u = lambda name: uniform(c, name, *at)
    true = F.col("begin") + F.col("i").cast("long") * F.when(F.col("device_class") == STALL, CADENCE_MS[STALL]).otherwise(CADENCE_MS[CABINET])
    drift = between(uniform(c, "drift", key), -c.drift_s * 1000, c.drift_s * 1000)
    r = r.withColumn("true_ms", true).withColumn("clock", u("clock"))
    a, b = c.missing_ts, c.missing_ts + c.epoch_ts
    ts = F.when(F.col("clock") < a, None).when(F.col("clock") < b, 0).when(F.col("clock") < b + c.future_ts, F.col("true_ms") + between(u("ahead"), HOUR_MS, 14 * DAY_MS)).otherwise(F.col("true_ms") + drift).cast("long")
    faulty = F.coalesce(F.col("i") >= F.col("fault_at"), F.lit(False))
    state = F.when(faulty, "fault").when(F.col("i") == 0, "plugged_in").when(F.col("i") == F.col("n") - 1, "session_complete").otherwise("charging")
    # power is full for most of a session and tapers linearly at its end
    share = F.when(state != "charging", 0.0).otherwise(F.least(F.lit(1.0), (F.col("n") - F.col("i")) / (F.col("n") * 0.3)))
    volts, amps = F.round(395 + 10 * u("volts"), 2), F.round(250 * share, 2)
    stall_code = F.when(faulty, F.element_at(F.array(*[F.lit(x) for x in (1001, 1042, 2010)]), between(uniform(c, "code", key, F.col("session")), 1, 3).cast("int"))).otherwise(0)
    bad = u("contact") < 0.01
    cabinet_code = F.when(bad, F.element_at(F.array(F.lit(3001), F.lit(3002)), between(u("code"), 1, 2).cast("int"))).otherwise(0)
    mark = payload_hash(F.concat_ws("|", key, "session", "i"))
    stall = F.struct(
        F.concat_ws("-", key, F.lit("s"), F.col("session").cast("string")).alias("session_id"), state.alias("state"), volts.alias("output_voltage_v"), amps.alias("output_current_a"), F.round(volts * amps / 1000, 3).alias("output_power_kw"),
        F.round(30 + 12 * share, 2).alias("connector_temp_c"), F.round(F.col("i") * 100 * 15 / 3600.0, 3).alias("energy_delivered_kwh"), stall_code.alias("fault_code"), ts.alias("device_ts_ms"), mark.alias("payload_hash"),
    )
    cabinet = F.struct(
        F.round(477 + 6 * u("grid"), 2).alias("grid_voltage_v"), F.round(59.95 + 0.1 * u("hertz"), 3).alias("grid_frequency_hz"), F.round(40 + 10 * u("heat"), 2).alias("transformer_temp_c"), (~bad).alias("contactor_closed"),
        between(u("stalls"), 0, 8).alias("active_stall_count"), F.round(480 * u("power"), 2).alias("aggregate_power_kw"), cabinet_code.alias("fault_code"), ts.alias("device_ts_ms"), mark.alias("payload_hash"),
    )
    keep = {"ignoreNullFields": "false"}
    reading = F.when(F.col("device_class") == STALL, F.to_json(stall, keep)).otherwise(F.to_json(cabinet, keep))
    m = r.withColumns({"reading": reading, "part": F.floor(F.col("i") / F.col("batch"))})
    m = m.groupBy("device_id", "device_class", "firmware_version", "site_id", "factor", "session", "part").agg(F.max("true_ms").alias("sent"), F.sort_array(F.collect_list(F.struct("i", "reading"))).alias("x"))
    v = lambda name: uniform(c, name, key, F.col("session"), F.col("part"))
    sent = F.col("sent") + between(v("jitter"), 0, 5000)
    m = m.withColumns({"sent": sent, "out_from": F.lit(start) + between(uniform(c, "out_from", key), 0, 20 * HOUR_MS), "out_for": between(uniform(c, "out_for", key), HOUR_MS, 4 * HOUR_MS)})
    out = (uniform(c, "out", key) < c.outage * F.col("factor")) & F.col("sent").between(F.col("out_from"), F.col("out_from") + F.col("out_for"))
    m = m.withColumn("out", out).where(~F.col("out") | (v("drop") >= c.outage_drop * F.col("factor")))
    late = F.when(F.col("out"), F.col("out_from") + F.col("out_for") - F.col("sent") + between(uniform(c, "burst", key), 900_000, 3 * HOUR_MS)).when(v("late") < c.late, between(v("late_by"), 300_000, 4 * HOUR_MS)).otherwise(0)
    name = F.concat_ws("-", F.lit("msg"), key, F.col("session").cast("string"), F.col("part").cast("string"))
    m = m.withColumns({"message_id": name, "arrival": F.col("sent") + between(v("net"), 100, 2000) + late, "copies": F.when(v("again") < c.duplicate, 2).otherwise(1)})
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    again = F.col("copy") == 2
    issues = F.array_compact(F.array(F.when(F.col("out"), "post_outage_burst").when(late > 0, "late_arrival"), F.when(again, F.concat(F.lit("duplicate_of:"), "message_id"))))
    head = F.struct(
        F.concat("message_id", F.when(again, "-retry").otherwise("")).alias("message_id"), "device_id", "device_class", "firmware_version", "site_id", F.when(F.col("device_class") == STALL, "mqtt_batch").otherwise("https_poll").alias("protocol"),
        F.col("sent").alias("sent_ts_ms"), (F.col("arrival") + F.when(again, 5000).otherwise(0)).alias("arrival_ts_ms"), issues.alias("_debug_injected_issues"),
    )
    body = F.array_join(F.transform("x", lambda e: e["reading"]), ",")
    text = F.to_json(head)
    return m.select(F.concat(F.left(text, F.length(text) - 1), F.lit(',"readings":['), body, F.lit("]}")).alias("raw"))


def feed(spark: SparkSession, name: str, c: Config = Config(), rows: int | None = None) -> DataFrame:  # noqa: B008
    """rma, tickets, dispatch or outage. An end is null for what is open; what describes the end is null with it."""
    d = sum(map(len, FIRMWARE.values())) * c.devices_per_firmware
    i, u = F.col("id"), lambda k: uniform(c, f"{name} {k}", F.col("id"))
    pick = lambda k, *of: F.element_at(F.array(*[F.lit(x) for x in of]), between(u(k), 1, len(of)).cast("int"))
    who = devices(spark, c).select("device_id", "site_id", F.col("number").alias("k"))
    base = spark.range(FEEDS[name] if rows is None else rows).withColumn("k", between(u("device"), 0, d - 1)).join(who, "k")
    opened = F.lit(c.now_ms) - between(u("opened"), 1, 90 * DAY_MS)
    closed = F.when(u("open") >= 0.2, F.least(opened + between(u("took"), HOUR_MS, 10 * DAY_MS), F.lit(c.now_ms)))
    code = F.format_string(f"{name}-%05d", i)
    if name == "rma":
        cols = [code.alias("rma_id"), "device_id", "site_id", opened.alias("opened_ts"), closed.alias("closed_ts"), pick("reason", "module", "connector", "display", "thermal").alias("reason_code"), F.when(closed.isNotNull(), pick("end", "replaced", "repaired", "no_fault_found")).alias("resolution")]
    elif name == "tickets":
        cols = [code.alias("ticket_id"), F.when(u("known") >= 0.1, F.col("device_id")).alias("device_id"), opened.alias("opened_ts"), closed.alias("closed_ts"), pick("kind", "charging", "payment", "app", "hardware").alias("category"), pick("grade", "low", "medium", "high").alias("severity"), F.when(closed.isNull(), "open").otherwise("closed").alias("status")]
    elif name == "dispatch":
        cols = [code.alias("dispatch_id"), "device_id", "site_id", opened.alias("scheduled_ts"), closed.alias("completed_ts"), F.when(closed.isNotNull(), pick("end", "fixed", "parts_needed", "no_access")).alias("technician_outcome"), F.when(u("linked") >= 0.4, F.format_string("tickets-%05d", between(u("ticket"), 0, 2 * FEEDS["tickets"]))).alias("ticket_id")]
    else:
        cols = [code.alias("outage_id"), "site_id", opened.alias("start_ts"), closed.alias("end_ts"), pick("cause", "grid", "network", "maintenance").alias("cause_code"), between(u("many"), 1, 12).alias("affected_device_count")]
    return base.select(*cols)


def provisioning(spark: SparkSession, c: Config = Config()) -> DataFrame:  # noqa: B008
    """One to four full snapshots a device, at strictly rising times."""
    d = devices(spark, c).withColumn("k", F.explode(F.sequence(F.lit(0), between(uniform(c, "changes", F.col("device_id")), 0, 3).cast("int"))))
    at = (F.col("device_id"), F.col("k"))
    when = F.lit(c.now_ms - 400 * DAY_MS) + F.col("k").cast("long") * 90 * DAY_MS + between(uniform(c, "when", *at), 0, 80 * DAY_MS)
    return d.select("device_id", when.alias("effective_ts"), "firmware_version", F.format_string("rev-%d", F.col("k") + 1).alias("hardware_rev"), F.format_string("lot-%02d", between(uniform(c, "lot", *at), 0, 19)).alias("cell_lot"), "site_id")


def write_feed(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
