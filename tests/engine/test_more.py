"""Rules, metrics, mediated reads, Python parsers, compaction and the generators."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import scalars as fn
from tidegrid.functions.plugins import python_parser
from tidegrid.model import CABINET, STALL
from tidegrid.operators import profile, reports, stage1, stage3
from tidegrid.plans import detectors, observability, stage4
from tidegrid.sources import generator, landing

H = 3_600_000


def test_fault_episodes(spark):
    codes = [1001, 1001, 0, 1001, None, 1042, 1001]
    rows = spark.createDataFrame([("d", i, i, c) for i, c in enumerate(codes)] + [("e", 0, 0, 0)], "device_id string, device_ts_ms long, event_id long, stall_fault_code int")
    got = sorted((r.start_ms, r.end_ms, r.readings) for r in detectors.module_faults(rows).collect())
    assert got == [(0, 1, 2), (3, 3, 1), (6, 6, 1)]
    assert [(r.rule, r.start_ms) for r in detectors.thermal_events(rows).collect()] == [("thermal_event_v1", 5)]
    assert detectors.module_faults(rows.limit(0)).count() == 0


def test_fault_episodes_of_tied_readings(spark):
    """Readings of one time and event with unlike codes give the same episodes however the rows lie."""
    rows = [("d", 0, 0, 1001), ("d", 1, 1, 1001), ("d", 1, 1, 0), ("d", 1, 1, 1042), ("d", 2, 2, 1042), ("d", 2, 2, 1042)]
    for given in (rows, rows[::-1], rows[3:] + rows[:3], rows[2:] + rows[:2]):
        df = spark.createDataFrame(given, "device_id string, device_ts_ms long, event_id long, stall_fault_code int").coalesce(1)
        assert [(r.start_ms, r.end_ms, r.readings) for r in detectors.module_faults(df).collect()] == [(0, 1, 2)]
        assert sorted((r.start_ms, r.end_ms, r.readings) for r in detectors.thermal_events(df).collect()) == [(1, 1, 1), (2, 2, 2)]


def test_derates(spark):
    series = {
        "derate": [100, 100, 60, 60, 61, 60, 60],  # a step, then level
        "taper": [100, 90, 80, 70, 60, 50, 40, 30, 20, 10],
        "dip": [100, 100, 60, 100, 100, 100],
        "end": [100, 100, 0, 0],  # too short to be a plateau
        "null": [None, 100, None, 60, 60, None, 60, 60],
    }
    rows = [(k, i, i, None if p is None else float(p)) for k, v in series.items() for i, p in enumerate(v)]
    df = spark.createDataFrame(rows, "session_id string, device_ts_ms long, event_id long, output_power_kw double")
    got = sorted((r.session_id, r.found_ms, r.power_before, r.power_after) for r in detectors.derates(df, ["session_id"]).collect())
    assert got == [("derate", 2, 100.0, 60.0), ("null", 3, 100.0, 60.0)]


def test_metrics_and_watchdog(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).coalesce(1).write.parquet(path)
    cost = {(r.metric, r.feed): r.value for r in observability.cost_metrics(spark, {"t": path, "none": f"{path}-none"}).collect()}
    assert cost["cost_bytes", "t"] > 0 and cost["cost_files", "none"] == 0
    feeds = {"a": (spark.createDataFrame([(5,), (None,)], "t long"), "t"), "empty": (spark.createDataFrame([], "t long"), "t")}
    m = observability.freshness_metrics(feeds, 10)
    limits = spark.createDataFrame([("freshness_ms", "a", None, 5.0), ("freshness_ms", "a", 6.0, None), ("freshness_ms", "empty", None, 5.0), ("x", "y", 0.0, None)], "metric string, feed string, least double, most double")
    assert sorted(r.status for r in observability.watchdog(m, limits).collect()) == ["breached", "missing", "missing", "ok"]


def test_mediated_history(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i}", "s1" if i < 25 else "s2", "r", 1.0) for i in range(30)] + [("d0", "s3", "r", 5.0)], "device_id string, site_id string, region string, value double")
    log = f"file://{tmp_path}/log"
    door = observability.MediatedHistory(rows, log)
    got = [(r.site_id, r.entities) for r in door.read("ann", "review 7", ["region", "site_id"], ["region"], "value").collect()]
    assert got == [("s1", 25)]  # five others and one are too few at either level
    assert [(r.who, r.justification) for r in spark.read.parquet(log).collect()] == [("ann", "review 7")]
    for who, why, keys in (("", "x", ["site_id"]), ("ann", " ", ["site_id"]), ("ann", "x", ["device_id"])):
        with pytest.raises(PermissionError):
            door.read(who, why, keys, [], "value")
    assert spark.read.parquet(log).count() == 1


def test_python_parser(spark):
    def parse(m):
        return [{"device_ts_ms": r["t"], "payload_hash": m["message_id"], "other": 1} for r in m["readings"]]

    head = {"device_id": "d", "device_class": STALL, "firmware_version": "9", "site_id": "x", "protocol": "p", "sent_ts_ms": 1, "arrival_ts_ms": 2}
    texts = [json.dumps(head | {"message_id": i, "readings": r}) for i, r in (("good", [{"t": 1}, {"t": None}]), ("bad", [{"t": 1}, {}]), ("none", []))]
    registry = {}
    stage1.register(registry, STALL, "9", python_parser(parse, "device_ts_ms bigint, payload_hash string, extra string"))
    rows, bad = stage1.parse_messages(landing.parse_raw(spark.createDataFrame([(t,) for t in texts], "raw string")), registry)
    assert sorted((r.message_id, r["at"], r.device_ts_ms, r.payload_hash, r.extra) for r in rows.collect()) == [("good", 0, 1, "good", None), ("good", 1, None, "good", None)]
    assert [(r.message_id, r.reason) for r in bad.collect()] == [("bad", "parser_error: KeyError('t')")]


def test_compact(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 2).alias("hour"))
    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    rows.repartition(10).write.partitionBy("hour").parquet(old)
    stage4.compact(spark.read.parquet(old), new, ["hour"])
    assert stage4.replay_difference(spark.read.parquet(old), spark.read.parquet(new)).count() == 0
    files = lambda p: spark.read.parquet(p).select(F.input_file_name()).distinct().count()
    assert files(old) == 20 and files(new) == 2


def test_generated_telemetry(spark):
    c = generator.Config(devices_per_firmware=20)
    raw = generator.telemetry(spark, c).persist()
    again = generator.telemetry(spark, c).repartition(3)
    assert stage4.replay_difference(raw, again).count() == 0
    m = landing.parse_raw(raw)
    assert m.where(landing.reject_reason(m).isNotNull()).count() == 0
    rows, bad = stage1.parse_messages(m, stage1.default_registry())
    assert bad.count() == 0 and {r[0] for r in rows.select("device_class").distinct().collect()} == {STALL, CABINET}
    n = rows.count()
    rates = rows.select((F.count_if(F.col("device_ts_ms").isNull()) / n).alias("missing"), (F.count_if(F.col("device_ts_ms") == 0) / n).alias("epoch")).first()
    assert abs(rates.missing - 0.01) < 0.005 and abs(rates.epoch - 0.015) < 0.005
    repeats = m.where("message_id like '%-retry'").count() / m.count()
    assert abs(repeats - 0.03) < 0.01
    assert rows.where("device_class = 'cabinet' and contactor_closed = (fault_code <> 0)").count() == 0
    assert m.where("size(readings) > 12").count() == 0
    assert stage4.replay_difference(raw, generator.telemetry(spark, generator.Config(seed=1, devices_per_firmware=20))).count() > 0
    raw.unpersist()


def test_generated_feeds(spark, tmp_path):
    d = {r.device_id: r.site_id for r in generator.devices(spark, generator.Config()).collect()}
    assert len(d) == 20
    for name, n in generator.FEEDS.items():
        rows = generator.feed(spark, name)
        assert rows.count() == n == rows.select(rows.columns[0]).distinct().count()
        generator.write_feed(rows, f"file://{tmp_path}/{name}")
        back = spark.read.schema(rows.schema).json(f"file://{tmp_path}/{name}")
        assert stage4.replay_difference(rows, back).count() == 0
    rma = generator.feed(spark, "rma")
    assert rma.where("(closed_ts is null) <> (resolution is null) or closed_ts < opened_ts").count() == 0
    assert all(d[r.device_id] == r.site_id for r in rma.collect())
    p = generator.provisioning(spark)
    assert p.select("device_id", "effective_ts").distinct().count() == p.count()
    assert p.where("hardware_rev = 'rev-1'").count() == 20


def test_declared_detectors(spark):
    rows = spark.createDataFrame([("d", i, i, c) for i, c in enumerate([1001, 0, 1042, 1001])], "device_id string, device_ts_ms long, event_id long, stall_fault_code int")
    first = detectors.findings(rows)
    assert Counter(r.detector for r in first.collect()) == {"module_fault": 2, "thermal_event": 1}
    assert detectors.findings(rows, detectors.DECLARED, first).count() == 0
    again = detectors.declared([{"name": "module_fault", "version": 2, "rule": "faults"}], {"faults": detectors.module_faults})
    assert {r.detector_version for r in detectors.findings(rows, again, first).collect()} == {2}


def test_retention(spark, tmp_path):
    now = 1_780_358_400_000  # 2026-06-02
    rows = spark.createDataFrame([(d, now - d * 86_400_000) for d in (0, 89, 90, 91, 390, 400, 700, 760)], "days int, t long")
    kept = {k: sorted(r.days for r in stage4.retained(rows, "t", now, k).collect()) for k in ("rows", "features", "linkage")}
    assert kept == {"rows": [0, 89, 90, 91, 390], "features": [0, 89, 90, 91, 390, 400, 700], "linkage": [0, 89, 90]}
    root = f"file://{tmp_path}/t"
    spark.createDataFrame([("2024-01-0" + str(k), k) for k in (1, 2, 3)], "event_date string, k int").write.partitionBy("event_date").parquet(root)
    assert stage4.drop_expired(spark, root, "2024-01-03") == ["event_date=2024-01-01", "event_date=2024-01-02"]
    assert [r.k for r in spark.read.parquet(root).collect()] == [3]


def test_feeds_by_day_and_history(spark, tmp_path):
    rma, path = generator.feed(spark, "rma"), f"file://{tmp_path}/rma"
    days = [r.d for r in rma.select(F.date_format(F.timestamp_millis("opened_ts"), "yyyy-MM-dd").alias("d")).distinct().collect()]
    assert sum(stage4.load_daily(rma, "opened_ts", path, d) for d in days) == 150
    stage4.load_daily(rma, "opened_ts", path, days[0])
    assert spark.read.parquet(path).count() == 150
    history = stage4.with_climate(generator.provisioning(spark), spark.createDataFrame([("site-000", "hot")], "site_id string, climate string"))
    probes = generator.devices(spark, generator.Config()).select("device_id", F.lit(generator.Config().now_ms).alias("t"))
    got = {r.device_id: r for r in stage3.as_of(probes, history, "device_id", "t", "effective_ts", ["hardware_rev", "site_id", "climate"]).collect()}
    newest = {r.device_id: r for r in history.orderBy("effective_ts").collect()}
    assert {d: (r.hardware_rev, r.climate) for d, r in got.items()} == {d: (r.hardware_rev, r.climate) for d, r in newest.items()}
    current = stage3.validity(history, "device_id", "effective_ts").where("valid_to is null")
    assert {r.device_id: r.hardware_rev for r in current.collect()} == {d: r.hardware_rev for d, r in newest.items()}


def test_corpus_and_reports(spark, tmp_path):
    c = generator.Config(devices_per_firmware=5)
    m = landing.parse_raw(generator.telemetry(spark, c)).persist()
    root = f"file://{tmp_path}/corpus"
    manifest = landing.write_envelopes(m, root, {"seed": c.seed})
    assert json.loads((tmp_path / "corpus/manifest.json").read_text()) == manifest and len(manifest["groups"]) == 5
    assert (tmp_path / "corpus/stall/2.1.4/messages.jsonl").is_dir()
    back = landing.read_envelopes(spark, root)
    assert stage4.replay_difference(m.select("raw"), back.select("raw")).count() == 0
    assert sum(g["messages"] for g in manifest["groups"].values()) == m.count()
    issues = F.from_json("raw", "_debug_injected_issues array<string>")["_debug_injected_issues"]
    messages = m.select("message_id", "device_id", "device_class", "firmware_version", "arrival_ts_ms", F.size("readings").alias("n_readings"), issues.alias("issues"), profile.message_size(F.col("raw")).alias("n_bytes"))
    assert messages.agg(F.sum("n_bytes")).first()[0] == sum(len(r.raw.encode()) for r in m.collect())
    rows, _ = stage1.parse_messages(m, stage1.default_registry())
    outages = spark.createDataFrame([("2.1.4", 10, 5)], "firmware_version string, buffered long, dropped long")
    metrics = profile.firmware_metrics(messages, rows, profile.burst_events(messages), outages)
    got = {r.firmware_version: r for r in metrics.collect()}
    assert got["2.1.4"].drop_rate == 0.333333 and got["2.1.4"].outage_rate == 0.2 and got["3.0.1"].drop_rate is None
    assert got["2.1.4"].duplicate_messages == manifest["groups"]["stall/2.1.4"].get("duplicate_of", 0)
    assert got["2.1.4"].expected_outage_probability == 0.625
    text = reports.firmware_report(metrics, {"seed": c.seed})
    assert text.index("## 1.8.2 (cabinet)") < text.index("## 2.1.4 (stall)") and "n/a" in text
    assert json.loads(reports.to_json(metrics, ["firmware_version"]))["2.1.4"]["devices"] == 5
    assert [r.x for r in spark.createDataFrame([(0.256,), (None,)], "v double").select(fn.percent(F.col("v"), 1).alias("x")).collect()] == ["25.6%", "n/a"]
    m.unpersist()


def test_payload_hash(spark):
    one = spark.createDataFrame([(2, "x", None)], "b int, a string, c string")
    text = fn.canonical_json({c: F.col(c) for c in one.columns})
    r = one.select(text.alias("t"), fn.payload_hash(text).alias("h")).first()
    assert r.t == '{"a":"x","b":2,"c":null}' and r.h == "sha1:" + hashlib.sha1(r.t.encode()).hexdigest()[:16]
