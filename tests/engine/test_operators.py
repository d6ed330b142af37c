"""Hand-computed cases: boundaries, replay, quarantine, streaming, and what SQL doesn't cover."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import scalars as fn
from tidegrid.model import CATALOG, STALL, STALL_SIGNALS
from tidegrid.operators import profile, quantiles, reports, stage1, stage2, stage3
from tidegrid.operators.stores import Stage1Store
from tidegrid.plans import late_data, stage4
from tidegrid.sources import catalog, landing
from tidegrid.streaming import ingest

H = 3_600_000
READING = {"session_id": "s", "state": "charging", "output_voltage_v": 400.0, "output_current_a": 1.0, "output_power_kw": 1.0, "connector_temp_c": 30.0, "energy_delivered_kwh": 1.0, "fault_code": 0, "device_ts_ms": 1000, "payload_hash": "h"}


def envelope(i, readings=None, **kw):
    return json.dumps({"message_id": f"m{i}", "device_id": f"d{i % 3}", "device_class": STALL, "firmware_version": "2.1.4", "site_id": "x", "protocol": "mqtt_batch", "sent_ts_ms": 1, "arrival_ts_ms": 2 * H + i, "readings": [READING] if readings is None else readings} | kw)


def lines(spark, texts):
    return landing.parse_raw(spark.createDataFrame([(t,) for t in texts], "raw string"))


def test_floor_and_future_threshold(spark):
    df = spark.createDataFrame([(-1, 0), (0, 0), (59_999, 0), (6 * H, 0), (6 * H + 1, 0), (None, 0), (5, None)], "device_ts_ms long, arrival_ts_ms long")
    got = df.select(fn.bucket_start(F.col("device_ts_ms"), 60_000).alias("b"), stage1.timestamp_reason(F.col("device_ts_ms"), F.col("arrival_ts_ms")).alias("r")).collect()
    assert [x.b for x in got] == [-60_000, 0, 0, 6 * H, 6 * H, None, 0]
    assert [x.r for x in got] == [None, "epoch_default_timestamp", None, None, "future_timestamp", "missing_timestamp", None]


def test_strict_cast(spark):
    inf = float("inf")
    cases = {
        ("float", "string"): [("1.5", 1.5), ("nan", "nan"), ("1_0", 10.0), ("1__0", None), ("1_0 V", None), ("1.5d", None), ("\t\u00a02.\n", 2.0), (".5e-1", 0.05), ("-Infinity", -inf), ("0x1p3", None), ("", None), (None, None)],
        ("int", "string"): [("3", 3), ("2.0", None), (" +1_000 \n", 1000), ("1.5", None), ("x", None), ("1e3", None)],
        ("bool", "string"): [(" TRUE ", True), ("\u2003false\t", False), ("yes", None), ("1", None)],
        ("float", "bigint"): [(3, 3.0), (None, None)], ("int", "double"): [(2.0, 2), (1.5, None), (-3.0, -3)], ("int", "bigint"): [(7, 7)], ("int", "boolean"): [(True, 1)], ("float", "boolean"): [(False, 0.0)],
        ("bool", "boolean"): [(True, True), (None, None)], ("bool", "bigint"): [(1, None)], ("bool", "double"): [(0.0, None)], ("enum", "string"): [(" x ", " x ")], ("string", "boolean"): [(True, "True")], ("string", "bigint"): [(5, "5")],
    }
    for (kind, given), rows in cases.items():
        df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], f"i int, x {given}")
        got = [r.v for r in df.select("i", fn.strict_cast(F.col("x"), kind, given).alias("v")).orderBy("i").collect()]
        assert [("nan" if v != v else v) for v in got] == [b for _, b in rows], (kind, given)


def test_parse_and_quarantine(spark):
    lacks = {k: v for k, v in READING.items() if k != "state"}
    df = lines(spark, [envelope(1), envelope(2, [READING, lacks]), envelope(3, firmware_version="9"), envelope(4, [READING] * 3)])
    rows, bad = stage1.parse_messages(df, stage1.default_registry())
    assert Counter(r.message_id for r in rows.collect()) == {"m1": 1, "m4": 3}
    assert {r.message_id: r.reason for r in bad.collect()} == {"m2": "parser_error: a reading lacks a field", "m3": "no_parser_registered_for_(stall, 9)"}
    with pytest.raises(stage1.DuplicateParserError):
        stage1.register(stage1.default_registry(), STALL, "2.1.4", None)


def test_envelope_reasons(spark):
    df = lines(spark, [envelope(1), envelope(2, []), envelope(3, device_class="boat"), envelope(4, message_id=None), "not json"])
    got = [r.x for r in df.select(landing.reject_reason(df).alias("x")).collect()]
    assert got == [None, "readings_not_a_non_empty_list", "unsupported_device_class: boat", "missing_field: message_id", "missing_field: message_id"]


def test_landing_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/landed"
    df = lines(spark, [envelope(i) for i in range(5)])
    assert landing.land(df, path) == {"seen": 5, "written": 5, "present": 0, "landed": 5, "distinct": 5}
    more = landing.land(df.unionByName(lines(spark, [envelope(9), envelope(9)])), path)
    landing.reconcile(more)
    assert more == {"seen": 7, "written": 1, "present": 6, "landed": 6, "distinct": 6}
    assert spark.read.parquet(path).count() == 6
    for wrong in ({"written": 0}, {"present": 5}, {"landed": 5}):
        with pytest.raises(stage1.ReconciliationError):
            landing.reconcile(more | wrong)
    with pytest.raises(ValueError):
        landing.land(lines(spark, [envelope(1, device_class="boat")]), path)


def rows(spark, triples):
    return spark.createDataFrame([(d, t, h, 1, f"m{i}") for i, (d, t, h) in enumerate(triples)], "device_id string, device_ts_ms long, payload_hash string, arrival_ts_ms long, message_id string").withColumn("device_class", F.lit(STALL))


def test_store_merges_marks_and_acknowledges(spark, tmp_path):
    store = Stage1Store(spark, f"file://{tmp_path}/s")
    first = [("a", H, "x"), ("b", H, "x"), ("a", 5 * H, "y"), ("a", H, "x")]
    assert store.merge(0, rows(spark, first), ["message_id"]) == {"seen": 4, "inserted": 3, "present": 1}
    assert store.dirty()[0].count() == 0  # a first population marks nothing
    assert store.merge(1, rows(spark, first), ["message_id"])["inserted"] == 0
    late = [("a", H + 5, "z"), ("b", 7 * H, "n")]
    assert store.merge(2, rows(spark, late), ["message_id"])["inserted"] == 2
    assert store.merge(2, rows(spark, late), ["message_id"])["inserted"] == 0  # a replayed batch
    keys, upto = store.dirty("grid")
    assert [tuple(r) for r in keys.collect()] == [("a", "1970-01-01T01")]
    store.acknowledge(upto, "grid")
    assert store.dirty("grid")[0].count() == 0
    assert store.dirty("days")[0].count() == 1  # another consumer has its own place
    with pytest.raises(ValueError):
        store.merge(3, rows(spark, [("a", None, "x")]), ["message_id"])


def test_null_keys_are_equal(spark):
    a, b = rows(spark, [(None, 1, None), ("a", 1, "x")]), rows(spark, [(None, 1, None), ("a", 2, "x")])
    assert stage1.new_rows(b, a, ["message_id"]).count() == 1


def test_flags(spark):
    data = [(i, 1000 * i, v, e, s) for i, (v, e, s) in enumerate([(30.0, 1.0, "p"), (30.0, 1.0, "p"), (None, 1.0, "p"), (30.0, 0.5, "p"), (30.0, 0.1, "q"), (30.0, 0.1, None), (float("nan"), 0.05, None), (float("nan"), 0.05, None), (50.0, 9.0, None)])]
    df = spark.createDataFrame(data, "event_id int, device_ts_ms long, connector_temp_c double, energy_delivered_kwh double, session_id string").withColumn("device_id", F.lit("d"))
    got = {r.event_id: {(f.kind, f.field) for f in r.flags} for r in stage2.flag_rows(df, STALL_SIGNALS, ["device_ts_ms"]).collect()}
    assert len(got) == 9
    assert ("stuck", "connector_temp_c") in got[5] and ("stuck", "connector_temp_c") not in got[4]  # the null doesn't break the run; the fifth equal value is at 5
    assert not any(("stuck", "connector_temp_c") in got[i] for i in (6, 7, 8))
    assert [i for i in got if ("counter_reset", "energy_delivered_kwh") in got[i]] == [3, 6]
    assert ("range", "connector_temp_c") in got[8] and ("range", "connector_temp_c") not in got[6]


def test_offsets_round_half_even(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 2), ("b", 0, 3)], "device_id string, device_ts_ms long, arrival_ts_ms long")
    assert {r.device_id: r.offset_ms for r in stage2.estimate_offsets(df).collect()} == {"a": 2, "b": 2}


def test_device_day(spark):
    df = rows(spark, [("a", m * 60_000, f"h{m}") for m in (0, 1, 500, 501)]).withColumn("mode", F.concat(F.lit("m"), (F.col("device_ts_ms") / 60_000).cast("int").cast("string")))
    b = stage3.day_buckets(df, ["payload_hash"])
    day = stage3.device_days(b).first()
    assert (day.measured_count, day.longest_gap, day.gap_count) == (4, 938, 1436)
    assert {r["mode"]: r.minutes for r in stage3.mode_minutes(b).collect()} == {"m0": 1, "m1": 499, "m500": 1, "m501": 939}


def test_latest_ties_take_the_first(spark):
    df = rows(spark, [("a", 5, "y"), ("a", 5, "x")]).withColumn("mode", F.col("payload_hash"))
    assert stage3.latest_in_bucket(df, ["payload_hash"]).first()["mode"] == "x"


def test_as_of_boundaries(spark):
    h = spark.createDataFrame([("a", 10, "v1"), ("a", 20, "v2")], "k string, e long, v string")
    p = spark.createDataFrame([("a", t) for t in (9, 10, 19, 20, 99)], "k string, t long")
    assert {r.t: r.v for r in stage3.as_of(p, h, "k", "t", "e", ["v"]).collect()} == {9: None, 10: "v1", 19: "v1", 20: "v2", 99: "v2"}


def test_profilers_by_hand(spark):
    r = spark.createDataFrame([("d", "A", 1, "k1"), ("d", "A", 1, "k2"), ("d", "B", 2, "k1"), ("d", "B", 2, "k2"), ("d", "C", 3, "k2"), ("d", "C", 3, "k3")], "device_id string, message_id string, arrival_ts_ms long, payload_hash string").withColumns({"device_class": F.lit(STALL), "device_ts_ms": F.lit(1).cast("long")})
    d = profile.duplicate_keys(r).first()
    assert (d.instances, d.distinct_keys, d.duplicated_keys, d.excess_rate) == (6, 3, 2, 0.5)
    m = profile.message_duplicates(r).first()
    assert (m.messages, m.pure, m.partial) == (3, 1, 1)
    late = spark.createDataFrame([(STALL, 10_000 * i, 90_000 if i else 90_000) for i in range(10)], "device_class string, device_ts_ms long, arrival_ts_ms long").withColumn("device_ts_ms", F.col("device_ts_ms") + 1).withColumn("arrival_ts_ms", F.col("arrival_ts_ms") + 1)
    x = profile.lateness(late).first()
    assert (x.median_s, x.p90_s, x.p99_s) == (45.0, 81.0, 89.1)
    assert reports.markdown(profile.duplicate_keys(r)).startswith("| device_class |")
    whole = profile.class_profile(r.withColumn("arrival_ts_ms", F.col("arrival_ts_ms").cast("long")))
    assert json.loads(reports.to_json(whole, ["device_class"]))[STALL]["pure"] == 1


def test_catalog(spark):
    c = catalog.from_mapping({"version": 1, STALL: {"2.1.4": {"state": {"canonical_name": "session_state", "type": "enum"}}, "note": "x"}})
    assert c[STALL, "2.1.4"][0].canonical == "session_state"
    with pytest.raises(catalog.CatalogError):
        catalog.from_mapping({STALL: {"2.1.4": {"state": {}}}})
    assert catalog.frame(spark, CATALOG).count() == sum(len(v) for v in CATALOG.values())


def test_stream_survives_a_failing_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.jsonl").write_text("\n".join(envelope(10 * k + i) for i in range(4)) + "\n" + envelope(99, []))
    calls, landed = [], f"file://{tmp_path}/landed"

    def sink(frame):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("outage")
        landing.land(frame, landed)

    ledger = ingest.Ledger(spark, f"file://{tmp_path}/ledger")
    start = lambda: ingest.ingest_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/ck", sink, f"file://{tmp_path}/bad", 1, ledger)
    with pytest.raises(Exception, match="outage"):
        start().awaitTermination()
    assert ledger.snapshot() == {"accepted": 4, "rejected": 1, "attempts": 1, "delivered": 0, "pending": 4} and ledger.reconciles()
    assert ingest.drain(start) == 1
    assert ingest.drain(start) == 0  # nothing is left
    assert ledger.snapshot() == {"accepted": 12, "rejected": 3, "attempts": 5, "delivered": 12, "pending": 0} and ledger.reconciles()
    assert spark.read.parquet(f"file://{tmp_path}/bad").count() == 3
    assert spark.read.parquet(landed).select("message_id").distinct().count() == 12
    schema = spark.read.parquet(landed).schema
    store = Stage1Store(spark, f"file://{tmp_path}/store")
    quarantine = f"file://{tmp_path}/quarantine"
    ingest.merge_stream(spark, landed, f"file://{tmp_path}/ck2", store, stage1.default_registry(), schema, quarantine).awaitTermination()
    assert len(store) == 3  # one reading a device
    bad = lines(spark, [envelope(50, firmware_version="9"), envelope(51, [READING | {"device_ts_ms": 0}, READING | {"device_ts_ms": 7}])])
    landing.land(bad, landed)
    ingest.merge_stream(spark, landed, f"file://{tmp_path}/ck2", store, stage1.default_registry(), schema, quarantine).awaitTermination()
    got = {(r.kind, r.reason): r.n for r in ingest.quarantined(spark, quarantine).collect()}
    assert got == {("message", "no_parser_registered_for_(stall, 9)"): 1, ("row", "epoch_default_timestamp"): 1}
    assert len(store) == 4


def test_versions_and_findings(spark):
    hours = spark.createDataFrame([("a", "h1", 100), ("a", "h2", 101)], "device_id string, event_hour string, hour_end_ms long")
    state = stage4.hour_status(hours, 100 + 24 * H)
    assert {r.event_hour: r.status for r in state.collect()} == {"h1": "final", "h2": "provisional"}
    first = stage4.new_versions(state, None)
    assert stage4.new_versions(state, first).count() == 0
    later = stage4.new_versions(stage4.hour_status(hours, 101 + 24 * H), first)
    assert [tuple(r) for r in later.collect()] == [("a", "h2", "final", 2)]
    every = first.unionByName(later)
    assert stage4.new_versions(stage4.hour_status(hours, 100), every).count() == 0  # final stays final
    assert {r.event_hour: r.version for r in stage4.latest_version(every).collect()} == {"h1": 1, "h2": 2}
    f = stage4.new_findings(hours, None, ["device_id", "event_hour"])
    assert f.count() == 2 and stage4.new_findings(hours, f, ["device_id", "event_hour"]).count() == 0


def test_merge_reads_the_partitions_of_its_batch_alone(spark, tmp_path):
    store = Stage1Store(spark, f"file://{tmp_path}/s")
    day = 24 * H
    store.merge(0, rows(spark, [(d, k * day + H, "x") for d in "abcdefgh" for k in range(4)]), ["message_id"])
    assert (tmp_path / "s/rows/batch=0/device_class=stall/event_date=1970-01-03/hour=01").is_dir()
    late = rows(spark, [("a", 2 * day + H, "x"), ("a", 2 * day + H, "y"), (None, 2 * day + H, "y")])
    for f in (tmp_path / "s/rows/batch=0").rglob("*.parquet"):  # whatever else is read fails
        if "event_date=1970-01-03" not in str(f):
            f.write_bytes(b"not a table")
            f.with_name(f".{f.name}.crc").unlink()
    assert store.merge(1, late, ["message_id"]) == {"seen": 3, "inserted": 2, "present": 1}
    assert [tuple(r) for r in store.dirty()[0].collect()] == [("a", "1970-01-03T01")]
    assert store.get("a", 2 * day + H, "y").count() == 1 and store.get("a", 2 * day + H, "z").count() == 0


def test_compacted_store(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store = Stage1Store(spark, root)
    first, late = [("a", H, "x"), ("b", H, "x")], [("a", H + 5, "z"), ("c", 7 * H, "n")]
    store.merge(0, rows(spark, first), ["message_id"])
    store.merge(1, rows(spark, late).withColumn("more", F.lit(1)), ["message_id"])  # batches may gain columns
    before = sorted(map(str, store.rows().orderBy("device_id", "device_ts_ms").collect()))
    assert store.compact() == 2 == store.compact()
    again = Stage1Store(spark, root)
    assert sorted(map(str, again.rows().select(store.rows().columns).orderBy("device_id", "device_ts_ms").collect())) == before
    assert not (tmp_path / "s/rows/batch=0").exists()
    assert again.merge(1, rows(spark, late), ["message_id"])["inserted"] == 0
    assert again.merge(2, rows(spark, [*late, ("c", 7 * H + 1, "n")]), ["message_id"]) == {"seen": 3, "inserted": 1, "present": 2}
    assert len(again) == 5 and {r.hour for r in again.rows().select("hour").collect()} == {"01", "07"}
    assert {tuple(r) for r in again.dirty()[0].collect()} == {("a", "1970-01-01T01"), ("c", "1970-01-01T07")}


def test_cleared_keys(spark, tmp_path):
    store = Stage1Store(spark, f"file://{tmp_path}/s", ())
    store.merge(0, rows(spark, [("a", H, "x"), ("b", H, "x")]), ["message_id"])
    store.merge(1, rows(spark, [("a", H + 1, "x"), ("b", H + 1, "x")]), ["message_id"])
    keys, upto = store.dirty("grid")
    store.clear(keys.where("device_id = 'a'"), upto, "grid")
    assert [r.device_id for r in store.dirty("grid")[0].collect()] == ["b"] and store.dirty("days")[0].count() == 2
    store.merge(2, rows(spark, [("a", H + 2, "x")]), ["message_id"])
    assert {r.device_id for r in store.dirty("grid")[0].collect()} == {"a", "b"}  # marked anew


def test_backfill_of_three_days(spark, tmp_path):
    """Two devices send what an outage of 72 hours held back: 288 rows in one batch, two boundary hours are dirty, and a replay does nothing."""
    store = Stage1Store(spark, f"file://{tmp_path}/s", ("event_date",))
    start, half = 10 * H, H // 2
    known = [(d, start - k * half, f"k{k}") for d in "ab" for k in range(1, 5)] + [(d, start + 72 * H + k * half, f"l{k}") for d in "ab" for k in range(1, 5)]
    known += [("a", start + 60_000, "first"), ("b", start + 72 * H - 60_000, "last")]  # the hours in which one went and the other came back
    sent = lambda x: rows(spark, x).withColumn("firmware_version", F.lit("2.1.4"))
    store.merge(0, sent(known), ["message_id"])
    held = sent([(d, start + k * half, f"h{k}") for d in "ab" for k in range(144)])
    assert store.merge(1, held, ["message_id"]) == {"seen": 288, "inserted": 288, "present": 0}
    dirty, upto = store.dirty("stage2")
    assert {tuple(r) for r in dirty.collect()} == {("a", "1970-01-01T10"), ("b", "1970-01-04T09")}
    out = late_data.Stage2Output(spark, f"file://{tmp_path}/stage2")
    assert out.run(store, CATALOG, keep=("message_id", "batch_id")) == {"device_hours": 2, "rows_seen": 6, "rows_recomputed": 6, "rows_failed": 0}
    assert out.rows().count() == 6
    assert store.merge(1, held, ["message_id"])["inserted"] == 0 == store.merge(2, held, ["message_id"])["inserted"]
    assert out.run(store, CATALOG)["device_hours"] == 0 and out.rows().count() == 6


def stage1_rows(spark, values):
    """(device, ts, class, firmware, state, output_voltage_v, contactor_closed)."""
    schema = "device_id string, device_ts_ms long, device_class string, firmware_version string, state string, output_voltage_v string, contactor_closed boolean, odd string, payload_hash string, arrival_ts_ms long"
    return spark.createDataFrame([(*v, None if k % 2 else "odd", f"h{k}", 1) for k, v in enumerate(values)], schema)


FEW = {STALL: frozenset({"state", "output_voltage_v"}), "cabinet": frozenset({"contactor_closed"})}


def test_mixed_catalog(spark):
    r = stage1_rows(spark, [("a", 1, STALL, "2.1.4", "charging", "400", None), ("a", 2, STALL, "2.1.4", None, "x", None), ("b", 3, "cabinet", "1.8.2", None, None, True), ("b", 4, "cabinet", "1.8.2", None, "5", None), ("c", 5, STALL, "none", "charging", "x", None)])
    got = {x.device_ts_ms: x for x in stage2.canonicalize_mixed(r, CATALOG, (), FEW).collect()}
    assert (got[1].session_state, got[1].output_voltage_v, got[1].errors, got[1].units, got[1].dropped_fields) == ("charging", 400.0, [], {"output_voltage_v": "V"}, ["odd"])
    assert sorted(got[2].errors) == ["output_voltage_v", "state"] and got[2].dropped_fields == []
    assert (got[3].contactor_closed, got[3].errors, got[3].units) == (True, [], {})
    assert got[4].errors == ["contactor_closed"] and got[4].dropped_fields == ["output_voltage_v"]  # it isn't a cabinet's
    assert got[5].errors == [] and sorted(got[5].dropped_fields) == ["odd", "output_voltage_v", "state"]


def test_recompute_keeps_every_key(spark):
    r = stage1_rows(spark, [("a", H + 1, STALL, "2.1.4", "charging", "400", None), ("a", H + 2, STALL, "2.1.4", "charging", "x", None), ("b", H, STALL, "2.1.4", "fault", "bad", None), ("b", 9 * H, STALL, "2.1.4", "fault", "1", None)])
    dirty = spark.createDataFrame([("a", "1970-01-01T01"), ("b", "1970-01-01T01"), ("gone", "1970-01-02T05")], "device_id string, event_hour string")
    result = stage2.recompute(r, dirty, CATALOG, (), FEW)
    assert {x.device_id: (x.rows_seen, x.rows_recomputed, x.rows_failed) for x in result.per_key.collect()} == {"a": (2, 1, 1), "b": (1, 0, 1), "gone": (0, 0, 0)}
    grid = late_data.rebuilt_grid(result, ["payload_hash"])
    hours = {x.device_id: (x.device_class, x.rows_seen, x.rows_failed, x.buckets, x.measured) for x in late_data.rebuilt_hours(result, grid).collect()}
    assert hours == {"a": (STALL, 2, 1, 60, 1), "b": (None, 1, 1, 0, 0), "gone": (None, 0, 0, 0, 0)}
    assert stage3.not_contiguous(grid).count() == 0
    days = {x.device_id: (x.rows_seen, x.rows_failed, x.measured_count) for x in late_data.rebuilt_days(r, dirty, CATALOG, ["payload_hash"], (), FEW).collect()}
    assert days == {"a": (2, 1, 1), "b": (2, 1, 1), "gone": (0, 0, None)}


def test_grid_checks(spark):
    r = rows(spark, [("a", 5 * 60_000, "x"), ("a", 99 * H, "y")]).withColumn("mode", F.lit("m"))
    span = lambda *v: spark.createDataFrame([v], "device_id string, device_class string, range_start_ms long, range_end_ms long")
    good = stage3.build_grid(span("a", STALL, 0, H), r, ["payload_hash"], initial_mode=F.lit("before"))
    assert [x["mode"] for x in good.orderBy("bucket_start_ms").collect()] == ["before"] * 5 + ["m"] * 55
    assert stage3.build_grid(span("a", STALL, 0, H), r, ["payload_hash"]).where("mode is null").count() == 5
    for wrong in (span("a", STALL, 0, H + 1), span("a", STALL, 0, 0), span("a", "boat", 0, H), span("a", None, 0, H)):
        with pytest.raises(Exception, match="buckets|unsupported"):
            stage3.build_grid(wrong, r, ["payload_hash"]).collect()
    assert stage3.not_contiguous(good.where("bucket_start_ms <> 600000")).count() == 1
    assert stage3.not_contiguous(good.where("bucket_start_ms > 0")).count() == 1


def test_exact_percentiles(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    groups = {"one": [5.0], "same": [2.5] * 50, "wide": [-1e308, 1e308, 0.0, 1e-300, -1e-300], "many": rnd.normal(0, 1e6, 9000).round(2).tolist(), "heavy": [7.0] * 3000 + rnd.exponential(1, 3000).tolist(), None: [1.0, 2.0], "none": []}
    data = [(k, float(v)) for k, x in groups.items() for v in x] + [("none", None), ("many", None), ("many", float("nan"))]
    got = {r.k0: r for r in quantiles.percentiles(spark.createDataFrame(data, "k0 string, x double"), ["k0"], F.col("x"), [0, 0.3, 0.5, 0.999, 1]).collect()}
    assert got["none"].n == 0 and got["none"].p is None
    for k, x in groups.items():
        if x:
            assert got[k].n == len(x)
            if k != "wide":
                assert got[k].p == pytest.approx(np.quantile(x, [0, 0.3, 0.5, 0.999, 1]).tolist(), rel=1e-12)
    assert got["wide"].p[2] == 0.0


def test_intervals_by_bucket(spark):
    rnd = __import__("random").Random(6)
    facts = [("ab"[i % 2], rnd.randrange(0, 9 * H)) for i in range(300)] + [("a", None), (None, 5)]
    spans = [("ab"[i % 2], i, s, None if i % 9 == 0 else s + rnd.choice([0, 1, H // 2, H, 4 * H])) for i in range(40) for s in [rnd.randrange(0, 9 * H)]]
    f = spark.createDataFrame(facts, "site_id string, t long")
    w = spark.createDataFrame(spans, "site_id string, number int, s long, e long")
    got = Counter((r.t, r.number) for r in stage3.during(f, w, "site_id", "t", "s", "e").collect())
    assert got == Counter((t, n) for k, t in facts for q, n, s, e in spans if k is not None and t is not None and k == q and s <= t and (e is None or t < e))
    visits = w.selectExpr("site_id", "s as window_start", "e as window_end")
    sessions = spark.createDataFrame([("a", i, a, a + rnd.randrange(0, 40 * H)) for i in range(30) for a in [rnd.randrange(0, 30 * H)]], "site_id string, number int, start_ms long, end_ms long")
    got = {r.number: r.met for r in stage4.overlaps(sessions, visits, "site_id", "met").collect()}
    for r in sessions.collect():
        assert got[r.number] == sum(1 for q, _, s, e in spans if q == "a" and s <= r.end_ms and (e is None or e > r.start_ms and e > s))


def test_overlaps_are_counted_without_pairs(spark):
    # equal spans count each for itself; what has no key or no time, or ends before it starts, meets none
    spans = spark.createDataFrame([("a", 10, 20)] * 3 + [("a", 21, 21), ("b", 0, 99), (None, 0, 99), ("a", None, 20), ("a", 10, None), ("a", 20, 10)], "site_id string, start_ms long, end_ms long")
    windows = spark.createDataFrame([("a", 20, 21), ("a", 0, 10), ("a", 0, 11), ("a", 21, None), ("a", 15, 15), ("a", None, 15), ("a", None, None), (None, 0, None)], "site_id string, window_start long, window_end long")
    got = Counter(tuple(r) for r in stage4.overlaps(spans, windows, "site_id", "met", width_ms=7).collect())
    assert got == Counter([("a", 10, 20, 2)] * 3 + [("a", 21, 21, 1), ("b", 0, 99, 0), (None, 0, 99, 0), ("a", None, 20, 0), ("a", 10, None, 0), ("a", 20, 10, 0)])
    # 10^10 pairs of one key
    n = 100_000
    many = spark.range(n).selectExpr("'a' as site_id", "id as start_ms", f"id + {n} as end_ms")
    met = stage4.overlaps(many, many.selectExpr("site_id", "start_ms as window_start", "end_ms as window_end"), "site_id", "met", width_ms=n // 10)
    assert met.where(f"met = {n}").count() == n


def test_flags_of_mixed_devices(spark):
    df = spark.createDataFrame([(d, c, f, i, i * 1000, 450.0, 500.0) for d, c, f in (("a", STALL, "2.1.4"), ("b", "cabinet", "1.8.2"), ("c", STALL, "none")) for i in range(3)], "device_id string, device_class string, firmware_version string, event_id int, device_ts_ms long, output_voltage_v double, grid_voltage_v double")
    got = stage2.flag_mixed(df, CATALOG, ["device_ts_ms"]).collect()
    assert Counter((r.device_id, f.field) for r in got for f in r.flags) == {("a", "output_voltage_v"): 3, ("b", "grid_voltage_v"): 3}
    assert len(got) == 9 and {f.detail for r in got for f in r.flags if r.device_id == "a"} == {"450.0 outside [390, 410]"}
    assert stage2.signals_of_pair(CATALOG, STALL, "none") == []
