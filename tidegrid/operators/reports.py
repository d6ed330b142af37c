"""Reports of small aggregates as text: Markdown and JSON. Rows come to the driver ordered; aggregates alone belong here."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def _text(v: object) -> str:
    return "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)


def percent(x: float | None, digits: int = 0) -> str:
    return "n/a" if x is None else f"{100 * x:.{digits}f}%"


def table(heads: list[str], rows: list[list[object]]) -> str:
    return "\n".join([f"| {' | '.join(heads)} |", "|" + " --- |" * len(heads), *(f"| {' | '.join(map(_text, r))} |" for r in rows)]) + "\n"


def markdown(report: DataFrame, by: list[str] | None = None) -> str:
    """An aggregate as one table, ordered by ``by`` (its first two columns if not given)."""
    return table(report.columns, [list(r) for r in report.orderBy(*(by or report.columns[:2])).collect()])


def to_json(report: DataFrame, by: list[str]) -> str:
    """An aggregate as an object: by the text of its keys, each row's other columns."""
    rows = [r.asDict(recursive=True) for r in report.orderBy(*by).collect()]
    return json.dumps({"/".join(str(r[k]) for k in by): {c: v for c, v in r.items() if c not in by} for r in rows}, indent=2, default=str)


def firmware_report(metrics: DataFrame, about: dict[str, object]) -> str:
    """firmware_metrics as a document: a summary, the clocks, and a section for each firmware (by class, then version)."""
    rows = [r.asDict() for r in metrics.orderBy("device_classes", "firmware_version").collect()]
    summary = [[r["firmware_version"], r["device_classes"], f"{r['quirk_multiplier']:g}", r["devices"], percent(r["outage_rate"]), percent(r["drop_rate"]), percent(r["recall"]), percent(r["precision"], 1)] for r in rows]
    out = ["# Behaviour by firmware", "", "Made-up telemetry: " + ", ".join(f"{k} {v}" for k, v in about.items()) + ".", "", "## Summary", ""]
    out += [table(["Firmware", "Class", "Factor", "Devices", "Outages", "Dropped", "Recall", "Precision"], summary), "## Clocks", ""]
    out.append(table(["Firmware", "Missing", "Epoch", "Future", "Share of readings"], [[r["firmware_version"], r["missing_timestamp_readings"], r["epoch_default_timestamp_readings"], r["future_timestamp_readings"], percent(r["clock_issue_rate"], 1)] for r in rows]))
    for r in rows:
        out += [f"## {r['firmware_version']} ({r['device_classes']})", ""]
        out.append(f"- {r['devices']} devices, {r['messages']} messages, {r['readings']} readings.")
        out.append(f"- Outages: {r['outage_events']} ({percent(r['outage_rate'])} of devices; expected {percent(r['expected_outage_probability'])}); {r['outage_readings_buffered']} readings held back and {r['outage_readings_dropped']} dropped ({percent(r['drop_rate'])}; expected {percent(r['expected_drop_rate'])}).")
        out.append(f"- {r['post_outage_burst_messages']} messages after outages, {r['late_messages']} late ones, {r['duplicate_messages']} repeats.")
        found = "no true burst to find" if not r["true_bursts"] else f"{r['hits']} of {r['true_bursts']} bursts found ({percent(r['recall'])}), on {r['devices_hit']} of {r['devices_true']} devices ({percent(r['device_recall'])})"
        out += [f"- Detector: {found}; {r['flagged']} flagged, of these {percent(r['precision'], 1)} right.", ""]
    return "\n".join(out)
