"""Rules v1: fault codes and derates. Each is one sort within a device's (or session's) partition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stage4 import new_findings

#: Simulated fault codes of a stall.
MODULE_FAULT, THERMAL, COMMS = 1001, 1042, 2010


def fault_episodes(rows: DataFrame, rule: str, code: int, column: str = "stall_fault_code", order: tuple[str, ...] = ("device_ts_ms", "event_id")) -> DataFrame:
    """Runs of a device's readings that have the code: rule, device_id, start_ms, end_ms, readings. Null codes end a run.

    Of readings that ``order`` leaves tied, those with the code come first, so no run depends on how rows lie."""
    w = W.partitionBy("device_id").orderBy(*order, F.desc("has"))
    marked = rows.select("device_id", *order, F.coalesce(F.col(column) == code, F.lit(False)).alias("has"))
    first = F.col("has") & ~F.coalesce(F.lag("has").over(w), F.lit(False))
    runs = marked.withColumn("first", first).withColumn("run", F.sum(F.col("first").cast("int")).over(w)).where("has")
    t = F.col("device_ts_ms")
    return runs.groupBy("device_id", "run").agg(F.min(t).alias("start_ms"), F.max(t).alias("end_ms"), F.count("*").alias("readings")).select(F.lit(rule).alias("rule"), "device_id", "start_ms", "end_ms", "readings")


def module_faults(rows: DataFrame) -> DataFrame:
    return fault_episodes(rows, "module_fault_v1", MODULE_FAULT)


def thermal_events(rows: DataFrame) -> DataFrame:
    return fault_episodes(rows, "thermal_event_v1", THERMAL)


def derates(rows: DataFrame, session: list[str], power: str = "output_power_kw", drop: float = 0.2, band: float = 0.05, plateau: int = 4, order: tuple[str, ...] = ("device_ts_ms", "event_id")) -> DataFrame:
    """Readings at which power falls at once by at least ``drop`` of the session's peak so far and then stays level.

    Level: this and the next readings, ``plateau`` together, lie within ``band`` of the peak. A taper, which declines
    little by little, has no such step, and a session's end no such plateau. Rows without power don't count."""
    w = W.partitionBy(*session).orderBy(*order)
    ahead = w.rowsBetween(0, plateau - 1)
    p = F.col(power)
    g = rows.where(p.isNotNull()).withColumns({
        "_before": F.lag(p).over(w), "_peak": F.max(p).over(w.rowsBetween(W.unboundedPreceding, -1)),
        "_spread": F.max(p).over(ahead) - F.min(p).over(ahead), "_n": F.count("*").over(ahead),
    })
    found = (F.col("_before") - p >= drop * F.col("_peak")) & (F.col("_spread") <= band * F.col("_peak")) & (F.col("_n") == plateau) & (F.col("_peak") > 0)
    return g.where(found).select(F.lit("derate_v1").alias("rule"), *session, F.col("device_ts_ms").alias("found_ms"), F.col("_before").alias("power_before"), p.alias("power_after"))


@dataclass(frozen=True)
class Detector:
    """A declared rule. A changed one takes a new version, whose findings are new beside those of the old."""

    name: str
    version: int
    find: Callable[[DataFrame], DataFrame]
    content: tuple[str, ...] = ("device_id", "start_ms", "end_ms")


#: What runs by default.
DECLARED = (Detector("module_fault", 1, module_faults), Detector("thermal_event", 1, thermal_events))


def declared(entries: list[dict], rules: dict[str, Callable[[DataFrame], DataFrame]]) -> list[Detector]:
    """Detectors from a mapping (of a YAML or JSON file): name, version and the rule's name."""
    return [Detector(e["name"], int(e["version"]), rules[e["rule"]], tuple(e.get("content", Detector.content))) for e in entries]


def findings(rows: DataFrame, detectors: tuple[Detector, ...] | list[Detector] = DECLARED, stored: DataFrame | None = None) -> DataFrame:
    """What the detectors find and ``stored`` lacks: detector, detector_version, the content and finding_id (its hash). To be appended."""
    found = [d.find(rows).select(F.lit(d.name).alias("detector"), F.lit(d.version).alias("detector_version"), *d.content) for d in detectors]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return new_findings(every, stored, every.columns)
