"""Canonicalisation, clock offsets, quality flags and targeted recompute."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import event_hour, half_even, strict_cast
from ..model import CABINET, CABINET_READING, DEFAULTS, IDENTITY, STALL, STALL_READING, Signal, Thresholds


def canonicalize(rows: DataFrame, signals: list[Signal]) -> DataFrame:
    """rows of one class and firmware -> identity, canonical columns, units, dropped_fields, errors.

    Uncataloged fields are dropped and listed; a present null or a refused cast is an error of the row."""
    known, types = {s.raw: s for s in signals}, dict(rows.dtypes)
    raw = [c for c in rows.columns if c not in IDENTITY]
    errors, cols = [], []
    for name in raw:
        if (s := known.get(name)) is None:
            continue
        cast = strict_cast(F.col(name), s.type, types[name])
        errors.append(F.when(cast.isNull(), F.lit(name)))
        cols.append(cast.alias(s.canonical))
    dropped = F.array(*[F.lit(n) for n in raw if n not in known]).cast("array<string>")
    return rows.select(*[F.col(c) for c in IDENTITY if c in rows.columns], *cols, _units([known[n] for n in raw if n in known]).alias("units"), dropped.alias("dropped_fields"), F.array_compact(F.array(*errors)).cast("array<string>").alias("errors"))


def _units(signals: list[Signal]) -> Column:
    pairs = [x for s in signals if s.unit for x in (F.lit(s.canonical), F.lit(s.unit))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


#: The raw fields that a reading of each class has, null or not.
PRESENT = {c: frozenset(f.split()[0] for f in schema.split(", ")) for c, schema in ((STALL, STALL_READING), (CABINET, CABINET_READING))}


def canonicalize_mixed(rows: DataFrame, catalog: dict[tuple[str, str], list[Signal]], keep: tuple[str, ...] = (), present: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """Rows of any class and firmware in one pass: each by the entries of its own pair, in the columns of all.

    ``keep``: columns that are no fields and stay as they are. A field is present in a row if its class has it
    (``present``) or it isn't null; fields of a pair that the catalog lacks are all dropped, and the row has no error."""
    present = PRESENT if present is None else present
    types = dict(rows.dtypes)
    raw = [c for c in rows.columns if c not in IDENTITY and c not in keep]
    groups: dict[tuple[Signal, ...], list[tuple[str, str]]] = {}
    for pair, signals in catalog.items():
        groups.setdefault(tuple(signals), []).append(pair)
    pair = F.struct(F.col("device_class").alias("c"), F.col("firmware_version").alias("f"))
    of = [F.coalesce(pair.isin(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in pairs]), F.lit(False)) for pairs in groups.values()]
    values: dict[str, list[Column]] = {}
    errors, dropped, units = [], [], F.create_map().cast("map<string,string>")
    for name in raw:
        classes = [c for c, names in present.items() if name in names]
        here = F.coalesce(F.col("device_class").isin(*classes), F.lit(False)) | F.col(name).isNotNull() if classes else F.col(name).isNotNull()
        known = F.lit(False)
        for mine, signals in zip(of, groups, strict=True):
            for s in signals:
                if s.raw == name:
                    cast = F.when(mine, strict_cast(F.col(name), s.type, types[name]))
                    values.setdefault(s.canonical, []).append(cast)
                    errors.append(F.when(mine & here & cast.isNull(), F.lit(name)))
                    known = known | mine
        dropped.append(F.when(here & ~known, F.lit(name)))
    for mine, signals in zip(of, groups, strict=True):
        units = F.when(mine, _units([s for s in signals if s.raw in raw])).otherwise(units)
    names = lambda x: F.array_compact(F.array(*x)).cast("array<string>") if x else F.array().cast("array<string>")
    return rows.select(*[F.col(c) for c in (*IDENTITY, *keep) if c in rows.columns], *[F.coalesce(*v).alias(c) for c, v in values.items()], units.alias("units"), names(dropped).alias("dropped_fields"), names(errors).alias("errors"))


def split_failed(canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    return canonical.where(F.size("errors") == 0).drop("errors"), canonical.where(F.size("errors") > 0)


def dropped_field_counts(ok: DataFrame) -> DataFrame:
    return ok.select(F.explode("dropped_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def estimate_offsets(rows: DataFrame) -> DataFrame:
    """device_id, offset_ms: the median of arrival - device time, half to even."""
    return rows.groupBy("device_id").agg(half_even(F.percentile(F.col("arrival_ts_ms") - F.col("device_ts_ms"), F.lit(0.5))).alias("offset_ms")).where("offset_ms is not null")


def update_offsets(old: DataFrame, new: DataFrame) -> DataFrame:
    n = new.withColumnRenamed("offset_ms", "_new")
    return old.join(n, "device_id", "full_outer").select("device_id", F.coalesce("_new", "offset_ms").alias("offset_ms"))


def corrected_time(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """With offset_ms (0 for unknown devices), corrected_event_ts_ms and is_estimated; device_ts_ms stays."""
    j = rows.join(offsets.withColumnRenamed("offset_ms", "_o"), "device_id", "left")
    return j.withColumns({"offset_ms": F.coalesce("_o", F.lit(0)), "is_estimated": F.col("_o").isNotNull(), "corrected_event_ts_ms": F.col("device_ts_ms") + F.coalesce("_o", F.lit(0))}).drop("_o")


def _flag(kind: str, field: str, when: Column, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), detail.cast("string").alias("detail")))


def range_flag(s: Signal) -> Column:
    v = F.col(s.canonical)
    out = (v < s.low if s.low is not None else F.lit(False)) | (v > s.high if s.high is not None else F.lit(False))
    detail = F.format_string("%s outside [%s, %s]", v.cast("string"), F.lit("-" if s.low is None else f"{s.low:g}"), F.lit("-" if s.high is None else f"{s.high:g}"))
    return _flag("range", s.canonical, out & ~F.isnan(v.cast("double")), detail)


def flag_rows(rows: DataFrame, signals: list[Signal], order: list[str], limits: Thresholds = DEFAULTS) -> DataFrame:
    """With flags: range, then stuck, counter_reset and jump, in the order of each device's readings. No row goes.

    All windows share one partitioning and order, so one shuffle and sort serve them."""
    w = W.partitionBy("device_id").orderBy(*order)
    have = [s for s in signals if s.canonical in rows.columns]
    floats = [s.canonical for s in have if s.type == "float"]
    prev = lambda c: F.lag(c).over(w)
    elapsed = (F.col("device_ts_ms") - prev("device_ts_ms")) / 1000.0
    session = F.col("session_id") if "session_id" in rows.columns else F.lit(None).cast("string")
    marked = rows.withColumns({"_session": session, "_dt": F.when(elapsed > 0, elapsed)})
    marked = marked.withColumn("_new_session", F.coalesce(F.col("_session") != F.lag("_session").over(w), F.lit(False)))
    stuck = [c for c in floats if c != "output_voltage_v"]
    # a null doesn't break a run: compare with the last value there was
    before = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)) for c in stuck}
    marked = marked.withColumns({f"_new_{c}": F.when(F.col(c).isNull(), 0).when(before[c].isNull() | (before[c] != F.col(c)) | F.isnan(c), 1).otherwise(0) for c in stuck})
    # one sort by device serves islands too: the place in a run is the count of values since its start
    marked = marked.withColumns({f"_seen_{c}": F.count(c).over(w) for c in stuck})
    marked = marked.withColumns({f"_start_{c}": F.max(F.when(F.col(f"_new_{c}") == 1, F.col(f"_seen_{c}"))).over(w) for c in stuck})
    flags = [range_flag(s) for s in have if s.type in ("float", "int") and (s.low is not None or s.high is not None)]
    flags += [_flag("stuck", c, F.col(c).isNotNull() & (F.col(f"_seen_{c}") - F.col(f"_start_{c}") + 1 >= limits.stuck_run), F.col(c)) for c in stuck]
    if "energy_delivered_kwh" in floats:
        e = F.col("energy_delivered_kwh")
        marked = marked.withColumn("_reset", F.coalesce((e < prev("energy_delivered_kwh")) & ~F.isnan(prev("energy_delivered_kwh")), F.lit(False)) & ~F.col("_new_session"))
        flags.append(_flag("counter_reset", "energy_delivered_kwh", F.col("_reset"), e))
    for c in floats:
        if c in limits.jump_rates:
            rate = F.abs(F.col(c) - prev(c)) / F.col("_dt")
            skip = F.col("_new_session") if c in limits.session_scoped else F.lit(False)
            marked = marked.withColumn(f"_jump_{c}", F.coalesce((rate > limits.jump_rates[c]) & ~F.isnan(rate) & ~skip, F.lit(False)))
            flags.append(_flag("jump", c, F.col(f"_jump_{c}"), F.col(c)))
    kind = "array<struct<kind:string,field:string,detail:string>>"
    return marked.withColumn("flags", F.array_compact(F.array(*flags)).cast(kind)).select(*rows.columns, "flags")


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("flags").alias("f")).groupBy(F.col("f.kind").alias("kind"), F.col("f.field").alias("field")).agg(F.count("*").alias("n"))


def rows_of_hours(rows: DataFrame, dirty: DataFrame) -> DataFrame:
    """All rows of the dirty device-hours, in one semi join."""
    return rows.withColumn("event_hour", event_hour(F.col("device_ts_ms"))).join(dirty, ["device_id", "event_hour"], "left_semi")


@dataclass(frozen=True)
class Recompute:
    """What a recompute of dirty device-hours gives: canonical rows (with event_hour), rows with errors, and of every
    dirty key, also those without rows, rows_seen, rows_recomputed and rows_failed."""

    rows: DataFrame
    failed: DataFrame
    per_key: DataFrame


def recompute(rows: DataFrame, dirty: DataFrame, catalog: dict[tuple[str, str], list[Signal]], keep: tuple[str, ...] = (), present: dict[str, frozenset[str]] | None = None) -> Recompute:
    """All stored rows of each dirty hour canonicalised anew; a refused cast fails its row alone."""
    hour = ["device_id", "event_hour"]
    canonical = canonicalize_mixed(rows_of_hours(rows, dirty), catalog, (*keep, "event_hour"), present)
    ok, failed = split_failed(canonical)
    good = F.size("errors") == 0
    counts = canonical.groupBy(*hour).agg(F.count("*").alias("rows_seen"), F.count_if(good).alias("rows_recomputed"), F.count_if(~good).alias("rows_failed"))
    none = {c: F.coalesce(c, F.lit(0)) for c in ("rows_seen", "rows_recomputed", "rows_failed")}
    return Recompute(ok, failed, dirty.select(*hour).join(counts, hour, "left").withColumns(none))


def signals_of_pair(catalog: dict[tuple[str, str], list[Signal]], device_class: str, firmware: str) -> list[Signal]:
    """The entries of a class and firmware; none where the catalog has no such pair, so nothing can be checked."""
    return catalog.get((device_class, firmware), [])


def flag_mixed(rows: DataFrame, catalog: dict[tuple[str, str], list[Signal]], order: list[str], limits: Thresholds = DEFAULTS) -> DataFrame:
    """flag_rows over devices of any class and firmware, each by its own entries; as many rows as came.

    Pairs with the same entries share a pass. A device that changes its firmware is taken apart by it, as its
    signals may differ."""
    groups: dict[tuple[Signal, ...], list[tuple[str, str]]] = {}
    for pair, signals in catalog.items():
        groups.setdefault(tuple(signals), []).append(pair)
    pair = F.struct(F.col("device_class").alias("c"), F.col("firmware_version").alias("f"))
    among = lambda pairs: F.coalesce(pair.isin(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in pairs]), F.lit(False))
    parts = [flag_rows(rows.where(among(pairs)), list(signals), order, limits) for signals, pairs in groups.items()]
    unknown = rows.where(~among(list(catalog))) if catalog else rows
    out = unknown.withColumn("flags", F.array().cast("array<struct<kind:string,field:string,detail:string>>"))
    for part in parts:
        out = out.unionByName(part)
    return out
