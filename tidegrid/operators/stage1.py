"""Parsing, timestamp sanity, idempotent merge and dirty keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import device_bucket, event_date, event_hour, utc
from ..model import CABINET, CABINET_READING, DEFAULTS, NATURAL_KEY, STALL, STALL_READING

STAMPED = ("device_id", "device_class", "firmware_version", "site_id", "arrival_ts_ms")
#: A message's readings, one row each, with at: the place in the message.
Parser = Callable[[DataFrame], DataFrame]
Registry = dict[tuple[str, str], Parser]


class DuplicateParserError(ValueError):
    pass


def register(registry: Registry, device_class: str, firmware: str, parser: Parser) -> None:
    if (device_class, firmware) in registry:
        raise DuplicateParserError(f"{device_class} {firmware}")
    registry[device_class, firmware] = parser


def registered(registry: Registry) -> list[tuple[str, str]]:
    return sorted(registry)


def reading_parser(schema: str) -> Parser:
    """Readings are JSON texts. error is set on all rows of a message of which any reading lacks a field."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def parse(messages: DataFrame) -> DataFrame:
        def lacks(reading: Column) -> Column:
            keys = F.json_object_keys(reading)
            return keys.isNull() | (F.size(F.array_intersect(keys, F.array(*[F.lit(f) for f in fields]))) < len(fields))

        error = F.when(F.exists("readings", lacks), F.lit("parser_error: a reading lacks a field"))
        rows = messages.withColumn("error", error).select("message_id", *STAMPED, "error", F.posexplode("readings").alias("at", "reading"))
        return rows.withColumn("r", F.from_json("reading", schema)).select("message_id", *STAMPED, "error", "at", "r.*")

    return parse


def default_registry() -> Registry:
    out: Registry = {}
    for firmware in ("2.1.4", "2.3.0", "3.0.1"):
        register(out, STALL, firmware, reading_parser(STALL_READING))
    for firmware in ("1.8.2", "1.9.0"):
        register(out, CABINET, firmware, reading_parser(CABINET_READING))
    return out


def parse_messages(messages: DataFrame, registry: Registry) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined): rows of all parsers; whole messages with a reason where none is registered or one fails.

    One pass over the messages for each parser; firmware of one parser share it."""
    by_parser: dict[int, tuple[Parser, list[tuple[str, str]]]] = {}
    for key, parser in registry.items():
        by_parser.setdefault(id(parser), (parser, []))[1].append(key)
    pair = F.struct(F.col("device_class").alias("c"), F.col("firmware_version").alias("f"))

    def among(keys: list[tuple[str, str]]) -> Column:
        return F.coalesce(pair.isin(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in keys]), F.lit(False)) if keys else F.lit(False)

    every = None
    for parser, keys in by_parser.values():
        rows = parser(messages.where(among(keys)))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    unknown = messages.where(~among(list(registry))).select("message_id", F.concat(F.lit("no_parser_registered_for_("), F.coalesce("device_class", F.lit("null")), F.lit(", "), F.coalesce("firmware_version", F.lit("null")), F.lit(")")).alias("reason"))
    if every is None:
        raise ValueError("no parser is registered")
    failed = every.where("error is not null").select("message_id", F.col("error").alias("reason")).distinct()
    return every.where("error is null").drop("error"), unknown.unionByName(failed)


def timestamp_reason(ts: Column, arrival: Column, future_ms: int = DEFAULTS.future_ms) -> Column:
    """The first rule that a reading's time breaks, null if none."""
    return F.when(ts.isNull(), "missing_timestamp").when(ts == 0, "epoch_default_timestamp").when(ts - arrival > future_ms, "future_timestamp")


def check_timestamps(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with reason)."""
    judged = rows.withColumn("reason", timestamp_reason(F.col("device_ts_ms"), F.col("arrival_ts_ms")))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def partition_columns(rows: DataFrame) -> DataFrame:
    ts = F.col("device_ts_ms")
    return rows.withColumns({"event_date": event_date(ts), "hour": utc(ts, "HH"), "device_bucket": device_bucket(F.col("device_id"))})


def first_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of rows with one natural key (null equals null) the first by ``order``; partial aggregation before the shuffle."""
    others = [c for c in rows.columns if c not in NATURAL_KEY]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("v")
    return rows.groupBy(*NATURAL_KEY).agg(first).select(*NATURAL_KEY, "v.*").select(*rows.columns)


def new_rows(batch: DataFrame, store: DataFrame, order: list[str]) -> DataFrame:
    """What a merge inserts: first of each key in the batch, unless the store has it."""
    fresh = first_rows(batch, order)
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}")) for k in NATURAL_KEY]
    return fresh.alias("b").join(store.select(*NATURAL_KEY).alias("s"), same, "left_anti")


def device_hours(rows: DataFrame) -> DataFrame:
    return rows.select("device_id", event_hour(F.col("device_ts_ms")).alias("event_hour")).distinct()


def dirty_hours(inserted: DataFrame, store_before: DataFrame) -> DataFrame:
    """Hours that the merge added to and that had rows before it."""
    return device_hours(inserted).join(device_hours(store_before), ["device_id", "event_hour"], "left_semi")


class ReconciliationError(RuntimeError):
    pass


def reconcile(seen: DataFrame, *outcomes: DataFrame, of: str = "rows") -> dict[str, int]:
    """Counts what went in and what came out on each way, each on its own; raises unless they add up.

    ``of``: rows, or a column whose distinct values count (message_id for messages that become several rows)."""
    count = lambda frame: frame.count() if of == "rows" else frame.select(of).distinct().count()
    counts = {"seen": count(seen)} | {f"outcome_{k}": count(frame) for k, frame in enumerate(outcomes)}
    if counts["seen"] != sum(v for k, v in counts.items() if k != "seen"):
        raise ReconciliationError(str(counts))
    return counts
