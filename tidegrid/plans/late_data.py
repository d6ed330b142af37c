"""Late batch to targeted recompute: the composition of Stage 1 to Stage 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hour_range_start
from ..model import Signal
from ..operators.stage1 import check_timestamps, dirty_hours, first_rows, new_rows
from ..operators.stage2 import Recompute, canonicalize_mixed, recompute, split_failed
from ..operators.stage3 import build_grid, day_buckets, device_days, dirty_days, hour_spans, mode, rows_of_days
from ..operators.stores import Stage1Store
from ..scratch import get_json, materialize, names, put_json

ORDER = ["arrival_ts_ms", "message_id", "event_id"]
Catalog = dict[tuple[str, str], list[Signal]]


def merged(first: DataFrame, late: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows after both merges, dirty hours) of two batches that passed sanity, each merge written once."""
    order = order or ORDER
    store = materialize(first_rows(first, order), "store")
    fresh = materialize(new_rows(late, store, order), "fresh")
    return store.unionByName(fresh), dirty_hours(fresh, store)


def merged_rows(first: DataFrame, late: DataFrame, order: list[str] | None = None) -> DataFrame:
    """All rows after both merges, without the dirty hours: one pass, nothing written."""
    order = order or ORDER
    store = first_rows(first, order)
    return store.unionByName(new_rows(late, store, order))


def accepted(readings: DataFrame) -> DataFrame:
    return check_timestamps(readings)[0]


def with_mode(rows: DataFrame) -> DataFrame:
    """Canonical rows with their mode, by what the class reports."""
    field = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    return rows.withColumn("mode", mode(F.col("device_class"), field("session_state", "string"), field("contactor_closed", "boolean")))


def rebuilt_grid(result: Recompute, order: list[str]) -> DataFrame:
    """A full grid for each dirty hour with canonical rows. Where there are none, no class is known, and there is no grid."""
    rows = with_mode(result.rows)
    classes = rows.groupBy("device_id", "event_hour").agg(F.min("device_class").alias("device_class"))
    return build_grid(hour_spans(classes), rows, order)


def rebuilt_hours(result: Recompute, grid: DataFrame) -> DataFrame:
    """Every dirty hour, also those without a grid: device_class, rows_seen, rows_failed, buckets and measured ones."""
    start = hour_range_start(F.col("event_hour")).alias("range_start_ms")
    built = grid.groupBy("device_id", "range_start_ms").agg(F.min("device_class").alias("device_class"), F.count("*").alias("buckets"), F.count_if(F.col("coverage") == "measured").alias("measured"))
    keys = result.per_key.select("device_id", "event_hour", "rows_seen", "rows_failed", start)
    return keys.join(built, ["device_id", "range_start_ms"], "left").select("device_id", "event_hour", "device_class", "rows_seen", "rows_failed", F.coalesce("buckets", F.lit(0)).alias("buckets"), F.coalesce("measured", F.lit(0)).alias("measured"))


def rebuilt_days(rows: DataFrame, dirty: DataFrame, catalog: Catalog, order: list[str], keep: tuple[str, ...] = (), present: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """Of each day with a dirty hour, the features of the whole day from Stage 1's rows, canonicalised anew; with
    dirty_hours, rows_seen and rows_failed. A day without canonical rows has no class and no features."""
    days = dirty_days(dirty)
    canonical = canonicalize_mixed(rows_of_days(rows, days), catalog, (*keep, "event_day"), present)
    counts = canonical.groupBy("device_id", "event_day").agg(F.count("*").alias("rows_seen"), F.count_if(F.size("errors") > 0).alias("rows_failed"))
    features = device_days(day_buckets(with_mode(split_failed(canonical)[0]), order))
    day = F.date_format(F.timestamp_millis("day_start_ms"), "yyyy-MM-dd").alias("event_day")
    features = features.select("*", day).drop("day_start_ms")
    out = days.join(counts, ["device_id", "event_day"], "left").join(features, ["device_id", "event_day"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows_seen", "rows_failed")})


class Stage2Output:
    """Canonical rows by recompute: each writes all rows of its device-hours, and an hour's newest recompute counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def run(self, store: Stage1Store, catalog: Catalog, consumer: str = "stage2", keep: tuple[str, ...] = ()) -> dict[str, int]:
        """Recompute what is dirty for the consumer and acknowledge exactly that, failed casts or not. A run that stops
        before its marker has acknowledged nothing and is done again."""
        dirty, upto = store.dirty(consumer)
        rows = store.rows()
        if rows is None or upto <= store.acknowledged(consumer):
            return {"device_hours": 0, "rows_seen": 0, "rows_recomputed": 0, "rows_failed": 0}
        dirty = materialize(dirty, "dirty")
        result = recompute(rows, dirty, catalog, keep)
        at = f"{self.root}/run={upto}"
        result.rows.write.mode("overwrite").parquet(f"{at}/rows")
        result.failed.write.mode("overwrite").parquet(f"{at}/failed")
        result.per_key.write.mode("overwrite").parquet(f"{at}/keys")
        keys = self.spark.read.schema(result.per_key.schema).parquet(f"{at}/keys")
        total = keys.agg(F.count("*").alias("device_hours"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows_seen", "rows_recomputed", "rows_failed")]).first().asDict()
        put_json(self.spark, f"{self.root}/runs/{upto}", total)
        store.acknowledge(upto, consumer)
        return total

    def rows(self) -> DataFrame | None:
        """The canonical rows of each device-hour by its newest recompute."""
        runs = sorted((int(x) for x in names(self.spark, f"{self.root}/runs")))
        if not runs:
            return None
        every, keys = None, None
        for r in runs:
            rows = self.spark.read.parquet(f"{self.root}/run={r}/rows").withColumn("_run", F.lit(r))
            key = self.spark.read.parquet(f"{self.root}/run={r}/keys").select("device_id", "event_hour", F.lit(r).alias("_run"))
            every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
            keys = key if keys is None else keys.unionByName(key)
        newest = keys.groupBy("device_id", "event_hour").agg(F.max("_run").alias("_run"))
        return every.join(newest, ["device_id", "event_hour", "_run"], "left_semi").drop("_run")

    def counts(self) -> list[dict]:
        return [get_json(self.spark, f"{self.root}/runs/{r}") for r in names(self.spark, f"{self.root}/runs")]
