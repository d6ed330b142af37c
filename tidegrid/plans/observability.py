"""Metrics of the pipeline, the watchdog over them, and mediated reads of restricted tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DEFAULTS
from .stage4 import freshness, suppressed


def freshness_metrics(feeds: dict[str, tuple[DataFrame, str]], now_ms: int) -> DataFrame:
    """metric, feed, value: age in ms of each feed's latest row (null if it has none). One pass a feed, over one column."""
    parts = [freshness(frame.select(ts), ts, now_ms).select(F.lit("freshness_ms").alias("metric"), F.lit(name).alias("feed"), F.col("age_ms").cast("double").alias("value")) for name, (frame, ts) in feeds.items()]
    return reduce(DataFrame.unionByName, parts)


def completeness_metric(hours: DataFrame, feed: str) -> DataFrame:
    """hours: what stage4.completeness returns. Share of expected readings that came, at most all of each hour."""
    share = F.try_divide(F.sum(F.least(F.col("on_time") + F.col("late"), F.col("expected"))), F.sum("expected"))
    return hours.agg(share.cast("double").alias("value")).select(F.lit("completeness").alias("metric"), F.lit(feed).alias("feed"), "value")


def cost_metrics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Bytes and files under each path, as the file system counts them; a path that isn't there has none."""
    rows = []
    for name, path in paths.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        s = fs.getContentSummary(p) if fs.exists(p) else None
        rows += [("cost_bytes", name, float(s.getLength()) if s else 0.0), ("cost_files", name, float(s.getFileCount()) if s else 0.0)]
    return spark.createDataFrame(rows, "metric string, feed string, value double")


def watchdog(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """limits: metric, feed, least, most (null: none). Each limit's status: ok, breached, or missing if nobody wrote it.

    It reads the metrics table alone, so it can run apart from what writes it."""
    j = limits.join(metrics.select("metric", "feed", "value"), ["metric", "feed"], "left")
    out = F.coalesce(F.col("value") < F.col("least"), F.lit(False)) | F.coalesce(F.col("value") > F.col("most"), F.lit(False))
    return j.select("metric", "feed", "value", F.when(F.col("value").isNull(), "missing").when(out, "breached").otherwise("ok").alias("status"))


class MediatedHistory:
    """The device history behind suppressed aggregates: no method returns its rows, and each read is logged first."""

    def __init__(self, history: DataFrame, log: str, entity: str = "device_id", floor: int = DEFAULTS.suppression_floor):
        self._history, self._log, self._entity, self._floor = history, log, entity, floor

    def read(self, who: str, justification: str, fine: list[str], coarse: list[str], value: str) -> DataFrame:
        if not who.strip() or not justification.strip():
            raise PermissionError("a read needs a name and a justification")
        if self._entity in [*fine, *coarse]:
            raise PermissionError(f"{self._entity} is no key of an aggregate")
        row = self._history.sparkSession.createDataFrame([(who, justification, ",".join(fine), value)], "who string, justification string, keys string, value string")
        row.withColumn("read_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self._log)
        return suppressed(self._history, fine, coarse, self._entity, value, self._floor)
