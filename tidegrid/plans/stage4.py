"""Operators that are specified in prose only: health, cohorts, findings, marts, survival."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import HOUR_MS, event_hour, ratio
from ..model import DEFAULTS
from ..operators.quantiles import percentiles
from ..scratch import materialize, names, remove


def freshness(feed: DataFrame, ts: str, now_ms: int) -> DataFrame:
    return feed.agg(F.max(ts).alias("latest_ms"), F.count("*").alias("n_rows")).withColumn("age_ms", F.lit(now_ms) - F.col("latest_ms"))


def completeness(rows: DataFrame, expected_per_hour: Column | int, late_ms: int) -> DataFrame:
    """Each device-hour from a device's first to its last: expected, on time, late and missing (not yet seen)."""
    hour = (F.col("device_ts_ms") / HOUR_MS).cast("long")
    late = F.col("arrival_ts_ms") - F.col("device_ts_ms") > late_ms
    seen = rows.groupBy("device_id", hour.alias("h")).agg(F.count_if(~late).alias("on_time"), F.count_if(late).alias("late"))
    spine = seen.groupBy("device_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).select("device_id", F.explode(F.sequence("a", "b")).alias("h"))
    g = spine.join(seen, ["device_id", "h"], "left").fillna(0, ["on_time", "late"])
    want = F.lit(expected_per_hour) if isinstance(expected_per_hour, int) else expected_per_hour
    return g.select("device_id", event_hour(F.col("h") * HOUR_MS).alias("event_hour"), want.cast("long").alias("expected"), "on_time", "late", F.greatest(want - F.col("on_time") - F.col("late"), F.lit(0)).cast("long").alias("missing"))


def silence_episodes(rows: DataFrame, threshold_ms: int = DEFAULTS.silence_ms, now_ms: int | None = None) -> DataFrame:
    """Spans of more than the threshold without a reading; the last is open if now_ms is given and reaches so far."""
    w = W.partitionBy("device_id").orderBy("device_ts_ms")
    nxt = F.lead("device_ts_ms").over(w)
    g = rows.select("device_id", "device_ts_ms").distinct().withColumn("closed_ms", nxt)
    until = F.coalesce("closed_ms", F.lit(now_ms).cast("long"))
    return g.where(until - F.col("device_ts_ms") > threshold_ms).select("device_id", F.col("device_ts_ms").alias("opened_ms"), "closed_ms", F.lit("unknown").alias("cause"))


def last_seen(rows: DataFrame, by: tuple[str, ...] = ("device_id",)) -> DataFrame:
    return rows.groupBy(*by).agg(F.max("device_ts_ms").alias("last_seen_ms"))


def dropout(last: DataFrame, cohort: str, now_ms: int, threshold_ms: int, correlated_share: float = 0.5) -> DataFrame:
    """Silent devices of each cohort, correlated if at least the share of the cohort is silent."""
    g = last.groupBy(cohort).agg(F.count("*").alias("devices"), F.count_if(F.lit(now_ms) - F.col("last_seen_ms") > threshold_ms).alias("silent"))
    share = F.col("silent") / F.col("devices")
    return g.withColumns({"silent_share": F.round(share, 6), "kind": F.when(F.col("silent") == 0, "none").when(share >= correlated_share, "correlated").otherwise("isolated")})


def new_findings(findings: DataFrame, stored: DataFrame | None, content: list[str]) -> DataFrame:
    """Findings with the hash of their content, without those that are stored and without repeats."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in content]), 256)
    fresh = findings.withColumn("finding_id", h).dropDuplicates(["finding_id"])
    return fresh if stored is None else fresh.join(stored.select("finding_id"), "finding_id", "left_anti")


def session_failures(rows: DataFrame, state: str = "session_state", session: tuple[str, ...] = ("device_id", "session_id")) -> DataFrame:
    """Sessions whose last reading is a fault that no later reading resolved. Readings without a session don't count."""
    last = F.max_by(state, F.struct("device_ts_ms", "event_id")).alias("last_state")
    return rows.where(F.col(session[-1]).isNotNull()).groupBy(*session).agg(last, F.count_if(F.col(state) == "fault").alias("faults")).where("last_state = 'fault'")


def hour_status(hours: DataFrame, now_ms: int, horizon_ms: int = DEFAULTS.lateness_horizon_ms) -> DataFrame:
    """hours: device_id, event_hour, hour_end_ms. final what is past the horizon, inclusive; provisional otherwise."""
    final = F.col("hour_end_ms") + horizon_ms <= now_ms
    return hours.select("device_id", "event_hour", F.when(final, "final").otherwise("provisional").alias("status"))


def new_versions(state: DataFrame, stored: DataFrame | None) -> DataFrame:
    """device_id, event_hour, status, version: rows to append, as stored ones stay as they are. Version 1 of what is new, and
    the next version of a provisional hour that is final now; final ones change no more, so a second run appends nothing."""
    if stored is None:
        return state.select("device_id", "event_hour", "status", F.lit(1).cast("long").alias("version"))
    old = latest_version(stored).withColumnsRenamed({"status": "_status", "version": "_version"})
    j = state.join(old, ["device_id", "event_hour"], "left")
    changed = F.col("_status").isNull() | ((F.col("_status") == "provisional") & (F.col("status") == "final"))
    return j.where(changed).select("device_id", "event_hour", "status", (F.coalesce("_version", F.lit(0)) + 1).cast("long").alias("version"))


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("device_id", "event_hour").agg(F.max_by("status", "version").alias("status"), F.max("version").alias("version"))


#: Cohorts up to this number are broadcast to the facts; beyond, both are shuffled by cohort.
COHORTS = 100_000


def _by_cohort(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(stats) if stats.count() <= COHORTS else stats, keys)


def cohort_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys, median, n and mad (the median of the distances from the median), exact; no task holds a cohort."""
    v = F.col(value).cast("double")
    med = materialize(percentiles(rows.where(F.expr(" and ".join(f"`{k}` is not null" for k in keys))), keys, v, [0.5]).select(*keys, "n", F.col("p")[0].alias("median")), "medians")
    mad = percentiles(_by_cohort(rows, med.select(*keys, "median"), keys), keys, F.abs(v - F.col("median")), [0.5])
    return med.join(mad.select(*keys, F.col("p")[0].alias("mad")), keys)


def robust_outliers(rows: DataFrame, keys: list[str], value: str, limit: float = 3.5) -> DataFrame:
    z = F.try_divide(0.6745 * (F.col(value) - F.col("median")), F.nullif(F.col("mad"), F.lit(0.0)))
    return _by_cohort(rows, materialize(cohort_stats(rows, keys, value), "cohorts"), keys).withColumn("z", z).where(F.abs("z") > limit)


def suppressed(rows: DataFrame, fine: list[str], coarse: list[str], entity: str, value: str, floor: int = DEFAULTS.suppression_floor) -> DataFrame:
    """Cohort means with at least ``floor`` distinct entities; what falls short is shown at the coarser level, if that is large enough."""
    agg = [F.countDistinct(entity).alias("entities"), F.round(F.avg(value), 6).alias("mean_value")]
    f = rows.groupBy(*fine).agg(*agg)
    small = f.where(F.col("entities") < floor).select(*fine)
    c = rows.join(small, fine, "left_semi").groupBy(*coarse).agg(*agg).where(F.col("entities") >= floor)
    shown = f.where(F.col("entities") >= floor)
    for k in fine:
        if k not in coarse:
            c = c.withColumn(k, F.lit(None).cast("string"))
    return shown.unionByName(c.select(*shown.columns))


@dataclass(frozen=True)
class Retention:
    """How long rows, features and the linkage of a device to its customer are kept."""

    rows_months: int = 13
    features_months: int = 24
    linkage_days: int = 90

    def cutoff(self, kind: str, now: Column) -> Column:
        """The first time that is kept of a kind: rows, features or linkage. now: a timestamp."""
        if kind == "linkage":
            return now - F.expr(f"INTERVAL {self.linkage_days} DAYS")
        return F.add_months(now, -{"rows": self.rows_months, "features": self.features_months}[kind]).cast("timestamp")


def retained(rows: DataFrame, ts: str, now_ms: int, kind: str, policy: Retention = Retention()) -> DataFrame:  # noqa: B008
    """Rows whose time (ms) isn't before the kind's cutoff."""
    return rows.where(F.timestamp_millis(F.col(ts)) >= policy.cutoff(kind, F.timestamp_millis(F.lit(now_ms))))


def drop_expired(spark: SparkSession, root: str, first_kept: str, column: str = "event_date") -> list[str]:
    """Remove whole partitions of days before ``first_kept`` (yyyy-MM-dd) under a table's root; which ones went."""
    prefix = f"{column}="
    gone = [n for n in names(spark, root) if n.startswith(prefix) and n[len(prefix) :] < first_kept]
    for n in gone:
        remove(spark, f"{root}/{n}")
    return gone


def mart(features: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by all keys, their prefixes, and overall."""
    return features.rollup(*keys).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("device_days"), F.sum("reading_total").alias("readings"), F.round(F.avg("coverage_ratio"), 6).alias("mean_coverage"))


def device_snapshot(rows: DataFrame, order: tuple[str, ...] = ("device_ts_ms", "event_id")) -> DataFrame:
    """One row a device: its newest reading."""
    others = [c for c in rows.columns if c != "device_id"]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("v")
    return rows.groupBy("device_id").agg(newest).select("device_id", "v.*")


def survival(lives: DataFrame, cohort: str) -> DataFrame:
    """Kaplan-Meier of (cohort, duration, failed): at_risk, failures and the share that survives each failure time."""
    t = lives.groupBy(cohort, "duration").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    later = W.partitionBy(cohort).orderBy(F.desc("duration")).rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("at_risk", F.sum("n").over(later))
    # a product as a sum of logarithms; none survives a time at which all at risk fail
    step = F.when(F.col("failures") < F.col("at_risk"), F.log(1 - F.col("failures") / F.col("at_risk")))
    earlier = W.partitionBy(cohort).orderBy("duration").rowsBetween(W.unboundedPreceding, 0)
    dead = F.max((F.col("failures") >= F.col("at_risk")).cast("int")).over(earlier)
    t = t.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.round(F.exp(F.sum(step).over(earlier)), 6)))
    return t.where("failures > 0").select(cohort, "duration", "at_risk", "failures", "survival")


def replay_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks; empty if a replay gave the same."""
    b = b.select(*a.columns)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def backtest(findings: DataFrame, cases: DataFrame, horizon_ms: int) -> DataFrame:
    """Each finding's next case of the device within the horizon: hit and lead time."""
    c = cases.select(F.col("device_id").alias("_d"), "opened_ms")
    near = findings.join(c, (F.col("device_id") == F.col("_d")) & (F.col("opened_ms") >= F.col("found_ms")) & (F.col("opened_ms") <= F.col("found_ms") + horizon_ms), "left")
    g = near.groupBy("device_id", "found_ms").agg(F.min("opened_ms").alias("case_ms"))
    return g.agg(F.count("*").alias("findings"), F.count("case_ms").alias("hits"), ratio(F.count("case_ms"), F.count("*")).alias("precision"), F.percentile((F.col("case_ms") - F.col("found_ms")) / HOUR_MS, F.lit(0.5)).alias("median_lead_h"))


def sessions(rows: DataFrame, session: tuple[str, ...] = ("device_id", "session_id")) -> DataFrame:
    """Sessions as the device names them, from their first to their last reading. Readings without a session don't count."""
    return rows.where(F.col(session[-1]).isNotNull()).groupBy(*session).agg(F.min("device_ts_ms").alias("start_ms"), F.max("device_ts_ms").alias("end_ms"), F.count("*").alias("readings"), F.min("site_id").alias("site_id"))


def overlaps(spans: DataFrame, windows: DataFrame, key: str, name: str, width_ms: int = 24 * HOUR_MS) -> DataFrame:
    """spans (start_ms, end_ms, both inclusive) with ``name``: how many windows (key, window_start, window_end; null end: goes
    on) of the same key they meet: those that begin by the span's end, less those that end by its start. Both are running
    counts within a time bucket, on top of all earlier buckets, so pairs are never made and no task holds a key. Each span
    counts for itself; one without a key or a time, or that ends before it starts, meets none."""
    s = materialize(spans.withColumn("_id", F.monotonically_increasing_id()), "spans")
    w = windows.where("window_end is null or window_end > window_start")

    def points(rows: DataFrame, begin: str, end: str, span: Column, n: int) -> DataFrame:
        both = F.array(F.struct(F.col(begin).alias("_t"), F.lit(1).alias("_sign")), F.struct(F.col(end).alias("_t"), F.lit(-1).alias("_sign")))
        return rows.select(F.col(key).alias("_k"), span.alias("_span"), F.lit(n).alias("_n"), F.inline(both)).where("_k is not null and _t is not null")

    asked = points(s, "end_ms", "start_ms", F.col("_id"), 0)
    every = asked.unionByName(points(w, "window_start", "window_end", F.lit(None).cast("long"), 1)).withColumn("_b", F.floor(F.col("_t") / width_ms))
    at = ["_k", "_sign", "_b"]
    earlier = W.partitionBy("_k", "_sign").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = every.groupBy(*at).agg(F.sum("_n").alias("_m")).select(*at, F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"))
    within = F.sum("_n").over(W.partitionBy(*at).orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow))
    counts = every.withColumn("_within", within).where("_span is not null").join(before, at).groupBy("_span").agg(F.sum(F.col("_sign") * (F.col("_before") + F.col("_within"))).alias("_met"))
    met = F.when(F.col("start_ms") <= F.col("end_ms"), F.coalesce("_met", F.lit(0))).otherwise(0)
    return s.join(counts, F.col("_id") == F.col("_span"), "left").select(*spans.columns, met.alias(name))


def event_table(rows: DataFrame, dispatch: DataFrame, outages: DataFrame) -> DataFrame:
    """Sessions with the dispatch windows of their device and the outages of their site that they meet."""
    return overlaps(overlaps(sessions(rows), dispatch, "device_id", "dispatches"), outages, "site_id", "outages")


def load_daily(feed: DataFrame, ts: str, path: str, day: str) -> int:
    """One day of a feed into its partition; loading it again replaces the day. How many rows it has."""
    rows = feed.where(F.date_format(F.timestamp_millis(F.col(ts)), "yyyy-MM-dd") == day)
    rows.write.mode("overwrite").parquet(f"{path}/load_date={day}")
    return feed.sparkSession.read.schema(rows.schema).parquet(f"{path}/load_date={day}").count()


def with_climate(history: DataFrame, climates: DataFrame, site: str = "site_id") -> DataFrame:
    """The device history with its site's climate, null where none is known: a placeholder by site."""
    return history.join(climates.select(site, "climate"), site, "left")


def tier(arrival: Column, now_ms: int, hot_days: int = 30) -> Column:
    """hot for what arrived within the last days, else cold."""
    return F.when(arrival >= now_ms - hot_days * 24 * HOUR_MS, "hot").otherwise("cold")


def compact_cold(landed: DataFrame, to: str, now_ms: int, hot_days: int = 30, partitions: tuple[str, ...] = ("arrival_date", "hour")) -> DataFrame:
    """Rewrites what has left the hot tier to another prefix; the table of hot rows as landed and cold ones as rewritten."""
    kind = tier(F.col("arrival_ts_ms"), now_ms, hot_days)
    compact(landed.where(kind == "cold"), to, list(partitions))
    cold = landed.sparkSession.read.schema(landed.schema).parquet(to)
    return landed.where(kind == "hot").unionByName(cold)


def compact(rows: DataFrame, to: str, partitions: list[str]) -> None:
    """Rewrite small files to another prefix, one shuffle by the partition columns."""
    rows.repartition(*partitions).write.mode("errorifexists").partitionBy(*partitions).parquet(to)
