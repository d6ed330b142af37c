"""Structured Streaming: landing of envelopes and the merge of readings, each micro-batch idempotent.

The checkpoint is the spool: a batch whose sink fails is replayed from its offsets when the query starts again. A ledger
notes what each batch accepted before its delivery and what was delivered after, so a snapshot adds up at any time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stage1 import Registry, check_timestamps, parse_messages
from ..operators.stores import Stage1Store
from ..scratch import get_json, names, put_json
from ..sources.landing import land, parse_raw, reconcile, reject_reason

Sink = Callable[[DataFrame], None]


def landing_sink(path: str) -> Sink:
    return lambda frame: reconcile(land(frame, path))


class Ledger:
    """Counts by batch, each a small file that is there whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def accepted(self, batch_id: int, counts: dict[str, int]) -> None:
        at = f"{self.root}/accepted/{batch_id}"
        attempts = get_json(self.spark, at)["attempts"] if str(batch_id) in names(self.spark, f"{self.root}/accepted") else 0
        put_json(self.spark, at, counts | {"attempts": attempts + 1})

    def delivered(self, batch_id: int, n: int) -> None:
        put_json(self.spark, f"{self.root}/delivered/{batch_id}", {"delivered": n})

    def snapshot(self) -> dict[str, int]:
        """accepted, rejected, delivered, pending (of batches that aren't delivered) and attempts, as of now."""
        taken = {b: get_json(self.spark, f"{self.root}/accepted/{b}") for b in names(self.spark, f"{self.root}/accepted")}
        done = {b: get_json(self.spark, f"{self.root}/delivered/{b}")["delivered"] for b in names(self.spark, f"{self.root}/delivered")}
        out = {k: sum(t[k] for t in taken.values()) for k in ("accepted", "rejected", "attempts")}
        return out | {"delivered": sum(done.values()), "pending": sum(t["accepted"] for b, t in taken.items() if b not in done)}

    def reconciles(self) -> bool:
        s = self.snapshot()
        return s["accepted"] == s["delivered"] + s["pending"]


def ingest_batch(raw: DataFrame, sink: Sink, rejects: str | None = None, ledger: Ledger | None = None, batch_id: int = 0) -> dict[str, int]:
    """Validate, hand the accepted on, keep the rejected with their reason."""
    parsed = parse_raw(raw)
    judged = parsed.withColumn("reason", reject_reason(parsed)).persist()
    try:
        accepted, rejected = judged.where("reason is null").drop("reason"), judged.where("reason is not null")
        counts = {"accepted": accepted.count(), "rejected": rejected.count()}
        if ledger:
            ledger.accepted(batch_id, counts)
        if rejects and counts["rejected"]:
            rejected.select("raw", "reason").write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        sink(accepted)
        if ledger:
            ledger.delivered(batch_id, counts["accepted"])
        return counts
    finally:
        judged.unpersist()


def ingest_stream(spark: SparkSession, source: str, checkpoint: str, sink: Sink, rejects: str | None = None, files_per_batch: int = 200, ledger: Ledger | None = None):
    """A started query over the text files in ``source``; it ends when all there is has been handed on."""
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(source).withColumnRenamed("value", "raw")
    step = lambda frame, batch_id: (ingest_batch(frame, sink, rejects, ledger, batch_id), None)[1]
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(start: Callable[[], object], max_rounds: int = 1000) -> int:
    """Start the query again until a round ends without an error; how many rounds failed."""
    for failed in range(max_rounds):
        try:
            start().awaitTermination()
            return failed
        except Exception:  # noqa: BLE001  the sink's own errors; the last round's is raised
            if failed == max_rounds - 1:
                raise
    return max_rounds


def merge_batch(batch: DataFrame, batch_id: int, store: Stage1Store, registry: Registry, quarantine: str, order: list[str]) -> dict[str, int]:
    """Parse -> sanity -> merge with dirty keys. What is refused is kept with its reason: messages and rows, by batch."""
    batch = batch.persist()
    try:
        rows, refused = parse_messages(batch, registry)
        good, bad = check_timestamps(rows)
        refused.write.mode("overwrite").parquet(f"{quarantine}/messages/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{quarantine}/rows/batch={batch_id}")
        return store.merge(batch_id, good, order)
    finally:
        batch.unpersist()


def merge_stream(spark: SparkSession, landed: str, checkpoint: str, store: Stage1Store, registry: Registry, schema, quarantine: str):
    """merge_batch for each micro-batch of landed messages."""
    step = lambda batch, batch_id: (merge_batch(batch, batch_id, store, registry, quarantine, ["arrival_ts_ms", "message_id", "at"]), None)[1]
    stream = spark.readStream.schema(schema).parquet(landed)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quarantined(spark: SparkSession, quarantine: str) -> DataFrame:
    """kind (message or row), reason and how many, over all batches."""
    count = lambda folder, kind: spark.read.parquet(f"{quarantine}/{folder}").groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "reason", "n")
    return count("messages", "message").unionByName(count("rows", "row"))
