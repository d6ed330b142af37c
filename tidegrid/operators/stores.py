"""The two stateful tables: Stage 1 and dirty keys, both Parquet under one root.

A merge writes its rows, partitioned as in production, then its dirty keys, then a commit marker; readers see committed
batches only, so a replayed or half-written batch neither loses a mark nor doubles a row. A marker holds the schema of its
rows, so no footers are read to find it. A merge reads no more of the store than the dates and device buckets of its batch:
both follow from the natural key, so what a row could repeat lies there. ``compact`` rewrites all committed batches as one
base; it counts once its own marker is there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..scratch import get_json, names, put_json, remove
from .stage1 import dirty_hours, new_rows, partition_columns

#: What rows are partitioned by, in this order.
LAYOUT = ("device_class", "event_date", "hour", "device_bucket")
#: Of these, what follows from the natural key alone.
FROM_KEY = ("event_date", "hour", "device_bucket")
HOUR = ["device_id", "event_hour"]


class Stage1Store:
    def __init__(self, spark: SparkSession, root: str, layout: tuple[str, ...] = LAYOUT):
        if not set(layout) <= set(LAYOUT):
            raise ValueError(f"a layout of {layout}")
        self.spark, self.root, self.layout = spark, root.rstrip("/"), layout

    def _list(self, folder: str) -> list[str]:
        return names(self.spark, f"{self.root}/{folder}")

    def _put(self, name: str, value: object) -> None:
        put_json(self.spark, f"{self.root}/{name}", value)

    def _get(self, name: str) -> dict:
        return get_json(self.spark, f"{self.root}/{name}")

    def committed(self) -> list[int]:
        return sorted(int(x) for x in self._list("commits"))

    def _base(self) -> dict:
        numbers = sorted(self._list("bases"), key=int)
        return self._get(f"bases/{numbers[-1]}") if numbers else {"folder": None, "batches": []}

    def _folders(self) -> dict[str, dict]:
        """The folders with the rows of all committed batches, and the schema of each."""
        base = self._base()
        out = {base["folder"]: base["schema"]} if base["folder"] else {}
        for b in self.committed():
            if b not in base["batches"]:
                marker = self._get(f"commits/{b}")
                out[marker["folder"]] = marker["schema"]
        return out

    def rows(self, where: Column | None = None) -> DataFrame | None:
        """All rows, with their batch_id and the layout's columns; null where an older batch has no such column."""
        folders = self._folders()
        if not folders:
            return None
        fields: dict[str, StructField] = {}
        for schema in folders.values():
            for f in StructType.fromJson(schema).fields:
                fields.setdefault(f.name, StructField(f.name, f.dataType))
        parts = [StructField(c, IntegerType() if c == "device_bucket" else StringType()) for c in self.layout]
        schema = StructType([f for f in fields.values() if f.name not in self.layout] + parts)
        reader = self.spark.read.schema(schema)
        every = None
        for folder in folders:
            part = reader.option("basePath", f"{self.root}/{folder}").parquet(f"{self.root}/{folder}")
            every = part if every is None else every.unionByName(part)
        return every if where is None else every.where(where)

    def get(self, device_id: str, device_ts_ms: int, payload_hash: str) -> DataFrame:
        """The row of a natural key, or none; of its partitions alone."""
        key = self.spark.createDataFrame([(device_id, device_ts_ms, payload_hash)], "device_id string, device_ts_ms long, payload_hash string")
        rows = self.rows(self._touched(partition_columns(key)))
        if rows is None:
            return key.limit(0)
        return rows.where(F.col("device_id").eqNullSafe(F.lit(device_id)) & F.col("device_ts_ms").eqNullSafe(F.lit(device_ts_ms)) & F.col("payload_hash").eqNullSafe(F.lit(payload_hash)))

    def __len__(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()

    def _touched(self, placed: DataFrame) -> Column:
        """A filter of partitions: the dates, hours and buckets that occur in ``placed``."""
        mine = [c for c in self.layout if c in FROM_KEY]
        if not mine:
            return F.lit(True)
        found = placed.agg(*[F.collect_set(c).alias(c) for c in mine], *[F.bool_or(F.col(c).isNull()).alias(f"no_{c}") for c in mine]).first()  # days, 24 hours and 16 buckets
        out = F.lit(True)
        for c in mine:
            some = F.col(c).isin(*sorted(found[c])) if found[c] else F.lit(False)
            out = out & ((some | F.col(c).isNull()) if found[f"no_{c}"] else some)
        return out

    def merge(self, batch_id: int, batch: DataFrame, order: list[str]) -> dict[str, int]:
        """batch: rows with a device_ts_ms (sanity has run). Idempotent by batch_id."""
        if batch_id in self.committed():
            return {"seen": 0, "inserted": 0, "present": 0}
        placed = partition_columns(batch).persist()
        try:
            seen, bad = placed.agg(F.count("*"), F.count_if(F.col("device_ts_ms").isNull())).first()
            if bad:
                raise ValueError("device_ts_ms is null; timestamp sanity comes first")
            before = self.rows(self._touched(placed)) if seen else None
            store = before if before is not None else placed.limit(0)
            fresh = new_rows(placed, store, order).withColumn("batch_id", F.lit(batch_id).cast("long"))
            folder = f"rows/batch={batch_id}"
            self._write(fresh.drop(*[c for c in LAYOUT if c not in self.layout and c not in batch.columns]), folder)
            schema = StructType([f for f in fresh.schema.fields if f.name in (*batch.columns, "batch_id") or f.name in self.layout])
            reader = self.spark.read.schema(StructType([f for f in schema.fields if f.name not in self.layout]))
            written = reader.parquet(f"{self.root}/{folder}")
            dirty_hours(written, store).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.root}/dirty/batch={batch_id}")
            inserted = written.count()
        finally:
            placed.unpersist()
        self._put(f"commits/{batch_id}", {"folder": folder, "schema": json.loads(schema.json())})
        return {"seen": seen, "inserted": inserted, "present": seen - inserted}

    def _write(self, rows: DataFrame, folder: str) -> None:
        writer = rows.hint("rebalance", *self.layout).write.mode("overwrite")
        (writer.partitionBy(*self.layout) if self.layout else writer).parquet(f"{self.root}/{folder}")

    def compact(self) -> int:
        """All committed batches as one base with large files; how many it holds. Replays stay no-ops, dirty keys stay."""
        folders, held = self._folders(), self.committed()
        rows = self.rows()
        if rows is None or len(folders) < 2:
            return len(held)
        folder = f"rows/base-{uuid.uuid4().hex}"
        self._write(rows, folder)
        number = 1 + max((int(x) for x in self._list("bases")), default=0)
        self._put(f"bases/{number}", {"folder": folder, "batches": held, "schema": json.loads(rows.schema.json())})
        for old in folders:
            remove(self.spark, f"{self.root}/{old}")
        return len(held)

    # Dirty keys: each consumer has its own place.

    def acknowledged(self, consumer: str) -> int:
        return max((int(x) for x in self._list(f"acks/{consumer}")), default=-1)

    def dirty(self, consumer: str = "all") -> tuple[DataFrame, int]:
        """Keys that the consumer has neither acknowledged nor cleared, and the batch up to which they reach."""
        done = self.acknowledged(consumer)
        ids = [b for b in self.committed() if b > done]
        if not ids:
            return self.spark.createDataFrame([], "device_id string, event_hour string"), done
        marked = self.spark.read.schema("device_id string, event_hour string, batch_id long").parquet(*[f"{self.root}/dirty/batch={b}" for b in ids])
        cleared = self._list(f"cleared/{consumer}")
        if cleared:
            gone = self.spark.read.schema("device_id string, event_hour string, upto long").parquet(*[f"{self.root}/cleared/{consumer}/{x}" for x in cleared])
            gone = gone.groupBy(*HOUR).agg(F.max("upto").alias("upto"))
            same = [F.col(f"m.{c}").eqNullSafe(F.col(f"g.{c}")) for c in HOUR]
            marked = marked.alias("m").join(gone.alias("g"), [*same, F.col("m.batch_id") <= F.col("g.upto")], "left_anti")
        return marked.select(*HOUR).distinct(), ids[-1]

    def clear(self, keys: DataFrame, upto: int, consumer: str = "all") -> None:
        """These keys alone, as marked up to a batch; later marks of them stay."""
        keys.select(*HOUR).distinct().withColumn("upto", F.lit(upto).cast("long")).write.parquet(f"{self.root}/cleared/{consumer}/{uuid.uuid4().hex}")

    def acknowledge(self, upto: int, consumer: str = "all") -> None:
        """All keys marked up to this batch."""
        self._put(f"acks/{consumer}/{upto}", {})
