"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize, shared_dir

__all__ = ["columns", "discard", "documents", "materialize", "runs", "shared_dir", "slices", "utf8"]

#: A Python worker expands at most about this much text at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that others can't clash with what an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, n + 1, from 0) and bytes of a string or binary column; null as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    if not len(arr):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; rows are never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, min(int(np.searchsorted(ends, base + limit, "right")), at + 4096))
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key runs from batches that are sorted by ``keys``: a run is never split between tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for k in ks:
            change[1:] |= k[1:] != k[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != v[0] for k, v in zip(keys, ks, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        last = np.flatnonzero(change)
        if len(last):
            yield pa.Table.from_batches([*held, batch.slice(0, int(last[-1]))])
            held = [batch.slice(int(last[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
