"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder under spark.checkpoint.dir. Only a session of one machine may leave that unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = f"file://{tempfile.gettempdir()}/tidegrid-shared"
    return f"{base.rstrip('/')}/tidegrid"


def file_system(spark: SparkSession, path: str):
    """Hadoop's Path of ``path`` and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. It goes with the session at the latest."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = file_system(df.sparkSession, path)
    fs.deleteOnExit(p)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            p, fs = file_system(df.sparkSession, f)
            folder = p.getParent()
            if folder.getParent().getName() == "tidegrid":
                fs.delete(folder, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, in order; nothing if there is no such folder."""
    p, fs = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def put_json(spark: SparkSession, path: str, value: object) -> None:
    """A small file, there whole or not at all: it is written under another name, then renamed."""
    p, fs = file_system(spark, path)
    draft = p.getParent().suffix(f"-draft-{uuid.uuid4().hex}")  # beside the folder, so listings of it don't meet drafts
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    out.close()
    fs.mkdirs(p.getParent())
    fs.delete(p, False)
    fs.rename(draft, p)


def get_json(spark: SparkSession, path: str) -> dict:
    p, fs = file_system(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
