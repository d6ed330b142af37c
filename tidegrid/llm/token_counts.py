"""Token counts as delta-maintained rollups.

A batch holds signed changes: an insert adds a document's count, a delete takes it back, a revision does both. Its sums
by source, language and tokenizer version are written under its id, then a commit marker; a batch that is committed
is not applied again, and one that failed halfway is overwritten. Totals are the sums of all committed batches; groups
without documents are left out. ``compact`` adds the committed deltas up into a base that names the batches it holds; a
base counts once its marker is there, and deltas go only then, so a failure at any point loses and doubles nothing.

A null count is 0; null sources and languages are groups of their own. Repeated changes count each time. Empty
batches commit and change nothing. Counting: a null text counts as an empty one, with no tokens; very long texts are
counted whole, one at a time; repeated rows have counts of their own; an empty table gives none. Other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import file_system
from . import bpe, tokenfiles
from .common import columns, slices, utf8

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _mark(self, name: str) -> None:
        p, fs = file_system(self.spark, f"{self.path}/{name}")
        fs.create(p, True).close()

    def _names(self, folder: str) -> list[str]:
        p, fs = file_system(self.spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def committed(self, batch_id: int) -> bool:
        p, fs = file_system(self.spark, f"{self.path}/commits/{batch_id}")
        return fs.exists(p)

    def apply(self, batch_id: int, changes: DataFrame) -> bool:
        """changes: source, lang, tokenizer_version, old_tokens, new_tokens, and times (1 if there is no such column): how
        many documents change so. Null old: an insert, null new: a delete."""
        if self.committed(batch_id):
            return False
        times = F.col("times") if "times" in changes.columns else F.lit(1)
        docs = F.col("new_tokens").isNotNull().cast("long") - F.col("old_tokens").isNotNull().cast("long")
        tokens = F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))
        delta = changes.groupBy(*KEYS).agg(F.sum(docs * times).alias("n_docs"), F.sum(tokens * times).alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")
        self._mark(f"commits/{batch_id}")
        return True

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest finished base and the batches it holds."""
        done = [n.split(".") for n in self._names("bases") if n.endswith(".done")]
        if not done:
            return None, set()
        name = max(done, key=lambda n: int(n[0]))[1]
        held = self.spark.read.schema("batch string").json(f"{self.path}/base-{name}/batches").collect()  # a row a batch
        return name, {r.batch for r in held}

    def _deltas(self) -> tuple[DataFrame, set[str], str | None]:
        name, held = self._base()
        fresh = sorted(set(self._names("commits")) - held)
        paths = ([f"{self.path}/base-{name}/sums"] if name else []) + [f"{self.path}/deltas/batch={b}" for b in fresh]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), held | set(fresh), name

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens over committed batches."""
        return self._deltas()[0].where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> int:
        """Add all committed deltas up into a new base and remove them; the number of batches it holds."""
        sums, held, before = self._deltas()
        if not held:
            return 0
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.path}/base-{name}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(held)], "batch string").coalesce(1).write.json(f"{self.path}/base-{name}/batches")
        number = 1 + max((int(n.split(".")[0]) for n in self._names("bases")), default=0)
        self._mark(f"bases/{number}.{name}.done")
        for old in [f"deltas/batch={b}" for b in held] + ([f"base-{before}"] if before else []):
            p, fs = file_system(self.spark, f"{self.path}/{old}")
            fs.delete(p, True)
        return len(held)


def change(frame: DataFrame, version: str, old: Column | None = None, new: Column | None = None) -> DataFrame:
    """The same change of every row of ``frame`` (source, lang, and times if there is such a column)."""
    none = F.lit(None).cast("long")
    times = F.col("times") if "times" in frame.columns else F.lit(1)
    return frame.select("source", "lang", F.lit(version).alias("tokenizer_version"), (none if old is None else old).cast("long").alias("old_tokens"), (none if new is None else new).cast("long").alias("new_tokens"), times.cast("long").alias("times"))


#: Tokenizer versions: a byte-level BPE over whole texts, and a tokenizers file's without special tokens.
BYTE, WORD = "byte_bpe_50k", "word_bpe_49k"


def counted(docs: DataFrame, byte_bpe: str, word_bpe: str) -> DataFrame:
    """doc_id, source, lang, text_md5, n_bytes (UTF-8), and the tokens of each text by either tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, words = bpe.vocabulary(byte_bpe), tokenfiles.word_tokenizer(word_bpe)
        for batch in slices(batches, "text"):
            raw, offsets = bpe.valid_utf8(*utf8(batch.column("text"))[::-1])
            _, upto = vocab.encode(raw, offsets)
            counts = [np.diff(offsets), np.diff(upto), np.diff(words.encode(raw, offsets)[1])]
            kept = [batch.column(c) for c in ("doc_id", "source", "lang", "text_md5")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in counts)], names=["doc_id", "source", "lang", "text_md5", "n_bytes", BYTE, WORD])

    rows = columns(docs, "doc_id", "source", "lang", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "text")
    return rows.mapInArrow(run, f"doc_id long, source string, lang string, text_md5 string, n_bytes long, {BYTE} long, {WORD} long")


def copies(counts: DataFrame) -> DataFrame:
    """source, lang, the counts, and times: the documents beyond the first (smallest doc_id) of each group of equal texts.

    Equal texts are added up by source and language before anything is gathered, so no task holds a group's rows."""
    equal = ["text_md5", "n_bytes", BYTE, WORD]
    held = counts.groupBy(*equal, "source", "lang").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("least"))
    one = F.struct("n", "source", "lang", "least")
    of_text = held.groupBy(*equal).agg(F.min(F.struct("least", "source", "lang")).alias("first"), F.collect_list(one).alias("every"))  # a row a source and language
    rows = of_text.select(*equal, "first", F.inline("every"))
    first = F.col("source").eqNullSafe(F.col("first.source")) & F.col("lang").eqNullSafe(F.col("first.lang"))
    return rows.withColumn("times", F.col("n") - first.cast("long")).where("times > 0").select("source", "lang", "n_bytes", BYTE, WORD, "times")
