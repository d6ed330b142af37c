"""Documents to tokens: language ID, near-dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last returns token ids. ``run`` writes each stage's rows as Parquet and reads them again. Every stage
takes nulls in any column, repeated rows, very long texts, further columns of any name, and an empty table, which gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, langid, mixing, near_dedup
from tidegrid.llm.common import documents, materialize
from tidegrid.llm.queries import BYTE_BPE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: what has no letters (null and empty texts too), or no learned language for half of them (other scripts,
    mixtures). If no document has a language, all go."""
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return langid.keep_identified(docs, model, least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a similarity of 0.8 or more stays: that with the smallest
    doc_id, one without an id only where the group has none; of repeated rows one. Texts without words link with nothing."""
    return near_dedup.keep_one(docs, shingle=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (not at all, once or twice), in training order. Null is a source of its
    own; rows that share an id or have none are mixed each for itself; ties of position are ordered by a hash."""
    return mixing.mixed_rows(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and byte_offsets of every row, repeated ones too; a null text is an empty one without tokens."""
    return bpe.encode_documents(docs, BYTE_BPE)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: The stages' models and hashes aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
