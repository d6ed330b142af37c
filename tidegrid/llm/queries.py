"""The queries that apply the operators of this subpackage to whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, licenses, mixing, near_dedup, sharding, tiff, token_counts, tokenfiles
from .common import documents, materialize, shared_dir

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(bpe.encode_documents(documents(spark, sf_dir), BYTE_BPE), BYTE_BPE)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), whole_words=True)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle=2)


def op4_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir), 8)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read_shards(materialize(tokenfiles.write_shards(documents(spark, sf_dir), WORD_BPE, end_id=2), "token_files"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with an estimate of their byte BPE tokens (a quarter of the bytes) and with their word
    BPE tokens; a batch that is sent twice revises the estimates to the counts; then all but the first of each group of
    equal texts are deleted. The first two batches are compacted before the third."""
    docs = materialize(token_counts.counted(documents(spark, sf_dir), BYTE_BPE, WORD_BPE), "counted")
    rollup = token_counts.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    guess, exact, word = F.ceil(F.col("n_bytes") / 4), F.col(token_counts.BYTE), F.col(token_counts.WORD)
    rollup.apply(0, token_counts.change(docs, token_counts.BYTE, new=guess).unionByName(token_counts.change(docs, token_counts.WORD, new=word)))
    for _ in range(2):
        rollup.apply(1, token_counts.change(docs, token_counts.BYTE, old=guess, new=exact))
    rollup.compact()
    gone = token_counts.copies(docs)
    rollup.apply(2, token_counts.change(gone, token_counts.BYTE, old=exact).unionByName(token_counts.change(gone, token_counts.WORD, old=word)))
    return rollup.totals()


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")


def op9_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff.decode_media(tiff.encode_media(documents(spark, sf_dir)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = batch.column("pixels").to_pylist()
            made = {
                "payload_bytes": pa.array([len(p) for p in pixels], pa.int64()), "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in pixels], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in pixels], pa.int64()),
            }
            kept = {c: batch.column(c) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "feature")}
            yield pa.RecordBatch.from_pydict({c: (kept | made)[c] for c in names})

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pages.select("doc_id", "n_bytes", "pixels", "media_bytes", "media_sha256", "feature").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return langid.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_byte_bpe, op2_license_scan, op3_minhash_near_dedup, op4_multi_index_ann, op5_kd_sharding, op6_token_files, op7_token_counts, op8_source_mixing, op9_tiff_media, op10_language_id)
}

ORACLE_SQL: dict[str, str] = {
    "op8_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source),
        w AS (SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(CASE (rank - 1) % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0 ELSE 0.5 END AS DOUBLE) AS a FROM s),
        c AS (SELECT *, CAST(2 AS DOUBLE) * source_size AS cap, CAST(2 AS DOUBLE) * source_size / weight AS ratio FROM w),
        l AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER q, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER q, 0)) AS level FROM c
            WINDOW q AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT level AS fits FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
        t AS (SELECT source, source_size, a, coalesce(least(cap, fits * weight), cap) AS target FROM l LEFT JOIN f ON TRUE),
        p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.a, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, b + pass * source_size AS place, CAST(greatest(0, least(size, floor(target) - b - pass * source_size)) AS BIGINT) AS part FROM p, (VALUES (0), (1)) n(pass)),
        u AS (SELECT *, least(CAST(1 AS DOUBLE), place / nullif(target, 0)) AS u FROM e),
        v AS (SELECT *, CASE WHEN a = 0 THEN u ELSE (sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a) END + CAST(0 AS DOUBLE) AS t FROM u)
        SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(part) AS BIGINT) AS taken, min(t) FILTER (part > 0) AS first_position, max(t) FILTER (part > 0) AS last_position FROM v GROUP BY doc_id""",
}
