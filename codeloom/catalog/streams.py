"""Streaming queries: all files there are, to the end, result read back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from codeloom.catalog.corpus import stripped_sql
from codeloom.catalog.registry import query, table
from codeloom.operators.ordering import first_n
from codeloom.session import shared_dir
from codeloom.streaming.ingest import (
    digest_ingest_to_table,
    hashed_records,
    read_ingested,
    read_stream,
    start_digest_ingest,
)

# Batches in which each half of a restarted stream arrives.
BATCHES = 4
KEPT_SQL = f"""FROM documents WHERE lang = 'en' AND {stripped_sql('text')} >= 50 AND length(text) <= 50000"""


def raw_stream(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    return read_stream(spark, path, schema, files_per_batch=files).select(
        "doc_id",
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.col("source").alias("repo_name"),
    )


def ingested(spark: SparkSession, folder: str) -> DataFrame:
    """The table may be one file or a folder of files; a stream takes either where the path is a pattern."""
    raw = raw_stream(spark, f"{folder}/documents[.]parquet", table(spark, folder, "documents").schema)
    return digest_ingest_to_table(hashed_records(raw, "en", keep=("doc_id",)), "doc_id")


@query("stream_dedup", f"SELECT DISTINCT md5(text) AS code_hash, CAST(length(text) AS INTEGER) AS size {KEPT_SQL}")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Which of equal contents survives depends on arrival, so only content facts are compared."""
    return ingested(spark, folder).select("code_hash", "size")


@query("stream_first_n", f"SELECT DISTINCT md5(text) AS code_hash {KEPT_SQL} ORDER BY 1 LIMIT 100")
def stream_first_n(spark: SparkSession, folder: str) -> DataFrame:
    """The first N are taken from the output of the stream."""
    return first_n(ingested(spark, folder).select("code_hash"), 100, "code_hash")


@query("stream_restart", f"SELECT DISTINCT md5(text) AS code_hash, CAST(length(text) AS INTEGER) AS size {KEPT_SQL}")
def stream_restart(spark: SparkSession, folder: str) -> DataFrame:
    """The documents arrive in two halves of four batches or fewer; the stream ends between and goes on.

    Rows stay in their scan partitions, so files and the tasks that write and read them grow with the table; only a
    table of fewer than four partitions is dealt out.
    """
    documents = table(spark, folder, "documents")
    dealt = documents.repartition(BATCHES) if documents.rdd.getNumPartitions() < BATCHES else documents
    base = f"{shared_dir(spark)}/restart-{uuid.uuid4().hex}"
    half, arrived = F.pmod(F.xxhash64("doc_id"), F.lit(2)), 0
    for part in range(2):
        dealt.where(half == part).write.mode("append").parquet(f"{base}/in")
        files = len(spark.read.schema(documents.schema).parquet(f"{base}/in").inputFiles())
        raw = raw_stream(spark, f"{base}/in", documents.schema, max(1, -(-(files - arrived) // BATCHES)))
        arrived = files
        records = hashed_records(raw, "en", keep=("doc_id",))
        start_digest_ingest(records, f"{base}/records", f"{base}/checkpoint", "doc_id").awaitTermination()
    return read_ingested(spark, f"{base}/records", records.schema).select("code_hash", "size")
