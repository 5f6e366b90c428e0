"""The corpus pipeline: toxicity, line dedup, near duplicates, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. All but
the last return the columns of the documents they are given, with their values (the line stage changes
``text`` and ``n_chars``). Null ids and texts, repeated ids and rows, and an empty table pass all stages; an
empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm.common import shared_path
from codeloom.llm.jaccard_join import near_dedup
from codeloom.llm.line_dedup import dedup_lines
from codeloom.llm.mixing import mixed_rows
from codeloom.llm.packing import pack_documents
from codeloom.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not call toxic; fitted on the labels of these documents.

    Null texts are scored as empty; columns named like the chain's results come back as they were.
    """
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    judged = toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where(~F.col("is_toxic")).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs are cut out; a document of which no word is left goes.

    ``n_chars`` follows the text. A document without words to begin with, or without a text, stays.
    """
    left = dedup_lines(docs.select("doc_id", "text", F.struct("*").alias("row")))
    emptied = (F.col("n_deleted") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return left.where(~emptied).select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (see ``near_dedup`` for the cases)."""
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (see ``mixed_rows`` for the cases)."""
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with the checksum of their ids (see ``pack_documents`` for the cases).

    The workers run all stages, here and in later runs of a session, so fewer words are remembered and none beyond a task.
    """
    pieces = pack_documents(docs, remembered=100_000, keep=False)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

# The classifier, the sampled paths, the hash of the mix and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
