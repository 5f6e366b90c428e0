"""Structure analysis of a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.functions.text import decode_source
from codeloom.operators.structure import file_reports
from codeloom.sources.tree import walk_sources


def analyze_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports, and rejects with the reason (from ``path``, ``content``, ``error``)."""
    decoded = files.select("path", "error", decode_source(F.col("content")).alias("text"))
    reports = file_reports(decoded.where(F.col("text").isNotNull()), path="path")
    rejects = decoded.where(F.col("text").isNull()).select(
        "path", F.coalesce("error", F.lit("not valid UTF-8")).alias("error")
    )
    return reports, rejects


def analyze_tree(spark: SparkSession, root: str) -> DataFrame:
    """One report for each readable source file below ``root``."""
    return analyze_files(walk_sources(spark, root))[0]
