"""Label cleaning and structure features for a classifier."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from codeloom.operators.ordering import content_digest

STRUCTURE_FEATURES = ("n_functions", "n_classes", "n_imports", "total_lines", "avg_function_length", "max_nesting")


def conflicting_hashes(df: DataFrame, text: str, label: str) -> DataFrame:
    """Digests of contents that carry differing labels (partial aggregation, so hot contents are cheap)."""
    return (
        df.groupBy(content_digest(F.col(text)).alias("_digest"))
        .agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
        .where(F.col("_low") != F.col("_high"))
        .select("_digest")
    )


def drop_label_conflicts(df: DataFrame, text: str, label: str) -> DataFrame:
    """Samples whose content never carries another label."""
    return (
        df.withColumn("_digest", content_digest(F.col(text)))
        .join(conflicting_hashes(df, text, label), "_digest", "left_anti")
        .drop("_digest")
    )


def structure_features(labels: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Labels with the structure numbers of their file as ``features``; no report means zeros."""
    numbers = reports.select(
        key,
        F.size("functions").alias("n_functions"),
        F.size("classes").alias("n_classes"),
        F.size("imports").alias("n_imports"),
        "total_lines",
        "avg_function_length",
        "max_nesting",
    )
    joined = labels.join(numbers, key, "left").fillna(0, list(STRUCTURE_FEATURES))
    return VectorAssembler(inputCols=list(STRUCTURE_FEATURES), outputCol="features").transform(joined)
