"""Writers. Each writes a folder with one part a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_records(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object a line."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Columnar data set."""
    df.write.mode(mode).parquet(path)


def write_bucketed(
    df: DataFrame, name: str, key: str, buckets: int, partition_by: str | None = None, mode: str = "overwrite"
) -> None:
    """Save as a table bucketed and sorted by the row key.

    First-seen and first-N pick rows by that key, so on such a table the contents are joined
    where they lie; only the keys are shuffled. ``partition_by`` (a normalised language, say)
    lets an equality filter skip the other folders.
    """
    writer = df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(name)


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """File reports as JSON, nested lists included."""
    reports.write.mode(mode).option("ignoreNullFields", "false").json(path)


def scores_json(scores: DataFrame) -> DataFrame:
    """Scores (``k``, ``score``; a few rows) as one JSON object with keys ``pass@k``."""
    entries = F.sort_array(F.collect_list(F.struct("k", "score")))
    named = F.transform(entries, lambda e: F.struct(F.concat(F.lit("pass@"), e["k"]), e["score"]))
    return scores.agg(F.to_json(F.map_from_entries(named)).alias("value"))


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scores as one JSON object."""
    scores_json(scores).write.mode(mode).text(path)
