"""Tables, splits and record files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

RECORD = StructType(
    [
        StructField("code", StringType()),
        StructField("language", StringType()),
        StructField("repo", StringType()),
        StructField("path", StringType()),
        StructField("size", IntegerType()),
    ]
)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    format: str = "parquet",
    schema: StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """A named corpus as a table; give ``schema`` for JSON so that no pass is spent on inference."""
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load([path] if isinstance(path, str) else list(path))


def read_records(spark: SparkSession, path: str, schema: StructType = RECORD) -> DataFrame:
    """JSON Lines of prepared code; an absent ``code`` reads as empty."""
    return spark.read.schema(schema).json(path).withColumn("code", F.coalesce("code", F.lit("")))


def choose_splits(df: DataFrame, split: str = "split") -> tuple[DataFrame | None, DataFrame | None]:
    """Training rows and validation rows; ``test`` stands in for a missing ``validation``.

    Looks up which of the three splits exist, nothing else (metadata only when ``split`` is a
    partition column).
    """
    names = ["train", "validation", "test"]
    present = {r[0] for r in df.where(F.col(split).isin(names)).select(split).distinct().collect()}

    def rows(name: str) -> DataFrame:
        return df.where(F.col(split) == name)

    train = rows("train") if "train" in present else None
    check = next((n for n in ("validation", "test") if n in present), None)
    return train, rows(check) if check else None
