"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.common import key_bitmap, maybe_in, spark_space, spool


def content_hash(text: Column) -> Column:
    """MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = spark_space,
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are equal when their normalised texts have the same bytes; the row with the smallest id
    stays. Method: (1) count rows per 128-bit hash; (2) where a hash has several rows, group by hash
    *and* text, so bytes are compared and a collision of the hash makes two groups; (3) join the
    groups back to the narrow table of hashes. Only texts whose hash prefix is marked in a bitmap of
    a fixed 4 MB are shuffled in (2), one for each map task and group, as the grouping is partial
    first. The join of (3) meets hot groups on a narrow side that the adaptive planner splits.

    Defined cases: null text is empty text, which forms a group like any other; a null id sorts
    after all others; rows that share id and text keep one row, the first in scan order; an empty
    table gives an empty result; other columns are not read. ``docs`` must be deterministic (a
    table or files), as its texts are read twice.
    """
    text = normalise(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("place"), text.alias("text"))
    narrow = spool(
        rows.select("id", "place", digest(F.col("text")).alias("hash"), F.sha2("text", 256).alias("sha")), "exact-hashes"
    )
    several = narrow.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    maybe = maybe_in(rows.withColumn("hash", digest(F.col("text"))), "hash", key_bitmap(several, "hash"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "place"))
    groups = spool(
        maybe.groupBy("hash", "text")
        .agg(first.alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("hash", F.sha2("text", 256).alias("sha"), "first.id", "first.place", "n"),
        "exact-groups",
    ).select(
        F.col("hash").alias("g_hash"), F.col("sha").alias("g_sha"), F.col("id").alias("g_id"),
        F.col("place").alias("g_place"), F.col("n").alias("g_n"),
    )
    joined = narrow.join(
        groups, (narrow["hash"] == groups["g_hash"]) & (narrow["sha"] == groups["g_sha"]), "left"
    )
    alone = F.col("g_n").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("g_id")).alias("keep_id"),
        F.coalesce("g_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("place") == F.col("g_place"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
