"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm.common import spool

# Three histograms of 4,096 buckets for each source: the last bucket holds 2**-36 of the hashes.
HASH_BITS = 36
LEVEL_BITS = 12
LEVELS = 3


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """``source, weight``: weights repeat over the sources in code-point order, null last.

    ``sources`` has one row a source (already aggregated), so the one ordered window is as long as
    the list of sources.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    choice = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(place, F.lit(len(cycle))) + 1).cast("int"))
    return sources.select("source", choice.alias("weight"))


def capped_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``source, source_size, weight`` plus ``target``: shares of ``share`` times all sizes.

    A target is ``min(most * size, level * weight)`` with one level for all sources such that the
    targets add up (all are at their caps if they cannot). The level is found on the sources in
    ascending order of cap to weight: those before the crossing are at their caps. One row a source.
    A source whose weight is null, zero or negative gets no share.
    """
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    cap = F.when(weight > 0, most * F.col("source_size")).otherwise(0.0)
    ranked = sources.withColumn("w", weight).withColumn("cap", cap).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    budget = share * F.sum("source_size").over(everything)
    placed = ranked.select(
        "source", "source_size", "w", "cap", "ratio",
        # The level if all sources before this one are at their caps and none from here on.
        ((budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.nullif(F.sum("w").over(onwards), F.lit(0.0))).alias("try"),
    )
    level = F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(everything)
    return placed.select("source", "source_size", F.col("w").alias("weight"), F.coalesce(F.least("cap", level * F.col("w")), F.col("cap")).alias("target"))


def _key() -> Column:
    """Null-safe join key of a source."""
    source = F.col("source").cast("string")
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def row_hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _place() -> Column:
    return F.col("row_hash").bitwiseAND((1 << HASH_BITS) - 1)


def _copies() -> Column:
    return F.col("passes") + F.when(_place() < F.coalesce("below", F.lit(0)), 1).otherwise(0)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """``id, source, key, size, row_hash``: what the mix needs of each row, written once."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        row_hash(id_col, text_col, seed).alias("row_hash"),
    )
    return spool(rows.withColumn("key", _key()), "mix-rows")


def mix_plan(rows: DataFrame, weights: DataFrame | None = None, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: ``key, source_size, target, passes, below``; ``rows`` come from ``sized``.

    A target of q whole passes and a rest takes every row q times (``passes``), and once more the
    rows whose hash is ``below`` the threshold, so a larger budget takes all that a smaller one does.
    Thresholds come from histograms: words by source and hash bucket; the bucket in which the budget
    is crossed is cut into 4,096 again, and only its rows are counted in the next round; the last
    bucket is taken if that comes nearer. Nothing is sorted by row.
    """
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    if weights is None:
        weights = cycled_weights(sizes)
    named = weights.withColumn("key", _key()).groupBy("key").agg(F.sum("weight").cast("double").alias("weight"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = spool(
        capped_targets(sizes.join(named, "key", "left"), share, most).withColumn("key", _key()).withColumn("passes", passes),
        "mix-targets",
    )
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    # Rows below `low` are taken; `left` words are still to be found from there on.
    state = targets.select("key", F.lit(0).cast("long").alias("low"), rest.alias("left"))
    placed = rows.select("key", "size", _place().alias("place"))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        inside = placed if level == 1 else placed.join(state, "key").where(
            (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + (1 << (shift + LEVEL_BITS)))
        )
        buckets = inside.groupBy("key", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
        crossing = (
            buckets.withColumn("upto", upto)
            .join(state.select("key", "left"), "key")
            .where(F.col("upto") > F.col("left"))
            .groupBy("key", "left")
            .agg(F.min(F.struct("bucket", "upto", "words")).alias("b"))
        )
        state = spool(
            crossing.select(
                "key", F.shiftleft("b.bucket", shift).alias("low"),
                (F.col("left") - F.col("b.upto") + F.col("b.words")).alias("left"), F.col("b.words").alias("words"),
            ),
            "mix-bounds",
        )
    width = 1 << (HASH_BITS - LEVEL_BITS * LEVELS)
    bounds = state.select("key", (F.col("low") + F.when(2 * F.col("left") > F.col("words"), width).otherwise(0)).alias("below"))
    return spool(targets.drop("source", "weight").join(bounds, "key", "left"), "mix-plan")


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 1,
) -> DataFrame:
    """One row per input row: id, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Sizes are word counts. Targets are the weighted shares of ``share`` times all sizes, none above
    ``most`` times its source; ``mix_plan`` says how rows are chosen. The hash is of id and text, so
    reruns agree.

    Defined cases: null text has size 0; null is a source of its own; null and repeated ids take
    part (rows that share id and text share a hash and are taken together); an empty table gives an
    empty result; a source of size 0 has target 0; sources that ``weights`` does not name get none;
    weights of a repeated source are added up; other columns are not read.
    """
    rows = sized(docs, id_col, text_col, source_col, seed)
    return (
        rows.join(mix_plan(rows, weights, share, most), "key")
        .withColumn("copies", _copies())
        .select(
            F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mixed_rows(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 1,
) -> DataFrame:
    """Rows of ``docs`` as often as the mix of ``mix_sources`` takes them, all columns kept.

    Each row is compared with its source's threshold; only the plan, a row a source, is joined. Cases are those
    of ``mix_sources``: null ids and texts and repeated rows take part, rows without words as often as
    their hash says, an empty table gives no rows. ``docs`` is read twice and must be deterministic.
    """
    plan = mix_plan(sized(docs, id_col, text_col, source_col, seed), weights, share, most).select("key", "passes", "below")
    source = F.col(source_col).alias("source")
    packed = docs.select(F.struct("*").alias("row"), row_hash(id_col, text_col, seed).alias("row_hash"), source).withColumn("key", _key())
    times = F.array_repeat(F.lit(0), _copies().cast("int"))
    return packed.join(plan, "key").select("row", F.explode(times).alias("copy")).select("row.*")
