"""Benchmark evaluation on recorded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from codeloom.functions.scoring import pass_at_k, sample_passed
from codeloom.operators.ordering import first_n_per_group

K_VALUES = (1, 10, 100)


def capped_samples(
    samples: DataFrame,
    cap: int | None = None,
    task: str = "task_id",
    order_by: str | Sequence[str] = "sample_no",
) -> DataFrame:
    """At most ``cap`` samples of each problem; ``None`` keeps all."""
    return samples if cap is None else first_n_per_group(samples, cap, task, order_by)


def with_passed(samples: DataFrame) -> DataFrame:
    """Add ``passed`` from the recorded outcome."""
    return samples.withColumn("passed", sample_passed(F.col("returncode"), F.col("timed_out")))


def problem_results(problems: DataFrame, samples: DataFrame, task: str = "task_id") -> DataFrame:
    """``n_samples`` and ``correct`` of every problem; one without samples counts zero.

    Samples (with ``passed``) are counted before the join, so the join has one row a side for
    each problem however many samples it has.
    """
    counts = samples.groupBy(task).agg(
        F.count("*").alias("n_samples"), F.count_if("passed").alias("correct")
    )
    return problems.select(task).join(counts, task, "left").select(
        task,
        F.coalesce("n_samples", F.lit(0)).cast("bigint").alias("n_samples"),
        F.coalesce("correct", F.lit(0)).cast("bigint").alias("correct"),
    )


def evaluation_totals(results: DataFrame) -> DataFrame:
    """Correct and all samples over all problems."""
    return results.agg(
        F.coalesce(F.sum("correct"), F.lit(0)).cast("bigint").alias("total_correct"),
        F.coalesce(F.sum("n_samples"), F.lit(0)).cast("bigint").alias("total_samples"),
    )


def problem_pass_at_k(results: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """pass@k of each problem for each k."""
    ks = F.explode(F.array(*(F.lit(k).cast("bigint") for k in k_values))).alias("k")
    return results.select("*", ks).withColumn(
        "score", pass_at_k(F.col("n_samples"), F.col("correct"), F.col("k"))
    )


def mean_pass_at_k(results: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """Mean pass@k over problems, for each k the average sample count allows.

    Problems with equal counts score alike, so they are counted first: the score is worked out
    once for each distinct pair of counts, not for each problem.
    """
    pairs = results.groupBy("n_samples", "correct").agg(F.count("*").alias("problems"))
    scored = problem_pass_at_k(pairs, k_values)
    return (
        scored.groupBy("k")
        .agg(
            F.sum(F.col("score") * F.col("problems")).alias("_sum"),
            F.sum("problems").alias("_problems"),
            F.sum(F.col("n_samples") * F.col("problems")).alias("_samples"),
        )
        .where(F.col("k") <= F.floor(F.col("_samples") / F.col("_problems")))
        .select("k", (F.col("_sum") / F.col("_problems")).alias("score"))
    )


def compare_runs(scores: DataFrame, before: str, after: str) -> DataFrame:
    """Scores of two runs side by side with the difference, one row a metric.

    ``scores`` has ``run``, ``metric`` and ``score``.
    """
    wide = (
        scores.where(F.col("run").isin(before, after))
        .groupBy("metric")
        .pivot("run", [before, after])
        .agg(F.max("score"))
    )
    return wide.select(
        "metric",
        F.col(f"`{before}`").alias("before"),
        F.col(f"`{after}`").alias("after"),
        (F.col(f"`{after}`") - F.col(f"`{before}`")).alias("delta"),
    )
