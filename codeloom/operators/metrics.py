"""Classifier metrics and model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def binary_metrics(predictions: DataFrame, label: str = "labels", predicted: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; an undefined ratio is 0."""
    actual, guess = F.col(label), F.col(predicted)
    counts = predictions.agg(
        F.count_if((guess == 1) & (actual == 1)).alias("tp"),
        F.count_if((guess == 1) & (actual != 1)).alias("fp"),
        F.count_if((guess != 1) & (actual == 1)).alias("fn"),
        F.count_if(guess == actual).alias("right"),
        F.count(F.when(guess.isNotNull() & actual.isNotNull(), 1)).alias("rows"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        ratio(F.col("right"), F.col("rows")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def best_checkpoint(log: DataFrame, run: str = "run", step: str = "step", score: str = "f1") -> DataFrame:
    """Step with the best score of each run; the lowest step wins a tie, a score that is no number never.

    A run without any number has its lowest step with a null score.
    """
    sound = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    return (
        log.withColumn(score, sound)
        .groupBy(run)
        .agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(step)).alias("n"))).alias("_best"))
        .select(run, (-F.col("_best.n")).alias(step), F.col("_best.s").alias(score))
    )
