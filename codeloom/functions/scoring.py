"""Column functions for evaluation scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_passed(returncode: Column, timed_out: Column) -> Column:
    """A sample passes when it ended by itself with return code 0."""
    return F.coalesce(returncode == 0, F.lit(False)) & ~F.coalesce(timed_out, F.lit(False))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Unbiased pass@k for ``n`` samples of which ``c`` are correct; 0 without samples."""
    wrong = n - c
    all_wrong = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k.cast("bigint") - 1),
        F.lit(1.0),
        lambda acc, i: acc * (wrong - i) / (n - i),
    )
    return F.when(n <= 0, F.lit(0.0)).when(wrong < k, F.lit(1.0)).otherwise(1.0 - all_wrong)


def argmax(values: Column) -> Column:
    """Zero-based index of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
