"""Fixed-length integer rows for model input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from codeloom.functions.tokens import attention_mask, pad_ids, token_ids


def fixed_length_rows(
    df: DataFrame, text: str = "text", max_length: int = 512, keep: Sequence[str] = (), vocab: int = 1000
) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of exactly ``max_length``; only ``keep`` survives."""
    return df.select(*keep, token_ids(F.col(text), max_length, vocab).alias("_ids")).select(
        *keep,
        pad_ids(F.col("_ids"), max_length).alias("input_ids"),
        attention_mask(F.col("_ids"), max_length).alias("attention_mask"),
    )


def paired_rows(
    df: DataFrame,
    source: str = "code",
    target: str = "summary",
    max_input: int = 256,
    max_target: int = 128,
    keep: Sequence[str] = (),
    vocab: int = 1000,
) -> DataFrame:
    """Source rows as for ``fixed_length_rows``, target ids as ``labels``."""
    return df.select(
        *keep,
        token_ids(F.col(source), max_input, vocab).alias("_ids"),
        token_ids(F.col(target), max_target, vocab).alias("_target"),
    ).select(
        *keep,
        pad_ids(F.col("_ids"), max_input).alias("input_ids"),
        attention_mask(F.col("_ids"), max_input).alias("attention_mask"),
        pad_ids(F.col("_target"), max_target).alias("labels"),
    )
