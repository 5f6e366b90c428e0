"""Column resolution by name, at plan time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType

from codeloom.functions.tokens import join_tokens

# Names under which data sets keep code and summaries.
TEXT_COLUMNS = ("code", "text", "content", "func_code")
CODE_COLUMNS = ("code", "code_tokens", "func_code")
SUMMARY_COLUMNS = ("docstring", "docstring_tokens", "summary", "nl")


def with_defaults(df: DataFrame, names: list[str]) -> DataFrame:
    """Add each missing string column as ``""``; present columns are untouched."""
    missing = {n: F.lit("") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def resolve_text(df: DataFrame, preferred: str = "content") -> DataFrame:
    """Rename the text column to ``text``: the preferred name, else the first known one."""
    names = [preferred, *TEXT_COLUMNS]
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise ValueError(f"no text column among {df.columns}; looked for {names}")
    if found != "text" and "text" in df.columns:
        raise ValueError(f"cannot rename {found!r} to 'text': the table has a 'text' column already")
    return df.withColumnRenamed(found, "text")


def resolve_code_summary(df: DataFrame) -> tuple[str, str]:
    """Names of the code and the summary column; of several matches the last one counts."""
    code = [n for n in df.columns if n in CODE_COLUMNS]
    summary = [n for n in df.columns if n in SUMMARY_COLUMNS]
    if not code or not summary:
        raise ValueError(f"no code/summary columns among {df.columns}")
    return code[-1], summary[-1]


def code_summary_pairs(df: DataFrame) -> DataFrame:
    """``code`` and ``summary`` as strings, token lists joined."""
    code, summary = resolve_code_summary(df)
    return df.select(
        *(
            join_tokens(F.col(n), isinstance(df.schema[n].dataType, ArrayType)).alias(alias)
            for n, alias in ((code, "code"), (summary, "summary"))
        )
    )


def rename_target(df: DataFrame) -> DataFrame:
    """``target`` becomes ``labels`` if present."""
    return df.withColumnRenamed("target", "labels")
