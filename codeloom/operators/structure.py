"""File reports and the flat tables and totals drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from codeloom.functions.jscode import fold_javascript, javascript_functions
from codeloom.functions.pycode import (
    count_python,
    fold_python,
    line_facts,
    mask_python,
    python_classes,
    python_functions,
)
from codeloom.functions.text import language_of, total_lines
from codeloom.operators.filters import has_structure

CLASS_TYPE = "array<struct<name:string,line:int,methods:array<string>,num_methods:int>>"


# Fields of a report after ``file`` and ``language``.
FIELDS = ("functions", "classes", "imports", "total_lines", "avg_function_length", "max_nesting")
OF_FUNCTIONS = {"functions", "avg_function_length", "max_nesting"}


def _known(files: DataFrame, path: str, text: str, language: str | None) -> DataFrame:
    """``file, _text, language`` of the files that have a report."""
    lang = F.col(language) if language else language_of(F.col(path))
    return files.select(F.col(path).alias("file"), F.col(text).alias("_text"), lang.alias("language")).where(
        F.col("language").isin("python", "javascript") & F.col("_text").isNotNull()
    )


def file_reports(
    files: DataFrame,
    path: str = "file",
    text: str = "text",
    language: str | None = None,
    fields: Sequence[str] = FIELDS,
) -> DataFrame:
    """One report a file, with nested functions, classes and imports.

    The language comes from the column ``language`` or else from the suffix of ``path``. Files of
    another language get no report; see ``unsupported``. Purely row-local: a scan and a projection.
    Only the ``fields`` asked for are worked out; the others are left out of the report.
    """
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"no fields of a report: {sorted(unknown)}")
    functions = bool(OF_FUNCTIONS & set(fields))
    facts = [fact for fact, asked in (("defs", functions or "classes" in fields), ("imports", "imports" in fields)) if asked]
    folded = _known(files, path, text, language)
    if facts:
        folded = folded.select(
            "file",
            "language",
            "_text",
            F.expr(f"IF(language = 'python', {fold_python('_text', facts)}, NULL)").alias("_py"),
            F.expr(f"IF(language = 'python', NULL, {fold_javascript('_text', facts)})").alias("_js"),
        )
    made = {}
    if functions:
        made["functions"] = F.expr(
            f"IF(language = 'python', {python_functions('_text', '_py.defs')}, {javascript_functions('_js.defs')})"
        )
    if "classes" in fields:
        made["classes"] = F.expr(
            f"IF(language = 'python', {python_classes('_py.defs')}, CAST(array() AS {CLASS_TYPE}))"
        )
    if "imports" in fields:
        made["imports"] = F.coalesce("_py.imports", "_js.imports")
    if "total_lines" in fields:
        made["total_lines"] = total_lines(F.col("_text"))
    if not made:
        return folded.select("file", "language")
    # Generated columns are a barrier: a filter on them is not pushed into the analysis (which
    # would then run once for the filter and once for the result).
    struct = F.struct(*(value.alias(name) for name, value in made.items()))
    reports = folded.select("file", "language", F.inline_outer(F.array(struct)))
    if functions:
        lengths = F.aggregate("functions", F.lit(0).cast("bigint"), lambda acc, f: acc + f["length"])
        deepest = F.array_max(F.transform("functions", lambda f: f["nesting_depth"]))
        reports = reports.withColumns(
            {
                "avg_function_length": F.when(F.size("functions") > 0, lengths / F.size("functions")).otherwise(0.0),
                "max_nesting": F.coalesce(deepest, F.lit(0)),
            }
        )
    return reports.select("file", "language", *(f for f in FIELDS if f in fields))


def file_counts(files: DataFrame, path: str = "file", text: str = "text", language: str | None = None) -> DataFrame:
    """Numbers of ``functions`` and ``classes`` of each file, as its report has them, without building it."""
    known = _known(files, path, text, language)
    python = F.expr(f"IF(language = 'python', {count_python('_text')}, NULL)").alias("_py")
    script = F.expr(f"IF(language = 'python', NULL, size({fold_javascript('_text', ['defs'])}.defs))").alias("_js")
    return known.select("file", "language", python, script).select(
        "file",
        "language",
        F.coalesce("_py.functions", "_js").alias("functions"),
        F.coalesce("_py.classes", F.lit(0)).alias("classes"),
    )


def line_table(files: DataFrame, path: str = "file", text: str = "text") -> DataFrame:
    """One row a line of Python source: number, indent, code without strings and comments, keyword.

    ``bracket_balance`` is the number of brackets the line leaves open; lines inside a string or
    bracket are continuations and their indent means nothing.
    """
    facts = F.expr(f"inline_outer({line_facts(mask_python('_text'))})")
    lines = files.select(F.col(path).alias("file"), F.col(text).alias("_text")).select("file", facts)
    return lines.select(
        "file",
        F.col("ln").alias("line"),
        F.col("ind").alias("indent"),
        F.col("body").alias("code"),
        F.col("delta").alias("bracket_balance"),
        F.col("note").alias("is_comment"),
        "keyword",
    )


def unsupported(files: DataFrame, path: str = "file") -> DataFrame:
    """Files whose suffix names no supported language."""
    return files.where(language_of(F.col(path)).isNull())


# The tables below use the outer generators and then drop the empty row: for a plain generator
# Spark first filters on the size of the array, which would run the whole analysis a second time.


def function_table(reports: DataFrame) -> DataFrame:
    """One row a function."""
    return reports.select("file", "language", F.inline_outer("functions")).where(F.col("name").isNotNull())


def class_table(reports: DataFrame) -> DataFrame:
    """One row a class."""
    return reports.select("file", "language", F.inline_outer("classes")).where(F.col("name").isNotNull())


def import_table(reports: DataFrame) -> DataFrame:
    """One row an import with its place in the file."""
    places = F.posexplode_outer("imports").alias("pos", "import")
    return reports.select("file", "language", places).where(F.col("import").isNotNull())


def with_structure(reports: DataFrame) -> DataFrame:
    """Reports with at least one function or class."""
    return reports.where(has_structure(F.col("functions"), F.col("classes")))


def corpus_totals(reports: DataFrame) -> DataFrame:
    """Files, functions and classes over all reports."""
    return reports.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.size("functions")), F.lit(0)).cast("bigint").alias("functions"),
        F.coalesce(F.sum(F.size("classes")), F.lit(0)).cast("bigint").alias("classes"),
    )


def count_totals(counts: DataFrame) -> DataFrame:
    """The same totals from ``file_counts``."""
    return counts.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("functions"), F.lit(0)).cast("bigint").alias("functions"),
        F.coalesce(F.sum("classes"), F.lit(0)).cast("bigint").alias("classes"),
    )
