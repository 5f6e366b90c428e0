"""Structure queries on derived code."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codeloom.catalog.derived import EXTENTS_SQL, JAVASCRIPT, PYTHON, code_files, lines_sql
from codeloom.catalog.registry import query, table
from codeloom.operators.labels import structure_features
from codeloom.operators.structure import (
    class_table,
    count_totals,
    file_counts,
    file_reports,
    function_table,
    import_table,
    line_table,
    with_structure,
)
from codeloom.session import shared_dir
from codeloom.sources.sinks import write_reports

PY_SQL = f"WITH {lines_sql(PYTHON, '.py')}{EXTENTS_SQL}"
JS_SQL = f"WITH {lines_sql(JAVASCRIPT, '.js')}"


def python_files(spark: SparkSession, folder: str) -> DataFrame:
    return code_files(table(spark, folder, "documents"), PYTHON, ".py")


def javascript_files(spark: SparkSession, folder: str) -> DataFrame:
    return code_files(table(spark, folder, "documents"), JAVASCRIPT, ".js")


def flat_functions(reports: DataFrame) -> DataFrame:
    return function_table(reports).select(
        "file",
        "name",
        "line",
        "end_line",
        F.array_join("params", ",").alias("params"),
        "length",
        "nesting_depth",
        "is_method",
        F.array_join("decorators", "|").alias("decorators"),
    )


def report_numbers(reports: DataFrame) -> DataFrame:
    return reports.select(
        "file",
        "language",
        F.size("functions").alias("n_functions"),
        F.size("classes").alias("n_classes"),
        F.array_join("imports", "|").alias("imports"),
        "total_lines",
        F.round("avg_function_length", 6).alias("avg_function_length"),
        "max_nesting",
    )


@query(
    "code_lines",
    PY_SQL
    + """
    SELECT file, CAST(ln AS INTEGER) AS line, CASE WHEN kind IN ('note', 'cont') THEN NULL ELSE indent END AS indent,
           kind IN ('def', 'class', 'block') AS is_header
    FROM lines""",
)
def code_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with the indent of each statement; continuations, blank lines and comments have none."""
    lines = line_table(python_files(spark, folder))
    order = Window.partitionBy("file").orderBy("line")
    before = F.sum("bracket_balance").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = F.coalesce(F.endswith(F.lag("code").over(order), F.lit("\\")), F.lit(False))
    inside = (F.coalesce(before, F.lit(0)) > 0) | joined
    return lines.select(
        "file",
        "line",
        F.when(~inside & (F.col("code") != ""), F.col("indent")).alias("indent"),
        (~inside & (F.col("keyword") != "")).alias("is_header"),
    )


@query(
    "code_functions",
    PY_SQL
    + """
    SELECT file, name, line, end_line, params, length, nesting_depth, is_method, decorators
    FROM functions""",
)
def code_functions(spark: SparkSession, folder: str) -> DataFrame:
    return flat_functions(file_reports(python_files(spark, folder), fields=["functions"]))


@query("code_classes", PY_SQL + " SELECT file, name, line, methods, num_methods FROM classes")
def code_classes(spark: SparkSession, folder: str) -> DataFrame:
    classes = class_table(file_reports(python_files(spark, folder), fields=["classes"]))
    return classes.select("file", "name", "line", F.array_join("methods", ",").alias("methods"), "num_methods")


@query(
    "code_imports",
    PY_SQL
    + """
    SELECT file, import, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ln, n) - 1 AS INTEGER) AS pos
    FROM imports""",
)
def code_imports(spark: SparkSession, folder: str) -> DataFrame:
    return import_table(file_reports(python_files(spark, folder), fields=["imports"])).select("file", "import", "pos")


REPORT_SQL = (
    PY_SQL
    + """,
    report AS (
      SELECT l.file, 'python' AS language,
             CAST(coalesce(f.n, 0) AS INTEGER) AS n_functions, CAST(coalesce(c.n, 0) AS INTEGER) AS n_classes,
             coalesce(i.imports, '') AS imports, CAST(l.n AS INTEGER) AS total_lines,
             round(coalesce(f.mean, 0.0), 6) AS avg_function_length, coalesce(f.deep, 0) AS max_nesting, l.doc_id
      FROM (SELECT doc_id, file, count(*) AS n FROM lines GROUP BY 1, 2) l
      LEFT JOIN (SELECT doc_id, count(*) AS n, avg(length) AS mean, max(nesting_depth) AS deep
                 FROM functions GROUP BY 1) f USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM classes GROUP BY 1) c USING (doc_id)
      LEFT JOIN (SELECT doc_id, string_agg(import, '|' ORDER BY ln, n) AS imports
                 FROM imports GROUP BY 1) i USING (doc_id))"""
)
REPORT_COLUMNS = "file, language, n_functions, n_classes, imports, total_lines, avg_function_length, max_nesting"


@query("file_report", f"{REPORT_SQL} SELECT {REPORT_COLUMNS} FROM report")
def file_report(spark: SparkSession, folder: str) -> DataFrame:
    return report_numbers(file_reports(python_files(spark, folder)))


@query("report_json", f"{REPORT_SQL} SELECT {REPORT_COLUMNS} FROM report")
def report_json(spark: SparkSession, folder: str) -> DataFrame:
    """Nested reports written as JSON and read back."""
    reports = file_reports(python_files(spark, folder))
    target = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    write_reports(reports, target)
    return report_numbers(spark.read.schema(reports.schema).json(target))


@query(
    "files_with_structure",
    f"{REPORT_SQL} SELECT {REPORT_COLUMNS} FROM report WHERE n_functions > 0 OR n_classes > 0",
)
def files_with_structure(spark: SparkSession, folder: str) -> DataFrame:
    return report_numbers(with_structure(file_reports(python_files(spark, folder))))


@query(
    "structure_totals",
    REPORT_SQL
    + """
    SELECT count(*) AS files, CAST(sum(n_functions) AS BIGINT) AS functions, CAST(sum(n_classes) AS BIGINT) AS classes
    FROM report""",
)
def structure_totals(spark: SparkSession, folder: str) -> DataFrame:
    return count_totals(file_counts(python_files(spark, folder)))


@query(
    "structure_features",
    REPORT_SQL
    + """
    SELECT l.doc_id, l.quality,
           CAST(r.n_functions AS DOUBLE) AS f0, CAST(r.n_classes AS DOUBLE) AS f1,
           CAST(length(r.imports) - length(replace(r.imports, '|', '')) + (r.imports <> '')::INT AS DOUBLE) AS f2,
           CAST(r.total_lines AS DOUBLE) AS f3, r.avg_function_length AS f4, CAST(r.max_nesting AS DOUBLE) AS f5
    FROM labels l JOIN report r USING (doc_id)""",
)
def labelled_structure(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    files = python_files(spark, folder)
    labels = table(spark, folder, "labels").join(files.select("doc_id", "file"), "doc_id")
    features = structure_features(labels, file_reports(files), "file")
    return features.select("doc_id", "quality", vector_to_array("features").alias("v")).select(
        "doc_id", "quality", *(F.round(F.col("v")[i], 6).alias(f"f{i}") for i in range(6))
    )


# The JavaScript templates hold whole declarations, so their extents follow from the closing lines.
JS_FUNCTIONS_SQL = (
    JS_SQL
    + """,
    f AS (
      SELECT f.*, min(x.ln) AS end_ln
      FROM lines f JOIN lines x ON x.doc_id = f.doc_id AND x.ln > f.ln AND x.kind = 'end' AND x.indent = f.indent
      WHERE f.kind = 'def' GROUP BY ALL)"""
)


@query(
    "js_functions",
    JS_FUNCTIONS_SQL
    + """
    SELECT f.file, f.name, CAST(f.ln AS INTEGER) AS line, CAST(f.end_ln AS INTEGER) AS end_line, f.params,
           CAST(f.end_ln - f.ln + 1 AS INTEGER) AS length,
           CAST(CASE WHEN f.name LIKE 'f\\_%' ESCAPE '\\' THEN 4 WHEN f.name LIKE 'e\\_%' ESCAPE '\\' THEN 1
                     ELSE 2 END AS INTEGER) AS nesting_depth,
           false AS is_method, '' AS decorators
    FROM f""",
)
def js_functions(spark: SparkSession, folder: str) -> DataFrame:
    return flat_functions(file_reports(javascript_files(spark, folder), fields=["functions"]))


@query("js_imports", JS_SQL + " SELECT file, imports AS import FROM lines WHERE imports <> ''")
def js_imports(spark: SparkSession, folder: str) -> DataFrame:
    return import_table(file_reports(javascript_files(spark, folder), fields=["imports"])).select("file", "import")
