"""Corpus preparation queries; ``documents`` stands for raw code."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.catalog.registry import query, table
from codeloom.functions.text import (
    PY_WHITESPACE,
    content_hash,
    extension_language,
    file_suffix,
    language_of,
    stripped_length,
    token_estimate,
    total_lines,
    truncate_tokens,
)
from codeloom.operators.columns import code_summary_pairs, resolve_text
from codeloom.operators.encode import fixed_length_rows, paired_rows
from codeloom.operators.filters import junk_path, language_is, long_enough, short_enough
from codeloom.operators.ordering import content_digest, first_n, first_seen
from codeloom.plans.corpus import format_for_training, local_records, prepare_corpus
from codeloom.session import shared_dir
from codeloom.sources.sinks import write_dataset, write_records
from codeloom.sources.tables import choose_splits, read_records, read_table

SQL_SPACES = " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE)


def stripped_sql(text: str) -> str:
    return f"length(trim({text}, {SQL_SPACES}))"


def raw_code(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` under the column names of raw code."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.col("source").alias("repo_name"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
    )


def prepared_sql(lang: str, limit: int | None = None) -> str:
    """Prepared rows in the order of the rules: filters, first of equal contents, first N."""
    return f"""
    SELECT doc_id, text AS code, '{lang}' AS language, source AS repo,
           source || '/' || doc_id || '.txt' AS path, CAST(length(text) AS INTEGER) AS size
    FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS nth
          FROM documents
          WHERE lower(coalesce(lang, '')) = '{lang}' AND {stripped_sql("coalesce(text, '')")} >= 50
            AND length(text) <= 50000)
    WHERE nth = 1 {f'ORDER BY doc_id LIMIT {limit}' if limit else ''}"""


@query("corpus_prepare", prepared_sql("en"))
def corpus_prepare(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_corpus(raw_code(spark, folder), "en", "doc_id", keep=["doc_id"])


@query("corpus_prepare_first", prepared_sql("fr", 50))
def corpus_prepare_first(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_corpus(raw_code(spark, folder), "fr", "doc_id", max_files=50, keep=["doc_id"])


@query(
    "filter_language",
    "SELECT doc_id, text AS content FROM documents WHERE lower(coalesce(lang, '')) = 'de'",
)
def filter_language(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_code(spark, folder)
    return raw.where(language_is(F.col("language"), "de")).select("doc_id", "content")


PADDED = "chr(160) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 30 + CAST(doc_id % 41 AS INT)) ELSE text END || chr(12288)"


@query(
    "filter_min_length",
    f"""SELECT doc_id, CAST({stripped_sql("content")} AS INTEGER) AS stripped
    FROM (SELECT doc_id, {PADDED} AS content FROM documents) WHERE {stripped_sql("content")} >= 50""",
)
def filter_min_length(spark: SparkSession, folder: str) -> DataFrame:
    """Every third text is cut near the bound, all are padded with other than plain spaces."""
    cut = F.when(
        F.col("doc_id") % 3 == 0,
        F.substring("text", F.lit(1), (30 + F.col("doc_id") % 41).cast("int")),
    ).otherwise(F.col("text"))
    padded = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("\xa0\n"), cut, F.lit("　")).alias("content")
    )
    return padded.where(long_enough(F.col("content"))).select(
        "doc_id", stripped_length(F.col("content")).alias("stripped")
    )


@query(
    "filter_max_length",
    """SELECT doc_id, CAST(length(content) AS INTEGER) AS size
    FROM (SELECT doc_id, repeat(text, 25) AS content FROM documents) WHERE length(content) <= 50000""",
)
def filter_max_length(spark: SparkSession, folder: str) -> DataFrame:
    """Texts repeated, so that many are beyond the bound."""
    long = table(spark, folder, "documents").select("doc_id", F.repeat("text", 25).alias("content"))
    return long.where(short_enough(F.col("content"))).select("doc_id", F.char_length("content").alias("size"))


@query("content_hash", "SELECT doc_id, md5(text) AS code_hash FROM documents")
def hash_content(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", content_hash(F.col("text")).alias("code_hash"))


@query(
    "dedup_exact",
    """SELECT doc_id, lang, source, md5(text) AS code_hash
    FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS nth FROM documents)
    WHERE nth = 1""",
)
def dedup_exact(spark: SparkSession, folder: str) -> DataFrame:
    unique = first_seen(table(spark, folder, "documents"), content_digest(F.col("text")), "doc_id", unique_key=True)
    return unique.select("doc_id", "lang", "source", content_hash(F.col("text")).alias("code_hash"))


@query(
    "dedup_hot_group",
    """SELECT min(event_id) AS event_id, event_type FROM events GROUP BY event_type""",
)
def dedup_hot_group(spark: SparkSession, folder: str) -> DataFrame:
    """First row of each of a few very frequent values."""
    events = table(spark, folder, "events")
    return first_seen(events, content_digest(F.col("event_type")), "event_id").select("event_id", "event_type")


@query(
    "split_slice",
    "SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 500",
)
def split_slice(spark: SparkSession, folder: str) -> DataFrame:
    return first_n(table(spark, folder, "documents"), 500, "doc_id").select("doc_id", "lang", "text")


@query(
    "split_slice_large",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem"
    " ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 20000",
)
def split_slice_large(spark: SparkSession, folder: str) -> DataFrame:
    """More rows than a single task should gather, by a compound key."""
    key = ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return first_n(table(spark, folder, "lineitem").select(*key), 20_000, key)


@query(
    "split_choice",
    """SELECT doc_id, lang, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'validation' END AS used_for
    FROM documents""",
)
def split_choice(spark: SparkSession, folder: str) -> DataFrame:
    """No validation split, so the test split stands in."""
    rows = table(spark, folder, "documents").withColumn(
        "split", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test")
    )
    train, validation = choose_splits(rows)
    return (
        train.withColumn("used_for", F.lit("train"))
        .unionByName(validation.withColumn("used_for", F.lit("validation")))
        .select("doc_id", "lang", "used_for")
    )


@query("token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def estimate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query(
    "format_truncate",
    """SELECT doc_id, CASE WHEN length(text) // 4 > 512 THEN substr(text, 1, 2048) ELSE text END AS text
    FROM documents""",
)
def format_truncate(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "documents").withColumnRenamed("text", "code")
    return format_for_training(records, keep=["doc_id"])


BOUNDARY_SQL = "substr(repeat(text, 600), 1, CAST(2046 + doc_id % 8 AS INT))"


@query(
    "format_truncate_boundary",
    f"""SELECT doc_id, CAST(length(code) AS INTEGER) AS before,
           CAST(length(CASE WHEN length(code) // 4 > 512 THEN substr(code, 1, 2048) ELSE code END) AS INTEGER) AS after
    FROM (SELECT doc_id, {BOUNDARY_SQL} AS code FROM documents)""",
)
def format_truncate_boundary(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths on both sides of the budget."""
    code = F.substring(F.repeat("text", 600), F.lit(1), (2046 + F.col("doc_id") % 8).cast("int"))
    cut = table(spark, folder, "documents").select("doc_id", code.alias("code"))
    return cut.select(
        "doc_id",
        F.char_length("code").alias("before"),
        F.char_length(truncate_tokens(F.col("code"))).alias("after"),
    )


@query("text_column", "SELECT doc_id, text, lang AS language FROM documents")
def text_column(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("func_code"), F.col("lang").alias("language")
    )
    return resolve_text(named)


@query(
    "code_summary_pairs",
    """SELECT text AS code, string_split(text, '.')[1] AS summary FROM documents""",
)
def summary_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Token lists joined, the last matching column taken."""
    named = table(spark, folder, "documents").select(
        F.col("lang").alias("code"),
        F.split("text", " ").alias("code_tokens"),
        F.split("text", r"\.")[0].alias("docstring"),
    )
    return code_summary_pairs(named)


PATH_SQL = """source || '/' || CASE doc_id % 9
    WHEN 0 THEN 'src/a' || doc_id || '.py' WHEN 1 THEN '.github/b' || doc_id || '.js'
    WHEN 2 THEN 'preventvenv/c.mjs' WHEN 3 THEN 'node_modules/d/e.py' WHEN 4 THEN 'x.y/f.PY'
    WHEN 5 THEN '__pycache__/g.pyc' WHEN 6 THEN 'h.d/.jsx' WHEN 7 THEN 'lib/i' || doc_id || '.tar.go'
    ELSE 'pkg/__init__.jsx' END"""


def with_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.expr(PATH_SQL))


@query(
    "junk_path",
    f"""SELECT doc_id, path FROM (SELECT doc_id, {PATH_SQL} AS path FROM documents)
    WHERE path NOT LIKE '%.git%' AND path NOT LIKE '%node!_modules%' ESCAPE '!'
      AND path NOT LIKE '%!_!_pycache!_!_%' ESCAPE '!' AND path NOT LIKE '%venv%'""",
)
def drop_junk(spark: SparkSession, folder: str) -> DataFrame:
    return with_path(table(spark, folder, "documents")).where(~junk_path(F.col("path"))).select("doc_id", "path")


@query(
    "path_language",
    f"""SELECT doc_id, path,
        CASE doc_id % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.mjs' WHEN 3 THEN '.py' WHEN 4 THEN '.PY'
          WHEN 5 THEN '.pyc' WHEN 6 THEN '' WHEN 7 THEN '.go' ELSE '.jsx' END AS suffix,
        CASE WHEN doc_id % 9 IN (0, 3, 4) THEN 'python' WHEN doc_id % 9 IN (1, 2, 8) THEN 'javascript' END AS language,
        CASE doc_id % 9 WHEN 0 THEN 'python' WHEN 3 THEN 'python' WHEN 1 THEN 'javascript' WHEN 7 THEN 'go'
          END AS dimension_language
    FROM (SELECT doc_id, {PATH_SQL} AS path FROM documents)""",
)
def path_language(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("path")
    return with_path(table(spark, folder, "documents")).select(
        "doc_id",
        "path",
        file_suffix(path).alias("suffix"),
        language_of(path).alias("language"),
        extension_language(file_suffix(path)).alias("dimension_language"),
    )


@query(
    "local_prepare",
    f"""SELECT text, file, CASE doc_id % 9 WHEN 0 THEN '.py' WHEN 4 THEN '.PY' WHEN 6 THEN '' WHEN 7 THEN '.go'
             ELSE '.jsx' END AS language
    FROM (SELECT *, {PATH_SQL} AS file FROM documents)
    WHERE doc_id % 9 IN (0, 4, 6, 7, 8) AND doc_id % 11 <> 0 AND {stripped_sql("text")} >= 100""",
)
def local_prepare(spark: SparkSession, folder: str) -> DataFrame:
    """File bytes with carriage returns; every eleventh file is not UTF-8."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(
        F.replace("text", F.lit("\n"), F.lit("\r"))
    )
    content = F.encode(text, "UTF-8")
    broken = F.when(F.col("doc_id") % 11 == 0, F.concat(content, F.unhex(F.lit("80")))).otherwise(content)
    files = with_path(table(spark, folder, "documents")).select("path", broken.alias("content"))
    return local_records(files)


@query(
    "total_lines",
    "SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS total_lines FROM documents",
)
def count_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", total_lines(F.col("text")).alias("total_lines"))


def ids_sql(text: str, n: int) -> str:
    return (
        f"list_transform(list_slice(regexp_extract_all({text}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'), 1, {n}),"
        " lambda t: CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 1000 + 1)"
    )


def padded_sql(ids: str, n: int) -> str:
    return f"array_to_string(list_resize({ids}, {n}, 0), ',')"


@query(
    "fixed_length_rows",
    f"""SELECT doc_id, {padded_sql('ids', 128)} AS input_ids,
           repeat('1,', least(len(ids), 127)) || CASE WHEN len(ids) >= 128 THEN '1'
             ELSE repeat('0,', 127 - len(ids)) || '0' END AS attention_mask
    FROM (SELECT doc_id, {ids_sql('text', 128)} AS ids FROM documents)""",
)
def encode_rows(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    rows = fixed_length_rows(documents, max_length=128, keep=["doc_id"])
    return rows.select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), ",").alias("attention_mask"),
    )


@query(
    "paired_rows",
    f"""SELECT item_id, {padded_sql(ids_sql('text', 32), 32)} AS input_ids,
           {padded_sql(ids_sql("string_split(text, '.')[1]", 16), 16)} AS labels
    FROM benchmark""",
)
def encode_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "benchmark").select(
        "item_id", F.col("text").alias("code"), F.split("text", r"\.")[0].alias("summary")
    )
    rows = paired_rows(pairs, max_input=32, max_target=16, keep=["item_id"])
    return rows.select(
        "item_id",
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"),
    )


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


@query("jsonl_roundtrip", prepared_sql("es").replace("SELECT doc_id, ", "SELECT ", 1))
def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared records written as JSON Lines and read back."""
    target = _run_folder(spark)
    write_records(prepare_corpus(raw_code(spark, folder), "es", "doc_id"), target)
    return read_records(spark, target)


@query(
    "dataset_roundtrip",
    """SELECT CASE WHEN length(text) // 4 > 512 THEN substr(text, 1, 2048) ELSE text END AS text FROM documents""",
)
def dataset_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Formatted texts written as a columnar data set and read back."""
    target = _run_folder(spark)
    write_dataset(format_for_training(table(spark, folder, "documents").withColumnRenamed("text", "code")), target)
    return read_table(spark, target)
