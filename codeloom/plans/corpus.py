"""Corpus preparation: from raw tables, from record files, from a source tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.functions.text import decode_source, file_suffix, stripped_length, truncate_tokens
from codeloom.operators.columns import with_defaults
from codeloom.operators.filters import (
    MAX_CORPUS_CHARS,
    MIN_CORPUS_CHARS,
    MIN_LOCAL_CHARS,
    junk_path,
    language_is,
    long_enough,
    short_enough,
)
from codeloom.operators.ordering import content_digest, first_seen, first_seen_keys, key_list, nth_key, upto, upto_nth
from codeloom.session import written
from codeloom.sources.tree import files_by_extension

RAW_COLUMNS = ["language", "content", "repo_name", "path"]


def accepted(raw: DataFrame, lang: str) -> DataFrame:
    """Rows of one language that are neither too short nor too long."""
    content = F.col("content")
    return with_defaults(raw, RAW_COLUMNS).where(
        language_is(F.col("language"), lang)
        & long_enough(content, MIN_CORPUS_CHARS)
        & short_enough(content, MAX_CORPUS_CHARS)
    )


def record(rows: DataFrame, lang: str, keep: Sequence[str] = ()) -> DataFrame:
    """The output record; ``keep`` adds columns in front."""
    return with_defaults(rows, RAW_COLUMNS).select(
        *keep,
        F.col("content").alias("code"),
        F.lit(lang).alias("language"),
        F.col("repo_name").alias("repo"),
        "path",
        F.char_length("content").alias("size"),
    )


def prepare_corpus(
    raw: DataFrame,
    lang: str = "python",
    order_by: str | Sequence[str] = (),
    max_files: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Filter, drop exact duplicates (first by ``order_by`` wins), keep the first ``max_files``.

    ``order_by`` is required; its values may be null or shared. With ``max_files`` the first key of each
    content is settled on digests and written once (narrow rows), the last key is looked up there,
    and only rows up to it are looked at again.
    """
    keys = key_list(order_by)
    rows = accepted(raw, lang)
    digest = content_digest(F.col("content"))
    if max_files is None:
        return record(first_seen(rows, digest, keys), lang, keep)
    if max_files <= 0:
        return record(rows.limit(0), lang, keep)
    first = written(first_seen_keys(rows, digest, keys), "first-keys")
    found = nth_key(first, max_files)
    reached = rows if found[0] is None else upto(rows, keys, found[0])
    return record(upto_nth(first_seen(reached, digest, keys), first, max_files, *found), lang, keep)


def format_for_training(records: DataFrame, max_length: int = 512, keep: Sequence[str] = ()) -> DataFrame:
    """Only ``text``, cut to the token budget."""
    code = F.coalesce("code", F.lit(""))
    return records.select(*keep, truncate_tokens(code, max_length).alias("text"))


def local_records(files: DataFrame) -> DataFrame:
    """Records of readable, long enough files outside junk paths (from ``path``, ``content``)."""
    path = F.col("path")
    return (
        files.where(~junk_path(path) & F.col("content").isNotNull())
        .select(decode_source(F.col("content")).alias("text"), path.alias("file"), file_suffix(path).alias("language"))
        .where(F.col("text").isNotNull() & (stripped_length(F.col("text")) >= MIN_LOCAL_CHARS))
    )


def local_rejects(files: DataFrame) -> DataFrame:
    """``path, error`` of what gives no record: folders that cannot be listed, files that cannot be read or are no UTF-8."""
    text = decode_source(F.col("content"))
    return files.where(F.col("error").isNotNull() | text.isNull()).select(
        "path", F.coalesce("error", F.lit("not valid UTF-8")).alias("error")
    )


def prepare_local(
    spark: SparkSession, root: str, extensions: Sequence[str] = (".py", ".js")
) -> DataFrame:
    """Records of the source files below ``root``."""
    return local_records(files_by_extension(spark, root, extensions))
