"""Predicates of corpus preparation and analysis, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from codeloom.functions.text import stripped_length

# Folder names that hold no source of interest.
JUNK_NAMES = (".git", "node_modules", "__pycache__", ".venv", "venv")

# Length bounds of a corpus file and of a local file.
MIN_CORPUS_CHARS = 50
MAX_CORPUS_CHARS = 50_000
MIN_LOCAL_CHARS = 100


def language_is(language: Column, wanted: str) -> Column:
    """Lower-cased language equals ``wanted`` as given."""
    return F.lower(F.coalesce(language, F.lit(""))) == wanted


def long_enough(text: Column, at_least: int = MIN_CORPUS_CHARS) -> Column:
    return stripped_length(text) >= at_least


def short_enough(text: Column, at_most: int = MAX_CORPUS_CHARS) -> Column:
    return F.char_length(text) <= at_most


def junk_path(path: Column) -> Column:
    """A junk name occurs anywhere in the path, also inside another name."""
    return reduce(lambda a, b: a | b, (F.contains(path, F.lit(n)) for n in JUNK_NAMES))


def has_structure(functions: Column, classes: Column) -> Column:
    """At least one function or class."""
    return (F.size(functions) > 0) | (F.size(classes) > 0)
