"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.operators.bitmap import join_few, key_bitmap, marked, maybe_in  # noqa: F401
from codeloom.session import shared_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    return f"{shared_dir(spark).rstrip('/')}/codeloom-{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and go on from the files.

    Cuts the lineage on storage that survives an executor. Read back, the table has a known size
    (so the planner broadcasts it only below its own threshold) and no partitioning, so a later
    join shuffles both sides and the adaptive planner may split a hot key on either.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replaced(row: str, columns: Sequence[str], new: dict[str, Column]) -> list[Column]:
    """The fields of a struct column and ``new`` ones, which take the place of fields of their name in any case."""
    rest = {n.casefold(): v.alias(n) for n, v in new.items()}
    found = []
    for c in columns:
        if c.casefold() not in {n.casefold() for n in new}:
            found.append(F.col(f"{row}.`{c}`").alias(c))
        elif c.casefold() in rest:
            found.append(rest.pop(c.casefold()))
    return [*found, *rest.values()]


def spark_space(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hash128(value: Column) -> list[Column]:
    """Two independent 64-bit hashes of one value (a different seed each)."""
    return [F.xxhash64(value), F.xxhash64(F.lit(0x5EED), value)]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` as one table a group; only a group and a batch are held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        cut[0] = True
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        starts = [*np.flatnonzero(cut).tolist(), batch.num_rows]
        for i, j in zip(starts, starts[1:]):
            key = tuple(c[i] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    """Return to the system what earlier tasks of this worker freed; a worker that is used again keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``; the worker returns what earlier tasks and this one freed before it goes on or idles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from work(batches)
        give_back()

    return run
