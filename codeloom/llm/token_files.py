"""Token-id files: ids of whole documents in id order, entropy-coded, written and read with Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from codeloom.llm.rans import Segment, encode_segment
from codeloom.llm.tokens import END_ID, encoder, tokenizer_path

# A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 21


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of all documents below ``path``, in ascending order of id.

    A file is a Parquet container with a row a segment: ``part``, ``segment``, ``first`` (ids of the
    part before it), ``ids`` (how many), ``doc_ids``, ``doc_tokens`` and ``data``, the bytes described
    in ``rans``. Documents are range-partitioned and sorted before they are tokenised, so only text
    is shuffled, once; each task holds one segment. Segments are written by Spark's own committer, so
    a lost task leaves nothing behind and any store that Spark writes to will do.

    Defined cases: null text is empty (the end id alone); null ids come last; rows with equal ids
    are in order of a hash of their text; repeated rows are written each; a very long text makes one long
    segment; no rows make an empty table; only id and text are read; vocabularies may be of any size below 2**32.
    """
    file = tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keys = [F.col("id").isNull(), F.col("id"), F.xxhash64("text"), F.col("text").isNull()]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = StructType(
        [
            StructField("part", IntegerType()), StructField("segment", IntegerType()), StructField("first", LongType()),
            StructField("ids", LongType()), StructField("doc_ids", ArrayType(rows.schema["id"].dataType)),
            StructField("doc_tokens", ArrayType(LongType())), StructField("data", BinaryType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(file)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held, lengths, names = bytearray(), [], []
        segment = first = size = 0
        kind = None

        def full() -> pa.RecordBatch:
            data = encode_segment(np.frombuffer(bytes(held), dtype=tokens.code))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                    pa.array([size], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([data], pa.binary()),
                ],
                [f.name for f in schema],
            )

        for batch in batches:
            kind = batch.schema.field("id").type
            for key, ids in zip(batch.column("id").to_pylist(), tokens.batch(batch.column("text"))):
                ids.append(end_id)
                held += memoryview(ids).cast("B")
                size += len(ids)
                names.append(key)
                lengths.append(len(ids))
                if size >= segment_ids:
                    yield full()
                    segment, first = segment + 1, first + size
                    held, lengths, names, size = bytearray(), [], [], 0
        if names:
            yield full()

    ordered.mapInArrow(encode, schema).write.parquet(path)


def _part_starts(segments: DataFrame) -> DataFrame:
    """``part, part_start``: how many ids lie before each part."""
    parts = segments.groupBy("part").agg(F.sum("ids").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_start"))


def read_id_span(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Ids number ``start`` up to ``stop`` of all files below ``path``: one row a segment with ``start``, ``n_tokens``, ``ids``.

    For loaders that begin anywhere: only segments that hold some of these ids are read, and each is
    decoded from its last checkpoint before them. A damaged block is an error that names it. A span
    beyond the last id ends there; an empty span has no rows.
    """
    segments = spark.read.parquet(path)
    own = F.col("part_start") + F.col("first")
    wanted = segments.join(_part_starts(segments), "part").where((own < stop) & (own + F.col("ids") > start) & F.lit(start < stop))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, data in zip(batch.column("own").to_pylist(), batch.column("data")):
                segment = Segment(data.as_py())
                ids = segment.span(max(0, start - place), min(segment.size, stop - place)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([max(start, place)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()], pa.binary())],
                    ["start", "n_tokens", "ids"],
                )

    return wanted.select(own.alias("own"), "data").mapInArrow(cut, "start long, n_tokens long, ids binary")


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents in the files below ``path``: id, ``start``, ``n_tokens``, ``ids``.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit
    integers. Segments decode independently; a damaged one is an error. The table of parts has a
    row for each task that wrote, at most the number of shuffle partitions.
    """
    segments = spark.read.parquet(path)
    parts = _part_starts(segments)
    id_type = segments.schema["doc_ids"].dataType.elementType
    schema = StructType(
        [StructField("id", id_type), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = memoryview(Segment(batch.column("data")[row].as_py()).decode().astype("<u4").tobytes())
                lengths = np.array(batch.column("doc_tokens")[row].as_py(), np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                start = batch.column("part_start")[row].as_py() + batch.column("first")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[row].values,
                        pa.array(starts + start, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([bytes(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                    ],
                    ["id", "start", "n_tokens", "ids"],
                )

    placed = segments.join(parts, "part").select("part_start", "first", "doc_ids", "doc_tokens", "data")
    return placed.mapInArrow(decode, schema).withColumnRenamed("id", id_col)
