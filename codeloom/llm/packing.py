"""Cost-balanced packing of documents into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from codeloom.llm.common import give_back, giving_back
from codeloom.llm.tokens import END_ID, REMEMBERED, encoder, forget, tokenizer_path

LENGTH = 1024
# A task packs its rows in blocks that end at this many documents or bytes of ids, so memory is bounded.
BLOCK_DOCS = 8192
BLOCK_BYTES = 32 << 20
# Pieces of a block leave the worker this many at a time: some megabytes, whatever the block holds.
PIECES = 1024
NAMES = ("start", "length", "doc_tokens", "sequence_id", "offset")


def piece_cost(length, linear: float = 1.0, quadratic: float = 1.0 / LENGTH):
    """Estimated work: a part for each token and a part for each pair of tokens that attend."""
    return linear * length + quadratic * length * length


def balance(lengths, size: int = LENGTH, linear: float = 1.0, quadratic: float = 1.0 / LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Place pieces of 1 to ``size`` tokens: ``(piece, from, length, sequence, offset)`` for each part.

    The least number of sequences that holds all tokens is opened. Pieces in descending length go
    to the sequence of lowest cost with room for the whole piece. A piece with no such sequence is
    cut over those with most room, so padding stays below one sequence in all.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    count = -(-int(lengths.sum()) // size)
    used, costs = np.zeros(count, np.int64), np.zeros(count)
    placed = []

    def put(piece: int, start: int, length: int, sequence: int) -> None:
        placed.append((int(piece), start, length, int(sequence), int(used[sequence])))
        used[sequence] += length
        costs[sequence] += piece_cost(length, linear, quadratic)

    cut = []
    for piece in np.argsort(-lengths, kind="stable"):
        length = int(lengths[piece])
        fitting = np.where(used + length <= size, costs, np.inf)
        best = int(fitting.argmin()) if count else 0
        if np.isfinite(fitting[best]):
            put(piece, 0, length, best)
        else:
            cut.append(piece)
    for piece in cut:
        start, whole = 0, int(lengths[piece])
        while start < whole:
            sequence = int(used.argmin())
            length = min(whole - start, size - int(used[sequence]))
            put(piece, start, length, sequence)
            start += length
    return placed


def piece_batches(block: list[tuple[object, np.ndarray]], table: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The pieces of a block, ``PIECES`` a batch; ``table`` has document, start, length, sequence and offset of each."""
    for at in range(0, len(table), PIECES):
        some = table[at : at + PIECES]
        columns = [
            pa.array([block[t[0]][0] for t in some], kind),
            pa.array([t[1] for t in some], pa.int64()),
            pa.array([t[2] for t in some], pa.int64()),
            pa.array([len(block[t[0]][1]) for t in some], pa.int64()),
            pa.array([t[3] for t in some], pa.int64()),
            pa.array([t[4] for t in some], pa.int64()),
            pa.array([block[t[0]][1][t[1] : t[1] + t[2]].astype("<u4").tobytes() for t in some], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", *NAMES, "ids"])


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    size: int = LENGTH,
    end_id: int = END_ID,
    linear: float = 1.0,
    quadratic: float = 1.0 / LENGTH,
    remembered: int = REMEMBERED,
    keep: bool = True,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers. A document's ids
    end with ``end_id``. Its first full sequences are pieces of their own; the rest is packed by
    ``balance`` with the rests of up to 8,192 other documents of the same task. No row is shuffled:
    packing is local to a scan partition, so hot sources, copies and other skew do not matter, and a
    lost task is packed again with the same result (sequence ids come from partition and position).
    At most one sequence a block is not full.

    ``remembered`` bounds the words that a worker keeps the ids of (twice so many, some 400 bytes each): more
    save time, fewer save memory. Without ``keep`` it forgets them, and the tokenizer, at the end of each task: what
    runs in the same workers afterwards has their memory.

    Defined cases: null text is empty, one piece with the end id alone; a text of any length is cut
    into pieces (its ids are held by one task); a null id is passed on; repeated rows are packed
    each; an empty table gives an empty result; only id and text are read.
    """
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    out = StructType([StructField("id", id_type), *(StructField(n, LongType()) for n in NAMES), StructField("ids", BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, remembered).batch
        give_back()
        context = TaskContext.get()
        following = (context.partitionId() if context else 0) << 33
        block: list[tuple[object, np.ndarray]] = []
        held = 0
        kind = None

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal following
            table: list[tuple] = []
            rests, owners = [], []
            for n, (_, ids) in enumerate(block):
                full = len(ids) // size
                for k in range(full):
                    table.append((n, k * size, size, following, 0))
                    following += 1
                if len(ids) > full * size:
                    rests.append(len(ids) - full * size)
                    owners.append((n, full * size))
            parts = balance(rests, size, linear, quadratic)
            for piece, start, length, sequence, offset in parts:
                n, base = owners[piece]
                table.append((n, base + start, length, following + sequence, offset))
            following += -(-sum(rests) // size)
            yield from piece_batches(block, table, kind)

        for batch in batches:
            kind = batch.schema.field("id").type
            for key, ids in zip(batch.column("id").to_pylist(), encode(batch.column("text"))):
                ids.append(end_id)
                block.append((key, np.frombuffer(ids, dtype=ids.typecode)))
                held += len(ids) * 4
                if len(block) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    yield from packed()
                    block, held = [], 0
        if block:
            yield from packed()
        if not keep:
            del encode
            forget(path, remembered)

    return rows.mapInArrow(giving_back(pack), out).withColumnRenamed("id", id_col)
