"""Static range asymmetric numeral system over interleaved lanes, in numpy.

File format of one segment, all numbers little-endian:

- head: ``SEGMENT`` = magic, ids in all, ids a block, number of codes, number of blocks, number of the
  escape code (``NO_ESCAPE``: there is none);
- the frequency table that all blocks share: the id of each code (u4), frequencies less one (u2 each,
  summing to 2**16 with the ones added);
- for each block ``BLOCK`` = ids, lanes, steps between checkpoints, 16-bit words, CRC-32 of the block's
  bytes, CRC-32 of its decoded ids (as u4), escaped ids;
- for each block its checkpoints, its words (u2), then its escaped ids (u4). A checkpoint is the place in
  the words, the number of escaped ids before it and the state of each lane (u4 each). The first is where decoding starts, the others are those after
  each ``steps`` rows of ids, so parts of a block can be decoded side by side;
- CRC-32 of head, table and block heads.

A block of n ids is a table with ``lanes`` columns, filled row by row; lane i codes column i. Where a
segment has more than 2**16 different ids, the most frequent ``HELD`` have codes of their own; the others
share the escape code and stand after the words as they are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"RANSIDS2"
SEGMENT = struct.Struct("<8sQIIII")
BLOCK = struct.Struct("<IHHIIII")
BITS = 16
TOTAL = 1 << BITS
HELD = 1 << 15
NO_ESCAPE = (1 << 32) - 1


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least one that sum to ``TOTAL``, near the given positive counts."""
    if len(counts) > TOTAL:
        raise ValueError(f"more than {TOTAL} codes")
    low, high = 0.0, TOTAL / float(counts.sum())
    for _ in range(50):
        middle = (low + high) / 2
        fits = int(np.maximum(1, np.floor(counts * middle)).sum()) <= TOTAL
        low, high = (middle, high) if fits else (low, middle)
    exact = counts * low
    freq = np.maximum(1, np.floor(exact)).astype(np.int64)
    left = TOTAL - int(freq.sum())
    most = np.argsort(freq - exact, kind="stable")
    freq += left // len(freq)
    freq[most[: left % len(freq)]] += 1
    return freq


def _encode_block(codes: np.ndarray, freq: np.ndarray, base: np.ndarray, lanes: int, every: int, escapes: np.ndarray) -> tuple[bytes, int]:
    rows = -(-len(codes) // lanes)
    state = np.full(lanes, TOTAL, np.uint64)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for row in range(rows - 1, -1, -1):
        part = codes[row * lanes : (row + 1) * lanes]
        n = len(part)
        f, b, x = freq[part], base[part], state[:n]
        full = x >= (f << np.uint64(16))
        words = x[full]
        if len(words):
            out.append((words & np.uint64(0xFFFF)).astype("<u2")[::-1])
            written += len(words)
            x = np.where(full, x >> np.uint64(16), x)
        q = x // f
        state[:n] = (q << np.uint64(BITS)) + (x - q * f) + b
        if row % every == 0:
            marks.append((written, state.astype("<u4")))
    marks.reverse()
    words = np.concatenate(out)[::-1] if out else np.zeros(0, "<u2")
    before = np.searchsorted(escapes, np.arange(len(marks)) * every * lanes)
    body = b"".join(struct.pack("<II", written - at, n) + lane.tobytes() for (at, lane), n in zip(marks, before.tolist()))
    return body + words.tobytes(), written


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different ids in order, the place of each id among them, and their counts."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[ids], counts[distinct]


def _coded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The id of each code, the codes of the ids, their counts, and the escape code."""
    distinct, codes, counts = _numbered(ids)
    if len(distinct) <= TOTAL:
        return distinct, codes, counts, NO_ESCAPE
    held = np.sort(np.argsort(-counts, kind="stable")[:HELD])
    renamed = np.full(len(distinct), HELD, np.int64)
    renamed[held] = np.arange(HELD)
    rest = int(counts.sum() - counts[held].sum())
    return np.append(distinct[held], 0), renamed[codes], np.append(counts[held], rest), HELD


def encode_segment(ids: np.ndarray, block: int = 1 << 18, lanes: int = 1024, every: int = 128) -> bytes:
    """One segment of the file format; ``lanes`` shrinks for short blocks."""
    distinct, codes, counts, escape = _coded(ids)
    freq = frequencies(counts) if len(ids) else np.zeros(0, np.int64)
    base = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    wide = freq.astype(np.uint64)
    heads, bodies = [], []
    for start in range(0, len(ids), block):
        part = codes[start : start + block]
        width = int(min(lanes, max(1, 1 << max(0, (len(part) // 64).bit_length() - 1))))
        raw = ids[start : start + block].astype("<u4")
        escapes = np.flatnonzero(part == escape)
        body, words = _encode_block(part, wide, base, width, every, escapes)
        body += raw[escapes].tobytes()
        heads.append(BLOCK.pack(len(part), width, every, words, zlib.crc32(body), zlib.crc32(raw.tobytes()), len(escapes)))
        bodies.append(body)
    front = SEGMENT.pack(MAGIC, len(ids), block, len(distinct), len(heads), escape) + distinct.astype("<u4").tobytes()
    front += (freq - 1).astype("<u2").tobytes() + b"".join(heads)
    return front + struct.pack("<I", zlib.crc32(front)) + b"".join(bodies)


class Segment:
    """Reader of one segment; blocks, and the stretches between checkpoints, decode independently."""

    def __init__(self, data: bytes):
        magic, self.size, self.block, n, blocks, self.escape = SEGMENT.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = SEGMENT.size
        self.distinct = np.frombuffer(data, "<u4", n, at)
        self.freq = np.frombuffer(data, "<u2", n, at + 4 * n).astype(np.uint32) + np.uint32(1)
        self.base = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint32) if n else self.freq
        self.slots = np.repeat(np.arange(n, dtype=np.uint16), self.freq)
        at += 6 * n
        self.heads = [BLOCK.unpack_from(data, at + i * BLOCK.size) for i in range(blocks)]
        at += blocks * BLOCK.size
        if struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
            raise ValueError("the head of a segment is damaged")
        self.bodies = []
        at += 4
        for ids, lanes, every, words, _, _, escaped in self.heads:
            marks = -(-(-(-ids // lanes)) // every)
            length = marks * 4 * (lanes + 2) + 2 * words + 4 * escaped
            self.bodies.append(memoryview(data)[at : at + length])
            at += length

    def decode_block(self, number: int, check: bool = True) -> np.ndarray:
        ids, lanes, _, _, crc, ids_crc, _ = self.heads[number]
        if check and zlib.crc32(self.bodies[number]) != crc:
            raise ValueError(f"block {number} is damaged")
        rows = -(-ids // lanes)
        found = self.decode_from(number, 0) if rows else np.zeros(0, "<u4")
        if check and zlib.crc32(found.tobytes()) != ids_crc:
            raise ValueError(f"block {number} decodes to other ids")
        return found

    def decode_from(self, number: int, mark: int, rows: int | None = None) -> np.ndarray:
        """Ids from a checkpoint on; ``rows`` limits how many rows of lanes are decoded."""
        ids, lanes, every, words, _, _, escaped = self.heads[number]
        body = self.bodies[number]
        total = -(-ids // lanes)
        marks = -(-total // every)
        stream = np.frombuffer(body, "<u2", words, marks * 4 * (lanes + 2))
        place, before = (int(v) for v in np.frombuffer(body, "<u4", 2, mark * 4 * (lanes + 2)))
        state = np.frombuffer(body, "<u4", lanes, mark * 4 * (lanes + 2) + 8).copy()
        first = mark * every
        last = total if rows is None else min(total, first + rows)
        out = np.empty(min(ids, last * lanes) - first * lanes, np.uint16)
        for row in range(first, last):
            n = min(lanes, ids - row * lanes)
            x = state[:n]
            slot = x & np.uint32(TOTAL - 1)
            code = self.slots[slot]
            out[(row - first) * lanes : (row - first) * lanes + n] = code
            x = self.freq[code] * (x >> np.uint32(BITS)) + slot - self.base[code]
            low = np.flatnonzero(x < TOTAL)
            if len(low):
                x[low] = (x[low] << np.uint32(16)) | stream[place : place + len(low)]
                place += len(low)
            state[:n] = x
        found = self.distinct[out]
        if escaped:
            at = np.flatnonzero(out == self.escape)
            raw = np.frombuffer(body, "<u4", escaped, marks * 4 * (lanes + 2) + 2 * words)
            found[at] = raw[before : before + len(at)]
        return found

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids of the segment from ``start`` up to ``stop``; decodes from the checkpoints before them only."""
        parts = [np.zeros(0, "<u4")]
        for number, (ids, lanes, every, _, crc, _, _) in enumerate(self.heads):
            low, high = max(0, start - number * self.block), min(ids, stop - number * self.block)
            if low >= high:
                continue
            if zlib.crc32(self.bodies[number]) != crc:
                raise ValueError(f"block {number} is damaged")
            mark = low // lanes // every
            first = mark * every * lanes
            parts.append(self.decode_from(number, mark, -(-(high - first) // lanes))[low - first : high - first])
        return np.concatenate(parts)

    def blocks(self) -> Iterator[np.ndarray]:
        for number in range(len(self.heads)):
            yield self.decode_block(number)

    def decode(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *self.blocks()])
