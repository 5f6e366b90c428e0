"""Packing, token files and WARC: exact round trips and small cases."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.llm.packing import NAMES, PIECES, balance, pack_documents, piece_batches
from codeloom.llm.rans import NO_ESCAPE, Segment, encode_segment, frequencies
from codeloom.llm.token_files import read_id_span, read_token_files, write_token_files
from codeloom.llm.tokens import Encoder, tokenizer_path
from codeloom.llm.warc import chunked, page_of, parse_records, read_records, read_warc, reassembled, record, unchunked, write_warc

ROWS = [(1, "Hello world, it's me."), (2, None), (3, ""), (None, "null id"), (4, "long " * 30_000), (1, "again"), (5, "same"), (5, "same"), (6, " a  b \n\n c ")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")


def test_encoder_is_the_tokenizer(tokenizer):
    encoder = Encoder(tokenizer_path())
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " ", "a", "it's", "Ωé", "12", "½", "!", ",", "..", "<|endoftext|>", "\r\n", "x y", " ", "\x1c", "Word,", "中文", "𝒳", "́", " and"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert list(encoder.ids(text)) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_batch_is_encoded_in_slices(tokenizer, monkeypatch):
    from codeloom.llm import tokens

    monkeypatch.setattr(tokens, "SLICE", 3)
    texts = [*(t for _, t in ROWS), "last one"]
    got = [list(ids) for ids in Encoder(tokenizer_path()).batch(pa.array(texts))]
    assert got == [ids_of(tokenizer, t)[:-1] for t in texts] and list(Encoder(tokenizer_path()).batch(pa.array([], pa.string()))) == []


def test_words_are_forgotten_after_a_task(spark):
    """Later work in the same Python workers does not have the packer's words and tokenizer beside it."""

    def held(batches):
        from codeloom.llm import tokens

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(tokens._ENCODERS)])], ["n"])

    packed = [tuple(p) for p in pack_documents(table(spark).coalesce(1), remembered=99).collect()]
    before = spark.range(64, numPartitions=32).mapInArrow(held, "n long").agg(F.max("n")).first()[0]
    assert [tuple(p) for p in pack_documents(table(spark).coalesce(1), remembered=98, keep=False).collect()] == packed
    assert spark.range(64, numPartitions=32).mapInArrow(held, "n long").agg(F.max("n")).first()[0] <= before


def test_packing(spark, tokenizer):
    pieces = pack_documents(table(spark)).collect()
    assert pack_documents(table(spark, [])).count() == 0
    want = sorted(ids_of(tokenizer, t) for _, t in ROWS)
    for key in (1, 5):
        mine = [p for p in pieces if p.doc_id == key]
        assert sum(p.length for p in mine) == sum(len(ids_of(tokenizer, t)) for i, t in ROWS if i == key)
    assert sum(p.length for p in pieces) == sum(map(len, want))
    sequences = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        sequences.setdefault(p.sequence_id, []).append(p)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    for key in (2, 3, 4, 6, None):
        mine = sorted((p for p in pieces if p.doc_id == key), key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in mine]).tolist()
        assert ids == ids_of(tokenizer, dict(ROWS[1:5] + ROWS[8:])[key]) and {p.doc_tokens for p in mine} == {len(ids)}


def test_pieces_leave_a_few_at_a_time():
    block = [(n, np.arange(n % 7 + 1, dtype=np.uint16)) for n in range(3 * PIECES + 5)]
    table = [(n, 0, len(ids), n, n % 3) for n, ids in block]
    batches = list(piece_batches(block, table, pa.int64()))
    assert [b.num_rows for b in batches] == [PIECES] * 3 + [5]
    rows = pa.Table.from_batches(batches)
    assert list(zip(rows["id"].to_pylist(), *(rows[n].to_pylist() for n in NAMES))) == [(n, s, k, len(block[n][1]), q, o) for n, s, k, q, o in table]
    assert rows["ids"].to_pylist() == [ids.astype("<u4").tobytes() for _, ids in block]


def test_balance_keeps_costs_level():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1024) for _ in range(500)]
    placed = balance(lengths)
    assert len({p[3] for p in placed}) == -(-sum(lengths) // 1024)
    done = {}
    for piece, start, length, _, _ in placed:
        done.setdefault(piece, []).append((start, length))
    for piece, parts in done.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == lengths[piece]
    assert balance([]) == [] and balance([3, 3, 2], 4) and sorted(p[2] for p in balance([3, 3, 2], 4)) in ([1, 1, 3, 3],)


def test_word_memory_is_bounded_and_changes_no_id(tokenizer):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["one", "two,", "three.\nfour", "fünf", "a" * 80, "x1", "", "\nsix"], k=40)) for _ in range(60)]
    small = Encoder(tokenizer_path(), remembered=3)
    for text in texts:
        assert [*small.ids(text), 0] == ids_of(tokenizer, text)
        assert len(small.words) <= 3 and len(small.words.older) <= 3


def test_words_with_signs_take_the_ids_of_their_letters(tokenizer):
    """A word of letters with any run of signs behind it does not go through the whole tokenizer, and keeps its ids."""
    rng = random.Random(6)
    signs = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    encoder = Encoder(tokenizer_path())
    for _ in range(3000):
        words = ["".join(rng.choices(["ab", "É", "ñ", "they", "s", "endoftext", "中"], k=rng.randint(0, 3))) for _ in range(4)]
        text = "".join(rng.choice(["", " ", "\n", " <|"]) + w + "".join(rng.choices(signs, k=rng.randint(0, 4))) for w in words)
        assert list(encoder.ids(text)) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    encoder, seen = Encoder(tokenizer_path()), []
    encode = encoder.words.whole
    encoder.words.whole = lambda text: seen.append(text) or encode(text)
    text = "A one### Zwei.&&& d\u00e9j\u00e0,%%% HABLE!!\nDos$$$"
    assert list(encoder.ids(text)) == tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == sorted(["A", "###", ".&&&", ",%%%", "!!", "\n", "$$$"])
    encoder.ids("A three### vier.&&&")
    assert len(seen) == 8


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000, 300_000])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_256).astype(np.uint16)
    data = encode_segment(ids)
    assert (Segment(data).decode() == ids).all()
    if n == 300_000:
        segment = Segment(data)
        _, lanes, every, *_ = segment.heads[0]
        assert (segment.decode_from(0, 1, rows=5) == ids[every * lanes : (every + 5) * lanes]).all()
        assert len(data) < 1.2 * n
    if n > 64:
        broken = bytearray(data)
        broken[-3] ^= 1
        with pytest.raises(ValueError):
            Segment(bytes(broken)).decode()


@pytest.mark.parametrize("distinct", [65_536, 65_537, 70_000])
def test_rans_round_trip_of_large_vocabularies(distinct):
    rng = np.random.default_rng(distinct)
    ids = np.concatenate([np.arange(distinct), rng.integers(0, 5000, 600_000), [2**32 - 1] * (distinct > 65_536)]).astype(np.uint32)
    rng.shuffle(ids)
    segment = Segment(encode_segment(ids))
    assert (segment.escape == NO_ESCAPE) == (distinct == 65_536) and len(segment.heads) == 3
    assert (segment.decode() == ids).all()
    for start, stop in ((0, 1), (131_072, 131_073), (262_000, 530_000), (400_000, len(ids)), (7, 7), (len(ids) - 1, len(ids) + 9)):
        assert (segment.span(start, stop) == ids[start:stop]).all()


def test_a_damaged_block_is_named():
    ids = np.random.default_rng(1).integers(0, 100_000, 600_000).astype(np.uint32)
    broken = bytearray(encode_segment(ids))
    broken[-3] ^= 1
    segment = Segment(bytes(broken))
    assert (segment.span(0, 262_144) == ids[:262_144]).all()
    for decode in (segment.decode, lambda: segment.span(599_999, 600_000)):
        with pytest.raises(ValueError, match="block 2 "):
            decode()


def test_frequencies_sum():
    for counts in ([1], [1, 10**9], [5] * 65_536, [1] * 40_000 + [10**6]):
        f = frequencies(np.array(counts))
        assert f.sum() == 1 << 16 and f.min() >= 1


def test_token_files(spark, tokenizer, tmp_path):
    path = str(tmp_path / "ids")
    write_token_files(table(spark), path, segment_ids=50)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 1, 2, 3, 4, 5, 5, 6, None]
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    texts = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got}
    for key, text in ROWS[1:5] + ROWS[8:]:
        assert texts[key] == ids_of(tokenizer, text)
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    for start, stop in ((0, at), (3, 70), (at - 2, at + 5), (5, 5), (at, at + 1), (-4, 2)):
        span = sorted(read_id_span(spark, path, start, stop).collect(), key=lambda r: r.start)
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r.ids, "<u4") for r in span)])
        assert (ids == every[max(0, start) : stop]).all() and all(len(r.ids) == 4 * r.n_tokens for r in span)
    empty = str(tmp_path / "none")
    write_token_files(table(spark, []), empty)
    assert read_token_files(spark, empty).count() == 0 and read_id_span(spark, empty, 0, 9).count() == 0


def test_op6_and_op10_agree_with_the_tokenizer(spark, small, tokenizer):
    from codeloom.llm import catalog

    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda r: r.doc_id)
    files = {r.doc_id: r for r in catalog.QUERIES["op10_token_files"](spark, small).collect()}
    pieces = {}
    for p in catalog.QUERIES["op6_pack_documents"](spark, small).collect():
        pieces.setdefault(p.doc_id, []).append(p)
    start = 0
    for d in docs:
        ids = np.array(ids_of(tokenizer, d.text), "<u4")
        r = files[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        for p in pieces[d.doc_id]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


PAGES = [(1, "http://a", "x" * 5000), (2, None, "x" * 5000), (3, "u", None), (None, "u", ""), (4, "ä\r\n", "äöü€" * 3000 + "\r\n\r\nWARC/1.1\r\n"), (4, "b", "dup"), (4, "b", "dup"), (5, "c", "one")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, place int")


def test_warc_round_trip(spark, tmp_path):
    path = str(tmp_path / "warc")
    write_warc(pages(spark), path, segment_bytes=1000, volume_bytes=6000)
    records = read_records(spark, path)
    assert records.where("type = 'continuation'").count() > 10
    got = read_warc(spark, path).withColumn("page", page_of(F.col("record_id"))).withColumn("of", page_of(F.col("refers_to"))).collect()
    assert len(got) == len(PAGES) and all(r.problem is None for r in got)
    assert sorted(str((r.page, r.record_type, r.of)) for r in got) == sorted(
        str(x) for x in [("1", "revisit", "2"), ("2", "response", None), ("3", "response", None), (None, "revisit", "3"), ("4", "response", None), ("4", "response", None), ("4", "revisit", "4"), ("5", "response", None)]
    )
    for r in got:
        if r.record_type == "response":
            text = bytes(r.payload).decode()
            assert text in {h or "" for _, _, h in PAGES} and r.payload_bytes == len(r.payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
    by_page = {r.page: r for r in got}
    assert by_page["1"].payload_bytes == 5000 and by_page["1"].payload_digest == by_page["2"].payload_digest


def test_small_payloads_are_not_revisits(spark, tmp_path):
    path = str(tmp_path / "warc")
    write_warc(pages(spark, [(1, "a", "dup"), (2, "b", "dup"), (3, "c", "duplicate"), (4, "d", "duplicate")]), path, min_bytes=5)
    assert sorted((page_of_id(r.record_id), r.record_type) for r in read_warc(spark, path).collect()) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


def page_of_id(name):
    return name.split(":")[2]


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "warc")
    write_warc(pages(spark, []), path)
    assert read_warc(spark, path).count() == 0


def test_broken_segments_are_named(spark):
    kinds = "type string, record_id string, refers_to string, digest string, payload_length long, segment int, origin string, total_length long, block binary"
    rows = [
        ("response", "a", None, None, None, 1, None, None, b"ab"), ("continuation", "a2", None, None, None, 3, "a", 4, b"cd"),
        ("response", "b", None, None, None, 1, None, None, b"ab"), ("continuation", "b2", None, None, None, 2, "b", 5, b"cd"),
        ("response", "c", None, None, None, 1, None, None, b"ab"), ("continuation", "c2", None, None, None, 2, "c", 4, b"cd"),
        ("response", "d", None, None, None, 1, None, None, b"ab"), ("response", "e", None, None, None, None, None, None, b"whole"),
    ]
    got = {r.record_id: r for r in reassembled(spark.createDataFrame(rows, kinds)).collect()}
    assert got["a"].problem == "segments are missing or doubled" and got["b"].problem == "the total length does not fit"
    assert got["c"].problem is None and bytes(got["c"].block) == b"abcd"
    assert got["d"].problem == "the last segment is missing" and bytes(got["e"].block) == b"whole"


def test_framing():
    for payload in (b"", b"x", b"\r\n" * 9000):
        assert unchunked(chunked(payload)) == payload
    assert unchunked(b"3;name=value\r\nabc\r\n0\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"abc", b"2\r\nab\r\n"):
        with pytest.raises(ValueError):
            unchunked(bad)
    import gzip

    data = record({"WARC-Type": "response", "A": 1}, b"x\r\n\r\ny")
    assert [b for _, b in parse_records(gzip.compress(data) + gzip.compress(data))] == [b"x\r\n\r\ny"] * 2
    with pytest.raises(ValueError):
        list(parse_records(data[:-9]))
