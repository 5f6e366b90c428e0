"""WARC archives: written with segmentation and chunked framing, reassembled on reading."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.llm.common import spool

CRLF = b"\r\n"
# Payload bytes in one record; longer ones are continued in further records.
SEGMENT_BYTES = 1 << 20
# A volume ends with the record that brings it to so many bytes.
VOLUME_BYTES = 32 << 20
CHUNK_BYTES = 8 << 10
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; a size that does not fit, or a missing end, is an error."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk is not as long as it says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + f"{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + CRLF + CRLF


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record of one archive, plain or gzip members."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = stream.readline()
        while line in (CRLF, b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not start with its version")
        fields: dict[str, str] = {}
        last = ""
        while (line := stream.readline()) not in (CRLF, b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and last:
                fields[last] += " " + text.strip()
            elif ":" in text:
                last, value = text.split(":", 1)
                last = last.strip().lower()
                fields[last] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield fields, block


def page_records(
    key: str, url: str | None, payload: bytes, refers_to: str | None, digest: str, segment_bytes: int = SEGMENT_BYTES
) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response in as many segments as it needs."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A") or None
    own = {
        "WARC-Type": "response", "WARC-Record-ID": f"<{key}>", "WARC-Date": DATE, "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is not None:
        own |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT, "WARC-Refers-To": f"<{refers_to}>"}
        # An extension field: the length of the payload that is not repeated.
        yield record(own | {"X-Payload-Length": len(payload)}, http)
        return
    block = http + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record(own, block)
        return
    yield record(own | {"WARC-Segment-Number": 1}, parts[0])
    for number, part in enumerate(parts[1:], 2):
        yield record(
            {
                "WARC-Type": "continuation", "WARC-Record-ID": f"<{key}:{number}>", "WARC-Date": DATE,
                "WARC-Target-URI": target, "WARC-Segment-Number": number, "WARC-Segment-Origin-ID": f"<{key}>",
                "WARC-Segment-Total-Length": len(block) if number == len(parts) else None,
            },
            part,
        )


def with_responses(pages: DataFrame, id_col: str, body: Column, min_bytes: int) -> DataFrame:
    """``pages(row columns ...)`` plus digest and the key of the response that a page revisits.

    Digests are grouped on a narrow table; its groups of several pages are joined back to the
    pages, whose frequent digests the adaptive planner splits.
    """
    digests = pages.select("id", "place", F.sha1(body).alias("sha"), F.octet_length(body).alias("n")).where(F.col("n") >= min_bytes)
    last = F.max(F.struct(F.col("id").isNotNull().alias("named"), "id", "place"))
    groups = spool(
        digests.groupBy("sha").agg(last.alias("r"), F.count("*").alias("copies")).where("copies > 1")
        .select(F.col("sha").alias("g_sha"), F.col("r.id").alias("r_id"), F.col("r.place").alias("r_place")),
        "warc-groups",
    )
    own = pages.withColumn("sha", F.when(F.octet_length(body) >= min_bytes, F.sha1(body)))
    return own.join(groups, own["sha"] == groups["g_sha"], "left")


def _key(page: Column, place: Column) -> Column:
    """Record name of a page: its id, if it has one, and its place, which tells repeated ids apart."""
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), place.cast("string"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    volume_bytes: int = VOLUME_BYTES,
) -> None:
    """Write a WARC 1.1 record for each page below ``path``, one uncompressed archive a volume.

    Of pages with equal payloads (SHA-1 and nothing shorter than ``min_bytes``) the one with the
    largest id is a response, the others are revisits that refer to it. Payloads are in chunked
    framing; blocks above ``segment_bytes`` go on in continuation records. Archives are written by
    Spark's text writer with the blank lines between records as its separator, so the files are
    plain WARC, land on any store that Spark writes to, and lost tasks leave nothing behind.

    Defined cases: null html is an empty payload; a null id gets a nameless record, and is never
    preferred as the response; repeated ids get records of their own, the later in scan order
    counts as larger; a null or odd URL is left out or has its line breaks escaped; no pages make an
    empty folder. ``pages`` must be deterministic (a table or files), as it is read twice.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("body"), F.monotonically_increasing_id().alias("place"),
    )
    placed = with_responses(rows, "id", F.col("body"), min_bytes)
    revisits = F.col("g_sha").isNotNull() & (F.col("place") != F.col("r_place"))
    planned = placed.select(
        _key(F.col("id"), F.col("place")).alias("key"), "url", "body",
        F.when(revisits, _key(F.col("r_id"), F.col("r_place"))).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        volume = size = 0
        for batch in batches:
            texts, volumes, held = [], [], 0
            for key, url, body, refers in zip(*(batch.column(c) for c in ("key", "url", "body", "refers_to"))):
                payload = body.as_py()
                if size >= volume_bytes:
                    volume, size = volume + 1, 0
                for data in page_records(key.as_py(), url.as_py(), payload, refers.as_py(), sha1_base32(payload), segment_bytes):
                    # The writer puts the two line ends after each record.
                    texts.append(data[:-4])
                    volumes.append(f"{part:06d}-{volume:05d}")
                    size += len(data)
                    held += len(data)
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(volumes)], ["value", "volume"])
                    texts, volumes, held = [], [], 0
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(volumes)], ["value", "volume"])

    records = planned.mapInArrow(write, "value binary, volume string")
    records.select(F.col("value").cast("string").alias("value"), "volume").write.partitionBy("volume").option("lineSep", "\r\n\r\n").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``: type, record id, fields for segments, and block.

    Archives (plain or gzip) are read whole by a task each; ``write_warc`` bounds theirs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    schema = (
        "type string, record_id string, refers_to string, digest string, payload_length long, segment int, "
        "origin string, total_length long, block binary"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def angle(value: str | None) -> str | None:
        return value.strip("<>") if value else None

    def number(value: str | None) -> int | None:
        return int(value) if value else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for f, block in parse_records(content.as_py()):
                    rows.append(
                        (
                            f.get("warc-type"), angle(f.get("warc-record-id")), angle(f.get("warc-refers-to")),
                            (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, number(f.get("x-payload-length")),
                            number(f.get("warc-segment-number")), angle(f.get("warc-segment-origin-id")),
                            number(f.get("warc-segment-total-length")), block,
                        )
                    )
                    held += len(block)
                    if held >= 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(read, schema)


def reassembled(records: DataFrame) -> DataFrame:
    """Records with continuations put back: grouped by origin, ordered by segment number, checked.

    ``problem`` names what is wrong with a segmented record (a segment missing or doubled, a total
    that does not fit); its block is null then. Records in one piece pass without a shuffle.
    """
    segmented = F.col("segment").isNotNull()
    whole = records.where(~segmented).withColumn("problem", F.lit(None).cast("string"))
    origin = F.coalesce("origin", "record_id")
    first = F.col("segment") == 1
    # One group is one record, whose block some task has to hold anyway.
    groups = (
        records.where(segmented)
        .groupBy(origin.alias("record_id"))
        .agg(
            *(F.max(F.when(first, F.col(c))).alias(c) for c in ("type", "refers_to", "digest", "payload_length")),
            F.max("total_length").alias("total_length"),
            F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        )
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    joined = F.expr("aggregate(parts, X'', (a, p) -> a || p.block)")
    problem = (
        F.when(numbers != F.sequence(F.lit(1), F.size("parts")), "segments are missing or doubled")
        .when(F.col("total_length").isNull(), "the last segment is missing")
        .when(F.octet_length("joined") != F.col("total_length"), "the total length does not fit")
    )
    put = groups.withColumn("joined", joined).withColumn("problem", problem).select(
        "type", "record_id", "refers_to", "digest", "payload_length", F.lit(None).cast("int").alias("segment"),
        F.lit(None).cast("string").alias("origin"), "total_length",
        F.when(F.col("problem").isNull(), F.col("joined")).alias("block"), "problem",
    )
    return whole.unionByName(put)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Pages in the archives below ``path``.

    ``record_id``, ``record_type``, ``refers_to`` (record id), ``payload`` (null for a revisit),
    ``payload_bytes``, ``payload_digest`` and ``problem`` (null if the record is sound). Payloads are
    taken out of the HTTP message and its chunked framing, and held against the digest in the record.
    """
    rows = reassembled(read_records(spark, path)).where(F.col("type").isin("response", "revisit"))
    rows = rows.select("record_id", "type", "refers_to", "digest", "payload_length", "block", "problem")
    schema = "record_id string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string, problem string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def payload(kind: str, digest: str | None, length: int | None, block: bytes | None, problem: str | None):
        if kind == "revisit" or block is None:
            return None, length, digest, problem
        head, _, body = block.partition(CRLF + CRLF)
        fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
        try:
            if fields.get(b"transfer-encoding") == b"chunked":
                body = unchunked(body)
        except ValueError as error:
            return None, None, digest, str(error)
        found = sha1_base32(body)
        return body, len(body), found, "the payload has another digest" if digest and digest != found else problem

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [payload(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("type", "digest", "payload_length", "block", "problem")))]
            columns = [batch.column("record_id"), batch.column("type"), batch.column("refers_to")]
            columns += [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds[3:])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(decode, schema)


def page_of(record_id: Column) -> Column:
    """Page id in the name that ``write_warc`` gives a record, null if it has none."""
    return F.nullif(F.regexp_extract(record_id, r"\Aurn:page:(.*):\d+\z", 1), F.lit(""))
