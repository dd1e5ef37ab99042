"""Operator 6: Zstandard WARC archives, written and read with Spark.

An archive begins with a skippable frame that holds a dictionary; each record after it is one frame compressed with
that dictionary. The writer lets every task write one archive into a folder of the shared file system: its rows are
frames, and the line separator of the text writer is an empty skippable frame, so what comes out is a plain
archive. The reader takes whole archives, loads the dictionary from the leading frame, finds frame after
frame from the block headers, decodes one frame per record, and validates version, headers, lengths and digest.

Repeated payloads: of the records with equal payloads of at least ``least_bytes`` bytes, the one with the largest
``page_id`` is the response; the others are ``revisit`` records that refer to it and hold the HTTP header alone.

Empty cases: a null ``html`` is an empty payload. A row without ``page_id`` is a revisit where another row has its payload
and a ``page_id``, else a response; rows that share the largest ``page_id`` are all responses. Null ``url`` gives no target.
Other columns are ignored. No rows give no archive, and reading no archive gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY = 0x184D2A5D
FRAME = 0xFD2FB528
#: An empty skippable frame (magic 0x184D2A50, length 0), as text.
SEPARATOR = "P*M\x18\0\0\0\0"
DICTIONARY_BYTES = 32_768
#: Records that an archive's dictionary is made from, and bytes taken of each.
SAMPLES = 200
SAMPLE_BYTES = 4_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "archive string, position long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary, error string"
)


def _record(page_id, url, payload: bytes, refers_to) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained where the samples suffice, else the samples' own bytes."""
    cut = [s[:SAMPLE_BYTES] for s in samples]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, cut)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(cut)[:DICTIONARY_BYTES].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive."""
    first: list[bytes] = []
    compressor = None
    for record in records:
        if compressor is None:
            first.append(record)
            if len(first) < SAMPLES:
                continue
            compressor, lead = _start(first)
            yield lead
            yield from map(compressor.compress, first)
            first = []
        else:
            yield compressor.compress(record)
    if first:
        compressor, lead = _start(first)
        yield lead
        yield from map(compressor.compress, first)


def _start(first: list[bytes]) -> tuple[zstandard.ZstdCompressor, bytes]:
    dictionary = _dictionary(first)
    raw = dictionary.as_bytes()
    return zstandard.ZstdCompressor(level=3, dict_data=dictionary), struct.pack("<II", DICTIONARY, len(raw)) + raw


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``pages(page_id, url, html)`` as archives into the new folder ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_digest", F.sha1("html"))
    latest = rows.where(F.octet_length("html") >= least_bytes).groupBy("_digest").agg(F.max("page_id").alias("_latest"))
    rows = rows.join(latest, "_digest", "left")
    revisits = F.col("_latest").isNotNull() & ~F.col("_latest").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", "html", F.when(revisits, F.col("_latest")).alias("refers_to"))

    def archive(batches):
        def records():
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                    yield _record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())

        held, size = [], 0
        for frame in _frames(records()):
            held.append(frame)
            size += len(frame)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    frames = rows.mapInArrow(archive, "frame binary")
    # the cast keeps the bytes as they are; only the name is "string"
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its headers (RFC 8878)."""
    magic = struct.unpack_from("<I", data, at)[0]
    if magic in SKIPPABLE:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == FRAME:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            head = int.from_bytes(data[end : end + 3], "little")
            if end + 3 > len(data):
                raise ValueError("frame is cut off")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    else:
        raise ValueError(f"no frame at byte {at}")
    if end > len(data):
        raise ValueError("frame is cut off")
    return end


def parse_record(raw: bytes) -> dict:
    """The fields of a decoded record; ``error`` tells what is wrong with it, if anything."""
    out = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "error"))
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        return out | {"error": "no WARC header"}
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out |= {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    missing = [k for k in ("warc-record-id", "warc-type", "warc-date", "content-length") if not fields.get(k)]
    if missing:
        return out | {"error": "missing " + ", ".join(missing)}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "Content-Length does not fit the block"}
    payload, length = rest[:-4], None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
    out["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": length}
    out |= {"payload": payload, "payload_bytes": len(payload)}
    if length is not None and length != len(payload):
        return out | {"error": "HTTP Content-Length does not fit the payload"}
    if out["payload_digest"] and out["payload_digest"] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        return out | {"error": "payload digest differs"}
    return out


def read_records(data: bytes) -> Iterator[tuple[int, dict]]:
    """Position and fields of each record of an archive."""
    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        try:
            end = frame_end(view, at)
        except (ValueError, struct.error, IndexError) as e:
            yield at, parse_record(b"") | {"error": str(e) or "frame is cut off"}
            return  # what follows cannot be found
        magic = struct.unpack_from("<I", view, at)[0]
        if magic == DICTIONARY and at == 0:
            raw = bytes(view[at + 8 : end])
            if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == FRAME:
            try:
                record = parse_record(reader.decompressobj().decompress(view[at:end]))
            except zstandard.ZstdError as e:
                record = parse_record(b"") | {"error": str(e)}
            yield at, record
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, with the columns of ``RECORD``."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]

    def read(batches):
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for position, record in read_records(content.as_py()):
                    rows.append((archive.as_py(), position, *(record[n] for n in names[2:])))
                    size += len(record["payload"] or b"")
                    if size > 8_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(read, RECORD)


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS h, sha1(COALESCE(html, '')) AS x FROM pages),
q AS (SELECT *, MAX(page_id) OVER (PARTITION BY x) AS latest FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string([substr('{_B32}', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM q
"""
