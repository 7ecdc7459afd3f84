"""Operator 2: WARC archives compressed with Zstandard.

An archive starts with a skippable frame that holds the dictionary; every record
is a frame of its own, compressed with it.  The reader walks frames by their block
headers, decodes one record at a time and checks version line, mandatory headers,
block length, terminator and payload digest.

Defined results: a null payload is an empty one and counts as equal to other empty
ones; of equal payloads, every row that carries the largest id is a response (so
repeated rows are all responses) and the others revisit it; a null id is never the
largest unless no row of the group has one; a null url is written as ``urn:x-url:none``;
an empty table writes no archive and gives no rows.  A very long payload is a record of its own
size, held once.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common

# Fixed values of the formats.
DICT_MAGIC = 0x184D2A5D  # skippable frame that holds a dictionary
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "2024-01-01T00:00:00Z"
#: Uncompressed bytes after which a new archive begins; bounds a task's memory.
ROLL_BYTES = 8 << 20
DICT_BYTES = 16 << 10
#: Records and bytes from which an archive's dictionary is trained.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 20
LEVEL = 3


class WarcError(ValueError):
    """An archive that breaks the format."""


# -- writing ------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """The bytes of a response record, or of a revisit record without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    url = "urn:x-url:none" if url is None else "".join(c for c in url if c not in "\r\n")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_uri(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uri(refers_to))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def pack_archive(records: list[bytes]) -> bytes:
    """One archive: the dictionary's skippable frame, if one can be trained, then a frame for each record."""
    samples, size = [], 0
    for r in records[:SAMPLE_ROWS]:
        samples.append(r[: SAMPLE_BYTES // 8])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        trained = zstandard.train_dictionary(min(DICT_BYTES, max(512, size // 8)), samples)
    except zstandard.ZstdError:  # too few or too small samples
        trained = None
    raw = trained.as_bytes() if trained else b""
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    head = struct.pack("<II", DICT_MAGIC, len(raw)) + raw if raw else b""
    return head + b"".join(map(packer.compress, records))


def write_archives(pages: DataFrame, uri: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes (page_id, url, payload binary, revisit, refers_to) as archives below ``uri``;
    lazily returns a manifest (archive, n_records, n_bytes)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal n, held, size
            name, data = f"part-{part:06d}-{n:05d}-{common.attempt()}.warc.zst", pack_archive(held)
            common.put(uri, name, data)
            row = pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(held)], "n_bytes": [len(data)]})
            n, held, size = n + 1, [], 0
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, revisit, refers = (c[i].as_py() for c in batch.columns)
                held.append(build_record(page, url, payload, refers, revisit))
                size += len(held[-1])
                if size >= roll_bytes:
                    yield flush()
        if held:
            yield flush()

    cols = pages.select("page_id", "url", "payload", "revisit", "refers_to")
    return cols.mapInArrow(common.tidy(task), "archive string, n_records long, n_bytes long")


# -- reading ------------------------------------------------------------------


def frame_end(data: memoryview, at: int) -> int:
    """Offset behind the Zstandard frame at ``at``, from its header and block headers alone."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise WarcError(f"no frame at byte {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        if pos + 3 > len(data):
            raise WarcError(f"frame at byte {at} is cut off")
        head = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError(f"reserved block type in the frame at byte {at}")
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 * checksum
    if pos > len(data):
        raise WarcError(f"frame at byte {at} is cut off")
    return pos


def parse_record(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one record; raises :class:`WarcError` on a broken one."""
    top, sep, rest = data.partition(b"\r\n\r\n")
    lines = top.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC version line or header end")
    head = {}
    for line in lines[1:]:
        k, colon, v = line.decode().partition(":")
        if not colon:
            raise WarcError(f"header line without a colon: {line[:60]!r}")
        head[k.strip()] = v.strip()
    if missing := [k for k in REQUIRED if k not in head]:
        raise WarcError(f"missing headers: {missing}")
    if not head["Content-Length"].isdigit() or len(rest) != int(head["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {head['Content-Length']} does not fit a block of {len(rest) - 4} bytes")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if ": " in x)
    if head["WARC-Type"] == "response":
        if len(payload) != int(fields.get("Content-Length", -1)):
            raise WarcError("the HTTP Content-Length does not fit the payload")
        if head.get("WARC-Payload-Digest") != f"sha1:{base32_sha1(payload)}":
            raise WarcError("the payload does not fit its digest")
    return {"head": head, "http": fields, "payload": payload}


def read_archive(data: bytes) -> Iterator[tuple[int, dict]]:
    """(offset, record) of each record of one archive, decoded one frame at a time."""
    view, at, trained = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("the dictionary frame is cut off")
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        trained, at = zstandard.ZstdCompressionDict(raw), 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(data):
        if len(data) >= at + 8 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:  # any other skippable frame
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        end = frame_end(view, at)
        try:
            record = unpacker.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        yield at, parse_record(record)
        at = end


SCHEMA = (
    "archive string, offset long, page_id long, target_uri string, record_type string, payload_digest string, "
    "payload_bytes long, refers_to long, payload binary"
)


def read_archives(spark: SparkSession, uri: str, payloads: bool = True, manifest: DataFrame | None = None) -> DataFrame:
    """Records of all ``*.warc.zst`` below ``uri``, or of those that ``manifest`` (archive) lists.
    Archives are read whole, so one must stay under 2 GB."""

    listed = manifest is not None

    def page(value: str | None) -> int | None:
        tail = (value or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows, size = batch.column(0)[i].as_py(), [], 0
                for offset, r in read_archive(common.get(uri, path) if listed else batch.column(1)[i].as_py()):
                    h = r["head"]
                    rows.append((path, offset, page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), int(r["http"].get("Content-Length", len(r["payload"]))), page(h.get("WARC-Refers-To")), r["payload"] if payloads else None))
                    size += len(r["payload"]) if payloads else 0
                    if len(rows) >= 4096 or size >= ROLL_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    if listed:
        return manifest.select("archive").mapInArrow(common.tidy(task), SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(uri)
    return files.select("path", "content").mapInArrow(common.tidy(task), SCHEMA)


# -- the operator ---------------------------------------------------------------


def mark_revisits(pages: DataFrame, min_bytes: int = 0, salts: int = 64) -> DataFrame:
    """page_id, url, payload, revisit, refers_to: of equal payloads of at least ``min_bytes``
    the row with the largest id is the response."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    pages = common.salted(pages.withColumn("digest", F.sha1("payload")), F.col("page_id"), salts)
    keys = pages.drop("url", "payload")
    stats = common.cut(common.group_stats(keys, "digest", {"top": F.max("page_id")}, {"top": F.max("top")}))
    out = common.attach(pages, stats, "digest")
    revisit = ~F.col("page_id").eqNullSafe(F.col("top")) & (F.octet_length("payload") >= min_bytes)
    return out.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to"))


def archive_pages(pages: DataFrame, uri: str, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``uri`` and returns the archives' records as read back."""
    spark = pages.sparkSession
    common.small_batches(spark)
    manifest = common.cut(write_archives(mark_revisits(pages, min_bytes), uri))
    return read_archives(spark, uri, manifest=manifest)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), common.shared_path(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((w{k} >> {35 - 5 * j}) & 31 AS INT) + 1, 1)" for k in range(4) for j in range(8)
)
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS x FROM p),
w AS (
  SELECT page_id, body, {", ".join(f"CAST('0x' || substr(x, {1 + 10 * k}, 10) AS BIGINT) AS w{k}" for k in range(4))},
         max(page_id) OVER (PARTITION BY body) AS top
  FROM h
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM w
"""
