"""WARC archives, index first: records are found by file, offset and length, and read in few, long byte ranges.

Writing: each task appends gzip members, one a record, to archive files of its own in the shared folder. What it returns is
the index, a row (archive, offset, length, url, digest) for each record, and the index is the commit: files of a task that
was lost or run twice are in no index. Of records with equal payloads the one with the largest page id is the `response`,
the others are `revisit` records without a payload.

Reading: index rows are dealt by stretches of the archives and sorted, ranges that lie close together are read at once, and
each record is cut out, unpacked and checked against its digest. A selection of index rows reads only what it names.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import materialise, scratch
from tracelens.sources.files import filesystem

#: Bytes after which a task begins another archive file.
ARCHIVE_BYTES = 256 << 20
#: Bytes of archives that one reading task is dealt; the most bytes between two ranges that are read through; the most read at once.
CELL_BYTES, GAP_BYTES, RANGE_BYTES = 8 << 20, 64 << 10, 4 << 20
#: Keys of repeated payloads, of under 100 bytes each, that are broadcast; more are joined by a shuffle.
FEW_KEYS = 100_000
INDEX = "archive string, offset long, length long, url string, digest string"
PAGES = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: What can't stand in a header line: blanks and control characters of a url are written as %XX and come back so.
_UNFIT = re.compile(r"[\x00-\x20\x7f]+")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def page_record(page_id: int | None, row: int, url: str | None, payload: bytes, of: tuple[int | None, int] | None, date: str) -> tuple[bytes, str]:
    """A record's bytes and its payload's digest; `of` is the (page id, row) of the response that a revisit refers to."""
    digest = sha1_base32(payload)
    fields = [("WARC-Type", "response" if of is None else "revisit"), ("WARC-Record-ID", _urn(page_id, row)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _UNFIT.sub(lambda x: quote(x[0]), url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if of is not None:  # the length is a field of our own, which the standard allows
        fields += [("WARC-Refers-To", _urn(*of)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Payload-Length", str(len(payload)))]
    head = _HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    return _record([*fields, ("Content-Type", "application/http; msgtype=response")], head + (payload if of is None else b"")), digest


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page_of(urn: str) -> int | None:
    page = urn.split(":")[2]
    return int(page) if page else None


def originals(rows: DataFrame, least: int) -> DataFrame:
    """(key, original, original_row): of each payload of at least `least` bytes that several rows (key, page_id, row, size) have, the response."""
    best = rows.where(F.col("size") >= least).groupBy("key").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    return best.where("n > 1").select("key", F.col("best.page_id").alias("original"), F.col("best.row").alias("original_row"))


def write_archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row and returns the index (archive, offset, length, url, digest), a table in the shared folder.

    Payloads of fewer than `least` bytes are never revisits. Null payloads are empty, null urls have no target field, a null
    page id counts as smaller than all others. Of rows that are equal in payload and page id one is the response. Payloads are
    compared by SHA-256. A very long payload is a record as any; an empty table gives an empty index. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "pages")  # written, so that a row keeps its number
    keyed = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    copies = materialise(originals(keyed.select("key", "page_id", "row", F.octet_length("payload").alias("size")), least), "copies")
    typed = keyed.join(F.broadcast(copies) if copies.count() <= FEW_KEYS else copies, "key", "left")
    again = F.col("original_row").isNotNull() & (F.col("original_row") != F.col("row"))
    folder = scratch(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        stem, out, name, at, n = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, "", 0, 0
        for batch in batches:
            found = []
            for row in zip(*[batch.column(i) for i in range(batch.num_columns)], strict=True):
                page, link, body, number, revisit, original, original_row = (x.as_py() for x in row)
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, n = f"{stem}-{n:05d}.warc.gz", n + 1
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    info = zlib_member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{stem}:{n}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    at = len(info)
                record, digest = page_record(page, number, link, body, (original, original_row) if revisit else None, date)
                member = zlib_member(record)
                out.write(member)
                found.append((f"{folder}/{name}", at, len(member), link, digest))
                at += len(member)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["archive", "offset", "length", "url", "digest"]) if found else _empty()
        if out is not None:
            out.close()

    return materialise(typed.select("page_id", "url", "payload", "row", again.alias("revisit"), "original", "original_row").mapInArrow(write, INDEX), "index")


def _empty() -> pa.RecordBatch:
    return pa.record_batch([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())], names=["archive", "offset", "length", "url", "digest"])


def zlib_member(data: bytes) -> bytes:
    """A gzip member whose bytes depend on `data` only."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def coalesced(archive: np.ndarray, offset: np.ndarray, length: np.ndarray, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> list[tuple[int, int]]:
    """Runs [i, j) of sorted ranges to be read at once: of one archive, at most `gap` bytes apart, and together of `most` bytes if more than one."""
    runs, i = [], 0
    for j in range(1, len(offset) + 1):
        if j == len(offset) or archive[j] != archive[i] or offset[j] - (offset[j - 1] + length[j - 1]) > gap or offset[j] + length[j] - offset[i] > most:
            runs.append((i, j))
            i = j
    return runs


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the records that index rows name.

    A revisit has no payload; its digest and length are those of the payload it refers to. With payload=False payloads
    are read and checked but not returned. A record that isn't what the index says is an error. An index row that stands
    there twice gives its record twice; an empty index gives no rows.
    """
    schema = PAGES if payload else PAGES.removesuffix(", payload binary")
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 7 if payload else 6]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            archives, digests = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            offsets, lengths = (batch.column(i).to_numpy() for i in (1, 2))
            for i, j in coalesced(np.array(archives, object), offsets, lengths):
                if archives[i] != name:
                    files, path = filesystem(archives[i])
                    name, source = archives[i], files.open_input_file(path)
                data = source.read_at(int(max(offsets[i:j] + lengths[i:j]) - offsets[i]), int(offsets[i]))
                out = []
                for k in range(i, j):
                    start = int(offsets[k] - offsets[i])
                    row = _page_row(zlib.decompress(data[start : start + int(lengths[k])], 31), digests[k])
                    out.append(row if payload else row[:6])
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    total = index.agg(F.sum("length")).first()[0] or 0
    cell = F.floor(F.col("offset") / CELL_BYTES)
    dealt = index.select("archive", "offset", "length", "digest").repartition(max(1, math.ceil(total / CELL_BYTES)), F.col("archive"), cell)
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(read, schema)


def _page_row(record: bytes, digest: str) -> tuple:
    fields, block = parse_record(record)
    body, kind = block.partition(b"\r\n\r\n")[2], fields["WARC-Type"]
    found = sha1_base32(body) if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if found != digest or fields["WARC-Payload-Digest"] != f"sha1:{digest}":
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't have the digest of its index row")
    refers = _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    size = len(body) if kind == "response" else int(fields["Payload-Length"])
    return _page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, refers, size, digest, body if kind == "response" else None


def archive_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives it was written to.

    Defined cases are those of `write_archives` and `read_records`.
    """
    return read_records(write_archives(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
