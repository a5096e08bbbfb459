"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left.

The writer puts each record into a gzip member of its own.  The reader checks each member (inflation, CRC) and each record in
it (version line, headers, length, and the block's and the payload's digests, where they are given in an algorithm that it
knows).  After a failed check it searches the following bytes for the next valid member or, in an archive that isn't
compressed and within a member, the next version line, goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_back, materialise, scratch

#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
MEMBER = b"\x1f\x8b\x08"
#: Bytes of headers that are looked through where records are not compressed; in a member, its own length bounds them.
PLAIN_HEADER_MOST = 1 << 16


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 8 times 5 hex digits make 8 times 4 letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def header_value(text: str | None) -> str:
    return re.sub(r"[\x00-\x20]", "", text or "")


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None = None, name: str = "", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, with an HTTP head before the payload.  A revisit, which refers to another, carries the head alone."""
    revisit = refers_to is not None
    block = HTTP_HEAD + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name or f'page {page_id}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        f"X-Payload-Length: {len(payload)}",
        *([f"X-Refers-To-Page: {refers_to}", f"WARC-Refers-To-Target-URI: {header_value(refers_url)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def payload_of(headers: dict, block: bytes) -> bytes:
    """The block, or for HTTP messages what follows their head."""
    if headers.get("content-type", "").lower().startswith("application/http") and block.startswith(b"HTTP/"):
        _, empty, body = block.partition(b"\r\n\r\n")
        return body if empty else b""
    return block


def digest_holds(stated: str | None, data: bytes) -> bool:
    """Whether the data has the stated digest, in hex or base32; true if none is stated or its algorithm isn't known."""
    name, colon, value = (stated or "").strip().partition(":")
    name, value = (name, value) if colon else ("sha1", name)
    name = name.lower().replace("-", "")
    if not value or name not in ("sha1", "sha256", "sha512", "md5"):
        return True
    digest = hashlib.new(name, data, usedforsecurity=False).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def parse_record(data: bytes, at: int, header_most: int | None = None) -> tuple[dict, bytes, int] | None:
    """(headers, block, end) of the record at that byte, or None if a check fails or the headers are longer than header_most."""
    m = VERSION.match(data, at)
    if not m:
        return None
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0 or header_most is not None and stop - at > header_most:
        return None
    headers, last = {}, None
    for line in data[m.end() : stop].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:  # a folded line
            headers[last] += " " + line.strip().decode("utf-8", "replace")
        elif line:
            name, colon, value = line.partition(b":")
            if not colon:
                return None
            last = name.strip().lower().decode("latin-1")
            headers[last] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    begin, end = stop + 4, stop + 4 + int(length)
    block = data[begin:end]
    if len(block) < int(length) or data[end : end + 4] != b"\r\n\r\n":
        return None
    if not digest_holds(headers.get("warc-block-digest"), block):
        return None
    # a payload is stated without its transfer coding, a revisit's is elsewhere, a segment's is incomplete
    checked = headers.get("warc-type") in ("response", "resource") and "warc-segment-number" not in headers
    head = block[: len(block) - len(payload_of(headers, block))].lower()
    if checked and b"transfer-encoding:" not in head and not digest_holds(headers.get("warc-payload-digest"), payload_of(headers, block)):
        return None
    return headers, block, end + 4


#: Bytes that the inflater is given at once.
FED = 1 << 16


def inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at that byte; None if it is cut short or its CRC is wrong."""
    z, view, out = zlib.decompressobj(31), memoryview(data), []
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + FED]))
            at = min(at + FED, len(data))
    except zlib.error:
        return None
    return (b"".join(out), at - len(z.unused_data)) if z.eof else None


def records_in(content: bytes) -> tuple[list[tuple[dict, bytes]], bool]:
    """The valid records of a member's content, and whether anything else is in it."""
    found, at, rest = [], 0, False
    while at < len(content):
        if record := parse_record(content, at):
            found.append(record[:2])
            at = record[2]
        else:
            rest = True
            at = content.find(b"WARC/1.", at + 1)
            at = len(content) if at < 0 else at
    return found, rest


def valid_at(data: bytes, at: int) -> tuple[list[tuple[dict, bytes]], int, bool] | None:
    """(records, end, whether the member has damage beside them) at that byte."""
    if data.startswith(MEMBER, at):
        if not (got := inflate(data, at)):
            return None
        found, rest = records_in(got[0])
        return (found, got[1], rest) if found else None
    record = parse_record(data, at, PLAIN_HEADER_MOST)  # nothing else bounds the headers here
    return ([record[:2]], record[2], False) if record else None


def salvage(data: bytes) -> Iterator[tuple]:
    """('record', start, end, headers, block) for each valid record and ('gap', start, end, None, None) for the bytes between.

    All records of a member have its bytes; a member that has damage beside its valid records is followed by a gap of its
    bytes.
    """
    at, bad = 0, None
    while at < len(data):
        if found := valid_at(data, at):
            if bad is not None:
                yield "gap", bad, at, None, None
                bad = None
            records, end, rest = found
            for headers, block in records:
                yield "record", at, end, headers, block
            if rest:
                yield "gap", at, end, None, None
            at = end
            continue
        bad = at if bad is None else bad
        following = [x for x in (data.find(MEMBER, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
        at = min(following, default=len(data))
    if bad is not None:
        yield "gap", bad, len(data), None, None


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """The pages with digest, length and, for revisits, the page they refer to."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    groups = (
        rows.where(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("response"), F.max_by("url", "page_id").alias("refers_url"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and response is not null")
    )
    # a payload of very many pages (an empty one, an error page) isn't all one task's
    key = F.concat_ws(" ", "digest", F.col("bytes").cast("string")).alias("key")
    groups = materialise(groups.select(key, "response", "refers_url", "n"), "warc-groups")
    joined = join_back(rows.select("*", key), groups, "key", "n", ["response", "refers_url"])
    refers = F.when((F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), "refers_url")


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES, date: str | None = None,
) -> DataFrame:
    """Writes a record for each row into archives of about archive_bytes below the folder, and returns their list (path, records, bytes).

    Of rows with equal payloads of at least min_bytes the one with the largest id becomes a response and the others revisit
    it; all others are responses.  A null payload is empty; a null id is never referred to unless it is the only kind, and
    then all are responses; rows that repeat the largest id are responses too.  Record ids are unique.  `date` (now) is all
    records' WARC-Date.  An archive belongs to the result only if it is in the list: an attempt that is lost or repeated may
    leave others beside them, under names of its own.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, done, attempt = TaskContext.get().partitionId(), [], uuid.uuid4().hex[:12]
        out, records, size = None, 0, 0

        def close():
            nonlocal out, records, size
            out.close()
            done.append((f"{folder}/{name()}", records, size))
            out, records, size = None, 0, 0

        def name():
            return f"part-{part:06d}-{len(done):05d}-{attempt}.warc.gz"

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url"))):
                page_id, url, payload, digest, refers_to, refers_url = row
                out = out or store.open_output_stream(posixpath.join(root, name()), compression=None)
                own = f"{folder} {attempt} {len(done)} {records}"
                data = member(record_bytes(page_id, url, payload.encode(), digest, refers_to, refers_url, own, date))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    plan = plan_records(pages, id_col, url_col, payload_col, min_bytes)
    return materialise(plan.mapInArrow(write, "path string, records long, bytes long"), "warc-list")


RECORD = "path string, start long, stop long, kind string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark, path: str | list[str], with_payload: bool = False) -> DataFrame:
    """All records of the archives below the path, or of the listed ones, kind 'record', and the quarantined byte gaps, kind 'gap'.

    page_id and refers_to are those of records that this module has written, null in others.  payload_bytes and
    payload_digest are as stated, or of the payload that is there.  An empty archive gives no row, one without any valid
    record a single gap.  Headers of any length are read in gzip members.  An archive is one value, of 2 GB at most.
    """
    schema = RECORD + (", payload string" if with_payload else "")

    def number(text: str | None):
        return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None

    def row(name, kind, start, stop, h, block):
        if kind == "gap":
            return [name, start, stop, kind, *[None] * (6 + with_payload)]
        payload, stated = payload_of(h, block), h.get("warc-payload-digest", "")
        digest = stated.rpartition(":")[2] or base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
        length = number(h.get("x-payload-length"))
        found = [number(h.get("x-page-id")), h.get("warc-target-uri"), len(payload) if length is None else length, digest, h.get("warc-type"), number(h.get("x-refers-to-page"))]
        return [name, start, stop, kind, *found, *([payload.decode("utf-8", "replace")] if with_payload else [])]

    def read(batches):
        kinds = {"string": pa.string(), "long": pa.int64()}
        fields = [(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))]

        def send(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

        for batch in batches:
            for k in range(batch.num_rows):
                name, rows = batch.column("path")[k].as_py(), []
                for found in salvage(batch.column("content")[k].as_py() or b""):
                    rows.append(row(name, *found))
                    if len(rows) == 4096:
                        yield send(rows)
                        rows = []
                if rows:
                    yield send(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path", "content").mapInArrow(read, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages into archives in the shared folder, reads those of the list back and returns a row for each record.

    As `write_warc` treats nulls, ties and repeated rows; pages without a row give none.  Payloads and urls of any length
    come back whole; other columns aren't read, whatever their names.  One row for each archive comes to the driver.
    """
    spark = pages.sparkSession
    paths = [r.path for r in write_warc(pages, scratch(spark, "warc"), min_bytes=min_bytes).select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_warc(spark, paths).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
