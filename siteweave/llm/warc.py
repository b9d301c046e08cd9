"""WARC archives: a writer of one gzip member per record, and a reader that splits archives at any byte.

``write`` describes pages (payload digest; a payload seen before becomes a revisit of the page with the smallest id) and writes them with
the data source ``warc``: every task streams records into archives of about ``archive_bytes``, and the commit moves the archives of accepted
attempts into place.  ``read`` cuts archives into byte ranges.  A task looks in its range for the three bytes that open a gzip member,
decodes the candidate and takes it only if it opens with a WARC header, ends with the right checksum and is followed by ``AHEAD`` more such
members or by the end of the file; bytes inside compressed data that look like a member fail that, as do short archives stored inside a
record.  From there it goes from member to member.  A record belongs to the range in which its member starts, so every record is read once
wherever the ranges end.  A member that breaks the chain is an error, never skipped.  So is a range that would begin elsewhere than the one
before it ends: a split inside a record that holds a long archive uncompressed, which a larger ``splitBytes`` reads.

Memory: a task holds one record, and a batch of about ``BATCH`` bytes of payloads.

Defined cases: a null html is an empty payload; payloads are compared by SHA-256; every row of the smallest page id of a group is a response (a
repeated row is), and in a group without ids every row is one; null ids come after all others and are left out of the record, as are null
URLs; control characters, blanks and signs beyond ASCII in a URL are percent-encoded in the record; an empty table makes a folder without
archives, which reads as no rows; columns but the three named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from siteweave.sources import files

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 18
#: members that must follow a candidate
AHEAD = 64
#: payload bytes of a batch of rows
BATCH = 8 << 20
#: key parts of a hot payload
SALTS = 32
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, refers_to_url string"


def _base32(hexed):
    """Base32 of 40 hexadecimal digits: ten digits are eight signs."""
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def described(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Pages with payload, digest, record type and what a revisit refers to; payloads under ``least`` bytes are all responses."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    told = rows.select("page_id", "url", F.octet_length("payload").cast("bigint").alias("size"), F.sha2("payload", 256).alias("sha"))
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("url").alias("url"))
    groups = told.where(F.col("size") >= least).groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    # a payload of many pages is met by all parts of its key
    groups = groups.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("sha", F.sha2("payload", 256)).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    again = ~F.col("page_id").eqNullSafe(F.col("first.id")) & F.col("first").isNotNull()
    joined = salted.join(groups, ["sha", "salt"], "left")
    return joined.select(
        "page_id", "url", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), _base32(F.sha1("payload")).alias("payload_digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first.id")).alias("refers_to"),
        F.when(again, F.col("first.url")).alias("refers_to_url"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0,
          archive_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per page to archives below ``path``; ``date`` is when the pages were captured."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    rows = described(pages, id_col, url_col, html_col, least)
    rows.write.format("warc").mode("append").option("archiveBytes", str(archive_bytes)).option("date", date).save(path)


def read(spark: SparkSession, path: str, split_bytes: int = 64 << 20, payload: bool = True) -> DataFrame:
    """A row per record; payloads are decoded and checked in any case, but stay behind with ``payload=False``."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", str(split_bytes)).option("payload", str(payload).lower()).load(path)


class WarcSource(DataSource):
    """Options: ``path``; writing ``archiveBytes``, ``date``, ``level``; reading ``splitBytes``, ``payload``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def record_id(*said: object) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, repr(said)).urn}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]
    return "\r\n".join(lines).encode()


def _uri(url: str | None) -> str | None:
    return None if url is None else quote(url, safe="".join(map(chr, range(33, 127))))


def record(row: dict, date: str) -> list[bytes]:
    """The parts of a WARC record of a described page."""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    body = b"" if revisit else row["payload"]
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"], row["url"], row["payload_digest"])), ("WARC-Date", date),
        ("WARC-Target-URI", _uri(row["url"])), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("Page-ID", row["page_id"])]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"], row["refers_to_url"], row["payload_digest"])),
                   ("WARC-Refers-To-Target-URI", _uri(row["refers_to_url"])), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", row["refers_to"])]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + len(body))]
    return [_header(fields), http, body, b"\r\n\r\n"]


def member(parts: list[bytes], level: int) -> Iterator[bytes]:
    """One gzip member, piece by piece."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    for part in parts:
        for at in range(0, len(part), CHUNK):
            yield packer.compress(part[at: at + CHUNK])
    yield packer.flush()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.archive_bytes, self.date, self.level = int(options.get("archiveBytes", 1 << 30)), options.get("date", "1970-01-01T00:00:00Z"), int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Written:
        store, folder = files.filesystem(files.staging(self.path, self.job))
        names, attempt, out, size = [], uuid.uuid4().hex, None, 0
        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    if out is None or size >= self.archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{attempt}-{len(names):05d}.warc.gz"
                        if not names:
                            store.create_dir(folder, recursive=True)
                        names.append((name, name))
                        out, size = store.open_output_stream(f"{folder}/{name}", compression=None), 0
                        size += self._put(out, self._info(name))
                    row = {f: batch.column(i)[k].as_py() for i, f in enumerate(batch.schema.names)}
                    size += self._put(out, record(row, self.date))
        finally:
            if out is not None:
                out.close()
        return files.Written(names)

    def _put(self, out, parts: list[bytes]) -> int:
        return sum(out.write(piece) for piece in member(parts, self.level))

    def _info(self, name: str) -> list[bytes]:
        said = b"software: siteweave\r\nformat: WARC File Format 1.1\r\n"
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", self.date), ("WARC-Filename", name),
                  ("Content-Type", "application/warc-fields"), ("Content-Length", len(said))]
        return [_header(fields), said, b"\r\n\r\n"]

    def commit(self, messages) -> None:
        files.publish(self.path, self.job, messages, self.overwrite)

    def abort(self, messages) -> None:
        files.discard(self.path, self.job)


@dataclass
class Ranges(InputPartition):
    """Byte ranges of archives: path, size, start, end."""

    ranges: list[tuple[str, int, int, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split, self.payload = options["path"], int(options.get("splitBytes", 64 << 20)), options.get("payload", "true") == "true"

    def partitions(self) -> list[Ranges]:
        """Ranges of about ``splitBytes``; small archives share a task."""
        tasks, held, room = [], [], self.split
        for path, size in files.files(self.path, ".warc.gz"):
            at = 0
            while at < size:
                end = min(size, at + room)
                held.append((path, size, at, end))
                room -= end - at
                at = end
                if room <= 0:
                    tasks.append(Ranges(held))
                    held, room = [], self.split
        return [*tasks, Ranges(held)] if held or not tasks else tasks

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = files.filesystem(self.path)
        rows, size = [], 0
        for path, length, start, end in partition.ranges:
            with store.open_input_file(path) as file:
                for _, raw in records(file, length, start, end):
                    row = page(raw)
                    if row is None:
                        continue
                    size += len(row["payload"] or b"")
                    if not self.payload:
                        row["payload"] = None
                    rows.append(row)
                    if size >= BATCH or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_url", pa.string())])


def records(file, length: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the records whose member starts in ``[start, end)``."""
    at = _synchronised(file, length, start, end)
    if at < 0:
        if start == 0 < end:
            raise ValueError("damaged record at byte 0")
        return
    while at < end:
        found = decoded(file, at, length)
        if found is None:
            raise ValueError(f"damaged record at byte {at}")
        yield at, found[0]
        at = found[1]
    # whoever reads on must begin where this range ends, else one of the two reads an archive inside a record
    if at < length and (other := _synchronised(file, length, end, at + 1)) != at:
        raise ValueError(f"a record ends at byte {at}, but one seems to begin at byte {other}: read with a larger splitBytes")


def _synchronised(file, length: int, start: int, end: int) -> int:
    """Offset of the first member in ``[start, end)`` that ``AHEAD`` more follow, or all up to the end of the file; -1 without any."""
    at = start
    while (at := _candidate(file, at, end)) >= 0:
        further, n = at, 0
        while n <= AHEAD and further < length and (found := decoded(file, further, length)):
            further, n = found[1], n + 1
        if n > AHEAD or further == length:
            return at
        if start == 0 == at:
            return at  # a file begins with a member, damaged ones may follow
        at += 1
    return -1


def _candidate(file, at: int, end: int) -> int:
    """Offset of the next three magic bytes that start before ``end``; -1 without any."""
    while at < end:
        file.seek(at)
        data = file.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        k = data.find(MAGIC)
        if k >= 0:
            return at + k
        at += max(1, len(data) - len(MAGIC) + 1)
    return -1


def decoded(file, at: int, length: int) -> tuple[bytes, int] | None:
    """Content and end of the member at an offset; None if it is no WARC record, is damaged, or neither a member nor the end follows."""
    file.seek(at)
    unpack, parts, fed, known = zlib.decompressobj(31), [], at, False
    try:
        while not unpack.eof:
            data = file.read(4096 if not known else CHUNK)
            if not data:
                return None
            fed += len(data)
            parts.append(unpack.decompress(data))
            if not known and sum(map(len, parts)) >= 7:
                if not b"".join(parts).startswith(b"WARC/1."):
                    return None
                known = True
    except zlib.error:
        return None
    content, end = b"".join(parts), fed - len(unpack.unused_data)
    if not content.startswith(b"WARC/1.") or b"\r\n\r\n" not in content:
        return None
    if end < length:
        file.seek(end)
        if file.read(len(MAGIC)) != MAGIC:
            return None
    return content, end


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def page(raw: bytes) -> dict | None:
    """The row of a response or revisit record, its digest computed anew; None for other records."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is not as long as it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda name: int(fields[name]) if name in fields else None
    row = {"page_id": number("page-id"), "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": len(payload), "payload_digest": said,
           "record_type": kind, "refers_to": number("refers-to-page-id"), "refers_to_url": fields.get("warc-refers-to-target-uri")}
    if kind == "revisit":  # the payload is with the record it refers to
        row |= {"payload": None, "payload_bytes": int(_fields(http).get("content-length", 0))}
    elif (digest := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != said:
        if said:
            raise ValueError(f"payload of record {fields.get('warc-record-id')} has digest {digest}, not {said}")
        row["payload_digest"] = digest
    return row
