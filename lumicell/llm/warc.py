"""WARC archives: a writer, and a splittable reader, as Spark data sources.

An archive is a series of gzip members, one record each.  The reader cuts files into byte ranges; a task scans
its range for the gzip magic, takes a candidate for a record only if it unpacks to a WARC header, and owns
every record that starts inside its range, reading past the range's end where the last one needs it.  A record that the
end of its file cuts off is an error.

The writer is a commit protocol: each task writes a file of its own, and only files that the driver then
names in the manifest are read, so retried and lost tasks leave nothing that counts.  A folder without a manifest holds archives
from elsewhere: all its ``.warc.gz`` files are read, in the order of their names; so is a path that names one file.
"""

from __future__ import annotations

import hashlib
import re
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lumicell.llm.shared import in_small_batches, shared_folder

LEAST_PAYLOAD = 100
SPLIT_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_BLOCK, _PIECE = 1 << 20, 1 << 14
_MANIFEST = "_manifest.json"
_DATE = "2000-01-01T00:00:00Z"
#: Parts that a group of equal payloads is dealt into when it meets its first record.
_SALTS = 32

SCHEMA = (
    "record_type string, page_id long, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to long"
)


def record(page_id: int | None, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member.  Without a payload it is a revisit of ``refers_to``'s record."""
    kind = "response" if payload is not None else "revisit"
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {payload_bytes}"]
    block = "\r\n".join([*head, "", ""]).encode() + (payload or b"")
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": name(page_id if kind == "response" else f"revisit {page_id}"),
        "WARC-Refers-To": name(refers_to) if kind == "revisit" else None,
        "WARC-Date": _DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
        "X-Page-ID": page_id,
        "X-Payload-Length": payload_bytes,
        "X-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    header = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(header.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple | None:
    """A row of ``SCHEMA`` from an unpacked record, header names in any case; None if it is not a whole one, or its length is no number."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]) if colon}
    number = lambda k: int(fields[k]) if re.fullmatch("[0-9]{1,18}", fields.get(k, "")) else None
    length = number("content-length")
    if length is None or length > len(rest):
        return None
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    digest = digest.removeprefix("sha256:") if digest.startswith("sha256:") else None
    payload = rest[:length].partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and digest and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {fields.get('x-page-id')} does not have its digest")
    return kind, number("x-page-id"), fields.get("warc-target-uri"), payload, number("x-payload-length") if payload is None else len(payload), digest, number("x-refers-to-page-id")


class _Bytes:
    """A file's bytes, read by blocks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.block = file, size, 0, b""

    def at(self, position: int, n: int) -> bytes:
        if not self.start <= position or position + n > self.start + len(self.block):
            self.file.seek(position)
            self.start, self.block = position, self.file.read(max(n, min(_BLOCK, self.size - position)))
        return self.block[position - self.start : position - self.start + n]


def _member(data: _Bytes, position: int) -> tuple[bytes, int] | None:
    """The unpacked gzip member at ``position`` and where it ends; None if no WARC record starts there."""
    unpacker, out, fed = zlib.decompressobj(31), bytearray(), 0
    try:
        while not unpacker.eof:
            piece = data.at(position + fed, min(_PIECE, data.size - position - fed))
            if not piece:
                if out.startswith(b"WARC/"):
                    raise ValueError(f"the record at byte {position} is cut off by the end of its file")
                return None
            out += unpacker.decompress(piece)
            fed += len(piece)
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    return (bytes(out), position + fed - len(unpacker.unused_data)) if out.startswith(b"WARC/") else None


def owned_records(file, size: int, low: int, high: int) -> Iterator[bytes]:
    """Unpacked records that start in ``[low, high)``."""
    data, position = _Bytes(file, size), low
    while position < high:
        window = data.at(position, min(_BLOCK, high + len(_MAGIC) - 1 - position, size - position))
        found = window.find(_MAGIC)
        if found < 0:
            if len(window) < len(_MAGIC):
                return
            position += len(window) - len(_MAGIC) + 1
        elif member := _member(data, position + found):
            yield member[0]
            position = member[1]
        else:
            position += found + 1


@dataclass
class ByteRange(InputPartition):
    file: str | None
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    file: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[ByteRange]:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            files = [("", store.get_file_info(root).size)]
        elif store.get_file_info(f"{root}/{_MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{_MANIFEST}") as f:
                files = json.loads(f.read())
        else:
            found = store.get_file_info(fs.FileSelector(root, recursive=True))
            files = sorted((f.path.removeprefix(root).lstrip("/"), f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".warc.gz"))
        ranges = [ByteRange(name, low, min(size, low + self.split_bytes)) for name, size in files for low in range(0, size, self.split_bytes)]
        return ranges or [ByteRange(None, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        if part.file is None:
            return
        store, root = fs.FileSystem.from_uri(self.path)
        name = f"{root}/{part.file}" if part.file else root
        with store.open_input_file(name) as file:
            for data in owned_records(file, store.get_file_info(name).size, part.low, part.high):
                if row := parse(data):
                    yield row


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        name, size = f"part-{uuid.uuid4()}.warc.gz", 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for r in (r for batch in batches for r in batch.to_pylist()):
                size += out.write(record(r["page_id"], r["target_uri"], r["payload"], r["payload_bytes"], r["payload_digest"], r["refers_to"]))
        return Written(name, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{_MANIFEST}") as out:
            out.write(json.dumps([(m.file, m.size) for m in messages if m and m.size]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.file}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def archive_rows(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """One row of ``SCHEMA`` for each page: a response, or a revisit of the first page with an equal payload.

    The payload is the html in UTF-8, a null one empty.  Of pages with equal payloads of ``least`` bytes or more,
    that with the smallest id is the response (rows that repeat its id too); smaller payloads are all responses.  Groups
    are counted by digest before pages meet them, and a group's pages are dealt over several tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    )
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = groups.filter("n > 1 and first is not null").select(
        F.col("payload_digest").alias("digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("part")
    )
    dealt = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)), F.lit(0)).cast("int"))
    met = dealt.join(repeated, (dealt.payload_digest == repeated.digest) & (dealt.salt == repeated.part), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "target_uri",
        F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(again, F.col("first")).alias("refers_to"),
    )


def write_archives(rows: DataFrame, path: str) -> None:
    """Write rows of ``archive_rows`` below ``path``, a URI that all executors reach; one file for each task."""
    in_small_batches(rows.sparkSession)
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of ``SCHEMA``, one for each record; payloads are checked against their digests.

    A payload of stored (not deflated) bytes that itself holds a whole gzipped WARC record may be taken for one where a
    range starts inside it; the writer here always deflates.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", str(split_bytes)).load(path)


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Archive the pages in the shared folder and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Sizes and digests of responses are taken from the payloads read; those of revisits from their headers.  Repeated
    rows stay, a null id reads back as null, an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    write_archives(archive_rows(pages), path)
    return read_archives(spark, path, split_bytes).select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


#: DuckDB SQL for ``round_trip``.
ROUND_TRIP_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest AS digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM sized LEFT JOIN firsts ON payload_digest = digest
"""
