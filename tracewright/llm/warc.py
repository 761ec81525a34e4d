"""WARC archives, index first.

Writing: pages go to gzip archives, a member a record, and each record's archive, offset, length, URL and payload digest
go to an index table. Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is
a response; the others become revisit records without the payload that refer to it. Reading: the index is filtered, its
rows are sorted by archive and offset, neighbouring byte ranges are joined into one read, and the records are parsed and
checked against their digests.

Archives lie in the shared folder, by any file system that pyarrow.fs opens; ``filesystem`` lists the schemes. A task writes to a file name of its own
attempt, so a task that runs again leaves at most a file that no index row names.

Defined cases. Null html: an empty payload. Null url: no target header, null in the index. Null page_id: a record without
an id; among equal payloads an id is larger than none, and without any id all are responses. Rows that repeat the largest
page_id of a payload are all responses. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.storage import Scratch

_INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    text = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _END
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(urllib.parse.quote(c) if c < "!" or c == "\x7f" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload."""
    head, _, rest = data.partition(_END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != _END:
        raise ValueError("record does not end where its length says")
    http, _, payload = block.partition(_END)
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that Spark names by a URI.

    file, hdfs, viewfs (both by libhdfs), s3, gs and gcs, abfs and abfss; s3a and s3n are s3, and dbfs:/ is the mount /dbfs.
    Paths without a scheme are local. Other schemes are refused: write such archives to one of these.
    """
    scheme, colon, rest = folder.partition(":")
    if not colon:
        return fs.LocalFileSystem(), folder
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        return fs.FileSystem.from_uri(f"s3:{rest}")
    if scheme not in ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss"):
        raise ValueError(f"archives can't be written to {scheme}: use file, hdfs, viewfs, s3, gs, abfs or dbfs")
    # file:/path, as Hadoop writes it, has no host.
    return fs.FileSystem.from_uri(f"file://{rest}" if scheme == "file" and not rest.startswith("//") else folder)


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def roles(pages: DataFrame, least_bytes: int = 0, id_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, html and refers_to, which is null for responses.

    id_bytes: the digests that occur twice are broadcast while they need no more bytes than this, so that no page moves;
    beyond it, the same join is a shuffle.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    pages = pages.withColumns({"sha": F.sha1("html"), "size": F.octet_length("html")})
    # Only payloads that occur twice need a decision; the counts are combined before the shuffle.
    twice = pages.filter(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).filter("n > 1").drop("n")
    twice = Scratch(pages.sparkSession, "warc_roles").keep(twice, "twice")
    few = 64 * twice.count() <= id_bytes
    found = pages.join(F.broadcast(twice) if few else twice, ["sha", "size"], "left")
    other = F.when(F.col("page_id") == F.col("first"), None).otherwise(F.col("first"))
    return found.select("page_id", "url", "html", other.alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives below folder and returns the index, lazily: store it before use."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        stream, name, offset, number = None, "", 0, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, other in zip(*(batch.column(k) for k in range(4)), strict=True):
                    page_id, url, payload, other = page_id.as_py(), url.as_py(), payload.as_py(), other.as_py()
                    if stream is None or offset >= roll_bytes:
                        if stream:
                            stream.close()
                        name, offset, number = f"{stem}-{number:04d}.warc.gz", 0, number + 1
                        stream = system.open_output_stream(f"{path}/{name}", compression=None)
                    digest = _sha1(payload)
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(record(page_id, url, payload, digest, other, date)) + pack.flush()
                    stream.write(member)
                    rows.append((name, offset, len(member), page_id, url, digest, "response" if other is None else "revisit"))
                    offset += len(member)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["archive", "offset", "length", "page_id", "url", "digest", "record_type"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        finally:
            if stream:
                stream.close()

    return roles(pages, least_bytes).mapInArrow(store, _INDEX)


def coalesced(rows: list[tuple[str, int, int]], gap: int, most: int) -> list[tuple[str, int, int, int, int]]:
    """Byte ranges (archive, begin, end, first row, row after the last) that cover sorted rows (archive, offset, length)."""
    out: list[list] = []
    for k, (archive, offset, length) in enumerate(rows):
        if out and out[-1][0] == archive and offset - out[-1][2] <= gap and offset + length - out[-1][1] <= most:
            out[-1][2], out[-1][4] = max(out[-1][2], offset + length), k + 1
        else:
            out.append([archive, offset, offset + length, k, k + 1])
    return [tuple(x) for x in out]


def read(index: DataFrame, folder: str, where: Column | None = None, gap: int = 64 << 10, most: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """The records of the selected index rows, with the payload (null for revisits) if asked for."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        name, handle = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            digests, urls = batch.column("digest").to_pylist(), batch.column("url").to_pylist()
            for archive, begin, end, i, j in coalesced(rows, gap, most):
                if archive != name:
                    if handle:
                        handle.close()
                    name, handle = archive, system.open_input_file(f"{path}/{archive}")
                data = handle.read_at(end - begin, begin)
                out = []
                for k in range(i, j):
                    at = rows[k][1] - begin
                    fields, http, payload = parse(zlib.decompress(data[at : at + rows[k][2]], 31))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if digest != digests[k] or kind == "response" and _sha1(payload) != digest:
                        raise ValueError(f"{archive} at {rows[k][1]}: the payload doesn't match its digest")
                    other = _number(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    row = (_number(fields["WARC-Record-ID"]), urls[k], int(http["Content-Length"]), digest, kind, other)
                    out.append((*row, payload if kind == "response" else None) if with_payload else row)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)
        if handle:
            handle.close()

    chosen = index if where is None else index.filter(where)
    ranges = chosen.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ranges.mapInArrow(load, _RECORD + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives all pages in the shared folder and reads all records back."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path("archives")
    index = scratch.keep(write(pages, folder, least_bytes), "index")
    return read(index, folder)
