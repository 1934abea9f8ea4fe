"""Web archives (WARC, plain or gzip) as a Spark data source: HTML responses to rows (S10, X18), rows to archives.

``spark.read.format("warc")`` cuts every archive into byte ranges of ``splitBytes``, a partition each, so a large archive is
read by many tasks.  A gzip archive holds a member per record: a range owns the members that start in it, finds its first one
by the member's signature (which must unpack to a record's first line), and reads its last one beyond the range's end.  A plain
archive is walked by the records' stated lengths, of which a range reads the headers before it only.  An archive that is one
single member has all its records in its first range.  A member whose payload is itself a stored archive could be taken for one;
``splitBytes`` 0 reads such archives whole.

Only response records whose Content-Type contains ``text/html`` are kept; bodies are decoded as UTF-8 ignoring bad
bytes.  The per-record parsing is a small helper over a byte stream; everything downstream (H1-H4) is native Spark.

``df.write.format("warc").mode("append").save(path)`` writes rows (url, content_type, body, and, if there, warc_type) as
archives of a member per record, one per task; a task's file gets its name when the job commits, so a task that runs twice
leaves one file.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = T.StructType([T.StructField("archive", T.StringType()), T.StructField("record_pos", T.LongType()),
                       T.StructField("record_no", T.IntegerType()), T.StructField("url", T.StringType()),
                       T.StructField("content_type", T.StringType()), T.StructField("html", T.StringType())])
SPLIT_BYTES = 128 << 20
MAGIC = b"\x1f\x8b\x08"       # how a gzip member begins
FIRST = b"WARC/"              # how a record begins


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.decode("latin-1").split("\r\n")[1:]:
        if ":" in line:
            k, v = line.split(":", 1)
            out.setdefault(k.strip().lower(), v.strip())
    return out


def record_head(stream) -> dict[str, str] | None:
    """The WARC headers of the next record, the stream left at its payload; None at the end."""
    line = stream.readline()
    while line and not line.strip():
        line = stream.readline()
    if not line:
        return None
    head = [line]
    while (h := stream.readline()) not in (b"", b"\r\n", b"\n"):
        head.append(h)
    return _headers(b"".join(head).replace(b"\r\n", b"\n").replace(b"\n", b"\r\n"))


def payload_length(head: dict[str, str]) -> int:
    return int(head.get("content-length", "0") or 0)


def iter_warc(stream) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Yield (record type, WARC headers, payload bytes) from an uncompressed WARC stream."""
    while (head := record_head(stream)) is not None:
        yield head.get("warc-type", ""), head, stream.read(payload_length(head))


def decoded_body(body: bytes, headers: dict[str, str]) -> bytes:
    """The HTTP body without its transfer and content encodings; bytes that don't fit them stay as they are."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                size = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if size == 0:
                break
            out.append(body[end + 2:end + 2 + size])
            at = end + 4 + size
        body = b"".join(out) if out else body
    coding = headers.get("content-encoding", "").lower()
    try:
        if "gzip" in coding:
            return zlib.decompressobj(31).decompress(body)
        if "deflate" in coding:
            return zlib.decompressobj().decompress(body)
    except zlib.error:
        pass
    return body


def html_response(rtype: str, head: dict[str, str], payload: bytes) -> tuple[str, str, str] | None:
    """(url, content type, decoded html) of an HTML response record, None for any other."""
    if rtype != "response":
        return None
    sep = payload.find(b"\r\n\r\n")
    http_head, body = (payload[:sep + 2], payload[sep + 4:]) if sep >= 0 else (payload, b"")
    headers = _headers(http_head)
    ctype = headers.get("content-type", "")
    if "text/html" not in ctype:
        return None
    return head.get("warc-target-uri", ""), ctype, decoded_body(body, headers).decode("utf-8", errors="ignore")


class _Member(io.RawIOBase):
    """The unpacked bytes of the gzip member at ``at``; afterwards ``end`` is where it ended in the file."""

    def __init__(self, file, at: int, chunk: int = 1 << 16):
        file.seek(at)
        self.file, self.chunk, self.read_to = file, chunk, at
        self.unpack, self.held = zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held and not self.unpack.eof:
            packed = self.unpack.unconsumed_tail
            if not packed:
                packed = self.file.read(self.chunk)
                self.read_to += len(packed)
                if not packed:  # cut off
                    return 0
            self.held = self.unpack.decompress(packed, 1 << 20)
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n

    @property
    def end(self) -> int:
        while not self.unpack.eof and self.read(1 << 20):  # what was not read
            pass
        return self.read_to - len(self.unpack.unused_data)


def next_member(file, at: int, end: int) -> int | None:
    """The first place in [at, end) where a gzip member that holds a record begins."""
    tail, place = b"", at
    while place < end + len(MAGIC) - 1:
        file.seek(place)
        block = file.read(min(1 << 20, end + len(MAGIC) - 1 - place))
        if not block:
            return None
        joined, start = tail + block, place - len(tail)
        i = joined.find(MAGIC)
        while i >= 0 and start + i < end:
            try:
                if _Member(file, start + i).read(len(FIRST)) == FIRST:
                    return start + i
            except zlib.error:
                pass
            i = joined.find(MAGIC, i + 1)
        tail, place = joined[-len(MAGIC) + 1:], place + len(block)
    return None


def packed_records(file, start: int, end: int) -> Iterator[tuple[int, int, str, dict[str, str], bytes]]:
    """(place, number in member, type, headers, payload) of the records of the members that start in [start, end)."""
    at = next_member(file, start, end) if start else 0
    while at is not None and at < end:
        member = _Member(file, at)
        try:
            for i, record in enumerate(iter_warc(io.BufferedReader(member, 1 << 16))):
                yield (at, i, *record)
            after = member.end
        except zlib.error:  # a damaged member: go on with the next sound one
            after = at + 1
        file.seek(after)
        at = after if file.read(len(MAGIC)) == MAGIC else next_member(file, max(after, at + 1), end)


def plain_records(file, start: int, end: int) -> Iterator[tuple[int, int, str, dict[str, str], bytes]]:
    """The same for a plain archive: records that start in [start, end)."""
    at = 0
    while at < end:
        file.seek(at)
        stream = io.BufferedReader(_Raw(file), 1 << 13)
        head = record_head(stream)
        if head is None:
            return
        body = at + stream.tell()
        if at >= start:
            file.seek(body)
            yield at, 0, head.get("warc-type", ""), head, file.read(payload_length(head))
        at = body + payload_length(head)


class _Raw(io.RawIOBase):
    """A file from where it stands, as a raw stream."""

    def __init__(self, file):
        self.file, self.at = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        if (offset, whence) != (0, 1):
            raise io.UnsupportedOperation("seek")
        return self.at

    def readinto(self, buffer) -> int:
        got = self.file.read(len(buffer))
        buffer[:len(got)] = got
        self.at += len(got)
        return len(got)


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("pathGlobFilter", "*.warc*")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        from fnmatch import fnmatch

        from pyarrow.fs import FileSelector

        from quarry.sources.files import arrow_fs
        fs, root = arrow_fs(self.root)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(FileSelector(root, recursive=True))
        base = self.root[:len(self.root) - len(root)] if self.root.endswith(root) else ""
        out = []
        for f in sorted((f for f in found if f.is_file and (fnmatch(f.base_name, self.glob) or f is info)), key=lambda f: f.path):
            if f.base_name.startswith(("_", ".")) or "/_" in f.path[len(root):]:
                continue
            step = self.split or max(f.size, 1)
            out += [ByteRange(base + f.path, a, min(a + step, f.size)) for a in range(0, f.size, step)]
        return out

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive there
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        from quarry.sources.files import arrow_fs
        schema = to_arrow_schema(SCHEMA)
        fs, path = arrow_fs(partition.path)
        rows, size = [], 0
        with fs.open_input_file(path) as file:
            walk = packed_records if file.read(len(MAGIC)) == MAGIC else plain_records
            for at, i, *record in walk(file, partition.start, partition.end):
                if (found := html_response(*record)) is not None:
                    rows.append((partition.path, at, i, *found))
                    size += len(found[2])
                if len(rows) >= 256 or size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    path: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from quarry.sources.files import arrow_fs
        fs, root = arrow_fs(self.root)
        folder = f"{root}/_temporary-{self.job}"
        fs.create_dir(folder, recursive=True)
        path = f"{folder}/{uuid.uuid4().hex}"
        with fs.open_output_stream(path, compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(gzip.compress(record_bytes(row.get("warc_type") or "response", row["url"], row.get("content_type"), row["body"]), mtime=0))
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        from quarry.sources.files import arrow_fs
        fs, root = arrow_fs(self.root)
        if self.overwrite:
            for f in fs.get_file_info(FileSelector(root)):
                if f.is_file:
                    fs.delete_file(f.path)
        for i, m in enumerate(messages):
            if m is not None:
                fs.move(m.path, f"{root}/part-{i:05d}-{self.job}.warc.gz")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        from quarry.sources.files import arrow_fs
        fs, root = arrow_fs(self.root)
        if fs.get_file_info(f"{root}/_temporary-{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_temporary-{self.job}")


def record_bytes(kind: str, url: str | None, content_type: str | None, body: str | bytes | None) -> bytes:
    """A record of an archive; a response's body gets an HTTP head."""
    raw = (body.encode() if isinstance(body, str) else body) or b""
    if kind == "response":
        raw = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type or ''}\r\n\r\n".encode() + raw
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(raw)}\r\n\r\n".encode() + raw + b"\r\n\r\n"


class WarcSource(DataSource):
    """Format ``warc``.  Options: ``path`` (a folder or an archive), ``pathGlobFilter``, ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read_warc_html(spark: SparkSession, root: str, glob: str = "*.warc*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """HTML responses of every archive under ``root`` as (archive, record_pos, record_no, url, content_type, html).

    ``record_pos`` is the byte where the record, or its gzip member, begins; ``record_no`` counts within a member.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("pathGlobFilter", glob).option("splitBytes", split_bytes).load(root)


def write_warc(df: DataFrame, path: str) -> str:
    """Rows (url, content_type, body, and, if there, warc_type) as archives under ``path``."""
    df.sparkSession.dataSource.register(WarcSource)
    df.write.format("warc").mode("append").save(path)
    return path


def first_archives(spark: SparkSession, root: str, n: int = 5, suffix: str = ".warc.gz") -> DataFrame:
    """The first ``n`` archive paths of a listing (ordered by path)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))
    return files.filter(F.col("path").endswith(suffix)).orderBy("path").limit(n)


def archive_article_texts(spark: SparkSession, root: str, out: str | None = None, glob: str = "*.warc*",
                          split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """S10 + H4 (+ K4): article text of every HTML response in the archives under ``root``.

    Pages without an ``<article>`` are dropped.  With ``out`` the texts are
    also written as blank-line separated blocks.
    """
    from quarry.operators.pages import article_text
    from quarry.sources.sinks import write_text_blocks
    texts = article_text(read_warc_html(spark, root, glob, split_bytes), "html", keep=["archive", "record_pos", "record_no", "url"])
    if out is not None:
        write_text_blocks(texts, "text", out)
    return texts
