"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Records are a table: record_id, warc_type, target_uri, refers_to, date, digest,
header (all named fields in order, a line each) and block (bytes). Responses come from WARC
files or from a table of pages; each yields one ``metadata`` record (source
headers, digests, what was found) and one ``conversion`` record (plain text),
both naming the response in WARC-Refers-To. Files hold one gzip member per record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from lorehouse.llm.blocks import bounded_batches, rows_of
from lorehouse.session import fresh_path

DATE = "2000-01-01T00:00:00Z"
#: Bytes of a file, and the level of compression.
FILE_BYTES, LEVEL = 8 << 20, 1
RECORD = "record_id string, warc_type string, target_uri string, refers_to string, date string, digest string, header string, block binary"
_KIND = {"block": pa.binary()}
_NAMES = ["record_id", "warc_type", "target_uri", "refers_to", "date", "digest", "header", "block"]
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs of RFC 4122
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([-\w:.]+)", re.I)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|li|ul|ol|h[1-6]|tr|table|br|hr|article|section|header|footer|nav|aside|title|body|head|blockquote|pre|dd|dt|form|figure|main)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")


def sha1_of(data: bytes) -> str:
    """A digest as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A stable record id, so that a task that runs twice names its records alike."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(map(str, parts)))}>"


def plain_text(html: str) -> str:
    """All visible text: blocks on lines of their own, white space folded, empty lines left out."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", html).replace("\n", " ")))
    lines = (" ".join(unescape(line).split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    return pa.record_batch([pa.array(c, _KIND.get(n, pa.string())) for n, c in zip(_NAMES, columns, strict=True)], names=_NAMES)


def _row(kind: str, name: str, uri: str | None, refers: str | None, date: str, digest: str, fields: list[tuple[str, str]], block: bytes) -> tuple:
    first = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if uri is not None:
        first.append(("WARC-Target-URI", " ".join(uri.splitlines())))
    if refers is not None:
        first.append(("WARC-Refers-To", refers))
    header = [*first, *fields, ("WARC-Block-Digest", sha1_of(block)), ("Content-Length", str(len(block)))]
    return name, kind, uri, refers, date, digest, "\r\n".join([f"{n}: {v}" for n, v in header]), block


def responses_of(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of pages (page_id, url, html); null html is an empty payload."""
    bounded_batches(pages.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, html in rows_of(iter([batch]), "page_id", "url", "html"):
                payload = (html or "").encode("utf-8", "surrogatepass")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                digest = sha1_of(payload)
                fields = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest)]
                name = record_id("response", page, url, digest)
                rows.append(_row("response", name, url, None, date, digest, fields, http.encode() + payload))
            yield _batch(rows)

    return pages.select("page_id", "url", "html").mapInArrow(build, RECORD)


def parts_of(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = [tuple(x.strip() for x in line.partition(":")[::2]) for line in lines[1:] if ":" in line]
    return lines[0], pairs, payload


def _decoded(payload: bytes, http: list[tuple[str, str]]) -> str:
    stated = next((v for n, v in http if n.lower() == "content-type"), "").encode()
    found = _CHARSET.search(stated) or _CHARSET.search(payload[:1024])
    name = found[1].decode("ascii", "replace") if found else "utf-8"
    try:
        return payload.decode(name, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(records: DataFrame) -> DataFrame:
    """One metadata and one conversion record per response; other records give none.

    The payload digest of the response is carried over, or computed where it has
    none. A response without payload gives an empty text, an unknown character
    set is read as UTF-8, damaged bytes become U+FFFD. Repeated responses give
    repeated records; an empty table none; further columns are not read. There
    is no shuffle: the records of a response are made where it is read.
    """
    bounded_batches(records.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, kind, uri, date, digest, header, block in rows_of(
                iter([batch]), "record_id", "warc_type", "target_uri", "date", "digest", "header", "block"
            ):
                if kind != "response":
                    continue
                status, http, payload = parts_of(block or b"")
                digest = digest or sha1_of(payload)
                text = plain_text(_decoded(payload, http)).encode()
                source = [(f"source-{n}", v) for n, v in fields_of(header)] + [("http-status", status)]
                source += [(f"http-{n}", v) for n, v in http] + [("text-length", str(len(text))), ("text-digest", sha1_of(text))]
                listed = "".join(f"{n}: {v}\r\n" for n, v in source).encode()
                linked = [("WARC-Refers-To-Target-URI", uri)] if uri is not None else []
                linked += [("WARC-Refers-To-Date", date or DATE), ("WARC-Payload-Digest", digest)]
                for derived, content, what in (("metadata", listed, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
                    own = record_id(derived, name)
                    rows.append(_row(derived, own, uri, name, date or DATE, digest, [*linked, ("Content-Type", what)], content))
            yield _batch(rows)

    return records.select(*_NAMES).mapInArrow(build, RECORD)


def fields_of(header: str | None) -> list[tuple[str, str]]:
    """The named fields of a header."""
    return [tuple(x.strip() for x in line.split(":", 1)) for line in (header or "").split("\r\n") if ":" in line]


def as_bytes(header: str, block: bytes) -> bytes:
    """A record as it stands in a file, before compression."""
    return b"".join((b"WARC/1.1\r\n", header.encode("utf-8", "surrogatepass"), b"\r\n\r\n", block, b"\r\n\r\n"))


def write_warc(records: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Write records to ``.warc.gz`` files of about ``file_bytes`` each; returns their folder.

    A file is written under another name and renamed, and the files that count
    are those listed in ``files``, so a task that runs twice adds none.
    """
    spark = records.sparkSession
    folder = folder or fresh_path(spark, "warc")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = pafs.FileSystem.from_uri(folder)

        def placed(members: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.gz"
            with target.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(b"".join(members))
            return pa.record_batch([pa.array([name]), pa.array([len(members)], pa.int64())], names=["file", "n_records"])

        members, held = [], 0
        for header, block in rows_of(batches, "header", "block"):
            members.append(gzip.compress(as_bytes(header, block), LEVEL, mtime=0))
            held += len(members[-1])
            if held >= file_bytes:
                yield placed(members)
                members, held = [], 0
        if members:
            yield placed(members)

    records.select("header", "block").mapInArrow(write, "file string, n_records bigint").write.parquet(f"{folder}/files")
    return folder


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one record each; a plain file is one member."""
    view, at = memoryview(data), 0
    while at < len(data):
        if bytes(view[at : at + 2]) != b"\x1f\x8b":
            yield data[at:]
            return
        inflate, out = zlib.decompressobj(31), []
        while at < len(data) and not inflate.eof:
            piece = view[at : at + 16384]
            out.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(out)


def _parsed(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        header = data[at:end].decode("utf-8", "replace").partition("\r\n")[2]
        field = {n.lower(): v for n, v in fields_of(header)}
        size = int(field.get("content-length", 0))
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        yield (
            field.get("warc-record-id"), field.get("warc-type"), field.get("warc-target-uri"), field.get("warc-refers-to"),
            field.get("warc-date"), field.get("warc-payload-digest"), header, block,
        )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder's files: those its list names, or all if it has no list."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (data,) in rows_of(batches, "content"):
            rows, held = [], 0
            for member in _members(data):
                for row in _parsed(member):
                    rows.append(row)
                    held += len(row[-1])
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            yield _batch(rows)

    from pyspark.sql import functions as F

    listed, root = pafs.FileSystem.from_uri(folder)
    if listed.get_file_info(f"{root}/files").type == pafs.FileType.Directory:
        names = spark.read.schema("file string, n_records bigint").parquet(f"{folder}/files")
        files = files.join(names, F.element_at(F.split("path", "/"), -1) == names["file"], "left_semi")
    return files.select("content").mapInArrow(read, RECORD)


def derivative_digest(pages: DataFrame) -> DataFrame:
    """Per derived record, read back from its file: what it links to, its digests and its size."""
    from pyspark.sql import functions as F

    spark = pages.sparkSession
    responses = read_warc(spark, write_warc(responses_of(pages)))
    derived = read_warc(spark, write_warc(derive(responses)))
    return derived.select(
        "record_id",
        "warc_type",
        "refers_to",
        "target_uri",
        "date",
        "digest",
        F.octet_length("block").cast("bigint").alias("n_bytes"),
        F.sha2("block", 256).alias("block_sha256"),
        F.size(F.split("header", "\r\n")).alias("n_fields"),
    )
