"""WARC files with one gzip member for each record: a writer, and a reader that splits files.

A split is a range of bytes. Its task looks for the gzip magic from the range's start, takes a candidate for a
member if it inflates and its content begins with a WARC version line and headers, and owns every member that
starts inside the range, reading on past the range's end to finish the last. After an owned member the next is expected where
it ended; if none is there the search goes on. A member may hold several records.

Defined results: a damaged or cut-off member is passed over and the search goes on behind its first byte. Records without a payload or an
address give null there. A null page makes a record without payload, an empty one a payload of no bytes.
Repeated rows are written each. Other columns are not read. Not told apart is a member inside another
that was stored without compression and is met by a split that begins within it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import scratch_path, table

SPLIT_BYTES, READ = 16 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
RECORDS = "path string, offset bigint, record_type string, record_id string, date string, uri string, headers map<string,string>, payload binary"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One response record, not compressed."""
    body = None if html is None else html.encode("utf-8", "surrogatepass")
    http = b"" if body is None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = ["WARC/1.1", "WARC-Type: " + ("metadata" if body is None else "response"), f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        plain = url.isprintable() and url == url.strip()
        head += [f"WARC-Target-URI: {url if plain else quote(url)}"] + ["X-Target-Quoted: 1"] * (not plain)
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as one file for each partition; returns the manifest (path, length, records).

    The manifest is itself a written table: of tasks that ran twice only the files of the run that counted are listed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(folder)
        fs.create_dir(f"{base}/files", recursive=True)
        name, out, count = f"files/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for pdf in batches:
                for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                    out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member(record(None if pd.isna(page_id) else int(page_id), url, html)))
                    count += 1
        finally:
            if out is not None:
                length = out.tell()
                out.close()
        if count:
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "length": [length], "records": [count]})

    rows = pages.select(F.col("page_id").cast("decimal(19,0)").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows.mapInPandas(run, "path string, length bigint, records bigint").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


class _Bytes:
    """A file read in pieces, from some place on."""

    def __init__(self, file, at: int):
        self.file, self.begin, self.data = file, at, b""
        file.seek(at)

    def upto(self, end: int) -> bool:
        while self.begin + len(self.data) < end:
            more = self.file.read(READ)
            if not more:
                return False
            self.data += more
        return True

    def drop(self, at: int) -> None:
        self.data, self.begin = self.data[at - self.begin :], at


def _inflate(src: _Bytes, at: int) -> tuple[bytes, int] | None:
    """Content and end of the member at ``at``, or nothing if there is no WARC member."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if not src.upto(pos + 1):
                return None
            piece = src.data[pos - src.begin : pos - src.begin + (READ if out else 4096)]
            out.append(unpack.decompress(piece))
            pos += len(piece)
            if len(out) == 1 and out[0] and not b"WARC/".startswith(out[0][:5]):
                return None
        pos -= len(unpack.unused_data)
    except zlib.error:
        return None
    content = b"".join(out)
    return (content, pos) if content.startswith(b"WARC/") and b"\r\n\r\n" in content else None


def _parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a member."""
    at = 0
    while content.startswith(b"WARC/", at):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(content):
            return
        at = end + 4 + int(size)
        yield headers, content[end + 4 : at]
        while content.startswith(b"\r\n", at):
            at += 2


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the members that start in [start, end)."""
    src, at = _Bytes(file, start), start
    while at < end:
        src.drop(at)
        src.upto(min(end, at + READ) + len(MAGIC) - 1)
        found = src.data.find(MAGIC)
        if found < 0:
            at = max(at + 1, src.begin + len(src.data) - len(MAGIC) + 1)
            if not src.upto(at + len(MAGIC)):
                return
            continue
        at += found
        if at >= end:
            return
        member_ = _inflate(src, at)
        if member_ is None:
            at += 1
            continue
        yield at, member_[0]
        at = member_[1]


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the files listed in ``files`` (path, length), each split a task's work."""
    spark = files.sparkSession
    splits = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.greatest("length", F.lit(1)) - 1) / split_bytes))).alias("k"))
    splits = splits.select("path", (F.col("k") * split_bytes).alias("start"), F.least((F.col("k") + 1) * split_bytes, "length").alias("end"))
    splits = splits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start, end in zip(pdf["path"], pdf["start"], pdf["end"]):
                fs, base = _open(path)
                rows, size = [], 0
                with fs.open_input_file(base) as f:
                    for offset, content in members(f, int(start), int(end)):
                        for h, block in _parse(content):
                            payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") and block else (block or None)
                            uri = h.get("warc-target-uri")
                            uri = unquote(uri) if uri is not None and "x-target-quoted" in h else uri
                            rows.append((path, offset, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-date"), uri, h, payload))
                            size += len(block)
                        if size > 8 << 20:
                            yield pd.DataFrame(rows, columns=_NAMES)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_NAMES)

    return splits.mapInPandas(run, RECORDS)


_NAMES = [x.split()[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")]


def warc_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the WARC files under ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", "length")


def pages_of(records: DataFrame) -> DataFrame:
    return records.select(F.col("headers")["x-page-id"].cast("bigint").alias("page_id"), F.col("uri").alias("url"), F.decode("payload", "UTF-8").alias("html"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as WARC files in the shared folder and reads them back by splits."""
    return pages_of(read_warc(write_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))))


SQL = "SELECT page_id, url, html FROM pages"
