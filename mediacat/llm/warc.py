"""WARC archives: a writer with revisit records and a splittable reader.

The writer gives each task's rows one archive of gzip members, a record each. The reader
deals byte ranges of the archives to tasks. A task scans its range for the gzip magic,
validates a candidate by decoding the member and parsing its WARC header, and from a valid
record goes on member by member; it owns the records that start inside its range and reads
past its end to finish the last. Nothing but archive names and sizes passes the driver's
plan, and no task reads more than its range and one record.

Archives are written under a name that hangs on the partition only and moved into place
when complete, so a retried or speculative task replaces its archive by an equal one.

Defined results: null html is an empty payload; equal payloads below the least size are all
responses; a null page_id is smaller than all others and gives a record without a page id;
rows repeated exactly give a record each, and if theirs is the smallest page_id, each is a
response; an empty table gives archives without records and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.runtime import materialize, scratch_folder

# Production parameters: payloads from this size on are deduplicated; bytes of a range.
MIN_REVISIT = 100
RANGE_BYTES = 8 << 20

MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20  # bytes fetched at a time


def planned(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, n_bytes, refers_to): what each record will be.

    Only digests that several pages share are joined back; the payloads of the others stay
    in place until the left join deals them out.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n_bytes"))
    first = (
        rows.filter(F.col("n_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("__n"), F.min("page_id").alias("__least"), F.count_if(F.col("page_id").isNull()).alias("__nulls"))
        .filter("__n > 1")
        .select(F.col("digest").alias("__digest"), F.when(F.col("__nulls") == 0, F.col("__least")).alias("__first"))
    )
    shared = rows.join(first, (F.col("digest") == F.col("__digest")) & (F.col("n_bytes") >= min_bytes), "left")
    revisit = F.col("__digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return shared.select(
        "page_id", "url", "digest", "n_bytes", revisit.alias("revisit"),
        F.when(revisit, F.col("__first")).alias("refers_to"),
        F.when(~revisit, F.col("html")).alias("html"),
    )


def _header(lines: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines).encode()


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url, payload: bytes, digest: str, n_bytes: int, revisit: bool, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\n" + _header(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(n_bytes))]
    ) + b"\r\n"
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if revisit:
        lines += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
        ]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _header(lines) + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/*", "file:///", folder)))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives and give their (name, n_bytes)."""
    rows = planned(pages).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        sink, size, name, draft = None, 0, "", ""
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                if sink is None:
                    name = f"pages-{row['part']:06d}.warc.gz"
                    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(draft)
                member = _gzip(record(
                    row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["n_bytes"],
                    row["revisit"], row["refers_to"],
                ))
                sink.write(member)
                size += len(member)
        if sink is not None:
            sink.close()
            store.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["name", "n_bytes"])

    return materialize(rows.mapInArrow(run, "name string, n_bytes long"), "archives")


class _Window:
    """Bytes of a file from a position on, fetched in pieces and dropped once passed."""

    def __init__(self, file, at: int, size: int):
        self.file, self.size = file, size
        self.base, self.data = at, b""

    def upto(self, end: int) -> None:
        """Have the bytes before ``end``, as far as the file goes."""
        end = min(end, self.size)
        have = self.base + len(self.data)
        if have < end:
            self.file.seek(have)
            self.data += self.file.read(max(end - have, min(_READ, self.size - have)))

    def drop(self, at: int) -> None:
        if at > self.base:
            self.data = self.data[at - self.base :]
            self.base = at

    def find(self, at: int, stop: int) -> int:
        """Place of the next magic that starts in [at, stop), or -1."""
        while at < stop:
            self.drop(at)
            self.upto(at + _READ)
            hit = self.data.find(MAGIC, 0, stop + len(MAGIC) - 1 - self.base)
            if hit >= 0:
                return self.base + hit
            end = self.base + len(self.data)
            if end >= min(self.size, stop + len(MAGIC) - 1):
                return -1
            at = end - len(MAGIC) + 1
        return -1


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member that starts at ``at`` and the position after it, or None if it is no WARC record."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            window.upto(pos + 1)
            piece = window.data[pos - window.base : pos - window.base + (1 << 16)]
            if not piece:
                return None
            got = unpack.decompress(piece)
            if got and not out and not b"WARC/1."[: len(got)] == got[:7]:
                return None
            out.append(got)
            pos += len(piece) - len(unpack.unused_data)
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, pos) if parse(data) else None


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers, block) of a whole WARC record, or None."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", first):
        return None
    headers = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        key, colon, value = line.partition(":")
        if not colon:
            return None
        headers[key.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length) or "warc-type" not in headers:
        return None
    return headers, rest[: int(length)]


def records_in(file, size: int, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [start, stop)."""
    window = _Window(file, start, size)
    at = window.find(start, stop)
    while 0 <= at < stop:
        found = _member(window, at)
        if found is None:
            at = window.find(at + 1, stop)  # the magic by chance, inside a member
            continue
        data, after = found
        headers, block = parse(data)
        yield at, headers, block
        window.drop(after)
        at = window.find(after, stop)


def ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(name, n_bytes, start, stop): the byte ranges that tasks scan."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(range_bytes)))
    cut = archives.select("name", "n_bytes", starts.alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + range_bytes, F.col("n_bytes")))


def read_archives(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, parts: int | None = None) -> DataFrame:
    """(name, offset, record_type, uri, record_id, refers_to, digest, payload_bytes, payload_digest, payload).

    ``payload_bytes`` is what the HTTP header says, so that it holds for revisits too, and
    ``payload_digest`` is computed from the payload where there is one.
    """
    spread = ranges(archives, range_bytes).repartition(parts or archives.sparkSession.sparkContext.defaultParallelism * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        names = ["name", "offset", "record_type", "uri", "record_id", "refers_to", "digest", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for cut in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(f"{base}/{cut['name']}") as file:
                    for offset, headers, block in records_in(file, cut["n_bytes"], cut["start"], cut["stop"]):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                        whole = headers["warc-type"] == "response"
                        said = headers.get("warc-payload-digest", "").removeprefix("sha256:")
                        rows.append((
                            cut["name"], offset, headers["warc-type"], headers.get("warc-target-uri"),
                            headers.get("warc-record-id"), headers.get("warc-refers-to"), said,
                            len(payload) if whole else int(length[1]) if length else None,
                            hashlib.sha256(payload).hexdigest() if whole else said, payload if whole else None,
                        ))
                        held += len(block)
                        if held > _READ:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spread.mapInArrow(
        run,
        "name string, offset long, record_type string, uri string, record_id string, refers_to string, digest string, "
        "payload_bytes long, payload_digest string, payload binary",
    )


def archive_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
