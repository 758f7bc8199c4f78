"""A deterministic, sharded WARC writer, and a reader that trusts only what a manifest lists.

Records are range-sorted by page_id; each task writes its range to files of one gzip member per record and starts a new
file once the compressed size reaches a limit. Headers and digests are made anew from the payload. A file is written
under a temporary name and renamed when it is whole, so a task that runs again replaces it by the same bytes; the
manifest, a table written through Spark's committer, lists files with their sizes and digests and makes them visible.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import new_path, small_batches, stage
from keyspan.llm.tokens import releasing

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Compressed bytes at which a file is closed.
ROLL_BYTES = 64 << 20
#: Part of every record: output depends on input alone.
DATE = "2000-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def _id(kind: str, page_id: int | None, digest: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}:{n}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, repeat: int = 0) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    digest = hashlib.sha256(payload).hexdigest()
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(chr(x) for x in range(33, 127))))
    head += [f"WARC-Date: {DATE}", f"WARC-Record-ID: {_id('revisit' if revisit else 'response', page_id, digest, repeat)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id('response', refers_to, digest, 0)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head += [f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Writes records to files of one task; a file appears under its own name only when it is whole."""

    def __init__(self, folder: str, part: int, attempt: int, limit: int):
        self.system, self.base = _open(folder)
        self.part, self.attempt, self.limit, self.seq, self.out, self.done = part, attempt, limit, 0, None, []

    def write(self, data: bytes, page_id: int | None) -> None:
        if self.out is None:
            self.temp = f"{self.base}/.tmp-{self.part:05d}-{self.seq:05d}-{self.attempt}"
            self.out, self.hash, self.bytes, self.n, self.first = self.system.open_output_stream(self.temp), hashlib.sha256(), 0, 0, page_id
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress(data) + packer.flush()
        self.out.write(data)
        self.hash.update(data)
        self.bytes, self.n, self.last = self.bytes + len(data), self.n + 1, page_id
        if self.bytes >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"part-{self.part:05d}-{self.seq:05d}.warc.gz"
            self.system.move(self.temp, f"{self.base}/{name}")
            self.done.append((name, self.n, self.bytes, self.hash.hexdigest(), self.first, self.last))
            self.out, self.seq = None, self.seq + 1


def write_warc(spark: SparkSession, pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to folder, and returns the committed manifest.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads of at least `least` bytes, the one
    with the smallest page_id is a response and the others revisit it; of rows that repeat that page_id too, one is the
    response. A null page_id never is the smallest where there is another. Folder must be one that all executors see.
    """
    small_batches(spark)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    light = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least)
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # who revisits whom travels to the records as rows of its own, so the payloads move once only
    notes = light.join(first, "digest").filter("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()
    both = rows.withColumns({"digest": F.lit(None).cast("string"), "refers_to": F.lit(None).cast("long")}).unionByName(notes.withColumns({"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")}))
    ordered = both.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id").sortWithinPartitions(F.col("page_id"), F.col("payload").isNotNull(), "url", F.xxhash64("payload"))
    system, base = _open(folder)
    system.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = _Roller(folder, task.partitionId(), task.taskAttemptId(), roll_bytes)
        at, known, seen = object(), {}, {}
        for batch in batches:
            for page_id, url, data, digest, refers_to in zip(*(batch.column(x) for x in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                page_id = page_id.as_py()
                if page_id != at:
                    at, known, seen = page_id, {}, {}
                if not data.is_valid:
                    known[digest.as_py()] = refers_to.as_py()
                    continue
                data = data.as_py()
                own = hashlib.sha256(data).hexdigest() if known or len(data) >= least else ""
                nth = seen[own] = seen.get(own, -1) + 1
                revisit = own in known or bool(own and nth and len(data) >= least)
                out.write(record(page_id, url.as_py(), data, known.get(own, page_id) if revisit else None, revisit, nth), page_id)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out.done, strict=True) if out.done else [()] * 6, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "records", "bytes", "sha256", "first_id", "last_id"])

    return stage(spark, ordered.mapInArrow(releasing(run), _MANIFEST), "manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    with gzip.GzipFile(fileobj=stream) as lines:
        while line := lines.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"not a record: {line[:40]!r}")
            head = {}
            while (line := lines.readline()) != b"\r\n":
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[key] = value
            block = lines.read(int(head["Content-Length"]))
            if lines.read(4) != b"\r\n\r\n" or hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
            yield head, block


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the manifest's files.

    Files are streamed, records checked against their digests, and files against the manifest. For a response the
    length and digest are those of the payload read; a revisit has those of the response that it refers to.
    """
    number = lambda x: int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for batch in batches:
            for name, n in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, count = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, block in _records(stream):
                        digest, length = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != length:
                                raise ValueError(f"damaged payload {head['WARC-Record-ID']}")
                        rows.append((number(head["X-Page-Id"]), length, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page"))))
                        count += 1
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                if count != n:
                    raise ValueError(f"{name} has {count} records, not {n}")
                yield _batch(rows)

    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(releasing(run), _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    return read_warc(write_warc(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)


OP10_SQL = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM rows GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM rows JOIN firsts USING (payload_digest)
"""
