"""WARC archives as a chunked record table.

``write_archives`` writes one gzip member a record (WARC/1.1) and returns a manifest of the archives; payloads are never shuffled or sorted, as revisits are found among digests;
``read_chunks`` streams archives back as rows of record identifier and chunk number, each with the
payload's length and SHA-1 so far, so that neither side holds more of a payload than a chunk beyond
the table's own cell. A record's last chunk carries the full length and digest.

An archive is written under a name of its own attempt and moved to its final name when complete; only
archives of the manifest, which has the tasks that succeeded, are read. So a lost executor costs
a task's repetition and leaves at most a file that nobody reads.

Defined results: a null payload is empty; of equal payloads of at least ``revisit_from`` bytes the
records of the largest id are responses (all of them, if that id is repeated) and the others revisit
them; a null id is never the largest unless all are null, and then all are responses; an empty payload
has one chunk, number 0; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm._common import delete, join_hot, map_arrow, shared_path, table

CHUNK = 1 << 20
REVISIT_FROM = 1000
MANIFEST = "archive string, records long"
POOL = "part string, place long, size long, record_id long, uri string, digest string, bytes long"
POOL_NAMES = [f.split(" ")[0] for f in POOL.split(", ")]
CHUNKS = "archive string, record_id long, record_type string, refers_to long, uri string, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, is_last boolean"


def mark_revisits(index: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Stored rows ``record_id, digest, bytes, ...`` with ``refers_to``: the response's id for a revisit.

    A payload that a third of the rows share is no hot key: its digest is joined by broadcast (``join_hot``)."""
    large = index.filter(F.col("bytes") >= revisit_from)
    groups = large.groupBy("digest").agg(F.max("record_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 and top is not null")
    again = F.when(F.col("top").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("top")), F.col("top"))
    marked = join_hot(large, groups, "digest", "n").select(*index.columns, again.alias("refers_to"))
    return marked.unionByName(index.filter(F.col("bytes") < revisit_from).withColumn("refers_to", F.lit(None).cast("long")))


def _header(kind: str, record_id: int | None, uri: str, refers: int | None, digest: bytes, size: int) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>",
        f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~-._')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:record:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*lines, f"Content-Length: {0 if kind == 'revisit' else size}"]) + "\r\n\r\n").encode()


def _pieces(payload: memoryview, chunk: int) -> Iterator[memoryview]:
    for at in range(0, len(payload), chunk):
        yield payload[at : at + chunk]


@contextmanager
def _new_file(where: str, name: str) -> Iterator:
    """An output stream that gets its name when it is complete."""
    store, root = pafs.FileSystem.from_uri(where)
    store.create_dir(root, recursive=True)
    tmp = f"{root}/_{name}-{os.getpid()}"
    with store.open_output_stream(tmp, compression=None) as out:
        yield out
    store.move(tmp, f"{root}/{name}")


def _pool_writer(where: str, chunk: int, level: int):
    """Write every record as a response, a gzip member each, and say where it is."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        name = f"part-{at.partitionId():06d}-{at.taskAttemptId()}"
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with _new_file(where, name) as out:
            place = 0
            for batch in itertools.chain([first], batches):
                ids, uris, payloads = (batch.column(k) for k in range(3))
                places, sizes, digests, lengths = [], [], [], []
                for i in range(batch.num_rows):
                    payload = memoryview(payloads[i].as_buffer() or b"")
                    h = hashlib.sha1()
                    for x in _pieces(payload, chunk):
                        h.update(x)
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    n = out.write(z.compress(_header("response", ids[i].as_py(), uris[i].as_py() or "", None, h.digest(), len(payload))))
                    for x in _pieces(payload, chunk):
                        n += out.write(z.compress(x))
                    n += out.write(z.compress(b"\r\n\r\n") + z.flush())
                    places.append(place)
                    sizes.append(n)
                    digests.append(h.hexdigest())
                    lengths.append(len(payload))
                    place += n
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), *(pa.array(x, pa.int64()) for x in (places, sizes)), ids, uris, pa.array(digests), pa.array(lengths, pa.int64())], POOL_NAMES)

    return write


def _assembler(pool: str, where: str, chunk: int, level: int):
    """Make an archive of each pool file: responses are copied as they lie, revisits take the place of their payload."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(pool)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for part, members in itertools.groupby(rows, key=lambda r: r[0]):
            name, n = f"{part}-{TaskContext.get().taskAttemptId()}.warc.gz", 0
            with _new_file(where, name) as out, store.open_input_file(f"{root}/{part}") as source:
                for _, place, size, record_id, uri, digest, length, refers in members:
                    if refers is None:
                        source.seek(place)
                        for at in range(0, size, chunk):
                            out.write(source.read(min(chunk, size - at)))
                    else:
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        out.write(z.compress(_header("revisit", record_id, uri or "", refers, bytes.fromhex(digest), length) + b"\r\n\r\n") + z.flush())
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "records"])

    return assemble


def write_archives(records: DataFrame, where: str, chunk: int = CHUNK, level: int = 3, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write ``(record_id long, uri string, payload binary)`` as archives in ``where``.

    Payloads go from the table's cell to a file and from file to file, never through a shuffle or a sort: each task first writes
    its records as responses to a pool file; revisits are found among digests; then each pool file becomes an archive.
    Returns the manifest ``(archive, records)``, itself stored beside the archives.
    """
    if "://" not in where:
        where = "file://" + where
    spark = records.sparkSession
    map_arrow(records.select("record_id", "uri", "payload"), _pool_writer(f"{where}/pool", chunk, level), POOL).write.parquet(f"{where}/index")
    marked = mark_revisits(spark.read.schema(POOL).parquet(f"{where}/index"), revisit_from)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartition(parts, "part").sortWithinPartitions("part", "place").select(*POOL_NAMES, "refers_to")
    map_arrow(dealt, _assembler(f"{where}/pool", f"{where}/archives", chunk, level), MANIFEST).write.parquet(f"{where}/manifest")
    delete(spark, f"{where}/pool")
    delete(spark, f"{where}/index")
    return spark.read.schema(MANIFEST).parquet(f"{where}/manifest")


class _Stream:
    """Bytes of the gzip members of an archive, in bounded pieces."""

    def __init__(self, source, piece: int):
        self.source, self.piece = source, piece
        self.z, self.raw, self.buf, self.end = zlib.decompressobj(31), b"", bytearray(), False

    def fill(self) -> bool:
        while True:
            if self.z.eof:
                self.raw = self.z.unused_data or self.raw
                self.z = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(self.piece)
                if not self.raw:
                    self.end = True
                    return False
            got = self.z.decompress(self.raw, self.piece)
            self.raw = self.z.unconsumed_tail
            if self.z.eof and self.z.unused_data:
                self.raw = b""
            if got:
                self.buf += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.buf.find(mark, start)) < 0:
            start = max(0, len(self.buf) - len(mark) + 1)
            if not self.fill():
                return None
        out = bytes(self.buf[:k])
        del self.buf[: k + len(mark)]
        return out

    def some(self, n: int) -> bytes:
        """Exactly n bytes, n at most a chunk."""
        while len(self.buf) < n:
            if not self.fill():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def records_in(source, chunk: int) -> Iterator[tuple]:
    """(record_id, kind, refers_to, uri, chunk_no, chunk, bytes_so_far, digest_so_far, is_last) of an open archive."""
    s = _Stream(source, chunk)
    number = lambda x: int(y) if (y := x.strip("<>").rpartition(":")[2]) else None
    while (head := s.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record: {lines[0]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        kind, rid, uri = fields["warc-type"], number(fields["warc-record-id"]), fields["warc-target-uri"]
        want = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
        left = int(fields["content-length"])
        if kind == "revisit":
            yield rid, kind, number(fields["warc-refers-to"]), uri, 0, b"", int(fields["x-payload-length"]), want, True
        else:
            h, no, seen = hashlib.sha1(), 0, 0
            while True:
                part = s.some(min(left, chunk))
                left -= len(part)
                seen += len(part)
                h.update(part)
                if left == 0 and h.hexdigest() != want:
                    raise ValueError(f"record {rid}: the payload's digest is not that of its header")
                yield rid, kind, None, uri, no, part, seen, h.copy().hexdigest(), left == 0
                no += 1
                if left == 0:
                    break
        if s.some(4) != b"\r\n\r\n":
            raise ValueError(f"record {rid}: it has no end")


def _reader(where: str, chunk: int):
    names = [f.split(" ")[0] for f in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(where)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for r in records_in(source, chunk):
                        rows.append((name, *r))
                        size += len(r[5]) + 200
                        if size >= 4 * CHUNK:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def read_chunks(manifest: DataFrame, where: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives that the manifest names; each archive is read by one task."""
    if "://" not in where:
        where = "file://" + where
    spread = manifest.select("archive").repartition(max(manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "archive")
    return map_arrow(spread, _reader(f"{where}/archives", chunk), CHUNKS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, one row a record."""
    pages = table(spark, sf_dir, "pages")
    records = pages.select(F.col("page_id").alias("record_id"), F.coalesce("url", F.lit("")).alias("uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    where = shared_path(spark, "warc")
    chunks = read_chunks(write_archives(records, where), where)
    return chunks.filter("is_last").select(
        F.col("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""
