"""WARC archives with an index of byte ranges.

Writing: every task writes archives of its own rows, one gzip member a record, and returns the index rows (archive, offset, length,
url, digest, type); the index is Parquet that Spark commits, so that archives of lost attempts are never referred to. Reading: the index is
filtered first, the ranges of each archive are sorted and coalesced, and only those bytes are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.skew import split_join
from tidewright.session import materialise, scratch

#: Payloads below this size are never revisits.
MIN_REVISIT = 100
#: A new archive begins after so many bytes; ranges with gaps up to GAP are read at once, up to READ bytes.
ARCHIVE_BYTES, GAP, READ = 64 << 20, 64 << 10, 8 << 20
#: Up to so many repeated digests are broadcast to the pages (about 20 MB); more are joined by a shuffle. Bytes of archives that one task reads, about.
BROADCAST_DIGESTS, TASK_BYTES = 200_000, 32 << 20

INDEX = "archive string, offset long, length long, page_id long, url string, digest string, type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _record(page_id: int | None, url: str, digest: str, size: int, kind: str, refers: int | None, payload: bytes) -> bytes:
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>", f"X-Payload-Length: {size}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def _parsed(raw: bytes) -> tuple:
    raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s)) else None
    payload = rest[: int(field["Content-Length"])]
    if rest[len(payload) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError("a payload differs from its digest")
        payload_or_none = payload
    else:
        size, payload_or_none = int(field["X-Payload-Length"]), None
    return number(field["WARC-Record-ID"]), field["WARC-Target-URI"], kind, number(field.get("WARC-Refers-To", "")), size, digest, payload_or_none


def assign(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, bytes, digest, kind, refers_to): of equal payloads the smallest page_id is the response; a revisit has no html.

    Digests are counted with partial sums. While those that repeat are few enough to be broadcast, no page is moved; beyond that the pages of the hottest ones
    still stay, and the others are shuffled by their digest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    of = rows.where(f"bytes >= {MIN_REVISIT}").groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    of = materialise(of.where("n > 1 AND first IS NOT NULL"), "digests")
    size = of.agg(F.count("*").alias("digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages")).first()
    if size.digests <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(of.select("digest", "first")), "digest", "left")
    else:
        repeated = split_join(rows, of, ["digest"], "n", size.pages).drop("n")
        joined = rows.join(of, "digest", "left_anti").withColumn("first", F.lit(None).cast("long")).unionByName(repeated)
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    kind = F.when(refers.isNull(), "response").otherwise("revisit")
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "bytes", "digest", kind.alias("kind"), refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and return the committed index, columns INDEX.

    A null html is an empty payload, a null url an empty one, a null page_id stays null and is a response; rows that repeat a
    page_id are each written. ``folder`` is a URI that all executors reach (by default one in the shared folder).
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    cols = ["page_id", "url", "digest", "bytes", "kind", "refers_to", "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                values = [batch.column(c) for c in cols]
                for i in range(batch.num_rows):
                    page_id, url, digest, size, kind, refers, html = (v[i].as_py() for v in values)
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    raw = _record(page_id, url, digest, size, kind, refers, html.encode() if html else b"")
                    out.write(raw)
                    index.append((name, at, len(raw), page_id, url, digest, kind, refers))
                    at += len(raw)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index, strict=True), _INDEX_TYPES, strict=True)], names=_INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    index = assign(pages).select(*cols).mapInArrow(run, INDEX)
    return materialise(index.withColumn("archive", F.concat(F.lit(folder + "/"), "archive")), "warc-index")


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
_RECORD_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_RECORD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, records) of coalesced reads over sorted (offset, length): the gaps are at most ``gap``, the reads ``most`` or one record."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in rows:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            start, end, own = out[-1]
            own.append((offset, length))
            out[-1] = (start, max(end, offset + length), own)
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read_archives(index: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the selected index rows, columns RECORDS, parsed from the archives and checked against their digests.

    The index is dealt to tasks by ranges of (archive, offset), as many as the selected records have bytes for, so neighbouring records are read at once and
    no archive is bound to one task. Without ``payload`` the column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, at = None, None
        try:
            for batch in batches:
                archives = batch.column(0).to_pylist()
                offsets, lengths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                i = 0
                while i < len(archives):
                    j = i
                    while j < len(archives) and archives[j] == archives[i]:
                        j += 1
                    if at != archives[i]:
                        if opened is not None:
                            opened.close()
                        fs, path = pafs.FileSystem.from_uri(archives[i])
                        opened, at = fs.open_input_file(path), archives[i]
                    for start, end, own in ranges(list(zip(offsets[i:j], lengths[i:j], strict=True))):
                        data = memoryview(opened.read_at(end - start, start))
                        rows = [_parsed(data[o - start : o - start + n]) for o, n in own]
                        if not payload:
                            rows = [(*r[:-1], None) for r in rows]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _RECORD_TYPES, strict=True)], names=_RECORD_NAMES)
                    i = j
        finally:
            if opened is not None:
                opened.close()

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    chosen = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return chosen.mapInArrow(run, RECORDS)
