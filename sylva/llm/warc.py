"""WARC archives: a writer with revisit records, and a splittable reader.

Archives are gzip files with one member per record. The reader's tasks each scan a range of bytes: they look for gzip
magic, validate a candidate by decoding the start of its member up to a WARC version line, and own exactly the records
whose members start inside their range, reading past its end to finish the last one. So one large archive is read by as
many tasks as it has ranges, without an index. Files are reached through ``pyarrow.fs``, on executors too.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import shared_dir, stored

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are never revisits.
MIN_REVISIT = 100
RANGE_BYTES, READ_BYTES = 32 << 20, 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_COLUMNS = (
    "file string, begin long, position long, stop long, record_id string, record_type string, uri string, date string, "
    "refers_to string, payload_digest string, payload_bytes long, content binary"
)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/[^/]", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(record_type: str, uri: str | None, record_id: str, date: str, payload: bytes, digest: str,
           refers_to: str | None = None) -> bytes:
    """One uncompressed WARC/1.1 record; a revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if record_type == "revisit" else head + payload
    fields = [
        ("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri) if uri is not None else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if record_type == "revisit" else None),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def planned(pages: DataFrame) -> DataFrame:
    """Every page with its payload, digest, record type and the page that it refers to.

    Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the smallest page_id is the response (a null id comes
    last); of rows repeated with that id all are. Counting is by digest, in partial aggregates; the join is an
    equi-join, which AQE splits where one payload is common.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload").cast("long"))
    firsts = (
        rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest")
        .agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", "size",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first_page")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 256 << 20, level: int = 4) -> DataFrame:
    """Write a record for each page to gzip archives in ``folder``; the files with their sizes and record counts.

    Names hold the task's attempt, and only what finished attempts report counts: files that a lost executor leaves
    behind are in no row of the result. An empty table writes no file.
    """
    date = datetime(2000, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, count = None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder.rstrip('/')}/{name}", size, count))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                raw = record(
                    row["record_type"], row["url"], page_urn(row["page_id"]), date, row["payload"], row["digest"],
                    None if row["refers_to"] is None else page_urn(row["refers_to"]),
                )
                if out is None:
                    size = count = 0
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                size += out.write(packed := member(raw, level)) or len(packed)
                count += 1
                if size >= file_bytes:
                    close()
        close()
        columns = list(zip(*done)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["file", "bytes", "records"],
        )

    return planned(pages).mapInArrow(run, "file string, bytes long, records long")


class Window:
    """Bytes of an open file by absolute position, read in steps and forgotten from the front."""

    def __init__(self, source, start: int):
        self.source, self.start, self.data, self.ended = source, start, bytearray(), False
        source.seek(start)

    def reach(self, stop: int) -> bool:
        """Whether bytes up to ``stop`` (exclusive) are there, reading on as needed."""
        while self.start + len(self.data) < stop and not self.ended:
            more = self.source.read(READ_BYTES)
            self.ended = not more
            self.data += more
        return self.start + len(self.data) >= stop

    def forget(self, position: int) -> None:
        del self.data[: position - self.start]
        self.start = position


def _inflate(window: Window, position: int, least: int | None) -> tuple[bytes, int] | None:
    """The member at ``position`` decoded, and its end; only its first ``least`` bytes if given. None if it is none."""
    z, out, at = zlib.decompressobj(31), bytearray(), position
    try:
        while not z.eof:
            if not window.reach(at + 1):
                return None
            # A short first step keeps the price of a false candidate low.
            chunk = bytes(window.data[at - window.start : at - window.start + (512 if at == position else READ_BYTES)])
            out += z.decompress(chunk)
            at += len(chunk)
            if least is not None and len(out) >= least:
                return bytes(out), at
    except zlib.error:
        return None
    return bytes(out), at - len(z.unused_data)


def members(source, begin: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(position, end, decoded record) of every WARC member that starts in [begin, end).

    A candidate is gzip magic whose stream starts with ``WARC/``; after a valid member the next one is tried at its end,
    and only where that fails are the bytes searched on. Members are decoded wholly, so their checksums are verified; a
    damaged one is skipped. A range that begins within a record may find members that this record's payload holds; see
    ``outermost``.
    """
    window, at = Window(source, begin), begin
    while at < end:
        window.forget(at)
        found = window.data.find(MAGIC) if window.reach(at + len(MAGIC)) else -1
        if found < 0:
            if window.ended:
                return
            keep = max(at, window.start + len(window.data) - len(MAGIC) + 1)
            if keep == at:
                window.reach(window.start + len(window.data) + 1)
            at = keep
            continue
        at += found
        if at >= end:
            return
        start = _inflate(window, at, 5)
        whole = _inflate(window, at, None) if start and start[0][:5] == b"WARC/" else None
        if whole is None:
            at += 1
            continue
        yield at, whole[1], whole[0]
        at = whole[1]


def parse(raw: bytes) -> dict | None:
    """Fields of a record; None where it is not well-formed. ``content`` is the payload of an HTTP response block."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if colon:
            fields[k.strip().lower()] = v.strip()
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        return None
    block = rest[:length]
    if len(block) < length:
        return None
    http, mark, payload = block.partition(b"\r\n\r\n")
    is_http = fields.get("content-type", "").startswith("application/http") and bool(mark)
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", http) if is_http else None
    digest = fields.get("warc-payload-digest", "")
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"),
        "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": digest.partition(":")[2] or None,
        "payload_bytes": int(stated[1]) if stated else len(payload if is_http else block),
        "content": None if fields.get("warc-type") == "revisit" else payload if is_http else block,
    }


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """file and bytes of the archives in a folder, from Spark's own listing."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """A row for each byte range of each file."""
    step = F.lit(range_bytes).cast("long")
    ranges = files.where("bytes > 0").select(
        "file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("begin"), "bytes"
    ).select("file", "begin", F.least(F.col("begin") + step, F.col("bytes")).alias("end"))
    tasks = files.sparkSession.sparkContext.defaultParallelism * 3
    return ranges.repartition(tasks, F.xxhash64("file", "begin"))


def _scan(files: DataFrame, range_bytes: int, content: bool) -> DataFrame:
    """All members that the ranges find, with the range's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split()[0] for c in RECORD_COLUMNS.split(",")]
        kinds = {c.strip().split()[0]: pa.int64() for c in RECORD_COLUMNS.split(",") if c.endswith(" long")}
        kinds["content"] = pa.binary()
        held: list[dict] = []
        size = 0

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([h[n] for h in held], kinds.get(n, pa.string())) for n in names], names=names
            )
            held.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                store, path = file_system(row["file"])
                with store.open_input_file(path) as source:
                    for position, stop, raw in members(source, row["begin"], row["end"]):
                        found = parse(raw)
                        if found is None:
                            continue
                        if found["content"] is not None:
                            found["payload_bytes"] = len(found["content"])
                            found["payload_digest"] = hashlib.sha256(found["content"]).hexdigest()
                            if content:
                                size += len(found["content"])
                            else:
                                found["content"] = None
                        held.append(found | {"file": row["file"], "begin": row["begin"], "position": position, "stop": stop})
                        if size > 8 << 20 or len(held) >= 4_000:
                            yield emit()
                            size = 0
        yield emit()

    return _ranges(files, range_bytes).mapInArrow(run, RECORD_COLUMNS)


def outermost(found: DataFrame) -> DataFrame:
    """The members that lie in no record of an earlier range: a payload that is an archive itself adds no records.

    One row for each range goes through the window; the records themselves are only joined.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    reached = found.groupBy("file", "begin").agg(F.max("stop").alias("stop")).select(
        "file", "begin", F.coalesce(F.max("stop").over(before), F.lit(0)).alias("reached")
    )
    return found.join(reached, ["file", "begin"]).where("position >= reached").drop("reached")


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, content: bool = True) -> DataFrame:
    """All records of ``files(file, bytes)`` (columns of ``RECORD_COLUMNS``), range by range.

    With ``content`` off the payload stays out of the result: digests and sizes of payloads that are there are computed
    from their bytes, those of revisits are as stated. Damaged or foreign members are skipped.
    """
    found = _scan(files, range_bytes, content)
    return outermost(found if content else stored(found, "warc-records"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all ``pages`` to archives in the shared folder and read them back: one row per page.

    Null html is an empty payload; a null page_id is written without a number and read back as null; repeated rows give
    a record each; an empty table gives an empty result; other columns are not written. That not all records come back is
    an error.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files = stored(write_archives(pages, folder), "warc-files")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    found = stored(read_archives(files, content=False), "warc-found")
    written, read = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], found.count()
    if written != read:
        raise RuntimeError(f"{written} records were written, {read} were read")
    return found.select(
        as_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        as_id(F.col("refers_to")).alias("refers_to"),
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_page IS NOT NULL AND page_id IS DISTINCT FROM first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_page IS NOT NULL AND page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
