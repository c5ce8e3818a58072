"""WARC archives: written with one gzip member per record, read back by byte ranges.

The reader needs no index. A task takes a range of an archive, looks for gzip's magic bytes and
accepts a place as a record's start if what follows inflates to a WARC header. A record belongs to
the range in which its member starts, wherever it ends, so ranges may cut anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenfold.llm.common import releasing, scratch_path, written

#: Bytes of an archive after which the next one is begun.
ARCHIVE_BYTES = 256 << 20

#: Bytes of one reading task.
RANGE_BYTES = 8 << 20

#: Reading tasks, at most; beyond, a task reads several ranges one after another.
MOST_TASKS = 100_000

#: Bytes read at a time while looking for a record's start or its end.
STEP = 1 << 20

#: The first bytes of a gzip member with deflate (fixed values), and how a record begins.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
KNOWN = (b"WARC/1.0\r\n", VERSION)

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int) -> str:
    """The record's id in the archive, a function of the page's."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page/{page_id}')}>"


def make_record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_uri(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return press.compress(raw) + press.flush()


def parse_record(raw: bytes) -> dict:
    """A record's fields; ``payload`` is what follows the HTTP header of a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = [x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return fields | {"payload": payload, "payload-length": int(declared[0].partition(b":")[2]) if declared else len(payload)}


def _file(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return system, path


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file(folder)
        system.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(c for c in batch.columns)):
                if out is None or size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                        done.append((name, size, count))
                    name, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(_file(name)[1], compression=None)
                made = make_record(page_id.as_py(), url.as_py() or "", payload.as_py(), sha1.as_py(), refers_to.as_py())
                out.write(made)
                size += len(made)
                count += 1
        if out is not None:
            out.close()
            done.append((name, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done]) for k in range(3)], ["path", "size", "records"])

    return run


#: A digest with more than one of so many rows counts as hot, so that there are fewer hot digests than this.
HOT = 1000


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` in ``folder``; the written table of path, size and records names those that count.

    The payload is the html in UTF-8 (null: empty). Of equal payloads the page with the largest
    page_id is a response and the others revisit it; a payload shared by rows with one page_id or
    without any has one response for each such row. An archive of a task that was lost and run
    again has another name and isn't in the table.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    known = rows.withColumn("sha", F.sha1("payload"))
    # Only digests and ids meet by digest; payloads are dealt by page. Digests of one page need no meeting, and
    # those of a large part of all rows, which would meet in one task, are few: they are broadcast.
    thin = written(known.select("page_id", "sha"), "digests")
    counted = written(thin.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1"), "shared-digests")
    hot = F.col("n") * HOT > thin.count()
    older = [
        thin.join(hint(counted.filter(part).select("sha", "last")), "sha").filter("page_id < last").select("page_id", "sha", F.col("last").alias("refers_to")).distinct()
        for part, hint in ((hot, F.broadcast), (~hot, lambda frame: frame))
    ]
    older = older[0].unionByName(older[1])
    joined = known.join(older, ["page_id", "sha"], "left")
    chosen = joined.select("page_id", "url", "payload", F.unhex("sha").alias("sha1"), "refers_to")
    archives = chosen.mapInArrow(releasing(_with_digest(folder)), "path string, size long, records long")
    return written(archives, "archives")


def _with_digest(folder: str):
    """The writer, given SHA-1 digests as bytes."""
    write_records = _write(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coded() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = pa.array([base64.b32encode(x.as_py()).decode() for x in batch.column(3)], pa.string())
                yield batch.set_column(3, "sha1", text)

        return write_records(coded())

    return run


def _members(source, start: int, end: int, size: int) -> Iterator[bytes]:
    """The inflated records whose members start in [start, end) of an open file of ``size`` bytes."""
    at = start
    while at < end:
        source.seek(at)
        chunk = source.read(min(STEP, end - at) + len(MAGIC) - 1)
        found = chunk.find(MAGIC)
        if found < 0:
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        raw, length = _inflate(source, at)
        if raw is None:
            at += 1
        else:
            yield raw
            at += length


def _inflate(source, at: int) -> tuple[bytes | None, int]:
    """The member at ``at`` and its length; None if it doesn't inflate to a WARC record."""
    source.seek(at)
    open_member, parts, length, checked = zlib.decompressobj(31), [], 0, False
    step = 4096
    while not open_member.eof:
        data = source.read(step)
        if not data:
            return None, 0
        try:
            parts.append(open_member.decompress(data))
        except zlib.error:
            return None, 0
        length += len(data)
        if not checked and (begin := b"".join(parts)[:10]) and (len(begin) == 10 or open_member.eof):
            if begin not in KNOWN:
                return None, 0
            checked = True
        step = min(STEP, 4 * step)
    return (b"".join(parts), length - len(open_member.unused_data)) if checked else (None, 0)


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        schema = pa.schema([*kinds, *([("payload", pa.binary())] if payload else [])])
        for batch in batches:
            for path, start, end, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                system, name = _file(path)
                rows: list[dict] = []
                held = 0
                with system.open_input_file(name) as source:
                    for raw in _members(source, start, end, size):
                        got = parse_record(raw)
                        own = got["warc-type"] == "response"
                        sha1 = got["warc-payload-digest"].removeprefix("sha1:")
                        if own and sha1 != digest(got["payload"]):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        ids = [got.get(k) for k in ("x-page-id", "x-refers-to-page-id")]
                        rows.append(
                            {
                                "page_id": ids[0] and int(ids[0]), "url": got["warc-target-uri"],
                                "payload_bytes": len(got["payload"]) if own else got["payload-length"], "payload_digest": sha1,
                                "record_type": got["warc-type"], "refers_to": ids[1] and int(ids[1]),
                            }
                            | ({"payload": got["payload"] if own else None} if payload else {})
                        )
                        held += len(raw)
                        if len(rows) >= 5000 or held > STEP * 16:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """One row per record of the archives (path and size), with ``payload`` also its bytes.

    Every response's payload is held against its digest. A revisit's payload_bytes and
    payload_digest are those of the full payload. Bytes that belong to no valid member are skipped.
    Archives without a record, and no archives at all, give no rows.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)).cast("long"), F.lit(range_bytes).cast("long"))
    ranges = archives.select("path", "size", F.explode(starts).alias("start")).select(
        "path", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end"), "size"
    )
    # An explicit number, as the rows are so small that they would all be put into one partition.
    spread = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)), "path", "start")
    return spread.mapInArrow(releasing(_read(payload)), _RECORD + (", payload binary" if payload else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back: one row per record."""
    spark = pages.sparkSession
    return read(spark, write(pages, scratch_path(spark, "warc")))
