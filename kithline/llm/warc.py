"""WARC archives: a writer of one gzip member per record and a splittable reader.

Reading: a task takes a byte range of a file, looks in it for gzip magic, checks
each candidate by decoding its first bytes (they must start a WARC header), and
owns every record that starts inside its range, reading on past the range's end
where a record does. Ranges of one file so share nothing and no index is needed.

Files are opened through pyarrow.fs, which covers local paths and the stores that
Spark clusters use; a task writes its archive under a name of its own attempt and
renames it when whole, so a task that runs twice leaves one archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 4 << 20
#: Tasks that ranges are dealt over at most; beyond it a task reads several ranges.
READ_TASKS = 20_000
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, path string, position long"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _member(record_id: str, url: str, kind: str, refers_to: str | None, payload: bytes, level: int) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = "".join(f"%{b:02X}" if b <= 32 or b >= 127 else chr(b) for b in url.encode())
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {target}"] if url else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warc(records: DataFrame, path: str, level: int = 6) -> DataFrame:
    """Writes records (record_id, url, record_type, refers_to, payload) as one archive a partition.

    Returns the archives written (path, bytes); nothing is written before an action on it. A
    null payload is empty, a null url has no target line; repeated rows each give a record, and
    an empty partition an archive of no bytes.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        store, folder = _open(path)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        temp, size = f"{folder}/.{uuid.uuid4().hex}.tmp", 0
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(temp, compression=None) as out:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                        member = _member(row[0], row[1] or "", row[2], row[3], row[4] or b"", level)
                        out.write(member)
                        size += len(member)
        store.move(temp, name)
        yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name.rpartition('/')[2]}"], "bytes": [size]})

    return records.select("record_id", "url", "record_type", "refers_to", "payload").mapInArrow(run, "path string, bytes long")


class _Window:
    """A growing view of a file from a position on."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.data, self.ended = file, at, b"", False
        file.seek(at)

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(CHUNK)
        self.ended |= not got
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _starts_record(window: _Window, at: int) -> bool:
    while len(window.data) < at + 1024 and window.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(window.data[at : at + 1024], 16).startswith(b"WARC/")
    except zlib.error:
        return False


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    kind = fields.get("warc-type", "")
    payload, size = block, len(block)
    if block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
        lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(lengths[0]) if kind == "revisit" and lengths else len(payload)
    bare = lambda s: None if s is None else s.strip("<>").removeprefix("urn:record:")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() if kind != "revisit" else stated
    if stated and digest != stated:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not have its digest")
    return {
        "record_id": bare(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": bare(fields.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": size, "payload": payload,
    }


def _records(file, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """The records whose gzip member starts in [start, end)."""
    window = _Window(file, start)
    while window.at < end:
        found = window.data.find(MAGIC)
        if found < 0 or found >= end - window.at:
            if found >= 0 or window.at + len(window.data) - 2 >= end:
                return
            window.drop(max(0, len(window.data) - 2))
            if not window.more():
                return
            continue
        window.drop(found)
        if not _starts_record(window, 0):
            window.drop(1)
            continue
        position, z, raw = window.at, zlib.decompressobj(31), []
        while not z.eof:
            if not window.data and not window.more():
                raise EOFError(f"a record at {position} is cut off")
            raw.append(z.decompress(window.data))
            window.drop(len(window.data) - len(z.unused_data))
        yield position, _parse(b"".join(raw))


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives (path, bytes), each range of split_bytes a unit of work.

    payloads=False leaves payload null. A record that ends too early or whose payload
    does not have its stated digest is an error. Archives without bytes have no records.
    archives is read once more, for the number of ranges: rows of a path and an offset
    are so small that Spark, left to itself, would put all of them into one task.
    """
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("first"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORDS.split(", "))])
        rows, held = [], 0
        for b in batches:
            for path, size, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, name = _open(path)
                with store.open_input_file(name) as file:
                    for position, record in _records(file, first, min(first + split_bytes, size)):
                        held += len(record["payload"])
                        rows.append(record | {"path": path, "position": position} | ({} if payloads else {"payload": None}))
                        if len(rows) >= 1024 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    count = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0]
    return ranges.repartition(min(max(int(count or 0), 1), READ_TASKS)).mapInArrow(run, RECORDS)


def with_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Of records (id long, url, payload) with equal payloads, that with the largest id is the response.

    Payloads under min_bytes are all responses. Repeated rows of the largest id are all
    responses; a null id revisits the response of its payload, or is one if no id is known.
    """
    keyed = records.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("_digest", F.sha2("payload", 256))
    owner = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("_digest").agg(F.max("id").alias("_owner"), F.count("*").alias("_n"))
    own = F.col("_owner").isNull() | F.coalesce(F.col("id") == F.col("_owner"), F.lit(False))
    return common.spread_join(keyed, common.materialize(owner, "warc-owners"), "_digest", "_n", "left").select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("record_id"), "url",
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        F.when(~own, F.col("_owner").cast("string")).alias("refers_to"), "payload",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, as read back from the archives."""
    pages = common.text_sources(spark, sf_dir, "pages")
    records = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.col("html").cast("binary").alias("payload"))
    archives = common.materialize(write_warc(with_revisits(records), common.shared_dir(spark, "warc")), "warc-index")
    return read_warc(archives, payloads=False).select(
        F.expr("try_cast(record_id as long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers_to as long)").alias("refers_to"),
    )
