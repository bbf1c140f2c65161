"""WARC archives: writing records as gzip members, and a splittable reader.

Every record is a gzip member of its own.  A reading task is given a byte range: it
looks for gzip magic from the beginning of the range, takes a candidate for a member
only if it decodes to a WARC header, and owns the records that start inside its range,
however far the last one reaches.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm.runs import prepare, stored
from weftline.session import scratch_path

# Fixed values of the formats: the gzip magic with the deflate method, and the first
# line and the block separator of a record.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
BREAK = b"\r\n\r\n"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ANSWER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _line(value: object) -> str:
    """A header value: on one line, without blanks at its ends."""
    return " ".join(str(value).split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the size and digest of its payload, not the payload."""
    revisit = refers_to is not None
    block = _ANSWER if revisit else _ANSWER + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", len(payload)),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None),
        ("WARC-Profile", _IDENTICAL if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields if v is not None)
    return VERSION + head.encode() + b"\r\n" + block + BREAK


def _member(data: bytes) -> bytes:
    """``data`` as one gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return packer.compress(data) + packer.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        task = TaskContext.get()
        # every attempt writes a file of its own; only those of attempts that count are listed
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        many, out = 0, None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                payload = (html.as_py() or "").encode()
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(_member(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py())))
                many += 1
        if out:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([many])], names=["path", "bytes", "records"]
            )

    return run


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 1000) -> DataFrame:
    """Writes a record per row (page_id, url, html) below ``folder``; returns the list
    of files (path, bytes, records), itself written there.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one of the largest
    page_id is a response and the others revisit it; if that id is repeated, each of its
    rows is a response.  Smaller payloads are all responses.  A null html is an empty
    payload.  A row with a null page_id revisits the others, or is a response where no
    row with an id has its payload; a null url leaves its field out.  No row, no file.
    """
    spark = pages.sparkSession
    prepare(spark)
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"),
    )
    # of the groups of equal payloads only those of two rows or more go into the join
    latest = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("latest"), F.count("*").alias("many"))
    latest = stored(latest.where("many > 1").drop("many"), "latest")
    joined = rows.join(latest, ["digest", "size"], "left")
    refers = F.when(F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest"))
    listed = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return stored(listed.mapInArrow(_writer(folder), "path string, bytes long, records long"), "archives")


class _Range:
    """A file read forward from a place, a piece at a time."""

    def __init__(self, file, at: int, piece: int):
        self.file, self.piece = file, piece
        self.start, self.data = at, b""
        file.seek(at)

    def more(self) -> bool:
        new = self.file.read(self.piece)
        self.data += new
        return bool(new)

    def drop(self, n: int) -> None:
        self.data, self.start = self.data[n:], self.start + n


def _decoded(at: _Range, offset: int) -> tuple[bytes, int] | None:
    """(content, length) of the member at ``offset``, or None if there is none.

    The first bytes must decode to a WARC header before anything more is read; the
    checksum at the end must hold.
    """
    unpacker = zlib.decompressobj(16 + zlib.MAX_WBITS)
    out, fed, checked, whole = [], offset, False, b""
    while not unpacker.eof:
        if fed >= len(at.data) and not at.more():
            return None  # cut off
        try:
            out.append(unpacker.decompress(at.data[fed:]))
        except zlib.error:
            return None
        fed = len(at.data)
        if not checked:
            whole = b"".join(out)
            out = [whole]
            if whole[: len(VERSION)] != VERSION[: len(whole)]:
                return None
            checked = len(whole) >= len(VERSION)
    content = b"".join(out)
    if not content.startswith(VERSION) or BREAK not in content:
        return None
    return content, fed - len(unpacker.unused_data) - offset


def members(file, begin: int, end: int, size: int, piece: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(position, content) of the records that start in [begin, end)."""
    at = _Range(file, begin, piece)
    while at.start < end:
        place = at.data.find(MAGIC)
        if place < 0:
            at.drop(max(0, len(at.data) - len(MAGIC) + 1))
            if at.start >= end or not at.more():
                return
            continue
        if at.start + place >= end:
            return
        got = _decoded(at, place)
        if got is None:
            at.drop(place + 1)
        else:
            yield at.start + place, got[0]
            at.drop(place + got[1])


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of a record."""
    head, _, rest = content.partition(BREAK)
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    return fields, rest[: int(length)] if length.isdigit() else rest.removesuffix(BREAK)


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for task in batch.to_pylist():
            store, path = _open(task["path"])
            with store.open_input_file(path) as file:
                rows = []
                weight = 0
                for place, content in members(file, task["begin"], task["end"], task["bytes"]):
                    fields, block = parse(content)
                    kind = fields.get("warc-type")
                    payload = block.partition(BREAK)[2] if kind == "response" else None
                    digest = hashlib.sha1(payload).hexdigest() if payload is not None else fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    length = len(payload) if payload is not None else int(fields.get("warc-payload-length") or 0)
                    rows.append((task["path"], place, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to")), length, digest, payload))
                    weight += len(content)
                    if weight > 8 << 20:
                        yield _records(rows)
                        rows, weight = [], 0
                yield _records(rows)


_RECORD = pa.schema(
    [
        ("path", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_RECORD)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RECORD.types, strict=True)], schema=_RECORD)


def read_archives(files: DataFrame, *, split_bytes: int = 32 << 20) -> DataFrame:
    """The records of archives (path, bytes): path, position, page_id, url,
    record_type, refers_to, payload_bytes, payload_digest, payload.

    Files are cut into ranges of ``split_bytes``, a task each.  Bytes that are no record,
    and members that do not decode, are passed over.  Size and digest of a response are
    taken from its payload, those of a revisit from its header; its payload is null.
    No file, no row.
    """
    spark = files.sparkSession
    prepare(spark)
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "bytes", begins.alias("begin")).withColumn("end", F.least(F.col("begin") + split_bytes, "bytes"))
    tasks = max(1, min(ranges.count(), 4 * spark.sparkContext.defaultParallelism + files.count()))
    ranges = ranges.repartition(tasks, F.xxhash64("path", "begin"))
    schema = (
        "path string, position long, page_id long, url string, record_type string, refers_to long, "
        "payload_bytes long, payload_digest string, payload binary"
    )
    return ranges.mapInArrow(_reader, schema)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for archives below the shared one."""
    return scratch_path(spark, "warc")
