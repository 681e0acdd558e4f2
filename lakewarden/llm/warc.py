"""Operator 2: WARC archives with an index first, and coalesced byte-range reads.

Writing: each task writes one ``.warc.gz`` archive to the shared folder, one gzip
member a record, and returns the index: archive, offset, length, URL and payload
digest of every record. The index is a Parquet table of small rows; everything
that chooses records works on it alone. Of records with equal payloads one is a
``response`` and the rest are ``revisit`` records which name it.

Reading: the chosen index rows are ordered by archive and offset and close ranges
are read together, so an archive is opened once for each stretch of it and only
wanted bytes (and small gaps) are fetched.

Every attempt of a task writes an archive under a name of its own, and the index names that of
the attempt whose rows Spark keeps; what a lost or repeated attempt has left is never read.
Archives are opened through Arrow's file systems, so the folder may be local or in a cluster
store.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.shared import fresh_path, written

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Neighbouring ranges are read together when fewer than this many bytes lie between them.
GAP_BYTES = 64 << 10
#: One read fetches at most about this much; a single longer record is read alone.
READ_BYTES = 4 << 20
#: A reading task gets all records that start in one stretch of an archive.
STRETCH_BYTES = 4 << 20
#: Bytes of records that a reading task has on average.
READER_BYTES = 8 << 20
#: Revisits up to which their list is broadcast to the payloads; beyond, payloads are shuffled to it.
BROADCAST_REVISITS = 500_000
LEVEL = 3


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id: int, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. ``refers_to`` makes it a revisit, which has HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:])
    return headers, http, payload


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_PACKED = "page_id long, url string, size long, digest string, packed binary"
_INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        payloads = [b"" if h is None else h.encode("utf-8", "surrogatepass") for h in frame["html"]]
        yield pd.DataFrame(
            {
                "page_id": frame["page_id"],
                "url": frame["url"],
                "size": [len(p) for p in payloads],
                "digest": [payload_digest(p) for p in payloads],
                "packed": [zlib.compress(p, LEVEL) for p in payloads],
            }
        )


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, id_column: str = "page_id") -> DataFrame:
    """Write one record per row of ``pages`` (``page_id, url, html``); return the index, read back.

    Null html is an empty payload and a null URL an empty one. Of payloads of at
    least ``min_revisit_bytes`` bytes that are equal, the smallest page_id is the
    response and other ids revisit it; rows that repeat that id are responses too.
    An empty table has an empty index. Other columns are not read.
    """
    spark = pages.sparkSession
    packed = written(
        pages.select(F.col(id_column).cast("long").alias("page_id"), "url", "html").mapInPandas(_pack, _PACKED), "warc-packed"
    )
    # A digest that many rows share is aggregated map-side first, and only its small rows meet.
    first = packed.groupBy("digest").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    first = first.where("__n > 1").drop("__n")
    linked = packed.select("page_id", "digest", "size").join(first, "digest")
    linked = linked.where((F.col("page_id") > F.col("__first")) & (F.col("size") >= min_revisit_bytes))
    linked = written(linked.select("page_id", F.col("__first").alias("refers_to")).distinct(), "warc-revisits")
    rows = packed.join(F.broadcast(linked) if linked.count() <= BROADCAST_REVISITS else linked, "page_id", "left")
    target = fresh_path(spark, "warc-archives")
    if "://" not in target:
        target = "file://" + target if target.startswith("/") else target

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = _filesystem(target)
        store.create_dir(folder, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        offset = 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for frame in frames:
                index = []
                for row in frame.itertuples(index=False):
                    refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                    payload = zlib.decompress(row.packed) if refers is None else None
                    record = build_record(row.page_id, row.url, payload, row.size, row.digest, refers)
                    member = gzip.compress(record, LEVEL, mtime=0)
                    out.write(member)
                    kind = "response" if refers is None else "revisit"
                    index.append((name, offset, len(member), row.page_id, row.url, row.digest, kind))
                    offset += len(member)
                yield pd.DataFrame(index, columns=[c.split()[0] for c in _INDEX.split(", ")])
        if not offset:
            store.delete_file(f"{folder}/{name}")

    index = written(rows.mapInPandas(write, _INDEX), "warc-index")
    return index.withColumn("archive", F.concat(F.lit(target + "/"), "archive"))


def plan_reads(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """Coalesce sorted ``(offset, length)`` to ``(offset, length, first, last)`` over ranges first..last-1."""
    reads: list[list[int]] = []
    for i, (offset, length) in enumerate(ranges):
        if reads:
            last = reads[-1]
            end = last[0] + last[1]
            if offset - end <= gap and max(end, offset + length) - last[0] <= most:
                last[1] = max(end, offset + length) - last[0]
                last[3] = i + 1
                continue
        reads.append([offset, length, i, i + 1])
    return [tuple(r) for r in reads]


def read_records(index: DataFrame, with_html: bool = True) -> DataFrame:
    """The records of the index rows given: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, html``.

    A response's size and digest come from the bytes read; a revisit's from its
    headers, which describe the full payload (its html is null).
    """
    stretch = F.floor(F.col("offset") / F.lit(STRETCH_BYTES))
    wanted = index.select("archive", "offset", "length", stretch.alias("__part"))
    # Index rows are small whatever they stand for, so the number of tasks follows the bytes to read.
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = int(max(1, -(-total // READER_BYTES)))
    wanted = wanted.repartition(tasks, "archive", "__part").sortWithinPartitions("archive", "offset")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, own in frame.groupby("archive", sort=False):
                store, path = _filesystem(archive)
                ranges = list(zip(own["offset"].tolist(), own["length"].tolist(), strict=True))
                with store.open_input_file(path) as source:
                    for offset, length, first, last in plan_reads(ranges):
                        data = source.read_at(length, offset)
                        out = []
                        for at, size in ranges[first:last]:
                            member = zlib.decompress(data[at - offset : at - offset + size], 31)
                            headers, http, payload = parse_record(member)
                            revisit = headers["WARC-Type"] == "revisit"
                            declared = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                            digest = declared if revisit else payload_digest(payload)
                            if digest != declared:
                                raise ValueError(f"{archive} at {at}: the payload does not match its digest")
                            size = int(http["Content-Length"]) if revisit else len(payload)
                            refers = int(headers["X-Refers-To-Page"]) if revisit else None
                            html = payload.decode("utf-8", "surrogatepass") if with_html and not revisit else None
                            out.append(
                                (int(headers["X-Page-Id"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], refers, html)
                            )
                        result = pd.DataFrame(out, columns=[c.split()[0] for c in _READ.split(", ")])
                        result["refers_to"] = result["refers_to"].astype("Int64")
                        yield result

    return wanted.mapInPandas(read, _READ)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_records(write_archives(pages), with_html=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
