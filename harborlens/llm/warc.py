"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.llm.common import bounded_batches, shuffle_width
from harborlens.session import cut_lineage, scratch_path

# Fixed values of the formats: skippable frame and seek table of seekable Zstandard, WARC revisit profile.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A payload below this size is stored again instead of referred to.
LEAST_SHARED = 100
FRAME_RECORDS = 32
FRAME_BYTES = 1 << 19
BUNDLE_BYTES = 1 << 28
INDEX = "record_id string, page_id long, bundle string, frame int, frame_offset long, record_bytes long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _field(value: str) -> str:
    """A header value: control characters would end the line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """(header fields in lower case, block, position behind the record)."""
    end = data.index(b"\r\n\r\n", start)
    version, *lines = data[start:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {start}")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    stop = end + 4 + int(fields["content-length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {start} does not end where its length says")
    return fields, data[end + 4:stop], stop + 4


class BundleWriter:
    """Independent frames, then a skippable frame with the table of their sizes."""

    def __init__(self, stream):
        self.stream, self.frames, self.size = stream, [], 0
        self.pack = zstandard.ZstdCompressor(level=6, write_content_size=True, write_checksum=True)

    def frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.stream.write(packed)
        self.frames.append((len(packed), len(data)))
        self.size += len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Frames by number: one range of the file per frame, found in the table at its end."""

    def __init__(self, path: str):
        system, inner = pa.fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames = [struct.unpack_from("<II", table, 8 * i) for i in range(count)]
        self.starts = [0]
        for packed, _ in self.frames:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        packed, size = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[number]), max_output_size=size)


def archive(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least_shared: int = LEAST_SHARED) -> DataFrame:
    """Write every page as a record below ``folder`` and return the index of the records.

    ``pages`` has page_id, url and html. Of equal payloads of ``least_shared`` bytes or more the
    smallest page_id is written as a response, the others as revisits of it. Digests are grouped
    without the pages; only the rows that revisit come back to them, by page_id. Each task writes
    its partition into bundles of its own; names are fresh for every attempt, and the index, which is
    checkpointed, only knows what successful attempts wrote.

    Null html is an empty payload, a null url leaves its field out, control characters in it are
    escaped. Rows with equal page_id and payload are both written; a null page_id can revisit, but
    is never the smallest while another id has the payload. No pages, no bundles, an empty index.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= least_shared)
    firsts = shared.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    revisits = (
        shared.select("page_id", "digest").join(firsts.select("digest", "refers_to"), "digest")
        .where("page_id is null or page_id <> refers_to")
        .select(F.coalesce("page_id", F.lit(-1)).alias("id"), F.col("page_id").isNull().alias("none"), F.col("digest").alias("of"), "refers_to").distinct()
    )
    marked = rows.join(
        revisits,
        (F.coalesce(rows["page_id"], F.lit(-1)) == revisits["id"]) & (rows["page_id"].isNull() == revisits["none"]) & (rows["digest"] == revisits["of"]),
        "left",
    ).select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, inner = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        bundle, number = None, 0
        frame, held, waiting = [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal frame, held, waiting, bundle, number, path
            if bundle is None:
                name = f"bundle-{task.partitionId():06d}-{number:04d}-{os.urandom(6).hex()}.warc.zst"
                path = f"{folder}/{name}"
                bundle = BundleWriter(system.open_output_stream(f"{inner}/{name}", compression=None))
                number += 1
            rows = [(*w[:2], path, len(bundle.frames), *w[2:]) for w in waiting]
            bundle.frame(b"".join(frame))
            frame, held, waiting = [], 0, []
            if bundle.size >= BUNDLE_BYTES:
                bundle.close()
                bundle = None
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in INDEX.split(", ")])

        path = ""
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*batch.columns):
                page_id, digest = page_id.as_py(), digest.as_py()
                data = record(page_id, url.as_py(), payload.as_py(), digest, refers_to.as_py(), date)
                waiting.append((record_id(page_id, digest), page_id, held, len(data)))
                frame.append(data)
                held += len(data)
                if len(frame) >= FRAME_RECORDS or held >= FRAME_BYTES:
                    yield flush()
        if frame:
            yield flush()
        if bundle is not None:
            bundle.close()

    return cut_lineage(marked.mapInArrow(write, INDEX))


def read_back(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of an index.

    Records come frame by frame: a task gets the index rows of whole frames, fetches each frame once
    by the bundle's seek table and finds each record at its offset in the frame. Size and digest
    of a response are taken from its bytes; those of a revisit from the response that it
    refers to. A record that is not where the index says, or whose digest differs, is an error.
    """
    width = shuffle_width(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = lru_cache(maxsize=4)(BundleReader)
        at, data = None, b""
        for batch in batches:
            rows = []
            for key, page_id, bundle, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("record_id", "page_id", "bundle", "frame", "frame_offset"))):
                if at != (bundle, frame):
                    at, data = (bundle, frame), reader(bundle).frame(frame)
                fields, block, _ = parse(data, offset)
                if fields["warc-record-id"] != key:
                    raise ValueError(f"{key} is not at {offset} of frame {frame} of {bundle}")
                stored = fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "revisit":
                    rows.append((key, page_id, None, stored, "revisit", fields["warc-refers-to"]))
                    continue
                payload = block[block.index(b"\r\n\r\n") + 4:]
                digest = hashlib.sha256(payload).hexdigest()
                if digest != stored:
                    raise ValueError(f"the payload of {key} does not match its digest")
                rows.append((key, page_id, len(payload), digest, "response", None))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "target"],
            )

    records = index.repartition(width, "bundle", "frame").sortWithinPartitions("bundle", "frame", "frame_offset").mapInArrow(
        read, "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, target string"
    )
    records = cut_lineage(records)
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"),
        F.col("payload_digest").alias("full_digest"),
    ).dropDuplicates(["target"])
    revisits = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "target")
    resolved = revisits.join(responses, "target", "left").select(
        "page_id",
        F.when(F.col("full_digest") == F.col("payload_digest"), F.col("full_bytes"))
        .otherwise(F.raise_error(F.concat(F.lit("a revisit without its response: "), "target")).cast("long")).alias("payload_bytes"),
        F.col("full_digest").alias("payload_digest"), "record_type", "refers_to",
    )
    return records.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(resolved)


def fresh_folder(spark: SparkSession, name: str = "warc") -> str:
    """A new folder for bundles below the session's shared folder."""
    return scratch_path(spark, name)


#: What reading back the archives of ``pages`` gives, in SQL.
READ_BACK_SQL = """
WITH payloads AS (SELECT page_id, COALESCE(html, '') AS payload FROM pages),
grouped AS (
    SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
        MIN(page_id) OVER (PARTITION BY payload) AS smallest
    FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND smallest < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND smallest < page_id THEN smallest END AS refers_to
FROM grouped
"""
