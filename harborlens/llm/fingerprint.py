"""Context-triggered piecewise hashes of texts and their likeness."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import bounded_batches, id_order, id_ranges, shuffle_width

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW = 7
SMALLEST_BLOCK = 3
LENGTH = 64
#: Signatures must share a run of this many characters (a third of the shorter one, if that is less).
COMMON_RUN = 7


def rolling(data: bytes) -> np.ndarray:
    """At every byte, a hash of it and the six before it: their sum, their weighted sum, a shifted xor."""
    n = len(data)
    padded = np.zeros(n + WINDOW - 1, np.uint32)
    padded[WINDOW - 1:] = np.frombuffer(data, np.uint8)
    plain = np.zeros(n, np.uint32)
    weighted = np.zeros(n, np.uint32)
    shifted = np.zeros(n, np.uint32)
    for k in range(WINDOW):  # k bytes back
        byte = padded[WINDOW - 1 - k:WINDOW - 1 - k + n]
        plain += byte
        weighted += byte * np.uint32(WINDOW - k)
        shifted ^= byte << np.uint32(5 * k)
    return plain + weighted + shifted


def signature(data: bytes, ends: np.ndarray) -> str:
    """One character per chunk; whatever follows the 63rd boundary is one chunk."""
    cuts = [0, *(int(e) + 1 for e in ends[:LENGTH - 1])]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return "".join(ALPHABET[zlib.crc32(data[a:b]) & 63] for a, b in zip(cuts, cuts[1:]))


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block``.

    A boundary is where the rolling hash is one less than a multiple of the block size. The block
    is the smallest 3 * 2**k that cuts the text into about 64 chunks at most, halved while there
    would be less than 32.
    """
    block = SMALLEST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    hashes = rolling(data)
    while True:
        ends = np.flatnonzero(hashes % np.uint32(block) == block - 1)
        if block == SMALLEST_BLOCK or len(ends) >= LENGTH // 2:
            break
        block //= 2
    double = ends[hashes[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{signature(data, ends)}:{signature(data, double)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table per machine word operation."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str) -> float:
    """1 - edits / characters, with insertions and deletions as edits; 0 without a common run."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(COMMON_RUN, max(1, min(len(a), len(b)) // 3))
    if not {a[i:i + run] for i in range(len(a) - run + 1)} & {b[i:i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1 between fingerprints of compatible blocks (equal, or one twice the other), else 0."""
    if one == other:
        return 1.0
    (m, a, aa), (n, b, bb) = one.split(":"), other.split(":")
    if m == n:
        return max(signature_likeness(a, b), signature_likeness(aa, bb))
    if int(m) == 2 * int(n):
        return signature_likeness(a, bb)
    if int(n) == 2 * int(m):
        return signature_likeness(aa, b)
    return 0.0


def add_fingerprints(docs: DataFrame, text_column: str = "text", out: str = "fingerprint") -> DataFrame:
    """The rows with the fingerprint of their text (null: that of the empty text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_bytes")
            prints = pa.array([fingerprint(x.as_py() or b"") for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), prints], names=names)

    kept = [c for c in docs.columns if c.lower() != out.lower()]
    names = [*kept, out]
    rows = docs.select(*kept, F.col(text_column).cast("binary").alias("_bytes"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_bytes"]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{out}` string"]))


def compare_with_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document, its fingerprint against that of an edited text and that of the next document.

    Documents stand in descending order of id; the edited text has its last third (in code points,
    rounded down) replaced by as many first code points of the next document, or all it has; after
    the last document comes the first. Ranges of ids are sorted by themselves; the only other rows
    a task needs are the first ones of the range after its own, one per range, which travel along.

    Null and empty texts are empty; their fingerprints are equal and their likeness is 1. Null ids
    come last in the order, rows with equal ids follow in order of text (null first), a single
    document is its own next one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    width = shuffle_width(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), id_order(id_column).alias("at"), F.col(text_column).alias("text"))
    range_of = id_ranges(rows.select("at"), F.col("at"), 4 * width)
    tops = rows.groupBy(range_of(F.col("at")).alias("part")).agg(F.max("at").alias("top")).orderBy("part").collect()  # one row per range
    serves = [(tops[i - 1].top, tops[i].part) for i in range(len(tops))]  # the lowest range is followed by the highest
    heads = spark.createDataFrame(serves, "head long, part int")
    following = rows.where(F.col("at").isin([a for a, _ in serves])).join(
        F.broadcast(heads), F.col("at") == F.col("head")
    ).select("doc_id", "at", "text", "part", F.lit(1).alias("after"))
    placed = rows.select("doc_id", "at", "text", range_of(F.col("at")).alias("part"), F.lit(0).alias("after")).unionByName(following)
    order = ["part", "after", F.col("at").desc(), F.col("text").asc_nulls_first()]
    ordered = placed.repartition(width, "part").sortWithinPartitions(*order).select("doc_id", "text", "part", "after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row = None  # (part, id, text, its fingerprint) that waits for the next document
        done: list[tuple] = []
        for batch in batches:
            for doc, text, part, after in zip(*(c for c in batch.columns)):
                doc, text, part, after = doc.as_py(), text.as_py() or "", part.as_py(), after.as_py()
                if after and (open_row is None or open_row[0] != part):
                    continue  # more rows with the id of the first one
                own = fingerprint(text.encode())
                if open_row is not None:
                    done.append(compared(open_row, text, own))
                open_row = None if after else (part, doc, text, own)
                if len(done) >= 2048:
                    yield packed(done)
                    done = []
        if done:
            yield packed(done)

    def compared(row: tuple, following: str, its: str) -> tuple:
        _, doc, text, own = row
        cut = len(text) // 3
        edited = (text[:len(text) - cut] + following[:cut]).encode()
        changed = fingerprint(edited)
        return doc, len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, its)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=OUT)

    return ordered.mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
