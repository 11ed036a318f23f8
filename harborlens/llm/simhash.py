"""SimHash fingerprints and exact links between them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborlens.llm.common import bounded_batches, hidden, id_order
from harborlens.operators.graph import connected_components
from harborlens.session import cut_lineage

#: Seeds of the reference fingerprints: pivot i is XXH64 of the number i.
PIVOTS = 24
#: A bucket of more fingerprints than this is linked through shared neighbours instead of pairs.
PAIR_BUCKET = 16
STEP = 1 << 16


def fingerprint(text: bytes | None, width: int = 3) -> bytes:
    """Eight bytes: bit by bit, what over half of the shingles' XXH64 (seed 42) have.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; fewer than ``width``
    make one shingle; none (or null) gives zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return bytes(8)
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    total = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, STEP):
        end = min(total, start + STEP)
        runs = zip(*(words[start + k:end + k] for k in range(width)))
        digests = b"".join([xxhash.xxh64_digest(b" ".join(run), 42) for run in runs])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > total).tobytes()


def add_fingerprints(docs: DataFrame, text_column: str = "text", out: str = "_fp", width: int = 3) -> DataFrame:
    """The rows without their text, with the fingerprint as a long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_bytes")
            prints = [fingerprint(x.as_py(), width) for x in batch.column(at)]
            longs = pa.array(np.frombuffer(b"".join(prints), ">u8").astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(batch.columns) if i != at), longs],
                names=[*(n for i, n in enumerate(batch.schema.names) if i != at), out],
            )

    rows = docs.withColumn("_bytes", F.col(text_column).cast("binary")).drop(text_column)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_bytes"]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{out}` long"]))


def pivot_fingerprints(n: int = PIVOTS) -> list[int]:
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i).encode())).view(np.int64)) for i in range(n)]


def _blocks(fp: Column, blocks: int, chosen: int) -> Column:
    """Keys of a fingerprint: each choice of that many blocks, with its number."""
    width = 64 // blocks
    part = [F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(blocks)]
    keys = []
    for number, choice in enumerate(combinations(range(blocks), chosen)):
        value = F.lit(number).cast("long")
        for i in choice:
            value = F.shiftleft(value, width).bitwiseOR(part[i])
        keys.append(value)
    return F.array(*keys)


def links(prints: DataFrame, most: int = 2, pivots: int = PIVOTS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(src, dst) between ids whose fingerprints differ in at most two bits: enough for all components.

    ``prints`` has one row (id, fp) per fingerprint. Every row gets its table of Hamming distances
    to the reference fingerprints once. By the triangle inequality two fingerprints within two bits
    differ by two at most in every coordinate, so a pair is dropped at the first coordinate that
    differs more, and what survives is verified bit by bit. Distances of 64-bit fingerprints to any
    reference gather around 32, so the tables alone would leave a fixed share of all pairs;
    therefore pairs only meet where they can be close: of four blocks of 16 bits, two bits can
    change two, so close fingerprints share two whole blocks (six keys each).

    A key shared by more than ``pair_bucket`` fingerprints makes no pairs. Two fingerprints are
    within two bits exactly if some value is within one bit of both; so the members of such
    buckets each name their 65 values, and those that name the same one are linked in a star.
    """
    if most != 2:
        raise ValueError("blocks and shared neighbours are laid out for two bits")
    table = prints.withColumns({
        f"p{i}": F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for i, p in enumerate(pivot_fingerprints(pivots))
    })
    keyed = table.withColumn("key", F.explode(_blocks(F.col("fp"), 4, 2)))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut_lineage(keyed.join(shared, "key"))
    cold = members.where(F.col("n") <= pair_bucket).drop("n")
    left, right = cold.alias("a"), cold.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))
    for i in range(pivots):
        near = near & (F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) <= most)
    near = near & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most)
    pairs = left.join(right, near).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    hot = members.where(F.col("n") > pair_bucket).select("id", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(int(np.uint64(1 << i).view(np.int64))) for i in range(64)])
    named = hot.select("id", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("value"))
    stars = named.groupBy("value").agg(F.collect_set("id").alias("ids")).where("size(ids) > 1")  # 65 at most
    star = stars.select(F.explode("ids").alias("src"), F.array_min("ids").alias("dst")).where("src <> dst")
    return pairs.unionByName(star).distinct()


def classes_of(rows: DataFrame) -> DataFrame:
    """(fp, component): the component of a fingerprint is the smallest one (as a number) that links reach.

    ``rows`` has a column _fp; equal fingerprints are one node of the graph.
    """
    nodes = cut_lineage(rows.select(F.col("_fp").alias("fp")).distinct())
    found = links(nodes.select(F.col("fp").alias("id"), "fp"))
    joined = connected_components(found.select("src", "dst"))
    return cut_lineage(
        nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3,
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row.

    The component is the smallest id that links reach: equal fingerprints, and fingerprints that
    differ in at most two bits. Texts without words (null, empty, blank) have fingerprint zero and
    are linked like any other. A row with a null id belongs to its component too, whose name is the
    smallest id that is not null (null if all are). An empty table gives an empty result; other
    columns are not touched.
    """
    rows = docs.select(F.col(id_column).alias(id_column), F.col(text_column).alias("_text"))
    rows = cut_lineage(add_fingerprints(rows, "_text", "_fp", width))
    classes = classes_of(rows)
    least = rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_column).alias("least"))
    smallest = classes.join(least, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, rows["_fp"] == named["fp"]).select(
        id_column, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id.

    A null id counts as the smallest. Of rows that share the smallest id the one whose text hashes
    lowest stays, of equal rows any one; what stays is a row of the input.
    """
    at, mark, place, low, lowest = hidden(docs, "_at", "_mark", "_place", "_low", "_lowest")
    keys = docs.withColumns({at: id_order(id_column), mark: F.xxhash64(text_column)})
    rows = keys.select(F.col(at).alias(low), F.col(mark).alias(lowest), F.col(text_column).alias("_text"))
    rows = cut_lineage(add_fingerprints(rows, "_text", "_fp", width))
    classes = classes_of(rows)
    least = rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(F.struct(low, lowest)).alias("least"))
    chosen = classes.join(least, "fp").groupBy("component").agg(F.min("least").alias("least")).select(f"least.{low}", f"least.{lowest}")
    kept = keys.join(chosen, (F.col(at) == F.col(low)) & (F.col(mark) == F.col(lowest)), "left_semi")
    first = Window.partitionBy(at, mark).orderBy(F.lit(1))
    return kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns)
