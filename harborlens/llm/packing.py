"""Packing of tokenised documents into sequences of fixed length by exact complements and best fit."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborlens.llm.common import bounded_batches
from harborlens.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024
#: How byte-level vocabularies cut texts, and the bytes that stand for themselves in them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Characters whose class every version of Unicode agrees on; other texts go the tokenizer's own way.
_SETTLED = re.compile("[\x00-ɏ‐-‧€]*")


class Encoder:
    """Ids of texts by a tokenizers file.

    Where the file is a byte-level vocabulary whose ids are in order of its merges, the same merges
    run in a quicker implementation; everything else is left to the tokenizer itself.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.quick = _quick(json.loads(self.tokenizer.to_str()))

    def encode(self, text: str) -> np.ndarray:
        if self.quick is not None and _SETTLED.fullmatch(text):
            return self.quick.encode_to_numpy(text, allowed_special="all")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _quick(spec: dict):
    """The vocabulary as ranked byte strings, or None where that would not say the same."""
    import tiktoken

    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    vocab, added = model.get("vocab", {}), spec["added_tokens"]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model.get("merges", [])]
    plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
    level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    options = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model["type"] != "BPE" or spec["normalizer"] or options or not plain or not level or merged != sorted(set(merged)):
        return None
    shown = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*PLAIN_BYTES}))}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(shown[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=1)
def encoder(path: str | None) -> Encoder:
    """The encoder of this Python worker, which may run many tasks."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; all but the first have ``capacity`` ids."""
    bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
    return list(zip(bounds, np.diff(bounds).tolist()))


def tokenise(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32, part, nth[, ids]) of every row's ids and the end id.

    ``part`` numbers the task and ``nth`` the pieces of one length in it, from 0: written rows so keep
    a gapless number per (part, length) that no later shuffle or sort has to find.
    """
    bounded_batches(docs.sparkSession, 256)
    rows = docs.select(F.col(id_column), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, seen = TaskContext.get().partitionId(), encoder(tokenizer).encode, defaultdict(int)
        for batch in batches:
            owner, columns = [], defaultdict(list)
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start:start + length]
                    owner.append(row)
                    for name, value in (
                        ("piece", piece), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(own.tobytes())), ("part", part), ("nth", seen[length])
                    ):
                        columns[name].append(value)
                    seen[length] += 1
                    if keep_ids:
                        columns["ids"].append(own.astype(np.int32))
            kinds = {"piece": pa.int32(), "part": pa.int32(), "ids": pa.list_(pa.int32())}
            made = {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in columns.items()}
            if owner:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *made.values()], names=[id_column, *made])

    schema = f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    return rows.mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


@dataclass(frozen=True)
class Line:
    """``copies`` sequences that hold, in this order, runs (length, how many) of pieces."""

    copies: int
    runs: tuple[tuple[int, int], ...]


class Lengths:
    """Available pieces by length, with an index from sums to the pairs that have them.

    The pairs of a sum are listed once, when it is first asked for, and lose entries as lengths run out.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.counts = np.zeros(capacity + 1, np.int64)
        self.counts[list(histogram)] = list(histogram.values())
        self.pairs: dict[int, list[tuple[int, int]]] = {}

    def together(self, lengths: Sequence[int]) -> int:
        """How often these lengths are there together."""
        return min(int(self.counts[x]) // lengths.count(x) for x in set(lengths))

    def fitting(self, line: list[int], gap: int) -> Iterator[int]:
        """Lengths still there beside ``line`` that fit the gap, largest first."""
        return (x for x in np.flatnonzero(self.counts[:gap + 1])[::-1].tolist() if self.counts[x] > line.count(x))

    def pair(self, line: list[int], total: int, least: int, most: int) -> tuple[int, int] | None:
        """The pair of this sum with the largest first member from ``least`` to ``most``."""
        known = self.pairs.get(total)
        if known is None:
            known = [(a, total - a) for a in range(min(total, len(self.counts)) - 1, (total - 1) // 2, -1)]
        self.pairs[total] = known = [p for p in known if self.counts[p[0]] and self.counts[p[1]]]
        return next((p for p in known if least <= p[0] <= most and self.together([*line, *p])), None)

    def complement(self, line: list[int], gap: int, reach: int) -> tuple[int, ...]:
        """One, two or three lengths that fill the gap exactly, else the largest that fits it (or none).

        The largest member must come within ``reach`` of the largest length that fits: filling gaps
        with small pieces alone would leave the larger ones without company.
        """
        fitting = self.fitting(line, gap)
        largest = next(fitting, 0)
        if largest in (0, gap):
            return (largest,) if largest else ()
        least = largest - reach
        if found := self.pair(line, gap, least, largest):
            return found
        for a in chain([largest], fitting):
            if a < max(least, -(-gap // 3)):
                break
            if found := self.pair([*line, a], gap - a, 1, a):
                return (a, *found)
        return (largest,)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Line]:
    """Which lengths share sequences, from the number of pieces of each length alone.

    Longest first, each length opens a sequence and looks up the gap among the available lengths, pair
    sums and triple sums. Where no combination fills it exactly, the largest length that fits goes in (the
    best fit) and the rest of the gap is looked up again. A sequence is made as often as all its
    members last. Each line so uses up a length, or leaves fewer of it than the line has: the plan grows
    with ``capacity``, not with the pieces.
    """
    lengths, lines = Lengths(histogram, capacity), []
    for base in range(capacity, 0, -1):
        while lengths.counts[base]:
            line = [base]
            while (gap := capacity - sum(line)) and (more := lengths.complement(line, gap, capacity // 64)):
                line += more
            copies = lengths.together(line)
            lines.append(Line(copies, tuple((x, line.count(x)) for x in dict.fromkeys(line))))
            for x in line:
                lengths.counts[x] -= copies
    return lines


def slots(lines: Sequence[Line]) -> dict[int, np.ndarray]:
    """Per length rows (first rank, first sequence, offset, pieces of it per sequence), by first rank."""
    taken: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for line in lines:
        offset = 0
        for length, many in line.runs:
            out[length].append((taken[length], sequence, offset, many))
            taken[length] += many * line.copies
            offset += many * length
        sequence += line.copies
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    ``pieces`` is a written table with length, part and nth as ``tokenise`` gives them. Only the
    number of pieces per length reaches the driver (``capacity`` numbers at most); its plan goes to
    every task. A piece's rank among those of its length is the pieces of that length in
    earlier parts plus its own number, so no task sees all pieces of a length.
    """
    cells = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    where = pieces.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("length", "part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))

    @F.pandas_udf("sequence_id long, offset long")
    def spot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for one in np.unique(lengths):
            mine = np.flatnonzero(lengths == one)
            rows = where.value[int(one)]
            found = rows[np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1]
            since = ranks[mine] - found[:, 0]
            out[mine, 0] = found[:, 1] + since // found[:, 3]
            out[mine, 1] = found[:, 2] + since % found[:, 3] * one
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = pieces.join(before, ["length", "part"]).withColumn("__at", spot("length", F.col("nth") + F.col("__before")))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    return placed.select(*kept, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Every row's pieces and the sequence and offset where each stands.

    Returns id, piece, start, length, ids_crc32, [ids,] sequence_id, offset. A null or empty text is
    the end id alone, rows with equal ids or texts are packed apart, null ids stay, other columns
    of the input are left behind (so none can clash, but the id column must not be called like a
    new one), an empty table gives no rows. ``tokenizer`` is a file that every executor can read;
    None takes the installed public one. Pieces are tokenised once and written to the shared folder.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    tokenise(docs, capacity, end_id, tokenizer, keep_ids, id_column, text_column).write.parquet(path)
    return place(spark.read.parquet(path), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) of pieces that were packed with their ids: the rows a training run reads."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # one sequence: capacity ids at most
    return placed.groupBy("sequence_id").agg(inside.alias("__in")).select(
        "sequence_id", F.flatten("__in.ids").alias("ids"), F.col("__in.length").alias("lengths")
    )
