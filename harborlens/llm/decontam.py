"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import bounded_batches, hidden, slices

#: Items are compared in blocks of so many; each block is one pass over the documents' words.
BLOCK_ITEMS = 20_000
#: Documents are tokenised together in pieces of about so many bytes.
CHUNK_BYTES = 1 << 20
#: Items of fewer words allow no edit and are looked up whole.
SHORT = 5

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
END = np.uint64(0)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def tokens(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, byte position in its text) of every word of lower-cased texts.

    A word is a run of a-z, 0-9 and bytes beyond ASCII, so punctuation, markup and line ends
    between the words of a passage do not matter.
    """
    encoded = [t.lower().encode() for t in texts]
    data = b" ".join(encoded) + b" "
    raw = np.frombuffer(data, np.uint8)
    inside = _WORD_BYTE[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    names = (sums[end] - sums[begin]) * _powers(_INVERSE, len(data))[begin]  # the same at any place
    names ^= names >> np.uint64(31)
    names *= _STEP
    names ^= names >> np.uint64(29)
    names[names == END] = np.uint64(1)
    starts = np.cumsum([0, *(len(e) + 1 for e in encoded[:-1])]) if encoded else np.zeros(0, np.int64)
    owner = np.searchsorted(starts, begin, side="right") - 1
    return names, owner, (begin - starts[owner] if len(begin) else begin)


@dataclass(frozen=True)
class Walk:
    """One repetition: the coins of a random walk over the words and the steps whose word is sampled."""

    coins: np.ndarray  # an odd multiplier per step; its product's top bit decides whether the walk moves on
    sampled: frozenset[int]


def walks(steps: int, samples: int, repetitions: int, seed: int) -> list[Walk]:
    out = []
    for r in range(repetitions):
        draw = [xxhash.xxh64_intdigest(f"{seed}:{steps}:{r}:{j}".encode()) for j in range(2 * steps)]
        # The first two symbols agree already, as windows start at a shared pair of words.
        order = sorted(range(min(2, steps - samples), steps), key=lambda j: draw[steps + j])
        out.append(Walk(np.array([d | 1 for d in draw[:steps]], np.uint64), frozenset(order[:samples])))
    return out


def sampled_keys(names: np.ndarray, starts: np.ndarray, walk: Walk) -> np.ndarray:
    """The sampled words of the embeddings of the windows at ``starts``, hashed.

    CGK: the embedding's next symbol is the word at the walk's place; a coin that depends on step
    and word moves it on or not. Walks that part at an edit tend to meet again, so a small edit
    distance becomes a small Hamming distance.
    """
    place = starts.copy()
    key = np.zeros(len(starts), np.uint64)
    for j, coin in enumerate(walk.coins):
        symbol = names[place]
        if j in walk.sampled:
            key = (key ^ symbol) * _STEP
            key ^= key >> np.uint64(32)
        place = place + ((symbol * coin) >> np.uint64(63)).astype(np.int64)
    return key


def edit_distance(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of the window nearest to the item, if within ``most`` edits.

    One row of the table at a time, words as letters; the part may start and end anywhere.
    """
    n = len(window)
    columns = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), columns
    best, origin = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
    for i, word in enumerate(item, 1):
        diagonal = row[:-1] + (window != word)
        above = row[1:] + 1
        best[0], origin[0] = i, 0
        np.minimum(diagonal, above, out=best[1:])
        origin[1:] = np.where(diagonal <= above, start[:-1], start[1:])
        # Insertions: the least of (value - column) so far, as a running minimum with its place.
        best -= columns
        low = np.minimum.accumulate(best)
        came = np.maximum.accumulate(np.where(best == low, columns, 0))
        row, start = low + columns, origin[came]
    end = int(np.argmin(row))
    return (int(row[end]), int(start[end]), end) if row[end] <= most else None


class Index:
    """A block of items, ready for lookups; a few hundred bytes per item word."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str], similarity: float, samples: int, repetitions: int, seed: int):
        names, owner, _ = tokens(texts)
        cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
        self.ids = list(ids)
        self.items = [names[a:b] for a, b in zip(cuts, cuts[1:])]
        self.words = [set(i.tolist()) for i in self.items]
        self.allowed = [int((1 - similarity) * len(i) + 1e-9) for i in self.items]
        self.exact: dict[int, dict[int, list[int]]] = {}
        self.classes = []
        sizes = np.array([len(i) for i in self.items])
        for n in range(1, SHORT):
            chosen = np.flatnonzero(sizes == n)
            if len(chosen):
                table: dict[int, list[int]] = {}
                for i in chosen.tolist():
                    table.setdefault(int(run_hash(self.items[i], n)[0]), []).append(i)
                self.exact[n] = table
        least = SHORT
        while least <= max(sizes, default=0):
            chosen = np.flatnonzero((sizes >= least) & (sizes < 2 * least))
            if len(chosen):
                self.classes.append(self._class(chosen, least, samples, repetitions, seed))
            least *= 2

    def _class(self, chosen: np.ndarray, least: int, samples: int, repetitions: int, seed: int) -> tuple:
        # Windows start at each of the first words of an item: an edit there must not hide it.
        offsets = max(1, least // 3)
        steps = max(samples, 3 * (least - offsets) // 2)
        found = walks(steps, samples, repetitions, seed)
        parts, starts, item, offset, at = [], [], [], [], 0
        for i in chosen.tolist():
            padded = np.r_[self.items[i], np.full(steps + 2, END)]
            for o in range(offsets):
                starts.append(at + o)
                item.append(i)
                offset.append(o)
            parts.append(padded)
            at += len(padded)
        names, starts = np.concatenate(parts), np.array(starts)
        item, offset = np.array(item), np.array(offset)
        pairs = np.unique(run_hash(names, 2)[starts])
        tables = []
        for walk in found:
            keys = sampled_keys(names, starts, walk)
            order = np.argsort(keys, kind="stable")
            tables.append((walk, keys[order], item[order], offset[order]))
        return pairs, tables, steps

    def candidates(self, names: np.ndarray) -> set[tuple[int, int, int]]:
        """(item, first word of its window, a word inside) of the windows that share a sample with an item."""
        out: dict[tuple[int, int], int] = {}
        for n, table in self.exact.items():
            runs = run_hash(names, n)
            for s in np.flatnonzero(np.isin(runs, np.array(list(table), np.uint64))).tolist():
                out.update(((i, s), s) for i in table[int(runs[s])])
        pairs = run_hash(names, 2)
        for known, tables, steps in self.classes:
            starts = np.flatnonzero(known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs)
            if not len(starts):
                continue
            padded = np.r_[names, np.full(steps + 2, END)]
            for walk, keys, item, offset in tables:
                mine = sampled_keys(padded, starts, walk)
                low = np.searchsorted(keys, mine, side="left")
                high = np.searchsorted(keys, mine, side="right")
                hit = np.flatnonzero(high > low)
                count = high[hit] - low[hit]
                where = np.repeat(low[hit] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(hit) else hit
                begin = np.repeat(starts[hit], count) - offset[where]
                out.update(zip(zip(item[where].tolist(), begin.tolist()), np.repeat(starts[hit], count).tolist()))
        return {(i, begin, seen) for (i, begin), seen in out.items()}

    def matches(self, names: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, first word, word behind the last, edits): the best place per text and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        bounds = np.searchsorted(owner, np.arange(owner[-1] + 2))
        for i, begin, seen in sorted(self.candidates(names)):
            item, most = self.items[i], self.allowed[i]
            text = owner[seen]
            key = (int(text), self.ids[i])
            if key in best and best[key][0] == 0:
                continue
            first, last = bounds[text], bounds[text + 1]
            a, b = max(first, begin - most), min(last, begin + len(item) + most)
            if len(self.words[i].intersection(names[a:b].tolist())) < len(self.words[i]) - most:
                continue  # an edit removes one word at most
            found = edit_distance(item, names[a:b], most)
            if found:
                entry = (found[0], int(a + found[1]), int(a + found[2]))
                best[key] = min(best.get(key, entry), entry)
        return [(t, i, a, b, d) for (t, i), (d, a, b) in sorted(best.items())]


def run_hash(names: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from every start."""
    out = np.zeros(max(0, len(names) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ names[k:k + len(out)]) * _STEP
        out ^= out >> np.uint64(32)
    return out


def find_items(
    docs: DataFrame, items: DataFrame, similarity: float = 0.8, samples: int = 4, repetitions: int = 20, seed: int = 9,
    id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Every row with ``hits``: array of (item_id, edits, words, start, end), best place per item.

    A document contains an item if some run of its words is within (1 - similarity) * words edits
    of it (insert, delete or replace a word; start and end count the document's words). Windows of
    an item's size are embedded by CGK walks, ``repetitions`` times; each time ``samples`` places of
    the embedding are compared, and windows that agree are verified exactly, so nothing is reported
    that is not there. Windows start at words whose pair with the next one starts a window of an
    item too: each of the first third of an item's words gives such a start, and it takes one of
    them without an edit for a hit. With a fifth of the words edited at random the chance to find
    an item of 14 words or more is above 0.95 (measured in the tests); unedited passages are always
    found. Items of fewer than five words allow no edit and are looked up exactly.

    The items are a query set: blocks of ``block_items`` go to every task, one pass each.
    Null and empty texts contain nothing, null and empty items are contained nowhere, equal items
    are reported by each id, an empty table of either kind is allowed. A column named hits is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [c for c in docs.columns if c.lower() != "hits"]
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    count = items.count()
    blocks = max(1, -(-count // block_items))
    schema = "array<struct<item_id: bigint, edits: int, words: int, start: int, end: int>>"
    out = docs.select(*kept)
    names = hidden(docs, *[f"_hits{block}" for block in range(blocks)])
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", F.lit("block")), F.lit(blocks)) == block) if blocks > 1 else items
        rows = part.orderBy("item_id", "text").collect()  # one bounded block
        index = spark.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], similarity, samples, repetitions, seed))
        out = _with_hits(out, index, text_column, names[block], schema)
    hits = F.col(names[0]) if blocks == 1 else F.flatten(F.array(*map(F.col, names)))
    return out.select(*kept, F.array_sort(hits).alias("hits"))


def _with_hits(docs: DataFrame, index, text_column: str, name: str, schema: str) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        words = {i: len(item) for i, item in zip(found.ids, found.items)}
        for batch in batches:
            texts = [t or "" for t in batch.column(text_column).to_pylist()]
            hits: list[list[dict]] = [[] for _ in texts]
            for a, b in slices(len(texts), np.array([len(t) for t in texts]), CHUNK_BYTES):
                names, owner, _ = tokens(texts[a:b])
                if not len(names):
                    continue
                first = np.searchsorted(owner, np.arange(b - a))
                for text, item, start, end, edits in found.matches(names, owner):
                    low = int(first[text])
                    hits[a + text].append({"item_id": item, "edits": edits, "words": words[item], "start": start - low, "end": end - low})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], names=[*batch.schema.names, name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{name}` {schema}"]))
