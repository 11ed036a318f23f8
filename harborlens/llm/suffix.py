"""Exact removal of repeated byte strings by a hash-compared suffix sort.

Equal strings have to meet before they can be compared, and a table of all suffixes does not fit
any budget. Every string of ``length`` bytes therefore goes where its minimizer (the least hash of
its 24-byte grams) sends it; neighbours mostly share it, so they travel as one snippet. Minimizers
that only one text has are settled before any text moves. Inside a bucket the suffixes of the
snippets are merge-sorted; a comparison finds the common extension by binary search over prefix
polynomial hashes, and equal neighbours are verified byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import bounded_batches, id_order, shuffle_width, slices

GRAM = 24
#: Longer texts are handled in pieces of so many string starts.
SEGMENT = 1 << 22
#: So many bytes or string starts of a bucket are worked on at a time (about a hundred bytes of memory each).
PART = 1 << 19
BASE = np.uint64(0x5851F42D4C957F2D)


def eight_bytes(data: bytes) -> np.ndarray:
    """The eight bytes from every start as a number."""
    n = len(data) - 7
    eight = np.empty(n, np.uint64)
    for shift in range(8):
        part = np.frombuffer(data, "<u8", offset=shift, count=(len(data) - shift) // 8)
        eight[shift::8] = part[:(n - shift + 7) // 8]
    return eight


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the 24 bytes from every start."""
    eight = eight_bytes(data)
    n = len(data) - GRAM + 1
    out = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= eight[8:8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    third = eight[16:16 + n] * np.uint64(0xA0761D6478BD642F)
    out ^= third ^ (third >> np.uint64(31))
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[:len(values) - (width - done)], values[width - done:]) if done < width else values


def minimizers(data: bytes, length: int) -> np.ndarray:
    """The minimizer of the string of ``length`` bytes at every start."""
    return sliding(gram_hashes(data), length - GRAM + 1, np.minimum)


def segments(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    for start in range(0, len(data) - length + 1, SEGMENT):
        yield start, data[start:start + SEGMENT + length - 1]


def short_names(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 more bits) of minimizers; a shared name of two only costs work."""
    return (hashes % np.uint64(buckets)).astype(np.int32), (hashes >> np.uint64(32)).astype(np.uint32)


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield (int(bucket[a]), *(c[a:b] for c in columns))


def packed_names(hashes: list[np.ndarray], texts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One row per bucket: the short names of its hashes and the texts that have them."""
    bucket, name = short_names(np.concatenate(hashes), buckets)
    rows = [(b, n.tobytes(), t.tobytes()) for b, n, t in _by_bucket(bucket, name, np.concatenate(texts).astype(np.int64))]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "names", "texts"]
    )


def _announce(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, names, texts): which minimizers which texts have, packed per bucket."""
    names, texts, held = [], [], 0
    for batch in batches:
        for key, data in zip(batch.column("key").to_pylist(), batch.column("bytes")):
            for _, part in segments(data.as_py(), length):
                found = minimizers(part, length)
                found = np.unique(found[np.r_[True, found[1:] != found[:-1]]])
                names.append(found)
                texts.append(np.full(len(found), key, np.int64))
                held += len(found)
            if held >= 1_000_000:
                yield packed_names(names, texts, buckets)
                names, texts, held = [], [], 0
    if held:
        yield packed_names(names, texts, buckets)


def shared_names(table: pa.Table, buckets: int) -> pa.Table:
    """(key, name) of texts for the minimizers of a bucket that two different texts have."""
    bucket = table.column("bucket")[0].as_py()
    name = np.frombuffer(b"".join(table.column("names").to_pylist()), np.uint32)
    text = np.frombuffer(b"".join(table.column("texts").to_pylist()), np.int64)
    order = np.argsort(name, kind="stable")
    name, text = name[order], text[order]
    starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    many = np.minimum.reduceat(text, starts) != np.maximum.reduceat(text, starts)
    keep = np.repeat(many, np.diff(np.r_[starts, len(name)]))
    pairs = np.unique(np.rec.fromarrays([text[keep], name[keep].astype(np.int64)], names="k,n"))
    return pa.table({"key": pa.array(pairs["k"]), "name": pa.array(pairs["n"] * buckets + bucket)})


def _cut_snippets(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, places, packed snippets): runs of starts that share a minimizer other texts have too."""
    pack = zstandard.ZstdCompressor(level=1)
    held: dict[int, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = []
        for bucket, parts in sorted(held.items()):
            places = np.array([(at, key, start, len(s)) for at, key, start, s in parts], np.int64)
            rows.append((bucket, places.tobytes(), pack.compress(b"".join(s for *_, s in parts))))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
            names=["bucket", "places", "snippets"],
        )

    for batch in batches:
        for at, key, data, known in zip(*(batch.column(c) for c in ("at", "key", "bytes", "names"))):
            if not known.is_valid:
                continue
            at, key, data = at.as_py(), key.as_py(), data.as_py()
            known = known.values.to_numpy()
            for offset, part in segments(data, length):
                found = minimizers(part, length)
                runs = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                bucket, name = short_names(found[runs], buckets)
                shared = np.flatnonzero(np.isin(name.astype(np.int64) * buckets + bucket, known))
                ends = np.r_[runs[1:], len(found)]
                for a, b, to in zip(runs[shared].tolist(), ends[shared].tolist(), bucket[shared].tolist()):
                    snippet = part[a:b + length - 1]
                    held.setdefault(to, []).append((at, key, offset + a, snippet))
                    size += len(snippet) + 120
                if size >= 16_000_000:
                    yield flush()
                    held, size = {}, 0
    if held:
        yield flush()


class PrefixHashes:
    """Polynomial hashes of all prefixes of a buffer: equality of substrings in constant time."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        self.eight = eight_bytes(data)
        powers = np.full(len(data) + 1, BASE)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], out=self.sums[1:])

    def common(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of suffix pairs, up to ``most``, by binary search."""
        # Moving the hash of i up by the distance of the two makes equal substrings equal.
        swap = i > j
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        lift, from_i, from_j = self.powers[j - i], self.sums[i], self.sums[j]
        length = np.zeros(len(i), np.int64)
        step = 1 << (most.bit_length() - 1)
        while step:
            tried = np.minimum(length + step, most)
            same = (self.sums[i + tried] - from_i) * lift == self.sums[j + tried] - from_j
            length = np.where(same, tried, length)
            step //= 2
        return length

    def after(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Whether suffix i comes after suffix j, by the byte behind the common extension."""
        shared = self.common(i, j, most)
        at = np.minimum(shared, most - 1)  # equal suffixes have equal last bytes
        return self.bytes[i + at] > self.bytes[j + at]

    def equal(self, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
        """Whether the bytes themselves are equal."""
        same = np.ones(len(i), bool)
        for shift in [*range(0, length - 8, 8), length - 8]:
            same &= self.eight[i + shift] == self.eight[j + shift]
        return same


def sort_suffixes(hashes: PrefixHashes, suffixes: np.ndarray, classes: np.ndarray, length: int) -> np.ndarray | None:
    """For each suffix the number of one that stands for all equal ones (in the first ``length`` bytes) of its class.

    Bottom-up mergesort of all classes at once. A round merges pairs of sorted runs: every element
    finds its place in the other run by binary search, with logarithmic work per comparison. Equal
    elements come together and only the first goes on, so a string that a hot class repeats a
    thousand times is compared about twice each. Hashes that agree where bytes do not: None.
    """
    stands = np.arange(len(suffixes))
    element = np.argsort(classes, kind="stable")
    owner = classes[element]
    run = np.arange(len(element))
    while True:
        # Leave out the classes with a single run.
        new_class = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        ends = np.r_[new_class[1:], len(owner)]
        open_ = run[new_class] != run[ends - 1] if len(owner) else np.zeros(0, bool)
        keep = np.repeat(open_, ends - new_class)
        element, owner, run = element[keep], owner[keep], run[keep]
        if not len(element):
            break
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        sizes = np.diff(np.r_[starts, len(run)])
        first_of_class = np.r_[True, owner[starts][1:] != owner[starts][:-1]]
        number = np.arange(len(starts)) - np.maximum.accumulate(np.where(first_of_class, np.arange(len(starts)), 0))
        left = number % 2 == 0
        has_right = left & np.r_[left[1:] != left[:-1], False] & np.r_[~first_of_class[1:], False]
        partner = np.where(left, np.where(has_right, np.arange(len(starts)) + 1, -1), np.arange(len(starts)) - 1)
        pair_start = np.where(left, starts, starts[np.maximum(np.arange(len(starts)) - 1, 0)])
        of = np.repeat(np.arange(len(starts)), sizes)
        inside = np.arange(len(element)) - starts[of]
        low = np.zeros(len(element), np.int64)
        high = np.where(partner[of] >= 0, sizes[partner[of]], 0)
        base = starts[partner[of]]
        mine = suffixes[element]
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            theirs = suffixes[element[base[todo] + middle]]
            from_left = left[of[todo]]
            i, j = np.where(from_left, mine[todo], theirs), np.where(from_left, theirs, mine[todo])
            later = hashes.after(i, j, length)  # an equal element of the left run comes first
            up = np.where(from_left, later, ~later)
            low[todo] = np.where(up, middle + 1, low[todo])
            high[todo] = np.where(up, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        place = pair_start[of] + inside + low
        merged, merged_owner, merged_run = np.empty_like(element), np.empty_like(owner), np.empty_like(run)
        merged[place], merged_owner[place] = element, owner
        merged_run[place] = pair_start[of]
        near = np.flatnonzero(merged_run[1:] == merged_run[:-1])
        a, b = suffixes[merged[near]], suffixes[merged[near + 1]]
        alike = hashes.common(a, b, length) == length
        if not hashes.equal(a[alike], b[alike], length).all():
            return None  # collision verification failed
        drop = np.zeros(len(merged), bool)
        drop[near[alike] + 1] = True
        head = np.maximum.accumulate(np.where(drop, 0, np.arange(len(merged))))
        stands[merged[drop]] = merged[head[drop]]
        element, owner, run = merged[~drop], merged_owner[~drop], merged_run[~drop]
    while True:
        further = stands[stands]
        if np.array_equal(further, stands):
            return stands
        stands = further


def least_grams(contents: list[bytes], length: int) -> np.ndarray:
    """The minimizer that all strings of a snippet share, per snippet."""
    out = np.zeros(len(contents), np.uint64)
    sizes = np.array([len(c) for c in contents])
    for a, b in slices(len(contents), sizes, PART):
        grams = gram_hashes(b"".join(contents[a:b]))
        begins = np.cumsum(sizes[a:b]) - sizes[a:b]
        groups = grams[begins]
        for shift in range(1, length - GRAM + 1):
            np.minimum(groups, grams[begins + shift], out=groups)
        out[a:b] = groups
    return out


def earliest_holders(contents: list[bytes], first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place per snippet, holders): for each of a snippet's starts the lowest text position that has the string there.

    A snippet's holders begin at its place. ``first`` is the lowest position that has the whole
    snippet. One whose minimizer no other snippet has needs no sort and has place -1. Snippets of one
    minimizer are sorted together, different minimizers in parts.
    """
    groups = least_grams(contents, length)
    _, group, count = np.unique(groups, return_inverse=True, return_counts=True)
    place = np.full(len(contents), -1)
    chosen = np.flatnonzero(count[group] > 1)
    if not len(chosen):
        return place, np.zeros(0, np.int64)
    chosen = chosen[np.argsort(group[chosen], kind="stable")]
    sizes = np.array([len(contents[i]) for i in chosen.tolist()])
    starts = sizes - length + 1
    place[chosen] = np.r_[0, np.cumsum(starts)[:-1]]
    cuts = np.r_[np.flatnonzero(np.r_[True, group[chosen][1:] != group[chosen][:-1]]), len(chosen)]
    holders = np.empty(starts.sum(), np.int64)
    for a, b in slices(len(cuts) - 1, np.add.reduceat(sizes, cuts[:-1]), PART):
        part = chosen[cuts[a]:cuts[b]]
        found = holders_of_part([contents[i] for i in part.tolist()], groups[part], group[part], first[part], length)
        holders[place[part[0]]:place[part[0]] + len(found)] = found
    return place, holders


def holders_of_part(contents: list[bytes], minimizer: np.ndarray, group: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """The holders of all starts of these snippets, one after the other."""
    data = b"".join(contents)
    lengths = np.array([len(c) for c in contents])
    begins = np.cumsum(lengths) - lengths
    starts = lengths - length + 1
    owner = np.repeat(np.arange(len(contents)), starts)
    suffix = np.arange(starts.sum()) + np.repeat(begins - (np.cumsum(starts) - starts), starts)
    # Equal strings have their minimizer at the same distance and the same first bytes: only those are compared.
    grams = gram_hashes(data)
    hits = np.flatnonzero(grams == np.repeat(minimizer, lengths)[:len(grams)])
    distance = hits[np.searchsorted(hits, suffix)] - suffix
    hashes = PrefixHashes(data)
    label = (group[owner] - group.min()).astype(np.int64) * length + distance
    prefix = hashes.eight[suffix]
    order = np.lexsort((prefix, label))
    changed = (label[order][1:] != label[order][:-1]) | (prefix[order][1:] != prefix[order][:-1])
    classes = np.empty(len(order), np.int64)
    classes[order] = np.r_[0, np.cumsum(changed)]
    stands = sort_suffixes(hashes, suffix, classes, length)
    if stands is None:  # 64-bit hashes collided: the same by the strings themselves
        known: dict[bytes, int] = {}
        stands = np.array([known.setdefault(data[s:s + length], i) for i, s in enumerate(suffix.tolist())])
    least = np.full(len(suffix), np.iinfo(np.int64).max)
    np.minimum.at(least, stands, first[owner])
    return least[stands]


def _repeats(table: pa.Table, length: int) -> pa.Table:
    """(at, key, start << 32 | end) of the bytes that strings of earlier documents cover, per snippet."""
    unpack = zstandard.ZstdDecompressor()
    places, content = [], []
    known: dict[bytes, int] = {}
    for packed, snippets in zip(table.column("places"), table.column("snippets")):
        part = np.frombuffer(packed.as_py(), np.int64).reshape(-1, 4)
        data = unpack.decompress(snippets.as_py())
        ends = np.cumsum(part[:, 3]).tolist()
        content.append(np.array([known.setdefault(data[a:b], len(known)) for a, b in zip([0, *ends], ends)], np.int64))
        places.append(part)
    rows, content = np.concatenate(places), np.concatenate(content)
    contents = list(known)
    first = np.full(len(contents), np.iinfo(np.int64).max)
    np.minimum.at(first, content, rows[:, 0])
    place, holders = earliest_holders(contents, first, length)
    whole = rows[(place[content] < 0) & (first[content] < rows[:, 0])]
    sorted_ = place[content] >= 0
    rows, at = rows[sorted_], place[content][sorted_]
    parts = [(whole[:, 0], whole[:, 1], whole[:, 2] << 32 | whole[:, 2] + whole[:, 3])]
    for a, b in slices(len(rows), rows[:, 3] - length + 1, PART):
        parts.append(covered_spans(rows[a:b], at[a:b], holders, length))
    return pa.table({name: np.concatenate(columns) for name, columns in zip(("at", "key", "span"), zip(*parts))})


def covered_spans(part: np.ndarray, at: np.ndarray, holders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, key, span) of the stretches of snippets whose starts have an earlier holder."""
    starts = part[:, 3] - length + 1
    begins = np.cumsum(starts) - starts
    inside = np.arange(starts.sum()) - np.repeat(begins, starts)
    covered = holders[np.repeat(at, starts) + inside] < np.repeat(part[:, 0], starts)
    head, tail = np.zeros(len(covered), bool), np.zeros(len(covered), bool)
    head[begins], tail[begins + starts - 1] = True, True
    opens = np.flatnonzero(covered & (head | ~np.r_[False, covered[:-1]]))
    closes = np.flatnonzero(covered & (tail | ~np.r_[covered[1:], False]))
    row = np.searchsorted(begins, opens, side="right") - 1
    start, end = part[row, 2] + inside[opens], part[row, 2] + inside[closes] + length
    return part[row, 0], part[row, 1], start << 32 | end


def merge_spans(spans: np.ndarray, total: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes from packed spans."""
    if not len(spans):
        return []
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    cuts = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[cuts].tolist(), np.minimum(end[np.r_[cuts[1:] - 1, len(end) - 1]], total).tolist()))


def remove_repeats(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, kept bytes, n_bytes, removed runs) of every row: what no earlier document has said.

    A byte goes if some string of ``length`` bytes that covers it also starts in a document with a
    smaller id. Strings are judged on the input, overlaps count, matches stay inside documents.

    Copies of a text are one text with its smallest id: later copies of at least ``length`` bytes go
    as a whole. Null texts are empty, a null id counts as the smallest, rows with equal ids do not
    remove each other's bytes, shorter texts stay. Texts up to 2 GiB. An empty table stays empty.
    """
    if length < GRAM + 8:
        raise ValueError(f"strings of {GRAM + 8} bytes at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = 3 * shuffle_width(spark)
    rows = docs.select(
        F.col(id_column).alias("id"), id_order(id_column).alias("at"),
        F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("bytes"),
    ).withColumn("key", F.xxhash64("bytes"))
    long_rows = rows.where(F.octet_length("bytes") >= length)
    first = long_rows.groupBy("key", F.sha2("bytes", 256).alias("digest")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    copies = (
        long_rows.select("at", "key", F.sha2("bytes", 256).alias("digest"))
        .join(first.where("last > first"), ["key", "digest"]).where("at > first")
        .select("at", "key", F.lit(None).cast("array<bigint>").alias("spans")).distinct()
    )
    announced = long_rows.select("key", "bytes").mapInArrow(
        lambda batches: _announce(batches, length, buckets), "bucket int, names binary, texts binary"
    )
    shared = announced.groupBy("bucket").applyInArrow(lambda t: shared_names(t, buckets), "key long, name long")
    wanted = (
        shared.groupBy("key").agg(F.collect_list("name").alias("names"))
        .join(first.select("key", F.col("first").alias("at")), "key").select("at", "key", "names")
    )
    base = rows.select("id", "at", "key", "bytes")
    # The same columns as in the join below, so that Spark moves the texts once for both.
    snippets = base.join(wanted, ["at", "key"], "left").select("id", "at", "key", "bytes", "names").mapInArrow(
        lambda batches: _cut_snippets(batches, length, buckets), "bucket int, places binary, snippets binary"
    )
    repeats = snippets.groupBy("bucket").applyInArrow(lambda t: _repeats(t, length), "at long, key long, span long")
    spans = repeats.groupBy("at", "key").agg(F.collect_list("span").alias("spans"))
    marked = copies.withColumn("copy", F.lit(True)).unionByName(spans.withColumn("copy", F.lit(False)))
    found = marked.groupBy("at", "key").agg(F.max("copy").alias("copy"), F.first("spans", ignorenulls=True).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for data, copy, own in zip(*(batch.column(c) for c in ("bytes", "copy", "spans"))):
                data = data.as_py()
                if copy.as_py():
                    runs = [(0, len(data))]
                else:
                    runs = merge_spans(own.values.to_numpy() if own.is_valid else np.zeros(0, np.int64), len(data))
                edges = [0, *(e for run in runs for e in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append([{"start": a, "end": b} for a, b in runs])
            runs = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(kept, pa.binary()), pa.array([len(x) for x in batch.column("bytes").to_pylist()], pa.int64()), runs],
                names=["id", "kept", "n_bytes", "removed"],
            )

    kind = dict(docs.dtypes)[id_column]
    return base.join(found, ["at", "key"], "left").select("id", "bytes", "copy", "spans").mapInArrow(
        cut, f"id {kind}, kept binary, n_bytes long, removed array<struct<start: bigint, end: bigint>>"
    ).withColumnRenamed("id", id_column)
