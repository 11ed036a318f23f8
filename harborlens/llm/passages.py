"""Near-duplicate passages by compact windows of min-hashes.

Two near-duplicate passages have a run of consecutive shingles in common whose length follows from
the similarity (``shared_run``). Hashes of somewhat shorter runs are taken at every shingle. All
stretches whose least hash is the same one form a compact window (l, c, r): whatever starts in l..c and
ends in c..r has its minimum at c. Two texts that share a long run have windows with the same minimum
whose intervals meet over it, so that one hash function finds every such pair. The windows are the
nodes of the Cartesian tree over the hashes; about two per least length are needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.llm import suffix
from harborlens.llm.common import bounded_batches, id_order, shuffle_width, slices
from harborlens.llm.decontam import run_hash, tokens
from harborlens.operators.graph import connected_components
from harborlens.session import cut_lineage, scratch_path

WIDTH = 5
#: Hash functions to choose from. Any one finds all shared runs; the join uses the first.
FUNCTIONS = 4
#: Where a member of a group of at most so many windows is not like the first one, it is compared with all.
ALL_PAIRS = 16
#: How far around a window's centre, in least lengths, a passage that can not be cut into shorter ones may reach.
REACH = 3
CHUNK_BYTES = 1 << 19
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the five words from every word, 0 at the last four of a text; first word of each text and the end)."""
    names, owner, _ = tokens(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = np.zeros(len(names), np.uint64)
    whole = run_hash(names, WIDTH)
    out[:len(whole)] = np.maximum(whole, 1)
    for k in range(1, WIDTH):
        last = bounds[1:] - k
        out[last[last >= bounds[:-1]]] = 0
    return out, bounds


def signature(values: np.ndarray, function: int) -> np.ndarray:
    """Hashes of shingles under one of the functions; 0 stays 0 and is below all."""
    out = values * _MULTIPLIERS[function]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    out = (out & ~np.uint64(FUNCTIONS * 2 - 1)) | np.uint64(function)  # which function, in the last bits
    return np.where(values == 0, np.uint64(0), np.maximum(out, np.uint64(FUNCTIONS * 2)))


def centres_of(values: np.ndarray, function: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, places that are the least of some ``least`` places in a row)."""
    hashed = signature(values, function)
    if len(hashed) < least:
        return hashed, np.zeros(0, np.int64)
    low = suffix.sliding(hashed, least, np.minimum)
    edge = np.zeros(least - 1, np.uint64)
    return hashed, np.flatnonzero((suffix.sliding(np.r_[edge, low, edge], least, np.maximum) == hashed) & (values != 0))


def compact_windows(
    values: np.ndarray, bounds: np.ndarray, function: int, least: int, width: int = WIDTH,
) -> tuple[np.ndarray, np.ndarray]:
    """(rows of [text, l, c, r] in places of the text, signature of each) of all windows of ``least`` places or more.

    A value stands for ``width`` words from its place on, so that the last places of a text have none.

    A node of the Cartesian tree spans that much exactly if it is the least of some run of that
    length, and so do its ancestors, which bound it: the tree is built from these few alone.
    """
    hashed, centres = centres_of(values, function, least)
    if not len(centres):
        return np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
    owner = np.searchsorted(bounds, centres, side="right") - 1
    place, value = centres.tolist(), hashed[centres].tolist()
    windows, chosen = [], []
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        text = int(owner[a])
        start, end = int(bounds[text]), int(bounds[text + 1]) - width + 1
        right = [end] * (b - a)
        left, stack = [], []
        for i in range(a, b):
            while stack and value[stack[-1]] > value[i]:
                right[stack.pop() - a] = place[i]
            left.append(place[stack[-1]] + 1 if stack else start)
            stack.append(i)
        for i in range(a, b):
            if right[i - a] - left[i - a] >= least:
                windows.append((text, left[i - a] - start, place[i] - start, right[i - a] - 1 - start))
                chosen.append(i)
    return np.array(windows, np.int64).reshape(-1, 4), hashed[centres[chosen]]


@cache
def shared_run(least: int, similarity: float) -> int:
    """So many consecutive shingles any two near-duplicate passages of ``least`` shingles or more have in common.

    Where passages of m and n shingles have b places at which the common ones do not go on alike, each
    such place takes ``WIDTH`` - 1 shingles at least from either (all that span it), wherever no
    ``WIDTH`` - 1 words repeat inside the passage. So Jaccard s needs 4 b (1 + s) <= (1 - s) m for five
    words, and s (m + 4 b) common shingles or more are in b + 1 runs: the longest has their share.
    """
    lost, out = WIDTH - 1, least
    for places in range(64):
        if places and similarity >= 1:
            break
        size = max(least, ceil(lost * places * (1 + similarity) / (1 - similarity) - 1e-9)) if places else least
        out = min(out, ceil(similarity * (size + lost * places) / (places + 1) - 1e-9))
    return max(1, out)


def seeds(least: int, similarity: float) -> tuple[int, int]:
    """(shingles per hashed run, places per window): any shared run holds a whole window of such runs."""
    run = (2 * shared_run(least, similarity) + 1) // 3
    return run, shared_run(least, similarity) - run + 1


def hashed_runs(values: np.ndarray, bounds: np.ndarray, run: int) -> np.ndarray:
    """The hash of ``run`` shingles from every one, 0 where they would pass the end of a text."""
    out = np.zeros(len(values), np.uint64)
    whole = run_hash(values, run)
    out[:len(whole)] = np.maximum(whole, 1)
    for k in range(1, run + WIDTH - 1):
        last = bounds[1:] - k
        out[last[last >= bounds[:-1]]] = 0
    return out


def joined_signatures(
    values: np.ndarray, bounds: np.ndarray, function: int, least: int, similarity: float = 0.8,
) -> tuple[np.ndarray, np.ndarray]:
    """Compact windows over hashed runs of shingles, and their minima as keys; l, c and r are first shingles of runs.

    Where a text repeats the same few words many times, the minimum stands at equal distances. Of
    such a stretch the first and the last window stay (``inside_stretch``).
    """
    run, span = seeds(least, similarity)
    windows, keys = compact_windows(hashed_runs(values, bounds, run), bounds, function, span, run + WIDTH - 1)
    if not len(windows):
        return windows, keys
    outer = ~inside_stretch(values, bounds[windows[:, 0]] + windows[:, 2], windows, keys, least)
    return windows[outer], keys[outer]


def inside_stretch(values: np.ndarray, centre: np.ndarray, windows: np.ndarray, keys: np.ndarray, least: int) -> np.ndarray:
    """Which windows stand between two of the same key, as far before as behind, with the same shingles in both gaps.

    They can go without losing a passage. Let the first and the last window of such a stretch have
    centres f and e. A passage around a centre between them reaches f or e or has a whole period (no
    longer than ``least``), and beyond e it has all from its centre to e. So with all from f on it
    has no other shingles than before, lies in the window of f, and is as similar as it was.
    """
    out = np.zeros(len(keys), bool)
    if len(keys) < 3:
        return out
    gap = np.diff(centre)
    tied = (keys[1:] == keys[:-1]) & (windows[1:, 0] == windows[:-1, 0]) & (windows[1:, 1] == windows[:-1, 2] + 1) & (gap <= least)
    middle = np.flatnonzero(tied[1:] & tied[:-1] & (gap[1:] == gap[:-1])) + 1
    periods = gap[middle]
    for period in np.unique(periods).tolist():
        rows = middle[periods == period]
        differs = np.cumsum(np.r_[0, values[period:] != values[:-period]])
        out[rows] = differs[centre[rows]] == differs[centre[rows - 1]]
    return out


def _announce(batches: Iterator[pa.RecordBatch], least: int, similarity: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, names, texts): which signatures which texts have, packed per bucket."""
    run, span = seeds(least, similarity)
    names, owners, held = [], [], 0
    for batch in batches:
        keys, texts = batch.column("key").to_numpy(), batch.column("text").to_pylist()
        for a, b in slices(len(texts), np.array([len(t) for t in texts]), CHUNK_BYTES):
            values, bounds = shingles(texts[a:b])
            hashed, centres = centres_of(hashed_runs(values, bounds, run), 0, span)
            if len(centres):
                names.append(hashed[centres])
                owners.append(keys[a:b][np.searchsorted(bounds, centres, side="right") - 1])
                held += len(centres)
        if held >= 1_000_000:
            yield suffix.packed_names(names, owners, buckets)
            names, owners, held = [], [], 0
    if held:
        yield suffix.packed_names(names, owners, buckets)


WINDOW = "sig long, at long, key long, l int, c int, r int, grams binary"


def _windows(batches: Iterator[pa.RecordBatch], least: int, similarity: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows whose signature another text has too, and a row with the shingles of each text that has such."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in WINDOW.split(", ")]
    for batch in batches:
        wanted = [i for i, ok in enumerate(batch.column("names").is_valid().to_pylist()) if ok]
        texts = [batch.column("text")[i].as_py() for i in wanted]
        ids = np.array([batch.column("at")[i].as_py() for i in wanted], np.int64)
        keys = np.array([batch.column("key")[i].as_py() for i in wanted], np.int64)
        known = [np.sort(batch.column("names")[i].values.to_numpy()) for i in wanted]
        for a, b in slices(len(texts), np.array([len(t) for t in texts]), CHUNK_BYTES):
            values, bounds = shingles(texts[a:b])
            table, found = joined_signatures(values, bounds, 0, least, similarity)
            if not len(table):
                continue
            bucket, name = suffix.short_names(found, buckets)
            name = name.astype(np.int64) * buckets + bucket
            cuts = np.flatnonzero(np.r_[True, table[1:, 0] != table[:-1, 0], True])
            shared = np.concatenate([np.isin(name[x:y], known[a + table[x, 0]]) for x, y in zip(cuts, cuts[1:])])
            table = table[shared]
            who = a + table[:, 0]
            columns = [found[shared].view(np.int64), ids[who], keys[who], *table[:, 1:].T.astype(np.int32), [None] * len(table)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            rows = np.unique(who).tolist()
            grams = [values[bounds[i - a]:bounds[i - a + 1]].tobytes() for i in rows]
            columns = [[None] * len(rows), ids[rows], keys[rows], *[[None] * len(rows)] * 3, grams]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a compressed table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _link(windows: DataFrame, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """(a, b, matches): verified links between texts, enough to join what belongs together.

    In a group of windows with one key every member is compared with the first. Nearly always that
    settles the group, and no group is expanded into pairs. Members that are not like it stay
    open and are compared with all others: in a small group as they are, in a large one where they
    have enough in common besides (``_apart``). Two members that the first one settles are in its
    class; any other pair has an open member, so no class is parted.
    """
    run, span = seeds(least, similarity)
    active = windows.select("sig", F.struct("at", "key", "l", "c", "r").alias("y"))
    groups = active.groupBy("sig").agg(
        F.min("y").alias("x"), F.min("y.at").alias("low"), F.max("y.at").alias("high"), F.count(F.lit(1)).alias("n")
    ).where("high > low").select("sig", "x", "n")
    star = active.join(groups, "sig").where(F.col("y.at") != F.col("x.at"))
    found = _written(star.select("sig", "n", "y", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")), "window-pairs")
    if found.isEmpty():
        return windows.sparkSession.createDataFrame([], MATCH)
    # A shared run lies in the intervals of both windows around the centre.
    before = F.least(F.col("p.c") - F.col("p.l"), F.col("q.c") - F.col("q.l"))
    meet = before + F.least(F.col("p.r") - F.col("p.c"), F.col("q.r") - F.col("q.c")) + 1 >= span
    links, attempted = _look(found.where(meet), None, None, texts, least, similarity)
    # A member is settled where a link to its first one covers the window's centre.
    over = _written(_uncovered(found, links, run).select("sig", "n", "y"), "left-over")
    small = over.where(F.col("n") <= ALL_PAIRS).select("sig", "y")
    if not small.isEmpty():
        others = active.join(small.select("sig").distinct(), "sig", "left_semi").select("sig", F.col("y").alias("z"))
        every = small.join(others, "sig").where(F.col("y.at") != F.col("z.at"))
        every = every.select(F.least("y", "z").alias("p"), F.greatest("y", "z").alias("q")).where(meet)
        links, attempted = _look(every, links, attempted, texts, least, similarity)
    open_ = over.where(F.col("n") > ALL_PAIRS).select("sig", "y").distinct()
    if not open_.isEmpty():
        links = _apart(active, open_, links, attempted, texts, least, similarity)
    return links.groupBy("a", "b").agg(F.flatten(F.collect_list("matches")).alias("matches"))


def _uncovered(found: DataFrame, links: DataFrame, run: int) -> DataFrame:
    """Rows of (y, p, q) for which no link between p and q covers the shingles at the centre of y."""
    linked = links.select("a", "b", F.explode("matches").alias("m"))
    # A match's end counts words; its last shingle starts some words before.
    start, end = F.col("y.c"), F.col("y.c") + run
    inside = lambda side: (start >= F.col(f"m.start_{side}")) & (end <= F.col(f"m.end_{side}") - (WIDTH - 1))
    return found.join(linked, (F.col("p.at") == F.col("a")) & (F.col("q.at") == F.col("b")) & F.when(
        F.col("y.at") == F.col("b"), inside("b")
    ).otherwise(inside("a")), "left_anti")


def _apart(
    active: DataFrame, open_: DataFrame, links: DataFrame, attempted: DataFrame, texts: DataFrame, least: int, similarity: float,
) -> DataFrame:
    """All links, after the open members of large groups have been compared with all that can be like them.

    Near-duplicate passages around a centre have ``similarity`` times ``least`` different shingles
    in common, all within ``REACH`` least lengths of it (a longer pair has a shorter one in it). Count
    the shingles that stand so near to the members' centres. If a pair shares one that occurs there
    ``ALL_PAIRS`` times or less, the two meet at that shingle. Else all they share are frequent ones:
    texts with enough of those meet by their groups, once each pair (``_by_group``).
    """
    need = ceil(similarity * least - 1e-9)
    members = active.join(open_.select("sig").distinct(), "sig", "left_semi").join(open_.withColumn("open", F.lit(True)), ["sig", "y"], "left")
    members = _written(members.withColumn("open", F.coalesce("open", F.lit(False))), "members")
    of_text = members.groupBy(F.col("y.at").alias("at"), F.col("y.key").alias("key")).agg(F.collect_set(F.struct("y.c", "open")).alias("members"))
    made = of_text.join(texts, ["at", "key"]).select("at", "key", "members", "grams")
    around = _written(made.mapInArrow(lambda batches: _around(batches, REACH * least), AROUND), "around")
    around = around.repartition("shingle")  # dealt once, for the counts and for what they are joined to
    counts = around.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.max("open").alias("some")
    ).where("high > low and some")
    counted = _written(around.join(counts.select("shingle", "n"), "shingle"), "counted")
    rare = counted.where(F.col("n") <= ALL_PAIRS).select("shingle", F.struct("at", "key", "c").alias("y"), "open")
    every = rare.where("open").select("shingle", "y").join(rare.select("shingle", F.col("y").alias("z")), "shingle")
    every = every.where(F.col("y.at") != F.col("z.at")).select(F.least("y", "z").alias("p"), F.greatest("y", "z").alias("q"))
    links, attempted = _look(every, links, attempted, texts, least, similarity)
    marks = counted.where(F.col("n") > ALL_PAIRS).select("at", "key", "shingle").distinct()
    heavy = marks.groupBy("at", "key").agg(F.count(F.lit(1)).alias("marks")).where(F.col("marks") >= need)
    rest = members.join(heavy, (F.col("y.at") == F.col("at")) & (F.col("y.key") == F.col("key")), "left_semi")
    return _by_group(rest, links, attempted, texts, least, similarity)


def _by_group(members: DataFrame, links: DataFrame, attempted: DataFrame, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """All links, after every open member has been compared with all others of its group.

    Two texts mostly have many groups in common. They meet in the first of them alone, and the places
    where they are to be compared come from their lists of members, without those looked at before.
    """
    place = F.struct("sig", F.col("y.l").alias("l"), F.col("y.c").alias("c"), F.col("y.r").alias("r"), "open")
    lists = _written(members.groupBy(F.col("y.at").alias("at"), F.col("y.key").alias("key")).agg(
        F.collect_list(place).alias("members"), F.collect_set("sig").alias("groups"), F.collect_set(F.when(F.col("open"), F.col("sig"))).alias("open"),
    ), "member-lists")
    if lists.isEmpty():
        return links
    x = lists.select(F.struct("at", "key").alias("y"), F.col("groups").alias("mine"), F.col("open").alias("ours"), F.explode("open").alias("sig"))
    z = lists.select(F.struct("at", "key").alias("z"), F.col("groups").alias("theirs"), F.col("open").alias("others"), F.explode("groups").alias("sig"))
    # An open text leads; where both are open in a common group, the smaller one does.
    met = x.join(z, "sig").where(
        (F.col("y.at") != F.col("z.at")) & (F.col("sig") == F.array_min(F.array_intersect("theirs", "ours")))
        & ((F.col("y.at") < F.col("z.at")) | ~F.arrays_overlap("mine", "others"))
    )
    pairs = met.select(F.least("y", "z").alias("p"), F.greatest("y", "z").alias("q")).select(
        F.col("p.at").alias("a"), F.col("p.key").alias("key_a"), F.col("q.at").alias("b"), F.col("q.key").alias("key_b")
    )
    pairs = _written(pairs, "text-pairs")
    done = attempted.join(pairs.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.collect_set(F.struct("ca", "cb")).alias("done"))
    pairs = pairs.join(done, ["a", "b"], "left")
    run, span = seeds(least, similarity)
    texts = texts.join(lists.select("at", "key", "members"), ["at", "key"])
    theirs = lists.select(F.col("at").alias("b"), F.col("key").alias("key_b"), F.col("members").alias("members_b"))
    with_a = pairs.join(theirs, ["b", "key_b"]).join(texts, (F.col("a") == F.col("at")) & (F.col("key_a") == F.col("key")))
    cut = with_a.select("a", "b", "key_b", "grams", "members", "members_b", "done").mapInArrow(
        lambda batches: _meetings(batches, span, REACH * least), f"{SLICE}, centres array<struct<ca: int, cb: int>>"
    )
    return links.unionByName(_verify_slices(cut, texts.drop("members"), least, similarity))


AROUND = "shingle long, at long, key long, c int, open boolean"


def _around(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """The shingles of texts within ``reach`` of a member's centre, and whether an open member is that near."""
    for batch in batches:
        for at, key, members, grams in zip(*(batch.column(c) for c in ("at", "key", "members", "grams"))):
            values = np.frombuffer(grams.as_py(), np.uint64)
            near = np.zeros((2, len(values) + 1), np.int64)
            for m in members.as_py():
                for row in (0, 1) if m["open"] else (0,):
                    near[row, max(0, m["c"] - reach)] += 1
                    near[row, min(len(values), m["c"] + reach)] -= 1
            some, open_ = np.cumsum(near, axis=1)[:, :-1] > 0
            chosen = np.flatnonzero(some & (values != 0))
            columns = [
                pa.array(values[chosen].view(np.int64)), pa.array(np.full(len(chosen), at.as_py(), np.int64)),
                pa.array(np.full(len(chosen), key.as_py(), np.int64)), pa.array(chosen.astype(np.int32)), pa.array(open_[chosen]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in AROUND.split(", ")])


def _look(found: DataFrame, links, attempted, texts: DataFrame, least: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Verify what has not been looked at yet of (p, q); all links and all places looked at so far."""
    places = found.select(
        F.col("p.at").alias("a"), F.col("p.key").alias("key_a"), F.col("p.c").alias("ca"),
        F.col("q.at").alias("b"), F.col("q.key").alias("key_b"), F.col("q.c").alias("cb"),
    )
    if attempted is not None:
        places = _written(places.join(attempted, ["a", "ca", "b", "cb"], "left_anti"), "places")
    pairs = places.groupBy("a", "key_a", "b", "key_b").agg(F.collect_set(F.struct("ca", "cb")).alias("centres"))
    fresh = _verify_pairs(_written(pairs, "text-pairs"), texts, least, similarity)
    looked = places.select("a", "ca", "b", "cb")
    return (
        fresh if links is None else links.unionByName(fresh),
        looked if attempted is None else attempted.unionByName(looked),
    )


#: Texts of pairs are looked up by a broadcast of their ids up to so many (some megabytes), else by a shuffle.
BROADCAST_PAIRS = 20_000
SLICE = "a long, b long, key_b long, first int, slice binary"


def _verify_pairs(pairs: DataFrame, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """(a, b, matches) of the pairs whose texts hold near-duplicate passages around their centres."""
    if pairs.count() <= BROADCAST_PAIRS:
        ids = pairs.select(F.col("a").alias("at"), F.col("key_a").alias("key")).unionByName(pairs.select(F.col("b").alias("at"), F.col("key_b").alias("key")))
        texts = texts.join(F.broadcast(ids.distinct()), ["at", "key"], "left_semi")
    with_a = pairs.join(texts, (pairs["a"] == texts["at"]) & (pairs["key_a"] == texts["key"])).select("a", "b", "key_b", "grams", "centres")
    kind = dict(with_a.dtypes)["centres"]
    cut = with_a.mapInArrow(lambda batches: _slices(batches, REACH * least), f"{SLICE}, centres {kind}")
    return _verify_slices(cut, texts, least, similarity)


def _verify_slices(cut: DataFrame, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    with_b = cut.join(texts, (cut["b"] == texts["at"]) & (cut["key_b"] == texts["key"])).select("a", "b", "first", "slice", "grams", "centres")
    return _written(with_b.mapInArrow(lambda batches: _verified(batches, least, similarity), MATCH), "links")


def _columns(centres) -> np.ndarray:
    return np.stack([r.to_numpy(zero_copy_only=False).astype(np.int64) for r in centres.values.flatten()], axis=1)


def _slices(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Of the first text of each pair, the shingles that stand within ``reach`` of its centres."""
    for batch in batches:
        first, cut = [], []
        for grams, centres in zip(*(batch.column(c) for c in ("grams", "centres"))):
            place = _columns(centres)[:, 0]
            low = max(0, int(place.min()) - reach)
            first.append(low)
            cut.append(np.frombuffer(grams.as_py(), np.uint64)[low:int(place.max()) + reach].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("key_b"), pa.array(first, pa.int32()), pa.array(cut, pa.binary()), batch.column("centres")],
            names=["a", "b", "key_b", "first", "slice", "centres"],
        )


def _meetings(batches: Iterator[pa.RecordBatch], span: int, reach: int) -> Iterator[pa.RecordBatch]:
    """The places where two texts are in one group, one of them open, that have not been looked at; as ``_slices``."""
    for batch in batches:
        (i, mine), (j, theirs), (k, done) = (_rows_of(batch.column(c)) for c in ("members", "members_b", "done"))
        sig, places = np.unique(np.r_[mine[0], theirs[0]], return_inverse=True)
        p, q = i * len(sig) + places[:len(i)], j * len(sig) + places[len(i):]
        order = np.argsort(q, kind="stable")
        low, high = (np.searchsorted(q[order], p, side) for side in ("left", "right"))
        each = high - low
        x = np.repeat(np.arange(len(p)), each)
        y = order[np.arange(len(x)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)]
        (_, la, ca, ra, open_a), (_, lb, cb, rb, open_b) = ([c[at] for c in part] for part, at in ((mine, x), (theirs, y)))
        meet = np.minimum(ca - la, cb - lb) + np.minimum(ra - ca, rb - cb) + 1 >= span
        codes = _place_codes(i[x], ca, cb)[meet & ((open_a | open_b) == 1)]
        codes = np.setdiff1d(codes, _place_codes(k, *done)) if len(k) else np.unique(codes)
        if not len(codes):
            continue
        row, ca, cb = codes >> 54, codes >> 27 & _PLACES, codes & _PLACES
        cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
        rows = row[cuts[:-1]]
        first = np.maximum(0, ca[cuts[:-1]] - reach)
        texts = batch.column("grams")
        cut = [texts[r].as_py()[8 * u:8 * v] for r, u, v in zip(rows.tolist(), first.tolist(), (ca[cuts[1:] - 1] + reach).tolist())]
        flat = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in (ca, cb)], ["ca", "cb"])
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(rows)) for c in ("a", "b", "key_b")), pa.array(first, pa.int32()), pa.array(cut, pa.binary()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat),
            ],
            names=["a", "b", "key_b", "first", "slice", "centres"],
        )


_PLACES = (1 << 27) - 1


def _place_codes(row: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """One number for the row of a batch and the places in two texts (of fewer than 2^27 words)."""
    return row << 54 | ca << 27 | cb


def _rows_of(lists) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of every struct in a column of lists, and the fields of all."""
    sizes = np.diff(lists.offsets.to_numpy())
    if lists.null_count:
        sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return np.repeat(np.arange(len(sizes)), sizes), [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in lists.flatten().flatten()]


def best_run(hits: np.ndarray, centre: int, loss: float, least: int, once: np.ndarray | float = 1.0) -> tuple[int, int, float]:
    """The longest run of at least ``least`` around ``centre`` that maximises hits minus ``loss`` times misses, and that sum.

    A miss counts as ``once`` has it (``best_around``).
    """
    sums = np.empty(len(hits) + 1)
    sums[0] = 0.0
    np.add.accumulate(np.where(hits, 1.0, -loss * once), out=sums[1:])
    least_end = max(centre + 1, least)
    if least_end > len(hits):
        return 0, 0, -np.inf
    low = np.minimum.accumulate(sums[:centre + 1])
    # The least sum up to the last start that an end leaves: at the centre from some end on.
    gain = sums[least_end:].copy()
    growing = low[least_end - least:centre + 1][:len(gain)]
    gain[:len(growing)] -= growing
    gain[len(growing):] -= low[-1]
    at = len(gain) - 1 - int(gain[::-1].argmax())
    upto = min(least_end + at - least, centre)
    return int(low[:upto + 1].argmin()), least_end + at, float(gain[at])


def reachable(hits: np.ndarray, loss: float, least: int) -> np.ndarray:
    """Places inside some run of at least ``least`` whose hits are no fewer than ``loss`` times its misses."""
    sums = np.concatenate(([0.0], np.cumsum(np.where(hits, 1.0, -loss))))
    best = np.maximum.accumulate(sums[::-1])  # from the end: the largest sum not before a place
    last = len(sums) - 1 - np.searchsorted(best, sums - 1e-6)
    starts = np.flatnonzero(last - np.arange(len(sums)) >= least)
    edge = np.zeros(len(sums), np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, last[starts], -1)
    return np.cumsum(edge)[:-1] > 0


def best_around(hits: np.ndarray, once: np.ndarray, loss: float, least: int) -> np.ndarray:
    """For every place the most that a run of at least ``least`` around it has in hits less ``loss`` times misses.

    ``once`` has for each place one part of a shingle that stands so many times, so that a run has no
    more misses by this count than different shingles. Runs whose Jaccard reaches s have, added up,
    0 or more with a loss of 2s / (1 - s), so a pair of places below that has none.
    """
    sums = np.concatenate(([0.0], np.where(hits, 1.0, -loss * once)))
    np.add.accumulate(sums, out=sums)
    out = np.full(len(hits), -np.inf)
    if len(hits) < least:
        return out
    low, high = np.minimum.accumulate(sums), np.maximum.accumulate(sums[::-1])[::-1]
    # Either the run goes on for ``least`` places from here, or its end says where it may start.
    out[:len(sums) - least] = high[least:] - low[:len(sums) - least]
    short = np.concatenate((np.full(least - 1, -np.inf), sums[least:] - low[:-least], np.full(least, -np.inf)))
    return np.maximum(out, suffix.sliding(short, least, np.maximum)[:len(hits)])


def stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every true place the first and the last place of the run of true ones that it is in."""
    at = np.arange(len(mask))
    low = np.maximum.accumulate(np.where(mask, 0, at + 1))
    return low, np.minimum.accumulate(np.where(mask, len(mask), at)[::-1])[::-1] - 1


def hopeful(one: np.ndarray, other: np.ndarray, boxes: np.ndarray, least: int, similarity: float) -> bool:
    """Whether any box can hold near-duplicate passages, by the last bits of the shingles.

    Shingles with equal bits count as one, which makes hits more, misses fewer: no passage is ruled out.
    """
    size = 1 << (16 * max(len(one), len(other))).bit_length()
    sums = 0.0
    bits = [(part & np.uint64(size - 1)).astype(np.int64) for part in (one, other)]
    counts = [np.bincount(part, minlength=size) for part in bits]
    for part, mine, theirs, places in ((bits[0], counts[0], counts[1], boxes[:, 1]), (bits[1], counts[1], counts[0], boxes[:, 4])):
        sums = sums + best_around(theirs[part] > 0, 1.0 / mine[part], 2 * similarity / max(1 - similarity, 1e-9), least)[places]
    return bool((sums >= -1e-6).any())


def verify(one: np.ndarray, other: np.ndarray, boxes: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start, end, Jaccard) of near-duplicate passages, in shingles of both texts.

    ``boxes`` has rows (la, ca, ra, lb, cb, rb): intervals around a shared minimum, largest first.
    Inside a box the passage is the best pair of runs of at least ``least`` shingles around the
    centre: each run is the best one of that length or more for what the other has, in turn until
    neither moves. Where no shingle repeats, Jaccard s is reached exactly if a pair of runs has
    hits minus 2s / (1 - s) times misses of 0 or more over both, so that loss misses no passage;
    the lower one before it reports longer runs.
    """
    found: list[tuple[int, int, int, int, float]] = []
    if not hopeful(one, other, boxes, least, similarity):
        return found
    kinds, codes = np.unique(np.r_[one, other], return_inverse=True)
    one, other = codes[:len(one)], codes[len(one):]
    single = similarity / max(1 - similarity, 1e-9)  # a run alone must reach the similarity in hits per shingle

    def table(part: np.ndarray) -> np.ndarray:
        out = np.zeros(len(kinds), bool)
        out[part] = True
        return out

    in_other, in_one = table(other)[one], table(one)[other]
    once = [1.0 / np.bincount(part, minlength=len(kinds))[part] for part in (one, other)]
    ahead, behind = best_around(in_other, once[0], 2 * single, least), best_around(in_one, once[1], 2 * single, least)
    near, far = reachable(in_other, single, least), reachable(in_one, single, least)
    boxes = boxes[near[boxes[:, 1]] & far[boxes[:, 4]]]
    for column, part in ((0, near), (3, far)):  # no passage leaves the stretch of such places
        low, high = stretches(part)
        boxes[:, column] = np.maximum(boxes[:, column], low[boxes[:, column + 1]])
        boxes[:, column + 2] = np.minimum(boxes[:, column + 2], high[boxes[:, column + 1]])
    boxes = boxes[np.lexsort((boxes[:, 1], boxes[:, 1] - boxes[:, 4]))]
    # Whatever passages one centre has go on to the next one, if all is equal from the one to the other.
    follows = np.zeros(len(boxes), bool)
    follows[1:] = (boxes[1:, 1] - boxes[:-1, 1] == boxes[1:, 4] - boxes[:-1, 4]) & (boxes[1:, [0, 2, 3, 5]] == boxes[:-1, [0, 2, 3, 5]]).all(axis=1)
    rows = np.flatnonzero(follows)
    steps = boxes[rows, 1] - boxes[rows - 1, 1]
    rows, steps = rows[steps > 0], steps[steps > 0]
    if len(rows):
        ends = np.cumsum(steps)
        along = np.arange(ends[-1]) - np.repeat(ends - steps, steps)
        same = one[np.repeat(boxes[rows - 1, 1], steps) + along] == other[np.repeat(boxes[rows - 1, 4], steps) + along]
        follows[rows] = np.logical_and.reduceat(same, ends - steps)
    boxes = boxes[~follows]
    boxes = boxes[ahead[boxes[:, 1]] + behind[boxes[:, 4]] >= -1e-6]
    size = boxes[:, 2] - boxes[:, 0] + boxes[:, 5] - boxes[:, 3]
    for la, ca, ra, lb, cb, rb in boxes[np.lexsort((*boxes.T[::-1], -size))].tolist():
        if any(a <= ca < b and c <= cb < d for a, b, c, d, _ in found):
            continue
        if best_run(in_other[la:ra + 1], ca - la, single, least)[2] < -1e-6 or best_run(in_one[lb:rb + 1], cb - lb, single, least)[2] < -1e-6:
            continue
        x, y = one[la:ra + 1], other[lb:rb + 1]
        in_y = table(y)[x]
        most = best_run(in_y, ca - la, 2 * single, least, once[0][la:ra + 1])[2] + best_run(table(x)[y], cb - lb, 2 * single, least, once[1][lb:rb + 1])[2]
        if most < -1e-6:
            continue
        for loss in (single, 2 * single, 19):
            a, b, c, d = _settled(x, y, in_y, ca - la, cb - lb, loss, least, table)
            p, q = table(x[a:b]), table(y[c:d])
            jaccard = float((p & q).sum() / (p | q).sum())
            if jaccard >= similarity:
                found.append((la + a, la + b, lb + c, lb + d, jaccard))
                break
    return found


def _settled(x, y, in_y, cx: int, cy: int, loss: float, least: int, table) -> tuple[int, int, int, int]:
    """Runs of x and y around their centres, each the best for the other."""
    a, b, _ = best_run(in_y, cx, loss, least)
    seen: set[tuple[int, int, int, int]] = set()
    while True:
        before = a, b
        c, d, _ = best_run(table(x[a:b])[y], cy, loss, least)
        a, b, _ = best_run(table(y[c:d])[x], cx, loss, least)
        if (a, b) == before or (a, b, c, d) in seen:
            return a, b, c, d
        seen.add((a, b, c, d))


MATCH = "a long, b long, matches array<struct<start_a: int, end_a: int, start_b: int, end_b: int, similarity: double>>"


def _verified(batches: Iterator[pa.RecordBatch], least: int, similarity: float) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start_a", "end_a", "start_b", "end_b")] + [("similarity", pa.float64())]))
    for batch in batches:
        a, b, out = [], [], []
        ends = batch.column("centres").offsets.to_numpy()
        places = np.stack(_rows_of(batch.column("centres"))[1], axis=1)
        for i, (x, y, low, mine, theirs) in enumerate(zip(*(batch.column(c) for c in ("a", "b", "first", "slice", "grams")))):
            y, low = y.as_py(), low.as_py()
            place = places[ends[i] - ends[0]:ends[i + 1] - ends[0]]
            begin = max(0, int(place[:, 1].min()) - REACH * least)
            one = np.frombuffer(mine.as_py(), np.uint64)
            other = np.frombuffer(theirs.as_py(), np.uint64)[begin:int(place[:, 1].max()) + REACH * least]
            table = np.zeros((len(place), 6), np.int64)
            table[:, 1], table[:, 4] = place[:, 0] - low, place[:, 1] - begin
            # The last places of a text are no shingles.
            table[:, 2], table[:, 5] = np.flatnonzero(one)[-1], np.flatnonzero(other)[-1]
            found = verify(one, other, table, least, similarity)
            if found:
                a.append(x.as_py())
                b.append(y)
                # A run of shingles covers the words of its last one too.
                out.append([
                    {"start_a": low + p, "end_a": low + q + WIDTH - 1, "start_b": begin + r, "end_b": begin + s + WIDTH - 1, "similarity": j}
                    for p, q, r, s, j in found
                ])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, kind)], names=["a", "b", "matches"])


def near_duplicate_passages(
    docs: DataFrame, least_words: int = 50, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, copy_of, class_id, n_links, partners, repeated_words, passages) of every row.

    Passages of at least ``least_words`` words are near duplicates if the Jaccard similarity of
    their five-word shingles (words as in ``tokens``: lower case, without punctuation) reaches
    ``similarity``. Equal texts are one text with its smallest id (``copy_of``). Verified links join
    texts into classes (``class_id`` is the smallest id that links and copies reach); ``partners``
    are the earlier texts that a text has links to, ``passages`` where (words of both and the
    similarity), ``repeated_words`` how many of its words they cover, ``n_links`` its links in either
    direction (a group is linked through its first member where that settles it, not by all its pairs). Near
    duplicates are found whatever the hash function (``shared_run``), in groups of any size.

    Signatures that only one text has are settled in packed buckets before windows or texts move.
    Null, empty and shorter texts have no passages; a null id counts as the smallest; rows with
    equal ids and texts are equal; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    least = least_words - WIDTH + 1
    buckets = 3 * shuffle_width(spark)
    rows = docs.select(
        F.col(id_column).alias("id"), id_order(id_column).alias("at"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    ).withColumn("key", F.xxhash64("text"))
    digests = cut_lineage(rows.select("id", "at", "key", F.sha2("text", 256).alias("digest")))
    first = cut_lineage(digests.groupBy("key", "digest").agg(F.min("at").alias("at")))
    announced = rows.where(F.length("text") >= least_words).mapInArrow(
        lambda batches: _announce(batches, least, similarity, buckets), "bucket int, names binary, texts binary"
    )
    shared = announced.groupBy("bucket").applyInArrow(lambda t: suffix.shared_names(t, buckets), "key long, name long")
    wanted = shared.groupBy("key").agg(F.collect_list("name").alias("names")).join(first.select("key", "at"), "key").select("at", "key", "names")
    base = rows.select("at", "key", "text")
    windows = _written(base.join(wanted, ["at", "key"], "left").select("at", "key", "text", "names").mapInArrow(
        lambda batches: _windows(batches, least, similarity, buckets), WINDOW
    ), "windows")
    texts = windows.where("grams is not null").select("at", "key", "grams")
    links = _link(windows.where("grams is null").drop("grams"), texts, least, similarity)
    classes = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.explode(F.array("a", "b")).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n_links"))
    span = lambda m: F.sequence(m["start_b"], m["end_b"] - 1)
    mine = links.groupBy(F.col("b").alias("at")).agg(
        F.sort_array(F.collect_list("a")).alias("partners"),
        F.sort_array(F.collect_list(F.struct("a", "matches"))).alias("passages"),
    ).withColumn("repeated_words", F.size(F.array_distinct(F.flatten(F.transform(F.flatten("passages.matches"), span)))))
    of_text = (
        first.join(classes.select(F.col("node").alias("at"), "component"), "at", "left").join(degree, "at", "left").join(mine, "at", "left")
        .select("key", "digest", F.col("at").alias("rep"), F.coalesce("component", "at").alias("class_at"), "n_links", "partners", "repeated_words", "passages")
    )
    shown = lambda c: F.when(c != F.lit(-(2**63)), c)
    kind = dict(docs.dtypes)[id_column]
    joined = digests.join(of_text, ["key", "digest"])
    return joined.select(
        F.col("id").alias(id_column), shown(F.col("rep")).cast(kind).alias("copy_of"), shown(F.col("class_at")).cast(kind).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("partners", F.array().cast("array<bigint>")).alias("partners"),
        F.coalesce("repeated_words", F.lit(0)).cast("long").alias("repeated_words"),
        F.coalesce("passages", F.array().cast("array<struct<a: bigint, matches: array<struct<start_a: int, end_a: int, start_b: int, end_b: int, similarity: double>>>>")).alias("passages"),
    )
