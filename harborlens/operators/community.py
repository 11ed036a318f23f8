"""Communities of a graph by modularity.

Edges are (src, dst, weight), undirected, each once, with whole weights (scale and round others
first): all gains are then exact whole numbers, and results do not depend on the order of sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.operators.scan import salted_join
from harborlens.session import cut_lineage

# A level of so many links at most (24 bytes each) is settled on the driver, by the same rounds: as Spark jobs they take seconds each.
LOCAL_LINKS = 3 << 20
# The whole numbers of a local round stay below this squared.
LOCAL_TOTAL = 1 << 31


def _wide(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def _both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions, parallel edges added up; a loop counts twice, as its two ends."""
    one = edges.select("src", "dst", F.col("weight").cast("long").alias("w"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _named(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, w): the groups (node, name) of both ends of each link."""
    one = salted_join(links, groups.select(F.col("node").alias("src"), F.col("name").alias("a")), ["src"])
    return salted_join(one, groups.select(F.col("node").alias("dst"), F.col("name").alias("b")), ["dst"]).select("a", "b", "w")


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: communities with an edge, total (summed degrees) and the modularity of ``groups`` (node, community).

    Edges travel to their two ends one way only; weights are summed per pair of communities before
    both ways count. A hub's edges are dealt out by the skew handling of plain joins.
    """
    end = lambda at, name: groups.select(F.col("node").alias(at), F.col("community").alias(name))
    one = edges.select("src", "dst", F.col("weight").cast("long").alias("w"))
    between = one.join(end("src", "a"), "src").select("dst", "a", "w").join(end("dst", "b"), "dst").groupBy("a", "b").agg(F.sum("w").alias("w"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = between.select(F.explode(ways).alias("_way"), "w").select("_way.a", "_way.b", "w")
    per = ends.groupBy("a").agg(
        F.sum("w").cast("double").alias("tot"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("inside")
    )
    whole = per.agg(
        F.count(F.lit(1)).alias("communities"), F.sum("tot").alias("total"), F.sum("inside").cast("double").alias("inside"),
        F.sum(F.col("tot") * F.col("tot")).alias("squares"),
    )
    share = F.col("inside") / F.col("total") - F.col("squares") / (F.col("total") * F.col("total"))
    return whole.select("communities", "total", share.alias("modularity"))


def communities(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-4, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, community) that raise modularity level by level; a community is named by its smallest node.

    On a level nodes move between communities (``_settle``); then each community becomes one node
    with the summed links, and the next level begins. It ends with the level that moves nothing.
    Nodes without edges stay alone. Edges to nodes that are not listed are an error of the caller.
    From the first level of at most ``local_links`` links on, the same rounds run on the driver.
    """
    links = cut_lineage(_both_ways(edges))
    member = cut_lineage(nodes.select("node", F.col("node").alias("community")).distinct())
    while True:
        arrays = _local_links(links, local_links)
        labels = _settle(links, tolerance) if arrays is None else _local_levels(links, arrays, tolerance)
        if labels is None:
            break
        joined = labels.select(F.col("node").alias("community"), F.col("label").alias("joined"))
        member = cut_lineage(
            salted_join(member, joined, ["community"], "left").select("node", F.coalesce("joined", "community").alias("community"))
        )
        if arrays is not None:
            break
        ends = _named(links, labels.select("node", F.col("label").alias("name")))
        links = cut_lineage(ends.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    smallest = member.groupBy("community").agg(F.min("node").alias("first"))
    return salted_join(member, smallest, ["community"]).select("node", F.col("first").alias("community"))


def _settle(links: DataFrame, tolerance: float) -> DataFrame | None:
    """(node, label) after the moves of one level, None if no move gains anything.

    Every node starts alone. Per round a coin per community lets it take nodes in or give nodes away,
    not both, so that no node follows a neighbour that is leaving. Nodes that would gain go to their
    best open community; gains are those of single moves, so the modularity that the next round
    counts decides: if it did not rise, the round is taken back and half as many nodes move, down to
    the one with the largest gain, which always raises it. The level ends when no node would gain
    anywhere, or when all moves of four rounds together raised modularity by ``tolerance`` at most.
    """
    degrees = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w"))).alias("loop"))
    degrees = cut_lineage(degrees)
    total = degrees.agg(F.sum("k")).first()[0]
    if not total:
        return None
    other = links.where("src <> dst").join(degrees.select(F.col("node").alias("src"), "k"), "src")
    ends = cut_lineage(other)
    labels = degrees.select("node", F.col("node").alias("label"), "k", F.coalesce("loop", F.lit(0)).alias("loop"), _takes(F.col("node"), 0).alias("takes"))
    before, share, turn, moved, history = None, 1.0, 0, False, []
    while True:
        judged = cut_lineage(_judge(ends, labels, total))
        inside, squares, gaining, opened = judged.agg(
            F.sum(_wide(F.col("inside"))), F.sum("k_tot"), F.count_if(F.col("best_gain") > 0), F.count_if(F.col("open_gain") > 0)
        ).first()
        now = int(total) * int(inside) - int(squares)  # modularity times total squared
        if before is not None and now <= before[0]:
            now, judged, opened = before  # taken back
            share /= 2
        else:
            share = min(1.0, 2 * share)
            history.append(now)
            moved = moved or before is not None
            slow = len(history) > 4 and (now - history[-5]) <= tolerance * float(total) ** 2
            if not gaining or slow:
                break
            before = (now, judged, opened)
        turn += 1
        labels = _move(judged, share, bool(opened), turn)
    return judged.select("node", "label") if moved else None


def _takes(label: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64(label, F.lit(turn)), F.lit(2)) == 0


def _judge(ends: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Per node its label, the link weight inside it, and the best moves at all and to an open community.

    A move's gain is 2 m (links to the new - links to the old) - k (degrees of the new - those of the
    old without the node), half the rise of modularity times total squared. A hub's links and a
    large community's rows are dealt out by the skew handling of plain joins.
    """
    nothing = F.lit(None).cast("long")
    beside = ends.join(labels.select(F.col("node").alias("dst"), "label", "takes"), "dst").select(
        F.col("src").alias("node"), "label", "takes", "k", "w", F.lit(False).alias("home"), nothing.alias("loop")
    )
    at_home = labels.select("node", "label", "takes", "k", F.lit(0).cast("long").alias("w"), F.lit(True).alias("home"), "loop")
    near = beside.unionByName(at_home).groupBy("node", "label").agg(
        F.sum("w").alias("w"), F.max("k").alias("k"), F.max("takes").alias("takes"), F.max("home").alias("home"), F.max("loop").alias("loop")
    )
    totals = labels.groupBy("label").agg(F.sum("k").alias("tot"))
    home, takes, k, tot = F.col("home"), F.col("takes"), _wide(F.col("k")), _wide(F.col("tot"))
    others = _wide(F.col("tot") - F.when(home, F.col("k")).otherwise(F.lit(0)))
    worth = (_wide(F.lit(total)) * _wide(F.col("w"))).cast("decimal(38,0)") - (k * others).cast("decimal(38,0)")
    option = F.struct(F.col("worth"), (-F.col("label")).alias("label"))
    best = near.join(totals, "label").withColumn("worth", worth).groupBy("node").agg(
        F.max(F.when(home, F.struct("label", "k", "loop", "takes", "worth", "w", (k * tot).cast("decimal(38,0)").alias("k_tot")))).alias("at"),
        F.max(F.when(~home, option)).alias("best"), F.max(F.when(~home & takes, option)).alias("open"),
    )
    gain = lambda c: F.coalesce(F.col(f"{c}.worth") - F.col("at.worth"), F.lit(0)).cast("decimal(38,0)")
    return best.select(
        "node", "at.label", "at.k", "at.loop", (F.col("at.w") + F.col("at.loop")).alias("inside"), "at.k_tot",
        gain("best").alias("best_gain"), (-F.col("best.label")).alias("best_label"),
        F.when(F.col("at.takes"), F.lit(0)).otherwise(gain("open")).alias("open_gain"), (-F.col("open.label")).alias("open_label"),
    )


def _move(judged: DataFrame, share: float, opened: bool, turn: int) -> DataFrame:
    """The labels after the chosen share of the open moves; the one with the largest gain is always among them."""
    way = "open" if opened else "best"
    gains = F.col(f"{way}_gain") > 0
    first = judged.where(gains).agg(F.max_by("node", F.struct(F.col(f"{way}_gain"), -F.col("node")))).first()[0]
    drawn = F.pmod(F.xxhash64("node", F.lit(turn), F.lit("move")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    chosen = gains & ((F.col("node") == F.lit(first)) | (drawn if opened else F.lit(False)))
    moved = judged.select("node", F.when(chosen, F.col(f"{way}_label")).otherwise(F.col("label")).alias("label"), "k", "loop")
    return moved.withColumn("takes", _takes(F.col("label"), turn))


# The same rounds on the driver, for levels of few links


def _local_links(links: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The links as arrays, None if they are too many, or too heavy or not of a kind for exact 64-bit numbers."""
    kinds = dict(links.dtypes)
    if kinds["src"] not in ("bigint", "int") or kinds["dst"] != kinds["src"]:
        return None
    count, total, least, open_ends = links.agg(
        F.count(F.lit(1)), F.sum(_wide(F.col("w"))), F.min("w"), F.count_if(F.col("src").isNull() | F.col("dst").isNull())
    ).first()
    if not 0 < count <= most or open_ends or total is None or least < 0 or total >= LOCAL_TOTAL:
        return None
    rows = links.toArrow()  # bounded by ``most``
    return tuple(rows[c].to_numpy() for c in ("src", "dst", "w"))


def _local_levels(links: DataFrame, arrays: tuple[np.ndarray, np.ndarray, np.ndarray], tolerance: float) -> DataFrame | None:
    """(node, label) after this level and all that follow, None if no move gains anything."""
    src, dst, w = arrays
    names = np.unique(np.concatenate([src, dst]))
    src, dst = np.searchsorted(names, src), np.searchsorted(names, dst)
    group, moved = np.arange(len(names)), False
    while True:
        used = np.unique(src)  # as places in ``names``
        label = _local_settle(np.searchsorted(used, src), np.searchsorted(used, dst), w, names[used], tolerance)
        if label is None:
            break
        joined = np.arange(len(names))
        joined[used] = used[label]
        group, moved = joined[group], True
        pairs, at = np.unique(joined[src] * len(names) + joined[dst], return_inverse=True)
        src, dst = pairs // len(names), pairs % len(names)
        w = _sums(at, w, len(pairs))
    if not moved:
        return None
    kind = dict(links.dtypes)["src"]
    found = pa.table({"node": names, "label": names[group]})
    return links.sparkSession.createDataFrame(found).select(F.col("node").cast(kind), F.col("label").cast(kind))


def _sums(at: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Whole sums of the values by place."""
    return np.bincount(at, values, count).astype(np.int64)  # doubles, exact below LOCAL_TOTAL


def _local_settle(src: np.ndarray, dst: np.ndarray, w: np.ndarray, names: np.ndarray, tolerance: float) -> np.ndarray | None:
    """``_settle`` over nodes 0, 1, ... in the order of their names: the label of each, None if no move gains anything."""
    n = len(names)
    k, own = _sums(src, w, n), src == dst
    loop = _sums(src[own], w[own], n)
    total = int(k.sum())
    if not total:
        return None
    order = np.argsort(src[~own], kind="stable")
    src, dst, w = (x[~own][order] for x in (src, dst, w))
    label = np.arange(n)
    before, share, turn, moved, history = None, 1.0, 0, False, []
    while True:
        tot = _sums(label, k, n)
        takes = _hashed(names, turn) & np.uint64(1) == 0  # by community
        judged = _local_judge(src, dst, w, k, tot, label, takes, total)
        inside, best_gain, _, open_gain, _ = judged
        now = total * int((inside + loop).sum()) - int((k * tot[label]).sum())
        state = (now, label, judged)
        if before is not None and now <= before[0]:
            state = before  # taken back
            share /= 2
        else:
            share = min(1.0, 2 * share)
            history.append(now)
            moved = moved or before is not None
            slow = len(history) > 4 and (now - history[-5]) <= tolerance * float(total) ** 2
            if not (best_gain > 0).any() or slow:
                break
            before = state
        turn += 1
        now, label, judged = state
        label = _local_move(names, label, judged, share, turn)
    return state[1] if moved else None


def _local_judge(src, dst, w, k, tot, label, takes, total: int) -> tuple[np.ndarray, ...]:
    """``_judge``: links inside, best gain and label, best open gain and label of each node."""
    n = len(label)
    keys = np.concatenate([src * n + label[dst], np.arange(n) * n + label])  # the home with no weight, as a node may have no link there
    keys, at = np.unique(keys, return_inverse=True)
    near = _sums(at[: len(src)], w, len(keys))
    node, to = keys // n, keys % n
    home = to == label[node]
    worth = total * near - k[node] * (tot[to] - np.where(home, k[node], 0))
    starts = np.searchsorted(node, np.arange(n))
    stay = worth[home]

    def most(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.where(allowed, worth, np.iinfo(np.int64).min)
        top = np.maximum.reduceat(held, starts)
        first = np.minimum.reduceat(np.where(held == top[node], np.arange(len(keys)), len(keys)), starts)
        real = allowed[first]
        return np.where(real, top, stay) - stay, to[first]

    best_gain, best_label = most(~home)
    open_gain, open_label = most(~home & takes[to])
    return near[home], best_gain, best_label, np.where(takes[label], 0, open_gain), open_label


def _local_move(names: np.ndarray, label: np.ndarray, judged: tuple[np.ndarray, ...], share: float, turn: int) -> np.ndarray:
    """``_move``"""
    _, best_gain, best_label, open_gain, open_label = judged
    opened = bool((open_gain > 0).any())
    gain, to = (open_gain, open_label) if opened else (best_gain, best_label)
    chosen = np.zeros(len(label), bool)
    if opened:
        chosen = (_hashed(names, turn, "move") & np.uint64((1 << 20) - 1)) < np.uint64(int(share * (1 << 20)))
    chosen[np.argmax(gain)] = True  # the first of the largest, which has the smallest name
    return np.where(chosen & (gain > 0), to, label)


PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _hashed(names: np.ndarray, turn: int, word: str = "") -> np.ndarray:
    """What ``F.xxhash64(names, turn, word)`` gives, unsigned; the word has four letters or none."""
    out = _hash_step(np.full(len(names), 42, np.uint64), names, names.dtype.itemsize)
    out = _hash_step(out, np.array([turn]), 4)
    return _hash_step(out, np.frombuffer(word.encode(), "<u4"), 4) if word else out


def _hash_step(seed: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Spark's XXH64 of one number of four or eight bytes."""
    one, two, three, four, five = PRIMES
    turned = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    with np.errstate(over="ignore"):
        values, out = values.astype(np.int64).astype(np.uint64), seed + five + np.uint64(width)
        if width == 8:
            out = turned(out ^ (turned(values * two, 31) * one), 27) * one + four
        else:
            out = turned(out ^ ((values & np.uint64(0xFFFFFFFF)) * one), 23) * two + three
        out = (out ^ (out >> np.uint64(33))) * two
        out = (out ^ (out >> np.uint64(29))) * three
        return out ^ (out >> np.uint64(32))
