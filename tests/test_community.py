"""Communities against a plain sequential implementation, and their edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlens.operators import community, vocab


def plain_modularity(edges, group):
    total = 2 * sum(w for _, _, w in edges)
    tot, inside = defaultdict(int), 0
    for a, b, w in edges:
        tot[group[a]] += w
        tot[group[b]] += w
        inside += 2 * w * (group[a] == group[b])
    return inside / total - sum(t * t for t in tot.values()) / total**2


def plain_communities(n, edges):
    """One node after the other moves to its best community until none gains; communities become nodes; again."""
    group, links = {i: i for i in range(n)}, edges
    while True:
        near, k = defaultdict(lambda: defaultdict(int)), defaultdict(int)
        for a, b, w in links:
            near[a][b] += w
            near[b][a] += w
            k[a] += w
            k[b] += w
        label, total = {i: i for i in k}, sum(k.values())
        tot, moved, again = dict(k), False, True
        while again:
            again = False
            for i in sorted(k):
                around = defaultdict(int)
                for j, w in near[i].items():
                    if j != i:
                        around[label[j]] += w
                tot[label[i]] -= k[i]
                worth = {c: total * around[c] - k[i] * tot[c] for c in {*around, label[i]}}
                best = max(worth, key=lambda c: (worth[c], -c))
                if worth[best] > worth[label[i]]:
                    label[i], moved, again = best, True, True
                tot[label[i]] += k[i]
        if not moved:
            return group
        group = {i: label.get(g, g) for i, g in group.items()}
        merged = defaultdict(int)
        for a, b, w in links:
            merged[tuple(sorted((label[a], label[b])))] += w
        links = [(a, b, w) for (a, b), w in merged.items()]


def planted(groups, size, inside, outside, seed):
    draw, n = random.Random(seed), groups * size
    return n, [(i, j, 1) for i in range(n) for j in range(i + 1, n) if draw.random() < (inside if i // size == j // size else outside)]


def ring_of_cliques(cliques, size):
    edges = [(c * size + i, c * size + j, 1) for c in range(cliques) for i in range(size) for j in range(i + 1, size)]
    return cliques * size, edges + [(c * size, (c + 1) % cliques * size + 1, 1) for c in range(cliques)]


def weighted(seed):
    n, edges = planted(3, 8, 0.7, 0.2, seed)
    draw = random.Random(seed)
    return n, [(a, b, draw.randint(1, 9)) for a, b, _ in edges] + [(0, 0, 5), (0, 1, 2), (1, 0, 3)]


GRAPHS = {
    "planted": planted(4, 12, 0.5, 0.04, 1),
    "ring": ring_of_cliques(6, 5),
    "loose": planted(3, 12, 0.4, 0.15, 2),
    "weighted": weighted(3),
    "grid": (36, [(6 * y + x, 6 * y + x + 1, 1) for y in range(6) for x in range(5)] + [(6 * y + x, 6 * y + x + 6, 1) for y in range(5) for x in range(6)]),
}


def found(spark, n, edges):
    nodes = spark.range(n).withColumnRenamed("id", "node")
    frame = spark.createDataFrame(edges, "src long, dst long, weight long")
    return {r.node: r.community for r in community.communities(nodes, frame).collect()}, frame


@pytest.mark.parametrize("name", GRAPHS)
def test_modularity_is_close_to_sequential_moves(spark, name):
    n, edges = GRAPHS[name]
    group, frame = found(spark, n, edges)
    assert group.keys() == set(range(n))
    assert all(c == min(i for i in group if group[i] == c) for c in group.values())
    groups = spark.createDataFrame(list(group.items()), "node long, community long")
    mine = community.modularity(frame, groups).first()
    assert mine.modularity == pytest.approx(plain_modularity(edges, group), abs=1e-9)
    assert mine.modularity >= 0.98 * plain_modularity(edges, plain_communities(n, edges))


def test_runs_agree_and_hubs_join(spark):
    edges = [(0, i, 1) for i in range(1, 200)]
    group, _ = found(spark, 202, edges)
    assert {group[i] for i in range(200)} == {0} and group[200] == 200 and group[201] == 201
    n, edges = ring_of_cliques(3, 4)
    assert found(spark, n, edges)[0] == found(spark, n, edges[::-1])[0]


def test_no_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    none = spark.createDataFrame([], "src long, dst long, weight long")
    assert {r.node: r.community for r in community.communities(nodes, none).collect()} == {1: 1, 2: 2}
    assert community.communities(nodes.limit(0), none).collect() == []


def test_copies_are_one_node(spark):
    draw = random.Random(4)
    vectors = [[draw.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    rows = [(f"w{i:03d}", i, i, vectors[i % 3]) for i in range(60)] + [("zero", 7, 60, [0.0] * 4), ("nil", 8, 61, [0.0] * 4)]
    tokens = spark.createDataFrame(rows, "token string, frequency long, number long, vector array<double>")
    grouped = {r.token: r.representative for r in vocab.compress_communities(tokens, 0.9).collect()}
    assert grouped["zero"] == "zero" and grouped["nil"] == "nil"
    assert {grouped[f"w{i:03d}"] for i in range(60)} == {"w057", "w058", "w059"}


@pytest.mark.parametrize("kind, name", [("long", "loose"), ("int", "weighted")])
def test_rounds_on_the_driver_are_the_same(spark, kind, name):
    """Few links are settled without a Spark job per round; names, coins and labels are those of the jobs."""
    draw = np.array([-(1 << 31), -7, 0, 5, (1 << 31) - 1])
    frame = spark.createDataFrame([(int(x),) for x in draw], f"node {kind}")
    for turn in (0, 3):
        seen = frame.select(F.xxhash64("node", F.lit(turn), F.lit("move")).alias("a"), F.xxhash64("node", F.lit(turn)).alias("b"), "node").collect()
        mine = [community._hashed(draw.astype(np.int64 if kind == "long" else np.int32), turn, w).astype(np.int64).tolist() for w in ("move", "")]
        assert sorted((r.node, r.a, r.b) for r in seen) == sorted(zip(draw.tolist(), *mine))
    n, edges = GRAPHS[name]
    nodes = spark.createDataFrame([(7 * i - 9,) for i in range(n)], f"node {kind}")
    links = spark.createDataFrame([(7 * a - 9, 7 * b - 9, w) for a, b, w in edges], f"src {kind}, dst {kind}, weight long")
    far, near = (sorted(map(tuple, community.communities(nodes, links, local_links=most).collect())) for most in (0, 1000))
    assert near == far and len(near) == n


def test_few_links_need_no_job_per_round(spark):
    n, edges = GRAPHS["planted"]
    context, before = spark.sparkContext, found(spark, n, edges)[0]
    context.setJobGroup("rounds", "rounds")
    try:
        assert found(spark, n, edges)[0] == before
        assert len(context.statusTracker().getJobIdsForGroup("rounds")) < 40
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_modularity_sends_each_edge_twice_at_most(spark):
    """Two joins and sums per pair of communities: no exchange of both ways of all edges."""
    n, edges = GRAPHS["weighted"]
    frame = spark.createDataFrame(edges + [(1, 1, 4)], "src long, dst long, weight long")
    groups = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(n)], "node long, community long")
    found = community.modularity(frame, groups)
    row, group = found.first(), {i: i % 3 if i % 5 else f"none {i}" for i in range(n)}
    degrees = defaultdict(int)
    for a, b, w in edges + [(1, 1, 4)]:
        degrees[i if (i := group[a]) in (0, 1, 2) else None] += w
        degrees[i if (i := group[b]) in (0, 1, 2) else None] += w
    inside = sum(2 * w for a, b, w in edges + [(1, 1, 4)] if group[a] == group[b] and group[a] in (0, 1, 2))
    total = sum(degrees.values())
    assert (row.communities, row.total) == (len(degrees), total)
    assert row.modularity == pytest.approx(inside / total - sum(d * d for d in degrees.values()) / total**2, abs=1e-12)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
