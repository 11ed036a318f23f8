"""Metric rules, dirty data, topology, graphs, texts and patches on hand frames."""

import datetime as dt
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlens.functions import text as fn
from harborlens.operators import corpus, dirty, entity, evaluate, graph, metrics, nearest, params, spatial, vocab
from harborlens.operators.metrics import agg_step, filter_step, get_step
from harborlens.sources import datasets
from harborlens.streaming import patches


def test_metric_nulls(spark):
    up = np.nextafter(1.0, 2.0)
    state = spark.createDataFrame([(0, None), (0, 1.0), (0, float(up)), (0, math.nan), (0, 3.0)], "step INT, v DOUBLE")
    count = lambda comparison, value: [filter_step("v", comparison, value), agg_step("count")]
    outputs = {
        "eq": count("eq", 1.0), "neq": count("neq", 1.0), "lt": count("lt", 2), "null": count("eq", None), "some": count("neq", None),
        "rows": [agg_step("count")], "values": [get_step("v"), agg_step("count")],
        "low": [get_step("v"), agg_step("min")], "high": [get_step("v"), agg_step("max")],
        "none_sum": [filter_step("v", "gt", 99), filter_step("v", "lt", 100), get_step("v"), agg_step("sum")],
        "none_mean": [filter_step("v", "eq", 99), get_step("v"), agg_step("mean")],
    }
    row = metrics.metrics(state, outputs, ["step"]).first()
    assert (row.eq, row["null"], row.some, row.rows, row["values"]) == (2, 1, 4, 5, 4)
    assert row.neq == 3  # null, NaN and 3.0
    assert (row.low, row.high, row.none_sum, row.none_mean) == (1.0, 3.0, 0.0, None)


def test_metric_definition_errors_are_collected():
    with pytest.raises(ValueError) as error:
        metrics.check_metric("m", [agg_step("sum"), filter_step("a", "like", 1), {"op": "spin"}])
    assert str(error.value).count(";") >= 3
    with pytest.raises(ValueError):
        metrics.check_metric("m", [filter_step("a", "lt", None), agg_step("count")])


def test_dirty_is_stable_under_partitioning(spark):
    base = spark.range(2000).selectExpr("id", "CONCAT('00', id) AS k", "'20240131' AS d", "'x' AS n")
    config = {"keys": ["k"], "dates": ["d"], "orphans": ["k"], "duplicate_rate": 0.01, "nulls": ["n"]}
    make = lambda parts: sorted(map(str, dirty.apply_dirty(base.repartition(parts), config, dirty.row_draw("id", seed=1), F.col("id")).collect()))
    one = make(1)
    assert one == make(8)
    assert len(one) > 2000


def test_param_grid(spark):
    grid = params.param_grid(spark, {"a": params.linspace(2, 4, 3), "b": ["x", "y"]})
    assert [(r.run, r.a, r.b) for r in grid.orderBy("run").collect()] == [
        (0, 2.0, "x"), (1, 2.0, "y"), (2, 3.0, "x"), (3, 3.0, "y"), (4, 4.0, "x"), (5, 4.0, "y")
    ]
    assert params.arange(0, 1, 0.25) == [0, 0.25, 0.5, 0.75, 1.0]


def test_sampled_moments(spark):
    ids = spark.range(20000)
    checks = {"normal": (2.0, 0.5, dict(mean=2.0, std=0.5)), "poisson": (3.0, 3**0.5, dict(rate=3.0)), "gamma": (3.0, 18**0.5 / 2, dict(shape=2.0, scale=1.5)),
              "beta": (2 / 7, (10 / (49 * 8)) ** 0.5, dict(alpha=2.0, beta=5.0)), "log-normal": (math.exp(0.125), None, dict(mu=0.0, sigma=0.5))}
    for name, (mean, std, p) in checks.items():
        row = params.sample_parameter(ids, "id", "v", name, seed=1, **p).agg(F.avg("v").alias("m"), F.stddev("v").alias("s")).first()
        assert abs(row.m - mean) < 0.05 * max(1, mean), name
        assert std is None or abs(row.s - std) < 0.1 * std, name


# Space


def place(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, position ARRAY<DOUBLE>, direction ARRAY<DOUBLE>")


def test_radius_join_with_a_crowd(spark):
    rng = random.Random(1)
    rows = [(i, [0.5, 0.5, 0.5] if i < 60 else [rng.random() for _ in range(3)], None) for i in range(180)] + [(999, None, None)]
    points = place(spark, rows)
    near = lambda a, b: math.dist(a, b) <= 0.2
    expected = {(i, j) for i, p, _ in rows for j, q, _ in rows if i != j and p and q and near(p, q)}
    got = [(r.id, r.neighbor) for r in spatial.radius_join(points, 0.2).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    counts = {r.id: r.neighbors for r in spatial.radius_counts(points, 0.2).collect()}
    assert counts == {i: sum(a == i for a, _ in expected) for i, p, _ in rows if p}
    assert spatial.radius_join(points, None).count() == 0


def test_salted_candidates_equal_plain(spark):
    rows = [(i, [0.1 * (i % 3), 0.0, 0.0], None) for i in range(90)]
    points = place(spark, rows).withColumn("reach", F.lit(0.1)).withColumn("at", F.col("position"))
    wide = spatial.candidate_pairs(points, points, 0.1, hot_rows=10).count()
    assert wide == spatial.candidate_pairs(points, points, 0.1).count()


def test_topology(spark):
    bounds = ((0.0, 10.0),) * 3
    topology = spatial.Topology(bounds, ("continuous", "reflection", "offset_reflection"))
    rows = [
        (1, [10.0, 5.0, 5.0], [1.0, 1.0, 1.0]), (2, [-1.0, 5.0, 5.0], [1.0, 1.0, 1.0]), (3, [5.0, 10.0, 5.0], [1.0, 1.0, 1.0]),
        (4, [5.0, 2.0, 12.0], [1.0, 1.0, 1.0]), (5, [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]),
    ]
    got = {r.id: (r.position, r.direction, r.corrected) for r in spatial.correct_out_of_bounds(place(spark, rows), topology).collect()}
    assert got[1] == ([0.0, 5.0, 5.0], [1.0, 1.0, 1.0], True)
    assert got[2] == ([9.0, 5.0, 5.0], [1.0, 1.0, 1.0], True)
    assert got[3] == ([5.0, 9.0, 5.0], [1.0, -1.0, 1.0], True)
    assert got[4] == ([5.0, 7.0, 7.0], [1.0, 1.0, -1.0], True)
    assert got[5][2] is False
    torus = spatial.Topology.preset("torus", bounds)
    edge = place(spark, [(1, [0.5, 5.0, 5.0], None), (2, [9.8, 5.0, 5.0], None)])
    assert spatial.radius_join(edge, 1.0).count() == 0
    assert [(r.id, r.neighbor) for r in spatial.wrapped_radius_join(edge, 1.0, torus).orderBy("id").collect()] == [(1, 2), (2, 1)]


def test_front_and_behind(spark):
    points = place(spark, [(1, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0], [1.0, 0.0, 0.0]),
                           (3, [-1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0], [1.0, 0.0, 0.0])])
    pairs = spatial.with_vectors(spatial.radius_join(points, 5.0), points).where("id = 1")
    names = lambda df: sorted(r.neighbor for r in df.collect())
    assert names(spatial.neighbors_in_front(pairs)) == [2]
    assert names(spatial.neighbors_behind(pairs)) == [3]
    assert names(spatial.neighbors_in_front(pairs, colinear=True)) == [2]
    assert names(spatial.neighbors_behind(pairs, colinear=True)) == [3]


def vectors(spark, with_copies):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    if with_copies:
        rows += [(200 + i, rows[0][1]) for i in range(60)] + [(300, [0.0] * 8)]
    return rows, spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>")


def cosine_table(rows):
    m = np.array([v for _, v in rows])
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
    return np.round(m @ m.T, 9)


@pytest.mark.parametrize("block_rows", [16, 1000])
def test_cosine_topk_is_exact(spark, block_rows):
    rows, df = vectors(spark, True)
    ids, table = [i for i, _ in rows], cosine_table(rows)
    got = {}
    for r in nearest.cosine_topk(df, "id", "v", 4, block_rows).collect():
        got.setdefault(r.id, {})[r.rank] = (r.neighbor, r.similarity)
    for a, i in enumerate(ids):
        best = sorted((-table[a, b], j) for b, j in enumerate(ids) if j != i)[:4]
        assert [got[i][n + 1] for n in range(4)] == [(j, pytest.approx(-s, abs=1e-8)) for s, j in best]


def test_radius_graph_and_links(spark):
    rows, df = vectors(spark, True)
    table = cosine_table(rows)
    plain = {(i, j) for a, (i, _) in enumerate(rows) for b, (j, _) in enumerate(rows) if i < j and table[a, b] >= 0.5}
    edges = [(r.id, r.neighbor) for r in nearest.cosine_radius_graph(df, "id", "v", 0.5, 16).collect()]
    assert len(edges) == len(set(edges)) and set(edges) == plain
    links = {(r.id, r.neighbor) for r in nearest.cosine_radius_links(df, "id", "v", 0.5, 16).collect()}
    assert {e for e in links if e[1] < 200} == {e for e in plain if e[1] < 200}
    assert {e for e in links if 200 <= e[1] < 300} == {(0, 200 + i) for i in range(60)}


# Graphs


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src BIGINT, dst BIGINT")


def test_components_with_a_hub(spark):
    rng = random.Random(4)
    pairs = [(1000, i) for i in range(100)] + [(i, i + 1) for i in range(200, 260)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(25)] + [(500, 500)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    expected = {n: min(m for m in parent if find(m) == find(n)) for n in parent}
    assert {r.node: r.component for r in graph.connected_components(edges_of(spark, pairs)).collect()} == expected


def test_reachable(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node BIGINT")
    edges = edges_of(spark, [(0, 1), (1, 2), (2, 0), (3, 2), (4, 5)])
    root = spark.createDataFrame([(0,)], "node BIGINT")
    assert {r.node: r.distance for r in graph.reachable(nodes, edges, root).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r.node for r in graph.reachable(nodes, edges, root, directed=False).collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        graph.reachable(nodes, edges, spark.createDataFrame([(9,)], "node BIGINT"))


def test_dag_levels(spark):
    steps = spark.createDataFrame([(1, i, i != 3) for i in range(4)] + [(2, i, True) for i in range(3)] + [(3, i, True) for i in range(2)], "plan_id BIGINT, step BIGINT, concurrent BOOLEAN")
    edges = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 3, 2), (2, 1, 0), (2, 2, 1), (2, 1, 2), (3, 0, 1), (3, 1, 0)], "plan_id BIGINT, step BIGINT, depends_on BIGINT")
    levels = graph.dag_levels(steps, edges)
    got = {(r.plan_id, r.step): (r.depth, r.cyclic) for r in levels.collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 0): (0, False), (1, 1): (1, False), (1, 2): (1, False), (1, 3): (2, False)}
    assert all(v == (None, True) for k, v in got.items() if k[0] in (2, 3))
    assert [(r.plan_id, r.length, r.path) for r in graph.critical_path(levels).collect()] == [(1, 3, [0, 2, 3])]


def test_temporal_slice(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = [(1, d(1), d(5), d(1), None), (2, d(5), None, d(1), d(3)), (3, d(1), None, d(9), None)]
    df = spark.createDataFrame(rows, "id INT, ts DATE, te DATE, ds DATE, de DATE")
    cut = lambda at, start, end: sorted(r.id for r in entity.temporal_slice(df, ("ts", "te"), F.lit(at), ("ds", "de"), None if start is None else F.lit(start), F.lit(end)).collect())
    assert cut(d(5), None, d(31)) == [2, 3]
    assert cut(d(4), None, d(8)) == [1]
    assert cut(d(5), d(3), d(8)) == []


def test_property_rules(spark):
    rows = [("a", '{"n": 5, "s": "abc", "l": [1, "x", 3], "o": {"k": 1}, "z": null}'), ("b", '{"n": "5"}'), ("c", "broken")]
    df = spark.createDataFrame(rows, "entity_id STRING, properties STRING")
    hit = lambda clause: [r.entity_id for r in df.where(clause).orderBy("entity_id").collect()]
    P, match = entity.Path, entity.property_match
    assert hit(match(P("n"), "equals", 5)) == ["a"]
    assert hit(match(P("n"), "not_equals", 5)) == ["b"]
    assert hit(match(P("n"), "greater", 100)) == ["b"]  # text ranks above numbers
    assert hit(match(P("z"), "equals", None)) == ["a"]
    assert hit(match(P("l"), "contains", "x")) == ["a"]
    assert hit(match(P("l"), "starts_with", [1, "x"])) == ["a"]
    assert hit(match(P("l"), "ends_with", [3])) == ["a"]
    assert hit(match(P("o"), "contains", "k")) == ["a"]
    assert hit(match(P("l", 1), "equals", "x")) == ["a"]
    assert hit(match("xabcx", "contains", P("s"))) == ["a"]
    updated = entity.update_properties(df, F.lit(True), [(["o", "k"], 2), (["o", "q"], 3), (["s"], [1])])
    assert json.loads(updated.where("entity_id = 'a'").first().properties)["o"] == {"k": 2}


# Texts


@pytest.mark.parametrize("url, slug", [
    ("https://x.org/a/how-to-bake-good-bread.html", "how-to-bake-good-bread"),
    ("https://x.org/good_old_bread/index.php", "good-old-bread"),
    ("https://x.org/News-From-Spain-31/?q=1#f", "news-from-spain-31"),
    ("https://x.org/news-from-spain-2024", None),
    ("https://x.org/one-two", None),
    ("https://x.org/the-of-and-bread", None),
    ("https://x.org/a-b-c-word", None),
    ("https://x.org/", None),
    ("not a url", None),
])
def test_extract_slug(spark, url, slug):
    assert spark.createDataFrame([(url,)], "u STRING").select(fn.extract_slug(F.col("u"))).first()[0] == slug


def test_scores(spark):
    rows = [(1, "river-quiet-harbor", "river-harbor-night-ferry", "s", 60), (2, "", "a-b", "s", 60), (3, "a-b-a", "a-a-b", "s", 700)]
    df = spark.createDataFrame(rows, "id BIGINT, prediction STRING, reference STRING, source STRING, token_count INT")
    got = {r.id: r for r in evaluate.score(df).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1) == (2 / 3, 2 / 4, pytest.approx(4 / 7))
    assert (got[2].f1, got[2].rouge_l, got[2].valid) == (0.0, 0.0, False)
    assert got[3].rouge1 == 1.0 and got[3].rouge_l == pytest.approx(2 * 2 / 6)
    assert got[3].length_bucket == "long"


def test_longest_common_subsequence(spark):
    rng = random.Random(6)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 8))], [rng.choice("abc") for _ in range(rng.randint(0, 8))]) for _ in range(80)]

    def plain(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    df = spark.createDataFrame(rows, "a ARRAY<STRING>, b ARRAY<STRING>")
    got = [r[0] for r in df.select(evaluate.lcs_length(F.col("a"), F.col("b"))).collect()]
    assert got == [plain(a, b) for a, b in rows]


def test_repetition_against_plain_loops(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(n)) for n in (0, 1, 5, 40, 200)] + ["line\nline\n\npara\n\npara"]
    df = spark.createDataFrame(list(enumerate(texts)), "id BIGINT, text STRING")
    for row in corpus.repetition_measures(df).collect():
        words = re.findall(r"\w+", row.text)
        total = max(1, len(row.text))
        for n in range(2, 11):
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            if n <= 4:
                best = max(((c, sum(map(len, g))) for g, c in Counter(grams).items()), default=(0, 0))
                assert row.repetition[f"top_{n}"] == (best[0] * best[1] / total if best[0] > 1 else 0)
            else:
                seen, covered = set(), set()
                for i, g in enumerate(grams):
                    covered |= set(range(i, i + n)) if g in seen else set()
                    seen.add(g)
                assert row.repetition[f"dup_{n}"] == sum(len(words[i]) for i in covered) / total


def test_slug_frequency_filter_hot_slug(spark):
    rows = [(i, "hot" if i < 300 else f"s{i % 70}") for i in range(900)]
    df = spark.createDataFrame(rows, "id BIGINT, slug STRING")
    counts = Counter(s for _, s in rows)
    got = {r.id for r in corpus.slug_frequency_filter(df, 10).collect()}
    assert got == {i for i, s in rows if counts[s] < 10}


def test_clusters_stay_in_one_split(spark):
    df = spark.range(3000).select("id", (F.col("id") % 37).alias("cluster"))
    splits = corpus.assign_splits(df, F.xxhash64("cluster"))
    assert splits.groupBy("cluster").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    shares = {r["split"]: r["count"] / 3000 for r in splits.groupBy("split").count().collect()}
    assert 0.78 < shares["train"] < 0.85


def test_communities_and_representatives(spark):
    rows = [("aa", 5, 0, [1.0, 0.0]), ("ab", 9, 1, [1.0, 0.05]), ("b", 1, 2, [0.0, 1.0])]
    tokens = spark.createDataFrame(rows, "token STRING, frequency BIGINT, number BIGINT, vector ARRAY<DOUBLE>")
    for build in (vocab.compress_graph, vocab.compress_communities):
        assert {r.token: r.representative for r in build(tokens, 0.9).collect()} == {"aa": "ab", "ab": "ab", "b": "b"}


def test_nested_events_and_reports(spark, tmp_path):
    events = [{"action": "closed", "title": "no", "text": "no"}, {"action": "opened", "title": " T ", "text": " B "}, {"action": "opened", "title": "x", "text": "y"}]
    df = spark.createDataFrame([("r", 7, events), ("r", 8, [])], "repo STRING, n INT, events ARRAY<STRUCT<action: STRING, title: STRING, text: STRING>>")
    got = [tuple(r) for r in datasets.adapt_nested_events(df, F.col("repo"), F.col("n")).collect()]
    assert got == [("r#7", "T", "T\n\nB"), ("r#8", "", "")]
    report = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "lint", "rules": [{"id": "A"}, {"id": "B"}]}, "extensions": [{"name": "ext"}]}}, {"tool": {"driver": {"name": "bare"}}}]}
    (tmp_path / "r.json").write_text(json.dumps(report, indent=1))
    rows = datasets.flatten_reports(datasets.read_reports(spark, str(tmp_path))).collect()
    assert sorted((r.run, r.part, r.tool, r.rule_id) for r in rows if r.rule_id) == [(0, "driver", "lint", "A"), (0, "driver", "lint", "B")]
    assert len(rows) == 4


# Patches


def test_apply_patch():
    run = lambda doc, *ops: json.loads(patches.apply_patch(json.dumps(doc), json.dumps(list(ops))))
    assert run({}, {"op": "add", "path": "/a", "value": [1]}, {"op": "add", "path": "/a/-", "value": 2}) == {"a": [1, 2]}
    assert run({"a": {"b": 1}}, {"op": "move", "from": "/a/b", "path": "/c"}) == {"a": {}, "c": 1}
    assert run({"a~/": 1}, {"op": "replace", "path": "/a~0~1", "value": 2}) == {"a~/": 2}
    assert run({"l": [1, 2]}, {"op": "remove", "path": "/l/0"}, {"op": "copy", "from": "/l/0", "path": "/x"}) == {"l": [2], "x": 2}
    for bad in ({"op": "replace", "path": "/q", "value": 1}, {"op": "test", "path": "/a", "value": 9}, {"op": "spin", "path": "/a"}):
        with pytest.raises((ValueError, KeyError)):
            run({"a": 1}, bad)


def test_bad_patches_keep_the_document(spark, tmp_path):
    add = lambda v: json.dumps([{"op": "add", "path": "/v", "value": v}])
    rows = [("a", 1, add(1)), ("a", 2, "broken"), ("a", 3, add(3)), ("b", 1, '[{"op": "remove", "path": "/v"}]')]
    spark.createDataFrame(rows, "entity_id STRING, seq BIGINT, patch STRING").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity_id STRING, seq BIGINT, patch STRING").parquet(str(tmp_path / "in"))
    patches.run_to_end(patches.stream_entity_patches(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.entity_id, r.version, r.document, r.error is None) for r in got) == [
        ("a", 1, '{"v": 1}', False), ("a", 1, '{"v": 1}', True), ("a", 2, '{"v": 3}', True), ("b", 0, "{}", False),
    ]


def test_draws_are_independent(spark):
    from harborlens.functions.draws import hash_draw
    from harborlens.operators import dirty

    keys = spark.range(200_000).withColumns({"a": hash_draw("id", tag="x"), "b": hash_draw("id", tag="x variant")})
    row = keys.agg(F.corr("a", "b").alias("r"), F.countDistinct("a").alias("n"), F.min("a").alias("low"), F.max("a").alias("high")).first()
    assert abs(row.r) < 0.02 and row.n == 200_000 and 0 <= row.low and row.high < 1
    draw = dirty.row_draw("id", seed=1)
    rows = spark.range(20_000).select("id", F.lit("0Ab").alias("k"), F.lit("20240131").alias("d"))
    made = dirty.dirty_dates(dirty.dirty_keys(rows, ["k"], 0.2, draw), ["d"], 0.2, draw)
    assert made.select("k").distinct().count() == 7 and made.select("d").distinct().count() == 5


def test_long_numbers_keep_their_digits(spark):
    from harborlens.operators import dirty, ledger

    rows = spark.range(1234560, 1234575).withColumn("k", F.lit("x"))
    assert dirty.inject_orphans(rows, "k", F.col("id"), 1.1, dirty.row_draw("id")).select("k").distinct().count() == 15
    items = spark.range(100_050).select(F.lit(1).alias("doc"), (F.col("id") % 97).alias("day"), "id")
    assert ledger.line_numbers(items, "doc", ["day", "id"]).select("line_no").distinct().count() == 100_050


def test_null_keys_stay(spark):
    from harborlens.operators.scan import prefix_scan

    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", None, 7), ("a", 1, 8)], "k string, b int, v int")
    got = {(r.k, r.b): r.running for r in prefix_scan(rows, ["k"], "b", ["v"], F.col("v")).collect()}
    assert got == {(None, 1): 5, (None, 2): 11, ("a", None): 7, ("a", 1): 15}


def test_labels_reject_all_listed_words(spark):
    words = ["as", "be", "are", "was", "were", "this", "that", "from", "but", "not", "no"]
    df = spark.createDataFrame([(f"quiet-{w}-harbor",) for w in words], "t string")
    assert df.select(fn.clean_label(F.col("t")).alias("c")).where("c is not null").count() == 0


def test_patches_in_order_across_chunks(spark, tmp_path):
    from harborlens.streaming import patches

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(1500).select(
            F.lit("e").alias("entity_id"), F.col("id").alias("seq"),
            F.format_string('[{"op": "add", "path": "/v", "value": %d}]', "id").alias("patch"),
        )
        rows.repartition(7).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        patches.run_to_end(patches.stream_entity_patches(stream), str(tmp_path / "out"), str(tmp_path / "check"))
        last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("version")).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert last.version == 1500 and last.document == '{"v": 1499}'


def test_radius_graph_has_all_copies(spark):
    from harborlens.operators import nearest

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.1]), (5, [0.0, 1.0]), (6, [0.0, 0.0]), (7, [0.0, 0.0]), (8, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    edges = {(r.id, r.neighbor) for r in nearest.cosine_radius_graph(df, "id", "v", 0.9).collect()}
    assert edges == {(a, b) for a in (1, 2, 3) for b in (2, 3, 4) if a < b}
    links = {(r.id, r.neighbor) for r in nearest.cosine_radius_links(df, "id", "v", 0.9).collect()}
    assert links == {(1, 2), (1, 3), (1, 4)}


def crowd(spark, n=400, twice=7):
    """Points in a small box, every ``twice``-th id on two rows at different places, some without a position."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-0.5, 0.5) for _ in range(3)], [rng.uniform(-1, 1) for _ in range(3)]) for i in range(n)]
    rows += [(i, [rng.uniform(-0.5, 0.5) for _ in range(3)], None if i % 2 else [1.0, 0.0, 0.0]) for i in range(0, n, twice)] if twice else []
    return rows + [(n + 1, None, None), (0, None, [1.0, 1.0, 1.0])]


@pytest.mark.parametrize("cell_rows", [spatial.CELL_ROWS, 3])
def test_pairs_keep_their_ends(spark, monkeypatch, cell_rows):
    """What pairs kept equals the look-up, for ids on several rows too, in crowded and in listed cells."""
    monkeypatch.setattr(spatial.grid_pairs, "__defaults__", (cell_rows,))
    monkeypatch.setattr(spatial, "LISTED_CELLS", 4 if cell_rows == 3 else 1 << 14)
    points = place(spark, crowd(spark))
    show = lambda df: sorted((r.id, r.neighbor, round(r.distance, 9), tuple(r.direction or ()), tuple(r.offset or ())) for r in df.collect())
    kept = spatial.with_vectors(spatial.radius_join(points, 0.15, ends=True), points)
    looked = spatial.with_vectors(spatial.radius_join(points, 0.15), points)
    assert kept.columns == looked.columns and show(kept) == show(looked)
    rows = [(i, p) for i, p, _ in crowd(spark) if p]
    plain = sorted((i, j) for i, p in rows for j, q in rows if i != j and math.dist(p, q) <= 0.15)
    assert sorted((r.id, r.neighbor) for r in spatial.radius_join(points, 0.15).collect()) == plain


@pytest.mark.parametrize("kind", ["torus", "spherical", "reflection"])
def test_wrapped_pairs_have_their_smallest_distance(spark, kind):
    topology = spatial.Topology.preset(kind, ((-0.4, 0.4),) * 3)
    rows = crowd(spark, 120)
    points = place(spark, rows)
    images = {}
    for r in points.where("position IS NOT NULL").select("id", spatial.wrapped_positions(F.col("position"), topology).alias("at")).collect():
        images.setdefault(r.id, []).extend(r.at)
    for radius in (0.12, 0.5):
        expected = {}
        for i, ats in images.items():
            for j, q, _ in rows:
                if q and i != j and (gap := min(math.dist(a, q) for a in ats)) <= radius:
                    expected[i, j] = min(gap, expected.get((i, j), gap))
        got = spatial.wrapped_radius_join(points, radius, topology).collect()
        assert len(got) == len(expected) and all(abs(expected[r.id, r.neighbor] - r.distance) < 1e-9 for r in got)


def test_pairs_do_not_travel(spark):
    """No exchange stands above the join that makes the pairs."""
    points = place(spark, crowd(spark, twice=0)[:-1])
    torus = spatial.Topology.preset("torus", ((-0.6, 0.6),) * 3)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = spatial.radius_join(points, 0.2, ends=True)
        for df in (spatial.neighbors_in_front(spatial.with_vectors(near, points)), spatial.wrapped_radius_join(points, 0.2, torus)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan[: plan.index("SortMergeJoin")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
