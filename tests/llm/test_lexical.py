import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from harborlens.llm import lexical
from harborlens.llm.queries import LLM_QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """Every item against every document."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        if text is None:
            continue
        scores = []
        for doc, bag in bags:
            m = 75 + (25 * bag.total() * total) // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t in terms(text) if t in bag
            )
            if score > 0:
                scores.append((-score, -(2**63) if doc is None else doc))
        for rank, (score, doc) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if doc == -(2**63) else doc, -score))
    return sorted(out, key=repr)


def rows(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_all_pairs(spark, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["ÀÉ", "straße", "ıx", "名前"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, draw.choice([" ", "-", "\n"]).join(draw.choices(words, weights, k=draw.randint(0, 200)))) for i in range(3000)]
    docs += [(5000 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1]), (None, docs[9][1]), (9001, None), (9002, ""), (9003, "--- !!")]
    items = [(i, " ".join(draw.choices(words, weights, k=draw.randint(1, 30)))) for i in range(70)]
    items += [(70, docs[7][1]), (71, None), (72, ""), (73, "unheard"), (1, "W1 w2 W1"), (None, "w5 w6")]
    found = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id int, text string"), k=20
    )
    assert rows(found) == plain(docs, items, 20)


def test_blocks_of_items_give_the_same(spark):
    draw = random.Random(3)
    docs = [(i, " ".join(draw.choices("abcdefghij", k=draw.randint(1, 30)))) for i in range(200)]
    items = [(i, " ".join(draw.choices("abcdefghij", k=4))) for i in range(30)]
    found = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3, block_items=7
    )
    assert rows(found) == plain(docs, items, 3)


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, score int, item int")
    items = spark.createDataFrame([(1, "a", 0)], "item_id long, text string, rank int")
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, plain([(1, "a b")], [(1, "a")], 1)[0][3])]
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []


def test_trees_prune_and_bounds_hold():
    """No node's bound is below a score under it, and most leaves are never opened."""
    draw = np.random.default_rng(4)
    n, size = 1500, 400
    owner = np.repeat(np.arange(n), 12)
    term = np.concatenate([40 * draw.integers(0, 10) + draw.choice(40, 12, replace=False) for _ in range(n)])  # ten subjects
    tfs = draw.integers(1, 5, len(owner))
    weights = np.sort(draw.integers(100, 9000, size))
    docs = lexical.Documents(np.arange(n), np.full(n, 100), owner, term, tfs, weights)
    items = [{int(t): int(weights[t]) for t in 40 * draw.integers(0, 10) + draw.choice(40, 10, replace=False)} for _ in range(40)]
    tree = lexical.item_tree(items)
    for node in [tree, *tree.below]:
        at, w = docs.local(node)
        for item in node.items.tolist():
            own, ow = docs.local(lexical.Node(np.array(sorted(items[item])), np.array([items[item][t] for t in sorted(items[item])]), np.array([item])))
            scores = ow @ docs.impacts[own].astype(np.int64)
            for level, fan in enumerate([lexical.LEAF_DOCS, lexical.LEAF_DOCS * lexical.DOC_FAN]):
                bound = w @ docs.levels[level][at].astype(np.int64)
                assert (np.repeat(bound, fan)[:n] >= scores).all()
    best, opened = lexical.Best(np.zeros(40, np.int64), 5), []
    add = best.add
    best.add = lambda item, scores, ids: (opened.append(len(ids)), add(item, scores, ids))
    for _ in range(2):  # the second walk has the thresholds of the first
        opened.clear()
        docs.search(tree, best, len(docs.levels) - 1, np.arange(1))
        best.scores, best.ids = [x[:0] for x in best.scores], [x[:0] for x in best.ids]
    assert sum(opened) < 0.5 * 40 * n


def test_long_texts_in_parts():
    text = ("ab-c " * 30).encode()
    assert Counter(w for part in lexical.term_parts(text, 7) for w in part) == lexical.term_counts(text) == {b"ab": 30, b"c": 30}


def test_query_on_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(LLM_QUERIES["op11_lexical_search"](spark, folder)) == plain(docs, items, 20)
