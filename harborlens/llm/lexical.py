"""Ranked lexical search: whole benchmark items as queries over all documents, by a dual-tree search."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborlens.llm.common import LOWEST, bounded_batches, id_order
from harborlens.session import scratch_path

#: Items that go to every task together, and the items under one bottom node of their tree.
BLOCK_ITEMS, ITEM_FAN = 20_000, 8
#: Documents of one tree, documents of a leaf, and cells of the table of a tree's impacts.
TREE_DOCS, LEAF_DOCS, DOC_FAN, TREE_CELLS = 2048, 16, 8, 1 << 23
#: One document in so many is searched first; the scores found there only set thresholds to begin with.
FIRST_SHARE = 64


def _separators() -> bytes:
    """A table for UTF-8 bytes: letters and digits stay (A-Z in lower case), other ASCII becomes a blank."""
    out = bytearray(range(256))
    for c in range(128):
        out[c] = ord(chr(c).lower()) if chr(c).isalnum() else 32
    return bytes(out)


TERMS = _separators()


def term_parts(text: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time: maximal runs of ASCII letters and digits and all beyond ASCII."""
    plain, at = text.translate(TERMS), 0
    while at < len(plain):
        end = len(plain) if at + size >= len(plain) else plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def term_counts(text: bytes) -> Counter:
    total: Counter = Counter()
    for part in term_parts(text):
        total.update(part)
    return total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by: whole numbers below a million that grow with tf."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_factor(n: Sequence[int], documents: int, terms: int) -> np.ndarray:
    return np.array([75 + (25 * int(x) * documents) // terms for x in n], np.int64)  # whole numbers of any size


def postings(docs: DataFrame, vocabulary: Sequence[bytes], id_column: str, text_column: str) -> DataFrame:
    """(id, n, terms, tfs) of every row with a term; terms are numbers of those in the vocabulary."""
    spark = docs.sparkSession
    bounded_batches(spark)
    places = spark.sparkContext.broadcast({word: i for i, word in enumerate(vocabulary)})
    rows = docs.where(F.col(text_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places.value
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts(text.as_py())
                if not counts:
                    continue
                known = sorted((place[w], c) for w, c in counts.items() if w in place)
                ids.append(i)
                sizes.append(counts.total())
                terms.append([t for t, _ in known])
                tfs.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                names=["id", "n", "terms", "tfs"],
            )

    return rows.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>")


def document_frequencies(found: DataFrame, size: int) -> dict[int, int]:
    """Rows per term number, counted by tasks first; ``size`` numbers at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])

    counts = found.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in counts.collect()}


@dataclass(frozen=True)
class Node:
    """Some items: term numbers in order with the largest weight any item has for each."""

    terms: np.ndarray
    weights: np.ndarray
    items: np.ndarray
    below: tuple[Node, ...] = ()


def item_tree(items: Sequence[dict[int, int]], fan: int = ITEM_FAN) -> Node:
    """A tree over items (term number -> weight, repeats included); neighbours share their heaviest terms."""
    heaviest = [sorted(item, key=lambda t: (-item[t], t))[:8] for item in items]
    level = []
    for i in sorted(range(len(items)), key=lambda i: heaviest[i]):
        terms = np.array(sorted(items[i]), np.int64)
        level.append(Node(terms, np.array([items[i][t] for t in terms.tolist()], np.int64), np.array([i])))
    while len(level) > 1:
        above = []
        for k in range(0, len(level), fan):
            part = tuple(level[k:k + fan])
            terms = np.unique(np.concatenate([x.terms for x in part]))
            weights = np.zeros(len(terms), np.int64)
            for x in part:
                at = np.searchsorted(terms, x.terms)
                weights[at] = np.maximum(weights[at], x.weights)
            above.append(Node(terms, weights, np.concatenate([x.items for x in part]), part))
        level = above
    return level[0]


class Best:
    """The k best (score, id) per item so far, and the score that a further document has to reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.scores = [np.zeros(0, np.int64) for _ in floor]
        self.ids = [np.zeros(0, np.int64) for _ in floor]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= max(1, self.floor[item])
        scores, ids = np.r_[self.scores[item], scores[keep]], np.r_[self.ids[item], ids[keep]]
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], scores[order[-1]])


class Documents:
    """A tree over some documents: per term the largest impact below each node, from the leaves' up to one."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, owner: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        self.terms, column = np.unique(terms, return_inverse=True)
        values = impact(tfs, m[owner])
        # Documents with the same strongest term stand together, so that maxima are close to what is below.
        worth = values * weights[terms]
        strongest = np.zeros(len(ids), np.int64)
        order = np.lexsort((worth, owner))
        strongest[owner[order]] = column[order]  # the last one of an owner stays
        order = np.lexsort((m, strongest))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        self.impacts = np.zeros((len(self.terms), len(ids)), np.int32)
        self.impacts[column, place[owner]] = values
        self.levels = [self._above(self.impacts, LEAF_DOCS)]
        while self.levels[-1].shape[1] > 1:
            self.levels.append(self._above(self.levels[-1], DOC_FAN))

    @staticmethod
    def _above(table: np.ndarray, fan: int) -> np.ndarray:
        return np.maximum.reduceat(table, np.arange(0, table.shape[1], fan), axis=1) if len(table) else table[:, ::fan]

    def local(self, node: Node) -> tuple[np.ndarray, np.ndarray]:
        """The node's terms that occur here, as rows of the tables, and their weights."""
        at = np.minimum(np.searchsorted(self.terms, node.terms), len(self.terms) - 1)
        here = self.terms[at] == node.terms
        return at[here], node.weights[here]

    def search(self, node: Node, best: Best, level: int, alive: np.ndarray) -> None:
        """Drop the node pairs whose bound stays below the weakest k-th score of the node's items, then go down on both sides."""
        rows, weights = self.local(node)
        if not len(rows):
            return
        weakest = max(1, int(best.floor[node.items].min()))
        bound = weights @ self.levels[level][np.ix_(rows, alive)].astype(np.int64)
        alive = alive[bound >= weakest]
        if not len(alive):
            return
        if level:
            fan, width = DOC_FAN, self.levels[level - 1].shape[1]
        else:
            fan, width = LEAF_DOCS, len(self.ids)
        inner = (alive[:, None] * fan + np.arange(fan)).ravel()
        inner = inner[inner < width]
        if node.below:
            down = inner if level else alive
            for child in node.below:
                self.search(child, best, max(0, level - 1), down)
        elif level:
            self.search(node, best, level - 1, inner)
        else:
            best.add(int(node.items[0]), weights @ self.impacts[np.ix_(rows, inner)].astype(np.int64), self.ids[inner])


def best_of_tasks(found: DataFrame, tree: Node, weights: np.ndarray, floor: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """(item, id, score): every task's k best documents per item that reach the item's floor."""
    spark = found.sparkSession
    bounded_batches(spark, TREE_DOCS)
    shared = spark.sparkContext.broadcast((tree, weights, floor))

    def trees(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[Documents]:
        flat, tfs = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        if batch.num_rows > LEAF_DOCS and len(np.unique(flat)) * batch.num_rows > TREE_CELLS:
            half = batch.num_rows // 2
            yield from trees(batch.slice(0, half), weights)
            yield from trees(batch.slice(half), weights)
        elif len(flat):
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(2).value_lengths()))
            m = length_factor(batch.column(1).to_pylist(), documents, terms)
            yield Documents(np.asarray(batch.column(0).fill_null(LOWEST)), m, owner, flat.astype(np.int64), tfs.astype(np.int64), weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weights, floor = shared.value
        best = Best(floor, k)
        for batch in batches:
            for docs in trees(batch, weights):
                top = len(docs.levels) - 1
                docs.search(tree, best, top, np.arange(docs.levels[top].shape[1]))
        for first in range(0, len(floor), 1000):
            some = range(first, min(first + 1000, len(floor)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(some, np.int32), [len(best.ids[i]) for i in some])),
                    pa.array(np.concatenate([best.ids[i] for i in some])), pa.array(np.concatenate([best.scores[i] for i in some])),
                ],
                names=["item", "id", "score"],
            )

    return found.mapInArrow(run, "item int, id bigint, score bigint")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of highest score above 0.

    Scores weigh the item's terms by how rare they are and by their share of the document, in whole
    numbers. Documents are read once per block of ``block_items`` items: what they hold of the
    block's vocabulary is written to the shared folder. A task builds trees of its documents with the
    largest impact of every term below a node and walks them against the tree of the items; a pair
    of nodes whose bound stays below the weakest k-th score of the node's items is dropped with
    all below it, so nothing that could rank is lost. The k-th scores in one document of
    ``FIRST_SHARE`` are where all tasks start.

    A null text has no terms and is no document; rows with equal ids each rank; a null id counts as
    the smallest and is returned as null; equal scores go by ascending id. Every row of ``items``
    is a query of its own, with null text it has no result. Other columns are left behind. Empty
    tables give an empty result.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = max(1, -(-items.count() // block_items))
    parts = []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = part.orderBy("item_id", "text").collect()  # one bounded block
        parts.append(_search_block(docs, [r.item_id for r in rows], [r.text for r in rows], k, id_column, text_column))
    parts = [x for x in parts if x is not None]
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, parts)


def _search_block(docs: DataFrame, ids: list, texts: list[str], k: int, id_column: str, text_column: str) -> DataFrame | None:
    spark = docs.sparkSession
    bags = [term_counts(text.encode()) for text in texts]
    vocabulary = sorted(set().union(*bags))
    if not vocabulary:
        return None
    path = scratch_path(spark, "postings")
    postings(docs, vocabulary, id_column, text_column).write.parquet(path)
    found = spark.read.parquet(path)
    documents, terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        return None
    df = document_frequencies(found, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    place = {word: t for t, word in enumerate(vocabulary)}
    tree = item_tree([{place[w]: c * int(weights[place[w]]) for w, c in bag.items()} for bag in bags])
    found = found.where(F.size("terms") > 0)
    floor = np.zeros(len(ids), np.int64)
    first = found.where(F.pmod(F.xxhash64("id", "n"), F.lit(FIRST_SHARE)) == 0)
    for row in ranked(best_of_tasks(first, tree, weights, floor, documents, terms, k), k).where(F.col("rank") == k).collect():
        floor[row.item] = row.score  # one row per item of the block
    best = ranked(best_of_tasks(found, tree, weights, floor, documents, terms, k), k)
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id bigint")
    doc_id = F.when(F.col("id") != LOWEST, F.col("id")).alias("doc_id")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", doc_id, "score")  # one block's ids


#: The same in SQL, for k = 20.
SEARCH_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
counted AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY row),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
wanted AS (
    SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counted, totals WHERE term IN (SELECT term FROM wanted) GROUP BY term),
impacts AS (
    SELECT c.row, c.doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS value
    FROM counted c JOIN weights USING (term) JOIN sizes s ON s.row = c.row, totals),
scores AS (
    SELECT item_id, row, doc_id, CAST(sum(repeats * value) AS BIGINT) AS score
    FROM impacts JOIN wanted USING (term) GROUP BY ALL HAVING sum(repeats * value) > 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
