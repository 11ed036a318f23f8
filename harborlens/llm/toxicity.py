"""A toxicity classifier that is held to equal scores when identity terms are swapped."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import bounded_batches

#: The classifier is fitted on at most so many labelled rows, those whose ids hash lowest.
TRAINING_ROWS = 5000
#: Terms for groups of people; a term may be swapped for the others of its row, or for a neutral word.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frau", "mann"), ("femme", "homme"), ("mujer", "hombre"),
)
NEUTRAL = "person"
TOKEN = re.compile(r"\w+")


#: Lengths of the word beginnings that are features besides whole words; they carry stems over to unseen forms.
STEMS = (3, 4, 5, 6, 7)


def words_of(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings with a hyphen."""
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in STEMS))


def swaps(words: set[str], terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[set[str]]:
    """Counterfactual word sets: all terms moved on by one in their row, and all made neutral."""
    moved: dict[str, str] = {}
    for row in terms:
        for i, term in enumerate(row):
            if term in words:
                moved[term] = row[(i + 1) % len(row)]
    if not moved:
        return []
    rest = words - moved.keys()
    return [rest | set(moved.values()), rest | {NEUTRAL}]


@dataclass(frozen=True)
class Model:
    weights: Mapping[str, float]
    intercept: float
    constant: float | None = None  # the score of everything, where labels name one class only

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        found = features(words_of(text)) & self.weights.keys()
        return float(1 / (1 + np.exp(-(self.intercept + sum(self.weights[w] for w in sorted(found))))))


def copies_weight(bags: Iterable[set[str]], sketch: int = 6) -> np.ndarray:
    """1 / size of the group of bags with the same six lowest word hashes, so that copies count once."""
    keys = [tuple(nsmallest(sketch, (zlib.crc32(w.encode()) * 2654435761 & 0xFFFFFFFF for w in bag))) for bag in bags]
    sizes = Counter(keys)
    return np.array([1 / sizes[k] for k in keys])


def fit(
    texts: Sequence[str | None], labels: Sequence[int], penalty: float = 1.0, l2: float = 1e-6,
    least_docs: float = 5, least_share: float = 0.01, least_z: float = 6.0,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> Model:
    """Logistic regression on the presence of words and word beginnings that speak for a label.

    One enters if it occurs in enough toxic rows (``least_docs`` and ``least_share`` of them,
    near copies counted once) and deviates from the base rate by ``least_z`` standard errors. The loss
    is the weighted mean of the log loss, a small ridge, and ``penalty`` times the mean squared change
    of the logit between a row and its counterfactuals. Newton steps find its one minimum.
    """
    y = np.array(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, 0.0, float(y.sum() / (len(y) + 1)))
    # The word sets of all texts take far more memory than the texts: they are made anew where they are needed.
    share = copies_weight(map(words_of, texts))
    toxic_rows = defaultdict(float)
    for text, label, part in zip(texts, y, share):
        if label:
            for word in features(words_of(text)):
                toxic_rows[word] += part
    base = float((share * y).sum() / share.sum())
    enough = max(least_docs, least_share * float((share * y).sum()))
    toxic_rows = {w: n for w, n in toxic_rows.items() if n >= enough}
    rows = dict.fromkeys(toxic_rows, 0.0)
    for text, part in zip(texts, share):
        for word in features(words_of(text)) & rows.keys():
            rows[word] += part
    vocabulary = sorted(
        w for w, n in rows.items() if (toxic_rows[w] - n * base) / np.sqrt(n * base * (1 - base)) >= least_z
    )
    place = {w: i + 1 for i, w in enumerate(vocabulary)}

    def row_of(bag: set[str]) -> np.ndarray:
        out = np.zeros(len(place) + 1)
        out[[0, *(place[w] for w in features(bag) & place.keys())]] = 1
        return out

    x = np.zeros((len(y), len(place) + 1))
    changes = []
    for i, bag in enumerate(map(words_of, texts)):
        x[i] = row_of(bag)
        changes += [x[i] - row_of(other) for other in swaps(bag, terms)]
    change = np.array(changes) if changes else np.zeros((0, x.shape[1]))
    fair = 2 * penalty * change.T @ change / max(1, len(changes)) + 2 * l2 * np.diag([0.0] + [1.0] * len(place))
    share /= share.sum()
    w = np.zeros(x.shape[1])
    w[0] = np.log(base / (1 - base))

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((share * (np.logaddexp(0, z) - y * z)).sum() + at @ fair @ at / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (share * (p - y)) + fair @ w
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + fair + 1e-9 * np.eye(len(w))
        step, size = np.linalg.solve(bend, slope), 1.0
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-10:
            break
    return Model(dict(zip(vocabulary, map(float, w[1:]))), float(w[0]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of five; rows without id are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_column: str = "doc_id",
    text_column: str = "text", label_column: str = "toxic",
) -> Model:
    """Fit on the bounded sample of labelled rows that are not held out (the larger of several labels counts)."""
    key = F.col("id")
    chosen = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & ~held_out(key))
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(key), key).limit(rows)
    )
    sample = (
        docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
        .join(F.broadcast(chosen), F.col("doc") == key)  # at most ``rows`` ids
        .select("doc", "text", "label").dropDuplicates(["doc"]).orderBy("doc").toArrow()
    )
    return fit(sample.column("text").to_pylist(), sample.column("label").to_pylist())


def add_scores(docs: DataFrame, model: Model, text_column: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """The rows with their score. Null and empty texts have no words and get the intercept's score."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            scores = pa.array([model.score(x.as_py()) for x in batch.column(at)], pa.float64())
            shown = [i for i in range(batch.num_columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in shown), scores], names=[*(batch.schema.names[i] for i in shown), out]
            )

    rows = docs.select(*kept)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep_text or f.name != text_column]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{out}` double"]))


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Scores see the text alone. Without labels of both classes every score is the share of toxic
    rows among the training rows. An empty table gives an empty result; rows with equal ids each
    get the score of their own text.
    """
    model = train(docs, labels, id_column=id_column, text_column=text_column)
    scored = add_scores(docs.select(id_column, text_column), model, text_column)
    return scored.select(
        id_column, held_out(F.col(id_column)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
