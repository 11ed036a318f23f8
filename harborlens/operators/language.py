"""Telling languages apart by letter n-grams: naive Bayes over hashed counts.

The model is a table of counts per language and bucket, filled by one aggregation over a bounded
sample; scoring is a look-up in a broadcast array, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts per language that are looked at: half of them fill the counts, half set the temperature.
SAMPLE = 1000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: Characters whose n-grams are counted at a time; a longer text is taken in parts.
PART = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    """Code points in lower case; every run of other characters than letters is one blank."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    return np.frombuffer(f" {' '.join(kept.split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)


def bucket_counts(text: str | None) -> np.ndarray:
    """How many n-grams of a text fall into each bucket. N-grams may begin and end with a blank, not span one."""
    out = np.zeros(BUCKETS, np.int64)
    text = text or ""
    for at in range(0, len(text), PART):
        points = _points(text[at:at + PART])
        blank = points == 32
        if len(points) < 3:
            continue
        for n in ORDERS:
            key, whole = np.full(len(points) - n + 1, n, np.uint64), np.ones(len(points) - n + 1, bool)
            for k in range(n):
                part = slice(k, len(points) - n + 1 + k)
                key = (key ^ points[part]) * _MIX
                key ^= key >> np.uint64(29)
                if 0 < k < n - 1 or n == 1:
                    whole &= ~blank[part]
            out += np.bincount((key[whole] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` (language, bucket): log shares; ``prior``: log shares of texts; ``temperature`` divides sums."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray
    temperature: float

    def evidence(self, counts: np.ndarray) -> np.ndarray:
        """Log likelihood per language relative to the mean, over the root of the number of n-grams."""
        total = counts.sum(axis=-1, keepdims=True)
        raw = counts @ self.weights.T
        return (raw - raw.mean(axis=-1, keepdims=True)) / np.sqrt(np.maximum(total, 1))

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """One row per row of ``counts``; a text without letters has the shares of the languages."""
        z = self.evidence(counts) / self.temperature + self.prior
        z -= z.max(axis=-1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=-1, keepdims=True)


def sample(docs: DataFrame, id_column: str, text_column: str, language_column: str, size: int = SAMPLE) -> DataFrame:
    """(language, text, fits): at most ``size`` texts per language, drawn by a hash of their id; every second one fits the counts."""
    draw = F.xxhash64(F.col(id_column), F.lit("language"))
    rows = docs.where(F.col(language_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(language_column).alias("language"), F.col(text_column).alias("text"), draw.alias("draw")
    )
    # The rank has a limit, so every task passes on ``size`` rows of a language at most.
    place = F.row_number().over(Window.partitionBy("language").orderBy("draw", "text"))
    return rows.withColumn("at", place).where(F.col("at") <= size).select("language", "text", (F.col("at") % 2 == 1).alias("fits"))


def fit(
    docs: DataFrame, id_column: str = "id", text_column: str = "text", language_column: str = "lang", size: int = SAMPLE
) -> LanguageModel:
    """Counts per language from half of a bounded sample, a temperature from the other half.

    Only languages x buckets counts and the sample's evidence (one number per text and language)
    reach the driver. Without labelled texts the model knows no language.
    """
    chosen = sample(docs, id_column, text_column, language_column, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[language] = total.get(language, 0) + bucket_counts(text.as_py())
        for language, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["language", "bucket", "n"]
            )

    filled = (
        chosen.where("fits").select("language", "text").mapInArrow(count, "language string, bucket int, n bigint")
        .groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = tuple(sorted(filled["language"].unique()))
    counts = np.zeros((len(languages), BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    counts[filled["language"].map(place).to_numpy(dtype=np.int64), filled["bucket"].to_numpy(dtype=np.int64)] = filled["n"]
    shares = counts + SMOOTHING
    weights = np.log(shares / shares.sum(axis=1, keepdims=True))
    texts = {r["language"]: r["n"] for r in chosen.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = np.array([texts[name] for name in languages], float)
    model = LanguageModel(languages, weights, np.log(known / known.sum()) if len(known) else known, 1.0)
    if not languages:
        return model
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [shipped.value.evidence(bucket_counts(text.as_py())).tolist() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.list_(pa.float64()))], names=["language", "z"])

    rest = chosen.where(~F.col("fits") & F.col("language").isin(*languages)).select("language", "text")
    rows = rest.mapInArrow(evidence, "language string, z array<double>").toPandas()
    if not len(rows):
        return model
    z, truth = np.array(rows["z"].tolist()), rows["language"].map(place).to_numpy(dtype=np.int64)
    return LanguageModel(languages, weights, model.prior, calibrated(z, truth, model.prior))


def calibrated(z: np.ndarray, truth: np.ndarray, prior: np.ndarray) -> float:
    """The temperature under which the true languages have the least log loss (a convex search in its inverse)."""
    def loss(inverse: float) -> float:
        s = z * inverse + prior
        return float((np.logaddexp.reduce(s, axis=1) - s[np.arange(len(s)), truth]).mean())

    low, high = np.log(1e-3), np.log(1e3)
    for _ in range(80):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, high)
    return float(np.exp(-(low + high) / 2))


def language_probabilities(model: LanguageModel, text: Column, spark) -> Column:
    """Struct (language, probability, all): the likeliest language and the probabilities in the model's order.

    Null and empty texts, and texts without letters, have the shares of the languages in the sample. A
    model without languages gives nulls.
    """
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("language string, probability double, all array<double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        model = shipped.value
        if not model.languages:
            return pd.DataFrame({"language": [None] * len(texts), "probability": np.nan, "all": [[]] * len(texts)})
        p = np.array([model.probabilities(bucket_counts(t)) for t in texts]).reshape(len(texts), -1)
        best = p.argmax(axis=1)
        return pd.DataFrame({
            "language": [model.languages[i] for i in best], "probability": p[np.arange(len(p)), best], "all": list(p)
        })

    return score(text)


def model_filter(docs: DataFrame, model: LanguageModel, language: str = "en", threshold: float = 0.65, text_column: str = "text") -> DataFrame:
    """The rows whose text belongs to the language with at least this probability."""
    if language not in model.languages:
        return docs.where(F.lit(False))
    at = model.languages.index(language)
    scored = language_probabilities(model, F.col(text_column), docs.sparkSession)
    return docs.where(F.get(scored["all"], F.lit(at)) >= threshold)
