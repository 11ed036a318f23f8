"""The language model against plain counting, on held-out documents and at the edges."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlens.operators import language
from harborlens.plans.catalog import QUERIES

WORDS = {"x": "aba abo bao oba abab".split(), "y": "kim mik kimi iki mimik".split()}


def texts(n, seed):
    draw = random.Random(seed)
    return [(i, lang, " ".join(draw.choices(WORDS[lang], k=draw.randint(3, 30)))) for i in range(n) for lang in [draw.choice("xy")]]


def plain_grams(text):
    """N-grams as strings, one blank for everything between letters."""
    line = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in text.lower()).split())} "
    out = Counter()
    if len(line) > 2:
        for n in language.ORDERS:
            for i in range(len(line) - n + 1):
                gram = line[i:i + n]
                if " " not in (gram[1:-1] if n > 1 else gram):
                    out[gram] += 1
    return out


def test_buckets_hold_all_grams():
    for text in ["Ab, cd!", "", "  ", "é", "ein Wort\nzwei  Wörter", "123 -- 4"]:
        grams, counts = plain_grams(text), language.bucket_counts(text)
        assert counts.sum() == grams.total()
        assert (counts > 0).sum() <= len(grams) and (counts > 0).sum() >= 0.95 * len(grams)
    assert (language.bucket_counts("ab cd") == language.bucket_counts("AB ;CD")).all()
    assert language.bucket_counts(None).sum() == 0


def test_scores_equal_plain_bayes(spark):
    rows = texts(200, 1)
    frame = spark.createDataFrame(rows, "id long, lang string, text string")
    model = language.fit(frame)
    chosen = language.sample(frame, "id", "text", "lang").collect()
    assert len(chosen) == 200
    counts = {lang: sum(language.bucket_counts(r.text) for r in chosen if r.fits and r.language == lang) for lang in "xy"}
    share = Counter(r.language for r in chosen)
    for text in ["abab mik", "kimi", "zz", ""]:
        mine, own = model.probabilities(language.bucket_counts(text)), language.bucket_counts(text)
        logs = []
        for lang in "xy":
            smooth = counts[lang] + language.SMOOTHING
            logs.append(sum(c * math.log(smooth[b] / smooth.sum()) for b, c in enumerate(own.tolist()) if c))
        z = [(v - sum(logs) / 2) / math.sqrt(max(1, own.sum())) / model.temperature + math.log(share[lang] / 200) for v, lang in zip(logs, "xy")]
        assert mine == pytest.approx([math.exp(v) / sum(map(math.exp, z)) for v in z], abs=1e-9)


def test_temperature_has_the_least_loss():
    draw = np.random.default_rng(2)
    truth = draw.integers(0, 3, 500)
    z = draw.normal(size=(500, 3)) + 0.8 * np.eye(3)[truth]
    prior = np.log([0.2, 0.3, 0.5])
    loss = lambda t: (np.logaddexp.reduce(z / t + prior, axis=1) - (z / t + prior)[np.arange(500), truth]).mean()
    best = language.calibrated(z, truth, prior)
    assert all(loss(best) <= loss(best * step) + 1e-12 for step in (0.5, 0.9, 0.99, 1.01, 1.1, 2))


def test_probabilities_are_calibrated_on_ambiguous_texts(spark):
    """Texts of few letters that both languages use: a probability of p is right about p of the time."""
    draw = random.Random(3)
    rows = [(i, lang, "".join(draw.choices("abcd", [3, 2, 2, 1] if lang == "x" else [1, 2, 2, 3], k=5))) for i in range(3000) for lang in [draw.choice("xy")]]
    frame = spark.createDataFrame(rows, "id long, lang string, text string")
    model = language.fit(frame.where("id < 2000"))
    found = frame.where("id >= 2000").withColumn("p", language.language_probabilities(model, F.col("text"), spark)).select("lang", "p.*").toPandas()
    right, stated = (found["lang"] == found["language"]).mean(), found["probability"].mean()
    assert right > 0.6 and abs(right - stated) < 0.08


def test_edges(spark):
    frame = spark.createDataFrame(texts(60, 4) + [(100, "x", None), (101, None, "kim"), (102, "y", "")], "id long, lang string, text string")
    model = language.fit(frame)
    scored = {r.id: r.p for r in frame.withColumn("p", language.language_probabilities(model, F.col("text"), spark)).collect()}
    assert scored[100]["all"] == pytest.approx(np.exp(model.prior)) and scored[102]["all"] == scored[100]["all"]
    assert scored[101].language == "y"
    assert language.model_filter(frame, model, "unknown").count() == 0
    none = language.fit(frame.limit(0))
    assert none.languages == ()
    assert frame.limit(2).select(language.language_probabilities(none, F.col("text"), spark).alias("p")).first().p.language is None
    assert (language.fit(frame, size=10).weights.shape) == (2, language.BUCKETS)


def test_long_texts_in_parts(monkeypatch):
    whole = language.bucket_counts("abc def " * 50)
    monkeypatch.setattr(language, "PART", 8)
    assert (language.bucket_counts("abc def " * 50) == whole).all()


def test_held_out_accuracy(spark):
    found = QUERIES["language_model"](spark, "/root/testdata/sf0.01").toPandas()
    import zlib
    held = found[[zlib.crc32(str(i).encode()) % 5 == 0 for i in found["id"]]]
    assert len(held) > 100 and (held["lang"] == held["language"]).mean() >= 0.97
    kept = {r.id for r in QUERIES["language_model_filter"](spark, "/root/testdata/sf0.01").collect()}
    english = set(found[found["lang"] == "en"]["id"])
    assert len(kept & english) >= 0.97 * len(english) and len(kept - english) <= 0.03 * len(kept)
