"""Preparing a text corpus: quality filters, slugs, splits and batches.

Filters look at whole texts and stay work on each row: no text is exploded or shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborlens.functions import text as fn
from harborlens.functions.grams import ngram_letters, profile_hits
from harborlens.functions.json_path import let
from harborlens.operators.scan import prefix_scan, rank_within

# Frequent function words per language, for telling languages apart offline.
PROFILES = {
    "en": "the and of to in is that for it with as was on are by this be from or an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "le la les et des en un une du est que dans qui pour au sur pas par avec ce".split(),
    "es": "el la de que y en los se del las un por con una su para es al lo como".split(),
}

# Published limits of the repetition filter (shares of lines, paragraphs, characters).
DUPLICATE_LINES, DUPLICATE_PARAGRAPHS = 0.30, 0.30
DUPLICATE_LINE_CHARS, DUPLICATE_PARAGRAPH_CHARS = 0.20, 0.20
TOP_NGRAM_CHARS = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATE_NGRAM_CHARS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}

# Published limits of the web quality filter.
MIN_ENDED_LINES, MAX_SHORT_LINES, SHORT_LINE = 0.12, 0.67, 30
MAX_REPEATED_LINE_CHARS, MAX_NEWLINES_PER_WORD = 0.10, 0.30

MIN_TOKENS, MAX_TOKENS = 50, 1000


def language_score(text: Column, language: str) -> Column:
    """How much of the profile words found belongs to the language, 0 when none is found.

    An offline stand-in for a trained classifier; words of several profiles count for each.
    """
    at = list(PROFILES).index(language)
    found = profile_hits(fn.words_of(text), list(PROFILES.values()))
    return let(found, lambda c: F.when(F.array_max(c) > 0, c[at] / F.aggregate(c, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0.0)))


def language_filter(df: DataFrame, language: str = "en", threshold: float = 0.65) -> DataFrame:
    return df.where(language_score(F.col("text"), language) >= threshold)


def _total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x))


def duplicate_shares(text: Column, separator: str) -> Column:
    """Struct (by_count, by_chars): repeated pieces after their first occurrence."""
    pieces = F.filter(F.split(F.trim(text), separator), lambda p: p != "")
    return let(pieces, lambda p: let(F.array_distinct(p), lambda d: F.struct(
        F.when(F.size(p) > 0, (F.size(p) - F.size(d)) / F.size(p)).otherwise(F.lit(0.0)).alias("by_count"),
        F.when(F.length(text) > 0, (_total_length(p) - _total_length(d)) / F.length(text)).otherwise(F.lit(0.0)).alias("by_chars"),
    )))


def repetition_measures(df: DataFrame) -> DataFrame:
    """The rows with all shares of the repetition filter as one struct column ``repetition``.

    Repeated lines and paragraphs are shares after their first occurrence. ``top_n`` is the share of
    the text in its most frequent n-gram, ``dup_n`` that of words inside n-grams seen before.
    """
    text, total = F.col("text"), F.greatest(F.length("text"), F.lit(1))
    counted = df.withColumn(
        "_letters", ngram_letters(fn.words_of(text), list(TOP_NGRAM_CHARS), list(DUPLICATE_NGRAM_CHARS))
    )
    names = [f"top_{n}" for n in TOP_NGRAM_CHARS] + [f"dup_{n}" for n in DUPLICATE_NGRAM_CHARS]
    shares = [(F.col(f"_letters.{name}") / total).alias(name) for name in names]
    return counted.withColumn("repetition", F.struct(
        duplicate_shares(text, "\n+").alias("lines"), duplicate_shares(text, "\n{2,}").alias("paragraphs"), *shares
    )).drop("_letters")


def is_repetitive(m: Column) -> Column:
    """Whether measures exceed any published limit."""
    over = (
        (m["lines"]["by_count"] > DUPLICATE_LINES) | (m["lines"]["by_chars"] > DUPLICATE_LINE_CHARS)
        | (m["paragraphs"]["by_count"] > DUPLICATE_PARAGRAPHS) | (m["paragraphs"]["by_chars"] > DUPLICATE_PARAGRAPH_CHARS)
    )
    for n, limit in TOP_NGRAM_CHARS.items():
        over = over | (m[f"top_{n}"] > limit)
    for n, limit in DUPLICATE_NGRAM_CHARS.items():
        over = over | (m[f"dup_{n}"] > limit)
    return over


def repetition_filter(df: DataFrame) -> DataFrame:
    return repetition_measures(df).where(~is_repetitive(F.col("repetition"))).drop("repetition")


def web_quality_measures(text: Column) -> Column:
    """Shares of ended, short and repeated lines and newlines per word, as one struct."""
    lines = F.filter(F.split(F.trim(text), "\n"), lambda x: F.trim(x) != "")

    def measures(parts: Column) -> Column:
        n = F.greatest(F.size(parts), F.lit(1))
        share = lambda test: F.size(F.filter(parts, test)) / n
        letters = F.greatest(_total_length(parts), F.lit(1))
        return F.struct(
            share(lambda x: F.trim(x).rlike("[.!?\"'…]$")).alias("ended"),
            share(lambda x: F.length(x) < SHORT_LINE).alias("short"),
            ((letters - F.greatest(_total_length(F.array_distinct(parts)), F.lit(1))) / letters).alias("repeated"),
            ((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))) / F.greatest(F.size(fn.words_of(text)), F.lit(1))).alias("newlines"),
        )

    return let(lines, measures)


def web_quality_filter(df: DataFrame) -> DataFrame:
    """Published limits for web text; issue and paper sources skip this filter."""
    good = lambda m: (
        (m["ended"] >= MIN_ENDED_LINES) & (m["short"] <= MAX_SHORT_LINES)
        & (m["repeated"] <= MAX_REPEATED_LINE_CHARS) & (m["newlines"] <= MAX_NEWLINES_PER_WORD)
    )
    return df.where(let(web_quality_measures(F.col("text")), good))


def token_count_filter(df: DataFrame, low: int = MIN_TOKENS, high: int = MAX_TOKENS) -> DataFrame:
    """Bounds inclusive. Counts words and punctuation marks, not subword tokens."""
    return df.withColumn("token_count", fn.token_count(F.col("text"))).where(F.col("token_count").between(low, high))


def slug_frequency_filter(df: DataFrame, limit: int = 10, order: str = "id") -> DataFrame:
    """Rows whose slug occurs fewer than ``limit`` times.

    Only ``limit`` rows of a slug leave a map task (a ranked limit), so a slug that makes up a
    third of the corpus costs nothing; a slug with ``limit`` survivors is dropped.
    """
    by_slug = Window.partitionBy("slug")
    first = df.withColumn("_at", F.row_number().over(by_slug.orderBy(order))).where(F.col("_at") <= limit)
    return first.withColumn("_n", F.count(F.lit(1)).over(by_slug)).where(F.col("_n") < limit).drop("_at", "_n")


def build_url_corpus(pages: DataFrame, language: str = "en") -> DataFrame:
    """(id, url, text, slug, token_count, source) of pages whose URL names a slug and whose text is fit."""
    named = pages.withColumn("slug", fn.extract_slug(F.col("url"))).where("slug IS NOT NULL")
    fit = token_count_filter(repetition_filter(language_filter(named, language)))
    return slug_frequency_filter(fit).select("id", "url", "text", "slug", "token_count", F.lit("web").alias("source"))


def take_per_source(df: DataFrame, quotas: dict[str, int], source: str = "source", order: str = "id") -> DataFrame:
    """The first rows of each source, by a unique integer id, up to its quota."""
    quota = F.create_map(*[x for s, n in quotas.items() for x in (F.lit(s), F.lit(n))])
    listed = df.where(F.col(source).isin(list(quotas)))
    ranked = rank_within(listed, [source], order, "_rank")
    return ranked.where(F.col("_rank") <= F.try_element_at(quota, F.col(source))).drop("_rank")


def cluster_vectors(df: DataFrame, id_column: str, vector: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """(id, cluster) by k-means; k is the square root of the rows, at least 200."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(id_column).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if k is None:
        k = max(200, int(rows.count() ** 0.5))
    model = KMeans(k=k, seed=seed, maxIter=20, initSteps=2).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"))


def assign_splits(clustered: DataFrame, order: Column, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Whole clusters to train until it has its share, then to val, then to test.

    ``order`` permutes the clusters. Near copies share a cluster and so a split. The running sum
    is over one row per cluster.
    """
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    total = clustered.agg(F.count(F.lit(1))).scalar()
    before = F.coalesce(
        F.sum("n").over(Window.orderBy(order, "cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    split = (
        F.when(before < F.floor(total * F.lit(train)), "train")
        .when(before < F.floor(total * F.lit(train + val)), "val")
        .otherwise("test")
    )
    return clustered.join(sizes.select("cluster", split.alias("split")), "cluster")


def cluster_split(df: DataFrame, id_column: str, vector: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """(id, split, cluster) of vectors, leakage-free by cluster."""
    clustered = cluster_vectors(df, id_column, vector, k, seed)
    return assign_splits(clustered, F.xxhash64(F.col("cluster"), F.lit(seed))).select("id", "split", "cluster")


def split_report(splits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows per split, and how many of them have a slug."""
    slugs = corpus.where("slug IS NOT NULL").select("id").withColumn("_slug", F.lit(True))
    return splits.join(slugs, "id", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count("_slug").alias("with_slug")
    )


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Rows, mean tokens, distinct slugs and vocabulary size."""
    words = corpus.select(F.explode(F.split("slug", "-")).alias("w")).agg(F.countDistinct("w")).scalar()
    return corpus.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.sum("token_count") / F.count("token_count")).alias("mean_tokens"),
        F.countDistinct("slug").alias("slugs"),
    ).withColumn("vocabulary", words)


def slug_lengths(corpus: DataFrame) -> DataFrame:
    """Slugs by word count, with their share in percent."""
    total = corpus.agg(F.count(F.lit(1))).scalar()
    counted = corpus.groupBy(F.size(F.split("slug", "-")).alias("words")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.col("n") / total * 100)


def stopword_density(corpus: DataFrame) -> DataFrame:
    """Mean, median, 90th percentile and maximum of the stopword share of slugs."""
    share = corpus.select(fn.stopword_share(F.split("slug", "-")).alias("s"))
    return share.agg(
        (F.sum("s") / F.count("s")).alias("mean"), F.percentile("s", F.lit(0.5)).alias("median"),
        F.percentile("s", F.lit(0.9)).alias("p90"), F.max("s").alias("max"),
    )


def source_by_length(samples: DataFrame, buckets: list[str]) -> DataFrame:
    """Samples by source and length bucket, buckets as columns."""
    bucketed = samples.withColumn("bucket", fn.length_bucket(F.col("token_count")))
    return bucketed.groupBy("source").pivot("bucket", buckets).count().na.fill(0, buckets)


def pack_batches(docs: DataFrame, limit: int, width: int = 4096) -> DataFrame:
    """Batch number per document, in id order, of about ``limit`` tokens each.

    A batch is the slice of the running token sum a document starts in. Unlike greedy filling a
    batch may pass the limit by its last document.
    """
    ranged = docs.withColumn("_range", F.floor(F.col("id") / F.lit(width)))
    scanned = prefix_scan(ranged, [], "_range", ["id"], F.col("token_count"), "_sum")
    batch = F.floor((F.col("_sum") - F.col("token_count")) / F.lit(limit))
    return scanned.withColumn("batch", batch).drop("_sum", "_range")


def three_way_split(corpus: DataFrame, splits: DataFrame, embeddings: DataFrame, split: str) -> DataFrame:
    """Corpus rows of one split with their embedding."""
    chosen = splits.where(F.col("split") == split).select("id")
    return corpus.join(chosen, "id").join(embeddings, "id")


def resume_missing(source: DataFrame, done: DataFrame) -> DataFrame:
    """Rows that were not processed yet."""
    return source.join(done.select("id"), "id", "left_anti")


def outside_split(predictions: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """How many predictions have an id outside the split; 0 is fine."""
    known = splits.where(F.col("split") == split).select("id")
    return predictions.join(known, "id", "left_anti").agg(F.count(F.lit(1)).alias("outside"))


def distilled_labels(corpus: DataFrame, written: DataFrame) -> DataFrame:
    """Corpus rows with their first valid written label (by attempt)."""
    label = written.withColumn("slug", fn.clean_label(F.col("label"))).where("slug IS NOT NULL")
    first = label.groupBy("id").agg(F.min_by("slug", "attempt").alias("slug"))
    return corpus.drop("slug").join(first, "id")


def union_test_ids(splits: list[DataFrame]) -> DataFrame:
    """Distinct test ids over the splits of several encoders."""
    ids = None
    for part in splits:
        rows = part.where("split = 'test'").select("id")
        ids = rows if ids is None else ids.unionByName(rows)
    return ids.distinct()


# Runs of letters and digits; those of three or more ASCII ones may stand in a slug.
WORD_RUN = re.compile(r"[^\W_]+")


def keyword_slugs(docs: DataFrame, words: int, by_letters: bool = False) -> DataFrame:
    """(id, slug): the most frequent plain words of a whole text, most frequent first.

    With ``by_letters`` a word weighs its count times its length. Ties go by spelling. Words are
    counted inside their row, so nothing is shuffled.
    """

    @F.pandas_udf("string")
    def slug(texts: pd.Series) -> pd.Series:
        def best(text: str | None) -> str | None:
            counts = Counter(WORD_RUN.findall((text or "").lower()))
            # A lower-cased run of ASCII letters and digits; looked at once per distinct word.
            weight = {w: n * len(w) if by_letters else n for w, n in counts.items() if len(w) > 2 and w.isascii()}
            return "-".join(sorted(weight, key=lambda w: (-weight[w], w))[:words]) or None

        return texts.map(best)

    return docs.select("id", slug("text").alias("slug")).where("slug IS NOT NULL")
