"""Slug and label expressions. All stay in the JVM as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that count towards a slug's stopword ratio.
STOPWORDS = (
    "a an the and or but of for in on to at by with as from into about between through during "
    "if nor is are was were be been being has have had it its you your my our their them he him "
    "his she her we they how what why when where which who this that these those not no so than very"
).split()

# Words a written label must not contain.
LABEL_STOPWORDS = [
    "the", "a", "an", "of", "for", "in", "on", "to", "and", "or", "is", "it", "with", "by", "at", "as", "be", "are", "was",
    "were", "this", "that", "from", "but", "not", "no",
]

# Limits on slugs and labels.
SLUG_PATTERN = "^[a-z0-9]+(-[a-z0-9]+)*$"
LINK_SLUG_PATTERN = "^[a-z0-9]+([-_][a-z0-9]+)+$"
SITE_PAGES = "^(index|page|post|article|default|category|tag|archive|feed|rss|print|embed)[.](html?|php|aspx?|xml|json)$"
EXTENSION = "[.](html?|php|aspx?|htm|shtml|xml)$"
MAX_STOPWORD_RATIO = 0.4
LARGEST_NUMBER = 31


def split_slug(slug: Column) -> Column:
    """The words of a slug; an empty slug has none."""
    return F.when(slug == "", F.array().cast("array<string>")).otherwise(F.split(slug, "-"))


def word_count(slug: Column) -> Column:
    return F.size(split_slug(slug))


def stopword_share(tokens: Column, stopwords: list[str] | None = None) -> Column:
    words = F.array(*[F.lit(w) for w in (stopwords or STOPWORDS)])
    hits = F.filter(tokens, lambda t: F.array_contains(words, t))
    return F.size(hits) / F.size(tokens)


def extract_slug(url: Column) -> Column:
    """The readable slug of a URL, or null when its path holds none.

    The last path segment that is not a site page, without its extension, must read as three to
    eight hyphenated words with at most one number (up to 31), at least three words of two
    letters or more and a stopword ratio of at most 0.4.
    """
    path = F.try_parse_url(url, F.lit("PATH"))
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~F.lower(s).rlike(SITE_PAGES))
    last = F.get(segments, F.size(segments) - F.lit(1))
    stem = F.regexp_replace(F.lower(last), EXTENSION, "")
    slug = F.regexp_replace(stem, "_", "-")
    tokens = F.split(slug, "-")
    numbers = F.filter(tokens, lambda t: t.rlike("^[0-9]+$"))
    accepted = (
        stem.rlike(LINK_SLUG_PATTERN)
        & F.size(tokens).between(3, 8)
        & (F.size(numbers) < 2)
        & ~F.exists(numbers, lambda t: F.coalesce(t.try_cast("int"), F.lit(LARGEST_NUMBER + 1)) > LARGEST_NUMBER)
        & (F.size(F.filter(tokens, lambda t: F.length(t) > 1)) >= 3)
        & (stopword_share(tokens) <= MAX_STOPWORD_RATIO)
    )
    return F.when(accepted, slug)


def is_valid_slug(slug: Column) -> Column:
    """Well-formed kebab case of 3 to 80 characters and two to eight words."""
    return (
        slug.rlike(SLUG_PATTERN) & F.length(slug).between(3, 80) & F.size(F.split(slug, "-")).between(2, 8)
    )


def clean_label(text: Column) -> Column:
    """A written label in normal form, or null when it breaks a rule."""
    label = F.regexp_replace(F.lower(F.trim(text)), "^[\"'`]+|[\"'`]+$", "")
    tokens = F.split(label, "-")
    stop = F.array(*[F.lit(w) for w in LABEL_STOPWORDS])
    accepted = (
        label.rlike(SLUG_PATTERN)
        & (F.size(tokens) <= 8)
        & ~F.arrays_overlap(tokens, stop)
        & F.length(label).between(3, 80)
    )
    return F.when(accepted, label)


def length_bucket(tokens: Column) -> Column:
    """short, medium or long by token count (lower bound inclusive), else other."""
    return (
        F.when((tokens >= 50) & (tokens < 200), "short")
        .when((tokens >= 200) & (tokens < 500), "medium")
        .when((tokens >= 500) & (tokens < 1000), "long")
        .otherwise("other")
    )


def padded(number: Column, width: int) -> Column:
    """The number with leading zeros up to the width; a longer one keeps all its digits."""
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def stable_id(text: Column) -> Column:
    return F.sha2(text, 256)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits of the whole text."""
    tokens = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")
    return F.filter(tokens, lambda w: w != "")


def token_count(text: Column) -> Column:
    """Words and punctuation marks; an offline stand-in for a subword tokenizer's count."""
    return F.size(F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]"), F.lit(0)))


def jaccard_distance(left: Column, right: Column) -> Column:
    """1 - |a & b| / |a | b| over word sets; two empty sets are at distance 0."""
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.lit(1.0) - shared / union)
