"""A training corpus from documents: filter, deduplicate, decontaminate, mix, shard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.llm import decontam, mixing, sharding, simhash, toxicity
from harborlens.llm.common import hidden, table
from harborlens.session import scratch_path

USED = ("doc_id", "text", "source")


def shielded(work: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """Apply ``work`` with all columns it does not use under neutral names, so that none can clash.

    The columns of ``docs`` come back as they were; a new one whose name is taken gets an underscore.
    """
    aside = {c: c if c in USED else f"__other_{i}" for i, c in enumerate(docs.columns)}
    done = work(docs.select(*[F.col(f"`{c}`").alias(aside[c]) for c in docs.columns]))
    new = [c for c in done.columns if c not in aside.values()]
    return done.select(
        *[F.col(aside[c]).alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(new, hidden(docs, *new))]
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5, by a classifier fitted on the labels of ``docs``.

    Null and empty texts have the base score and stay. Without documents or labels nothing is rejected.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))

    def work(rows: DataFrame) -> DataFrame:
        return toxicity.add_scores(rows, model, out="__score", keep_text=True).where(F.col("__score") < 0.5).select(*rows.columns)

    return shielded(work, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id (a null id is the smallest)."""
    return shielded(simhash.keep_one, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item within a fifth of its words. Null and empty texts stay."""
    items = table(spark, sf_dir, "benchmark")

    def work(rows: DataFrame) -> DataFrame:
        return decontam.find_items(rows, items).where(F.size("hits") == 0).select(*rows.columns)

    return shielded(work, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: from not at all to three times."""
    return shielded(lambda rows: mixing.repeat(mixing.mix(rows), rows.columns), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with size, text_crc32, shard (0 to 23, equal bytes, in order of id) and slot."""
    return shielded(lambda rows: sharding.shard_by_bytes(rows, shards=24), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A classifier, hash graphs and edit distances: SQL cannot say this; the tests hold it against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
