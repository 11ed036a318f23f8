"""The corpus queries on the given tables, and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.llm import (
    decontam, fingerprint, lexical, mixing, packing, passages, sharding, simhash, spelling, suffix, surrogate, toxicity, warc,
)
from harborlens.llm.common import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        LLM_QUERIES[name] = function
        if sql:
            LLM_SQL[name] = sql
        return function

    return register


@query("op2_mix_sources", mixing.MIX_SQL)
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "copies", "taken")


@query("op6_shard_by_bytes")
def op6_shard_by_bytes(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, folder, "documents").select("doc_id", "text"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op7_simhash")
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_piecewise_hash")
def op10_piecewise_hash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, folder, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), length=50)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op8_warc_bundles", warc.READ_BACK_SQL)
def op8_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.archive(table(spark, folder, "pages"), warc.fresh_folder(spark))
    return warc.read_back(index)


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.find_items(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").alias("n_items"),
        F.transform("hits", lambda h: h["item_id"]).alias("item_ids"), F.transform("hits", lambda h: h["edits"]).alias("edits"),
        F.transform("hits", lambda h: h["start"]).alias("first_words"), F.transform("hits", lambda h: h["end"]).alias("end_words"),
    )


@query("op1_repeated_passages")
def op1_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, folder, "documents").select("doc_id", "text"))


@query("op5_pii_surrogates")
def op5_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogate.replace_entities(table(spark, folder, "documents").select("doc_id", "text"))


@query("op11_lexical_search", lexical.SEARCH_SQL)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


@query("op12_pack_sequences")
def op12_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"))


@query("op13_spelling_variants", spelling.VARIANTS_SQL)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))
