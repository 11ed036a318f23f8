"""Attached datasets, nested analysis reports and nested event records as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True) -> DataFrame:
    """JSON records; a schema saves the inference pass over the files."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line; without a schema every column is text."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


RULE = "id STRING, name STRING, helpUri STRING, shortDescription STRUCT<text: STRING>"
TOOL_PART = f"name STRING, version STRING, rules ARRAY<STRUCT<{RULE}>>"
REPORT_SCHEMA = (
    "version STRING, runs ARRAY<STRUCT<tool STRUCT<"
    f"driver STRUCT<{TOOL_PART}>, extensions ARRAY<STRUCT<{TOOL_PART}>>>>>"
)


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Analysis report files (static analysis interchange format), one document per file or line."""
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", not lines).json(path)


def flatten_reports(reports: DataFrame, *keep: str) -> DataFrame:
    """One row per run, tool part (driver or extension) and rule; parts without rules stay."""
    runs = reports.select(*keep, F.posexplode_outer("runs").alias("run", "_run"))
    driver = F.array(F.struct(F.lit("driver").alias("part"), F.col("_run.tool.driver").alias("tool")))
    extensions = F.transform(
        F.coalesce(F.col("_run.tool.extensions"), F.array()),
        lambda e: F.struct(F.lit("extension").alias("part"), e.alias("tool")),
    )
    parts = runs.select(*keep, "run", F.explode(F.concat(driver, extensions)).alias("_part"))
    return parts.select(
        *keep, "run", F.col("_part.part").alias("part"), F.col("_part.tool.name").alias("tool"),
        F.col("_part.tool.version").alias("version"), F.explode_outer("_part.tool.rules").alias("_rule"),
    ).select(
        *keep, "run", "part", "tool", "version", F.col("_rule.id").alias("rule_id"),
        F.col("_rule.name").alias("rule_name"), F.col("_rule.shortDescription.text").alias("description"),
    )


def adapt_nested_events(df: DataFrame, repo: Column, number: Column, events: str = "events") -> DataFrame:
    """Text of the first 'opened' event (title, blank line, body) under the id ``repo#number``."""
    opened = F.get(F.filter(events, lambda e: e["action"] == "opened"), F.lit(0))
    title = F.coalesce(F.trim(opened["title"]), F.lit(""))
    body = F.coalesce(F.trim(opened["text"]), F.lit(""))
    text = F.when((title != "") & (body != ""), F.concat(title, F.lit("\n\n"), body)).when(title != "", title).otherwise(body)
    return df.select(
        F.concat(repo, F.lit("#"), number.cast("string")).alias("id"), title.alias("title"), text.alias("text")
    )
