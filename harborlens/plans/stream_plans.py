"""Streams over the events table, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlens.operators.metrics import agg_step, filter_step, get_step
from harborlens.plans.registry import Tables, query
from harborlens.session import scratch_path
from harborlens.streaming import metrics, patches

OUTPUTS = {
    "agents": [agg_step("count")],
    "clicks": [filter_step("event_type", "eq", "click"), agg_step("count")],
    "max_value": [get_step("value"), agg_step("max")],
    "users": [get_step("user_id"), agg_step("sum")],
}


def event_stream(t: Tables):
    return metrics.read_events(t.spark, f"{t.folder}/events.parque[t]")


@query(
    "stream_metrics",
    """SELECT date_trunc('day', ts) AS step_start, CAST(COUNT(*) AS DOUBLE) AS agents, CAST(COUNT(*) FILTER (event_type = 'click') AS DOUBLE) AS clicks,
    MAX(value) AS max_value, CAST(SUM(user_id) AS DOUBLE) AS users FROM events GROUP BY 1""",
)
def stream_metrics(t: Tables):
    path = scratch_path(t.spark, "stream-metrics")
    stream = metrics.stream_metrics(event_stream(t).withColumn("ts", F.col("ts").cast("timestamp")), OUTPUTS)
    metrics.write_updates(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    rows = metrics.latest_rows(t.spark, f"{path}/out", ["step_start"])
    return rows.withColumn("step_start", F.col("step_start").cast("timestamp_ntz"))


@query(
    "stream_appended_metrics",
    """SELECT date_trunc('day', ts) AS step_start, CAST(COUNT(*) AS DOUBLE) AS agents, CAST(COUNT(*) FILTER (event_type = 'click') AS DOUBLE) AS clicks,
    MAX(value) AS max_value, CAST(SUM(user_id) AS DOUBLE) AS users FROM events GROUP BY 1""",
)
def stream_appended_metrics(t: Tables):
    """Events arrive in three spans of time; each run sees the new files only and appends the steps that are over."""
    path, waves = scratch_path(t.spark, "stream-appended"), 3
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    wave = F.least(F.floor((F.unix_seconds("ts") - F.lit(first)) * waves / F.lit(last - first + 1)), F.lit(waves - 1))
    for n in range(waves):
        events.where(wave == n).write.mode("append").parquet(f"{path}/events")
        stream = metrics.stream_metrics(metrics.read_events(t.spark, f"{path}/events"), OUTPUTS)
        metrics.append_final(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    final = t.spark.read.parquet(f"{path}/out").select("step_start", *OUTPUTS)
    rows = metrics.steps_so_far(t.spark.read.parquet(f"{path}/events"), final, OUTPUTS)
    return rows.withColumn("step_start", F.col("step_start").cast("timestamp_ntz"))


def patch_stream(t: Tables):
    body = """CONCAT('[{"op": "add", "path": "/', event_type, '", "value": ', value, '}]')"""
    return event_stream(t).selectExpr("CAST(user_id AS STRING) AS entity_id", "event_id AS seq", f"{body} AS patch")


def published(t: Tables) -> str:
    path = scratch_path(t.spark, "stream-patches")
    patches.run_to_end(patches.stream_entity_patches(patch_stream(t)), f"{path}/out", f"{path}/checkpoint")
    return f"{path}/out"


@query(
    "stream_entity_patches",
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, COUNT(*) AS version, arg_max(value, event_id) FILTER (event_type = 'click') AS click,
    arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""",
)
def stream_entity_patches(t: Tables):
    final = t.spark.read.parquet(published(t)).groupBy("entity_id").agg(F.max(F.struct("version", "document")).alias("r"))
    pick = lambda name: F.get_json_object("r.document", f"$.{name}").cast("double").alias(name)
    return final.select("entity_id", F.col("r.version").alias("version"), pick("click"), pick("purchase"))


@query(
    "fold_patches",
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, COUNT(*) AS version, arg_max(value, event_id) FILTER (event_type = 'click') AS click,
    arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""",
)
def fold_patches(t: Tables):
    """The same documents by a sorted pass, read from the change log."""
    path = scratch_path(t.spark, "stream-folded")
    patches.fold_patches(patch_stream(t), path, f"{path}/checkpoint").awaitTermination()
    rows = patches.ChangeLog(f"{path}/documents", ["entity_id"], "version").read(t.spark)
    pick = lambda name: F.get_json_object("document", f"$.{name}").cast("double").alias(name)
    return rows.select("entity_id", "version", pick("click"), pick("purchase"))


@query(
    "fold_replacements",
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, '/' || event_type AS path, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""",
)
def fold_replacements(t: Tables):
    return patches.fold_replacements(
        t.events.selectExpr("CAST(user_id AS STRING) AS entity_id", "event_id AS seq", "CONCAT('/', event_type) AS path", "value")
    )


@query(
    "subscribe",
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, COUNT(*) AS version, arg_max(value, event_id) FILTER (event_type = 'view') AS view
    FROM events WHERE user_id IN (1, 2, 3, 4, 5) GROUP BY 1""",
)
def subscribe(t: Tables):
    """Latest documents of five subscribed entities, from the published patches."""
    path = scratch_path(t.spark, "stream-subscribe")
    updates = metrics.read_events(t.spark, published(t))
    patches.subscribe(updates, ["1", "2", "3", "4", "5"], f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return patches.snapshot(t.spark, f"{path}/out").select(
        "entity_id", "version", F.get_json_object("document", "$.view").cast("double").alias("view")
    )


@query("stream_resume", "SELECT event_id, user_id FROM events")
def stream_resume(t: Tables):
    """Two runs over one checkpoint: the second finds nothing left to do."""
    path = scratch_path(t.spark, "stream-resume")
    for _ in range(2):
        patches.run_to_end(event_stream(t).select("event_id", "user_id"), f"{path}/out", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/out")


@query(
    "stream_quality",
    """SELECT 'events' AS "table", 'Volume' AS "check", 'PASS' AS result, 'at least 1 rows' AS message, COUNT(*) AS value, 0 AS batch FROM events
    UNION ALL SELECT 'events', 'Validity', 'FAIL', 'values outside the list in event_type', COUNT(*) FILTER (event_type NOT IN ('click', 'view')), 0 FROM events
    UNION ALL SELECT 'events', 'Null Check', 'PASS', 'nulls in user_id', COUNT(*) FILTER (user_id IS NULL), 0 FROM events""",
)
def stream_quality(t: Tables):
    path = scratch_path(t.spark, "stream-quality")
    checks = [
        {"type": "count", "min": 1},
        {"type": "allowed_values", "column": "event_type", "values": ["click", "view"]},
        {"type": "no_nulls", "columns": ["user_id"]},
    ]
    metrics.stream_quality(event_stream(t), "events", checks, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
