"""Metrics and quality checks over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harborlens.operators.metrics import metric_expressions
from harborlens.operators.quality import run_checks


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files; the schema is that of the files present now.

    The path may be a folder or a glob; a single file needs a glob that matches it.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_metrics(
    events: DataFrame, outputs: dict[str, list[dict]], time: str = "ts", step: str = "1 day",
    slide: str | None = None, late: str = "1 hour", by: list[str] | None = None,
) -> DataFrame:
    """The metrics of each step, a tumbling (or sliding) window over event time.

    The aggregate expressions are those of the batch form. Events later than ``late`` behind the
    newest are dropped, and only then is a step final.
    """
    span = F.window(time, step, slide) if slide else F.window(time, step)
    grouped = events.withWatermark(time, late).groupBy(span.alias("window"), *(by or []))
    wide = grouped.agg(*metric_expressions(outputs, events.schema))
    return wide.select(F.col("window.start").alias("step_start"), *(by or []), *outputs)


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every changed row of each micro-batch, tagged with the batch number, until the input is used up.

    A batch that is repeated after a failure overwrites its own folder, so rows appear once.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


def append_final(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every step once, when the watermark has passed its end, until the input is used up.

    The open steps are the query's state and go on in the next run with the same checkpoint, which reads
    new files only. A row of a step that the watermark of the batch before had passed already is late and
    left out. A batch that is repeated after a failure overwrites its own folder.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


def steps_so_far(
    events: DataFrame, final: DataFrame, outputs: dict[str, list[dict]], time: str = "ts", step: str = "1 day",
) -> DataFrame:
    """The appended steps and, behind them, the open ones as the events say now.

    Only events from the end of the last appended step on are evaluated; the bound is one value that
    reaches the scan.
    """
    last = final.agg(F.max(F.col("step_start") + F.expr(f"INTERVAL {step}"))).first()[0]
    unseen = events if last is None else events.where(F.col(time) >= F.lit(last))
    return final.unionByName(stream_metrics(unseen, outputs, time, step))


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key among the written batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in ("batch", *keys)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


def stream_quality(events: DataFrame, name: str, checks: list[dict], path: str, checkpoint: str) -> StreamingQuery:
    """The configured checks on every micro-batch, one folder of results per batch.

    Row counts and nulls are also observed, for listeners that watch the query's progress.
    """
    columns = sorted({c for check in checks if check["type"] == "no_nulls" for c in check["columns"]})
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns]
    watched = events.observe(f"quality_{name}", F.count(F.lit(1)).alias("rows"), *nulls)

    def check(rows: DataFrame, batch: int) -> None:
        results = run_checks({name: rows}, [{"table": name, "checks": checks}])
        results.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return watched.writeStream.option("checkpointLocation", checkpoint).foreachBatch(check).trigger(availableNow=True).start()
