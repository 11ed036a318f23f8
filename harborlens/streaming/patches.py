"""Entity documents kept by streams of JSON patches, subscriptions and resumable work."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PATCH_OUTPUT = "entity_id STRING, version BIGINT, patch STRING, document STRING, error STRING"
PATCH_STATE = "version BIGINT, document STRING"


def _steps(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError(f"bad pointer {pointer!r}")
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]


def _index(parent: list, key: str, end: bool) -> int:
    if key == "-" and end:
        return len(parent)
    at = int(key)
    if not 0 <= at <= len(parent) - (0 if end else 1):
        raise ValueError(f"no element {key}")
    return at


def _lookup(document, steps: list[str]):
    for step in steps:
        document = document[_index(document, step, False)] if isinstance(document, list) else document[step]
    return document


def _put(document, steps: list[str], value, insert: bool):
    if not steps:
        return value
    parent, key = _lookup(document, steps[:-1]), steps[-1]
    if isinstance(parent, list):
        if insert:
            parent.insert(_index(parent, key, True), value)
        else:
            parent[_index(parent, key, False)] = value
    elif insert or key in parent:
        parent[key] = value
    else:
        raise ValueError(f"no member {key!r}")
    return document


def _take(document, steps: list[str]):
    parent, key = _lookup(document, steps[:-1]), steps[-1]
    return parent.pop(_index(parent, key, False)) if isinstance(parent, list) else parent.pop(key)


def apply_patch(document: str, patch: str) -> str:
    """The document after a JSON patch (add, remove, replace, move, copy, test); all or nothing."""
    value = json.loads(document)
    for op in json.loads(patch):
        kind, steps = op["op"], _steps(op["path"])
        if kind in ("add", "replace"):
            value = _put(value, steps, op["value"], insert=kind == "add")
        elif kind == "remove":
            _take(value, steps)
        elif kind == "move":
            value = _put(value, steps, _take(value, _steps(op["from"])), insert=True)
        elif kind == "copy":
            copied = json.loads(json.dumps(_lookup(value, _steps(op["from"]))))
            value = _put(value, steps, copied, insert=True)
        elif kind == "test":
            if _lookup(value, steps) != op["value"]:
                raise ValueError(f"test failed at {op['path']}")
        else:
            raise ValueError(f"unknown operation {kind!r}")
    return json.dumps(value, sort_keys=True)


#: Rows that a fold hands on at a time; each carries the whole document.
OUTPUT_ROWS = 256


def stream_entity_patches(patches: DataFrame, idle_hours: float | None = None, max_bytes: int | None = None) -> DataFrame:
    """Apply the patches of each entity in order and publish every one with the new document.

    ``patches`` has entity_id, seq and patch (JSON text). A patch that can not be applied, or makes
    the document larger than ``max_bytes``, is published with its error and changes nothing.
    The patches of an entity in a micro-batch are folded in order of ``seq``, however many Arrow
    chunks they come in: a task holds those of one entity, which the trigger's limits bound.

    With ``idle_hours`` the documents of entities idle that long are dropped, by processing time.
    Such a stream never runs out of timeouts to check, so it needs a periodic trigger: one that
    stops when the input is used up would not stop.
    """
    timeout = None if idle_hours is None else int(idle_hours * 3_600_000)
    kind = GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.ProcessingTimeTimeout

    def fold(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, document = state.get if state.exists else (0, "{}")
        ordered = pd.concat([chunk[["seq", "patch"]] for chunk in chunks]).sort_values("seq", kind="stable")["patch"]
        for start in range(0, len(ordered), OUTPUT_ROWS):
            out = []
            for patch in ordered[start:start + OUTPUT_ROWS]:
                error = None
                try:
                    changed = apply_patch(document, patch)
                    if max_bytes is not None and len(changed) > max_bytes:
                        raise ValueError("document too large")
                    document, version = changed, version + 1
                except (ValueError, KeyError, IndexError, TypeError) as problem:
                    error = str(problem) or type(problem).__name__
                out.append((key[0], version, patch, document, error))
            yield pd.DataFrame(out, columns=["entity_id", "version", "patch", "document", "error"])
        state.update((version, document))
        if timeout is not None:
            state.setTimeoutDuration(timeout)

    return patches.groupBy("entity_id").applyInPandasWithState(
        fold, PATCH_OUTPUT, PATCH_STATE, "append", kind
    )


def fold_replacements(patches: DataFrame) -> DataFrame:
    """(entity_id, path, value): the last value per path, for histories of plain replacements.

    ``patches`` has entity_id, seq, path and value. The last write per path is a partial
    aggregate, so one entity may hold most of the history.
    """
    return patches.groupBy("entity_id", "path").agg(F.max_by("value", "seq").alias("value"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet until its input is used up; a restart goes on from the checkpoint."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def fold_patches(patches: DataFrame, path: str, checkpoint: str, max_bytes: int | None = None, compact_every: int = 20) -> StreamingQuery:
    """Apply the patches of each entity in order; publish every one, and keep the documents in a change log.

    As ``stream_entity_patches``, for entities with any number of patches in a micro-batch: rows are
    sorted by entity and ``seq`` (Spark's sort, which spills) behind the entity's document so far, and a
    task passes over them with one document in hand. Published patches are below ``path``/published,
    without the documents between; documents are read with ``ChangeLog(path/documents)``.
    """
    log = ChangeLog(f"{path}/documents", ["entity_id"], "version", compact_every)
    schema = "entity_id STRING, version BIGINT, patch STRING, error STRING, document STRING, seq BIGINT"

    def fold(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, version, document, changed = None, 0, "{}", False
        for chunk in chunks:
            out = []
            for name, known, seq, patch, held in chunk[["entity_id", "version", "seq", "patch", "document"]].itertuples(index=False):
                if name != entity:
                    if changed:
                        out.append((entity, version, None, None, document, None))
                    entity, version, document, changed = name, 0, "{}", False
                if patch is None:
                    version, document = int(known), held
                    continue
                error = None
                try:
                    after = apply_patch(document, patch)
                    if max_bytes is not None and len(after) > max_bytes:
                        raise ValueError("document too large")
                    document, version, changed = after, version + 1, True
                except (ValueError, KeyError, IndexError, TypeError) as problem:
                    error = str(problem) or type(problem).__name__
                out.append((name, version, patch, error, None, seq))
            yield pd.DataFrame(out, columns=["entity_id", "version", "patch", "error", "document", "seq"])
        if changed:
            yield pd.DataFrame([(entity, version, None, None, document, None)], columns=["entity_id", "version", "patch", "error", "document", "seq"])

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        new = rows.where("patch IS NOT NULL").select("entity_id", F.lit(None).cast("bigint").alias("version"), "seq", "patch", F.lit(None).cast("string").alias("document"))
        if batch > 0:
            held = log.read(spark, batch).join(new.select("entity_id").distinct(), "entity_id", "left_semi")
            new = new.unionByName(held.select("entity_id", "version", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("patch"), "document"))
        ordered = new.repartition("entity_id").sortWithinPartitions("entity_id", F.col("patch").isNotNull(), "seq")
        folder = f"{path}/folded/batch={batch}"
        ordered.mapInPandas(fold, schema).write.mode("overwrite").parquet(folder)  # folded once, read twice
        folded = spark.read.parquet(folder)
        folded.where("patch IS NOT NULL").select("entity_id", "version", "seq", "patch", "error").write.mode("overwrite").parquet(f"{path}/published/batch={batch}")
        log.append(folded.where("document IS NOT NULL").select("entity_id", "version", "document"), batch)

    return patches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()


class ChangeLog:
    """The latest row per key as a log: each micro-batch appends what it changed, and readers merge.

    A batch writes its changes only. Every ``every`` batches the merged rows are written as a new base, and
    readers need that base and the changes behind it. A repeated batch overwrites its own folders.
    Folders before the newest base are not read any more and may be removed while nobody reads.
    """

    def __init__(self, path: str, keys: list[str], order: str, every: int = 20):
        self.path, self.keys, self.order, self.every = path, keys, order, every

    def _latest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (*self.keys, self.order)]
        row = F.max_by(F.struct(*rows.columns), F.struct(self.order, *others)).alias("_row")
        return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in self.keys]).agg(row).select("_row.*")

    def append(self, rows: DataFrame, batch: int) -> None:
        self._latest(rows).write.mode("overwrite").parquet(f"{self.path}/kind=change/batch={batch}")
        if (batch + 1) % self.every == 0:
            self.read(rows.sparkSession, batch + 1).write.mode("overwrite").parquet(f"{self.path}/kind=base/batch={batch}")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The latest rows, or those of the batches before the given one."""
        rows = spark.read.option("basePath", self.path).parquet(self.path)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        base = rows.where("kind = 'base'").agg(F.max("batch")).first()[0]  # folder names only
        if base is not None:
            rows = rows.where((F.col("batch") > base) | ((F.col("kind") == "base") & (F.col("batch") == base)))
        return self._latest(rows.drop("kind", "batch"))


def subscribe(
    updates: DataFrame, entity_ids: list[str], path: str, checkpoint: str, compact_every: int = 20
) -> StreamingQuery:
    """Keep the latest documents of the subscribed entities as a change log.

    ``updates`` has entity_id, version and document. Each batch appends the entities it changes;
    ``snapshot`` merges them on reading.
    """
    log = ChangeLog(path, ["entity_id"], "version", compact_every)
    wanted = updates.where(F.col("entity_id").isin(entity_ids)).select("entity_id", "version", "document")
    return wanted.writeStream.option("checkpointLocation", checkpoint).foreachBatch(log.append).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The latest documents of a subscription."""
    return ChangeLog(path, ["entity_id"], "version").read(spark)
