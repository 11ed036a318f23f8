"""Appended metrics over several micro-batches and runs: late rows, resumption, equality with the batch form."""

import datetime

import pytest
from pyspark.sql import functions as F

from harborlens.operators.metrics import agg_step, get_step
from harborlens.streaming import metrics

OUTPUTS = {"rows": [agg_step("count")], "most": [get_step("value"), agg_step("max")]}
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def write(spark, path, rows):
    """One file of (hour since the start, value)."""
    frame = spark.createDataFrame([(START + datetime.timedelta(hours=h), float(v)) for h, v in rows], "ts TIMESTAMP, value DOUBLE")
    frame.coalesce(1).write.mode("append").parquet(path)


def run(spark, folder):
    stream = metrics.stream_metrics(metrics.read_events(spark, f"{folder}/in", 1), OUTPUTS, late="2 hours")
    query = metrics.append_final(stream, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return query


def steps(frame):
    return {int((r.step_start.astimezone(datetime.timezone.utc) - START).days): (r.rows, r.most) for r in frame.collect()}


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_steps_are_appended_once_and_late_rows_left_out(spark, folder):
    write(spark, f"{folder}/in", [(1, 5), (2, 7), (23, 1)])
    write(spark, f"{folder}/in", [(25, 2), (22, 9)])  # within the two hours of the newest, 23
    write(spark, f"{folder}/in", [(50, 3)])  # the first day is over from here on
    write(spark, f"{folder}/in", [(51, 4)])
    write(spark, f"{folder}/in", [(3, 100)])  # too late: the batch before had seen the day end
    query = run(spark, folder)
    assert len([p for p in query.recentProgress if p.numInputRows]) == 5
    written = spark.read.parquet(f"{folder}/out")
    assert written.groupBy("step_start").count().where("count > 1").isEmpty()
    assert steps(written) == {0: (4.0, 9.0), 1: (1.0, 2.0)}
    now = metrics.steps_so_far(spark.read.parquet(f"{folder}/in"), written.select("step_start", *OUTPUTS), OUTPUTS)
    assert steps(now) == {0: (4.0, 9.0), 1: (1.0, 2.0), 2: (2.0, 4.0)}


def test_a_later_run_reads_new_files_only(spark, folder):
    rows = [[(h, h % 7) for h in range(24 * day, 24 * day + 24, 3)] for day in range(6)]
    for day in rows[:3]:
        write(spark, f"{folder}/in", day)
    assert sum(p.numInputRows for p in run(spark, folder).recentProgress) == 24
    first = steps(spark.read.parquet(f"{folder}/out"))
    for day in rows[3:]:
        write(spark, f"{folder}/in", day)
    assert sum(p.numInputRows for p in run(spark, folder).recentProgress) == 24  # the old files are not read again
    assert sum(p.numInputRows for p in run(spark, folder).recentProgress) == 0
    final = spark.read.parquet(f"{folder}/out").select("step_start", *OUTPUTS)
    assert first.items() <= steps(final).items() and len(steps(final)) > len(first)
    events = spark.read.parquet(f"{folder}/in")
    batch = metrics.stream_metrics(events, OUTPUTS)
    assert steps(metrics.steps_so_far(events, final, OUTPUTS)) == steps(batch) and len(steps(batch)) == 6


def test_nothing_appended_yet(spark, folder):
    write(spark, f"{folder}/in", [(1, 5)])
    events = spark.read.parquet(f"{folder}/in")
    none = metrics.stream_metrics(events.limit(0), OUTPUTS)
    assert steps(metrics.steps_so_far(events, none, OUTPUTS)) == {0: (1.0, 5.0)}


# Patches of entities and change logs

from harborlens.streaming import patches  # noqa: E402


def send(spark, folder, rows):
    spark.createDataFrame(rows, "entity_id STRING, seq BIGINT, patch STRING").coalesce(1).write.mode("append").parquet(f"{folder}/patches")


def add(path, value):
    return f'[{{"op": "add", "path": "/{path}", "value": {value}}}]'


def fold(spark, folder, **options):
    stream = metrics.read_events(spark, f"{folder}/patches", 1)
    patches.fold_patches(stream, folder, f"{folder}/fold-checkpoint", **options).awaitTermination()
    log = patches.ChangeLog(f"{folder}/documents", ["entity_id"], "version")
    return {r.entity_id: (r.version, r.document) for r in log.read(spark).collect()}


def test_patches_are_folded_in_order_over_batches_and_runs(spark, folder):
    send(spark, folder, [("a", 2, add("x", 2)), ("a", 1, add("x", 1)), ("b", 1, add("y", 1)), ("c", 1, "broken")])
    send(spark, folder, [("a", 3, '[{"op": "remove", "path": "/x"}]'), ("a", 4, '[{"op": "remove", "path": "/x"}]'), ("c", 2, None)])
    assert fold(spark, folder, compact_every=2) == {"a": (3, "{}"), "b": (1, '{"y": 1}')}
    send(spark, folder, [("b", 2, add("z", 5)), ("d", 1, add("x", '"' + "l" * 200 + '"'))])
    assert fold(spark, folder, compact_every=2, max_bytes=100) == {"a": (3, "{}"), "b": (2, '{"y": 1, "z": 5}')}
    published = {(r.entity_id, r.seq): (r.version, r.error is None) for r in spark.read.parquet(f"{folder}/published").collect()}
    assert published == {
        ("a", 1): (1, True), ("a", 2): (2, True), ("a", 3): (3, True), ("a", 4): (3, False), ("b", 1): (1, True),
        ("b", 2): (2, True), ("c", 1): (0, False), ("d", 1): (0, False),
    }


def test_one_entity_with_very_many_patches(spark, folder):
    """More rows than an Arrow batch holds many times over; the result has all of them, in order."""
    rows = spark.range(200_000).selectExpr(
        "'hot' AS entity_id", "id AS seq", """CONCAT('[{"op": "add", "path": "/', id % 7, '", "value": ', id, '}]') AS patch"""
    )
    rows.repartition(16, "seq").write.parquet(f"{folder}/patches")
    stream = metrics.read_events(spark, f"{folder}/patches")
    patches.fold_patches(stream, folder, f"{folder}/fold-checkpoint").awaitTermination()
    row = patches.ChangeLog(f"{folder}/documents", ["entity_id"], "version").read(spark).first()
    import json
    assert row.version == 200_000 and json.loads(row.document) == {str(k): max(i for i in range(199_990, 200_000) if i % 7 == k) for k in range(7)}


def test_change_log_writes_changes_and_merges(spark, folder):
    log = patches.ChangeLog(f"{folder}/log", ["k"], "version", every=3)
    frame = lambda rows: spark.createDataFrame(rows, "k STRING, version BIGINT, v STRING")
    log.append(frame([(f"k{i}", 1, "a") for i in range(100)]), 0)
    for batch in range(1, 5):
        log.append(frame([("k1", batch + 1, f"b{batch}"), ("k1", batch, "old")]), batch)
    log.append(frame([("k2", 0, "older")]), 5)
    log.append(frame([("k1", 6, "b4 again")]), 4)  # a repeated batch overwrites its own rows
    now = {r.k: (r.version, r.v) for r in log.read(spark).collect()}
    assert len(now) == 100 and now["k2"] == (1, "a") and now["k3"] == (1, "a")
    written = {(r.kind, r.batch): r["count"] for r in spark.read.parquet(f"{folder}/log").groupBy("kind", "batch").count().collect()}
    assert written[("change", 1)] == written[("change", 5)] == 1 and written[("base", 2)] == written[("base", 5)] == 100
    assert {r.k: r.version for r in log.read(spark, 3).collect()}["k1"] == 3
