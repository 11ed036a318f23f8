"""Per-step metrics on the events table: a step is a day, a run is all of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlens.operators import metrics as ops
from harborlens.operators.metrics import agg_step, filter_step, get_step
from harborlens.plans.registry import Tables, query

STATE_SQL = """state AS (SELECT *, CAST(ts AS DATE) AS step, CASE WHEN event_type <> 'view' THEN value END AS score,
    CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)"""


def state(t: Tables):
    """Agent state with a nullable number, a flag, a list and JSON properties."""
    return t.events.selectExpr(
        "event_id", "user_id", "event_type", "value", "props", "CAST(ts AS DATE) AS step",
        "CASE WHEN event_type <> 'view' THEN value END AS score", "value > 20 AS big",
        "ARRAY(value, CAST(user_id AS DOUBLE)) AS pair", "NAMED_STRUCT('who', user_id, 'what', value) AS body",
    )


OUTPUTS = {
    "agents": [agg_step("count")],
    "clicks": [filter_step("event_type", "eq", "click"), agg_step("count")],
    "not_views": [filter_step("score", "neq", None), agg_step("count")],
    "score_not_five": [filter_step("score", "neq", 5.0), agg_step("count")],
    "large": [filter_step("big", "eq", True), get_step("event_id"), agg_step("count")],
    "min_score": [get_step("score"), agg_step("min")],
    "max_click": [filter_step("event_type", "eq", "click"), get_step("body"), get_step("what"), agg_step("max")],
    "sum_user": [get_step("pair"), get_step(1), agg_step("sum")],
    "mean_k": [filter_step("value", "lte", 50), get_step("props"), get_step("k"), agg_step("mean")],
    "missing": [get_step("body"), get_step("absent"), agg_step("sum")],
}
METRICS_SQL = f"""{STATE_SQL}, series AS (SELECT step, CAST(COUNT(*) AS DOUBLE) AS agents,
    CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) AS clicks,
    CAST(COUNT(score) AS DOUBLE) AS not_views,
    CAST(SUM(CASE WHEN score IS NULL OR score <> 5 THEN 1 ELSE 0 END) AS DOUBLE) AS score_not_five,
    CAST(SUM(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS DOUBLE) AS large, MIN(score) AS min_score,
    MAX(CASE WHEN event_type = 'click' THEN value END) AS max_click, CAST(SUM(user_id) AS DOUBLE) AS sum_user,
    SUM(CASE WHEN value <= 50 THEN k END) / COUNT(CASE WHEN value <= 50 THEN k END) AS mean_k,
    CAST(0 AS DOUBLE) AS missing FROM state GROUP BY step)"""


@query("metrics", f"WITH {METRICS_SQL} SELECT * FROM series")
def metrics(t: Tables):
    return ops.metrics(state(t), OUTPUTS, ["step"])


@query(
    "metrics_long",
    f"""WITH {METRICS_SQL} SELECT step, metric, value FROM (UNPIVOT series ON clicks, not_views, large
    INTO NAME metric VALUE value)""",
)
def metrics_long(t: Tables):
    wanted = {name: OUTPUTS[name] for name in ("clicks", "not_views", "large")}
    return ops.metrics_long(state(t), wanted, ["step"])


@query(
    "metric_filter",
    f"""WITH {STATE_SQL} SELECT event_id, event_type, score FROM state
    WHERE (score IS NULL OR score <> 10) AND value >= 5 AND event_type <> 'error'""",
)
def metric_filter(t: Tables):
    rows = state(t)
    steps = [filter_step("score", "neq", 10), filter_step("value", "gte", 5), filter_step("event_type", "neq", "error")]
    keep, _, _ = ops.compile_metric(steps, rows.schema)
    return rows.where(keep).select("event_id", "event_type", "score")


@query(
    "metric_get",
    f"""WITH {STATE_SQL} SELECT event_id, value AS what, CAST(user_id AS DOUBLE) AS second, CAST(NULL AS DOUBLE) AS beyond, k
    FROM state""",
)
def metric_get(t: Tables):
    rows = state(t)
    pick = lambda *path: ops.compile_metric([get_step(p) for p in path], rows.schema)[1]
    return rows.select(
        "event_id", pick("body", "what").alias("what"), pick("pair", 1).alias("second"),
        pick("pair", 9).alias("beyond"), pick("props", "k").alias("k"),
    )


@query(
    "metric_list",
    f"""WITH {STATE_SQL} SELECT step, event_id // 1024 AS chunk, list(score ORDER BY event_id) AS "values"
    FROM state WHERE event_type <> 'error' GROUP BY 1, 2""",
)
def metric_list(t: Tables):
    return ops.metric_list(
        state(t), [filter_step("event_type", "neq", "error"), get_step("score")], ["step"], "event_id"
    )


SERIES_SQL = f"""{STATE_SQL}, per_type AS (SELECT event_type AS run, step, CAST(COUNT(*) AS DOUBLE) AS value
    FROM state GROUP BY 1, 2)"""


def series(t: Tables):
    return state(t).groupBy(F.col("event_type").alias("run"), "step").agg(F.count(F.lit(1)).cast("double").alias("value"))


@query(
    "cumulative_sum",
    f"WITH {SERIES_SQL} SELECT *, SUM(value) OVER (PARTITION BY run ORDER BY step) AS sum FROM per_type",
)
def cumulative_sum(t: Tables):
    return ops.cumulative(series(t), ["run"], "step", "sum")


@query(
    "cumulative_mean_range",
    f"""WITH {SERIES_SQL} SELECT *, SUM(value) OVER w / COUNT(value) OVER w AS mean FROM per_type
    WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def cumulative_mean_range(t: Tables):
    return ops.cumulative(series(t), ["run"], "step", "mean", steps=7)


@query(
    "metric_slice",
    f"""WITH {SERIES_SQL}, numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY step) - 1 AS pos,
    COUNT(*) OVER (PARTITION BY run) AS n FROM per_type) SELECT run, step, value FROM numbered WHERE pos >= 3 AND pos < n - 5""",
)
def metric_slice(t: Tables):
    return ops.metric_slice(series(t), ["run"], "step", 3, -5)


@query(
    "collated_series",
    f"WITH {SERIES_SQL} SELECT *, 'run=' || run AS label FROM per_type",
)
def collated_series(t: Tables):
    return ops.collate(series(t), ["run"])


@query(
    "box_data",
    """SELECT event_type, MIN(value) AS low, ROUND(quantile_cont(value, 0.25), 6) AS q1, ROUND(quantile_cont(value, 0.5), 6) AS median,
    ROUND(quantile_cont(value, 0.75), 6) AS q3, MAX(value) AS high FROM events GROUP BY 1""",
)
def box_data(t: Tables):
    box = ops.box_data(t.events, "event_type", "value")
    return box.select("event_type", "low", "high", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


@query(
    "histogram",
    """SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE FLOOR(value / 5) + 1 END AS BIGINT) AS bin,
    COUNT(*) AS n FROM events GROUP BY 1""",
)
def histogram(t: Tables):
    return ops.histogram(t.events, "value", 0.0, 100.0, 20)


@query(
    "surface",
    f"""WITH {STATE_SQL} SELECT user_id AS x, step AS y, CAST(SUM(CAST(k AS BIGINT)) AS DOUBLE) / COUNT(k) AS z, COUNT(*) AS n
    FROM state GROUP BY 1, 2""",
)
def surface(t: Tables):
    rows = state(t).withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    return ops.surface(rows, "user_id", "step", "k")


@query("project_scopes", "SELECT event_id, user_id FROM events")
def project_scopes(t: Tables):
    marked = t.events.selectExpr("event_id", "user_id", "value AS __hidden_value", "props AS __private_props")
    return ops.project_scopes(marked)


@query(
    "route_messages",
    """WITH agents AS (SELECT CAST(c_custkey AS VARCHAR) AS agent_id, c_mktsegment || '-' || (c_custkey // 100) AS agent_name
    FROM customer), mentions AS (SELECT event_id AS message_id, event_type AS sender, position, key FROM events,
    (VALUES (0), (1), (2)) p(position), LATERAL (SELECT CASE position WHEN 1 THEN 'BUILDING-' || (user_id // 10)
      ELSE CAST(user_id AS VARCHAR) END AS key))
    SELECT message_id, sender, CAST(position AS INTEGER) AS position, agent_id, 0 AS by_name FROM mentions JOIN agents ON key = agent_id
    UNION ALL SELECT message_id, sender, CAST(position AS INTEGER), agent_id, 1 FROM mentions JOIN agents ON key = agent_name""",
)
def route_messages(t: Tables):
    messages = t.events.selectExpr(
        "event_id AS message_id", "event_type AS sender",
        "ARRAY(CAST(user_id AS STRING), CONCAT('BUILDING-', user_id DIV 10), CAST(user_id AS STRING)) AS recipients",
    )
    agents = t.customer.selectExpr(
        "CAST(c_custkey AS STRING) AS agent_id", "CONCAT(c_mktsegment, '-', c_custkey DIV 100) AS agent_name"
    )
    return ops.route_messages(messages, agents)
