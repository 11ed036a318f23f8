"""Named metrics over entity state: filter, get, aggregate.

A metric is a list of steps, for example ``[filter("kind", "eq", "click"), get("value"), agg("sum")]``
with the helpers below, or the same as dicts (``{"op": "filter", ...}``). All metrics of a request
become aggregate expressions of one ``groupBy``, so the state is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from harborlens.operators.scan import exact_quantiles, salted_join

COMPARISONS = ("eq", "neq", "lt", "lte", "gt", "gte")
AGGREGATES = ("count", "sum", "min", "max", "mean")
# Two units in the last place, as a relative tolerance for comparing doubles.
TOLERANCE = 4.5e-16


def filter_step(field: str, comparison: str, value) -> dict:
    return {"op": "filter", "field": field, "comparison": comparison, "value": value}


def get_step(field: str | int) -> dict:
    return {"op": "get", "field": field}


def agg_step(name: str) -> dict:
    return {"op": name}


def check_metric(name: str, steps: list[dict], needs_aggregate: bool = True) -> None:
    """All problems of a definition in one error."""
    problems = []
    ops = [s.get("op") for s in steps]
    if not ops:
        problems.append("has no steps")
    for i, step in enumerate(steps):
        op = ops[i]
        if op == "filter":
            if i and ops[i - 1] != "filter":
                problems.append(f"step {i}: a filter follows only filters")
            if step.get("comparison") not in COMPARISONS:
                problems.append(f"step {i}: unknown comparison {step.get('comparison')!r}")
            elif step.get("value") is None and step["comparison"] not in ("eq", "neq"):
                problems.append(f"step {i}: null compares only with eq and neq")
        elif op == "get":
            if i and ops[i - 1] not in ("filter", "get"):
                problems.append(f"step {i}: get follows only filter and get")
        elif op in AGGREGATES:
            if i != len(steps) - 1:
                problems.append(f"step {i}: {op} must come last")
            if op != "count" and "get" not in ops[:i]:
                problems.append(f"step {i}: {op} needs a get before it")
        else:
            problems.append(f"step {i}: unknown operation {op!r}")
    if needs_aggregate and ops and ops[-1] not in AGGREGATES:
        problems.append("does not end in an aggregate")
    if problems:
        raise ValueError(f"metric {name}: " + "; ".join(problems))


def _same_number(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(TOLERANCE)


def compare(field: Column, comparison: str, value, kind: T.DataType | None = None) -> Column:
    """A field against a literal. A null field fails every comparison except ``neq``."""
    if value is None:
        return field.isNull() if comparison == "eq" else field.isNotNull()
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        field = field.try_cast("double" if number else "boolean")
    literal = F.lit(float(value)) if number else F.lit(value)
    if number:
        field = field.cast("double")
    tests = {
        "eq": lambda: _same_number(field, literal) if number else field == literal,
        "neq": lambda: ~_same_number(field, literal) if number else field != literal,
        "lt": lambda: field < literal,
        "lte": lambda: field <= literal,
        "gt": lambda: field > literal,
        "gte": lambda: field >= literal,
    }
    test = tests[comparison]()
    if number:
        # NaN equals and orders against nothing.
        test = F.when(F.isnan(field), F.lit(comparison == "neq")).otherwise(test)
    return F.coalesce(test, F.lit(comparison == "neq"))


def get(value: Column, kind: T.DataType, field: str | int) -> tuple[Column, T.DataType]:
    """A part of a struct, map, list or JSON text; null when it is missing."""
    if isinstance(kind, T.StructType):
        if field not in kind.fieldNames():
            return F.lit(None), T.NullType()
        return value.getField(field), kind[field].dataType
    if isinstance(kind, T.MapType):
        return F.try_element_at(value, F.lit(field)), kind.valueType
    if isinstance(kind, T.ArrayType):
        return F.get(value, F.lit(int(field))), kind.elementType
    if isinstance(kind, T.StringType):
        path = f"$[{field}]" if isinstance(field, int) else f"$['{field}']"
        return F.get_json_object(value, path), T.StringType()
    return F.lit(None), T.NullType()


def compile_metric(steps: list[dict], schema: T.StructType) -> tuple[Column, Column | None, str | None]:
    """(row predicate, value or None, aggregate or None) of a metric."""
    keep, value, kind, aggregate = F.lit(True), None, None, None
    for step in steps:
        if step["op"] == "filter":
            field = step["field"]
            keep = keep & compare(F.col(field), step["comparison"], step["value"], schema[field].dataType)
        elif step["op"] == "get":
            if value is None:
                value, kind = F.col(step["field"]), schema[step["field"]].dataType
            else:
                value, kind = get(value, kind, step["field"])
        else:
            aggregate = step["op"]
    if value is not None:
        value = F.when(keep, value.try_cast("double"))
    return keep, value, aggregate


def _finite(value: Column) -> Column:
    """NaN and infinite results count as missing."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def aggregate_expression(keep: Column, value: Column | None, aggregate: str) -> Column:
    """One aggregate: sum of nothing is 0, min, max and mean of nothing are null."""
    if aggregate == "count":
        return (F.count_if(keep) if value is None else F.count(value)).cast("double")
    number = F.when(~F.isnan(value), value)
    if aggregate == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    if aggregate == "mean":
        return F.sum(value) / F.count(value)
    return _finite(F.min(number) if aggregate == "min" else F.max(number))


def metric_expressions(outputs: dict[str, list[dict]], schema: T.StructType) -> list[Column]:
    expressions = []
    for name, steps in outputs.items():
        check_metric(name, steps)
        expressions.append(aggregate_expression(*compile_metric(steps, schema)).alias(name))
    return expressions


def metrics(state: DataFrame, outputs: dict[str, list[dict]], by: list[str]) -> DataFrame:
    """Every output per step, from one scan and one shuffle."""
    return state.groupBy(*by).agg(*metric_expressions(outputs, state.schema))


def metrics_long(state: DataFrame, outputs: dict[str, list[dict]], by: list[str]) -> DataFrame:
    """The same as rows (step, metric, value)."""
    wide = metrics(state, outputs, by)
    return wide.unpivot(by, list(outputs), "metric", "value")


def metric_list(
    state: DataFrame, steps: list[dict], by: list[str], order: str, width: int = 1024
) -> DataFrame:
    """The values of a metric without an aggregate, in row order, with their nulls.

    Lists come in chunks of ``width`` consecutive ids of the unique integer column ``order``, so a
    step of any size stays spread over tasks; chunks sorted by number make the whole list.
    """
    check_metric("list", steps, needs_aggregate=False)
    keep, value, _ = compile_metric(steps, state.schema)
    pair = F.struct(F.col(order).alias("at"), value.alias("value"))
    return (
        state.where(keep)
        .groupBy(*by, F.floor(F.col(order) / F.lit(width)).alias("chunk"))
        .agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))
        .select(*by, "chunk", F.transform("_pairs", lambda p: p["value"]).alias("values"))
    )


def cumulative(series: DataFrame, by: list[str], step: str, how: str, steps: int | None = None) -> DataFrame:
    """Max, min, mean or sum of a per-step value over all steps so far, or the last n steps."""
    start = Window.unboundedPreceding if steps is None else -(steps - 1)
    window = Window.partitionBy(*by).orderBy(step).rowsBetween(start, 0)
    if how == "mean":
        total = F.sum("value").over(window) / F.count("value").over(window)
    elif how in ("max", "min", "sum"):
        total = {"max": F.max, "min": F.min, "sum": F.sum}[how]("value").over(window)
    else:
        raise ValueError(f"unknown aggregate {how!r}")
    return series.withColumn(how, total)


def metric_slice(series: DataFrame, by: list[str], step: str, start: int | None, stop: int | None) -> DataFrame:
    """series[start:stop] per run, with negative positions counted from the end."""
    whole = Window.partitionBy(*by)
    numbered = series.withColumn("_at", F.row_number().over(whole.orderBy(step)) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(whole)
    )
    position = lambda p: F.lit(p) if p >= 0 else F.col("_n") + F.lit(p)
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("_at") >= position(start))
    if stop is not None:
        keep = keep & (F.col("_at") < position(stop))
    return numbered.where(keep).drop("_at", "_n")


def collate(series: DataFrame, parameters: list[str]) -> DataFrame:
    """Series of all runs, labelled with their parameters and sorted by label and step."""
    parts = [F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in parameters]
    return series.withColumn("label", F.concat_ws(", ", *parts)).orderBy("label", "step")


def box_data(df: DataFrame, by: str, value: str) -> DataFrame:
    """Five numbers per group for a box plot."""
    return exact_quantiles(df, by, value, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; bin 0 lies below the range and bin bins+1 above."""
    bucket = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    return df.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def surface(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Mean of z over each (x, y) of two swept parameters."""
    return df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(
        (F.sum(z) / F.count(z)).alias("z"), F.count(F.lit(1)).alias("n")
    )


def project_scopes(
    df: DataFrame, retain_hidden: bool = False, retain_private: bool = False,
    hidden: str = "__hidden_", private: str = "__private_",
) -> DataFrame:
    """Drop columns whose prefix marks them hidden or private."""
    kept = [
        name for name in df.columns
        if (retain_hidden or not name.startswith(hidden)) and (retain_private or not name.startswith(private))
    ]
    return df.select(*kept)


def route_messages(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """Deliver each message to the agents whose id or name is among its recipients.

    Every mention delivers, so an agent named twice gets the message twice. Matches by id sort
    before matches by name.
    """
    mentions = messages.select("message_id", "sender", F.posexplode("recipients").alias("position", "key"))
    keys = agents.select(F.col("agent_id").alias("key"), "agent_id", F.lit(0).alias("by_name")).unionByName(
        agents.where("agent_name IS NOT NULL").select(
            F.col("agent_name").alias("key"), "agent_id", F.lit(1).alias("by_name")
        )
    )
    # An agent may be named in most of the messages, so its key is salted.
    return salted_join(mentions, keys, ["key"]).select("message_id", "sender", "position", "agent_id", "by_name")
