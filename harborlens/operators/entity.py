"""Queries over typed entities.

``entities`` has ``entity_id``, ``type_id`` (a versioned type URL), ``properties`` (JSON text) and,
for links, ``left_id`` and ``right_id``. Clauses are boolean columns over that frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.functions import json_path as jp
from harborlens.session import cut_lineage


@dataclass(frozen=True)
class Path:
    """A path into the properties, e.g. Path("address", "city")."""

    steps: tuple

    def __init__(self, *steps: str | int):
        object.__setattr__(self, "steps", steps)


def _operand(side) -> Column:
    if isinstance(side, Path):
        return jp.read_value(F.col("properties"), *side.steps)
    if isinstance(side, Column):
        return side
    return jp.literal_value(side)


def _keys(value: Column) -> Column:
    return F.transform(jp.as_array(value), jp.sort_key)


def value_match(left: Column, condition: str, right: Column) -> Column:
    """Two variants under a condition; false when either is missing, also for not_equals.

    equals, not_equals, less, less_or_equals, greater and greater_or_equals compare by kind first
    (null, boolean, number, string, array, object). contains, starts_with and ends_with work on
    strings and arrays, and contains on the keys of objects.
    """
    return jp.let(jp.sort_key(left), lambda a: jp.let(jp.sort_key(right), lambda b: _keyed_match(left, a, condition, right, b)))


def _keyed_match(left: Column, a: Column, condition: str, right: Column, b: Column) -> Column:
    simple = {
        "equals": lambda: a == b,
        "not_equals": lambda: a != b,
        "less": lambda: a < b,
        "less_or_equals": lambda: a <= b,
        "greater": lambda: a > b,
        "greater_or_equals": lambda: a >= b,
    }
    if condition in simple:
        return F.coalesce(simple[condition](), F.lit(False))
    strings = (a["kind"] == 3) & (b["kind"] == 3)
    if condition == "contains":
        hit = (
            F.when(strings, F.contains(a["text"], b["text"]))
            .when(a["kind"] == 4, F.array_contains(_keys(left), b))
            .when((a["kind"] == 5) & (b["kind"] == 3), F.array_contains(F.map_keys(jp.as_map(left)), b["text"]))
        )
    elif condition in ("starts_with", "ends_with"):
        arrays = (a["kind"] == 4) & (b["kind"] == 4)
        n = F.size(_keys(right))
        start = F.lit(1) if condition == "starts_with" else F.greatest(F.size(_keys(left)) - n + 1, F.lit(1))
        text = F.startswith if condition == "starts_with" else F.endswith
        hit = (
            F.when(strings, text(a["text"], b["text"]))
            .when(arrays, (F.size(_keys(left)) >= n) & (F.slice(_keys(left), start, n) == _keys(right)))
        )
    else:
        raise ValueError(f"unknown condition {condition!r}")
    return F.coalesce(hit, F.lit(False))


def property_match(left, condition: str, right) -> Column:
    """A property predicate; each side is a Path, a variant column or a plain value."""
    return jp.let(_operand(left), lambda a: jp.let(_operand(right), lambda b: value_match(a, condition, b)))


def any_element_match(path: Path, condition: str, value) -> Column:
    """True when any element of the array at the path fulfils the condition."""
    elements = jp.as_array(_operand(path))
    return F.coalesce(F.exists(elements, lambda e: value_match(e, condition, jp.literal_value(value))), F.lit(False))


def all_of(*clauses: Column) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def any_of(*clauses: Column) -> Column:
    return reduce(lambda a, b: a | b, clauses, F.lit(False))


def negate(clause: Column) -> Column:
    return ~clause


def attribute_match(left: Column, condition: str, right) -> Column:
    """A filter on entity attributes: equal, not_equal, starts_with, ends_with, contains_segment.

    Either side may be a column or a parameter. Missing values fail every condition.
    """
    right = right if isinstance(right, Column) else F.lit(right)
    tests = {
        "equal": lambda: left == right,
        "not_equal": lambda: left != right,
        "starts_with": lambda: F.startswith(left, right),
        "ends_with": lambda: F.endswith(left, right),
        "contains_segment": lambda: F.contains(left, right),
    }
    if condition not in tests:
        raise ValueError(f"unknown condition {condition!r}")
    return F.coalesce(tests[condition](), F.lit(False))


def base_url(type_id: Column) -> Column:
    """The type URL without its version: ``https://x/order/v/2`` gives ``https://x/order/``."""
    return F.regexp_extract(type_id, "^(.*/)v/[0-9]+$", 1)


def version(type_id: Column) -> Column:
    return F.regexp_extract(type_id, "/v/([0-9]+)$", 1).try_cast("int")


def type_match(entities: DataFrame, ids: list[str], types: list[str], descendants: DataFrame | None = None) -> DataFrame:
    """Entities with a listed id, or a listed type, or a type among ``descendants(type_id)``."""
    hit = F.col("entity_id").isin(ids) | F.col("type_id").isin(types)
    if descendants is None:
        return entities.where(hit)
    inherited = descendants.select("type_id").distinct().withColumn("_inherits", F.lit(True))
    marked = entities.join(inherited, "type_id", "left")
    return marked.where(hit | F.coalesce("_inherits", F.lit(False))).select(*entities.columns)


def dynamic_match(entities: DataFrame, predicate: Callable[[DataFrame], Column]) -> DataFrame:
    """Entities for which the caller's column expression holds."""
    return entities.where(predicate(entities))


def python_predicate(function: Callable[[dict], bool]) -> Callable[[DataFrame], Column]:
    """A Python predicate over the parsed properties, run in Arrow batches."""
    import json

    @F.pandas_udf("boolean")
    def check(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: bool(function(json.loads(d))) if d is not None else False)

    return lambda entities: check(entities["properties"])


def linked_match(entities: DataFrame, links: DataFrame, clause: Column, end: str = "right") -> DataFrame:
    """Entities with a link whose entity at the other end fulfils the clause."""
    near, far = ("left_id", "right_id") if end == "right" else ("right_id", "left_id")
    targets = entities.where(clause).select(F.col("entity_id").alias(far))
    hits = links.join(targets, far, "left_semi").select(F.col(near).alias("entity_id"))
    return entities.join(hits, "entity_id", "left_semi")


@dataclass(frozen=True)
class Statement:
    """An entity clause with optional clauses on the ends of a link."""

    entity: Column
    left: Column | None = None
    right: Column | None = None


def _matched_ids(entities: DataFrame, statements: list[Statement]) -> DataFrame:
    """Ids that match any statement. All clauses are judged in one scan, whose flags are written once."""
    clauses = {
        f"_{side}{i}": clause
        for i, s in enumerate(statements) for side, clause in (("entity", s.entity), ("left", s.left), ("right", s.right)) if clause is not None
    }
    flags = entities.select("entity_id", "left_id", "right_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in clauses.items()])
    flags = cut_lineage(flags.where(any_of(*map(F.col, clauses))))
    found = None
    for i in range(len(statements)):
        rows = flags.where(F.col(f"_entity{i}"))
        for side in ("left", "right"):
            if f"_{side}{i}" in clauses:
                ends = flags.where(F.col(f"_{side}{i}")).select(F.col("entity_id").alias(f"{side}_id"))
                rows = rows.join(ends, f"{side}_id", "left_semi")
        ids = rows.select("entity_id")
        found = ids if found is None else found.unionByName(ids)
    return found


def select(entities: DataFrame, statements: list[Statement]) -> DataFrame:
    """Entities matching any statement; calls one after another intersect."""
    return entities.join(_matched_ids(entities, statements), "entity_id", "left_semi")


def select_complement(entities: DataFrame, statements: list[Statement]) -> DataFrame:
    return entities.join(_matched_ids(entities, statements), "entity_id", "left_anti")


def select_properties(entities: DataFrame, clause: Column, include: bool, keys: list[str]) -> DataFrame:
    """Reduce the properties of matching entities.

    Start from all keys (``include``) and drop the listed ones, or from none and keep them.
    """
    listed = F.array(*[F.lit(k) for k in keys])
    kept = F.map_filter(
        jp.as_map(F.try_parse_json("properties")),
        lambda k, v: ~F.array_contains(listed, k) if include else F.array_contains(listed, k),
    )
    return entities.withColumn("properties", F.when(clause, F.to_json(kept)).otherwise(F.col("properties")))


def update_properties(entities: DataFrame, clause: Column, changes: list[tuple[list[str], object]]) -> DataFrame:
    """Set values at paths that already exist; which entities match is decided before any change."""
    members = jp.as_map(F.try_parse_json("properties"))
    for steps, value in changes:
        members = jp.set_path(members, steps, jp.literal_value(value))
    return entities.withColumn("properties", F.when(clause, F.to_json(members)).otherwise(F.col("properties")))


def latest_version(revisions: DataFrame, key: str, revision: str) -> DataFrame:
    """The newest revision per entity: a partial aggregate, so long histories need no sort."""
    row = F.struct(*[F.col(c) for c in revisions.columns])
    return revisions.groupBy(key).agg(F.max_by(row, F.col(revision)).alias("_row")).select("_row.*")


def temporal_slice(
    df: DataFrame, pinned: tuple[str, str], at: Column, variable: tuple[str, str], start: Column | None, end: Column,
) -> DataFrame:
    """Rows whose pinned interval holds ``at`` and whose other interval overlaps [start, end].

    Intervals include their start and exclude their end; a null end is open. A null ``start`` is
    unbounded. The caller passes the present as ``at`` or ``end`` where it is meant.
    """
    open_end = lambda name, t: F.col(name).isNull() | (F.col(name) > t)
    keep = (F.col(pinned[0]) <= at) & open_end(pinned[1], at) & (F.col(variable[0]) <= end)
    if start is not None:
        keep = keep & open_end(variable[1], start)
    return df.where(keep)


def entity_edges(entities: DataFrame) -> DataFrame:
    """left -> link and link -> right edges; ends that are no entity become nodes all the same."""
    links = entities.where("left_id IS NOT NULL AND right_id IS NOT NULL")
    into = links.select(F.col("left_id").alias("src"), F.col("entity_id").alias("dst"), F.lit("left").alias("side"))
    out = links.select(F.col("entity_id").alias("src"), F.col("right_id").alias("dst"), F.lit("right").alias("side"))
    return into.unionByName(out)


def group_by_property(entities: DataFrame, name: str) -> DataFrame:
    """Entities per value of a property, sorted by label."""
    label = F.coalesce(jp.read_text(F.col("properties"), name), F.lit("Unknown"))
    return entities.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("entities")).orderBy("label")


def count_links(entities: DataFrame, links: DataFrame, label: str, direction: str = "outgoing") -> DataFrame:
    """Links per entity with zeros, labelled with a property or 'Unknown'."""
    near = "left_id" if direction == "outgoing" else "right_id"
    counted = links.groupBy(F.col(near).alias("entity_id")).agg(F.count(F.lit(1)).alias("links"))
    name = F.coalesce(jp.read_text(F.col("properties"), label), F.lit("Unknown"))
    return entities.join(counted, "entity_id", "left").select(
        "entity_id", name.alias("label"), F.coalesce("links", F.lit(0)).alias("links")
    )
