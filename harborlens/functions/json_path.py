"""Reading, comparing and guarded writing of paths in JSON documents."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How values of different kinds order against each other.
KIND_ORDER = ["null", "boolean", "number", "string", "array", "object"]


def json_path(*steps: str | int) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def read_text(document: Column, *steps: str | int) -> Column:
    """The value at the path as text, null when the path is missing."""
    return F.get_json_object(document, json_path(*steps))


def read_number(document: Column, *steps: str | int) -> Column:
    return read_text(document, *steps).try_cast("double")


def read_value(document: Column, *steps: str | int) -> Column:
    """The value at the path as a variant: it keeps its kind (number, string, array ...)."""
    return F.try_variant_get(F.try_parse_json(document), json_path(*steps), "variant")


def literal_value(value) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def as_map(value: Column) -> Column:
    """The members of a variant object, null for any other kind."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def kind_rank(value: Column) -> Column:
    """Position of a variant's kind in ``KIND_ORDER``; null when there is no value."""
    return let(
        F.schema_of_variant(value),
        lambda name: F.when(name == "VOID", 0)
        .when(name == "BOOLEAN", 1)
        .when(name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), 2)
        .when(name == "STRING", 3)
        .when(name.startswith("ARRAY"), 4)
        .when(name.startswith("OBJECT"), 5),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once per row, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sort_key(value: Column) -> Column:
    """A struct that compares as the value does: by kind, then number, then text."""

    def key(rank: Column) -> Column:
        number = F.when(rank == 2, F.try_variant_get(value, "$", "double")).otherwise(F.lit(0.0))
        text = F.when(rank == 2, F.lit("")).when(rank == 3, F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
        return F.when(rank.isNotNull(), F.struct(rank.alias("kind"), number.alias("number"), F.coalesce(text, F.lit("")).alias("text")))

    return let(kind_rank(value), key)


def set_path(members: Column, steps: list[str], value: Column) -> Column:
    """Replace the value at a path of a ``map<string,variant>``, only where the path exists."""
    head, rest = steps[0], steps[1:]
    if rest:
        inner = lambda old: F.coalesce(F.to_variant_object(set_path(as_map(old), rest, value)), old)
    else:
        inner = lambda old: value
    return F.transform_values(members, lambda k, v: F.when(k == head, inner(v)).otherwise(v))
