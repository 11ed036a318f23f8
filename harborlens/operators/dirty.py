"""Deliberately dirty copies of tables.

Every choice is a draw in [0, 1) that the caller derives from the row key (``hash_draw``), so a table comes out the same however it is partitioned. ``draw(tag)`` returns the
draw for one purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.functions.draws import hash_draw, pick
from harborlens.functions.text import padded

Draw = Callable[[str], Column]


def row_draw(*key: str, seed: int = 0) -> Draw:
    return lambda tag: hash_draw(*key, seed=seed, tag=tag)


def _replace(df: DataFrame, column: str, chosen: Column, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(chosen, value).otherwise(F.col(column)))


def dirty_keys(df: DataFrame, columns: list[str], rate: float, draw: Draw) -> DataFrame:
    """Text keys with a leading zero, stray spaces, lower case or lost leading zeros."""
    for name in columns:
        text = F.col(name)
        variant = pick(
            draw(name + " variant"),
            F.concat(F.lit("0"), text),
            F.concat(F.lit(" "), text),
            F.concat(text, F.lit(" ")),
            F.lower(text),
            F.ltrim(text, F.lit("0")),
            F.concat(F.lit("  "), text, F.lit("  ")),
        )
        df = _replace(df, name, draw(name) < rate, variant)
    return df


def dirty_dates(df: DataFrame, columns: list[str], rate: float, draw: Draw) -> DataFrame:
    """yyyyMMdd text rewritten as DD/MM/YYYY, MM-DD-YYYY, ISO or dotted."""
    for name in columns:
        text = F.col(name)
        year, month, day = F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)
        variant = pick(
            draw(name + " variant"),
            F.concat_ws("/", day, month, year),
            F.concat_ws("-", month, day, year),
            F.concat_ws("-", year, month, day),
            F.concat_ws(".", day, month, year),
        )
        df = _replace(df, name, (draw(name) < rate) & (F.length(text) == 8), variant)
    return df


def inject_orphans(df: DataFrame, column: str, row_id: Column, rate: float, draw: Draw, prefix: str = "ORPHAN") -> DataFrame:
    """Chosen rows get a key no parent has: the prefix and the row's own number."""
    made = F.concat(F.lit(prefix + "_"), padded(row_id, 6))
    return _replace(df, column, draw(column + " orphan") < rate, made)


def inject_duplicates(df: DataFrame, rate: float, draw: Draw) -> DataFrame:
    """Repeat the rows drawn up to the rate, or the row with the lowest draw when there are none."""
    drawn = df.withColumn("_draw", draw("duplicate"))
    limit = drawn.agg(F.greatest(F.min("_draw"), F.lit(float(rate)))).scalar()
    return df.unionByName(drawn.where(F.col("_draw") <= limit).drop("_draw"))


def inject_nulls(df: DataFrame, columns: list[str], rate: float, draw: Draw) -> DataFrame:
    for name in columns:
        df = _replace(df, name, draw(name + " null") < rate, F.lit(None))
    return df


def apply_dirty(df: DataFrame, config: dict, draw: Draw, row_id: Column) -> DataFrame:
    """All kinds in a fixed order: keys, dates, orphans, duplicates, nulls."""
    df = dirty_keys(df, config.get("keys", []), config.get("key_rate", 0.05), draw)
    df = dirty_dates(df, config.get("dates", []), config.get("date_rate", 0.05), draw)
    for column in config.get("orphans", []):
        df = inject_orphans(df, column, row_id, config.get("orphan_rate", 0.03), draw)
    if config.get("duplicate_rate", 0) > 0:
        df = inject_duplicates(df, config["duplicate_rate"], draw)
    return inject_nulls(df, config.get("nulls", []), config.get("null_rate", 0.02), draw)
