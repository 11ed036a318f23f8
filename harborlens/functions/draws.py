"""Reproducible pseudo-random draws that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52


def hash_draw(*key: str | Column, seed: int = 0, tag: str = "") -> Column:
    """A number in [0, 1) that is a function of the row key, the seed and the tag only.

    The first 52 bits of the MD5 of key, seed and tag, joined by bars: draws for different tags are
    independent, and every SQL engine can repeat them. Null parts of a key count as a tilde.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in key]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns], F.lit(str(seed)), F.lit(tag))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long") / F.lit(float(2**BITS))


def draw_sql(*key: str, seed: int = 0, tag: str = "") -> str:
    """The same in DuckDB, for keys that are not null."""
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"(CAST('0x' || substr(md5({text} || '|{seed}|{tag}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def pick(draw: Column, *choices: Column) -> Column:
    """One of the choices, by where the draw in [0, 1) falls."""
    index = F.floor(draw * F.lit(len(choices))).cast("int")
    return F.element_at(F.array(*choices), index + F.lit(1))
