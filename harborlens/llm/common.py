"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
LOWEST = -(2**63)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which a cluster sets in proportion to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts cross to Python in batches of few rows, so that a worker holds some megabytes of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def hidden(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the frame has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_order(column: str | Column) -> Column:
    """The id as a long; a null id counts as the lowest."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(LOWEST))


def id_ranges(df: DataFrame, order: Column, ranges: int) -> Callable[[Column], Column]:
    """A function from an id to the number of its range, 0 to ranges - 1, in the order of the ids.

    The bounds are approximate quantiles (at most 4,096, so what the driver and the tasks hold is
    bounded). Where they fall changes the work's balance only, never a result.
    """
    ranges = max(1, min(4096, ranges))
    at = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(order, F.array(*map(F.lit, at)), F.lit(20 * ranges)).alias("q")).first().q if at else []
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="right").astype(np.int32))

    return range_of


def slices(rows: int, sizes: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most_bytes`` at most; a longer row makes a run of its own."""
    start = total = 0
    for i in range(rows):
        if i > start and total + sizes[i] > most_bytes:
            yield start, i
            start, total = i, 0
        total += int(sizes[i])
    if rows > start:
        yield start, rows
