"""Prefix sums and skew-safe joins shared by the other operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[str | Column],
    value: Column,
    out: str = "running",
    low: str | None = None,
) -> DataFrame:
    """Running sum of ``value`` per key, inclusive, in two levels.

    ``bucket`` is a coarser, order-preserving column (a day for a time stamp, an id range for an
    id). Rows are scanned within (keys, bucket); the totals of whole buckets are scanned per key
    and added back. One key may hold any share of the rows: no task sees more rows of it than one
    bucket, or one row per bucket. With ``low`` the running minimum of the sum is returned too, and
    as ``<low>_before`` the one up to the row before (null on the first row of a key).
    Null keys are a key, a null bucket comes first.
    """
    parts = [*keys, bucket]
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_inside", F.sum(value).over(inside))
    if low:
        rows = rows.withColumn("_inside_low", F.min("_inside").over(inside)).withColumn(
            "_inside_low_before", F.min("_inside").over(inside.rowsBetween(Window.unboundedPreceding, -1))
        )
        totals = rows.groupBy(*parts).agg(F.sum(value).alias("_sum"), F.min("_inside").alias("_low"))
    else:
        totals = df.groupBy(*parts).agg(F.sum(value).alias("_sum"))
    by_bucket = Window.partitionBy(*keys).orderBy(bucket)
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
    totals = totals.withColumn("_before", before)
    kept = [*parts, "_before"]
    if low:
        totals = totals.withColumn("_prior_low", F.min(F.col("_before") + F.col("_low")).over(earlier))
        kept.append("_prior_low")
    totals = totals.select(*[F.col(p).alias(f"_of_{p}") for p in parts], *kept[len(parts):])
    same = reduce(and_, [F.col(p).eqNullSafe(F.col(f"_of_{p}")) for p in parts])
    joined = rows.join(totals, same).drop(*[f"_of_{p}" for p in parts]).withColumn(out, F.col("_before") + F.col("_inside"))
    if low:
        joined = joined.withColumn(
            f"{low}_before", F.least("_prior_low", F.col("_before") + F.col("_inside_low_before"))
        ).withColumn(low, F.least("_prior_low", F.col("_before") + F.col("_inside_low")))
    return joined.drop("_inside", "_inside_low", "_inside_low_before", "_before", "_prior_low")


def rank_within(df: DataFrame, keys: list[str], order: str, out: str = "rank", width: int = 1024) -> DataFrame:
    """Position 1, 2, ... of each row per key by a unique integer ``order`` column.

    A row number for keys that may hold most of the rows: ranges of ``width`` ids are the buckets
    of a prefix scan.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    return prefix_scan(ranged, keys, "_range", [order], F.lit(1), out).drop("_range")


def exact_quantiles(df: DataFrame, by: str, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles per group, interpolated between neighbours, without holding a group in memory.

    Values are counted first; the counts are summed up in two levels whose buckets are steps of a
    logarithmic scale, and each quantile is the least value with enough rows up to it.
    """
    number = F.col(value).cast("double")
    counts = df.where(F.col(value).isNotNull()).groupBy(by, number.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    step = F.signum("_v") * F.floor(F.lit(32) * F.log2(F.lit(1) + F.abs("_v")))
    scanned = prefix_scan(counts.withColumn("_step", step), [by], "_step", ["_v"], F.col("_n"), "_upto")
    sized = scanned.join(counts.groupBy(by).agg(F.sum("_n").alias("_total")), by)
    picks = []
    for name, p in probabilities.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for end, position in (("low", F.floor(at)), ("high", F.ceil(at))):
            picks.append(F.min(F.when(F.col("_upto") > position, F.col("_v"))).alias(f"_{name}_{end}"))
    found = sized.groupBy(by).agg(F.first("_total").alias("_total"), *picks)
    between = []
    for name, p in probabilities.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        between.append((low + (at - F.floor(at)) * (high - low)).alias(name))
    return found.select(by, *between)


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = 4096
) -> DataFrame:
    """Equi-join whose hot keys are cut into pieces of about ``hot_rows`` left rows.

    Keys with more left rows than that get a salt: left rows take one at random (by hash), right
    rows are repeated once per salt. Other keys join as they are.
    """
    if how not in ("inner", "left"):
        raise ValueError("only the left side is cut, so inner and left joins alone are exact")
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    )
    spread = F.coalesce(F.col("_salts"), F.lit(1))
    cut = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*left.columns), spread).cast("int"))
        .drop("_salts")
    )
    repeated = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), spread - F.lit(1))))
        .drop("_salts")
    )
    return cut.join(repeated, [*keys, "_salt"], how).drop("_salt")
