"""Parameter grids, sampled parameters and what-if evaluation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.functions.draws import hash_draw


def linspace(start: float, stop: float, n: int) -> list[float]:
    step = (stop - start) / max(1, n - 1)
    return [start + step * i for i in range(n)]


def arange(start: float, stop: float, increment: float) -> list[float]:
    """From start up to and including stop."""
    if increment <= 0:
        raise ValueError("the increment must be positive")
    return [start + increment * i for i in range(int((stop - start) / increment + 1e-9) + 1)]


def param_grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """Every combination of the listed values, one row per variant.

    The run number is written in the mixed radix of the axis lengths, so the grid is a range with
    computed columns, not a join.
    """
    size = 1
    for values in axes.values():
        size *= len(values)
    grid = spark.range(size).withColumnRenamed("id", "run")
    columns, width = [], size
    for name, values in axes.items():
        width //= len(values)
        position = F.pmod(F.floor(F.col("run") / F.lit(width)), F.lit(len(values))).cast("int")
        columns.append(F.get(F.array(*[F.lit(v) for v in values]), position).alias(name))
    return grid.select("run", *columns)


def group_plans(plans: list[DataFrame]) -> DataFrame:
    """Plans one after another: fields a plan does not set stay null."""
    rows = None
    for number, plan in enumerate(plans):
        part = plan.withColumn("plan", F.lit(number))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows


def sample_parameter(ids: DataFrame, key: str, field: str, distribution: str, seed: int = 0, **p: float) -> DataFrame:
    """One draw per row of ``ids``: normal, log-normal, poisson, beta or gamma.

    Normal draws are expressions over hash draws (Box-Muller). The others need rejection, so they
    run in Arrow batches with a generator per row key; both ignore the partitioning.
    """
    if distribution in ("normal", "log-normal"):
        u = F.greatest(hash_draw(key, seed=seed, tag=field + " radius"), F.lit(5e-7))
        angle = hash_draw(key, seed=seed, tag=field + " angle") * F.lit(2 * np.pi)
        unit = F.sqrt(-2 * F.log(u)) * F.cos(angle)
        if distribution == "normal":
            return ids.withColumn(field, F.lit(p.get("mean", 1.0)) + F.lit(p.get("std", 1.0)) * unit)
        return ids.withColumn(field, F.exp(F.lit(p.get("mu", 1.0)) + F.lit(p.get("sigma", 1.0)) * unit))
    draws = {
        "poisson": lambda g: g.poisson(p.get("rate", 1.0)),
        "beta": lambda g: g.beta(p.get("alpha", 1.0), p.get("beta", 1.0)),
        "gamma": lambda g: g.gamma(p.get("shape", 1.0), p.get("scale", 1.0)),
    }
    if distribution not in draws:
        raise ValueError(f"unknown distribution {distribution!r}")
    draw = draws[distribution]

    @F.pandas_udf("double")
    def sampled(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: float(draw(np.random.Generator(np.random.Philox(key=[seed, k & (2**64 - 1)])))))

    return ids.withColumn(field, sampled(F.xxhash64(key, F.lit(field))))


def what_if(
    facts: DataFrame, variants: list[dict], metric: Callable[[dict], Column], by: list[str]
) -> DataFrame:
    """A metric under every variant of the parameters, collated by run.

    ``metric(variant)`` is an aggregate expression. All variants are aggregates of one groupBy:
    the facts are read and shuffled once, whatever the number of variants.
    """
    names = [f"run_{i}" for i in range(len(variants))]
    wide = facts.groupBy(*by).agg(*[metric(v).alias(n) for v, n in zip(variants, names)])
    long = wide.unpivot(by, names, "run", "value")
    labels = [", ".join(f"{k}={v}" for k, v in variant.items()) for variant in variants]
    number = F.substring_index("run", "_", -1).cast("int")
    return long.select(
        *by, number.alias("run"), F.get(F.array(*[F.lit(x) for x in labels]), number).alias("label"), "value"
    )
