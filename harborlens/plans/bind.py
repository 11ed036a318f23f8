"""Which of the given tables plays which role, as DataFrames and as the same text in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.plans.registry import Tables

CODE_SQL = """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '101'
    WHEN l_returnflag = 'R' THEN '561' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '261'
    WHEN l_returnflag = 'A' THEN '551' WHEN l_linestatus = 'F' THEN '601' ELSE '641' END"""

LEDGER_SQL = f"""ledger AS (SELECT l_orderkey AS doc, l_linenumber AS item, l_partkey AS material,
    l_suppkey AS plant, CAST(l_shipdate AS DATE) AS posted, l_quantity AS qty,
    CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'H' END AS flag, {CODE_SQL} AS code,
    CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS signed FROM lineitem)"""

STOCK_SQL = """stock AS (SELECT l_partkey AS material, l_suppkey AS plant, SUM(l_quantity) AS stock
    FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)"""

PRICE_SQL = """prices AS (SELECT p_partkey AS material, p_name AS description, p_type AS material_type,
    p_brand AS brand, p_retailprice AS price, CASE WHEN p_size > 25 THEN 10 ELSE 1 END AS unit FROM part)"""


def ledger(t: Tables) -> DataFrame:
    """Movements: returned lines book in, all others book out."""
    return t.lineitem.selectExpr(
        "l_orderkey AS doc", "l_linenumber AS item", "l_partkey AS material", "l_suppkey AS plant",
        "CAST(l_shipdate AS DATE) AS posted", "l_quantity AS qty",
        "CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'H' END AS flag", f"{CODE_SQL} AS code",
    )


def stock(t: Tables) -> DataFrame:
    """Stock on hand: quantity of finished lines by material and plant."""
    return (
        t.lineitem.where("l_linestatus = 'F'")
        .groupBy(F.col("l_partkey").alias("material"), F.col("l_suppkey").alias("plant"))
        .agg(F.sum("l_quantity").alias("stock"))
    )


def prices(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "p_partkey AS material", "p_name AS description", "p_type AS material_type", "p_brand AS brand",
        "p_retailprice AS price", "CASE WHEN p_size > 25 THEN 10 ELSE 1 END AS unit",
    )
