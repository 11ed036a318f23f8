"""Synthetic tables seeded by the given ones, so they grow with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlens.operators import synth
from harborlens.plans.bind import LEDGER_SQL, STOCK_SQL, ledger, stock
from harborlens.plans.impact_plans import lines
from harborlens.plans.ledger_plans import REPLENISHMENT_SQL, day, replenishment_plan
from harborlens.plans.quality_plans import draw_sql, plain_draw
from harborlens.plans.registry import Tables, query


def sales(t: Tables):
    products = t.part.selectExpr("p_partkey AS material", "p_size AS plant", "CASE WHEN p_size <> 9 THEN p_retailprice END AS cost")
    customers = t.customer.selectExpr("c_custkey AS customer")
    return synth.gen_sales(t.orders.selectExpr("o_orderkey AS order_no"), products, customers, day("2002-01-01"), F.lit(1), seed=7)


@query("gen_sales_headers")
def gen_sales_headers(t: Tables):
    return sales(t)[0]


@query("gen_sales_lines")
def gen_sales_lines(t: Tables):
    return sales(t)[1]


DELIVERY_SQL = f"""WITH {STOCK_SQL}, chosen AS (SELECT l_orderkey AS order_no, l_linenumber AS item, l_partkey AS material, l_suppkey AS plant,
    l_quantity AS qty, CAST(l_shipdate AS DATE) AS due FROM lineitem WHERE {draw_sql('l_orderkey', 'deliver')} < 0.8),
    asked AS (SELECT *, SUM(qty) OVER (PARTITION BY material, plant ORDER BY due, order_no, item, qty ROWS UNBOUNDED PRECEDING) AS asked FROM chosen),
    items AS (SELECT order_no AS delivery_no, item, material, plant, GREATEST(0, LEAST(qty, COALESCE(stock, 0) - (asked - qty))) AS qty, due AS issued_on
    FROM asked LEFT JOIN stock USING (material, plant) WHERE GREATEST(0, LEAST(qty, COALESCE(stock, 0) - (asked - qty))) > 0)"""


def deliveries(t: Tables):
    orders = lines(t).selectExpr("order_id AS order_no", "item", "material", "plant", "qty", "due")
    return synth.gen_deliveries(orders, stock(t), 0.8, plain_draw("order_no")("deliver"))


@query("gen_delivery_items", f"{DELIVERY_SQL} SELECT * FROM items")
def gen_delivery_items(t: Tables):
    return deliveries(t)[1]


@query("gen_delivery_headers", f"{DELIVERY_SQL} SELECT delivery_no, MAX(issued_on) AS issued_on, COUNT(*) AS items FROM items GROUP BY 1")
def gen_delivery_headers(t: Tables):
    return deliveries(t)[0]


@query("gen_delivery_flow", f"{DELIVERY_SQL} SELECT delivery_no AS order_no, item, delivery_no, 'C' AS from_kind, 'J' AS to_kind, qty FROM items")
def gen_delivery_flow(t: Tables):
    return deliveries(t)[2]


PLANTS_SQL = """plants AS (SELECT n_nationkey AS plant, (n_nationkey * 37 % 25) * 5.0 - 60 AS lat, (n_nationkey * 91 % 36) * 10.0 - 180 AS lon,
    CASE WHEN n_nationkey % 4 = 0 THEN 'GB' WHEN n_nationkey % 2 = 0 THEN 'DE' ELSE 'US' END AS country, n_nationkey % 3 = 0 AS port FROM nation),
    served AS (SELECT DISTINCT s_nationkey AS origin, c_nationkey AS target FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey),
    lanes AS (SELECT origin || '-' || target AS lane, origin, target, a.country, b.country AS to_country, a.port, b.port AS to_port,
      2 * 6371 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) * sin(radians(b.lat - a.lat) / 2) + cos(radians(a.lat)) * cos(radians(b.lat))
        * sin(radians(b.lon - a.lon) / 2) * sin(radians(b.lon - a.lon) / 2))) AS km
      FROM served JOIN plants a ON a.plant = origin JOIN plants b ON b.plant = target),
    customs AS (SELECT *, CASE WHEN (country = 'GB' AND to_country = 'DE') OR (country = 'DE' AND to_country = 'GB') THEN 1 ELSE 0 END AS days FROM lanes)"""


def plants(t: Tables):
    return t.nation.selectExpr(
        "n_nationkey AS plant", "(n_nationkey * 37 % 25) * 5.0D - 60 AS lat", "(n_nationkey * 91 % 36) * 10.0D - 180 AS lon",
        "CASE WHEN n_nationkey % 4 = 0 THEN 'GB' WHEN n_nationkey % 2 = 0 THEN 'DE' ELSE 'US' END AS country", "n_nationkey % 3 = 0 AS port",
    )


def served(t: Tables):
    """Country pairs that goods travel between, from the order lines."""
    return (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("s_nationkey").alias("origin"), F.col("c_nationkey").alias("target")).distinct()
    )


def lanes(t: Tables):
    return synth.gen_lanes(plants(t), served(t))


@query(
    "gen_lane_modes",
    f"""WITH {PLANTS_SQL}, modes AS (SELECT lane, origin, target, ROUND(km, 6) AS km, mode, ROUND(km / speed + 24 * days, 2) AS hours, ROUND(km * rate, 2) AS cost
    FROM customs, (VALUES ('ROAD', 60.0, 0.5), ('SEA', 25.0, 0.15), ('AIR', 800.0, 3.0)) m(mode, speed, rate)
    WHERE mode <> 'SEA' OR (port AND to_port AND km > 200)),
    best AS (SELECT lane, arg_min(mode, struct_pack(c := cost, m := mode)) AS best FROM modes GROUP BY 1)
    SELECT modes.*, mode = best AS preferred FROM modes JOIN best USING (lane)""",
)
def gen_lane_modes(t: Tables):
    return synth.lane_modes(lanes(t)).withColumn("km", F.round("km", 6))


@query(
    "gen_routes",
    f"""WITH {PLANTS_SQL}, chosen AS (SELECT *, CASE WHEN port AND to_port AND km > 200 THEN 'SEA' WHEN km > 1000 THEN 'AIR' ELSE 'ROAD' END AS mode FROM customs),
    timed AS (SELECT *, km / CASE mode WHEN 'SEA' THEN 25.0 WHEN 'AIR' THEN 800.0 ELSE 60.0 END AS h FROM chosen)
    SELECT lane, 'R' || left(CAST(origin AS VARCHAR), 2) || left(CAST(target AS VARCHAR), 2) AS route, mode, ROUND(km, 2) AS km, ROUND(h, 2) AS hours,
    ROUND(h / 24 + days, 2) AS days FROM timed""",
)
def gen_routes(t: Tables):
    return synth.gen_routes(lanes(t))


@query("gen_shipments")
def gen_shipments(t: Tables):
    items = (
        deliveries(t)[1].join(t.supplier, F.col("plant") == F.col("s_suppkey"))
        .join(t.orders, F.col("delivery_no") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("delivery_no", F.col("s_nationkey").alias("origin"), F.col("c_nationkey").alias("target"), "qty", "issued_on")
    )
    return synth.gen_shipments(items, synth.lane_modes(lanes(t)))


PURCHASE_SQL = f"""{LEDGER_SQL}, used AS (SELECT material, SUM(qty) AS consumed FROM ledger WHERE code = '261' GROUP BY 1),
    vendors AS (SELECT p_partkey AS material, p_size AS vendor, p_retailprice AS price, p_size * 10.0 AS min_qty FROM part),
    bought AS (SELECT material, vendor, CAST(DATE '2002-01-01' + to_months(CAST(m AS INTEGER)) AS DATE) AS ordered,
      GREATEST(CEIL(consumed / 12 / 100) * 100, CAST(min_qty AS DOUBLE)) AS qty, price FROM used JOIN vendors USING (material), range(0, 12) r(m))"""


def purchases(t: Tables):
    used = ledger(t).where("code = '261'").groupBy("material").agg(F.sum("qty").alias("consumed"))
    vendors = t.part.selectExpr("p_partkey AS material", "p_size AS vendor", "p_retailprice AS price", "p_size * 10.0D AS min_qty")
    return synth.gen_purchase_orders(used, vendors, day("2002-01-01"), 12)


@query("gen_purchase_orders", f"WITH {PURCHASE_SQL} SELECT *, ROUND(qty * price, 2) AS net FROM bought")
def gen_purchase_orders(t: Tables):
    return purchases(t)


@query("gen_receipts")
def gen_receipts(t: Tables):
    due = purchases(t).withColumn("due", F.date_add("ordered", 14))
    return synth.gen_receipts(due, ["material", "vendor", "ordered"], seed=11)


@query(
    "gen_planned_orders",
    f"""WITH {REPLENISHMENT_SQL} SELECT material, receive_plant AS plant, CASE WHEN type = 'TRNS' THEN supply_plant END AS source,
    CASE WHEN type = 'TRNS' THEN 'U' ELSE 'E' END AS kind, CAST(week - 7 AS DATE) AS start, week AS due, qty FROM plan""",
)
def gen_planned_orders(t: Tables):
    return synth.gen_planned_orders(replenishment_plan(t))


@query(
    "safety_stock",
    """WITH need AS (SELECT l_partkey AS material, l_suppkey AS plant, CAST(FLOOR(SUM(l_quantity) / 52 * 4) AS DOUBLE) AS new FROM lineitem
      WHERE l_linestatus = 'O' GROUP BY 1, 2), policy AS (SELECT DISTINCT l_partkey AS material, l_suppkey AS plant, CAST(p_size AS DOUBLE) AS safety
      FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT material, plant, COALESCE(new, safety) AS safety FROM policy LEFT JOIN need USING (material, plant)""",
)
def safety_stock(t: Tables):
    policy = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_partkey AS material", "l_suppkey AS plant", "CAST(p_size AS DOUBLE) AS safety"
    ).distinct()
    demand = t.lineitem.where("l_linestatus = 'O'").selectExpr("l_partkey AS material", "l_suppkey AS plant", "l_quantity AS qty")
    return synth.safety_stock(policy, demand, 4)


@query("gen_master_counts")
def gen_master_counts(t: Tables):
    """Rows, distinct materials and a content hash of every generated master table."""
    seeds = t.part.select(F.col("p_partkey").alias("seed"))
    rows = None
    for name, table in synth.gen_master(seeds, [1000, 2000, 3000], seed=13).items():
        one = table.agg(
            F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.countDistinct("material").alias("materials"),
            F.bit_xor(F.xxhash64(*table.columns)).alias("content"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


EXECUTION_SQL = f"""WITH {REPLENISHMENT_SQL}, {STOCK_SQL}, bom AS (SELECT p_partkey AS material, p_partkey + 1 AS component, 2.0 AS component_qty FROM part),
    wanted AS (SELECT component AS material, receive_plant AS plant, week, SUM(qty * component_qty) AS qty FROM plan JOIN bom USING (material)
      WHERE type = 'PROD' GROUP BY 1, 2, 3),
    asked AS (SELECT n.*, COALESCE(stock, 0) AS stock, SUM(qty) OVER (PARTITION BY material, plant ORDER BY week) AS asked FROM wanted n LEFT JOIN stock USING (material, plant)),
    issued AS (SELECT *, GREATEST(0, LEAST(qty, stock - (asked - qty))) AS issued FROM asked)
    SELECT material, receive_plant AS plant, week, '101' AS code, 'S' AS flag, qty FROM plan WHERE type = 'PROD'
    UNION ALL SELECT material, plant, week, '261', 'H', issued FROM issued WHERE issued > 0
    UNION ALL SELECT material, plant, week, '102', 'H', qty - issued FROM issued WHERE qty - issued > 0
    UNION ALL SELECT material, supply_plant, week, '641', 'H', qty FROM plan WHERE type = 'TRNS'
    UNION ALL SELECT material, receive_plant, week, '101', 'S', qty FROM plan WHERE type = 'TRNS'"""


@query("gen_execution", EXECUTION_SQL)
def gen_execution(t: Tables):
    bom = t.part.selectExpr("p_partkey AS material", "p_partkey + 1 AS component", "2.0D AS component_qty")
    return synth.gen_execution(replenishment_plan(t), bom, stock(t))
