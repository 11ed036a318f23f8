"""Node impact, shortfall, order and lane queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlens.functions import ledger as fn
from harborlens.operators import impact as ops
from harborlens.operators import ledger as ledger_ops
from harborlens.plans.bind import LEDGER_SQL, PRICE_SQL, STOCK_SQL, ledger, prices, stock
from harborlens.plans.ledger_plans import day
from harborlens.plans.registry import Tables, query

NODES = [1, 3, 5, 7]
NODES_SQL = "(1, 3, 5, 7)"

PLACES_SQL = """places AS (SELECT s_suppkey AS plant, n_name AS place FROM supplier
    LEFT JOIN nation ON s_nationkey = n_nationkey)"""
LINES_SQL = """lines AS (SELECT l_orderkey AS order_id, l_linenumber AS item, l_partkey AS material,
    l_suppkey AS plant, l_quantity AS qty, l_extendedprice * (1 - l_discount) AS net,
    CAST(l_shipdate AS DATE) AS due FROM lineitem)"""
ORDERS_SQL = """heads AS (SELECT o_orderkey AS order_id, o_custkey AS customer, CAST(o_orderdate AS DATE) AS ordered
    FROM orders), delivered AS (SELECT o_orderkey AS order_id FROM orders WHERE o_orderstatus = 'F')"""
LOST_SQL = "lost AS (SELECT DISTINCT material, plant FROM ledger WHERE code = '551' AND qty > 45)"
PLANS_SQL = """plans AS (SELECT l_orderkey * 10 + l_linenumber AS plan_id, l_partkey AS material, l_suppkey AS plant,
    (SELECT MIN(s_suppkey) FROM supplier) AS source, CAST(o_orderdate AS DATE) AS start, CAST(l_shipdate AS DATE) AS due,
    l_quantity AS qty, CASE l_returnflag WHEN 'A' THEN 'E' WHEN 'N' THEN 'U' ELSE 'X' END AS kind
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def places(t: Tables):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").selectExpr(
        "s_suppkey AS plant", "n_name AS place"
    )


def lines(t: Tables):
    return t.lineitem.selectExpr(
        "l_orderkey AS order_id", "l_linenumber AS item", "l_partkey AS material", "l_suppkey AS plant",
        "l_quantity AS qty", "l_extendedprice * (1 - l_discount) AS net", "CAST(l_shipdate AS DATE) AS due",
    )


def heads(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey AS order_id", "o_custkey AS customer", "CAST(o_orderdate AS DATE) AS ordered"
    )


def delivered(t: Tables):
    return t.orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey AS order_id")


def lost(t: Tables):
    return ledger(t).where("code = '551' AND qty > 45").select("material", "plant").distinct()


def plans(t: Tables):
    source = t.supplier.agg(F.min("s_suppkey")).scalar()
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.expr("l_orderkey * 10 + l_linenumber AS plan_id"), F.col("l_partkey").alias("material"),
        F.col("l_suppkey").alias("plant"), source.alias("source"),
        F.expr("CAST(o_orderdate AS DATE) AS start"), F.expr("CAST(l_shipdate AS DATE) AS due"),
        F.col("l_quantity").alias("qty"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'E' WHEN 'N' THEN 'U' ELSE 'X' END AS kind"),
    )


@query(
    "node_product_window",
    f"""WITH {LEDGER_SQL} SELECT * EXCLUDE (signed) FROM ledger WHERE plant IN {NODES_SQL}
    AND posted BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
)
def node_product_window(t: Tables):
    return ops.in_scope(ledger(t), NODES, None, "posted", day("1998-01-01"), day("1998-12-31"))


@query(
    "movement_class",
    f"""WITH {LEDGER_SQL} SELECT CASE code WHEN '101' THEN 'Goods Receipt' WHEN '261' THEN 'Goods Issue (Production)'
    WHEN '551' THEN 'Scrapping' WHEN '601' THEN 'Goods Issue (Delivery)' WHEN '641' THEN 'GI Reversal'
    ELSE 'Other' END AS class, SUM(CASE WHEN code IN ('101', '561', '501', '102') THEN qty
    WHEN code IN ('601', '641', '261', '201') THEN -qty ELSE 0 END) AS flow FROM ledger GROUP BY 1""",
)
def movement_class(t: Tables):
    return ledger(t).groupBy(fn.movement_name(F.col("code")).alias("class")).agg(
        F.sum(fn.flow_qty(F.col("code"), F.col("qty"))).alias("flow")
    )


@query("open_orders", f"WITH {ORDERS_SQL} SELECT * FROM heads WHERE order_id NOT IN (SELECT order_id FROM delivered)")
def open_orders(t: Tables):
    return ops.open_orders(heads(t), delivered(t))


VALUED_SQL = f"""WITH {STOCK_SQL}, {PRICE_SQL}, {PLACES_SQL} SELECT material, plant, place, description, stock,
    COALESCE(ROUND(stock * price / unit, 2), 0) AS value FROM stock LEFT JOIN prices USING (material)
    LEFT JOIN places USING (plant) WHERE plant"""


@query("valued_inventory_inside", f"{VALUED_SQL} IN {NODES_SQL}")
def valued_inventory_inside(t: Tables):
    return ops.valued_inventory(stock(t), prices(t), places(t), NODES)


@query("valued_inventory_outside", f"{VALUED_SQL} NOT IN {NODES_SQL}")
def valued_inventory_outside(t: Tables):
    return ops.valued_inventory(stock(t), prices(t), places(t), NODES, inside=False)


RECEIPTS_SQL = f"""{PLANS_SQL}, {PRICE_SQL}, {PLACES_SQL}, receipts AS (SELECT plan_id, p.material, description, p.plant,
    a.place AS receiving_place, due, qty, CASE kind WHEN 'E' THEN 'PRODUCTION' WHEN 'U' THEN CAST(source AS VARCHAR)
    ELSE 'OTHER' END AS ship_from, CASE WHEN kind = 'U' THEN b.place ELSE 'In-house Production' END AS ship_from_place,
    CASE kind WHEN 'E' THEN 'Production' WHEN 'U' THEN 'Stock Transfer' ELSE kind END AS order_type
    FROM plans p LEFT JOIN places a ON p.plant = a.plant LEFT JOIN places b ON p.source = b.plant
    LEFT JOIN prices x ON p.material = x.material
    WHERE p.plant IN {NODES_SQL} AND due BETWEEN DATE '1998-01-01' AND DATE '1998-12-31')"""


def receipts(t: Tables):
    scoped = ops.in_scope(plans(t), NODES, None, "due", day("1998-01-01"), day("1998-12-31"))
    return ops.planned_receipts(scoped, prices(t), places(t))


@query("planned_receipts", f"WITH {RECEIPTS_SQL} SELECT * FROM receipts")
def planned_receipts(t: Tables):
    return receipts(t)


ISSUES_SQL = f"""{PLANS_SQL}, {ORDERS_SQL}, {LINES_SQL}, issues AS (SELECT source AS plant, plant AS ship_to,
    'INTERNAL' AS customer_type, material, start AS due, qty, plan_id AS order_id, 'Stock Transfer' AS order_type
    FROM plans WHERE kind = 'U' UNION ALL SELECT plant, customer, 'CUSTOMER', material, due, qty, order_id,
    'Customer Order' FROM heads JOIN lines USING (order_id) WHERE order_id NOT IN (SELECT order_id FROM delivered))"""


def issues(t: Tables):
    return ops.planned_issues(plans(t), heads(t), lines(t), delivered(t))


@query("planned_issues", f"WITH {ISSUES_SQL} SELECT * FROM issues")
def planned_issues(t: Tables):
    return issues(t)


LANES_SQL = """lane_modes AS (SELECT lane, origin, target, mode, hours, cost, cost = MIN(cost) OVER (PARTITION BY lane)
    AND mode = FIRST_VALUE(mode) OVER (PARTITION BY lane ORDER BY cost, mode) AS preferred FROM (
    SELECT s_suppkey * 100 + c_nationkey AS lane, s_suppkey AS origin, 1000 + c_nationkey AS target,
      o_orderpriority AS mode, CAST(SUM(l_linenumber) AS DOUBLE) AS hours, SUM(l_quantity) AS cost
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4))"""


def lane_modes(t: Tables):
    """Lanes from supplier to customer country, one mode per order priority that used them."""
    used = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.expr("s_suppkey * 100 + c_nationkey").alias("lane"), F.col("s_suppkey").alias("origin"),
            F.expr("1000 + c_nationkey").alias("target"), F.col("o_orderpriority").alias("mode"),
        )
        .agg(F.sum("l_linenumber").cast("double").alias("hours"), F.sum("l_quantity").alias("cost"))
    )
    return ledger_ops.preferred_mode(used)


@query("preferred_mode", f"WITH {LANES_SQL} SELECT * FROM lane_modes")
def preferred_mode(t: Tables):
    return lane_modes(t)


@query(
    "lane_directions",
    f"""WITH {LANES_SQL}, {PLACES_SQL} SELECT m.*, a.place AS origin_place, b.place AS target_place,
    CASE WHEN origin IN {NODES_SQL} THEN 'OUTBOUND' ELSE 'INBOUND' END AS direction,
    CASE WHEN preferred THEN 'Primary' ELSE 'Alternate' END AS priority
    FROM lane_modes m LEFT JOIN places a ON origin = a.plant LEFT JOIN places b ON target = b.plant
    WHERE origin IN {NODES_SQL} OR target IN {NODES_SQL}""",
)
def lane_directions(t: Tables):
    return ops.lane_directions(lane_modes(t), places(t), NODES)


SHORTFALL_SQL = f"""{LEDGER_SQL}, {STOCK_SQL}, {LINES_SQL}, {ORDERS_SQL},
    gone AS (SELECT material, plant, SUM(qty) AS lost FROM ledger WHERE code = '551' AND qty > 45 GROUP BY 1, 2),
    asked AS (SELECT material, plant, SUM(qty) AS demand, CAST(SUM(CAST(net AS DECIMAL(18, 4))) AS DOUBLE) AS demand_value,
      COUNT(DISTINCT order_id) AS orders FROM lines WHERE order_id NOT IN (SELECT order_id FROM delivered) GROUP BY 1, 2),
    short AS (SELECT COALESCE(d.material, s.material, f.material) AS material, COALESCE(d.plant, s.plant, f.plant) AS plant,
      COALESCE(stock, 0) AS stock, COALESCE(lost, 0) AS lost, COALESCE(demand, 0) AS demand,
      COALESCE(demand_value, 0) AS demand_value, COALESCE(orders, 0) AS orders,
      COALESCE(stock, 0) - COALESCE(demand, 0) AS stock_vs_demand,
      GREATEST(COALESCE(demand, 0) - COALESCE(stock, 0), 0) AS shortfall, f.material IS NOT NULL AS affected
      FROM asked d FULL JOIN stock s ON d.material = s.material AND d.plant = s.plant
      FULL JOIN gone f ON COALESCE(d.material, s.material) = f.material AND COALESCE(d.plant, s.plant) = f.plant
      WHERE COALESCE(demand, 0) > 0 OR COALESCE(lost, 0) > 0)"""


def shortfalls(t: Tables):
    demand = lines(t).join(delivered(t), "order_id", "left_anti")
    return ops.shortfall(stock(t), demand, ledger(t).where("code = '551' AND qty > 45"))


@query("shortfall", f"WITH {SHORTFALL_SQL} SELECT * FROM short")
def shortfall(t: Tables):
    return shortfalls(t)


@query(
    "shortfall_ranking",
    f"""WITH {SHORTFALL_SQL} SELECT * FROM short ORDER BY CASE WHEN affected THEN 0 ELSE 1 END,
    CASE WHEN shortfall > 0 THEN 0 ELSE 1 END, demand - stock DESC, material, plant""",
)
def shortfall_ranking(t: Tables):
    return shortfalls(t).orderBy(*ops.shortfall_order())


@query(
    "touched_stock",
    f"""WITH {LEDGER_SQL}, {STOCK_SQL}, {LOST_SQL} SELECT * FROM stock s WHERE EXISTS (SELECT 1 FROM lost l
    WHERE l.material = s.material AND l.plant = s.plant)""",
)
def touched_stock(t: Tables):
    return ops.touched_stock(stock(t), lost(t))


@query(
    "impact_join",
    f"""WITH {LEDGER_SQL}, {STOCK_SQL} SELECT material, plant, stock, doc, code, CASE WHEN flag = 'H' THEN -qty ELSE qty END
    AS impact FROM stock JOIN (SELECT DISTINCT material, plant, doc, code, flag, qty FROM ledger WHERE code = '551')
    USING (material, plant)""",
)
def impact_join(t: Tables):
    return ops.impact_join(stock(t), ledger(t).where("code = '551'"))


IMPACTED_SQL = f"""{LEDGER_SQL}, {LINES_SQL}, {ORDERS_SQL}, {LOST_SQL}, impacted AS (SELECT order_id, customer, material,
    plant, qty, net, due FROM lines JOIN lost USING (material, plant) JOIN heads USING (order_id)
    WHERE order_id NOT IN (SELECT order_id FROM delivered))"""


def impacted(t: Tables):
    return ops.impacted_orders(heads(t), lines(t), delivered(t), lost(t))


@query("impacted_orders", f"WITH {IMPACTED_SQL} SELECT * FROM impacted")
def impacted_orders(t: Tables):
    return impacted(t)


@query(
    "customer_impact",
    f"""WITH {IMPACTED_SQL} SELECT customer, COUNT(DISTINCT order_id) AS orders, SUM(qty) AS qty,
    CAST(SUM(CAST(net AS DECIMAL(18, 4))) AS DOUBLE) AS value FROM impacted GROUP BY 1""",
)
def customer_impact(t: Tables):
    return ops.customer_impact(impacted(t))


@query(
    "country_impact_share",
    f"""WITH {IMPACTED_SQL}, grouped AS (SELECT n_name AS country, COUNT(*) AS rows,
    SUM(CAST(net AS DECIMAL(18, 4))) AS v FROM impacted JOIN customer ON customer = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT country, rows, CAST(v AS DOUBLE) AS value,
    CAST(v AS DOUBLE) / CAST(SUM(v) OVER () AS DOUBLE) * 100 AS share_pct FROM grouped""",
)
def country_impact_share(t: Tables):
    named = (
        impacted(t).join(t.customer, F.col("customer") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumnRenamed("n_name", "country")
    )
    return ops.share_by(named, "country", F.col("net"))


@query(
    "impact_kpis",
    f"""WITH {IMPACTED_SQL} SELECT COUNT(DISTINCT order_id) AS orders, COUNT(DISTINCT customer) AS customers,
    CAST(SUM(CAST(net AS DECIMAL(18, 4))) AS DOUBLE) AS revenue_at_risk, SUM(qty) AS units FROM impacted""",
)
def impact_kpis(t: Tables):
    return ops.impact_kpis(impacted(t))


def bom_tables(t: Tables):
    """Bills of material: each order lists components, its highest part number is the product."""
    items = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("component_qty")).selectExpr(
        "l_orderkey AS bom", "l_partkey AS component", "component_qty"
    )
    bom_heads = t.lineitem.groupBy("l_orderkey").agg(F.max("l_partkey").alias("material")).selectExpr(
        "l_orderkey AS bom", "material"
    )
    return bom_heads, items


BOM_SQL = """bom_heads AS (SELECT l_orderkey AS bom, MAX(l_partkey) AS material FROM lineitem GROUP BY 1),
    bom_items AS (SELECT l_orderkey AS bom, l_partkey AS component, SUM(l_quantity) AS component_qty
    FROM lineitem GROUP BY 1, 2)"""


@query(
    "flat_bom",
    f"""WITH {BOM_SQL} SELECT material, m.p_name AS material_text, bom, component, c.p_name AS component_text,
    component_qty FROM bom_heads JOIN bom_items USING (bom) LEFT JOIN part m ON m.p_partkey = material
    LEFT JOIN part c ON c.p_partkey = component""",
)
def flat_bom(t: Tables):
    bom_heads, items = bom_tables(t)
    return ops.flat_bom(bom_heads, items, prices(t))


RATES_SQL = """rates AS (SELECT p_partkey AS component, p_size / 40.0 AS rate FROM part WHERE p_size < 40)"""


@query(
    "bom_requirements",
    f"""WITH {BOM_SQL}, {RATES_SQL}, runs AS (SELECT o_orderkey AS plan_id,
    CAST(FLOOR(o_totalprice / 10000) AS DOUBLE) AS qty FROM orders),
    need AS (SELECT plan_id, material, qty, component_qty * qty AS needed, qty * COALESCE(rate, 1) AS buildable,
      component_qty * (qty - qty * COALESCE(rate, 1)) AS shortage
      FROM runs JOIN bom_heads ON plan_id = bom JOIN bom_items USING (bom) LEFT JOIN rates USING (component)),
    built AS (SELECT plan_id, material, qty, SUM(needed) AS needed,
      CAST(SUM(CAST(shortage AS DECIMAL(18, 4))) AS DOUBLE) AS shortage,
      CAST(SUM(CASE WHEN shortage > 0 THEN 1 ELSE 0 END) AS BIGINT) AS short_components,
      CAST(FLOOR(LEAST(MIN(buildable), qty)) AS BIGINT) AS built FROM need GROUP BY 1, 2, 3)
    SELECT *, CASE WHEN built <= 0 THEN 'BLCK' WHEN built < qty THEN 'PART' ELSE 'COMP' END AS status FROM built""",
)
def bom_requirements(t: Tables):
    bom_heads, items = bom_tables(t)
    runs = t.orders.selectExpr("o_orderkey AS bom", "o_orderkey AS plan_id", "CAST(FLOOR(o_totalprice / 10000) AS DOUBLE) AS qty")
    rates = t.part.where("p_size < 40").selectExpr("p_partkey AS component", "p_size / 40.0D AS rate")
    planned = runs.join(bom_heads, "bom")
    need = planned.join(items, "bom").select("plan_id", "material", "qty", "component", "component_qty")
    return ops.order_requirements(need, rates)


@query(
    "document_flow_edges",
    f"""WITH {ORDERS_SQL} SELECT l_orderkey AS order_id, l_orderkey * 10 + l_linenumber AS delivery_id,
    h.ordered AS delivered_on, l_quantity AS qty FROM lineitem LEFT JOIN heads h ON l_orderkey * 10 + l_linenumber = order_id
    WHERE l_linestatus = 'F'""",
)
def document_flow_edges(t: Tables):
    flow = t.lineitem.selectExpr(
        "l_orderkey AS order_id", "l_orderkey * 10 + l_linenumber AS delivery_id", "'C' AS from_kind",
        "CASE WHEN l_linestatus = 'F' THEN 'J' ELSE 'M' END AS to_kind", "l_quantity AS qty",
    )
    headers = heads(t).selectExpr("order_id AS delivery_id", "ordered AS delivered_on")
    return ops.document_flow_edges(flow, headers)


@query(
    "receipts_by_type",
    f"""WITH {RECEIPTS_SQL} SELECT order_type, COUNT(DISTINCT plan_id) AS orders, SUM(qty) AS qty FROM receipts GROUP BY 1""",
)
def receipts_by_type(t: Tables):
    return ops.receipts_by(receipts(t), "order_type")


@query(
    "receipts_by_date",
    f"""WITH {RECEIPTS_SQL} SELECT due, COUNT(DISTINCT plan_id) AS orders, SUM(qty) AS qty FROM receipts GROUP BY 1""",
)
def receipts_by_date(t: Tables):
    return ops.receipts_by(receipts(t), "due")


@query(
    "issues_by_type_destination",
    f"""WITH {ISSUES_SQL} SELECT customer_type, ship_to, COUNT(DISTINCT order_id) AS orders, SUM(qty) AS qty
    FROM issues GROUP BY 1, 2""",
)
def issues_by_type_destination(t: Tables):
    return ops.issues_by(issues(t), "customer_type", "ship_to")


@query(
    "lane_summary_by_mode",
    f"""WITH {LANES_SQL} SELECT mode, COUNT(DISTINCT lane) AS lanes, SUM(hours) / COUNT(*) AS mean_hours,
    SUM(cost) / COUNT(*) AS mean_cost FROM lane_modes GROUP BY 1""",
)
def lane_summary_by_mode(t: Tables):
    return ops.lane_summary(lane_modes(t), "mode")


@query(
    "node_net_position",
    f"""WITH {STOCK_SQL}, {ISSUES_SQL}, all_rows AS (SELECT plant, stock AS held, 0 AS received, 0 AS issued FROM stock
    UNION ALL SELECT plant, 0, qty, 0 FROM plans UNION ALL SELECT plant, 0, 0, qty FROM issues)
    SELECT plant, SUM(held) AS stock, SUM(received) AS receipts, SUM(issued) AS issues,
    SUM(held) + SUM(received) - SUM(issued) AS net_position FROM all_rows GROUP BY 1""",
)
def node_net_position(t: Tables):
    return ops.node_net_position(stock(t), plans(t), issues(t))


@query(
    "affected_customers",
    f"""WITH {LINES_SQL}, {ORDERS_SQL} SELECT customer, COUNT(DISTINCT order_id) AS orders, SUM(qty) AS units,
    CAST(SUM(CAST(net AS DECIMAL(18, 4))) AS DOUBLE) AS value FROM lines JOIN heads USING (order_id)
    WHERE material = 17 GROUP BY ROLLUP (customer)""",
)
def affected_customers(t: Tables):
    return ops.affected_customers(heads(t), lines(t), 17)


@query(
    "pending_deliveries",
    f"""WITH {LINES_SQL}, {ORDERS_SQL}, {PRICE_SQL}, waiting AS (SELECT material, COUNT(DISTINCT order_id) AS deliveries,
    SUM(qty) AS qty FROM lines WHERE plant = 3 AND order_id NOT IN (SELECT order_id FROM delivered) GROUP BY 1
    ORDER BY qty DESC, material LIMIT 20)
    SELECT material, deliveries, qty, description FROM waiting LEFT JOIN prices USING (material)""",
)
def pending_deliveries(t: Tables):
    waiting = lines(t).join(delivered(t), "order_id", "left_anti")
    return ops.pending_deliveries(waiting, prices(t), 3, 20)


@query(
    "customer_products",
    f"""WITH {LINES_SQL}, {ORDERS_SQL}, bought AS (SELECT * FROM lines JOIN heads USING (order_id)),
    own AS (SELECT material, COUNT(DISTINCT order_id) AS orders, SUM(qty) AS qty FROM bought WHERE customer = 7 GROUP BY 1)
    SELECT material, orders, qty, (SELECT COUNT(DISTINCT customer) FROM bought b WHERE b.material = own.material
    AND customer <> 7) AS other_customers FROM own""",
)
def customer_products(t: Tables):
    return ops.customer_products(heads(t), lines(t), 7)


@query(
    "scenario_value",
    f"""WITH {LEDGER_SQL}, plant_prices AS (SELECT l_partkey AS material, l_suppkey AS plant, MAX(l_extendedprice) AS price
    FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
    any_price AS (SELECT material, arg_min(price, plant) AS fallback FROM plant_prices GROUP BY 1)
    SELECT code AS scenario, COUNT(*) AS rows, CAST(SUM(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fallback_prices,
    CAST(SUM(CAST(qty * COALESCE(price, fallback, 0) AS DECIMAL(18, 4))) AS DOUBLE) AS value
    FROM ledger LEFT JOIN plant_prices USING (material, plant) LEFT JOIN any_price USING (material) GROUP BY 1""",
)
def scenario_value(t: Tables):
    plant_prices = t.lineitem.where("l_linestatus = 'F'").groupBy(
        F.col("l_partkey").alias("material"), F.col("l_suppkey").alias("plant")
    ).agg(F.max("l_extendedprice").alias("price"))
    return ops.scenario_value(ledger(t).withColumnRenamed("code", "scenario"), plant_prices)


@query(
    "scenario_counts",
    f"""WITH {LEDGER_SQL} SELECT 'movements' AS metric, COUNT(*) AS n FROM ledger UNION ALL
    SELECT 'losses', COUNT(*) FROM ledger WHERE code = '551' UNION ALL SELECT 'orders', COUNT(*) FROM orders""",
)
def scenario_counts(t: Tables):
    moves = ledger(t)
    return ops.count_rows({"movements": moves, "losses": moves.where("code = '551'"), "orders": t.orders})


@query(
    "location_nodes",
    """SELECT 'plant' AS kind, CAST(s_suppkey AS VARCHAR) AS node, s_name AS label FROM supplier UNION ALL
    SELECT DISTINCT 'store', CAST(l_suppkey AS VARCHAR) || '/' || l_linestatus, l_linestatus FROM lineitem""",
)
def location_nodes(t: Tables):
    plants = t.supplier.selectExpr("'plant' AS kind", "CAST(s_suppkey AS STRING) AS node", "s_name AS label")
    stores = t.lineitem.selectExpr(
        "'store' AS kind", "CONCAT(l_suppkey, '/', l_linestatus) AS node", "l_linestatus AS label"
    ).distinct()
    return plants.unionByName(stores)


@query(
    "affected_rows",
    f"WITH {LEDGER_SQL} SELECT DISTINCT material, plant, code FROM ledger WHERE code IN ('551', '601')",
)
def affected_rows(t: Tables):
    return ledger(t).where("code IN ('551', '601')").select("material", "plant", "code").distinct()


@query(
    "top_safety_stock",
    """SELECT l_partkey AS material, SUM(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
    ORDER BY qty DESC, material LIMIT 20""",
)
def top_safety_stock(t: Tables):
    return (
        t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("material"))
        .agg(F.sum("l_quantity").alias("qty")).orderBy(F.desc("qty"), "material").limit(20)
    )


@query(
    "issues_by_date",
    f"WITH {ISSUES_SQL} SELECT due, COUNT(DISTINCT order_id) AS orders, SUM(qty) AS qty FROM issues GROUP BY 1",
)
def issues_by_date(t: Tables):
    return ops.issues_by(issues(t), "due")


@query(
    "lane_summary_by_priority",
    f"""WITH {LANES_SQL} SELECT CASE WHEN preferred THEN 'Primary' ELSE 'Alternate' END AS priority, COUNT(DISTINCT lane) AS lanes,
    SUM(hours) / COUNT(*) AS mean_hours, SUM(cost) / COUNT(*) AS mean_cost FROM lane_modes GROUP BY 1""",
)
def lane_summary_by_priority(t: Tables):
    labelled = lane_modes(t).withColumn("priority", F.when(F.col("preferred"), "Primary").otherwise("Alternate"))
    return ops.lane_summary(labelled, "priority")


@query(
    "loss_by_type",
    f"""WITH {LEDGER_SQL}, {PRICE_SQL}, grouped AS (SELECT material_type, COUNT(*) AS rows, SUM(CAST(qty * price / unit AS DECIMAL(18, 4))) AS v
    FROM ledger JOIN prices USING (material) WHERE code = '551' GROUP BY 1)
    SELECT material_type, rows, CAST(v AS DOUBLE) AS value, CAST(v AS DOUBLE) / CAST(SUM(v) OVER () AS DOUBLE) * 100 AS share_pct FROM grouped""",
)
def loss_by_type(t: Tables):
    losses = ledger(t).where("code = '551'").join(prices(t), "material")
    return ops.share_by(losses, "material_type", F.col("qty") * F.col("price") / F.col("unit"))


@query(
    "date_parts",
    """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT strftime(d, '%Y%m%d') AS text, d AS day,
    CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(date_trunc('week', d) AS DATE) AS week_start,
    CAST(date_trunc('week', d) AS DATE) + 6 AS week_end FROM days""",
)
def date_parts(t: Tables):
    text = t.orders.select(fn.day_text(F.col("o_orderdate")).alias("text")).distinct()
    d = fn.parse_day(F.col("text"))
    return text.select(
        "text", d.alias("day"), fn.month_start(d).alias("month_start"), fn.week_start(d).alias("week_start"), fn.week_end(d).alias("week_end")
    )
