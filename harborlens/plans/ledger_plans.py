"""Ledger aggregates and windows on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlens.functions import ledger as fn
from harborlens.operators import ledger as ops
from harborlens.plans.bind import LEDGER_SQL, PRICE_SQL, STOCK_SQL, ledger, prices, stock
from harborlens.plans.registry import Tables, query


def day(text: str):
    return F.lit(text).cast("date")


SCENARIO_SQL = "CASE WHEN code = '551' THEN 'loss' WHEN code IN ('261', '601') THEN 'issue' END"


@query(
    "impact_summary",
    f"""WITH {LEDGER_SQL} SELECT * FROM (SELECT {SCENARIO_SQL} AS scenario, code, COUNT(*) AS records,
    SUM(signed) AS net_qty, COUNT(DISTINCT material) AS materials, COUNT(DISTINCT plant) AS plants
    FROM ledger GROUP BY 1, 2) WHERE scenario IS NOT NULL""",
)
def impact_summary(t: Tables):
    return ops.impact_summary(ledger(t), F.expr(SCENARIO_SQL))


@query(
    "movement_distribution",
    f"""WITH {LEDGER_SQL} SELECT code, COUNT(*) AS records,
    CAST(SUM(CASE WHEN qty > 40 THEN 1 ELSE 0 END) AS BIGINT) AS scenario_records,
    CAST(SUM(CASE WHEN qty > 40 THEN 0 ELSE 1 END) AS BIGINT) AS normal_records, SUM(qty) AS total_qty,
    CASE code WHEN '101' THEN 'Goods Receipt' WHEN '261' THEN 'Goods Issue (Production)'
      WHEN '551' THEN 'Scrapping' WHEN '601' THEN 'Goods Issue (Delivery)' WHEN '641' THEN 'GI Reversal'
      ELSE 'Other' END AS description
    FROM ledger GROUP BY code""",
)
def movement_distribution(t: Tables):
    return ops.movement_distribution(ledger(t), F.col("qty") > 40)


@query(
    "product_location_volume",
    f"""WITH {LEDGER_SQL} SELECT material, plant, SUM(CASE WHEN flag = 'S' THEN qty ELSE 0 END) AS volume_in,
    SUM(CASE WHEN flag = 'H' THEN qty ELSE 0 END) AS volume_out, SUM(qty) AS activity
    FROM ledger WHERE posted BETWEEN DATE '1999-07-01' AND DATE '2000-07-01'
      AND material IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY 1, 2""",
)
def product_location_volume(t: Tables):
    finished = prices(t).where("material_type = 'PROMO'")
    return ops.product_location_volume(ledger(t), finished, day("2000-07-01"), 12)


@query(
    "stock_position",
    f"""WITH {LEDGER_SQL} SELECT material, plant, SUM(signed) AS stock FROM ledger GROUP BY 1, 2
    HAVING SUM(signed) > 0""",
)
def stock_position(t: Tables):
    return ops.stock_position(ledger(t))


@query(
    "valuation_by_type",
    f"""WITH {STOCK_SQL}, {PRICE_SQL} SELECT material_type, COUNT(*) AS skus,
    CAST(SUM(CAST(ROUND(stock * price / unit, 2) AS DECIMAL(18, 4))) AS DOUBLE) AS value
    FROM stock JOIN prices USING (material) GROUP BY ROLLUP (material_type)""",
)
def valuation_by_type(t: Tables):
    valued = stock(t).join(prices(t), "material").withColumn(
        "value", fn.item_value(F.col("stock"), F.col("price"), F.col("unit"))
    )
    return ops.valuation_by(valued, "material_type")


PNL_SQL = f"""{PRICE_SQL}, lines AS (SELECT l_suppkey AS plant, l_partkey AS material, l_quantity AS delivered,
    CASE WHEN l_quantity > 0 THEN l_extendedprice * (1 - l_discount) / l_quantity ELSE 0 END AS unit_price
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'),
sales AS (SELECT plant, material, SUM(delivered) AS qty_sold,
    CAST(SUM(CAST(unit_price AS DECIMAL(18, 10))) AS DOUBLE) / COUNT(*) AS unit_price,
    CAST(SUM(CAST(delivered * unit_price AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lines GROUP BY 1, 2),
costed AS (SELECT plant, material, material_type, qty_sold, unit_price, revenue, price AS unit_cost,
    ROUND(qty_sold * price, 6) AS cogs FROM sales LEFT JOIN prices USING (material)),
pnl AS (SELECT *, ROUND(revenue - cogs, 6) AS gross_profit,
    CASE WHEN revenue > 0 THEN ROUND(ROUND(revenue - cogs, 6) / revenue * 100, 4) ELSE 0 END AS margin_pct FROM costed)"""


def pnl_detail(t: Tables):
    flow = t.lineitem.join(
        t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")
    ).selectExpr(
        "l_suppkey AS plant", "l_partkey AS material", "l_quantity AS delivered", "l_quantity AS ordered",
        "l_extendedprice * (1 - l_discount) AS net",
    )
    return ops.product_pnl(flow, prices(t).withColumnRenamed("price", "unit_cost"))


@query("product_pnl", f"WITH {PNL_SQL} SELECT * FROM pnl")
def product_pnl(t: Tables):
    return pnl_detail(t)


@query(
    "pnl_by_level",
    f"""WITH {PNL_SQL}, sets AS (SELECT material_type, plant, material,
    CASE GROUPING(material_type, plant, material) WHEN 3 THEN 'type' WHEN 5 THEN 'plant' WHEN 6 THEN 'product'
      ELSE 'total' END AS level, SUM(qty_sold) AS qty_sold,
    CAST(SUM(CAST(revenue AS DECIMAL(18, 4))) AS DOUBLE) AS revenue,
    CAST(SUM(CAST(cogs AS DECIMAL(18, 4))) AS DOUBLE) AS cogs
    FROM pnl GROUP BY GROUPING SETS ((material_type), (plant), (material), ()))
    SELECT *, ROUND(revenue - cogs, 6) AS gross_profit,
    CASE WHEN revenue > 0 THEN ROUND(ROUND(revenue - cogs, 6) / revenue * 100, 4) ELSE 0 END AS margin_pct FROM sets""",
)
def pnl_by_level(t: Tables):
    return ops.pnl_by(pnl_detail(t))


# The months of the given tables, which the query finds by itself.
MONTHS = [f"{year}-{month:02d}" for year in range(1995, 2002) for month in range(1, 13) if (year, month) < (2001, 12)]
MONTHS_SQL = ", ".join(f"COALESCE(SUM(qty) FILTER (month = '{m}'), 0) AS \"{m}\"" for m in MONTHS)


@query(
    "monthly_pivot",
    f"""WITH {LEDGER_SQL}, {PRICE_SQL}, plan AS (SELECT plant, material, COALESCE(description, '') AS description,
      strftime(posted, '%Y-%m') AS month, qty FROM ledger LEFT JOIN prices USING (material))
    SELECT plant, material, description, {MONTHS_SQL} FROM plan GROUP BY plant, material, description""",
)
def monthly_pivot(t: Tables):
    """Every month of the data, by plant, material and description."""
    plan = (
        ledger(t).join(prices(t).select("material", "description"), "material", "left")
        .withColumns({"description": F.coalesce("description", F.lit("")), "month": F.date_format("posted", "yyyy-MM")})
    )
    return ops.monthly_pivot(plan, ["plant", "material", "description"])


@query(
    "monthly_plan",
    f"""WITH {LEDGER_SQL} SELECT plant, material, strftime(posted, '%Y-%m') AS month, SUM(qty) AS qty FROM ledger GROUP BY 1, 2, 3""",
)
def monthly_plan(t: Tables):
    """The same as rows, the form for wide ranges of months."""
    return ops.monthly_plan(ledger(t).withColumn("month", F.date_format("posted", "yyyy-MM")), ["plant", "material"])


@query(
    "weekly_load",
    f"""WITH {LEDGER_SQL} SELECT plant, CAST(date_trunc('week', posted) AS DATE) AS week_start, material,
    SUM(qty) AS qty FROM ledger GROUP BY 1, 2, 3""",
)
def weekly_load(t: Tables):
    return ops.weekly_load(ledger(t))


TARGET_SQL = """targets AS (SELECT l_partkey AS material, l_suppkey AS plant,
    CAST(FLOOR(SUM(l_quantity) / 52 * 4 - 2) AS DOUBLE) AS safety FROM lineitem GROUP BY 1, 2)"""


@query(
    "safety_stock_summary",
    f"""WITH {TARGET_SQL} SELECT plant, COUNT(*) AS materials, SUM(safety) AS safety FROM targets
    WHERE safety > 0 GROUP BY plant""",
)
def safety_stock_summary(t: Tables):
    targets = ledger(t).groupBy("material", "plant").agg(
        F.floor(F.sum("qty") / 52 * 4 - 2).cast("double").alias("safety")
    )
    return ops.safety_stock_summary(targets)


RECEIPT_SQL = """receipts AS (SELECT l_suppkey AS vendor, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
    CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + 90 AS on_time, l_returnflag <> 'R' AS in_full
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
OTIF_SQL = """COUNT(*) AS receipts, CAST(SUM(CASE WHEN on_time THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS on_time_rate,
    CAST(SUM(CASE WHEN in_full THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS in_full_rate,
    CAST(SUM(CASE WHEN on_time AND in_full THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS otif_rate FROM receipts"""


def receipts(t: Tables):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "l_suppkey AS vendor", "CAST(TRUNC(l_shipdate, 'month') AS DATE) AS month",
        "CAST(l_shipdate AS DATE) <= DATE_ADD(CAST(o_orderdate AS DATE), 90) AS on_time",
        "l_returnflag <> 'R' AS in_full",
    )


@query("otif_overall", f"WITH {RECEIPT_SQL} SELECT {OTIF_SQL}")
def otif_overall(t: Tables):
    return ops.otif(receipts(t))


@query("otif_by_vendor_month", f"WITH {RECEIPT_SQL} SELECT vendor, month, {OTIF_SQL} GROUP BY vendor, month")
def otif_by_vendor_month(t: Tables):
    return ops.otif(receipts(t), "vendor", "month")


@query(
    "consumption_by_material",
    f"WITH {LEDGER_SQL} SELECT material, SUM(qty) AS consumed FROM ledger WHERE code = '261' GROUP BY 1",
)
def consumption_by_material(t: Tables):
    return ops.consumption_by_material(ledger(t))


@query(
    "running_balance",
    f"""WITH {LEDGER_SQL}, daily AS (SELECT material, posted, SUM(signed) AS net FROM ledger GROUP BY 1, 2),
    scanned AS (SELECT *, SUM(net) OVER (PARTITION BY material ORDER BY posted) AS balance FROM daily)
    SELECT * FROM scanned WHERE posted >= DATE '1998-01-01'""",
)
def running_balance(t: Tables):
    return ops.running_balance(ledger(t), ["material"], day("1998-01-01"))


def weekly_sql(dims: str) -> str:
    group = f"week_start, {dims}" if dims else "week_start"
    return f"""WITH {LEDGER_SQL}, {PRICE_SQL}, moves AS (SELECT material, plant,
    CAST(date_trunc('week', posted) AS DATE) AS week_start, SUM(signed) AS net FROM ledger GROUP BY 1, 2, 3),
    held AS (SELECT *, 1000 + SUM(net) OVER (PARTITION BY material, plant ORDER BY week_start) AS balance FROM moves)
    SELECT {group}, CAST(SUM(CAST(balance * price AS DECIMAL(18, 4))) AS DOUBLE) AS value
    FROM held JOIN prices USING (material) WHERE balance > 0 GROUP BY {group}"""


@query("weekly_stock_value_by_type", weekly_sql("material_type"))
def weekly_stock_value(t: Tables):
    return ops.weekly_stock_value(ledger(t), prices(t), 1000, ["material_type"])


@query("weekly_stock_value_by_plant", weekly_sql("plant"))
def weekly_stock_value_by_plant(t: Tables):
    return ops.weekly_stock_value(ledger(t), prices(t), 1000, ["plant"])


@query("weekly_stock_value_total", weekly_sql(""))
def weekly_stock_value_total(t: Tables):
    return ops.weekly_stock_value(ledger(t), prices(t), 1000, [])


@query(
    "reconstruct_stock",
    f"""WITH {LEDGER_SQL}, {STOCK_SQL}, daily AS (SELECT material, plant, posted, SUM(signed) AS net
    FROM ledger GROUP BY 1, 2, 3), totals AS (SELECT material, plant, SUM(net) AS total FROM daily GROUP BY 1, 2),
    rolled AS (SELECT material, plant, posted, net, COALESCE(stock, 0) - total
      + SUM(net) OVER (PARTITION BY material, plant ORDER BY posted) AS stock
      FROM daily JOIN totals USING (material, plant) LEFT JOIN stock USING (material, plant))
    SELECT * FROM rolled WHERE posted BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'""",
)
def reconstruct_stock(t: Tables):
    return ops.reconstruct_stock(stock(t), ledger(t), day("1999-01-01"), day("1999-12-31"))


@query(
    "month_end_snapshots",
    f"""WITH {LEDGER_SQL}, monthly AS (SELECT material, CAST(date_trunc('month', posted) AS DATE) AS period,
    SUM(signed) AS change FROM ledger GROUP BY 1, 2), opened AS (SELECT p_partkey AS material,
    CAST(p_size AS DOUBLE) AS opening FROM part), grid AS (SELECT material, period
    FROM (SELECT DISTINCT material FROM monthly) CROSS JOIN (SELECT DISTINCT period FROM monthly)),
    rolled AS (SELECT material, period, COALESCE(change, 0) AS change, COALESCE(opening, 0)
      + SUM(COALESCE(change, 0)) OVER (PARTITION BY material ORDER BY period) AS balance
      FROM grid LEFT JOIN monthly USING (material, period) LEFT JOIN opened USING (material))
    SELECT material, period, GREATEST(0, balance) AS stock FROM rolled WHERE change <> 0 OR balance <> 0""",
)
def month_end_snapshots(t: Tables):
    opening = t.part.selectExpr("p_partkey AS material", "CAST(p_size AS DOUBLE) AS opening")
    return ops.month_end_snapshots(ledger(t), opening, ["material"])


ITEM_ORDER = "material, plant, posted, qty, code"


@query(
    "line_numbers",
    f"""WITH {LEDGER_SQL} SELECT doc, material, plant, qty, lpad(CAST(10 * ROW_NUMBER() OVER (
    PARTITION BY doc ORDER BY {ITEM_ORDER}) AS VARCHAR), 6, '0') AS line_no FROM ledger""",
)
def line_numbers(t: Tables):
    numbered = ops.line_numbers(ledger(t), "doc", ITEM_ORDER.split(", "))
    return numbered.select("doc", "material", "plant", "qty", "line_no")


POLICY_SQL = """policy AS (SELECT material, plant, CAST(p_size AS DOUBLE) AS safety, 25.0 AS lot,
    plant = MIN(plant) OVER (PARTITION BY material) AS is_hub
    FROM (SELECT DISTINCT material, plant FROM need) JOIN part ON p_partkey = material)"""
LOTS_SQL = """ROUND((safety - 1.2 * safety + SUM(qty) OVER (PARTITION BY material, plant ORDER BY week)) / lot, 9)"""
REPLENISHMENT_SQL = f"""{LEDGER_SQL}, need AS (SELECT material, plant,
    CAST(date_trunc('week', posted) AS DATE) AS week, SUM(qty) AS qty FROM ledger WHERE flag = 'H' GROUP BY 1, 2, 3),
{POLICY_SQL}, starts AS (SELECT material, MIN(week) AS week FROM need GROUP BY 1),
weekly AS (SELECT material, plant, week, SUM(qty) AS qty FROM (SELECT material, plant, week, qty FROM need
    UNION ALL SELECT material, plant, week, 0 FROM policy JOIN starts USING (material)) GROUP BY 1, 2, 3),
spoke_need AS (SELECT w.material, w.plant, week, lot, CEIL({LOTS_SQL}) AS lots FROM weekly w
    JOIN policy USING (material, plant) WHERE NOT is_hub),
spoke_lots AS (SELECT *, GREATEST(0, MAX(lots) OVER (PARTITION BY material, plant ORDER BY week)) AS total FROM spoke_need),
spokes AS (SELECT material, plant, week, lot * (total - COALESCE(LAG(total) OVER (PARTITION BY material, plant
    ORDER BY week), 0)) AS qty FROM spoke_lots),
hub_weekly AS (SELECT material, plant, week, SUM(qty) AS qty FROM (
    SELECT material, plant, week, qty FROM weekly JOIN policy USING (material, plant) WHERE is_hub UNION ALL
    SELECT s.material, h.plant, week, qty FROM spokes s JOIN policy h ON h.material = s.material AND h.is_hub
    WHERE qty > 0) GROUP BY 1, 2, 3),
hub_need AS (SELECT material, plant, week, lot, CEIL({LOTS_SQL}) AS lots FROM hub_weekly JOIN policy USING (material, plant)),
hub_lots AS (SELECT *, GREATEST(0, MAX(lots) OVER (PARTITION BY material, plant ORDER BY week)) AS total FROM hub_need),
hubs AS (SELECT material, plant, week, lot * (total - COALESCE(LAG(total) OVER (PARTITION BY material, plant
    ORDER BY week), 0)) AS qty FROM hub_lots),
plan AS (SELECT 'TRNS' AS type, s.material, h.plant AS supply_plant, s.plant AS receive_plant, week,
    CAST(qty AS DOUBLE) AS qty FROM spokes s JOIN policy h ON h.material = s.material AND h.is_hub WHERE qty > 0
    UNION ALL SELECT 'PROD', material, plant, plant, week, CAST(qty AS DOUBLE) FROM hubs WHERE qty > 0)"""


def replenishment_plan(t: Tables):
    need = ledger(t).where("flag = 'H'").groupBy(
        "material", "plant", fn.week_start(F.col("posted")).alias("week")
    ).agg(F.sum("qty").alias("qty"))
    pairs = need.select("material", "plant").distinct()
    hubs = pairs.groupBy("material").agg(F.min("plant").alias("hub"))
    policy = pairs.join(hubs, "material").join(
        t.part.selectExpr("p_partkey AS material", "CAST(p_size AS DOUBLE) AS safety"), "material"
    ).selectExpr("material", "plant", "safety", "25.0D AS lot", "plant = hub AS is_hub")
    return ops.replenishment(need, policy)


@query("replenishment", f"WITH {REPLENISHMENT_SQL} SELECT * FROM plan")
def replenishment(t: Tables):
    return replenishment_plan(t)


REQUEST_ORDER = ["posted", "doc", "item", "qty"]


@query(
    "allocate_stock",
    f"""WITH {LEDGER_SQL}, {STOCK_SQL}, asked AS (SELECT material, plant, posted, doc, item, qty,
    SUM(qty) OVER (PARTITION BY material, plant ORDER BY posted, doc, item, qty
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM ledger WHERE flag = 'H')
    SELECT material, plant, posted, doc, item, qty,
    GREATEST(0, LEAST(qty, COALESCE(stock, 0) * 0.5 - (asked - qty))) AS issued
    FROM asked LEFT JOIN stock USING (material, plant)""",
)
def allocate_stock(t: Tables):
    requests = ledger(t).where("flag = 'H'").select("material", "plant", *REQUEST_ORDER)
    half = stock(t).withColumn("stock", F.col("stock") * 0.5)
    return ops.allocate_stock(requests, half, REQUEST_ORDER)


FIFO_SQL = f"""WITH {LEDGER_SQL}, asked AS (SELECT material, posted, doc * 100 + item AS request_id, qty,
    SUM(qty) OVER (PARTITION BY material ORDER BY posted, doc, item, qty ROWS UNBOUNDED PRECEDING) AS high
    FROM ledger WHERE flag = 'H'), held AS (SELECT material, posted, doc * 100 + item AS batch_id, qty,
    SUM(qty) OVER (PARTITION BY material ORDER BY posted, doc, item, qty ROWS UNBOUNDED PRECEDING) AS high
    FROM ledger WHERE flag = 'S')
    SELECT a.material, request_id, batch_id, LEAST(a.high, h.high) - GREATEST(a.high - a.qty, h.high - h.qty) AS qty
    FROM asked a JOIN held h ON a.material = h.material AND a.high > h.high - h.qty AND h.high > a.high - a.qty"""


@query("fifo_batches", FIFO_SQL)
def fifo_batches(t: Tables):
    moves = ledger(t).withColumn("plant", F.lit(0)).withColumn("_id", F.col("doc") * 100 + F.col("item"))
    requests = moves.where("flag = 'H'").withColumnRenamed("_id", "request_id")
    batches = moves.where("flag = 'S'").withColumnRenamed("_id", "batch_id")
    return ops.fifo_batches(requests, batches, REQUEST_ORDER, REQUEST_ORDER).drop("plant")


CLIP_SQL = f"""{LEDGER_SQL}, opened AS (SELECT p_partkey AS material, CAST(p_size AS DOUBLE) AS opening FROM part),
    plain AS (SELECT material, posted, doc, item, code, flag, qty, COALESCE(opening, 0) AS opening, COALESCE(opening, 0)
      + SUM(signed) OVER (PARTITION BY material ORDER BY posted, flag, doc, item, qty, code ROWS UNBOUNDED PRECEDING)
      AS c FROM ledger LEFT JOIN opened USING (material)),
    low AS (SELECT *, GREATEST(0, -MIN(c) OVER (PARTITION BY material ORDER BY posted, flag, doc, item, qty, code
      ROWS UNBOUNDED PRECEDING)) AS lift FROM plain),
    clipped AS (SELECT material, posted, doc, item, code, flag, qty, CASE WHEN flag = 'H' THEN qty - (lift - COALESCE(
      LAG(lift) OVER (PARTITION BY material ORDER BY posted, flag, doc, item, qty, code), 0)) ELSE qty END AS real_qty,
      c + lift AS stock_after FROM low)"""


def clipped_ledger(t: Tables):
    opening = t.part.selectExpr("p_partkey AS material", "0 AS plant", "CAST(p_size AS DOUBLE) AS opening")
    moves = ledger(t).withColumn("plant", F.lit(0))
    order = ["posted", "flag", "doc", "item", "qty", "code"]
    return ops.clip_ledger(moves, opening, order).drop("plant")


@query("clip_ledger", f"WITH {CLIP_SQL} SELECT * FROM clipped")
def clip_ledger(t: Tables):
    return clipped_ledger(t)


@query(
    "rank_products",
    f"""WITH {PNL_SQL}, products AS (SELECT material,
    CAST(SUM(CAST(gross_profit AS DECIMAL(18, 4))) AS DOUBLE) AS gross_profit FROM pnl GROUP BY 1)
    (SELECT *, 'top' AS list FROM products ORDER BY gross_profit DESC, material LIMIT 20) UNION ALL
    (SELECT *, 'bottom' FROM products ORDER BY gross_profit, material LIMIT 20)""",
)
def rank_products(t: Tables):
    return ops.rank_products(pnl_detail(t), 20)


@query(
    "valuation_by_plant",
    f"""WITH {STOCK_SQL}, {PRICE_SQL} SELECT plant, COUNT(*) AS skus,
    CAST(SUM(CAST(ROUND(stock * price / unit, 2) AS DECIMAL(18, 4))) AS DOUBLE) AS value
    FROM stock JOIN prices USING (material) GROUP BY ROLLUP (plant)""",
)
def valuation_by_plant(t: Tables):
    valued = stock(t).join(prices(t), "material").withColumn(
        "value", fn.item_value(F.col("stock"), F.col("price"), F.col("unit"))
    )
    return ops.valuation_by(valued, "plant")
