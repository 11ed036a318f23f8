"""Scenarios, parameter grids and what-if runs on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlens.functions import ledger as fn
from harborlens.operators import ledger as ledger_ops
from harborlens.operators import params, scenario
from harborlens.functions import draws
from harborlens.operators.dirty import row_draw
from harborlens.plans.bind import LEDGER_SQL, STOCK_SQL, ledger, stock
from harborlens.plans.impact_plans import heads, lines
from harborlens.plans.ledger_plans import CLIP_SQL, clipped_ledger, day
from harborlens.plans.quality_plans import draw_sql, plain_draw
from harborlens.plans.registry import Tables, query

STORES_SQL = """stores AS (SELECT l_partkey AS material, l_suppkey AS plant, l_linestatus AS store, SUM(l_quantity) AS stock
    FROM lineitem GROUP BY 1, 2, 3)"""


def stores(t: Tables):
    return t.lineitem.groupBy(
        F.col("l_partkey").alias("material"), F.col("l_suppkey").alias("plant"), F.col("l_linestatus").alias("store")
    ).agg(F.sum("l_quantity").alias("stock"))


@query(
    "remove_stock_location",
    f"""WITH {STOCK_SQL} SELECT 'fire' AS scenario, material, plant, DATE '2000-01-15' AS posted, '551' AS code, 'H' AS flag,
    stock AS qty FROM stock WHERE plant IN (2, 4) AND stock > 0""",
)
def remove_stock_location(t: Tables):
    return scenario.remove_stock(stock(t), F.col("plant").isin(2, 4), "fire", day("2000-01-15"))


@query(
    "remove_stock_product",
    f"""WITH {STOCK_SQL} SELECT 'contamination' AS scenario, material, plant, DATE '2000-01-15' AS posted, '344' AS code, 'H' AS flag,
    stock * 0.25 AS qty FROM stock WHERE material IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') AND stock > 0""",
)
def remove_stock_product(t: Tables):
    affected = stock(t).join(t.part.where("p_type = 'PROMO'"), F.col("material") == F.col("p_partkey"), "left_semi")
    return scenario.remove_stock(affected, F.lit(True), "contamination", day("2000-01-15"), code="344", share=0.25)


@query(
    "blocked_documents",
    f"""WITH {LEDGER_SQL} SELECT DISTINCT doc FROM ledger WHERE plant IN (2, 4) AND posted >= DATE '1998-03-01'
    AND posted < DATE '1998-03-31' AND code IN ('101', '102', '601', '261', '311')""",
)
def blocked_documents(t: Tables):
    return scenario.blocked_documents(ledger(t), [2, 4], day("1998-03-01"), 30)


@query(
    "quarantine",
    f"""WITH {STORES_SQL} SELECT 'quarantine' AS scenario, material, plant, store, 'QA01' AS other_store, 1 AS item, '311' AS code,
    'H' AS flag, stock AS qty, DATE '2000-01-15' AS posted FROM stores WHERE plant IN (3, 5)
    UNION ALL SELECT 'quarantine', material, plant, 'QA01', store, 2, '311', 'S', stock, DATE '2000-01-15' FROM stores
    WHERE plant IN (3, 5)""",
)
def quarantine(t: Tables):
    return scenario.quarantine(stores(t), F.col("plant").isin(3, 5), "quarantine", day("2000-01-15"))


@query(
    "reroute",
    f"""WITH {STORES_SQL} SELECT 'offline' AS scenario, material, plant, store, store AS other_store, 1 AS item, '311' AS code,
    'H' AS flag, stock AS qty, DATE '2000-01-15' AS posted FROM stores WHERE plant IN (3, 5)
    UNION ALL SELECT 'offline', material, CAST(CASE material % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS BIGINT), store, store,
    2, '311', 'S', stock, DATE '2000-01-15' FROM stores WHERE plant IN (3, 5)""",
)
def reroute(t: Tables):
    return scenario.reroute(stores(t), [3, 5], [1, 2, 4], "offline", day("2000-01-15"))


@query(
    "apply_ledger",
    f"""WITH {STOCK_SQL}, {LEDGER_SQL}, change AS (SELECT material, plant, SUM(signed) AS change FROM ledger
    WHERE posted >= DATE '1999-01-01' GROUP BY 1, 2) SELECT material, plant,
    CASE WHEN stock IS NOT NULL THEN GREATEST(0, stock + COALESCE(change, 0)) END AS stock, stock IS NULL AS unmatched,
    COALESCE(change, 0) AS change FROM stock FULL JOIN change USING (material, plant)""",
)
def apply_ledger(t: Tables):
    rows = ledger(t).where("posted >= DATE '1999-01-01'")
    return scenario.apply_ledger(stock(t), rows, ["material", "plant"])


CASCADE_SQL = f"""WITH {CLIP_SQL}, real AS (SELECT doc AS delivery_id, material, SUM(real_qty) AS real_qty FROM clipped
    WHERE flag = 'H' GROUP BY 1, 2), items AS (SELECT doc AS delivery_id, material, SUM(qty) AS qty FROM ledger
    WHERE flag = 'H' GROUP BY 1, 2), adjusted AS (SELECT delivery_id, material, LEAST(qty, COALESCE(real_qty, qty)) AS qty
    FROM items LEFT JOIN real USING (delivery_id, material) WHERE LEAST(qty, COALESCE(real_qty, qty)) > 0)"""


def cascade(t: Tables):
    items = ledger(t).where("flag = 'H'").groupBy(F.col("doc").alias("delivery_id"), "material").agg(F.sum("qty").alias("qty"))
    clipped = clipped_ledger(t).where("flag = 'H'").withColumnRenamed("doc", "delivery_id")
    headers = t.orders.selectExpr("o_orderkey AS delivery_id", "o_custkey AS customer")
    return scenario.cascade_adjustments(clipped, items, headers, items)


@query("cascade_items", f"{CASCADE_SQL} SELECT * FROM adjusted")
def cascade_items(t: Tables):
    return cascade(t)[0]


@query(
    "cascade_headers",
    f"""{CASCADE_SQL} SELECT o_orderkey AS delivery_id, o_custkey AS customer FROM orders
    WHERE o_orderkey IN (SELECT delivery_id FROM adjusted)""",
)
def cascade_headers(t: Tables):
    return cascade(t)[1]


@query("cascade_flow", f"{CASCADE_SQL} SELECT delivery_id, material, LEAST(i.qty, a.qty) AS qty FROM items i JOIN adjusted a USING (delivery_id, material)")
def cascade_flow(t: Tables):
    return cascade(t)[2]


def order_lines(t: Tables):
    return lines(t).join(heads(t), "order_id")


@query("demand_surge")
def demand_surge(t: Tables):
    customers = t.customer.selectExpr("c_custkey AS customer")
    return scenario.extra_demand(order_lines(t), customers, 30, day("2002-01-01"), F.lit(10**12), seed=1)


@query("emergency_demand")
def emergency_demand(t: Tables):
    customers = t.customer.selectExpr("c_custkey AS customer")
    return scenario.extra_demand(
        order_lines(t), customers, 150, day("2002-01-01"), F.lit(10**12), seed=2, spread=(1.0, 2.0), lead_days=(1, 3)
    )


PRODUCTION_SQL = """production AS (SELECT o_orderkey AS order_id, o_custkey AS plant, CAST(o_orderdate AS DATE) AS start,
    CAST(o_orderdate AS DATE) + 7 AS due, o_totalprice AS qty FROM orders)"""


def production(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey AS order_id", "o_custkey AS plant", "CAST(o_orderdate AS DATE) AS start",
        "DATE_ADD(CAST(o_orderdate AS DATE), 7) AS due", "o_totalprice AS qty",
    )


PLANTS = [10, 20, 30, 40, 50]


@query(
    "equipment_failure",
    f"""WITH {PRODUCTION_SQL}, hit AS (SELECT *, plant IN (10, 20, 30, 40, 50) AND start BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
    AS hit, {draw_sql('order_id', 'cancel')} < 0.3 AS lose FROM production),
    moved AS (SELECT *, hit AND NOT lose AS shift, CAST(DATE '1999-12-31' + CAST(1 + FLOOR({draw_sql('order_id', 'start')} * 7) AS INTEGER) AS DATE)
      AS new_start FROM hit)
    SELECT order_id, plant, qty, CASE WHEN shift THEN new_start ELSE start END AS start, CASE WHEN shift THEN
      CAST(new_start + CAST(3 + FLOOR({draw_sql('order_id', 'end')} * 8) AS INTEGER) AS DATE) ELSE due END AS due,
      CASE WHEN hit AND lose THEN 'CANC' WHEN hit THEN 'RSCH' ELSE 'REL' END AS status FROM moved""",
)
def equipment_failure(t: Tables):
    return scenario.equipment_failure(production(t), PLANTS, day("1996-01-01"), 1460, 0.3, plain_draw("order_id"))


@query(
    "delivery_freeze",
    f"""WITH {PRODUCTION_SQL} SELECT * FROM production WHERE plant IN (10, 20, 30, 40, 50)
    AND due BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
)
def delivery_freeze(t: Tables):
    return scenario.delivery_freeze(production(t), PLANTS, day("1998-01-01"), 364)


@query(
    "capacity_ramp",
    f"""WITH weeks AS (SELECT p_partkey AS material, CAST(w AS INTEGER) AS week, LEAST(1.0, 0.2 + CAST(0.8 AS DOUBLE) * w / 12) AS capacity
    FROM part, range(0, 12) r(w)) SELECT 99 AS plant, material, week, capacity,
    CAST(FLOOR(CAST(200 + FLOOR({draw_sql('material', 'qty')} * 301) AS INTEGER) * capacity) AS BIGINT) AS qty,
    CAST(DATE '2000-01-03' + CAST(week * 7 + FLOOR({draw_sql('material', 'day')} * 5) AS INTEGER) AS DATE) AS start, 'REL' AS status FROM weeks""",
)
def capacity_ramp(t: Tables):
    products = t.part.selectExpr("p_partkey AS material")
    return scenario.capacity_ramp(products, 99, day("2000-01-03"), 12, plain_draw("material"))


@query(
    "capacity_load",
    f"""WITH {PRODUCTION_SQL} SELECT order_id, plant, start, due, 1 AS copy,
    CAST(300 + FLOOR({draw_sql('order_id', 'qty')} * 501) AS DOUBLE) AS qty FROM production
    WHERE plant IN (10, 20, 30, 40, 50) AND {draw_sql('order_id', 'extra')} < (90 / 100.0 - 0.6) / 0.6""",
)
def capacity_load(t: Tables):
    return scenario.capacity_load(production(t), PLANTS, 90, plain_draw("order_id"))


COMPETING_DRAW = lambda tag: draws.draw_sql("material", "week", seed=3, tag=tag)


@query(
    "competing_orders",
    f"""WITH weeks AS (SELECT p_partkey AS material, CAST(week AS INTEGER) AS week FROM part, range(4) r(week)),
    drawn AS (SELECT *, 2 + FLOOR({COMPETING_DRAW('n')} * 2) AS n, CAST(400 + FLOOR({COMPETING_DRAW('qty')} * 501) AS INTEGER) AS qty,
      CAST(DATE '2000-01-03' + CAST(week * 7 + FLOOR({COMPETING_DRAW('day')} * 5) AS INTEGER) AS DATE) AS start,
      CAST(5 + FLOOR({COMPETING_DRAW('end')} * 6) AS INTEGER) AS days FROM weeks)
    SELECT 99 AS plant, material, week, CAST(number AS INTEGER) AS number, qty, start, CAST(start + days AS DATE) AS due
    FROM drawn JOIN range(1, 4) k(number) ON number <= n""",
)
def competing_orders(t: Tables):
    products = t.part.selectExpr("p_partkey AS material")
    return scenario.competing_orders(products, 99, day("2000-01-03"), row_draw("material", "week", seed=3))


@query("supplier_performance")
def supplier_performance(t: Tables):
    """On-time and in-full rates per vendor before and after the scenario."""
    given = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "l_orderkey AS doc", "l_linenumber AS item", "l_suppkey AS vendor", "CAST(l_shipdate AS DATE) AS posted",
        "l_quantity AS qty", "CAST(l_shipdate AS DATE) <= DATE_ADD(CAST(o_orderdate AS DATE), 90) AS on_time",
        "l_returnflag <> 'R' AS in_full",
    )
    draw = row_draw("doc", "item", "vendor", "posted", "qty", seed=4)
    after = scenario.supplier_performance(given, [1, 2, 3], day("1998-01-01"), 0.6, "DECLINE", draw)
    label = lambda df, name: df.withColumn("phase", F.lit(name))
    both = label(given, "before").unionByName(label(after, "after"))
    return ledger_ops.otif(both, "vendor", "phase")


# Parameter grids: axes are read off the tables


@query(
    "param_grid_mesh",
    """WITH bounds AS (SELECT MIN(p_size) AS lo, MAX(p_size) AS hi, COUNT(*) AS n, MAX(p_retailprice) AS top FROM part)
    SELECT i * 40 + j AS run, lo + i * (hi - lo) / (n // 20 - 1.0) AS size, top * j / 40 AS price
    FROM bounds, range((SELECT n // 20 FROM bounds)) a(i), range(40) b(j)""",
)
def param_grid_mesh(t: Tables):
    bounds = t.part.agg(
        F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("top")
    ).first()
    n = bounds["n"] // 20
    sizes = [bounds["lo"] + i * (bounds["hi"] - bounds["lo"]) / (n - 1.0) for i in range(n)]
    return params.param_grid(t.spark, {"size": sizes, "price": [bounds["top"] * j / 40 for j in range(40)]})


@query(
    "param_group",
    """WITH b AS (SELECT COUNT(*) AS n FROM supplier) SELECT CAST(i AS BIGINT) AS run, CAST(i AS DOUBLE) AS rate, CAST(NULL AS DOUBLE) AS lot, 0 AS plan
    FROM b, range((SELECT n FROM b)) r(i) UNION ALL SELECT i, NULL, 5.0 + 2.5 * i, 1 FROM b, range((SELECT CAST(FLOOR((n * 5) / 2.5) AS BIGINT) + 1 FROM b)) r(i)""",
)
def param_group(t: Tables):
    n = t.supplier.count()
    rates = params.param_grid(t.spark, {"rate": [float(v) for v in params.linspace(0, n - 1, n)]})
    lots = params.param_grid(t.spark, {"lot": params.arange(5.0, 5.0 + n * 5, 2.5)})
    return params.group_plans([rates, lots])


@query("sampled_demand")
def sampled_demand(t: Tables):
    """A demand factor, a lot count and two shares drawn for every part."""
    ids = t.part.select("p_partkey")
    ids = params.sample_parameter(ids, "p_partkey", "factor", "normal", seed=5, mean=1.0, std=0.2)
    ids = params.sample_parameter(ids, "p_partkey", "scale", "log-normal", seed=5, mu=0.0, sigma=0.5)
    ids = params.sample_parameter(ids, "p_partkey", "lots", "poisson", seed=5, rate=3.0)
    ids = params.sample_parameter(ids, "p_partkey", "share", "beta", seed=5, alpha=2.0, beta=5.0)
    return params.sample_parameter(ids, "p_partkey", "delay", "gamma", seed=5, shape=2.0, scale=1.5)


VARIANTS = [{"discount": d, "from_qty": q} for d in (0.0, 0.05, 0.1) for q in (10, 30)]


@query(
    "what_if_pricing",
    "WITH facts AS (SELECT l_returnflag, l_quantity, CAST(l_extendedprice AS DECIMAL(18, 2)) AS price FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT l_returnflag, {i} AS run, 'discount={v["discount"]}, from_qty={v["from_qty"]}' AS label,
        CAST(SUM(CASE WHEN l_quantity >= {v["from_qty"]} THEN price * CAST({1 - v["discount"]} AS DECIMAL(4, 2)) ELSE price END)
        AS DOUBLE) AS value FROM facts GROUP BY 1""" for i, v in enumerate(VARIANTS)
    ),
)
def what_if_pricing(t: Tables):
    def revenue(variant):
        price = fn.money(F.col("l_extendedprice"), 2)
        less = price * F.lit(1 - variant["discount"]).cast("decimal(4,2)")
        return F.sum(F.when(F.col("l_quantity") >= variant["from_qty"], less).otherwise(price)).cast("double")

    return params.what_if(t.lineitem, VARIANTS, revenue, ["l_returnflag"])


@query("shortage_and_volatility")
def shortage_and_volatility(t: Tables):
    """Two milder demand variants: longer lead times, and quantities between a fifth and twice the usual."""
    customers = t.customer.selectExpr("c_custkey AS customer")
    make = lambda label, **how: scenario.extra_demand(
        order_lines(t), customers, 10, day("2002-01-01"), F.lit(10**12), seed=6, **how
    ).withColumn("variant", F.lit(label))
    return make("shortage", lead_days=(30, 60)).unionByName(make("volatility", spread=(0.2, 2.0)))
