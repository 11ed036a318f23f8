"""Node impact, shortfalls and order joins.

Order frames: ``orders`` (order_id, customer, ordered), ``lines`` (order_id, item, material, plant,
qty, net, due), ``delivered`` (order_id). Plans: (plan_id, material, plant, source, start, due, qty,
kind 'E' make / 'U' transfer). Lookups join without hints: Spark broadcasts those it measures as
small, and sorts or splits the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.functions import ledger as fn
from harborlens.operators.ledger import signed


def in_scope(
    df: DataFrame, plants: list | None, products: list | None, day: str, first: Column, last: Column
) -> DataFrame:
    """Plants in the list, products in the list (all when None) and days in the window."""
    keep = F.col(day).between(first, last)
    if plants is not None:
        keep = keep & F.col("plant").isin(plants)
    if products is not None:
        keep = keep & F.col("material").isin(products)
    return df.where(keep)


def open_orders(orders: DataFrame, delivered: DataFrame) -> DataFrame:
    """Orders without a delivery. An anti join: a null delivery id excludes nothing."""
    return orders.join(delivered.select("order_id"), "order_id", "left_anti")


def valued_inventory(
    stock: DataFrame, prices: DataFrame, places: DataFrame, nodes: list, inside: bool = True
) -> DataFrame:
    """Stock with text, place and value, inside or outside the listed nodes."""
    listed = F.col("plant").isin(nodes)
    value = F.coalesce(fn.item_value(F.col("stock"), F.col("price"), F.col("unit")), F.lit(0.0))
    return (
        stock.where(listed if inside else ~listed)
        .join(prices, "material", "left")
        .join(places, "plant", "left")
        .select("material", "plant", "place", "description", "stock", value.alias("value"))
    )


def planned_receipts(plans: DataFrame, prices: DataFrame, places: DataFrame) -> DataFrame:
    """What arrives at a plant: own production or a transfer from its source plant."""
    receiving = places.select("plant", F.col("place").alias("receiving_place"))
    shipping = places.select(F.col("plant").alias("source"), F.col("place").alias("source_place"))
    transfer = F.col("kind") == "U"
    return (
        plans.join(receiving, "plant", "left")
        .join(shipping, "source", "left")
        .join(prices.select("material", "description"), "material", "left")
        .select(
            "plan_id", "material", "description", "plant", "receiving_place", "due", "qty",
            F.when(F.col("kind") == "E", "PRODUCTION")
            .when(transfer, F.col("source").cast("string")).otherwise("OTHER").alias("ship_from"),
            F.when(transfer, F.col("source_place")).otherwise("In-house Production").alias("ship_from_place"),
            F.when(F.col("kind") == "E", "Production").when(transfer, "Stock Transfer")
            .otherwise(F.col("kind")).alias("order_type"),
        )
    )


def planned_issues(
    plans: DataFrame, orders: DataFrame, lines: DataFrame, delivered: DataFrame
) -> DataFrame:
    """What leaves a plant: transfers to other plants and open customer orders."""
    transfers = plans.where("kind = 'U'").select(
        F.col("source").alias("plant"), F.col("plant").alias("ship_to"), F.lit("INTERNAL").alias("customer_type"),
        "material", F.col("start").alias("due"), "qty", F.col("plan_id").alias("order_id"),
        F.lit("Stock Transfer").alias("order_type"),
    )
    sales = (
        open_orders(orders, delivered).join(lines, "order_id")
        .select(
            "plant", F.col("customer").alias("ship_to"), F.lit("CUSTOMER").alias("customer_type"),
            "material", "due", "qty", "order_id", F.lit("Customer Order").alias("order_type"),
        )
    )
    return transfers.unionByName(sales)


def lane_directions(lane_modes: DataFrame, places: DataFrame, nodes: list) -> DataFrame:
    """Lanes that touch the listed nodes, outbound first; transit time is in hours."""
    start = places.select(F.col("plant").alias("origin"), F.col("place").alias("origin_place"))
    end = places.select(F.col("plant").alias("target"), F.col("place").alias("target_place"))
    out, into = F.col("origin").isin(nodes), F.col("target").isin(nodes)
    return (
        lane_modes.where(out | into)
        .join(start, "origin", "left")
        .join(end, "target", "left")
        .withColumn("direction", F.when(out, "OUTBOUND").when(into, "INBOUND"))
        .withColumn("priority", F.when(F.col("preferred"), "Primary").otherwise("Alternate"))
    )


def shortfall(stock: DataFrame, demand: DataFrame, loss: DataFrame) -> DataFrame:
    """Demand against stock and loss per (material, plant): two full outer joins.

    Each side is summed per key first, so every key meets at most one row of the others.
    """
    keys = ["material", "plant"]
    held = stock.groupBy(*keys).agg(F.sum("stock").alias("stock"))
    asked = demand.groupBy(*keys).agg(
        F.sum("qty").alias("demand"),
        F.sum(fn.money(F.col("net"))).cast("double").alias("demand_value"),
        F.countDistinct("order_id").alias("orders"),
    )
    lost = loss.groupBy(*keys).agg(F.sum("qty").alias("lost"), F.lit(True).alias("_hit"))
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    return (
        asked.join(held, keys, "full").join(lost, keys, "full")
        .select(
            *keys,
            zero("stock").alias("stock"), zero("lost").alias("lost"), zero("demand").alias("demand"),
            zero("demand_value").alias("demand_value"),
            F.coalesce("orders", F.lit(0)).alias("orders"),
            (zero("stock") - zero("demand")).alias("stock_vs_demand"),
            F.greatest(zero("demand") - zero("stock"), F.lit(0.0)).alias("shortfall"),
            F.coalesce("_hit", F.lit(False)).alias("affected"),
        )
        .where((F.col("demand") > 0) | (F.col("lost") > 0))
    )


def shortfall_order() -> list[Column]:
    """Affected first, then short ones, then by the largest gap."""
    return [
        F.when(F.col("affected"), 0).otherwise(1),
        F.when(F.col("shortfall") > 0, 0).otherwise(1),
        F.desc(F.col("demand") - F.col("stock")),
        F.col("material"),
        F.col("plant"),
    ]


def touched_stock(stock: DataFrame, scenario: DataFrame) -> DataFrame:
    """Stock rows with at least one scenario movement (EXISTS)."""
    return stock.join(scenario.select("material", "plant"), ["material", "plant"], "left_semi")


def impact_join(stock: DataFrame, scenario: DataFrame) -> DataFrame:
    """Stock against the distinct scenario movements of its place."""
    moves = scenario.select("material", "plant", "doc", "code", "flag", "qty").distinct()
    return stock.join(moves, ["material", "plant"]).select(
        "material", "plant", "stock", "doc", "code", signed().alias("impact")
    )


def impacted_orders(orders: DataFrame, lines: DataFrame, delivered: DataFrame, lost: DataFrame) -> DataFrame:
    """Open order lines for (material, plant) pairs that lost stock."""
    pairs = lost.select("material", "plant")
    return (
        lines.join(pairs, ["material", "plant"], "left_semi")
        .join(orders, "order_id")
        .join(delivered.select("order_id"), "order_id", "left_anti")
        .select("order_id", "customer", "material", "plant", "qty", "net", "due")
    )


def flat_bom(heads: DataFrame, items: DataFrame, texts: DataFrame) -> DataFrame:
    """One-level bill of material: header, components and both texts."""
    return (
        heads.join(items, "bom")
        .join(texts.select("material", F.col("description").alias("material_text")), "material", "left")
        .join(
            texts.select(F.col("material").alias("component"), F.col("description").alias("component_text")),
            "component", "left",
        )
        .select("material", "material_text", "bom", "component", "component_text", "component_qty")
    )


def bom_requirements(plans: DataFrame, bom: DataFrame, rates: DataFrame) -> DataFrame:
    """Component need of planned orders through the bill of material of their material."""
    return order_requirements(plans.join(bom, "material"), rates)


def order_requirements(components: DataFrame, rates: DataFrame) -> DataFrame:
    """Component need and shortage per order; the worst delivery rate limits the order.

    ``components`` has one row per order and component (plan_id, material, qty, component,
    component_qty). ``rates`` names the unreliable components and the share of the need they deliver. An order is
    COMP when nothing is short, PART when some can be built and BLCK when none can.
    """
    need = (
        components.join(rates, "component", "left")
        .withColumn("needed", F.col("component_qty") * F.col("qty"))
        .withColumn("buildable", F.col("qty") * F.coalesce("rate", F.lit(1.0)))
        .withColumn("shortage", F.col("component_qty") * (F.col("qty") - F.col("buildable")))
    )
    built = F.floor(F.least("_built", "qty"))
    return (
        need.groupBy("plan_id", "material", "qty")
        .agg(
            F.min("buildable").alias("_built"),
            F.sum("needed").alias("needed"),
            F.sum(fn.money(F.col("shortage"))).cast("double").alias("shortage"),
            F.count_if(F.col("shortage") > 0).alias("short_components"),
        )
        .withColumn("built", built)
        .withColumn(
            "status",
            F.when(F.col("built") <= 0, "BLCK").when(F.col("built") < F.col("qty"), "PART").otherwise("COMP"),
        )
        .drop("_built")
    )


def document_flow_edges(flow: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Order to delivery edges; a delivery without a header stays with a null date."""
    return (
        flow.where((F.col("from_kind") == "C") & (F.col("to_kind") == "J"))
        .join(deliveries, "delivery_id", "left")
        .select("order_id", "delivery_id", "delivered_on", "qty")
    )


# Summaries


def receipts_by(receipts: DataFrame, *dims: str) -> DataFrame:
    return receipts.groupBy(*dims).agg(F.countDistinct("plan_id").alias("orders"), F.sum("qty").alias("qty"))


def issues_by(issues: DataFrame, *dims: str) -> DataFrame:
    return issues.groupBy(*dims).agg(F.countDistinct("order_id").alias("orders"), F.sum("qty").alias("qty"))


def lane_summary(lane_modes: DataFrame, dim: str) -> DataFrame:
    """Lanes, mean transit hours and mean cost by mode or priority."""
    mean = lambda name: F.sum(fn.money(F.col(name))).cast("double") / F.count(name)
    return lane_modes.groupBy(dim).agg(
        F.countDistinct("lane").alias("lanes"), mean("hours").alias("mean_hours"), mean("cost").alias("mean_cost")
    )


def node_net_position(stock: DataFrame, receipts: DataFrame, issues: DataFrame) -> DataFrame:
    """Stock plus planned receipts less planned issues, per plant."""
    rows = (
        stock.select("plant", F.col("stock").alias("held"), F.lit(0.0).alias("received"), F.lit(0.0).alias("issued"))
        .unionByName(receipts.select("plant", F.lit(0.0).alias("held"), F.col("qty").alias("received"), F.lit(0.0).alias("issued")))
        .unionByName(issues.select("plant", F.lit(0.0).alias("held"), F.lit(0.0).alias("received"), F.col("qty").alias("issued")))
    )
    return (
        rows.groupBy("plant")
        .agg(F.sum("held").alias("stock"), F.sum("received").alias("receipts"), F.sum("issued").alias("issues"))
        .withColumn("net_position", F.col("stock") + F.col("receipts") - F.col("issues"))
    )


def share_by(df: DataFrame, dim: str, value: Column) -> DataFrame:
    """Summed value per dimension and its share of the total in percent."""
    grouped = df.groupBy(dim).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(fn.money(value)).alias("_value")
    )
    total = grouped.agg(F.sum("_value")).scalar().cast("double")
    value = F.col("_value").cast("double")
    return grouped.select(dim, "rows", value.alias("value"), (value / total * 100).alias("share_pct"))


def customer_impact(impacted: DataFrame) -> DataFrame:
    return impacted.groupBy("customer").agg(
        F.countDistinct("order_id").alias("orders"),
        F.sum("qty").alias("qty"),
        F.sum(fn.money(F.col("net"))).cast("double").alias("value"),
    )


def impact_kpis(impacted: DataFrame) -> DataFrame:
    return impacted.agg(
        F.countDistinct("order_id").alias("orders"),
        F.countDistinct("customer").alias("customers"),
        F.sum(fn.money(F.col("net"))).cast("double").alias("revenue_at_risk"),
        F.sum("qty").alias("units"),
    )


def affected_customers(orders: DataFrame, lines: DataFrame, material) -> DataFrame:
    """Orders, units and value per customer of one material, with a total row (null customer)."""
    return (
        lines.where(F.col("material") == material)
        .join(orders, "order_id")
        .rollup("customer")
        .agg(
            F.countDistinct("order_id").alias("orders"),
            F.sum("qty").alias("units"),
            F.sum(fn.money(F.col("net"))).cast("double").alias("value"),
        )
    )


def pending_deliveries(lines: DataFrame, texts: DataFrame, plant, n: int) -> DataFrame:
    """The n materials with the largest quantity waiting at a plant."""
    return (
        lines.where(F.col("plant") == plant)
        .groupBy("material")
        .agg(F.countDistinct("order_id").alias("deliveries"), F.sum("qty").alias("qty"))
        .orderBy(F.desc("qty"), "material")
        .limit(n)
        .join(texts.select("material", "description"), "material", "left")
    )


def customer_products(orders: DataFrame, lines: DataFrame, customer) -> DataFrame:
    """What one customer orders, by product, and how many other customers order it too."""
    bought = lines.join(orders, "order_id").select("material", "customer", "order_id", "qty")
    own = bought.where(F.col("customer") == customer).groupBy("material").agg(
        F.countDistinct("order_id").alias("orders"), F.sum("qty").alias("qty")
    )
    others = (
        bought.where(F.col("customer") != customer)
        .groupBy("material").agg(F.countDistinct("customer").alias("other_customers"))
    )
    return own.join(others, "material", "left").withColumn(
        "other_customers", F.coalesce("other_customers", F.lit(0))
    )


def scenario_value(losses: DataFrame, plant_prices: DataFrame) -> DataFrame:
    """Loss value per scenario; the price at the plant, else the one at the lowest-numbered plant."""
    any_price = plant_prices.groupBy("material").agg(F.min_by("price", "plant").alias("_any"))
    value = F.col("qty") * F.coalesce("price", "_any", F.lit(0.0))
    return (
        losses.join(plant_prices.select("material", "plant", "price"), ["material", "plant"], "left")
        .join(any_price, "material", "left")
        .groupBy("scenario")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("price").isNull()).alias("fallback_prices"),
            F.sum(fn.money(value)).cast("double").alias("value"),
        )
    )


def count_rows(named: dict[str, DataFrame]) -> DataFrame:
    """One (metric, rows) row per frame: a union of counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n") for name, df in named.items()]
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    return counted
