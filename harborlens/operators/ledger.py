"""Stock-ledger aggregates and windows.

Frames use one vocabulary: ``material, plant, posted (date), qty, flag ('S' in / 'H' out), code``
for movements; ``material, plant, stock`` for stock; ``material, price, unit`` for valuation.
Windows run over sums per day, week or month, never over raw movements, so one material or plant
with a third of the ledger costs no more than its number of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborlens.functions import ledger as fn
from harborlens.functions.text import padded
from harborlens.operators.scan import prefix_scan


def signed() -> Column:
    return fn.signed_qty(F.col("flag"), F.col("qty"))


def _cumulative(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


# Aggregates


def impact_summary(ledger: DataFrame, scenario: Column) -> DataFrame:
    """Movements of each scenario by code: rows, net quantity, materials and plants touched."""
    return (
        ledger.withColumn("scenario", scenario)
        .where(F.col("scenario").isNotNull())
        .groupBy("scenario", "code")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.sum(signed()).alias("net_qty"),
            F.countDistinct("material").alias("materials"),
            F.countDistinct("plant").alias("plants"),
        )
    )


def movement_distribution(ledger: DataFrame, is_scenario: Column) -> DataFrame:
    """Scenario against normal movements by code, with the code's name."""
    return ledger.groupBy("code").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(is_scenario).alias("scenario_records"),
        F.count_if(~is_scenario).alias("normal_records"),
        F.sum("qty").alias("total_qty"),
    ).withColumn("description", fn.movement_name(F.col("code")))


def product_location_volume(ledger: DataFrame, finished: DataFrame, as_of: Column, months: int) -> DataFrame:
    """Volume in and out of finished goods over the months before ``as_of``."""
    return (
        ledger.where(F.col("posted").between(F.add_months(as_of, -months), as_of))
        .join(finished.select("material"), "material", "left_semi")
        .groupBy("material", "plant")
        .agg(
            F.sum(F.when(F.col("flag") == "S", F.col("qty")).otherwise(0.0)).alias("volume_in"),
            F.sum(F.when(F.col("flag") == "H", F.col("qty")).otherwise(0.0)).alias("volume_out"),
        )
        .withColumn("activity", F.col("volume_in") + F.col("volume_out"))
    )


def stock_position(ledger: DataFrame) -> DataFrame:
    """Net quantity by material and plant, positive positions only."""
    return (
        ledger.groupBy("material", "plant").agg(F.sum(signed()).alias("stock")).where(F.col("stock") > 0)
    )


def valuation_by(valued: DataFrame, *dims: str) -> DataFrame:
    """SKU count and value per dimension with a grand total (null dimension), in one pass."""
    return valued.rollup(*dims).agg(
        F.count(F.lit(1)).alias("skus"),
        F.sum(fn.money(F.col("value"))).cast("double").alias("value"),
    )


def product_pnl(flow: DataFrame, cost: DataFrame) -> DataFrame:
    """Profit and loss by plant and material.

    ``flow`` has one row per delivered line (material, plant, delivered, net, ordered). Revenue is
    delivered quantity at the line's unit price; cost of goods is quantity at standard cost.
    """
    price = fn.unit_price(F.col("net"), F.col("ordered"))
    sales = (
        flow.withColumn("unit_price", price)
        .groupBy("plant", "material")
        .agg(
            F.sum("delivered").alias("qty_sold"),
            F.sum(fn.money(F.col("unit_price"), 10)).alias("_prices"),
            F.count(F.lit(1)).alias("_lines"),
            F.sum(fn.money(F.col("delivered") * F.col("unit_price"))).cast("double").alias("revenue"),
        )
        .withColumn("unit_price", F.col("_prices").cast("double") / F.col("_lines"))
    )
    return with_margin(
        sales.join(cost.select("material", "material_type", "unit_cost"), "material", "left")
        .withColumn("unit_cost", F.coalesce("unit_cost", F.lit(0.0)))
        .withColumn("cogs", F.round(F.col("qty_sold") * F.col("unit_cost"), 6))
        .drop("_prices", "_lines")
    )


def with_margin(pnl: DataFrame) -> DataFrame:
    """Gross profit and margin in percent, recomputed from revenue and cost."""
    profit = F.round(F.col("revenue") - F.col("cogs"), 6)
    margin = F.when(F.col("revenue") > 0, F.round(profit / F.col("revenue") * 100, 4)).otherwise(0.0)
    return pnl.withColumn("gross_profit", profit).withColumn("margin_pct", margin)


def pnl_by(pnl: DataFrame) -> DataFrame:
    """P&L by type, by plant, by product and in total: grouping sets in one pass."""
    sets = [
        [F.col("material_type")],
        [F.col("plant")],
        [F.col("material")],
        [],
    ]
    grouped = pnl.groupingSets(sets, "material_type", "plant", "material").agg(
        F.grouping_id().alias("_level"),
        F.sum("qty_sold").alias("qty_sold"),
        F.sum(fn.money(F.col("revenue"))).cast("double").alias("revenue"),
        F.sum(fn.money(F.col("cogs"))).cast("double").alias("cogs"),
    )
    level = (
        F.when(F.col("_level") == 3, "type")
        .when(F.col("_level") == 5, "plant")
        .when(F.col("_level") == 6, "product")
        .otherwise("total")
    )
    return with_margin(grouped.withColumn("level", level)).drop("_level")


def monthly_plan(plan: DataFrame, keys: list[str]) -> DataFrame:
    """Planned quantity per key and month (yyyy-MM), as rows."""
    return plan.groupBy(*keys, "month").agg(F.sum("qty").alias("qty"))


def monthly_pivot(plan: DataFrame, keys: list[str], months: list[str] | None = None) -> DataFrame:
    """Planned quantity with one column per month: the listed ones, or all of the data's."""
    rows = monthly_plan(plan, keys)
    if months is None:
        months = [r.month for r in rows.select("month").distinct().orderBy("month").collect()]  # one row per month
    return rows.groupBy(*keys).pivot("month", months).agg(F.first("qty")).na.fill(0.0, months)


def weekly_load(plan: DataFrame) -> DataFrame:
    return plan.groupBy("plant", fn.week_start(F.col("posted")).alias("week_start"), "material").agg(
        F.sum("qty").alias("qty")
    )


def safety_stock_summary(targets: DataFrame) -> DataFrame:
    """Materials with a target above zero and the summed target, by plant."""
    return targets.where(F.col("safety") > 0).groupBy("plant").agg(
        F.count(F.lit(1)).alias("materials"), F.sum("safety").alias("safety")
    )


def otif(receipts: DataFrame, *dims: str) -> DataFrame:
    """On-time, in-full and both, as shares of receipts; overall when no dimension is given."""
    both = F.col("on_time") & F.col("in_full")
    rate = lambda hit: F.count_if(hit) / F.count(F.lit(1))
    return receipts.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("receipts"),
        rate(F.col("on_time")).alias("on_time_rate"),
        rate(F.col("in_full")).alias("in_full_rate"),
        rate(both).alias("otif_rate"),
    )


def consumption_by_material(ledger: DataFrame, code: str = "261") -> DataFrame:
    return ledger.where(F.col("code") == code).groupBy("material").agg(F.sum("qty").alias("consumed"))


# Windows over day, week and month sums


def running_balance(ledger: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """Net movement and balance per day from ``start`` on; earlier days make the opening."""
    daily = ledger.groupBy(*keys, "posted").agg(F.sum(signed()).alias("net"))
    balance = daily.withColumn("balance", F.sum("net").over(_cumulative(keys, "posted")))
    return balance.where(F.col("posted") >= start)


def weekly_stock_value(
    ledger: DataFrame, prices: DataFrame, opening: float, dims: list[str]
) -> DataFrame:
    """Value of positive weekly balances by week and dimension (type, plant or none)."""
    weekly = ledger.groupBy("material", "plant", fn.week_start(F.col("posted")).alias("week_start")).agg(
        F.sum(signed()).alias("net")
    )
    balance = F.lit(opening) + F.sum("net").over(_cumulative(["material", "plant"], "week_start"))
    return (
        weekly.withColumn("balance", balance)
        .where(F.col("balance") > 0)
        .join(prices, "material")
        .groupBy("week_start", *dims)
        .agg(F.sum(fn.money(F.col("balance") * F.col("price"))).cast("double").alias("value"))
    )


def reconstruct_stock(current: DataFrame, ledger: DataFrame, first: Column, last: Column) -> DataFrame:
    """Daily stock that ends at the current stock: start = current - net of all movements."""
    keys = ["material", "plant"]
    daily = ledger.groupBy(*keys, "posted").agg(F.sum(signed()).alias("net"))
    after = (
        Window.partitionBy(*keys).orderBy("posted").rowsBetween(1, Window.unboundedFollowing)
    )
    later = F.coalesce(F.sum("net").over(after), F.lit(0.0))
    return (
        daily.withColumn("_later", later)
        .where(F.col("posted").between(first, last))
        .join(current.select(*keys, "stock"), keys, "left")
        .select(*keys, "posted", "net", (F.coalesce("stock", F.lit(0.0)) - F.col("_later")).alias("stock"))
    )


def month_end_snapshots(ledger: DataFrame, opening: DataFrame, keys: list[str]) -> DataFrame:
    """Month-end stock of every key in every month of the ledger, clipped at zero.

    A month is kept when it has a change or the unclipped balance is not zero. Balances only move
    in months with movements, so each such row is stretched to the month before the next one
    instead of crossing all keys with all months.
    """
    monthly = ledger.groupBy(*keys, fn.month_start(F.col("posted")).alias("month")).agg(
        F.sum(signed()).alias("change")
    )
    span = monthly.agg(F.min("month").alias("first"), F.max("month").alias("last"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    starts = monthly.select(*keys).distinct().withColumn("month", first).withColumn("change", F.lit(0.0))
    rows = monthly.unionByName(starts).groupBy(*keys, "month").agg(F.sum("change").alias("change"))
    ordered = Window.partitionBy(*keys).orderBy("month")
    balance = F.coalesce("opening", F.lit(0.0)) + F.sum("change").over(
        ordered.rowsBetween(Window.unboundedPreceding, 0)
    )
    held = (
        rows.join(opening.select(*keys, "opening"), keys, "left")
        .withColumn("balance", balance)
        .withColumn("until", F.coalesce(F.add_months(F.lead("month").over(ordered), -1), last))
    )
    spread = held.select(
        *keys,
        F.explode(F.sequence("month", "until", F.expr("interval 1 month"))).alias("period"),
        "month",
        "change",
        "balance",
    )
    return (
        spread.withColumn("change", F.when(F.col("period") == F.col("month"), F.col("change")).otherwise(0.0))
        .where((F.col("change") != 0) | (F.col("balance") != 0))
        .join(monthly.select(F.col("month").alias("period")).distinct(), "period", "left_semi")
        .select(*keys, "period", F.greatest(F.lit(0.0), "balance").alias("stock"))
    )


def line_numbers(items: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Item numbers in steps of ten within each document, six digits or more.

    The first order column makes the buckets of the scan, so a document may have any number of items.
    """
    numbered = prefix_scan(items, [group], order[0], order, F.lit(1), "_at")
    return numbered.withColumn("line_no", padded(F.col("_at") * 10, 6)).drop("_at")


def replenishment(demand: DataFrame, policy: DataFrame, opening_factor: float = 1.2) -> DataFrame:
    """Whole-lot orders that keep every plant at its safety stock, hub serving the spokes.

    ``demand`` has (material, plant, week, qty), ``policy`` (material, plant, safety, lot, is_hub).
    By week t a plant must have ordered K = max(0, running max of ceil((safety - opening +
    demand so far) / lot)) lots, so the order of week t is lot * (K - K before). K can only grow in
    a week with demand (or in the first week), so weeks without demand need no rows. Spoke orders
    join the hub's own demand, then the hub runs through the same formula.
    """
    keys = ["material", "plant"]
    need = demand.groupBy(*keys, "week").agg(F.sum("qty").alias("qty"))
    weeks = need.groupBy("material").agg(F.min("week").alias("week"))
    starts = policy.join(weeks, "material").select(*keys, "week", F.lit(0.0).alias("qty"))
    rules = policy.select(*keys, "is_hub", "safety", "lot")

    def orders(flow: DataFrame) -> DataFrame:
        ordered = Window.partitionBy(*keys).orderBy("week")
        upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
        gap = F.col("safety") * F.lit(1.0 - opening_factor) + F.sum("qty").over(upto)
        lots = F.greatest(F.lit(0), F.max("_need").over(upto))
        return (
            flow.withColumn("_need", F.ceil(F.round(gap / F.col("lot"), 9)))
            .withColumn("_lots", lots)
            .withColumn("order_qty", F.col("lot") * (F.col("_lots") - F.coalesce(F.lag("_lots").over(ordered), F.lit(0))))
        )

    weekly = need.unionByName(starts).groupBy(*keys, "week").agg(F.sum("qty").alias("qty")).join(rules, keys)
    spokes = orders(weekly.where(~F.col("is_hub"))).where(F.col("order_qty") > 0)
    hubs = policy.where("is_hub").select("material", F.col("plant").alias("hub"))
    spoke_orders = spokes.join(hubs, "material").select(
        F.lit("TRNS").alias("type"), "material", F.col("hub").alias("supply_plant"),
        F.col("plant").alias("receive_plant"), "week", F.col("order_qty").cast("double").alias("qty"),
    )
    outflow = spoke_orders.select("material", F.col("supply_plant").alias("plant"), "week", "qty")
    hub_weekly = (
        weekly.where("is_hub").select(*keys, "week", "qty").unionByName(outflow)
        .groupBy(*keys, "week").agg(F.sum("qty").alias("qty")).join(rules, keys)
    )
    hub_orders = orders(hub_weekly).where(F.col("order_qty") > 0).select(
        F.lit("PROD").alias("type"), "material", F.col("plant").alias("supply_plant"),
        F.col("plant").alias("receive_plant"), "week", F.col("order_qty").cast("double").alias("qty"),
    )
    return spoke_orders.unionByName(hub_orders)


def allocate_stock(requests: DataFrame, stock: DataFrame, order: list[str]) -> DataFrame:
    """Each request gets what earlier ones left over: min(request, max(0, stock - asked before))."""
    keys = ["material", "plant"]
    scanned = prefix_scan(requests, keys, "posted", order, F.col("qty"), "_asked")
    available = F.coalesce("stock", F.lit(0.0))
    left_over = available - (F.col("_asked") - F.col("qty"))
    return (
        scanned.join(stock.select(*keys, "stock"), keys, "left")
        .withColumn("issued", F.greatest(F.lit(0.0), F.least(F.col("qty"), left_over)))
        .drop("_asked", "stock")
    )


def fifo_batches(
    requests: DataFrame, batches: DataFrame, request_order: list[str], batch_order: list[str], span: float | None = None
) -> DataFrame:
    """Split requests over batches, oldest first.

    Requests and batches are laid end to end per key; a request draws from the batches its range
    overlaps. Ranges meet in cells of ``span`` units, so a key's size does not matter; by default
    a cell is sixteen times the larger mean quantity, which keeps the number of cells below that of
    the rows. A request is split over several batches, which single-batch picking would not do.
    """
    keys = ["material", "plant"]
    mean = lambda df: F.coalesce(df.agg(F.avg("qty")).scalar(), F.lit(1.0))
    span = F.lit(span) if span else F.greatest(mean(requests), mean(batches), F.lit(1e-9)) * F.lit(16.0)

    def ranges(df: DataFrame, order: list[str], name: str) -> DataFrame:
        high = prefix_scan(df, keys, "posted", order, F.col("qty"), f"{name}_high")
        high = high.withColumn(f"{name}_low", F.col(f"{name}_high") - F.col("qty"))
        cells = F.sequence(F.floor(F.col(f"{name}_low") / span), F.floor(F.col(f"{name}_high") / span))
        return high.where(F.col("qty") > 0).withColumn("cell", F.explode(cells))

    asked = ranges(requests, request_order, "ask").select(*keys, "cell", "request_id", "ask_low", "ask_high")
    held = ranges(batches, batch_order, "lot").select(*keys, "cell", "batch_id", "lot_low", "lot_high")
    low, high = F.greatest("ask_low", "lot_low"), F.least("ask_high", "lot_high")
    return (
        asked.join(held, [*keys, "cell"])
        .where((high > low) & (F.floor(low / span) == F.col("cell")))
        .select(*keys, "request_id", "batch_id", (high - low).alias("qty"))
    )


def clip_ledger(movements: DataFrame, opening: DataFrame, order: list[str]) -> DataFrame:
    """Reduce issues so that the stock of no key ever falls below zero.

    With C the plain running balance, the clipped stock is C + max(0, -running min of C), and an
    issue is cut by the growth of that correction. ``order`` must put issues of a day first.
    """
    keys = ["material", "plant"]
    first = movements.join(opening.select(*keys, "opening"), keys, "left").withColumn(
        "opening", F.coalesce("opening", F.lit(0.0))
    )
    scanned = prefix_scan(first, keys, "posted", order, signed(), "_net", low="_low")
    lift = lambda low: F.greatest(F.lit(0.0), -(F.col("opening") + low))
    lifted, lifted_before = lift(F.col("_low")), F.coalesce(lift(F.col("_low_before")), F.lit(0.0))
    issued = F.when(F.col("flag") == "H", F.col("qty") - (lifted - lifted_before)).otherwise(F.col("qty"))
    return scanned.withColumn("real_qty", issued).withColumn(
        "stock_after", F.col("opening") + F.col("_net") + lifted
    ).drop("_net", "_low", "_low_before", "opening")


def preferred_mode(lane_modes: DataFrame) -> DataFrame:
    """Flag the cheapest mode of each lane (ties: first by name)."""
    best = lane_modes.groupBy("lane").agg(F.min_by("mode", F.struct("cost", "mode")).alias("_best"))
    return lane_modes.join(best, "lane").withColumn("preferred", F.col("mode") == F.col("_best")).drop("_best")


def rank_products(pnl: DataFrame, n: int) -> DataFrame:
    """The n most and the n least profitable products."""
    products = pnl.groupBy("material").agg(
        F.sum(fn.money(F.col("gross_profit"))).cast("double").alias("gross_profit")
    )
    top = products.orderBy(F.desc("gross_profit"), "material").limit(n).withColumn("list", F.lit("top"))
    bottom = products.orderBy("gross_profit", "material").limit(n).withColumn("list", F.lit("bottom"))
    return top.unionByName(bottom)
