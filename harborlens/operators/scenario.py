"""What-if scenarios on stock, ledgers, deliveries and orders.

Scenario ledger rows have the ledger's columns plus ``scenario`` and ``store``. Draws come from row
keys; dates are parameters, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.functions.draws import hash_draw
from harborlens.operators.dirty import Draw
from harborlens.operators.scan import rank_within

# Movement codes an offline location can not post.
BLOCKED_CODES = ["101", "102", "601", "261", "311"]


def _between(low: Column, high: Column, draw: Column) -> Column:
    """Whole number from low to high inclusive, by a draw in [0, 1)."""
    return (low + F.floor(draw * (high - low + 1))).cast("int")


def remove_stock(
    stock: DataFrame, scope: Column, scenario: str, posted: Column, code: str = "551", share: float = 1.0
) -> DataFrame:
    """Ledger rows that take the stock in scope (a place, a product or all) off the books."""
    return stock.where(scope & (F.col("stock") > 0)).select(
        F.lit(scenario).alias("scenario"), "material", "plant", posted.alias("posted"),
        F.lit(code).alias("code"), F.lit("H").alias("flag"), (F.col("stock") * share).alias("qty"),
    )


def blocked_documents(
    ledger: DataFrame, plants: list, start: Column, days: int, codes: list[str] | None = None
) -> DataFrame:
    """Documents that fall into the outage [start, start + days)."""
    inside = (F.col("posted") >= start) & (F.col("posted") < F.date_add(start, days))
    hit = F.col("plant").isin(plants) & inside & F.col("code").isin(codes or BLOCKED_CODES)
    return ledger.where(hit).select("doc").distinct()


def _double_entry(rows: DataFrame, scenario: str, posted: Column, from_store: Column, to_store: Column) -> DataFrame:
    entry = lambda item, flag, plant, store, other: F.struct(
        F.lit(item).alias("item"), F.lit(flag).alias("flag"), plant.alias("plant"),
        store.alias("store"), other.alias("other_store"),
    )
    pair = F.array(
        entry(1, "H", F.col("plant"), from_store, to_store),
        entry(2, "S", F.col("target_plant"), to_store, from_store),
    )
    return rows.select("material", "stock", F.explode(pair).alias("e")).select(
        F.lit(scenario).alias("scenario"), "material", "e.plant", "e.store", "e.other_store", "e.item",
        F.lit("311").alias("code"), "e.flag", F.col("stock").alias("qty"), posted.alias("posted"),
    )


def quarantine(stock: DataFrame, scope: Column, scenario: str, posted: Column, quarantine_store: str = "QA01") -> DataFrame:
    """Move the stock in scope to the quarantine store of its plant, as out and in rows."""
    rows = stock.where(scope & (F.col("stock") > 0) & (F.col("store") != quarantine_store))
    rows = rows.withColumn("target_plant", F.col("plant"))
    return _double_entry(rows, scenario, posted, F.col("store"), F.lit(quarantine_store))


def reroute(stock: DataFrame, offline: list, targets: list, scenario: str, posted: Column) -> DataFrame:
    """Move the stock of offline plants to other plants, materials spread over them in turn."""
    options = F.array(*[F.lit(t) for t in targets])
    turn = F.pmod(F.col("material"), F.lit(len(targets))).cast("int")
    rows = stock.where(F.col("plant").isin(offline) & (F.col("stock") > 0)).withColumn(
        "target_plant", F.get(options, turn)
    )
    return _double_entry(rows, scenario, posted, F.col("store"), F.col("store"))


def apply_ledger(stock: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stock after the rows, clipped at zero. Keys without a stock row are returned as unmatched."""
    change = rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("flag") == "S", F.col("qty")).otherwise(-F.col("qty"))).alias("change")
    )
    after = F.greatest(F.lit(0.0), F.col("stock") + F.coalesce("change", F.lit(0.0)))
    return stock.join(change, keys, "full").select(
        *keys, F.when(F.col("stock").isNotNull(), after).alias("stock"),
        F.col("stock").isNull().alias("unmatched"), F.coalesce("change", F.lit(0.0)).alias("change"),
    )


def cascade_adjustments(
    clipped: DataFrame, items: DataFrame, headers: DataFrame, flow: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Carry clipped issues over to delivery items, headers and flow rows.

    ``clipped`` has the summed real quantity per (delivery_id, material). An item at zero is
    dropped, a reduced one keeps the reduced quantity, a header without items goes and so do the
    flow rows of dropped items.
    """
    keys = ["delivery_id", "material"]
    real = clipped.groupBy(*keys).agg(F.sum("real_qty").alias("_real"))
    adjusted = (
        items.join(real, keys, "left")
        .withColumn("qty", F.least("qty", F.coalesce("_real", F.col("qty"))))
        .where(F.col("qty") > 0)
        .drop("_real")
    )
    kept_headers = headers.join(adjusted.select("delivery_id"), "delivery_id", "left_semi")
    kept = adjusted.groupBy(*keys).agg(F.sum("qty").alias("_kept"))
    kept_flow = flow.join(kept, keys).withColumn("qty", F.least("qty", "_kept")).drop("_kept")
    return adjusted, kept_headers, kept_flow


def extra_demand(
    lines: DataFrame, customers: DataFrame, pct: float, start: Column, first_id: Column, seed: int = 0,
    spread: tuple[float, float] = (0.8, 1.2), lead_days: tuple[int, int] = (7, 21),
) -> DataFrame:
    """New order lines worth ``pct`` percent of the given ones, from ``start`` on.

    Each line is repeated pct / 100 times (the fraction by a draw). Quantities vary within
    ``spread``; emergency and shortage variants pass a shorter lead time or a wider spread. The
    customer is drawn by number, each with the same chance; without customers an order keeps its own.
    """
    key = ["order_id", "item", "material", "plant"]
    draw = lambda tag: hash_draw(*key, "copy", seed=seed, tag=tag)
    whole, part = int(pct // 100), (pct % 100) / 100
    times = F.lit(whole) + F.when(hash_draw(*key, seed=seed, tag="extra") < part, 1).otherwise(0)
    distinct = customers.select("customer").distinct()
    by_slot = rank_within(distinct, [], "customer", "_no", width=65536).select((F.col("_no") - 1).alias("_slot"), F.col("customer").alias("_drawn"))
    slots = distinct.select(F.count(F.lit(1))).scalar()
    copies = lines.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    ordered = F.date_add(start, _between(F.lit(0), F.lit(30), draw("day")))
    due = F.date_add(ordered, _between(F.lit(lead_days[0]), F.lit(lead_days[1]), draw("lead")))
    qty = F.round(F.col("qty") * (F.lit(spread[0]) + F.lit(spread[1] - spread[0]) * draw("qty")))
    made = copies.withColumn("_slot", F.floor(draw("customer") * slots).cast("long"))
    return made.join(by_slot, "_slot", "left").select(
        (first_id + F.pmod(F.xxhash64(*key, "copy"), F.lit(2**53))).alias("order_id"),
        F.coalesce("_drawn", "customer").alias("customer"), "material", "plant",
        F.greatest(qty, F.lit(1.0)).alias("qty"), ordered.alias("ordered"), due.alias("due"),
        F.col("order_id").alias("source_order"),
    )


def equipment_failure(
    production: DataFrame, plants: list, start: Column, days: int, cancel_ratio: float, draw: Draw
) -> DataFrame:
    """Production orders that start during the outage are cancelled (CANC) or moved past it (RSCH)."""
    recovery = F.date_add(start, days)
    hit = F.col("plant").isin(plants) & F.col("start").between(start, recovery)
    cancelled = hit & (draw("cancel") < cancel_ratio)
    new_start = F.date_add(recovery, _between(F.lit(1), F.lit(7), draw("start")))
    new_end = F.date_add(new_start, _between(F.lit(3), F.lit(10), draw("end")))
    return production.select(
        *[c for c in production.columns if c not in ("start", "due")],
        F.when(hit & ~cancelled, new_start).otherwise(F.col("start")).alias("start"),
        F.when(hit & ~cancelled, new_end).otherwise(F.col("due")).alias("due"),
        F.when(cancelled, "CANC").when(hit, "RSCH").otherwise("REL").alias("status"),
    )


def delivery_freeze(deliveries: DataFrame, plants: list, start: Column, days: int) -> DataFrame:
    """Deliveries that leave the plants within [start, start + days]."""
    return deliveries.where(
        F.col("plant").isin(plants) & F.col("due").between(start, F.date_add(start, days))
    )


def capacity_ramp(products: DataFrame, plant, start: Column, weeks: int, draw: Draw) -> DataFrame:
    """Orders of a new plant whose capacity grows from 20 % towards 100 %, week by week."""
    share = F.least(F.lit(1.0), F.lit(0.2) + F.lit(0.8) * F.col("week") / F.lit(weeks))
    rows = products.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    base = _between(F.lit(200), F.lit(500), draw("qty"))
    begin = F.date_add(start, F.col("week") * 7 + _between(F.lit(0), F.lit(4), draw("day")))
    return rows.withColumn("capacity", share).select(
        F.lit(plant).alias("plant"), "material", "week", "capacity",
        F.floor(base * F.col("capacity")).alias("qty"), begin.alias("start"), F.lit("REL").alias("status"),
    )


def capacity_load(production: DataFrame, plants: list, capacity_pct: float, draw: Draw) -> DataFrame:
    """Further orders that lift the plants from 60 % load to the given percentage."""
    extra = max(0.0, (capacity_pct / 100 - 0.6) / 0.6)
    times = F.lit(int(extra)) + F.when(draw("extra") < extra % 1, 1).otherwise(0)
    return (
        production.where(F.col("plant").isin(plants) & (times > 0))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
        .withColumn("qty", _between(F.lit(300), F.lit(800), draw("qty")).cast("double"))
    )


def competing_orders(products: DataFrame, plant, start: Column, draw: Draw, weeks: int = 4) -> DataFrame:
    """Two or three overlapping orders per product and week that contend for one plant."""
    rows = (
        products.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
        .withColumn("n", _between(F.lit(2), F.lit(3), draw("n")))
        .withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n"))))
    )
    begin = F.date_add(start, F.col("week") * 7 + _between(F.lit(0), F.lit(4), draw("day")))
    return rows.select(
        F.lit(plant).alias("plant"), "material", "week", "number",
        _between(F.lit(400), F.lit(900), draw("qty")).alias("qty"), begin.alias("start"),
        F.date_add(begin, _between(F.lit(5), F.lit(10), draw("end"))).alias("due"),
    )


def supplier_performance(
    receipts: DataFrame, vendors: list, since: Column, target_otif: float, trend: str, draw: Draw
) -> DataFrame:
    """Degrade (or repair) a share |0.95 - target| of the vendors' receipts since a day.

    Degraded rows come late (60 %) and/or short (40 %); an improving trend marks rows as fine.
    """
    gap = 0.95 - target_otif
    hit = F.col("vendor").isin(vendors) & (F.col("posted") >= since) & (draw("row") < abs(gap))
    worse = trend in ("DECLINE", "STABLE") and gap > 0
    late = (hit & (draw("late") < 0.6)) if worse else F.lit(False)
    short = (hit & (draw("short") < 0.4)) if worse else F.lit(False)
    fixed = hit if trend == "IMPROVE" else F.lit(False)
    days = _between(F.lit(5), F.lit(21), draw("days"))
    less = F.round(F.col("qty") * (F.lit(0.5) + F.lit(0.35) * draw("qty")))
    return receipts.select(
        *[c for c in receipts.columns if c not in ("posted", "qty", "on_time", "in_full")],
        F.when(late, F.date_add("posted", days)).otherwise(F.col("posted")).alias("posted"),
        F.when(short, less).otherwise(F.col("qty")).alias("qty"),
        F.when(fixed, True).when(late, False).otherwise(F.col("on_time")).alias("on_time"),
        F.when(fixed, True).when(short, False).otherwise(F.col("in_full")).alias("in_full"),
    )
