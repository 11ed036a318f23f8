"""Reproducible synthetic ERP tables, grown from seed rows.

Seeds are rows (order numbers, parts, plants ...), so tables scale with whatever frame seeds them:
``spark.range(n)`` or an existing table. All draws come from row keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.functions import geo
from harborlens.functions.draws import hash_draw
from harborlens.operators.ledger import preferred_mode
from harborlens.operators.scan import prefix_scan, rank_within


def _whole(low: int, high: int, draw: Column) -> Column:
    return (F.lit(low) + F.floor(draw * F.lit(high - low + 1))).cast("int")


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Rows numbered from 0 by a unique integer key, to be drawn by number."""
    return rank_within(df, [], key, "_no", width=65536).withColumn("_no", (F.col("_no") - 1).cast("long"))


def gen_sales(
    seeds: DataFrame, products: DataFrame, customers: DataFrame, as_of: Column, special_customer: Column, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Order headers and lines for each seed order number.

    One to three lines per order; every hundredth order goes to one customer; dates lie 0 to 365
    days before ``as_of``; the price is cost * 1.35 (100 where there is no cost). Products and
    customers are drawn by number.
    """
    draw = lambda tag, *more: hash_draw("order_no", *more, seed=seed, tag=tag)
    people = _numbered(customers.select("customer"), "customer")
    n_people = customers.agg(F.count(F.lit(1))).scalar()
    headers = (
        seeds.select("order_no")
        .withColumn("_no", F.floor(draw("customer") * n_people))
        .join(people.withColumnRenamed("customer", "_drawn"), "_no")
        .select(
            "order_no",
            F.when(F.pmod(F.col("order_no"), F.lit(100)) == 0, special_customer).otherwise(F.col("_drawn")).alias("customer"),
            F.date_sub(as_of, _whole(0, 365, draw("day"))).alias("ordered"),
        )
    )
    goods = _numbered(products.select("material", "plant", "cost"), "material")
    n_goods = products.agg(F.count(F.lit(1))).scalar()
    items = headers.withColumn("item", F.explode(F.sequence(F.lit(1), _whole(1, 3, draw("lines")))))
    line = lambda tag: hash_draw("order_no", "item", seed=seed, tag=tag)
    lines = (
        items.withColumn("_no", F.floor(line("product") * n_goods)).join(goods, "_no")
        .withColumn("qty", _whole(1, 100, line("qty")).cast("double"))
        .withColumn("price", F.round(F.coalesce(F.col("cost") * 1.35, F.lit(100.0)), 2))
        .select(
            "order_no", "item", "material", "plant", "qty", "price",
            F.round(F.col("qty") * F.col("price"), 2).alias("net"),
            F.date_add("ordered", _whole(3, 21, line("due"))).alias("due"),
        )
    )
    return headers, lines


def gen_deliveries(
    lines: DataFrame, stock: DataFrame, fill_rate: float, draw: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delivery headers, items and flow rows of the drawn share of order lines.

    ``lines`` has order_no, item, material, plant, qty and due. Items get what stock is left when
    their turn comes (by due date); items without stock and headers without items drop out.
    """
    keys = ["material", "plant"]
    chosen = lines.where(draw < fill_rate)
    asked = prefix_scan(chosen, keys, "due", ["due", "order_no", "item", "qty"], F.col("qty"), "_asked")
    left_over = F.coalesce("stock", F.lit(0.0)) - (F.col("_asked") - F.col("qty"))
    items = (
        asked.join(stock.select(*keys, "stock"), keys, "left")
        .withColumn("issued", F.greatest(F.lit(0.0), F.least(F.col("qty"), left_over)))
        .where("issued > 0")
        .select(F.col("order_no").alias("delivery_no"), "item", *keys, F.col("issued").alias("qty"), F.col("due").alias("issued_on"))
    )
    headers = items.groupBy("delivery_no").agg(F.max("issued_on").alias("issued_on"), F.count(F.lit(1)).alias("items"))
    flow = items.select(
        F.col("delivery_no").alias("order_no"), "item", "delivery_no", F.lit("C").alias("from_kind"), F.lit("J").alias("to_kind"), "qty"
    )
    return headers, items, flow


def lane_modes(lanes: DataFrame) -> DataFrame:
    """All modes of each lane with hours and cost, the cheapest marked as preferred.

    ``lanes`` has lane, both ends' latitude, longitude, country and port flag. Ships run between
    ports more than 200 km apart; customs add a day each.
    """
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))
    by_sea = F.col("port") & F.col("to_port") & (F.col("km") > geo.SEA_FROM_KM)
    modes = F.array(*[
        F.struct(F.lit(m).alias("mode"), F.lit(float(speed)).alias("speed"), F.lit(float(cost)).alias("rate"))
        for m, (speed, cost) in geo.MODES.items()
    ])
    rows = lanes.withColumn("km", km).withColumn("_m", F.explode(modes)).where((F.col("_m.mode") != "SEA") | by_sea)
    hours = F.col("km") / F.col("_m.speed") + 24 * geo.customs_days(F.col("country"), F.col("to_country"))
    return preferred_mode(
        rows.select(
            "lane", "origin", "target", "km", F.col("_m.mode").alias("mode"),
            F.round(hours, 2).alias("hours"), F.round(F.col("km") * F.col("_m.rate"), 2).alias("cost"),
        )
    )


def gen_lanes(plants: DataFrame, served: DataFrame | None = None) -> DataFrame:
    """Lanes (lane, origin, target and both ends' attributes) for every ordered pair of plants.

    A large network names the pairs in use as ``served`` (origin, target); without them every plant
    (by an integer id) is joined with the numbers of all.
    """
    if served is None:
        numbered = _numbered(plants.select("plant").distinct(), "plant")
        last = plants.select("plant").distinct().count() - 1
        served = plants.where(F.lit(last >= 0)).select(
            F.col("plant").alias("origin"), F.explode(F.sequence(F.lit(0), F.lit(max(0, last)))).cast("long").alias("_no")
        ).join(numbered.withColumnRenamed("plant", "target"), "_no").drop("_no")
    start = plants.select(F.col("plant").alias("origin"), "lat", "lon", "country", "port")
    end = plants.select(F.col("plant").alias("target"), *[F.col(c).alias(f"to_{c}") for c in ("lat", "lon", "country", "port")])
    return (
        served.where(F.col("origin") != F.col("target")).join(start, "origin").join(end, "target")
        .withColumn("lane", F.concat_ws("-", F.col("origin").cast("string"), F.col("target").cast("string")))
    )


def gen_routes(lanes: DataFrame) -> DataFrame:
    """One route per lane: sea between ports, air beyond 1000 km, else road."""
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))
    by_sea = F.col("port") & F.col("to_port") & (F.col("km") > geo.SEA_FROM_KM)
    pick = lambda values: F.when(by_sea, values["SEA"]).when(F.col("km") > geo.AIR_ROUTE_FROM_KM, values["AIR"]).otherwise(values["ROAD"])
    hours = F.col("km") / pick({m: F.lit(float(s)) for m, (s, _) in geo.MODES.items()})
    days = hours / 24 + geo.customs_days(F.col("country"), F.col("to_country"))
    return lanes.withColumn("km", km).select(
        "lane", geo.route_code(F.col("origin").cast("string"), F.col("target").cast("string")).alias("route"),
        pick({m: F.lit(m) for m in geo.MODES}).alias("mode"), F.round("km", 2).alias("km"),
        F.round(hours, 2).alias("hours"), F.round(days, 2).alias("days"),
    )


def gen_shipments(deliveries: DataFrame, modes: DataFrame, domestic_km: float = 100.0) -> DataFrame:
    """One shipment per delivery and lane by the preferred mode, with its stages.

    Deliveries have delivery_no, origin, target, qty and issued_on; a delivery's items are summed.
    Without a lane (within one country) the delivery goes by road, ``domestic_km`` far.
    """
    speed, rate = geo.MODES["ROAD"]
    loads = deliveries.groupBy("delivery_no", "origin", "target").agg(
        F.sum("qty").alias("qty"), F.max("issued_on").alias("issued_on")
    )
    best = modes.where("preferred").select("origin", "target", "mode", "km", "hours", "cost")
    shipped = loads.join(best, ["origin", "target"], "left").withColumns({
        "hours": F.coalesce("hours", F.lit(round(domestic_km / speed, 2))), "cost": F.coalesce("cost", F.lit(round(domestic_km * rate, 2))),
        "mode": F.coalesce("mode", F.lit("ROAD")), "km": F.coalesce("km", F.lit(float(domestic_km))),
    })
    stages = F.array(
        F.struct(F.lit(1).alias("stage"), F.lit("pick up").alias("step"), F.lit(0.0).alias("hours")),
        F.struct(F.lit(2).alias("stage"), F.lit("main leg").alias("step"), F.col("hours").alias("hours")),
    )
    arrives = F.date_add("issued_on", F.ceil(F.col("hours") / 24).cast("int"))
    return shipped.withColumn("arrives", arrives).select(
        "delivery_no", "origin", "target", "qty", "mode", "km", "cost", "issued_on", "arrives", F.inline(stages)
    )


def gen_purchase_orders(consumption: DataFrame, vendors: DataFrame, first_month: Column, months: int) -> DataFrame:
    """Monthly orders that replace consumption, in hundreds and at least the vendor's minimum.

    ``consumption`` has material and consumed (over all months), ``vendors`` material, vendor, price
    and min_qty.
    """
    monthly = F.ceil(F.col("consumed") / F.lit(months) / 100) * 100
    rows = consumption.join(vendors, "material").withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    return rows.select(
        "material", "vendor", F.add_months(first_month, F.col("_m")).alias("ordered"),
        F.greatest(monthly.cast("double"), F.col("min_qty")).alias("qty"), "price",
    ).withColumn("net", F.round(F.col("qty") * F.col("price"), 2))


def gen_receipts(orders: DataFrame, key: list[str], on_time: float = 0.95, in_full: float = 0.98, seed: int = 0) -> DataFrame:
    """A receipt per purchase order line: late ones by 3 to 14 days, short ones at 60 to 95 %."""
    draw = lambda tag: hash_draw(*key, seed=seed, tag=tag)
    late, short = draw("late") >= on_time, draw("short") >= in_full
    return orders.withColumns({
        "posted": F.when(late, F.date_add("due", _whole(3, 14, draw("days")))).otherwise(F.col("due")),
        "received": F.when(short, F.round(F.col("qty") * (F.lit(0.6) + F.lit(0.35) * draw("share")))).otherwise(F.col("qty")),
        "on_time": ~late,
        "in_full": ~short,
    })


def gen_planned_orders(plan: DataFrame) -> DataFrame:
    """Make ('E') and transfer ('U') orders from a replenishment plan; they start a week ahead."""
    transfer = F.col("type") == "TRNS"
    return plan.select(
        "material", F.col("receive_plant").alias("plant"),
        F.when(transfer, F.col("supply_plant")).alias("source"),
        F.when(transfer, "U").otherwise("E").alias("kind"),
        F.date_sub("week", 7).alias("start"), F.col("week").alias("due"), "qty",
    )


def safety_stock(policy: DataFrame, demand: DataFrame, weeks: int) -> DataFrame:
    """Safety stock for some weeks of mean demand; keys without demand keep their old value."""
    keys = ["material", "plant"]
    new = demand.groupBy(*keys).agg(F.floor(F.sum("qty") / 52 * weeks).cast("double").alias("_new"))
    return policy.join(new, keys, "left").withColumn("safety", F.coalesce("_new", "safety")).drop("_new")


def gen_master(seeds: DataFrame, plants: list, vendors: int = 50, components: int = 4, seed: int = 0) -> dict[str, DataFrame]:
    """Materials, texts, stock policies, prices, units, vendor records, bills and routings for seed numbers."""
    draw = lambda tag, *more: hash_draw("material", *more, seed=seed, tag=tag)
    kind = F.when(draw("kind") < 0.3, "FERT").when(draw("kind") < 0.6, "HALB").otherwise("ROH")
    materials = seeds.select(F.col("seed").alias("material")).withColumn("material_type", kind)
    places = F.explode(F.array(*[F.lit(p) for p in plants]))
    cost = F.round(F.lit(5.0) + draw("cost") * 500, 2)
    made = materials.where("material_type <> 'ROH'")
    part = F.explode(F.sequence(F.lit(1), F.lit(components)))
    bom_draw = hash_draw("material", "position", seed=seed, tag="component")
    return {
        "materials": materials,
        "texts": materials.select("material", F.lit("EN").alias("language"), F.concat(F.lit("Material "), "material").alias("description")),
        "policies": materials.select("material", places.alias("plant"), (_whole(1, 20, draw("safety")) * 50).alias("safety"), F.lit(500).alias("lot")),
        "prices": materials.select("material", cost.alias("price"), F.lit(1).alias("unit")),
        "units": materials.select("material", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(n).alias("pieces")) for u, n in (("PC", 1), ("BOX", 12), ("PAL", 480))])).alias("u")).select("material", "u.*"),
        "vendors": materials.where("material_type = 'ROH'").select("material", _whole(1, vendors, draw("vendor")).alias("vendor"), cost.alias("price"), (_whole(1, 10, draw("min")) * 100.0).alias("min_qty")),
        "boms": made.withColumn("position", part).select(
            "material", "position",
            # Components carry greater numbers than their product, so bills never form a cycle.
            (F.col("material") + 1 + F.floor(bom_draw * 1000)).alias("component"), _whole(1, 5, bom_draw).alias("component_qty"),
        ),
        "routings": made.withColumn("operation", F.explode(F.array(F.lit(10), F.lit(20), F.lit(30)))).select(
            "material", "operation", _whole(5, 60, hash_draw("material", "operation", seed=seed, tag="minutes")).alias("minutes")
        ),
    }


def gen_execution(plan: DataFrame, bom: DataFrame, stock: DataFrame) -> DataFrame:
    """Ledger rows that carry out a replenishment plan.

    Production books a receipt (101) and issues components (261) as far as stock reaches, by week;
    what is missing is booked as a shortage (102). Transfers book out (641) and in (101).
    """
    made = plan.where("type = 'PROD'")
    columns = ["material", "plant", "week", "code", "flag", "qty"]
    receipts = made.select("material", F.col("receive_plant").alias("plant"), "week", F.lit("101").alias("code"), F.lit("S").alias("flag"), "qty")
    need = made.join(bom, "material").groupBy(
        F.col("component").alias("material"), F.col("receive_plant").alias("plant"), "week"
    ).agg(F.sum(F.col("qty") * F.col("component_qty")).alias("qty"))
    keys = ["material", "plant"]
    asked = prefix_scan(need, keys, "week", ["week"], F.col("qty"), "_asked").join(stock.select(*keys, "stock"), keys, "left")
    issued = F.greatest(F.lit(0.0), F.least(F.col("qty"), F.coalesce("stock", F.lit(0.0)) - (F.col("_asked") - F.col("qty"))))
    booked = F.array(
        F.struct(F.lit("261").alias("code"), F.lit("H").alias("flag"), F.col("_issued").alias("qty")),
        F.struct(F.lit("102").alias("code"), F.lit("H").alias("flag"), (F.col("qty") - F.col("_issued")).alias("qty")),
    )
    components = asked.withColumn("_issued", issued).select(*keys, "week", F.inline(booked)).where("qty > 0")
    pair = F.array(
        F.struct(F.col("supply_plant").alias("plant"), F.lit("641").alias("code"), F.lit("H").alias("flag")),
        F.struct(F.col("receive_plant").alias("plant"), F.lit("101").alias("code"), F.lit("S").alias("flag")),
    )
    transfers = plan.where("type = 'TRNS'").select("material", "week", "qty", F.inline(pair))
    return receipts.select(*columns).unionByName(components.select(*columns)).unionByName(transfers.select(*columns))
