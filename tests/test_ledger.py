"""Closed forms against plain loops, and the rules of ledger operators on hand frames."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from harborlens.operators import impact, ledger, quality, scenario
from harborlens.operators.scan import prefix_scan, rank_within, salted_join

DAY = dt.date(2024, 1, 1)


def days(n):
    return DAY + dt.timedelta(days=n)


def movements(seed, n=300):
    """One plant-material pair holds a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        material = 1 if rng.random() < 0.34 else rng.randint(2, 6)
        rows.append((i, material, rng.randint(1, 2), days(rng.randint(0, 20)), float(rng.randint(1, 9)), rng.choice("SH")))
    return rows


MOVES = "doc BIGINT, material BIGINT, plant BIGINT, posted DATE, qty DOUBLE, flag STRING"


def test_prefix_scan_hot_key(spark):
    rows = movements(1)
    df = spark.createDataFrame(rows, MOVES).repartition(8)
    got = {r.doc: (r.running, r.low, r.low_before) for r in prefix_scan(
        df, ["material"], "posted", ["posted", "doc"], ledger.signed(), low="low").collect()}
    state = {}
    for doc, material, _, posted, qty, flag in sorted(rows, key=lambda r: (r[3], r[0])):
        total, low = state.get(material, (0.0, None))
        total += qty if flag == "S" else -qty
        lower = total if low is None else min(low, total)
        assert got[doc] == (total, lower, low)
        state[material] = (total, lower)
    assert len(got) == len(rows)


def test_rank_within(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("k"))
    ranked = rank_within(df, ["k"], "id", width=64)
    assert ranked.where(F.col("rank") != F.floor(F.col("id") / 3) + 1).count() == 0
    everyone = rank_within(spark.range(500), [], "id", width=64)
    assert everyone.where(F.col("rank") != F.col("id") + 1).count() == 0


def test_salted_join_equals_join(spark):
    left = spark.range(900).select("id", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 7).alias("k"))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        plain = sorted(left.join(right, "k", how).select("id", "k", "v").collect())
        assert sorted(salted_join(left, right, ["k"], how, hot_rows=50).select("id", "k", "v").collect()) == plain


def test_clip_ledger(spark):
    for seed in range(3):
        rows = movements(seed + 10)
        opening = {(m, p): float(seed * 3) for m in range(1, 7) for p in (1, 2)}
        df = spark.createDataFrame(rows, MOVES)
        start = spark.createDataFrame([(m, p, q) for (m, p), q in opening.items()], "material BIGINT, plant BIGINT, opening DOUBLE")
        got = {r.doc: (r.real_qty, r.stock_after) for r in ledger.clip_ledger(df, start, ["posted", "flag", "doc"]).collect()}
        stock = dict(opening)
        for doc, m, p, _, qty, flag in sorted(rows, key=lambda r: (r[3], r[5], r[0])):
            real = qty if flag == "S" else min(qty, stock[m, p])
            stock[m, p] += real if flag == "S" else -real
            assert got[doc] == (real, stock[m, p])
        assert min(s for _, s in got.values()) >= 0


def test_allocate_stock(spark):
    rows = movements(20)
    df = spark.createDataFrame(rows, MOVES)
    stock = spark.createDataFrame([(m, 1, 40.0) for m in range(1, 7)], "material BIGINT, plant BIGINT, stock DOUBLE")
    got = {r.doc: r.issued for r in ledger.allocate_stock(df, stock, ["posted", "doc"]).collect()}
    left = {(m, 1): 40.0 for m in range(1, 7)}
    for doc, m, p, _, qty, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        issued = min(qty, max(0.0, left.get((m, p), 0.0)))
        left[m, p] = left.get((m, p), 0.0) - issued
        assert got[doc] == issued


def test_fifo_batches(spark):
    rows = movements(30)
    df = spark.createDataFrame(rows, MOVES)
    requests = df.where("flag = 'H'").withColumn("request_id", F.col("doc"))
    batches = df.where("flag = 'S'").withColumn("batch_id", F.col("doc"))
    got = {(r.request_id, r.batch_id): r.qty for r in ledger.fifo_batches(requests, batches, ["posted", "doc"], ["posted", "doc"], span=16.0).collect()}
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    held = {}
    for doc, m, p, _, qty, flag in order:
        if flag == "S":
            held.setdefault((m, p), []).append([doc, qty])
    expected = {}
    for doc, m, p, _, qty, flag in order:
        if flag == "H":
            for batch in held.get((m, p), []):
                take = min(qty, batch[1])
                if take > 0:
                    expected[doc, batch[0]] = take
                    batch[1] -= take
                    qty -= take
    assert got == expected


def test_replenishment_matches_week_loop(spark):
    rng = random.Random(5)
    demand, policy, expected = [], [], []
    for material in range(1, 25):
        plants, hub, lot = [1, 2, 3], 1, rng.choice([5, 10, 25])
        safety = {p: float(rng.randint(5, 60)) for p in plants}
        policy += [(material, p, safety[p], float(lot), p == hub) for p in plants]
        weeks = sorted(rng.sample(range(12), 8))
        need = {(w, p): float(rng.randint(0, 30)) for w in weeks for p in plants if rng.random() < 0.7}
        demand += [(material, p, days(7 * w), q) for (w, p), q in need.items()]
        if not need:
            continue
        held = {p: 1.2 * safety[p] for p in plants}
        for week in sorted({w for w, _ in need}):
            outflow = 0.0
            for p in (2, 3):
                held[p] -= need.get((week, p), 0.0)
                if held[p] < safety[p] - 1e-9:
                    order = math.ceil(round((safety[p] - held[p]) / lot, 9)) * lot
                    held[p] += order
                    outflow += order
                    expected.append(("TRNS", material, 1, p, days(7 * week), float(order)))
            held[1] -= need.get((week, 1), 0.0) + outflow
            if held[1] < safety[1] - 1e-9:
                order = math.ceil(round((safety[1] - held[1]) / lot, 9)) * lot
                held[1] += order
                expected.append(("PROD", material, 1, 1, days(7 * week), float(order)))
    got = ledger.replenishment(
        spark.createDataFrame(demand, "material BIGINT, plant BIGINT, week DATE, qty DOUBLE"),
        spark.createDataFrame(policy, "material BIGINT, plant BIGINT, safety DOUBLE, lot DOUBLE, is_hub BOOLEAN"),
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_month_end_goes_negative_and_back(spark):
    rows = [
        (1, 1, dt.date(2024, 1, 5), 5.0, "H"), (1, 1, dt.date(2024, 3, 5), 9.0, "S"),
        (2, 1, dt.date(2024, 2, 1), 1.0, "S"), (2, 1, dt.date(2024, 4, 1), 1.0, "H"),
    ]
    df = spark.createDataFrame(rows, "material BIGINT, plant BIGINT, posted DATE, qty DOUBLE, flag STRING")
    opening = spark.createDataFrame([(1, 1, 3.0)], "material BIGINT, plant BIGINT, opening DOUBLE")
    got = ledger.month_end_snapshots(df, opening, ["material", "plant"]).collect()
    assert sorted((r.material, r.period.month, r.stock) for r in got) == [
        (1, 1, 0.0), (1, 2, 0.0), (1, 3, 7.0), (1, 4, 7.0), (2, 2, 1.0), (2, 3, 1.0), (2, 4, 0.0),
    ]


def test_shortfall_keeps_keys_of_any_side(spark):
    schema = "material BIGINT, plant BIGINT, qty DOUBLE"
    stock = spark.createDataFrame([(1, 1, 5.0), (2, 1, 9.0)], "material BIGINT, plant BIGINT, stock DOUBLE")
    demand = spark.createDataFrame([(1, 1, 8.0, 80.0, 7), (3, 1, 2.0, 20.0, 8)], schema + ", net DOUBLE, order_id BIGINT")
    loss = spark.createDataFrame([(4, 1, 6.0)], schema)
    got = {r.material: (r.shortfall, r.affected) for r in impact.shortfall(stock, demand, loss).collect()}
    assert got == {1: (3.0, False), 3: (2.0, False), 4: (0.0, True)}


def test_open_orders_ignores_null_deliveries(spark):
    orders = spark.createDataFrame([(1,), (2,)], "order_id BIGINT")
    delivered = spark.createDataFrame([(1,), (None,)], "order_id BIGINT")
    assert [r.order_id for r in impact.open_orders(orders, delivered).collect()] == [2]


def test_cascade_keeps_reduced_quantity(spark):
    clipped = spark.createDataFrame([(1, 10, 2.0), (2, 10, 0.0)], "delivery_id BIGINT, material BIGINT, real_qty DOUBLE")
    items = spark.createDataFrame([(1, 10, 5.0), (2, 10, 4.0), (3, 10, 1.0)], "delivery_id BIGINT, material BIGINT, qty DOUBLE")
    headers = items.select("delivery_id")
    adjusted, kept, flow = scenario.cascade_adjustments(clipped, items, headers, items)
    assert sorted((r.delivery_id, r.qty) for r in adjusted.collect()) == [(1, 2.0), (3, 1.0)]
    assert sorted(r.delivery_id for r in kept.collect()) == [1, 3]
    assert sorted((r.delivery_id, r.qty) for r in flow.collect()) == [(1, 2.0), (3, 1.0)]


def test_integrity_report(spark):
    tables = {
        "child": spark.createDataFrame([("known",), ("missing",), (None,)], "k STRING"),
        "parent": spark.createDataFrame([("known",)], "k STRING"),
        "odd": spark.createDataFrame([("x",)], "other STRING"),
    }
    rows = quality.integrity_report(tables, [("child", "k", "parent", "k"), ("child", "k", "odd", "k"), ("absent", "k", "parent", "k")])
    got = [(r.missing_keys, r.missing_columns) for r in rows.collect()]
    assert got == [(1, None), (None, "odd.k")]
    assert quality.is_intact(rows).first().ok is False


def test_manifest_ignores_order_and_partitions(spark):
    rows = [(i, f"t{i % 7}" if i % 5 else None) for i in range(100)]
    a = spark.createDataFrame(rows, "a BIGINT, b STRING").repartition(1)
    b = spark.createDataFrame(rows[::-1], "a BIGINT, b STRING").repartition(8)
    assert sorted(quality.content_manifest(a).collect()) == sorted(quality.content_manifest(b).collect())
    changed = quality.content_manifest(a.withColumn("a", F.col("a") + 1)).first().content_hash
    assert changed != quality.content_manifest(a).first().content_hash


def test_exact_quantiles(spark):
    from harborlens.operators.scan import exact_quantiles

    rng = random.Random(8)
    rows = [("a" if rng.random() < 0.8 else "b", rng.choice([rng.gauss(0, 100), float(rng.randint(-3, 3)), None])) for _ in range(800)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = exact_quantiles(df, "g", "v", {"q1": 0.25, "q9": 0.9})
    wanted = df.groupBy("g").agg(F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.9)).alias("q9"))
    for a, b in zip(got.orderBy("g").collect(), wanted.orderBy("g").collect()):
        assert a.g == b.g and abs(a.q1 - b.q1) < 1e-9 and abs(a.q9 - b.q9) < 1e-9
