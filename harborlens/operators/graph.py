"""Iterative graph operators. Each round is a join; lineage is cut by a checkpoint per round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.operators.scan import salted_join
from harborlens.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the component is its smallest node.

    Large-star and small-star steps alternate until the edges stop changing, which takes a number
    of rounds logarithmic in the component size. Neighbour minima are partial aggregates, and the
    edges of a hub are salted.
    """
    pairs = cut_lineage(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    nodes = cut_lineage(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct())
    current = cut_lineage(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = salted_join(both, lowest, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large.where("u <> v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, root, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            root.select("u", F.col("m").alias("v"))
        )
        current = cut_lineage(small.where("u <> v").distinct())
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        mark = seen
    return nodes.join(current, "u", "left").select(
        F.col("u").alias("node"), F.coalesce("v", "u").alias("component")
    )


def reachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, directed: bool = True, max_rounds: int | None = None) -> DataFrame:
    """(node, distance) for everything reachable from the roots; an unknown root is an error.

    The steps are written once, so that a round reads them instead of building them again. The
    search ends when a round finds nothing new; ``max_rounds`` makes a longer one an error.
    """
    unknown = roots.select("node").join(nodes.select("node"), "node", "left_anti").limit(3).collect()
    if unknown:
        raise ValueError(f"unknown roots: {[r.node for r in unknown]}")
    steps = edges.select("src", "dst")
    if not directed:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    steps = cut_lineage(steps.repartition("src"))
    frontier = cut_lineage(roots.select("node").distinct().withColumn("distance", F.lit(0)))
    visited = frontier
    for distance in count(1):
        if max_rounds is not None and distance > max_rounds:
            raise RuntimeError(f"the search did not end in {max_rounds} rounds")
        next_nodes = (
            steps.join(frontier.select(F.col("node").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("node")).distinct()
            .join(visited.select("node"), "node", "left_anti")
            .withColumn("distance", F.lit(distance))
        )
        frontier = cut_lineage(next_nodes)
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)


def subgraph(edges: DataFrame, roots: DataFrame, depths: dict[tuple[str, str], int]) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges within a number of steps per edge kind and direction.

    ``depths[(kind, "out" | "in")]`` is how many edges of that kind may be followed that way; kinds
    not named are not followed. Each step uses up one of its own kind only.
    """
    limits = {key: depth for key, depth in depths.items() if depth > 0}
    columns = {key: f"left_{i}" for i, key in enumerate(limits)}
    start = roots.select(F.col("node").alias("at")).distinct()
    for key, name in columns.items():
        start = start.withColumn(name, F.lit(limits[key]))
    frontier = seen = cut_lineage(start)
    state = ["at", *columns.values()]
    used = None
    for _ in range(sum(limits.values())):
        moves = None
        for (kind, way), name in columns.items():
            near, far = ("src", "dst") if way == "out" else ("dst", "src")
            followed = (
                edges.where(F.col("kind") == kind)
                .join(frontier.where(F.col(name) > 0).withColumnRenamed("at", near), near)
                .withColumn(name, F.col(name) - 1)
            )
            step = followed.select("src", "dst", "kind", F.col(far).alias("at"), *columns.values())
            moves = step if moves is None else moves.unionByName(step)
        moves = cut_lineage(moves)
        walked = moves.select("src", "dst", "kind")
        used = walked if used is None else used.unionByName(walked)
        frontier = cut_lineage(moves.select(*state).distinct().join(seen, state, "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    vertices = seen.select(F.col("at").alias("node")).distinct()
    kept = used.distinct() if used is not None else edges.select("src", "dst", "kind").where(F.lit(False))
    return vertices, kept


def inheritance_closure(parents: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(type_id, ancestor, depth): all ancestors with the shortest depth, itself at 0."""
    direct = parents.select("type_id", "parent").distinct()
    types = direct.select("type_id").unionByName(direct.select(F.col("parent").alias("type_id"))).distinct()
    frontier = cut_lineage(types.select("type_id", F.col("type_id").alias("ancestor"), F.lit(0).alias("depth")))
    closure = frontier
    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            return closure
        above = direct.select(F.col("type_id").alias("ancestor"), "parent")
        found = (
            frontier.join(above, "ancestor").select("type_id", F.col("parent").alias("ancestor")).distinct()
            .join(closure.select("type_id", "ancestor"), ["type_id", "ancestor"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut_lineage(found)
        if frontier.isEmpty():
            return closure
        closure = closure.unionByName(frontier)


# Dependency graphs of many plans: steps (plan_id, step, concurrent), edges (plan_id, step, depends_on)


def dag_levels(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, step, depth, path, cyclic): longest-path depth and one longest path to each step.

    Level r holds the steps an edge reaches from level r - 1; a step's depth is the last level it
    appears in. A plan that still has a level after as many rounds as it has steps is cyclic, and
    its steps have no depth. Among equally long paths the one through the greatest step ids wins.
    """
    links = edges.select("plan_id", "step", "depends_on")
    entries = steps.select("plan_id", "step").join(links.select("plan_id", "step"), ["plan_id", "step"], "left_anti")
    level = cut_lineage(entries.select("plan_id", "step", F.lit(0).alias("depth"), F.array("step").alias("path")))
    largest = steps.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = level
    for depth in range(1, largest + 1):
        before = level.select("plan_id", F.col("step").alias("depends_on"), "path")
        reached = links.join(before, ["plan_id", "depends_on"]).groupBy("plan_id", "step").agg(F.max("path").alias("_before"))
        level = cut_lineage(
            reached.select("plan_id", "step", F.lit(depth).alias("depth"), F.concat("_before", F.array("step")).alias("path"))
        )
        if level.isEmpty():
            break
        levels = levels.unionByName(level)
    deepest = levels.groupBy("plan_id", "step").agg(F.max(F.struct("depth", "path")).alias("_d"))
    # A cycle without an entry is never reached at all; one behind an entry never runs out.
    unreached = steps.select("plan_id", "step").join(deepest, ["plan_id", "step"], "left_anti").select("plan_id")
    cyclic = level.select("plan_id").unionByName(unreached).distinct().withColumn("_cyclic", F.lit(True))
    marked = (
        steps.select("plan_id", "step").join(deepest, ["plan_id", "step"], "left").join(cyclic, "plan_id", "left")
        .withColumn("cyclic", F.coalesce("_cyclic", F.lit(False)))
    )
    clean = lambda c: F.when(~F.col("cyclic"), F.col(f"_d.{c}")).alias(c)
    return marked.select("plan_id", "step", clean("depth"), clean("path"), "cyclic")


def parallel_groups(steps: DataFrame, levels: DataFrame) -> DataFrame:
    """Steps by depth; a step may run beside others of its depth unless it is marked sequential."""
    joined = levels.join(steps.select("plan_id", "step", "concurrent"), ["plan_id", "step"])
    beside = F.coalesce("concurrent", F.lit(True))
    return joined.groupBy("plan_id", "depth").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(beside).alias("concurrent_steps")
    )


def dag_entry_exit(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Per step: whether nothing is before it, whether nothing depends on it, and how many do."""
    before = edges.groupBy("plan_id", "step").agg(F.count(F.lit(1)).alias("_before"))
    after = edges.groupBy("plan_id", F.col("depends_on").alias("step")).agg(F.count(F.lit(1)).alias("_after"))
    keys = ["plan_id", "step"]
    return (
        steps.select(*keys).join(before, keys, "left").join(after, keys, "left")
        .select(
            *keys, F.col("_before").isNull().alias("is_entry"), F.col("_after").isNull().alias("is_exit"),
            F.coalesce("_after", F.lit(0)).alias("dependents"),
        )
    )


def critical_path(levels: DataFrame) -> DataFrame:
    """The longest chain of each plan; ties end in the greatest step id."""
    best = levels.where("NOT cyclic").groupBy("plan_id").agg(F.max(F.struct("depth", "step", "path")).alias("_b"))
    return best.select("plan_id", (F.col("_b.depth") + 1).alias("length"), F.col("_b.path").alias("path"))


def erp_graph(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of customers, materials, locations, orders and movements.

    ``tables`` holds customers (customer, name), materials (material, description), locations
    (location, name), orders (order_id, customer), lines (order_id, material, qty), flow (order_id,
    delivery_id, qty) and movements (doc, material, plant, code, qty).
    """
    node = lambda df, kind, key, name: df.select(
        F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("node"), F.lit(kind).alias("kind"), F.col(name).alias("label")
    )
    nodes = (
        node(tables["customers"], "customer", "customer", "name")
        .unionByName(node(tables["materials"], "material", "material", "description"))
        .unionByName(node(tables["locations"], "location", "location", "name"))
    )
    tag = lambda kind, column: F.concat(F.lit(f"{kind}/"), F.col(column).cast("string"))
    edge = lambda df, kind, src, dst, qty: df.select(
        src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), qty.cast("double").alias("qty")
    )
    moved = tables["movements"]
    target = F.when(F.col("code").isin("601", "641"), tag("order", "doc")).otherwise(tag("location", "plant"))
    edges = (
        edge(tables["orders"], "ordered_by", tag("order", "order_id"), tag("customer", "customer"), F.lit(None))
        .unionByName(edge(tables["lines"], "includes_item", tag("order", "order_id"), tag("material", "material"), F.col("qty")))
        .unionByName(edge(tables["flow"], "document_flow", tag("order", "order_id"), tag("delivery", "delivery_id"), F.col("qty")))
        .unionByName(edge(moved, "goods_movement", tag("material", "material"), target, F.col("qty")))
    )
    return nodes, edges
