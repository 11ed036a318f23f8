"""Entities, links, type hierarchies and dependency graphs from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlens.operators import entity, graph
from harborlens.operators.entity import Path, Statement, property_match
from harborlens.plans.bind import LEDGER_SQL, ledger
from harborlens.plans.registry import Tables, query

URL = "https://types.example/"

ENTITIES_SQL = f"""customers AS (SELECT 'c/' || c_custkey AS entity_id, c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer),
    order_entities AS (SELECT 'o/' || o_orderkey AS entity_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
    parts AS (SELECT 'p/' || p_partkey AS entity_id, p_partkey, p_name, p_brand, p_type, p_size FROM part),
    placed AS (SELECT 'l/' || o_orderkey AS entity_id, 'c/' || o_custkey AS left_id, 'o/' || o_orderkey AS right_id FROM orders),
    contained AS (SELECT DISTINCT 'l/' || l_orderkey || '/' || l_partkey AS entity_id, 'o/' || l_orderkey AS left_id,
      'p/' || l_partkey AS right_id FROM lineitem),
    ids AS (SELECT entity_id FROM customers UNION ALL SELECT entity_id FROM order_entities UNION ALL SELECT entity_id FROM parts
      UNION ALL SELECT entity_id FROM placed UNION ALL SELECT entity_id FROM contained),
    links AS (SELECT * FROM placed UNION ALL SELECT * FROM contained)"""


def customers(t: Tables):
    return t.customer.selectExpr(
        "CONCAT('c/', c_custkey) AS entity_id", f"'{URL}customer/v/1' AS type_id",
        """TO_JSON(NAMED_STRUCT('name', c_name, 'balance', c_acctbal, 'segment', c_mktsegment, 'address',
        NAMED_STRUCT('nation', c_nationkey), 'tags', ARRAY(c_mktsegment, CONCAT('n', c_nationkey)))) AS properties""",
        "CAST(NULL AS STRING) AS left_id", "CAST(NULL AS STRING) AS right_id",
    )


def parts(t: Tables):
    return t.part.selectExpr(
        "CONCAT('p/', p_partkey) AS entity_id", f"CONCAT('{URL}part-', LOWER(p_type), '/v/3') AS type_id",
        "TO_JSON(NAMED_STRUCT('name', p_name, 'brand', p_brand, 'size', p_size)) AS properties",
        "CAST(NULL AS STRING) AS left_id", "CAST(NULL AS STRING) AS right_id",
    )


def order_entities(t: Tables):
    return t.orders.selectExpr(
        "CONCAT('o/', o_orderkey) AS entity_id", f"'{URL}order/v/2' AS type_id",
        "TO_JSON(NAMED_STRUCT('status', o_orderstatus, 'price', o_totalprice)) AS properties",
        "CAST(NULL AS STRING) AS left_id", "CAST(NULL AS STRING) AS right_id",
    )


def placed(t: Tables):
    return t.orders.selectExpr(
        "CONCAT('l/', o_orderkey) AS entity_id", f"'{URL}placed/v/1' AS type_id", "'{}' AS properties",
        "CONCAT('c/', o_custkey) AS left_id", "CONCAT('o/', o_orderkey) AS right_id",
    )


def contained(t: Tables):
    return t.lineitem.select("l_orderkey", "l_partkey").distinct().selectExpr(
        "CONCAT('l/', l_orderkey, '/', l_partkey) AS entity_id", f"'{URL}contains/v/1' AS type_id", "'{}' AS properties",
        "CONCAT('o/', l_orderkey) AS left_id", "CONCAT('p/', l_partkey) AS right_id",
    )


def entities(t: Tables):
    rows = customers(t)
    for more in (order_entities, parts, placed, contained):
        rows = rows.unionByName(more(t))
    return rows


def ids(df):
    return df.select("entity_id")


def clause_query(name: str, build, sql: str):
    """A property clause on the customer entities."""

    @query(name, f"WITH {ENTITIES_SQL} SELECT entity_id FROM customers WHERE {sql}")
    def run(t: Tables):
        return ids(customers(t).where(build()))


clause_query("property_equals", lambda: property_match(Path("segment"), "equals", "BUILDING"), "c_mktsegment = 'BUILDING'")
clause_query("property_not_equals", lambda: property_match(Path("address", "nation"), "not_equals", 7), "c_nationkey <> 7")
clause_query("property_not_equals_missing", lambda: entity.any_of(
    property_match(Path("phone"), "not_equals", "1"), property_match(Path("balance"), "less", 0)), "c_acctbal < 0")
clause_query("property_range", lambda: entity.all_of(
    property_match(Path("balance"), "greater_or_equals", 1000), property_match(Path("balance"), "less", 2000.5)),
    "c_acctbal >= 1000 AND c_acctbal < 2000.5")
clause_query("property_across_kinds", lambda: property_match(Path("name"), "greater", Path("balance")), "TRUE")
clause_query("property_contains_text", lambda: property_match(Path("name"), "contains", "42"), "contains(c_name, '42')")
clause_query("property_contains_element", lambda: property_match(Path("tags"), "contains", "n7"), "c_nationkey = 7")
clause_query("property_contains_key", lambda: entity.negate(property_match(Path("address"), "contains", "street")), "TRUE")
clause_query("property_starts_with", lambda: property_match(Path("segment"), "starts_with", "B"), "c_mktsegment LIKE 'B%'")
clause_query("property_ends_with", lambda: property_match(Path("tags"), "ends_with", ["BUILDING", "n7"]),
             "c_mktsegment = 'BUILDING' AND c_nationkey = 7")
clause_query("any_element", lambda: entity.any_element_match(Path("tags"), "starts_with", "n1"), "CAST(c_nationkey AS VARCHAR) LIKE '1%'")
clause_query("empty_clauses", lambda: entity.all_of(entity.all_of(), entity.negate(entity.any_of())), "TRUE")


@query(
    "attribute_filter",
    f"""WITH {ENTITIES_SQL} SELECT entity_id, '{URL}part-' || lower(p_type) || '/' AS base, 3 AS version FROM parts
    WHERE p_type IN ('PROMO', 'SMALL') AND entity_id LIKE 'p/%'""",
)
def attribute_filter(t: Tables):
    rows = parts(t).withColumn("base", entity.base_url(F.col("type_id"))).withColumn("version", entity.version(F.col("type_id")))
    keep = entity.any_of(
        entity.attribute_match(F.col("base"), "contains_segment", "part-promo"),
        entity.attribute_match(F.col("base"), "ends_with", "small/"),
    )
    keep = entity.all_of(keep, entity.attribute_match(F.col("entity_id"), "starts_with", "p/"),
                         entity.attribute_match(F.col("version"), "not_equal", 2))
    return rows.where(keep).select("entity_id", "base", "version")


@query(
    "linked_filter",
    f"""WITH {ENTITIES_SQL} SELECT entity_id FROM customers WHERE entity_id IN (SELECT left_id FROM placed
    WHERE right_id IN (SELECT entity_id FROM order_entities WHERE o_totalprice > 480000))""",
)
def linked_filter(t: Tables):
    rows = customers(t).unionByName(order_entities(t))
    return ids(entity.linked_match(rows, placed(t), property_match(Path("price"), "greater", 480000)))


TYPES_SQL = """parents AS (SELECT DISTINCT 'size/' || p_type || '/' || p_brand || '/' || p_size AS type_id, 'brand/' || p_type || '/' || p_brand AS parent FROM part
    UNION SELECT DISTINCT 'brand/' || p_type || '/' || p_brand, 'type/' || p_type FROM part
    UNION SELECT DISTINCT 'brand/' || p_type || '/' || p_brand, 'maker/' || p_brand FROM part
    UNION SELECT DISTINCT 'type/' || p_type, 'thing' FROM part UNION SELECT DISTINCT 'maker/' || p_brand, 'thing' FROM part)"""


def type_parents(t: Tables):
    size, brand = "CONCAT('size/', p_type, '/', p_brand, '/', p_size)", "CONCAT('brand/', p_type, '/', p_brand)"
    pairs = [(size, brand), (brand, "CONCAT('type/', p_type)"), (brand, "CONCAT('maker/', p_brand)"),
             ("CONCAT('type/', p_type)", "'thing'"), ("CONCAT('maker/', p_brand)", "'thing'")]
    # One pass over the parts: all five parent links of a row at once.
    links = ", ".join(f"NAMED_STRUCT('type_id', {a}, 'parent', {b})" for a, b in pairs)
    return t.part.selectExpr(f"INLINE(ARRAY({links}))").distinct()


CLOSURE_SQL = f"""{TYPES_SQL}, closure AS (SELECT type_id, type_id AS ancestor, 0 AS depth FROM (SELECT type_id FROM parents
    UNION SELECT parent FROM parents) UNION SELECT c.type_id, p.parent, c.depth + 1 FROM closure c JOIN parents p ON c.ancestor = p.type_id)"""


@query("inheritance_closure", f"WITH RECURSIVE {CLOSURE_SQL} SELECT type_id, ancestor, MIN(depth) AS depth FROM closure GROUP BY 1, 2")
def inheritance_closure(t: Tables):
    return graph.inheritance_closure(type_parents(t))


@query(
    "type_match",
    """SELECT 'p/' || p_partkey AS entity_id FROM part WHERE p_partkey = 5 OR p_type = 'PROMO' OR p_brand = 'Brand#7'""",
)
def type_match(t: Tables):
    typed = t.part.selectExpr(
        "CONCAT('p/', p_partkey) AS entity_id", "CONCAT('size/', p_type, '/', p_brand, '/', p_size) AS type_id"
    )
    closure = graph.inheritance_closure(type_parents(t))
    return ids(entity.type_match(typed, ["p/5"], [], closure.where("ancestor IN ('type/PROMO', 'maker/Brand#7')")))


@query("dynamic_match", "SELECT 'c/' || c_custkey AS entity_id FROM customer WHERE c_acctbal * 2 > 9000 AND length(c_name) > 5")
def dynamic_match(t: Tables):
    wealthy = lambda df: (F.get_json_object(df["properties"], "$.balance").cast("double") * 2 > 9000)
    rows = entity.dynamic_match(customers(t), wealthy)
    return ids(entity.dynamic_match(rows, entity.python_predicate(lambda p: len(p["name"]) > 5)))


@query(
    "select_entities",
    f"""WITH {ENTITIES_SQL} SELECT entity_id FROM customers WHERE c_acctbal < 0 UNION ALL
    SELECT l.entity_id FROM placed l JOIN customers c ON l.left_id = c.entity_id JOIN order_entities o ON l.right_id = o.entity_id
    WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000""",
)
def select_entities(t: Tables):
    return ids(entity.select(entities(t), [
        Statement(property_match(Path("balance"), "less", 0)),
        Statement(F.lit(True), left=property_match(Path("segment"), "equals", "BUILDING"),
                  right=property_match(Path("price"), "greater", 300000)),
    ]))


@query(
    "select_complement",
    f"""WITH {ENTITIES_SQL} SELECT entity_id FROM ids WHERE entity_id NOT IN (SELECT entity_id FROM customers WHERE c_acctbal < 0)
    AND entity_id NOT IN (SELECT entity_id FROM order_entities WHERE o_orderstatus = 'F')""",
)
def select_complement(t: Tables):
    return ids(entity.select_complement(entities(t), [
        Statement(property_match(Path("balance"), "less", 0)),
        Statement(property_match(Path("status"), "equals", "F")),
    ]))


@query(
    "select_properties",
    """SELECT 'c/' || c_custkey AS entity_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name, c_mktsegment AS segment,
    CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance FROM customer""",
)
def select_properties(t: Tables):
    rows = entity.select_properties(customers(t), property_match(Path("balance"), "less", 0), False, ["segment"])
    pick = lambda name: F.get_json_object("properties", f"$.{name}")
    return rows.select("entity_id", pick("name").alias("name"), pick("segment").alias("segment"), pick("balance").cast("double").alias("balance"))


@query(
    "update_properties",
    """SELECT 'c/' || c_custkey AS entity_id, CASE WHEN c_acctbal < 0 THEN 99 ELSE c_nationkey END AS nation,
    CAST(NULL AS VARCHAR) AS street, CASE WHEN c_acctbal < 0 THEN 'LOCKED' ELSE c_mktsegment END AS segment FROM customer""",
)
def update_properties(t: Tables):
    changes = [(["address", "nation"], 99), (["address", "street"], "Main"), (["segment"], "LOCKED")]
    rows = entity.update_properties(customers(t), property_match(Path("balance"), "less", 0), changes)
    pick = lambda path: F.get_json_object("properties", path)
    return rows.select("entity_id", pick("$.address.nation").cast("int").alias("nation"),
                       pick("$.address.street").alias("street"), pick("$.segment").alias("segment"))


VERSIONS_SQL = """versions AS (SELECT o_custkey AS entity, o_orderkey AS revision, o_orderstatus AS state,
    CAST(o_orderdate AS DATE) AS tx_start, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + 45 END AS tx_end,
    CAST(o_orderdate AS DATE) - 30 AS dec_start, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 60 END AS dec_end FROM orders)"""


def versions(t: Tables):
    return t.orders.selectExpr(
        "o_custkey AS entity", "o_orderkey AS revision", "o_orderstatus AS state", "CAST(o_orderdate AS DATE) AS tx_start",
        "CASE WHEN o_orderstatus <> 'P' THEN DATE_ADD(CAST(o_orderdate AS DATE), 45) END AS tx_end",
        "DATE_SUB(CAST(o_orderdate AS DATE), 30) AS dec_start",
        "CASE WHEN o_orderstatus <> 'O' THEN DATE_ADD(CAST(o_orderdate AS DATE), 60) END AS dec_end",
    )


@query(
    "latest_version",
    """SELECT o_custkey AS entity, MAX(o_orderkey) AS revision, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY 1""",
)
def latest_version(t: Tables):
    revisions = t.orders.selectExpr("o_custkey AS entity", "o_orderkey AS revision", "o_orderstatus AS state")
    return entity.latest_version(revisions, "entity", "revision")


@query(
    "temporal_slice",
    f"""WITH {VERSIONS_SQL} SELECT * FROM versions WHERE tx_start <= DATE '1998-06-01' AND (tx_end IS NULL OR tx_end > DATE '1998-06-01')
    AND dec_start <= DATE '1998-12-31' AND (dec_end IS NULL OR dec_end > DATE '1998-01-01')""",
)
def temporal_slice(t: Tables):
    day = lambda text: F.lit(text).cast("date")
    return entity.temporal_slice(
        versions(t), ("tx_start", "tx_end"), day("1998-06-01"), ("dec_start", "dec_end"), day("1998-01-01"), day("1998-12-31")
    )


EDGES_SQL = f"""{ENTITIES_SQL}, edges AS (SELECT left_id AS src, entity_id AS dst, 'left' AS side FROM links
    UNION ALL SELECT entity_id, right_id, 'right' FROM links)"""


@query("entity_edges", f"WITH {EDGES_SQL} SELECT * FROM edges")
def entity_edges(t: Tables):
    return entity.entity_edges(placed(t).unionByName(contained(t)))


@query(
    "group_by_property",
    "SELECT p_brand AS label, COUNT(*) AS entities FROM part GROUP BY 1",
)
def group_by_property(t: Tables):
    return entity.group_by_property(parts(t), "brand")


@query(
    "count_links",
    f"""WITH {ENTITIES_SQL} SELECT c.entity_id, c_name AS label, COUNT(l.entity_id) AS links FROM customers c
    LEFT JOIN placed l ON l.left_id = c.entity_id GROUP BY 1, 2""",
)
def count_links(t: Tables):
    return entity.count_links(customers(t), placed(t), "name")


# Graph walks


def roots(t: Tables):
    return t.customer.where("c_acctbal < -800 AND c_mktsegment = 'BUILDING'").selectExpr("CONCAT('c/', c_custkey) AS node")


@query(
    "reachable",
    f"""WITH RECURSIVE {EDGES_SQL}, walk AS (SELECT entity_id AS node, 0 AS distance FROM customers
    WHERE c_acctbal < -800 AND c_mktsegment = 'BUILDING' UNION SELECT dst, distance + 1 FROM walk JOIN edges ON src = node)
    SELECT node, MIN(distance) AS distance FROM walk GROUP BY 1""",
)
def reachable(t: Tables):
    edges = entity.entity_edges(placed(t).unionByName(contained(t)))
    nodes = entities(t).select(F.col("entity_id").alias("node"))
    return graph.reachable(nodes, edges, roots(t))


KIND_EDGES_SQL = f"""{ENTITIES_SQL}, kinds AS (SELECT left_id AS src, right_id AS dst, 'placed' AS kind FROM placed
    UNION ALL SELECT left_id, right_id, 'contains' FROM contained
    UNION ALL SELECT entity_id, 'type/' || p_type, 'is_of_type' FROM parts)"""
SUBGRAPH_SQL = f"""{KIND_EDGES_SQL}, walk AS (SELECT entity_id AS node, 1 AS a, 1 AS b, 1 AS c FROM customers WHERE c_acctbal < -800
    AND c_mktsegment = 'BUILDING' UNION SELECT dst,
    a - CASE WHEN kind = 'placed' THEN 1 ELSE 0 END, b - CASE WHEN kind = 'contains' THEN 1 ELSE 0 END,
    c - CASE WHEN kind = 'is_of_type' THEN 1 ELSE 0 END FROM walk JOIN kinds ON src = node
    WHERE (kind = 'placed' AND a > 0) OR (kind = 'contains' AND b > 0) OR (kind = 'is_of_type' AND c > 0))"""


def kind_edges(t: Tables):
    arrow = lambda df, kind: df.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), F.lit(kind).alias("kind"))
    typed = t.part.selectExpr("CONCAT('p/', p_partkey) AS src", "CONCAT('type/', p_type) AS dst", "'is_of_type' AS kind")
    return arrow(placed(t), "placed").unionByName(arrow(contained(t), "contains")).unionByName(typed)


DEPTHS = {("placed", "out"): 1, ("contains", "out"): 1, ("is_of_type", "out"): 1}


@query("subgraph_vertices", f"WITH RECURSIVE {SUBGRAPH_SQL} SELECT DISTINCT node FROM walk")
def subgraph_vertices(t: Tables):
    return graph.subgraph(kind_edges(t), roots(t), DEPTHS)[0]


@query(
    "subgraph_edges",
    f"""WITH RECURSIVE {SUBGRAPH_SQL} SELECT DISTINCT src, dst, kind FROM walk JOIN kinds ON src = node
    WHERE (kind = 'placed' AND a > 0) OR (kind = 'contains' AND b > 0) OR (kind = 'is_of_type' AND c > 0)""",
)
def subgraph_edges(t: Tables):
    return graph.subgraph(kind_edges(t), roots(t), DEPTHS)[1]


@query(
    "connected_components",
    """WITH RECURSIVE grouped AS (SELECT l_orderkey, MIN(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey,
      date_trunc('month', l_shipdate)) AS first FROM lineitem), edges AS (SELECT DISTINCT l_orderkey AS src, first AS dst FROM grouped),
    steps AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    reach AS (SELECT src AS node, src AS label FROM steps UNION SELECT s.dst, r.label FROM reach r JOIN steps s ON s.src = r.node WHERE r.label < s.dst)
    SELECT node, MIN(label) AS component FROM reach GROUP BY 1""",
)
def connected_components(t: Tables):
    """Orders that ship the same part from the same supplier in the same month hang together."""
    key = [F.col("l_partkey"), F.col("l_suppkey"), F.trunc("l_shipdate", "month").alias("month")]
    rows = t.lineitem.select("l_orderkey", *key)
    first = rows.groupBy("l_partkey", "l_suppkey", "month").agg(F.min("l_orderkey").alias("dst"))
    edges = rows.join(first, ["l_partkey", "l_suppkey", "month"]).select(F.col("l_orderkey").alias("src"), "dst").distinct()
    return graph.connected_components(edges)


STEPS_SQL = """steps AS (SELECT conv_id AS plan_id, turn AS step, role <> 'system' AS concurrent FROM conversations),
    deps AS (SELECT conv_id AS plan_id, turn AS step, turn // 2 AS depends_on FROM conversations WHERE turn > 0
    UNION SELECT conv_id, turn, turn - 2 FROM conversations WHERE turn > 1 AND role = 'assistant')"""


def plan_steps(t: Tables):
    return t.conversations.selectExpr("conv_id AS plan_id", "turn AS step", "role <> 'system' AS concurrent")


def plan_edges(t: Tables):
    half = t.conversations.where("turn > 0").selectExpr("conv_id AS plan_id", "turn AS step", "turn DIV 2 AS depends_on")
    far = t.conversations.where("turn > 1 AND role = 'assistant'").selectExpr("conv_id AS plan_id", "turn AS step", "turn - 2 AS depends_on")
    return half.unionByName(far).distinct()


LEVELS_SQL = f"""{STEPS_SQL}, walk AS (SELECT plan_id, step, 0 AS depth FROM steps s WHERE NOT EXISTS (SELECT 1 FROM deps d
    WHERE d.plan_id = s.plan_id AND d.step = s.step) UNION SELECT d.plan_id, d.step, w.depth + 1 FROM walk w JOIN deps d
    ON d.plan_id = w.plan_id AND d.depends_on = w.step), levels AS (SELECT plan_id, step, MAX(depth) AS depth FROM walk GROUP BY 1, 2)"""


@query("dag_depth", f"WITH RECURSIVE {LEVELS_SQL} SELECT plan_id, step, depth, FALSE AS cyclic FROM levels")
def dag_depth(t: Tables):
    return graph.dag_levels(plan_steps(t), plan_edges(t)).select("plan_id", "step", "depth", "cyclic")


@query(
    "parallel_groups",
    f"""WITH RECURSIVE {LEVELS_SQL} SELECT plan_id, depth, COUNT(*) AS steps,
    CAST(SUM(CASE WHEN concurrent THEN 1 ELSE 0 END) AS BIGINT) AS concurrent_steps FROM levels JOIN steps USING (plan_id, step) GROUP BY 1, 2""",
)
def parallel_groups(t: Tables):
    return graph.parallel_groups(plan_steps(t), graph.dag_levels(plan_steps(t), plan_edges(t)))


@query(
    "dag_entry_exit",
    f"""WITH {STEPS_SQL} SELECT plan_id, step, NOT EXISTS (SELECT 1 FROM deps d WHERE d.plan_id = s.plan_id AND d.step = s.step) AS is_entry,
    NOT EXISTS (SELECT 1 FROM deps d WHERE d.plan_id = s.plan_id AND d.depends_on = s.step) AS is_exit,
    (SELECT COUNT(*) FROM deps d WHERE d.plan_id = s.plan_id AND d.depends_on = s.step) AS dependents FROM steps s""",
)
def dag_entry_exit(t: Tables):
    return graph.dag_entry_exit(plan_steps(t), plan_edges(t))


@query(
    "critical_path",
    f"""WITH RECURSIVE {STEPS_SQL}, chains AS (SELECT plan_id, step, [step] AS path FROM steps s WHERE NOT EXISTS (SELECT 1 FROM deps d
      WHERE d.plan_id = s.plan_id AND d.step = s.step) UNION ALL SELECT d.plan_id, d.step, list_append(path, d.step) FROM chains c
      JOIN deps d ON d.plan_id = c.plan_id AND d.depends_on = c.step),
    best AS (SELECT plan_id, path, ROW_NUMBER() OVER (PARTITION BY plan_id ORDER BY len(path) DESC, step DESC, path DESC) AS n FROM chains)
    SELECT plan_id, CAST(len(path) AS INTEGER) AS length, path FROM best WHERE n = 1""",
)
def critical_path(t: Tables):
    return graph.critical_path(graph.dag_levels(plan_steps(t), plan_edges(t)))


def erp(t: Tables):
    return graph.erp_graph({
        "customers": t.customer.selectExpr("c_custkey AS customer", "c_name AS name"),
        "materials": t.part.selectExpr("p_partkey AS material", "p_name AS description"),
        "locations": t.supplier.selectExpr("s_suppkey AS location", "s_name AS name"),
        "orders": t.orders.selectExpr("o_orderkey AS order_id", "o_custkey AS customer"),
        "lines": t.lineitem.selectExpr("l_orderkey AS order_id", "l_partkey AS material", "l_quantity AS qty"),
        "flow": t.lineitem.where("l_linestatus = 'F'").selectExpr(
            "l_orderkey AS order_id", "l_orderkey * 10 + l_linenumber AS delivery_id", "l_quantity AS qty"),
        "movements": ledger(t),
    })


@query(
    "erp_nodes",
    """SELECT 'customer/' || c_custkey AS node, 'customer' AS kind, c_name AS label FROM customer UNION ALL
    SELECT 'material/' || p_partkey, 'material', p_name FROM part UNION ALL SELECT 'location/' || s_suppkey, 'location', s_name FROM supplier""",
)
def erp_nodes(t: Tables):
    return erp(t)[0]


@query(
    "erp_edges",
    f"""WITH {LEDGER_SQL} SELECT 'order/' || o_orderkey AS src, 'customer/' || o_custkey AS dst, 'ordered_by' AS kind, CAST(NULL AS DOUBLE) AS qty FROM orders
    UNION ALL SELECT 'order/' || l_orderkey, 'material/' || l_partkey, 'includes_item', l_quantity FROM lineitem
    UNION ALL SELECT 'order/' || l_orderkey, 'delivery/' || (l_orderkey * 10 + l_linenumber), 'document_flow', l_quantity FROM lineitem WHERE l_linestatus = 'F'
    UNION ALL SELECT 'material/' || material, CASE WHEN code IN ('601', '641') THEN 'order/' || doc ELSE 'location/' || plant END, 'goods_movement', qty FROM ledger""",
)
def erp_edges(t: Tables):
    return erp(t)[1]
