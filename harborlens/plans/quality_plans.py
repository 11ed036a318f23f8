"""Sources, integrity and dirty-data queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlens.functions import draws
from harborlens.operators import dirty, quality
from harborlens.plans.registry import Tables, query
from harborlens.session import scratch_path
from harborlens.sources import datasets
from harborlens.sources.tables import TableStore, align, write_parts


def plain_draw(*key: str, seed: int = 0):
    """Draws on a key, one per tag."""
    return lambda tag: draws.hash_draw(*key, seed=seed, tag=tag)


def draw_sql(key: str, tag: str, seed: int = 0) -> str:
    return draws.draw_sql(key, seed=seed, tag=tag)


# Sources


@query("table_store", "SELECT p_partkey AS P_PARTKEY, p_name AS P_NAME, p_size AS P_SIZE FROM part")
def table_store(t: Tables):
    store = TableStore(t.spark, scratch_path(t.spark, "store"))
    store.save("part", t.part.select("p_partkey", "p_name", "p_size"))
    return store.read("part")


@query(
    "align_schema",
    """SELECT CAST(p_partkey AS VARCHAR) AS MATNR, CAST(p_size AS DOUBLE) AS SIZE, '' AS SPART, CAST(0 AS BIGINT) AS PEINH,
    TRY_CAST(p_name AS INTEGER) AS CODE FROM part""",
)
def align_schema(t: Tables):
    from pyspark.sql.types import StructType

    target = StructType.fromDDL("MATNR STRING, SIZE DOUBLE, SPART STRING, PEINH BIGINT, CODE INT")
    return align(t.part.selectExpr("p_partkey AS matnr", "p_size AS size", "p_name AS code", "p_brand"), target)


@query("json_dataset", "SELECT event_id, event_type, value FROM events")
def json_dataset(t: Tables):
    path = scratch_path(t.spark, "json")
    t.events.select("event_id", "event_type", "value").write.json(path)
    return datasets.read_json_dataset(t.spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")


@query("csv_dataset", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_dataset(t: Tables):
    path = scratch_path(t.spark, "csv")
    t.customer.select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return datasets.read_csv_dataset(t.spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")


@query("write_parts", "SELECT event_type AS run_id, COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def written_parts(t: Tables):
    path = scratch_path(t.spark, "parts")
    write_parts(t.events.withColumnRenamed("event_type", "run_id"), path, rows_per_file=5000)
    return t.spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "flatten_reports",
    """SELECT p_partkey, 0 AS run, 'driver' AS part, p_brand AS tool, CAST(p_size AS VARCHAR) AS version, rule_id,
    'rule ' || rule_id AS rule_name, p_name AS description FROM part, LATERAL (VALUES (p_type), (p_name)) r(rule_id)
    UNION ALL SELECT p_partkey, 0, 'extension', p_type, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
    CAST(NULL AS VARCHAR) FROM part WHERE p_size > 10""",
)
def flatten_reports(t: Tables):
    rule = lambda c: f"NAMED_STRUCT('id', {c}, 'name', CONCAT('rule ', {c}), 'shortDescription', NAMED_STRUCT('text', p_name))"
    tool = f"""NAMED_STRUCT('driver', NAMED_STRUCT('name', p_brand, 'version', CAST(p_size AS STRING),
        'rules', ARRAY({rule('p_type')}, {rule('p_name')})),
        'extensions', CASE WHEN p_size > 10 THEN ARRAY(NAMED_STRUCT('name', p_type)) END)"""
    path = scratch_path(t.spark, "reports")
    documents = t.part.selectExpr(f"TO_JSON(NAMED_STRUCT('id', p_partkey, 'runs', ARRAY(NAMED_STRUCT('tool', {tool})))) AS value")
    documents.write.text(path)
    reports = t.spark.read.schema("id BIGINT, " + datasets.REPORT_SCHEMA).json(path)
    return datasets.flatten_reports(reports, "id").withColumnRenamed("id", "p_partkey")


@query(
    "validate_fields",
    """SELECT event_id, CAST(user_id AS BIGINT) AS user, CASE WHEN value <= 20 THEN value END AS amount,
    CASE WHEN event_type <> 'error' THEN CAST(event_id AS INTEGER) END AS code,
    list_filter([CASE WHEN value > 20 THEN 'amount: not a double' END, CASE WHEN event_type = 'error' THEN 'code: missing' END],
      lambda x: x IS NOT NULL) AS errors FROM events""",
)
def validate_fields(t: Tables):
    documents = t.events.selectExpr(
        "event_id",
        """TO_JSON(NAMED_STRUCT('user', user_id, 'amount', CASE WHEN value > 20 THEN CONCAT(value, ' coins') ELSE CAST(value AS STRING) END,
        'code', CASE WHEN event_type <> 'error' THEN event_id END)) AS document""",
    )
    checked = quality.validate_fields(documents, "document", {"user": "BIGINT", "amount": "DOUBLE", "code": "INT!"})
    return checked.drop("document")


@query(
    "adapt_nested_events",
    """SELECT 'conv-' || conv_id || '#' || turn AS id, CASE WHEN role = 'user' THEN 'turn ' || turn ELSE '' END AS title,
    CASE WHEN role = 'user' AND trim(text) <> '' THEN 'turn ' || turn || chr(10) || chr(10) || trim(text)
      WHEN role = 'user' THEN 'turn ' || turn ELSE '' END AS text FROM conversations""",
)
def adapt_nested_events(t: Tables):
    nested = t.conversations.selectExpr(
        "conv_id", "turn",
        """ARRAY(NAMED_STRUCT('action', 'labeled', 'title', role, 'text', ''), NAMED_STRUCT('action',
        CASE WHEN role = 'user' THEN 'opened' ELSE 'closed' END, 'title', CONCAT(' turn ', turn, ' '), 'text', text)) AS events""",
    )
    return datasets.adapt_nested_events(nested, F.concat(F.lit("conv-"), F.col("conv_id")), F.col("turn"))


# Integrity


@query(
    "orphan_keys",
    """SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)""",
)
def orphan_keys(t: Tables):
    lines = t.lineitem.select(F.col("l_partkey").alias("key"))
    return quality.orphans(lines, t.part.where("p_size <> 7"), ["key"], ["p_partkey"])


@query(
    "integrity_report",
    """SELECT 'lineitem.l_orderkey' AS child, 'orders.o_orderkey' AS parent, (SELECT COUNT(DISTINCT l_orderkey) FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS missing_keys, CAST(NULL AS VARCHAR) AS missing_columns
    UNION ALL SELECT 'customer.c_custkey', 'orders.o_custkey', (SELECT COUNT(DISTINCT c_custkey) FROM customer
      WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), NULL
    UNION ALL SELECT 'documents.doc_id', 'labels.doc_id', (SELECT COUNT(DISTINCT doc_id) FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM labels)), NULL
    UNION ALL SELECT 'part.p_vendor', 'supplier.s_suppkey', NULL, 'part.p_vendor'""",
)
def integrity_report(t: Tables):
    tables = {n: getattr(t, n) for n in ("lineitem", "orders", "customer", "documents", "labels", "part", "supplier")}
    return quality.integrity_report(tables, [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("customer", "c_custkey", "orders", "o_custkey"),
        ("documents", "doc_id", "labels", "doc_id"),
        ("part", "p_vendor", "supplier", "s_suppkey"),
    ])


@query(
    "run_checks",
    """WITH measured AS (SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN o_orderkey IS NULL OR o_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT)
      AS nulls, CAST(SUM(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM orders)
    SELECT 'orders' AS "table", 'Volume' AS "check", CASE WHEN n >= 100 THEN 'PASS' ELSE 'FAIL' END AS result,
      'at least 100 rows' AS message, n AS value FROM measured
    UNION ALL SELECT 'orders', 'Null Check', CASE WHEN nulls = 0 THEN 'PASS' ELSE 'FAIL' END, 'nulls in o_orderkey, o_custkey', nulls FROM measured
    UNION ALL SELECT 'orders', 'Validity', CASE WHEN invalid = 0 THEN 'PASS' ELSE 'FAIL' END, 'values outside the list in o_orderstatus', invalid FROM measured
    UNION ALL SELECT 'orders', 'Integrity', CASE WHEN COUNT(*) = 0 THEN 'PASS' ELSE 'FAIL' END, 'orphans in o_custkey', COUNT(*)
      FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'orders', 'Schema', 'FAIL', 'missing columns: o_comment', NULL
    UNION ALL SELECT 'orders', 'Integrity', 'ERROR', 'orphans in o_custkey: table or column not found', NULL
    UNION ALL SELECT 'shipments', 'Existence', 'FAIL', 'Table not found', NULL""",
)
def run_checks(t: Tables):
    config = [
        {"table": "orders", "checks": [
            {"type": "count", "min": 100},
            {"type": "no_nulls", "columns": ["o_orderkey", "o_custkey"]},
            {"type": "no_nulls", "columns": ["o_comment"]},
            {"type": "allowed_values", "column": "o_orderstatus", "values": ["F", "O"]},
            {"type": "foreign_key", "parent_table": "customer", "child_col": "o_custkey", "parent_col": "c_custkey"},
            {"type": "foreign_key", "parent_table": "clerks", "child_col": "o_custkey", "parent_col": "id"},
        ]},
        {"table": "shipments", "checks": [{"type": "count"}]},
    ]
    return quality.run_checks({"orders": t.orders, "customer": t.customer}, config)


@query(
    "primary_key_violations",
    """SELECT l_orderkey, l_linenumber, COUNT(*) AS rows, 'duplicate' AS violation FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
)
def primary_key_violations(t: Tables):
    return quality.primary_key_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "constraint_report",
    """SELECT 'lines(l_partkey, l_suppkey) -> supplies(part, supplier)' AS "constraint", COUNT(*) AS violations FROM (
      SELECT DISTINCT l_partkey, l_suppkey FROM lineitem EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
    UNION ALL SELECT 'conversations(conv_id, turn) -> answers(conv_id, turn)', COUNT(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations
      EXCEPT SELECT conv_id, turn - 1 FROM conversations)""",
)
def constraint_report(t: Tables):
    supplies = t.lineitem.where("l_returnflag <> 'R'").selectExpr("l_partkey AS part", "l_suppkey AS supplier")
    tables = {
        "lines": t.lineitem, "supplies": supplies, "conversations": t.conversations,
        "answers": t.conversations.selectExpr("conv_id", "turn - 1 AS turn"),
    }
    return quality.constraint_report(tables, [
        ("lines", ["l_partkey", "l_suppkey"], "supplies", ["part", "supplier"]),
        ("conversations", ["conv_id", "turn"], "answers", ["conv_id", "turn"]),
    ])


@query(
    "key_difference",
    """SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 3 EXCEPT
    SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'""",
)
def key_difference(t: Tables):
    keys = ["l_partkey", "l_suppkey"]
    return t.lineitem.where("l_quantity < 3").select(*keys).subtract(t.lineitem.where("l_returnflag = 'R'").select(*keys))


@query("content_manifest")
def content_manifest(t: Tables):
    return quality.content_manifest(t.lineitem, volatile=["l_shipdate"])


# Dirty copies of orders, with draws that SQL can repeat


def orders_text(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey", "CONCAT('0', o_orderpriority) AS priority", "DATE_FORMAT(o_orderdate, 'yyyyMMdd') AS day",
        "CAST(o_custkey AS STRING) AS customer", "o_orderstatus AS status",
    )


ORDERS_TEXT_SQL = """base AS (SELECT o_orderkey, '0' || o_orderpriority AS priority, strftime(o_orderdate, '%Y%m%d') AS day,
    CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status FROM orders)"""


def pick_sql(draw: str, *choices: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE CAST(FLOOR({draw} * {len(choices)}) AS INTEGER) {cases} END"


DIRTY_KEY_SQL = f"""CASE WHEN {draw_sql('o_orderkey', 'priority')} < 0.2 THEN {pick_sql(draw_sql('o_orderkey', 'priority variant'),
    "'0' || priority", "' ' || priority", "priority || ' '", "lower(priority)", "ltrim(priority, '0')", "'  ' || priority || '  '")}
    ELSE priority END"""
DIRTY_DAY_SQL = f"""CASE WHEN {draw_sql('o_orderkey', 'day')} < 0.2 THEN {pick_sql(draw_sql('o_orderkey', 'day variant'),
    "day[7:8] || '/' || day[5:6] || '/' || day[1:4]", "day[5:6] || '-' || day[7:8] || '-' || day[1:4]",
    "day[1:4] || '-' || day[5:6] || '-' || day[7:8]", "day[7:8] || '.' || day[5:6] || '.' || day[1:4]")} ELSE day END"""
ORPHAN_SQL = f"""CASE WHEN {draw_sql('o_orderkey', 'customer orphan')} < 0.03 THEN 'ORPHAN_' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) > 6
    THEN CAST(o_orderkey AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR), 6, '0') END ELSE customer END"""
NULL_SQL = f"CASE WHEN {draw_sql('o_orderkey', 'status null')} < 0.1 THEN NULL ELSE status END"


@query("dirty_keys", f"WITH {ORDERS_TEXT_SQL} SELECT o_orderkey, {DIRTY_KEY_SQL} AS priority, day, customer, status FROM base")
def dirty_keys(t: Tables):
    return dirty.dirty_keys(orders_text(t), ["priority"], 0.2, plain_draw("o_orderkey"))


@query("dirty_dates", f"WITH {ORDERS_TEXT_SQL} SELECT o_orderkey, priority, {DIRTY_DAY_SQL} AS day, customer, status FROM base")
def dirty_dates(t: Tables):
    return dirty.dirty_dates(orders_text(t), ["day"], 0.2, plain_draw("o_orderkey"))


@query("inject_orphans", f"WITH {ORDERS_TEXT_SQL} SELECT o_orderkey, priority, day, {ORPHAN_SQL} AS customer, status FROM base")
def inject_orphans(t: Tables):
    return dirty.inject_orphans(orders_text(t), "customer", F.col("o_orderkey"), 0.03, plain_draw("o_orderkey"))


@query(
    "inject_duplicates",
    f"""WITH {ORDERS_TEXT_SQL} SELECT * FROM base UNION ALL SELECT * FROM base WHERE {draw_sql('o_orderkey', 'duplicate')} <= (
    SELECT GREATEST(0.02, MIN({draw_sql('o_orderkey', 'duplicate')})) FROM base)""",
)
def inject_duplicates(t: Tables):
    return dirty.inject_duplicates(orders_text(t), 0.02, plain_draw("o_orderkey"))


@query("inject_nulls", f"WITH {ORDERS_TEXT_SQL} SELECT o_orderkey, priority, day, customer, {NULL_SQL} AS status FROM base")
def inject_nulls(t: Tables):
    return dirty.inject_nulls(orders_text(t), ["status"], 0.1, plain_draw("o_orderkey"))


DIRTY_SQL = (
    lambda tag, rate, text: f"CASE WHEN {draw_sql('o_orderkey', tag, 42)} < {rate} THEN {text} END"
)
DIRTY_ALL_SQL = f"""WITH {ORDERS_TEXT_SQL}, changed AS (SELECT o_orderkey,
      COALESCE({DIRTY_SQL('priority', 0.05, pick_sql(draw_sql('o_orderkey', 'priority variant', 42),
        "'0' || priority", "' ' || priority", "priority || ' '", "lower(priority)", "ltrim(priority, '0')", "'  ' || priority || '  '"))}, priority) AS priority,
      COALESCE({DIRTY_SQL('day', 0.05, pick_sql(draw_sql('o_orderkey', 'day variant', 42),
        "day[7:8] || '/' || day[5:6] || '/' || day[1:4]", "day[5:6] || '-' || day[7:8] || '-' || day[1:4]",
        "day[1:4] || '-' || day[5:6] || '-' || day[7:8]", "day[7:8] || '.' || day[5:6] || '.' || day[1:4]"))}, day) AS day,
      COALESCE({DIRTY_SQL('customer orphan', 0.03, "'ORPHAN_' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) > 6 THEN CAST(o_orderkey AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR), 6, '0') END")}, customer) AS customer,
      status FROM base),
    repeated AS (SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE {draw_sql('o_orderkey', 'duplicate', 42)} <= (
      SELECT GREATEST(0.01, MIN({draw_sql('o_orderkey', 'duplicate', 42)})) FROM changed))
    SELECT o_orderkey, priority, day, customer, CASE WHEN {draw_sql('o_orderkey', 'status null', 42)} < 0.02 THEN NULL ELSE status END AS status
    FROM repeated"""


@query("apply_dirty", DIRTY_ALL_SQL)
def apply_dirty(t: Tables):
    config = {"keys": ["priority"], "dates": ["day"], "orphans": ["customer"], "duplicate_rate": 0.01, "nulls": ["status"]}
    return dirty.apply_dirty(orders_text(t), config, dirty.row_draw("o_orderkey", seed=42), F.col("o_orderkey"))
