"""Integrity reports, configured checks and table manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECK_SCHEMA = "table STRING, check STRING, result STRING, message STRING, value BIGINT"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> DataFrame:
    """Distinct non-null child keys that the parent lacks."""
    keys = child.select(*child_keys).dropna().distinct()
    known = parent.select(*[F.col(p).alias(c) for c, p in zip(child_keys, parent_keys)])
    return keys.join(known, child_keys, "left_anti")


def integrity_report(tables: dict[str, DataFrame], relationships: list[tuple[str, str, str, str]]) -> DataFrame:
    """Missing keys of each (child table, child column, parent table, parent column).

    Tables that are absent are skipped; absent columns are named and leave the count null.
    """
    rows = []
    for child, child_key, parent, parent_key in relationships:
        if child not in tables or parent not in tables:
            continue
        names = [F.lit(f"{child}.{child_key}").alias("child"), F.lit(f"{parent}.{parent_key}").alias("parent")]
        absent = [
            f"{table}.{key}" for table, key in ((child, child_key), (parent, parent_key))
            if key not in tables[table].columns
        ]
        if absent:
            one = tables[child].sparkSession.range(1)
            rows.append(one.select(*names, F.lit(None).cast("long").alias("missing_keys"), F.lit(", ".join(absent)).alias("missing_columns")))
        else:
            lost = orphans(tables[child], tables[parent], [child_key], [parent_key])
            rows.append(
                lost.agg(F.count(F.lit(1)).alias("missing_keys"))
                .select(*names, "missing_keys", F.lit(None).cast("string").alias("missing_columns"))
            )
    return union_all(rows)


def is_intact(report: DataFrame) -> DataFrame:
    """One boolean over a report: every relationship has exactly zero missing keys."""
    return report.agg(F.bool_and(F.coalesce(F.col("missing_keys") == 0, F.lit(False))).alias("ok"))


def run_checks(tables: dict[str, DataFrame], config: list[dict]) -> DataFrame:
    """PASS / FAIL / ERROR rows for configured checks.

    All count, null and value checks of a table share one aggregation; a foreign key is an anti
    join. A null passes allowed_values, as it is in no list and outside none.
    """
    results = []
    spark = next(iter(tables.values())).sparkSession
    fixed = []
    for entry in config:
        table = entry["table"]
        if table not in tables:
            fixed.append((table, "Existence", "FAIL", "Table not found", None))
            continue
        df = tables[table]
        measures, labels = [], []
        for check in entry["checks"]:
            kind = check["type"]
            if kind == "count":
                measures.append(F.count(F.lit(1)))
                labels.append(("Volume", f"at least {check.get('min', 1)} rows", check.get("min", 1), None))
            elif kind in ("no_nulls", "allowed_values"):
                columns = check["columns"] if kind == "no_nulls" else [check["column"]]
                absent = [c for c in columns if c not in df.columns]
                if absent:
                    fixed.append((table, "Schema", "FAIL", f"missing columns: {', '.join(absent)}", None))
                elif kind == "no_nulls":
                    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
                    measures.append(F.count_if(bad))
                    labels.append(("Null Check", f"nulls in {', '.join(columns)}", None, 0))
                else:
                    measures.append(F.count_if(~F.col(columns[0]).isin(check["values"])))
                    labels.append(("Validity", f"values outside the list in {columns[0]}", None, 0))
            elif kind == "foreign_key":
                parent = tables.get(check["parent_table"])
                message = f"orphans in {check['child_col']}"
                if parent is None or check["child_col"] not in df.columns or check["parent_col"] not in parent.columns:
                    fixed.append((table, "Integrity", "ERROR", message + ": table or column not found", None))
                    continue
                keys = parent.select(F.col(check["parent_col"]).alias(check["child_col"]))
                lost = df.select(check["child_col"]).join(keys, check["child_col"], "left_anti")
                results.append(
                    lost.agg(F.count(F.lit(1)).alias("value")).select(
                        F.lit(table).alias("table"), F.lit("Integrity").alias("check"),
                        F.when(F.col("value") == 0, "PASS").otherwise("FAIL").alias("result"),
                        F.lit(message).alias("message"), "value",
                    )
                )
        if measures:
            wide = df.agg(F.array(*measures).alias("_values"))
            rows = F.array(*[
                F.struct(
                    F.lit(table).alias("table"), F.lit(name).alias("check"),
                    F.when((F.col("_values")[i] >= low) if low is not None else (F.col("_values")[i] <= high), "PASS")
                    .otherwise("FAIL").alias("result"),
                    F.lit(message).alias("message"), F.col("_values")[i].alias("value"),
                )
                for i, (name, message, low, high) in enumerate(labels)
            ])
            results.append(wide.select(F.inline(rows)))
    if fixed:
        results.append(spark.createDataFrame(fixed, CHECK_SCHEMA))
    return union_all(results)


def primary_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that repeat or hold a null, with their row count."""
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        .where((F.col("rows") > 1) | has_null)
        .withColumn("violation", F.when(has_null, "null").otherwise("duplicate"))
    )


def constraint_report(tables: dict[str, DataFrame], constraints: list[tuple[str, list[str], str, list[str]]]) -> DataFrame:
    """Violations of composite foreign keys; a key with a null part is not checked."""
    rows = []
    for child, child_keys, parent, parent_keys in constraints:
        lost = orphans(tables[child], tables[parent], child_keys, parent_keys)
        rows.append(
            lost.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(f"{child}({', '.join(child_keys)}) -> {parent}({', '.join(parent_keys)})").alias("constraint"),
                "violations",
            )
        )
    return union_all(rows)


def content_manifest(df: DataFrame, volatile: list[str] | None = None) -> DataFrame:
    """Rows, nulls per column and a hash of the content that ignores row order.

    Row hashes are combined by a sum and an exclusive or, both partial aggregates. Volatile
    columns count their nulls but do not enter the hash.
    """
    stable = [c for c in df.columns if c not in (volatile or [])]
    row = F.xxhash64(*[F.col(c) for c in stable])
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(row.cast("decimal(20,0)")).cast("string").alias("_sum"),
        F.bit_xor(row).alias("_xor"),
        F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in df.columns]).alias("_nulls"),
    )
    content = F.sha2(F.concat_ws("/", "_sum", F.col("_xor").cast("string"), F.col("rows").cast("string")), 256)
    return wide.select("rows", content.alias("content_hash"), F.inline("_nulls"))


def validate_fields(df: DataFrame, document: str, fields: dict[str, str]) -> DataFrame:
    """Parse a JSON column against field types and list every faulty field, not just the first.

    A missing field is an error only when its type ends in '!' (required).
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    parsed = df.withColumn("_parsed", F.from_json(F.col(document), schema))
    errors, values = [], []
    for name, kind in fields.items():
        text = F.col("_parsed").getField(name)
        value = text.try_cast(kind.rstrip("!"))
        values.append(value.alias(name))
        errors.append(F.when(text.isNotNull() & value.isNull(), F.lit(f"{name}: not a {kind.rstrip('!').lower()}")))
        if kind.endswith("!"):
            errors.append(F.when(text.isNull(), F.lit(f"{name}: missing")))
    return parsed.select(*df.columns, *values, F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors"))
