"""Compare registered queries with their SQL in DuckDB: python tests/oracle.py [sf] [name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder):
    connection = duckdb.connect()
    connection.execute("set threads=8; set timezone='UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def plain(value):
    """One text form per value for both engines; doubles keep every digit."""
    import decimal
    import numpy as np

    if value is None or value is np.nan:
        return None
    if isinstance(value, np.ndarray):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (decimal.Decimal, np.floating)):
        value = float(value)
    if isinstance(value, np.integer):
        value = int(value)
    if isinstance(value, float):
        return int(value) if value == int(value) else value if value == value else None
    return value


def compare(frame, connection, sql):
    """None when equal, else a short text about the difference."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    order = sorted(names)
    left = [tuple(plain(row[c]) for c in order) for row in frame.collect()]
    positions = [names.index(c) for c in order]
    right = [tuple(plain(row[p]) for p in positions) for row in expected]
    left.sort(key=repr)
    right.sort(key=repr)
    note = ""
    for name, kind in types.items():
        spark_type = dict(frame.dtypes)[name]
        if ("HUGEINT" in kind) or kind.startswith("DECIMAL"):
            note += f" [type of {name}: {kind} / {spark_type}]"
    if len(left) != len(right):
        return f"rows {len(left)} against {len(right)}: {left[:2]} / {right[:2]}" + note
    for a, b in zip(left, right):
        if a != b:
            wrong = sum(x != y for x, y in zip(left, right))
            return f"{wrong} of {len(left)} rows differ, first {a} against {b}" + note
    return note.strip() or (None if left else "no rows")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from harborlens.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    wanted = sys.argv[2:]
    queries, sqls = entry.queries(), entry.oracle_sql()
    spark = local_session(8)
    connection = duck(folder)
    bad = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            frame = run(spark, folder)
            if name in sqls:
                problem = compare(frame, connection, sqls[name])
            else:
                rows = len(frame.collect())
                problem = None if rows else "no rows"
                if not problem:
                    print(f"rows {name} {rows}")
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print("bad:", bad)
