"""Columns of the input that are called like helpers of the operators stay as they are."""

import pytest
from pyspark.sql import functions as F

from harborlens.llm import decontam, mixing, sharding, simhash

HELPERS = "s_ k_ p_ r_ i_ m_ shard_ _own _mine _shard _src _class _piece _ks _kk _kp _at _mark _low _lowest _place _hits0 _fp _text".split()


def docs(spark):
    rows = [(i, f"alpha beta gamma {'delta ' * (i % 5)}word{i % 9}", "ab"[i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def run(name, frame, items):
    return {
        "mix": lambda: mixing.mix(frame), "shard": lambda: sharding.shard_by_bytes(frame, shards=4),
        "keep_one": lambda: simhash.keep_one(frame), "find": lambda: decontam.find_items(frame, items),
    }[name]()


@pytest.mark.parametrize("name", ["mix", "shard", "keep_one", "find"])
def test_helper_names_do_not_clash(spark, name):
    plain = docs(spark)
    crowded = plain.select("*", *[F.concat(F.lit(f"{h}="), "doc_id").alias(h) for h in HELPERS])
    items = spark.createDataFrame([(1, "alpha beta gamma delta delta word3")], "item_id long, text string")
    want, found = run(name, plain, items), run(name, crowded, items)
    assert sorted(found.columns) == sorted([*want.columns, *HELPERS])
    rows = found.collect()
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert all(r[h] == f"{h}={r.doc_id}" for r in rows for h in HELPERS)


def test_rows_with_one_id_and_size_are_told_apart_by_text(spark):
    rows = [(1, f"word{k:02d} x", "a") for k in range(40)] + [(i, "y " * 300, "b") for i in range(2, 6)]
    frame = lambda order: spark.createDataFrame(rows[::order], "doc_id long, text string, source string").repartition(5 - order)
    taken = lambda f: sorted((r.text, r.copies) for r in mixing.mix(f).collect())
    assert taken(frame(1)) == taken(frame(-1))
