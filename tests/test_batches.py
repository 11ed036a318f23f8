"""Greedy batches against the plain loop."""

import random

import pytest

from harborlens.operators import batches


def plain(rows, limit):
    out, batch, held = {}, -1, None
    for i, n in sorted(rows):
        n = max(0, n or 0)
        if held is None or held + n > limit:
            batch, held = batch + 1, 0
        held += n
        out[i] = batch
    return out


@pytest.mark.parametrize("seed,limit,most,span", [(1, 50, 20, 2), (2, 10, 40, 1), (3, 100, 3, 3), (4, 7, 9, 64), (5, 30, 3000, 1)])
def test_equal_to_the_loop(spark, monkeypatch, seed, limit, most, span):
    monkeypatch.setattr(batches, "SPAN_LIMITS", span)
    draw = random.Random(seed)
    rows = [(i * 3, draw.choice([0, draw.randint(0, most), draw.randint(0, most)])) for i in range(700)]
    rows[5], rows[6] = (15, None), (18, -4)
    frame = spark.createDataFrame(rows, "id long, token_count int").repartition(4)
    found = {r.id: r.batch for r in batches.fill_batches(frame, limit, 64).collect()}
    assert found == plain(rows, limit)
    held = {}
    for i, n in rows:
        held.setdefault(found[i], []).append(max(0, n or 0))
    assert all(sum(x) <= limit or len([n for n in x if n]) == 1 for x in held.values())


def test_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, token_count int")
    assert batches.fill_batches(frame([]), 10).collect() == []
    assert [(r.id, r.batch) for r in batches.fill_batches(frame([(-5, 99)]), 10).collect()] == [(-5, 0)]
    assert {r.id: r.batch for r in batches.fill_batches(frame([(1, 0), (2, 0), (3, 10), (4, 0), (5, 1)]), 10).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
