"""Greedy filling of batches in order, without a loop over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborlens.operators.scan import prefix_scan
from harborlens.session import cut_lineage

#: Limits that a span of the running sum holds.
SPAN_LIMITS = 64


def _starts(before: np.ndarray, upto: np.ndarray, begun: int, limit: int) -> Iterator[int]:
    """Rows that start a batch, when one that began at ``begun`` is open: each the first beyond the limit."""
    at = int(np.searchsorted(upto, begun + limit, side="right"))
    while at < len(upto):
        yield at
        at = max(at + 1, int(np.searchsorted(upto, before[at] + limit, side="right")))


def fill_batches(docs: DataFrame, limit: int, width: int = 4096) -> DataFrame:
    """The rows with ``batch``: in order of the unique integer ``id``, a batch takes rows until the next would pass the limit.

    A row of more than ``limit`` tokens is a batch of its own; null and negative counts are 0; batches count
    from 0. Greedy filling looks like a loop over all rows, as where a batch starts depends on all before
    it. But a span of the running sum only has to know where the batch that is open at its beginning
    began, and that is at one of the few rows within a limit before the span. So each span
    answers for all of these at once (from where to where), the answers are chained by pointer
    doubling, and a second pass over the spans numbers their batches. Spans hold ``SPAN_LIMITS`` limits of
    tokens, so no task sees more rows than that, besides rows without tokens.
    """
    tokens = F.greatest(F.coalesce(F.col("token_count").cast("long"), F.lit(0)), F.lit(0))
    sized = docs.select("id", tokens.alias("_n"), F.floor(F.col("id") / F.lit(width)).alias("_range"))
    summed = prefix_scan(sized, [], "_range", ["id"], F.col("_n"), "_upto").select(
        "id", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto"
    )
    rows = cut_lineage(summed.withColumn("_span", F.floor(F.col("_before") / F.lit(SPAN_LIMITS * limit))))
    # Spans in turn: a long row may leave some without rows. One row per span.
    order = Window.orderBy("_span")
    spans = rows.groupBy("_span").agg(F.max("_upto").alias("_end"), F.max("_before").alias("_last")).withColumns(
        {"_turn": F.row_number().over(order) - 1, "_next_end": F.lead("_end").over(order)}
    )
    spans = cut_lineage(spans)
    rows = rows.join(spans, "_span")
    # Where a batch that is open at the end of a span may have begun: there, or in the span before if this one is short.
    open_rows = rows.where((F.col("_before") >= F.col("_end") - limit) | (F.col("_before") == F.col("_last")))
    entries = open_rows.select((F.col("_turn") + 1).alias("_turn"), F.col("_before").alias("begun")).unionByName(
        rows.where(F.col("_before") >= F.col("_next_end") - limit).select((F.col("_turn") + 2).alias("_turn"), F.col("_before").alias("begun"))
    ).distinct()
    # The very first row always starts a batch, wherever the one before it had begun.
    entries = entries.unionByName(spans.where("_turn = 0").select("_turn", F.lit(-limit - 1).cast("long").alias("begun")))
    inside = rows.select("_turn", "id", "_before", "_upto")

    def answer(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        before, upto = own["_before"].to_numpy(), own["_upto"].to_numpy()
        # From the last row back: where the batch that is open at the end began, if one starts here.
        last = np.empty(len(own), np.int64)
        following = np.maximum(np.arange(len(own)) + 1, np.searchsorted(upto, before + limit, side="right"))
        for at in range(len(own) - 1, -1, -1):
            last[at] = before[at] if following[at] >= len(own) else last[following[at]]
        begun = asked["begun"].to_numpy()
        first = np.searchsorted(upto, begun + limit, side="right")
        out = np.where(first < len(own), last[np.minimum(first, max(0, len(own) - 1))] if len(own) else begun, begun)
        return pd.DataFrame({"_turn": asked["_turn"], "begun": begun, "next": out})

    steps = inside.groupBy("_turn").cogroup(entries.groupBy("_turn")).applyInPandas(answer, "_turn INT, begun BIGINT, next BIGINT")
    jump = cut_lineage(steps.where(F.col("_turn").isNotNull()).select("_turn", "begun", (F.col("_turn") + 1).alias("to"), F.col("next").alias("there")))
    reached = cut_lineage(entries.where("_turn = 0"))
    count, reach = spans.count(), 1
    # Doubling: with all spans below ``reach`` known, jumps of that length give as many again.
    while reach < count:
        ahead = reached.join(jump, ["_turn", "begun"]).select(F.col("to").alias("_turn"), F.col("there").alias("begun"))
        reached = cut_lineage(reached.unionByName(ahead))
        further = jump.select(F.col("_turn").alias("to"), F.col("begun").alias("there"), F.col("to").alias("_to"), F.col("there").alias("_there"))
        jump = cut_lineage(jump.join(further, ["to", "there"]).select("_turn", "begun", F.col("_to").alias("to"), F.col("_there").alias("there")))
        reach *= 2

    def number(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        begins = np.zeros(len(own), np.int64)
        if len(own) and len(known):
            begins[list(_starts(own["_before"].to_numpy(), own["_upto"].to_numpy(), int(known["begun"].iloc[0]), limit))] = 1
        return pd.DataFrame({"id": own["id"], "_turn": own["_turn"], "_nth": np.cumsum(begins), "_starts": begins})

    marked = cut_lineage(inside.groupBy("_turn").cogroup(reached.groupBy("_turn")).applyInPandas(number, "id BIGINT, _turn INT, _nth BIGINT, _starts BIGINT"))
    earlier = Window.orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy("_turn").agg(F.sum("_starts").alias("_s")).select("_turn", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    numbered = marked.join(offsets, "_turn").select("id", (F.col("_nth") + F.col("_o") - 1).alias("batch"))
    return docs.join(numbered, "id")
