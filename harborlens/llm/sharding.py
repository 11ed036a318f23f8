"""Contiguous shards of equal bytes from prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborlens.llm.common import hidden, id_order, id_ranges, shuffle_width
from harborlens.session import cut_lineage


def text_crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def framed_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and 8 for its frame."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None,
) -> DataFrame:
    """Every row with size, text_crc32, shard (0 to shards - 1) and slot (0, 1, ... within the shard).

    Rows stand in order of id, then checksum, then size. Ranges of ids are summed up first; their
    totals, added up, tell where each range starts, and a running sum inside the range gives every
    row the bytes before it. A row goes to shard floor(bytes before * shards / all bytes), so each
    shard is a contiguous run whose bytes miss an equal share by less than one row at either end.
    Tasks see one range of ids at most; ranges are as many as shuffle partitions, four times over.

    Null texts have no bytes but their frame, null ids come first, rows that are equal follow each
    other, a text larger than a share leaves shards empty, an empty table stays empty. Columns of
    the input that clash with the new ones are replaced.
    """
    spark = docs.sparkSession
    at, size, crc, part, sum_, count, sb, cb, total, begin, own, mine, shard = hidden(
        docs, *"_at _size _crc _part _sum _count _sb _cb _total _begin _own _mine _shard".split()
    )
    ranges = ranges or 4 * shuffle_width(spark)
    ids = docs.select(id_order(id_column).alias(at))
    range_of = id_ranges(ids, F.col(at), ranges)
    rows = docs.withColumns({at: id_order(id_column), size: framed_bytes(F.col(text_column)), crc: text_crc32(F.col(text_column))})
    rows = rows.withColumn(part, range_of(F.col(at)))
    totals = rows.groupBy(part).agg(F.sum(size).alias(sum_), F.count(F.lit(1)).alias(count))
    before = Window.orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(totals.withColumnRenamed(part, own).select(
        own,
        F.coalesce(F.sum(sum_).over(before), F.lit(0)).alias(sb),
        F.coalesce(F.sum(count).over(before), F.lit(0)).alias(cb),
        F.sum(sum_).over(Window.partitionBy()).alias(total),
    ))
    order = Window.partitionBy(part).orderBy(at, crc, size)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumns({sum_: F.sum(size).over(upto), count: F.row_number().over(order)})
        .join(F.broadcast(starts), F.col(part) == F.col(own))  # one row per range, 4,096 at most
        .withColumn(shard, F.expr(f"cast((({sb} + {sum_} - {size}) * {int(shards)}L) div {total} as int)"))
        .withColumn(count, F.col(cb) + F.col(count))
    )
    first = placed.groupBy(F.col(shard).alias(mine)).agg(F.min(count).alias(begin))
    fresh = {
        "size": F.col(size), "text_crc32": F.col(crc), "shard": F.col(shard),
        "slot": (F.col(count) - F.col(begin)).cast("long"),
    }
    kept = [F.col(c) for c in docs.columns if c.lower() not in fresh]
    return placed.join(F.broadcast(first), F.col(shard) == F.col(mine)).select(  # one row per shard
        *kept, *[value.alias(name) for name, value in fresh.items()]
    )
