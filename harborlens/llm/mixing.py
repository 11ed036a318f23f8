"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborlens.llm.common import WORD, hidden, id_order
from harborlens.session import cut_lineage

#: A plan of at most so many sources (some megabytes) is sent to every task; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Each size class of a source is cut by id into so many pieces, so that no task ranks a whole source.
PIECES = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Classes of sizes in steps of a quarter of a power of two, by whole numbers only."""
    digits = F.length(F.bin(size))
    lead = F.pow(F.lit(2.0), digits - 1)
    return F.when(size > 0, digits * 4 + F.floor(size * 4 / lead)).otherwise(F.lit(0)).cast("int")


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take the weights in turn. They share the total size
    by weight; a target stops at ``most`` times its source's size and the excess is shared again
    among the others. That is one water level: with the sources in order of limit per weight and
    the first k at their limit, the level is (total - their limits) / (weight of the rest), and the
    right k is the first whose level its next source can take. One row per source is all that
    these windows see.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    rows = (
        sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    )
    steps = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(steps.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(steps.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.sum("source_size").over(whole) - before) / rest)
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    level = F.coalesce(F.max(fits).over(whole), F.lit(0.0))
    return rows.withColumn("_at", level).select(
        "source", "source_size", F.least("_cap", F.col("_at") * F.col("_w")).alias("target")
    )


def offset(source: Column, seed: int) -> Column:
    """The random start of a source in [0, 1): 52 bits of a digest of seed and source."""
    key = F.concat(F.lit(f"{seed}|"), F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 20, pieces: int = PIECES,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """Every row with size, source_size, target, copies and taken (copies times size) of its source's mix.

    Systematic sampling: documents of a source stand in a row, each adds target / source_size
    expected copies to a prefix sum that starts at the source's random offset, and a document is
    taken once per whole number that the sum passes there. The row is in order of size class, so
    each class gives its share, to one document; inside a class ids decide. The position in the row
    is counted in three levels (classes of a source, pieces of a class, rows of a piece): no task
    sees a whole source, and the rows with their other columns move once.

    Null texts have size 0, null sources are one source, null ids come first in their piece. Rows
    that are equal each count. A source without words gets no copies. An empty table stays empty.
    Columns of the input that clash with the new ones are replaced. Another run agrees, unless
    rows share an id and a text but differ otherwise: then which of them is taken may change.
    """
    source, size, klass, piece, place, cb, pb, ss, tg, ks, kk, kp = hidden(
        docs, *"_src _size _class _piece _place _cb _pb _ss _tg _ks _kk _kp".split()
    )
    rows = docs.withColumns({source: F.col(source_column), size: word_count(F.col(text_column))})
    rows = rows.withColumns({klass: size_class(F.col(size)), piece: F.pmod(id_order(id_column), F.lit(pieces)).cast("int")})
    cells = cut_lineage(
        rows.groupBy(source, klass, piece).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("words"))
    )
    classes = cells.groupBy(source, klass).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    plan = targets(
        classes.groupBy(F.col(source).alias("source")).agg(F.sum("words").alias("source_size")), weights, most
    )

    def earlier(keys: list[str], order: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    before_class = classes.select(source, klass, earlier([source], klass).alias(cb))
    before_piece = cells.select(source, klass, piece, earlier([source, klass], piece).alias(pb))
    starts = before_piece.alias("p").join(
        before_class.alias("c"), F.col(f"p.{source}").eqNullSafe(F.col(f"c.{source}")) & (F.col(f"p.{klass}") == F.col(f"c.{klass}"))
    ).select(F.col(f"p.{source}").alias(source), F.col(f"p.{klass}").alias(klass), F.col(piece), (F.col(cb) + F.col(pb)).alias(cb))
    known = cut_lineage(
        starts.join(plan, starts[source].eqNullSafe(plan["source"])).select(
            F.col(source).alias(ks), F.col(klass).alias(kk), F.col(piece).alias(kp), F.col(cb),
            F.col("source_size").alias(ss), F.col("target").alias(tg),
        )
    )
    inside = Window.partitionBy(source, klass, piece).orderBy(id_order(id_column), size, F.xxhash64(text_column))
    ranked = rows.withColumn(place, F.row_number().over(inside))
    bounded = known.select(ks).distinct().count() <= BROADCAST_SOURCES and known.count() <= BROADCAST_SOURCES * pieces
    joined = ranked.join(
        F.broadcast(known) if bounded else known,
        ranked[source].eqNullSafe(known[ks]) & (ranked[klass] == known[kk]) & (ranked[piece] == known[kp]),
    )
    rate = F.when(F.col(ss) > 0, F.col(tg) / F.col(ss)).otherwise(F.lit(0.0))
    at = F.col(cb) + F.col(place)
    start = offset(F.col(source), seed)
    copies = F.floor(rate * at + start) - F.floor(rate * (at - 1) + start)
    fresh = {"size": F.col(size), "source_size": F.col(ss), "target": F.col(tg), "copies": copies, "taken": copies * F.col(size)}
    kept = [F.col(c) for c in docs.columns if c.lower() not in fresh]
    return joined.select(*kept, *[value.alias(name) for name, value in fresh.items()])


def repeat(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: the given columns of every row, once per copy."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(*columns)


#: The same in SQL, for the default parameters.
MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
    FROM documents),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY
        CASE WHEN size > 0 THEN length(bin(size)) * 4 + (size * 4) // (CAST(1 AS BIGINT) << CAST(length(bin(size)) - 1 AS BIGINT)) ELSE 0 END,
        ((doc_id % 64) + 64) % 64, doc_id, size) AS place
    FROM sized),
sources AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w,
        CAST(3 * source_size AS DOUBLE) AS cap FROM sources),
levels AS (
    SELECT *, (SUM(CAST(source_size AS DOUBLE)) OVER () - COALESCE(SUM(cap) OVER (ORDER BY cap / w, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / SUM(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed),
filled AS (SELECT *, COALESCE(MAX(CASE WHEN level * w <= cap THEN level END) OVER (), 0) AS final FROM levels),
plan AS (
    SELECT source, source_size, LEAST(cap, final * w) AS target,
        CAST('0x' || substr(md5('20|' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 13) AS BIGINT)
            / 4503599627370496.0::DOUBLE AS u,
        CASE WHEN source_size > 0 THEN LEAST(cap, final * w) / source_size ELSE 0 END AS rate
    FROM filled),
taken AS (
    SELECT doc_id, size, source_size, target,
        CAST(floor(rate * place + u) - floor(rate * (place - 1) + u) AS BIGINT) AS copies
    FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM taken
"""
