"""Points from the first components of the embeddings; vectors from all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlens.functions import geo, vector
from harborlens.operators import nearest, spatial
from harborlens.plans.registry import Tables, query

POINTS_SQL = """points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
    CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS dx, CAST(embedding[5] AS DOUBLE) AS dy,
    CAST(embedding[6] AS DOUBLE) AS dz, label FROM embeddings)"""


def points(t: Tables):
    parts = lambda low: F.transform(F.slice("embedding", low, 3), lambda v: v.cast("double"))
    return t.embeddings.select(
        F.col("vec_id").alias("id"), parts(1).alias("position"), parts(4).alias("direction"), "label"
    )


def gap_sql(metric: str, a: str = "a", b: str = "b", dims: str = "xyz") -> str:
    parts = [f"({b}.{c} - {a}.{c})" for c in dims]
    if metric == "manhattan":
        return " + ".join(f"abs{p}" for p in parts)
    if metric == "chebyshev":
        return f"greatest({', '.join(f'abs{p}' for p in parts)})"
    squared = " + ".join(f"{p} * {p}" for p in parts)
    return squared if metric == "squared" else f"sqrt({squared})"


def pairs_sql(metric: str, reach: str) -> str:
    return f"""pairs AS (SELECT a.id, b.id AS neighbor, {gap_sql(metric)} AS distance FROM points a, points b
    WHERE a.id <> b.id AND {gap_sql(metric)} <= {reach})"""


def rounded(df):
    return df.withColumn("distance", F.round("distance", 9))


def radius_query(name: str, metric: str, radius: float):
    @query(name, f"WITH {POINTS_SQL}, {pairs_sql(metric, str(radius))} SELECT id, neighbor, ROUND(distance, 9) AS distance FROM pairs")
    def run(t: Tables):
        return rounded(spatial.radius_join(points(t), radius, metric))


radius_query("radius_join", "euclidean", 0.08)
radius_query("radius_join_manhattan", "manhattan", 0.1)
radius_query("radius_join_chebyshev", "chebyshev", 0.06)
radius_query("radius_join_squared", "squared", 0.006)


@query(
    "radius_join_own_radius",
    f"""WITH {POINTS_SQL}, reach AS (SELECT *, CASE WHEN label = 3 THEN 0.1 WHEN label > 3 THEN 0.05 END AS r FROM points)
    SELECT a.id, b.id AS neighbor, ROUND({gap_sql('euclidean')}, 9) AS distance FROM reach a, reach b
    WHERE a.id <> b.id AND {gap_sql('euclidean')} <= a.r""",
)
def radius_join_own_radius(t: Tables):
    rows = points(t).withColumn("r", F.expr("CASE WHEN label = 3 THEN 0.1D WHEN label > 3 THEN 0.05D END"))
    return rounded(spatial.radius_join(rows, None, own_radius="r"))


@query(
    "radius_counts",
    f"""WITH {POINTS_SQL} SELECT a.id, COUNT(*) - 1 AS neighbors FROM points a, points b
    WHERE {gap_sql('euclidean')} <= 0.08 GROUP BY 1""",
)
def radius_counts(t: Tables):
    return spatial.radius_counts(points(t), 0.08)


BOUNDS = ((-0.25, 0.25), (-0.25, 0.25), (-0.25, 0.25))
TORUS = spatial.Topology.preset("torus", BOUNDS)
MIXED = spatial.Topology(BOUNDS, ("continuous", "reflection", "offset_reflection"))
WRAP = "CASE WHEN {0} > 0 THEN {0} - 0.5 ELSE {0} + 0.5 END"


@query(
    "wrapped_radius_join",
    f"""WITH {POINTS_SQL}, ix AS (SELECT *, x AS ax FROM points UNION ALL SELECT *, {WRAP.format('x')} FROM points),
    iy AS (SELECT *, y AS ay FROM ix UNION ALL SELECT *, {WRAP.format('y')} FROM ix),
    iz AS (SELECT *, z AS az FROM iy UNION ALL SELECT *, {WRAP.format('z')} FROM iy)
    SELECT a.id, b.id AS neighbor, ROUND(MIN(sqrt((b.x - ax) * (b.x - ax) + (b.y - ay) * (b.y - ay) + (b.z - az) * (b.z - az))), 9)
    AS distance FROM iz a, points b WHERE a.id <> b.id
    AND sqrt((b.x - ax) * (b.x - ax) + (b.y - ay) * (b.y - ay) + (b.z - az) * (b.z - az)) <= 0.08 GROUP BY 1, 2""",
)
def wrapped_radius_join(t: Tables):
    return rounded(spatial.wrapped_radius_join(points(t), 0.08, TORUS))


def corrected_sql() -> str:
    """The mixed topology spelled out: x continuous, y reflecting, z offset-reflecting (moves y)."""
    return f"""WITH {POINTS_SQL}, sx AS (SELECT * REPLACE (CASE WHEN x < -0.25 OR x >= 0.25 THEN {WRAP.format('x')} ELSE x END AS x),
      x < -0.25 OR x >= 0.25 AS ox FROM points),
    sy AS (SELECT * REPLACE (CASE WHEN y < -0.25 OR y >= 0.25 THEN CASE WHEN y < 0 THEN -0.5 - y ELSE -0.5 - y END ELSE y END AS y,
      CASE WHEN y < -0.25 OR y >= 0.25 THEN -dy ELSE dy END AS dy), y < -0.25 OR y >= 0.25 AS oy FROM sx),
    sz AS (SELECT id, x, CASE WHEN z < -0.25 OR z >= 0.25 THEN CASE WHEN y < 0 THEN y + 0.25 ELSE y - 0.25 END ELSE y END AS y,
      CASE WHEN z < -0.25 OR z >= 0.25 THEN CASE WHEN z < 0 THEN -0.5 - z ELSE -0.5 - z END ELSE z END AS z, dx, dy,
      CASE WHEN z < -0.25 OR z >= 0.25 THEN -dz ELSE dz END AS dz, ox OR oy OR z < -0.25 OR z >= 0.25 AS corrected FROM sy)
    SELECT id, ROUND(x, 9) AS x, ROUND(y, 9) AS y, ROUND(z, 9) AS z, dx, dy, dz, corrected FROM sz"""


@query("correct_out_of_bounds", corrected_sql())
def correct_out_of_bounds(t: Tables):
    fixed = spatial.correct_out_of_bounds(points(t), MIXED)
    return fixed.select(
        "id", *[F.round(F.get("position", F.lit(i)), 9).alias(c) for i, c in enumerate("xyz")],
        *[F.get("direction", F.lit(i)).alias(f"d{c}") for i, c in enumerate("xyz")], "corrected",
    )


@query(
    "neighbors_in_ring",
    f"""WITH {POINTS_SQL} SELECT a.id, b.id AS neighbor, ROUND({gap_sql('euclidean', dims='xy')}, 9) AS distance FROM points a, points b
    WHERE a.id <> b.id AND {gap_sql('euclidean', dims='xy')} BETWEEN 0.02 AND 0.05""",
)
def neighbors_in_ring(t: Tables):
    return rounded(spatial.neighbors_in_ring(points(t), 0.02, 0.05))


@query(
    "neighbors_on_position",
    f"""WITH cells AS (SELECT vec_id AS id, round(embedding[1], 1) AS x, round(embedding[2], 1) AS y FROM embeddings),
    spots AS (SELECT x, y, MIN(id) AS spot, COUNT(*) AS points FROM cells GROUP BY 1, 2 HAVING COUNT(*) > 1)
    SELECT id, spot, points FROM cells JOIN spots USING (x, y)""",
)
def neighbors_on_position(t: Tables):
    rough = points(t).withColumn(
        "position", F.array(*[F.round(F.get("position", F.lit(i)), 1) + 0.0 for i in range(2)])
    )
    return spatial.neighbors_on_position(rough)


DIRECTED_SQL = f"""{POINTS_SQL}, {pairs_sql('euclidean', '0.08')}, turned AS (SELECT p.id, p.neighbor,
    a.dx * (b.x - a.x) + a.dy * (b.y - a.y) + a.dz * (b.z - a.z) AS facing
    FROM pairs p JOIN points a ON p.id = a.id JOIN points b ON p.neighbor = b.id)"""


def directed(t: Tables):
    return spatial.with_vectors(spatial.radius_join(points(t), 0.08, ends=True), points(t))


@query("neighbors_in_front", f"WITH {DIRECTED_SQL} SELECT id, neighbor FROM turned WHERE facing > 0")
def neighbors_in_front(t: Tables):
    return spatial.neighbors_in_front(directed(t)).select("id", "neighbor")


@query("neighbors_behind", f"WITH {DIRECTED_SQL} SELECT id, neighbor FROM turned WHERE facing < 0")
def neighbors_behind(t: Tables):
    return spatial.neighbors_behind(directed(t)).select("id", "neighbor")


@query(
    "vector_functions",
    f"""WITH {POINTS_SQL} SELECT id, ROUND(sqrt(dx * dx + dy * dy + dz * dz), 9) AS length, ROUND(x * dx + y * dy + z * dz, 9) AS dot,
    ROUND(dx - x, 9) AS off_x, ROUND(x / sqrt(x * x + y * y + z * z), 9) AS unit_x FROM points""",
)
def vector_functions(t: Tables):
    p, d = F.col("position"), F.col("direction")
    return points(t).select(
        "id", F.round(vector.norm(d), 9).alias("length"), F.round(vector.dot(p, d), 9).alias("dot"),
        F.round(F.get(vector.difference_vector(p, d), F.lit(0)), 9).alias("off_x"),
        F.round(F.get(vector.normalize_vector(p), F.lit(0)), 9).alias("unit_x"),
    )


COSINE_SQL = """unit AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
    scored AS (SELECT a.id, b.id AS neighbor, ROUND(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM unit a, unit b WHERE a.id <> b.id)"""


@query(
    "cosine_topk",
    f"""WITH {COSINE_SQL}, ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY similarity DESC, neighbor) AS rank
    FROM scored) SELECT id, neighbor, ROUND(similarity, 6) AS similarity, rank FROM ranked WHERE rank <= 5""",
)
def cosine_topk(t: Tables):
    best = nearest.cosine_topk(t.embeddings, "vec_id", "embedding", 5, block_rows=512)
    return best.withColumn("similarity", F.round("similarity", 6))


@query(
    "cosine_radius_graph",
    f"WITH {COSINE_SQL} SELECT id, neighbor, ROUND(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.35 AND id < neighbor",
)
def cosine_radius_graph(t: Tables):
    edges = nearest.cosine_radius_graph(t.embeddings, "vec_id", "embedding", 0.35, block_rows=512)
    return edges.withColumn("similarity", F.round("similarity", 6))


@query(
    "haversine_routes",
    """WITH places AS (SELECT c_custkey AS id, (c_custkey * 37 % 18000) / 100.0 - 90 AS lat, (c_custkey * 91 % 36000) / 100.0 - 180 AS lon,
    c_nationkey AS nation FROM customer)
    SELECT id, ROUND(2 * 6371 * asin(sqrt(pow(sin(radians(48.1 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.1))
      * pow(sin(radians(11.5 - lon) / 2), 2))), 6) AS km,
    CASE WHEN nation = 1 THEN 1 ELSE 0 END AS customs, 'R' || left(CASE WHEN nation = 1 THEN 'GB' ELSE 'DE' END, 2) || 'FR' AS route FROM places""",
)
def haversine_routes(t: Tables):
    rows = t.customer.selectExpr(
        "c_custkey AS id", "(c_custkey * 37 % 18000) / 100D - 90 AS lat", "(c_custkey * 91 % 36000) / 100D - 180 AS lon",
        "CASE WHEN c_nationkey = 1 THEN 'GB' ELSE 'DE' END AS country",
    )
    return rows.select(
        "id",
        F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.1), F.lit(11.5)), 6).alias("km"),
        geo.customs_days(F.col("country"), F.lit("FR")).alias("customs"),
        geo.route_code(F.col("country"), F.lit("FR")).alias("route"),
    )
