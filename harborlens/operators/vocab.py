"""Slug vocabularies and their compression to representative words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.operators.community import communities
from harborlens.operators.corpus import cluster_vectors
from harborlens.operators.graph import connected_components
from harborlens.operators.nearest import cosine_radius_links, distinct_edges
from harborlens.operators.scan import prefix_scan, salted_join
from harborlens.session import cut_lineage


def token_counts(slugs: DataFrame) -> DataFrame:
    """(token, frequency) over all slugs."""
    return slugs.select(F.explode(F.split("slug", "-")).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("frequency")
    )


def build_vocab(slugs: DataFrame) -> DataFrame:
    """(token, index): distinct words in alphabetical order, from 0; first letters are the buckets."""
    tokens = token_counts(slugs).withColumn("_start", F.substring("token", 1, 3))
    numbered = prefix_scan(tokens, [], "_start", ["token"], F.lit(1), "_at")
    return numbered.select("token", (F.col("_at") - 1).cast("long").alias("index"))


def encode_slugs(slugs: DataFrame, vocab: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(id, indices): each word replaced by its representative's index, unknown words skipped."""
    words = slugs.select("id", F.posexplode(F.split("slug", "-")).alias("at", "token"))
    if mapping is not None:
        words = words.join(mapping.select("token", "representative"), "token", "left").withColumn(
            "token", F.coalesce("representative", "token")
        )
    known = words.join(vocab, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "index"))).alias("_p"))
    return slugs.select("id").join(known, "id", "left").select(
        "id", F.coalesce(F.transform("_p", lambda p: p["index"]), F.array().cast("array<bigint>")).alias("indices")
    )


def representatives(labelled: DataFrame) -> DataFrame:
    """(token, cluster, representative) for (token, cluster, frequency, vector).

    The most frequent word speaks for its cluster, ties by distance to the centroid and spelling.
    A null cluster is noise: the word stands for itself. The centroid is a mean per dimension, a
    partial aggregate, so clusters of any size are fine.
    """
    clustered = labelled.where("cluster IS NOT NULL")
    centroid = (
        clustered.select("cluster", F.posexplode("vector").alias("d", "x"))
        .groupBy("cluster", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("_c"))
    )
    squares = F.zip_with("vector", "_c", lambda x, c: (x - c["x"]) * (x - c["x"]))
    # Distances of cluster members of equal position differ in the last bits only; ten decimals tie them.
    far = F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)), 10)
    measured = clustered.join(centroid, "cluster").withColumn("_far", far)
    best = measured.groupBy("cluster").agg(
        F.min_by("token", F.struct(-F.col("frequency"), "_far", "token")).alias("representative")
    )
    return labelled.join(best, "cluster", "left").select(
        "token", "cluster", F.coalesce("representative", "token").alias("representative")
    )


def compress_kmeans(tokens: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``tokens`` (token, frequency, vector, number) grouped by k-means."""
    clusters = cluster_vectors(tokens, "number", "vector", k, seed).select(F.col("id").alias("number"), "cluster")
    return representatives(tokens.join(clusters, "number"))


def compress_graph(tokens: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Grouped by connected components of the cosine graph; lonely words are their own group."""
    edges = cosine_radius_links(tokens, "number", "vector", threshold).select(
        F.col("id").alias("src"), F.col("neighbor").alias("dst")
    )
    loops = tokens.select(F.col("number").alias("src"), F.col("number").alias("dst"))
    components = connected_components(edges.unionByName(loops))
    named = components.select(F.col("node").alias("number"), F.col("component").alias("cluster"))
    return representatives(tokens.join(named, "number"))


def compress_communities(tokens: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Grouped by modularity communities of the cosine graph; lonely words are their own group.

    Words with equal vectors are one node from the start, with the links of all of them: a crowd of
    copies costs one row and not all its pairs.
    """
    tokens = cut_lineage(tokens.select("token", "frequency", "number", "vector"))  # whatever made them runs once
    members, edges = distinct_edges(tokens, "number", "vector", threshold)
    members = cut_lineage(members.withColumn("node", F.when(F.col("alike"), F.col("first")).otherwise(F.col("id"))))
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    end = lambda name: sizes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"))
    between = edges.select(F.col("id").alias("src"), F.col("neighbor").alias("dst")).join(end("src"), "src").join(end("dst"), "dst")
    links = between.select("src", "dst", (F.col("n_src") * F.col("n_dst")).alias("weight")).unionByName(
        sizes.where("n > 1").select(F.col("node").alias("src"), F.col("node").alias("dst"), F.expr("n * (n - 1) DIV 2").alias("weight"))
    )
    found = salted_join(members.select("id", "node"), communities(sizes.select("node"), links), ["node"])
    return representatives(tokens.join(found.select(F.col("id").alias("number"), F.col("community").alias("cluster")), "number"))


class Grouping:
    """A grouping strategy: subclass it, or wrap a function of the token frame."""

    def __init__(self, name: str, function):
        self.name, self._function = name, function

    def fit(self, tokens: DataFrame) -> DataFrame:
        """(token, cluster, representative)."""
        return self._function(tokens)


def compression_report(name: str, grouped: DataFrame, counts: DataFrame) -> DataFrame:
    """Clusters, single-word clusters, distinct representatives and the share of uses they cover."""
    sizes = grouped.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    clusters = sizes.where("cluster IS NOT NULL").agg(F.count(F.lit(1))).scalar()
    lonely = sizes.agg(F.sum(F.when(F.col("cluster").isNull(), F.col("n")).when(F.col("n") == 1, 1).otherwise(0))).scalar()
    reps = grouped.select(F.col("representative").alias("token")).distinct()
    total = counts.agg(F.sum("frequency")).scalar()
    return counts.join(reps, "token").agg(
        F.count(F.lit(1)).alias("representatives"), F.sum("frequency").alias("_covered")
    ).select(
        F.lit(name).alias("strategy"), clusters.alias("clusters"), lonely.alias("noise"),
        "representatives", (F.col("_covered") / total).alias("coverage"),
    )
