"""Match edges to clusters, and clusters to every record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.operators.forest import COMPONENT_EDGES, spanning, whole_components
from kithlink.operators.scale import discard, lookup, staged

# Cluster ids of unlinked records, different per role so they never meet.
UNLINKED_ADMIN = -2
UNLINKED_EXPERIMENT = -1
ADMIN_ROLE = "admin_evaluation"
EXPERIMENT_ROLE = "experiment_evaluation"


def _larger_neighbours_to_minimum(edges: DataFrame, rows: int) -> DataFrame:
    """Each node hands its larger neighbours the smallest node it sees (itself included)."""
    both = edges.select("u", "v", "moved").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "moved"))
    seen = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    above = both.where(F.col("v") > F.col("u"))
    return (lookup(above, seen, ["u"], F.col("v"), how="inner", rows_col="n", rows=rows)
            .groupBy(F.col("v").alias("u"), F.col("m").alias("v"))
            .agg(F.max(F.col("m") != F.col("u")).alias("moved")))


def _smaller_neighbours_to_minimum(edges: DataFrame, most: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, the smallest of them."""
    seen = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    rows = lookup(edges, seen, ["u"], F.col("v"), how="inner", rows_col="n", rows=most)
    keeps = F.col("v") == F.col("m")
    return (rows.groupBy(F.when(keeps, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .agg(F.max(F.col("moved") | ~keeps).alias("moved")))


def connected_components(edges: DataFrame, a: str = "rowid1", b: str = "rowid2", task_edges: int = COMPONENT_EDGES) -> DataFrame:
    """(rowid, cluster_id) for every node of the edges; the id is the smallest rowid.

    Tasks write only edges that connect what theirs do; up to `task_edges` of those are one task's work.
    Beyond that by star contraction: each round turns the edges towards local minima and writes them, until
    a round moves nothing.  Rounds grow with the logarithm of the longest chain; only a
    flag and a count per round reach the driver.
    """
    if {dict(edges.dtypes)[c] for c in (a, b)} == {"bigint"}:
        edges, a, b = staged(spanning(edges, a, b), "thin"), "rowid1", "rowid2"
        if edges.count() <= task_edges:
            found = staged(whole_components(edges), "components")
            discard(edges)
            return found
    nodes = edges.select(F.col(a).alias("rowid")).where(F.col(a) == F.col(b))
    # a round reads its edges several times, so they are written before the first one too
    links = staged(edges.where(F.col(a) != F.col(b))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .distinct().withColumn("moved", F.lit(True)), "links")
    rows = links.count()
    while True:
        # neither half of a round makes more rows than it reads
        before, links = links, staged(_smaller_neighbours_to_minimum(_larger_neighbours_to_minimum(links, rows), rows), "stars")
        discard(before)
        moved, rows = links.agg(F.max("moved"), F.count("*")).first()
        if not moved:
            break
    members = links.select(F.col("u").alias("rowid"), F.col("v").alias("cluster_id"))
    roots = links.select(F.col("v").alias("rowid"), F.col("v").alias("cluster_id"))
    alone = nodes.select("rowid", F.col("rowid").alias("cluster_id"))
    # a node with a self edge may also be a member of a larger component: the smaller id wins
    return (members.unionByName(roots).unionByName(alone)
            .groupBy("rowid").agg(F.min("cluster_id").alias("cluster_id")))


def assign_clusters(records: DataFrame, clusters: DataFrame | None = None,
                    matches: DataFrame | None = None) -> DataFrame:
    """Every record with its cluster id; unlinked records get the sentinel of their role."""
    if (clusters is None) == (matches is None):
        raise ValueError("give either clusters or matches")
    if clusters is None:
        clusters = connected_components(matches)
    records = records.select("rowid", "sid", "dataset", "date_of_birth")
    # one cluster id per record, or the records would multiply
    clusters = clusters.groupBy("rowid").agg(
        F.when(F.min("cluster_id") == F.max("cluster_id"), F.min("cluster_id"))
        .otherwise(F.raise_error(F.lit("a record is in two clusters")).cast("bigint")).alias("cluster_id"))
    unlinked = (F.when(F.col("dataset") == ADMIN_ROLE, F.lit(UNLINKED_ADMIN))
                .when(F.col("dataset") == EXPERIMENT_ROLE, F.lit(UNLINKED_EXPERIMENT)))
    return (records.join(clusters, "rowid", "left")
            .withColumn("cluster_id", F.coalesce("cluster_id", unlinked.cast("bigint"))))


def explode_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster_id, records, scores) arrays to one row per record."""
    return (clusters.select("cluster_id", F.explode(F.arrays_zip("records", "scores")).alias("member"))
            .select(F.col("member.records").alias("rowid"), "cluster_id",
                    F.col("member.scores").alias("confidence_score")))


def split_pair(pairs: DataFrame) -> DataFrame:
    """A pair column to two id columns."""
    return pairs.select(F.col("pair")[0].alias("rowid1"), F.col("pair")[1].alias("rowid2"),
                        *[c for c in pairs.columns if c != "pair"])


def stack_clustered(experiment: DataFrame, admin: DataFrame) -> DataFrame:
    return experiment.unionByName(admin)


def many_to_one(edges: DataFrame, cut: float = 0.5) -> DataFrame:
    """Each left record keeps its best right record at or above the cut; ties to the lower id."""
    place = Window.partitionBy("rowid1").orderBy(F.col("score").desc(), "rowid2")
    return (edges.where(F.col("score") >= cut).withColumn("_place", F.row_number().over(place))
            .where("_place = 1").drop("_place"))
