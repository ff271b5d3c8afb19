"""Which links and clusters are allowed, and clustering that respects it.

Roles are upper case here: EXPERIMENT, ADMIN_TRAINING, ADMIN_EVALUATION.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.operators.cluster import connected_components
from kithlink.operators.forest import FOREST_EDGES, greedy_clusters, greedy_edges
from kithlink.operators.scale import broadcast_up_to, dense_number, discard, lookup, staged

EXPERIMENT, TRAINING = "EXPERIMENT", "ADMIN_TRAINING"
# Components up to this many edges are resolved by one task each; larger ones by joins.
TASK_EDGES = 50_000


def link_allowed(role1: Column, role2: Column) -> Column:
    """Training records link to training records only; two experiment records never link."""
    return (((role1 == TRAINING) == (role2 == TRAINING))
            & ~((role1 == EXPERIMENT) & (role2 == EXPERIMENT)))


def valid_links(edges: DataFrame) -> DataFrame:
    return edges.withColumn("valid", link_allowed(F.col("dataset_1"), F.col("dataset_2")))


def cluster_state(members: DataFrame, key: str) -> DataFrame:
    """What the cluster rules look at, per cluster."""
    return members.groupBy(key).agg(
        F.sum("n_experiment").alias("n_experiment"), F.sum("n_training").alias("n_training"),
        F.sum("n_other").alias("n_other"), F.min("uid_low").alias("uid_low"), F.max("uid_high").alias("uid_high"))


def record_state(nodes: DataFrame) -> DataFrame:
    """State of a cluster of one row; `nodes` has rowid, dataset, uid_sid and, if its rows stand for
    several equal records, copies."""
    role = F.col("dataset")
    copies = F.col("copies").cast("long") if "copies" in nodes.columns else F.lit(1).cast("long")
    of = lambda is_role: F.when(is_role, copies).otherwise(F.lit(0).cast("long"))
    return nodes.select(
        "rowid", of(role == EXPERIMENT).alias("n_experiment"),
        of(role == TRAINING).alias("n_training"), of(role != TRAINING).alias("n_other"),
        F.col("uid_sid").alias("uid_low"), F.col("uid_sid").alias("uid_high"))


def state_valid() -> Column:
    """At most one experiment record, no mix of training with others, at most one known id."""
    return ((F.col("n_experiment") <= 1) & ((F.col("n_training") == 0) | (F.col("n_other") == 0))
            & F.coalesce(F.col("uid_low") == F.col("uid_high"), F.lit(True)))


def valid_clusters(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(cluster, valid, valid_ids): role rules and the unique-id rule."""
    states = cluster_state(members.select(key, "rowid").join(record_state(members), "rowid"), key)
    return states.select(
        key, ((F.col("n_experiment") <= 1) & ((F.col("n_training") == 0) | (F.col("n_other") == 0))).alias("valid"),
        F.coalesce(F.col("uid_low") == F.col("uid_high"), F.lit(True)).alias("valid_ids"))


def link_priority(edges: DataFrame) -> DataFrame:
    """`priority` 1.. over all edges: higher score first, then original order."""
    ordered = edges.withColumn("_neg", -F.col("phat"))
    return dense_number(ordered, ["_neg", "original_order", "rowid1", "rowid2"], "priority").drop("_neg")


# -- greedy clustering in priority order ----------------------------------------------

def _in_buckets(rows: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], task_edges: int) -> DataFrame:
    """Solve whole components, many per task: buckets of about `task_edges` edges.

    No component here has more than `task_edges` edges, and components do not touch, so a bucket
    is solved as one graph.
    """
    buckets = max(1, -(-rows.count() // max(task_edges, 1)), rows.sparkSession.sparkContext.defaultParallelism)
    return (rows.withColumn("_bucket", F.pmod(F.xxhash64("_comp"), F.lit(buckets)))
            .groupBy("_bucket").applyInPandas(solve, "rowid long, cluster_id long"))


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """Bounded components: take edges by priority, merge when the result is valid."""
    rows = rows.sort_values("priority")
    parent: dict[int, int] = {}
    state: dict[int, tuple] = {}
    for n in (1, 2):
        columns = [f"{c}{n}" for c in ("rowid", "n_experiment", "n_training", "n_other", "uid_low")]
        for rowid, e, t, o, uid in rows[columns].drop_duplicates().itertuples(index=False):
            parent[rowid] = rowid
            state[rowid] = (e, t, o, frozenset() if pd.isna(uid) else frozenset([uid]))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in rows[["rowid1", "rowid2"]].itertuples(index=False):
        a, b = root(a), root(b)
        if a == b:
            continue
        e, t, o = (state[a][i] + state[b][i] for i in range(3))
        uids = state[a][3] | state[b][3]
        if e <= 1 and (t == 0 or o == 0) and len(uids) <= 1:
            keep, gone = min(a, b), max(a, b)
            parent[gone] = keep
            state[keep] = (e, t, o, uids)
    return pd.DataFrame({"rowid": list(parent), "cluster_id": [root(x) for x in parent]})


def _with_states(edges: DataFrame, states: DataFrame, key: str) -> DataFrame:
    for n in (1, 2):
        side = states.select(F.col(key).alias(f"rowid{n}"),
                             *[F.col(c).alias(f"{c}{n}") for c in states.columns if c != key])
        edges = lookup(edges, side, [f"rowid{n}"], F.col("priority"), how="inner")
    return edges


def _merge_allowed() -> Column:
    """Would the two clusters of an edge form a valid one?"""
    total = {c: F.col(f"{c}1") + F.col(f"{c}2") for c in ("n_experiment", "n_training", "n_other")}
    same_id = F.coalesce(F.col("uid_low1") == F.col("uid_low2"), F.lit(True))
    return (total["n_experiment"] <= 1) & ((total["n_training"] == 0) | (total["n_other"] == 0)) & same_id


def _relabel(clusters: DataFrame, merges: DataFrame) -> DataFrame:
    """Replace cluster ids by the ids they merged into; `merges` has cluster_id and merged."""
    return (lookup(clusters, merges, ["cluster_id"], F.col("rowid"))
            .select("rowid", F.coalesce("merged", "cluster_id").alias("cluster_id")))


def _merge_by_joins(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Greedy result for components of any size, in rounds of joins.

    Rules only ever tighten as clusters grow, so (1) an edge whose merge is invalid stays
    invalid, (2) if all edges down to some priority form a valid cluster, greedy merges them
    all, and (3) an edge that is the best valid one at both of its ends is taken by greedy
    before anything else touches them.  A round uses (2) for all, half and a quarter of the
    edges of each component, and (3), which always makes progress.
    """
    clusters = staged(states.select("rowid", F.col("rowid").alias("cluster_id")), "greedy")
    while True:
        progress = False
        for part in (1.0, 0.5, 0.25, None):
            now = cluster_state(clusters.join(states, "rowid"), "cluster_id")
            moved = edges.select("rowid1", "rowid2", "priority")
            for n in (1, 2):
                names = clusters.select(F.col("rowid").alias(f"rowid{n}"), F.col("cluster_id").alias(f"_c{n}"))
                moved = lookup(moved, names, [f"rowid{n}"], F.col("priority"), how="inner")
            contracted = (moved.where("_c1 != _c2")
                          .groupBy(F.least("_c1", "_c2").alias("rowid1"), F.greatest("_c1", "_c2").alias("rowid2"))
                          .agg(F.min("priority").alias("priority")))
            open_edges = staged(_with_states(contracted, now, "cluster_id").where(_merge_allowed())
                                .select("rowid1", "rowid2", "priority"), "greedy_edges")
            if open_edges.isEmpty():
                return clusters
            if part is None:
                best = (open_edges.select(F.col("rowid1").alias("c"), "priority")
                        .unionByName(open_edges.select(F.col("rowid2").alias("c"), "priority"))
                        .groupBy("c").agg(F.min("priority").alias("priority")))
                mutual = best.groupBy("priority").agg(F.count("*").alias("_n")).where("_n = 2")
                merges = (open_edges.join(mutual, "priority", "left_semi")
                          .select(F.col("rowid2").alias("cluster_id"), F.col("rowid1").alias("merged")))
            else:
                chosen = open_edges
                if part < 1.0:
                    whole = connected_components(open_edges)
                    placed = lookup(open_edges, whole.select(F.col("rowid").alias("rowid1"),
                                                             F.col("cluster_id").alias("_comp")),
                                    ["rowid1"], F.col("priority"), how="inner")
                    bars = placed.groupBy("_comp").agg(F.percentile_approx("priority", part).alias("_bar"))
                    chosen = lookup(placed, bars, ["_comp"], F.col("priority"), how="inner") \
                        .where(F.col("priority") <= F.col("_bar"))
                groups = connected_components(chosen)
                merged_state = cluster_state(groups.withColumnRenamed("cluster_id", "_group")
                                             .join(now.withColumnRenamed("cluster_id", "rowid"), "rowid"), "_group")
                fine = merged_state.where(state_valid()).select("_group")
                merges = (groups.join(fine, groups["cluster_id"] == fine["_group"], "left_semi")
                          .where("rowid != cluster_id")
                          .select(F.col("rowid").alias("cluster_id"), F.col("cluster_id").alias("merged")))
            merges = staged(merges, "greedy_merges")
            if not merges.isEmpty():
                clusters = staged(_relabel(clusters, merges), "greedy")
                progress = True
        if not progress:
            return clusters


def _forest_by_joins(edges: DataFrame, forest_edges: int) -> DataFrame:
    """(rowid, cluster_id): greedy result where the one rule is that of single nodes; `edges` as of `greedy_edges`.

    In each round every cluster without a single node joins along its first edge, which halves such clusters at
    least, until one task can hold the edges that are left.
    """
    def ends() -> DataFrame:
        """Each edge from both of its ends."""
        return reduce(DataFrame.unionByName, [edges.select(
            F.col(f"rowid{n}").alias("rowid"), F.col(f"single{n}").alias("single"), F.col(f"rowid{3 - n}").alias("other"), "priority") for n in (1, 2)])

    clusters = staged(ends().select("rowid").distinct().withColumn("cluster_id", F.col("rowid")), "forest")
    while True:
        rows = edges.count()
        if rows == 0:
            return clusters
        if rows <= forest_edges:
            return _relabel(clusters, greedy_clusters(edges).select(F.col("rowid").alias("cluster_id"), F.col("cluster_id").alias("merged")))
        first = (ends().where("NOT single")
                 .groupBy("rowid").agg(F.min(F.struct("priority", "other")).alias("first")))
        groups = staged(connected_components(staged(first.select(F.col("rowid").alias("rowid1"), F.col("first.other").alias("rowid2")), "firsts")),
                        "groups")
        merges = groups.select(F.col("rowid").alias("cluster_id"), F.col("cluster_id").alias("merged"))
        clusters = staged(_relabel(clusters, merges), "forest")
        flags = (lookup(ends().select("rowid", "single").distinct(), groups, ["rowid"], F.col("rowid"))
                 .groupBy(F.coalesce("cluster_id", "rowid").alias("merged")).agg(F.max("single").alias("single")))
        moved = edges.select("rowid1", "rowid2", "priority")
        for n in (1, 2):
            moved = lookup(moved, merges.select(F.col("cluster_id").alias(f"rowid{n}"), "merged"), [f"rowid{n}"], F.col("priority"))
            moved = moved.withColumn(f"rowid{n}", F.coalesce("merged", f"rowid{n}")).drop("merged")
        moved = (moved.where("rowid1 != rowid2").groupBy(F.least("rowid1", "rowid2").alias("rowid1"), F.greatest("rowid1", "rowid2").alias("rowid2"))
                 .agg(F.min("priority").alias("priority")))
        for n in (1, 2):
            moved = lookup(moved, flags.select(F.col("merged").alias(f"rowid{n}"), F.col("single").alias(f"single{n}")), [f"rowid{n}"],
                           F.col("priority"), how="inner")
        before, edges = edges, staged(greedy_edges(moved.where("NOT (single1 AND single2)")), "forest_edges")
        discard(before)


def constrained_clusters(edges: DataFrame, nodes: DataFrame, task_edges: int = TASK_EDGES, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """(rowid, cluster_id): greedy merging by priority under the link and cluster rules.

    Outside of the training records the one rule is, unless ids are known there, that two experiment records never
    meet.  The greedy edges are then a minimum spanning forest, which tasks thin their edges to.  Among the others an
    edge between two records that may not meet is left out at once.  Components that are valid as a whole need no
    order.  The others go to one task each while they are small, and through rounds of joins beyond that.
    """
    states = staged(record_state(nodes), "states")
    prior = staged(link_priority(edges.where(link_allowed(F.col("dataset_1"), F.col("dataset_2")))), "priority")
    ends = prior.select(F.col("rowid1").alias("rowid")).unionByName(prior.select(F.col("rowid2").alias("rowid"))).distinct()
    in_training = F.col("dataset_1") == TRAINING
    outside = states.where("n_other > 0")
    if outside.where("uid_low IS NOT NULL").isEmpty():
        never = broadcast_up_to(outside.where("n_experiment > 1").select("rowid"))
        plain = prior.where(~in_training)
        for n in (1, 2):
            plain = plain.join(never.withColumnRenamed("rowid", f"rowid{n}"), f"rowid{n}", "left_anti")
        single = [(F.col(f"dataset_{n}") == EXPERIMENT).alias(f"single{n}") for n in (1, 2)]
        taken = staged(greedy_edges(plain.select("rowid1", "rowid2", "priority", *single)), "forest_edges")
        out, rest = _forest_by_joins(taken, forest_edges), prior.where(in_training)
    else:
        out, rest = None, prior
    rest = staged(_with_states(rest, states, "rowid").where(_merge_allowed()).select("rowid1", "rowid2", "priority"), "compatible")
    solved = _merged_by_rules(rest, states, task_edges)
    out = solved if out is None else out.unionByName(solved)
    return ends.join(out, "rowid", "left").select("rowid", F.coalesce("cluster_id", "rowid").alias("cluster_id"))


def _merged_by_rules(prior: DataFrame, states: DataFrame, task_edges: int) -> DataFrame:
    """(rowid, cluster_id) of the ends of numbered edges, under all rules."""
    parts = connected_components(prior).withColumnRenamed("cluster_id", "_comp")
    parts = staged(parts, "parts")
    placed = lookup(prior.select("rowid1", "rowid2", "priority"),
                    parts.select(F.col("rowid").alias("rowid1"), "_comp"), ["rowid1"], F.col("priority"), how="inner")
    sizes = placed.groupBy("_comp").agg(F.count("*").alias("_edges"))
    kinds = staged(cluster_state(parts.join(states, "rowid"), "_comp").join(sizes, "_comp")
                   .select("_comp", state_valid().alias("_fine"), "_edges"), "kinds")
    marked = staged(lookup(placed, kinds, ["_comp"], F.col("priority"), how="inner", rows_col="_edges"), "marked")
    fine = parts.join(kinds.where("_fine"), "_comp", "left_semi").select("rowid", F.col("_comp").alias("cluster_id"))
    hard = marked.where("NOT _fine")
    small = _with_states(hard.where(F.col("_edges") <= task_edges), states, "rowid")
    out = fine.unionByName(_in_buckets(small, _greedy, task_edges))
    large = hard.where(F.col("_edges") > task_edges)
    if not large.isEmpty():
        ends = large.select(F.col("rowid1").alias("rowid")).unionByName(
            large.select(F.col("rowid2").alias("rowid"))).distinct()
        out = out.unionByName(_merge_by_joins(large, states.join(ends, "rowid", "left_semi")))
    return out


# -- score-threshold clustering -------------------------------------------------------

def _average_linkage(rows: pd.DataFrame, cut: float) -> pd.DataFrame:
    """Bounded components: merge clusters that are each other's nearest until none reach the cut."""
    label = {x: x for x in pd.unique(rows[["rowid1", "rowid2"]].to_numpy().ravel())}
    size: dict[int, int] = {}
    links: dict[tuple, float] = {}
    for a, b, s, m, n in rows[["rowid1", "rowid2", "score", "copies1", "copies2"]].itertuples(index=False):
        size[a], size[b] = m, n
        # every copy of one side has the score with every copy of the other
        links[min(a, b), max(a, b)] = s * m * n
    while True:
        best: dict[int, tuple] = {}
        for (a, b), total in links.items():
            mean = round(total / (size[a] * size[b]), 12)
            if mean >= cut:
                rank = (-mean, a, b)
                for x in (a, b):
                    best[x] = min(best.get(x, rank), rank)
        merges = {r for x, r in best.items() if best[r[1]] == r and best[r[2]] == r}
        if not merges:
            break
        into = {b: a for _, a, b in merges}
        for b, a in into.items():
            size[a] += size.pop(b)
        summed: dict[tuple, float] = {}
        for (a, b), total in links.items():
            a, b = into.get(a, a), into.get(b, b)
            if a != b:
                key = (min(a, b), max(a, b))
                summed[key] = summed.get(key, 0.0) + total
        links = summed
        label = {x: into.get(c, c) for x, c in label.items()}
    return pd.DataFrame({"rowid": list(label), "cluster_id": list(label.values())})


def _linkage_by_joins(edges: DataFrame, cut: float) -> DataFrame:
    """The same merges in rounds of joins, for components of any size."""
    ends = edges.select(F.col("rowid1").alias("rowid"), F.col("copies1").alias("copies")).unionByName(
        edges.select(F.col("rowid2").alias("rowid"), F.col("copies2").alias("copies")))
    counted = staged(ends.distinct(), "copies")
    clusters = staged(counted.select("rowid", F.col("rowid").alias("cluster_id")), "linkage")
    links = staged(edges.select(F.col("rowid1").alias("a"), F.col("rowid2").alias("b"),
                                (F.col("score") * F.col("copies1") * F.col("copies2")).alias("total")), "links")
    while True:
        sizes = clusters.join(counted, "rowid").groupBy("cluster_id").agg(F.sum("copies").alias("n"))
        sized = links
        for c in ("a", "b"):
            sized = lookup(sized, sizes.select(F.col("cluster_id").alias(c), F.col("n").alias(f"n_{c}")),
                           [c], F.xxhash64("a", "b"), how="inner")
        near = sized.select("a", "b", F.round(F.col("total") / (F.col("n_a") * F.col("n_b")), 12).alias("mean")) \
            .where(F.col("mean") >= cut).withColumn("rank", F.struct((-F.col("mean")).alias("m"), "a", "b"))
        best = (near.select(F.col("a").alias("x"), "rank").unionByName(near.select(F.col("b").alias("x"), "rank"))
                .groupBy("x").agg(F.min("rank").alias("rank")))
        merges = staged(best.groupBy("rank").agg(F.count("*").alias("k")).where("k = 2")
                        .select(F.col("rank.b").alias("cluster_id"), F.col("rank.a").alias("merged")), "merges")
        if merges.isEmpty():
            return clusters
        before, clusters = (clusters, links), staged(_relabel(clusters, merges), "linkage")
        for c in ("a", "b"):
            into = merges.select(F.col("cluster_id").alias(c), "merged")
            links = lookup(links, into, [c], F.xxhash64("a", "b")).withColumn(c, F.coalesce("merged", c)).drop("merged")
        links = staged(links.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .agg(F.sum("total").alias("total")), "links")
        for used in (*before, merges):
            discard(used)


def partition_clusters(edges: DataFrame, cut: float = 0.5, task_edges: int = TASK_EDGES) -> DataFrame:
    """(rowid, cluster_id): average linkage of one table, pairs without an edge counting as 0.

    Edges below the cut still lower the mean between clusters, so they stay in, but only
    components connected above the cut can merge at all.  With columns `copies1` and `copies2` an end
    stands for so many equal records, and the mean is that over all of their pairs.
    """
    for n in (1, 2):
        if f"copies{n}" not in edges.columns:
            edges = edges.withColumn(f"copies{n}", F.lit(1).cast("long"))
    # a repeated edge counts once, with its best score
    up = F.col("rowid1") < F.col("rowid2")
    edges = staged(edges.where("rowid1 != rowid2")
                   .groupBy(F.least("rowid1", "rowid2").alias("rowid1"), F.greatest("rowid1", "rowid2").alias("rowid2"))
                   .agg(F.max("score").alias("score"), F.max(F.when(up, F.col("copies1")).otherwise(F.col("copies2"))).alias("copies1"),
                        F.max(F.when(up, F.col("copies2")).otherwise(F.col("copies1"))).alias("copies2")), "once")
    strong = edges.where(F.col("score") >= cut)
    parts = staged(connected_components(strong).withColumnRenamed("cluster_id", "_comp"), "parts")
    # a table of records, so that up to a limit the pairs stay where they are
    held = broadcast_up_to(parts)
    placed = edges
    for n in (1, 2):
        named = held.select(F.col("rowid").alias(f"rowid{n}"), F.col("_comp").alias(f"_comp{n}"))
        placed = (lookup(placed, named, [f"rowid{n}"], F.xxhash64("rowid1", "rowid2"), how="inner") if held is parts else
                  placed.join(F.broadcast(named), f"rowid{n}"))
    inside = staged(placed.where("_comp1 = _comp2").select("rowid1", "rowid2", "score", "copies1", "copies2", F.col("_comp1").alias("_comp")),
                    "inside")
    discard(edges)
    sizes = inside.groupBy("_comp").agg(F.count("*").alias("_edges"))
    few = staged(sizes, "sizes")
    # a row per component
    sized = inside.join(broadcast_up_to(few), "_comp")
    small = sized.where(F.col("_edges") <= task_edges)
    out = _in_buckets(small, lambda rows: _average_linkage(rows, cut), task_edges)
    large = sized.where(F.col("_edges") > task_edges)
    if not large.isEmpty():
        out = out.unionByName(_linkage_by_joins(large, cut))
    return out
