"""Controlled study data sets: an eligible pool, a person-level split and quota samples.

All sampling follows one seeded order per stratum (class x cluster size x side), so a sample
is "the first k persons of the stratum".  The k of every specification are worked out on the
driver from the stratum sizes, a table of a few dozen rows; persons are then taken for all
specifications in one join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions.seeded import order_hash
from kithlink.operators.profile import (
    cluster_size_cutoff, cluster_size_dist, collapse_mixed, entity_class, stat_columns, with_entity_class)
from kithlink.operators.scale import lookup, seeded_rank, staged

SIDES = ("training", "evaluation")
CLASSES = ("singleton", "exact", "different")


@dataclass(frozen=True)
class SamplingRules:
    """Sizes and shares of a study; the defaults are the full-size study."""

    experiment_n: int = 1000
    sample_sizes: tuple[int, ...] = (5000, 50000, 200000)
    shares_exact: tuple[float, ...] = (0.5,)
    seed: int = 3
    max_cluster_size: int | None = 5
    max_cluster_share: float | None = None
    drop_large_exact: bool = False
    bins_different: int = 2
    bins_exact: int = 4
    # share of persons per cluster size; None takes the distribution of the pool
    target: dict[int, float] | None = field(
        default_factory=lambda: {1: 0.499, 2: 0.4, 3: 0.06, 4: 0.03, 5: 0.011})
    # True draws the fresh single records of the two experiment sets apart from each other
    disjoint_singletons: bool = False


def spec_name(size: int, share: float) -> str:
    return f"{size}__{int(share * 100)}"


# -- eligible pool --------------------------------------------------------------------

def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("sid").agg(F.count("*").alias("_size"))


def truncate_clusters(df: DataFrame, limit: int, bins: int, seed: int) -> DataFrame:
    """Cut every cluster above `limit` records down to one of the sizes limit, limit-1, ..

    The `bins` largest allowed sizes share out the oversize persons in proportion to how
    common they are; the last bin takes the remainder, so no person is lost.  A person then
    keeps its first records in seeded order.
    """
    sizes = staged(_sizes(df), "sizes")
    counts = {r["_size"]: r["n"] for r in
              sizes.groupBy("_size").agg(F.count("*").alias("n")).where(F.col("_size") <= limit)
              .where(F.col("_size") > limit - bins).collect()}  # at most `bins` rows
    oversize = sizes.where(F.col("_size") > limit)
    total = oversize.count()
    common = sum(counts.values())
    upto, borders = 0, []
    for size in sorted(counts, key=lambda s: (-counts[s], s)):
        upto = min(total, upto + round(total * (counts[size] / common)))
        borders.append((size, upto))
    target = F.lit(borders[-1][0] if borders else limit)
    for size, border in reversed(borders[:-1]):
        target = F.when(F.col("_turn") <= border, F.lit(size)).otherwise(target)
    targets = (seeded_rank(oversize.withColumn("_all", F.lit(0)), ["_all"], "sid", seed, "bin", "_turn")
               .select("sid", target.alias("_target"), F.col("_size").alias("_rows")))
    # the literal limit lets each map task drop the tail of a huge cluster before the shuffle
    digest = order_hash(seed, "keep", F.col("rowid"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy("_digest", "rowid"))
    return (lookup(df.withColumn("_digest", digest), targets, ["sid"], F.col("rowid"), rows_col="_rows")
            .withColumn("_place", place).where(F.col("_place") <= limit)
            .where(F.col("_target").isNull() | (F.col("_place") <= F.col("_target")))
            .select(*df.columns))


def size_limit(different: DataFrame, rules: SamplingRules) -> int | None:
    """The fixed cap, the largest size below the percentile, or no limit."""
    if rules.max_cluster_size is not None or rules.max_cluster_share is None:
        return rules.max_cluster_size
    return cluster_size_cutoff(different, rules.max_cluster_share).first()[0]


def size_policy(exact: DataFrame, different: DataFrame, rules: SamplingRules) -> tuple[DataFrame, DataFrame]:
    """Apply the size limit to the exact and the all-different clusters."""
    limit = size_limit(different, rules)
    if limit is None:
        return exact, different
    if rules.drop_large_exact:
        small = _sizes(exact).where(F.col("_size") <= limit).select("sid")
        exact = exact.join(small, "sid", "left_semi")
    else:
        exact = truncate_clusters(exact, limit, rules.bins_exact, rules.seed)
    return exact, truncate_clusters(different, limit, rules.bins_different, rules.seed)


def sampling_pool(profiled: DataFrame, rules: SamplingRules) -> DataFrame:
    """Singles, exact clusters and all-different clusters (mixed ones collapsed), sizes limited."""
    kind = entity_class()
    collapsed = staged(collapse_mixed(profiled), "collapsed")
    exact, different = size_policy(profiled.where(kind == "exact"),
                                   profiled.where(kind == "different").unionByName(collapsed), rules)
    rows = profiled.where(kind == "singleton").unionByName(exact).unionByName(different)
    # the statistics read the pool rows several times: write them once
    return stat_columns(staged(rows, "pool_rows"))


# -- split ----------------------------------------------------------------------------

def ranked_persons(pool: DataFrame, rules: SamplingRules) -> DataFrame:
    """One row per person: class, cluster size, side, and rank 1.. within class x size x side.

    Half of each class x size stratum (half-even) goes to training; a person is on one side only.
    """
    persons = (with_entity_class(pool).groupBy("sid")
               .agg(F.first("entity_class").alias("entity_class"), F.first("n_records").alias("n_records")))
    split = seeded_rank(persons, ["entity_class", "n_records"], "sid", rules.seed, "split", "_turn", "_persons")
    training = F.bround(F.col("_persons") / 2, 0)
    sided = split.withColumn("side", F.when(F.col("_turn") <= training, SIDES[0]).otherwise(SIDES[1]))
    return seeded_rank(sided.drop("_turn", "_persons"), ["entity_class", "n_records", "side"], "sid",
                       rules.seed, "sample", "rank")


def train_eval_split(pool: DataFrame, rules: SamplingRules) -> DataFrame:
    """(sid, entity_class, n_records, side) for every person of the pool."""
    return ranked_persons(pool, rules).select("sid", "entity_class", "n_records", "side")


# -- quotas ---------------------------------------------------------------------------

def person_quotas(target: dict[int, float], n_persons: int, n_records_by_size: dict[int, int] | None,
                  rules: SamplingRules) -> dict[int, dict[int, int]]:
    """Persons wanted per data set size and cluster size.

    Half the experiment set moves out of each admin set later, one record per person of two or
    more; the distribution is shifted up beforehand so that it is right afterwards.
    """
    if n_records_by_size is None and not 0.9999 <= sum(target.values()) <= 1.0001:
        raise ValueError(f"target shares sum to {sum(target.values())}, not to 1")
    # one row per cluster size
    sizes = np.array(sorted(target), dtype=float)
    shares = np.array([target[s] for s in sorted(target)], dtype=float)
    offered = (np.array([n_records_by_size.get(int(s), 0) for s in sizes], dtype=float) if n_records_by_size
               else np.trunc(shares * n_persons))
    half = rules.experiment_n / 2
    # persons that lose a record to the experiment set come from the next larger size
    lost = np.trunc(half * shares)
    gained = np.concatenate([[0.0], lost[:-1]])
    lost[-1] = 0.0

    def made_up_like(offer: np.ndarray, records: float) -> np.ndarray:
        """Persons per size that hold about `records` records in the proportions of `offer`."""
        return np.rint(np.rint(records / (sizes * offer).sum() * offer * sizes) / sizes)

    def quota(records: int) -> dict[int, int]:
        level = shares * made_up_like(offered, records).sum() + gained - lost
        wanted = made_up_like(np.trunc(level / level.sum() * n_persons), records + half)
        return {int(s): int(n) for s, n in zip(sizes, wanted)}

    return {records: quota(records) for records in rules.sample_sizes}


def class_quota(kind: str, size: int, persons: int, share_exact: float) -> int:
    if kind == "singleton":
        return persons if size == 1 else 0
    if kind == "exact":
        return round(share_exact * persons) if size > 1 else 0
    if kind == "different":
        return round((1 - share_exact) * persons) if size > 1 else 0
    raise ValueError(f"unknown entity class {kind}")


def take_counts(available: dict[int, int], wanted: dict[int, int]) -> dict[int, int]:
    """Persons to take per cluster size of one class and side.

    A size that runs short is filled up from the next smaller sizes, with as many more persons
    as it takes to keep the number of records; smaller sizes have served themselves before.
    """
    taken = {s: 0 for s in available}
    for size in sorted(wanted):
        if not available.get(size) or not wanted[size]:
            continue
        got = min(available[size] - taken[size], wanted[size])
        taken[size] += got
        lower, short = size, wanted[size] - got
        while short > 0 and lower > 1:
            need = math.ceil(short * lower / (lower - 1))
            lower -= 1
            extra = min(need, available.get(lower, 0) - taken.get(lower, 0))
            if extra:
                taken[lower] += extra
            short -= extra
    return taken


def quota_table(pool: DataFrame, rules: SamplingRules) -> DataFrame:
    """(spec_n, cluster_size, n_sids) wanted before the classes share them."""
    spark = pool.sparkSession
    rows = [(size, s, n) for size, by_size in _quotas(pool, rules).items() for s, n in by_size.items()]
    return spark.createDataFrame(rows, "spec_n long, cluster_size int, n_sids long")


def _quotas(pool: DataFrame, rules: SamplingRules) -> dict[int, dict[int, int]]:
    if rules.target is not None:
        return person_quotas(rules.target, pool.select("sid").distinct().count(), None, rules)
    # one row per cluster size
    dist = cluster_size_dist(pool).collect()
    return person_quotas({r["cluster_size"]: r["share"] for r in dist}, sum(r["n_sids"] for r in dist),
                         {r["cluster_size"]: r["n_sids"] for r in dist}, rules)


def take_table(pool: DataFrame, persons: DataFrame, rules: SamplingRules) -> DataFrame:
    """(spec, side, entity_class, n_records, take) for every specification."""
    spark = pool.sparkSession
    strata = persons.groupBy("entity_class", "n_records", "side").agg(F.count("*").alias("n")).collect()
    quotas = _quotas(pool, rules)
    rows = []
    for size in rules.sample_sizes:
        for share in rules.shares_exact:
            for side in SIDES:
                for kind in CLASSES:
                    available = {r["n_records"]: r["n"] for r in strata
                                 if r["entity_class"] == kind and r["side"] == side}
                    wanted = {s: class_quota(kind, s, n, share) for s, n in quotas[size].items()}
                    rows += [(spec_name(size, share), share, side, kind, s, k)
                             for s, k in take_counts(available, wanted).items() if k > 0]
    return spark.createDataFrame(
        rows, "spec string, share_exact double, side string, entity_class string, n_records long, take long")


def quota_sample(persons: DataFrame, takes: DataFrame) -> DataFrame:
    """(spec, side, sid) of the persons taken; `takes` has a few rows per specification."""
    return (persons.join(F.broadcast(takes), ["side", "entity_class", "n_records"])
            .where(F.col("rank") <= F.col("take"))
            .select("spec", "share_exact", "side", "entity_class", "sid", F.col("n_records").alias("_rows")))


def admin_datasets(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pool records of the persons taken, once per specification and side.

    Pool clusters are limited in size, so the join on sid has no hot key.
    """
    return pool.join(chosen.select("spec", "share_exact", "side", "sid"), "sid")


# -- experiment sets ------------------------------------------------------------------

def eligible_singletons(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    """Single-record persons that no specification took on either side."""
    return (pool.where(F.col("n_records") == 1)
            .join(chosen.select("sid").distinct(), "sid", "left_anti"))


def experiment_rows(pool: DataFrame, chosen: DataFrame, rules: SamplingRules) -> DataFrame:
    """(spec, side, rowid) that form the experiment sets: fresh singles, and the first record of
    sampled exact and all-different persons in the shares of the specification."""
    half = rules.experiment_n // 2
    specs = [(spec_name(n, s), s, side) for n in rules.sample_sizes for s in rules.shares_exact for side in SIDES]
    singles = seeded_rank(eligible_singletons(pool, chosen).select("rowid").withColumn("_all", F.lit(0)),
                          ["_all"], "rowid", rules.seed, "fresh", "rank")
    # every data set takes its range of the one seeded order
    takers = []
    for spec, _, side in specs:
        skip = half if rules.disjoint_singletons and side == SIDES[1] else 0
        takers.append(F.struct(F.lit(spec).alias("spec"), F.lit(side).alias("side"), F.lit(skip).alias("low")))
    new = (singles.where(F.col("rank") <= 2 * half)
           .select("rowid", "rank", F.explode(F.array(*takers)).alias("_t"))
           .where((F.col("rank") > F.col("_t.low")) & (F.col("rank") <= F.col("_t.low") + half))
           .select("_t.spec", "_t.side", "rowid"))
    several = chosen.where(F.col("entity_class").isin("exact", "different"))
    lowest = pool.where(F.col("n_records") > 1).groupBy("sid").agg(F.min("rowid").alias("rowid"))
    firsts = several.join(lowest, "sid")
    ranked = seeded_rank(firsts, ["spec", "side", "entity_class"], "rowid", rules.seed, "move", "rank")
    quota = (half * F.when(F.col("entity_class") == "exact", F.col("share_exact"))
             .otherwise(1 - F.col("share_exact"))).cast("int")
    return new.unionByName(ranked.where(F.col("rank") <= quota).select("spec", "side", "rowid"))


def build_datasets(profiled: DataFrame, rules: SamplingRules) -> DataFrame:
    """All four roles of every specification, from profiled persons, as one table."""
    pool = staged(sampling_pool(profiled, rules), "pool")
    persons = staged(ranked_persons(pool, rules), "persons_ranked")
    takes = take_table(pool, persons, rules)
    chosen = staged(quota_sample(persons, takes), "chosen")
    experiment = staged(experiment_rows(pool, chosen, rules), "experiment_rows")
    return datasets_of(pool, chosen, experiment)


def datasets_of(pool: DataFrame, chosen: DataFrame, experiment: DataFrame) -> DataFrame:
    """Admin sets without the records that moved, and the experiment sets, with their role."""
    admin = (admin_datasets(pool, chosen).join(experiment, ["spec", "side", "rowid"], "left_anti")
             .withColumn("dataset", F.concat(F.lit("admin_"), F.col("side"))))
    moved = (pool.join(experiment, "rowid")
             .withColumn("dataset", F.concat(F.lit("experiment_"), F.col("side"))))
    return admin.drop("share_exact", "side").unionByName(moved.drop("side"))
