"""The unsupervised match model inside one table, where a pair has no first and second side.

A block holds on side A the records of its birth year (and name cluster) and on side B those of the years around it;
small blocks are one block together.  Two records meet in the block of the one, of the other, or of
both, and count once, in the lower of these blocks.  How many pairs a block has, and how they agree
on each field, are products of counts per (block, block of the other record), less what the lower
block holds already; no pair is listed for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.operators.blocking import COMPARED, SMALL_BLOCK
from kithlink.operators.compare import AGREEMENTS, AgreementRules, agreement_levels, graded
from kithlink.operators.em import BLOCK_KEYS, EmRules, field_values, with_posterior
from kithlink.operators.scale import broadcast_up_to, pairs_between, staged
from kithlink.operators.tiles import graded_pairs, pattern_sums

# The field that every record has: its totals are the pairs of a block.
ALL = "all"


def one_table_members(rows: DataFrame, limit: int, reach: int = 1) -> DataFrame:
    """(block, side, home, near, ..) of profiles of one table.

    `home` is the block where a profile is on side A: its birth year, within its `name_cluster` if the rows
    have one, or the merged block if that block has at most `limit` records.  `near` are the blocks where it
    is on side B.  Profiles without a birth date or name cluster are in no block.
    """
    key = ["name_cluster", "yob"] if "name_cluster" in rows.columns else ["yob"]
    known = rows.dropna(subset=key)
    own = F.concat_ws(".", *[F.col(k).cast("string") for k in key])
    homes = staged(known.groupBy(*key).agg(F.sum("copies").alias("_n")).select(
        *key, F.when(F.col("_n") <= limit, SMALL_BLOCK).otherwise(own).alias("home")), "homes")
    around = F.explode(F.sequence(F.col("yob") - reach, F.col("yob") + reach))
    # a set has at most 2 * reach + 1 blocks
    near = (homes.select(*key[:-1], around.alias("yob"), F.col("home").alias("_block"))
            .groupBy(*key).agg(F.sort_array(F.collect_set("_block")).alias("near")))
    # a row per birth year and name cluster
    placed = known.join(broadcast_up_to(homes.join(near, key)), key)
    return (placed.withColumns({"side": F.lit("A"), "block": F.col("home")})
            .unionByName(placed.withColumns({"side": F.lit("B"), "block": F.explode("near")})))


def _once(rows: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of a batch belong to its blocks: each pair counts in the lower of the blocks that hold it."""
    block, home, near = (rows[c].to_pylist() for c in ("block", "home", "near"))
    names = sorted({*block, *home})
    place = {x: i for i, x in enumerate(names)}
    block, home = (np.array([place[x] for x in column]) for column in (block, home))
    sets = {x: i for i, x in enumerate({tuple(x) for x in near})}
    holds = np.array([[x in s for x in names] for s in sets])
    near = np.array([sets[tuple(x)] for x in near])
    rowid = rows["rowid"].to_numpy()
    inside = home[b] == block[a]
    return np.where(inside, rowid[a] < rowid[b], (block[a] < home[b]) | ~holds[near[a], home[b]])


def _sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(members.where(members["side"] == x) for x in ("A", "B"))


def within_graded(members: DataFrame, rules: AgreementRules = AgreementRules(),
                  wanted: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Pairs of profiles that share a candidate key, each once, lower rowid first, with their agreement levels."""
    carried = ["rowid", "sid", "dataset", "copies"]
    pairs = graded_pairs(*_sides(members), BLOCK_KEYS, carried, rules, _once, ("home", "near"), wanted=wanted)
    turned = F.col("rowid1") > F.col("rowid2")
    ordered = {f"{c}{n}": F.when(turned, F.col(f"{c}{3 - n}")).otherwise(F.col(f"{c}{n}")) for c in carried for n in (1, 2)}
    return pairs.select("block", *[c.alias(n) for n, c in ordered.items()], *AGREEMENTS)


def _copies_graded(members: DataFrame, rules: AgreementRules) -> DataFrame:
    """The pairs among the copies of a profile: they agree on all that is known."""
    own = members.where("side = 'A' AND copies > 1")
    twice = own.select("block", F.shiftright(F.col("copies") * (F.col("copies") - 1), 1).alias("n_pairs"),
                       *[F.col(c).alias(f"{c}{n}") for c in COMPARED for n in (1, 2)])
    return agreement_levels(twice, rules).select("block", *AGREEMENTS, "n_pairs")


def within_patterns(members: DataFrame, pairs: DataFrame | None, totals: DataFrame,
                    rules: AgreementRules = AgreementRules()) -> DataFrame:
    """(block, agreement levels, n_pairs) over all pairs of records of each block.

    `pairs` are those of `within_graded`; without them the pairs are counted in the tasks that make them.
    `totals` are those of `within_totals`.  Pairs without a candidate key are counted by subtraction, as
    one pattern.
    """
    counted = (pattern_sums(*_sides(members), BLOCK_KEYS, rules, _once, ("home", "near")) if pairs is None else
               pairs.select("block", *AGREEMENTS, (F.col("copies1") * F.col("copies2")).alias("n_pairs")))
    compared = (counted.unionByName(_copies_graded(members, rules))
                .groupBy("block", *AGREEMENTS).agg(F.sum("n_pairs").alias("n_pairs")))
    compared = staged(compared, "patterns")
    seen = compared.groupBy("block").agg(F.sum("n_pairs").alias("n_seen"))
    unshared = {"g_last", "g_dob"}
    rest = (totals.where(F.col("field") == ALL).select("block", F.col("n_known").alias("n_all"))
            .join(seen, "block", "left")
            .withColumn("n_pairs", F.col("n_all") - F.coalesce("n_seen", F.lit(0))).where("n_pairs > 0")
            .select("block", *[F.lit(0 if g in unshared else None).cast("int").alias(g) for g in AGREEMENTS], "n_pairs"))
    return compared.unionByName(rest)


def within_totals(members: DataFrame, rules: AgreementRules = AgreementRules()) -> DataFrame:
    """(block, field, n_full, n_partial, n_known): how all pairs of a block agree on each field.

    The field ALL counts the pairs themselves.  Texts agree when they are equal; birth dates are graded
    over pairs of distinct dates.
    """
    fields = {**field_values(), ALL: F.lit("")}
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()]))
    counts = staged(members.where("side = 'B'").select("block", "home", "copies", values.alias("_v"))
                    .where("_v.value IS NOT NULL")
                    .groupBy("block", "home", F.col("_v.field").alias("field"), F.col("_v.value").alias("value"))
                    .agg(F.sum("copies").alias("n")), "values")
    key = ["block", "other", "field"]
    facing = counts.where(F.col("field") == ALL).select("block", F.col("home").alias("other"))
    # records of the block that the other block has on its side B: their pairs count in the lower of the two
    held = counts.where("block <> home").select(F.col("home").alias("block"), F.col("block").alias("other"),
                                                "field", "value", F.col("n").alias("_held"))
    free = F.col("n") - F.when(F.col("other") < F.col("block"), F.coalesce("_held", F.lit(0))).otherwise(0)
    left = staged(counts.where("block = home").drop("home").join(broadcast_up_to(facing), "block")
                  .join(held, [*key, "value"], "left").select(*key, "value", free.alias("l")).where("l > 0"), "free")
    right = counts.select("block", F.col("home").alias("other"), "field", "value", F.col("n").alias("r"))

    def once(products: Column) -> Column:
        """Inside a block the products count each pair from both ends, and each record with itself."""
        return F.when(F.col("block") == F.col("other"), F.shiftright(products - F.col("n_left"), 1)).otherwise(products)

    known = (left.groupBy(*key).agg(F.sum("l").alias("n_left"))
             .join(right.groupBy(*key).agg(F.sum("r").alias("n_right")), key)
             .withColumn("n_known", once(F.col("n_left") * F.col("n_right"))))
    equal = left.where("field <> 'g_dob'").join(right, [*key, "value"]).groupBy(*key).agg(
        F.sum(F.col("l") * F.col("r")).alias("n_full")).withColumn("n_partial", F.lit(0).cast("bigint"))
    n = F.col("l") * F.col("r")
    dates = pairs_between(left.where("field = 'g_dob'").select("block", "other", F.col("value").alias("v1"), "l"),
                          right.where("field = 'g_dob'").select("block", "other", F.col("value").alias("v2"), "r"),
                          ["block", "other"], "v1")
    level = graded(F.col("v1"), F.col("v2"), rules)
    near = (dates.withColumn("_level", level).groupBy("block", "other")
            .agg(F.sum(F.when(F.col("_level") == 2, n).otherwise(0)).alias("n_full"),
                 F.sum(F.when(F.col("_level") == 1, n).otherwise(0)).alias("n_partial"))
            .select("block", "other", F.lit("g_dob").alias("field"), "n_full", "n_partial"))
    both = F.when(F.col("block") == F.col("other"), F.shiftright(F.col("n_partial"), 1)).otherwise(F.col("n_partial"))
    return (known.join(equal.unionByName(near), key, "left")
            .groupBy("block", "field")
            .agg(F.sum(F.coalesce(once(F.col("n_full")), F.lit(0))).alias("n_full"),
                 F.sum(F.coalesce(both, F.lit(0))).alias("n_partial"), F.sum("n_known").alias("n_known"))
            .where("n_known > 0"))


def within_matches(pairs: DataFrame, fitted: DataFrame, rules: EmRules = EmRules()) -> DataFrame:
    """Pairs of profiles whose pattern reaches the threshold in their block, lower rowid first."""
    return with_posterior(pairs, fitted, rules)
