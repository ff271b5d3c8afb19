"""Unsupervised match model: Fellegi-Sunter mixture fitted by EM per block.

A block enters as the counts of its agreement patterns, at most a few thousand rows however
many pairs it has.  Only pairs that share a candidate key are compared.  The others are taken as
non-matches; how often they agree on each field follows from value counts, by subtraction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.operators.compare import AGREEMENTS, AgreementRules, graded
from kithlink.operators.scale import broadcast_up_to, lookup, pairs_between, staged
from kithlink.operators.tiles import code_of, graded_pairs, pattern_sums

# Matching patterns that are handed to every task; of more the pairs are joined to them after they are made.
HANDED_OUT = 200_000
# Candidate keys inside a block.
BLOCK_KEYS = [["last_name"], ["first_name", "middle_initial"], ["date_of_birth"]]


@dataclass(frozen=True)
class EmRules:
    threshold: float = 0.85
    tolerance: float = 1e-5
    max_rounds: int = 500
    first_match_share: float = 0.05
    floor: float = 1e-6


def _sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(members.where(members["side"] == x) for x in ("A", "B"))


def block_pairs(members: DataFrame, rules: AgreementRules = AgreementRules(), wanted: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Candidate pairs of side A and side B profiles inside each block with their agreement levels."""
    return graded_pairs(*_sides(members), BLOCK_KEYS, ["rowid", "sid", "dataset", "copies"], rules, wanted=wanted)


def pattern_counts(members: DataFrame, rules: AgreementRules = AgreementRules()) -> DataFrame:
    """(block, agreement levels, n_pairs) over all pairs of each block, copies counted.

    Compared pairs are graded and counted in the tasks that make them; they are not shuffled.
    Pairs that share no candidate key are counted by subtraction, as one pattern.
    """
    compared = staged(pattern_sums(*_sides(members), BLOCK_KEYS, rules), "compared")
    copies = F.col("copies")
    totals = (members.groupBy("block").agg(F.sum(F.when(F.col("side") == "A", copies).otherwise(0)).alias("a"),
                                           F.sum(F.when(F.col("side") == "B", copies).otherwise(0)).alias("b"))
              .select("block", (F.col("a") * F.col("b")).alias("n_all")))
    seen = compared.groupBy("block").agg(F.sum("n_pairs").alias("n_seen"))
    unshared = {"g_last", "g_dob"}
    rest = (totals.join(seen, "block", "left")
            .withColumn("n_pairs", F.col("n_all") - F.coalesce("n_seen", F.lit(0))).where("n_pairs > 0")
            .select("block", *[F.lit(0 if g in unshared else None).cast("int").alias(g) for g in AGREEMENTS],
                    "n_pairs"))
    return (compared.unionByName(rest)
            .groupBy("block", *AGREEMENTS).agg(F.sum("n_pairs").alias("n_pairs")))


def field_values() -> dict[str, Column]:
    """The value of each compared field as a text."""
    birth = F.col("date_of_birth")
    return {"g_first": F.col("first_name"), "g_last": F.col("last_name"), "g_dob": birth.cast("string"),
            "g_mi": F.col("middle_initial"), "g_race": F.col("race"), "g_sex": F.col("sex"),
            "g_month": F.month(birth).cast("string"), "g_day": F.dayofmonth(birth).cast("string")}


def field_totals(members: DataFrame, rules: AgreementRules = AgreementRules()) -> DataFrame:
    """(block, field, n_full, n_partial, n_known): how all pairs of a block agree on each field.

    Sums of products of value counts; no pair of records is made.  Texts count as agreeing when
    they are equal.  Birth dates of one year are all alike as texts, so their levels are taken
    over pairs of distinct dates, of which a block has no more than its calendar has days.
    """
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in field_values().items()]))
    counts = (members.select("block", "side", "copies", values.alias("_v"))
              .where("_v.value IS NOT NULL")
              .groupBy("block", F.col("_v.field").alias("field"), F.col("_v.value").alias("value"))
              .agg(F.sum(F.when(F.col("side") == "A", F.col("copies")).otherwise(0)).alias("a"),
                   F.sum(F.when(F.col("side") == "B", F.col("copies")).otherwise(0)).alias("b")))
    counts = staged(counts, "values")
    totals = counts.groupBy("block", "field").agg(
        F.sum(F.col("a") * F.col("b")).alias("n_equal"), (F.sum("a") * F.sum("b")).alias("n_known"))
    dates = counts.where("field = 'g_dob'")
    pairs = pairs_between(dates.where("a > 0").select("block", F.col("value").alias("v1"), "a"),
                          dates.where("b > 0").select("block", F.col("value").alias("v2"), "b"), ["block"], "v1")
    level = graded(F.col("v1"), F.col("v2"), rules)
    n = F.col("a") * F.col("b")
    graded_dates = (pairs.withColumn("_level", level).groupBy("block")
                    .agg(F.sum(F.when(F.col("_level") == 2, n).otherwise(0)).alias("n_full"),
                         F.sum(F.when(F.col("_level") == 1, n).otherwise(0)).alias("n_partial"),
                         F.sum(n).alias("n_known"))
                    .select("block", F.lit("g_dob").alias("field"), "n_full", "n_partial", "n_known"))
    plain = totals.where("field <> 'g_dob' AND n_known > 0").select(
        "block", "field", F.col("n_equal").alias("n_full"), F.lit(0).cast("bigint").alias("n_partial"), "n_known")
    return plain.unionByName(graded_dates)


def fit_mixture(levels: np.ndarray, counts: np.ndarray, rest_levels: np.ndarray, rest: float,
                rules: EmRules) -> tuple[np.ndarray, dict]:
    """Posterior match probability of each pattern; `levels` has NaN where a field is missing.

    `rest` pairs share no candidate key and are non-matches by definition; `rest_levels`
    (field x level) says how they agree, which is all the update of u needs of them.
    """
    hot = np.stack([levels == v for v in range(3)], axis=2).astype(float)  # pattern, field, level
    total = counts.sum() + rest
    # start: matches mostly agree, non-matches agree as often as all pairs of the block do
    u = np.einsum("p,pfl->fl", counts, hot) + rest_levels + rules.floor
    u /= u.sum(axis=1, keepdims=True)
    m = np.tile([0.05, 0.1, 0.85], (levels.shape[1], 1))
    share, rounds, change = min(rules.first_match_share, 0.5 * counts.sum() / total), 0, np.inf
    posterior = np.zeros(len(counts))
    while rounds < rules.max_rounds and change > rules.tolerance:
        log_m = np.einsum("pfl,fl->p", hot, np.log(m)) + np.log(share)
        log_u = np.einsum("pfl,fl->p", hot, np.log(u)) + np.log1p(-share)
        posterior = 1 / (1 + np.exp(np.clip(log_u - log_m, -500, 500)))
        new_share = float(np.clip((counts * posterior).sum() / total, rules.floor, 1 - rules.floor))
        new_m = np.einsum("p,pfl->fl", counts * posterior, hot) + rules.floor
        new_u = np.einsum("p,pfl->fl", counts * (1 - posterior), hot) + rest_levels + rules.floor
        new_m /= new_m.sum(axis=1, keepdims=True)
        new_u /= new_u.sum(axis=1, keepdims=True)
        change = max(abs(new_share - share), np.abs(new_m - m).max(), np.abs(new_u - u).max())
        share, m, u, rounds = new_share, new_m, new_u, rounds + 1
    return posterior, {"share": share, "m": m, "u": u, "rounds": rounds, "converged": bool(change <= rules.tolerance)}


EM_SCHEMA = ("block string, " + ", ".join(f"{g} int" for g in AGREEMENTS)
             + ", n_pairs long, posterior double, match_share double, rounds int, converged boolean, error string")


def _rest_levels(levels: np.ndarray, counts: np.ndarray, totals: pd.DataFrame) -> np.ndarray:
    """Agreement of the pairs without a candidate key: block totals less the compared pairs."""
    known = totals.set_index("field")
    out = np.zeros((len(AGREEMENTS), 3))
    for i, g in enumerate(AGREEMENTS):
        if g in known.index:
            full = max(0.0, known.loc[g, "n_full"] - counts[levels[:, i] == 2].sum())
            partial = max(0.0, known.loc[g, "n_partial"] - counts[levels[:, i] == 1].sum())
            both = known.loc[g, "n_known"] - counts[~np.isnan(levels[:, i])].sum()
            out[i] = [max(0.0, both - full - partial), partial, full]
    return out


def em_link(counts: DataFrame, totals: DataFrame, rules: EmRules = EmRules()) -> DataFrame:
    """Posterior per (block, pattern) from `pattern_counts` and `field_totals` of the same members.

    The pattern of pairs without a candidate key gets 0.  A block that cannot be fitted keeps
    its reason and no posterior; `with_posterior` makes that an error.
    """
    def fit(rows: pd.DataFrame, fields: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:  # a block with one side only has no pairs
            return pd.DataFrame({c.split()[0]: [] for c in EM_SCHEMA.split(", ")}, dtype=object)
        rows = rows.sort_values(AGREEMENTS).reset_index(drop=True)
        out = rows.assign(posterior=0.0, match_share=None, rounds=0, converged=False, error=None)
        unshared = (rows["g_last"] == 0) & (rows["g_dob"] == 0) & rows["g_first"].isna()
        compared = ~unshared.to_numpy()
        try:
            levels = rows.loc[compared, AGREEMENTS].to_numpy(dtype=float)
            n = rows.loc[compared, "n_pairs"].to_numpy(dtype=float)
            if len(n):
                posterior, info = fit_mixture(levels, n, _rest_levels(levels, n, fields),
                                              float(rows.loc[~compared, "n_pairs"].sum()), rules)
                if not np.isfinite(posterior).all():
                    raise ValueError("the posterior is not a number")
                out.loc[compared, "posterior"] = posterior
                out["match_share"], out["rounds"] = info["share"], info["rounds"]
                out["converged"] = info["converged"]
        except Exception as e:  # the other blocks are fitted; the reason is kept
            out["posterior"], out["error"] = None, f"{type(e).__name__}: {e}"
        for g in AGREEMENTS:
            out[g] = pd.Series([None if pd.isna(v) else int(v) for v in out[g]], dtype=object)
        return out

    # a block has at most 4^3 * 3^5 patterns
    named = totals.withColumnRenamed("block", "_totals_of")
    return counts.groupBy("block").cogroup(named.groupBy("_totals_of")).applyInPandas(fit, EM_SCHEMA)


def em_matches(members: DataFrame, fitted: DataFrame, rules: EmRules = EmRules(),
               levels: AgreementRules = AgreementRules()) -> DataFrame:
    """Profile pairs whose pattern reaches the threshold in their block; no one-to-one reduction."""
    return with_posterior(block_pairs(members, levels, matching_codes(fitted, rules)), fitted, rules)


def matching_patterns(fitted: DataFrame, rules: EmRules = EmRules()) -> DataFrame:
    """(block, agreement levels, posterior) of the patterns that reach the threshold; a block that was not fitted is an error."""
    failed = F.raise_error(F.concat(F.lit("block "), F.col("block"), F.lit(" was not fitted: "), F.col("error"))).cast("double")
    return (fitted.withColumn("posterior", F.when(F.col("error").isNull(), F.col("posterior")).otherwise(failed))
            .where(F.col("posterior") >= rules.threshold).select("block", *AGREEMENTS, "posterior"))


def matching_codes(fitted: DataFrame, rules: EmRules = EmRules()) -> dict[str, np.ndarray] | None:
    """The pattern codes of the matching patterns by block, for tasks to look up; None if there are too many to hand out."""
    patterns = matching_patterns(fitted, rules).where("block IS NOT NULL").select("block", code_of().alias("code"))
    # at most a few hundred patterns per block reach the threshold
    rows = patterns.limit(HANDED_OUT + 1).toPandas()
    if len(rows) > HANDED_OUT:
        return None
    return {block: of.to_numpy(dtype=np.int64) for block, of in rows.groupby("block")["code"]}


def with_posterior(pairs: DataFrame, fitted: DataFrame, rules: EmRules = EmRules()) -> DataFrame:
    """Those of the graded pairs whose pattern reaches the threshold in their block.

    A block that was not fitted is an error here: without a posterior it would pass for one without matches.
    """
    patterns = matching_patterns(fitted, rules)
    same = [pairs[c].eqNullSafe(patterns[c]) for c in AGREEMENTS]
    # at most a few hundred patterns per block reach the threshold
    patterns = broadcast_up_to(patterns)
    joined = pairs.join(patterns, [pairs["block"] == patterns["block"], *same])
    return joined.select(pairs["block"], "rowid1", "sid1", "dataset1", "rowid2", "sid2", "dataset2",
                         "copies1", "copies2", F.col("posterior").alias("score"))


def match_rows(matches: DataFrame, records: DataFrame) -> DataFrame:
    """Matches with id, truth and role of both sides."""
    sides = [records.select(F.col("rowid").alias(f"rowid{n}"), F.col("sid").alias(f"sid{n}"),
                            F.col("dataset").alias(f"d{n}")) for n in (1, 2)]
    counts = [matches.groupBy(f"rowid{n}").agg(F.count("*").alias("_n")) for n in (1, 2)]
    facts = [counts[i].join(sides[i], f"rowid{i + 1}") for i in (0, 1)]
    one = lookup(matches.select("rowid1", "rowid2"), facts[0], ["rowid1"], F.col("rowid2"),
                 how="inner", rows_col="_n").drop("_n")
    return lookup(one, facts[1], ["rowid2"], F.col("rowid1"), how="inner", rows_col="_n") \
        .select("rowid1", "sid1", "d1", "rowid2", "sid2", "d2")
