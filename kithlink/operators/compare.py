"""Comparison of candidate pairs: similarity columns, agreement levels, value checks, truth."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.functions.similarity import edit_similarity, jaro_winkler


@dataclass(frozen=True)
class Variable:
    """A compared variable: its type, its column per source, and an optional value check.

    Types: String, Date, Numeric, Categorical, UniqueID; None carries the column through.
    """

    name: str
    kind: str | None
    columns: dict[str, str]
    check: str | None = None


# The declared variables of the study; sources are experiment, admin_training, admin_evaluation.
SOURCES = ("experiment", "admin_training", "admin_evaluation")


def _everywhere(name: str, kind: str | None, column: str, check: str | None = None) -> Variable:
    return Variable(name, kind, {s: column for s in SOURCES}, check)


STUDY_VARIABLES = (
    _everywhere("first_name", "String", "first_name"),
    _everywhere("last_name", "String", "last_name"),
    _everywhere("dob", "Date", "date_of_birth", "Date - %Y-%m-%d"),
    _everywhere("age", "Numeric", "age_in_2020"),
    _everywhere("middle_initial", "Categorical", "middle_initial"),
    _everywhere("suffix", "Categorical", "lineage"),
    _everywhere("gender", "Categorical", "sex", "M,F"),
    _everywhere("race", "Categorical", "race"),
    Variable("uid_sid", "UniqueID", {"admin_training": "uid_sid"}),
    _everywhere("sid", None, "sid"),
    _everywhere("dataset", None, "dataset"),
)


def as_declared(df: DataFrame, source: str, variables: tuple[Variable, ...] = STUDY_VARIABLES) -> DataFrame:
    """One source under the declared variable names; a variable it lacks is NULL."""
    return df.select("rowid", *[
        (F.col(v.columns[source]) if source in v.columns else F.lit(None).cast("string")).alias(v.name)
        for v in variables])


def _check(column: Column, check: str) -> Column:
    if check.startswith("Date - "):
        layout = check.removeprefix("Date - ").replace("%Y", "yyyy").replace("%m", "MM").replace("%d", "dd")
        return F.try_to_timestamp(column.cast("string"), F.lit(layout)).cast("date")
    return F.when(column.isin(*check.split(",")), column)


def value_checks(df: DataFrame, variables: tuple[Variable, ...] = STUDY_VARIABLES) -> DataFrame:
    """Values that fail the declared check become NULL; their number is in `n_invalid`."""
    checked = {v.name: _check(F.col(v.name), v.check) for v in variables if v.check}
    failed = [(F.col(n).isNotNull() & c.isNull()).cast("int") for n, c in checked.items()]
    counted = df.withColumn("n_invalid", sum(failed, F.lit(0)))
    return counted.withColumns(checked)


def _equal(a: Column, b: Column) -> Column:
    """1 / 0, NULL when a side is missing."""
    return (a == b).cast("int")


COMPARATORS: dict[str, Callable[[Column, Column], Column]] = {
    "String": edit_similarity,
    "Date": lambda a, b: F.abs(F.datediff(a, b)),
    "Numeric": lambda a, b: F.abs(a - b),
    "Categorical": _equal,
    "UniqueID": _equal,
}


def compare_declared(pairs: DataFrame, variables: tuple[Variable, ...] = STUDY_VARIABLES) -> DataFrame:
    """Comparison column per declared variable of a pair of declared rows."""
    return pairs.select("rowid1", "rowid2", *[
        COMPARATORS[v.kind](F.col(f"{v.name}1"), F.col(f"{v.name}2")).alias(v.name)
        for v in variables if v.kind])


SIMILARITIES = ["first_name_sim", "last_name_sim", "dob_days", "dob_sim", "mi_equal", "race_equal",
                "sex_equal", "age_diff"]


def similarities() -> dict[str, Column]:
    """The comparison vector of the active and the supervised linker."""
    def both(c: str) -> tuple[Column, Column]:
        return F.col(f"{c}1"), F.col(f"{c}2")

    birth = both("date_of_birth")
    return {
        "first_name_sim": edit_similarity(*both("first_name")),
        "last_name_sim": edit_similarity(*both("last_name")),
        "dob_days": F.abs(F.datediff(*birth)),
        "dob_sim": edit_similarity(*[b.cast("string") for b in birth]),
        "mi_equal": _equal(*both("middle_initial")), "race_equal": _equal(*both("race")),
        "sex_equal": _equal(*both("sex")),
        "age_diff": F.abs(F.col("age_in_20201") - F.col("age_in_20202"))}


def compare_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(similarities())


def truth_labels(pairs: DataFrame) -> DataFrame:
    """'y' for one person, 'n' for two; and whether name and birth date agree exactly."""
    exact = [F.coalesce(F.col(f"{c}1") == F.col(f"{c}2"), F.lit(False))
             for c in ("first_name", "last_name", "date_of_birth")]
    return pairs.withColumns({
        "label": F.when(F.col("sid1") == F.col("sid2"), "y").otherwise("n"),
        "exact_match": (exact[0] & exact[1] & exact[2]).cast("int")})


@dataclass(frozen=True)
class AgreementRules:
    """Cut points on Jaro-Winkler for full and partial agreement."""

    full: float = 0.94
    partial: float = 0.88


AGREEMENTS = ["g_first", "g_last", "g_dob", "g_mi", "g_race", "g_sex", "g_month", "g_day"]


def graded(a: Column, b: Column, rules: AgreementRules) -> Column:
    """Level of two texts by Jaro-Winkler; NULL when a side is missing."""
    s = jaro_winkler(a, b)
    return F.when(s >= rules.full, 2).when(s >= rules.partial, 1).when(s.isNotNull(), 0)


def agreement_levels(pairs: DataFrame, rules: AgreementRules = AgreementRules()) -> DataFrame:
    """2 full, 1 partial, 0 none, NULL missing; names and birth date have the partial level."""
    def equal(a: Column, b: Column) -> Column:
        return F.when(a == b, 2).when(a != b, 0)

    birth = [F.col("date_of_birth1"), F.col("date_of_birth2")]
    return pairs.withColumns({
        "g_first": graded(F.col("first_name1"), F.col("first_name2"), rules),
        "g_last": graded(F.col("last_name1"), F.col("last_name2"), rules),
        "g_dob": graded(*[b.cast("string") for b in birth], rules),
        "g_mi": equal(F.col("middle_initial1"), F.col("middle_initial2")),
        "g_race": equal(F.col("race1"), F.col("race2")),
        "g_sex": equal(F.col("sex1"), F.col("sex2")),
        "g_month": equal(*[F.month(b) for b in birth]),
        "g_day": equal(*[F.dayofmonth(b) for b in birth])})
