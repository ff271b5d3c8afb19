"""Raw case rows to clean cases, and clean cases to person records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions import dates, names
from kithlink.operators.scale import dense_number

RAW_COLUMNS = ["casnbr", "casfildat", "sid", "name", "dob", "sex", "race"]
PERSON_COLUMNS = ["rowid", "first_name", "last_name", "date_of_birth", "age_in_2020", "middle_name",
                  "middle_initial", "lineage", "race", "sex", "sid", "uid_sid"]
# Ids up to 100 and the id text 'M' stand for no person; 'NULL' for no race.
LOWEST_ID = 100
NO_ID = "M"
NO_RACE = "NULL"


def parse_dates(df: DataFrame) -> DataFrame:
    """Filing date in place and `date_of_birth` beside the birth text; bad dates become NULL."""
    return df.withColumns({"date_of_birth": dates.parse_mdy(F.col("dob")),
                           "casfildat": dates.parse_mdy(F.col("casfildat"))})


def filter_names(df: DataFrame) -> DataFrame:
    """Rows whose name is not empty and has at least two words."""
    return df.where((F.col("name") != "") & F.col("name").contains(" "))


def normalise_missing(df: DataFrame) -> DataFrame:
    """Sentinel texts: no id becomes NULL, no race becomes the empty text."""
    return df.withColumns({
        "sid": F.nullif(F.col("sid"), F.lit(NO_ID)),
        "race": F.when(F.col("race") == NO_RACE, "").otherwise(F.col("race"))})


def filter_ids(df: DataFrame) -> DataFrame:
    """Numeric ids above the reserved range."""
    return (df.withColumn("sid", F.col("sid").try_cast("double"))
            .where(F.col("sid") > LOWEST_ID)
            .withColumn("sid", F.col("sid").cast("bigint")))


def first_per_case(df: DataFrame, arrival: str) -> DataFrame:
    """First row of each (sid, casnbr) in order of arrival; full ties fall to the lowest texts.

    Filtering on the first place lets every map task send one row per key at most.
    """
    rest = [c for c in df.columns if c not in ("sid", "casnbr", arrival)]
    place = Window.partitionBy("sid", "casnbr").orderBy(arrival, *rest)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def number_rows(df: DataFrame) -> DataFrame:
    """rowid 1..N over (sid, casnbr), which is unique after `first_per_case`."""
    return dense_number(df, ["sid", "casnbr"], "rowid")


def parse_name(df: DataFrame) -> DataFrame:
    """Three name columns; the birth text is dropped."""
    return df.withColumns(names.parse_full_name(F.col("name"))).drop("dob")


def filter_missing_names(df: DataFrame) -> DataFrame:
    return df.where(names.is_present_name(F.col("first_name")) & names.is_present_name(F.col("last_name")))


def age_at_event(df: DataFrame) -> DataFrame:
    return df.withColumn("age", dates.age_at(F.col("casfildat"), F.col("date_of_birth")))


def usable_rows(raw: DataFrame, arrival: str) -> DataFrame:
    """Everything that happens to a raw row before rows are numbered.

    `arrival` is the column whose order is that of the rows in the file: a table has no first row.
    """
    return (raw.select(*RAW_COLUMNS, arrival).transform(parse_dates).transform(filter_names)
            .transform(normalise_missing).transform(filter_ids).transform(first_per_case, arrival).drop(arrival))


def clean_cases(raw: DataFrame, arrival: str) -> DataFrame:
    """Raw text rows to numbered clean cases."""
    return (usable_rows(raw, arrival).transform(number_rows).transform(parse_name)
            .transform(filter_missing_names).transform(age_at_event))


@dataclass(frozen=True)
class PreprocessRules:
    """`suffix_column` holds the generational suffix; `missing_birth` is 'error' or 'null'."""

    suffix_column: str = "middle_name"
    missing_birth: str = "error"


def preprocess(cases: DataFrame, rules: PreprocessRules = PreprocessRules()) -> DataFrame:
    """Clean cases to the twelve person columns.

    The middle name is first cut to its letters and then overwritten by the suffix column
    without its suffix, so with the default column both steps act on the middle name.
    """
    birth = F.col("date_of_birth")
    if rules.missing_birth == "error":
        birth = F.when(birth.isNull(), F.raise_error(F.lit("date_of_birth is missing")).cast("date")) \
                 .otherwise(birth)
    source = F.col(rules.suffix_column)
    return (cases
            .withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("middle_name", "race")})
            .withColumn("middle_name", names.letters_only(F.col("middle_name")))
            .withColumn("lineage", names.lineage(source))
            .withColumn("middle_name", names.without_lineage(source))
            .withColumns({
                "sid": F.concat(F.lit("SID"), F.col("sid").cast("bigint").cast("string")),
                "middle_initial": F.substring("middle_name", 1, 1),
                "sex": F.when(F.col("sex").isin("F", "M"), F.col("sex")),
                "age_in_2020": dates.age_on_reference_day(birth)})
            .withColumn("uid_sid", F.col("sid"))
            .select(*PERSON_COLUMNS))


def date_parts(persons: DataFrame) -> DataFrame:
    """Year of birth and age as numbers, month and day as two-digit texts."""
    birth = F.col("date_of_birth")
    return persons.withColumns({
        "age_in_2020": F.col("age_in_2020").cast("double"), "yob": F.year(birth).cast("double"),
        "mob": F.date_format(birth, "MM"), "dob": F.date_format(birth, "dd")})
