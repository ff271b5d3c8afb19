"""Entity profiling: how many records and spellings each person has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions.numbers import half_even
from kithlink.operators.scale import lookup

STAT_COLUMNS = ["name_dob", "sid_name_dob", "n_records", "n_uq_namedob", "n_records_per_sid_name_dob",
                "any_non_exact_match", "all_non_exact_match"]


def records_per_person(df: DataFrame) -> DataFrame:
    return df.groupBy("sid").agg(F.count("*").alias("n_records"))


def share_singletons(df: DataFrame) -> DataFrame:
    return records_per_person(df).agg(F.avg((F.col("n_records") == 1).cast("double")).alias("share_singletons"))


def name_dob(first: str = "first_name", last: str = "last_name", birth: str = "date_of_birth") -> Column:
    """Name and birth date as one text, NULL as soon as one part is."""
    return F.concat(F.col(first), F.lit(" "), F.col(last), F.lit(" "), F.col(birth).cast("string"))


def stat_columns(df: DataFrame) -> DataFrame:
    """Seven statistic columns per record, from two grouped passes joined back.

    Spellings are counted per (sid, spelling) first, so the per-person pass reads one row
    per spelling and a person with very many records costs no task more than another.
    """
    keyed = df.drop(*[c for c in STAT_COLUMNS if c in df.columns]).withColumn("name_dob", name_dob())
    spellings = keyed.groupBy("sid", "name_dob").agg(F.count("rowid").alias("_n_same"))
    persons = spellings.groupBy("sid").agg(F.sum("_n_same").alias("n_records"),
                                           F.count("name_dob").alias("n_uq_namedob"))
    spelled = (spellings.where(F.col("name_dob").isNotNull())
               .withColumnRenamed("_n_same", "n_records_per_sid_name_dob"))
    joined = lookup(keyed, persons, ["sid"], F.col("rowid"), rows_col="n_records")
    joined = lookup(joined, spelled, ["sid", "name_dob"], F.col("rowid"),
                    rows_col="n_records_per_sid_name_dob")
    several = F.col("n_uq_namedob") > 1
    return joined.withColumns({
        "sid_name_dob": F.concat(F.col("sid"), F.lit(" "), F.col("name_dob")),
        "any_non_exact_match": several.cast("int"),
        "all_non_exact_match": (several & (F.col("n_uq_namedob") == F.col("n_records"))).cast("int"),
    }).select(*[c for c in df.columns if c not in STAT_COLUMNS], *STAT_COLUMNS)


def cluster_size_dist(df: DataFrame) -> DataFrame:
    """Persons per cluster size, with their share to three places."""
    sizes = records_per_person(df).groupBy(F.col("n_records").alias("cluster_size")) \
        .agg(F.count("*").alias("n_sids"))
    # one row per distinct cluster size
    every = Window.partitionBy(F.lit(1))
    return sizes.withColumn("share", half_even(F.col("n_sids") / F.sum("n_sids").over(every), 3))


def cluster_size_cutoff(df: DataFrame, below: float) -> DataFrame:
    """Largest cluster size whose cumulative share of persons stays below the threshold."""
    sizes = records_per_person(df).groupBy("n_records").agg(F.count("*").alias("n"))
    # one row per distinct cluster size
    upto = Window.partitionBy(F.lit(1)).orderBy("n_records")
    every = Window.partitionBy(F.lit(1))
    shares = sizes.withColumn("upto", F.sum("n").over(upto) / F.sum("n").over(every))
    return shares.where(F.col("upto") < below).agg(F.max("n_records").alias("max_cluster_size"))


def entity_class() -> Column:
    """singleton / exact / different / mixed, from the statistic columns."""
    return (F.when(F.col("n_records") == 1, "singleton")
            .when(F.col("n_uq_namedob") == 1, "exact")
            .when(F.col("n_uq_namedob") == F.col("n_records"), "different")
            .otherwise("mixed"))


def with_entity_class(df: DataFrame) -> DataFrame:
    return df.withColumn("entity_class", entity_class())


def collapse_mixed(df: DataFrame) -> DataFrame:
    """Mixed clusters reduced to the lowest record of each spelling, statistics computed anew."""
    place = Window.partitionBy("sid", "first_name", "last_name", "date_of_birth").orderBy("rowid")
    return (df.where(entity_class() == "mixed")
            .withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
            .transform(stat_columns))
