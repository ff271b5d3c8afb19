"""Scans with declared columns; nothing is inferred from values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from kithlink.operators.clean import RAW_COLUMNS

# A text no file holds: every field of an all-text scan stays a text, empty ones included.
NO_NULLS = "\x00"
PERSON_SCHEMA = StructType([
    StructField("rowid", LongType()), StructField("first_name", StringType()),
    StructField("last_name", StringType()), StructField("date_of_birth", DateType()),
    StructField("age_in_2020", IntegerType()), StructField("middle_name", StringType()),
    StructField("middle_initial", StringType()), StructField("lineage", StringType()),
    StructField("race", StringType()), StructField("sex", StringType()),
    StructField("sid", StringType()), StructField("uid_sid", StringType())])
DATASET_SCHEMA = StructType([*PERSON_SCHEMA.fields, StructField("dataset", StringType()),
                             StructField("spec", StringType())])


def scan_raw_cases(spark: SparkSession, path: str, more: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header, all text, 'NA' missing; only the columns the cleaning needs are parsed."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="NA", emptyValue="").select(*RAW_COLUMNS, *more)


def scan_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled datasets; a filter on `dataset` or `spec` reads only those folders."""
    return spark.read.schema(DATASET_SCHEMA).parquet(folder)


def scan_keyed_text(spark: SparkSession, path: str, key: str, arrival: str) -> DataFrame:
    """CSV as all-text rows under an integer key; the row that arrived last wins."""
    text = spark.read.csv(path, header=True, inferSchema=False, nullValue=NO_NULLS, emptyValue="")
    rows = text.withColumn(key, F.col(key).cast("bigint"))
    rest = [F.col(c).desc() for c in rows.columns if c not in (key, arrival)]
    place = Window.partitionBy(key).orderBy(F.col(arrival).cast("bigint").desc(), *rest)
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def spec_from_path(path: F.Column) -> dict[str, F.Column]:
    """Specification columns out of a file or folder name such as
    `result__sst_5000__emt_50__budget_20__sample_size_1500__type_linkage__iter_3`."""
    def part(tag: str) -> F.Column:
        return F.nullif(F.regexp_extract(path, f"__{tag}_([^/]*?)(?:__|/|[.]|$)", 1), F.lit(""))
    return {"ss_train": part("sst").cast("bigint"), "em_train": part("emt").cast("int"),
            "budget": part("budget").cast("int"), "sample_size": part("sample_size").cast("int"),
            "framework": part("type"), "model_iter": part("iter").cast("int")}


def scan_results(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """Many result files; each row gets the specification its path spells out."""
    rows = spark.read.schema(schema).csv(pattern, header=True).withColumn("_path", F.col("_metadata.file_path"))
    return rows.withColumns(spec_from_path(F.col("_path"))).drop("_path")
