"""Case records derived from the `orders` table: one order is a case, a customer stands for several persons.

The text runs unchanged on Spark SQL and DuckDB, so both sides of every check
start from the same rows.  `{orders}` is the table to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.operators.cluster import ADMIN_ROLE, EXPERIMENT_ROLE
from kithlink.operators.scale import lookup

# Every order is a case.  A customer's orders, in their order, belong to one person after another, of 1, 2,
# 1, 2, 1, 3, 2, 1, 4, 1, 8, 1 records, over and over; customers start at different places of this round of 27.
RAW_CASES_SQL = """
WITH o AS (
  SELECT o_orderkey, o_custkey AS c, CAST(o_orderdate AS DATE) AS od,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + o_custkey % 27 AS nth
  FROM {orders}),
p AS (
  SELECT o.*, CAST(floor(nth / 27) AS BIGINT) AS round_, nth % 27 AS place FROM o),
g AS (
  SELECT p.*, CASE WHEN place < 1 THEN 0 WHEN place < 3 THEN 1 WHEN place < 4 THEN 2 WHEN place < 6 THEN 3 WHEN place < 7 THEN 4
                   WHEN place < 10 THEN 5 WHEN place < 12 THEN 6 WHEN place < 13 THEN 7 WHEN place < 17 THEN 8
                   WHEN place < 18 THEN 9 WHEN place < 26 THEN 10 ELSE 11 END AS grp
  FROM p),
s AS (
  SELECT o_orderkey, od, k, r, CASE WHEN k % 13 = 12 THEN k - 1 ELSE k END AS pk,
         CASE WHEN k % 10 IN (0,1,2,3) THEN 'EM' WHEN k % 10 IN (4,5,6,7) THEN 'NEM' ELSE 'MIX' END AS kind
  FROM (SELECT o_orderkey, od, c + 1000003 * (12 * round_ + grp) AS k,
               1 + place - CASE grp WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 6 WHEN 5 THEN 7 WHEN 6 THEN 10
                                    WHEN 7 THEN 12 WHEN 8 THEN 13 WHEN 9 THEN 17 WHEN 10 THEN 18 ELSE 26 END AS r
        FROM g) x),
v AS (
  SELECT s.*, CASE WHEN kind = 'EM' THEN 1 WHEN kind = 'MIX' AND r > 2 THEN 2 ELSE r END AS e,
    substr('SMITJOHNWILLBROWJONEGARCMILLDAVIRODRMARTHERNLOPEGONZWILSANDETHOM', CAST(1 + 4 * (pk % 16) AS INT), 4)
      || substr('SONTONMANLEYFORDENBERINGUEZRISOWSKIVICLUND', CAST(1 + 3 * (CAST(floor(pk / 16) AS BIGINT) % 14) AS INT), 3) AS ln,
    substr('JAMESMARIAROBERLINDADAVIDSUSANJASONKAREN', CAST(1 + 5 * (CAST(floor(pk / 5) AS BIGINT) % 8) AS INT), 5) AS fn,
    substr('ABCDEFGHJKLM', CAST(1 + (pk % 12) AS INT), 1) AS mi
  FROM s),
w AS (
  SELECT v.*, DATE '1950-01-01' + CAST((pk * 7919) % 18000 + CASE WHEN e IN (3, 5, 7) THEN e ELSE 0 END AS INT) AS d FROM v)
SELECT CAST(1000000 + o_orderkey AS STRING) AS casnbr,
  lpad(CAST(month(od) AS STRING), 2, '0') || '/' || lpad(CAST(day(od) AS STRING), 2, '0') || '/' || CAST(year(od) AS STRING) AS casfildat,
  CASE WHEN k % 97 = 96 THEN 'M' ELSE CAST(k + 101 AS STRING) END AS sid,
  CASE WHEN k % 101 = 100 THEN '' WHEN k % 103 = 102 THEN ln ELSE
    CASE WHEN e IN (2, 5, 8) THEN substr(ln, 1, 2) || 'X' || substr(ln, 4) ELSE ln END || ' ' ||
    CASE WHEN e IN (4, 6, 7, 8) THEN substr(fn, 1, CAST(8 - floor(e / 2) - CASE WHEN e = 6 THEN 0 ELSE 1 END AS INT)) || 'Y' ELSE fn END
    || CASE WHEN k % 5 = 0 THEN '' ELSE ' ' || mi || CASE WHEN k % 11 = 0 THEN ' JR' ELSE '' END END END AS name,
  lpad(CAST(month(d) AS STRING), 2, '0') || '/' || lpad(CAST(day(d) AS STRING), 2, '0') || '/' || CAST(year(d) AS STRING) AS dob,
  CASE WHEN k % 53 = 0 THEN 'U' WHEN k % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  CASE WHEN k % 29 = 0 THEN 'NULL' ELSE substr('WBHA', CAST(1 + (k % 4) AS INT), 1) END AS race
FROM w
"""

# One row per charge of a case, in order of arrival: later charges of a case
# repeat it with another spelling, some dates are no dates and some ids are short.
RAW_CHARGES_SQL = """
SELECT c.casnbr, CASE WHEN l.l_linenumber = 7 THEN '02/30/1999' ELSE c.casfildat END AS casfildat,
  CASE WHEN l.l_partkey % 41 = 0 THEN CAST(l.l_partkey % 101 AS STRING) ELSE c.sid END AS sid,
  CASE WHEN l.l_suppkey % 7 = 0 THEN c.name || ' Q' ELSE c.name END AS name,
  CASE WHEN l.l_linenumber = 6 THEN '13/01/1980' ELSE c.dob END AS dob, c.sex, c.race,
  l.l_orderkey * 10 + l.l_linenumber AS ingest_order
FROM {cases} c JOIN {lineitem} l ON l.l_orderkey = CAST(c.casnbr AS BIGINT) - 1000000
"""


def raw_cases(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Text rows (casnbr, casfildat, sid, name, dob, sex, race) with planted variation."""
    return spark.sql(RAW_CASES_SQL, orders=orders)


def raw_charges(spark: SparkSession, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Case rows repeated once per charge, with `ingest_order` as the order of arrival."""
    return spark.sql(RAW_CHARGES_SQL, cases=raw_cases(spark, orders), lineitem=lineitem)


def roles(profiled: DataFrame) -> DataFrame:
    """Evaluation roles: the first record of each person with several, and every third single
    record, is the experiment side; all other records are the admin side."""
    lowest = profiled.groupBy("sid").agg(F.min("rowid").alias("_lowest"), F.count("*").alias("_n"))
    chosen = F.when(F.col("_n") > 1, F.col("rowid") == F.col("_lowest")).otherwise(F.col("rowid") % 3 == 0)
    return (lookup(profiled, lowest, ["sid"], F.col("rowid"), rows_col="_n")
            .withColumn("dataset", F.when(chosen, EXPERIMENT_ROLE).otherwise(ADMIN_ROLE))
            .drop("_lowest", "_n"))
