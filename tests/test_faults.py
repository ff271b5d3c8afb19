"""Small cases that once went wrong."""

import pytest
from pyspark.sql import functions as F

from kithlink.operators import cluster, constraints, report, scale
from kithlink.plans import arms
from kithlink.plans.queries import QUERIES
from kithlink.plans.workspace import Workspace

RECORDS = ("rowid long, sid string, dataset string, date_of_birth date, first_name string, last_name string, "
           "age_in_2020 int, middle_initial string, race string, sex string")


def records(spark, rows):
    return spark.createDataFrame([(i, s, d, None, f, "LEE", 30, "A", "W", "F") for i, s, d, f in rows], RECORDS)


@pytest.mark.parametrize("task_edges", [0, 50_000])
def test_a_repeated_edge_counts_once_with_its_best_score(spark, task_edges):
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 2, 0.4), (2, 1, 0.3), (2, 3, 0.6)], "rowid1 long, rowid2 long, score double")
    got = {r.rowid: r.cluster_id for r in constraints.partition_clusters(edges, 0.5, task_edges).collect()}
    # the mean of {1, 2} to 3 is 0.3
    assert got[1] == got[2] == 1 and got.get(3, 3) == 3


def test_copies_are_matches_in_one_table(spark):
    rows = records(spark, [(1, "a", "admin_evaluation", "ANN"), (2, "a", "admin_evaluation", "ANN"), (3, "b", "admin_evaluation", "BO"),
                           (4, "b", "admin_evaluation", "BEA")])
    matches = spark.createDataFrame([(3, 4)], "rowid1 long, rowid2 long")
    got = {r.rowid: r.cluster_id for r in arms.records_from_matches(rows, matches, one_table=True).collect()}
    assert got[1] == got[2] and got[3] == got[4] != got[1]


def test_equal_records_of_two_persons_are_one_profile(spark):
    from kithlink.operators import blocking
    rows = records(spark, [(1, "a", "admin_evaluation", "ANN"), (2, "b", "admin_evaluation", "ANN")])
    assert [(r.rowid, r.copies) for r in blocking.profiles(rows).collect()] == [(1, 2)]


def test_a_profile_of_two_experiment_records_stays_alone(spark):
    nodes = spark.createDataFrame([(1, constraints.EXPERIMENT, None, 2), (3, "ADMIN_EVALUATION", None, 1)],
                                  "rowid long, dataset string, uid_sid string, copies long")
    edges = spark.createDataFrame([(1, 3, constraints.EXPERIMENT, "ADMIN_EVALUATION", 0.9, 1)],
                                  "rowid1 long, rowid2 long, dataset_1 string, dataset_2 string, phat double, original_order long")
    got = {r.rowid: r.cluster_id for r in constraints.constrained_clusters(edges, nodes).collect()}
    assert got[1] != got[3]
    rows = records(spark, [(1, "a", cluster.EXPERIMENT_ROLE, "ANN"), (2, "a", cluster.EXPERIMENT_ROLE, "ANN"), (3, "a", cluster.ADMIN_ROLE, "ANN")])
    matches = spark.createDataFrame([(1, 3)], "rowid1 long, rowid2 long")
    out = {r.rowid: r.cluster_id for r in
           arms.records_from_matches(rows, matches, never_together=cluster.EXPERIMENT_ROLE).collect()}
    assert out[1] == out[3] != out[2]


def test_a_record_in_two_clusters_is_an_error(spark):
    rows = records(spark, [(1, "a", "admin_evaluation", "ANN")])
    clusters = spark.createDataFrame([(1, 5), (1, 6)], "rowid long, cluster_id long")
    with pytest.raises(Exception, match="two clusters"):
        cluster.assign_clusters(rows, clusters=clusters).collect()


def test_every_order_is_a_case(spark, folder):
    w = Workspace(spark, folder)
    assert w.raw_cases().count() == w.source("orders").count()
    assert w.raw_cases().groupBy("sid").count().where("sid <> 'M'").agg(F.max("count")).first()[0] == 8


def test_the_flagship_has_its_numbers(spark):
    row = QUERIES["exact_key_linkage"](spark, "/root/testdata/sf0.001").first()
    assert all(row[c] is not None for c in ("tpr_any", "prc_any", "error_any", "tpr_pair", "error_pair"))


def test_written_tables_go_when_they_are_discarded(spark):
    df = scale.staged(spark.range(5), "gone")
    assert df.inputFiles()
    scale.discard(df)
    with pytest.raises(Exception):
        df.count()
    # a table that stands elsewhere stays
    scale.discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    assert spark.read.parquet("/root/testdata/sf0.001/region.parquet").count() == 5
    assert report.POINT_GROUP
