import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions.seeded import order_hash
from kithlink.operators import scale


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_dense_number_is_the_global_order(spark, parts):
    ids = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(parts)
    got = rows(scale.dense_number(df, ["k"], "n").select("n", "k"))
    assert got == list(enumerate(sorted(ids), 1))


@pytest.mark.parametrize("parts", [1, 5])
def test_seeded_rank_equals_a_plain_window(spark, parts):
    df = spark.range(400).withColumn("s", F.when(F.col("id") < 130, "hot").otherwise((F.col("id") % 3).cast("string")))
    df = df.withColumn("s", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("s"))).repartition(parts)
    got = scale.seeded_rank(df, ["s"], "id", 3, "x", "rank", "size").select("id", "rank", "size")
    w = Window.partitionBy("s")
    want = df.withColumn("h", order_hash(3, "x", F.col("id"))).select(
        "id", F.row_number().over(w.orderBy("h", "id")), F.count("*").over(w))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("hot_rows", [1, 10, 1000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_a_join_for_any_hot_bar(spark, hot_rows, how):
    left = spark.range(100).withColumn("k", F.when(F.col("id") < 40, 0).when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 7))
    facts = left.where("k IS NOT NULL AND k <> 5").groupBy("k").agg(F.count("*").alias("n"))
    want = rows(left.join(facts, "k", how).select("id", "n").fillna(-1))
    assert rows(scale.lookup(left, facts, ["k"], F.col("id"), how, "n", hot_rows).select("id", "n").fillna(-1)) == want
    assert rows(scale.lookup(left, facts, ["k"], F.col("id"), how, None, hot_rows).select("id", "n").fillna(-1)) == want


@pytest.mark.parametrize("tile_rows", [2, 7, 1000])
def test_pairs_appear_once_however_groups_are_cut(spark, tile_rows):
    data = [(i, None if i % 11 == 0 else ("hot" if i < 30 else str(i % 4))) for i in range(60)]
    df = spark.createDataFrame(data, "id long, k string")
    got = [(r["id1"], r["id2"]) for r in scale.pairs_within(df, ["k"], "id", ["k"], tile_rows).collect()]
    want = [(a, b) for (a, x), (b, y) in itertools.combinations(data, 2) if x is not None and x == y]
    assert sorted(got) == sorted(want)
    left = df.where("id % 2 = 0").select(F.col("id").alias("id1"), "k")
    right = df.where("id % 2 = 1").select(F.col("id").alias("id2"), "k")
    got = rows(scale.pairs_between(left, right, ["k"], "id1", tile_rows).select("id1", "id2"))
    assert got == rows(left.join(right, "k").select("id1", "id2"))


def test_scratch_folder_is_the_one_the_session_names(spark):
    before = scale.scratch_folder(spark)
    assert scale.scratch_folder(spark) == before == spark.conf.get("spark.checkpoint.dir")


def test_broadcast_only_below_the_bar(spark):
    small, large = (scale.broadcast_up_to(spark.range(n), 10) for n in (10, 11))
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


def test_candidate_pairs_are_not_written(spark, folder):
    from kithlink.plans.workspace import Workspace
    w = Workspace(spark, folder)
    for pairs in (w.candidates(), w.candidates_one_table()):
        # they are read from the profiles they are made of
        assert all("/profiles-" in f for f in pairs.inputFiles())
