import pytest
from pyspark.sql import functions as F

from kithlink.operators import profile, sampling
from kithlink.plans.workspace import STUDY, Workspace


def test_shortage_is_filled_from_smaller_sizes_keeping_records():
    # 3 persons of size 3 are missing: 9 records, so 5 persons of size 2
    assert sampling.take_counts({2: 20, 3: 2}, {2: 4, 3: 5}) == {2: 9, 3: 2}
    # size 2 has only 2 left: the rest would come from size 1, where there is nobody
    assert sampling.take_counts({2: 6, 3: 2}, {2: 4, 3: 5}) == {2: 6, 3: 2}
    assert sampling.take_counts({2: 20}, {2: 4, 3: 5}) == {2: 4}


def test_quota_rules():
    assert sampling.class_quota("exact", 2, 5, .5) == 2 and sampling.class_quota("different", 2, 5, .5) == 2
    assert sampling.class_quota("singleton", 2, 5, .5) == 0
    with pytest.raises(ValueError):
        sampling.class_quota("mixed", 2, 5, .5)
    for bad in ({1: .5}, {1: .7, 2: .7}):
        with pytest.raises(ValueError):
            sampling.person_quotas(bad, 100, None, STUDY)


def clusters(spark, sizes):
    rows = [(k * 100 + i, f"SID{k}") for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "rowid long, sid string")


@pytest.mark.parametrize("sizes", [[1, 2, 2, 3, 9, 9, 9, 40], [9, 9], [2, 3]])
def test_truncation_loses_no_person_and_respects_the_limit(spark, sizes):
    df = clusters(spark, sizes)
    cut = sampling.truncate_clusters(df, 3, 2, 3)
    left = {r.sid: r["count"] for r in cut.groupBy("sid").count().collect()}
    assert len(left) == len(sizes) and max(left.values()) <= 3
    assert all(left[f"SID{k}"] == n for k, n in enumerate(sizes) if n <= 3)


def test_split_halves_every_stratum_and_keeps_persons_apart(spark, folder):
    w = Workspace(spark, folder)
    split = sampling.train_eval_split(w.pool(), STUDY)
    assert split.count() == split.select("sid").distinct().count() == w.pool().select("sid").distinct().count()
    sides = split.groupBy("entity_class", "n_records").pivot("side", list(sampling.SIDES)).count().fillna(0)
    assert sides.where(F.abs(F.col("training") - F.col("evaluation")) > 1).count() == 0


def test_same_seed_same_rows_for_any_partitioning(spark, folder):
    pool = Workspace(spark, folder).pool()
    one, two = (sorted(r.rowid for r in sampling.build_datasets(df, STUDY).select("rowid").collect())
                for df in (pool.repartition(1), pool.repartition(9)))
    assert one == two


def test_sides_and_roles_are_disjoint(spark, folder):
    sets = Workspace(spark, folder).datasets()
    for spec in [r.spec for r in sets.select("spec").distinct().collect()]:
        rows = sets.where(F.col("spec") == spec)
        for side in sampling.SIDES:
            admin, moved = (rows.where(F.col("dataset") == f"{kind}_{side}").select("rowid") for kind in ("admin", "experiment"))
            assert admin.intersect(moved).count() == 0
        train, evaluation = (rows.where(F.col("dataset") == f"admin_{s}").select("sid") for s in sampling.SIDES)
        assert train.intersect(evaluation).count() == 0


def test_spellings_with_a_missing_part_are_not_counted(spark):
    rows = [(1, "A", "B", None, "s"), (2, "A", "B", "1990-01-01", "s"), (3, "A", "B", "1990-01-01", "s")]
    df = spark.createDataFrame(rows, "rowid long, first_name string, last_name string, date_of_birth string, sid string")
    got = {r.rowid: r for r in profile.stat_columns(df).collect()}
    assert got[1].name_dob is None and got[1].n_records_per_sid_name_dob is None and got[1].n_records == 3
    assert got[2].n_records_per_sid_name_dob == 2 and got[2].n_uq_namedob == 1
