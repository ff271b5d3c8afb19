import pytest

from kithlink.operators import report, results
from kithlink.plans import study
from kithlink.sources.readers import spec_from_path


def runs(spark, values):
    return spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "grp string, model_iter int, error_any double")


@pytest.mark.parametrize("values,median,best,worst", [
    ([.3, .1, .2], 2, 1, 0), ([.2, .2, .2], 0, 0, 0), ([.1, .4, None], 0, 0, 1), ([.1, .2, .3, .9], 1, 0, 3)])
def test_run_flags(spark, values, median, best, worst):
    df = report.best_worst_run(report.median_run(runs(spark, values), ["grp"], "error_any"), ["grp"], "error_any")
    flags = {f: [r.model_iter for r in df.collect() if r[f]] for f in ("is_median", "is_best", "is_worst")}
    assert flags == {"is_median": [median], "is_best": [best], "is_worst": [worst]}


def test_more_rows_than_runs_is_an_error(spark):
    df = runs(spark, [.1, .2])
    report.check_runs_per_group(df, ["grp"])
    with pytest.raises(ValueError):
        report.check_runs_per_group(df.union(df), ["grp"])


def test_difference_is_positive_when_the_answer_is_yes(spark):
    df = spark.createDataFrame([("unsupervised", .1, .3), ("supervised", .3, .1), ("supervised", .1, .3)],
                               "comparison_alg string, error_any__optimized double, error_any__comparison double")
    got = [r.performance_difference for r in report.performance_difference(df, "error_any").collect()]
    assert got == pytest.approx([.2, .2, -.2])
    renamed = df.toDF("comparison_alg", "tpr_any__optimized", "tpr_any__comparison")
    got = [r.performance_difference for r in report.performance_difference(renamed, "tpr_any").collect()]
    assert got == pytest.approx([-.2, -.2, .2])


def test_metric_names():
    assert report.metric_names(["error", "prc"], "corr") == ["error_pair", "prc_corr"]
    assert report.metric_names(["error"], "any") == ["error_any"]


def test_grid_sizes(spark):
    grid = study.run_grid(spark, study.GridRules())
    counts = {r.arm: r["count"] for r in grid.groupBy("arm").count().collect()}
    assert counts == {"active": 1080, "supervised": 30, "unsupervised": 60}
    linkage = grid.where("arm = 'active' AND framework = 'record_linkage'")
    assert {r.sample_size for r in linkage.select("sample_size").distinct().collect()} == {15000, 150000}


def test_specification_from_a_path(spark):
    path = "s3://x/result__sst_5000__emt_50__budget_20__sample_size_1500__type_record_linkage__iter_3.csv"
    df = spark.createDataFrame([(path,), ("x/other.csv",)], "p string").select(*[c.alias(n) for n, c in spec_from_path(
        __import__("pyspark.sql.functions", fromlist=["col"]).col("p")).items()])
    assert tuple(df.collect()[0]) == (5000, 50, 20, 1500, "record_linkage", 3)
    assert set(df.collect()[1]) == {None}


def test_collecting_arms_keeps_all_columns_and_turns_nan_to_null(spark):
    one = spark.createDataFrame([("deduplication", 1.0, 5)], "framework string, tpr_any double, labeled_1s int")
    two = spark.createDataFrame([("", float("nan"))], "framework string, tpr_any double")
    got = {r.algorithm: r for r in results.collect_results({"active": one, "supervised": two}).collect()}
    assert set(got) == {"active (deduplication)", "supervised"}
    assert got["supervised"].tpr_any is None and got["supervised"].labeled_1s is None


def test_f1_and_runtime_with_nothing_to_divide(spark):
    df = spark.createDataFrame([(0.0, 0.0, None, 2.0)], "prc_any double, tpr_any double, runtime_min__a double, runtime_min__b double")
    row = results.total_runtime(results.f1_scores(df, ("any",))).first()
    assert row.f1_any is None and row.runtime_min == 2.0


def test_unknown_benchmark_lines(spark):
    df = spark.createDataFrame([("supervised", 1, 0, .5, True)], "algorithm string, ss_train int, model_iter int, error_any double, is_median boolean")
    with pytest.raises(ValueError):
        report.benchmark_lines(df, "error_any", "best", "deduplication")
