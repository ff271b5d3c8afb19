import hashlib
import random

import pandas as pd
import pytest

from kithlink.operators import evaluate

METRICS = ["tpr_any", "prc_any", "tnr_any", "acc_any", "tpr_corr", "prc_corr", "tpr_pair", "prc_pair", "tnr_pair"]
E, A = "experiment_evaluation", "admin_evaluation"


def sample(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        role = rng.choice([E, A])
        cluster = rng.choice([rng.randrange(20), -1 if role == E else -2])
        rows.append((1, i, f"p{rng.randrange(30)}", role, cluster))
    return pd.DataFrame(rows, columns=["spec", "rowid", "sid", "dataset", "cluster_id"])


def by_hand(df):
    exp, adm = df[df.dataset == E], df[df.dataset == A]
    expected, made = exp.sid.isin(adm.sid), exp.cluster_id.isin(adm.cluster_id)
    sid = exp.merge(adm, on="sid", suffixes=("_e", "_a"))
    clu = exp.merge(adm, on="cluster_id", suffixes=("_e", "_a"))
    sid_ok, clu_ok = sid.cluster_id_e == sid.cluster_id_a, clu.sid_e == clu.sid_a
    lonely = adm[~adm.sid.isin(exp.sid)]
    return {
        "tpr_any": made[expected].mean(), "prc_any": expected[made].mean(), "tnr_any": (~made[~expected]).mean(),
        "acc_any": (expected == made).mean(), "tpr_corr": sid_ok.groupby(sid.sid).all().mean(),
        "prc_corr": clu_ok.groupby(clu.sid_e).all().mean(), "tpr_pair": sid_ok.mean(), "prc_pair": clu_ok.mean(),
        "tnr_pair": (~lonely.cluster_id.isin(exp.cluster_id)).mean()}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_metrics_equal_the_listed_pairs(spark, monkeypatch, seed, hot_rows):
    monkeypatch.setattr("kithlink.operators.scale.HOT_ROWS", hot_rows)
    pdf = sample(seed)
    got = evaluate.metrics(spark.createDataFrame(pdf), ["spec"]).first()
    want = by_hand(pdf)
    assert {m: got[m] for m in METRICS} == pytest.approx(want)


def test_metrics_do_not_depend_on_cluster_names(spark):
    pdf = sample(4)
    other = pdf.assign(cluster_id=[c if c < 0 else (c * 7 + 3) % 1009 for c in pdf.cluster_id])
    one, two = (evaluate.eval_summary(spark.createDataFrame(p), ["spec"]).first() for p in (pdf, other))
    assert one == two


def test_the_truth_as_prediction_is_perfect(spark):
    pdf = sample(5)
    pdf["cluster_id"] = [int(s[1:]) for s in pdf.sid]
    row = evaluate.eval_summary(spark.createDataFrame(pdf), ["spec"]).first()
    assert [row[m] for m in METRICS] == [1.0] * 9 and row["error_any"] == row["error_pair"] == 0.0


def test_no_rows_to_average_gives_null(spark):
    df = spark.createDataFrame([(1, 1, "a", E, -1), (1, 2, "a", A, -2)], "spec int, rowid long, sid string, dataset string, cluster_id long")
    row = evaluate.eval_summary(df, ["spec"]).first()
    assert row["prc_any"] is None and row["tnr_any"] is None and row["tpr_any"] == 0.0


@pytest.mark.parametrize("bucket", [2_000, 3])
def test_bootstrap_equals_explicit_resampling(spark, monkeypatch, bucket):
    monkeypatch.setattr(evaluate, "PATTERNS_PER_BUCKET", bucket)
    frames = []
    for run in (1, 2):
        pdf = sample(7)
        pdf.loc[pdf.index % (run + 2) == 0, "cluster_id"] = [-1 if r == E else -2 for r in pdf[pdf.index % (run + 2) == 0].dataset]
        frames.append(pdf.assign(run=run, data="d"))
    pdf = pd.concat(frames)
    got = {(r.run, r.bs_iter): r for r in evaluate.bootstrap_eval(
        spark.createDataFrame(pdf), ["data", "run"], ["data"], iters=20).collect()}
    for run, df in pdf.groupby("run"):
        exp, adm = df[df.dataset == E].sort_values(["sid", "rowid"]), df[df.dataset == A]
        known, linked = exp.sid.isin(adm.sid).to_numpy(), exp.cluster_id.isin(adm.cluster_id).to_numpy()
        n = len(exp)
        for it in range(20):
            draws = [int(hashlib.md5(f"{333 + it}:{slot}".encode()).hexdigest()[:15], 16) % n for slot in range(n)]
            k, m = known[draws], linked[draws]
            assert got[(run, it)].tpr_any == pytest.approx(m[k].mean())
            assert got[(run, it)].prc_any == pytest.approx(k[m].mean())
            assert got[(run, it)].tnr_any == pytest.approx((~m[~k]).mean())
