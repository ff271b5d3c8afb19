"""Supervised and active-learning linkers on comparison vectors (MLlib logistic regression)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions.numbers import f1, ratio
from kithlink.functions.seeded import hash_mod, order_hash
from kithlink.operators.blocking import learn_blocks
from kithlink.operators.compare import compare_pairs, truth_labels
from kithlink.operators.scale import staged

LOG_COLUMNS = ["label_ix", "label", "rowid_1", "rowid_2", "exact_match",
               "just_queried_for_uncertain_pairs", "match_phat", "block_yhat"]


def _features() -> list[Column]:
    """Comparison vector scaled to 0..1, a missing value half way."""
    def level(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.5))

    def near(c: str, unit: float) -> Column:
        return F.coalesce(1 / (1 + F.col(c) / unit), F.lit(0.5))

    return [level("first_name_sim"), level("last_name_sim"), near("dob_days", 30.0), level("dob_sim"),
            level("mi_equal"), level("race_equal"), level("sex_equal"), near("age_diff", 1.0)]


def with_features(pairs: DataFrame) -> DataFrame:
    """Comparison columns, truth, the feature vector and its plain mean."""
    parts = _features()
    return (pairs.transform(compare_pairs).transform(truth_labels)
            .withColumn("features", array_to_vector(F.array(*parts)))
            .withColumn("mean_similarity", sum(parts[1:], parts[0]) / len(parts))
            .withColumn("target", (F.col("label") == "y").cast("double")))


def fit_pairs(labelled: DataFrame) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol="features", labelCol="target", regParam=0.001, maxIter=50).fit(labelled)


def score_pairs(pairs: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """`confidence_score`: match probability of each pair."""
    return (model.transform(pairs)
            .withColumn("confidence_score", vector_to_array("probability")[1])
            .drop("rawPrediction", "probability", "prediction"))


def active_label(pool: DataFrame, budget: int, batch: int) -> DataFrame:
    """Label log: the truth of the pairs the current model is least sure of, up to the budget.

    `pool` is the bounded candidate sample.  Each round labels one batch; until both labels have
    been seen the plain mean of the comparison vector stands in for the model.  The log has at
    most `budget` rows, so excluding labelled pairs is a small broadcast anti join.
    """
    rows = staged(pool.transform(with_features).select(
        "rowid1", "rowid2", "label", "exact_match", "features", "mean_similarity", "target",
        (F.coalesce(F.col("last_name1") == F.col("last_name2"), F.lit(False))
         | F.coalesce(F.col("date_of_birth1") == F.col("date_of_birth2"), F.lit(False))).alias("block_yhat")),
        "label_pool")
    log, done, asked = None, 0, 0
    while done < budget:
        open_rows = rows if log is None else rows.join(
            F.broadcast(log.select(F.col("rowid_1").alias("rowid1"), F.col("rowid_2").alias("rowid2"))),
            ["rowid1", "rowid2"], "left_anti")
        model = None
        if log is not None and log.select("label").distinct().count() == 2:
            model = fit_pairs(rows.join(F.broadcast(
                log.select(F.col("rowid_1").alias("rowid1"), F.col("rowid_2").alias("rowid2"))),
                ["rowid1", "rowid2"], "left_semi"))
        scored = (score_pairs(open_rows, model) if model else
                  open_rows.withColumn("confidence_score", F.col("mean_similarity")))
        take = min(batch, budget - done)
        # the first batch has no model to doubt: it starts from the most similar pairs
        doubt = F.abs(F.col("confidence_score") - 0.5) if log is not None else -F.col("confidence_score")
        picked = scored.withColumn("_doubt", doubt).orderBy("_doubt", "rowid1", "rowid2").limit(take)
        # at most one batch of rows
        turn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_doubt", "rowid1", "rowid2"))
        new = picked.select(
            (turn + done).alias("label_ix"), "label", F.col("rowid1").alias("rowid_1"),
            F.col("rowid2").alias("rowid_2"), "exact_match",
            (turn == 1).alias("just_queried_for_uncertain_pairs"),
            F.col("confidence_score").alias("match_phat"), "block_yhat")
        new = staged(new if log is None else log.unionByName(new), "label_log")
        asked = new.count()
        if asked == done:
            break
        log, done = new, asked
    return log if log is not None else new


def label_balance(log: DataFrame) -> DataFrame:
    ones, zeros = F.count_if(F.col("label") == "y"), F.count_if(F.col("label") == "n")
    return log.agg(ones.alias("labeled_1s"), zeros.alias("labeled_0s"),
                   ratio(ones, ones + zeros).alias("labeled_base_rate"))


def labelled_pairs(pool: DataFrame, log: DataFrame) -> DataFrame:
    """Pool pairs named in the label log."""
    keys = log.select(F.col("rowid_1").alias("rowid1"), F.col("rowid_2").alias("rowid2"))
    return pool.join(F.broadcast(keys), ["rowid1", "rowid2"], "left_semi").transform(with_features)


@dataclass(frozen=True)
class TrainedLinker:
    model: LogisticRegressionModel
    predicates: list[str]


def train_pairs(labelled: DataFrame, left: DataFrame, right: DataFrame, recall: float = 0.99) -> TrainedLinker:
    """Pair classifier, and the blocking predicates that cover `recall` of the labelled matches."""
    rules = learn_blocks(left, right, labelled.where("label = 'y'").select("rowid1", "rowid2"), recall)
    # one row per chosen predicate
    return TrainedLinker(fit_pairs(labelled), [r["predicate"] for r in rules.orderBy("place").collect()])


SCORE_BINS = 1000


@dataclass(frozen=True)
class SupervisedRules:
    """Share of labelled pairs to train on; the rest tunes the threshold."""

    pct_train: float = 0.9
    seed: int = 3


def train_share(labelled: DataFrame, rules: SupervisedRules) -> DataFrame:
    """`in_training` by a seeded digest of the pair."""
    digest = order_hash(rules.seed, "train", F.col("rowid1"), F.col("rowid2"))
    return labelled.withColumn("in_training", hash_mod(digest, 1000) < int(rules.pct_train * 1000))


def tune_threshold(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 at every score bin; the best bin is flagged (lowest on ties).

    `cut` lies half way to the next lower score seen: nothing held out says that scores in
    between are non-matches.
    """
    bins = (scored.groupBy(F.floor(F.col("confidence_score") * SCORE_BINS).cast("int").alias("bin"))
            .agg(F.sum("target").alias("hits"), F.count("*").alias("n")))
    # at most SCORE_BINS + 1 rows
    every = Window.partitionBy(F.lit(1))
    above = every.orderBy(F.col("bin").desc())
    curve = (bins.withColumns({"_hits": F.sum("hits").over(above), "_n": F.sum("n").over(above),
                               "_all": F.sum("hits").over(every)})
             .select((F.col("bin") / SCORE_BINS).alias("threshold"),
                     ratio(F.col("_hits"), F.col("_n")).alias("precision"),
                     ratio(F.col("_hits"), F.col("_all")).alias("recall"))
             .withColumn("f1", f1(F.col("precision"), F.col("recall"))))
    best = F.row_number().over(every.orderBy(F.col("f1").desc_nulls_last(), "threshold"))
    lower = F.coalesce(F.lag("threshold").over(every.orderBy("threshold")), F.lit(0.0))
    return curve.withColumns({"is_best": best == 1, "cut": (F.col("threshold") + lower) / 2})


def supervised_link(pairs: DataFrame, labelled: DataFrame,
                    rules: SupervisedRules = SupervisedRules()) -> tuple[DataFrame, float]:
    """Scores of `pairs` and the threshold tuned on the held-out labelled pairs."""
    split = staged(train_share(labelled, rules), "supervised")
    model = fit_pairs(split.where("in_training"))
    curve = tune_threshold(score_pairs(split.where("NOT in_training"), model))
    best = curve.where("is_best").first()
    return score_pairs(pairs, model), (best["cut"] if best else 0.5)
