"""Which records get compared: keys, windows, name clusters and name similarity.

Blocks are membership rows (block, side, rowid) and so grow with the records, not with the
pairs.  Records that agree on everything that is compared are collapsed into one profile
before any pair is made.
"""

from __future__ import annotations

from functools import reduce

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.functions.seeded import order_hash
from kithlink.operators.scale import dense_number, lookup, pairs_between, pairs_within, staged

# What a comparison looks at; records equal on all of it are copies of each other.
COMPARED = ["first_name", "last_name", "date_of_birth", "age_in_2020", "middle_initial", "race", "sex"]
# Keys a pair has to share one of to become a candidate.
CANDIDATE_KEYS = [["last_name", "yob"], ["first_name", "middle_initial", "yob"], ["date_of_birth"]]
SMALL_BLOCK = "small"


def star_edges(records: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Edges between records that agree on one of the key lists, without repeats.

    Each key group becomes a star around its lowest rowid: it joins the same records as all
    pairs of the group would, with one edge per record instead of one per pair.
    """
    return distinct_pairs(reduce(DataFrame.unionByName, [_star(records, k) for k in keys]))


def _star(records: DataFrame, key: list[str]) -> DataFrame:
    known = records.select("rowid", *key)
    for k in key:
        known = known.where(F.col(k).isNotNull())
    centre = (known.groupBy(*key).agg(F.min("rowid").alias("rowid1"), F.count("*").alias("n"))
              .where("n > 1"))
    return (lookup(known.withColumnRenamed("rowid", "rowid2"), centre, key, F.col("rowid2"),
                   how="inner", rows_col="n")
            .where(F.col("rowid1") < F.col("rowid2")).select("rowid1", "rowid2"))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs found through several blocks count once."""
    return pairs.distinct()


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Self pairs and mirrored pairs go."""
    return pairs.where(F.col("rowid1") < F.col("rowid2"))


def stack_roles(admin: DataFrame, experiment: DataFrame) -> DataFrame:
    """Both roles as one input; an experiment record replaces an admin record of the same id."""
    return (admin.join(experiment.select("rowid"), "rowid", "left_anti")
            .unionByName(experiment))


# -- profiles and candidate pairs -----------------------------------------------------

def profiles(records: DataFrame, also: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """One row per group of copies: its lowest rowid, what is compared, and the number of copies.

    Who the records belong to plays no part in the grouping, it is what a linker has to find out; `sid`
    is the lowest of the group and serves as its label.
    """
    return (records.groupBy(*COMPARED, *also)
            .agg(F.min("sid").alias("sid"), F.min("rowid").alias("rowid"), F.count("*").alias("copies"))
            .withColumn("yob", F.year("date_of_birth")))


def copy_edges(records: DataFrame, linked: DataFrame | None = None, also: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Star edges from the profiles in `linked` (rowid; without it from all) to their copies, to widen
    matches to records."""
    keys = [*COMPARED, *also]
    # a digest with the nulls spelled out makes the grouping a plain equality key
    key = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).cast("binary"))
    keyed = records.select("rowid", key.alias("_copy"))
    lowest = keyed.groupBy("_copy").agg(F.min("rowid").alias("rowid1"), F.count("*").alias("n")).where("n > 1")
    wanted = lowest if linked is None else lowest.join(
        linked.select(F.col("rowid").alias("rowid1")).distinct(), "rowid1", "left_semi")
    return (lookup(keyed.withColumnRenamed("rowid", "rowid2"), wanted, ["_copy"], F.col("rowid2"),
                   how="inner", rows_col="n")
            .where("rowid1 < rowid2").select("rowid1", "rowid2"))


def _shares(keys: list[str]) -> Column:
    """Both rows of a pair know all keys and agree on them."""
    same = [F.coalesce(F.col(f"{k}1") == F.col(f"{k}2"), F.lit(False)) for k in keys]
    return reduce(lambda x, y: x & y, same)


def candidates_between(left: DataFrame, right: DataFrame, keys: list[list[str]],
                       within: list[str] | None = None) -> DataFrame:
    """Pairs of a left and a right profile that share one of the key lists (and all of `within`).

    A pair that shares several keys is made under the first of them only, so no pass over the
    pairs is needed to remove repeats.
    """
    within = within or []
    carried = [c for c in left.columns if c not in within]
    parts = []
    for i, key in enumerate(keys):
        a, b = left, right
        for k in key:
            a, b = a.where(F.col(k).isNotNull()), b.where(F.col(k).isNotNull())
        join = [*within, *[f"_k{j}" for j in range(len(key))]]
        a = a.select(*within, *[F.col(k).alias(f"_k{j}") for j, k in enumerate(key)],
                     *[F.col(c).alias(f"{c}1") for c in carried])
        b = b.select(*within, *[F.col(k).alias(f"_k{j}") for j, k in enumerate(key)],
                     *[F.col(c).alias(f"{c}2") for c in carried])
        pairs = pairs_between(a, b, join, "rowid1").drop(*[f"_k{j}" for j in range(len(key))])
        for earlier in keys[:i]:
            pairs = pairs.where(~_shares(earlier))
        parts.append(pairs)
    return reduce(DataFrame.unionByName, parts)


def candidates_within(rows: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Pairs of profiles of one table, lower rowid first, that share one of the key lists."""
    carried = [c for c in rows.columns if c != "rowid"]
    parts = []
    for i, key in enumerate(keys):
        pairs = pairs_within(rows, key, "rowid", carried).drop(*key)
        for earlier in keys[:i]:
            pairs = pairs.where(~_shares(earlier))
        parts.append(pairs)
    return reduce(DataFrame.unionByName, parts)


def candidate_sample(pairs: DataFrame, size: int, seed: int) -> DataFrame:
    """The first `size` candidate pairs in seeded order: the bounded pool a model trains on."""
    pair = F.concat_ws("-", "rowid1", "rowid2")
    return pairs.orderBy(order_hash(seed, "candidates", pair), pair).limit(size)


def candidate_stats(pairs: DataFrame) -> DataFrame:
    """True matches among the candidates, and those that differ in name or birth date."""
    match = F.col("sid1") == F.col("sid2")
    differs = ((F.col("first_name1") != F.col("first_name2")) | (F.col("last_name1") != F.col("last_name2"))
               | (F.col("date_of_birth1") != F.col("date_of_birth2")))
    return pairs.agg(F.count_if(match).alias("cp_1s"), F.count_if(match & differs).alias("cp_1s__nem"))


# -- year windows and name clusters ---------------------------------------------------

def year_window_members(left: DataFrame, right: DataFrame, reach: int = 1) -> DataFrame:
    """(block, side, rowid, ..): a left record is in the block of its birth year, a right record
    in the blocks up to `reach` years around its own."""
    years = F.sequence(F.col("yob") - reach, F.col("yob") + reach)
    return (left.where(F.col("yob").isNotNull()).withColumns({"side": F.lit("A"), "block": F.col("yob")})
            .unionByName(right.where(F.col("yob").isNotNull()).withColumn("side", F.lit("B"))
                         .withColumn("block", F.explode(years)))
            .withColumn("block", F.col("block").cast("int").cast("string")))


def last_name_clusters(records: DataFrame, k: int = 2, seed: int = 3, features: int = 256) -> DataFrame:
    """(last_name, name_cluster) by k-means over the letter pairs of the distinct last names."""
    names = records.select("last_name").where("last_name IS NOT NULL").distinct()
    letters = names.withColumn("_letters", F.split("last_name", ""))
    grams = NGram(n=2, inputCol="_letters", outputCol="_grams").transform(letters)
    vectors = HashingTF(numFeatures=features, inputCol="_grams", outputCol="features").transform(grams)
    model = KMeans(k=k, seed=seed).fit(vectors.select("features"))
    return model.transform(vectors).select("last_name", F.col("prediction").alias("name_cluster"))


def last_name_ranges(records: DataFrame, k: int = 2, rounds: int = 50) -> DataFrame:
    """(last_name, name_cluster) by k-means over the places of the last names in the alphabet.

    A name weighs as many records as it has.  Centres start evenly over the places and move to the mean of
    their records until no name changes sides, so a cluster is a range of names and the result depends on
    the records alone.  Each round is one aggregate of k rows.  A name halfway between two centres goes to
    the lower; a centre without records stays.
    """
    names = (records.where("last_name IS NOT NULL").groupBy("last_name").agg(F.count("*").alias("_w")))
    placed = staged(dense_number(names, ["last_name"], "_place"), "places")
    last = placed.agg(F.max("_place")).first()[0] or 0
    centres = [(2 * i + 1) * last / (2 * k) for i in range(k)]

    def cluster() -> Column:
        borders = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
        return sum([(F.col("_place") > b).cast("int") for b in borders], F.lit(0))

    for _ in range(rounds):
        means = {r["c"]: r["s"] / r["n"] for r in placed.groupBy(cluster().alias("c")).agg(
            F.sum(F.col("_place") * F.col("_w")).alias("s"), F.sum("_w").alias("n")).collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return placed.select("last_name", cluster().alias("name_cluster"))


def block_members(left: DataFrame, right: DataFrame, clusters: DataFrame, reach: int = 1) -> DataFrame:
    """Members of the blocks name cluster x birth-year window."""
    a, b = (lookup(side, clusters, ["last_name"], F.col("rowid"), how="inner") for side in (left, right))
    return (year_window_members(a, b, reach)
            .withColumn("block", F.concat_ws(".", "name_cluster", "block")).drop("name_cluster"))


def merge_small_blocks(members: DataFrame, limit: int) -> DataFrame:
    """Blocks with at most `limit` records on side A become one block, each record once."""
    sizes = members.groupBy("block").agg(F.count_if(F.col("side") == "A").alias("_a"),
                                         F.count("*").alias("_rows"))
    merged = (lookup(members, sizes, ["block"], F.col("rowid"), rows_col="_rows")
              .withColumn("block", F.when(F.col("_a") <= limit, SMALL_BLOCK).otherwise(F.col("block"))))
    return merged.drop("_a", "_rows").dropDuplicates(["block", "side", "rowid"])


def block_listing(members: DataFrame) -> DataFrame:
    return members.select("block", "dataset", "rowid", "yob")


# -- name similarity ------------------------------------------------------------------

@dataclass(frozen=True)
class CosineRules:
    """Bar on the cosine of full names; very common names need up to `common_penalty` more."""

    bar: float = 0.55
    common_penalty: float = 0.05
    dob_edit_bar: int = 3
    age_bar: int = 3


def name_vectors(records: DataFrame) -> DataFrame:
    """(name, n_name, grams): unit tf-idf vectors of letter pairs, one per distinct full name.

    `grams` is an array of (gram, weight), rarest gram first.
    """
    names = (records.where("first_name IS NOT NULL AND last_name IS NOT NULL")
             .groupBy(F.concat_ws(" ", "first_name", "last_name").alias("name"))
             .agg(F.count("*").alias("n_name")))
    total = names.count()
    padded = F.concat(F.lit("^"), F.col("name"), F.lit("$"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("name") + 1), lambda i: F.substr(padded, i, F.lit(2)))
    terms = (names.select("name", "n_name", F.explode(pieces).alias("gram"))
             .groupBy("name", "n_name", "gram").agg(F.count("*").alias("tf")))
    common = terms.groupBy("gram").agg(F.count("*").alias("df"))
    weighted = (lookup(terms, common, ["gram"], F.col("name"), rows_col="df")
                .withColumn("w", F.col("tf") * (F.log(F.lit(float(total)) / F.col("df")) + 1)))
    listed = weighted.groupBy("name", "n_name").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        F.sort_array(F.collect_list(F.struct("df", "gram", "w"))).alias("terms"))
    return listed.select("name", "n_name", F.transform(
        "terms", lambda t: F.struct(t["gram"].alias("gram"), (t["w"] / F.col("norm")).alias("w"))).alias("grams"))


def cosine_name_pairs(records: DataFrame, rules: CosineRules = CosineRules()) -> DataFrame:
    """(name1, name2, cosine) of distinct names at or above the bar, lower name first.

    Exact prefix filter: a name is filed only under its rarest letter pairs, up to the point
    where the weight of the rest is below the bar.  Two names that share none of those cannot
    reach the bar, so common letter pairs never have to be joined on, and none is dropped.
    A pair that shares several is scored under the rarest only.
    """
    vectors = staged(name_vectors(records), "vectors")
    top = vectors.agg(F.max("n_name")).first()[0] or 1
    # squared weight from each gram to the end of the list
    rest = F.reverse(F.transform(
        F.sequence(F.lit(1), F.size("grams")),
        lambda k: F.aggregate(F.slice(F.reverse("grams"), F.lit(1), k), F.lit(0.0),
                              lambda acc, t: acc + t["w"] * t["w"])))
    filed = (vectors
             .select("name", "n_name", F.map_from_entries("grams").alias("weights"),
                     F.col("grams.gram").alias("terms"), rest.alias("_rest"),
                     F.posexplode("grams.gram").alias("_i", "gram"))
             .where(F.element_at("_rest", F.col("_i") + 1) >= rules.bar ** 2 - 1e-9)
             .drop("_rest", "_i"))
    pairs = pairs_within(staged(filed, "filed"), ["gram"], "name", ["n_name", "weights", "terms"])
    # both lists run from rare to common, so the first shared term is the rarest
    shared = pairs.withColumn("_shared", F.array_intersect("terms1", "terms2")) \
                  .where(F.element_at("_shared", 1) == F.col("gram"))
    dot = F.aggregate("_shared", F.lit(0.0),
                      lambda acc, g: acc + F.col("weights1")[g] * F.col("weights2")[g])
    needed = rules.bar + rules.common_penalty * F.greatest("n_name1", "n_name2") / F.lit(float(top))
    return (shared.withColumn("cosine", F.round(dot, 9))
            .where(F.col("cosine") >= F.round(needed, 9)).select("name1", "name2", "cosine"))


def similar_name_candidates(records: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of distinct (name, birth date, age) whose names are equal or among the name pairs."""
    spelled = staged(records.where("first_name IS NOT NULL AND last_name IS NOT NULL")
                     .groupBy(F.concat_ws(" ", "first_name", "last_name").alias("name"), "date_of_birth", "age_in_2020")
                     .agg(F.min("rowid").alias("rowid")), "spelled")
    same = pairs_within(spelled, ["name"], "rowid", ["name", "date_of_birth", "age_in_2020"]).drop("name")
    first = lookup(names.select("name1", "name2"), names.groupBy("name1").agg(F.count("*").alias("_n")),
                   ["name1"], F.col("name2"), rows_col="_n").drop("_n")
    renamed = [spelled.select(*[F.col(c).alias(f"{c}{n}") for c in spelled.columns]) for n in (1, 2)]
    left = staged(pairs_between(first, renamed[0], ["name1"], "name2"), "first_side")
    other = pairs_between(left, renamed[1], ["name2"], "rowid1")
    return same.unionByName(other.select(*same.columns))


def dob_edit_filter(pairs: DataFrame, bar: int) -> DataFrame:
    """Pairs whose birth dates are at most `bar` edits apart."""
    return pairs.where(_dob_edits(bar) >= 0)


def _dob_edits(bar: int) -> Column:
    return F.levenshtein(F.col("date_of_birth1").cast("string"), F.col("date_of_birth2").cast("string"), bar)


def age_backup_filter(pairs: DataFrame, bar: int, age_bar: int) -> DataFrame:
    """Birth dates as above; where one is missing the ages decide."""
    near = F.abs(F.col("age_in_20201") - F.col("age_in_20202")) <= age_bar
    return pairs.where(F.coalesce(_dob_edits(bar) >= 0, near, F.lit(False)))


# -- learned predicates ---------------------------------------------------------------

def predicate_menu() -> dict[str, Column]:
    """Key expressions a learner may block on."""
    first, last, birth = F.col("first_name"), F.col("last_name"), F.col("date_of_birth").cast("string")
    return {
        "last_name": last, "first_name_dob": F.concat_ws("|", first, birth),
        "last_sound_year": F.concat_ws("|", F.soundex(last), F.substring(birth, 1, 4)),
        "last3_first1": F.concat_ws("|", F.substring(last, 1, 3), F.substring(first, 1, 1)),
        "dob": birth, "full_name": F.concat_ws("|", first, last),
        "first3_year_month": F.concat_ws("|", F.substring(first, 1, 3), F.substring(birth, 1, 7)),
    }


def _products(sides: DataFrame, key: list[str]) -> int:
    """Pairs across the two sides that share the key, from counts."""
    counts = sides.groupBy(*key).agg(F.count_if("is_left").alias("a"), F.count_if(~F.col("is_left")).alias("b"))
    return counts.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n")).first()["n"]


def learn_blocks(left: DataFrame, right: DataFrame, matches: DataFrame, recall: float = 0.99) -> DataFrame:
    """Predicates chosen greedily until they cover `recall` of the labelled matches.

    `matches` is a labelled set, bounded by the labelling budget: its cover pattern (one bit per
    predicate) is counted and only those counts are read.  Pairs a predicate would compare are
    computed from key counts; nothing is paired to find out.  The result carries the share of
    all pairs left by the chosen predicates together (inclusion-exclusion over joint keys).
    """
    spark = left.sparkSession
    menu = predicate_menu()
    sides = left.select("*", F.lit(True).alias("is_left")).unionByName(
        right.select("*", F.lit(False).alias("is_left")))
    keyed = sides.select("is_left", "rowid", *[c.alias(n) for n, c in menu.items()])
    long = keyed.select("is_left", F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in menu]), F.array(*[F.col(n) for n in menu]))).alias("predicate", "key"))
    cost = {r["predicate"]: r["n"] for r in (
        long.where("key IS NOT NULL").groupBy("predicate", "key")
        .agg(F.count_if("is_left").alias("a"), F.count_if(~F.col("is_left")).alias("b"))
        .groupBy("predicate").agg(F.sum(F.col("a") * F.col("b")).alias("n")).collect())}
    keys = keyed.drop("is_left")
    a = keys.select(F.col("rowid").alias("rowid1"), *[F.col(n).alias(f"{n}1") for n in menu])
    b = keys.select(F.col("rowid").alias("rowid2"), *[F.col(n).alias(f"{n}2") for n in menu])
    covers = (matches.select("rowid1", "rowid2").join(a, "rowid1").join(b, "rowid2")
              .select(F.concat(*[F.when(F.col(f"{n}1") == F.col(f"{n}2"), "1").otherwise("0") for n in menu])
                      .alias("mask")).groupBy("mask").agg(F.count("*").alias("n")).collect())
    total = sum(r["n"] for r in covers)
    names, chosen, rows = list(menu), [], []
    open_masks = {r["mask"]: r["n"] for r in covers}

    def gain(name: str) -> int:
        return sum(n for mask, n in open_masks.items() if mask[names.index(name)] == "1")

    covered = 0
    while covered < recall * total:
        best = max((n for n in names if n not in chosen),
                   key=lambda n: (gain(n) / max(cost.get(n, 0), 1), n), default=None)
        if best is None or gain(best) == 0:
            break
        covered += gain(best)
        open_masks = {m: n for m, n in open_masks.items() if m[names.index(best)] == "0"}
        chosen.append(best)
        rows.append((len(chosen), best, cost.get(best, 0), covered, total))
    union = 0
    for bits in range(1, 2 ** len(chosen)):
        joint = [c for i, c in enumerate(chosen) if bits >> i & 1]
        present = reduce(lambda d, c: d.where(F.col(c).isNotNull()), joint, keyed)
        union += (-1) ** (len(joint) + 1) * _products(present, joint)
    all_pairs = max(left.count() * right.count(), 1)
    return spark.createDataFrame(
        rows, "place int, predicate string, comparisons long, covered long, labelled_matches long") \
        .withColumn("realized_blocked_proportion", F.lit(union / all_pairs))
