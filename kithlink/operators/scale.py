"""Building blocks that keep the other operators even under skew and safe under task loss.

staged         write a result to the shared scratch folder and read it back
dense_number   1..N over a global sort order without a single-task window
seeded_rank    rank in seeded order per stratum without a single-task window
broadcast_up_to  broadcast hint behind a row count
lookup         left join to a one-row-per-key table, hot keys salted
pairs_within   pairs inside key groups, hot groups cut into tiles
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions.seeded import order_hash

# A key counts as hot above this many rows; the table of hot keys then has at most
# rows / HOT_ROWS entries, which is the size bound of the broadcasts below.
HOT_ROWS = 1_000_000
# Three hex digits of a digest split every stratum into 4096 even, ordered buckets.
BUCKET_DIGITS = 3
# Records of one side of a tile: a task compares at most TILE_ROWS^2 pairs at a time.
TILE_ROWS = 4_000
# Pairs a task should make before another partition is worth its overhead.
PAIRS_PER_TASK = 1_000_000


# The temporary folder of each local application that names no shared one.
_LOCAL_FOLDERS: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode.

    The setting belongs to the session and is only read.  Whether its folder is one that all machines
    share is for the cluster to say; a path without a scheme can be a mounted share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL_FOLDERS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="kithlink-"))


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `staged` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    root = scratch_folder(spark)
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        # only what stands in the scratch folder
        if folder.getParent().toUri().getPath() == spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: one pass writes the table, later plans start from the files."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Column 1..N in the order of `order`, which has to be unique.

    Rows are range-partitioned and sorted, written once with their place inside the
    partition, and shifted by the number of rows in the partitions before theirs.
    The write fixes the range borders, which are sampled anew on each evaluation.
    """
    placed = staged(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition of the write
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (placed.withColumn("_part", part)
            .join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + F.col("_at") - F.shiftleft(F.col("_part"), 33) + 1)
            .drop("_part", "_at", "_start"))


def seeded_rank(df: DataFrame, strata: list[str], id_col: str, seed: int, stage: str,
                name: str = "rank", size_name: str | None = None) -> DataFrame:
    """Rank 1.. of each row in seeded order inside its stratum, optionally with the stratum size.

    Equal to row_number() over (partition by strata order by digest, id), but the digest
    prefix splits each stratum into even ordered buckets, so no stratum is one task's work.
    The strata are few (classes x sizes x specifications); their bucket table is broadcast.
    """
    hashed = df.withColumn("_h", order_hash(seed, stage, F.col(id_col))) \
               .withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    counts = hashed.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    stratum = Window.partitionBy(*strata)
    before = stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_b").alias("_sb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(stratum).alias("_stratum_size"))
    same = F.col("_b") == F.col("_sb")
    for i, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    place = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", id_col))
    ranked = (hashed.withColumn("_place", place)
              .join(F.broadcast(starts), same)
              .withColumn(name, F.col("_start") + F.col("_place")))
    if size_name:
        ranked = ranked.withColumn(size_name, F.col("_stratum_size"))
    return ranked.drop("_h", "_b", "_sb", "_start", "_stratum_size", "_place",
                       *[f"_s{i}" for i in range(len(strata))])


def broadcast_up_to(df: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """Broadcast hint only after counting the rows; a larger table is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _hot_keys(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys with more than `rows` rows and the number of parts to cut them into."""
    return (df.groupBy(*keys).agg(F.count("*").alias("_n"))
            .where(F.col("_n") > rows)
            .select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_parts")))


def lookup(df: DataFrame, facts: DataFrame, keys: list[str], spread: Column, how: str = "left",
           rows_col: str | None = None, hot_rows: int | None = None, rows: int | None = None) -> DataFrame:
    """Join to `facts`, which has one row per key, with hot keys of `df` salted by `spread`.

    `spread` must vary inside a key (a row id).  Only the facts of hot keys are copied.
    `rows_col` names a column of `facts` that already holds the rows of `df` per key and
    saves the counting pass.  `rows` is a number of rows that `df` is known not to exceed: where that is
    no more than a key may have, no key is hot and a plain join does.
    """
    hot_rows = hot_rows or HOT_ROWS
    if rows is not None and rows <= hot_rows:
        return df.join(facts, keys, how)
    if rows_col:
        hot = (facts.where(F.col(rows_col) > hot_rows)
               .select(*keys, F.ceil(F.col(rows_col) / hot_rows).cast("int").alias("_parts")))
    else:
        hot = _hot_keys(df, keys, hot_rows)
    hot = F.broadcast(hot)
    left = (df.join(hot, keys, "left")
            .withColumn("_salt", F.when(F.col("_parts").isNull(), 0)
                        .otherwise(F.pmod(F.xxhash64(spread), F.col("_parts"))).cast("int"))
            .drop("_parts"))
    right = (facts.join(hot, keys, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
             .drop("_parts"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def pairs_within(df: DataFrame, keys: list[str], id_col: str, carry: list[str],
                 tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs of rows that share `keys`, lower id first, as (keys, id1, id2, carry1.., carry2..).

    A group above `tile_rows` rows is cut into slices; each pair of slices is a join key of
    its own, so a hot group becomes many even tasks.  Every pair appears exactly once.
    """
    known = df.select(*keys, id_col, *[c for c in carry if c not in keys and c != id_col])
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    hot = F.broadcast(_hot_keys(known, keys, tile_rows))
    sliced = (known.join(hot, keys, "left")
              .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
              .withColumn("_slice", F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int"))
              .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
              .withColumn("_lo", F.least("_slice", "_other"))
              .withColumn("_hi", F.greatest("_slice", "_other"))
              .drop("_other", "_parts"))
    tile = [*keys, "_lo", "_hi"]
    sliced = _by_work(sliced, tile, known.groupBy(*keys).agg((F.count("*") * F.count("*")).alias("_w")))

    def side(n: int) -> DataFrame:
        return sliced.select(*tile, F.col("_slice").alias(f"_slice{n}"),
                             F.col(id_col).alias(f"{id_col}1" if n == 1 else f"{id_col}2"),
                             *[F.col(c).alias(f"{c}{n}") for c in carry])

    return (side(1).join(side(2), tile)
            .where(F.col(f"{id_col}1") < F.col(f"{id_col}2"))
            # inside a mixed tile only pairs across the two slices belong to it
            .where((F.col("_lo") == F.col("_hi")) | (F.col("_slice1") != F.col("_slice2")))
            .drop("_lo", "_hi", "_slice1", "_slice2"))


def _by_work(df: DataFrame, keys: list[str], work: DataFrame) -> DataFrame:
    """Partition the input of a pair join by the pairs it makes, not by its bytes.

    `work` has the pairs per group as `_w`.  Few rows can make many pairs, and adaptive
    execution would otherwise put a small input into one task.
    """
    pairs = work.agg(F.sum("_w")).first()[0] or 0
    if pairs < PAIRS_PER_TASK // 10:
        return df
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(int(max(least, -(-pairs // PAIRS_PER_TASK))), *keys)


def pairs_between(left: DataFrame, right: DataFrame, keys: list[str],
                  left_id: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs of a left and a right row that share `keys`; a hot left group is cut into slices."""
    work = (left.groupBy(*keys).agg(F.count("*").alias("_l"))
            .join(right.groupBy(*keys).agg(F.count("*").alias("_r")), keys)
            .select((F.col("_l") * F.col("_r")).alias("_w")))
    hot = F.broadcast(_hot_keys(left, keys, tile_rows))
    cut = (left.join(hot, keys, "left")
           .withColumn("_slice", F.pmod(F.xxhash64(left_id), F.coalesce("_parts", F.lit(1))).cast("int"))
           .drop("_parts"))
    copies = (right.join(hot, keys, "left")
              .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
              .drop("_parts"))
    slices = [*keys, "_slice"]
    cut = _by_work(cut, slices, work)
    return cut.join(copies, slices).drop("_slice")
