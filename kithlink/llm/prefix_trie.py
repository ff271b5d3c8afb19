"""The prefix trie of all conversations, by van Emde Boas recursion over its depth.

Downwards, a block of 2**k levels is cut at half its depth: the prefixes that end at the cut are
named, which splits the block into an upper trie and a lower forest, and all blocks of a height are
cut at the same time.  A prefix's name is a digest of the name at the block's top and of the turns
between, whose digests are put together pairwise beforehand, so a level of the recursion costs a
join of what lies at its cuts, and a trie of depth d takes log2 d levels.

Upwards, totals of the lower forests are grafted on the upper tries: those of a root of the forest
are added to its ancestors inside the block, which its smallest member's path tells.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.llm.turns import placed_turns
from kithlink.operators.scale import discard, lookup, staged

# Ids of conversations that end at a node are joined in runs of 2**RUN_BITS consecutive ids, so a run is a small text.
RUN_BITS = 12
# Above one of this many parts of all nodes, the children of a node are spread over tasks: the list of such nodes is as short.
HOT_PARTS = 1000
NOTHING = sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, heads: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv_id, size) and (conv_id, depth, symbol, bytes), depths from 1.

    Conversation c takes the first h turns of conversation c - c % family (all if fewer, none if absent) and then
    its own turns after its first h, with h = crc32(c in decimal) % heads.  % keeps the sign of a negative id.
    """
    said = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    size = F.octet_length("text").cast("long")
    said = said.withColumn("bytes", size).withColumn(
        "symbol", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows, spans = placed_turns(said, "conv_id", ["turn", "role", "text"], ["symbol", "bytes"])
    spans = staged(spans, "spans")
    lengths = spans.groupBy("conv_id").agg(F.sum("_n").alias("own"))
    facts = (lengths.withColumn("source", F.col("conv_id") - F.col("conv_id") % family)
             .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
             .join(lengths.select(F.col("conv_id").alias("source"), F.col("own").alias("_there")), "source", "left")
             .withColumn("_borrowed", F.least("h", F.coalesce("_there", F.lit(0)))))
    facts = staged(facts.select("conv_id", "source", "h", F.col("_borrowed").alias("borrowed"),
                                (F.col("_borrowed") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    # a source has less than twice `family` followers
    followers = facts.groupBy(F.col("source").alias("conv_id")).agg(F.collect_list(F.struct("conv_id", "h")).alias("followers"))
    spans = spans.join(facts.select("conv_id", "h", "borrowed"), "conv_id").join(followers, "conv_id", "left")
    at = (rows.join(spans, ["conv_id", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")))
    own = F.when(F.col("pos") > F.col("h"), F.array(F.struct("conv_id", (F.col("borrowed") + F.col("pos") - F.col("h")).alias("depth"))))
    lent = F.transform(F.filter("followers", lambda f: f["h"] >= F.col("pos")),
                       lambda f: F.struct(f["conv_id"].alias("conv_id"), F.col("pos").alias("depth")))
    nobody = F.array().cast("array<struct<conv_id:bigint,depth:bigint>>")
    steps = (at.withColumn("_to", F.explode(F.concat(F.coalesce(own, nobody), F.coalesce(lent, nobody))))
             .select("_to.conv_id", "_to.depth", "symbol", "bytes"))
    return facts.select("conv_id", "size"), staged(steps, "steps")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def prefix_names(conversations: DataFrame, steps: DataFrame, levels: int) -> DataFrame:
    """conv_id, depth, name of every prefix of every conversation; equal prefixes have equal names, the root ''."""
    # digests of the blocks of 2**k turns, block j from depth j * 2**k + 1 on
    blocks = [steps.select("conv_id", (F.col("depth") - 1).alias("block"), F.col("symbol").alias("digest"))]
    for k in range(1, levels):
        second = F.col("block") % 2 == 1
        pairs = (blocks[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block"))
                 .agg(F.max(F.when(~second, F.col("digest"))).alias("_one"), F.max(F.when(second, F.col("digest"))).alias("_two"))
                 .where(F.col("_one").isNotNull() & F.col("_two").isNotNull()))
        blocks.append(staged(pairs.select("conv_id", "block", F.md5(F.concat("_one", "_two").cast("binary")).alias("digest")), "blocks"))
    named = [staged(conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("name")), "names")]
    for k in reversed(range(levels)):
        # the blocks of 2**(k + 1) levels have their top at an even block of 2**k turns and their cut at its end
        half = blocks[k].where(F.col("block") % 2 == 0).select("conv_id", (F.col("block") * (1 << k)).alias("depth"), "digest")
        cut = (half.join(_union(named), ["conv_id", "depth"])
               .select("conv_id", (F.col("depth") + (1 << k)).alias("depth"), F.md5(F.concat("name", "digest").cast("binary")).alias("name")))
        named.append(staged(cut, "names"))
    for used in blocks[1:]:
        discard(used)
    return _union(named)


def graft(nodes: DataFrame, names: DataFrame, levels: int, totals: list[str]) -> DataFrame:
    """`totals` of each node (conv_id, depth, name, ..) become sums over its subtree."""
    rest = nodes.drop(*totals)
    now = staged(nodes.select("conv_id", "depth", "name", *totals), "totals")
    for k in range(levels):
        # blocks of 2**(k + 1) levels: the lower half is summed up already, its roots stand at the cut
        cut, half = F.col("depth") % (2 << k) == (1 << k), 1 << k
        above = (now.where(cut).withColumn("depth", F.explode(F.sequence(F.col("depth") - half, F.col("depth") - 1))).drop("name")
                 .join(names, ["conv_id", "depth"])
                 .groupBy("depth", "name").agg(*[F.sum(t).alias(f"_{t}") for t in totals]))
        before = now
        now = staged(now.join(above, ["depth", "name"], "left").select(
            "conv_id", "depth", "name", *[(F.col(t) + F.coalesce(f"_{t}", F.lit(0))).alias(t) for t in totals]), "totals")
        discard(before)
    return rest.join(now.drop("conv_id"), ["depth", "name"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs of ids, comma-joined, for rows sorted by node and run."""
    key, running = None, None

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[0][1] for r in rows], pa.string()),
                                           pa.array([r[1] for r in rows], pa.string())], ["depth", "name", "ends_sha256"])
    for batch in batches:
        done = []
        for depth, name, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "ids"))):
            if (depth, name) == key:
                running.update(b"," + ids.encode())
            else:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = (depth, name), sha256(ids.encode())
        yield out(done)
    if key is not None:
        yield out([(key, running.hexdigest())])


def ends(conversations: DataFrame, names: DataFrame) -> DataFrame:
    """Per node at which conversations end: SHA-256 of their ids, ascending, decimal and comma-joined.

    A digest reads its ids in order, so those of one node pass through one task, which keeps only the digest's
    state: ids come as runs that were joined before, in other tasks.
    """
    last = conversations.withColumnRenamed("size", "depth").join(names, ["conv_id", "depth"])
    runs = (last.groupBy("depth", "name", F.shiftright("conv_id", RUN_BITS).alias("run"))
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")))
    return (runs.repartition("depth", "name").sortWithinPartitions("depth", "name", "run").select("depth", "name", "ids")
            .mapInArrow(_digests, "depth long, name string, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns go by number, those without one first; equal numbers by role, then text; repeated rows are kept.  Null
    roles and texts are empty, texts of any length count whole.  Rows without a conv_id belong to no conversation and
    are left out.  Other columns are not looked at.  An empty table has no root and gives no rows.
    """
    conversations, steps = rebuilt(turns)
    levels = (steps.agg(F.max("depth")).first()[0] or 0).bit_length()
    names = prefix_names(conversations, steps, levels)
    nodes = names.groupBy("depth", "name").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    up = names.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = staged(nodes.join(steps.select("conv_id", "depth", "bytes"), ["conv_id", "depth"], "left")
                   .join(up, ["conv_id", "depth"], "left"), "nodes")
    children = (nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name"))
                .agg(F.count("*").alias("n_children")))
    tree = (nodes.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
            .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
            .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))))
    tree = staged(tree.select("conv_id", "depth", "name", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens"), "tree")
    parents = tree.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"),
                          F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_rows"))
    full = graft(tree, names, levels, ["n_leaves", "saved_tokens"]).join(ends(conversations, names), ["depth", "name"], "left")
    hot = max(1000, tree.count() // HOT_PARTS)
    return lookup(full, parents, ["depth", "parent"], F.col("conv_id"), rows_col="_rows", hot_rows=hot).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
