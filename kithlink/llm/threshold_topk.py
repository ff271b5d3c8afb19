"""Exact top-k by inner product with the threshold algorithm, block against block.

Rows stand in blocks of a few thousand.  A block keeps, for each dimension, its rows in the order of
their component: the end with the largest products comes first for a query's sign.  The lists are read
side by side by a group of queries, rows met for the first time are scored in full for all of them in one
product, and a query stops when the threshold, the score of a row that stood at the present depth of every
list, cannot beat its k-th best so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.llm.common import partitions
from kithlink.llm.vectors import usable
from kithlink.operators.scale import staged

ROWS, QUERIES = 4096, 1024
# Queries that read the lists of a block together.
TOGETHER = 256
FIRST_DEPTH = 64


class SortedLists:
    """The rows of a block with their lists: for each dimension the rows from its largest component down, and the values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], vectors[by_id]
        self.order = np.argsort(-self.rows, axis=0, kind="stable")
        values = np.take_along_axis(self.rows, self.order, 0)
        # down the list for positive, up the list for negative query components
        self.values = np.stack([values, values[::-1]])
        most = float(np.abs(self.rows).max()) if self.rows.size else 0.0
        self.small = most * most * self.rows.shape[1] < 2 ** 52
        self.exact = self.rows.astype(np.float64) if self.small else self.rows.astype(np.int64)

    def top(self, query: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of one query, best first, ties to the smaller id."""
        _, ids, scores = self.tops(query[None, :], k, np.array([without]))
        return ids, scores

    def tops(self, queries: np.ndarray, k: int, without: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and score of the k best rows of each query; best first, ties to the smaller id.

        The queries read the lists together: a row that stands high enough for one of them is scored for all that have
        not stopped.  A query stops when the rows below the present depth cannot reach its k-th best score.
        """
        n, out = len(self.ids), []
        at = np.searchsorted(self.ids, without)
        own = np.where((at < n) & (self.ids[np.minimum(at, n - 1)] == without), at, -1) if n else np.full(len(without), -1)
        q = queries.astype(self.exact.dtype)
        open_ = np.arange(len(queries))
        found, scores = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0), self.exact.dtype)
        unread = np.ones(n, bool)
        depth, before = min(n, max(FIRST_DEPTH, k)), 0
        while len(open_):
            up, down = (q[open_] > 0).any(0), (q[open_] < 0).any(0)
            near = np.zeros(n, bool)
            near[self.order[before:depth, up]] = True
            near[self.order[n - depth:n - before, down]] = True
            # the lists of components that are 0 in all queries are not read, their rows are scored at last
            near |= depth >= n
            new = np.flatnonzero(near & unread)
            unread[new] = False
            met = np.broadcast_to(new, (len(open_), len(new)))
            some = q[open_] @ (self.exact if 2 * len(new) > n else self.exact[new]).T
            some = some[:, new] if 2 * len(new) > n else some
            found, scores = self._best(np.concatenate([found, met], 1), np.concatenate([scores, np.where(met == own[open_, None], self._nothing, some)], 1), k)
            reached = scores > self._nothing
            if depth >= n or not unread.any():
                done = np.ones(len(open_), bool)
            else:
                side = (q[open_] < 0).astype(np.int64)
                bound = (self.values[side, depth, np.arange(q.shape[1])].astype(q.dtype) * q[open_]).sum(1)
                done = (reached.sum(1) >= k) & (bound < scores.min(1, initial=np.iinfo(np.int64).max))
            for i in np.flatnonzero(done):
                out.append((open_[i], found[i][reached[i]], scores[i][reached[i]]))
            open_, found, scores = open_[~done], found[~done], scores[~done]
            before, depth = depth, min(n, 2 * depth)
        of = np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out])
        rows, best = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in (1, 2))
        return of, self.ids[rows.astype(np.int64)], best.astype(np.int64)

    @property
    def _nothing(self) -> float | int:
        """A score below all others."""
        return -np.inf if self.small else -np.iinfo(np.int64).max

    def _best(self, found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each line, best first, ties to the smaller place."""
        if scores.shape[1] > 8 * k:
            # all that reach the k-th best score: few, but where many are equal
            least = np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k]
            line, at = np.nonzero(scores >= least[:, None])
            place = np.arange(len(line)) - np.searchsorted(line, line)
            shape = (len(scores), int(place.max(initial=-1)) + 1)
            some, of = np.zeros(shape, np.int64), np.full(shape, self._nothing, scores.dtype)
            some[line, place], of[line, place] = found[line, at], scores[line, at]
            found, scores = some, of
        order = np.lexsort((found, -scores))[:, :k]
        return np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)


def top_k(table: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id",
          vector: str = "embedding", rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for each query row.

    Components x are floor(scale * x).  `is_query` is a condition on vec_id; a query is no candidate of its
    own.  Ties go to the smaller vec_id; all candidates are returned if there are fewer than k.  Rows whose
    id or vector is null or whose vector holds null or non-finite components, and vectors of another length
    than most, take no part.  Of rows that repeat an id one counts.  Other columns are not looked at.  An
    empty table gives no rows.
    """
    known = usable(table, vec_id, vector, zero=True).select(
        "vec_id", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("z"))
    total = known.count()
    blocks = max(1, -(-total // rows))
    wanted = known.where(is_query)
    groups = max(1, -(-wanted.count() // queries))
    listed = F.collect_list(F.struct("vec_id", "z"))
    # blocks of about `rows` and `queries` vectors by a hash of the id
    row_blocks = known.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(listed.alias("rows"))
    query_blocks = (wanted.groupBy(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).alias("group")).agg(listed.alias("queries"))
                    .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))))

    def block_of(lists: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
        flat = lists.slice(i, 1).flatten()
        ids = flat.field("vec_id").to_numpy()
        return ids, flat.field("z").flatten().to_numpy().reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, lists = None, None
        for batch in batches:
            of = batch.column("block").to_pylist()
            for i in range(batch.num_rows):
                if of[i] != made:
                    made, lists = of[i], SortedLists(*block_of(batch.column("rows"), i))
                ids, z = block_of(batch.column("queries"), i)
                for first in range(0, len(ids), TOGETHER):
                    some = slice(first, first + TOGETHER)
                    query, best, scores = lists.tops(z[some], k, ids[some])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][query]), pa.array(best), pa.array(scores)], ["query_id", "vec_id", "score"])

    # few rows of much work each: spread over tasks by (block, group)
    spread = min(blocks * groups, 4 * max(partitions(table.sparkSession), table.sparkSession.sparkContext.defaultParallelism))
    best = staged(query_blocks.join(row_blocks.hint("shuffle_hash"), "block")
                  .repartition(spread, "block", "group").sortWithinPartitions("block")
                  .mapInArrow(run, "query_id long, vec_id long, score long"), "block-tops")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
