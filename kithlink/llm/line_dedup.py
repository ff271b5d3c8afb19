"""Deletion of repeated passages by pairwise alignment of lines.

Line hashes bring documents together: of each line that is long enough, and of each shortest run of lines
that is, the earliest document that has it is a partner of all others.  The line sequences of a document
and of each of its partners are aligned by patience diff, and the blocks they have in common go from the
later document.  A shared run that stands in another order than an alignment can follow is looked up among
the partner's runs and goes as well (`dedup_passages`).

`dedup_lines` takes fewer partners, the earliest holders of rare single lines, and goes by alignments alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.llm.common import RunHash, mix, unused
from kithlink.operators.scale import lookup, staged

# Documents that may share a line that counts as rare.
RARE = 100
# Characters, blanks at the ends of lines aside, that a common block must have to be deleted.
BLOCK_CHARS = 40
# Documents whose lines a task holds as arrays at a time.
ROWS = 500
_RUNS = RunHash(1, 31)
# A line that stands in an earlier document more often does not anchor an alignment with it.
OFTEN = 8
# Documents that are held against one reading of a partner's lines.
PARTNER_ROWS = 2_000


def line_keys(text: Column) -> Column:
    """A hash of each line without outer blanks; null for a line of blanks."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a common subsequence of `a` and `b`, by patience diff.

    Equal elements at both ends are matched, then those that stand once in either, as far as a longest
    increasing run of them goes, and the stretches between likewise.  None matches nothing.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo1, hi1, lo2, hi2 = todo.pop()
        while lo1 < hi1 and lo2 < hi2 and a[lo1] == b[lo2] and a[lo1] is not None:
            out.append((lo1, lo2))
            lo1, lo2 = lo1 + 1, lo2 + 1
        while lo1 < hi1 and lo2 < hi2 and a[hi1 - 1] == b[hi2 - 1] and a[hi1 - 1] is not None:
            hi1, hi2 = hi1 - 1, hi2 - 1
            out.append((hi1, hi2))
        if lo1 >= hi1 or lo2 >= hi2:
            continue
        n1, n2 = Counter(a[lo1:hi1]), Counter(b[lo2:hi2])
        at2 = {b[j]: j for j in range(lo2, hi2)}
        once = [(i, at2[a[i]]) for i in range(lo1, hi1) if a[i] is not None and n1[a[i]] == 1 and n2.get(a[i]) == 1]
        if not once:
            continue
        # piles of the patience game; each card knows the one below it on the pile before
        tops: list[int] = []
        last: list[int] = []
        under: list[int] = []
        for k, (_, j) in enumerate(once):
            pile = bisect_left(tops, j)
            under.append(last[pile - 1] if pile else -1)
            if pile == len(tops):
                tops.append(j)
                last.append(k)
            else:
                tops[pile], last[pile] = j, k
        chain, k = [], last[-1]
        while k >= 0:
            chain.append(once[k])
            k = under[k]
        edges = [(lo1 - 1, lo2 - 1), *reversed(chain), (hi1, hi2)]
        out.extend(chain)
        todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]))
    return sorted(out)


def repeated_lines(later: list, earlier: list, sizes: list[int], least: int) -> list[int]:
    """The lines of `later` in aligned blocks of `least` characters or more; lines of blanks do not part a block."""
    matched = patience([x for x in later if x is not None], [x for x in earlier if x is not None])
    place = [i for i, x in enumerate(later) if x is not None]
    out: list[int] = []
    block: list[int] = []
    before = None
    for i, j in [*matched, (-1, -1)]:
        if block and before != (i - 1, j - 1):
            if sum(sizes[k] for k in block) >= least:
                out.extend(block)
            block = []
        if i >= 0:
            block.append(place[i])
        before = (i, j)
    return out


def removals(docs: DataFrame, rare: int = RARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_partners, lines (places of the lines to delete, ascending) of each document with a partner.

    A document's partners are the earliest documents that hold its rare lines, judged on the input.
    Repeated rows of one id are one document.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lined = staged(known.select("doc_id", line_keys(F.col("text")).alias("keys"), F.transform(
        F.split("text", "\n"), lambda x: F.length(F.trim(x))).alias("sizes")), "lines")
    held = lined.select("doc_id", F.explode(F.array_distinct(F.filter("keys", lambda x: x.isNotNull()))).alias("key")).distinct()
    shared = held.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    hits = held.join(shared, "key").where("doc_id != first")
    rarest = hits.groupBy("doc_id").agg(F.min(F.struct("n", "key")).alias("least"))
    pairs = (hits.join(rarest, "doc_id").where((F.col("n") <= rare) | (F.col("key") == F.col("least.key")))
             .select("doc_id", "first").distinct())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later, earlier, sizes = (batch.column(c).to_pylist() for c in ("keys", "other", "sizes"))
            lines = [repeated_lines(x, y, s, block_chars) for x, y, s in zip(later, earlier, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.list_(pa.int32()))], ["doc_id", "lines"])

    one = lined.groupBy("doc_id").agg(F.min(F.struct("keys", "sizes")).alias("d")).select("doc_id", "d.keys", "d.sizes")
    aligned = (pairs.join(one, "doc_id")
               .join(one.select(F.col("doc_id").alias("first"), F.col("keys").alias("other")), "first")
               .select("doc_id", "keys", "sizes", "other").mapInArrow(align, "doc_id long, lines array<int>"))
    # at most one set of lines per rare line of a document
    return aligned.groupBy("doc_id").agg(
        F.count("*").alias("n_partners"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def runs_of(keys: np.ndarray, sizes: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Shortest runs of `least` characters from each line on and up to each line: hash, first line, line after the last.

    `ends` has the bounds of each document's lines, 0 first; no line is blank and no run leaves its document.
    """
    n = len(keys)
    place = np.arange(n)
    of = np.searchsorted(ends, place, side="right") - 1
    chars = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    to = np.searchsorted(chars, chars[:-1] + least)
    since = np.searchsorted(chars, chars[1:] - least, side="right") - 1
    on, upto = to <= ends[1:][of], since >= ends[:-1][of]
    both = np.unique(np.concatenate([np.stack([place[on], to[on]], 1), np.stack([since[upto], place[upto] + 1], 1)]), axis=0)
    _RUNS._powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys.view(np.uint64)) * _RUNS.up[:n])])
    return _RUNS.runs(sums, both[:, 0], both[:, 1]).view(np.int64), both[:, 0], both[:, 1]


class _Earlier:
    """The lines of an earlier document, where each stands, and its runs."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, least: int):
        self.keys = keys.tolist()
        self.index: dict[int, list[int]] = {}
        for j, x in enumerate(self.keys):
            self.index.setdefault(x, []).append(j)
        self.runs = set(runs_of(keys, sizes, np.array([0, len(keys)]), least)[0].tolist())

    def aligned(self, keys: list[int], sizes: list[int], least: int) -> set[int]:
        """The lines of a later document in blocks that patience diff aligns.

        Lines that stand here more than OFTEN times anchor nothing and stay out of the comparison, so a pair costs what the
        later document has, however long the earlier one is.
        """
        js = sorted({j for x in set(keys) if len(at := self.index.get(x, ())) <= OFTEN for j in at})
        out: set[int] = set()
        block: list[int] = []
        before = None
        for i, j in [*((i, js[j]) for i, j in patience(keys, [self.keys[j] for j in js])), (-1, -1)]:
            if block and before != (i - 1, j - 1):
                if sum(sizes[k] for k in block) >= least:
                    out.update(block)
                block = []
            if i >= 0:
                block.append(i)
            before = (i, j)
        return out


def _alignments(rows: DataFrame, least: int) -> DataFrame:
    """partner, doc_id, version, lines, n_aligned per pair; `rows` has each partner's lines (later = false) before the documents held against it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = None, []
        for batch in batches:
            met, ids, versions, lines, counts = [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("partner", "salt", "later", "doc_id", "version")]
            for partner, salt, later, doc, version, keys, sizes in zip(*columns, batch.column("keys"), batch.column("sizes")):
                keys, sizes = (x.values.to_numpy(zero_copy_only=False) for x in (keys, sizes))
                full = np.flatnonzero(sizes > 0)
                if (partner, salt) != here:
                    here, known = (partner, salt), []
                if not later:
                    known.append(_Earlier(keys[full], sizes[full], least))
                    continue
                own, chars = keys[full].tolist(), sizes[full].tolist()
                found: set[int] = set()
                for earlier in known:
                    found |= earlier.aligned(own, chars, least)
                aligned = len(found)
                # what stands in another order than an alignment can follow, or among lines too frequent to anchor it
                key, first, after = runs_of(keys[full], sizes[full], np.array([0, len(full)]), least)
                for k, a, b in zip(key.tolist(), first.tolist(), after.tolist()):
                    if any(k in earlier.runs for earlier in known):
                        found.update(range(a, b))
                met.append(partner)
                ids.append(doc)
                versions.append(version)
                lines.append(full[sorted(found)].tolist())
                counts.append(aligned)
            yield pa.RecordBatch.from_arrays(
                [pa.array(met, pa.int64()), pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(lines, pa.list_(pa.int32())),
                 pa.array(counts, pa.int64())], ["partner", "doc_id", "version", "lines", "n_aligned"])

    return (rows.repartition("partner", "salt").sortWithinPartitions("partner", "salt", "later")
            .mapInArrow(run, "partner long, doc_id long, version long, lines array<int>, n_aligned long"))


def passages(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, version (hash of the text), n_partners, lines (places of the lines to delete), n_aligned (lines aligned, over the partners).

    Partners are the earliest holders of a document's line hashes: of each line of `block_chars` characters, and of each
    shortest run of lines that has as many.  A hash that very many documents have is one sum that combines before
    the shuffle, and one row per holder after it.  Each document is aligned with each partner; a partner of many is
    read once for some thousands of them.
    """
    lined = staged(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", F.xxhash64("text").alias("version"), F.transform(line_keys(F.col("text")), lambda x: F.coalesce(x, F.lit(0))).alias("keys"),
        F.transform(F.split("text", "\n"), lambda x: F.length(F.trim(x))).alias("sizes")), "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                lists = batch.column("keys")
                bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
                full = sizes > 0
                ends = np.concatenate([[0], np.cumsum(full)])[bounds]
                key, first, _ = runs_of(lists.flatten().to_numpy(zero_copy_only=False)[full], sizes[full], ends, block_chars)
                doc = pa.array(np.searchsorted(ends, first, side="right") - 1)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("doc_id").take(doc), batch.column("version").take(doc)],
                                                 ["key", "doc_id", "version"])

    held = lined.select("doc_id", "version", "keys", "sizes").mapInArrow(run, "key long, doc_id long, version long")
    shared = (held.groupBy("key").agg(F.min("doc_id").alias("partner"), F.max("doc_id").alias("last"), F.count("*").alias("_rows"))
              .where("partner != last").select("key", "partner", "_rows"))
    pairs = staged(lookup(held, shared, ["key"], F.col("doc_id"), how="inner", rows_col="_rows", hot_rows=PARTNER_ROWS)
                   .where("doc_id != partner").select("doc_id", "version", "partner").distinct(), "pairs")
    # partners of many documents, with the parts their documents are dealt to
    counted = pairs.groupBy("partner").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / PARTNER_ROWS).cast("int")
    hot = F.broadcast(counted.where(F.col("n") > PARTNER_ROWS).select("partner", parts.alias("_parts")))
    later = (pairs.join(hot, "partner", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "version"), F.coalesce("_parts", F.lit(1))).cast("int"))
             .join(lined, ["doc_id", "version"]).select("partner", "salt", F.lit(True).alias("later"), "doc_id", "version", "keys", "sizes"))
    earlier = (lined.join(counted.select(F.col("partner").alias("doc_id"), parts.alias("_parts")), "doc_id")
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
               .select(F.col("doc_id").alias("partner"), "salt", F.lit(False).alias("later"), "doc_id", "version", "keys", "sizes"))
    # a document has two runs per line at most, so as many partners
    return _alignments(earlier.unionByName(later), block_chars).groupBy("doc_id", "version").agg(
        F.size(F.collect_set("partner")).cast("long").alias("n_partners"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"), F.sum("n_aligned").alias("n_aligned"))


def dedup_passages(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` with `text` less the deleted lines, and n_lines, n_removed, n_partners; the first document
    that holds a passage keeps it.

    A line goes if it stands in a run of `block_chars` characters or more, lines of blanks left out, that
    also is a run of lines of any document with a smaller id, however many have it and in whatever order
    they have their passages.  Rows that repeat an id are not earlier than one another; each loses the
    lines of its own text.  Null texts stay null and have no lines, an empty text is one empty line, texts of any
    length count whole.  Rows with a null id are left as they are.  Columns called like the new ones are replaced, and an
    empty table gives no rows.
    """
    keep = docs.drop("n_lines", "n_removed", "n_partners")
    own, version, which = (unused(docs, c) for c in ("cut_id", "cut_version", "cut_lines"))
    blank = lambda i: F.trim(F.get(F.split("text", "\n"), i)) == ""
    gone = passages(docs, block_chars).select(F.col("doc_id").alias(own), F.col("version").alias(version), F.col("n_partners"), F.col("lines").alias(which))
    found = keep.join(gone, (keep["doc_id"].cast("long") == F.col(own))
                      & (F.xxhash64(keep["text"].cast("string")) == F.col(version)), "left")
    return _cut(found.withColumn(which, F.filter(which, lambda i: ~blank(i))), which).drop(own, version, which)


def dedup_lines(docs: DataFrame, rare: int = RARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` with `text` less the deleted lines, and n_lines, n_removed, n_partners.

    The first document that holds a passage keeps it.  Null texts stay null and have no lines; an
    empty text is one empty line, which is shared with nothing.  Rows with a null id are left as they
    are, so are texts without deletions.  Rows that repeat an id lose the same lines; of several texts
    under one id one speaks for all.  Columns called like the new ones are replaced.  An empty table
    gives no rows.
    """
    keep = docs.drop("n_lines", "n_removed", "n_partners")
    own, which = unused(docs, "cut_id"), unused(docs, "cut_lines")
    gone = removals(docs, rare, block_chars).select(F.col("doc_id").alias(own), "n_partners", F.col("lines").alias(which))
    return _cut(keep.join(gone, keep["doc_id"].cast("long") == F.col(own), "left"), which).drop(own, which)


def _cut(found: DataFrame, which: str) -> DataFrame:
    """The texts less the lines in `which`, and the counts."""
    lines = F.split("text", "\n")
    cut = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(which, i)), "\n")
    return (found
            .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
            .withColumn("n_removed", F.coalesce(F.size(which), F.lit(0)).cast("long"))
            .withColumn("n_partners", F.coalesce("n_partners", F.lit(0)))
            .withColumn("text", F.when(F.size(which) > 0, cut).otherwise(F.col("text"))))
