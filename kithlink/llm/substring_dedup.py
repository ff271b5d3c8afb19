"""Exact removal of byte strings that also start earlier, by a Burrows-Wheeler transform in buckets.

Every string of `least` bytes chooses one of its k-grams, by hash and then the leftmost, so equal
strings choose equal k-grams.  Neighbouring strings that choose the same place form a context.  Only
contexts whose k-gram occurs again can hold a repeat: equal contexts are settled by the first of them,
different ones go, by k-gram, to buckets of bounded size.  A bucket's transform is expanded breadth
first until common prefixes are `least` long, see `bwt.repeats`; places that are not parted then hold
the same string, and all but the first of them are removed.  A k-gram of too many contexts for a
bucket is settled string by string instead, with sums that combine before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.llm.bwt import repeats
from kithlink.llm.common import RunHash, bytes_of, documents_only, mix, partitions, pieces, ragged
from kithlink.operators.scale import staged

LEAST, GRAM = 100, 32
# Bytes of text that a task indexes at a time; a longer text is indexed in parts.
PART = 2_000_000
# Contexts of a bucket, and of one k-gram in a bucket.
BUCKET = 6_000
MOST = 3_000
CONTEXT = "gram long, same long, doc_id long, start long, strings int, lead int"
SPAN = "doc_id long, start long, end long"
_HASH: dict[int, RunHash] = {}


def _hash(seed: int) -> RunHash:
    return _HASH.setdefault(seed, RunHash(256, seed))


def contexts(data: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """The contexts of some texts: text, first string's start, number of strings, place of the k-gram after it,
    hash of the k-gram, hash of the context with that place."""
    n, window = len(data), least - gram + 1
    size = np.diff(ends)
    if not n or size.max() < least:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    h = _hash(21)
    sums = h.sums(data)
    at = np.arange(max(0, n - gram + 1))
    code = h.runs(sums, at, at + gram)
    # the low half names the place, so the least number is the leftmost of the least hashes
    low = (code & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    reach = 1
    while 2 * reach <= window:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if window > reach:
        low = np.minimum(low[:len(low) - (window - reach)], low[window - reach:])
    chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long = np.flatnonzero(size >= least)
    start = ragged(ends[:-1][long], size[long] - least + 1)
    text = np.repeat(long, size[long] - least + 1)
    chosen = chosen[start]
    opens = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(opens, len(start)))
    first, text, place = start[opens], text[opens], chosen[opens]
    lead = place - first
    # sums start anew where the power tables of very long inputs would, so a second hash keeps equality safe
    same = h.runs(sums, first, first + count + least - 1) ^ mix(_hash(22).runs(_hash(22).sums(data), first, first + count + least - 1)
                                                              + lead.astype(np.uint64))
    return text, first - ends[:-1][text], count, lead, code[place], same


def _parts(data: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, ends, offset): all texts as they are, or one very long one in overlapping parts."""
    if len(ends) > 2 or ends[-1] <= 2 * PART:
        yield data, ends, 0
        return
    for at in range(0, int(ends[-1]), PART):
        to = min(int(ends[-1]), at + PART + least - 1)
        yield data[at:to], np.array([0, to - at]), at


def _settle_here(doc: np.ndarray, start: np.ndarray, count: np.ndarray, lead: np.ndarray, code: np.ndarray,
                 same: np.ndarray) -> pa.RecordBatch:
    """Contexts as rows; those that equal an earlier one of these are spans at once, neighbours as one, without a k-gram."""
    order = np.lexsort((start, doc, same, code))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (same[order[1:]] == same[order[:-1]])
    k = np.flatnonzero(again)
    k = k[np.lexsort((start[k], doc[k]))]
    opens = np.flatnonzero(np.concatenate([[True], (doc[k[1:]] != doc[k[:-1]]) | (start[k[1:]] != start[k[:-1]] + count[k[:-1]])])
                           if len(k) else np.zeros(0, bool))
    spans = np.add.reduceat(count[k], opens) if len(k) else count[:0]
    first, one = k[opens], np.flatnonzero(~again)
    both = lambda x, y: pa.array(np.concatenate([x, y]))
    none = np.zeros(len(first), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.nulls(len(first), pa.int64()), pa.array(code[one].view(np.int64))]), both(none, same[one].view(np.int64)),
         both(doc[first], doc[one]), both(start[first], start[one]), both(spans, count[one]).cast(pa.int32()),
         both(none, lead[one]).cast(pa.int32())], [c.split()[0] for c in CONTEXT.split(", ")])


def index(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """One row per context of each document; what repeats within a batch of texts is settled there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch.column("doc_id").to_numpy()
            for data, ends, offset in _parts(*bytes_of(batch.column("text")), least):
                text, start, count, lead, code, same = contexts(data, ends, least, gram)
                yield _settle_here(ids[text], start + offset, count, lead, code, same)

    return docs.mapInArrow(run, CONTEXT)


def _settle_equal(rows: DataFrame, least: int, most: int, split: int) -> DataFrame:
    """Of each k-gram that occurs again: spans of contexts that equal an earlier one (gram is null), and the
    first of each context where there are several (crowded: more than `most`).

    A k-gram of more than `split` contexts (by default 50 * most) is settled in parts.  What it has in all is
    not known then, so the first of each of its contexts is kept and it is crowded from its first part on.
    """
    names = [c.split()[0] for c in CONTEXT.split(", ")]

    def settle(held: dict[str, np.ndarray], crowds: np.ndarray) -> pa.RecordBatch:
        gram, same = held["gram"], held["same"]
        n = len(gram)
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]]) if n else np.zeros(0, bool)
        new = new_gram.copy()
        new[1:] |= same[1:] != same[:-1]
        run = np.cumsum(new_gram) - 1
        kinds = np.bincount(run, new, int(run[-1]) + 1 if n else 0).astype(np.int64)
        crowded = (kinds[run] > most) | np.isin(gram, crowds)
        keep = ~new | (kinds[run] > 1) | crowded
        gone = ~new
        cols = [pa.array(gram[keep], mask=gone[keep]), *(pa.array(held[c][keep]) for c in names[2:]), pa.array(crowded[keep])]
        return pa.RecordBatch.from_arrays(cols, ["gram", *names[2:], "crowded"])

    def spans(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Contexts that equal an earlier one."""
        n = len(held["gram"])
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *(pa.array(held[c]) for c in names[2:]), pa.array(np.zeros(n, bool))],
                                          ["gram", *names[2:], "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        crowds = np.zeros(0, np.int64)
        for batch in batches:
            # spans come first and only pass through
            ready = batch.column("gram").null_count
            if ready:
                out = batch.slice(0, ready)
                yield pa.RecordBatch.from_arrays([out.column(c) for c in ("gram", *names[2:])] + [pa.array(np.zeros(ready, bool))],
                                                 ["gram", *names[2:], "crowded"])
                batch = batch.slice(ready)
                if not batch.num_rows:
                    continue
            new = {c: batch.column(c).to_numpy() for c in names}
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in names}
            # the last k-gram may go on; a long run of it is passed on but for the first of its last context
            upto = int(np.searchsorted(held["gram"], held["gram"][-1])) if len(held["gram"]) else 0
            if len(held["gram"]) - upto > split:
                upto += int(np.searchsorted(held["same"][upto:], held["same"][-1]))
                crowds = held["gram"][-1:]
                again = {c: x[upto + 1:] for c, x in held.items()}
                if len(again["gram"]):
                    yield spans(again)
                    held = {c: x[:upto + 1] for c, x in held.items()}
            if upto:
                yield settle({c: x[:upto] for c, x in held.items()}, crowds)
                held = {c: x[upto:] for c, x in held.items()}
        if held is not None:
            yield settle(held, crowds)

    order = ["gram", "same", "doc_id", "start"]
    place = F.coalesce("gram", F.xxhash64("doc_id", "start"))
    return (rows.repartition(partitions(rows.sparkSession), place).sortWithinPartitions(*order)
            .mapInArrow(run, "gram long, doc_id long, start long, strings int, lead int, crowded boolean"))


def _cut_out(docs: DataFrame, picked: DataFrame, least: int) -> DataFrame:
    """The picked contexts with their bytes."""
    listed = picked.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "start", "strings", "crowded")).alias("picked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, ends = bytes_of(batch.column("text"))
            lists = batch.column("picked")
            flat, per = lists.flatten(), np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(per)), per)
            start, strings = flat.field("start").to_numpy(), flat.field("strings").to_numpy().astype(np.int64)
            size = strings + least - 1
            # of an id with several texts, what does not fit one of them belongs to another
            fits = start + size <= np.diff(ends)[of]
            of, start, size = of[fits], start[fits], size[fits]
            raw = data[ragged(ends[:-1][of] + start, size)]
            cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes())])
            keep = pa.array(fits)
            yield pa.RecordBatch.from_arrays(
                [flat.field("gram").filter(keep), flat.field("crowded").filter(keep), batch.column("doc_id").take(pa.array(of)),
                 pa.array(start), text], ["gram", "crowded", "doc_id", "start", "bytes"])

    return (docs.join(listed, "doc_id").select("doc_id", "text", "picked")
            .mapInArrow(run, "gram long, crowded boolean, doc_id long, start long, bytes binary"))


def _spans(doc: np.ndarray, start: np.ndarray, least: int) -> pa.RecordBatch:
    """Removed strings as spans, neighbouring starts together."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    opens = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])) if len(doc) else np.zeros(0, int)
    last = np.append(opens[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[opens]), pa.array(start[opens]), pa.array(start[last] + least)], ["doc_id", "start", "end"])


def _expand_buckets(cut: DataFrame, least: int, buckets: int) -> DataFrame:
    def settle(group: pa.Table) -> pa.RecordBatch:
        group = group.combine_chunks()
        data, ends = bytes_of(group.column("bytes").chunk(0))
        doc, start = (group.column(c).to_numpy() for c in ("doc_id", "start"))
        which, string, offset = repeats(data, np.diff(ends), least)
        doc, start = doc[string], start[string] + offset
        order = np.lexsort((start, doc, which))
        which, doc, start = which[order], doc[order], start[order]
        # the first place of each class stays; so does its other mention by a neighbouring part
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, int)
        at = np.repeat(first, np.diff(np.append(first, len(which))))
        later = (doc != doc[at]) | (start != start[at])
        return _spans(doc[later], start[later], least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            of = batch.column("bucket").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and of[a] != now:
                    yield settle(pa.Table.from_batches(held))
                    held = []
                now = of[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield settle(pa.Table.from_batches(held))

    return (cut.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
            .select("bucket", "doc_id", "start", "bytes")
            .repartition(max(1, min(buckets, 4 * partitions(cut.sparkSession))), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, SPAN))


def _settle_strings(cut: DataFrame, least: int) -> DataFrame:
    """Spans of the strings of crowded k-grams, each looked up by two hashes of all its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "bytes", 200_000):
            data, ends = bytes_of(batch.column("bytes"))
            count = np.diff(ends) - least + 1
            at = ragged(ends[:-1], count)
            of = np.repeat(np.arange(len(count)), count)
            one, two = (_hash(s).runs(_hash(s).sums(data), at, at + least).view(np.int64) for s in (23, 24))
            yield pa.RecordBatch.from_arrays(
                [pa.array(one), pa.array(two), pa.array(batch.column("doc_id").to_numpy()[of]),
                 pa.array(batch.column("start").to_numpy()[of] + at - ends[:-1][of])], ["one", "two", "doc_id", "start"])

    strings = cut.mapInArrow(run, "one long, two long, doc_id long, start long")
    first = (strings.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("k"))
             .where("k > 1").select("one", "two", "first"))
    return (strings.join(first, ["one", "two"])
            .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
            .select("doc_id", "start", (F.col("start") + least).alias("end")))


def removed_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, most: int = MOST, bucket: int = BUCKET,
                  split: int | None = None) -> DataFrame:
    """(doc_id, start, end) byte spans, overlapping ones included, of strings that also start earlier."""
    texts = documents_only(docs).where(F.col("doc_id").isNotNull())
    settled = staged(_settle_equal(index(texts, least, gram), least, most, split or 50 * most), "contexts")
    equal = settled.where(F.col("gram").isNull()).select("doc_id", "start", (F.col("start") + F.col("strings") + least - 1).alias("end"))
    picked = settled.where(F.col("gram").isNotNull())
    cut = staged(_cut_out(texts, picked, least), "strings")
    buckets = max(1, -(-cut.where("not crowded").count() // bucket))
    return (equal.unionByName(_expand_buckets(cut.where("not crowded"), least, buckets))
            .unionByName(_settle_strings(cut.where("crowded"), least)))


def dedup_substrings(docs: DataFrame, least: int = LEAST, gram: int = GRAM, most: int = MOST, bucket: int = BUCKET,
                     keep_text: bool = False, split: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, if asked for).

    A byte goes if a string of `least` bytes around it also starts at a smaller doc_id, or earlier in the
    same document; strings are judged on the input and may overlap.  Null and empty texts have no bytes.
    Rows with a null id are neither compared nor cut.  Rows that repeat an id are one document: they lose
    the same spans, as far as these lie in them.  Other columns are not looked at.  An empty table gives
    no rows.
    """
    if gram > least:
        raise ValueError("a k-gram is at most as long as a string")
    spans = (removed_spans(docs, least, gram, most, bucket, split).distinct().groupBy("doc_id")
             .agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def cut(raw: bytes, pairs: np.ndarray) -> tuple:
        if not len(pairs):
            return len(raw), 0, 0, raw
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        start, end = pairs[:, 0], np.minimum(np.maximum.accumulate(pairs[:, 1]), len(raw))
        opens = np.concatenate([[True], start[1:] > end[:-1]]) & (start < len(raw))
        first = start[opens]
        last = end[np.append(np.flatnonzero(opens)[1:], int((start < len(raw)).sum())) - 1] if opens.any() else first
        view, kept, at = memoryview(raw), [], 0
        for a, b in zip(first.tolist(), last.tolist()):
            kept.append(view[at:a])
            at = b
        kept.append(view[at:])
        return len(raw), int((last - first).sum()), len(first), b"".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lists = batch.column("spans")
            flat, at = lists.flatten(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            both = np.stack([flat.field("start").to_numpy(), flat.field("end").to_numpy()], 1)
            data, ends = bytes_of(batch.column("text"))
            raw = data.tobytes()
            done = [cut(raw[a:b], both[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], at[:-1], at[1:])]
            cols = [batch.column("doc_id"), *(pa.array([d[i] for d in done], pa.int64()) for i in range(3)),
                    pa.array([hashlib.sha256(d[3]).hexdigest() for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array([d[3] for d in done], pa.binary())] if keep_text else [])],
                                             [f.split()[0] for f in fields.split(", ")])

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (documents_only(docs).join(spans, "doc_id", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
            .mapInArrow(run, fields))
