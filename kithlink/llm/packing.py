"""Packing of documents into token sequences by first-fit decreasing in randomised groups.

Documents are tokenised where they are read.  Whole sequences are cut off the front of a long
document; what is left goes, by a hash of its id, to a group, and each group is packed on its own:
largest piece first into the first sequence with room, found in a tournament tree of the free room.
Only ids, lengths and checksums are shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.llm.common import bytes_of, documents_only, partitions, pieces, ragged
from kithlink.llm.tokens import Tokens

SEQUENCE = 2048
END_ID = 1
# Documents of a group, and the pieces that are packed together at most.
GROUP_DOCUMENTS = 4096
GROUP_PIECES = 8192
# A much longer text is tokenised in parts, cut where a line break stands alone.
PART_CHARS = 1_000_000


def first_fit_decreasing(lengths: list[int], room: int) -> list[int]:
    """The bin of each piece: largest first (ties: earlier first), into the lowest bin with room.

    The tree holds the free room of bins at its leaves and the larger of two children above them.
    """
    n = 1
    while n < max(1, len(lengths)):
        n *= 2
    tree = [room] * (2 * n)
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, need = 1, lengths[i]
        while at < n:
            at = 2 * at if tree[2 * at] >= need else 2 * at + 1
        out[i] = at - n
        tree[at] -= need
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return out


def _parts(text: str) -> list[str]:
    if len(text) <= 2 * PART_CHARS:
        return [text]
    out, at = [], 0
    for m in re.finditer(r"(?<=\S)\n(?=\S)", text):
        if m.end() - at >= PART_CHARS:
            out.append(text[at:m.end()])
            at = m.end()
    return [*out, text[at:]]


SPANS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def spans(docs: DataFrame, vocabulary: str, ranks: str, sequence: int = SEQUENCE, end_id: int = END_ID,
          keep_ids: bool = False) -> DataFrame:
    """Each document's tokens and the closing id, as spans of `sequence` tokens and one shorter or equal."""
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(vocabulary, ranks)
        for batch in pieces(batches):
            rows: list[tuple] = []
            for doc, parts in zip(batch.column("doc_id").to_pylist(), _encoded(tokens, batch.column("text"))):
                ids = np.concatenate([*parts, np.array([end_id])]).astype("<u4")
                for at in range(0, len(ids), sequence):
                    raw = ids[at:at + sequence].tobytes()
                    rows.append((doc, at, len(raw) // 4, zlib.crc32(raw), len(ids), *([raw] if keep_ids else [])))
            yield pa.RecordBatch.from_pydict(
                {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(
                    [*((c.split()[0], pa.int64()) for c in SPANS.split(", ")), *([("ids", pa.binary())] if keep_ids else [])])})

    return documents_only(docs).mapInArrow(tokenise, SPANS + (", ids binary" if keep_ids else ""))


def _encoded(tokens: Tokens, texts: pa.Array) -> list[list[np.ndarray]]:
    """The ids of each text; short texts together, a very long one in parts."""
    _, ends = bytes_of(texts)
    if len(texts) == 1 and ends[-1] > 2 * PART_CHARS:
        return [[tokens.encode([part])[0] for part in _parts(texts[0].as_py())]]
    return [[ids] for ids in tokens.encode(texts.to_pylist())]


def pack(docs: DataFrame, vocabulary: str, ranks: str, sequence: int = SEQUENCE, end_id: int = END_ID,
         group_documents: int = GROUP_DOCUMENTS, seed: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids,
    little-endian unsigned 32-bit, if asked for).

    A null or empty text is the closing id alone.  A document is cut only into whole sequences and
    one rest.  Repeated rows are packed as often as they stand there.  A group far above its size
    (repeated ids) is packed in runs of GROUP_PIECES pieces.  A null id is kept as such.  Other
    columns are not looked at.  An empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group_documents))
    keyed = (spans(docs, vocabulary, ranks, sequence, end_id, keep_ids)
             .withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups))))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]

    def packed(run: pa.Table, group: int, first: int) -> tuple[pa.Table, int]:
        """The pieces of one run with their sequences, numbered from `first`."""
        lengths = run.column("length").to_numpy()
        bins = np.array(first_fit_decreasing(lengths.tolist(), sequence), np.int64)
        order = np.lexsort((np.arange(len(bins)), bins))
        sizes = lengths[order]
        before = np.cumsum(sizes) - sizes
        opens = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = before - np.maximum.accumulate(np.where(opens, before, 0))
        out = run.select(names).take(pa.array(order))
        out = out.append_column("sequence_id", pa.array((group << 32) + first + bins[order]))
        return out.append_column("offset", pa.array(offset)), first + int(bins.max()) + 1

    def pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, held = None, 0, []
        for batch in batches:
            of = batch.column("grp").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and of[a] != group:
                    yield from packed(pa.Table.from_batches(held), group, first)[0].to_batches()
                    held, first = [], 0
                elif of[a] != group:
                    first = 0
                group = int(of[a])
                for at in range(a, b, GROUP_PIECES):
                    if sum(x.num_rows for x in held) + min(GROUP_PIECES, b - at) > GROUP_PIECES:
                        out, first = packed(pa.Table.from_batches(held), group, first)
                        yield from out.to_batches()
                        held = []
                    held.append(batch.slice(at, min(GROUP_PIECES, b - at)))
        if held:
            yield from packed(pa.Table.from_batches(held), group, first)[0].to_batches()

    order = ["grp", "doc_id", "start", "ids_crc32", "doc_tokens"]
    return (keyed.repartition(min(groups, partitions(docs.sparkSession)), "grp").sortWithinPartitions(*order)
            .mapInArrow(pack_groups, ", ".join([SPANS, *(["ids binary"] if keep_ids else []),
                                                "sequence_id long, offset long"])))
