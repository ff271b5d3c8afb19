"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.operators.scale import staged


def _give_back() -> None:
    """Memory of freed arrays goes back to the system at once: workers stay from stage to stage, and what the
    allocators would keep for them adds up beside the heap of their executor."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        # of the C library: large blocks are mapped on their own, the rest is trimmed, two arenas do
        for setting, value in ((-3, 1 << 18), (-1, 1 << 20), (-8, 2)):
            ctypes.CDLL("libc.so.6").mallopt(setting, value)
    except (OSError, AttributeError):
        # another C library keeps its own ways
        pass


_give_back()

# Text that a task holds as arrays at a time; a single longer text is handled alone.
PIECE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """`staged`, and the driver's garbage collected, so that Spark drops the shuffle files of what was written.

    They stay as long as the driver remembers the plan; on disks of a few times the input they add up.
    """
    out = staged(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and nothing else a table may carry."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of up to `most` bytes of `column`, one row at least."""
    for batch in batches:
        ends = offsets_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """An array of texts cut like `pieces`."""
    for batch in pieces([pa.RecordBatch.from_arrays([texts], ["text"])], most=most):
        yield batch.column("text")


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Where each text starts in the array's buffer, and where the last ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], kind) if texts.buffers()[1] else np.zeros(1, kind)
    return raw[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts without nulls, and len + 1 offsets from 0."""
    ends = offsets_of(texts)
    data = texts.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers (multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, .. of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


class RunHash:
    """Hashes of byte or symbol runs from one running sum, modulo 2**64.

    Symbol s at place i counts table[s] * BASE**i; a run's sum is divided by BASE**start, which
    BASE being odd allows, so equal runs have equal hashes wherever they stand.
    """
    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)
    # powers of both, one table for all hashes of a process
    up = down = np.ones(1, np.uint64)

    def __init__(self, symbols: int, seed: int):
        self.table = mix(np.arange(1, symbols + 1, dtype=np.uint64) + np.uint64(seed << 32))

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, min(2 * len(self.up), PIECE_BYTES + 1))
            RunHash.up, RunHash.down = (np.cumprod(np.full(n, factor, np.uint64)) * np.uint64(pow(factor, -1, 1 << 64))
                                  for factor in (self.BASE, self.INVERSE))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        self._powers(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(self.table[symbols] * self.up[:len(symbols)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts])
