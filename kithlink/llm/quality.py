"""Quality of documents by a convolutional network over bytes, in numpy.

A document is a row of blocks of BLOCK bytes; a chunk is two neighbouring blocks, so chunks overlap
by half and cover the whole text.  Learned filters slide over the embedded bytes, the strongest
answer of each filter in a chunk goes through a hidden layer, the strongest hidden answers over all
chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.llm import labelled
from kithlink.llm.common import bytes_of, pieces, text_pieces

BLOCK, STRIDE, WIDTH = 128, 2, 8
PLACES = BLOCK // STRIDE
EMBED, FILTERS, HIDDEN = 8, 32, 24
# Blocks that are convolved at a time.
SLAB = 1024


@dataclass(frozen=True)
class Fitting:
    """Bounds and settings of the fit: documents per class, chunks per document, passes."""
    per_class: int = 1200
    chunks: int = 12
    steps: int = 240
    batch: int = 64
    rate: float = 0.004
    seed: int = 7


def blocks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each padded with zeros to whole blocks (2 at least), and blocks per text."""
    size = np.diff(ends)
    count = np.maximum(2, -(-(size + WIDTH) // BLOCK))
    starts = (np.cumsum(count) - count) * BLOCK
    out = np.zeros(int(count.sum()) * BLOCK + WIDTH, np.uint8)
    for a, b, at in zip(ends[:-1].tolist(), ends[1:].tolist(), starts.tolist()):
        out[at:at + b - a] = data[a:b]
    return out, count


class Network:
    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        f = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"embed": f(256, EMBED) * 16, "filter": f(WIDTH * EMBED, FILTERS), "filter0": np.zeros(FILTERS, np.float32),
                  "hidden": f(FILTERS, HIDDEN), "hidden0": np.zeros(HIDDEN, np.float32),
                  "out": f(HIDDEN, 1)[:, 0], "out0": np.zeros(1, np.float32)}

    @staticmethod
    def windows(embedded: np.ndarray, rows: int) -> np.ndarray:
        """(rows, places, WIDTH * EMBED) views of rows of bytes that stand STRIDE apart."""
        step = embedded.strides[1]
        return np.lib.stride_tricks.as_strided(
            embedded, (rows, (embedded.shape[1] // EMBED - WIDTH) // STRIDE + 1, WIDTH * EMBED),
            (embedded.strides[0], STRIDE * EMBED * step, step), writeable=False)

    def block_answers(self, padded: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The strongest answer of each filter that starts in each block.

        What starts at the end of a text's last block would read the next text; a text ends with
        zeros wide enough for a filter, so nothing is lost without those places.
        """
        n = (len(padded) - WIDTH) // BLOCK
        out = np.empty((n, FILTERS), np.float32)
        last = np.cumsum(count) - 1
        for at in range(0, n, SLAB):
            to = min(n, at + SLAB)
            e = self.w["embed"][padded[at * BLOCK:to * BLOCK + WIDTH]].reshape(1, -1)
            a = self.windows(e, 1)[0, :(to - at) * PLACES] @ self.w["filter"]
            a = a.reshape(to - at, PLACES, FILTERS)
            a[last[(last >= at) & (last < to)] - at, PLACES - (WIDTH - STRIDE) // STRIDE:] = -np.inf
            out[at:to] = a.max(1)
        return np.maximum(out + self.w["filter0"], 0)

    def scores(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        padded, count = blocks(data, ends)
        b = self.block_answers(padded, count)
        first = np.cumsum(count) - count
        chunk = np.maximum(b[:-1], b[1:])
        h = np.maximum(chunk @ self.w["hidden"] + self.w["hidden0"], 0)
        # the pair of one text's last and the next one's first block is no chunk
        h[(first + count - 1)[:-1]] = 0
        top = np.maximum.reduceat(h, first)
        z = (top @ self.w["out"] + self.w["out0"]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, chunks: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over texts, given as rows of chunk bytes and each text's first row."""
        w = self.w
        c = len(chunks)
        win = self.windows(w["embed"][chunks].reshape(c, -1), c)
        a = (win.reshape(-1, WIDTH * EMBED) @ w["filter"]).reshape(c, -1, FILTERS)
        at = a.argmax(1)
        raw = np.take_along_axis(a, at[:, None], 1)[:, 0] + w["filter0"]
        m = np.maximum(raw, 0)
        hraw = m @ w["hidden"] + w["hidden0"]
        h = np.maximum(hraw, 0)
        size = np.diff(np.append(first, c))
        top = np.maximum.reduceat(h, first)
        p = 1 / (1 + np.exp(-np.clip(top @ w["out"] + w["out0"], -30, 30)))
        dz = ((p - y) / len(y)).astype(np.float32)
        won = (h == np.repeat(top, size, 0)) & (h > 0)
        nth = np.cumsum(won, 0) - np.repeat(np.cumsum(won, 0)[first] - won[first], size, 0)
        dh = (won & (nth == 1)) * np.repeat(dz[:, None] * w["out"], size, 0)
        dm = (dh @ w["hidden"].T) * (raw > 0)
        ci, fi = np.nonzero(dm)
        d = dm[ci, fi]
        seen = win[ci, at[ci, fi]]
        dfilter = np.stack([np.bincount(fi, d * seen[:, k], FILTERS) for k in range(WIDTH * EMBED)])
        back = (d[:, None] * w["filter"].T[fi]).reshape(-1, WIDTH, EMBED)
        byte = chunks[ci[:, None], at[ci, fi][:, None] * STRIDE + np.arange(WIDTH)].ravel()
        dembed = np.stack([np.bincount(byte, back[:, :, e].ravel(), 256) for e in range(EMBED)], 1)
        return {"embed": dembed, "filter": dfilter, "filter0": dm.sum(0), "hidden": m.T @ dh, "hidden0": dh.sum(0),
                "out": top.T @ dz, "out0": dz.sum(keepdims=True)}

    def fit(self, texts: list[tuple[np.ndarray, int]], rule: Fitting) -> Network:
        """Adam over batches with as many texts of either class; chunks are rows of bytes."""
        r = np.random.default_rng(rule.seed)
        by = [[t for t, y in texts if y == k] for k in (0, 1)]
        if not by[0] or not by[1]:
            # one class known: every document has its share
            self.w["out"][:] = 0
            self.w["out0"][:] = 0
            return self
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, rule.steps + 1):
            pick = [by[k][i] for k in (0, 1) for i in r.integers(0, len(by[k]), rule.batch // 2)]
            y = np.repeat([0, 1], rule.batch // 2)
            size = np.array([len(t) for t in pick])
            g = self.gradients(np.concatenate(pick), np.cumsum(size) - size, y)
            rate = rule.rate * min(1, 2 * (1 - step / (rule.steps + 1)))
            for k, v in g.items():
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                self.w[k] -= (rate * (mean[k] / (1 - 0.9 ** step))
                              / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


def training_chunks(chosen: DataFrame, most: int) -> list[tuple[np.ndarray, int]]:
    """Up to `most` evenly spaced chunks of each sampled document, and its label.

    At most per_class * 2 documents of `most` chunks come to the driver.
    """
    wide = 2 * BLOCK + WIDTH - STRIDE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            padded, count = blocks(*bytes_of(batch.column("text")))
            first = np.cumsum(count) - count
            raw = []
            for at, n in zip(first.tolist(), count.tolist()):
                spots = np.unique(np.linspace(0, n - 2, min(most, n - 1)).round().astype(np.int64))
                chunks = padded[((at + spots) * BLOCK)[:, None] + np.arange(wide)]
                chunks[spots == n - 2, 2 * BLOCK:] = 0
                raw.append(chunks.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(raw, pa.binary())],
                                             ["doc_id", "y", "raw"])

    rows = chosen.select("doc_id", "text", "y").mapInArrow(cut, "doc_id long, y int, raw binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.raw)))
    return [(np.frombuffer(r.raw, np.uint8).reshape(-1, wide), r.y) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, label: str, fold: Column, rule: Fitting = Fitting()) -> Network:
    """A network fitted on a bounded sample of the labelled documents that `fold` admits."""
    chosen = labelled.sample(docs, labels, label, rule.per_class, fold)
    network = Network(rule.seed).fit(training_chunks(chosen, rule.chunks), rule)
    network.w["out0"] += np.float32(labelled.log_odds(labels, label, fold))
    return network


def score_rows(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """The rows of `docs` as they are, with the probability of label 1, from the whole text.

    Null and empty texts are scored as blocks of zeros.  Repeated rows are scored as often as they
    stand there, an empty table gives no rows.  A column of `docs` called like the score is replaced.
    """
    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.float64()), *(
            pa.array(network.scores(*bytes_of(piece))) for piece in text_pieces(text, 1_000_000))])

    return docs.drop(name).withColumn(name, run(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def score(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """doc_id and score of each row, see `score_rows`."""
    return score_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), network, name).drop("text")
