"""Mixing of domains to target weights by soft membership.

A classifier fitted on a bounded labelled table gives each document a posterior over domains; where a
document has a label itself, the posterior speaks only for the few labels that are wrong.  Its tokens
count for the domains in these shares.  Rates of documents are then fitted so that the expected
tokens of each domain meet their targets, by projected gradient least squares: each step is one
distributed sum over all documents, and rates stay at zero or above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.llm.common import bytes_of, mix, pieces, text_pieces, unused
from kithlink.llm.shingles import word_hashes
from kithlink.operators.scale import staged

BUCKETS = 1 << 13
# Bytes of texts summed up at a time: each word takes a row of numbers, one per domain, meanwhile.
SUMMED_BYTES = 200_000
# The domain of all labels that are none of the largest.
REST = "(rest)"


@dataclass(frozen=True)
class Fitting:
    """Labelled documents per domain, domains at most (the last for all smaller ones), share of wrong labels,
    steps at most, relative error that ends them, steps without progress that do."""
    per_domain: int = 400
    domains: int = 64
    wrong: float = 0.01
    steps: int = 60
    tolerance: float = 1e-6
    patience: int = 5


def _counts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of words and byte pairs with the text of each, and the words of each text."""
    h, words = word_hashes(data, ends)
    of = np.repeat(np.arange(len(words)), words)
    return (mix(h + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64), of, words


class Posterior:
    """Multinomial naive Bayes over hashed words; a text's evidence is tempered by its length.

    `documents` is the number of each domain's documents, of which `counts` may cover a sample.
    """

    def __init__(self, domains: list[str], counts: np.ndarray, documents: np.ndarray, wrong: float = Fitting.wrong):
        self.domains = domains
        self.wrong = wrong
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        self.log_share = np.log(share).T.astype(np.float32).copy()
        self.prior = np.log((documents + 1) / (documents + 1).sum())

    def __call__(self, data: np.ndarray, ends: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One row of domain shares per text, and its words; `label` has the domain a text is labelled with or -1."""
        bucket, _, words = _counts(data, ends)
        sums = np.zeros((len(bucket) + 1, len(self.domains)))
        np.cumsum(self.log_share[bucket], 0, dtype=np.float64, out=sums[1:])
        at = np.concatenate([[0], np.cumsum(words)])
        z = (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(1, words))[:, None] + self.prior
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        known = np.flatnonzero(label >= 0)
        z[known] *= self.wrong
        z[known, label[known]] += 1 - self.wrong
        return z, words


def fit_posterior(docs: DataFrame, domain: str, rule: Fitting = Fitting(), first: tuple[str, ...] = ()) -> Posterior:
    """From up to `per_domain` labelled documents of each domain, by a hash of their ids.

    If there are more than `domains`, the smallest are the domain REST together; those in `first` are not among
    these as long as others are.  Rows without a domain label are no examples.
    """
    labelled = docs.where(F.col(domain).isNotNull()).select(
        "doc_id", F.col(domain).cast("string").alias("domain"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = (labelled.groupBy("domain").agg(F.count("*").alias("n"))
             .orderBy(F.desc(F.col("domain").isin(*first)), F.desc("n"), "domain").limit(rule.domains + 1).collect())
    if len(sizes) > rule.domains:
        own = [r.domain for r in sizes[:rule.domains - 1]]
        labelled = labelled.withColumn("domain", F.when(F.col("domain").isin(own), F.col("domain")).otherwise(REST))
        sizes = labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()
    size = {r.domain: r.n for r in sizes}
    names = sorted(size)
    # the first of each of many slices of a domain, then the first of those
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = (labelled.select("doc_id", "domain", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)).alias("slice"))
           .withColumn("k", F.row_number().over(Window.partitionBy("domain", "slice").orderBy(*order))).where(F.col("k") <= rule.per_domain)
           .withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).where(F.col("k") <= rule.per_domain)
           .select("doc_id", "domain"))
    # at most domains * per_domain rows
    chosen = labelled.join(F.broadcast(ids), ["doc_id", "domain"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS))
        for batch in pieces(batches):
            bucket, of, _ = _counts(*bytes_of(batch.column("text")))
            d = np.searchsorted(names, batch.column("domain").to_pylist())
            total += np.bincount(d[of] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(list(total))], ["d", "c"])

    got = np.zeros((len(names), BUCKETS))
    # of each task its few rows of counts
    if names:
        for r in chosen.select("domain", "text").coalesce(8).mapInArrow(count, "d int, c array<double>").collect():
            got[r.d] += r.c
    return Posterior(names, got, np.array([size[n] for n in names]), rule.wrong)


def member_shares(docs: DataFrame, posterior: Posterior, domain: str) -> DataFrame:
    """The rows of `docs` with `tokens` (words) and `shares` (of the posterior's domains)."""
    d = len(posterior.domains)

    @F.arrow_udf("tokens long, shares array<double>")
    def run(text: pa.Array, label: pa.Array) -> pa.Array:
        known, at, found = label.to_numpy(zero_copy_only=False), 0, []
        for piece in text_pieces(text, SUMMED_BYTES):
            found.append(posterior(*bytes_of(piece), known[at:at + len(piece)]))
            at += len(piece)
        p = np.concatenate([np.zeros((0, d)), *(p for p, _ in found)])
        words = np.concatenate([np.zeros(0, np.int64), *(w for _, w in found)])
        shares = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
        return pa.StructArray.from_arrays([pa.array(words.astype(np.int64)), shares], ["tokens", "shares"])

    found = unused(docs, "found")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    label = F.lit(-1)
    if domain in docs.columns:
        own = F.col(domain).cast("string")
        place = F.array_position(F.array(*[F.lit(n) for n in posterior.domains]), own)
        rest = posterior.domains.index(REST) if REST in posterior.domains else -1
        label = F.when(own.isNull(), -1).when(place > 0, place - 1).otherwise(rest)
    return (docs.drop("tokens", "shares").withColumn(found, run(whole, label.cast("int")))
            .withColumns({"tokens": F.col(found)["tokens"], "shares": F.col(found)["shares"]}).drop(found))


def _rates(shares: np.ndarray, steps: np.ndarray, most: float) -> np.ndarray:
    r = np.ones(len(shares))
    for s in steps:
        r = np.clip(r + shares @ s, 0.0, most)
    return r


def _sums(members: DataFrame, steps: np.ndarray, d: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the rates of `steps`, and the Gram matrix of the documents not at zero."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(d + d * d)
        for batch in batches:
            shares = batch.column("shares").flatten().to_numpy().reshape(-1, d)
            tokens = batch.column("tokens").to_numpy().astype(np.float64)
            r = _rates(shares, steps, most)
            out[:d] += (r * tokens) @ shares
            out[d:] += (shares.T @ (shares * (tokens * (r > 0))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], ["k", "x"])

    out = np.zeros(d + d * d)
    # at most d + d * d rows
    for r in members.select("tokens", "shares").mapInArrow(add, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r.k] = r.x
    return out[:d], out[d:].reshape(d, d)


def fit_rates(members: DataFrame, targets: np.ndarray, rule: Fitting = Fitting(), most: float = math.inf) -> np.ndarray:
    """The dual steps of the fit, one row each; `rate` turns them into the rate of a document.

    Rates start at 1.  A step moves each rate along its document's part of the gradient, in the metric
    of the domains' Gram matrix, and projects it to between zero and `most`.  Documents of equal shares
    have equal rates, so the steps depend on `shares` and `tokens` alone.  Targets that such rates cannot
    meet end the fit when steps no longer come nearer.
    """
    d = len(targets)
    steps = np.zeros((0, d))
    scale = max(1.0, float(np.abs(targets).max()))
    best, kept, since = math.inf, steps, 0
    for _ in range(rule.steps):
        total, gram = _sums(members, steps, d, most)
        miss = targets - total
        far = float(np.abs(miss).max())
        since = 0 if far < best * 0.999 else since + 1
        if far < best:
            best, kept = far, steps
        if best <= rule.tolerance * scale or since >= rule.patience:
            break
        gram += np.eye(d) * 1e-9 * max(1.0, np.trace(gram))
        steps = np.vstack([steps, np.linalg.solve(gram, miss)])
    return kept


def rate(steps: np.ndarray, most: float = math.inf):
    """The rate of a document from its shares: 1 at first, then each step, never below zero or above `most`."""
    if not len(steps):
        return F.lit(1.0)

    @F.arrow_udf("double")
    def run(shares: pa.Array) -> pa.Array:
        return pa.array(_rates(shares.flatten().to_numpy().reshape(-1, steps.shape[1]), steps, most))

    return run(F.col("shares"))


def mix_to_targets(docs: DataFrame, domain: str, weights: dict[str, float] | None = None, power: float = 0.7,
                   labelled: DataFrame | None = None, seed: int = 0, rule: Fitting = Fitting(), budget: float | None = None,
                   most: float = math.inf) -> DataFrame:
    """The rows of `docs` with tokens, shares, rate and copies.

    `labelled` (doc_id, text and the domain column; by default `docs`) is the table the classifier is
    fitted on.  The targets are `weights` by domain, or each domain's share of expected tokens to
    `power`, of `budget` tokens, by default as many as `docs` has.  A domain that has fewer than its
    target is repeated; with `most`, no rate is above it, and a domain that then cannot meet its target
    misses it (see `report`) without taking from the others.  `copies` is the rate rounded up or down by
    a hash of the id, so that it is right on average and the same on every run.
    Null and empty texts have no tokens and a rate that costs nothing; a null id is hashed as such.
    Repeated rows have equal rates.  Without a labelled row every rate is 1.  Columns called like the
    new ones are replaced.  An empty table gives no rows.
    """
    keep = docs.drop("tokens", "shares", "rate", "copies")
    posterior = fit_posterior(docs if labelled is None else labelled, domain, rule, tuple(weights or ()))
    if not posterior.domains:
        none = F.array().cast("array<double>")
        return keep.withColumn("tokens", F.lit(0).cast("long")).withColumn("shares", none).withColumn(
            "rate", F.lit(1.0)).withColumn("copies", F.lit(1).cast("long"))
    members = member_shares(keep, posterior, domain)
    texts = keep.select("text", *([domain] if domain in keep.columns else []))
    small = staged(member_shares(texts, posterior, domain).select("tokens", "shares"), "members")
    d = len(posterior.domains)
    have, _ = _sums(small, np.zeros((0, d)), d, math.inf)
    wanted = np.array([weights.get(n, 0.0) for n in posterior.domains]) if weights else np.power(np.maximum(have, 0), power)
    if not wanted.sum() or not have.sum():
        steps = np.zeros((0, d))
    else:
        targets = wanted / wanted.sum() * (have.sum() if budget is None else budget)
        steps = fit_rates(small, np.minimum(targets, have * most), rule, most)
    even = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return (members.withColumn("rate", rate(steps, most))
            .withColumn("copies", F.floor(F.col("rate") + even).cast("long")))


def report(mixed: DataFrame, domain: str, weights: dict[str, float] | None = None, power: float = 0.7,
           budget: float | None = None) -> DataFrame:
    """domain, tokens, target, drawn (tokens times copies) by label, from the rows of `mix_to_targets`."""
    known = mixed.where(F.col(domain).isNotNull()).groupBy(F.col(domain).cast("string").alias("domain")).agg(
        F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    given = F.lit(0.0)
    for n, w in (weights or {}).items():
        given = F.when(F.col("domain") == n, F.lit(float(w))).otherwise(given)
    part = known.withColumn("part", given if weights else F.pow(F.col("tokens").cast("double"), F.lit(power)))
    total = part.agg(F.sum("part").alias("parts"), F.sum("tokens").alias("all"))
    return part.crossJoin(total).select("domain", "tokens", (
        F.col("part") / F.col("parts") * (F.col("all") if budget is None else F.lit(float(budget)))).alias("target"), "drawn")
