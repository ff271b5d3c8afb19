"""String similarity: edit similarity on the JVM, Jaro-Winkler over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def _codepoints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(v) for v in values), dtype=np.int64, count=len(values))
    width = max(1, int(lengths.max(initial=0)))
    matrix = values.astype(f"<U{width}").view("<u4").reshape(len(values), width)
    return matrix, lengths


def edit_distance_batch(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edit distance of two arrays of texts, vectorised over the rows of the batch."""
    a, len_a = _codepoints(left)
    b, len_b = _codepoints(right)
    # row i of the distance table of every pair; a pair is done in the row of its left length
    above = np.repeat(np.arange(b.shape[1] + 1, dtype=np.int32)[:, None], len(a), 1)
    out = np.where(len_a == 0, len_b, 0)
    for i in range(a.shape[1] if len(a) else 0):
        row = np.empty_like(above)
        row[0] = i + 1
        for j in range(b.shape[1]):
            row[j + 1] = np.minimum(np.minimum(above[j + 1], row[j]) + 1, above[j] + (a[:, i] != b[:, j]))
        ends = np.flatnonzero(len_a == i + 1)
        out[ends] = row[len_b[ends], ends]
        above = row
    return out


def jaro_winkler_batch(left: np.ndarray, right: np.ndarray, boost_from: float = 0.7) -> np.ndarray:
    """Jaro-Winkler of two arrays of texts, vectorised over the rows of the batch."""
    a, len_a = _codepoints(left)
    b, len_b = _codepoints(right)
    rows = np.arange(len(a))
    window = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    used_a = np.zeros(a.shape, dtype=bool)
    used_b = np.zeros(b.shape, dtype=bool)
    reach = int(window.max(initial=0))
    for i in range(a.shape[1]):
        open_row = i < len_a
        for j in range(max(0, i - reach), min(b.shape[1], i + reach + 1)):
            hit = (open_row & (abs(i - j) <= window) & (j < len_b)
                   & ~used_b[:, j] & (a[:, i] == b[:, j]))
            used_b[hit, j] = True
            used_a[hit, i] = True
            open_row &= ~hit
    matches = used_a.sum(axis=1)
    # k-th matched character of each side, compared position by position
    width = int(matches.max(initial=0))
    seq_a = np.zeros((len(a), width), dtype=a.dtype)
    seq_b = np.zeros((len(a), width), dtype=b.dtype)
    for used, chars, seq in ((used_a, a, seq_a), (used_b, b, seq_b)):
        r, c = np.nonzero(used)
        seq[r, (np.cumsum(used, axis=1) - 1)[r, c]] = chars[r, c]
    half_moves = (seq_a != seq_b).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / len_a + matches / len_b + (matches - half_moves) / matches) / 3
    jaro = np.where(matches > 0, jaro, 0.0)
    jaro = np.where((len_a == 0) & (len_b == 0), 1.0, jaro)
    prefix = np.zeros(len(a), dtype=np.int64)
    running = np.ones(len(a), dtype=bool)
    for i in range(min(4, a.shape[1], b.shape[1])):
        running &= (i < len_a) & (i < len_b) & (a[rows, i] == b[rows, i])
        prefix += running
    return np.where(jaro > boost_from, jaro + prefix * 0.1 * (1 - jaro), jaro)


@F.pandas_udf(DoubleType())
def _jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    out = np.full(len(left), np.nan)
    known = (left.notna() & right.notna()).to_numpy()
    if known.any():
        # a batch of pairs repeats its values: each pair of them is compared once
        (a, lefts), (b, rights) = (pd.factorize(x[known].to_numpy(dtype=object)) for x in (left, right))
        pair, of = np.unique(a.astype(np.int64) * len(rights) + b, return_inverse=True)
        out[known] = jaro_winkler_batch(lefts[pair // len(rights)].astype(str), rights[pair % len(rights)].astype(str))[of]
    return pd.Series(out).where(known, None)


def jaro_winkler(left: Column, right: Column) -> Column:
    """Jaro-Winkler similarity with prefix weight 0.1; NULL when a side is missing."""
    return _jaro_winkler(left, right)
