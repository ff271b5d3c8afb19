"""Agreement patterns of the pairs of key groups, made and counted inside tasks.

The rows of a group meet in one task: those of side A first, at most `tile_rows` of them, then those of
side B as they stream by.  A pair is two places in the arrays of a batch; texts are compared once per pair
of distinct values.  Nothing is written or shuffled per pair unless the pairs themselves are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.functions.similarity import edit_distance_batch, jaro_winkler_batch
from kithlink.operators.compare import AGREEMENTS, AgreementRules
from kithlink.operators.scale import TILE_ROWS, _hot_keys

# What the agreement levels are taken from.
VALUES = ["first_name", "last_name", "date_of_birth", "middle_initial", "race", "sex"]
# Pairs whose patterns are worked out at a time, pairs of a batch that leaves Python, and pairs a task should make.
CHUNK = 1_000_000
ROWS_OUT = 100_000
WORK_PER_TASK = 20_000_000
MISSING = 3  # level of a pair that lacks a value: two bits a field
CODES = 4 ** len(AGREEMENTS)

# (rows of a batch, places on side A, places on side B) -> which pairs count
Rule = Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]


def levels_of(code: Column) -> dict[str, Column]:
    """The agreement columns of a pattern code."""
    return {g: F.nullif(F.shiftright(code, 2 * i).bitwiseAND(3), F.lit(MISSING)).cast("int") for i, g in enumerate(AGREEMENTS)}


def code_of() -> Column:
    """The pattern code of the agreement columns."""
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.coalesce(F.col(g).cast("int"), F.lit(MISSING)), 2 * i) for i, g in enumerate(AGREEMENTS)])


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number per row, -1 for null, and the distinct values in the order of their numbers."""
    coded = column.combine_chunks().dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _level(left: np.ndarray, right: np.ndarray, rules: AgreementRules) -> np.ndarray:
    s = jaro_winkler_batch(left, right)
    return np.where(s >= rules.full, 2, np.where(s >= rules.partial, 1, 0)).astype(np.int8)


def _text_levels(codes: np.ndarray, values: pa.Array, a: np.ndarray, b: np.ndarray, rules: AgreementRules) -> np.ndarray:
    """Levels of pairs of texts, graded once per pair of distinct values."""
    n = len(values)
    left, right = codes[a], codes[b]
    out = np.full(len(a), MISSING, np.int8)
    known = np.flatnonzero((left >= 0) & (right >= 0))
    if not len(known):
        return out
    pair = left[known] * n + right[known]
    texts = values.to_numpy(zero_copy_only=False).astype(str)
    if n * n <= 4 * CHUNK:
        seen = np.zeros(n * n, bool)
        seen[pair] = True
        distinct = np.flatnonzero(seen)
        table = np.zeros(n * n, np.int8)
        table[distinct] = _level(texts[distinct // n], texts[distinct % n], rules)
        out[known] = table[pair]
    else:
        distinct, of = np.unique(pair, return_inverse=True)
        out[known] = _level(texts[distinct // n], texts[distinct % n], rules)[of]
    return out


@lru_cache(maxsize=400)
def _year_table(first: int, second: int, rules: AgreementRules) -> np.ndarray:
    """Levels of the dates of two years by their days, -1 where not worked out yet."""
    return np.full(366 * 366, -1, np.int8)


@lru_cache(maxsize=400)
def _year_edits(first: int, second: int) -> np.ndarray:
    """Edits between the dates of two years by their days, -1 where not worked out yet."""
    return np.full(366 * 366, -1, np.int8)


def _date_text(days: np.ndarray) -> np.ndarray:
    text = np.datetime_as_string(days.astype("datetime64[D]"))
    return np.where(days.astype("datetime64[D]") > np.datetime64("9999-12-31"), np.char.add("+", text), text)


def _by_years(days: np.ndarray, a: np.ndarray, b: np.ndarray, table_of: Callable[[int, int], np.ndarray],
              grade: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """What `grade` says of pairs of known dates as texts; kept by the worker, as a calendar has few days."""
    year = days.astype("datetime64[D]").astype("datetime64[Y]")
    place = days - year.astype("datetime64[D]").astype(np.int64)
    year = year.astype(np.int64)
    out = np.zeros(len(a), np.int8)
    low = int(year.min(initial=0))
    span = int(year.max(initial=0)) - low + 1
    both = (year[a] - low) * span + year[b] - low
    if span < 180:
        both = both.astype(np.int16)  # short numbers sort faster
    pair = place[a] * 366 + place[b]
    order = np.argsort(both, kind="stable") if (both[1:] != both[:-1]).any() else np.arange(len(both))
    cuts = np.flatnonzero(np.diff(both[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        table = table_of(int(year[a[at[0]]]), int(year[b[at[0]]]))
        level = table[pair[at]]
        fresh = at[level < 0]
        if len(fresh):
            _, one = np.unique(pair[fresh], return_index=True)
            one = fresh[one]
            table[pair[one]] = grade(_date_text(days[a[one]]), _date_text(days[b[one]]))
            level = table[pair[at]]
        out[at] = level
    return out


def _date_levels(days: np.ndarray, a: np.ndarray, b: np.ndarray, rules: AgreementRules) -> np.ndarray:
    return _by_years(days, a, b, lambda x, y: _year_table(x, y, rules), lambda x, y: _level(x, y, rules))


def _similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """`edit_similarity` of two arrays of texts."""
    longest = np.maximum(*[np.fromiter((len(v) for v in x), np.int64, len(x)) for x in (left, right)])
    # long texts in short batches: a row of the distance tables is held for all pairs of a batch
    step = max(1, 4 * CHUNK // (int(longest.max(initial=0)) + 1))
    edits = [edit_distance_batch(left[i:i + step], right[i:i + step]) for i in range(0, len(left), step)]
    return np.where(longest == 0, 1.0, 1 - np.concatenate(edits) / np.maximum(longest, 1))


def _text_similarity(codes: np.ndarray, values: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit similarity of pairs of texts, worked out once per pair of distinct values.

    NaN where one is missing, but 1 if the other is empty, as `edit_similarity` has it.
    """
    n = len(values)
    texts = values.to_numpy(zero_copy_only=False)
    left, right = codes[a], codes[b]
    out = np.full(len(a), np.nan)
    empty = np.append(texts == "", False)  # the last is that of a missing text
    out[((left < 0) & empty[right]) | ((right < 0) & empty[left])] = 1.0
    known = np.flatnonzero((left >= 0) & (right >= 0))
    pair = left[known] * n + right[known]
    if not len(known):
        return out
    if n * n <= 4 * CHUNK:
        seen = np.zeros(n * n, bool)
        seen[pair] = True
        distinct = np.flatnonzero(seen)
        table = np.zeros(n * n)
        table[distinct] = _similarity(texts[distinct // n], texts[distinct % n])
        out[known] = table[pair]
    else:
        distinct, of = np.unique(pair, return_inverse=True)
        out[known] = _similarity(texts[distinct // n], texts[distinct % n])[of]
    return out


def _scores(rows: pa.Table, coded: dict, days: np.ndarray, a: np.ndarray, b: np.ndarray, _: AgreementRules) -> np.ndarray:
    """The mean of the edit similarities of first name, last name and birth date, NaN where one has none."""
    dated = coded["date_of_birth"][0] >= 0
    at = np.flatnonzero(dated[a] & dated[b])
    out = np.full(len(a), np.nan)
    if not len(at):
        return out
    a, b = a[at], b[at]
    # a date is ten characters long, or longer with a sign
    wide = np.fromiter((len(x) for x in _date_text(days)), np.int64, len(days))
    edits = _by_years(days, a, b, _year_edits, lambda x, y: edit_distance_batch(x, y).astype(np.int8))
    dates = 1 - edits / np.maximum(wide[a], wide[b])
    out[at] = (_text_similarity(*coded["first_name"], a, b) + _text_similarity(*coded["last_name"], a, b) + dates) / 3
    return out


def _patterns(rows: pa.Table, coded: dict, days: np.ndarray, a: np.ndarray, b: np.ndarray, rules: AgreementRules) -> np.ndarray:
    """The pattern code of each pair."""
    def equal(left: np.ndarray, right: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known, np.where(left == right, 2, 0), MISSING).astype(np.int8)

    levels = {"g_first": _text_levels(*coded["first_name"], a, b, rules), "g_last": _text_levels(*coded["last_name"], a, b, rules)}
    for g, c in (("g_mi", "middle_initial"), ("g_race", "race"), ("g_sex", "sex")):
        left, right = coded[c][0][a], coded[c][0][b]
        levels[g] = equal(left, right, (left >= 0) & (right >= 0))
    dated = coded["date_of_birth"][0] >= 0
    known = dated[a] & dated[b]
    at = np.flatnonzero(known)
    levels["g_dob"] = np.full(len(a), MISSING, np.int8)
    levels["g_dob"][at] = _date_levels(days, a[at], b[at], rules)
    date = days.astype("datetime64[D]")
    month = date.astype("datetime64[M]")
    day = days - month.astype("datetime64[D]").astype(np.int64)
    month = month.astype(np.int64) % 12
    levels["g_month"] = equal(month[a], month[b], known)
    levels["g_day"] = equal(day[a], day[b], known)
    return reduce(np.bitwise_or, [levels[g].astype(np.int32) << (2 * i) for i, g in enumerate(AGREEMENTS)])


def _pairs_of(batches: Iterator[pa.RecordBatch], keys: list[list[str]], rules: AgreementRules,
              rule: Rule | None, chunk: int, found: Callable = _patterns
              ) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places on side A, places on side B, pattern codes or what else `found` says) of sorted batches, a chunk at a time."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        marks = np.stack([_codes(rows[c])[0] for c in ("block", "_kind", "_key", "_slice")])
        opens = np.concatenate([[True], (marks[:, 1:] != marks[:, :-1]).any(0)])
        group = np.cumsum(opens) - 1
        second = rows["_second"].to_numpy()
        first_row, n_left = np.flatnonzero(opens), np.bincount(group, weights=~second).astype(np.int64)
        kind = rows["_kind"].to_numpy()
        coded = {c: _codes(rows[c]) for c in {*VALUES, *[k for key in keys for k in key]}}
        days = pc.fill_null(rows["date_of_birth"].cast(pa.int32()), 0).to_numpy().astype(np.int64)
        right = np.flatnonzero(second & (n_left[group] > 0))
        sizes = n_left[group[right]]
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(ends, np.arange(chunk, int(ends[-1]) + chunk, chunk)) + 1 if len(right) else []
        for part, of in zip(np.split(right, cuts), np.split(sizes, cuts)):
            if not len(part):
                continue
            b = np.repeat(part, of)
            a = np.arange(len(b)) - np.repeat(np.cumsum(of) - of, of) + first_row[group[b]]
            keep = np.ones(len(a), bool) if rule is None else rule(rows, a, b)
            # a pair that shares several keys belongs to the first of them
            for i, key in enumerate(keys[:-1]):
                same = [(coded[k][0][a] == coded[k][0][b]) & (coded[k][0][a] >= 0) for k in key]
                keep &= ~(reduce(np.logical_and, same) & (kind[b] > i))
            a, b = a[keep], b[keep]
            if len(a):
                yield rows, a, b, found(rows, coded, days, a, b, rules)
        # side A of the last group may meet more of side B in the next batch
        last = np.flatnonzero((group == group[-1]) & ~second)
        held = rows.take(pa.array(last)) if len(last) else None


def _sorted_groups(left: DataFrame, right: DataFrame, keys: list[list[str]], columns: list[str], tile_rows: int) -> DataFrame:
    """Rows of both sides by block, key group and slice of side A, side A first."""
    def side(rows: DataFrame, second: bool) -> DataFrame:
        parts = []
        for i, key in enumerate(keys):
            known = reduce(lambda d, k: d.where(F.col(k).isNotNull()), key, rows.where(F.col("block").isNotNull()))
            parts.append(known.select("block", *columns, F.lit(i).alias("_kind"), F.to_json(F.struct(*key)).alias("_key"),
                                      F.lit(second).alias("_second")))
        return reduce(DataFrame.unionByName, parts)

    group = ["block", "_kind", "_key"]
    a, b = side(left, False), side(right, True)
    sizes = a.groupBy(*group).agg(F.count("*").alias("_l")).join(b.groupBy(*group).agg(F.count("*").alias("_r")), group)
    pairs = sizes.agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    hot = F.broadcast(_hot_keys(a, group, tile_rows))
    count = F.coalesce("_parts", F.lit(1))
    cut = a.join(hot, group, "left").withColumn("_slice", F.pmod(F.xxhash64("rowid"), count).cast("int")).drop("_parts")
    copies = b.join(hot, group, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), count - 1))).drop("_parts")
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-pairs // WORK_PER_TASK))
    tile = [*group, "_slice"]
    return cut.unionByName(copies).repartition(int(tasks), *tile).sortWithinPartitions(*tile, "_second")


def pattern_sums(left: DataFrame, right: DataFrame, keys: list[list[str]], rules: AgreementRules = AgreementRules(),
                 rule: Rule | None = None, also: tuple[str, ...] = (), tile_rows: int = TILE_ROWS, chunk: int = CHUNK) -> DataFrame:
    """(block, agreement levels, n_pairs) of the pairs of a left and a right profile of a block that share one of
    the key lists, copies counted; `rule` says which of them count and reads the columns `also`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, a, b, code in _pairs_of(batches, keys, rules, rule, chunk):
            block, names = _codes(rows["block"])
            copies = rows["copies"].to_numpy()
            both = block[b] * CODES + code
            distinct, of = ((None, both) if len(names) * CODES <= 8 * CHUNK else np.unique(both, return_inverse=True))
            # whole numbers, exact as doubles for a chunk of pairs
            sums = np.bincount(of, weights=copies[a].astype(float) * copies[b])
            at = np.flatnonzero(sums)
            value = at if distinct is None else distinct[at]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(value // CODES)).cast(pa.string()), pa.array((value % CODES).astype(np.int32)),
                                              pa.array(sums[at].astype(np.int64))], ["block", "code", "n"])

    columns = list(dict.fromkeys(["rowid", "copies", *VALUES, *also]))
    sums = _sorted_groups(left, right, keys, columns, tile_rows).mapInArrow(run, "block string, code int, n long")
    return (sums.groupBy("block", "code").agg(F.sum("n").alias("n_pairs"))
            .select("block", *[c.alias(g) for g, c in levels_of(F.col("code")).items()], "n_pairs"))


def graded_pairs(left: DataFrame, right: DataFrame, keys: list[list[str]], carry: list[str], rules: AgreementRules = AgreementRules(),
                 rule: Rule | None = None, also: tuple[str, ...] = (), tile_rows: int = TILE_ROWS, chunk: int = CHUNK,
                 wanted: dict[str, np.ndarray] | None = None) -> DataFrame:
    """The same pairs one by one: block, the columns `carry` of both sides, agreement levels.

    With `wanted`, which has the pattern codes of interest by block, other pairs do not leave the task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, a, b, code in _pairs_of(batches, keys, rules, rule, chunk):
            if wanted is not None:
                block, blocks = _codes(rows["block"])
                asked = [wanted.get(x, np.zeros(0, np.int64)) for x in blocks.to_pylist()]
                codes = np.concatenate([i * CODES + x for i, x in enumerate(asked)])
                at = np.flatnonzero(np.isin(block[b] * CODES + code, codes))
                a, b, code = a[at], b[at], code[at]
            # few enough rows at a time for the reader of the batches
            for start in range(0, len(a), ROWS_OUT):
                one, two = (pa.array(x[start:start + ROWS_OUT]) for x in (a, b))
                out = [rows["block"].take(two), *[rows[c].take(at) for at in (one, two) for c in carry]]
                yield pa.RecordBatch.from_arrays(
                    [*[x.combine_chunks() for x in out], pa.array(code[start:start + ROWS_OUT].astype(np.int32))], names)

    types = dict(left.dtypes)
    fields = [("block", "string"), *[(f"{c}{n}", types[c]) for n in (1, 2) for c in carry], ("code", "int")]
    names = [f for f, _ in fields]
    columns = list(dict.fromkeys(["rowid", *carry, *VALUES, *also]))
    pairs = _sorted_groups(left, right, keys, columns, tile_rows).mapInArrow(run, ", ".join(f"{f} {t}" for f, t in fields))
    return pairs.select(*names[:-1], *[c.alias(g) for g, c in levels_of(F.col("code")).items()])


def similar_within(rows: DataFrame, keys: list[list[str]], carry: list[str], least: float, tile_rows: int = TILE_ROWS,
                   chunk: int = CHUNK) -> DataFrame:
    """Pairs of profiles of one table that share one of the key lists, lower rowid first, whose `score` is at least `least`:
    rowid1, rowid2, the columns `carry` of both, score.

    The score is the mean edit similarity of first name, last name and birth date to six places; a pair that lacks one of
    them has none.  Only pairs at the bar leave a task.
    """
    def lower(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rowid = table["rowid"].to_numpy()
        return rowid[a] < rowid[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, a, b, score in _pairs_of(batches, keys, AgreementRules(), lower, chunk, _scores):
            # the bar itself is held against the rounded score
            at = np.flatnonzero(score >= least - 1e-6)
            for start in range(0, len(at), ROWS_OUT):
                part = at[start:start + ROWS_OUT]
                one, two = pa.array(a[part]), pa.array(b[part])
                out = [table[c].take(x) for x in (one, two) for c in kept]
                yield pa.RecordBatch.from_arrays([*[x.combine_chunks() for x in out], pa.array(score[part])], names)

    kept = ["rowid", *carry]
    types = dict(rows.dtypes)
    fields = [*[(f"{c}{n}", types[c]) for n in (1, 2) for c in kept], ("score", "double")]
    names = [f for f, _ in fields]
    one_block = rows.withColumn("block", F.lit(""))
    pairs = _sorted_groups(one_block, one_block, keys, list(dict.fromkeys([*kept, *VALUES, *[k for key in keys for k in key]])), tile_rows)
    return (pairs.mapInArrow(run, ", ".join(f"{f} {t}" for f, t in fields))
            .withColumn("score", F.round("score", 6)).where(F.col("score") >= least))
