import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kithlink.llm import nn_descent, threshold_topk

SCHEMA = "vec_id long, embedding array<float>, score double, node string"


def table(spark, n, seed=0, width=12):
    x = np.random.default_rng(seed).standard_normal((n, width)).astype(np.float32)
    x[n // 2:n // 2 + n // 6] = x[0]  # many copies of one vector
    return x, spark.createDataFrame([(i, v.tolist(), 0.0, "a") for i, v in enumerate(x)], SCHEMA)


def odd(spark):
    nan, inf = float("nan"), float("inf")
    return spark.createDataFrame(
        [(0, [1.0, 2.0], None, None), (0, [1.0, 2.0], None, None), (1, [0.0, 0.0], None, None), (2, None, None, None),
         (3, [1.0, None], None, None), (4, [nan, 1.0], None, None), (5, [inf, 1.0], None, None), (None, [1.0, 1.0], None, None),
         (6, [1.0, 2.0], None, None), (7, [], None, None), (8, [3.0, 2.0], None, None)], SCHEMA)


@pytest.mark.parametrize("rows", [4096, 60])
def test_threshold_top_is_exact(spark, rows):
    x, df = table(spark, 300)
    got = threshold_topk.top_k(df, F.col("vec_id") % 20 == 0, 7, rows=rows, queries=5).collect()
    z = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 300, 20):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:7]
        want += [(q, r + 1, i, s[i]) for r, i in enumerate(order)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_reading_stops_early_where_the_bound_allows():
    x = np.zeros((1000, 3), np.int64)
    x[:, 0] = np.arange(1000)[::-1]
    lists = threshold_topk.SortedLists(np.arange(1000), x)
    ids, scores = lists.top(np.array([2, 0, 0]), 3, without=0)
    assert ids.tolist() == [1, 2, 3] and scores.tolist() == [1996, 1994, 1992]


def test_queries_read_the_lists_together():
    """One product serves a group: queries of all kinds get what each would get alone and what all rows give."""
    rng = np.random.default_rng(3)
    for scale in (10, 2 ** 30):
        x = rng.integers(-scale, scale, (700, 6))
        x[100:160] = x[5]
        queries = np.concatenate([x[:40], np.zeros((1, 6), np.int64), np.eye(6, dtype=np.int64), -np.eye(6, dtype=np.int64)])
        own = np.concatenate([np.arange(40) * 3, np.full(13, -1)])
        lists = threshold_topk.SortedLists(np.arange(700) * 3, x)
        of, ids, scores = lists.tops(queries, 9, own)
        for i, (q, one) in enumerate(zip(queries, own)):
            s = x @ q
            order = [j for j in np.lexsort((np.arange(700), -s)) if 3 * j != one][:9]
            assert ids[of == i].tolist() == [3 * j for j in order] and scores[of == i].tolist() == s[order].tolist()
            alone = lists.top(q, 9, one)
            assert alone[0].tolist() == ids[of == i].tolist()


def test_odd_vectors_of_the_threshold_top(spark):
    got = threshold_topk.top_k(odd(spark), F.col("vec_id") >= 0, 20).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(a, b) for a in (0, 1, 6, 8) for b in (0, 1, 6, 8) if a != b}
    assert threshold_topk.top_k(odd(spark).where("false"), F.lit(True)).collect() == []


def test_descent_finds_most_near_rows(spark):
    x, df = table(spark, 700)
    rule = nn_descent.Rule(neighbours=8, reverse=6, rounds=3, kept=40, around=24, steps=4, slice=80)
    got = nn_descent.nearest(df, F.col("vec_id") % 50 == 0, 10, rule=rule).collect()
    x = x.astype(np.float64)
    found = right = 0
    for q in range(0, 700, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in mine) and [s for *_, s in mine] == sorted(s for *_, s in mine)
        right += len({i for _, i, _ in mine} & set(order))
        found += 10
    assert right / found >= 0.9


def recall(spark, x, rule, every=50):
    df = spark.createDataFrame([(i, v.tolist(), 0.0, "a") for i, v in enumerate(x)], SCHEMA)
    got = nn_descent.nearest(df, F.col("vec_id") % every == 0, 10, rule=rule).select("query_id", "vec_id").collect()
    x, right, asked = x.astype(np.float64), 0, 0
    for q in range(0, len(x), every):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        right += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d)[:10].tolist()))
        asked += 10
    return right / asked


def test_one_huge_vector_leaves_the_codes_of_the_others_apart():
    x = np.random.default_rng(1).standard_normal((50, 12))
    x[7] *= 1e6
    code = nn_descent._encoded(x, 1.0)
    batch = pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in code], pa.binary())], ["code"])
    back = nn_descent._codes(batch, "code", 12)
    assert np.allclose(back, x, rtol=0, atol=np.abs(x).max(1, keepdims=True) / 200)


def test_the_descent_bears_one_huge_vector(spark):
    x = np.random.default_rng(1).standard_normal((700, 12)).astype(np.float32)
    x[301, 3] = 1e6
    rule = nn_descent.Rule(neighbours=8, reverse=6, rounds=3, kept=40, around=24, steps=4, slice=80)
    assert recall(spark, x, rule) >= 0.9


def test_walks_go_on_until_enough_is_found(spark):
    """Without structure, few nodes kept and one step at a time find little; the recall that is asked for is reached."""
    x = np.random.default_rng(2).standard_normal((1500, 48)).astype(np.float32)
    rule = nn_descent.Rule(neighbours=8, reverse=6, rounds=2, kept=20, around=5, steps=1, slice=80)
    assert recall(spark, x, rule, 100) >= 0.9


def test_few_and_odd_vectors_of_the_descent(spark):
    got = nn_descent.nearest(odd(spark), F.col("vec_id") >= 0, 10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [
        (0, 1, 6, 0.0), (0, 2, 8, 2.0), (6, 1, 0, 0.0), (6, 2, 8, 2.0), (8, 1, 0, 2.0), (8, 2, 6, 2.0)]
    assert nn_descent.nearest(odd(spark).where("false"), F.lit(True)).collect() == []
