import itertools
import random

import duckdb
import pandas as pd
import pytest

from kithlink.llm import queries, url_rules
from kithlink.llm.url_rules import Listed, Mining

SCHEMA = "page_id long, url string, token string, host string, copies long"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "t", "h", 7) for i, u in urls], SCHEMA)


def told(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def test_hosts_paths_and_the_longest_rule(spark):
    urls = [(1, "http://A.Example.NET/en/x?y=/z#w"), (2, "http://example.net/fr/"), (3, "ftp://example.com/de/a://b/"), (4, "http://org/fr/"),
            (5, "http://notnet/"), (6, "http://net"), (7, "HTTP://x.Org?q/fr/"), (8, "://É.net/a b\nc"), (None, None), (None, None), (9, ""), (9, "a/b"),
            (10, "http://x.org/fr/" + "long/" * 40_000)]
    got = told(url_rules.judge(pages(spark, urls), queries.LISTED).withColumn("path", url_rules.F.substring("path", 1, 12)))
    want = [(1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/fr/", "net/", "block"),
            (3, "example.com", "/de/a://b/", "example.com/de/", "block"), (4, "org", "/fr/", "org/fr/", "allow"),
            (8, "É.net", "/a b\nc", "net/", "block"), (10, "x.org", "/fr/long/lon", "org/fr/", "allow")]
    assert [r for r in got if r[3] is not None] == sorted(want, key=str)
    assert sorted((r[:4] for r in got if r[3] is None), key=str) == sorted(
        [(5, "notnet", "/", None), (6, "net", "", None), (7, "x.org", "", None), (None, "", "", None), (None, "", "", None),
         (9, "", "", None), (9, "", "", None)], key=str)


def test_empty_tables_and_no_labels(spark):
    assert url_rules.judge(pages(spark, []), queries.LISTED).collect() == []
    none_listed = url_rules.judge(pages(spark, [(1, "http://a.net/")]), [])
    assert told(none_listed) == [(1, "a.net", "/", None, "allow")]
    blocked = url_rules.judge(pages(spark, [(1, "http://a.net/")]), [], mining=Mining(otherwise="block"))
    assert told(blocked) == [(1, "a.net", "/", None, "block")]


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_are_those_of_a_plain_count(spark, seed):
    """All combinations of a small labelled table counted one by one, and every url held against every rule."""
    rng = random.Random(seed)
    urls = ["http://" + rng.choice(["a", "b", "c"]) + "." + rng.choice(["x", "y"]) + "/" + rng.choice(["p", "q", "r"]) + rng.choice(["", "?k=1"])
            for _ in range(60)]
    rows = [(u, "block" if ("a." in u and "/p" in u) or rng.random() < 0.2 else "allow") for u in urls]
    rows += [(None, "block"), (urls[0], None), (urls[1], "maybe")]
    mining = Mining(support=0.05, confidence=0.7)
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    sets = {r.url: frozenset(r.t) for r in labelled.where("url is not null").select("url", url_rules.tokens_of(url_rules.F.col("url")).alias("t")).collect()}
    known = [(sets[u], v) for u, v in rows if u and v in ("allow", "block")]
    every = {c for s, _ in known for k in range(1, len(s) + 1) for c in itertools.combinations(sorted(s), k)}
    rules = {}
    for c in every:
        held = [v for s, v in known if s >= set(c)]
        for v in ("allow", "block"):
            n = held.count(v)
            if n >= 0.05 * len(known) and n / len(held) >= 0.7:
                rules[c, v] = (n / len(held), n / len(known))
    kept = {(c, v): x for (c, v), x in rules.items()
            if not any(w == v and set(d) < set(c) and y[0] >= x[0] for (d, w), y in rules.items())}
    mined = url_rules.mine(labelled, mining).collect()
    assert {(tuple(r.combination), r.verdict): (r.confidence, r.support) for r in mined} == kept
    counts = {t: sum(t in s for s, _ in known) for s, _ in known for t in s}
    assert all(r.posted == min(r.combination, key=lambda t: (counts[t], t)) for r in mined)
    judged = url_rules.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), [], labelled, mining)
    for r in judged.collect():
        met = [(*x, -len(c), v == "block") for (c, v), x in kept.items() if set(c) <= sets[urls[r.page_id]]]
        assert r.verdict == ("block" if met and max(met)[3] else "allow")
    # joined by shuffle instead of broadcast: the same
    small = url_rules.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), [], labelled,
                            Mining(support=0.05, confidence=0.7, broadcast_rules=0))
    assert sorted(small.collect()) == sorted(judged.collect())


def test_url_rules_are_what_sql_says(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op11_url_rules(spark, folder).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_url_rules"]).df()
    text = lambda df: sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in df[sorted(want.columns)].itertuples(index=False))
    assert text(got) == text(want)


def test_no_python_on_the_workers(spark):
    plan = url_rules.judge(pages(spark, [(1, "http://a.net/"), (2, "http://b.org/")]), queries.LISTED)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
