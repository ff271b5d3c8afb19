import itertools
import random

import numpy as np
import pytest

from kithlink.operators import cluster, constraints, forest, scale

EDGE = "rowid1 long, rowid2 long"


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def as_dict(df):
    return {r["rowid"]: r["cluster_id"] for r in df.select("rowid", "cluster_id").collect()}


SHAPES = {
    "path": [(i, i + 1) for i in range(1, 33)],
    "mixed-up path": [(a, b) for a, b in zip(*(lambda p: (p, p[1:]))(random.Random(2).sample(range(64), 64)))],
    "star": [(1, i) for i in range(2, 40)], "star around the largest": [(i, 99) for i in range(1, 40)],
    "cycle": [(i, (i + 1) % 20) for i in range(20)],
    "two cliques and a bridge": [*itertools.combinations(range(8), 2), *itertools.combinations(range(10, 18), 2), (7, 10)],
    "self edges": [(5, 5), (5, 6), (9, 9)], "repeats": [(1, 2), (2, 1), (1, 2)], "none": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components_match_union_find(spark, shape):
    edges = SHAPES[shape]
    got = as_dict(cluster.connected_components(spark.createDataFrame(edges, EDGE)))
    assert got == union_find(edges)


@pytest.mark.parametrize("task_edges", [0, 2_000_000])
def test_components_of_edges_in_many_tasks(spark, task_edges):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, 500), (501, 501), (501, 502), (7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], EDGE).repartition(6)
    assert as_dict(cluster.connected_components(df, task_edges=task_edges)) == union_find(edges)
    as_ints = df.selectExpr("CAST(rowid1 AS INT) AS x", "CAST(rowid2 AS INT) AS y")
    assert as_dict(cluster.connected_components(as_ints, "x", "y")) == union_find(edges)


def test_tasks_write_no_more_edges_than_connect_their_records(spark):
    edges = list(itertools.combinations(range(60), 2)) + [(70, 70)]
    thin = forest.spanning(spark.createDataFrame(edges, EDGE).repartition(2), gathered=50)
    # two tasks, a star of 60 nodes each; written whole they were 1,771
    assert thin.count() <= 2 * 59 + 1 and union_find([tuple(r) for r in thin.collect()]) == union_find(edges)
    # a task that holds more than it may hands them on
    few = forest.spanning(spark.createDataFrame(edges, EDGE).repartition(2), gathered=50, most=20)
    assert union_find([tuple(r) for r in few.collect()]) == union_find(edges)


def test_components_with_hot_nodes_salted(spark, monkeypatch):
    monkeypatch.setattr("kithlink.operators.scale.HOT_ROWS", 3)
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)]
    assert as_dict(cluster.connected_components(spark.createDataFrame(edges, EDGE))) == union_find(edges)


def test_small_components_need_no_salted_joins(spark):
    """Where a table has fewer rows than a key may have, no key is looked for that has too many."""
    edges = spark.createDataFrame(SHAPES["path"], EDGE).selectExpr("rowid2 AS u", "rowid1 AS v", "true AS moved")
    plans = [cluster._smaller_neighbours_to_minimum(cluster._larger_neighbours_to_minimum(edges, n), n)._jdf.queryExecution()
             .optimizedPlan().toString() for n in (32, 2_000_000)]
    assert [("_parts" in p, "Generate" in p) for p in plans] == [(False, False), (True, True)]
    assert plans[0].count("Join") < plans[1].count("Join")


def test_records_need_exactly_one_source_of_clusters(spark):
    empty = spark.createDataFrame([], EDGE)
    with pytest.raises(ValueError):
        cluster.assign_clusters(empty)
    with pytest.raises(ValueError):
        cluster.assign_clusters(empty, clusters=empty, matches=empty)


def test_every_record_keeps_its_row_and_unlinked_ones_never_meet(spark):
    records = spark.createDataFrame([
        (1, "a", "experiment_evaluation", None), (2, "a", "admin_evaluation", None),
        (3, "b", "experiment_evaluation", None), (4, "c", "admin_evaluation", None)],
        "rowid long, sid string, dataset string, date_of_birth date")
    got = as_dict(cluster.assign_clusters(records, matches=spark.createDataFrame([(1, 2)], EDGE)))
    assert got == {1: 1, 2: 1, 3: -1, 4: -2}


def test_many_to_one_keeps_the_best_and_breaks_ties_low(spark):
    edges = spark.createDataFrame([(1, 9, .9), (1, 8, .9), (2, 9, .4), (3, 9, .5)], "rowid1 long, rowid2 long, score double")
    got = sorted((r.rowid1, r.rowid2) for r in cluster.many_to_one(edges, .5).collect())
    assert got == [(1, 8), (3, 9)]


# -- constraints ----------------------------------------------------------------------

ROLES = [constraints.EXPERIMENT, constraints.TRAINING, "ADMIN_EVALUATION"]


def test_link_rules(spark):
    pairs = spark.createDataFrame(list(itertools.product(ROLES, ROLES)), "dataset_1 string, dataset_2 string")
    got = {(r[0], r[1]): r["valid"] for r in constraints.valid_links(pairs).collect()}
    e, t, a = ROLES
    assert {k for k, v in got.items() if v} == {(t, t), (a, a), (e, a), (a, e)}


def random_graph(seed, nodes=40, edges=90):
    rng = random.Random(seed)
    role = {i: rng.choice(ROLES) for i in range(nodes)}
    uid = {i: f"p{rng.randrange(4)}" if role[i] == constraints.TRAINING else None for i in range(nodes)}
    pairs = sorted({tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(edges)})
    return role, uid, [(a, b, role[a], role[b], rng.choice([.6, .7, .8, .9]), i) for i, (a, b) in enumerate(pairs)]


def greedy(role, uid, edges):
    members = {i: {i} for i in role}
    where = {i: i for i in role}
    seen = set()
    for a, b, r1, r2, *_ in sorted(edges, key=lambda e: (-e[4], e[5])):
        if (r1 == ROLES[1]) != (r2 == ROLES[1]) or r1 == r2 == ROLES[0]:
            continue
        seen |= {a, b}
        x, y = where[a], where[b]
        both = members[x] | members[y]
        if x == y or sum(role[i] == ROLES[0] for i in both) > 1 or len({uid[i] for i in both} - {None}) > 1:
            continue
        if any(role[i] == ROLES[1] for i in both) and any(role[i] != ROLES[1] for i in both):
            continue
        members[min(x, y)] = both
        for i in both:
            where[i] = min(x, y)
    return {i: where[i] for i in seen}


@pytest.mark.parametrize("seed,task_edges,nodes,edges", [(1, 50_000, 40, 90), (2, 50_000, 40, 90), (3, 0, 14, 20)])
def test_constrained_clusters_are_the_greedy_ones(spark, seed, task_edges, nodes, edges):
    role, uid, edges = random_graph(seed, nodes, edges)
    df = spark.createDataFrame(edges, "rowid1 long, rowid2 long, dataset_1 string, dataset_2 string, phat double, original_order long")
    nodes = spark.createDataFrame([(i, role[i], uid[i]) for i in role], "rowid long, dataset string, uid_sid string")
    got = as_dict(constraints.constrained_clusters(df, nodes, task_edges))
    assert got == greedy(role, uid, edges)
    members = nodes.join(spark.createDataFrame(list(got.items()), "rowid long, cluster_id long"), "rowid")
    assert constraints.valid_clusters(members).where("NOT valid OR NOT valid_ids").count() == 0


EDGES = "rowid1 long, rowid2 long, dataset_1 string, dataset_2 string, phat double, original_order long"


@pytest.mark.parametrize(("forest_edges", "known_outside"), [(4_000_000, False), (0, False), (4_000_000, True)])
def test_constrained_clusters_of_one_large_component(spark, forest_edges, known_outside):
    """Most records are no training records; edges of many tasks decide, by the forest, by its rounds and with ids known outside."""
    rng = random.Random(21)
    role = {i: rng.choice([*ROLES[:1] * 2, *ROLES[1:2] * 1, *ROLES[2:] * 5]) for i in range(60)}
    uid = {i: f"p{rng.randrange(3)}" if (role[i] == ROLES[1] or known_outside and role[i] == ROLES[2]) and rng.random() < 0.7 else None for i in role}
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(260)})
    edges = [(a, b, role[a], role[b], rng.choice([.6, .7, .8, .9]), i) for i, (a, b) in enumerate(pairs)]
    nodes = spark.createDataFrame([(i, role[i], uid[i]) for i in role], "rowid long, dataset string, uid_sid string")
    got = as_dict(constraints.constrained_clusters(spark.createDataFrame(edges, EDGES).repartition(7), nodes, forest_edges=forest_edges))
    assert got == greedy(role, uid, edges) and len(set(got.values())) > 5


def test_a_large_constrained_component_takes_no_rounds_of_joins(spark, monkeypatch):
    """Components of more than `task_edges` edges went through rounds of joins, dozens of jobs each."""
    def rounds(*_):
        raise AssertionError("rounds of joins")

    monkeypatch.setattr(constraints, "_merge_by_joins", rounds)
    role = {i: ROLES[0] if i % 10 == 0 else ROLES[2] for i in range(40)}
    edges = [(a, b, role[a], role[b], (a * 7 + b * 3) % 10 / 10, a * 40 + b) for a in range(40) for b in range(a + 1, 40)]
    nodes = spark.createDataFrame([(i, role[i], None) for i in role], "rowid long, dataset string, uid_sid string")
    got = as_dict(constraints.constrained_clusters(spark.createDataFrame(edges, EDGES), nodes, task_edges=100))
    assert got == greedy(role, dict.fromkeys(role), edges)


@pytest.mark.parametrize("seed", range(4))
def test_thinned_edges_are_those_of_the_greedy_over_all(seed):
    rng = np.random.default_rng(seed)
    n, m = 50, 400
    u, v = rng.integers(0, n, m) * 3, rng.integers(0, n, m) * 3
    single = rng.random(n * 3) < 0.2
    taken, nodes, cluster = forest.greedy_forest(u, v, single[u], single[v])
    role = {int(x): ROLES[0] if single[x] else ROLES[2] for x in nodes}
    want = greedy(role, dict.fromkeys(role), [(int(a), int(b), role[int(a)], role[int(b)], 0.0, i) for i, (a, b) in enumerate(zip(u, v))])
    got = dict(zip(nodes.tolist(), cluster.tolist()))
    assert {x: got[x] for x in want} == want
    # first in two parts, then what they leave
    parts = [np.arange(m)[i::2] for i in (0, 1)]
    left = np.sort(np.concatenate([p[forest.greedy_forest(u[p], v[p], single[u[p]], single[v[p]])[0]] for p in parts]))
    again = forest.greedy_forest(u[left], v[left], single[u[left]], single[v[left]])
    assert left[again[0]].tolist() == np.flatnonzero(taken).tolist() and len(left) < m


@pytest.mark.parametrize("seed", [3])
def test_average_linkage_by_task_and_by_joins_agree(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(70)})
    df = spark.createDataFrame([(a, b, round(rng.random(), 6)) for a, b in pairs], "rowid1 long, rowid2 long, score double")
    by_task, by_joins = (as_dict(constraints.partition_clusters(df, .5, n)) for n in (50_000, 0))
    assert by_task == by_joins and len(set(by_task.values())) > 1


def test_average_linkage_deletes_the_pairs_it_has_read(spark, monkeypatch):
    gone = []

    def discard(df):
        gone.extend({f.rpartition("/")[0].rpartition("/")[2].partition("-")[0] for f in df.inputFiles()})
        scale.discard(df)

    monkeypatch.setattr(constraints, "discard", discard)
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(90)})
    df = spark.createDataFrame([(a, b, round(rng.random(), 6)) for a, b in pairs], "rowid1 long, rowid2 long, score double")
    assert len(constraints.partition_clusters(df, .4, 0).collect()) > 20
    # the pairs, once those inside of components are written, and the tables of each turn by joins
    assert gone[0] == "once" and gone.count("links") == gone.count("linkage") == gone.count("merges") > 1


def test_pairs_that_may_not_link_are_not_compared(spark, monkeypatch):
    from kithlink.operators import learn
    from kithlink.plans import arms
    seen = []

    def compared(pairs):
        seen.append({(r.dataset1, r.dataset2) for r in pairs.select("dataset1", "dataset2").collect()})
        raise InterruptedError

    monkeypatch.setattr(learn, "with_features", compared)
    pairs = spark.createDataFrame([(a, b) for a in ROLES for b in ROLES], "dataset1 string, dataset2 string")
    with pytest.raises(InterruptedError):
        arms.supervised_linkage(None, None, pairs)
    e, t, a = ROLES
    assert seen == [{(t, t), (a, a), (e, a), (a, e)}]


def test_scores_of_one_table_are_read_and_not_written(spark, monkeypatch):
    from kithlink.operators import learn
    from kithlink.plans import arms
    pairs = spark.createDataFrame([(1, 2, 1, 1, .5)], "rowid1 long, rowid2 long, copies1 long, copies2 long, confidence_score double")
    for name, made in (("labelled_pairs", None), ("fit_pairs", None), ("with_features", pairs), ("score_pairs", pairs)):
        monkeypatch.setattr(learn, name, lambda *_, made=made: made)
    monkeypatch.setattr(constraints, "partition_clusters", lambda edges, cut: pytest.fail("written") if edges.inputFiles() else (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        arms.active_deduplication(None, None, None, pairs)


def test_priority_is_score_then_order(spark):
    rows = [(1, 2, .5, 2), (3, 4, .9, 3), (5, 6, .5, 1)]
    df = spark.createDataFrame(rows, "rowid1 long, rowid2 long, phat double, original_order long")
    got = {r.rowid1: r.priority for r in constraints.link_priority(df).collect()}
    assert got == {3: 1, 5: 2, 1: 3}


@pytest.mark.parametrize("task_edges", [50_000, 0])
def test_average_linkage_counts_copies(spark, task_edges):
    """A record that stands for several weighs as many as they would on their own."""
    rng = random.Random(12)
    copies = {x: rng.choice([1, 1, 2, 4]) for x in range(24)}
    pairs = {(a, b): rng.randrange(300, 1000) / 1000 for a in range(24) for b in range(a + 1, 24) if a // 6 == b // 6 and rng.random() < 0.8}
    weighed = [(a, b, s, copies[a], copies[b]) for (a, b), s in pairs.items()]
    each = {x: [x * 10 + k for k in range(n)] for x, n in copies.items()}
    alone = [(p, q, s) for (a, b), s in pairs.items() for p in each[a] for q in each[b]]
    alone += [(p, q, 2.0) for own in each.values() for p in own for q in own if p < q]
    one = {r.rowid: r.cluster_id for r in constraints.partition_clusters(
        spark.createDataFrame(weighed, "rowid1 long, rowid2 long, score double, copies1 long, copies2 long"), 0.5, task_edges).collect()}
    many = {r.rowid: r.cluster_id for r in constraints.partition_clusters(
        spark.createDataFrame(alone, "rowid1 long, rowid2 long, score double"), 0.5, task_edges).collect()}
    assert {x: c * 10 for x, c in one.items()} == {x: many[x * 10] for x in one}
    assert len(set(one.values())) < len(one)
