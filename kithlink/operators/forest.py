"""Edges that decide components, picked inside tasks: of all the edges a task reads, no more leave it than it saw nodes.

An edge that closes a circle of edges before it says nothing new, whatever the other tasks hold, so each task
may leave it out.  Memory is bounded by FOREST_EDGES: a task that holds more hands them on and begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Edges a task gathers before it thins them out, and edges that one task may hold.
GATHERED = 1_000_000
FOREST_EDGES = 4_000_000
# Edges of which one task finds the components.
COMPONENT_EDGES = 2_000_000


def joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of the nodes 0..n-1 is connected with."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def _numbered(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    return nodes, at[:len(u)], at[len(u):]


def greedy_forest(u: np.ndarray, v: np.ndarray, single1: np.ndarray, single2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which edges, given in order, a greedy takes that never joins two clusters with a single node each; the nodes
    and the smallest node of the cluster of each.

    With all single nodes seen as one, an edge between two such clusters closes a circle, so these are the edges of
    a minimum spanning forest: in each round every cluster without a single node takes its first edge (Boruvka).
    """
    nodes, u, v = _numbered(u, v)
    n, m = len(nodes), len(u)
    single = np.zeros(n, bool)
    single[u[single1]] = True
    single[v[single2]] = True
    label = np.where(single, 0, np.arange(1, n + 1))
    alive, taken = np.arange(m), np.zeros(m, bool)
    while True:
        a, b = label[u[alive]], label[v[alive]]
        apart = a != b
        alive, a, b = alive[apart], a[apart], b[apart]
        if not len(alive):
            break
        first = np.full(n + 1, m)
        np.minimum.at(first, a, alive)
        np.minimum.at(first, b, alive)
        first[0] = m
        chosen = np.unique(first[first < m])
        taken[chosen] = True
        label = joined(n + 1, label[u[chosen]], label[v[chosen]])[label]
    return taken, nodes, nodes[joined(n, u[taken], v[taken])]


COLUMNS = ["rowid1", "rowid2", "priority", "single1", "single2"]
SCHEMA = "rowid1 long, rowid2 long, priority long, single1 boolean, single2 boolean"


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS]


def _in_order(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(columns[2], kind="stable")
    return [c[order] for c in columns]


def greedy_edges(edges: DataFrame, gathered: int = GATHERED, most: int = FOREST_EDGES) -> DataFrame:
    """Those of the edges (COLUMNS, by ascending priority) that a greedy over all edges of a task would take."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def thinned() -> list[np.ndarray]:
            columns = _in_order([np.concatenate(c) for c in zip(*held)])
            taken = greedy_forest(columns[0], columns[1], columns[3], columns[4])[0]
            return [c[taken] for c in columns]

        held, new, kept = [], 0, 0
        for batch in batches:
            held.append(_arrays(batch))
            new += batch.num_rows
            if new >= max(gathered, kept):
                held = [thinned()]
                new, kept = 0, len(held[0][0])
                if kept > most:
                    yield from _batches(held.pop(), COLUMNS)
                    kept = 0
        if held:
            yield from _batches(thinned(), COLUMNS)

    return edges.select(*COLUMNS).mapInArrow(run, SCHEMA)


def _batches(columns: list[np.ndarray], names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + rows]) for c in columns], names)


def greedy_clusters(edges: DataFrame) -> DataFrame:
    """(rowid, cluster_id) of the greedy over all edges, of which one task can hold all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_arrays(b) for b in batches]
        if held:
            columns = _in_order([np.concatenate(c) for c in zip(*held)])
            _, nodes, cluster = greedy_forest(columns[0], columns[1], columns[3], columns[4])
            yield from _batches([nodes, cluster], ["rowid", "cluster_id"])

    return edges.select(*COLUMNS).repartition(1).mapInArrow(run, "rowid long, cluster_id long")


def spanning(edges: DataFrame, a: str = "rowid1", b: str = "rowid2", gathered: int = GATHERED, most: int = FOREST_EDGES) -> DataFrame:
    """(rowid1, rowid2): edges that connect what those of each task connect, and have the same ends.

    Each node goes with the smallest one it is connected with in its task; a node whose only edges lead to itself
    keeps one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> list[np.ndarray]:
            nodes, u, v = _numbered(*(np.concatenate(c) for c in zip(*held)))
            root = joined(len(nodes), u, v)
            alone = np.bincount(root, minlength=len(nodes))[root] == 1
            own = root == np.arange(len(nodes))
            show = ~own | alone
            return [nodes[root[show]], nodes[show]]

        held, new, kept = [], 0, 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in range(2)])
            new += batch.num_rows
            if new >= max(gathered, kept):
                held = [stars()]
                new, kept = 0, len(held[0][0])
                if kept > most:
                    yield from _batches(held.pop(), ["rowid1", "rowid2"])
                    kept = 0
        if held:
            yield from _batches(stars(), ["rowid1", "rowid2"])

    return edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("rowid1"), F.col(b).alias("rowid2")) \
        .mapInArrow(run, "rowid1 long, rowid2 long")


def whole_components(edges: DataFrame) -> DataFrame:
    """(rowid, cluster_id) of edges (rowid1, rowid2) of which one task can hold all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy() for c in range(2)] for b in batches]
        if held:
            nodes, u, v = _numbered(*(np.concatenate(c) for c in zip(*held)))
            yield from _batches([nodes, nodes[joined(len(nodes), u, v)]], ["rowid", "cluster_id"])

    return edges.select("rowid1", "rowid2").repartition(1).mapInArrow(run, "rowid long, cluster_id long")
