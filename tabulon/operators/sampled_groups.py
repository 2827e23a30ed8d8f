"""Groupings that need all distances: found on a bounded sample, then given to all rows by their nearest sampled ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.cluster import assign_by_neighbours


def distances(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Agglomerative grouping that adds least to the sum of squares, by chains of nearest neighbours."""
    n = len(x)
    d = distances(x) ** 2
    np.fill_diagonal(d, np.inf)
    size, alive, up = np.ones(n), np.ones(n, bool), np.arange(n)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = chain.pop(), chain.pop()
        merges.append((d[a, b], a, b))
        others = alive.copy()
        others[[a, b]] = False
        total = size[a] + size[b] + size
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / total
        d[b], d[:, b] = np.where(others, new, np.inf), np.where(others, new, np.inf)
        alive[a], size[b] = False, size[a] + size[b]
    # the cheapest merges, as far as k groups are left
    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        up[_root(up, a)] = _root(up, b)
    return np.unique([_root(up, i) for i in range(n)], return_inverse=True)[1]


def _root(up: np.ndarray, i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = int(up[i])
    return i


def medoids(x: np.ndarray, k: int, seed: int = 42, rounds: int = 50) -> np.ndarray:
    """Groups around k of the rows, each the one with the least distance to its group."""
    d, rng = distances(x), np.random.default_rng(seed)
    centres = [int(d.sum(1).argmin())]
    while len(centres) < k:
        gain = np.maximum(d[:, centres].min(1)[:, None] - d, 0).sum(0)
        gain[centres] = -1
        centres.append(int(gain.argmax()))
    for _ in range(rounds):
        label = d[:, centres].argmin(1)
        new = [int(np.flatnonzero(label == g)[d[np.ix_(label == g, label == g)].sum(1).argmin()]) if (label == g).any() else int(rng.integers(len(x))) for g in range(k)]
        if new == centres:
            break
        centres = new
    return d[:, centres].argmin(1)


def dense(x: np.ndarray, least: int | None = None) -> np.ndarray:
    """Groups of at least least rows that hold together longest as distances shrink; -1 for rows between them."""
    n = len(x)
    least = least or int(np.clip(n // 50, 5, 500))
    d = distances(x)
    core = np.partition(d, min(least, n - 1), axis=1)[:, min(least, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    # the smallest tree over all rows
    near, link, left, edges = reach[0].copy(), np.zeros(n, int), np.ones(n, bool), []
    left[0] = False
    for _ in range(n - 1):
        j = int(np.where(left, near, np.inf).argmin())
        edges.append((float(near[j]), int(link[j]), j))
        left[j] = False
        closer = left & (reach[j] < near)
        near[closer], link[closer] = reach[j][closer], j
    # joined from the shortest edge on: a node is (children, distance, rows)
    up, node, nodes = np.arange(n), list(range(n)), [((), 0.0, [i]) for i in range(n)]
    for w, a, b in sorted(edges):
        a, b = _root(up, a), _root(up, b)
        nodes.append(((node[a], node[b]), w, nodes[node[a]][2] + nodes[node[b]][2]))
        up[a] = b
        node[b] = len(nodes) - 1
    label, count = np.full(n, -1), 0

    def best(at: int, since: float) -> tuple[float, list[list[int]]]:
        """How long a group at a node holds together, or its parts do if that is longer, and the groups."""
        held, low = 0.0, at
        while True:
            kids, w, rows = nodes[low]
            density = 1 / max(w, 1e-12)
            held += len(rows) * max(density - since, 0)
            big = [c for c in kids if len(nodes[c][2]) >= least]
            if len(big) != 1:
                break
            since, low = density, big[0]
        if len(big) == 2:
            parts = [best(c, density) for c in big]
            if sum(p[0] for p in parts) > held or at == len(nodes) - 1:
                return sum(p[0] for p in parts), [g for p in parts for g in p[1]]
        return held, [nodes[at][2]]

    for rows in best(len(nodes) - 1, 0.0)[1]:
        label[rows] = count
        count += 1
    return label


def sampled_groups(df: DataFrame, columns: list[str], row_id: str, algorithm: str, k: int = 3, sample: int = 1500, seed: int = 42) -> DataFrame:
    """df with cluster, by ward, medoids or dense on sample rows drawn by hash; every other row joins its nearest ones' group."""
    rows = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in columns])
    some = rows.orderBy(F.xxhash64(row_id, F.lit(seed)), row_id).limit(sample).toPandas()
    x = some[columns].to_numpy(float)
    std = x.std(0)
    x = (x - x.mean(0)) / np.where(std > 0, std, 1)
    label = {"ward": lambda: ward(x, k), "medoids": lambda: medoids(x, k, seed), "dense": lambda: dense(x)}[algorithm]()
    known = df.sparkSession.createDataFrame([(*map(float, r), int(g)) for r, g in zip(some[columns].to_numpy(float), label, strict=True)], ", ".join(f"`{c}` double" for c in columns) + ", label_ int")
    return assign_by_neighbours(rows, known, columns, "label_", row_id, k=1 if algorithm == "dense" else 5)
