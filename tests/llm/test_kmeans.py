"""Ball k-means against Lloyd's rounds in plain integers; balls, ties, odd vectors, few rows."""

import hashlib
import random

import numpy as np
import pytest

from curastra.llm.ball_kmeans import Balls, assign, cluster, squared

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=8, rounds=10, dim=64, scale=1024, seed=3):
    ok = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(ok, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], dtype="<i4").tobytes()))
    c = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in ok]
        for j in range(len(c)):
            members = [v for (_, v), o in zip(ok, own, strict=True) if o == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [(i, *near(v)) for i, v in ok]
    inertia = [sum(d for _, d, o in last if o == j) for j in range(len(c))]
    return sorted(((i, o, d, inertia[o], sum(inertia), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, d, o in last), key=repr)


def _rows(n, dim, seed, groups=5, step=0.5):
    r = random.Random(seed)
    middle = [[r.gauss(0, 2) for _ in range(dim)] for _ in range(groups)]
    return [(i, [m + r.gauss(0, step) for m in r.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("dim,k,rounds", [(64, 8, 10), (3, 5, 4), (2, 1, 3)])
def test_against_plain_rounds(spark, dim, k, rounds):
    rows = _rows(300, dim, dim)
    rows += [(1000, None), (1001, []), (1002, [1.0] * (dim + 1)), (1003, [None] + [1.0] * (dim - 1)), (1004, [float("nan")] * dim), (1005, [float("-inf")] * dim), (None, [0.25] * dim), (7, rows[7][1]), (7, [9.0] * dim)]
    got = cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=rounds, dim=dim)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, k, rounds, dim)


def test_ties_on_a_grid_and_fewer_rows_than_centroids(spark):
    grid = [(i, [float(i % 7), float(i // 7)]) for i in range(49)]
    got = cluster(spark.createDataFrame(grid, SCHEMA), k=6, rounds=5, dim=2, scale=1)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(grid, 6, 5, 2, 1)
    few = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [4.0, 1.0])]
    assert sorted(map(tuple, cluster(spark.createDataFrame(few, SCHEMA), dim=2).collect()), key=repr) == plain(few, dim=2)
    assert cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(*x, 1, "o", 2.0, 3) for x in few], SCHEMA + ", id int, own string, distance double, kind int")
    assert sorted(map(tuple, cluster(clash, dim=2).collect()), key=repr) == plain(few, dim=2)


def test_only_relevant_neighbours_are_compared(monkeypatch):
    rng = np.random.default_rng(5)
    centre = np.array([[0, 0], [1000, 0], [100_000, 0], [0, 90_000]])
    x = np.concatenate([c + rng.integers(-600, 600, (200, 2)) for c in centre])
    nearest = np.argmin([squared(x, c) for c in centre], axis=0)
    radius = np.array([np.sqrt(squared(x[nearest == j], c).max()) for j, c in enumerate(centre)])
    balls = Balls.of(centre, radius)
    assert [n.tolist() for n in balls.near] == [[1], [0], [], []]
    seen = []
    monkeypatch.setattr("curastra.llm.ball_kmeans.squared", lambda x, c: seen.append(len(x)) or squared(x, c))
    best, far = assign(x, nearest, balls)
    assert best.tolist() == nearest.tolist() and far.tolist() == [int(squared(v[None], centre[j])[0]) for v, j in zip(x, nearest, strict=True)]
    assert sum(seen) < 1.5 * len(x)  # each with its own centroid, few with the one neighbour; four times as many without balls
    moved = assign(x, np.where(nearest == 1, 0, nearest), Balls.of(centre, np.array([2000.0, -1, 900, 900])))
    assert moved[0].tolist() == nearest.tolist()
