import hashlib
import math
import random

import numpy as np
import pytest

from auditspark.llm import centroid_orchard as C


def brute(rows, k, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    out = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, j in out:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((-1 if i is None else i), j, d, inertia[j], sum(inertia.values()), tuple(cents[j])) for i, d, j in out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, q int, cluster string").repartition(3)
    return sorted((-1 if r.id is None else r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in C.cluster(df, **kw).collect())


@pytest.mark.parametrize("k,spread", [(1, 1.0), (7, 1.0), (40, 0.02)])
def test_against_brute_force(spark, k, spread):
    r = random.Random(k)
    rows = [(i, [r.gauss(0, spread) for _ in range(6)]) for i in range(300)]
    rows += [(900 + i, list(rows[3][1])) for i in range(150)]  # a third are copies
    rows += [(5, rows[8][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(600, None), (601, []), (602, [1.0] * 5), (603, [1.0] * 7), (604, [None] + [1.0] * 5), (605, [float("nan")] * 6), (606, [float("inf")] + [0.0] * 5)]
    assert run(spark, rows, k=k, dims=6) == brute(rows, k, 5, 6)


def test_large_components_and_ties(spark):
    rows = [(i, [float(i % 5), 0.0]) for i in range(40)] + [(50, [3e12, -3e12]), (51, [-3e12, 1.0]), (52, [1e6, 1e6])]
    want = [(*w[:2], w[2] if w[2] < 1 << 63 else None) for w in brute(rows, 6, 3, 2)]
    assert [g[:3] for g in run(spark, rows, k=6, rounds=3, dims=2)] == want
    assert run(spark, [(1, [1e300, 0.0]), (2, [0.5, 0.5])], k=3, dims=2) == [(2, 0, 0, 0, 0, (128, 128))]


def test_few_and_none(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.1, 0.1])]
    assert run(spark, rows, k=40, dims=2) == brute(rows, 40, 5, 2)
    assert run(spark, [(1, None)], k=40, dims=2) == []


def test_search_visits_what_it_must():
    r = np.random.default_rng(3)
    cents = r.integers(-50, 50, (30, 4))
    x = r.integers(-60, 60, (500, 4))
    x[:50] = cents[r.integers(0, 30, 50)]
    best, dist = C.Orchard(cents.tolist()).nearest(x)
    d = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (dist == d.min(axis=1)).all() and (best == d.argmin(axis=1)).all()
