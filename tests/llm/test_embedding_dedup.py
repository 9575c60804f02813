import math

import numpy as np
import pytest

from auditspark.llm import embedding_dedup as E


def brute(rows, t):
    n = len(rows)
    lab = list(range(n))

    def root(x):
        while lab[x] != x:
            x = lab[x]
        return x

    def good(r):
        return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v) / max(map(abs, v)) for v in (a[1], b[1]))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= t:
                    links[i] += 1
                    links[j] += 1
                    p, q = root(i), root(j)
                    lab[max(p, q)] = min(p, q)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted((-1 if r[0] is None else r[0], links[i], low.get(root(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("tile", [1024, 5])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    g = np.random.default_rng(4)
    rows = []
    for c in range(25):
        center = g.standard_normal(16)
        for _ in range(int(g.integers(1, 14))):
            rows.append([len(rows), (center + 0.06 * g.standard_normal(16)).tolist(), c % 3])
    for _ in range(40):
        rows.append([len(rows), rows[0][1], 0])
    rows.append([len(rows), rows[0][1], None])
    rows.append([len(rows), [2 * x for x in rows[0][1]], 0])
    rows += [[len(rows) + k, v, 0] for k, v in enumerate([None, [], [0.0] * 16, [math.nan] * 16, [None] + [1.0] * 15,
                                                           [math.inf] + [1.0] * 15, [1.0, 0.0], [1.0, 0.001]])]
    for scale in (1e200, 1e-200, 1e300, 5e-310):  # cosine 1, though squares have no double
        rows.append([len(rows), [scale * x for x in rows[0][1]], 0])
    rows[3][0] = None
    rows[5][0] = rows[6][0]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n int").repartition(3)
    got = sorted((-1 if r.id is None else r.id, r.n_links, r.component) for r in E.near_duplicates(df).collect())
    assert got == brute(rows, 0.98)


def test_recall_bound():
    for bits in (14, 18, 24):
        p = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - p) ** E.tables_for(0.98, bits) <= E.MISS


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
