import random
import zlib

import pytest

from auditspark.llm import minimax_shards as M


def brute(docs, k):
    groups = {}
    for i, t in docs:
        groups.setdefault(t, []).append(i)
    big = (1 << 63) - 1
    order = sorted(groups.items(), key=lambda g: min(big if i is None else i for i in g[1]))
    sizes = [(len((t or "").encode()) + 1) * len(ids) for t, ids in order]

    def greedy(cap):
        out, room = [], -1
        for s in sizes:
            if s > cap:
                return None
            if not out or s > room:
                out.append(0)
                room = cap
            room -= s
            out[-1] += 1
        return out
    cap = max([0, *sizes])
    while len(greedy(cap) or ()) > k:
        cap += 1
    return order, greedy(cap)


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 16), (3, 1), (4, 7)])
def test_against_brute_force(spark, seed, k):
    r = random.Random(seed)
    texts = ["é" * r.randint(0, 30) for _ in range(12)] + [None, "", "x" * 5000 * (seed % 2)]
    docs = [(i, r.choice(texts) if r.random() < 0.6 else "t%d" % r.randint(0, 999) * r.randint(1, 9)) for i in range(120)]
    docs += [(None, "only nulls"), (None, "only nulls"), (5, docs[5][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int").repartition(5)
    got = M.shards(df, k).collect()
    order, counts = brute(docs, k)
    assert len(got) == len(docs)
    by = {}
    for g in got:
        by.setdefault(g.shard, []).append(g)
    assert [sum(len(ids) for _, ids in order[sum(counts[:s]): sum(counts[: s + 1])]) for s in range(len(counts))] == \
        [len(by[s]) for s in range(len(counts))]
    at = 0
    for s, n in enumerate(counts):
        rows = sorted(by[s], key=lambda x: x.slot)
        assert [x.slot for x in rows] == list(range(len(rows)))
        want = [(i, t) for t, ids in order[at: at + n] for i in sorted(ids, key=lambda i: (i is None, i))]
        assert [(x.id, x.size, x.crc) for x in rows] == [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in want]
        at += n


def test_empty(spark):
    assert M.shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []
