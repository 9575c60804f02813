import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from auditspark.llm import simhash_pivot as S


def brute_fp(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i: i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits):
    lab = list(range(len(ids)))
    def root(x):
        while lab[x] != x:
            x = lab[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = root(i), root(j)
                lab[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(ids))]


def texts():
    r = random.Random(5)
    vocab = ["Wort%d" % i for i in range(50)] + ["ÄÖ", "x y", " "]
    out = ["", None, " \t\n", "One", "one TWO", "a\x0bb\x0cc\rd"]
    for _ in range(40):
        base = [r.choice(vocab) for _ in range(r.randint(1, 400))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            w = list(base)
            w[r.randrange(len(w))] = r.choice(vocab)
            out.append("  ".join(w))
        out.append(" ".join(base))
    out.append(" ".join(r.choice(vocab) for _ in range(60000)))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 1000)
    t = texts()
    ids = list(range(100, 100 + len(t)))
    ids[7] = None
    ids[9] = ids[8]
    df = spark.createDataFrame(list(zip(ids, t, [1] * len(t))), "doc_id long, text string, fp int").repartition(3)
    got = sorted((-1 if r.id is None else r.id, r.fp & (1 << 64) - 1, r.component)
                 for r in S.near_duplicates(df, shingle=3, max_bits=2).collect())
    fps = [brute_fp(x) for x in t]
    want = sorted((-1 if i is None else i, f, c) for i, f, c in zip(ids, fps, brute_components(ids, fps, 2)))
    assert got == want


@pytest.mark.parametrize("bits,tile", [(0, 4096), (2, 4096), (2, 16), (3, 7)])
def test_links_lose_nothing(spark, monkeypatch, bits, tile):
    monkeypatch.setattr(S, "TILE", tile)
    r = random.Random(bits)
    fps = {0, (1 << 64) - 1}
    for _ in range(20):
        c = r.getrandbits(64)
        fps.add(c)
        for _ in range(40):
            x = c
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = S.links(df, bits).collect()
    for e in edges:
        assert 0 < bin((e.a ^ e.b) & (1 << 64) - 1).count("1") <= bits
    want = brute_components(list(range(len(fps))), fps, bits)
    lab = {x: x for x in signed}
    def root(x):
        while lab[x] != x:
            x = lab[x]
        return x
    for e in edges:
        lab[root(e.a)] = root(e.b)
    groups = {}
    for x, c in zip(signed, want):
        groups.setdefault(c, set()).add(root(x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).collect() == []


def test_components_of_shapes(spark):
    from auditspark.llm.components import components
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    e = spark.createDataFrame(path + star + [(5000, 5000), (None, 3), (7000, 7001)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert len({got[i] for i in range(301)}) == 1
    assert len({got[1000 + i] for i in range(300)}) == 1
    assert got[7000] == got[7001] and len(set(got.values())) == 3
    assert components(e.where(F.lit(False))).collect() == []
