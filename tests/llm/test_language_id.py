import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditspark.llm import language_id as L
from auditspark.llm.words import buffer


def symbols(t):
    out, prev = [], 0
    for c in t or "":
        x = ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0
        if x or prev:
            out.append(x)
        prev = x
    return [0, 0, 0, *out, 0]


def brute_model(texts):
    c4 = Counter()
    for t in texts:
        s = symbols(t)
        c4.update(tuple(s[i - 3: i + 1]) for i in range(3, len(s)))
    orders = {4: c4}
    for n in (3, 2, 1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    return orders


def brute_prob(orders, alphabet, g):
    n = len(g)
    if n == 0:
        return 1 / alphabet
    c = orders[n]
    total = sum(v for k, v in c.items() if k[:-1] == g[:-1])
    below = brute_prob(orders, alphabet, g[1:])
    if not total:
        return below
    kinds = sum(1 for k in c if k[:-1] == g[:-1])
    return max(c.get(g, 0) - L.DISCOUNT, 0) / total + L.DISCOUNT * kinds / total * below


def test_kneser_ney_against_formula():
    train = {"a": ["abra cadabra", "Bra, bra!"], "b": ["ñoño nada", "da da"]}
    counts = {}
    for v, t in train.items():
        k, n = np.unique(L.grams(*buffer(pa.array(t)))[0], return_counts=True)
        counts[v] = k, n.astype(float)
    m = L.build(counts)
    orders = {v: brute_model(t) for v, t in train.items()}
    alphabet = len({g for v in orders for g in orders[v][1]}) + 1
    for text in ("abra ñada", "zzz", "Bra! da", "", "12"):
        got, letters = m.entropies(*buffer(pa.array([text, "x"])))
        s = symbols(text)
        for k, v in enumerate(m.languages):
            want = -sum(math.log2(brute_prob(orders[v], alphabet, tuple(s[i - 3: i + 1]))) for i in range(3, len(s))) / (len(s) - 3)
            assert abs(got[0, k] - want) < 1e-4
        assert letters[0] == sum(c.isalpha() for c in text)


def test_sums_to_one():
    k, n = np.unique(L.grams(*buffer(pa.array(["the cat sat", "on the mat"])))[0], return_counts=True)
    m = L.build({"x": (k, n.astype(float))})
    every = sorted({int(x) & 0xFFFF for x in k})
    ctx = ord("t") << 48 | ord("h") << 32 | ord("e") << 16
    p = np.exp2(m.log_probs(np.array([ctx | x for x in every], np.uint64)).astype(float)).sum()
    assert p < 1 <= p + np.exp2(m.log_probs(np.array([ctx | 0xE001], np.uint64)).astype(float))[0] + 1e-6


def corpus():
    r = random.Random(3)
    syl = {"en": "the ing tion and er".split(), "de": "sch ung ein ße lich".split(), "fr": "eau ou é que ment".split()}
    rows = []
    for i in range(600):
        v = r.choice(list(syl))
        rows.append((i, " ".join("".join(r.choice(syl[v]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))), v))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 3!", None), (1003, "the thing", None), (None, "eau que", "fr"),
           (1004, "the " * 200000, "en"), (1005, "Ωμέγα " * 40, None), (1003, "the thing", None)]
    df = spark.createDataFrame([(*x, "s") for x in rows + odd], "doc_id long, text string, lang string, bits string").repartition(3)
    m = L.fit(df)
    got = defaultdict(list)
    for r in L.predict(df, m).withColumn("h", L.held_out(F.col("doc_id"))).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows) + len(odd)
    held = [(i, v) for i, _, v in rows if got[i][0].h]
    assert 80 < len(held) < 160
    assert sum(got[i][0]._lang == v for i, v in held) >= 0.99 * len(held)
    assert [got[i][0]._lang for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003][0]._lang == got[1003][1]._lang == "en" and got[None][0]._lang == "fr"
    assert got[1005][0]._rejected and not any(got[i][0]._rejected for i, _ in held[:50])
    assert all(0 <= r._score <= 1 for x in got.values() for r in x)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r._lang for r in L.predict(df, L.fit(df)).collect()} == {"und"}
    assert L.predict(df.where("false"), L.fit(df.where("false"))).collect() == []


def test_every_gram_and_language_is_kept(spark):
    r = random.Random(8)
    han = "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(300000))  # more 4-grams, seen once, than were kept of a language
    rows = [(i, han[k: k + 3000], "zh") for k, i in zip(range(0, len(han), 3000), (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 5))]
    for v in range(300):  # and more languages
        i = next(i for i in range(10**6 + 100 * v, 2 * 10**6) if zlib.crc32(str(i).encode()) % 5)
        rows.append((i, (chr(0x1401 + 2 * v) + chr(0x1402 + 2 * v)) * 9, f"v{v:03d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    m = L.fit(df)
    assert len(m.languages) == 301
    assert {r.doc_id: r._lang for r in L.predict(df, m).collect()} == {i: v for i, _, v in rows}
    counts = {}
    for v in m.languages:
        k, n = np.unique(L.grams(*buffer(pa.array([t for _, t, x in rows if x == v])))[0], return_counts=True)
        counts[v] = k, n.astype(float)
    whole = L.build(counts)
    texts = pa.array([han[5000:5200], han[7:60] + "abc", "ᐁᐂᐁ", ""])
    assert np.allclose(m.entropies(*buffer(texts))[0], whole.entropies(*buffer(texts))[0], rtol=1e-6)


def test_limits_of_all_own_texts(spark):
    base = [(i, t, v) for i, t, v in corpus() if v == "en" and zlib.crc32(str(i).encode()) % 5]
    rows = base + [(i, t, "twin") for i, t, _ in base]  # the same texts, which are always taken for "en"
    rows += [(i, "12 3", "zz") for i, _, _ in base]     # no text with a letter
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    m = L.fit(df)
    assert set(m.limit) == {"en", "twin", "zz"}
    for v in m.languages:
        h, _ = m.entropies(*buffer(pa.array([t for _, t, x in rows if x == v])))
        own = np.sort(h[:, m.languages.index(v)])
        assert m.limit[v] == own[math.ceil(len(own) * L.ACCEPT) - 1] * L.MARGIN
