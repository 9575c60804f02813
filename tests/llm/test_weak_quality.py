import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditspark.llm import weak_quality as W
from auditspark.llm import words


def test_words_against_split():
    t = ["", "Ab cd", "é ÉX-1", None, "x" * 40 + " y", "ab", "cd ef", " "]
    data, off = words.buffer(pa.array(t).slice(1))
    low = words.LOWER[data]
    starts, lens, row = words.spans(low, off, words.ALNUM)
    got = [(int(r), bytes(low[a: a + n])) for r, a, n in zip(row, starts, lens)]
    want = [(0, b"ab"), (0, b"cd"), (1, "é".encode()), (1, "Éx".encode()), (1, b"1"), (3, b"x" * 40), (3, b"y"),
            (4, b"ab"), (5, b"cd"), (5, b"ef")]
    assert got == want
    h = words.hashes(low, starts, lens)
    assert h[0] == h[7] and h[1] == h[8] and len(set(h.tolist())) == 8


def test_pieces_cover_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 30, 2, 2, 2, 9)] + [None])], names=["t"])
    got = [p.num_rows for p in words.pieces(b, 0, 10)]
    assert sum(got) == 8 and max(got) <= 4


def test_em_finds_accuracies():
    r = np.random.default_rng(3)
    acc = [0.95, 0.85, 0.7, 0.9995]
    y = r.random(20000) < 0.2
    pat = {}
    for c in y:
        k = tuple(0 if r.random() < 0.3 else (2 if c == (r.random() < a) else 1) for a in acc)
        pat[k] = pat.get(k, 0) + 1
    prior, est, post = W.fit_em(pat, 4)
    assert abs(prior - 0.2) < 0.03
    for i, a in enumerate(acc):
        right = est[i, 1, 2] / (est[i, 1, 2] + est[i, 1, 1])
        assert abs(right - a) < 0.03
    assert post[(2, 2, 2, 2)] > 0.99 and post[(1, 1, 1, 1)] < 0.01


def corpus():
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for d in range(1200):
        w = [r.choice(vocab) for _ in range(r.randint(30, 200))]
        kind = d % 6
        if kind == 4:
            w = [x + "###" for x in w]
        if kind == 5:
            for _ in range(6):
                w[r.randrange(len(w))] = "zumpf" + r.choice("abcdefgh")
        docs.append((d, " ".join(w), "src%d" % (d % 3)))
        if r.random() < 0.5:
            labels.append((d, 0 if kind == 4 else 1, 1 if kind == 5 else 0))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    known = {x[0] for x in labels}
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = W.fit(df, lab)
    got = {r.doc_id: r for r in W.score(df, m).collect()}
    held = [d for d in range(1200) if d not in known]
    wrong = [d for d in held if got[d]._kept != (d % 6 < 4)]
    assert len(wrong) <= 0.02 * len(held)
    assert set(got[0].asDict()) >= {"doc_id", "text", "source", "_p_junk", "_p_toxic", "_kept"}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (3, "", 3), (3, "", 3), (4, "x " * 300000, 4)],
                                 "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 0, 1), (99, None, None), (4, None, 1)],
                                   "doc_id long, quality int, toxic int")
    m = W.fit(docs, labels)
    assert len(W.score(docs, m).collect()) == 5
    empty_docs = docs.where("false")
    m = W.fit(empty_docs, labels.where("false"))
    assert W.score(empty_docs, m).collect() == []
    assert all(r._kept for r in W.score(docs, m).collect())


def test_the_sample_is_bounded_in_documents_and_bytes(spark, monkeypatch):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    often = df.unionByName(df.where("doc_id < 40").withColumn("text", F.concat("text", F.lit(" more"))).join(spark.range(30).select(), how="cross"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    plain = W.fit_linear
    monkeypatch.setattr(W, "fit_linear", lambda f, t: seen.append(len(f)) or plain(f, t))
    W.fit(often, lab, sample=100)
    assert 0 < max(seen) <= 100
    seen.clear()
    W.fit(df, lab, sample_bytes=20000)
    assert 5 < max(seen) < 100
