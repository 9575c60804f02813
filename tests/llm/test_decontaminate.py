import random
import re

import pytest

from auditspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window, slop):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, it in items:
            q = words(it)
            k = min(window, len(q))
            for a in range(len(q) - k + 1 if q else 0):
                g = q[a: a + k]
                for s in range(-slop, len(w) + slop):
                    if all(any(0 <= p < len(w) and w[p] == x for p in range(s + j - slop, s + j + slop + 1)) for j, x in enumerate(g)):
                        hit.update(p for p in range(max(0, s - slop), min(len(w), s + k + slop)))
                        if item is not None:
                            found.add(str(item))
        out.append((-1 if i is None else i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


def case(seed):
    r = random.Random(seed)
    vocab = ["a", "B", "ç", "d1", "éé", "f"]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(1, 14)))) for k in range(8)]
    items += [(20, None), (21, ""), (22, "--"), (None, "f f f d1"), (3, items[3][1]), (30, "longer item that holds a few rare words indeed"),
              (31, "LONGER item, that")]
    docs = [(k, ", ".join(r.choice(vocab) for _ in range(r.randint(0, 40)))) for k in range(40)]
    docs += [(100, None), (100, ""), (None, items[0][1]), (101, "x " + items[30 - 17][1] if items[13][1] else "x"),
             (102, "Longer ITEM that holds; a few rare words indeed"), (103, "longer-item-that-holds"), (103, "y")]
    return docs, items


@pytest.mark.parametrize("window,slop,query_bytes", [(10, 0, 1 << 20), (3, 0, 40), (3, 1, 1 << 20), (2, 2, 60)])
def test_against_brute_force(spark, monkeypatch, window, slop, query_bytes):
    monkeypatch.setattr(D, "QUERY_BLOCK_BYTES", query_bytes)
    docs, items = case(window)
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    bm = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(df, bm, window=window, slop=slop).collect()
    assert sorted((-1 if r.id is None else r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute(docs, items, window, slop)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bm = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in D.decontaminate(docs, bm).collect()] == [(2, 0, [])]
    assert D.decontaminate(docs.where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
