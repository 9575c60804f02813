import random

import pytest
from pyspark.sql import functions as F

from auditspark.llm import mixture as M


def waterfill(budget, caps, weights):
    """Exact shares of one family by steps."""
    left, out, open_ = budget, {}, dict(weights)
    while True:
        w = sum(open_.values())
        full = [c for c in open_ if caps[c] * w <= left * open_[c]]
        if not full:
            break
        for c in full:
            out[c] = caps[c]
        left -= sum(caps[c] for c in full)
        for c in full:
            del open_[c]
        if not open_:
            return out
    w = sum(open_.values())
    share = {c: left * x // w for c, x in open_.items()}
    odd = left - sum(share.values())
    for n, c in enumerate(sorted(share)):
        out[c] = share[c] + (1 if n < odd else 0)
    return out


def docs_of(seed):
    r = random.Random(seed)
    rows = [(i, "w " * r.choice([0, 1, 5, 50]) + "é", r.choice(["en", "de", None]), r.choice(["s1", "s1", "s1", "s2", "s3"])) for i in range(200)]
    rows += [(7, None, "en", "s1"), (8, " \t", "en", "s1"), (None, "a b c", "en", "s1"), (9, "a", "en", None), (9, "a", "en", None), (300, "x " * 40000, "de", "s2")]
    return rows


@pytest.mark.parametrize("seed,share,epochs", [(1, 0.3, 1), (2, 1.7, 3), (3, 5.0, 2)])
def test_budgets_and_prefixes(spark, seed, share, epochs):
    rows = docs_of(seed)
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, lang string, source string, epoch int").repartition(4)
    weights = {"domain": {"A": 3}, "lang": {"en": 2, "de": 0} if seed == 1 else {"en": 2}, "source": {"s2": 5}}
    dom = F.when(F.col("source") == "s1", "A").when(F.col("source") == "s2", "B")
    got = M.mix(df, dom, share, weights, epochs, 5).collect()
    leaf = {}
    for i, t, lang, s in rows:
        n = len((t or "").split())
        if n:
            k = ({"s1": "A", "s2": "B"}.get(s, "(none)"), lang or "(none)", s or "(none)")
            leaf.setdefault(k, []).append(n)
    cap = {k: sum(v) * epochs for k, v in leaf.items() if weights["lang"].get(k[1], 1)}
    total = int(sum(map(sum, leaf.values())) * share)
    want, given = {}, {(): min(total, sum(cap.values()))}
    for lv, name in enumerate(M.LEVELS):
        nxt = {}
        for p, b in given.items():
            kids = sorted({k[: lv + 1] for k in cap if k[:lv] == p})
            caps = {c[-1]: sum(v for k, v in cap.items() if k[: lv + 1] == c) for c in kids}
            for c, x in waterfill(b, caps, {c[-1]: weights.get(name, {}).get(c[-1], 1) for c in kids}).items():
                nxt[(*p, c)] = x
        given = nxt
    took = {}
    for r in got:
        took[(r.domain, r.lang, r.source)] = took.get((r.domain, r.lang, r.source), 0) + r["take"]
        assert 0 < r["take"] <= r.n_tokens and r.epoch < epochs
    assert took == {k: v for k, v in given.items() if v}
    for k in took:  # whole epochs before the last; at most one document is cut
        mine = [r for r in got if (r.domain, r.lang, r.source) == k]
        assert sum(r["take"] < r.n_tokens for r in mine) <= 1
        top = max(r.epoch for r in mine)
        for e in range(top):
            assert sorted(r.n_tokens for r in mine if r.epoch == e) == sorted(leaf[k])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert M.mix(df, F.col("source")).collect() == []


ODD_SOURCES = ["web", "", "src" + "9" * 30, None, "src5"]


def test_sources_without_a_number_have_no_domain(spark, tmp_path):
    from auditspark.llm.queries import op4_mixing_to_target_weights
    rows = [(i, "a b c", "en", ODD_SOURCES[i % 5]) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op4_mixing_to_target_weights(spark, str(tmp_path)).collect()
    assert {(r.source, r.domain) for r in got} == {("web", "(none)"), ("", "(none)"), ("src" + "9" * 30, "(none)"), ("(none)", "(none)"), ("src5", "domain1")}
    assert sum(r.take_tokens for r in got) == 90


def test_very_many_named_weights(spark):
    weights = {"source": {f"s{i} \"'é": i % 5 for i in range(3000)}}
    rows = [(i, "a b c d", "en", f"s{i % 6} \"'é") for i in range(600)] + [(700 + i, "a b", "en", "other") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    took = {}
    for r in M.mix(df, F.lit("d"), 0.5, weights).collect():
        took[r.source] = took.get(r.source, 0) + r["take"]
    # 1200 of 2400 + 200 tokens by weights 1, 2, 3, 4 (a source has 400), and 1 for the one not named (200)
    assert 's0 "\'é' not in took and took['s4 "\'é'] == 400 and took['s3 "\'é'] > took['s2 "\'é'] > took['s1 "\'é'] and sum(took.values()) == 1300
