"""The pipeline's stages against brute force, each on what its predecessor kept."""
import random
import re

import pytest

import corpus_pipeline as P
from auditspark.llm import simhash_pivot, weak_quality


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, text(30)) for k in range(5)] + [(9, None), (None, "")]
    docs, labels = [], []
    for d in range(700):
        t = text(r.randint(40, 150))
        if d % 7 == 4:
            t = t.replace(" ", "### ")
        if d % 7 == 5:
            t = " ".join(w if r.random() > 0.08 else "zumpf" + w[:1] for w in t.split())
        if d % 50 == 0:
            t = t + " " + items[d // 50 % 5][1]
        docs.append((d, t, r.choice(["en", "de", None]), "src%d" % (0 if r.random() < 0.4 else d % 5), len(t)))
        if r.random() < 0.6:
            labels.append((d, 0 if d % 7 == 4 else 1, 1 if d % 7 == 5 else 0))
    for d in range(0, 60):  # copies, near copies and repeated rows
        docs.append((1000 + d, docs[d][1] + (" end" if d % 2 else ""), "en", "src1", 0))
    docs += [docs[1], (2000, None, "en", "src1", 0), (2001, "", None, None, 0), (None, text(50), "en", "src1", 0), (None, items[0][1], "en", "src1", 0)]
    root = str(tmp_path_factory.mktemp("tables"))
    w = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/{name}.parquet")
    w(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    w(labels, "doc_id long, quality int, toxic int", "labels")
    w(items, "item_id long, text string", "benchmark")
    return root, items


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def test_stages(spark, tables):
    root, items = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    # columns of the operators' own names, and one that can't be ordered
    docs = docs.selectExpr("*", "1 AS _kept", "2 AS _key", "3 AS _bad", "4 AS _chosen", "5 AS fp", "6 AS shard", "map(1, 2) AS m")
    cols = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = P.cut(stage(spark, docs, root), f"test-{k}")
        kept[name] = docs.collect(), out.collect()
        if k < len(P.STAGES) - 1:
            assert out.columns == cols
        docs = out
    key_id = lambda r: -1 if r.doc_id is None else r.doc_id
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.text)

    before, after = kept["quality classifier"]
    m = weak_quality.fit(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
    scored = weak_quality.score(spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id long, text string"), m)
    assert sorted(map(key, after), key=repr) == sorted((key(r) for r in scored.where("_kept").collect()), key=repr)
    bad = [r for r in after if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 7 in (4, 5)]
    assert len(bad) <= 4 and len(after) > 0.65 * len(before)

    before, after = kept["SimHash near-dedup"]
    fps = {r.text: simhash_pivot.simhash(None if r.text is None else r.text.encode()) for r in before}
    group = list(range(len(before)))
    def root_of(x):
        while group[x] != x:
            x = group[x]
        return x
    for i, a in enumerate(before):
        for j in range(i):
            if (fps[a.text] ^ fps[before[j].text]).bit_count() <= 2:
                p, q = root_of(i), root_of(j)
                group[max(p, q)] = min(p, q)
    ids = {}
    for i, a in enumerate(before):
        ids.setdefault(root_of(i), []).append(1 << 62 if a.doc_id is None else a.doc_id)
    want = sorted(-1 if min(v) == 1 << 62 else min(v) for v in ids.values())
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in after) == want

    before, after = kept["benchmark decontamination"]
    grams = set()
    for _, t in items:
        q = words(t)
        n = min(10, len(q))
        grams |= {(n, tuple(q[i: i + n])) for i in range(len(q) - n + 1)} if q else set()
    def clean(t):
        w = words(t)
        return not any((n, tuple(w[i: i + n])) in grams for n in {g[0] for g in grams} for i in range(len(w) - n + 1))
    assert sorted(map(key, after), key=repr) == sorted((key(r) for r in before if clean(r.text)), key=repr)
    assert len(after) < len(before)

    before, after = kept["mixing sources"]
    tokens = sum(len((r.text or "").split()) for r in before)
    taken = sum(len(r.text.split()) for r in after)
    assert 0.85 * tokens < taken < tokens and {key(r) for r in after} <= {key(r) for r in before}

    before, after = kept["sharding"]
    assert sorted(key_id(r) for r in after) == sorted(key_id(r) for r in before)
    load = {}
    for r in after:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert max(load.values()) <= sum(load.values()) / P.N_SHARDS + max(r["size"] for r in after)
    for s in load:
        assert sorted(r.slot for r in after if r.shard == s) == list(range(sum(r.shard == s for r in after)))


def test_run_on_empty_tables(spark, tmp_path):
    schema = {"documents": "doc_id long, text string, lang string, source string, n_chars long",
              "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, s in schema.items():
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_mixing_stage_takes_sources_without_a_number(spark):
    odd = ["web", "", "src" + "9" * 30, None, "src5"]
    docs = spark.createDataFrame([(i, "a b c", "en", odd[i % 5]) for i in range(50)], "doc_id long, text string, lang string, source string")
    out = P.mixed(spark, docs, "").collect()
    assert {r.source for r in out} == set(odd) and 45 <= len(out) <= 50


def test_rows_of_one_id_are_judged_one_by_one(spark, tmp_path):
    r = random.Random(3)
    text = lambda: " ".join("w%d" % r.randint(0, 10**6) for _ in range(60))
    leak = text()
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one, two, long = text(), text(), " ".join("v%d" % i for i in range(120000))
    rows = [(1, one), (1, two), (1, two), (2, leak), (2, one + " tail"), (None, leak + " x"), (None, text()), (4, long), (4, long + " end"), (5, None), (5, "")]
    rows += [(7, text()) for _ in range(200)]  # a hot id, all texts different
    docs = spark.createDataFrame([(*x, "en", "src1", 0) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    keys = [x[0] for x in P.keyed(docs)[0].select(P.keyed(docs)[1]).collect()]
    assert len(set(keys)) == len(rows)
    out = P.near_duplicates(spark, docs, str(tmp_path))
    texts = {x.text or "" for x in out.collect()}
    assert two in texts and (one in texts or one + " tail" in texts) and "" in texts
    assert sum(x.doc_id == 7 for x in out.collect()) == 200 and (long in texts) != (long + " end" in texts)
    clean = P.benchmark_free(spark, docs, str(tmp_path)).collect()
    assert sorted((x.doc_id or 0, x.text or "") for x in clean) == sorted((i or 0, t or "") for i, t in rows if leak not in (t or ""))
    assert len(P.mixed(spark, docs, str(tmp_path)).collect()) > 0
