"""Corroboration fold: exact equality with a straightforward sequential fold,
including hot keys, confirmation bumps and text fall-backs."""
import random

from pyspark.sql import Row

from auditspark.operators.corroborate import deduplicate

SEV = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
CONF = {"CONFIRMED": 5, "TOOL-ONLY": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


def src(f):
    return f.get("source") or "detector"


def sev_rank(s):
    u = (s or "").upper()
    u = "MEDIUM" if u == "MODERATE" else u
    return SEV.get(u, 1)


def brute_fold(items):
    """Sequential fold over one group, as the audited tool does it."""
    cur = None
    for f in items:
        if cur is None:
            cur = dict(f, sources=[src(f)], count=1)
            continue
        sources = set(cur["sources"]) | {src(f)}
        d = sev_rank(f["severity"]) - sev_rank(cur["severity"])
        if d != 0:
            repl = d > 0
        else:
            c = CONF.get((f["confidence"] or "").upper(), 0) - CONF.get((cur["confidence"] or "").upper(), 0)
            repl = c > 0 if c != 0 else (src(f) != "detector" and src(cur) == "detector")
        prim, sec = (f, cur) if repl else (cur, f)
        both = "detector" in sources and any(s != "detector" for s in sources)
        cur = dict(prim, description=prim.get("description") or sec.get("description"),
                   confidence="CONFIRMED" if both else prim["confidence"],
                   source=prim.get("source") or sec.get("source"),
                   sources=sorted(sources), count=cur["count"] + 1)
    return cur


def test_pair_is_confirmed(spark):
    rows = [Row(repo_id="r", seq=1, source=None, file="src/a.js", line=3, severity="HIGH", confidence="HIGH",
                cwe="CWE-89", category="Injection", name="SQL", description="from detector"),
            Row(repo_id="r", seq=2, source="opengrep", file="src/a.js", line=3, severity="HIGH",
                confidence="TOOL-ONLY", cwe="cwe-89", category="Injection", name="sqli", description=None)]
    out = deduplicate(spark.createDataFrame(rows)).collect()
    assert len(out) == 1
    r = out[0]
    assert r.confidence == "CONFIRMED" and r.duplicate_count == 2
    assert r.sources == ["detector", "opengrep"]
    assert r.source == "opengrep" and r.description == "from detector"


def test_fold_equals_brute_force_with_hot_key(spark):
    rnd = random.Random(7)
    sevs = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "moderate", "weird"]
    confs = ["TOOL-ONLY", "HIGH", "MEDIUM", "LOW", "CONFIRMED", None]
    srcs = [None, "", "detector", "opengrep", "gitleaks", "subagent:auth"]
    rows = []
    for i in range(4000):
        hot = rnd.random() < 0.4   # one key holds a large share of all rows
        rows.append(dict(repo_id="r1", seq=i, source=rnd.choice(srcs),
                         file="src/hot.js" if hot else f"src/f{rnd.randint(0, 30)}.js",
                         line=1 if hot else rnd.randint(1, 4), severity=rnd.choice(sevs),
                         confidence=rnd.choice(confs), cwe="CWE-79" if hot else rnd.choice(["CWE-89", "N/A"]),
                         category="Injection", name=f"n{rnd.randint(0, 2)}",
                         description=rnd.choice([None, "", f"d{i}"])))
    df = spark.createDataFrame(rows, "repo_id string, seq long, source string, file string, line int, "
                                     "severity string, confidence string, cwe string, category string, name string, "
                                     "description string")
    got = {r.dedup_key: r for r in deduplicate(df, with_references=False).collect()}
    # group in Python with the same key rule as the engine
    from auditspark.functions import columns as X
    keyed = df.withColumn("k", X.dedup_key("file", "line", "cwe", "category", "name")).collect()
    groups = {}
    for r in sorted(keyed, key=lambda r: r.seq):
        groups.setdefault(r.k, []).append(r.asDict())
    assert set(groups) == set(got)
    for k, items in groups.items():
        exp = brute_fold(items)
        g = got[k]
        assert g.duplicate_count == exp["count"], k
        assert g.primary_seq == exp["seq"], k
        assert g.severity == exp["severity"] and g.confidence == exp["confidence"], k
        assert g.sources == exp["sources"], k
        assert (g.source or None) == (exp.get("source") or None), k
        assert (g.description or None) == (exp.get("description") or None), k


def test_references_ordered_union(spark):
    rows = [Row(repo_id="r", seq=1, source="a", file="f", line=1, severity="LOW", confidence="LOW", cwe="CWE-1",
                category="c", name="n", references=["u1", "u2"]),
            Row(repo_id="r", seq=2, source="b", file="f", line=1, severity="HIGH", confidence="LOW", cwe="CWE-1",
                category="c", name="n", references=["u3", "u1"]),
            Row(repo_id="r", seq=3, source="c", file="f", line=1, severity="LOW", confidence="LOW", cwe="CWE-1",
                category="c", name="n", references=["u4"])]
    r = deduplicate(spark.createDataFrame(rows)).collect()[0]
    # primary (seq 2) first, then the others in arrival order
    assert r.references == ["u3", "u1", "u2", "u4"]
