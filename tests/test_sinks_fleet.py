import json

from pyspark.sql import functions as F

from auditspark.operators import sinks as K
from auditspark.plans import fleet


def _findings(spark):
    rows = [("r", "k1", "CRITICAL", "HIGH", "Injection", "SQL", "src/a.js", 3, "CWE-89", 1),
            ("r", "k2", "LOW", None, "Cross-Site Scripting", "XSS", "./src\\b.js", 0, "cwe-79: x", 2),
            ("r", "k3", "weird", "MEDIUM", "Injection", "SQL 2", "src/c.js", 5, "CWE-89", 3)]
    return spark.createDataFrame(rows, "repo_id string, dedup_key string, severity string, confidence string, "
                                       "category string, name string, file string, line int, cwe string, first_seq int") \
        .withColumn("vibe_risk", F.lit(True)).withColumn("source", F.lit(None).cast("string")) \
        .withColumn("description", F.lit("d")).withColumn("fix", F.lit("do x\nthen y")) \
        .withColumn("owasp", F.lit(None).cast("string")).withColumn("vulnerable_code", F.lit("SECRET-CODE"))


def test_sarif_document(spark):
    docs = K.to_sarif(_findings(spark), max_results=2).collect()
    assert 1 <= len(docs) <= 2                              # hash-chunked: about 2 results per document
    results, rules = [], {}
    for d in docs:
        j = json.loads(d.sarif_json)
        assert j["version"] == "2.1.0"
        run = j["runs"][0]
        results += run["results"]
        for r in run["tool"]["driver"]["rules"]:
            rules[r["id"]] = r
        assert "SECRET-CODE" not in d.sarif_json           # never the code snippet
    assert len(results) == 3
    by_rule = {r["ruleId"]: r for r in results}
    assert set(rules) <= {"CWE-89", "CWE-79"}
    assert rules["CWE-89"]["properties"]["security-severity"] == "9.5"   # first finding of the rule
    x = by_rule["CWE-79"]
    assert x["level"] == "note" and x["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "src/b.js"
    assert x["message"]["text"] == "XSS — d — Remediation: do x"


def test_fleet_run(spark):
    files = spark.createDataFrame([
        ("r1", "src/a.js", 'const password = "hunter2hunter2";\n'),
        ("r1", "dist/b.js", 'const password = "hunter2hunter2";\n'),
        ("r2", "src/c.py", "x = 1\n")], "repo_id string, path string, content string")
    reports = spark.createDataFrame([
        ("r1", 1, "gitleaks", json.dumps([{"RuleID": "pw", "File": "src/a.js", "StartLine": 1,
                                           "Secret": "hunter2hunter2"},
                                          {"RuleID": "pw", "File": "dist/b.js", "StartLine": 1,   # tools see dist/
                                           "Secret": "hunter2hunter2"}]))],
        "repo_id string, run_id long, tool string, report_json string")
    res = fleet.run(spark, files, reports, checkpoint=True)
    f = {(r.repo_id, r.file): r for r in res.findings.collect()}
    assert ("r1", "dist/b.js") not in f                       # default ignore
    assert f[("r1", "src/a.js")].confidence == "CONFIRMED"   # detector + gitleaks on the same line/CWE
    s = {r.repo_id: r for r in res.summary.collect()}
    # r1: one CRITICAL over one audited file (dist/ is not discovered): 100 - 5*25 -> 0
    assert s["r2"].score == 100 and s["r1"].score == 0 and s["r1"].suppressed == 1


def test_merge_order_follows_the_sources(spark):
    """A line that a severer rule matches after another: the severer one comes first."""
    key = "sk_live_" + "4eC39HqLyjWDarjtT1zdp7dc"
    files = spark.createDataFrame([("r", "src/pay.js", f'const password = "{key}";\n')], "repo_id string, path string, content string")
    d = {r.dedup_key: r for r in fleet.merge_findings(spark, files).collect()}
    names = {r.name for r in d.values() if r.cwe == "CWE-798"}
    assert any("Stripe" in n for n in names) and not any("Password" in n for n in names)


def test_sequence_is_typed(spark):
    many = [{"RuleID": "pw", "File": "a.js", "StartLine": 5, "Secret": f"secret-{i}-x"} for i in range(12)]
    reports = spark.createDataFrame([("r", 2, "gitleaks", json.dumps(many)), ("r", 10, "gitleaks", json.dumps(many[:1]))],
                                    "repo_id string, run_id long, tool string, report_json string")
    files = spark.createDataFrame([("r", "b.js", "x\n")], "repo_id string, path string, content string")
    m = fleet.merge_findings(spark, files, reports).collect()
    assert len(m) == 1 and m[0].duplicate_count == 13
    assert (m[0].first_seq.run_id, m[0].first_seq.ordinal) == (2, 1) and m[0].id == "GITLEAKS_1"


def test_partials_are_merged_last(spark):
    item = {"severity": "CRITICAL", "category": "Injection", "name": "SQL", "description": "d", "file": "src/a.js", "line": 1,
            "cwe": "CWE-798", "fix": "f", "confidence": "HIGH", "source": "subagent:auth"}
    docs = spark.createDataFrame([("r1", 1, "auth-1.json", json.dumps({"findings": [item, item | {"line": 0}]}))],
                                 "repo_id string, run_id long, file_name string, json string")
    files = spark.createDataFrame([("r1", "src/a.js", 'const password = "hunter2hunter2";\n')],
                                  "repo_id string, path string, content string")
    res = fleet.run(spark, files, partials=docs)
    f = [r for r in res.findings.collect() if r.cwe == "CWE-798"]
    assert len(f) == 1 and f[0].sources == ["detector", "subagent:auth"] and f[0].first_seq.source_rank == 0
    assert f[0].confidence == "CONFIRMED"


def test_known_findings_and_one_scan(spark):
    files = spark.createDataFrame([("r1", "src/a.js", 'const password = "hunter2hunter2";\n')],
                                  "repo_id string, path string, content string")
    first = fleet.run(spark, files)
    base = first.findings.select("repo_id", "fingerprint")
    res = fleet.run(spark, files, baseline=base)
    assert res.findings.count() == 0 and res.baselined.count() == first.findings.count() > 0
    assert res.summary.first().baselined == res.baselined.count()
    plan = res.summary._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan        # the results read the checkpoint, not the scan
