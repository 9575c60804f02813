"""What keeps the work of the audit queries in step with their input: what is shuffled,
how often it is parsed, and how many pairs are tried."""
import datetime
import itertools
import random
import re

import pytest

from auditspark.operators import ignore_rules as I
from auditspark.operators import normalize as N
from auditspark.operators import tools as T
from auditspark.plans import fleet
from auditspark.plans import q_findings as QF
from auditspark.plans import q_fleet as QFL
from auditspark.plans import q_more as QM
from auditspark.plans import q_normalize as QN
from auditspark.sources import partials as P

LINEITEM = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
            "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, r = str(tmp_path_factory.mktemp("tables")), random.Random(1)
    rows = [(r.randint(1, 90), r.randint(1, 90), r.randint(1, 9), n % 7 + 1, float(r.randint(1, 50)), float(n), .1, .2, "A", "F",
             datetime.datetime(1995, 1, 1 + n % 28)) for n in range(400)]
    spark.createDataFrame(rows, LINEITEM).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(n,) for n in range(170)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    return d


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _below(plan: str, node: str) -> str:
    return plan[plan.index(node):]


@pytest.mark.parametrize("build", [*[lambda s, d, t=t: QN.tool_reports(s, d, t) for t in QN._TOOLS], QN.mixed_reports, QM.partial_docs])
def test_documents_are_written_behind_the_shuffle(spark, tables, build):
    df = build(spark, tables)
    plan = _optimized(df)
    assert "StructsToJson" in plan and "StructsToJson" not in _below(plan, "RepartitionByExpression")
    assert len(re.findall(r"Exchange (?:hash|round|range)", df._jdf.queryExecution().executedPlan().toString())) == 1
    assert df.count() == df.select("repo_id", "run_id").distinct().count()


def test_folded_rows_travel_before_anything_is_derived(spark, tables):
    for df in (QF.deduped(spark, tables), QF.findings(spark, tables, spread=True)):
        assert "repo" not in _below(_optimized(df), "RepartitionByExpression").replace("repo_id", "")


def test_an_advisory_is_parsed_once(spark):
    reports = spark.createDataFrame([("r", 1, "{}", "npm-audit")], "repo_id string, run_id long, report_json string, tool string")
    for df in (N.npm_audit(reports), N.bun_audit(reports)):
        assert _optimized(df).count("from_json(") == 3  # the report, the advisory and the fix of an item
    for df in (N.bandit(reports), N.gosec(reports)):
        assert _optimized(df).count("get_json_object(") <= 2 and _optimized(df).count("from_json(") == 1


def test_partials_are_parsed_once(spark):
    docs = spark.createDataFrame([("r", 1, "a.json", "{}")], "repo_id string, run_id long, file_name string, json string")
    valid = P.valid_partials(docs)
    for plan in (_optimized(valid), _optimized(T.partial_errors(P.load_partials(docs)[0]))):
        assert plan.count("from_json(") <= 6, plan
        assert not [ln for ln in plan.splitlines() if "Filter" in ln and "from_json(" in ln]


def test_partials_of_all_shapes(spark):
    item = '{"severity":"LOW","line":"3"}'
    docs = [("o.json", f'{{"findings":[{item},"x"],"toolRuns":["npm"]}}'), ("a.json", f" \n\t[{item}]"), ("p.json", f'{{"partialFindings":[{item}]}}'),
            ("n.json", "{}"), ("s.json", '"text"'), ("b.json", "[1"), ("bad name.json", f"[{item}]"), ("z.json", None), ("e.json", "[]"), ("m.json", '{"metadata":{"toolRuns":["bun"]}}')]
    found, errors, tools = P.load_partials(spark.createDataFrame([("r", n, f, j) for n, (f, j) in enumerate(docs)], "repo_id string, run_id long, file_name string, json string"))
    assert sorted((x.run_id, x.ordinal, x.severity, x.line) for x in found.collect()) == [(0, 1, "LOW", "3"), (0, 2, None, None), (1, 1, "LOW", "3"), (2, 1, "LOW", "3")]
    assert {x.run_id: x.error.split(": ")[1][:12] for x in errors.collect()} == {
        3: "there is no ", 4: "the JSON can", 5: "the JSON can", 6: "the name is ", 7: "the JSON can", 9: "there is no "}
    assert sorted((x.run_id, x.tool) for x in tools.collect()) == [(0, "npm audit"), (9, "bun audit")]


def test_patterns_with_a_key_make_no_pairs(spark):
    lines = [f"src/f{n}.js" for n in range(50)] + ["a/", "/b", "c"] + ["*.js", "!*.js"] * 20 + ["lib/x/*.js"]
    rules = I.deciding(I.rules(spark.createDataFrame([("r", "\n".join(lines))], "repo_id string, content string")))
    assert rules.count() == 55 and [(x.negate, x.last) for x in I.runs(rules).collect()] == [(True, 92)]


def test_keys_miss_no_match(spark):
    r = random.Random(3)
    atoms = ["a", "b.c", "*", "?", "**", "a*", "/", "//", ".", "d[1]", "ü", " "]
    pats = sorted({"".join(r.choice(atoms) + r.choice(["", "/"]) for _ in range(r.randint(1, 4))) for _ in range(300)})
    paths = sorted({"".join(x) for n in (1, 2, 3, 4, 5) for x in itertools.islice(itertools.product(["a", "b.c", "/", "d[1]", "ü", "\n"], repeat=n), 400)})
    rules = I.rules(spark.createDataFrame([("r", "\n".join(pats))], "repo_id string, content string"))
    p = spark.createDataFrame([(x,) for x in paths], "path string")
    pairs = rules.where("key is not null").crossJoin(p).where("path rlike regex").withColumn("keys", I.path_keys(p["path"]))
    assert pairs.count() > 100 and pairs.where("not array_contains(keys, key)").count() == 0


def test_later_patterns_decide_across_keyed_and_free_ones(spark):
    lines = ["*.js", "!a/x.js", "a/", "!*/y.js", "a/y.js", "!a/y.js", "q*", "!a/y.js"]
    rules = I.rules(spark.createDataFrame([("r", "\n".join(lines))], "repo_id string, content string"))
    f = spark.createDataFrame([("r", x) for x in ("a/x.js", "a/y.js", "b/x.js", "b/y.js", "a", "c")], "repo_id string, file string")
    got = {x.file: x.suppressed for x in I.flag_ignored(f, rules, defaults=False).collect()}
    assert got == {"a/x.js": True, "a/y.js": False, "b/x.js": True, "b/y.js": False, "a": True, "c": False}


def test_nothing_of_an_ignore_file_is_broadcast(spark):
    files = spark.createDataFrame([("r", "*.js\nsrc/a.js")], "repo_id string, content string").coalesce(1)
    paths = spark.range(3).selectExpr("'r' AS repo_id", "concat('a', id) AS path")  # small enough to be broadcast
    assert "Broadcast" not in I.verdicts(paths, I.rules(files))._jdf.queryExecution().executedPlan().toString()


def test_reports_of_a_fleet_are_read_once_and_findings_folded_once(spark, tables, tmp_path, monkeypatch):
    doc = '[{"RuleID":"x","File":"src/a.js","StartLine":"1","Secret":"abcdef","Match":"k=abcdef"}]'
    spark.createDataFrame([("r", 1, "gitleaks", doc)], "repo_id string, run_id long, tool string, report_json string").write.parquet(f"{tmp_path}/reports")
    files = spark.createDataFrame([("r", "src/a.js", "let x = 1;")], "repo_id string, path string, content string")
    reports = spark.read.parquet(f"{tmp_path}/reports")
    assert _optimized(fleet.merge_findings(spark, files, reports)).count("report_json#") > 0
    relations = [ln for ln in _optimized(fleet.merge_findings(spark, files, reports)).splitlines() if "Relation [" in ln and "report_json" in ln]
    assert len(relations) == 2  # the fold's findings and their references
    kept = []
    monkeypatch.setattr(fleet, "materialize", lambda df: kept.append(df.columns) or df)
    res = fleet.run(spark, files, reports)
    assert len(kept) == 2 and "suppressed" not in kept[0] and "suppressed" in kept[1]
    assert [(x.file, x.source) for x in res.findings.select("file", "source").collect()] == [("src/a.js", "gitleaks")]


def test_paths_of_merged_findings_come_from_one_fold(spark, tables, monkeypatch):
    kept = []
    monkeypatch.setattr(QFL, "materialize", lambda df: kept.append(df.columns) or df)
    assert QFL.flt_ignore_repo(spark, tables).count() == QF.deduped(spark, tables).count()
    assert kept == [["repo_id", "dedup_key", "file"]]


def test_the_sources_of_a_run_are_parsed_once(spark, tmp_path, monkeypatch):
    doc = '[{"RuleID":"x","File":"src/a.js","StartLine":"1","Secret":"abcdef","Match":"k=abcdef"}]'
    spark.createDataFrame([("r", 1, "gitleaks", doc)], "repo_id string, run_id long, tool string, report_json string").write.parquet(f"{tmp_path}/reports")
    files = spark.createDataFrame([("r", "src/a.js", "let x = 1;")], "repo_id string, path string, content string")
    plans, write = [], fleet.materialize
    monkeypatch.setattr(fleet, "written", lambda df: plans.append(_optimized(df)) or write(df))
    monkeypatch.setattr(fleet, "materialize", lambda df: plans.append(_optimized(df)) or write(df))
    res = fleet.run(spark, files, spark.read.parquet(f"{tmp_path}/reports"))
    union, merged, flagged = plans
    assert len([ln for ln in union.splitlines() if "Relation [" in ln and "report_json" in ln]) == 1
    assert "from_json(" not in merged + flagged and "regexp_extract_all(" not in merged
    assert [(x.file, x.references) for x in res.findings.collect()] == [("src/a.js", ["https://github.com/gitleaks/gitleaks"])]


def test_rows_with_much_work_are_dealt_into_a_fixed_number_of_tasks(spark, tables):
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert re.search(rf"RepartitionByExpression \[.*\], {n}\b", _optimized(QN.mixed_reports(spark, tables)))
    files = spark.createDataFrame([("r", "*.js\nsrc/a.js")], "repo_id string, content string")
    paths = spark.range(3).selectExpr("'r' AS repo_id", "concat('a', id) AS path")
    assert len(re.findall(rf"RepartitionByExpression \[.*\], {n}\b", _optimized(I.verdicts(paths, I.rules(files))))) == 4


def test_items_ask_for_their_tool_by_number(spark):
    reports = spark.createDataFrame([("r", 1, "gosec", "{}")], "repo_id string, run_id long, tool string, report_json string")
    plan = _optimized(N.normalize_all(reports))
    columns = plan[:plan.index("+- Project")]
    assert "_tool#" in columns and "tool#" not in columns.replace("_tool#", "")
