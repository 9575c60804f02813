import random

from auditspark.operators import ignore_rules as I
from auditspark.operators.suppress import compile_patterns, parse_ignore
from tests.test_ignore import CASES


def _flag(spark, docs, findings, **kw):
    rules = I.rules(spark.createDataFrame(docs, "repo_id string, content string"))
    f = spark.createDataFrame(findings, "repo_id string, file string, path string, negate int")
    return {(r.repo_id, r.file): r.suppressed for r in I.flag_ignored(f, rules, **kw).collect()}


def test_cases_by_repository(spark):
    docs = [(f"r{i}", "\n".join(p)) for i, (p, _, _) in enumerate(CASES)]
    got = _flag(spark, docs, [(f"r{i}", path, "x", 1) for i, (_, path, _) in enumerate(CASES)], defaults=False)
    for i, (pats, path, want) in enumerate(CASES):
        assert got[f"r{i}", path] is want, (pats, path)


def test_defaults_then_common_then_own(spark):
    docs = [("a", "!dist/keep.js\n# dist/\n\n  \n"), ("b", ""), ("c", None)]
    f = [(r, p, "x", 1) for r in "abcd" for p in ("dist/keep.js", "dist/x.js", "src/a.js", "src/b.js", "")] + [("a", None, "x", 1)]
    got = _flag(spark, docs, f, user_patterns=["src/b.js"])
    for r in "abcd":
        assert [got[r, p] for p in ("dist/keep.js", "dist/x.js", "src/a.js", "src/b.js", "")] == [r != "a", True, False, True, False]
    assert got["a", None] is False


def test_a_thousand_patterns_and_a_hot_repository(spark, monkeypatch):
    import re
    monkeypatch.setattr(I, "CHUNK", 16)
    r = random.Random(4)
    atoms = ["src/", "*.js", "f?.py", "/lib", "a/**/b", "**/x", "!src/keep*", "!f1.py", "d[1]", "a+b", "ü*", "!**/x/y", "/", "!", "**", "a.b/"]
    lines = [r.choice(atoms) + (str(r.randint(0, 9)) if r.random() < .3 else "") for _ in range(1000)]
    parts = ["src", "lib", "a", "b", "x", "keep1", "f1.py", "f2.py", "m.js", "d[1]", "a+b", "üx", "a.b", "y"]
    paths = sorted({"/".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(400)})
    docs = [("big", "\n".join(lines)), ("small", "src/")]
    got = _flag(spark, docs, [("big", p, "x", 1) for p in paths] + [("small", "src/a", "x", 1)] * 3, defaults=False)
    pats = [(n, re.compile(rx.replace("\\z", "\\Z"))) for n, rx in compile_patterns(parse_ignore("\n".join(lines)))]
    for p in paths:
        want = False
        for negate, rx in pats:
            if rx.search(p):
                want = not negate
        assert got["big", p] is want, p
    assert got["small", "src/a"] is True


def test_stars_limit_and_files(spark):
    rules = I.rules(spark.createDataFrame([("r", "a*b*c*\n**/**/x\nb")], "repo_id string, content string"), max_stars=2)
    assert sorted(x.pattern for x in rules.collect()) == ["**/**/x", "b"]
    files = spark.createDataFrame([("r", ".auditignore", "b"), ("r", ".auditignore", "a"), ("r", "sub/.auditignore", "c")], "repo_id string, path string, content string")
    assert [tuple(x) for x in I.ignore_files(files).collect()] == [("r", "a")]


def test_plan_sorts_by_regex_and_never_crosses(spark):
    rules = I.rules(spark.createDataFrame([("r", "a")], "repo_id string, content string"))
    plan = I.verdicts(spark.createDataFrame([("r", "a")], "repo_id string, path string"), rules)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Sort [repo_id" in plan and "max_by" in plan
