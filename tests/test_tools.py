from auditspark.operators import profile as P
from auditspark.operators import tools as T


def test_tool_mode(spark):
    rows = [
        ("all", "opengrep", True, False, "complete"), ("all", "osv-scanner", True, False, None),
        ("all", "package-audit", True, False, None),
        ("skips", "opengrep", True, False, "partial-skips"), ("skips", "osv-scanner", True, False, None),
        ("none", "opengrep", False, False, None), ("none", "osv-scanner", False, False, None),
        ("audit_skipped", "opengrep", True, False, None), ("audit_skipped", "osv-scanner", True, False, None),
        ("audit_skipped", "package-audit", False, True, None),
        ("extra_only", "gitleaks", True, False, None),
    ]
    df = spark.createDataFrame(rows, "repo_id string, tool string, available boolean, skipped boolean, diagnostic string")
    got = {r.repo_id: r.mode for r in T.tool_mode(df).collect()}
    assert got == {"all": "Self-Hosted", "skips": "Hybrid", "none": "Agent-Only", "audit_skipped": "Self-Hosted",
                   "extra_only": "Agent-Only"}


def test_audit_strategy(spark):
    rows = [("pnpm", "package.json"), ("pnpm", "pnpm-lock.yaml"), ("pnpm", "package-lock.json"),
            ("npm", "package.json"), ("npm", "package-lock.json"), ("bun", "package.json"), ("bun", "bun.lockb"),
            ("yarn", "package.json"), ("yarn", "yarn.lock"), ("plain", "package.json"), ("nopkg", "yarn.lock")]
    df = spark.createDataFrame(rows, "repo_id string, path string")
    got = {r.repo_id: (r.manager, r.lockfile, r.skipped) for r in P.audit_strategy(df).collect()}
    assert got == {"pnpm": ("pnpm", "pnpm-lock.yaml", False), "npm": ("npm", "package-lock.json", False),
                   "bun": ("bun", "bun.lockb", False), "yarn": ("yarn", "yarn.lock", True),
                   "plain": ("npm", "package.json", False), "nopkg": (None, None, True)}


def test_partial_validation_messages(spark):
    rows = [("a.json", 1, "HIGH", "c", "n", "d", "f.js", "3", "CWE-1", "fix", "HIGH", "subagent:auth"),
            ("a.json", 2, "HIGH", "c", "n", "", "f.js", "0", "CWE-1", "fix", "HIGH", "tool")]
    df = spark.createDataFrame(rows, "file_name string, ordinal int, severity string, category string, name string, "
                                     "description string, file string, line string, cwe string, fix string, "
                                     "confidence string, source string")
    errs = {r.ordinal: r.errors for r in T.partial_errors(df).collect()}
    assert errs[1] == []
    assert len(errs[2]) == 3 and any('"description"' in e for e in errs[2])
