"""Registered normaliser queries (section 2.3).

Fixture ``t_reports``: all rows of ``t_findings``, grouped per tool run (``run_id`` =
order key, so a report holds a handful of items at any scale), rendered as JSON in
the tool's own shape with ``to_json``. The oracle reads the expected canonical
columns, all of them, straight from ``t_findings`` (ordinal = position in the
report), without any JSON. ``norm_all`` sends a report of every ninth run to each
tool through the one-pass dispatch.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import normalize as N
from ..sources import bindings as B
from . import sqlfrag as Q
from .registry import register

OUT = [c for c in N.CANON if c != "references"]


def _runs(spark, sf, item_json: str) -> DataFrame:
    """(repo_id, run_id, xs): a run's items in the order of arrival. The table's rows are
    dealt out by run before their JSON is written."""
    f = B.spark_view(spark, sf, "t_findings", by=("repo_id", "run_id")).withColumn("_item", F.expr(item_json))
    return f.groupBy("repo_id", "run_id").agg(F.sort_array(F.collect_list(F.struct("seq", "line", "_item"))).alias("xs"))


def _list(xs: Column, keep=None, brackets: str = "[]") -> Column:
    items = F.transform(xs if keep is None else F.filter(xs, keep), lambda x: x["_item"])
    return F.concat(F.lit(brackets[:1]), F.array_join(items, ","), F.lit(brackets[1:]))


def _select(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("int") if c == "line" else F.col(c) for c in OUT], F.array_join("references", "|").alias("refs"))


_ORD = "(SELECT *, row_number() OVER (PARTITION BY repo_id, run_id ORDER BY seq) AS ord FROM t_findings)"
_NOWHERE = "CAST(NULL AS VARCHAR)"


def _row(source: str, frm: str = _ORD, **cols: str) -> str:
    """SELECT of all canonical columns; what a tool leaves out has its default."""
    default = {"vibe_risk": "FALSE", "confidence": "'TOOL-ONLY'", "refs": "''", "source": f"'{source}'", "repo_id": "repo_id", "run_id": "run_id"}
    return "SELECT " + ", ".join(f"{cols.get(c, default.get(c, _NOWHERE))} AS {c}" for c in [*OUT, "refs"]) + f"\nFROM {frm} x"


A05, A06, A06_AUDIT, A07 = (f"'{x}'" for x in ("A05:2021-Security Misconfiguration", "A06:2021-Vulnerable and Outdated Components",
                                               "A06:2021 - Vulnerable and Outdated Components", "A07:2021-Identification and Authentication Failures"))
_DEP = "'Dependency Vulnerability'"
_CWE_NO = "CASE WHEN cwe = 'N/A' THEN 'N/A' ELSE 'CWE-' || regexp_extract(cwe, '(\\d+)', 1) END"


def _scrub_sql(text: str, *secrets: str) -> str:
    for s_ in secrets:
        text = f"CASE WHEN length({s_}) >= 4 THEN replace({text}, {s_}, '[REDACTED]') ELSE {text} END"
    return text


# ---------------------------------------------------------------- gitleaks
GITLEAKS_ITEM = ("to_json(named_struct('RuleID', CASE WHEN line % 2 = 0 THEN name END, 'Description', CASE WHEN line % 3 = 0 THEN '' ELSE "
                 "concat(category, ' key S3CR', line) END, 'File', replace(file, '/', '\\\\'), "
                 "'StartLine', line, 'Secret', concat('S3CR', line), 'Match', concat('token=S3CR', line)))")
_GL_DESC = "CASE WHEN line % 3 = 0 THEN '' ELSE category || ' key S3CR' || line END"
_GL_SECRETS = ("('S3CR' || line)", "('token=S3CR' || line)")


def gitleaks_doc(xs: Column) -> Column:
    return F.when(F.col("run_id") % 2 == 0, _list(xs)).otherwise(F.concat(F.lit('{"findings":'), _list(xs), F.lit("}")))


GITLEAKS_SQL = _row(
    "gitleaks", id="'GITLEAKS_' || ord", severity="'CRITICAL'", category="'Secrets'",
    name=_scrub_sql(f"'Gitleaks: ' || CASE WHEN line % 2 = 0 THEN name WHEN {_GL_DESC} <> '' THEN {_GL_DESC} ELSE 'hardcoded secret' END", *_GL_SECRETS),
    description=_scrub_sql(f"CASE WHEN {_GL_DESC} <> '' THEN {_GL_DESC} ELSE 'A credential was found in the repository''s content or history.' END", *_GL_SECRETS),
    file="file", line="line", vulnerable_code=Q.redact_secret("('S3CR' || line)"), cwe="'CWE-798'", owasp=A07, vibe_risk="TRUE",
    compliance="'Credential exposure (Gitleaks)'", fix="'Revoke the credential, clean the history and load it from a vault.'",
    exploitation="'Whoever can read the repository can use the credential.'", refs="'https://github.com/gitleaks/gitleaks'")

# ---------------------------------------------------------------- bandit
BANDIT_ITEM = ("to_json(named_struct('filename', file, 'line_number', line, 'issue_severity', severity, "
               "'issue_confidence', confidence, 'issue_text', CASE WHEN line % 4 = 0 THEN '' ELSE category END, 'test_id', concat('B10', line % 10), "
               "'test_name', name, 'issue_cwe', CASE WHEN cwe = 'N/A' THEN NULL ELSE named_struct('id', "
               "CAST(regexp_extract(cwe, '(\\\\d+)', 1) AS INT)) END, 'code', CASE WHEN line % 6 = 0 THEN '' ELSE concat('x = ', line, char(10), 'y') END, "
               "'more_info', CASE WHEN line % 2 = 0 THEN concat('https://b/', line) END))")


def results_doc(xs: Column) -> Column:
    return F.concat(F.lit('{"results":'), _list(xs), F.lit("}"))


_B_CODE = "CASE WHEN line % 6 = 0 THEN '' ELSE 'x = ' || line END"
BANDIT_SQL = _row(
    "bandit", id="'BANDIT_' || ord", severity="severity", category="'Security (Python)'", name="'Bandit B10' || (line % 10) || ': ' || name",
    description="CASE WHEN line % 4 = 0 THEN 'Bandit flagged this statement.' ELSE category END", file="file", line="line",
    vulnerable_code=f"CASE WHEN line % 10 IN (5, 6, 7) THEN {Q.redact_secret('(' + _B_CODE + ')')} WHEN {_B_CODE} <> '' THEN {_B_CODE} ELSE '(no code in the report)' END",
    cwe=_CWE_NO, owasp=A06, compliance="'Bandit ' || confidence || ' confidence'",
    fix="'Use the pattern that Bandit documents for B10' || (line % 10) || '.'",
    refs="CASE WHEN line % 2 = 0 THEN 'https://b/' || line || '|' ELSE '' END || 'https://bandit.readthedocs.io/'")

# ---------------------------------------------------------------- gosec
GOSEC_ITEM = ("to_json(named_struct('severity', lower(severity), 'confidence', confidence, 'cwe', "
              "named_struct('id', CASE WHEN cwe = 'N/A' THEN '' ELSE regexp_extract(cwe, '(\\\\d+)', 1) END), "
              "'rule_id', concat('G10', line % 3), 'details', CASE WHEN line % 4 = 0 THEN '' ELSE category END, 'file', file, "
              "'line', CAST(line AS STRING), 'code', CASE WHEN line % 5 = 0 THEN '' ELSE concat(name, ' := ', line) END))")


def gosec_doc(xs: Column) -> Column:
    return F.concat(F.lit('{"Issues":'), _list(xs), F.lit("}"))


_G_CODE = "CASE WHEN line % 5 = 0 THEN '' ELSE name || ' := ' || line END"
GOSEC_SQL = _row(
    "gosec", id="'GOSEC_' || ord", severity="severity", category="'Security (Go)'", name="'gosec G10' || (line % 3)",
    description="CASE WHEN line % 4 = 0 THEN 'gosec flagged this statement.' ELSE category END", file="file", line="line",
    vulnerable_code=f"CASE WHEN line % 3 = 1 THEN {Q.redact_secret('(' + _G_CODE + ')')} WHEN {_G_CODE} <> '' THEN {_G_CODE} ELSE '(no code in the report)' END",
    cwe=_CWE_NO, owasp=A06, compliance="'gosec ' || confidence || ' confidence'", fix="'Use the API that the gosec rule recommends.'",
    refs="'https://github.com/securego/gosec'")

# ---------------------------------------------------------------- trivy (two results of a run, each with several items of the three kinds)
TRIVY_ITEM = ("CASE line % 3 WHEN 0 THEN to_json(named_struct('ID', concat('AVD-', line), 'Title', name, 'Severity', severity, "
              "'Message', CASE WHEN line % 2 = 0 THEN category END, 'Resolution', CASE WHEN line > 3 THEN concat('set ', line) END, "
              "'References', array(concat('https://t/', line), 'https://t/all'), 'CauseMetadata', named_struct('StartLine', line))) "
              "WHEN 1 THEN to_json(named_struct('VulnerabilityID', concat('CVE-', line), 'PkgName', name, 'InstalledVersion', '1.0', 'FixedVersion', "
              "CASE WHEN line % 2 = 0 THEN '1.1' END, 'Severity', severity, 'Description', CASE WHEN line > 3 THEN category END, 'CweIDs', array(cwe))) "
              "ELSE to_json(named_struct('RuleID', name, 'Severity', severity, 'Title', CASE WHEN line > 3 THEN concat('key ghp_', line, 'abcd') END, "
              "'StartLine', line, 'Match', concat('ghp_', line, 'abcd'))) END")


def trivy_doc(xs: Column) -> Column:
    def result(target: str, high: bool) -> Column:
        def of_kind(k: int):
            return lambda x: ((x["line"] > 3) == F.lit(high)) & (x["line"] % 3 == k)

        kinds = [F.concat(F.lit(f',"{name}":'), _list(xs, of_kind(k))) for k, name in enumerate(("Misconfigurations", "Vulnerabilities", "Secrets"))]
        return F.concat(F.lit(f'{{"Target":"{target}'), F.col("run_id").cast("string"), F.lit('\\\\lock"'), *kinds, F.lit("}"))

    return F.concat(F.lit('{"Results":['), result("low", False), F.lit(","), result("high", True), F.lit("]}"))


_T_ORD = "(SELECT *, line % 3 AS k, row_number() OVER (PARTITION BY repo_id, run_id ORDER BY line > 3, line % 3, seq) AS ord FROM t_findings)"
_T_SECRET = "('ghp_' || line || 'abcd')"
TRIVY_SQL = _row(
    "trivy", _T_ORD, id="CASE k WHEN 0 THEN 'TRIVY_MISCONF_' WHEN 1 THEN 'TRIVY_VULN_' ELSE 'TRIVY_SECRET_' END || ord", severity="severity",
    category=f"CASE k WHEN 0 THEN 'Security Misconfiguration' WHEN 1 THEN {_DEP} ELSE 'Secrets' END",
    name="CASE k WHEN 0 THEN 'Trivy AVD-' || line || ': ' || name WHEN 1 THEN 'Trivy: ' || name || ' CVE-' || line ELSE 'Trivy secret: ' || name END",
    description="CASE k WHEN 0 THEN CASE WHEN line % 2 = 0 THEN category ELSE 'A configuration check of Trivy failed.' END "
                "WHEN 1 THEN CASE WHEN line > 3 THEN category ELSE 'Trivy lists an advisory for this package version.' END "
                "ELSE CASE WHEN line > 3 THEN 'key [REDACTED]' ELSE 'Trivy matched a credential pattern in this file.' END END",
    file="CASE WHEN line > 3 THEN 'high' ELSE 'low' END || run_id || '/lock'", line="CASE k WHEN 1 THEN 1 ELSE line END",
    vulnerable_code="CASE k WHEN 0 THEN CASE WHEN line % 2 = 0 THEN category ELSE '(no message in the report)' END WHEN 1 THEN name || '@1.0' || "
                    f"CASE WHEN line % 2 = 0 THEN ' (fixed in 1.1)' ELSE '' END ELSE {Q.redact_secret(_T_SECRET)} END",
    cwe=f"CASE k WHEN 0 THEN 'N/A' WHEN 1 THEN CASE WHEN {Q.canonical_cwe('cwe')} = '' THEN 'N/A' ELSE {Q.canonical_cwe('cwe')} END ELSE 'CWE-798' END",
    owasp=f"CASE k WHEN 0 THEN {A05} WHEN 1 THEN {A06} ELSE {A07} END", vibe_risk="k = 2",
    compliance="CASE k WHEN 0 THEN 'AVD-' || line WHEN 1 THEN 'CVE-' || line ELSE 'Credential exposure (Trivy)' END",
    fix="CASE k WHEN 0 THEN CASE WHEN line > 3 THEN 'set ' || line ELSE 'Correct the setting as the linked Trivy check describes.' END "
        "WHEN 1 THEN CASE WHEN line % 2 = 0 THEN 'Move ' || name || ' to 1.1 or newer.' ELSE 'Without a fixed release, isolate or drop ' || name || '.' END "
        "ELSE 'Revoke the credential and load it from a vault.' END",
    refs="CASE k WHEN 0 THEN 'https://t/' || line || '|https://t/all' ELSE '' END")


# ---------------------------------------------------------------- opengrep
def _og_item(cwe_expr: str) -> str:
    return ("to_json(named_struct('check_id', concat('rules.', replace(name, ' ', '')), 'path', file, 'start', "
            "named_struct('line', line), 'extra', named_struct('severity', CASE WHEN severity IN ('CRITICAL','HIGH') "
            "THEN 'ERROR' WHEN severity = 'MEDIUM' THEN 'WARNING' ELSE 'INFO' END, 'message', "
            "CASE WHEN line % 4 = 0 THEN '' ELSE concat(category, ' issue') END, 'lines', CASE WHEN line % 5 = 0 THEN '' ELSE concat('code ', line) END, "
            f"'metadata', named_struct('impact', confidence, 'cwe', {cwe_expr}, 'owasp', array('A03:2021'), 'references', "
            "array(concat('https://r/', line)), 'shortlink', CASE WHEN line % 2 = 0 THEN 'https://s/' END, 'vulnerability_class', array(category)))))")


OG_ITEM = f"CASE WHEN line % 2 = 0 THEN {_og_item('array(cwe)')} ELSE {_og_item('cwe')} END"


def opengrep_doc(xs: Column) -> Column:
    errs = F.when(F.col("run_id") % 5 == 0, F.lit('["rule parse error"]')).otherwise(F.lit("[]"))
    skipped = F.when(F.col("run_id") % 3 == 0, F.lit('["a.min.js","b.bin"]')).otherwise(F.lit("[]"))
    return F.concat(F.lit('{"results":'), _list(xs), F.lit(',"errors":'), errs, F.lit(',"paths":{"skipped":'), skipped, F.lit("}}"))


_OG_CWE = f"CASE WHEN {Q.canonical_cwe('cwe')} = '' THEN 'N/A' ELSE {Q.canonical_cwe('cwe')} END"
OPENGREP_SQL = _row(
    "opengrep", id="'OPENGREP_' || ord",
    severity="CASE WHEN severity IN ('CRITICAL','HIGH') THEN CASE WHEN upper(confidence) = 'HIGH' THEN 'CRITICAL' ELSE 'HIGH' END "
             "WHEN severity = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END",
    category="category", name="CASE WHEN line % 4 = 0 THEN 'rules.' || replace(name, ' ', '') ELSE category || ' issue' END",
    description="CASE WHEN line % 4 = 0 THEN 'An OpenGrep rule matched this code.' ELSE category || ' issue' END", file="file", line="line",
    vulnerable_code="CASE WHEN line % 5 = 0 THEN '(no code in the report)' ELSE 'code ' || line END", cwe=_OG_CWE, owasp="'A03:2021'",
    compliance=f"CASE WHEN {_OG_CWE} <> 'N/A' THEN 'Mapped by OpenGrep' ELSE '' END", fix="'Rework the code as the OpenGrep rule advises.'",
    refs="CASE WHEN line % 2 = 0 THEN 'https://s/|' ELSE '' END || 'https://r/' || line")


# ---------------------------------------------------------------- npm / bun audit
def _npm_item() -> str:
    via_obj = ("to_json(named_struct('title', CASE WHEN line % 4 = 0 THEN NULL ELSE concat(category, ' advisory') END, "
               "'cwe', array(cwe), 'url', concat('https://gh/advisories/', line)))")
    fix = ("CASE line % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE to_json(named_struct('name', name, 'version', "
           "'2.0.0', 'isSemVerMajor', line % 2 = 0)) END")
    pkg = "concat(replace(name, ' ', '_'), '-', line)"
    return ("concat('\"k', sha1(to_json(seq)), '\":{\"name\":\"', " + pkg + ", '\"', "
            "',\"severity\":\"', CASE severity WHEN 'MEDIUM' THEN 'moderate' ELSE lower(severity) END, '\"', "
            "',\"isDirect\":', CASE WHEN line % 2 = 0 THEN 'true' ELSE 'false' END, "
            f"',\"via\":[\"dep-a\",', {via_obj}, ']', ',\"range\":\"<2.0\",\"nodes\":[\"node_modules/x\"]', "
            f"',\"fixAvailable\":', {fix}, '}}')")


def npm_doc(xs: Column) -> Column:
    return F.concat(F.lit('{"vulnerabilities":'), _list(xs, brackets="{}"), F.lit("}"))


def _npm_sql(prefix: str, tool: str, file: str, source: str) -> str:
    pkg = "(replace(name, ' ', '_') || '-' || line)"
    return _row(
        source, id=f"'{prefix}' || ord", severity="severity", category=_DEP, name=f"'{tool}: ' || {pkg}",
        description=f"CASE WHEN line % 4 = 0 THEN {pkg} || ' appears in an advisory of {tool}.' ELSE category || ' advisory' END", file=f"'{file}'", line="1",
        vulnerable_code=f"{pkg} || ' <2.0 (' || CASE WHEN line % 2 = 0 THEN 'direct' ELSE 'transitive' END || '); affected nodes: node_modules/x'",
        cwe="cwe", owasp=A06_AUDIT, compliance=f"'Dependency advisory ({tool})'",
        fix=f"'Review ' || {pkg} || CASE line % 3 WHEN 0 THEN '; {tool} names no release without the flaw.' WHEN 1 THEN "
            f"'; {tool} names a fix, take the nearest compatible release.' ELSE ' and update to 2.0.0 once tests pass.' || "
            "CASE WHEN line % 2 = 0 THEN ' That is a major release.' ELSE '' END END",
        refs="'https://gh/advisories/' || line")


NPM_SQL = _npm_sql("NPM_AUDIT_", "npm audit", "package-lock.json", "npm-audit")
BUN_SQL = _npm_sql("BUN_AUDIT_", "bun audit", "bun.lock", "bun-audit")

# ---------------------------------------------------------------- pnpm audit
PNPM_ITEM = ("concat('\"k', sha1(to_json(seq)), '\":', to_json(named_struct("
             "'module_name', replace(name, ' ', '_'), 'severity', lower(severity), 'title', "
             "CASE WHEN line % 3 = 0 THEN NULL ELSE concat(category, ' in mod') END, 'overview', CASE WHEN line % 2 = 0 THEN 'ov' END, "
             "'vulnerable_versions', '<1', 'patched_versions', CASE WHEN line % 2 = 0 THEN '>=1.2' ELSE '<0.0.0' END, "
             "'recommendation', CASE WHEN line % 5 = 0 THEN 'Upgrade now' END, 'cwe', array(cwe), 'url', "
             "concat('https://npm/adv/', line), 'findings', array(named_struct('version', concat('1.0.', line), "
             "'paths', array(concat('.>', replace(name, ' ', '_'))))), 'references', "
             "concat('- https://a/', line, char(10), '- not a url'))))")


def pnpm_doc(xs: Column) -> Column:
    return F.concat(F.lit('{"advisories":'), _list(xs, brackets="{}"), F.lit("}"))


_MOD = "replace(name, ' ', '_')"
PNPM_SQL = _row(
    "pnpm-audit", id="'PNPM_AUDIT_' || ord", severity="severity", category=_DEP, name=f"'pnpm audit: ' || {_MOD}",
    description=f"CASE WHEN line % 3 <> 0 THEN category || ' in mod' WHEN line % 2 = 0 THEN 'ov' ELSE {_MOD} || ' appears in an advisory of pnpm audit.' END",
    file="'pnpm-lock.yaml'", line="1", vulnerable_code=f"{_MOD} || ' 1.0.' || line || '; affected paths: .>' || {_MOD}", cwe="cwe", owasp=A06_AUDIT,
    compliance="'Dependency advisory (pnpm audit)'",
    fix=f"'Review ' || {_MOD} || CASE WHEN line % 5 = 0 THEN '; Upgrade now.' WHEN line % 2 = 0 THEN ' and update to >=1.2 once tests pass.' "
        "ELSE '; no release without the flaw is named.' END",
    refs="'https://npm/adv/' || line || '|https://a/' || line")

# ---------------------------------------------------------------- OSV (two results of a run, a package per item, two advisories of even lines)
OSV_ITEM = ("to_json(named_struct('package', named_struct('name', replace(name, ' ', ''), 'version', "
            "concat('0.', line), 'ecosystem', 'npm'), 'vulnerabilities', concat(array(named_struct('id', "
            "concat('GHSA-', line), 'aliases', array(concat('CVE-', line), cwe), 'summary', "
            "CASE WHEN line % 2 = 0 THEN category END, 'details', CASE WHEN line % 3 = 0 THEN 'long text' END, 'database_specific', named_struct('severity', "
            "CASE WHEN line % 4 = 1 THEN NULL ELSE severity END), 'severity', array(named_struct('type', 'CVSS_V3')), "
            "'references', array(named_struct('url', concat('https://o/', line))), "
            "'affected', array(named_struct('ranges', array(named_struct('events', array(named_struct('fixed', "
            "concat('1.', line))))))))), CASE WHEN line % 2 = 0 THEN array(named_struct('id', concat('EXTRA-', line), 'aliases', "
            "CAST(NULL AS ARRAY<STRING>), 'summary', CAST(NULL AS STRING), 'details', CAST(NULL AS STRING), 'database_specific', named_struct('severity', 'LOW'), "
            "'severity', array(named_struct('type', 'CVSS_V3')), 'references', CAST(NULL AS ARRAY<STRUCT<url:STRING>>), "
            "'affected', CAST(NULL AS ARRAY<STRUCT<ranges:ARRAY<STRUCT<events:ARRAY<STRUCT<fixed:STRING>>>>>>))) ELSE array() END)))")


def osv_doc(xs: Column) -> Column:
    def result(path: str, high: bool) -> Column:
        return F.concat(F.lit(f'{{"source":{{"path":"/work/{path}/'), F.col("run_id").cast("string"), F.lit('","type":"lockfile"},"packages":'),
                        _list(xs, lambda x: (x["line"] > 3) == F.lit(high)), F.lit("}"))

    return F.concat(F.lit('{"results":['), result("low", False), F.lit(","), result("high", True), F.lit("]}"))


_OSV_ORD = ("(SELECT *, row_number() OVER (PARTITION BY repo_id, run_id ORDER BY seq, j) AS ord FROM "
            "(SELECT *, unnest(CASE WHEN line % 2 = 0 THEN [1, 2] ELSE [1] END) AS j FROM t_findings))")
_OSV_NAME = "replace(name, ' ', '')"


def _osv_sql(root: str) -> str:
    path = f"'{root}' || CASE WHEN line > 3 THEN 'high/' ELSE 'low/' END || run_id"
    return _row(
        "osv-scanner", _OSV_ORD, id="'OSV_' || ord", severity="CASE WHEN j = 2 THEN 'LOW' WHEN line % 4 = 1 THEN 'INFO' ELSE severity END", category=_DEP,
        name=f"'OSV: ' || {_OSV_NAME} || CASE j WHEN 1 THEN ' GHSA-' ELSE ' EXTRA-' END || line",
        description="CASE WHEN j = 1 AND line % 2 = 0 THEN category WHEN j = 1 AND line % 3 = 0 THEN 'long text' "
                    "ELSE 'The OSV database lists an advisory for this package.' END",
        file=path, line="1", vulnerable_code=f"'npm:' || {_OSV_NAME} || '@0.' || line || ' from ' || {path}",
        cwe="CASE WHEN j = 1 AND regexp_matches(cwe, '^(?i)CWE-\\d+$') THEN cwe ELSE 'N/A' END", owasp=A06_AUDIT,
        compliance="'Dependency advisory (OSV-Scanner)'",
        fix=f"'Review ' || {_OSV_NAME} || CASE j WHEN 1 THEN ' and update to 1.' || line || ' or newer once tests pass.' "
            "ELSE '; without a fixed release, look for another package.' END",
        refs="'https://osv.dev/' || CASE j WHEN 1 THEN 'GHSA-' || line || '|https://o/' || line ELSE 'EXTRA-' || line END")


# ---------------------------------------------------------------- one query for each tool
_TOOLS = {
    "gitleaks": (GITLEAKS_ITEM, gitleaks_doc, GITLEAKS_SQL), "bandit": (BANDIT_ITEM, results_doc, BANDIT_SQL), "gosec": (GOSEC_ITEM, gosec_doc, GOSEC_SQL),
    "trivy": (TRIVY_ITEM, trivy_doc, TRIVY_SQL), "opengrep": (OG_ITEM, opengrep_doc, OPENGREP_SQL), "npm-audit": (_npm_item(), npm_doc, NPM_SQL),
    "bun-audit": (_npm_item(), npm_doc, BUN_SQL), "pnpm-audit": (PNPM_ITEM, pnpm_doc, PNPM_SQL), "osv-scanner": (OSV_ITEM, osv_doc, _osv_sql("")),
}


def tool_reports(spark, sf, tool: str) -> DataFrame:
    item, doc, _ = _TOOLS[tool]
    return _runs(spark, sf, item).select("repo_id", "run_id", F.lit(tool).alias("tool"), doc(F.col("xs")).alias("report_json"))


def _tool_query(tool: str, **options):
    return lambda spark, sf: _select(N.NORMALIZERS[tool](tool_reports(spark, sf, tool), **options))


for _tool in _TOOLS:
    register("norm_" + {"osv-scanner": "osv"}.get(_tool, _tool.replace("-", "_")), B.with_views(_TOOLS[_tool][2]))(
        _tool_query(_tool, **({"root": "/work"} if _tool == "osv-scanner" else {})))


def mixed_reports(spark, sf) -> DataFrame:
    """Reports of all tools in one table: every ninth run is one tool's."""
    item = "CASE run_id % 9 " + " ".join(f"WHEN {k} THEN {v[0]}" for k, v in enumerate(_TOOLS.values())) + " END"
    doc, tool = None, None
    for k, (t, (_, render, _)) in enumerate(_TOOLS.items()):
        mine = F.col("run_id") % 9 == k
        doc = F.when(mine, render(F.col("xs"))) if doc is None else doc.when(mine, render(F.col("xs")))
        tool = F.when(mine, F.lit(t)) if tool is None else tool.when(mine, F.lit(t))
    return _runs(spark, sf, item).select("repo_id", "run_id", tool.alias("tool"), doc.alias("report_json"))


# the dispatch gives no root: paths stay as they are written
MIXED_SQL = "\nUNION ALL\n".join(f"SELECT * FROM ({_osv_sql('/work/') if t == 'osv-scanner' else v[2]}) WHERE run_id % 9 = {k}" for k, (t, v) in enumerate(_TOOLS.items()))


@register("norm_all", B.with_views(MIXED_SQL))
def norm_all(spark, sf):
    return _select(N.normalize_all(mixed_reports(spark, sf)))


# ---------------------------------------------------------------- diagnostics, failures, positions
@register("norm_opengrep_diag", B.with_views("""SELECT DISTINCT repo_id, run_id,
  CASE WHEN run_id % 5 = 0 THEN 'rule-errors' WHEN run_id % 3 = 0 THEN 'partial-skips' ELSE 'complete' END AS diagnostic,
  CASE WHEN run_id % 5 = 0 THEN 1 ELSE 0 END AS rule_error_count,
  CASE WHEN run_id % 3 = 0 THEN 2 ELSE 0 END AS skipped_count,
  CASE WHEN run_id % 3 = 0 THEN 'a.min.js|b.bin' ELSE '' END AS skipped_reasons
FROM t_findings"""))
def norm_opengrep_diag(spark, sf):
    return N.opengrep_diagnostics(tool_reports(spark, sf, "opengrep"))


@register("norm_tool_failure", B.with_views(f"""SELECT DISTINCT repo_id, run_id,
  CASE run_id % 9 {' '.join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TOOLS))} END AS tool,
  run_id % 7 <> 0 AS available, CASE WHEN run_id % 7 = 0 THEN 'malformed-json' END AS reason
FROM t_findings"""))
def norm_tool_failure(spark, sf):
    r = mixed_reports(spark, sf)
    return N.tool_failures(r.withColumn("report_json", F.when(F.col("run_id") % 7 == 0, F.lit("not json {")).otherwise(F.col("report_json"))))


@register("win_report_ordinal", B.with_views(f"""SELECT repo_id, run_id, id, CAST(regexp_extract(id, '_(\\d+)$', 1) AS BIGINT) AS ordinal
FROM ({MIXED_SQL})"""))
def win_report_ordinal(spark, sf):
    """1-based position of each item in its report, over nested lists too."""
    return N.normalize_all(mixed_reports(spark, sf)).select("repo_id", "run_id", "id", "ordinal")
