"""Registered queries over findings: corroboration, suppression, projections,
aggregates, top-k, sets (sections 2.4 - 2.10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import columns as X
from ..operators import corroborate as D
from ..operators import normalize as N
from ..operators import reports as R
from ..operators import suppress as SP
from ..operators.numbering import positions
from ..sources import bindings as B
from . import sqlfrag as Q
from .registry import register

# ---------------------------------------------------------------- spark side


def findings(spark, sf, spread=False):
    return B.spark_view(spark, sf, "t_findings", spread=spread)


def deduped(spark, sf):
    # the table is one file: its rows are dealt out before anything is derived from them
    return D.deduplicate(findings(spark, sf, spread=True), with_references=False)


def final(spark, sf):
    kept, _ = SP.apply_ignore(deduped(spark, sf))
    return kept


# ---------------------------------------------------------------- oracle side

def _fold_sql(table: str = "t_findings", refs: str | None = None) -> str:
    """The sequential fold, finding by finding in the order of ``seq``; with ``refs``, also
    the references in the order in which the merges put them (repeats included)."""
    cr = lambda e: Q.confidence_rank(e)
    fs = lambda e: Q.finding_source(e)
    repl = (f"(x.sev_r > c.sev_r OR (x.sev_r = c.sev_r AND ({cr('x.conf')} > {cr('c.conf')} OR "
            f"({cr('x.conf')} = {cr('c.conf')} AND {fs('x.src')} <> 'detector' AND {fs('c.src')} = 'detector'))))")
    srcs = "list_distinct(list_concat(c.srcs, x.srcs))"
    both = f"(list_contains({srcs}, 'detector') AND len({srcs}) > 1)"
    fields = ["sev_r", "severity", "category", "name", "file", "line", "cwe", "pseq"]
    src = (f"CASE WHEN {repl} THEN (CASE WHEN {Q.nonempty('x.src')} THEN x.src ELSE c.src END) "
           f"ELSE (CASE WHEN {Q.nonempty('c.src')} THEN c.src ELSE x.src END) END")
    body = ", ".join([f"{f_} := CASE WHEN {repl} THEN x.{f_} ELSE c.{f_} END" for f_ in fields] + [
        f"conf := CASE WHEN {both} THEN 'CONFIRMED' WHEN {repl} THEN x.conf ELSE c.conf END",
        f"src := {src}", f"srcs := {srcs}", "cnt := c.cnt + 1", "first_seq := c.first_seq"] + ([
            f"refs := CASE WHEN {repl} THEN list_concat(x.refs, c.refs) ELSE list_concat(c.refs, x.refs) END"] if refs else []))
    elem = (f"struct_pack(sev_r := {Q.severity_rank('severity')}, severity := severity, category := category, "
            f"name := name, file := file, line := line, cwe := cwe, pseq := seq, conf := confidence, src := source, "
            f"srcs := [{fs('source')}], cnt := CAST(1 AS BIGINT), first_seq := seq" + (f", refs := {refs})" if refs else ")"))
    return f"""SELECT repo_id, dedup_key, r.severity, r.category, r.name, r.file, r.line, r.cwe, r.conf AS confidence,
  r.src AS source, list_sort(r.srcs) AS sources, r.cnt AS duplicate_count, r.first_seq, r.pseq AS primary_seq{", r.refs" if refs else ""}
FROM (SELECT repo_id, dedup_key, list_reduce(xs, lambda c, x: struct_pack({body})) AS r
      FROM (SELECT repo_id, {Q.dedup_key()} AS dedup_key, list({elem} ORDER BY seq) AS xs
            FROM {table} GROUP BY ALL))"""


def ignore_sql(col: str, patterns: list[str]) -> str:
    p = f"regexp_replace(replace({Q.js_trim(Q.s(col))}, '\\', '/'), '^\\./', '')"
    whens = " ".join(f"WHEN regexp_matches({p}, {Q.q(rx)}) THEN {'FALSE' if neg else 'TRUE'}"
                     for neg, rx in reversed(SP.compile_patterns(patterns)) if rx != SP.NEVER)
    return f"(CASE WHEN {p} = '' THEN FALSE {whens} ELSE FALSE END)"


DEDUP_CTES = [("t_dedup", _fold_sql()),
              ("t_final", f"SELECT * FROM t_dedup WHERE NOT {ignore_sql('file', C.DEFAULT_IGNORE_PATTERNS)}")]


def sqlv(sql: str, dedup: bool = False) -> str:
    extra = list(DEDUP_CTES) if dedup else []
    if "t_baseline" in sql:
        extra.append(("t_baseline", f"SELECT DISTINCT repo_id, {Q.fingerprint()} AS fingerprint FROM t_findings "
                                    f"WHERE detected_at < TIMESTAMP '{B.BASELINE_CUTOFF}'"))
    return B.with_views(sql, extra)


# ---------------------------------------------------------------- corroboration

DEDUP_COLS = ["repo_id", "dedup_key", "severity", "confidence", "source", "sources", "duplicate_count", "file",
              "line", "cwe", "category", "name"]


@register("agg_dedup", sqlv("SELECT repo_id, dedup_key, severity, confidence, source, array_to_string(sources, ',') "
                            "AS sources, duplicate_count, file, line, cwe, category, name FROM t_dedup", True))
def agg_dedup(spark, sf):
    d = deduped(spark, sf)
    return d.select(*[F.concat_ws(",", "sources").alias("sources") if c == "sources" else c for c in DEDUP_COLS])


@register("prj_dedup_key", sqlv(f"SELECT repo_id, file, line, {Q.dedup_key()} AS dedup_key FROM t_findings"))
def prj_dedup_key(spark, sf):
    return findings(spark, sf).select("repo_id", "file", "line",
                                      X.dedup_key("file", "line", "cwe", "category", "name").alias("dedup_key"))


@register("prj_fingerprint", sqlv(f"SELECT repo_id, file, line, {Q.fingerprint()} AS fingerprint FROM t_findings"))
def prj_fingerprint(spark, sf):
    return findings(spark, sf).select("repo_id", "file", "line",
                                      X.fingerprint("file", "cwe", "category", "name").alias("fingerprint"))


RANKS_SQL = ("CASE source WHEN 'detector' THEN 0 WHEN 'opengrep' THEN 1 WHEN 'npm-audit' THEN 2 WHEN 'osv-scanner' THEN 3 "
             "WHEN 'gitleaks' THEN 4 WHEN 'trivy' THEN 4 ELSE 5 END")


@register("set_union_findings", sqlv(f"""SELECT repo_id, source, CAST(source_rank AS INTEGER) AS source_rank, n, files, first_key FROM (
  SELECT repo_id, source, {RANKS_SQL} AS source_rank, count(*) AS n, count(DISTINCT file) AS files,
    arg_min({Q.dedup_key()}, seq) AS first_key FROM t_findings GROUP BY ALL)"""))
def set_union_findings(spark, sf):
    """The ordered union of the six kinds of sources, and what comes first of each."""
    f = findings(spark, sf)
    tools = {k: [t for t in D.SOURCE_TOOLS[k]] for k in D.SOURCE_ORDER}
    known = [t for ts in tools.values() for t in ts]
    parts = {k: f.where(F.col("source").isin(*ts) if ts else ~F.coalesce(F.col("source"), F.lit("")).isin(*known)) for k, ts in tools.items()}
    u = D.ordered_union(parts, {k: [F.col("seq").alias("at")] for k in parts})
    key = X.dedup_key("file", "line", "cwe", "category", "name")
    return u.groupBy("repo_id", "source", F.col("seq.source_rank").alias("source_rank")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"), F.min_by(key, "seq").alias("first_key"))


# ---------------------------------------------------------------- suppression

@register("flt_ignore", sqlv(f"""SELECT repo_id, dedup_key, file,
  {ignore_sql('file', C.DEFAULT_IGNORE_PATTERNS + ['test/', '!test/f1*.js', 'apps/**/f3?.js'])} AS suppressed
FROM t_dedup""", True))
def flt_ignore(spark, sf):
    pats = C.DEFAULT_IGNORE_PATTERNS + ["test/", "!test/f1*.js", "apps/**/f3?.js"]
    d = deduped(spark, sf)
    return d.select("repo_id", "dedup_key", "file", SP.is_ignored(SP.ignore_path("file"), pats).alias("suppressed"))


@register("flt_baseline", sqlv(f"""SELECT repo_id, dedup_key, fp IN (SELECT fingerprint FROM t_baseline b
  WHERE b.repo_id = d.repo_id) AS baselined FROM (SELECT *, {Q.fingerprint()} AS fp FROM t_final) d""", True))
def flt_baseline(spark, sf):
    f = SP.flag_baseline(final(spark, sf), B.spark_view(spark, sf, "t_baseline"))
    return f.select("repo_id", "dedup_key", F.col("known").alias("baselined"))


@register("jn_baseline", sqlv(f"""SELECT repo_id, count(*) FILTER (WHERE NOT known) AS new_findings,
  count(*) FILTER (WHERE known) AS baselined FROM (SELECT d.repo_id, b.fingerprint IS NOT NULL AS known
  FROM (SELECT *, {Q.fingerprint()} AS fp FROM t_final) d LEFT JOIN t_baseline b
  ON b.repo_id = d.repo_id AND b.fingerprint = d.fp) GROUP BY repo_id""", True))
def jn_baseline(spark, sf):
    f = SP.flag_baseline(final(spark, sf), B.spark_view(spark, sf, "t_baseline"))
    return f.groupBy("repo_id").agg(F.count_if(~F.col("known")).alias("new_findings"), F.count_if("known").alias("baselined"))


@register("set_new_vs_known", sqlv(f"""SELECT d.repo_id, d.dedup_key, d.severity, 'new' AS status
FROM (SELECT *, {Q.fingerprint()} AS fp FROM t_final) d
WHERE NOT EXISTS (SELECT 1 FROM t_baseline b WHERE b.repo_id = d.repo_id AND b.fingerprint = d.fp)
UNION ALL
SELECT d.repo_id, d.dedup_key, d.severity, 'known' FROM (SELECT *, {Q.fingerprint()} AS fp FROM t_final) d
WHERE EXISTS (SELECT 1 FROM t_baseline b WHERE b.repo_id = d.repo_id AND b.fingerprint = d.fp)""", True))
def set_new_vs_known(spark, sf):
    f = SP.flag_baseline(final(spark, sf), B.spark_view(spark, sf, "t_baseline"))
    return f.select("repo_id", "dedup_key", "severity", F.when(F.col("known"), "known").otherwise("new").alias("status"))


@register("snk_baseline", sqlv(f"""SELECT repo_id, fingerprint, arg_min(severity, first_seq) AS severity,
  arg_min(file, first_seq) AS file, arg_min(name, first_seq) AS name
FROM (SELECT *, {Q.fingerprint()} AS fingerprint FROM t_final) GROUP BY repo_id, fingerprint""", True))
def snk_baseline(spark, sf):
    return SP.baseline_entries(final(spark, sf))


@register("src_load_baseline", sqlv("SELECT DISTINCT repo_id, fingerprint FROM t_baseline"))
def src_load_baseline(spark, sf):
    """Baseline documents in both accepted shapes (bare array / {fingerprints}),
    one small document per known fingerprint, parsed back into rows."""
    from ..sources import reports as RS
    b = B.spark_view(spark, sf, "t_baseline")
    arr = F.array("fingerprint")
    docs = b.select("repo_id", F.when(F.length("fingerprint") % 2 == 0, F.to_json(arr))
                    .otherwise(F.to_json(F.struct(F.lit(1).alias("version"), arr.alias("fingerprints"))))
                    .alias("json"))
    return RS.load_baseline(docs)


# ---------------------------------------------------------------- projections

MIXED_SEV_SQL = ("CASE line % 4 WHEN 0 THEN severity WHEN 1 THEN 'error' WHEN 2 THEN 'Warning' "
                 "ELSE CASE WHEN line % 8 = 3 THEN 'informational' ELSE 'moderate' END END")


def _mixed_sev():
    m = F.col("line") % 4
    return (F.when(m == 0, F.col("severity")).when(m == 1, F.lit("error")).when(m == 2, F.lit("Warning"))
            .otherwise(F.when(F.col("line") % 8 == 3, F.lit("informational")).otherwise(F.lit("moderate"))))


@register("prj_severity", sqlv(f"""SELECT repo_id, file, line, {Q.severity_audit(MIXED_SEV_SQL)} AS sev_audit,
  {Q.case_map("upper(" + MIXED_SEV_SQL + ")", {'CRITICAL': 'CRITICAL', 'HIGH': 'HIGH', 'MEDIUM': 'MEDIUM',
      'LOW': 'LOW', 'INFO': 'INFO', 'ERROR': 'HIGH', 'WARNING': 'MEDIUM', 'UNKNOWN': 'LOW', 'INFORMATIONAL': 'INFO'}, "'MEDIUM'")} AS sev_tool,
  CASE WHEN upper({MIXED_SEV_SQL}) = 'ERROR' THEN (CASE WHEN upper(confidence) = 'HIGH' THEN 'CRITICAL' ELSE 'HIGH' END)
       WHEN upper({MIXED_SEV_SQL}) = 'WARNING' THEN 'MEDIUM' ELSE 'LOW' END AS sev_opengrep,
  CASE WHEN upper({MIXED_SEV_SQL}) IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN upper({MIXED_SEV_SQL})
    ELSE 'MEDIUM' END AS sev_sarif FROM t_findings"""))
def prj_severity(spark, sf):
    f = findings(spark, sf).withColumn("_v", _mixed_sev())
    return f.select("repo_id", "file", "line", X.severity_audit("_v").alias("sev_audit"),
                    X.severity_tool("_v").alias("sev_tool"),
                    X.severity_opengrep("_v", "confidence").alias("sev_opengrep"),
                    X.severity_sarif("_v").alias("sev_sarif"))


@register("prj_cwe", sqlv(f"SELECT repo_id, cwe, {Q.canonical_cwe('cwe')} AS cwe_key, CASE WHEN "
                          f"{Q.canonical_cwe('cwe')} = '' THEN 'N/A' ELSE {Q.canonical_cwe('cwe')} END AS cwe_tool "
                          "FROM t_findings"))
def prj_cwe(spark, sf):
    return findings(spark, sf).select("repo_id", "cwe", X.canonical_cwe("cwe").alias("cwe_key"),
                                      X.tool_cwe("cwe").alias("cwe_tool"))


@register("prj_line", sqlv("SELECT repo_id, line, CASE WHEN line - 3 > 0 THEN line - 3 ELSE 1 END AS tool_line, "
                           "CAST(coalesce(CAST(NULLIF(line, 2) AS BIGINT), 0) AS VARCHAR) AS key_line FROM t_findings"))
def prj_line(spark, sf):
    f = findings(spark, sf)
    return f.select("repo_id", "line", X.tool_line(F.col("line") - 3).alias("tool_line"),
                    X.key_line(F.nullif(F.col("line"), F.lit(2))).alias("key_line"))


@register("prj_path", sqlv(f"""SELECT repo_id, file,
  regexp_replace(replace({Q.js_trim("('./' || replace(file, '/', '\\') || ' ')")}, '\\', '/'), '^\\./', '') AS norm_path,
  {Q.key_part("('  ' || upper(file) || '  x')")} AS key_path FROM t_findings"""))
def prj_path(spark, sf):
    f = findings(spark, sf)
    messy = F.concat(F.lit("./"), F.regexp_replace("file", "/", "\\\\"), F.lit(" "))
    return f.select("repo_id", "file", X.norm_path(messy).alias("norm_path"),
                    X.key_part(F.concat(F.lit("  "), F.upper("file"), F.lit("  x"))).alias("key_path"))


@register("prj_compliance", sqlv(f"SELECT repo_id, cwe, {Q.case_map(Q.canonical_cwe('cwe'), C.COMPLIANCE_MAP, chr(39)*2)} "
                                 "AS compliance FROM t_findings"))
def prj_compliance(spark, sf):
    return findings(spark, sf).select("repo_id", "cwe", X.compliance(X.canonical_cwe("cwe")).alias("compliance"))


@register("prj_owasp", sqlv(f"SELECT repo_id, category, {Q.case_map('category', C.OWASP_CATEGORY_MAP, 'NULL')} AS owasp FROM t_findings"))
def prj_owasp(spark, sf):
    f = findings(spark, sf).withColumn("owasp", F.lit(None).cast("string"))
    return f.select("repo_id", "category", X.owasp_code("owasp", "category").alias("owasp"))


def _owasp_url_sql(o):
    num = f"TRY_CAST(regexp_extract({o}, 'A(\\d{{2}}):(\\d{{4}})', 1) AS INTEGER)"
    pages = "[" + ",".join(Q.q(p) for p in C.OWASP_TOP10_PAGES) + "]"
    return (f"CASE WHEN {o} = '' THEN '' WHEN {num} BETWEEN 1 AND 10 THEN 'https://owasp.org/Top10/' || "
            f"{pages}[{num}] || '/' ELSE 'https://owasp.org/Top10/' END")


@register("prj_reference_urls", sqlv(f"""SELECT repo_id, cwe, category,
  CASE WHEN regexp_extract(cwe, '(?i)CWE-(\\d+)', 1) <> '' THEN 'https://cwe.mitre.org/data/definitions/' ||
    regexp_extract(cwe, '(?i)CWE-(\\d+)', 1) || '.html' ELSE '' END AS cwe_url,
  {_owasp_url_sql(Q.case_map('category', C.OWASP_CATEGORY_MAP, "''"))} AS owasp_url
FROM t_findings"""))
def prj_reference_urls(spark, sf):
    f = findings(spark, sf)
    return f.select("repo_id", "cwe", "category", X.cwe_url("cwe").alias("cwe_url"),
                    X.owasp_url(X.owasp_code(F.lit(None).cast("string"), "category")).alias("owasp_url"))


@register("prj_source_label", sqlv(f"""SELECT source, {Q.case_map(Q.finding_source('source'), C.SOURCE_LABELS,
    Q.finding_source('source'))} AS label, count(*) AS n FROM t_findings GROUP BY ALL"""))
def prj_source_label(spark, sf):
    return findings(spark, sf).groupBy("source", X.source_label("source").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@register("prj_redact", sqlv(f"SELECT repo_id, name, {Q.redact_secret('name')} AS redacted, "
                             f"{Q.redact_secret('substr(name, 1, 4)')} AS redacted_short FROM t_findings"))
def prj_redact(spark, sf):
    f = findings(spark, sf)
    return f.select("repo_id", "name", X.redact_secret("name").alias("redacted"),
                    X.redact_secret(F.substring("name", 1, 4)).alias("redacted_short"))


@register("prj_downgrade", sqlv(f"""SELECT repo_id, file, line,
  CASE WHEN severity <> 'INFO' AND {Q.non_source('file')} THEN 'LOW' ELSE severity END AS severity,
  CASE WHEN severity <> 'INFO' AND {Q.non_source('file')} THEN 'LOW' ELSE confidence END AS confidence,
  {Q.non_source('file')} AS non_source FROM t_findings WHERE source = 'detector'"""))
def prj_downgrade(spark, sf):
    f = findings(spark, sf).where(F.col("source") == "detector")
    down = (F.col("severity") != "INFO") & X.non_source("file")
    return f.select("repo_id", "file", "line", F.when(down, "LOW").otherwise(F.col("severity")).alias("severity"),
                    F.when(down, "LOW").otherwise(F.col("confidence")).alias("confidence"),
                    X.non_source("file").alias("non_source"))


def _sarif_rule_sql():
    cw = Q.canonical_cwe("cwe")
    cat = Q.js_trim(Q.s("category"))
    return (f"CASE WHEN {cw} <> '' THEN {cw} WHEN {cat} <> '' THEN regexp_replace({cat}, '{Q.WS}+', '-', 'g') "
            f"ELSE 'auditspark-finding' END")


@register("prj_sarif_fields", sqlv(f"""SELECT repo_id, dedup_key, {_sarif_rule_sql()} AS rule_id,
  {Q.case_map("CASE WHEN upper(" + Q.s('severity') + ") IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN upper(severity) ELSE 'MEDIUM' END", C.SARIF_LEVEL, "'warning'")} AS level,
  {Q.case_map("CASE WHEN upper(" + Q.s('severity') + ") IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN upper(severity) ELSE 'MEDIUM' END", C.SECURITY_SEVERITY, "'5.0'")} AS security_severity,
  coalesce(NULLIF(name, ''), 'Security finding') AS message, greatest(1, coalesce(line, 1)) AS start_line,
  lower(regexp_replace(replace(file, '\\', '/'), '^\\./', '')) || ':' ||
    CASE WHEN {Q.canonical_cwe('cwe')} <> '' THEN {Q.canonical_cwe('cwe')} ELSE lower(category) END || ':' ||
    regexp_replace(lower({Q.js_trim(Q.s('name'))}), '{Q.WS}+', ' ', 'g') AS fingerprint
FROM t_final""", True))
def prj_sarif_fields(spark, sf):
    f = final(spark, sf)
    return f.select("repo_id", "dedup_key", X.sarif_rule_id("cwe", "category").alias("rule_id"),
                    X.sarif_level("severity").alias("level"), X.security_severity("severity").alias(
                        "security_severity"),
                    X.sarif_message("name", "description", "fix").alias("message"),
                    F.greatest(F.lit(1), F.coalesce("line", F.lit(1))).alias("start_line"),
                    X.sarif_fingerprint("file", "cwe", "category", "name").alias("fingerprint"))


@register("prj_triage", sqlv("""SELECT repo_id, dedup_key,
  CASE WHEN severity = 'CRITICAL' AND (contains(category, 'Injection') OR contains(category, 'XSS')) THEN 'Medium'
       WHEN severity = 'CRITICAL' THEN 'High' WHEN severity = 'HIGH' THEN 'Medium' ELSE 'Low' END AS effort,
  """ + Q.case_map("severity", R.IMPACTS, Q.q(R.OTHER_IMPACT)) + " AS impact, " + Q.q(R.NO_FIX) +
                                  " AS fix_summary FROM t_final", True))
def prj_triage(spark, sf):
    return R.triage(final(spark, sf)).select("repo_id", "dedup_key", "effort", "impact", "fix_summary")


# ---------------------------------------------------------------- filters

@register("flt_gate", sqlv("SELECT repo_id, dedup_key, severity FROM t_final WHERE severity IN ('CRITICAL', 'HIGH')",
                           True))
def flt_gate(spark, sf):
    return R.gate_findings(final(spark, sf), "high").select("repo_id", "dedup_key", "severity")


@register("flt_report", sqlv("SELECT repo_id, dedup_key FROM t_final WHERE severity IN ('CRITICAL','MEDIUM') AND "
                             "category IN ('Injection','Cross-Site Scripting') AND contains(lower(file), 'f1')", True))
def flt_report(spark, sf):
    f = R.report_filter(final(spark, sf), ["CRITICAL", "MEDIUM"], ["Injection", "Cross-Site Scripting"], "F1")
    return f.select("repo_id", "dedup_key")


# ---------------------------------------------------------------- aggregates

def _counts_sql(src="t_final", g="repo_id"):
    return ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in C.SEVERITIES)


@register("agg_severity_counts", sqlv(f"SELECT repo_id, {_counts_sql()} FROM t_final GROUP BY repo_id", True))
def agg_severity_counts(spark, sf):
    return R.severity_counts(final(spark, sf))


@register("agg_severity_points", sqlv("SELECT repo_id, " + ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') * {C.SEVERITY_WEIGHTS[s]} AS {s.lower()}_points"
    for s in C.SEVERITIES) + " FROM t_final GROUP BY repo_id", True))
def agg_severity_points(spark, sf):
    return R.severity_points(final(spark, sf))


@register("agg_category", sqlv(f"SELECT repo_id, category, count(*) AS total, {_counts_sql()}, "
                               "count(DISTINCT file) AS files FROM t_final GROUP BY repo_id, category", True))
def agg_category(spark, sf):
    return R.category_breakdown(final(spark, sf))


@register("agg_category_counts", sqlv("SELECT repo_id, category, count(*) AS count FROM t_final GROUP BY ALL", True))
def agg_category_counts(spark, sf):
    return R.category_counts(final(spark, sf))


@register("agg_top_category", sqlv("""SELECT repo_id, arg_min(category, (-n, fs)) AS top_category, max(n) AS count
FROM (SELECT repo_id, category, count(*) AS n, min(first_seq) AS fs FROM t_final GROUP BY ALL) GROUP BY repo_id""",
                                   True))
def agg_top_category(spark, sf):
    return R.top_category(final(spark, sf))


@register("agg_confidence", sqlv("SELECT repo_id, " + ", ".join(
    f"count(*) FILTER (WHERE coalesce(NULLIF(upper(confidence), ''), 'MEDIUM') = '{k}') AS "
    f"{k.lower().replace('-', '_')}" for k in ["CONFIRMED", "TOOL-ONLY", "HIGH", "MEDIUM", "LOW"])
    + " FROM t_final GROUP BY repo_id", True))
def agg_confidence(spark, sf):
    return R.confidence_counts(final(spark, sf))


@register("agg_origin", sqlv("""SELECT s.repo_id, s.source, s.count, t.total, t.confirmed, """ +
                             Q.case_map('s.source', C.SOURCE_LABELS, 's.source') + """ AS label
FROM (SELECT repo_id, src AS source, count(*) AS count FROM (SELECT repo_id, unnest(list_distinct(sources)) AS src
      FROM t_final) GROUP BY ALL) s
JOIN (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE upper(confidence) = 'CONFIRMED'
      OR len(list_distinct(sources)) > 1) AS confirmed FROM t_final GROUP BY repo_id) t USING (repo_id)""", True))
def agg_origin(spark, sf):
    return D.origin_breakdown(final(spark, sf)).select("repo_id", "source", "count", "total", "confirmed", "label")


@register("agg_headline", sqlv("SELECT repo_id, count(*) AS total, count(DISTINCT file) AS files, CAST(0 AS BIGINT) AS vibe_risk, "
                               + _counts_sql() + ", " + ", ".join(
                                   f"round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE severity = '{s}') / "
                                   f"count(*) * 360 ELSE 0.0 END, 6) AS {s.lower()}_deg" for s in C.SEVERITIES)
                               + " FROM t_final GROUP BY repo_id", True))
def agg_headline(spark, sf):
    return R.headline(final(spark, sf))


@register("agg_risk_level", sqlv(f"""SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'concerning'
  WHEN medium > 0 THEN 'moderate' WHEN low > 0 OR info > 0 THEN 'good' ELSE 'none' END AS risk_level
FROM (SELECT repo_id, {_counts_sql()} FROM t_final GROUP BY repo_id)""", True))
def agg_risk_level(spark, sf):
    return R.risk_level(final(spark, sf))


OWASP_SQL = Q.case_map('category', C.OWASP_CATEGORY_MAP, 'NULL')


@register("agg_owasp", sqlv(f"""SELECT repo_id, owasp, first_id, n, 'FAIL' AS status FROM (
  SELECT repo_id, {OWASP_SQL} AS owasp, arg_min(dedup_key, first_seq) AS first_id, count(*) AS n FROM t_final GROUP BY ALL)
WHERE owasp IS NOT NULL
UNION ALL SELECT repo_id, '-', NULL, 0, 'PASS' FROM t_final GROUP BY repo_id HAVING count({OWASP_SQL}) = 0""", True))
def agg_owasp(spark, sf):
    f = final(spark, sf).withColumn("id", F.col("dedup_key")).withColumn("owasp", F.lit(None).cast("string"))
    return R.owasp_rows(f)


@register("agg_owasp_ids", sqlv(f"SELECT repo_id, {OWASP_SQL} AS owasp, dedup_key AS id FROM t_final WHERE {OWASP_SQL} IS NOT NULL", True))
def agg_owasp_ids(spark, sf):
    f = final(spark, sf).withColumn("id", F.col("dedup_key")).withColumn("owasp", F.lit(None).cast("string"))
    return R.owasp_ids(f)


def _law_sql(law, article, words):
    hit = f"regexp_matches(upper(comp), '{words}')"
    return f"""SELECT repo_id, '{law}' AS law, '{article}' AS article, severity AS status, dedup_key AS id FROM c WHERE {hit}
  UNION ALL SELECT repo_id, '{law}', '{article}', CASE WHEN bool_or(category IN ('Sensitive Data Exposure',
    'Cryptographic Failures', 'Data Leakage') OR contains(lower(comp), 'data')) THEN 'MEDIUM' ELSE 'PASS' END, NULL
  FROM c GROUP BY repo_id HAVING NOT bool_or({hit})"""


@register("agg_privacy", sqlv("SELECT x.* FROM (WITH c AS (SELECT *, " + Q.case_map(Q.canonical_cwe('cwe'), C.COMPLIANCE_MAP, "''") +
                              " AS comp FROM t_final) " + _law_sql("gdpr", "Art.32", "GDPR|DATA PROTECTION|PERSONAL DATA") +
                              " UNION ALL " + _law_sql("lgpd", "Art.46", "LGPD|DADOS PESSOAIS") + ") x", True))
def agg_privacy(spark, sf):
    f = final(spark, sf).withColumn("compliance", X.compliance(X.canonical_cwe("cwe"))).withColumn("id", F.col("dedup_key"))
    return R.privacy_rows(f)


@register("agg_compliance_tags", sqlv(f"""SELECT DISTINCT severity, {Q.case_map(Q.canonical_cwe('cwe'),
    C.COMPLIANCE_MAP, "''")} AS compliance FROM t_final"""
                                      , True))
def agg_compliance_tags(spark, sf):
    return final(spark, sf).select("severity", X.compliance(X.canonical_cwe("cwe")).alias("compliance")).distinct()


@register("agg_fix_buckets", sqlv("""SELECT repo_id, CASE WHEN severity = 'CRITICAL' THEN 'Immediate'
  WHEN severity = 'HIGH' THEN 'Short-term' WHEN severity = 'MEDIUM' THEN 'Medium-term' ELSE 'Low Priority' END AS bucket,
  count(*) AS n FROM t_final WHERE severity IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') GROUP BY ALL""", True))
def agg_fix_buckets(spark, sf):
    return R.fix_buckets(final(spark, sf)).groupBy("repo_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


@register("agg_gate", sqlv("""SELECT repo_id, count(*) FILTER (WHERE severity IN ('CRITICAL','HIGH')) AS at_or_above,
  CASE WHEN count(*) FILTER (WHERE severity IN ('CRITICAL','HIGH')) > 0 THEN 'fail' ELSE 'pass' END AS gate
FROM t_final GROUP BY repo_id""", True))
def agg_gate(spark, sf):
    return R.gate(final(spark, sf), "HIGH")


def _score_sql():
    w = Q.case_map("severity", C.SEVERITY_WEIGHTS, "0")
    fac = Q.case_map(f"upper({Q.s('confidence')})", C.CONFIDENCE_FACTORS, "1.0")
    cap = ("CASE WHEN bool_or(severity = 'CRITICAL') THEN 49 WHEN bool_or(severity = 'HIGH') THEN 74 "
           "WHEN bool_or(severity = 'MEDIUM') THEN 89 WHEN bool_or(severity = 'LOW') THEN 97 ELSE 100 END")
    return f"""SELECT f.repo_id, CAST(greatest(0, least(max(cap), floor(round(100 - max(weighted) / greatest(max(nf), 1) * 5, 9) + 0.5))) AS BIGINT) AS score,
  max(n) AS n_findings, max(nf) AS n_files
FROM (SELECT repo_id, sum({w} * {fac}) AS weighted, count(*) AS n, {cap} AS cap FROM t_final GROUP BY repo_id) f
JOIN (SELECT repo_id, count(DISTINCT p) AS nf FROM (SELECT repo_id, replace({Q.js_trim(Q.s('file'))}, '\\', '/') AS p
      FROM t_final UNION ALL SELECT repo_id, replace({Q.js_trim(Q.s('path'))}, '\\', '/') FROM t_inventory)
      WHERE p <> '' GROUP BY repo_id) a USING (repo_id) GROUP BY f.repo_id"""


@register("agg_score", sqlv(_score_sql(), True))
def agg_score(spark, sf):
    return R.score(final(spark, sf), B.spark_view(spark, sf, "t_inventory"))


@register("prj_score_band", sqlv(f"""SELECT repo_id, score, CASE WHEN score >= 80 THEN 'Good' WHEN score >= 60 THEN
  'Fair' WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END AS band FROM ({_score_sql()})""", True))
def prj_score_band(spark, sf):
    s = R.score(final(spark, sf), B.spark_view(spark, sf, "t_inventory"))
    return s.select("repo_id", "score", X.score_band("score").alias("band"))


@register("set_audited_files", sqlv(f"""SELECT DISTINCT repo_id, replace({Q.js_trim(Q.s('file'))}, '\\', '/') AS path
FROM t_final WHERE replace({Q.js_trim(Q.s('file'))}, '\\', '/') <> ''
UNION SELECT repo_id, replace({Q.js_trim(Q.s('path'))}, '\\', '/') FROM t_inventory WHERE {Q.js_trim(Q.s('path'))} <> ''""", True))
def set_audited_files(spark, sf):
    return R.audited_files(B.spark_view(spark, sf, "t_inventory"), final(spark, sf))


@register("agg_suppressed_by_source", sqlv(f"""SELECT {Q.finding_source('source')} AS source, count(*) AS suppressed
FROM t_dedup WHERE {ignore_sql('file', C.DEFAULT_IGNORE_PATTERNS)} GROUP BY ALL""", True))
def agg_suppressed_by_source(spark, sf):
    _, sup = SP.apply_ignore(deduped(spark, sf))
    return sup.groupBy(X.finding_source("source").alias("source")).agg(F.count(F.lit(1)).alias("suppressed"))


# ---------------------------------------------------------------- top-k / sorts

@register("top_fixes", sqlv("""SELECT repo_id, dedup_key, severity, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1
    WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END, first_seq) AS rank FROM t_final)
WHERE rank <= 5""", True))
def top_fixes(spark, sf):
    return R.top_fixes(final(spark, sf)).select("repo_id", "dedup_key", "severity",
                                                F.col("rank").cast("bigint").alias("rank"))


@register("top_files", sqlv("""SELECT repo_id, basename, count, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY count DESC, basename) AS rank FROM (
    SELECT repo_id, regexp_extract(file, '([^/\\\\]*)$', 1) AS basename, count(*) AS count FROM t_final GROUP BY ALL))
WHERE rank <= 10""", True))
def top_files(spark, sf):
    return R.top_files(final(spark, sf)).select("repo_id", "basename", "count",
                                                F.col("rank").cast("bigint").alias("rank"))


@register("srt_findings_index", sqlv("""SELECT repo_id, dedup_key, sev_pos, row_number() OVER (ORDER BY repo_id, sev_pos, first_seq) AS rank
FROM (SELECT *, CAST(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END AS INT) AS sev_pos
  FROM t_final)""", True))
def srt_findings_index(spark, sf):
    """Report order (severity, unknown last, then arrival) with the rank of every
    finding, from a range partition: no per-repository window, so a huge repository is split."""
    f = final(spark, sf).select("repo_id", "dedup_key", R.sev_order("severity").cast("int").alias("sev_pos"), "first_seq")
    return positions(f, [F.col("repo_id"), F.col("sev_pos"), F.col("first_seq")], name="rank").drop("first_seq")


# texts and lists beyond each limit of the reports, and within it
LONG_FIX = "CASE WHEN duplicate_count % 2 = 0 THEN concat(repeat(concat(name, ' '), 9), name) ELSE concat(name, chr(10), cwe) END"
LONG_LINE = "CASE WHEN duplicate_count % 40 = 0 THEN concat(repeat('ab ', 500), name, repeat(' cd', 400)) ELSE concat(name, ' ', cwe) END"


@register("lim_misc", sqlv(f"""SELECT repo_id, dedup_key, CASE WHEN length(fix) <= 80 THEN fix ELSE
    substr(split_part(fix, chr(10), 1), 1, 80) || '...' END AS fix_summary, {Q.snippet('text', 'name', 2000)} AS code,
  array_to_string([i FOR i IN range(1, least(duplicate_count % 20, {N.REFERENCE_MAX_REASONS}) + 1)], '|') AS reasons,
  array_to_string([i FOR i IN range(1, least(duplicate_count % 20, {N.REFERENCE_MAX_REFERENCES}) + 1)], '|') AS refs
FROM (SELECT *, {LONG_FIX} AS fix, {LONG_LINE} AS text FROM t_final)""", True))
def lim_misc(spark, sf):
    """The limits of the reports: 80 characters of a fix, 2000 of a snippet, 10 reasons, 5 references."""
    f = final(spark, sf).withColumn("fix", F.expr(LONG_FIX)).withColumn("text", F.expr(LONG_LINE))
    some = F.filter(F.sequence(F.lit(0), (F.col("duplicate_count") % 20).cast("int")), lambda i: i > 0)
    return R.triage(f).select("repo_id", "dedup_key", "fix_summary", X.snippet("text", "name").alias("code"),
                              F.concat_ws("|", N.head_of(some, N.REFERENCE_MAX_REASONS).cast("array<string>")).alias("reasons"),
                              F.concat_ws("|", N.head_of(some, N.REFERENCE_MAX_REFERENCES).cast("array<string>")).alias("refs"))
