"""Registered queries: partial findings, reconciliation, sinks, rule quality,
rule scope, ignore files and the flagship run summary."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import columns as X
from ..operators import corroborate as D
from ..operators import reports as R
from ..operators import sinks as K
from ..operators import suppress as SP
from ..operators import tools as T
from ..rules.catalogue import builtin_rules
from ..session import materialize
from ..sources import bindings as B
from ..sources.partials import load_partials
from . import oracle_scan as OS
from . import q_findings as QF
from . import q_ops as QO
from . import q_scan as QS
from . import sqlfrag as Q
from .registry import register

# ---------------------------------------------------------------- partial findings
# Partial documents: one per (repo, run), named by a reviewer.
REVIEWER = "CASE run_id % 4 WHEN 0 THEN 'auth' WHEN 1 THEN 'injection' WHEN 2 THEN 'bad name!' ELSE 'crypto' END"
FILE_NAME = f"({REVIEWER} || '-' || CAST(run_id AS VARCHAR) || '.json')"
ITEM = ("to_json(named_struct('severity', severity, 'category', category, 'name', name, 'description', "
        "CASE WHEN line % 5 = 0 THEN '' ELSE 'desc' END, 'file', file, 'line', CASE WHEN line = 1 THEN 0 ELSE line END, "
        "'cwe', cwe, 'fix', 'fix it', 'confidence', confidence, 'source', CASE WHEN line % 7 = 0 THEN 'tool' "
        f"ELSE concat('subagent:', {REVIEWER}) END))")


def partial_docs(spark, sf):
    f = B.spark_view(spark, sf, "t_findings", by=("repo_id", "run_id")).withColumn("_item", F.expr(ITEM))
    docs = (f.groupBy("repo_id", "run_id")
            .agg(F.sort_array(F.collect_list(F.struct("seq", "_item"))).alias("_xs"))
            .withColumn("_arr", F.concat(F.lit("["), F.array_join(F.transform("_xs", lambda x: x["_item"]), ","),
                                         F.lit("]"))))
    tools = F.when(F.col("run_id") % 3 == 0, F.lit(',"toolExecutions":["opengrep","npm audit"]')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"findings":'), F.col("_arr"), tools, F.lit("}"))
    body = F.when(F.col("run_id") % 13 == 0, F.substring(body, 1, 20)).otherwise(body)
    name = F.concat(F.expr(REVIEWER), F.lit("-"), F.col("run_id").cast("string"), F.lit(".json"))
    return docs.select("repo_id", "run_id", name.alias("file_name"), body.alias("json"))


def _partials(spark, sf):
    return load_partials(partial_docs(spark, sf))


P_BASE = f"""SELECT *, {FILE_NAME} AS file_name, {REVIEWER} AS reviewer,
  row_number() OVER (PARTITION BY repo_id, run_id ORDER BY seq) AS ordinal,
  regexp_matches({FILE_NAME}, '(?i)^[a-z0-9][a-z0-9_-]*\\.json$') AND run_id % 13 <> 0 AS doc_ok,
  CASE WHEN line % 5 = 0 THEN '' ELSE 'desc' END AS description,
  CASE WHEN line = 1 THEN 0 ELSE line END AS pline,
  CASE WHEN line % 7 = 0 THEN 'tool' ELSE 'subagent:' || {REVIEWER} END AS psource
FROM t_findings"""
P_VALID = "description <> '' AND pline >= 1 AND regexp_matches(psource, '(?i)^subagent:[a-z0-9][a-z0-9_-]*$')"


@register("src_load_partials", QF.sqlv(f"""SELECT repo_id, count(*) FILTER (WHERE doc_ok) AS findings,
  count(DISTINCT run_id) FILTER (WHERE NOT doc_ok) AS doc_errors,
  2 * count(DISTINCT run_id) FILTER (WHERE run_id % 3 = 0 AND regexp_matches(file_name,
    '(?i)^[a-z0-9][a-z0-9_-]*\\.json$') AND run_id % 13 <> 0) AS tool_execs
FROM ({P_BASE}) GROUP BY repo_id"""))
def src_load_partials(spark, sf):
    f, e, x = _partials(spark, sf)
    a = f.groupBy("repo_id").agg(F.count(F.lit(1)).alias("findings"))
    b = e.groupBy("repo_id").agg(F.count(F.lit(1)).alias("doc_errors"))
    c = x.groupBy("repo_id").agg(F.count(F.lit(1)).alias("tool_execs"))
    return (a.join(b, "repo_id", "full").join(c, "repo_id", "full")
            .select("repo_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("findings", "doc_errors", "tool_execs")]))


@register("flt_partial_valid", QF.sqlv(f"""SELECT repo_id, run_id, ordinal, e AS error FROM (
  SELECT *, unnest(list_filter([
    CASE WHEN description = '' THEN file_name || ' finding #' || ordinal || ': "description" is empty.' END,
    CASE WHEN pline < 1 THEN file_name || ' finding #' || ordinal || ': "line" is no number from 1 on.' END,
    CASE WHEN NOT regexp_matches(psource, '(?i)^subagent:[a-z0-9][a-z0-9_-]*$') THEN file_name || ' finding #' ||
      ordinal || ': "source" names no subagent.' END], lambda x: x IS NOT NULL)) AS e
  FROM ({P_BASE}) WHERE doc_ok)"""))
def flt_partial_valid(spark, sf):
    f, _, _ = _partials(spark, sf)
    v = T.partial_errors(f)
    return v.select("repo_id", "run_id", "ordinal", F.explode("errors").alias("error")) \
        .withColumn("ordinal", F.col("ordinal").cast("bigint"))


def _valid_partials(spark, sf):
    f, _, _ = _partials(spark, sf)
    v = T.partial_errors(f).where(F.size("errors") == 0).drop("errors")
    return v.withColumn("line", F.col("line").cast("int"))


def _all_findings(spark, sf):
    """Detector and tool findings plus valid partials, with one common ordering key."""
    t = B.spark_view(spark, sf, "t_findings")
    none = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    t = t.withColumn("seq", F.struct(F.lit(0).alias("r"), F.col("seq").alias("at"), none[0].alias("a"), none[1].alias("b")))
    p = _valid_partials(spark, sf).withColumn("seq", F.struct(
        F.lit(1).alias("r"), F.lit(None).cast(t.schema["seq"].dataType["at"].dataType).alias("at"), F.col("file_name").alias("a"),
        F.col("ordinal").cast("bigint").alias("b")))
    cols = ["repo_id", "source", "file", "line", "severity", "confidence", "cwe", "category", "name", "seq"]
    return t.select(*cols).unionByName(p.select(*cols))


SUB_KEYS = f"""SELECT repo_id, {Q.dedup_key('file', 'pline', 'cwe', 'category', 'name')} AS k FROM ({P_BASE})
  WHERE doc_ok AND {P_VALID}"""
ALL_KEYS = f"""SELECT repo_id, {Q.dedup_key()} AS k, FALSE AS sub FROM t_findings
  UNION ALL SELECT repo_id, k, TRUE FROM ({SUB_KEYS})"""


@register("flt_subagent_evidence", QF.sqlv(f"""SELECT repo_id, count(*) AS subagent_findings FROM (
  SELECT repo_id, k FROM ({ALL_KEYS}) GROUP BY ALL HAVING bool_or(sub)) GROUP BY repo_id"""))
def flt_subagent_evidence(spark, sf):
    d = D.deduplicate(_all_findings(spark, sf), with_references=False)
    return d.where(T.has_subagent_evidence()).groupBy("repo_id").agg(F.count(F.lit(1)).alias("subagent_findings"))


@register("agg_reconcile", QF.sqlv(f"""SELECT a.repo_id, a.partial_count, a.deduped_partial_count,
  coalesce(f.final_subagent_count, 0) AS final_subagent_count,
  a.deduped_partial_count = coalesce(f.final_subagent_count, 0) AS ok
FROM (SELECT repo_id, count(*) AS partial_count, count(DISTINCT k) AS deduped_partial_count FROM ({SUB_KEYS})
      GROUP BY repo_id) a
LEFT JOIN (SELECT repo_id, count(*) AS final_subagent_count FROM (SELECT repo_id, k FROM ({ALL_KEYS}) GROUP BY ALL
      HAVING bool_or(sub)) GROUP BY repo_id) f USING (repo_id)"""))
def agg_reconcile(spark, sf):
    """Partials against the final findings, from one fold: a key with partials counts
    once as a partial key, and as a final finding if it kept their evidence."""
    every = _all_findings(spark, sf)
    fin = D.deduplicate(every, with_references=False, counts={"partials": F.col("seq.r") == 1})
    out = fin.groupBy("repo_id").agg(F.sum("partials").alias("partial_count"), F.count_if(F.col("partials") > 0).alias("deduped_partial_count"),
                                     F.count_if(T.has_subagent_evidence()).alias("final_subagent_count"))
    return out.where("partial_count > 0").withColumn("ok", F.col("deduped_partial_count") == F.col("final_subagent_count"))


# ---------------------------------------------------------------- ignore files

IGNORE_DOC = ("concat('# generated', char(10), '', char(10), '  ', path, '  ', char(13), char(10), char(10), '!', path, "
              "char(10), char(9), '# note')")
IGNORE_DOC_SQL = ("'# generated' || chr(10) || '' || chr(10) || '  ' || path || '  ' || chr(13) || chr(10) || chr(10) || "
                  "'!' || path || chr(10) || chr(9) || '# note'")


@register("src_load_ignore", QF.sqlv(f"""SELECT repo_id, path, CAST(o AS BIGINT) AS ordinal, {Q.js_trim('l')} AS pattern FROM (
  SELECT repo_id, path, unnest(string_split_regex({IGNORE_DOC_SQL}, '\\r?\\n')) AS l,
    unnest(range(len(string_split_regex({IGNORE_DOC_SQL}, '\\r?\\n')))) AS o FROM t_files)
WHERE {Q.js_trim('l')} <> '' AND NOT starts_with({Q.js_trim('l')}, '#')"""))
def src_load_ignore(spark, sf):
    f = B.spark_view(spark, sf, "t_files").select("repo_id", "path", F.expr(IGNORE_DOC).alias("doc"))
    return SP.ignore_lines(f, "doc", ["repo_id", "path"])


# ---------------------------------------------------------------- sinks

@register("snk_sarif", QF.sqlv(f"""SELECT repo_id, rule_id, CASE WHEN nm <> '' THEN nm ELSE 'Finding' END AS name,
  CASE WHEN cat <> '' THEN cat ELSE rule_id END AS short_description,
  CASE WHEN regexp_extract(cw, '(?i)CWE-(\\d+)', 1) <> '' THEN 'https://cwe.mitre.org/data/definitions/' ||
    regexp_extract(cw, '(?i)CWE-(\\d+)', 1) || '.html' END AS help_uri,
  {Q.case_map("CASE WHEN upper(sev) IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN upper(sev) ELSE 'MEDIUM' END",
              C.SECURITY_SEVERITY, "'5.0'")} AS security_severity
FROM (SELECT *, regexp_replace(CASE WHEN cat <> '' THEN cat ELSE rule_id END, '[^A-Za-z0-9]', '', 'g') AS nm FROM (
  SELECT repo_id, rule_id, arg_min(category, first_seq) AS cat, arg_min(cwe, first_seq) AS cw,
  arg_min(severity, first_seq) AS sev
  FROM (SELECT *, {QF._sarif_rule_sql()} AS rule_id FROM t_final) GROUP BY repo_id, rule_id))""", True))
def snk_sarif(spark, sf):
    return K.sarif_rules(QF.final(spark, sf).withColumn("owasp", F.lit(None).cast("string"))).drop("owasp")


SARIF_DOC = ("struct<runs: array<struct<tool: struct<driver: struct<name:string, rules: array<struct<id:string, name:string>>>>, "
             "properties: struct<part:bigint, parts:bigint>, results: array<struct<ruleId:string, level:string, message: struct<text:string>, "
             "locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri:string>, region: struct<startLine:int>>>>, "
             "partialFingerprints: struct<auditsparkFingerprint:string>, properties: struct<severity:string, confidence:string, "
             "cwe:string, vibeRisk:boolean, source:string>>>>>>")
SEV_SQL = f"(CASE WHEN upper({Q.s('severity')}) IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') THEN upper(severity) ELSE 'MEDIUM' END)"


@register("snk_sarif_document", QF.sqlv(f"""SELECT repo_id, {QF._sarif_rule_sql()} AS rule_id, {Q.case_map(SEV_SQL, C.SARIF_LEVEL, "'warning'")} AS level,
  coalesce(NULLIF(name, ''), 'Security finding') AS message, regexp_replace(replace(file, '\\', '/'), '^\\./', '') AS uri,
  greatest(1, coalesce(line, 1)) AS start_line,
  lower(regexp_replace(replace(file, '\\', '/'), '^\\./', '')) || ':' ||
    CASE WHEN {Q.canonical_cwe('cwe')} <> '' THEN {Q.canonical_cwe('cwe')} ELSE lower(category) END || ':' ||
    regexp_replace(lower({Q.js_trim(Q.s('name'))}), '{Q.WS}+', ' ', 'g') AS fingerprint,
  {SEV_SQL} AS severity, coalesce(NULLIF(confidence, ''), 'N/A') AS confidence, NULLIF({Q.canonical_cwe('cwe')}, '') AS cwe,
  {Q.finding_source('source')} AS source, TRUE AS rule_listed FROM t_final
UNION ALL SELECT 'no findings here', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""", True))
def snk_sarif_document(spark, sf):
    """The SARIF documents, read back: a row for each result, one for a clean repository."""
    f = materialize(QF.final(spark, sf)).withColumn("owasp", F.lit(None).cast("string"))
    clean = B.spark_view(spark, sf, "t_findings").select(F.lit("no findings here").alias("repo_id")).distinct()
    docs = K.to_sarif(f, repos=clean)
    run = docs.select("repo_id", F.from_json("sarif_json", SARIF_DOC)["runs"][0].alias("run"))
    rules = F.col("run.tool.driver.rules.id")
    r = run.select("repo_id", rules.alias("rules"), F.explode_outer("run.results").alias("r"))
    at = F.col("r.locations")[0]["physicalLocation"]
    return r.select("repo_id", F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"),
                    at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"),
                    F.col("r.partialFingerprints.auditsparkFingerprint").alias("fingerprint"), "r.properties.severity",
                    "r.properties.confidence", "r.properties.cwe", "r.properties.source",
                    F.array_contains("rules", F.col("r.ruleId")).alias("rule_listed"))


@register("snk_findings_json", QF.sqlv(f"""SELECT f.repo_id, CAST(to_json(struct_pack(severity := f.severity,
  category := f.category, name := f.name, file := f.file, line := f.line, cwe := f.cwe, confidence := f.confidence,
  source := f.source, score := s.score)) AS VARCHAR) AS finding_json FROM t_final f JOIN ({QF._score_sql()}) s USING (repo_id)""",
                                       True))
def snk_findings_json(spark, sf):
    f = materialize(QF.final(spark, sf))
    return K.findings_export(f.drop("id"), R.score(f, B.spark_view(spark, sf, "t_inventory")))


# ---------------------------------------------------------------- rule quality / scope

def _det_sql_all():
    from . import oracle_scan as O
    return O.detect_ctes(builtin_rules())


@register("jn_rule_quality", B.with_views("""SELECT count(*) FILTER (WHERE expected_cwe IS NOT NULL) AS positives,
  count(*) FILTER (WHERE expected_cwe IS NOT NULL AND hit) AS hits,
  round(CAST(count(*) FILTER (WHERE expected_cwe IS NOT NULL AND hit) AS DOUBLE) /
    greatest(count(*) FILTER (WHERE expected_cwe IS NOT NULL), 1), 6) AS recall,
  count(*) FILTER (WHERE expected_cwe IS NULL) AS negatives,
  count(*) FILTER (WHERE expected_cwe IS NULL AND high) AS high_on_negatives
FROM (SELECT l.doc_id, l.expected_cwe, coalesce(bool_or(d.cwe = l.expected_cwe), FALSE) AS hit,
        coalesce(bool_or(d.severity IN ('HIGH', 'CRITICAL')), FALSE) AS high
      FROM t_labels l JOIN t_files f USING (doc_id) LEFT JOIN det d ON d.repo_id = f.repo_id AND d.file = f.path
      GROUP BY l.doc_id, l.expected_cwe)""", _det_sql_all()))
def jn_rule_quality(spark, sf):
    det = QS.detector(spark, sf).select("repo_id", "file", "cwe", "severity")
    files = B.spark_view(spark, sf, "t_files").select("repo_id", "doc_id", F.col("path").alias("file"))
    lab = B.spark_view(spark, sf, "t_labels")
    per = (lab.join(files, "doc_id").join(det, ["repo_id", "file"], "left")
           .groupBy("doc_id", "expected_cwe")
           .agg(F.coalesce(F.bool_or(F.col("cwe") == F.col("expected_cwe")), F.lit(False)).alias("hit"),
                F.coalesce(F.bool_or(F.col("severity").isin("HIGH", "CRITICAL")), F.lit(False)).alias("high")))
    pos = F.col("expected_cwe").isNotNull()
    return per.agg(F.count_if(pos).alias("positives"), F.count_if(pos & F.col("hit")).alias("hits"),
                   F.round(F.count_if(pos & F.col("hit")).cast("double") / F.greatest(F.count_if(pos), F.lit(1)), 6)
                   .alias("recall"),
                   F.count_if(~pos).alias("negatives"), F.count_if(~pos & F.col("high")).alias("high_on_negatives"))


def _scope_counts():
    from ..rules.catalogue import LANGUAGE_SCOPES, VULN_RULES, CONFIG_RULES
    general = sum(1 for r in VULN_RULES if r.scope == "all")
    per_lang = {lang: sum(1 for r in VULN_RULES if r.scope == sc) for lang, sc in LANGUAGE_SCOPES.items()}
    return general, per_lang, len(CONFIG_RULES)


@register("jn_rule_scope", B.with_views(f"""SELECT repo_id, path, CAST({len([r for r in builtin_rules() if r.scope == 'secret'])}
  + {_scope_counts()[0]} + coalesce({Q.case_map('language', _scope_counts()[1], '0')}, 0)
  + CASE WHEN kind IN ('config', 'baas') THEN {_scope_counts()[2]} ELSE 0 END AS BIGINT) AS applicable_rules
FROM scan_files""",
                                        OS.detect_ctes(builtin_rules())[:1]))
def jn_rule_scope(spark, sf):
    """Rules applicable per file (the theta join folded into expressions)."""
    from ..sources import files as FS
    general, per_lang, n_cfg = _scope_counts()
    f = FS.with_file_flags(FS.classify(B.spark_view(spark, sf, "t_files")).where(~X.is_binary_ext("path")))
    f = f.where(~F.col("is_binary") & ~F.col("is_empty"))
    n_secret = len([r for r in builtin_rules() if r.scope == "secret"])
    lang_n = X.lookup(per_lang, F.col("language"), 0)
    # as the scan's default, which tries all rules on minified files too
    n = F.lit(n_secret) + F.lit(general) + lang_n + F.when(F.col("kind").isin("config", "baas"), F.lit(n_cfg)).otherwise(F.lit(0))
    return f.select("repo_id", "path", n.cast("bigint").alias("applicable_rules"))


# ---------------------------------------------------------------- flagship summary

@register("agg_summary", QF.sqlv(f"""SELECT f.repo_id, s.score, f.total, coalesce(sup.suppressed, 0) AS suppressed,
  coalesce(bl.baselined, 0) AS baselined, f.critical, f.high, f.medium, f.low, f.info, s.n_files,
  coalesce(inv.source_files, 0) AS source_files, coalesce(inv.config_files, 0) AS config_files,
  coalesce(inv.dependency_files, 0) AS dependency_files, coalesce(inv.baas_files, 0) AS baas_files,
  coalesce(tm.mode, 'Agent-Only') AS tool_mode, coalesce(fw.frameworks, '') AS frameworks, coalesce(pt.project_type, 'unknown') AS project_type
FROM (SELECT repo_id, count(*) AS total, {QF._counts_sql()} FROM t_final GROUP BY repo_id) f
JOIN ({QF._score_sql()}) s USING (repo_id)
LEFT JOIN (SELECT repo_id, {", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}_files" for c in R.FILE_CATEGORIES)}
           FROM (SELECT DISTINCT repo_id, path, category FROM t_inventory) GROUP BY repo_id) inv USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(framework, ',' ORDER BY framework) AS frameworks FROM ({QO._fw_sql()}) GROUP BY repo_id) fw USING (repo_id)
LEFT JOIN ({QO.PROJECT_TYPE_SQL}) pt USING (repo_id)
LEFT JOIN (SELECT repo_id, count(*) AS suppressed FROM t_dedup WHERE {QF.ignore_sql('file', C.DEFAULT_IGNORE_PATTERNS)}
           GROUP BY repo_id) sup USING (repo_id)
LEFT JOIN (SELECT d.repo_id, count(*) AS baselined FROM (SELECT *, {Q.fingerprint()} AS fp FROM t_final) d
           JOIN t_baseline b ON b.repo_id = d.repo_id AND b.fingerprint = d.fp GROUP BY d.repo_id) bl USING (repo_id)
LEFT JOIN (SELECT repo_id, CASE WHEN available_count = 0 THEN 'Agent-Only' WHEN available_count = relevant
    THEN 'Self-Hosted' ELSE 'Hybrid' END AS mode FROM (SELECT repo_id, count(*) FILTER (WHERE rel) AS relevant,
    count(*) FILTER (WHERE rel AND ok) AS available_count FROM (SELECT *, tool IN ('opengrep', 'osv-scanner') OR
    (tool = 'package-audit' AND NOT coalesce(skipped, FALSE)) AS rel, available AND (tool <> 'opengrep' OR diagnostic
    IS NULL OR diagnostic = 'complete') AS ok FROM t_tool_runs) GROUP BY repo_id)) tm USING (repo_id)""", True))
def agg_summary(spark, sf):
    """One run-summary row per repository. The merged findings are computed once:
    suppressed and known are flags, and findings and inventory go through one
    grouped pass (``reports.run_summary``)."""
    d = QF.deduped(spark, sf)
    d = d.withColumn("suppressed", SP.is_ignored(SP.ignore_path("file"), C.DEFAULT_IGNORE_PATTERNS))
    d = SP.flag_baseline(d, B.spark_view(spark, sf, "t_baseline"))
    mode = T.tool_mode(B.spark_view(spark, sf, "t_tool_runs")).select("repo_id", F.col("mode").alias("tool_mode"))
    fw = QO.jn_frameworks(spark, sf).groupBy("repo_id").agg(
        F.array_join(F.array_sort(F.collect_set("framework")), ",").alias("frameworks"))  # a fixed list of names
    out = R.run_summary(d, B.spark_view(spark, sf, "t_inventory"), mode, fw, QO.agg_project_type(spark, sf))
    return out.select("repo_id", "score", "total", "suppressed", "baselined", "critical", "high", "medium", "low", "info", "n_files",
                      *[f"{c}_files" for c in R.FILE_CATEGORIES], F.coalesce("tool_mode", F.lit("Agent-Only")).alias("tool_mode"),
                      F.coalesce("frameworks", F.lit("")).alias("frameworks"),
                      F.coalesce("project_type", F.lit("unknown")).alias("project_type"))
