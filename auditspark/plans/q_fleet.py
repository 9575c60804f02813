"""Registered queries over the fleet: ignore files of each repository, the references of
merged findings, and the whole run over files, tool reports and partial documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..operators import corroborate as D
from ..operators import ignore_rules as IG
from ..rules.catalogue import builtin_rules
from ..session import materialize
from ..sources import bindings as B
from . import fleet
from . import oracle_scan as OS
from . import q_findings as QF
from . import q_more as QM
from . import q_normalize as QN
from . import sqlfrag as Q
from .registry import register

# ---------------------------------------------------------------- ignore files of each repository
# Each repository's file has a line for each of its rows of ``part``, in their order.
_IGNORE_LINE = """CASE p_partkey % 17 WHEN 0 THEN concat('# note ', p_partkey) WHEN 1 THEN concat('src/f', p_partkey % 40, '.js')
  WHEN 2 THEN concat('!test/f', p_partkey % 40, '.js') WHEN 3 THEN 'test/' WHEN 4 THEN concat('*', p_partkey % 10, '.js') WHEN 5 THEN '/dist/'
  WHEN 6 THEN concat('apps/**/f', p_partkey % 4, '?.js') WHEN 7 THEN '  docs/ ' WHEN 8 THEN '' WHEN 9 THEN '!src/' WHEN 10 THEN 'f1?.js'
  WHEN 11 THEN concat('**/f', p_partkey % 3, '*') WHEN 12 THEN concat('!apps/web/f*', p_partkey % 5, '.js') WHEN 13 THEN 'web/f(1)+[2].js'
  WHEN 14 THEN '/apps//' WHEN 15 THEN concat('!**/**/f', p_partkey % 7, '.js') ELSE 'src' END"""


def ignore_docs(spark, sf):
    p = B.table(spark, sf, "part").select(F.expr("concat('repo', p_partkey % 5)").alias("repo_id"), "p_partkey", F.expr(_IGNORE_LINE).alias("l"))
    g = p.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "l"))).alias("x"))
    return g.select("repo_id", F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("content"))


# the oracle's own compiler: written out step by step, not taken from the engine
_IGNORE_SQL = f"""
ig_doc AS (SELECT concat('repo', p_partkey % 5) AS repo_id, string_agg({_IGNORE_LINE}, chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY ALL),
ig_lines AS (SELECT repo_id, unnest(string_split(content, chr(10))) AS raw, unnest(range(len(string_split(content, chr(10))))) AS ordinal FROM ig_doc),
ig_pat AS (SELECT repo_id, ordinal, {Q.js_trim('raw')} AS pattern FROM ig_lines WHERE {Q.js_trim('raw')} <> '' AND {Q.js_trim('raw')} NOT LIKE '#%'),
ig_a AS (SELECT *, pattern LIKE '!%' AS negate, CASE WHEN pattern LIKE '!%' THEN substr(pattern, 2) ELSE pattern END AS b FROM ig_pat),
ig_b AS (SELECT *, b LIKE '%/' AS directory, rtrim(b, '/') AS c FROM ig_a),
ig_c AS (SELECT *, c LIKE '/%' AS rooted, regexp_replace(ltrim(c, '/'), '\\*\\*(/?\\*+)*', '**', 'g') AS d FROM ig_b),
ig_rules AS (SELECT repo_id, ordinal, pattern, negate,
  CASE WHEN rooted OR contains(d, '/') THEN '^' ELSE '(?:^|/)' END || array_to_string(list_transform(regexp_extract_all(d, '(?s)\\*\\*/|\\*\\*|.'),
    lambda t: CASE t WHEN '**/' THEN '(?:.*/)?' WHEN '**' THEN '.*' WHEN '*' THEN '[^/]*' WHEN '?' THEN '[^/]' ELSE
      CASE WHEN regexp_matches(t, '^[A-Za-z0-9/_ \\-]$') OR unicode(t) > 127 THEN t ELSE chr(92) || t END END), '')
    || CASE WHEN directory THEN '(?:/.*)?\\z' ELSE '\\z' END AS regex FROM ig_c)"""


@register("src_ignore_rules", f"WITH {_IGNORE_SQL.strip()} SELECT repo_id, CAST(ordinal AS BIGINT) AS ordinal, pattern, negate, regex FROM ig_rules")
def src_ignore_rules(spark, sf):
    """Ignore files of all repositories, parsed and compiled to a row for each pattern."""
    return IG.rules(ignore_docs(spark, sf)).select("repo_id", "ordinal", "pattern", "negate", "regex")


_PATH_SQL = f"regexp_replace(replace({Q.js_trim(Q.s('file'))}, '\\', '/'), '^\\./', '')"
_IGNORED_SQL = f""",
ig_paths AS (SELECT DISTINCT repo_id, {_PATH_SQL} AS p FROM t_dedup),
ig_verdict AS (SELECT repo_id, p, arg_max(NOT negate, ordinal) AS own FROM ig_paths JOIN ig_rules USING (repo_id) WHERE regexp_matches(p, regex) GROUP BY ALL)
SELECT t.repo_id, t.dedup_key, t.file, coalesce(v.own, {QF.ignore_sql('t.file', C.DEFAULT_IGNORE_PATTERNS)}) AS suppressed
FROM t_dedup t LEFT JOIN ig_verdict v ON v.repo_id = t.repo_id AND v.p = {_PATH_SQL.replace('file', 't.file')}"""


@register("flt_ignore_repo", QF.sqlv(f"WITH {_IGNORE_SQL.strip()}{_IGNORED_SQL}", True))
def flt_ignore_repo(spark, sf):
    """Findings against the ignore file of their own repository, behind the built-in defaults."""
    merged = materialize(QF.deduped(spark, sf).select("repo_id", "dedup_key", "file"))  # read for its paths and for its rows: folded once
    f = IG.flag_ignored(merged, IG.rules(ignore_docs(spark, sf)))
    return f.select("repo_id", "dedup_key", "file", "suppressed")


# ---------------------------------------------------------------- references
REFS = ("array(concat('https://n/', name), CASE WHEN line % 2 = 0 THEN '' ELSE concat('https://l/', line) END, "
        "concat('https://run/', run_id % 5), concat('https://n/', name))")
REFS_SQL = REFS.replace("array(", "list_value(", 1)


@register("agg_references", B.with_views("""SELECT repo_id, dedup_key, row_number() OVER (PARTITION BY repo_id, dedup_key ORDER BY place) AS position, reference
FROM (SELECT repo_id, dedup_key, reference, min(place) AS place FROM (
  SELECT repo_id, dedup_key, unnest(refs) AS reference, unnest(range(len(refs))) AS place FROM t_folded) WHERE reference <> '' GROUP BY ALL)""",
                                         [("t_folded", QF._fold_sql(refs=REFS_SQL))]))
def agg_references(spark, sf):
    """The references of every merged finding, a row for each, in their order."""
    return D.reference_rows(QF.findings(spark, sf, spread=True).withColumn("references", F.expr(REFS)))


# ---------------------------------------------------------------- the whole run
_RULES = builtin_rules()
_TOOL_NAMES = [t for k in D.SOURCE_ORDER for t in D.SOURCE_TOOLS[k]]
_KIND = " ".join(f"WHEN source IN ({', '.join(map(Q.q, ts))}) THEN {i}" for i, ts in enumerate(D.SOURCE_TOOLS.values()) if ts)
_TOOL = " ".join(f"WHEN {Q.q(t)} THEN {i}" for i, t in enumerate(_TOOL_NAMES))
_NAMES = ", ".join(f"({i}, {Q.q(r.id)}, {Q.q(r.name)})" for i, r in enumerate(_RULES))
# the order of arrival, kind by kind; what a kind does not have is null in all its rows
_FLEET_ALL = f"""SELECT repo_id, severity, d.confidence, d.category, n.name, file, line, d.cwe, CAST(NULL AS VARCHAR) AS source, 0 AS kind,
  CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 99 END AS o1,
  depth AS o2, file AS o3, r.rule_pass AS o4, n.k AS o5, line AS o6, match_no AS o7, NULL AS o8, NULL AS o9, NULL AS o10, NULL AS o11
FROM det d JOIN rules r USING (rule_id) JOIN (SELECT * FROM (VALUES {_NAMES}) AS v(k, rule_id, name)) n USING (rule_id)
UNION ALL SELECT repo_id, severity, confidence, category, name, file, line, cwe, source, CASE {_KIND} END, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  CASE source {_TOOL} END, run_id, source, CAST(regexp_extract(id, '_(\\d+)$', 1) AS BIGINT) FROM ({QN.MIXED_SQL})
UNION ALL SELECT repo_id, severity, confidence, category, name, file, pline, cwe, psource, 5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  run_id, file_name, ordinal FROM ({QM.P_BASE}) WHERE doc_ok AND {QM.P_VALID}"""
_FLEET_SEQ = "SELECT *, row_number() OVER (ORDER BY kind, o1, o2, o3, o4, o5, o6, o7, o8, o9, o10, o11) AS seq FROM fl_all"
_FLEET_SQL = f"""{_IGNORE_SQL.strip()},
ig_paths AS (SELECT DISTINCT repo_id, {_PATH_SQL} AS p FROM t_merged),
ig_verdict AS (SELECT repo_id, p, arg_max(NOT negate, ordinal) AS own FROM ig_paths JOIN ig_rules USING (repo_id) WHERE regexp_matches(p, regex) GROUP BY ALL)
SELECT t.repo_id, t.dedup_key, t.severity, t.confidence, t.source, array_to_string(t.sources, ',') AS sources, t.duplicate_count, t.file, t.line, t.cwe,
  t.category, t.name, coalesce(v.own, {QF.ignore_sql('t.file', C.DEFAULT_IGNORE_PATTERNS)}) AS suppressed, b.fingerprint IS NOT NULL AS known
FROM t_merged t LEFT JOIN ig_verdict v ON v.repo_id = t.repo_id AND v.p = {_PATH_SQL.replace('file', 't.file')}
LEFT JOIN t_baseline b ON b.repo_id = t.repo_id AND b.fingerprint = {Q.fingerprint('t.file', 't.cwe', 't.category', 't.name')}"""
_FLEET_CTES = [("fl_files", "SELECT concat('repo', doc_id % 5) AS repo_id, path, content FROM t_files"), *OS.detect_ctes(_RULES, "fl_files"),
               ("fl_all", _FLEET_ALL), ("t_fleet", _FLEET_SEQ), ("t_merged", QF._fold_sql("t_fleet")),
               ("t_baseline", f"SELECT DISTINCT repo_id, {Q.fingerprint()} AS fingerprint FROM t_findings WHERE detected_at < TIMESTAMP '{B.BASELINE_CUTOFF}'")]


@register("fleet_run", B.with_views(f"WITH {_FLEET_SQL}", _FLEET_CTES))
def fleet_run(spark, sf):
    """The whole run: files scanned, reports of nine tools normalised in one pass, partials
    validated, all merged in the fixed order, and flagged by each repository's ignore file
    and the baseline. Scan and fold run once, into the shared folder."""
    files = B.spark_view(spark, sf, "t_files").select(F.expr("concat('repo', doc_id % 5)").alias("repo_id"), "path", "content")
    res = fleet.run(spark, files, QN.mixed_reports(spark, sf), B.spark_view(spark, sf, "t_baseline"), partials=QM.partial_docs(spark, sf),
                    ignore_files=ignore_docs(spark, sf), spread=True)
    return res.merged.select("repo_id", "dedup_key", "severity", "confidence", "source", F.concat_ws(",", "sources").alias("sources"), "duplicate_count",
                             "file", F.col("line").cast("int").alias("line"), "cwe", "category", "name", "suppressed", "known")
