"""Registered queries: sources, rule scan, detector (sections 2.1, 2.2)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.catalogs import BINARY_EXTENSIONS
from ..operators import scan as S
from ..rules.catalogue import SECRET_RULES, VULN_RULES, CONFIG_RULES, builtin_rules, user_rule
from ..sources import bindings as B
from ..sources import files as FS
from . import oracle_scan as O
from . import sqlfrag as Q
from .registry import register

DET_COLS = ["repo_id", "id", "rule_id", "file", "line", "severity", "confidence", "category", "cwe",
            "vulnerable_code"]


def _lines(spark, sf):
    # the tables are one file each: the lines are dealt out before the scan
    return S.prepare_lines(B.spark_view(spark, sf, "t_files"), spread=True)


def detector(spark, sf, rules=None):
    return S.detect(spark, _lines(spark, sf), rules)


def _det_sql(rules, where="TRUE"):
    return B.with_views(f"SELECT repo_id, {O.DET_ID} AS id, rule_id, file, line, severity, confidence, category, "
                        f"cwe, vulnerable_code FROM det WHERE {where}", O.detect_ctes(rules))


@register("scan_detect", _det_sql(builtin_rules()))
def scan_detect(spark, sf):
    return detector(spark, sf).select(*DET_COLS)


@register("scan_detect_limited", B.with_views(
    f"SELECT repo_id, {O.DET_ID} AS id, rule_id, file, line, severity, confidence, category, cwe, vulnerable_code FROM det",
    O.detect_ctes(builtin_rules(), max_line=S.REFERENCE_MAX_LINE, minified=False)))
def scan_detect_limited(spark, sf):
    """The scan with the reference's limits: no long lines and no minified files but for secrets."""
    return S.detect(spark, _lines(spark, sf), max_line=S.REFERENCE_MAX_LINE, minified=False).select(*DET_COLS)


@register("scan_skipped", B.with_views(
    f"""SELECT repo_id, count(*) FILTER (WHERE length(text) > {S.REFERENCE_MAX_LINE}) AS long_lines,
    count(*) FILTER (WHERE is_minified) AS minified_lines FROM scan_lines WHERE text <> '' GROUP BY repo_id""",
    [("scan_files", O.scan_files_sql()), ("scan_lines", O.scan_lines_sql())]))
def scan_skipped(spark, sf):
    return S.skipped_lines(_lines(spark, sf), S.REFERENCE_MAX_LINE, minified=False)


# These four read ``t_samples``: documents with a line for each of the rules, and near misses
def _on_samples(rules):
    return B.with_views(f"SELECT repo_id, {O.DET_ID} AS id, rule_id, file, line, severity, confidence, category, cwe, vulnerable_code FROM det",
                        O.detect_ctes(rules, "t_samples"))


def sampled(spark, sf, rules):
    return S.detect(spark, S.prepare_lines(B.spark_view(spark, sf, "t_samples"), spread=True), rules).select(*DET_COLS)


@register("scan_secrets", _on_samples(SECRET_RULES))
def scan_secrets(spark, sf):
    return sampled(spark, sf, SECRET_RULES)


GENERAL_RULES = [r for r in VULN_RULES if r.scope == "all"]


@register("scan_vulnerabilities", _on_samples(GENERAL_RULES))
def scan_vulnerabilities(spark, sf):
    return sampled(spark, sf, GENERAL_RULES)


LANG_RULES = [r for r in VULN_RULES if r.scope not in ("all",)]


@register("scan_language_rules", _on_samples(LANG_RULES))
def scan_language_rules(spark, sf):
    return sampled(spark, sf, LANG_RULES)


@register("scan_config_rules", _on_samples(CONFIG_RULES))
def scan_config_rules(spark, sf):
    return sampled(spark, sf, CONFIG_RULES)


CTX_RULES = [r for r in VULN_RULES if r.context]


@register("scan_context_suppression", _det_sql(CTX_RULES))
def scan_context_suppression(spark, sf):
    return detector(spark, sf, CTX_RULES).select(*DET_COLS)


# user rule pack on the raw document text (fixed by the fixture: 40-hex tokens)
HEX_TOKEN = user_rule("ASSIGNED_HEX_TOKEN", "Assigned hex token", r'\btoken\s*=\s*"([0-9a-f]{40})"',
                      guard=("token",), groups=1)
CUSTOM_RULES = builtin_rules() + [HEX_TOKEN]


def _raw_docs_sql():
    return "SELECT source AS repo_id, CAST(doc_id AS VARCHAR) || '.txt' AS path, text AS content FROM documents"


@register("scan_custom_rules", B.with_views(
    f"SELECT repo_id, {O.DET_ID} AS id, rule_id, file, line, severity, confidence, category, cwe, vulnerable_code "
    f"FROM det", [("raw_docs", _raw_docs_sql())] + O.detect_ctes(CUSTOM_RULES, "raw_docs", False)))
def scan_custom_rules(spark, sf):
    docs = B.table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"))
    docs = docs.withColumn("kind", F.lit("source")).withColumn("language", X.language("path")) \
        .withColumn("depth", F.size(F.split("path", "/")))
    return S.detect(spark, S.prepare_lines(docs, spread=True), CUSTOM_RULES).select(*DET_COLS)


# the two bundled structural rules (any eval(...) call in JavaScript/TypeScript,
# any pickle.loads(...) call in Python; ERROR with HIGH impact -> CRITICAL),
# expressed as regex rows over the same scan
BUNDLED = [
    user_rule("bundled-eval", "Text run as code through eval", r"\beval\s*\(", flags="g",
              severity="CRITICAL", category="Injection", cwe="CWE-95", scope="lang:javascript,typescript",
              guard=("eval",)),
    user_rule("bundled-pickle-loads", "Pickle data loaded without a check of its origin", r"\bpickle\.loads\s*\(",
              flags="g", severity="CRITICAL", category="Injection", cwe="CWE-502", scope="lang:python",
              guard=("pickle.loads",)),
]


@register("scan_bundled_pack", _det_sql(BUNDLED))
def scan_bundled_pack(spark, sf):
    return detector(spark, sf, BUNDLED).select(*DET_COLS)


@register("src_split_lines", B.with_views("SELECT repo_id, path, line, text FROM t_lines"))
def src_split_lines(spark, sf):
    return B.lines_of(B.spark_view(spark, sf, "t_files"))


def _excluded_sql():
    return f"(regexp_matches(path, {Q.q(FS.EXCLUDED_DIR_RE)}) OR regexp_matches(path, {Q.q(FS.EXCLUDED_FILE_RE)}))"


@register("src_default_excludes", B.with_views(
    f"SELECT repo_id, path FROM t_files WHERE NOT {_excluded_sql()}"))
def src_default_excludes(spark, sf):
    return B.spark_view(spark, sf, "t_files").where(~FS.is_excluded("path")).select("repo_id", "path")


INVENTORY_SQL = f"""SELECT DISTINCT repo_id, path, category FROM (
  SELECT repo_id, path, 'source' AS category FROM t_files WHERE regexp_matches(path, {Q.q(FS.SOURCE_RE)})
  UNION ALL SELECT repo_id, path, 'config' FROM t_files WHERE regexp_matches(path, {Q.q(FS.CONFIG_RE)})
  UNION ALL SELECT repo_id, path, 'dependency' FROM t_files WHERE regexp_matches(path, {Q.q(FS.DEP_RE)})
  UNION ALL SELECT repo_id, path, 'baas' FROM t_files WHERE regexp_matches(path, {Q.q(FS.BAAS_RE)})
) WHERE NOT {_excluded_sql()}"""


@register("src_file_inventory", B.with_views(INVENTORY_SQL))
def src_file_inventory(spark, sf):
    return FS.file_inventory(B.spark_view(spark, sf, "t_files"))


# Bodies as bytes: as they are, with a NUL, with bytes that are no UTF-8 at the start or cut off at the end, and none at all
_BODY = """CASE doc_id % 6 WHEN 0 THEN CAST(content AS BINARY) WHEN 1 THEN concat(CAST(content AS BINARY), unhex('00'), unhex('41'))
  WHEN 2 THEN concat(unhex('C328FF'), CAST(content AS BINARY)) WHEN 3 THEN concat(CAST(content AS BINARY), unhex('E282'))
  WHEN 4 THEN unhex('') ELSE NULL END"""


@register("src_read_text", B.with_views("""SELECT repo_id, path, doc_id % 6 IN (1, 5) AS is_binary, t = '' AS is_empty, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest
FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN content WHEN 2 THEN chr(65533) || '(' || chr(65533) || content WHEN 3 THEN content || chr(65533) WHEN 4 THEN '' END AS t FROM t_files)"""))
def src_read_text(spark, sf):
    """Bodies of files as bytes: binary ones told apart, the others as valid text."""
    f = FS.read_text(B.spark_view(spark, sf, "t_files").withColumn("content", F.expr(_BODY)))
    return f.select("repo_id", "path", "is_binary", (F.col("content") == "").alias("is_empty"),
                    F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("digest"))


@register("prj_minified", B.with_views(
    "SELECT repo_id, path, (length(content) / len(string_split(content, chr(10))) > 500 OR "
    "list_bool_or(list_transform(string_split(content, chr(10)), lambda l: length(l) > 10000))) AS is_minified "
    "FROM t_files"))
def prj_minified(spark, sf):
    return FS.with_file_flags(B.spark_view(spark, sf, "t_files")).select("repo_id", "path", "is_minified")


@register("flt_binary_ext", B.with_views(
    "SELECT repo_id, path FROM t_files WHERE lower(CASE WHEN contains(path, '.') THEN '.' || split_part(path, '.', -1) "
    "ELSE path END) NOT IN (" + ",".join(Q.q(e) for e in BINARY_EXTENSIONS) + ")"))
def flt_binary_ext(spark, sf):
    return B.spark_view(spark, sf, "t_files").where(~X.is_binary_ext("path")).select("repo_id", "path")


@register("win_finding_id", B.with_views(
    f"SELECT repo_id, {O.DET_ID} AS id, rule_id, file, line, CAST(n AS BIGINT) AS repeat_no FROM det",
    O.detect_ctes(builtin_rules())))
def win_finding_id(spark, sf):
    d = detector(spark, sf)
    base = F.concat_ws("_", "rule_id", F.regexp_replace(F.regexp_replace("file", "[^a-zA-Z0-9]+", "-"),
                                                         "^-+|-+$", ""), F.col("line").cast("string"))
    n = F.when(F.col("id") == base, F.lit(0)).otherwise(
        F.substring_index("id", "_", -1).cast("bigint"))
    return d.select("repo_id", "id", "rule_id", "file", "line", n.alias("repeat_no"))
