"""DuckDB oracle text for the rule scan, rendered from the rule catalogue.

RE2 cannot run negative look-ahead; for the eight rules that use it the oracle
drops the look-ahead group (so it may over-match where the look-ahead would
reject). The fixture has no such line; the look-ahead behaviour itself is
covered by unit tests against hand-written lines.
"""
from __future__ import annotations

from ..functions import catalogs as C
from ..rules.catalogue import CONTEXT_WORDS, LANGUAGE_SCOPES, Rule, should_redact
from ..rules.dialect import to_re2
from ..sources import files as S
from . import sqlfrag as Q


def strip_lookahead(p: str) -> str:
    out, i = [], 0
    while i < len(p):
        if p.startswith("(?!", i) and (i == 0 or p[i - 1] != "\\"):
            depth, j = 0, i
            while j < len(p):
                if p[j] == "\\":
                    j += 2
                    continue
                if p[j] == "(":
                    depth += 1
                elif p[j] == ")":
                    depth -= 1
                    if depth == 0:
                        break
                j += 1
            i = j + 1
            continue
        out.append(p[i])
        i += 1
    return "".join(out)


def rule_re2(r: Rule) -> str:
    p = strip_lookahead(r.pattern) if r.lookahead else r.pattern
    return to_re2(p, r.flags)


def scope_sql(r: Rule, max_line: int | None = None, minified: bool = True) -> str:
    if r.scope == "secret":
        return "text <> ''"
    cond = "text <> ''"
    if max_line is not None:
        cond += f" AND length(text) <= {max_line}"
    if not minified:
        cond += " AND NOT is_minified"
    if r.scope == "config":
        cond += " AND kind IN ('config','baas')"
    elif r.scope.startswith("lang:"):
        cond += " AND language IN (" + ",".join(Q.q(x) for x in r.scope[5:].split(",")) + ")"
    elif r.scope != "all":
        langs = ",".join(Q.q(lang) for lang, sc in LANGUAGE_SCOPES.items() if sc == r.scope)
        cond += f" AND language IN ({langs})"
    if r.context:
        cond += f" AND regexp_matches(text, {Q.q(CONTEXT_WORDS[r.id])}, 'i') AND NOT {Q.non_source('path')}"
    return cond


def scan_files_sql(files_view: str = "t_files", classify: bool = True) -> str:
    """Classified, scannable files with flags (DuckDB)."""
    cats = (f"regexp_matches(path, {Q.q(S.SOURCE_RE)}) OR regexp_matches(path, {Q.q(S.CONFIG_RE)}) OR "
            f"regexp_matches(path, {Q.q(S.BAAS_RE)})")
    kind = (f"CASE WHEN regexp_matches(path, {Q.q(S.BAAS_RE)}) THEN 'baas' "
            f"WHEN regexp_matches(path, {Q.q(S.CONFIG_RE)}) THEN 'config' ELSE 'source' END")
    excluded = f"(regexp_matches(path, {Q.q(S.EXCLUDED_DIR_RE)}) OR regexp_matches(path, {Q.q(S.EXCLUDED_FILE_RE)}))"
    binext = ",".join(Q.q(e) for e in C.BINARY_EXTENSIONS)
    dotext = "lower(CASE WHEN contains(path, '.') THEN '.' || split_part(path, '.', -1) ELSE path END)"
    if not classify:
        kind, excluded, cats = "'source'", "FALSE", "TRUE"
    return f"""SELECT repo_id, path, content, {kind} AS kind,
  CASE WHEN {Q.language('path')} = 'unknown' THEN NULL ELSE {Q.language('path')} END AS language,
  len(string_split(path, '/')) AS depth,
  (length(content) / len(string_split(content, chr(10))) > 500
   OR list_bool_or(list_transform(string_split(content, chr(10)), lambda l: length(l) > 10000))) AS is_minified
FROM {files_view}
WHERE NOT {excluded} AND ({cats}) AND {dotext} NOT IN ({binext})
  AND content IS NOT NULL AND content <> '' AND strpos(content, chr(0)) = 0"""


def scan_lines_sql() -> str:
    return """SELECT repo_id, path, kind, language, depth, is_minified,
  CAST(unnest(generate_series(1, len(a))) AS INTEGER) AS line, unnest(a) AS text
FROM (SELECT *, string_split(content, chr(10)) AS a FROM scan_files)"""


def hits_sql(rules: list[Rule], max_line: int | None = None, minified: bool = True) -> str:
    parts = []
    for i, r in enumerate(rules):
        pat = Q.q(rule_re2(r))
        g = f"regexp_extract_all(text, {pat}, 1)" if r.groups else "list_transform(ms, lambda x: '')"
        parts.append(f"""SELECT repo_id, path, line, text, depth, {i} AS rule_ord,
  unnest(ms) AS match, unnest(gs) AS grp, unnest(range(len(ms))) AS match_no
FROM (SELECT *, {g} AS gs FROM (SELECT *, regexp_extract_all(text, {pat}, 0) AS ms FROM scan_lines
      WHERE {scope_sql(r, max_line, minified)}) WHERE len(ms) > 0)""")
    return "\nUNION ALL\n".join(parts)


def rules_values(rules: list[Rule]) -> str:
    rows = []
    for i, r in enumerate(rules):
        rows.append(f"({i}, {Q.q(r.id)}, {Q.q(r.severity)}, {Q.q(r.category)}, {Q.q(r.cwe)}, {Q.q(r.confidence)}, "
                    f"{0 if r.scope == 'secret' else 1}, {str(should_redact(r)).upper()})")
    return ("SELECT * FROM (VALUES " + ",\n".join(rows) +
            ") AS v(rule_ord, rule_id, rule_severity, category, cwe, rule_confidence, rule_pass, rule_redact)")


def detect_ctes(rules: list[Rule], files_view: str = "t_files", classify: bool = True, max_line: int | None = None,
                minified: bool = True) -> list[tuple[str, str]]:
    code = (f"CASE WHEN rule_pass = 0 THEN {Q.redact_match('match', 'grp')} "
            f"WHEN rule_redact THEN {Q.replace_first(Q.js_trim('text'), 'match', Q.redact_match('match', 'grp'))} "
            f"ELSE {Q.snippet('text', 'match')} END")
    slug = "regexp_replace(regexp_replace(path, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    down = f"(rule_severity <> 'INFO' AND {Q.non_source('path')})"
    findings = f"""SELECT repo_id, rule_id, path AS file, line, category, cwe,
  CASE WHEN {down} THEN 'LOW' ELSE rule_severity END AS severity,
  CASE WHEN {down} THEN 'LOW' ELSE rule_confidence END AS confidence,
  {code} AS vulnerable_code, base_id, depth, match_no
FROM (SELECT h.*, r.*, rule_id || '_' || {slug} || '_' || CAST(line AS VARCHAR) AS base_id
      FROM hits h JOIN rules r USING (rule_ord))"""
    ided = """SELECT *, row_number() OVER (PARTITION BY repo_id, rule_id, base_id ORDER BY depth, file, match_no) - 1 AS n
FROM det_raw"""
    return [("scan_files", scan_files_sql(files_view, classify)), ("scan_lines", scan_lines_sql()),
            ("hits", hits_sql(rules, max_line, minified)), ("rules", rules_values(rules)), ("det_raw", findings), ("det", ided)]


DET_ID = "CASE WHEN n > 0 THEN base_id || '_' || CAST(n AS VARCHAR) ELSE base_id END"
