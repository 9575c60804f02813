"""DuckDB SQL fragments mirroring ``functions.columns`` (oracle side only).

These render the same semantics in DuckDB's dialect (RE2 regexes, ``'g'`` flag
for global replacement) so each registered query has an independent SQL
statement to be checked against.
"""
from __future__ import annotations

from ..functions import catalogs as C

WS = ("[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}"
      "\\x{3000}\\x{FEFF}]")


def q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def s(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def nonempty(x: str) -> str:
    return f"({x} IS NOT NULL AND CAST({x} AS VARCHAR) <> '')"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def key_part(x: str) -> str:
    return f"regexp_replace(replace(lower({js_trim(s(x))}), '\\', '/'), '{WS}+', ' ', 'g')"


def canonical_cwe(x: str) -> str:
    return f"upper(regexp_extract({s(x)}, '(?i)CWE-\\d+', 0))"


def dedup_key(file="file", line="line", cwe="cwe", category="category", name="name") -> str:
    cw = canonical_cwe(cwe)
    head = f"{key_part(file)} || ':' || CAST(coalesce(CAST({line} AS BIGINT), 0) AS VARCHAR)"
    return (f"CASE WHEN {cw} <> '' THEN {head} || ':' || {cw} "
            f"ELSE {head} || ':' || {key_part(category)} || ':' || {key_part(name)} END")


def fingerprint(file="file", cwe="cwe", category="category", name="name") -> str:
    cw = canonical_cwe(cwe)
    return (f"{key_part(file)} || '|' || CASE WHEN {cw} <> '' THEN {cw} ELSE {key_part(category)} END || '|' || "
            f"{key_part(name)}")


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def severity_audit(x: str) -> str:
    u = f"upper({s(x)})"
    return (f"(CASE WHEN {u} IN ('CRITICAL','HIGH','LOW') THEN {u} WHEN {u} IN ('MEDIUM','MODERATE') THEN 'MEDIUM' "
            f"ELSE 'INFO' END)")


def severity_rank(x: str) -> str:
    return case_map(severity_audit(x), C.SEVERITY_RANK, "0")


def confidence_rank(x: str) -> str:
    return case_map(f"upper({s(x)})", C.CONFIDENCE_RANK, "0")


def finding_source(x: str) -> str:
    return f"(CASE WHEN {nonempty(x)} THEN {x} ELSE 'detector' END)"


def non_source(x: str) -> str:
    pat = C.NON_SOURCE_PATH.replace("(?i)", "")
    return f"regexp_matches({s(x)}, {q(pat)}, 'i')"


def extension(x: str) -> str:
    return f"(CASE WHEN contains({s(x)}, '.') THEN lower(split_part({s(x)}, '.', -1)) ELSE '' END)"


def language(x: str) -> str:
    return case_map(extension(x), C.LANG_MAP, "'unknown'")


def basename(x: str) -> str:
    return f"split_part({s(x)}, '/', -1)"


def redact_secret(v: str) -> str:
    return (f"(CASE WHEN {v} IS NULL OR {v} = '' THEN '[REDACTED]' WHEN length({v}) > 4 THEN "
            f"'[REDACTED:' || length({v}) || ':...' || right({v}, 4) || ']' ELSE '[REDACTED]' END)")


def snippet(text: str, match: str, size: int = 2000) -> str:
    """The trimmed text, or the part of it around the match."""
    t, m = js_trim(text), match
    idx = f"(CASE WHEN {m} <> '' THEN strpos({t}, {m}) - 1 ELSE -1 END)"
    ctx = f"greatest(0, CAST(floor(({size} - length({m}) - 6) / 2) AS INTEGER))"
    start, end = f"greatest(0, {idx} - {ctx})", f"least(length({t}), {idx} + length({m}) + {ctx})"
    return (f"(CASE WHEN length({t}) <= {size} THEN {t} WHEN {idx} < 0 THEN substr({t}, 1, {size - 3}) || '...' "
            f"ELSE (CASE WHEN {start} > 0 THEN '...' ELSE '' END) || substr({t}, {start} + 1, {end} - {start}) || "
            f"(CASE WHEN {end} < length({t}) THEN '...' ELSE '' END) END)")


def replace_first(text: str, target: str, repl: str) -> str:
    pos = f"strpos({text}, {target})"
    return (f"(CASE WHEN {pos} > 0 THEN substr({text}, 1, {pos} - 1) || {repl} || "
            f"substr({text}, {pos} + length({target})) ELSE {text} END)")


def redact_match(m: str, g: str) -> str:
    return f"(CASE WHEN {nonempty(g)} THEN {replace_first(m, g, redact_secret(g))} ELSE {redact_secret(m)} END)"


def bool_str(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"
