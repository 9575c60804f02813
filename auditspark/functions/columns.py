"""Column expressions shared by the operators (the ``prj_*`` family).

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation; nothing here is a Python UDF.
"""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalogs as C

# JavaScript whitespace (String.prototype.trim and /\s/)
JS_WS = "[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_map(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def lookup(d: dict, key, default=None) -> Column:
    v = F.try_element_at(lit_map(d), col(key))
    return v if default is None else F.coalesce(v, F.lit(default))


def s(c) -> Column:
    """JavaScript ``String(x || '')``: null becomes ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def nonempty(c) -> Column:
    return col(c).isNotNull() & (col(c).cast("string") != "")


def or_else(a, b) -> Column:
    """JavaScript ``a || b`` for strings."""
    return F.when(nonempty(a), col(a)).otherwise(col(b))


# the same set minus the plain space, for character-wise translation
OTHER_WS = "\t\n\u000b\f\r\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + \
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
ALL_WS = [" "] + list(OTHER_WS)


def js_trim(c) -> Column:
    """Trim JavaScript whitespace; the regex only runs when an end is whitespace."""
    c = col(c)
    ends = F.substring(c, 1, 1).isin(*ALL_WS) | F.substring(c, -1, 1).isin(*ALL_WS)
    return F.when(ends, F.regexp_replace(c, f"^{JS_WS}+|{JS_WS}+\\z", "")).otherwise(c)


def _spaces(c) -> Column:
    return F.translate(col(c), OTHER_WS, " " * len(OTHER_WS))


def _squeeze(t: Column) -> Column:
    return F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t)


def collapse_ws(c) -> Column:
    """Runs of whitespace -> one space (character translation, regex only on runs)."""
    return _squeeze(_spaces(c))


def norm_path(c) -> Column:
    """Backslashes to slashes, leading ``./`` removed (ignore / SARIF form)."""
    return F.regexp_replace(F.regexp_replace(js_trim(s(c)), "\\\\", "/"), "^\\./", "")


def key_part(c) -> Column:
    """trim, lower-case, ``\\`` -> ``/``, whitespace runs -> one space.

    Whitespace is first translated to plain spaces character by character, so
    trimming is ``trim`` and only strings with a run of spaces see a regex."""
    t = F.translate(F.lower(F.trim(_spaces(s(c)))), "\\", "/")
    return _squeeze(t)


def canonical_cwe(c) -> Column:
    return F.upper(F.regexp_extract(s(c), "(?i)CWE-\\d+", 0))


def tool_cwe(c) -> Column:
    v = canonical_cwe(c)
    return F.when(v == "", F.lit("N/A")).otherwise(v)


def severity_audit(c) -> Column:
    """Audit / OSV / partial severity: MODERATE -> MEDIUM, anything else INFO."""
    u = F.upper(s(c))
    return (F.when(u.isin("CRITICAL", "HIGH", "LOW"), u)
            .when(u.isin("MEDIUM", "MODERATE"), F.lit("MEDIUM"))
            .otherwise(F.lit("INFO")))


def severity_tool(c, default: str = "MEDIUM") -> Column:
    """Extra-tool severity words, see ``catalogs.TOOL_SEVERITY``."""
    return lookup(C.TOOL_SEVERITY, F.upper(s(c)), default)


def severity_opengrep(sev, impact) -> Column:
    u = F.upper(s(sev))
    return (F.when(u == "ERROR", F.when(F.upper(s(impact)) == "HIGH", F.lit("CRITICAL")).otherwise(F.lit("HIGH")))
            .when(u == "WARNING", F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


def severity_sarif(c) -> Column:
    u = F.upper(s(c))
    return F.when(u.isin(*C.SARIF_LEVEL.keys()), u).otherwise(F.lit("MEDIUM"))


def severity_rank(c) -> Column:
    return lookup(C.SEVERITY_RANK, severity_audit(c), 0)


def confidence_rank(c) -> Column:
    return lookup(C.CONFIDENCE_RANK, F.upper(s(c)), 0)


def finding_source(c) -> Column:
    return F.when(nonempty(c), col(c)).otherwise(F.lit(C.DETECTOR))


def is_detector(c) -> Column:
    return finding_source(c) == C.DETECTOR


def key_line(c) -> Column:
    """Line as used in the dedup key: null counts as 0, a non-numeric value as 1
    (JavaScript ``Number(null) = 0``, ``Number('x')`` is not finite)."""
    c = col(c)
    return F.when(c.isNull(), F.lit("0")).otherwise(F.coalesce(c.try_cast("bigint").cast("string"), F.lit("1")))


def dedup_key(file, line, cwe, category, name) -> Column:
    cw = canonical_cwe(cwe)
    head = F.concat_ws(":", key_part(file), key_line(line))
    return F.when(cw != "", F.concat_ws(":", head, cw)).otherwise(
        F.concat_ws(":", head, key_part(category), key_part(name)))


def fingerprint(file, cwe, category, name) -> Column:
    cw = canonical_cwe(cwe)
    return F.concat_ws("|", key_part(file), F.when(cw != "", cw).otherwise(key_part(category)), key_part(name))


def extension(path) -> Column:
    """Text after the last ``.`` of the whole path, lower-cased ('' if none)."""
    p = s(path)
    return F.when(p.contains("."), F.lower(F.substring_index(p, ".", -1))).otherwise(F.lit(""))


def language(path) -> Column:
    return lookup(C.LANG_MAP, extension(path), "unknown")


def basename(path) -> Column:
    return F.substring_index(s(path), "/", -1)


def node_extname(path) -> Column:
    """Node ``path.extname`` without the dot (case kept, no leading-dot files)."""
    return F.regexp_extract(basename(path), "^.+\\.([^.]*)\\z", 1)


def tech_label(path) -> Column:
    return lookup(C.EXTENSION_TO_TECH, node_extname(path))


def dot_extension(path) -> Column:
    """``path.slice(path.lastIndexOf('.')).toLowerCase()`` (whole path when no dot)."""
    p = s(path)
    return F.lower(F.when(p.contains("."), F.concat(F.lit("."), F.substring_index(p, ".", -1))).otherwise(p))


def is_binary_ext(path) -> Column:
    return dot_extension(path).isin(*C.BINARY_EXTENSIONS)


def non_source(path) -> Column:
    return s(path).rlike(C.NON_SOURCE_PATH)


def redact_secret(v) -> Column:
    v = col(v)
    n = F.length(v)
    return (F.when(v.isNull() | (v == ""), F.lit("[REDACTED]"))
            .when(n > 4, F.concat(F.lit("[REDACTED:"), n.cast("string"), F.lit(":..."), F.substring(v, -4, 4),
                                  F.lit("]")))
            .otherwise(F.lit("[REDACTED]")))


def replace_first(text, target, repl) -> Column:
    """JavaScript ``text.replace(target, repl)`` with a literal target."""
    return _replace_first(col(text), col(target), col(repl))


def _replace_first(text: Column, target: Column, repl: Column) -> Column:
    pos = F.position(target, text)
    return F.when(pos > 0, F.concat(text.substr(F.lit(1), pos - 1), repl,
                                    text.substr(pos + F.length(target), F.length(text) + 1))).otherwise(text)


def redact_match(match, group) -> Column:
    """Redact the captured secret inside the match, else the whole match."""
    match, group = col(match), col(group)
    return F.when(nonempty(group), _replace_first(match, group, redact_secret(group))).otherwise(
        redact_secret(match))


def redact_line(text, match, group) -> Column:
    t = js_trim(col(text))
    return _replace_first(t, col(match), redact_match(match, group))


def snippet(text, match, max_len: int = 2000) -> Column:
    """Trimmed line; longer than ``max_len`` -> window centred on the match."""
    t = js_trim(col(text))
    m = s(match)
    n = F.length(t)
    idx = F.when(m != "", F.position(m, t) - 1).otherwise(F.lit(-1))
    ctx = F.greatest(F.lit(0), F.floor((F.lit(max_len) - F.length(m) - 6) / 2).cast("int"))
    start = F.greatest(F.lit(0), idx - ctx)
    end = F.least(n, idx + F.length(m) + ctx)
    windowed = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), t.substr(start + 1, end - start),
                        F.when(end < n, F.lit("...")).otherwise(F.lit("")))
    return (F.when(n <= max_len, t)
            .when(idx < 0, F.concat(t.substr(F.lit(1), F.lit(max_len - 3)), F.lit("...")))
            .otherwise(windowed))


def compliance(cwe) -> Column:
    return lookup(C.COMPLIANCE_MAP, col(cwe), "")


def owasp_code(owasp, category) -> Column:
    """The finding's own OWASP text, else the code for its category, else null."""
    return F.when(nonempty(owasp), col(owasp)).otherwise(F.try_element_at(lit_map(C.OWASP_CATEGORY_MAP), s(category)))


def cwe_url(cwe) -> Column:
    n = F.regexp_extract(s(cwe), "(?i)CWE-(\\d+)", 1)
    return F.when(n != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), n, F.lit(".html"))) \
        .otherwise(F.lit(""))


def owasp_url(owasp) -> Column:
    o = s(owasp)
    num = F.regexp_extract(o, "A(\\d{2}):(\\d{4})", 1).try_cast("int")
    page = F.try_element_at(F.array(*[F.lit(p) for p in C.OWASP_TOP10_PAGES]), num)
    return (F.when(o == "", F.lit(""))
            .when(num.between(1, 10), F.concat(F.lit("https://owasp.org/Top10/"), page, F.lit("/")))
            .otherwise(F.lit("https://owasp.org/Top10/")))


def source_label(source) -> Column:
    v = finding_source(source)
    return (F.when(v.startswith("subagent:"), F.concat(F.lit("Subagent: "), v.substr(F.lit(10), F.length(v))))
            .otherwise(F.coalesce(F.try_element_at(lit_map(C.SOURCE_LABELS), v), v)))


def score_band(score) -> Column:
    sc = col(score)
    return (F.when(sc >= 80, F.lit("Good")).when(sc >= 60, F.lit("Fair")).when(sc >= 40, F.lit("Poor"))
            .otherwise(F.lit("Critical")))


def js_round(x) -> Column:
    """``Math.round``: half rounds up (towards +inf)."""
    return F.floor(col(x) + F.lit(0.5)).cast("bigint")


def sarif_rule_id(cwe, category) -> Column:
    cw = canonical_cwe(cwe)
    cat = js_trim(s(category))
    return F.when(cw != "", cw).when(cat != "", F.regexp_replace(cat, f"{JS_WS}+", "-")).otherwise(
        F.lit("auditspark-finding"))


def sarif_level(sev) -> Column:
    return lookup(C.SARIF_LEVEL, severity_sarif(sev), "warning")


def security_severity(sev) -> Column:
    return lookup(C.SECURITY_SEVERITY, severity_sarif(sev), "5.0")


def sarif_message(name, description, fix) -> Column:
    first_fix = F.substring_index(s(fix), "\n", 1)
    return F.concat_ws(" — ", F.when(nonempty(name), col(name).cast("string")).otherwise(F.lit("Security finding")),
                       F.when(nonempty(description), col(description)),
                       F.when(nonempty(fix), F.concat(F.lit("Remediation: "), first_fix)))


def sarif_fingerprint(file, cwe, category, name) -> Column:
    uri = F.lower(sarif_uri(file))
    cw = canonical_cwe(cwe)
    nm = collapse_ws(F.lower(js_trim(s(name))))
    return F.concat_ws(":", uri, F.when(cw != "", cw).otherwise(F.lower(s(category))), nm)


def sarif_uri(file) -> Column:
    f = F.when(nonempty(file), col(file)).otherwise(F.lit("unknown"))
    return F.regexp_replace(F.regexp_replace(f, "\\\\", "/"), "^\\./", "")


def tool_line(c) -> Column:
    """Tool report line: a number > 0 is floored, anything else is 1."""
    n = col(c).cast("string").try_cast("double")
    return F.when(n.isNotNull() & (n > 0) & ~F.isnan(n), F.floor(n)).otherwise(F.lit(1)).cast("int")
