"""Rule scan: every rule of a pack evaluated over line rows in ONE projection.

Plan shape (map-only, no shuffle until the finding-id window):

    lines --(guards: contains on raw / lower(text))--> array<struct(rule_ord, matches, groups)>
          --filter(size>0)--> explode --> explode(arrays_zip(matches, groups))

Patterns are literals, so each task compiles them once. A cheap ``contains``
guard per rule skips the regex on lines that cannot match (most lines).
Language- and kind-scoped rules are folded into the same projection as
``when`` guards: no physical join with the rule table is needed. Rule metadata
is attached afterwards by a broadcast join on ``rule_ord`` (size bound: number
of rules in the pack).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import columns as X
from ..rules.catalogue import CONTEXT_WORDS, LANGUAGE_SCOPES, Rule, builtin_rules, should_redact
from ..rules.dialect import any_of, to_java
from ..session import tasks

RULE_META_SCHEMA = ("rule_ord int, rule_id string, rule_name string, rule_severity string, rule_category string, "
                    "rule_cwe string, rule_owasp string, rule_confidence string, rule_vibe boolean, rule_pass int, "
                    "rule_redact boolean, rule_description string, rule_fix string, rule_references array<string>")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.id, r.name, r.severity, r.category, r.cwe, r.owasp, r.confidence, r.vibe_risk,
             0 if r.scope == "secret" else 1, should_redact(r), r.description, r.fix, list(r.references))
            for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_META_SCHEMA)


def _guard(rule: Rule, raw: Column, low: Column) -> Column | None:
    """``guard`` = literals of which one must occur; or a tuple of such groups,
    all of which must be satisfied (a necessary condition for a match)."""
    if not rule.guard:
        return None
    target = low if "i" in rule.flags else raw
    groups = rule.guard if isinstance(rule.guard[0], tuple) else (rule.guard,)
    cond = None
    for grp in groups:
        any_ = None
        for g in grp:
            c = target.contains(g)
            any_ = c if any_ is None else (any_ | c)
        cond = any_ if cond is None else (cond & any_)
    return cond


def candidate(rules: list[Rule]) -> Column | None:
    """One test of a line's lower-case text for the guards of all rules: a line without any
    of their literals can't match. None where a rule has no guard, or one beyond ASCII."""
    words = set()
    for r in rules:
        if not r.guard:
            return None
        groups = r.guard if isinstance(r.guard[0], tuple) else (r.guard,)
        words |= {g.lower() for g in max(groups, key=lambda grp: min(map(len, grp)))}  # any one group is necessary
    return F.col("_low").rlike(any_of(words)) if words and all(w.isascii() and w for w in words) else None


# FIXED VALUE: the line length beyond which the reference's vulnerability rules do not look
REFERENCE_MAX_LINE = 2000


def _scope(rule: Rule, max_line: int | None, minified: bool) -> Column:
    """Line/file applicability of a rule: non-empty lines, plus language/kind.

    For all but the secret rules ``max_line`` leaves out longer lines and
    ``minified=False`` minified files; by default nothing is left out.
    """
    text = F.col("text")
    cond = text != ""
    if rule.scope == "secret":
        return cond
    if max_line is not None:
        cond = cond & (F.length(text) <= max_line)
    if not minified:
        cond = cond & ~F.col("is_minified")
    if rule.scope == "config":
        cond = cond & F.col("kind").isin("config", "baas")
    elif rule.scope.startswith("lang:"):
        cond = cond & F.col("language").isin(*rule.scope[5:].split(","))
    elif rule.scope != "all":
        langs = [lang for lang, sc in LANGUAGE_SCOPES.items() if sc == rule.scope]
        cond = cond & F.col("language").isin(*langs)
    if rule.context:
        cond = cond & text.rlike(to_java(CONTEXT_WORDS[rule.id], "i")) & ~X.non_source("path")
    return cond


def skipped_lines(lines: DataFrame, max_line: int | None = None, minified: bool = True) -> DataFrame:
    """(repo_id, long_lines, minified_lines): how many lines the limits of
    ``rule_hits`` keep from all but the secret rules."""
    long = F.length("text") > max_line if max_line is not None else F.lit(False)
    mini = F.lit(False) if minified else F.col("is_minified")
    return lines.where(F.col("text") != "").groupBy("repo_id").agg(
        F.count_if(long).alias("long_lines"), F.count_if(mini).alias("minified_lines"))


def rule_hits(lines: DataFrame, rules: list[Rule], use_guards: bool = True, max_line: int | None = None,
              minified: bool = True) -> DataFrame:
    """One output row per (line, rule, match). Input needs ``text``, ``path``,
    ``language``, ``kind``, ``is_minified``."""
    raw = F.col("text")
    low = F.col("_low")
    elems = []
    for i, r in enumerate(rules):
        pat = F.lit(to_java(r.pattern, r.flags))
        g = _guard(r, raw, low) if use_guards else None
        # the cheap literal guard first: AND short-circuits, so scope regexes
        # (same-line context, non-source path) only run on candidate lines
        scope = _scope(r, max_line, minified)
        cond = scope if g is None else (g & scope)
        matches = F.regexp_extract_all(raw, pat, F.lit(0))
        groups = F.regexp_extract_all(raw, pat, F.lit(1)) if r.groups else F.array_repeat(F.lit(""), F.size(matches))
        elems.append(F.when(cond, F.struct(F.lit(i).alias("rule_ord"), matches.alias("m"), groups.alias("g"))))
    hits = F.filter(F.array(*elems), lambda e: e.isNotNull() & (F.size(e["m"]) > 0))
    lines = lines.withColumn("_low", F.lower(raw))
    some = candidate(rules) if use_guards else None
    out = ((lines if some is None else lines.where(some))
           .withColumn("_hit", F.explode(hits))
           .drop("_low")
           .withColumn("rule_ord", F.col("_hit.rule_ord"))
           .select("*", F.posexplode(F.arrays_zip(F.col("_hit.m").alias("m"), F.col("_hit.g").alias("g")))
                   .alias("match_no", "_mg"))
           .withColumn("match", F.col("_mg.m")).withColumn("group1", F.col("_mg.g"))
           .drop("_hit", "_mg"))
    return out


def prepare_lines(files: DataFrame, spread: bool = False) -> DataFrame:
    """Files (``repo_id, path, content`` + classification) -> scannable line rows.

    Drops binary-extension, binary and empty files; language falls back to the
    path; lines carry the file flags. Lines are scanned where they are read;
    ``spread`` deals them out by (repo_id, path, line) first, for an input of few
    splits. It is up to the caller and never guessed.
    """
    from ..sources import files as S
    f = files
    if "kind" not in f.columns:
        f = S.classify(f)
    f = f.where(~X.is_binary_ext("path"))
    f = S.with_file_flags(f).where(~F.col("is_binary") & ~F.col("is_empty"))
    f = f.withColumn("language", F.when(F.col("language") != "unknown", F.col("language")))
    keep = ["repo_id", "path", "language", "kind", "depth", "is_minified"]
    lines = S.split_lines(f.select(*keep, "_lines"), keep)
    if spread:
        lines = lines.repartition(tasks(lines.sparkSession), "repo_id", "path", "line")
    return lines


def detect(spark: SparkSession, lines: DataFrame, rules: list[Rule] | None = None,
           use_guards: bool = True, max_line: int | None = None, minified: bool = True) -> DataFrame:
    """``scan_detect``: rule hits -> canonical detector findings with ids,
    redaction and the non-source downgrade."""
    rules = rules if rules is not None else builtin_rules()
    return finish(spark, rule_hits(lines, rules, use_guards, max_line, minified), rules)


def finish(spark: SparkSession, hits: DataFrame, rules: list[Rule], repeat: Column | None = None) -> DataFrame:
    """Rule metadata, redaction/snippet, ids (repeat counter), non-source downgrade.
    ``repeat`` counts the findings of one rule and line, 0 for the first; by default it
    is numbered by a window, which a stream has not."""
    meta = F.broadcast(rule_table(spark, rules))
    f = hits.join(meta, "rule_ord")
    code = (F.when(F.col("rule_pass") == 0, X.redact_match("match", "group1"))
            .when(F.col("rule_redact"), X.redact_line("text", "match", "group1"))
            .otherwise(X.snippet("text", "match")))
    slug = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("path"), F.lit("unknown")), "[^a-zA-Z0-9]+", "-"),
                            "^-+|-+$", "")
    base_id = F.concat_ws("_", "rule_id", slug, F.col("line").cast("string"))
    w = Window.partitionBy("repo_id", "rule_id", "_base_id").orderBy("depth", "path", "match_no")
    downgrade = (F.col("rule_severity") != "INFO") & X.non_source("path")
    # the snippet / redaction is computed before the id window, so the shuffle
    # carries the short code text, not the (possibly very long) source line
    f = (f.withColumn("_code", code).drop("text", "group1")
         .withColumn("_base_id", base_id)
         .withColumn("_n", repeat if repeat is not None else F.row_number().over(w) - 1)
         .select(
             "repo_id",
             F.when(F.col("_n") > 0, F.concat_ws("_", "_base_id", F.col("_n").cast("string")))
              .otherwise(F.col("_base_id")).alias("id"),
             "rule_id",
             F.when(downgrade, F.lit("LOW")).otherwise(F.col("rule_severity")).alias("severity"),
             F.col("rule_category").alias("category"),
             F.col("rule_name").alias("name"),
             F.col("rule_description").alias("description"),
             F.col("path").alias("file"),
             "line",
             F.col("_code").alias("vulnerable_code"),
             F.col("rule_cwe").alias("cwe"),
             F.col("rule_owasp").alias("owasp"),
             F.col("rule_vibe").alias("vibe_risk"),
             X.compliance("rule_cwe").alias("compliance"),
             F.col("rule_fix").alias("fix"),
             F.when(downgrade, F.lit("LOW")).otherwise(F.col("rule_confidence")).alias("confidence"),
             F.lit("An attacker who reaches this code path may exploit the pattern.").alias("exploitation"),
             F.col("rule_references").alias("references"),
             F.lit(None).cast("string").alias("source"),
             "depth", "rule_pass", "rule_ord", "match_no", "match"))
    return f


# FIXED VALUES: the risk flags of a change and the patterns that raise them
RED_FLAGS = [
    ("dynamic-exec", r"\beval\s*\(|new\s+Function\s*\(", ""),
    ("process-exec", r"child_process|execSync|spawnSync|\bexecFile\b|\bspawn\s*\(", ""),
    ("new-network", r"\bfetch\s*\(|https?\.request|net\.connect|new\s+WebSocket|axios|node-fetch", ""),
    ("obfuscation", r"atob\s*\(|Buffer\.from\([^)]*['\"]base64['\"]\)|\\x[0-9a-f]{2}\\x[0-9a-f]{2}", "i"),
    ("dependency-change", r"\"(?:dependencies|devDependencies)\"\s*:", ""),
    ("safeguard-touch", r"redact|pathSafety|LOCAL_HOSTS|confirmed\s*!==\s*true|allow_force_pushes", ""),
]
RED_FLAG_NOTES = {
    "dynamic-exec": "builds or runs code at run time",
    "process-exec": "starts other programs",
    "new-network": "opens network connections",
    "obfuscation": "hides what it contains",
    "dependency-change": "changes what is installed",
    "safeguard-touch": "touches a protection",
}


def red_flags(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``scan_red_flags``: a row for each risk flag of a text (diff, update notes),
    with ``flag`` and ``note``."""
    found = F.array_compact(F.array(*[F.when(F.col(text_col).rlike(to_java(p, fl)), F.struct(
        F.lit(n).alias("flag"), F.lit(RED_FLAG_NOTES[n]).alias("note"))) for n, p, fl in RED_FLAGS]))
    return texts.select("*", F.inline(found))


def detect_distinct_content(spark: SparkSession, files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``scan_detect`` for fleets with vendored copies: each distinct content is
    scanned once per scan context, and hits are joined back to every path.

    The scan context is what rule applicability depends on besides the text:
    (language, config-or-baas, non-source path, minified). Path-dependent steps
    (ids, downgrade, snippets) run after the join. A content copied into a third
    of all repositories is scanned once; the join back is a skew-tolerant
    shuffle join (AQE splits the hot key).
    """
    from ..sources import files as S
    rules = rules if rules is not None else builtin_rules()
    f = files if "kind" in files.columns else S.classify(files)
    f = f.where(~X.is_binary_ext("path"))
    f = S.with_file_flags(f).where(~F.col("is_binary") & ~F.col("is_empty"))
    # '' for an unknown language: a null would not join
    f = (f.withColumn("language", F.when(F.col("language") != "unknown", F.col("language")).otherwise(F.lit("")))
         .withColumn("content_sha", F.sha2(F.col("content"), 256))
         .withColumn("_cfg", F.col("kind").isin("config", "baas"))
         .withColumn("_ns", X.non_source("path")))
    ctx = ["content_sha", "language", "_cfg", "_ns", "is_minified"]
    uniq = (f.select(*ctx, "content").dropDuplicates(ctx)
            .withColumn("kind", F.when(F.col("_cfg"), "config").otherwise("source"))
            # a representative path carrying the non-source flag for the context rules
            .withColumn("path", F.when(F.col("_ns"), F.lit("test/x")).otherwise(F.lit("src/x"))))
    lines = S.split_lines(uniq.withColumn("_lines", F.split("content", "\n", -1)), ctx + ["kind", "path"])
    hits = rule_hits(lines, rules).drop("path", "kind")
    paths = f.select("repo_id", "path", "depth", *ctx)
    joined = hits.join(paths, ctx).drop("content_sha", "_cfg", "_ns")
    return finish(spark, joined, rules)
