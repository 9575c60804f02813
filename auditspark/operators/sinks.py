"""Sinks: SARIF 2.1.0 documents, findings JSON export, baseline documents.

Documents are assembled per repository *chunk*: results are bucketed by a
hash of their dedup key into ``ceil(n / max_results)`` documents (about
``max_results`` each), so no single repository, however large, is gathered
into one row. SARIF allows any
number of log files per analysis; rule metadata comes from the first finding
of each rule id across the whole repository (a partial-aggregated ``min``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from .suppress import baseline_entries


def sarif_rules(findings: DataFrame, order_col: str = "first_seq", g=("repo_id",)) -> DataFrame:
    """One rule per (repo, rule id), metadata from the first finding carrying it."""
    f = findings.withColumn("rule_id", X.sarif_rule_id("cwe", "category"))
    first = F.min(F.struct(F.col(order_col).alias("o"), X.s("category").alias("category"), X.s("cwe").alias("cwe"),
                           X.s("severity").alias("severity"), X.s("owasp").alias("owasp")))
    r = f.groupBy(*g, "rule_id").agg(first.alias("_f"))
    cat = F.col("_f.category")
    name = F.regexp_replace(F.when(cat != "", cat).otherwise(F.col("rule_id")), "[^A-Za-z0-9]", "")
    return r.select(*g, "rule_id", F.when(name != "", name).otherwise(F.lit("Finding")).alias("name"),
                    F.when(cat != "", cat).otherwise(F.col("rule_id")).alias("short_description"),
                    F.when(X.cwe_url("_f.cwe") != "", X.cwe_url("_f.cwe")).alias("help_uri"),
                    X.security_severity("_f.severity").alias("security_severity"),
                    F.col("_f.owasp").alias("owasp"))


def sarif_results(findings: DataFrame) -> DataFrame:
    return findings.select(
        "*",
        F.struct(
            X.sarif_rule_id("cwe", "category").alias("ruleId"),
            X.sarif_level("severity").alias("level"),
            F.struct(X.sarif_message("name", "description", "fix").alias("text")).alias("message"),
            F.array(F.struct(F.struct(
                F.struct(X.sarif_uri("file").alias("uri")).alias("artifactLocation"),
                F.struct(F.greatest(F.lit(1), F.coalesce(F.col("line").cast("int"), F.lit(1))).alias("startLine"))
                .alias("region")).alias("physicalLocation"))).alias("locations"),
            F.struct(X.sarif_fingerprint("file", "cwe", "category", "name").alias("auditsparkFingerprint"))
            .alias("partialFingerprints"),
            F.struct(X.severity_sarif("severity").alias("severity"),
                     F.coalesce(F.when(X.nonempty("confidence"), F.col("confidence")), F.lit("N/A")).alias("confidence"),
                     F.when(X.canonical_cwe("cwe") != "", X.canonical_cwe("cwe")).alias("cwe"),
                     F.coalesce(F.col("vibe_risk"), F.lit(False)).alias("vibeRisk"),
                     X.finding_source("source").alias("source")).alias("properties"),
        ).alias("_result"))


def to_sarif(findings: DataFrame, max_results: int = 5000, order_col: str = "first_seq", version: str = "0.1.0",
             g=("repo_id",), repos: DataFrame | None = None) -> DataFrame:
    """``snk_sarif``: (repo_id, part, parts, sarif_json). Never includes the code snippet.

    A repository of more than ``max_results`` findings is several documents of
    about that many, each of which says which ``part`` of how many ``parts`` it
    is; every document is whole by itself. Repositories of ``repos`` without
    findings get one empty document. Result arrays are built once and joined
    once with the rules of their document.
    """
    key = list(g)
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / max_results)).cast("long")
    counts = findings.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(*key, parts.alias("parts"))
    res = sarif_results(findings).select(*key, order_col, "dedup_key", "_result").join(counts, key)
    res = res.withColumn("part", F.pmod(F.xxhash64("dedup_key"), F.col("parts")) + 1)
    docs = res.groupBy(*key, "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("_result").alias("r")))).alias("_rs"))
    rule_struct = F.struct(F.col("rule_id").alias("id"), "name",
                           F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
                           F.col("help_uri").alias("helpUri"),
                           F.struct(F.col("security_severity").alias("security-severity"),
                                    F.array_compact(F.array(F.lit("security"), F.when(X.nonempty("owasp"),
                                                                                      F.col("owasp")))).alias("tags"))
                           .alias("properties"))
    used = res.select(*key, "part", F.col("_result.ruleId").alias("rule_id")).distinct()
    rules = used.join(sarif_rules(findings, order_col, g), [*key, "rule_id"]).groupBy(*key, "part").agg(
        F.array_sort(F.collect_list(rule_struct)).alias("_rules"))
    # every part of every repository, an empty one too where no result fell
    every = counts if repos is None else counts.join(repos.select(*key).distinct(), key, "full")
    every = every.select(*key, F.coalesce("parts", F.lit(1).cast("long")).alias("parts"))
    every = every.select(*key, "parts", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))).alias("part"))
    every = every.join(docs, [*key, "part"], "left").join(rules, [*key, "part"], "left")
    rule_type = "array<" + rules.schema["_rules"].dataType.elementType.simpleString().replace("security-severity", "`security-severity`") + ">"
    doc = F.struct(
        F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"),
        F.lit("2.1.0").alias("version"),
        F.array(F.struct(
            F.struct(F.struct(F.lit("auditspark").alias("name"), F.lit(version).alias("version"),
                              F.coalesce("_rules", F.array().cast(rule_type)).alias("rules")).alias("driver")).alias("tool"),
            F.coalesce(F.transform("_rs", lambda x: x["r"]), F.array()).alias("results"),
            F.struct(F.col("part"), F.col("parts")).alias("properties"))).alias("runs"))
    return every.select(*key, "part", "parts", F.to_json(doc).alias("sarif_json"))


def findings_export(findings: DataFrame, score: DataFrame, g=("repo_id",)) -> DataFrame:
    """``snk_findings_json``: one JSON line per finding with the repository score;
    write with ``.write.partitionBy('repo_id').json(path)``."""
    cols = ["id", "severity", "category", "name", "file", "line", "cwe", "confidence", "source"]
    f = findings.join(score.select(*g, "score"), list(g), "left")
    return f.select(*g, F.to_json(F.struct(*[F.col(c) for c in cols if c in findings.columns],
                                           F.col("score"))).alias("finding_json"))


def write_findings_json(findings: DataFrame, score: DataFrame, path: str) -> None:
    findings_export(findings, score).write.mode("overwrite").partitionBy("repo_id").text(path)


def write_baseline(findings: DataFrame, path: str) -> None:
    """Baseline entries as JSON lines per repository (sorted within files)."""
    e = baseline_entries(findings)
    # a range of (repository, fingerprint) for each task: a large repository is several files
    (e.repartitionByRange("repo_id", "fingerprint").sortWithinPartitions("repo_id", "fingerprint")
     .write.mode("overwrite").partitionBy("repo_id").json(path))
