"""Fleet run: the whole audit for many repositories.

    files --scan--> detector findings --+
    tool reports --normalise-----------+--> ordered union --> [checkpoint] --> corroborate --> [checkpoint] --> ignore flag --> baseline flag --> [checkpoint]
    partial documents --validate-------+        --> findings / suppressed / baselined / score / summary / SARIF

Sources are merged in their fixed order (``corroborate.SOURCE_ORDER``), detector
findings by severity first. The union is written to the cluster's shared
``spark.checkpoint.dir`` (as Parquet, of which each reader takes its columns) before it is
merged, as the fold reads it for its rows and again for their references; the merged table
before it is flagged, as the ignore flag reads it for its paths and again for its rows; and
the flagged table for the results: parsers, scan and fold run once.
``checkpoint=False`` keeps all of it lazy.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import columns as X
from ..operators import corroborate as D
from ..operators import ignore_rules as IG
from ..operators import normalize as N
from ..operators import reports as R
from ..operators import scan as S
from ..operators import sinks as K
from ..operators import suppress as SP
from ..rules.catalogue import Rule, builtin_rules
from ..session import written
from ..session import written as materialize
from ..sources import files as FS
from ..sources.partials import valid_partials


@dataclass
class FleetResult:
    merged: DataFrame        # every finding with ``suppressed`` and ``known`` (checkpointed)
    findings: DataFrame      # neither suppressed nor known
    suppressed: DataFrame
    baselined: DataFrame
    score: DataFrame
    summary: DataFrame


def _order(severity=None, depth=None, path=None, rule_pass=None, rule_ord=None, line=None, match_no=None, tool=None,
           run_id=None, name=None, ordinal=None) -> list[Column]:
    """The typed order key of all kinds of sources; what a kind lacks is null."""
    cols = [("severity", severity, "int"), ("depth", depth, "int"), ("path", path, "string"), ("rule_pass", rule_pass, "int"),
            ("rule_ord", rule_ord, "int"), ("line", line, "int"), ("match_no", match_no, "int"), ("tool", tool, "int"),
            ("run_id", run_id, "bigint"), ("name", name, "string"), ("ordinal", ordinal, "bigint")]
    return [(F.lit(None) if c is None else c).cast(t).alias(n) for n, c, t in cols]


def merge_findings(spark: SparkSession, files: DataFrame, reports: DataFrame | None = None, partials: DataFrame | None = None,
                   rules: list[Rule] | None = None, spread: bool = False, once: bool = False) -> DataFrame:
    """The corroborated findings of all sources, merged in the fixed order. ``once`` writes
    the findings before they are merged: the fold reads them, and again their references,
    and sources are scanned and parsed only once."""
    det = S.detect(spark, S.prepare_lines(files, spread), rules if rules is not None else builtin_rules())
    det_order = _order(R.sev_order("severity", 99), F.col("depth"), F.col("file"), F.col("rule_pass"), F.col("rule_ord"), F.col("line"),
                       F.col("match_no"))
    parts, order, ranks = {"detector": det}, {"detector": det_order}, {}
    if reports is not None:
        # one part for the tools of all kinds, so that reports are read and parsed once
        tools = N.normalize_all(reports)
        names = [t for k in D.SOURCE_ORDER for t in D.SOURCE_TOOLS[k]]
        rank = X.lookup({t: i for i, t in enumerate(names)}, F.col("source"), len(names))
        # those of normalisers that users registered are extra tools too
        parts["extra"], ranks["extra"] = tools.where(~F.col("source").isin(*D.SOURCE_TOOLS["detector"])), D.source_rank(F.col("source"))
        order["extra"] = _order(tool=rank, run_id=F.col("run_id"), name=F.col("source"), ordinal=F.col("ordinal"))
    if partials is not None:
        parts["partial"] = valid_partials(partials)
        order["partial"] = _order(run_id=F.col("run_id"), name=F.col("file_name"), ordinal=F.col("ordinal"))
    extra = ["depth", "rule_pass", "rule_ord", "match_no", "match", "run_id", "file_name", "ordinal"]
    found = D.ordered_union(parts, order, ranks).drop(*extra)
    return D.deduplicate(written(found) if once else found, spread=False)


def run(spark: SparkSession, files: DataFrame, reports: DataFrame | None = None, baseline: DataFrame | None = None,
        ignore_patterns: list[str] | None = None, rules: list[Rule] | None = None, checkpoint: bool = True,
        partials: DataFrame | None = None, spread: bool = False, ignore_files: DataFrame | None = None) -> FleetResult:
    """``ignore_patterns`` hold for all repositories; each repository's own ignore file,
    read from ``ignore_files`` (repo_id, content) or else from ``files``, comes behind them."""
    own = ignore_files if ignore_files is not None else IG.ignore_files(files)
    merged = merge_findings(spark, files, reports, partials, rules, spread, once=checkpoint)
    merged = IG.flag_ignored(materialize(merged) if checkpoint else merged, IG.rules(own), ignore_patterns)
    merged = SP.flag_baseline(merged, baseline) if baseline is not None else \
        SP.with_fingerprint(merged).withColumn("known", F.lit(False))
    if checkpoint:
        merged = materialize(merged)
    suppressed = merged.where("suppressed").drop("suppressed", "known")
    kept = merged.where("not suppressed")
    new, known = kept.where("not known").drop("suppressed", "known"), kept.where("known").drop("suppressed", "known")
    audited = FS.file_inventory(files).select("repo_id", "path").distinct()   # discovered files only
    score = R.score(new, audited, files.select("repo_id"))
    is_new = ~F.col("suppressed") & ~F.col("known")
    counts = merged.groupBy("repo_id").agg(
        *[F.count_if(is_new & (F.col("severity") == s)).alias(s.lower()) for s in C.SEVERITIES],
        F.count_if("suppressed").alias("suppressed"), F.count_if(~F.col("suppressed") & F.col("known")).alias("baselined"))
    summary = score.join(counts, "repo_id", "left").na.fill(0)
    return FleetResult(merged, new, suppressed, known, score, summary)


def write_outputs(res: FleetResult, out_dir: str) -> None:
    """Partitioned outputs per repository (parquet findings, JSON lines, SARIF)."""
    res.findings.write.mode("overwrite").partitionBy("repo_id").parquet(f"{out_dir}/findings")
    res.summary.write.mode("overwrite").parquet(f"{out_dir}/summary")
    K.to_sarif(res.findings, repos=res.summary.select("repo_id")).write.mode("overwrite").partitionBy("repo_id").json(f"{out_dir}/sarif")
    K.write_findings_json(res.findings, res.score, f"{out_dir}/findings_json")
