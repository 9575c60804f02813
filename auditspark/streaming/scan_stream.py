"""Structured Streaming: scan files as they arrive.

The scan and normaliser operators are stateless row transforms, so the same
expressions run on a streaming DataFrame. Two differences from batch:

* finding ids: the batch id window (repeat counter per rule/file/line) is not
  available on a stream, so the repeat suffix is the match number on the line
  (equal to the batch id unless two paths share a slug);
* ignore patterns are those given, the same for all repositories.

Tool reports go through the same one-pass normalisers, the baseline is a
stream-static join on the fingerprint: rows come out as the batch has them.

Aggregates (dedup, score, reports) stay batch jobs over the sink table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..operators import normalize as N
from ..operators import scan as S
from ..operators import suppress as SP
from ..rules.catalogue import Rule, builtin_rules

FILE_SCHEMA = "repo_id string, path string, content string"


def read_files_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = FILE_SCHEMA,
                      max_files_per_trigger: int = 64) -> DataFrame:
    return (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .load(path))


def stream_findings(spark: SparkSession, files: DataFrame, rules: list[Rule] | None = None,
                    baseline: DataFrame | None = None) -> DataFrame:
    """Streaming detector findings (no window, no action)."""
    rules = rules if rules is not None else builtin_rules()
    # the batch tail; the match number on the line stands for the repeat window
    out = S.finish(spark, S.rule_hits(S.prepare_lines(files), rules), rules, repeat=F.col("match_no"))
    if baseline is not None:
        out, _ = SP.apply_baseline(out, baseline)
    return out.drop("depth", "rule_pass", "rule_ord", "match_no", "match", "references")


REPORT_SCHEMA = "repo_id string, run_id long, tool string, report_json string"


def tool_findings(reports: DataFrame, baseline: DataFrame | None = None, ignore_patterns: list[str] | None = None) -> DataFrame:
    """Canonical findings of a stream (or table) of tool reports, with ``suppressed`` and
    ``known``: every report is normalised as it comes, nothing is kept between batches."""
    out = N.normalize_all(reports)
    patterns = list(C.DEFAULT_IGNORE_PATTERNS) + list(ignore_patterns or [])
    out = out.withColumn("suppressed", SP.is_ignored(SP.ignore_path("file"), patterns))
    return SP.flag_baseline(out, baseline) if baseline is not None else SP.with_fingerprint(out).withColumn("known", F.lit(False))


def start_reports(spark: SparkSession, source_path: str, sink_path: str, checkpoint: str, baseline: DataFrame | None = None,
                  fmt: str = "parquet", trigger_once: bool = False):
    """Reports to findings in a parquet sink partitioned by repository, exactly once
    through the checkpoint (put it in the cluster's shared checkpoint folder)."""
    q = (tool_findings(read_files_stream(spark, source_path, fmt, REPORT_SCHEMA), baseline)
         .writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
         .partitionBy("repo_id").outputMode("append"))
    q = q.trigger(availableNow=True) if trigger_once else q.trigger(processingTime="30 seconds")
    return q.start()


def start_scan(spark: SparkSession, source_path: str, sink_path: str, checkpoint: str,
               baseline: DataFrame | None = None, fmt: str = "parquet", trigger_once: bool = False):
    """Continuous scan to a parquet sink partitioned by repository. Exactly-once
    through the checkpoint (put it in the cluster's shared checkpoint folder)."""
    q = (stream_findings(spark, read_files_stream(spark, source_path, fmt), baseline=baseline)
         .writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
         .partitionBy("repo_id").outputMode("append"))
    q = q.trigger(availableNow=True) if trigger_once else q.trigger(processingTime="30 seconds")
    return q.start()
