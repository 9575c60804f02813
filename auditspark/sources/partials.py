"""Partial finding documents of reviewing agents: (repo_id, run_id, file_name, json)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tools as T

PARTIAL_SCHEMA = ("struct<severity:string, category:string, name:string, description:string, file:string, "
                  "line:string, cwe:string, fix:string, confidence:string, source:string>")


def load_partials(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``src_load_partials``: (findings, errors, tool executions) from partial
    documents. Bad file name, bad JSON or a missing findings array -> error row."""
    name_ok = F.col("file_name").rlike("(?i)^[a-z0-9][a-z0-9_-]*\\.json\\z")
    is_arr = F.col("json").rlike("^\\s*\\[")
    parsed = docs.select("*", F.when(~is_arr, F.from_json("json", "map<string,string>")).alias("_obj"),
                         F.when(is_arr, F.from_json("json", "array<string>")).alias("_arr"))
    as_obj, as_arr = F.col("_obj"), F.col("_arr")
    valid_json = as_obj.isNotNull() | as_arr.isNotNull()
    items = F.coalesce(as_arr, F.from_json(F.try_element_at(as_obj, F.lit("findings")), "array<string>"),
                       F.from_json(F.try_element_at(as_obj, F.lit("partialFindings")), "array<string>"))
    tool_fields = ["toolExecutions", "toolRuns", "toolsExecuted", "executedTools"]
    meta = F.from_json(F.try_element_at(as_obj, F.lit("metadata")), "map<string,string>")
    tools = F.flatten(F.array(*[F.coalesce(F.from_json(F.try_element_at(as_obj, F.lit(t)), "array<string>"),
                                           F.array().cast("array<string>")) for t in tool_fields] +
                               [F.coalesce(F.from_json(F.try_element_at(meta, F.lit(t)), "array<string>"),
                                           F.array().cast("array<string>")) for t in tool_fields]))
    d = parsed.select(*docs.columns, name_ok.alias("name_ok"), valid_json.alias("valid_json"), items.alias("items"),
                      tools.alias("tools"))
    err = F.when(~F.col("name_ok"), F.concat(F.lit("Partial document "), F.col("file_name"),
                                             F.lit(": the name is not <subagent>.json.")))
    err = err.when(~F.col("valid_json"), F.concat(F.lit("Partial document "), F.col("file_name"), F.lit(": the JSON can't be read.")))
    err = err.when(F.col("items").isNull(), F.concat(F.lit("Partial document "), F.col("file_name"),
                                                     F.lit(": there is no list of findings.")))
    d = d.withColumn("doc_error", err)
    # what a document lacks is an empty list, and items are parsed inside the generator: a
    # filter would be pushed below the parsers and parse everything again for each field
    read = F.transform("items", lambda raw: F.from_json(raw, PARTIAL_SCHEMA))
    findings = (d.select("repo_id", "run_id", "file_name", F.posexplode(F.when(F.col("doc_error").isNull(), read)).alias("_i", "f"))
                .select("repo_id", "run_id", "file_name", (F.col("_i") + 1).alias("ordinal"), "f.*"))
    execs = (d.select("repo_id", "run_id", F.explode(F.when(F.col("name_ok") & F.col("valid_json"), F.col("tools"))).alias("raw_tool"))
             .select("repo_id", "run_id", T.tool_name("raw_tool").alias("tool")).where(F.col("tool") != ""))
    errors = d.where(F.col("doc_error").isNotNull()).select("repo_id", "run_id", F.col("doc_error").alias("error"))
    return findings, errors, execs


def valid_partials(docs: DataFrame) -> DataFrame:
    """The findings of ``docs`` that pass validation, with ``line`` as an integer."""
    found = T.partial_errors(load_partials(docs)[0])
    return found.where(F.size("errors") == 0).drop("errors").withColumn("line", F.col("line").cast("int"))
