"""Line dedup by distinct-site spread, in DataFrame operations only.

A HyperLogLog sketch of the sites of every line merges by aggregation, so a line
of a third of all documents ships one sketch for each task. Lines whose estimate
is near the threshold get an exact distinct count; the boilerplate lines found are
then taken out of the documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MIN_SITES = 10  # distinct sites that make a line boilerplate
LOG_K = 12      # sketch size; its relative error is about 1.04 / sqrt(2 ** LOG_K)
SIGMAS = 4      # standard errors around the threshold that are counted exactly
SPACE = " \t\r"


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank: its document's columns, place and two hashes."""
    split = docs.select("k1", "k2", "site", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    split = split.withColumn("line", F.btrim("line", F.lit(SPACE))).where("line <> ''")
    return split.select("k1", "k2", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, n_sites) of the lines on at least ``min_sites`` distinct sites;
    ``n_sites`` is exact near the threshold and an estimate beyond. Null sites
    don't count."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"))
    margin = max(1.0, SIGMAS * 1.04 / 2 ** (LOG_K / 2) * min_sites)
    rated = sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("n_sites")).where(F.col("n_sites") >= min_sites - margin)
    rated = cut(rated, "line-spread")
    near = rated.where(F.col("n_sites") <= min_sites + margin).select("h1", "h2")
    pairs = lines.where("site is not null").join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_sites")).where(F.col("n_sites") >= min_sites)
    return exact.union(rated.where(F.col("n_sites") > min_sites + margin))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES) -> DataFrame:
    """(id, text, n_lines, n_removed): one row per row of ``docs``, without its
    boilerplate lines.

    Lines end at line feeds and are compared without blanks, tabs and carriage
    returns around them; blank lines are kept and never count. A line counts once
    for a site, however often it occurs there; documents without a site are
    cleaned but spread nothing. A null text stays null with no lines; an empty
    one is one blank line. Repeated rows are rows of their own. An empty table
    gives an empty one.
    """
    if min_sites < 1:
        raise ValueError("min_sites must be at least 1")
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.col(site_col).cast("string").alias("site"))
    # rows of equal id and text lose the same lines: they share a key
    src = src.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64("text", "id")})
    lines = _lines(src)
    common = cut(boilerplate(lines, min_sites).select("h1", "h2"), "line-boilerplate")
    gone = lines.join(common, ["h1", "h2"], "left_semi").select("k1", "k2", "place").distinct()
    gone = gone.groupBy("k1", "k2").agg(F.collect_list("place").alias("gone"))  # places in one text
    out = src.join(gone, ["k1", "k2"], "left").withColumn("all", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    clean = F.array_join(F.transform(F.array_sort(kept), lambda i: F.get("all", i)), "\n")
    return out.select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(clean).alias("text"),
                      F.coalesce(F.when(F.col("text").isNotNull(), F.size("all")), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"))
