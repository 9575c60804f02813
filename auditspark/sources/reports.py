"""Semi-structured inputs: baseline documents, partial-finding files, manifests,
checksum lists. All parsed with ``from_json`` / regex expressions (PERMISSIVE:
a bad document yields no rows or an error row, never a failed job)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X


def load_baseline(docs: DataFrame, json_col: str = "json", group_cols: tuple = ("repo_id",)) -> DataFrame:
    """``src_load_baseline``: accepts a bare JSON array or ``{fingerprints: [...]}``;
    anything else contributes nothing (fail-open)."""
    g = list(group_cols)
    arr = F.from_json(F.col(json_col), "array<string>")
    obj = F.from_json(F.col(json_col), "struct<fingerprints: array<string>>")
    trimmed = F.ltrim(F.col(json_col))
    fps = F.when(trimmed.startswith("["), arr).otherwise(obj["fingerprints"])
    return (docs.select(*g, F.explode(F.coalesce(fps, F.array().cast("array<string>"))).alias("fingerprint"))
            .where(F.col("fingerprint").isNotNull()).distinct())


def parse_checksums(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """``src_checksums``: ``<64 hex>  *?<name>`` lines -> (digest lower-case, basename)."""
    rx = "^([0-9a-fA-F]{64})\\s+\\*?(.+?)\\s*$"
    t = F.col(text_col)
    return (lines.where(t.rlike(rx))
            .withColumn("digest", F.lower(F.regexp_extract(t, rx, 1)))
            .withColumn("name", F.element_at(F.split(F.regexp_extract(t, rx, 2), "/"), -1)))


def manifest_deps(manifests: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``src_manifest_deps``: package.json dependencies / devDependencies /
    peerDependencies (later section wins per name); composer require /
    require-dev. Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``."""
    m = "map<string,string>"
    base = F.element_at(F.split(F.col(path_col), "/"), -1)
    pkg = F.from_json(F.col(content_col), f"struct<dependencies:{m}, devDependencies:{m}, peerDependencies:{m}>")
    comp = F.from_json(F.col(content_col), f"struct<require:{m}, `require-dev`:{m}>")
    empty = F.create_map().cast(m)
    deps = (F.when(base == "package.json",
                   F.map_concat(F.coalesce(pkg["dependencies"], empty), F.coalesce(pkg["devDependencies"], empty),
                                F.coalesce(pkg["peerDependencies"], empty)))
            .when(base == "composer.json",
                  F.map_concat(F.coalesce(comp["require"], empty), F.coalesce(comp["require-dev"], empty))))
    eco = F.when(base == "package.json", F.lit("npm")).when(base == "composer.json", F.lit("composer"))
    return (manifests.withColumn("ecosystem", eco).where(F.col("ecosystem").isNotNull())
            .select("*", F.explode(F.coalesce(deps, empty)).alias("name", "version")).drop(content_col))


def as_text(c) -> F.Column:
    return X.s(c)
