"""File sources: inventory, classification, text read and line split.

Any table with ``repo_id, path`` (and ``content`` for the text steps) is a file
source: a path listing, the result of ``binaryFile`` over a fleet checkout, or
a derived fixture. Classification is a set of ``rlike`` tests compiled from the
discovery globs at plan time; nothing is read twice.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import columns as X
from ..rules.dialect import glob_to_regex
from ..session import materialize, tasks


def _any_depth(patterns: list[str]) -> str:
    return "^(?:.*/)?(?:" + "|".join(glob_to_regex(p) for p in patterns) + ")\\z"


SOURCE_RE = "^(?:.*/)?[^/]*\\.(?:" + "|".join(C.SOURCE_EXTENSIONS) + ")\\z"
CONFIG_RE = _any_depth(C.CONFIG_FILE_PATTERNS)
DEP_RE = _any_depth(C.DEP_FILE_PATTERNS)
BAAS_RE = _any_depth(C.BAAS_FILE_PATTERNS)
EXCLUDED_DIR_RE = "^(?:.*/)?(?:" + "|".join(glob_to_regex(d) for d in C.DEFAULT_IGNORE_DIRS) + ")/"
EXCLUDED_FILE_RE = _any_depth(C.DEFAULT_IGNORE_FILES)


def is_excluded(path) -> Column:
    """``src_default_excludes``: generated / vendored directories and artefacts."""
    p = X.col(path)
    return p.rlike(EXCLUDED_DIR_RE) | p.rlike(EXCLUDED_FILE_RE)


def categories(path) -> Column:
    p = X.col(path)
    return F.array_compact(F.array(
        F.when(p.rlike(SOURCE_RE), F.lit("source")),
        F.when(p.rlike(CONFIG_RE), F.lit("config")),
        F.when(p.rlike(DEP_RE), F.lit("dependency")),
        F.when(p.rlike(BAAS_RE), F.lit("baas")),
    ))


def kind(cats) -> Column:
    c = X.col(cats)
    return (F.when(F.array_contains(c, "baas"), F.lit("baas"))
            .when(F.array_contains(c, "config"), F.lit("config"))
            .otherwise(F.lit("source")))


def normalise_paths(files: DataFrame) -> DataFrame:
    return files.withColumn("path", F.regexp_replace(F.regexp_replace("path", "\\\\", "/"), "^\\./", ""))


def file_inventory(files: DataFrame) -> DataFrame:
    """``src_file_inventory``: one row per (repo_id, path, category), exclusions applied."""
    return (normalise_paths(files).select("repo_id", "path").where(~is_excluded("path"))
            .select("repo_id", "path", F.explode(categories("path")).alias("category"))
            .dropDuplicates(["repo_id", "path", "category"]))


def classify(files: DataFrame) -> DataFrame:
    """Per file: categories, scan kind, language, depth; keeps only scanned files
    (source, config or BaaS; dependency-only files are not scanned)."""
    f = normalise_paths(files).where(~is_excluded("path")).withColumn("_cats", categories("path"))
    return (f.where(F.exists("_cats", lambda c: c != "dependency"))
            .withColumn("kind", kind("_cats"))
            .withColumn("language", X.language("path"))
            .withColumn("depth", F.size(F.split("path", "/")))
            .drop("_cats"))


def _file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri.rstrip("/"))


_LISTED = "path string, length long, is_dir boolean, error string"


def _list_folders(root: str):
    """Folders (relative to ``root``) -> what lies in each, names of all kinds; a folder
    that can't be listed -> one row that says why."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pfs
        fs, base = _file_system(root)
        local = isinstance(fs, pfs.LocalFileSystem)
        for b in batches:
            for folder in b.column("path").to_pylist():
                try:
                    found = fs.get_file_info(pfs.FileSelector(f"{base}/{folder}".rstrip("/")))
                    rows = [(f.path[len(base) + 1:], f.size or 0, f.type == pfs.FileType.Directory, None) for f in found]
                    # a link to a folder may lead back up: it is named, not followed
                    rows = [(p, n, False, "link to a folder") if d and local and os.path.islink(f"{base}/{p}") else (p, n, d, e) for p, n, d, e in rows]
                except OSError as e:
                    rows = [(folder, None, True, str(e))]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.bool_(), pa.string()))],
                                                 names=["path", "length", "is_dir", "error"])
    return run


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, is_dir, error) of all that lies under ``root``.

    Level by level: the folders that one level found are dealt out and listed by as many
    tasks as there are shuffle partitions, so a tree under one top-level folder is listed
    as widely as any other. Each level is written to the shared folder; the driver only
    asks whether there are folders left. Folders that can't be read are rows with ``error``.
    """
    level, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        listed = materialize(level.repartition(tasks(spark), "path").mapInArrow(_list_folders(root), _LISTED))
        found = listed if found is None else found.union(listed)
        level = listed.where("is_dir and error is null").select("path")
        if level.isEmpty():
            return found


def read_binary_tree(spark: SparkSession, root: str, repo_id: str | None = None, excluded: bool = False) -> DataFrame:
    """(path, length, content, repo_id) of every file of a checkout tree, dotfiles
    and empty files too; ``root`` is a path or URI that all executors reach.

    Folders are listed level by level in parallel (``list_tree``), and the bodies are
    read in parallel; those of excluded paths only with ``excluded``. A file or folder
    that can't be read stays, with null content (``read_text`` calls it binary).
    """
    files = list_tree(spark, root).where("not is_dir or error is not null").select("path", "length")
    if not excluded:
        files = files.where(~is_excluded("path"))

    def read(batches):
        import pyarrow as pa
        fs, base = _file_system(root)
        for b in batches:
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with fs.open_input_stream(f"{base}/{path}") as f:
                        body = f.read()
                except OSError:
                    body = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([body], pa.binary())],
                                                 names=["path", "length", "content"])

    out = files.repartition(tasks(spark), "path").mapInArrow(read, "path string, length long, content binary")
    return out.withColumn("repo_id", F.lit(repo_id or root))


# FIXED VALUE: the bytes that the reference looks at for a NUL
REFERENCE_SNIFF = 8192


def read_text(contents: DataFrame, sniff: int | None = None) -> DataFrame:
    """``src_read_text``: a NUL in the content (in its first ``sniff`` bytes, where
    given) -> binary; else UTF-8 with replacement characters. ``content`` may be
    binary or already a string."""
    head_of = lambda c: c if sniff is None else F.substring(c, 1, sniff)
    is_bin_col = dict(contents.dtypes).get("content") == "binary"
    if is_bin_col:
        head = head_of(F.col("content")).cast("string")
        binary = F.coalesce(F.instr(head, "\u0000") > 0, F.lit(True))  # what could not be read is binary
        text = F.make_valid_utf8(F.col("content").cast("string"))
    else:
        binary = F.instr(head_of(F.col("content")), F.lit("\u0000")) > 0
        text = F.col("content")
    return contents.withColumn("is_binary", binary).withColumn("content", F.when(~F.col("is_binary"), text))


def with_file_flags(files: DataFrame) -> DataFrame:
    """Adds ``is_empty``, ``is_minified`` (average > 500 chars per line, or a line
    longer than 10000) and ``is_binary`` when missing."""
    if "is_binary" not in files.columns:
        files = read_text(files)
    # split once; the line array is kept as ``_lines`` for ``split_lines``
    files = files.withColumn("_lines", F.split("content", "\n", -1))
    arr = F.col("_lines")
    minified = (F.length("content") / F.size(arr) > 500) | F.exists(arr, lambda l: F.length(l) > 10000)
    return (files.withColumn("is_empty", F.coalesce(F.col("content") == "", F.lit(True)))
            .withColumn("is_minified", F.coalesce(minified, F.lit(False))))


def split_lines(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``src_split_lines`` keeping file-level columns."""
    keep = keep or [c for c in files.columns if c not in ("content", "_lines")]
    arr = F.col("_lines") if "_lines" in files.columns else F.split("content", "\n", -1)
    return (files.select(*keep, F.posexplode(arr).alias("_pos", "text"))
            .withColumn("line", (F.col("_pos") + 1).cast("int")).drop("_pos"))
