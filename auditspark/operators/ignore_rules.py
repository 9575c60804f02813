"""Ignore files per repository, as data.

Every repository brings its own ignore file. Files become rows of patterns, patterns
become regexes in column expressions (no driver loop over them), and a path's verdict
is that of the last pattern of its repository that matches it.

Of patterns that are written twice in a file only the last counts, as it decides for
both. Patterns without wildcards, and those below a literal folder, are found by an
equi-join with the names, folders and prefixes of a path (``path_keys``). Of the others,
neighbours that decide alike are joined into alternations of at most ``CHUNK`` patterns,
so a path meets a few regexes and not a thousand. All are matched against the distinct
paths of a repository only, the patterns being the streamed side of a merge join: a task
compiles each regex once for its paths, nothing is broadcast and no pair is kept that
doesn't match. A repository with very many paths is spread by salting the paths, its
alternations being sent once for each salt.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..session import tasks
from . import suppress as SP

#: the file at a repository's root that holds its patterns
IGNORE_FILE = ".auditignore"
CHUNK = 64   # patterns of one regex
SALTS = 16


def glob_regex(glob: Column) -> Column:
    """A glob as the body of a regex: ``*`` and ``?`` within a path segment, ``**`` across."""
    once = F.regexp_replace(glob, r"\*\*(?:/?\*+)*", "**")
    tokens = F.regexp_extract_all(once, F.lit(r"(?s)(\*\*/|\*\*|.)"), F.lit(1))
    part = F.transform(tokens, lambda t: F.when(t == "**/", "(?:.*/)?").when(t == "**", ".*").when(t == "*", "[^/]*").when(t == "?", "[^/]")
                       .when(t.rlike(r"^[A-Za-z0-9/_ \-]$") | (F.ascii(t) > 127), t).otherwise(F.concat(F.lit("\\"), t)))
    return F.array_join(part, "")


def compiled(rules: DataFrame, max_stars: int | None = None) -> DataFrame:
    """Rows with ``pattern`` get ``negate`` and ``regex``. ``max_stars`` leaves out the
    patterns of more stars (after runs of ``**`` are taken as one); by default none."""
    raw = F.col("pattern")
    negate = raw.startswith("!")
    body = F.when(negate, F.substr(raw, F.lit(2))).otherwise(raw)
    directory = body.endswith("/")
    body = F.when(directory, F.regexp_replace(body, "/+$", "")).otherwise(body)
    rooted = body.startswith("/")
    out = (rules.withColumn("negate", negate).withColumn("_directory", directory).withColumn("_rooted", rooted)
           .withColumn("_body", F.when(rooted, F.regexp_replace(body, "^/+", "")).otherwise(body)))
    if max_stars is not None:
        stars = F.regexp_replace("_body", r"\*\*(?:/?\*+)*", "**")
        out = out.where(F.length(stars) - F.length(F.replace(stars, F.lit("*"), F.lit(""))) <= max_stars)
    head = F.when(F.col("_rooted") | F.contains("_body", F.lit("/")), "^").otherwise("(?:^|/)")
    tail = F.when(F.col("_directory"), "(?:/.*)?\\z").otherwise("\\z")
    return (out.withColumn("regex", F.concat(head, glob_regex(F.col("_body")), tail))
            .withColumn("key", _key(F.col("_body"), head == "^", F.col("_directory"))).drop("_directory", "_rooted", "_body"))


def _key(body: Column, anchored: Column, directory: Column) -> Column:
    """The one of a path's ``path_keys`` that it must have if the pattern matches it; null
    if there is none: of a pattern with wildcards, the folders before them."""
    kind = F.when(anchored, F.when(directory, "under:").otherwise("path:")).otherwise(F.when(directory, "part:").otherwise("name:"))
    folders = F.regexp_extract(body, r"(?s)^([^*?]*)/[^/*?]*[*?]", 1)
    return F.when(~body.rlike("[*?]") & (body != ""), F.concat(kind, body)).when(folders != "", F.concat(F.lit("under:"), folders))


def path_keys(path: Column) -> Column:
    """What a pattern's ``key`` may be for it to match ``path``."""
    parts = F.split(path, "/", -1)
    under = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("under:"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("path:"), path), F.concat(F.lit("name:"), F.element_at(parts, -1))),
                                     F.transform(parts, lambda p: F.concat(F.lit("part:"), p)), under))


def ignore_files(files: DataFrame, name: str = IGNORE_FILE) -> DataFrame:
    """(repo_id, content) of the ignore files among ``files`` (repo_id, path, content);
    of a path that is there twice, the smaller content."""
    return files.where(F.col("path") == name).groupBy("repo_id").agg(F.min("content").alias("content"))


def rules(docs: DataFrame, max_stars: int | None = None) -> DataFrame:
    """(repo_id, ordinal, pattern, negate, regex, key) of ignore files (repo_id, content)."""
    return compiled(SP.ignore_lines(docs, "content", ["repo_id"]), max_stars)


def deciding(compiled_rules: DataFrame) -> DataFrame:
    """(repo_id, ordinal, negate, regex, key): of equal regexes of a repository the last,
    which decides for every path that they match."""
    return compiled_rules.groupBy("repo_id", "regex").agg(F.max_by("negate", "ordinal").alias("negate"), F.max("ordinal").alias("ordinal"), F.min("key").alias("key"))


def runs(compiled_rules: DataFrame) -> DataFrame:
    """(repo_id, last, negate, regex): neighbouring patterns of one polarity as alternations,
    those without a ``key`` only. A run ends where the next pattern, with a key or not,
    decides otherwise: within it any order of patterns gives the same verdict."""
    order = Window.partitionBy("repo_id").orderBy("ordinal")
    turn = (F.col("negate") != F.lag("negate").over(order)).cast("int")
    r = compiled_rules.select("repo_id", "ordinal", "negate", "regex", "key").withColumn("_turn", F.coalesce(turn, F.lit(0)))
    r = r.withColumn("_run", F.sum("_turn").over(order)).withColumn("_free", F.col("key").isNull())
    r = r.withColumn("_pos", F.sum(F.col("_free").cast("int")).over(order)).where("_free")
    grouped = r.groupBy("repo_id", "_run", F.floor(F.col("_pos") / CHUNK).alias("_chunk"), "negate").agg(
        F.max("ordinal").alias("last"), F.collect_list("regex").alias("_all"))
    return grouped.select("repo_id", "last", "negate", F.concat(F.lit("(?:"), F.array_join("_all", "|"), F.lit(")")).alias("regex"))


def verdicts(paths: DataFrame, compiled_rules: DataFrame) -> DataFrame:
    """(repo_id, path, ignored) of the distinct (repo_id, path) that some pattern of
    their repository matches; the last one decides."""
    last = deciding(compiled_rules)
    p = paths.select("repo_id", "path").distinct()
    by_key = last.where(F.col("key").isNotNull()).select("repo_id", "key", F.col("ordinal").alias("last"), "negate", "regex")
    by_run = runs(last).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def matches(rules: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
        # few bytes, many regexes to try: both sides in as many tasks as there are, whatever their size
        rules, keyed = (x.repartition(tasks(x.sparkSession), "repo_id", key) for x in (rules, keyed))
        # the left side of a merge join is streamed: a task sees a regex with all its paths before the next one
        met = rules.hint("merge").join(keyed.hint("merge"), ["repo_id", key]).where(F.rlike("path", F.col("regex")))
        return met.select("repo_id", "path", "negate", "last")

    met = matches(by_key, p.withColumn("key", F.explode(path_keys(F.col("path")))), "key").unionByName(
        matches(by_run, p.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")), "_salt"))
    return met.groupBy("repo_id", "path").agg(F.max_by(~F.col("negate"), "last").alias("ignored"))


def flag_ignored(findings: DataFrame, compiled_rules: DataFrame | None, user_patterns: list[str] | None = None, defaults: bool = True) -> DataFrame:
    """``findings`` (repo_id, file) with ``suppressed``: built-in defaults first, then the
    patterns that hold for all repositories, then the repository's own; the last match decides."""
    common = (list(C.DEFAULT_IGNORE_PATTERNS) if defaults else []) + list(user_patterns or [])
    f = findings.withColumn("_ipath", SP.ignore_path("file"))
    base = SP.is_ignored("_ipath", common) if common else F.lit(False)
    if compiled_rules is None:
        return f.withColumn("suppressed", base).drop("_ipath")
    v = verdicts(f.select("repo_id", F.col("_ipath").alias("path")).where("path <> ''"), compiled_rules)
    v = v.select("repo_id", F.col("path").alias("_ipath"), F.col("ignored").alias("_own"))
    out = f.join(v, ["repo_id", "_ipath"], "left").withColumn("suppressed", F.coalesce("_own", base))
    return out.select(*findings.columns, "suppressed")
