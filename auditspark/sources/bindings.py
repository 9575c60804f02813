"""Derived fixture views over the driver tables.

The driver tables hold no source code and no scanner output, so the engine is
exercised on deterministic projections of them (files from ``documents``,
findings from ``lineitem``, dependencies from ``orders``, tool runs from
``supplier``, HTTP responses from ``pages``, env files from ``events``).

Every view is defined once in SQL text; ``spark_view`` evaluates it with
Spark's expression parser over the parquet table (column pruning and filter
push-down still reach the scan), and ``duckdb_cte`` renders the same text for
the DuckDB oracle. Only dialect tokens differ.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.catalogue import ALL_RULES
from ..rules.samples import NEAR_MISSES, SAMPLES
from ..session import tasks

#: DuckDB can't look ahead: the near misses of these rules are for the unit tests alone
LOOKAHEAD = {r.id for r in ALL_RULES if r.lookahead}

FILES_PATH = """concat(CASE doc_id % 8 WHEN 0 THEN 'src' WHEN 1 THEN 'lib/core' WHEN 2 THEN 'apps/web/src' WHEN 3 THEN 'test' WHEN 4 THEN 'docs'
   WHEN 5 THEN 'node_modules/pkg' WHEN 6 THEN 'services/api' ELSE 'dist' END, '/f', doc_id,
   CASE doc_id % 9 WHEN 0 THEN '.js' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.tf' WHEN 4 THEN '.cs' WHEN 5 THEN '.ts'
   WHEN 6 THEN '.min.js' WHEN 7 THEN '.yaml' ELSE '.spec.js' END)"""

FILES_CONTENT = """concat(text, {NL}, CASE doc_id % 11
   WHEN 0 THEN concat('const password = "pw', doc_id, 'abcdefgh";')
   WHEN 1 THEN concat('key = "AKIA', lpad(CAST(doc_id AS {STR}), 16, '0'), '"')
   WHEN 2 THEN 'db.query("SELECT * FROM t WHERE id = " + req.params.id);'
   WHEN 3 THEN 'obj = pickle.loads(data)'
   WHEN 4 THEN 'crypto.createHash("md5").update(x)'
   WHEN 5 THEN 'cidr_blocks = ["0.0.0.0/0"]'
   WHEN 6 THEN 'eval(req.body.code)'
   WHEN 7 THEN 'const token = Math.random();'
   WHEN 8 THEN 'const sample = Math.random();'
   WHEN 9 THEN concat('url = "postgresql://u:p', doc_id, '@db.internal/x"')
   ELSE 'let x = 1;' END)"""

_SAMPLES = list(SAMPLES.items())
_NEAR = {k: line for k, (end, line) in NEAR_MISSES.items() if end == SAMPLES[k][0] and k not in LOOKAHEAD}


def _by_sample(text) -> str:
    """CASE over the sample rule of a document. Spark's parser would take "${x}" for a
    variable, so the two characters stand in two literals."""
    literal = lambda t: "concat('" + t.replace("${", "$', '{") + "')"
    return f"CASE doc_id % {len(_SAMPLES)} " + " ".join(f"WHEN {i} THEN {literal(text(k, end, line))}" for i, (k, (end, line)) in enumerate(_SAMPLES)) + " END"


VIEWS = {
    # every rule's own line, and a near miss, behind the text of a document
    "t_samples": ("documents", [
        "source AS repo_id", "doc_id", "concat(CASE doc_id % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'test' WHEN 2 THEN 'services/api' WHEN 3 THEN 'lib/core' "
        f"ELSE 'apps/web' END, '/s', doc_id, {_by_sample(lambda k, end, line: end)}) AS path",
        f"concat(text, {{NL}}, {_by_sample(lambda k, end, line: line)}, {{NL}}, {_by_sample(lambda k, end, line: _NEAR.get(k, 'x = 1'))}) AS content"]),
    "t_files": ("documents", [
        "source AS repo_id", "doc_id", f"{FILES_PATH} AS path", f"{FILES_CONTENT} AS content"]),
    "t_findings": ("lineitem", [
        "concat('repo', l_suppkey % 5) AS repo_id",
        "CASE l_suppkey % 6 WHEN 0 THEN 'gitleaks' WHEN 1 THEN 'opengrep' WHEN 2 THEN 'osv-scanner' WHEN 3 THEN 'trivy' ELSE 'detector' END AS source",
        "concat(CASE l_partkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'dist' WHEN 2 THEN 'test' ELSE 'apps/web' END, '/f', l_partkey % 40, '.js') AS file",
        "CAST(l_linenumber AS INT) AS line",
        "CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END AS severity",
        "CASE CAST(l_orderkey AS INT) % 4 WHEN 0 THEN 'TOOL-ONLY' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence",
        "CASE l_orderkey % 3 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'cwe-79: XSS' ELSE 'N/A' END AS cwe",
        "CASE l_orderkey % 3 WHEN 0 THEN 'Injection' WHEN 1 THEN 'Cross-Site Scripting' ELSE 'Security Misconfiguration' END AS category",
        "concat('Rule  ', l_partkey % 7) AS name",
        "l_shipdate AS detected_at",
        "l_orderkey AS run_id",
        "{SEQ} AS seq",
    ]),
    "t_deps": ("orders", [
        "concat('repo', o_custkey % 20) AS repo_id",
        "concat(CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'apps/web/' ELSE 'services/api/' END, 'package.json') AS manifest_path",
        "'npm' AS ecosystem",
        "CASE o_orderkey % 10 WHEN 0 THEN 'react' WHEN 1 THEN 'vue' WHEN 2 THEN 'express' WHEN 3 THEN 'pg' WHEN 4 THEN 'mysql2' WHEN 5 THEN 'better-sqlite3' WHEN 6 THEN 'next' WHEN 7 THEN 'mongoose' WHEN 8 THEN 'electron' ELSE 'left-pad' END AS name",
        "concat('1.', o_custkey % 12, '.', o_orderkey % 20) AS version",
    ]),
    "t_tool_runs": ("supplier", [
        "concat('repo', s_suppkey % 20) AS repo_id",
        "CASE CAST(floor(s_suppkey / 20) AS INT) WHEN 0 THEN 'opengrep' WHEN 1 THEN 'osv-scanner' WHEN 2 THEN 'package-audit' WHEN 3 THEN 'gitleaks' ELSE 'trivy' END AS tool",
        "s_suppkey % 7 <> 0 AS available", "s_suppkey % 11 = 0 AS skipped",
        "CASE s_suppkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial-skips' ELSE NULL END AS diagnostic",
        "CAST(s_suppkey % 13 AS INT) AS raw_count",
        "concat('v', s_suppkey % 3, '.', s_suppkey % 15, '.0') AS version",
    ]),
    "t_responses": ("pages", [
        "page_id", "url AS target", "CASE page_id % 6 WHEN 0 THEN 302 WHEN 1 THEN 404 ELSE 200 END AS status",
        """concat('{', '"Content-Security-Policy":"', CASE WHEN page_id % 2 = 0 THEN 'default-src self' ELSE '' END, '","X-Frame-Options":"', CASE WHEN page_id % 3 = 0 THEN 'DENY' ELSE '' END, '","access-control-allow-origin":"', CASE WHEN page_id % 5 = 0 THEN '*' ELSE '' END, '","location":"', CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/login' ELSE 'http://localhost:3000/' END, '"}') AS headers_json""",
    ]),
    "t_env_lines": ("events", [
        "concat('repo', user_id % 20) AS repo_id",
        "CASE event_id % 4 WHEN 0 THEN '.env' WHEN 1 THEN '.env.local' WHEN 2 THEN '.env.development' ELSE '.env.production' END AS file",
        "event_id AS line",
        "CASE event_id % 5 WHEN 0 THEN concat('API_URL=https://h_', user_id, '.example.com/v1') WHEN 1 THEN 'API_URL=http://localhost:8080' WHEN 2 THEN concat('DB_HOST=db', user_id, '.internal.net:5432') WHEN 3 THEN 'CACHE_HOST=127.0.0.1' ELSE concat('FLAG=', event_type) END AS text",
    ]),
    "t_inventory": ("part", [
        "concat('repo', p_partkey % 5) AS repo_id",
        "concat(CASE p_partkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'conf' WHEN 2 THEN 'test' ELSE 'apps/web' END, '/f', p_partkey % 60, '.js') AS path",
        "CASE p_partkey % 7 WHEN 0 THEN 'config' WHEN 1 THEN 'dependency' WHEN 2 THEN 'baas' ELSE 'source' END AS category",
    ]),
    "t_labels": ("labels", [
        "doc_id", "CASE WHEN quality = 1 AND doc_id % 11 IN (0, 1, 9) THEN 'CWE-798' ELSE NULL END AS expected_cwe",
    ]),
}

# Ordering key of t_findings: every lineitem column, as the rows are distinct.
SEQ_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _spark_text(expr: str) -> str:
    return (expr.replace("{NL}", "char(10)").replace("{STR}", "STRING")
            .replace("{SEQ}", "named_struct(" + ", ".join(f"'{c}', {c}" for c in SEQ_COLS) + ")"))


def _duck_text(expr: str) -> str:
    return (expr.replace("{NL}", "chr(10)").replace("{STR}", "VARCHAR")
            .replace("{SEQ}", "row_number() OVER (ORDER BY " + ", ".join(SEQ_COLS) + ")"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str, by: tuple = (), spread: bool = False) -> DataFrame:
    """The view ``name``. Its rows can be dealt out, by the values of the columns ``by`` or
    by their content (``spread``): then the base table's narrow rows travel, and what the
    view derives from them is made behind the shuffle."""
    if name == "t_lines":
        return lines_of(spark_view(spark, sf_dir, "t_files"))
    if name == "t_baseline":
        return baseline_of(spark_view(spark, sf_dir, "t_findings"))
    base, exprs = VIEWS[name]
    t, cols = table(spark, sf_dir, base), {e.rsplit(" AS ", 1)[-1]: _spark_text(e) for e in exprs}
    if spread:
        t = t.repartition(F.xxhash64(*t.columns))
    if by:
        t = t.selectExpr("*", *[cols[c] for c in by]).repartition(tasks(spark), *by)
        cols |= {c: c for c in by}
    return t.selectExpr(*cols.values())


def lines_of(files: DataFrame) -> DataFrame:
    """``src_split_lines``: split on LF only (CR kept), 1-based, trailing empty line kept."""
    return (files.select("repo_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text"))
            .select("repo_id", "path", (F.col("pos") + 1).cast("int").alias("line"), "text"))


BASELINE_CUTOFF = "1995-06-17"


def baseline_of(findings: DataFrame) -> DataFrame:
    """Known fingerprints: those of every finding detected before the cut-off
    date (the accepted state of an earlier run)."""
    from ..functions import columns as X
    return (findings.where(F.col("detected_at") < F.lit(BASELINE_CUTOFF).cast("timestamp"))
            .select("repo_id", X.fingerprint("file", "cwe", "category", "name").alias("fingerprint"))
            .distinct())


DUCK_LINES = """SELECT repo_id, path, CAST(unnest(generate_series(1, len(a))) AS INTEGER) AS line, unnest(a) AS text
FROM (SELECT repo_id, path, string_split(content, chr(10)) AS a FROM t_files)"""


def duckdb_cte(name: str) -> str:
    if name == "t_lines":
        return DUCK_LINES
    base, exprs = VIEWS[name]
    return "SELECT " + ",\n ".join(_duck_text(e) for e in exprs) + f"\nFROM {base}"


VIEW_ORDER = ["t_samples", "t_files", "t_lines", "t_findings", "t_deps", "t_tool_runs", "t_responses", "t_env_lines",
              "t_inventory", "t_labels"]


def with_views(sql: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the fixture views it mentions (DuckDB dialect)."""
    import re
    needed = [v for v in VIEW_ORDER if re.search(rf"\b{v}\b", sql + " ".join(c for _, c in (extra_ctes or [])))]
    if "t_lines" in needed and "t_files" not in needed:
        needed.insert(0, "t_files")
    ctes = [(v, duckdb_cte(v)) for v in VIEW_ORDER if v in needed] + list(extra_ctes or [])
    if not ctes:
        return sql
    head = "WITH " + ",\n".join(f"{n} AS (\n{c}\n)" for n, c in ctes)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + sql
