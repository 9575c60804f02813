"""Registered queries: profile, tools, audits, partials, sinks, remaining
projections (sections 2.1, 2.4 - 2.7, 2.12)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..functions import columns as X
from ..operators import audits as A
from ..operators import profile as P
from ..operators import scan as S
from ..operators import suppress as SP
from ..operators import tools as T
from ..rules.dialect import to_java
from ..operators.numbering import positions
from ..sources import bindings as B
from ..sources import files as FS
from ..sources import reports as RS
from . import q_findings as QF
from . import sqlfrag as Q
from .registry import register


def v(spark, sf, name):
    return B.spark_view(spark, sf, name)


def W(sql, dedup=False):
    return QF.sqlv(sql, dedup)


def _host_sql(u):
    auth = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    hp = f"regexp_replace({auth}, '^.*@', '')"
    return (f"lower(CASE WHEN {auth} = '' THEN NULL WHEN starts_with({hp}, '[') THEN regexp_extract({hp}, '^(\\[[^]]*\\])', 1) "
            f"ELSE split_part({hp}, ':', 1) END)")


# ---------------------------------------------------------------- audits (t_responses, t_env_lines)

def responses(spark, sf):
    return v(spark, sf, "t_responses").withColumn("headers", A.headers_map())


HMAP = ("map_from_entries(list_transform(json_keys(headers_json), lambda k: struct_pack(k := lower(k), "
        "v := json_extract_string(headers_json, '$.\"' || k || '\"'))))")


def _hdr(h):
    """Case-insensitive header value ('' when absent)."""
    return f"coalesce(map_extract_value({HMAP}, {Q.q(h)}), '')"


@register("aud_security_headers", W("SELECT page_id, target, CASE WHEN len(m) > 0 THEN 'DAST-SUSPECTED' ELSE "
                                    "'DAST-CLEAN' END AS result, CASE WHEN len(m) > 0 THEN 'LOW' ELSE 'INFO' END AS "
                                    "severity, array_to_string(m, ', ') AS missing FROM (SELECT page_id, target, "
                                    "list_filter([" + ", ".join(Q.q(h) for h in A.SECURITY_HEADERS) + "], lambda k: "
                                    "CASE k " + " ".join(f"WHEN {Q.q(h)} THEN {_hdr(h)}" for h in A.SECURITY_HEADERS)
                                    + " END = '') AS m FROM t_responses)"))
def aud_security_headers(spark, sf):
    return A.security_headers(responses(spark, sf)).select("page_id", "target", "result", "severity", "missing")


@register("aud_cors", W(f"""SELECT page_id, target, CASE WHEN o = '*' OR lower(o) = 'https://evil.com' THEN
  'DAST-SUSPECTED' ELSE 'DAST-CLEAN' END AS result, CASE WHEN o = '*' OR lower(o) = 'https://evil.com' THEN 'MEDIUM'
  ELSE 'INFO' END AS severity FROM (SELECT *, {_hdr('access-control-allow-origin')} AS o FROM t_responses)"""))
def aud_cors(spark, sf):
    return A.cors(responses(spark, sf)).select("page_id", "target", "result", "severity")


@register("aud_external_redirect", W(f"""SELECT page_id, target, status, h AS location_host FROM (
  SELECT *, CASE WHEN regexp_matches(loc, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {_host_sql('loc')}
    ELSE {_host_sql('target')} END AS h
  FROM (SELECT *, {_hdr('location')} AS loc FROM t_responses) WHERE status BETWEEN 300 AND 399 AND loc <> '')
WHERE h IS NULL OR h NOT IN ('localhost', '127.0.0.1', '[::1]')"""))
def aud_external_redirect(spark, sf):
    return A.external_redirects(responses(spark, sf)).select("page_id", "target", "status", "location_host")


@register("aud_env_hosts", W(f"""SELECT repo_id, file, line, host, signal FROM (
  SELECT repo_id, file, line, {_host_sql('u')} AS host, 'url' AS signal
  FROM (SELECT *, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+.-]*://[^\\s"''<>]+')) AS u FROM t_env_lines
        WHERE file IN ('.env', '.env.local', '.env.development'))
  UNION ALL
  SELECT repo_id, file, line, split_part(val, ':', 1), 'assigned' FROM (
    SELECT *, regexp_extract(text, '^\\s*[A-Za-z0-9_]*(?:HOST|URL|URI|ENDPOINT|BASE|host|url|uri|endpoint|base)[A-Za-z0-9_]*\\s*=\\s*["'']?([^"''\\s#]+)["'']?', 1) AS val
    FROM t_env_lines WHERE file IN ('.env', '.env.local', '.env.development'))
  WHERE val <> '' AND NOT contains(val, '://') AND val NOT IN ('localhost', '127.0.0.1')
    AND regexp_matches(val, '^[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}(?::\\d+)?$'))
WHERE host IS NOT NULL AND host NOT IN ('localhost', '127.0.0.1', '[::1]')"""))
def aud_env_hosts(spark, sf):
    return A.env_hosts(v(spark, sf, "t_env_lines")).select("repo_id", "file", "line", "host", "signal")


# ---------------------------------------------------------------- tools (t_tool_runs)

@register("agg_tool_mode", W("""SELECT repo_id, relevant, available_count, CASE WHEN available_count = 0 THEN
  'Agent-Only' WHEN available_count = relevant THEN 'Self-Hosted' ELSE 'Hybrid' END AS mode FROM (
  SELECT repo_id, count(*) FILTER (WHERE rel) AS relevant, count(*) FILTER (WHERE rel AND ok) AS available_count
  FROM (SELECT *, tool IN ('opengrep', 'osv-scanner') OR (tool = 'package-audit' AND NOT coalesce(skipped, FALSE))
          AS rel, available AND (tool <> 'opengrep' OR diagnostic IS NULL OR diagnostic = 'complete') AS ok
        FROM t_tool_runs) GROUP BY repo_id)"""))
def agg_tool_mode(spark, sf):
    return T.tool_mode(v(spark, sf, "t_tool_runs"))


def _vparts_sql(x):
    core = f"split_part(regexp_replace({Q.s(x)}, '^[vV]', ''), '-', 1)"
    return (f"list_transform(string_split({core}, '.'), lambda p: coalesce(TRY_CAST(regexp_extract(p, "
            f"'^\\s*([+-]?\\d+)', 1) AS INTEGER), 0))")


def _cmp_sql(a, b):
    pa, pb = _vparts_sql(a), _vparts_sql(b)
    n = f"greatest(len({pa}), len({pb}))"
    pa2 = f"list_concat({pa}, list_transform(range({n} - len({pa})), lambda i: 0))"
    pb2 = f"list_concat({pb}, list_transform(range({n} - len({pb})), lambda i: 0))"
    return f"(CASE WHEN {pa2} > {pb2} THEN 1 WHEN {pa2} < {pb2} THEN -1 ELSE 0 END)"


def _latest_spark(runs):
    """Latest version seen per tool across the fleet (a derived table)."""
    return (runs.where(X.nonempty("version")).select("tool", T.parse_version("version").alias("v"))
            .where(F.col("v").isNotNull())
            .groupBy("tool").agg(F.max_by("v", F.struct(T.version_parts("v"), F.col("v"))).alias("latest")))


REG_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({Q.q(n)}, {Q.q(m)})" for n, m, _ in T.TOOL_REGISTRY) + \
    ") AS r(tool, db_mode)"


@register("jn_freshness", W(f"""WITH inst AS (SELECT repo_id, tool, regexp_extract(version, '\\d+\\.\\d+(?:\\.\\d+)?', 0)
    AS installed FROM t_tool_runs WHERE available AND version <> ''),
  lat AS (SELECT tool, arg_max(installed, ({_vparts_sql('installed')}, installed)) AS latest FROM inst
          WHERE installed <> '' GROUP BY tool)
SELECT i.repo_id, i.tool, NULLIF(i.installed, '') AS installed, l.latest,
  CASE WHEN l.latest IS NULL OR i.installed = '' THEN 'unknown' WHEN {_cmp_sql('l.latest', 'i.installed')} > 0
    THEN 'outdated' ELSE 'current' END AS status, r.db_mode
FROM inst i JOIN ({REG_SQL}) r USING (tool) LEFT JOIN lat l USING (tool)"""))
def jn_freshness(spark, sf):
    runs = v(spark, sf, "t_tool_runs")
    inst = runs.where(F.col("available"))
    return T.freshness(spark, inst, _latest_spark(inst))


@register("prj_version", W(f"""SELECT repo_id, tool, version, NULLIF(regexp_extract(version, '\\d+\\.\\d+(?:\\.\\d+)?', 0), '')
  AS parsed, {_cmp_sql('version', "'v1.7.0-rc1'")} AS cmp FROM t_tool_runs"""))
def prj_version(spark, sf):
    r = v(spark, sf, "t_tool_runs")
    return r.select("repo_id", "tool", "version", T.parse_version("version").alias("parsed"),
                    T.compare_versions(F.col("version"), F.lit("v1.7.0-rc1")).alias("cmp"))


RAW_TOOL = "CASE raw_count % 3 WHEN 0 THEN tool WHEN 1 THEN upper(tool) || ' v1' ELSE 'run ' || tool END"


def _tool_name_sql(x):
    vv = f"lower({Q.js_trim(Q.s(x))})"
    return (f"CASE WHEN {vv} = '' THEN '' WHEN {vv} = 'npm' OR contains({vv}, 'npm audit') THEN 'npm audit' "
            f"WHEN {vv} = 'pnpm' OR contains({vv}, 'pnpm audit') THEN 'pnpm audit' "
            f"WHEN {vv} = 'bun' OR contains({vv}, 'bun audit') THEN 'bun audit' "
            f"WHEN {vv} IN ('osv', 'osv scanner') OR contains({vv}, 'osv-scanner') THEN 'osv-scanner' "
            f"WHEN contains({vv}, 'opengrep') THEN 'opengrep' WHEN contains({vv}, 'trivy') THEN 'trivy' "
            f"ELSE regexp_split_to_array({vv}, '{Q.WS}+')[1] END")


@register("prj_tool_name", W(f"SELECT repo_id, {RAW_TOOL} AS raw_tool, {_tool_name_sql(RAW_TOOL)} AS tool "
                             "FROM t_tool_runs"))
def prj_tool_name(spark, sf):
    r = v(spark, sf, "t_tool_runs").withColumn("raw_tool", F.expr(RAW_TOOL))
    return r.select("repo_id", "raw_tool", T.tool_name("raw_tool").alias("tool"))


REGROUP = "concat('repo', CAST(substr(repo_id, 5) AS INT) % 5)"


@register("agg_duplicate_tools", W(f"""SELECT repo_id, tool, count(*) AS runs FROM (
  SELECT {REGROUP} AS repo_id, {_tool_name_sql(RAW_TOOL)} AS tool FROM t_tool_runs)
WHERE tool IN ({', '.join(Q.q(t) for t in T.WHOLE_TREE_TOOLS)}) GROUP BY ALL HAVING count(*) > 1"""))
def agg_duplicate_tools(spark, sf):
    r = v(spark, sf, "t_tool_runs").select(F.expr(REGROUP).alias("repo_id"), F.expr(RAW_TOOL).alias("raw_tool"))
    return T.duplicate_tools(r)


@register("jn_suppressed_by_tool", W(f"""SELECT r.repo_id, r.tool, r.available, coalesce(s.suppressed, 0) AS suppressed
FROM t_tool_runs r LEFT JOIN (SELECT repo_id, {Q.finding_source('source')} AS tool, count(*) AS suppressed FROM t_dedup
  WHERE {QF.ignore_sql('file', C.DEFAULT_IGNORE_PATTERNS)} GROUP BY ALL) s USING (repo_id, tool)""", True))
def jn_suppressed_by_tool(spark, sf):
    _, sup = SP.apply_ignore(QF.deduped(spark, sf))
    return T.suppressed_by_tool(v(spark, sf, "t_tool_runs"), sup)


# ---------------------------------------------------------------- profile

def _inventory(spark, sf):
    return FS.file_inventory(v(spark, sf, "t_files"))


def _stack_sql():
    tech = Q.case_map("regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1)", C.EXTENSION_TO_TECH)
    base = "split_part(path, '/', -1)"
    ext = "'.' || regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1)"
    man = " ".join(f"WHEN {(ext if k.startswith('.') else base)} = {Q.q(k)} THEN {Q.q(lab)}" for k, lab in P.MANIFEST_STACK)
    return f"""SELECT DISTINCT repo_id, label FROM (
  SELECT repo_id, {tech} AS label FROM inv WHERE category = 'source'
  UNION ALL SELECT repo_id, CASE {man} END FROM (SELECT repo_id, path FROM inv UNION ALL
    SELECT DISTINCT repo_id, manifest_path FROM t_deps)) WHERE label IS NOT NULL"""


def _stack_spark(spark, sf):
    inv = _inventory(spark, sf)
    src = inv.where(F.col("category") == "source").select("repo_id", "path").distinct()
    others = inv.select("repo_id", "path").distinct()
    manifests = v(spark, sf, "t_deps").select("repo_id", F.col("manifest_path").alias("path")).distinct()
    parts = P.tech_stack(src, others.unionByName(manifests))
    return parts


def _inventory_cte():
    from .q_scan import INVENTORY_SQL
    return [("inv", INVENTORY_SQL)]


@register("agg_tech_stack", B.with_views(_stack_sql(), _inventory_cte()))
def agg_tech_stack(spark, sf):
    return _stack_spark(spark, sf)


@register("jn_tool_selection", B.with_views(f"""SELECT repo_id, tool FROM (
  SELECT repo_id, bool_or(contains(lower(label), 'python')) AS py, bool_or(lower(label) = 'go' OR
    contains(lower(label), 'golang')) AS go FROM ({_stack_sql()}) GROUP BY repo_id),
  LATERAL (SELECT unnest(list_filter(['gitleaks', 'trivy', CASE WHEN py THEN 'bandit' END,
    CASE WHEN go THEN 'gosec' END], lambda t: t IS NOT NULL)) AS tool)""", _inventory_cte()))
def jn_tool_selection(spark, sf):
    return P.tool_selection(_stack_spark(spark, sf))


FW_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({Q.q(k)}, {Q.q(fw)})" for k, fw in P.JS_FRAMEWORKS.items()) + \
    ") AS c(name, framework)"


def _fw_sql():
    base = "split_part(path, '/', -1)"
    cfg = " ".join(f"WHEN {base} {'=' if exact else 'LIKE'} {Q.q(n if exact else n + '%')} THEN {Q.q(fw)}"
                   for n, exact, fw in P.CONFIG_FRAMEWORKS)
    return f"""SELECT DISTINCT repo_id, framework FROM (
  SELECT d.repo_id, c.framework FROM t_deps d JOIN ({FW_SQL}) c USING (name)
  UNION ALL SELECT repo_id, CASE {cfg} END FROM t_files) WHERE framework IS NOT NULL"""


@register("jn_frameworks", W(_fw_sql()))
def jn_frameworks(spark, sf):
    return P.frameworks(spark, deps=v(spark, sf, "t_deps"), files=v(spark, sf, "t_files").select("repo_id", "path"))


MANIFEST_DOC = ("to_json(named_struct('name', concat('pkg', o_orderkey), 'main', CASE WHEN o_orderkey % 4 = 0 THEN "
                "'index.js' END, 'scripts', CASE WHEN o_orderkey % 8 = 4 THEN named_struct('start', 'node .') END, "
                "'dependencies', map(name, version)))")


def _manifest_docs(spark, sf):
    o = B.table(spark, sf, "orders")
    d = o.selectExpr(*[B._spark_text(e) for e in B.VIEWS["t_deps"][1]], "o_orderkey")
    return d.select("repo_id", F.col("manifest_path").alias("path"), F.expr(MANIFEST_DOC).alias("content"))


PROJECT_TYPE_SQL = f"""WITH fw AS ({_fw_sql()}),
flags AS (SELECT repo_id, bool_or(framework IN ({', '.join(Q.q(x) for x in P.MOBILE_FW)})) AS mobile,
  bool_or(framework IN ({', '.join(Q.q(x) for x in P.DESKTOP_FW)})) AS desktop,
  bool_or(framework IN ({', '.join(Q.q(x) for x in P.BACKEND_FW)})) AS backend,
  bool_or(framework IN ({', '.join(Q.q(x) for x in P.FRONTEND_FW)})) AS frontend FROM fw GROUP BY repo_id),
docs AS (SELECT repo_id, manifest_path AS path, o_orderkey % 4 = 0 AS has_main, o_orderkey % 8 = 4 AS has_start
  FROM (SELECT concat('repo', o_custkey % 20) AS repo_id, concat(CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN
    'apps/web/' ELSE 'services/api/' END, 'package.json') AS manifest_path, o_orderkey FROM orders)),
per AS (SELECT repo_id, path, bool_or(has_main) AS main, bool_or(has_start) AS start FROM docs GROUP BY ALL),
root AS (SELECT repo_id, arg_min(main AND NOT start, (len(string_split(path, '/')), path)) AS library FROM per GROUP BY repo_id),
repos AS (SELECT repo_id FROM fw UNION SELECT repo_id FROM docs)
SELECT r.repo_id, CASE WHEN coalesce(mobile, FALSE) THEN 'mobile' WHEN coalesce(desktop, FALSE) THEN 'desktop'
  WHEN coalesce(backend, FALSE) AND NOT coalesce(frontend, FALSE) THEN 'api' WHEN coalesce(frontend, FALSE) THEN 'web'
  WHEN coalesce(library, FALSE) THEN 'library' ELSE 'unknown' END AS project_type
FROM repos r LEFT JOIN flags USING (repo_id) LEFT JOIN root USING (repo_id)"""


@register("agg_project_type", W(PROJECT_TYPE_SQL))
def agg_project_type(spark, sf):
    fw = P.frameworks(spark, deps=v(spark, sf, "t_deps"), files=v(spark, sf, "t_files").select("repo_id", "path"))
    docs = _manifest_docs(spark, sf)
    parsed = docs.select("repo_id", "path",
                         F.from_json("content", "struct<main:string, exports:string, scripts:map<string,string>>")
                         .alias("j"))
    s_ = F.col("j.scripts")
    man = parsed.select("repo_id", "path", (X.nonempty(F.col("j.main")) | X.nonempty(F.col("j.exports")))
                        .alias("has_main"),
                        F.coalesce(X.nonempty(F.try_element_at(s_, F.lit("start"))) |
                                   X.nonempty(F.try_element_at(s_, F.lit("dev"))) |
                                   X.nonempty(F.try_element_at(s_, F.lit("serve"))), F.lit(False)).alias("has_start"))
    return P.project_type(fw, man)


@register("src_manifest_deps", W("SELECT repo_id, manifest_path AS path, 'npm' AS ecosystem, name, version FROM t_deps"))
def src_manifest_deps(spark, sf):
    return RS.manifest_deps(_manifest_docs(spark, sf)).select("repo_id", "path", "ecosystem", "name", "version")


BACKEND_DEPS = "SELECT * FROM (VALUES " + ", ".join(f"({Q.q(d)}, {Q.q(b[0])})" for b in P.BACKENDS for d in b[1]) + \
    ") AS c(dep, backend)"


@register("jn_backends", W(f"""SELECT DISTINCT repo_id, backend FROM (
  SELECT d.repo_id, c.backend FROM t_deps d JOIN ({BACKEND_DEPS}) c ON lower(d.name) = c.dep
  UNION ALL SELECT repo_id, unnest(list_filter([{', '.join(f"CASE WHEN contains(lower(text), {Q.q(h)}) THEN {Q.q(b[0])} END" for b in P.BACKENDS for h in b[4])}],
    lambda x: x IS NOT NULL)) FROM t_lines
  UNION ALL SELECT repo_id, unnest(list_filter([{', '.join(f"CASE WHEN contains(lower(path), {Q.q(f.lower())}) THEN {Q.q(b[0])} END" for b in P.BACKENDS for f in b[3])}],
    lambda x: x IS NOT NULL)) FROM t_files
  UNION ALL SELECT f.repo_id, c.backend FROM t_files f JOIN (SELECT * FROM (VALUES {', '.join(f"({Q.q(e)}, {Q.q(b[0])})" for b in P.BACKENDS for e in b[2])}) AS e(ext, backend)) c
    ON '.' || split_part(lower(f.path), '.', -1) = c.ext)"""))
def jn_backends(spark, sf):
    files = v(spark, sf, "t_files")
    return P.backends(spark, paths=files.select("repo_id", "path"), deps=v(spark, sf, "t_deps"),
                      texts=B.lines_of(files))


LOCK = ("CASE o_custkey % 6 WHEN 0 THEN 'pnpm-lock.yaml' WHEN 1 THEN 'package-lock.json' WHEN 2 THEN "
        "'npm-shrinkwrap.json' WHEN 3 THEN 'bun.lock' WHEN 4 THEN 'yarn.lock' ELSE 'README.md' END")
ROOTFILES = (f"SELECT concat('repo', o_orderkey % 23) AS repo_id, CASE WHEN o_orderkey % 3 = 0 THEN 'package.json' "
             f"ELSE {LOCK} END AS path FROM orders")


@register("jn_audit_strategy", W(f"""SELECT repo_id,
  CASE WHEN NOT pkg THEN NULL WHEN pnpm THEN 'pnpm' WHEN npm OR shrink THEN 'npm' WHEN bun THEN 'bun'
    WHEN yarn THEN 'yarn' ELSE 'npm' END AS manager,
  CASE WHEN NOT pkg THEN NULL WHEN pnpm THEN 'pnpm-lock.yaml' WHEN npm THEN 'package-lock.json'
    WHEN shrink THEN 'npm-shrinkwrap.json' WHEN bunb THEN 'bun.lockb' WHEN bun THEN 'bun.lock' WHEN yarn THEN 'yarn.lock'
    ELSE 'package.json' END AS lockfile,
  NOT pkg OR (NOT pnpm AND NOT npm AND NOT shrink AND NOT bunb AND NOT bun AND yarn) AS skipped
FROM (SELECT repo_id, bool_or(path = 'package.json') AS pkg, bool_or(path = 'pnpm-lock.yaml') AS pnpm,
  bool_or(path = 'package-lock.json') AS npm, bool_or(path = 'npm-shrinkwrap.json') AS shrink,
  bool_or(path = 'bun.lockb') AS bunb, bool_or(path = 'bun.lock') AS bun, bool_or(path = 'yarn.lock') AS yarn
  FROM ({ROOTFILES}) GROUP BY repo_id)"""))
def jn_audit_strategy(spark, sf):
    return P.audit_strategy(B.table(spark, sf, "orders").selectExpr(
        "concat('repo', o_orderkey % 23) AS repo_id", f"CASE WHEN o_orderkey % 3 = 0 THEN 'package.json' ELSE {LOCK} END AS path"))


# ---------------------------------------------------------------- path projections (t_files)

@register("prj_language", W(f"SELECT repo_id, path, {Q.language('path')} AS language FROM t_files"))
def prj_language(spark, sf):
    return v(spark, sf, "t_files").select("repo_id", "path", X.language("path").alias("language"))


@register("prj_tech_label", W("SELECT repo_id, path, " + Q.case_map(
    "regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1)", C.EXTENSION_TO_TECH) + " AS label FROM t_files"))
def prj_tech_label(spark, sf):
    return v(spark, sf, "t_files").select("repo_id", "path", X.tech_label("path").alias("label"))


@register("prj_kind", B.with_views("""SELECT repo_id, path, CASE WHEN bool_or(category = 'baas') THEN 'baas'
  WHEN bool_or(category = 'config') THEN 'config' ELSE 'source' END AS kind FROM inv
WHERE category <> 'dependency' GROUP BY ALL""", _inventory_cte()))
def prj_kind(spark, sf):
    return FS.classify(v(spark, sf, "t_files")).select("repo_id", "path", "kind")


@register("prj_non_source", W(f"SELECT repo_id, path, {Q.non_source('path')} AS non_source FROM t_files"))
def prj_non_source(spark, sf):
    return v(spark, sf, "t_files").select("repo_id", "path", X.non_source("path").alias("non_source"))


@register("set_scan_files", B.with_views("SELECT DISTINCT repo_id, path FROM inv WHERE category <> 'dependency'",
                                         _inventory_cte()))
def set_scan_files(spark, sf):
    inv = _inventory(spark, sf)
    parts = [inv.where(F.col("category") == c).select("repo_id", "path") for c in ("source", "config", "baas")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@register("srt_files_root_first", B.with_views("SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY depth, path) AS rank FROM (SELECT DISTINCT repo_id, "
                                               "path, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM inv)", _inventory_cte()))
def srt_files_root_first(spark, sf):
    """The files of each repository, root-most first, with their rank; no per-repository window."""
    inv = _inventory(spark, sf).select("repo_id", "path", F.size(F.split("path", "/")).cast("bigint").alias("depth")).distinct()
    return positions(inv, [F.col("depth"), F.col("path")], ("repo_id",), "rank")


def _inside_sql(p):
    segs = f"string_split(replace({p}, '\\', '/'), '/')"
    depth = (f"list_reduce(list_prepend(0, list_transform({segs}, lambda s: CASE WHEN s = '..' THEN -1 WHEN s IN ('', '.') "
             f"THEN 0 ELSE 1 END)), lambda a, b: CASE WHEN a < 0 THEN a ELSE a + b END)")
    return (f"(NOT ({p} IS NULL OR trim({p}) = '' OR starts_with({p}, '/') OR starts_with({p}, '\\') OR "
            f"regexp_matches({p}, '^[A-Za-z]:')) AND {depth} >= 0)")


INSIDE_SAMPLES = ("CASE doc_id % 5 WHEN 0 THEN path WHEN 1 THEN '../' || path WHEN 2 THEN 'a/../../' || path "
                  "WHEN 3 THEN '/etc/' || path ELSE 'C:' || path END")


@register("prj_path_inside", W(f"SELECT repo_id, p, {_inside_sql('p')} AS inside FROM (SELECT repo_id, {INSIDE_SAMPLES} "
                               "AS p FROM t_files)"))
def prj_path_inside(spark, sf):
    f = v(spark, sf, "t_files").select("repo_id", F.expr(INSIDE_SAMPLES).alias("p"))
    return f.select("repo_id", "p", path_inside("p").alias("inside"))


def path_inside(p):
    """Relative, non-empty path that does not climb above the root."""
    segs = F.split(F.regexp_replace(X.col(p), "\\\\", "/"), "/")
    steps = F.transform(segs, lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1))
    depth = F.aggregate(steps, F.lit(0), lambda a, b: F.when(a < 0, a).otherwise(a + b))
    bad = (X.col(p).isNull() | (F.trim(X.col(p)) == "") | X.col(p).startswith("/") | X.col(p).startswith("\\")
           | X.col(p).rlike("^[A-Za-z]:"))
    return ~bad & (depth >= 0)


# ---------------------------------------------------------------- text projections (t_lines)

SNIP_MATCH = "regexp_extract(text, '[A-Za-z]{7,}', 0)"


@register("prj_snippet", W(f"""SELECT repo_id, path, line, CASE WHEN n <= 2000 THEN t
  WHEN idx < 0 THEN substr(t, 1, 1997) || '...'
  ELSE (CASE WHEN st > 0 THEN '...' ELSE '' END) || substr(t, st + 1, en - st) || (CASE WHEN en < n THEN '...' ELSE '' END)
  END AS snippet FROM (
  SELECT *, greatest(0, idx - ctx) AS st, least(n, idx + length(m) + ctx) AS en FROM (
    SELECT *, length(t) AS n, CASE WHEN m <> '' THEN strpos(t, m) - 1 ELSE -1 END AS idx,
      greatest(0, CAST(floor((2000 - length(m) - 6) / 2) AS INTEGER)) AS ctx FROM (
      SELECT repo_id, path, line, {Q.js_trim('text')} AS t, {SNIP_MATCH} AS m FROM t_lines)))"""))
def prj_snippet(spark, sf):
    lines = v(spark, sf, "t_lines")
    return lines.select("repo_id", "path", "line", X.snippet("text", F.expr(SNIP_MATCH)).alias("snippet"))


# a token of 40 hex digits, else the second word (those of three letters and fewer are too short to be scrubbed)
SCRUB_SECRET = ("CASE WHEN regexp_extract(text, '[0-9a-f]{40}', 0) <> '' THEN regexp_extract(text, '[0-9a-f]{40}', 0) "
                "ELSE regexp_extract(text, '^[^ ]+ ([^ ]+)', 1) END")


@register("prj_scrub", W(f"""SELECT repo_id, path, line, CASE WHEN length(sec) >= 4 THEN replace(text, sec, '[REDACTED]')
  ELSE text END AS scrubbed FROM (SELECT *, {SCRUB_SECRET} AS sec FROM t_lines)"""))
def prj_scrub(spark, sf):
    from ..operators.normalize import scrub
    lines = v(spark, sf, "t_lines").withColumn("sec", F.expr(SCRUB_SECRET))
    return lines.select("repo_id", "path", "line", scrub(F.col("text"), F.col("sec")).alias("scrubbed"))


def _redact_sql():
    from ..rules.catalogue import SECRET_RULES
    from . import oracle_scan as O
    ctes = O.detect_ctes(SECRET_RULES)
    return B.with_views("SELECT repo_id, path AS file, line, rule_ord, match, " + Q.redact_match("match", "grp") +
                        " AS redacted FROM hits", ctes)


@register("prj_redact_match", _redact_sql())
def prj_redact_match(spark, sf):
    from ..rules.catalogue import SECRET_RULES
    hits = S.rule_hits(S.prepare_lines(v(spark, sf, "t_files"), spread=True), SECRET_RULES)
    return hits.select("repo_id", F.col("path").alias("file"), "line", "rule_ord", "match",
                       X.redact_match("match", "group1").alias("redacted"))


@register("scan_red_flags", W("SELECT repo_id, path, line, flag, " + Q.case_map("flag", S.RED_FLAG_NOTES, "NULL") +
    " AS note FROM (SELECT repo_id, path, line, unnest(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, {Q.q(('(?i)' if fl else '') + p)}) THEN {Q.q(n)} END" for n, p, fl in S.RED_FLAGS)
    + "], lambda x: x IS NOT NULL)) AS flag FROM t_lines)"))
def scan_red_flags(spark, sf):
    return S.red_flags(v(spark, sf, "t_lines")).select("repo_id", "path", "line", "flag", "note")


# ---------------------------------------------------------------- checksums

LISTING = ("concat(CASE WHEN doc_id % 4 = 0 THEN upper(sha2(content, 256)) WHEN doc_id % 4 = 1 THEN sha2(concat(content, 'x'), 256) "
           "ELSE sha2(content, 256) END, CASE WHEN doc_id % 2 = 0 THEN '  *' ELSE '  ' END, 'dl/', path)")


@register("src_checksums", W("SELECT repo_id, lower(d) AS digest, split_part(n, '/', -1) AS name FROM (SELECT repo_id, "
                             "regexp_extract(l, '^([0-9a-fA-F]{64})\\s+\\*?(.+?)\\s*$', 1) AS d, regexp_extract(l, "
                             "'^([0-9a-fA-F]{64})\\s+\\*?(.+?)\\s*$', 2) AS n FROM (SELECT repo_id, CASE WHEN doc_id % 4 = 0 "
                             "THEN upper(sha256(content)) WHEN doc_id % 4 = 1 THEN sha256(content || 'x') ELSE sha256(content) "
                             "END || CASE WHEN doc_id % 2 = 0 THEN '  *' ELSE '  ' END || 'dl/' || path AS l FROM t_files))"))
def src_checksums(spark, sf):
    f = v(spark, sf, "t_files").select("repo_id", F.expr(LISTING).alias("text"))
    return RS.parse_checksums(f).select("repo_id", "digest", "name")


@register("jn_checksum", W("""SELECT f.repo_id, f.path AS name, l.digest AS digest_listed,
  coalesce(regexp_matches(l.digest, '^[0-9a-f]{64}$') AND sha256(f.content) = l.digest, FALSE) AS verified
FROM t_files f LEFT JOIN (SELECT repo_id, lower(regexp_extract(l, '^([0-9a-fA-F]{64})', 1)) AS digest,
  split_part(regexp_extract(l, '^([0-9a-fA-F]{64})\\s+\\*?(.+?)\\s*$', 2), '/', -1) AS base FROM (
  SELECT repo_id, CASE WHEN doc_id % 4 = 0 THEN upper(sha256(content)) WHEN doc_id % 4 = 1 THEN sha256(content || 'x')
  ELSE sha256(content) END || CASE WHEN doc_id % 2 = 0 THEN '  *' ELSE '  ' END || 'dl/' || path AS l FROM t_files)) l
ON l.repo_id = f.repo_id AND l.base = split_part(f.path, '/', -1)"""))
def jn_checksum(spark, sf):
    files = v(spark, sf, "t_files")
    listing = RS.parse_checksums(files.select("repo_id", F.expr(LISTING).alias("text")))
    out = T.checksum_match(files.select("repo_id", F.col("path").alias("name"), "content"), listing)
    return out.withColumn("verified", F.coalesce("verified", F.lit(False)))
