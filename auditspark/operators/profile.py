"""Project profile per repository: tech stack, frameworks, project type,
backends, audit strategy and tool selection (sections 2.6, 2.7).

Catalogues are tiny fixed tables. Equality signals (dependency names, file
extensions) are broadcast equi-joins against them; substring signals (file
markers, connection-string hints, manifest text) are literal ``contains``
projections - no theta join, no nested loop.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X

# FIXED VALUES: dependency name -> framework (package.json), then other manifests
JS_FRAMEWORKS = {
    "react": "React", "vue": "Vue", "@angular/core": "Angular", "svelte": "Svelte", "next": "Next.js",
    "nuxt": "Nuxt", "express": "Express", "fastify": "Fastify", "@nestjs/core": "NestJS",
    "react-native": "React Native", "expo": "Expo", "electron": "Electron", "@tauri-apps/api": "Tauri",
}
COMPOSER_FRAMEWORKS = {"laravel/framework": "Laravel"}
# (manifest basename rule, needle, lower-case?, framework)
TEXT_FRAMEWORKS = [
    ("requirements.txt", "django", True, "Django"), ("requirements.txt", "flask", True, "Flask"),
    ("requirements.txt", "fastapi", True, "FastAPI"),
    ("pyproject.toml", "django", True, "Django"), ("pyproject.toml", "flask", True, "Flask"),
    ("pyproject.toml", "fastapi", True, "FastAPI"),
    ("Gemfile", "'rails'", True, "Rails"), ("Gemfile", '"rails"', True, "Rails"),
    ("pom.xml", "spring-boot", True, "Spring"), ("pom.xml", "springframework", True, "Spring"),
    ("build.gradle", "spring-boot", True, "Spring"), ("build.gradle", "org.springframework", True, "Spring"),
    ("build.gradle.kts", "spring-boot", True, "Spring"), ("build.gradle.kts", "org.springframework", True, "Spring"),
    ("go.mod", "gin-gonic/gin", False, "Gin"), ("go.mod", "labstack/echo", False, "Echo"),
    ("go.mod", "gofiber/fiber", False, "Fiber"),
    ("*.csproj", "Microsoft.AspNetCore", False, "ASP.NET"),
    ("pubspec.yaml", "flutter", True, "Flutter"),
]
# config-file basename prefix -> framework; exact names
CONFIG_FRAMEWORKS = [("angular.json", True, "Angular"), ("vue.config.", False, "Vue"),
                     ("svelte.config.", False, "Svelte"), ("next.config.", False, "Next.js"),
                     ("nuxt.config.", False, "Nuxt"), ("gatsby-config.", False, "Gatsby"),
                     ("manage.py", True, "Django")]
BACKEND_FW = ["Express", "Fastify", "NestJS", "Django", "Flask", "FastAPI", "Laravel", "Rails", "Spring", "Gin",
              "Echo", "Fiber", "ASP.NET"]
FRONTEND_FW = ["React", "Vue", "Angular", "Svelte", "Next.js", "Nuxt", "Gatsby"]
MOBILE_FW = ["React Native", "Flutter", "Expo"]
DESKTOP_FW = ["Electron", "Tauri"]

# manifest basename (or extension) -> tech-stack label
MANIFEST_STACK = [("package.json", "Node.js"), ("requirements.txt", "Python"), ("pyproject.toml", "Python"),
                  ("setup.py", "Python"), ("Pipfile", "Python"), ("go.mod", "Go"), ("Cargo.toml", "Rust"),
                  (".csproj", "C#"), (".sln", "C#"), ("pubspec.yaml", "Dart"), ("Package.swift", "Swift"),
                  (".lpi", "Delphi"), (".dproj", "Delphi")]

# FIXED VALUES: database / BaaS backends: id, dependency names, file extensions, file markers, hints
BACKENDS = [
    ("postgres", ["pg", "postgres", "pg-promise", "slonik"], [], [], ["postgres://", "postgresql://"]),
    ("supabase", ["@supabase/supabase-js", "supabase"], [], ["supabase/config.toml", "supabase/migrations"],
     ["supabase.co"]),
    ("mysql", ["mysql", "mysql2", "mariadb"], [], ["my.cnf"], ["mysql://", "mariadb://"]),
    ("mongodb", ["mongodb", "mongoose"], [], [], ["mongodb://", "mongodb+srv://"]),
    ("sqlite", ["better-sqlite3", "sqlite3", "sql.js"], [".db", ".sqlite", ".sqlite3"], [], ["sqlite:"]),
    ("firebird", ["node-firebird"], [".fdb", ".gdb"], [], ["firebird"]),
    ("msaccess", [], [".mdb", ".accdb"], [], ["microsoft.ace.oledb", "microsoft.jet.oledb"]),
    ("libreoffice_base", [], [".odb"], [], []),
    ("hsqldb", [], [".script", ".lobs"], [], ["jdbc:hsqldb:"]),
    ("pocketbase", ["pocketbase"], [], ["pb_data", "pb_migrations"], []),
    ("appwrite", ["appwrite", "node-appwrite"], [], ["appwrite.json"], []),
    ("nocodb", ["nocodb"], [], [], ["nc_db", "nocodb"]),
    ("firebase", ["firebase", "firebase-admin"], [], ["firebase.json", "firestore.rules", ".firebaserc"],
     ["firebaseio.com"]),
]


def _catalog(spark: SparkSession, rows, schema) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def tech_stack(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """``agg_tech_stack``: distinct labels from source-file extensions and manifests."""
    parts = [files.select("repo_id", X.tech_label("path").alias("label"))]
    src = files.select("repo_id", "path")
    if manifests is not None:
        src = src.unionByName(manifests.select("repo_id", "path"))
    base = X.basename("path")
    ext = F.concat(F.lit("."), X.node_extname("path"))
    m = F.array_compact(F.array(*[F.when((base == k) if not k.startswith(".") else (ext == k), F.lit(v))
                                  for k, v in MANIFEST_STACK]))
    parts.append(src.select("repo_id", F.explode(m).alias("label")))
    return parts[0].unionByName(parts[1]).where(F.col("label").isNotNull()).distinct()


def frameworks(spark: SparkSession, deps: DataFrame | None = None, texts: DataFrame | None = None,
               files: DataFrame | None = None) -> DataFrame:
    """``jn_frameworks``: (repo_id, framework) from dependency names (broadcast
    equi-join), manifest text (contains) and config file names."""
    out = []
    if deps is not None:
        cat = _catalog(spark, [("npm", k, v) for k, v in JS_FRAMEWORKS.items()] +
                       [("composer", k, v) for k, v in COMPOSER_FRAMEWORKS.items()],
                       "ecosystem string, name string, framework string")
        out.append(deps.join(cat, ["ecosystem", "name"]).select("repo_id", "framework"))
    if texts is not None:
        base = X.basename("path")
        arr = []
        for manifest, needle, lower, fw in TEXT_FRAMEWORKS:
            cond = (F.col("path").endswith(".csproj") if manifest == "*.csproj" else (base == manifest))
            body = F.lower("content") if lower else F.col("content")
            arr.append(F.when(cond & body.contains(needle), F.lit(fw)))
        out.append(texts.select("repo_id", F.explode(F.array_compact(F.array(*arr))).alias("framework")))
    if files is not None:
        base = X.basename("path")
        arr = [F.when((base == n) if exact else base.startswith(n), F.lit(fw)) for n, exact, fw in CONFIG_FRAMEWORKS]
        out.append(files.select("repo_id", F.explode(F.array_compact(F.array(*arr))).alias("framework")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.distinct()


def project_type(fw: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """``agg_project_type``: mobile > desktop > api > web > library > unknown.

    ``manifests``: (repo_id, path, has_main, has_start) per package.json document;
    the library test uses the root-most package.json of the repository.
    """
    flags = fw.groupBy("repo_id").agg(
        F.bool_or(F.col("framework").isin(*MOBILE_FW)).alias("mobile"),
        F.bool_or(F.col("framework").isin(*DESKTOP_FW)).alias("desktop"),
        F.bool_or(F.col("framework").isin(*BACKEND_FW)).alias("backend"),
        F.bool_or(F.col("framework").isin(*FRONTEND_FW)).alias("frontend"))
    repos = fw.select("repo_id")
    if manifests is not None:
        per = (manifests.where(X.basename("path") == "package.json")
               .groupBy("repo_id", "path").agg(F.bool_or("has_main").alias("main"),
                                               F.bool_or("has_start").alias("start")))
        root = per.groupBy("repo_id").agg(F.min(F.struct(F.size(F.split("path", "/")).alias("d"), F.col("path"),
                                                          F.col("main"), F.col("start"))).alias("_r"))
        lib = root.select("repo_id", (F.col("_r.main") & ~F.col("_r.start")).alias("library"))
        repos = repos.unionByName(manifests.select("repo_id"))
    else:
        lib = None
    r = repos.distinct().join(flags, "repo_id", "left")
    if lib is not None:
        r = r.join(lib, "repo_id", "left")
    else:
        r = r.withColumn("library", F.lit(False))
    c = lambda n: F.coalesce(F.col(n), F.lit(False))
    t = (F.when(c("mobile"), "mobile").when(c("desktop"), "desktop")
         .when(c("backend") & ~c("frontend"), "api").when(c("frontend"), "web")
         .when(c("library"), "library").otherwise("unknown"))
    return r.select("repo_id", t.alias("project_type"))


def backends(spark: SparkSession, paths: DataFrame | None = None, deps: DataFrame | None = None,
             texts: DataFrame | None = None) -> DataFrame:
    """``jn_backends``: four signals, each its own plan, unioned and distinct:
    extension (equi-join on the last extension), dependency (equi-join),
    file marker and connection hint (literal ``contains`` projections)."""
    out = []
    if paths is not None:
        p = F.lower(F.regexp_replace(X.s("path"), "\\\\", "/"))
        ext_cat = _catalog(spark, [(e, b[0]) for b in BACKENDS for e in b[2]], "ext string, backend string")
        pe = paths.select("repo_id", p.alias("p")).withColumn(
            "ext", F.concat(F.lit("."), F.substring_index("p", ".", -1)))
        out.append(pe.join(ext_cat, "ext").select("repo_id", "backend"))
        arr = [F.when(F.col("p").contains(f.lower()), F.lit(b[0])) for b in BACKENDS for f in b[3]]
        out.append(pe.select("repo_id", F.explode(F.array_compact(F.array(*arr))).alias("backend")))
    if deps is not None:
        dep_cat = _catalog(spark, [(d, b[0]) for b in BACKENDS for d in b[1]], "dep string, backend string")
        out.append(deps.select("repo_id", F.lower("name").alias("dep")).join(dep_cat, "dep")
                   .select("repo_id", "backend"))
    if texts is not None:
        t = F.lower(X.s("text"))
        arr = [F.when(t.contains(h), F.lit(b[0])) for b in BACKENDS for h in b[4]]
        out.append(texts.select("repo_id", F.explode(F.array_compact(F.array(*arr))).alias("backend")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.distinct()


def audit_strategy(repo_files: DataFrame) -> DataFrame:
    """``jn_audit_strategy``: per repository, package audit by root lockfile
    priority pnpm > npm > shrinkwrap > bun > yarn (skipped) > package.json only;
    no root package.json -> skipped. Input: (repo_id, path) of root files."""
    has = lambda n: F.max(F.col("path") == n)
    f = repo_files.groupBy("repo_id").agg(
        has("package.json").alias("pkg"), has("pnpm-lock.yaml").alias("pnpm"), has("package-lock.json").alias("npm"),
        has("npm-shrinkwrap.json").alias("shrink"), has("bun.lockb").alias("bunb"), has("bun.lock").alias("bun"),
        has("yarn.lock").alias("yarn"))
    manager = (F.when(~F.col("pkg"), F.lit(None)).when(F.col("pnpm"), "pnpm").when(F.col("npm") | F.col("shrink"), "npm")
               .when(F.col("bunb") | F.col("bun"), "bun").when(F.col("yarn"), "yarn").otherwise("npm"))
    lock = (F.when(~F.col("pkg"), F.lit(None)).when(F.col("pnpm"), "pnpm-lock.yaml")
            .when(F.col("npm"), "package-lock.json").when(F.col("shrink"), "npm-shrinkwrap.json")
            .when(F.col("bunb"), "bun.lockb").when(F.col("bun"), "bun.lock").when(F.col("yarn"), "yarn.lock")
            .otherwise("package.json"))
    skipped = ~F.col("pkg") | (~F.col("pnpm") & ~F.col("npm") & ~F.col("shrink") & ~F.col("bunb") & ~F.col("bun")
                               & F.col("yarn"))
    return f.select("repo_id", manager.alias("manager"), lock.alias("lockfile"), skipped.alias("skipped"))


def tool_selection(stack: DataFrame) -> DataFrame:
    """``jn_tool_selection``: gitleaks and trivy always; bandit with Python; gosec with Go."""
    s = F.lower("label")
    f = stack.groupBy("repo_id").agg(F.bool_or(s.contains("python")).alias("py"),
                                     F.bool_or((s == "go") | s.contains("golang")).alias("go"))
    tools = F.array_compact(F.array(F.lit("gitleaks"), F.lit("trivy"), F.when(F.col("py"), F.lit("bandit")),
                                    F.when(F.col("go"), F.lit("gosec"))))
    return f.select("repo_id", F.explode(tools).alias("tool"))


def kind_of(path) -> Column:
    from ..sources import files as S
    return S.kind(S.categories(path))
