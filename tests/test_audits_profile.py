import json

from pyspark.sql import functions as F

from auditspark.operators import audits as A
from auditspark.operators import profile as P
from auditspark.operators import tools as T


def test_header_cors_redirect(spark):
    rows = [(1, "http://localhost:3000/", 200, json.dumps({"Content-Security-Policy": "x", "X-Content-Type-Options": "n",
                                                          "x-frame-options": "DENY", "Referrer-Policy": "r",
                                                          "Permissions-Policy": "p"})),
            (2, "http://localhost:3000/", 302, json.dumps({"Location": "https://evil.example/x",
                                                          "Access-Control-Allow-Origin": "*"})),
            (3, "http://localhost:3000/", 301, json.dumps({"location": "/login"}))]
    df = spark.createDataFrame(rows, "page_id long, target string, status int, headers_json string") \
        .withColumn("headers", A.headers_map())
    h = {r.page_id: r for r in A.security_headers(df).collect()}
    assert h[1].result == "DAST-CLEAN" and h[2].severity == "LOW" and "referrer-policy" in h[2].missing
    c = {r.page_id: r.result for r in A.cors(df).collect()}
    assert c == {1: "DAST-CLEAN", 2: "DAST-SUSPECTED", 3: "DAST-CLEAN"}
    red = [r.page_id for r in A.external_redirects(df).collect()]
    assert red == [2]


def test_env_hosts(spark):
    rows = [("r", ".env", 1, "API_URL=https://api.Example.com/v1"), ("r", ".env", 2, "DB_HOST=db.internal.net:5432"),
            ("r", ".env", 3, "CACHE_HOST=127.0.0.1"), ("r", ".env.production", 4, "X_URL=https://prod.example.com"),
            ("r", ".env.local", 5, "LOCAL=http://localhost:8080")]
    df = spark.createDataFrame(rows, "repo_id string, file string, line long, text string")
    got = sorted((r.line, r.host, r.signal) for r in A.env_hosts(df).collect())
    assert got == [(1, "api.example.com", "url"), (2, "db.internal.net", "assigned")]


def test_versions_and_tool_names(spark):
    df = spark.createDataFrame([("v1.2.3", "1.2.10"), ("2.0.0-rc1", "2.0"), ("1.10", "1.9.9"), ("x", "0")],
                               "a string, b string")
    assert [r.c for r in df.select(T.compare_versions("a", "b").alias("c")).collect()] == [-1, 0, 1, 0]
    n = spark.createDataFrame([("OSV Scanner",), ("npm audit --json",), ("semgrep ci",), ("  ",)], "t string")
    assert [r.x for r in n.select(T.tool_name("t").alias("x")).collect()] == ["osv-scanner", "npm audit", "semgrep", ""]


def test_project_type_and_backends(spark):
    deps = spark.createDataFrame([("a", "npm", "react"), ("a", "npm", "pg"), ("b", "npm", "express"),
                                  ("c", "npm", "electron"), ("c", "npm", "react")],
                                 "repo_id string, ecosystem string, name string")
    fw = P.frameworks(spark, deps=deps)
    types = {r.repo_id: r.project_type for r in P.project_type(fw).collect()}
    assert types == {"a": "web", "b": "api", "c": "desktop"}
    paths = spark.createDataFrame([("a", "data/app.sqlite3"), ("b", "supabase/migrations/1.sql")], "repo_id string, path string")
    texts = spark.createDataFrame([("b", "url = mongodb+srv://x")], "repo_id string, text string")
    got = {(r.repo_id, r.backend) for r in P.backends(spark, paths=paths, deps=deps, texts=texts).collect()}
    assert got == {("a", "postgres"), ("a", "sqlite"), ("b", "supabase"), ("b", "mongodb")}
