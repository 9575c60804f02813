import time

from pyspark.sql import functions as F

from auditspark.operators.suppress import compile_pattern, is_ignored, parse_ignore

CASES = [
    (["dist/"], "dist/a.js", True), (["dist/"], "pkg/dist/a.js", True), (["dist/"], "distx/a.js", False),
    (["/build"], "build/x", False), (["/build"], "build", True), (["/build/"], "build/x", True),
    (["/build/"], "a/build/x", False), (["*.min.js"], "a/b/c.min.js", True), (["*.min.js"], "a.min.jsx", False),
    (["src/*.js"], "src/a.js", True), (["src/*.js"], "src/a/b.js", False), (["src/**/*.js"], "src/a/b.js", True),
    (["src/**/*.js"], "src/b.js", True), (["a?c"], "x/abc", True), (["a?c"], "x/a/c", False),
    (["test/", "!test/keep.js"], "test/keep.js", False), (["test/", "!test/keep.js"], "test/other.js", True),
    (["!test/keep.js", "test/"], "test/keep.js", True), (["docs/"], "", False),
    (["*.js"], "./src\\a.js", True),
]


def test_ignore_cases(spark):
    rows = [(i, p) for i, (_, p, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, p string")
    from auditspark.operators.suppress import ignore_path
    for i, (pats, path, exp) in enumerate(CASES):
        got = df.where(F.col("i") == i).select(is_ignored(ignore_path("p"), pats).alias("x")).first().x
        assert got is exp, (pats, path)


def test_hostile_glob_is_fast(spark):
    neg, rx = compile_pattern("**/" * 30 + "x")
    assert rx.count(".*") <= 2
    neg, rx = compile_pattern("*" * 101)          # one run of stars collapses to a globstar
    assert rx != "(?!)"
    assert compile_pattern("a*" * 101, max_stars=100)[1] == "(?!)"
    assert compile_pattern("a*" * 101)[1] != "(?!)"   # no limit unless asked for
    df = spark.createDataFrame([("a/" * 30 + "y",)], "p string")
    t = time.time()
    assert df.select(is_ignored("p", ["**/" * 30 + "*a*a*a*a*a*x"]).alias("x")).first().x is False
    assert time.time() - t < 10


def test_ignore_lines_trims_all_blanks(spark):
    from auditspark.operators.suppress import ignore_lines
    df = spark.createDataFrame([("r", "\t# note\r\n \u00a0dist/ \n\n!keep")], "repo_id string, doc string")
    assert [(r.ordinal, r.pattern) for r in ignore_lines(df, "doc", ["repo_id"]).collect()] == [(1, "dist/"), (3, "!keep")]


def test_parse_ignore():
    assert parse_ignore("# c\n\n  dist/  \r\n!keep\n") == ["dist/", "!keep"]
