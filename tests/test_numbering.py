import random

from pyspark.sql import functions as F

from auditspark.operators.corroborate import deduplicate, reference_rows
from auditspark.operators.numbering import positions


def test_positions_in_all_and_in_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None, "c"]), r.randint(0, 10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, position long")
    got = sorted((x["rank"], x.v, x.position) for x in positions(df, [F.col("v"), F.col("position")], name="rank").collect())
    want = sorted((v, p) for _, v, p in rows)
    assert [(n, v, p) for n, (v, p) in enumerate(want, 1)] == got
    by = positions(df, [F.col("v"), F.col("position")], ("g",), "rank").collect()
    assert len(by) == 3000
    for g in {x[0] for x in rows}:
        mine = sorted((x["rank"], x.v, x.position) for x in by if x.g == g)
        assert mine == [(n, v, p) for n, (v, p) in enumerate(sorted((v, p) for h, v, p in rows if h == g), 1)]
    assert positions(df.where("false"), [F.col("v")], ("g",)).count() == 0


def test_no_task_numbers_a_whole_group(spark):
    plan = positions(spark.range(100).withColumn("g", F.lit(1)), [F.col("id")], ("g",))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("sum(_n" in w for w in windows)  # only over a row for each group and partition


def _finding(seq, sev, refs, key=0):
    return ("r", seq, sev, "HIGH", "CWE-1", "c", "n", f"f{key}.js", 1, "detector" if seq % 3 else "tool", refs)


SCHEMA = "repo_id string, seq int, severity string, confidence string, cwe string, category string, name string, file string, line int, source string, references array<string>"


def test_reference_rows_are_the_array(spark):
    r = random.Random(7)
    rows = [_finding(i, r.choice(["LOW", "MEDIUM", "HIGH"]), [f"{r.choice('zamb')}{r.randint(0, 3)}" for _ in range(r.randint(0, 4))] + [""], i % 7)
            for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {x.dedup_key: x.references for x in deduplicate(df).collect()}
    got = {}
    for x in sorted(reference_rows(df).collect(), key=lambda x: x.position):
        got.setdefault(x.dedup_key, []).append(x.reference)
    assert got == {k: v for k, v in want.items() if v}


def test_a_key_of_very_many_references(spark):
    n = 100_000
    base = spark.createDataFrame([_finding(0, "LOW", ["r0"])], SCHEMA).drop("seq", "references")
    df = base.crossJoin(spark.range(n).select(F.col("id").cast("int").alias("seq"), F.array(F.concat(F.lit("u"), F.col("id"))).alias("references")))
    out = reference_rows(df)
    assert out.agg(F.count("*"), F.max("position"), F.count_distinct("position")).first()[:] == (n, n, n)
    assert [x.reference for x in out.where("position <= 3").orderBy("position").collect()] == ["u0", "u1", "u2"]
