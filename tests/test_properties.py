"""Property checks from the survey's test plan, on seeded random data."""
import random

from pyspark.sql import functions as F

from auditspark.operators import reports as R
from auditspark.operators import suppress as SP
from auditspark.operators.corroborate import deduplicate

SEVS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def _findings(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = [(f"r{rnd.randint(0, 4)}", i, rnd.choice([None, "opengrep", "gitleaks"]), f"src/f{rnd.randint(0, 20)}.js",
             rnd.randint(1, 5), rnd.choice(SEVS), rnd.choice(["HIGH", "LOW", "TOOL-ONLY"]),
             rnd.choice(["CWE-89", "N/A"]), "Injection", f"n{rnd.randint(0, 3)}") for i in range(n)]
    return spark.createDataFrame(rows, "repo_id string, seq long, source string, file string, line int, "
                                       "severity string, confidence string, cwe string, category string, name string")


def test_dedup_is_idempotent_on_its_keys(spark):
    d1 = deduplicate(_findings(spark), with_references=False)
    d2 = deduplicate(d1.withColumn("seq", F.col("primary_seq")).drop("dedup_key"), with_references=False)
    assert d1.count() == d2.count()
    assert sorted(r.dedup_key for r in d1.collect()) == sorted(r.dedup_key for r in d2.collect())


def test_baseline_round_trip_leaves_nothing_new(spark):
    f = deduplicate(_findings(spark), with_references=False)
    base = SP.baseline_entries(f).select("repo_id", "fingerprint")
    new, known = SP.apply_baseline(f, base)
    assert new.count() == 0 and known.count() == f.count()


def test_ignore_then_negate_keeps_all(spark):
    f = _findings(spark)
    kept, sup = SP.apply_ignore(f, ["src/", "!src/"], defaults=False)
    assert sup.count() == 0 and kept.count() == f.count()


def test_score_bounds_and_caps(spark):
    f = _findings(spark, 300, 11)
    for r in R.score(f).collect():
        assert 0 <= r.score <= 100
    caps = {"CRITICAL": 49, "HIGH": 74, "MEDIUM": 89, "LOW": 97, "INFO": 100}
    for sev, cap in caps.items():
        one = f.where(F.col("severity") == sev)
        for r in R.score(one).collect():
            assert r.score <= cap
