from auditspark.operators.corroborate import origin_breakdown


def test_origin_breakdown(spark):
    rows = [("r", ["detector", "opengrep"], None, "CONFIRMED"),
            ("r", None, "gitleaks", "TOOL-ONLY"),
            ("r", [], None, None),                      # empty finding counts for the detector
            ("r", ["subagent:auth", "subagent:auth"], None, "HIGH"),
            ("r", None, None, "confirmed")]
    df = spark.createDataFrame(rows, "repo_id string, sources array<string>, source string, confidence string")
    got = {r.source: (r["count"], r.label) for r in origin_breakdown(df).collect()}
    assert got == {"detector": (3, "Built-in detector (heuristic)"), "opengrep": (1, "OpenGrep"),
                   "gitleaks": (1, "Gitleaks"), "subagent:auth": (1, "Subagent: auth")}
    tot = origin_breakdown(df).select("total", "confirmed").distinct().collect()
    assert [(t.total, t.confirmed) for t in tot] == [(5, 2)]
