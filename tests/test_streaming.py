import os
import tempfile

from pyspark.sql import functions as F

from auditspark.streaming.scan_stream import read_files_stream, stream_findings


def test_stream_scan_matches_batch_ids(spark):
    d = tempfile.mkdtemp(prefix="auditspark-stream-")
    src = os.path.join(d, "in")
    rows = [("r1", "src/a.js", 'x = 1\nconst password = "hunter2hunter2";\n'),
            ("r1", "test/b.py", "obj = pickle.loads(data)\n"),
            ("r2", "infra/main.tf", 'cidr_blocks = ["0.0.0.0/0"]\n')]
    spark.createDataFrame(rows, "repo_id string, path string, content string").write.parquet(src)
    baseline = spark.createDataFrame([("r2", "infra/main.tf|CWE-284|network open to the world (0.0.0.0/0)")],
                                     "repo_id string, fingerprint string")
    s = stream_findings(spark, read_files_stream(spark, src), baseline=baseline)
    assert s.isStreaming
    q = s.writeStream.format("memory").queryName("stream_findings_t").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM stream_findings_t").collect()
    got = {(r.repo_id, r.rule_id, r.severity) for r in out}
    assert ("r1", "GENERIC_PASSWORD", "CRITICAL") in got
    assert ("r1", "PY_DESERIALIZE", "LOW") in got          # non-source path downgrade
    assert not any(r.repo_id == "r2" for r in out)          # baselined by the stream-static anti join
    assert all("hunter2hunter2" not in r.vulnerable_code for r in out)


def test_report_stream_equals_batch(spark, tmp_path):
    from auditspark.operators import suppress as SP
    from auditspark.plans import q_normalize as QN
    from auditspark.streaming import scan_stream as ST
    reports = QN.mixed_reports(spark, "/root/testdata/sf0.001").where("run_id < 400")
    reports = reports.unionByName(spark.createDataFrame([("r", 1, "gitleaks", "not json {"), ("r", 2, "nobody", "[]"), ("r", 3, None, None)], ST.REPORT_SCHEMA))
    reports.repartition(4).write.parquet(str(tmp_path / "in"))
    static = spark.read.parquet(str(tmp_path / "in"))
    baseline = SP.with_fingerprint(ST.tool_findings(static)).where("ordinal = 1").select("repo_id", "fingerprint").distinct()
    baseline.write.parquet(str(tmp_path / "baseline"))
    baseline = spark.read.parquet(str(tmp_path / "baseline"))
    q = ST.start_reports(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), baseline, trigger_once=True)
    q.awaitTermination(120)
    cols = ["repo_id", "run_id", "id", "severity", "name", "file", "line", "cwe", "references", "source", "ordinal", "suppressed", "known"]
    got = spark.read.schema(ST.tool_findings(static, baseline).schema).parquet(str(tmp_path / "out")).select(cols).collect()
    want = ST.tool_findings(static, baseline).select(cols).collect()
    assert len(want) > 300 and {r.known for r in want} == {True, False} and {r.suppressed for r in want} == {True, False}
    assert sorted(map(str, got)) == sorted(map(str, want))
