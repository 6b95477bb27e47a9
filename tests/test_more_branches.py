"""More branch tests: error classes, finish reasons, drift warnings, insert-if-absent, orphans, auto bootstrap."""

from pyspark.sql import functions as F

from assay.operators import audit, stats
from assay.operators import requests as R


def test_classify_errors_per_provider(spark):
    rows = [("openai", 401, "http"), ("openai", 429, "http"), ("openai", 529, "http"), ("anthropic", 529, "http"),
            ("google", 408, "http"), ("openai", 408, "http"), ("xai", 503, "http"), ("openai", None, "connection"),
            ("openai", None, "value_error"), ("unknown", 500, "http")]
    df = spark.createDataFrame(rows, "provider string, status_code int, error_kind string")
    got = [(r["error_class"], r["retryable"]) for r in R.classify_errors(df).collect()]
    assert got == [("AuthenticationError", False), ("RateLimitError", True), ("NonRetryableProviderError", False),
                   ("RetryableProviderError", True), ("RetryableProviderError", True),
                   ("NonRetryableProviderError", False), ("RetryableProviderError", True),
                   ("RetryableProviderError", True), ("UnknownError", False), ("NonRetryableProviderError", False)]


def test_finish_reason_mapping(spark):
    df = spark.createDataFrame([("end_turn",), ("max_tokens",), ("stop_sequence",), ("tool_use",), ("refusal",), (None,)],
                               "r string")
    assert [r[0] for r in df.select(R.map_finish_reason(F.col("r"))).collect()] == [
        "stop", "length", "stop", "tool_calls", "refusal", None]


def test_manifest_drift_warnings(spark):
    m = spark.createDataFrame([
        ("r1", "b", "unknown", "3.13", "", "h"), ("r2", "b", "abcdef123456", "3.12", "fpX", "h2")],
        "run_id string, benchmark_id string, git_commit string, python_version string, "
        "benchmark_fingerprint string, config_hash string")
    env = spark.createDataFrame([("b", "zzzzzzzz99", "3.13", "fp1", "h")],
                                "benchmark_id string, git_commit string, python_version string, "
                                "benchmark_fingerprint string, config_hash string")
    out = {r["run_id"]: r for r in audit.manifest_drift(m, env).collect()}
    assert out["r1"]["drift_count"] == 0 and not out["r1"]["strict_fail"]
    w = out["r2"]["warnings"].split(" | ")
    assert w == ["Git Commit Drift: Manifest commit abcdef12 != Current zzzzzzzz",
                 "Python Version Drift: Manifest 3.12 != Current 3.13",
                 "Benchmark Fingerprint Drift: Content hash mismatch for benchmark 'b'",
                 "Configuration Drift: Run parameters hash mismatch"]


def test_insert_if_absent_and_orphans(spark):
    old = spark.createDataFrame([("p", "m1")], "provider string, model_name string")
    new = spark.createDataFrame([("p", "m1"), ("p", "m2"), ("p", "m2"), ("q", "m1")], "provider string, model_name string")
    assert sorted(tuple(r) for r in audit.insert_if_absent(new, old, ["provider", "model_name"]).collect()) == [
        ("p", "m2"), ("q", "m1")]
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1,), (3,), (None,), (3,)], "pid long")
    r = audit.orphan_check([("child->parent", child, "pid", parent, "id")]).first()
    assert r["relation"] == "child->parent" and r["orphans"] == 2


def test_bootstrap_has_one_method_unless_asked(spark):
    df = spark.createDataFrame([("g", i, float(i % 4)) for i in range(40)], "g string, id long, v double")
    assert stats.bootstrap_ci(df, "g", "v", "id", iterations=50).first()["mode"] == "hash"
    assert stats.bootstrap_ci(df, "g", "v", "id", iterations=50, mode="poisson").first()["mode"] == "poisson"


def test_report_files_end_to_end(spark, scratch):
    import json
    import os

    from assay.sources import files as FS

    def write(name, doc):
        os.makedirs(f"{scratch}/reports", exist_ok=True)
        with open(f"{scratch}/reports/{name}", "w", encoding="utf-8") as fh:
            fh.write(json.dumps(doc))

    base = {"schema_version": "1.0", "generated_at": "2026-01-01T11:00:00Z", "suite": "evaluation_integrity",
            "total": 2, "passed": 2, "failed": 0, "resistance_score": 1.0,
            "cases": [{"case_id": "a", "passed": True}, {"case_id": "b", "passed": True}]}
    write("good.json", base)
    write("tampered.json", dict(base, cases=[{"case_id": "a", "passed": True}, {"case_id": "b", "passed": False}]))
    write("dups.json", dict(base, cases=[{"case_id": "a", "passed": True}, {"case_id": "a", "passed": True}]))
    reports = FS.scan_integrity_reports(spark, f"{scratch}/reports").where("status = 'ok'").withColumnRenamed(
        "file_path", "report_id")
    cases = FS.report_cases(reports.withColumnRenamed("report_id", "file_path"))
    out = {os.path.basename(r["report_id"]): r["reason"]
           for r in audit.reconcile_report(reports, cases, "2026-01-01T12:00:00Z").collect()}
    assert out == {"good.json": None, "tampered.json": "case_results_mismatch", "dups.json": "duplicate_case_ids"}
    dup = [(os.path.basename(r["report_id"]), r["case_id"], r["copies"]) for r in audit.duplicate_case_ids(cases).collect()]
    assert dup == [("dups.json", "a", 2)]
