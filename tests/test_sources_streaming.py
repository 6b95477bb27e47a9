"""File sources, sinks, raw payload normalisation, plug-in contracts and streaming equivalence."""

import datetime as dt
import hashlib
import json
import os

from pyspark.sql import functions as F

from assay.operators import contracts
from assay.sources import cases as C
from assay.sources import files as FS
from assay.sources import scenarios as S
from assay.sources import sinks
from assay.streaming import stateful, windows


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


CASE = {"id": "gc-001", "version": 2, "category": "guardrail_consistency", "subcategory": "refusal",
        "messages": [{"role": "user", "content": "hi"}], "expected": {"must_contain": ["no"]}, "tags": ["refusal"]}


def test_case_files_and_validation(spark, scratch):
    root = os.path.join(scratch, "cases")
    _write(f"{root}/guardrail_consistency/b.jsonl", "# comment\n\n" + json.dumps(CASE) + "\n")
    minimal = {k: v for k, v in CASE.items() if k not in ("version", "tags")}
    minimal["id"] = "gc-000"
    schema_case = dict(CASE, id="ci-1", category="content_integrity", expected={"json_schema": {"type": "object"}})
    _write(f"{root}/guardrail_consistency/a.jsonl", json.dumps(minimal) + "\n" + json.dumps(schema_case) + "\n")
    _write(f"{root}/broken/x.jsonl", '{"id": "x", "messages": "nope"}\n{not json\n')
    got = {r["id"]: r for r in C.scan_cases_jsonl(spark, root, "guardrail_consistency/*.jsonl").collect()}
    assert got["gc-000"]["version"] == 1 and got["gc-000"]["tags"] == [] and got["gc-000"]["risk_level"] == "low"
    assert got["gc-001"]["version"] == 2 and got["gc-001"]["line_no"] == 3 and got["gc-001"]["must_contain"] == ["no"]
    assert got["ci-1"]["has_json_schema"] and not got["gc-001"]["has_json_schema"]
    errs = sorted((r["line_no"], r["error"]) for r in C.validate_cases(spark, root, "broken/*.jsonl").collect())
    assert (2, "JSON parse error") in errs and (1, "'messages' must be a list") in errs
    assert (1, "missing field 'category' in case 'x'") in errs and len([e for e in errs if e[0] == 1]) == 5


def test_scenarios_and_legacy(spark, scratch):
    d = os.path.join(scratch, "scen")
    base = {"id": "greet-7", "version": "1.0", "title": "Greeting", "category": "tone", "metadata": {"lang": "sv"},
            "steps": [{"role": "user", "content": "hej", "assertions": [{"type": "regex", "value": ["a", 1]}, {"type": "len", "target": "log"}]},
                      {"role": "assistant", "content": 5}]}
    without = lambda *names: {k: v for k, v in base.items() if k not in names}
    files = {
        "ok.json": json.dumps(base), "marked.json": json.dumps(dict(base, fingerprint="old")),
        "plain.yaml": "id: 3\nversion: 1.0.0\ntitle: Y\ncategory: c\nsteps:\n- {role: user, content: hi}\n",
        "broken.yml": "id: [", "broken.json": "{", "list.json": "[1]", "version.json": json.dumps(dict(base, version="3")),
        "untitled.json": json.dumps(without("title")), "stepless.json": json.dumps(without("steps")),
        "mute.json": json.dumps(dict(base, steps=[{"role": "user"}])), "steps.json": json.dumps(dict(base, steps="none")),
        "check.json": json.dumps(dict(base, steps=[dict(base["steps"][0], assertions=[{"value": 1}])])), "notes.txt": "x"}
    for name, text in files.items():
        _write(f"{d}/{name}", text)
    out = {os.path.basename(r["file_path"]): r for r in S.scan_scenarios(spark, d).collect()}
    errors = {n: r["error"] for n, r in out.items()}
    assert errors == {
        "ok.json": None, "marked.json": None, "plain.yaml": None, "broken.yml": "undecodable", "broken.json": "undecodable",
        "list.json": "not_an_object", "version.json": "unknown_version", "untitled.json": "missing_title",
        "stepless.json": "missing_steps", "mute.json": "bad_step", "steps.json": "bad_step", "check.json": "bad_assertion",
        "notes.txt": "unknown_suffix"}
    canonical = json.dumps(base, sort_keys=True, separators=(",", ":"))
    assert out["ok.json"]["fingerprint"] == out["marked.json"]["fingerprint"] == hashlib.sha256(canonical.encode()).hexdigest()
    first, second = out["ok.json"]["steps"]
    assert [tuple(a) for a in first["assertions"]] == [("regex", "output", '["a",1]'), ("len", "log", None)]
    assert second["content"] == "5" and second["assertions"] == [] and json.loads(out["ok.json"]["metadata"]) == {"lang": "sv"}
    assert out["plain.yaml"]["id"] == "3" and out["plain.yaml"]["metadata"] == "{}"
    records = [{"id": "q9", "prompt": "2+2?", "expected": 4, "level": "easy"}, {"name": "N", "category": "c"}, {}]
    _write(f"{scratch}/legacy.jsonl", "\n".join([*map(json.dumps, records), "", "nonsense"]) + "\n")
    rows = S.adapt_legacy_jsonl(spark, f"{scratch}/legacy.jsonl").collect()
    assert [(r["id"], r["title"], r["category"], r["error"]) for r in rows] == [
        ("q9", "q9", "general", None), ("legacy_case", "N", "c", None), ("legacy_case", "Legacy Benchmark", "general", None),
        (None, None, None, "undecodable")]
    assert [tuple(a) for a in rows[0]["steps"][0]["assertions"]] == [("contains", "output", "4")]
    assert json.loads(rows[0]["metadata"]) == {"level": "easy"} and rows[1]["steps"][0]["content"] == ""


def test_reports_and_artifacts(spark, scratch):
    rep = {"schema_version": "1.0", "generated_at": "2026-01-01T00:00:00Z", "suite": "evaluation_integrity",
           "total": 1, "passed": 1, "failed": 0, "resistance_score": 1.0, "cases": [{"case_id": "a", "passed": True}]}
    _write(f"{scratch}/rep/ok.json", json.dumps(rep))
    _write(f"{scratch}/rep/bad.json", "{oops")
    _write(f"{scratch}/rep/extra.json", json.dumps(dict(rep, extra=1)))
    out = {os.path.basename(r["file_path"]): r["status"] for r in FS.scan_integrity_reports(spark, f"{scratch}/rep").collect()}
    assert out == {"ok.json": "ok", "bad.json": "malformed", "extra.json": "schema_mismatch"}
    _write(f"{scratch}/art/a.log", "key sk-" + "w4" * 16)
    _write(f"{scratch}/art/sub/b.md", "clean text")
    _write(f"{scratch}/art/c.bin", "sk-" + "w4" * 16)
    hits = [(os.path.basename(r["path"]), r["pattern"]) for r in FS.scan_artifacts(spark, f"{scratch}/art").collect()]
    assert hits == [("a.log", "openai_key")]


def test_raw_payload_normalisation(spark):
    rows = [
        ("o1", "openai", json.dumps({"id": "o1", "model": "gpt-4o", "choices": [{"message": {"content": None, "tool_calls": [
            {"id": "t", "type": "function", "function": {"name": "send_email", "arguments": "{}"}}]},
            "finish_reason": "tool_calls"}]}), 10),
        ("a1", "anthropic", json.dumps({"id": "a1", "model": "claude", "content": [
            {"type": "text", "text": "one"}, {"type": "tool_use", "id": "tu", "name": "get_weather", "input": {"c": 1}},
            {"type": "text", "text": "two"}], "stop_reason": "end_turn", "usage": {"input_tokens": 3, "output_tokens": 4}}), 20),
        ("g1", "google", json.dumps({"model": "gemini", "choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]},
                                                                     "finish_reason": "stop"}]}), 30),
        ("g2", "google", json.dumps({"model": "gemini", "choices": []}), 40),
    ]
    raw = spark.createDataFrame(rows, "payload_id string, provider string, payload string, latency_ms long")
    out = {r["payload_id"]: r for r in FS.normalise_raw_responses(raw).collect()}
    assert out["o1"]["text"] == "" and out["o1"]["tool_calls"][0]["name"] == "send_email" and out["o1"]["input_tokens"] == 0
    assert out["a1"]["text"] == "one\ntwo" and out["a1"]["finish_reason"] == "stop" and out["a1"]["total_tokens"] == 7
    assert out["a1"]["tool_calls"][0]["name"] == "get_weather"
    assert out["g1"]["text"] == "ab" and out["g2"]["error"] == "no choices"


def test_sinks_roundtrip(spark, scratch):
    t = dt.datetime(2026, 1, 1)
    ev = spark.createDataFrame([("r1", t, "running", 0.0, None), ("r1", t + dt.timedelta(seconds=5), "completed", 1.5, None)],
                               "run_id string, ts timestamp, status string, actual_cost_usd double, failure_reason string")
    sinks.append_status(ev, f"{scratch}/status")
    cur = sinks.current_run_status(spark.read.parquet(f"{scratch}/status")).first()
    assert cur["status"] == "completed" and cur["actual_cost_usd"] == 1.5
    ex = spark.createDataFrame([("r1", "e1", "openai", "gpt-4o", "completed", 10, 1, 2, None, "x" * 600)],
                               "run_id string, execution_id string, provider string, configured_model string, status string, "
                               "latency_ms long, input_tokens long, output_tokens long, error_type string, text string")
    sinks.append_results(ex, f"{scratch}/executions")
    assert spark.read.parquet(f"{scratch}/executions").count() == 1
    sc = spark.createDataFrame([("r1", "e1", "m", 1.0)], "run_id string, execution_id string, metric_name string, v double")
    vd = spark.createDataFrame([("r1", "e1", "pass")], "run_id string, execution_id string, status string")
    mt = spark.createDataFrame([("r1", 1)], "run_id string, success_count long")
    sinks.export_run_document(ex, sc, vd, mt, f"{scratch}/doc")
    assert len(spark.read.json(f"{scratch}/doc/executions").first()["text"]) == 500
    man = sinks.build_manifest(ex, {"b": 1, "a": [1, 2]}, "bench", "1.0").first()
    import hashlib

    assert man["config_hash"] == hashlib.sha256(json.dumps({"a": [1, 2], "b": 1}, sort_keys=True).encode()).hexdigest()
    assert man["providers"] == ["openai"]


def test_contracts(spark):
    raw = spark.createDataFrame([("s1", '{"schema_version":"1.0","score":0.9,"reason":"ok"}'), ("s2", "bad")],
                                "subject_id string, raw string")
    j = {r["subject_id"]: r for r in contracts.judge_from_raw(raw, "strict").collect()}
    assert j["s1"]["passed"] and not j["s2"]["passed"] and j["s2"]["score"] == 0.0
    out = spark.createDataFrame([('{"passed": true, "score": "0.5", "details": [1]}',), ('{"passed": true}',), ("x",)],
                                "output string")
    r = contracts.user_evaluator_contract(out).collect()
    assert r[0]["valid"] and r[0]["score"] == 0.5 and json.loads(r[0]["details"]) == {"raw": [1]}
    assert not r[1]["valid"] and "passed" in r[1]["error"] and not r[2]["valid"]


def _exec_rows(n=400):
    t0 = dt.datetime(2026, 1, 1)
    return [(f"e{i:04d}", f"run-{i % 3}", t0 + dt.timedelta(seconds=37 * i), ["openai", "anthropic"][i % 2],
             "m", "completed" if i % 5 else "failed", 100 + (i * 37) % 3000, 0.001 * (i % 7)) for i in range(n)]


SCHEMA = ("execution_id string, run_id string, request_ts timestamp, provider string, model string, status string, "
          "latency_ms long, cost_usd double")


def test_window_metrics_stream_equals_batch(spark):
    src = spark.createDataFrame(_exec_rows(), SCHEMA)
    # a request a year on lets the watermark pass the end of every other window
    last = src.limit(1).withColumn("provider", F.lit("later")).withColumn("request_ts", F.expr("request_ts + INTERVAL 1 YEAR"))
    in_order = src.unionByName(last).orderBy("request_ts").coalesce(1)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "150")  # several files, so several micro-batches
    try:
        for build in (lambda d: windows.request_rate(d, keys=["provider"]),
                      lambda d: windows.error_rate(d),
                      lambda d: windows.p95_latency(d),
                      lambda d: windows.cost_window(d)):
            batch = sorted(tuple(r) for r in build(src).collect())
            streamed = stateful.run_available(spark, in_order, build, "win", files_per_trigger=1).where("provider <> 'later'")
            assert batch and batch == sorted(tuple(r) for r in streamed.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_sliding_windows_copy_panes_not_rows(spark):
    plan = windows.cost_window(spark.createDataFrame(_exec_rows(), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")  # printed from the top: the pane aggregate is below the copies


def test_budget_stream_equals_batch_fold(spark):
    from assay.operators import costs

    src = spark.createDataFrame(_exec_rows(), SCHEMA).select("run_id", "execution_id", "provider", "cost_usd", "request_ts")
    caps, eff = {"openai": 0.2, "anthropic": 0.15}, 0.3
    batch = sorted(tuple(r) for r in costs.budget_admission(src, caps, eff).collect())
    streamed = stateful.run_available(spark, src.orderBy("request_ts").coalesce(1),
                                      lambda s: stateful.budget_admission_stream(s, caps, eff), "budget")
    assert sorted(tuple(r) for r in streamed.collect()) == batch
    assert any(not r[4] for r in batch) and any(r[4] for r in batch)


def test_append_decisions_branches(spark):
    rows = [("s", "d1", 1, "GENESIS", "h1", 1), ("s", "d2", 2, "h1", "h2", 2), ("s", "d3", 4, "h2", "h3", 3),
            ("s", "d4", 3, "bad", "h4", 4), ("s", "d5", 3, "h2", "h5", 5), ("t", "d9", 2, "GENESIS", "x", 1),
            ("t", "d9", 1, "GENESIS", "y", 2)]
    src = spark.createDataFrame(rows, "stream_id string, decision_id string, stream_sequence long, "
                                      "previous_record_digest string, current_record_digest string, pos long")
    out = {r["decision_id"]: r for r in stateful.run_available(
        spark, src, lambda s: stateful.append_decisions(s, arrival="pos"), "dec", files_per_trigger=100).collect()}
    assert out["d1"]["accepted"] and out["d2"]["accepted"]
    assert out["d3"]["reason"] == "sequence_gap" and out["d4"]["reason"] == "broken_link"
    assert out["d5"]["accepted"]  # d3 / d4 were rejected, so the head is still d2
    assert len([d for d in out if d == "d9"]) == 1 and len(out) == 6  # duplicate id kept once


def test_gauge_stream_equals_batch(spark):
    src = spark.createDataFrame(_exec_rows(300), SCHEMA).select("provider", "execution_id", "request_ts", "latency_ms")
    batch = sorted(tuple(r) for r in windows.active_executions(src).collect())
    ev = windows.gauge_events(src).orderBy("_t", "delta", "execution_id").coalesce(1)
    streamed = stateful.run_available(spark, ev, stateful.active_executions_stream, "gauge", files_per_trigger=1)
    assert sorted(tuple(r) for r in streamed.collect()) == batch


def _batches(spark, name):
    """Rows of each micro-batch of the last stream of that name, from its source files in order of age."""
    import glob

    import pyarrow.parquet as pq

    base = max(glob.glob(os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "..", f"stream-{name}-*")),
               key=os.path.getmtime)
    commits = [f for f in os.listdir(os.path.join(base, "checkpoint", "commits")) if f.isdigit()]
    files = sorted(glob.glob(os.path.join(base, "source", "*.parquet")), key=os.path.getmtime)
    return len(commits), [pq.read_metadata(f).num_rows for f in files]


def test_gauge_in_bounded_batches_equals_batch(spark, monkeypatch):
    monkeypatch.setattr(stateful, "BATCH_ROWS", 100)
    src = spark.createDataFrame(_exec_rows(300), SCHEMA).select("provider", "execution_id", "request_ts", "latency_ms")
    want = sorted(tuple(r) for r in windows.active_executions(src).collect())
    ev = windows.gauge_events(src).repartition(5)
    streamed = stateful.run_available(spark, ev, stateful.active_executions_stream, "gauges",
                                      arrival=["_t", "delta", "execution_id"])
    assert sorted(tuple(r) for r in streamed.collect()) == want
    commits, sizes = _batches(spark, "gauges")
    assert commits == 6 and sum(sizes) == 600 and max(sizes) <= 200


def test_appended_decisions_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(stateful, "BATCH_ROWS", 40)
    rows = [(f"s{k}", f"s{k}-{i}", i, "GENESIS" if i == 1 else "bad" if i == 90 else f"h{k}-{i - 1}", f"h{k}-{i}", i)
            for i in range(1, 101) for k in range(3)]
    src = spark.createDataFrame(rows[::-1] + rows[150:160], "stream_id string, decision_id string, stream_sequence long, "
                                "previous_record_digest string, current_record_digest string, pos long").repartition(4)
    out = {r["decision_id"]: r for r in stateful.run_available(
        spark, src, lambda s: stateful.append_decisions(s, arrival="pos"), "bounded", arrival=["pos", "decision_id"]).collect()}
    assert len(out) == 300 and all(r["accepted"] == (r["stream_sequence"] < 90) for r in out.values())
    assert {r["reason"] for r in out.values() if not r["accepted"]} == {"broken_link", "sequence_gap"}
    commits, sizes = _batches(spark, "bounded")
    assert commits == 8 and sum(sizes) == 310 and max(sizes) <= 80


def test_line_numbers_of_files_read_in_blocks(spark, tmp_path):
    from assay.sources.cases import numbered_lines

    want = {}
    for name, n in (("a.txt", 900), ("b.txt", 1), ("c.txt", 333)):
        lines = [f"{name} {i} " + "\u00e9x" * (i % 40) if i % 5 != 1 else "" for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if n > 1 else ""), encoding="utf-8")
        want |= {(name, i + 1): line for i, line in enumerate(lines)}
    settings = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = numbered_lines(spark, f"{tmp_path}/*.txt")
        assert rows.rdd.getNumPartitions() > 10
        found = [(r["file_path"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in rows.collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(found) == len(want) and {(f, n): v for f, n, v in found} == want
