"""Hash chains, access decisions, reports, pricing, budgets, running sums and text hygiene."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.functions import hashing as H
from assay.functions import text as T
from assay.operators import audit, costs
from assay.operators.cumulative import order_slices, running_sum
from assay.sources.dims import Budget

KEY = {"key_hmac_v1": b"k" * 32}


def _records(spark, rows):
    base = dict(action="READ", algorithm="HMAC-SHA256", canonicalization_version=H.CANONICALIZATION_VERSION,
                evaluator_version="1.0.0", policy_version="1.0.0", resource_id="run_1", schema_version=H.SCHEMA_VERSION,
                signing_key_id="key_hmac_v1", tenant_id="t1", timestamp="2026-01-01T00:00:00Z", user_id="u1")
    data = [dict(base, stream_id=s, decision_id=d, correlation_id=f"c-{d}", verdict=v, ord=o) for s, d, v, o in rows]
    return spark.createDataFrame(data)


def _signed_chain(spark, rows):
    chain = audit.build_chain(_records(spark, rows), ["ord"])
    return H.sign_records(chain, H.key_table(spark, KEY))


def test_chains_longer_than_a_piece_go_on_from_their_heads(spark, monkeypatch):
    import hashlib
    import json

    monkeypatch.setattr(audit, "CHAIN_ROWS", 25)
    pieces = []
    monkeypatch.setattr(audit, "order_slices", lambda *a: (pieces.append(p.count()) or p for p in order_slices(*a)))
    rows = [(s, f"{s}-{i}", "allow", i) for s, first, last in (("a", 0, 60), ("b", 40, 90), (None, 5, 55), ("d", 0, 3)) for i in range(first, last)]
    records = _records(spark, rows).repartition(4)
    got = {r["decision_id"]: r for r in audit.build_chain(records, ["ord"]).collect()}
    assert len(got) == len(rows) and len(pieces) == 7 and sum(pieces) == len(rows) and max(pieces) < 60
    heads = {}
    for r in sorted(records.collect(), key=lambda r: r["ord"]):
        seq, prev = heads.get(r["stream_id"], (0, "GENESIS"))
        payload = {**{k: r[k] for k in H.DIGEST_FIELDS if k in r}, "stream_sequence": seq + 1, "previous_record_digest": prev}
        digest = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        heads[r["stream_id"]] = (seq + 1, digest)
        found = got[r["decision_id"]]
        assert (found["stream_sequence"], found["previous_record_digest"], found["current_record_digest"]) == (seq + 1, prev, digest)


def test_chain_build_and_verify(spark):
    signed = _signed_chain(spark, [("s1", "d1", "allow", 1), ("s1", "d2", "deny", 2), ("s2", "d3", "allow", 1)]).cache()
    rows = {(r["stream_id"], r["decision_id"]): r for r in signed.collect()}
    assert rows[("s1", "d1")]["previous_record_digest"] == "GENESIS"
    assert rows[("s1", "d2")]["previous_record_digest"] == rows[("s1", "d1")]["current_record_digest"]
    keys = H.key_table(spark, KEY)
    ok = {r["stream_id"]: r for r in audit.verify_chain(signed, keys=keys).collect()}
    assert ok["s1"]["valid"] and ok["s2"]["valid"]

    tampered = signed.withColumn("verdict", F.when(F.col("decision_id") == "d2", "allow").otherwise(F.col("verdict")))
    r = audit.verify_chain(tampered, keys=keys).where("stream_id = 's1'").first()
    assert not r["valid"] and r["reason"] == "digest_mismatch" and r["first_failure_rank"] == 2

    wrong = audit.verify_chain(signed, keys=H.key_table(spark, {"key_hmac_v1": b"w" * 32})).first()
    assert wrong["reason"] == "signature_mismatch"

    gap = signed.withColumn("stream_sequence", F.when(F.col("decision_id") == "d2", 5).otherwise(F.col("stream_sequence")))
    assert audit.verify_chain(gap).where("stream_id = 's1'").first()["reason"] == "sequence_break"

    dup = signed.unionByName(signed.where("decision_id = 'd1'").withColumn("stream_sequence", F.lit(3).cast("long")))
    assert audit.verify_chain(dup).where("stream_id = 's1'").first()["reason"] == "duplicate_decision_id"

    secret = _signed_chain(spark, [("s9", "d9", "sk-" + "a" * 24, 1)])
    assert audit.verify_chain(secret, keys=keys).first()["reason"] == "secret_in_record"

    streams = spark.createDataFrame([("s1",), ("empty",)], "stream_id string")
    e = {r["stream_id"]: r for r in audit.verify_chain(signed, keys=keys, streams=streams).collect()}
    assert e["empty"]["reason"] == "empty_chain" and e["s1"]["valid"]
    with pytest.raises(ValueError):
        H.key_table(spark, {"short": b"x" * 31})


def test_hmac_matches_python(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("key_hmac_v1", "abc123")], "signing_key_id string, current_record_digest string")
    got = H.sign_records(df, H.key_table(spark, KEY)).first()["signature"]
    assert got == hmac.new(KEY["key_hmac_v1"], b"abc123", hashlib.sha256).hexdigest()


def test_access_truth_table(spark):
    rows = [
        ("cross-tenant read", "tenant_a", "user_a", False, "tenant_b", "user_b", "READ", None, None, None, 404),
        ("cross-tenant cancel", "tenant_a", "user_a", False, "tenant_b", "user_b", "CANCEL", None, None, None, 404),
        ("same tenant read", "tenant_a", "user_1", False, "tenant_a", "user_2", "READ", None, None, None, 200),
        ("same tenant delete", "tenant_a", "user_1", False, "tenant_a", "user_2", "DELETE", None, None, None, 403),
        ("parent mismatch", "tenant_a", "user_1", False, "tenant_a", "user_1", "READ", None, "run_a", "run_b", 403),
        ("foreign parent", "tenant_a", "user_1", False, "tenant_a", "user_1", "READ", "tenant_z", None, None, 404),
        ("admin delete", "tenant_a", "admin_1", True, "tenant_a", "user_2", "DELETE", None, None, None, 200),
        ("replay other user", "tenant_a", "user_1", False, "tenant_a", "user_2", "REPLAY", None, None, None, 200),
    ]
    df = spark.createDataFrame(rows, "case string, identity_tenant string, identity_user string, is_admin boolean, "
                                     "owner_tenant string, owner_user string, action string, parent_tenant string, "
                                     "parent_id string, requested_parent string, want int")
    for r in audit.authorize_access(df).collect():
        assert r["status_code"] == r["want"], r["case"]


def test_reconcile_report_rules(spark):
    now = "2026-01-01T12:00:00Z"
    rep = [("ok", "1.0", "evaluation_integrity", "2026-01-01T11:00:00Z", 2, 2, 0, 1.0),
           ("stale", "1.0", "evaluation_integrity", "2025-12-30T00:00:00Z", 2, 2, 0, 1.0),
           ("nozone", "1.0", "evaluation_integrity", "2026-01-01T11:00:00", 2, 2, 0, 1.0),
           ("below", "1.0", "evaluation_integrity", "2026-01-01T11:00:00+00:00", 2, 1, 1, 0.5),
           ("lying", "1.0", "evaluation_integrity", "2026-01-01T11:00:00Z", 2, 2, 0, 1.0),
           ("dups", "1.0", "evaluation_integrity", "2026-01-01T11:00:00Z", 2, 2, 0, 1.0)]
    reports = spark.createDataFrame(rep, "report_id string, schema_version string, suite string, generated_at string, "
                                         "total long, passed long, failed long, resistance_score double")
    cases = [(r, f"c{i}", True) for r in ("ok", "stale", "nozone") for i in range(2)]
    cases += [("below", "c0", True), ("below", "c1", False), ("lying", "c0", True), ("lying", "c1", False),
              ("dups", "c0", True), ("dups", "c0", True)]
    cdf = spark.createDataFrame(cases, "report_id string, case_id string, passed boolean")
    out = {r["report_id"]: r["reason"] for r in audit.reconcile_report(reports, cdf, now).collect()}
    assert out == {"ok": None, "stale": "stale", "nozone": "missing_timezone", "below": "threshold_not_met",
                   "lying": "case_results_mismatch", "dups": "duplicate_case_ids"}


def test_longest_prefix_pricing(spark):
    pricing = spark.createDataFrame([("gpt-4o", 5.0, 15.0), ("gpt-4o-mini", 0.15, 0.6), ("empty", None, None)],
                                    "model_name string, input_per_million double, output_per_million double")
    ex = spark.createDataFrame([("gpt-4o-mini-2024-07-18", 1_000_000, 1_000_000), ("gpt-4o", 1000, 0),
                                ("unknown", 10, 10), ("empty-2", 5, 5)],
                               "returned_model string, input_tokens long, output_tokens long")
    out = {r["returned_model"]: r["cost_usd"] for r in costs.with_cost(ex, pricing).collect()}
    assert out == {"gpt-4o-mini-2024-07-18": 0.75, "gpt-4o": 0.005, "unknown": 0.0, "empty-2": 0.0}


def test_budget_admission_fold(spark):
    b = Budget({"global": {"maximum_total_usd": 10.0, "reserve_usd": 2.0}, "providers": {"openai": {"maximum_usd": 5.0}}})
    t = dt.datetime(2026, 1, 1)
    req = spark.createDataFrame(
        [("r", "e1", "openai", 1.0, t), ("r", "e2", "openai", 6.0, t + dt.timedelta(seconds=1)),
         ("r", "e3", "openai", 2.0, t + dt.timedelta(seconds=2)), ("r", "e4", "other", 5.5, t + dt.timedelta(seconds=3)),
         ("q", "e5", "openai", 4.0, t)],
        "run_id string, execution_id string, provider string, cost_usd double, request_ts timestamp")
    out = {r["execution_id"]: r for r in costs.budget_admission(req, b.caps, b.effective_global_cap).collect()}
    assert out["e1"]["admitted"] and not out["e2"]["admitted"] and out["e2"]["reason"] == "provider_cap"
    assert out["e3"]["admitted"] and out["e3"]["provider_spend_usd"] == 3.0
    assert not out["e4"]["admitted"] and out["e4"]["reason"] == "global_cap"  # 3 + 5.5 > 8
    assert out["e5"]["admitted"]  # runs are independent


def test_running_sum_hot_key_matches_window(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, float(i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = running_sum(df, ["k"], ["t"], "v", "rs", slices=16)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("rs2", F.sum("v").over(w))
    j = got.join(want, ["k", "t"])
    assert j.count() == 3000 and j.where(F.abs(F.col("rs") - F.col("rs2")) > 1e-9).count() == 0


def sample(prefix, n):
    """A key-like string of ``n`` characters after the prefix, built by a rule."""
    return prefix + "".join("Qw7eR5tY"[i % 8] for i in range(n))


# (text, marker, what must be gone), one row a rule
REDACT_CASES = [
    (f"export K={sample('sk-', 32)};", "[OPENAI-KEY-REDACTED]", sample("sk-", 32)),
    (f"maps {sample('AIza', 35)} end", "[GOOGLE-KEY-REDACTED]", sample("AIza", 35)),
    (f"<{sample('sk-ant-', 24)}>", "[ANTHROPIC-KEY-REDACTED]", sample("sk-ant-", 24)),
    (f"Authorization: Bearer  {sample('', 20)}", "Bearer [TOKEN-REDACTED]", sample("", 20)),
    ("write to first.last+tag@mail.example.net today", "[EMAIL-REDACTED]", "first.last"),
    ("digest " + "0F" * 32, "[HEX-TOKEN-REDACTED]", "0F" * 32),
]


def test_redaction_samples(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in REDACT_CASES], "t string")
    out = [r[0] for r in df.select(T.redact_text("t")).collect()]
    for (src, marker, gone), got in zip(REDACT_CASES, out):
        assert marker in got and gone not in got, src
    longer = spark.createDataFrame([(sample("AIza", 40),)], "t string").select(T.redact_text("t")).first()[0]
    assert longer == "[GOOGLE-KEY-REDACTED]" + sample("AIza", 40)[39:]
    mixed = spark.createDataFrame([("nothing to hide, sk-short and AIzaShort",), (f"two {sample('sk-', 20)}",)], "t string")
    flags = [(r[0], r[1]) for r in mixed.select(T.is_clean("t"), T.first_secret("t")).collect()]
    assert flags == [(True, None), (False, "openai_key")]


def test_redact_fields_and_json(spark):
    import json

    bearer, key = "Bearer " + "q7" * 12, "sk-" + "w4" * 14
    m = spark.createDataFrame([({"API_KEY": "hush-1", "colour": "green", "note": bearer},)], "m map<string,string>")
    r = m.select(T.redact_map("m").alias("m")).first()["m"]
    assert r == {"API_KEY": "[REDACTED]", "colour": "green", "note": "Bearer [TOKEN-REDACTED]"}
    deep = '{"a": ' * 60 + '{"secret": {"b": [1, {"c": 2}], "token": {"d": "]"}}, "e": "x@y.org"}' + "}" * 60
    cases = {
        '{"meta": {"token": "x"}, "headers": ["' + bearer + '", {"api-key": "' + key + '"}]}':
            {"meta": {"token": "[REDACTED]"}, "headers": ["Bearer [TOKEN-REDACTED]", {"api-key": "[REDACTED]"}]},
        '{"Password": [1, [2, {"z": "}"}]], "k": [true, null, 1.50, "a\\\\\\"b me@x.org"], "secret": null}':
            {"Password": "[REDACTED]", "k": [True, None, 1.5, 'a\\"b [EMAIL-REDACTED]'], "secret": "[REDACTED]"},
        '"mail me@x.org"': "mail [EMAIL-REDACTED]", "[]": [], "7": 7,
        '{"x": "\\u0061@b.org \\\\", "authorization": {}}': {"x": "[EMAIL-REDACTED] \\", "authorization": "[REDACTED]"},
        '["' + "\\n\\\\" * 20_000 + '"]': ["\n\\" * 20_000]}
    broken = {'{"a": "me@x.org"': '{"a": "[EMAIL-REDACTED]"', "[" * 100_000: "[" * 100_000, "": "", None: None}
    rows = [*cases, *broken, deep]
    df = spark.createDataFrame(list(enumerate(rows)), "out_ long, j string").repartition(3)
    found = {r["j"]: r["clean"] for r in T.redact_json(df, "j", "clean").collect()}
    assert len(found) == len(rows)
    assert all(json.loads(found[j]) == want for j, want in cases.items())
    assert all(found[j] == want for j, want in broken.items())
    inner = json.loads(found[deep])
    for _ in range(60):
        inner = inner["a"]
    assert inner == {"secret": "[REDACTED]", "e": "[EMAIL-REDACTED]"}


def test_secret_containers_are_taken_out_within_their_row(spark, capsys):
    import json

    texts = {'{"token": {"a": {"secret": [1]}}, "b": [{"API_KEY": []}, {"password": {}}], "secret": [[2], [3]]}':
             {"token": "[REDACTED]", "b": [{"API_KEY": "[REDACTED]"}, {"password": "[REDACTED]"}], "secret": "[REDACTED]"},
             '[{"secret": {"x": 1}, "y": [{}]}, {"secret": [1]}, [2]]': [{"secret": "[REDACTED]", "y": [{}]}, {"secret": "[REDACTED]"}, [2]]}
    clean = T.redact_json(spark.createDataFrame([(t,) for t in texts], "j string"), "j", "clean")
    clean.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert {r["j"]: json.loads(r["clean"]) for r in clean.collect()} == texts


def test_text_normalisers(spark):
    df = spark.createDataFrame([("été\x00\x07ok\tline\n",), ("x" * 70,)], "t string")
    a, b = [r[0] for r in df.select(T.normalise_text("t", max_chars=64)).collect()]
    assert a == "étéok\tline\n"
    assert b == "x" * 64 + "\n\n[RESPONSE TRUNCATED]"
    s = df.select(T.sanitize_output("t", max_chars=64)).collect()[1][0]
    assert s.endswith("\n\n[TRUNCATED]")
    blocks = spark.createDataFrame([('text ```json\n{"a": 1}\n``` more {"b": 2}',), ('x {"a": {"b": 1}} y',), ("none",)],
                                   "t string")
    assert [r[0] for r in blocks.select(T.extract_json_block("t")).collect()] == ['{"a": 1}', '{"a": {"b": 1}}', None]


def test_attribute_hygiene(spark):
    from assay.operators.requests import normalise_providers, safe_attributes, scrub_secret_keys

    df = spark.createDataFrame([({"provider": "openai", "Authorization": "x", "prompt_len": "3", "model": None,
                                  "long": "y" * 300},)], "m map<string,string>")
    r = df.select(safe_attributes(F.col("m")).alias("s")).first()["s"]
    assert set(r) == {"provider", "long"} and len(r["long"]) == 300
    env = spark.createDataFrame([({"PATH": "/bin", "OPENAI_API_KEY": "k", "aws_region": "x", "HOME": "/h"},)],
                                "m map<string,string>")
    assert set(env.select(scrub_secret_keys(F.col("m"))).first()[0]) == {"PATH", "HOME"}
    p = spark.createDataFrame([(" OpenAI, gemini ,,google,xai,openai",)], "c string")
    assert p.select(normalise_providers(F.col("c"))).first()[0] == ["openai", "google", "xai"]


def test_bad_json_rows_give_null_and_the_job_goes_on(spark):
    from assay.functions import hashing as H

    rows = [('{"b": 1, "a": "\u00e9"}',), ('{"a": ',), ("[" * 100_000,), ("[1, 2]",), (None,)]
    df = spark.createDataFrame(rows, "j string")
    found = df.select(H.canonical_json_text("j"), H.config_hash("j"), H.scenario_fingerprint("j")).collect()
    assert found[0][0] == '{"a":"\\u00e9","b":1}' and found[3][0] == "[1,2]"
    assert all(found[i][k] is None for i in (1, 2, 4) for k in range(3)) and all(found[i][k] for i in (0, 3) for k in (1, 2))
