"""Audit queries: W2-W5, W10, L5, SRC-7, SRC-12, STR-10, SCL-13, SCL-14, SCL-15, P10, A14, A15, A20,
J9, J10, J12."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import hashing as H
from assay.operators import audit, verdicts
from assay.plans.catalog import register
from assay.plans.fixtures import oracle
from assay.sources.tables import scan_decision_stream

D = ["decisions"]
# Fixture signing key (test material only).
FIXTURE_KEYS = {"key_hmac_v1": b"assay-fixture-signing-key-0123456789abcdef"}
NOW = "2026-01-01T12:00:00Z"


def _pads_hex(key: bytes) -> tuple[str, str]:
    k = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()


RANK_CTE = """
dr AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pos) AS rk,
  coalesce(lag(current_record_digest) OVER (PARTITION BY stream_id ORDER BY pos), 'GENESIS') AS expected_prev,
  row_number() OVER (PARTITION BY stream_id, decision_id ORDER BY pos) AS occ,
  count(*) OVER (PARTITION BY stream_id, decision_id) AS copies FROM decisions)
"""


def decisions(fx):
    """The decisions fixture with BIGINT positions (Spark's row_number is INT)."""
    return fx.decisions.withColumn("pos", F.col("pos").cast("bigint")).withColumn(
        "stream_sequence", F.col("stream_sequence").cast("bigint"))


def ranked(fx):
    return audit.with_rank(decisions(fx), "pos", materialize=True)


@register("chain_link_check", oracle(D, """
SELECT stream_id, pos, decision_id, previous_record_digest = expected_prev AS link_ok FROM dr""", RANK_CTE))
def q_chain_link_check(fx):
    """Each record links to its predecessor's digest (first: GENESIS)."""
    return audit.chain_link_check(ranked(fx)).select("stream_id", "pos", "decision_id", "link_ok")


@register("sequence_check", oracle(D, "SELECT stream_id, pos, stream_sequence = rk AS sequence_ok FROM dr", RANK_CTE))
def q_sequence_check(fx):
    """stream_sequence runs 1, 2, 3, ... in record order."""
    return audit.sequence_check(ranked(fx)).select("stream_id", "pos", "sequence_ok")


@register("duplicate_decisions", oracle(D, """
SELECT stream_id, pos, decision_id, occ > 1 AS duplicate, copies FROM dr""", RANK_CTE))
def q_duplicate_decisions(fx):
    """Decision ids repeated within a chain (copies after the first are duplicates)."""
    return audit.duplicate_decisions(ranked(fx)).select("stream_id", "pos", "decision_id", "duplicate", "copies")


@register("stream_head", oracle(D, """
SELECT stream_id, arg_max(stream_sequence, pos) AS head_sequence, arg_max(current_record_digest, pos) AS head_digest
FROM decisions GROUP BY stream_id"""))
def q_stream_head(fx):
    """The head (last record) of each stream."""
    return audit.stream_head(decisions(fx), "pos")


FAIL_CTE = RANK_CTE + """,
f AS (SELECT stream_id, rk, CASE WHEN occ > 1 THEN 'duplicate_decision_id' WHEN stream_sequence <> rk THEN 'sequence_break'
  WHEN previous_record_digest <> expected_prev THEN 'chain_broken' END AS reason FROM dr)"""


@register("verify_chain", oracle(D, """
SELECT stream_id, count(*) AS records, min(rk) FILTER (WHERE reason IS NOT NULL) AS first_failure_rank,
 arg_min(reason, rk) FILTER (WHERE reason IS NOT NULL) AS reason, count(*) FILTER (WHERE reason IS NOT NULL) = 0 AS valid
FROM f GROUP BY stream_id""", FAIL_CTE))
def q_verify_chain(fx):
    """STR-10 (link, sequence and duplicate parts): first failure per stream."""
    return audit.verify_chain(decisions(fx), "pos").select("stream_id", "records", "first_failure_rank", "reason", "valid")


@register("scan_decision_stream", oracle(D, """
SELECT pos, stream_sequence, decision_id, current_record_digest FROM decisions WHERE stream_id = 'stream-3'
ORDER BY pos"""))
def q_scan_decision_stream(fx):
    """SRC-12 / L5: one stream's records in order (pushed-down stream filter)."""
    return scan_decision_stream(decisions(fx), "stream-3", "pos").select(
        "pos", "stream_sequence", "decision_id", "current_record_digest")


def decision_records(fx):
    d = decisions(fx)
    return d.select(
        "stream_id", "pos",
        F.lit("READ").alias("action"), F.lit("HMAC-SHA256").alias("algorithm"),
        F.lit(H.CANONICALIZATION_VERSION).alias("canonicalization_version"),
        F.concat(F.lit("corr-"), F.col("event_id")).alias("correlation_id"), "decision_id",
        F.lit("1.0.0").alias("evaluator_version"), F.lit("1.0.0").alias("policy_version"), "previous_record_digest",
        F.concat(F.lit("res-"), F.col("event_id") % 50).alias("resource_id"), F.lit(H.SCHEMA_VERSION).alias("schema_version"),
        F.lit("key_hmac_v1").alias("signing_key_id"), "stream_sequence", F.col("stream_id").alias("tenant_id"),
        F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.concat(F.lit("u"), F.col("event_id") % 150).alias("user_id"),
        F.when(F.col("event_id") % 4 == 0, F.lit("deny")).otherwise(F.lit("allow")).alias("verdict"))


REC_SQL = f"""
SELECT stream_id, pos, sha256(to_json(struct_pack(action := 'READ', algorithm := 'HMAC-SHA256',
  canonicalization_version := '{H.CANONICALIZATION_VERSION}', correlation_id := concat('corr-', event_id), decision_id := decision_id,
  evaluator_version := '1.0.0', policy_version := '1.0.0', previous_record_digest := previous_record_digest,
  resource_id := concat('res-', event_id % 50), schema_version := '{H.SCHEMA_VERSION}', signing_key_id := 'key_hmac_v1',
  stream_sequence := stream_sequence, tenant_id := stream_id, "timestamp" := '2026-01-01T00:00:00Z',
  user_id := concat('u', event_id % 150), verdict := CASE WHEN event_id % 4 = 0 THEN 'deny' ELSE 'allow' END))) AS record_digest
FROM decisions"""


@register("record_digest", oracle(D, REC_SQL))
def q_record_digest(fx):
    """SCL-13 (+SCL-9): SHA-256 of the canonical JSON of each decision record's 16 fields."""
    r = decision_records(fx)
    return r.select("stream_id", "pos", H.record_digest(r).alias("record_digest"))


# The record that is spoilt in each stream, and how the streams are spoilt; stream-0 is left whole.
SPOILT_AT = 37
SPOILT = ("", "digest_mismatch", "signature_mismatch", "secret_in_record", "unknown_signing_key", "sequence_break",
          "duplicate_decision_id", "unsupported_algorithm", "unsupported_schema_version", "chain_broken")


def spoilt_chains(fx):
    """Signed chains of all decisions, one record of each stream spoilt in its own way."""
    keys = H.key_table(fx.spark, FIXTURE_KEYS)
    way = F.when(F.col("pos") == SPOILT_AT, F.element_at(F.array(*map(F.lit, SPOILT)), F.substring("stream_id", 8, 9).cast("int") + 1)).otherwise("")
    r = decision_records(fx).withColumn("_way", way).withColumn("decision_id", F.concat(
        F.lit("d-"), "stream_id", F.lit("-"), F.when(F.col("_way") == "duplicate_decision_id", F.col("pos") - 1).otherwise(F.col("pos"))))
    before = {"user_id": ("secret_in_record", "Bearer hush.hush"), "signing_key_id": ("unknown_signing_key", "key_retired"),
              "algorithm": ("unsupported_algorithm", "HMAC-MD5"), "schema_version": ("unsupported_schema_version", "0.9")}
    r = r.withColumns({c: F.when(F.col("_way") == w, F.lit(v)).otherwise(F.col(c)) for c, (w, v) in before.items()}).drop("_way")
    chain = audit.build_chain(r, ["pos"]).withColumn("pos", F.col("stream_sequence")).withColumn("_way", way)
    relinked = F.col("_way") == "chain_broken"
    chain = chain.withColumn("previous_record_digest", F.when(relinked, F.lit("elsewhere")).otherwise(F.col("previous_record_digest")))
    chain = chain.withColumn("current_record_digest", F.when(relinked, H.record_digest(chain)).otherwise(F.col("current_record_digest")))
    signed = H.sign_records(chain, keys)
    after = {"verdict": ("digest_mismatch", "changed"), "signature": ("signature_mismatch", "0" * 64)}
    out = signed.withColumns({c: F.when(F.col("_way") == w, F.lit(v)).otherwise(F.col(c)) for c, (w, v) in after.items()})
    return out.where(F.col("_way") != "sequence_break"), keys


@register("verify_signed_chain", oracle(D, f"""
SELECT stream_id, count(*) FILTER (WHERE NOT (spoilt AND reason = 'sequence_break')) AS records,
 CASE WHEN bool_or(spoilt AND reason <> '') THEN {SPOILT_AT} END AS first_failure_rank,
 max(CASE WHEN spoilt AND reason <> '' THEN reason END) AS reason, NOT bool_or(spoilt AND reason <> '') AS valid
FROM (SELECT stream_id, pos = {SPOILT_AT} AS spoilt, {list(SPOILT)}[CAST(substr(stream_id, 8) AS INT) + 1] AS reason FROM decisions) d
GROUP BY stream_id"""))
def q_verify_signed_chain(fx):
    """STR-10 with record checks: digests, signatures, secrets, keys and versions ranked with the link checks."""
    chain, keys = spoilt_chains(fx)
    return audit.verify_chain(chain, "pos", keys=keys).select("stream_id", "records", "first_failure_rank", "reason", "valid")


_IP, _OP = _pads_hex(FIXTURE_KEYS["key_hmac_v1"])


@register("record_hmac", oracle(D, f"""
SELECT stream_id, pos, sha256(unhex('{_OP}') || unhex(sha256(unhex('{_IP}') || encode(record_digest)))) AS signature
FROM ({REC_SQL}) r"""))
def q_record_hmac(fx):
    """SCL-14: HMAC-SHA256 signature of each record digest (key pads from a key table)."""
    r = decision_records(fx)
    r = r.withColumn("current_record_digest", H.record_digest(r))
    signed = H.sign_records(r, H.key_table(fx.spark, FIXTURE_KEYS))
    return signed.select("stream_id", "pos", "signature")


@register("authorize_access", oracle(["access_requests"], """
SELECT request_id,
 CASE WHEN identity_tenant <> owner_tenant THEN 404
  WHEN coalesce(parent_tenant, '') <> '' AND parent_tenant <> identity_tenant THEN 404
  WHEN coalesce(requested_parent, '') <> '' AND coalesce(parent_id, '') <> '' AND requested_parent <> parent_id THEN 403
  WHEN NOT is_admin AND identity_user <> owner_user AND action IN ('UPDATE', 'DELETE', 'CANCEL', 'ADMIN') THEN 403
  ELSE 200 END AS status_code,
 CASE WHEN identity_tenant <> owner_tenant THEN 'not_found'
  WHEN coalesce(parent_tenant, '') <> '' AND parent_tenant <> identity_tenant THEN 'not_found'
  WHEN coalesce(requested_parent, '') <> '' AND coalesce(parent_id, '') <> '' AND requested_parent <> parent_id THEN 'parent_mismatch'
  WHEN NOT is_admin AND identity_user <> owner_user AND action IN ('UPDATE', 'DELETE', 'CANCEL', 'ADMIN') THEN 'insufficient_permissions'
  ELSE 'allowed' END AS reason
FROM access_requests"""))
def q_authorize_access(fx):
    """P10: tenant isolation / parent integrity / ownership decisions per request."""
    return audit.authorize_access(fx.access_requests).select("request_id", "status_code", "reason")


# Reports: labels grouped by doc_id % 20; some declared totals are off by one.
REPORT_CTE = """
rc AS (SELECT doc_id % 20 AS report_id, concat('case-', doc_id % 150) AS case_id, quality = 1 AS passed FROM labels),
rp AS (SELECT report_id, '1.0' AS schema_version,
  CASE WHEN report_id = 13 THEN 'other' ELSE 'evaluation_integrity' END AS suite,
  CASE WHEN report_id % 5 = 4 THEN '2025-12-30T00:00:00Z' WHEN report_id = 7 THEN '2026-01-01T10:00:00'
       ELSE '2026-01-01T08:30:00+02:00' END AS generated_at,
  count(*) + CASE WHEN report_id % 6 = 1 THEN 1 ELSE 0 END AS total,
  count(*) FILTER (WHERE passed) AS passed,
  count(*) + CASE WHEN report_id % 6 = 1 THEN 1 ELSE 0 END - count(*) FILTER (WHERE passed) AS failed,
  count(*) FILTER (WHERE passed) / count(*) AS resistance_score
 FROM rc GROUP BY report_id)
"""


def report_inputs(fx):
    lab = fx.labels
    cases = lab.select((F.col("doc_id") % 20).alias("report_id"),
                       F.concat(F.lit("case-"), F.col("doc_id") % 150).alias("case_id"),
                       (F.col("quality") == 1).alias("passed"))
    g = F.col("report_id")
    agg = cases.groupBy("report_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("passed").alias("passed"))
    off = F.when(g % 6 == 1, F.lit(1)).otherwise(F.lit(0))
    reports = agg.select(
        "report_id", F.lit("1.0").alias("schema_version"),
        F.when(g == 13, F.lit("other")).otherwise(F.lit("evaluation_integrity")).alias("suite"),
        F.when(g % 5 == 4, F.lit("2025-12-30T00:00:00Z")).when(g == 7, F.lit("2026-01-01T10:00:00"))
        .otherwise(F.lit("2026-01-01T08:30:00+02:00")).alias("generated_at"),
        (F.col("_n") + off).alias("total"), "passed", (F.col("_n") + off - F.col("passed")).alias("failed"),
        (F.col("passed") / F.col("_n")).alias("resistance_score"))
    return reports, cases


RECON_SQL = f"""
SELECT p.report_id,
 CASE WHEN p.schema_version <> '1.0' THEN 'unsupported_version' WHEN p.suite <> 'evaluation_integrity' THEN 'unexpected_suite'
  WHEN NOT regexp_matches(p.generated_at, '(Z|[+-]\\d{{2}}:?\\d{{2}})$') THEN 'missing_timezone'
  WHEN epoch(TIMESTAMPTZ '{NOW}') - epoch(CAST(p.generated_at AS TIMESTAMPTZ)) < 0
    OR epoch(TIMESTAMPTZ '{NOW}') - epoch(CAST(p.generated_at AS TIMESTAMPTZ)) > 86400 THEN 'stale'
  WHEN p.total <= 0 OR p.passed < 0 OR p.failed < 0 OR p.passed + p.failed <> p.total THEN 'inconsistent_counts'
  WHEN c.n <> p.total THEN 'cases_total_mismatch'
  WHEN c.ap <> p.passed OR p.total - c.ap <> p.failed THEN 'case_results_mismatch'
  WHEN abs(c.ap / p.total - p.resistance_score) > 1e-6 THEN 'score_mismatch'
  WHEN c.d <> c.n THEN 'duplicate_case_ids'
  WHEN p.resistance_score < 0.5 OR p.failed <> 0 THEN 'threshold_not_met' END AS reason,
 CASE WHEN regexp_matches(p.generated_at, '(Z|[+-]\\d{{2}}:?\\d{{2}})$')
  THEN round(epoch(TIMESTAMPTZ '{NOW}') - epoch(CAST(p.generated_at AS TIMESTAMPTZ)), 3) END AS age_seconds
FROM rp p LEFT JOIN (SELECT report_id, count(*) AS n, count(*) FILTER (WHERE passed) AS ap, count(DISTINCT case_id) AS d
 FROM rc GROUP BY report_id) c ON c.report_id = p.report_id"""


@register("reconcile_report", oracle(["labels"], f"SELECT report_id, reason IS NULL AS passed_gate, reason, age_seconds FROM ({RECON_SQL}) x",
                                     REPORT_CTE))
def q_reconcile_report(fx):
    """A14 + SCL-15: integrity reports reconciled against their case rows; first failing rule."""
    reports, cases = report_inputs(fx)
    return audit.reconcile_report(reports, cases, NOW, min_score=0.5)


@register("duplicate_case_ids", oracle(["labels"], """
SELECT report_id, case_id, count(*) AS copies FROM rc GROUP BY report_id, case_id HAVING count(*) > 1""", REPORT_CTE))
def q_duplicate_case_ids(fx):
    """Case ids listed more than once in a report."""
    _, cases = report_inputs(fx)
    return audit.duplicate_case_ids(cases)


@register("release_gate", oracle(["labels"], """
SELECT candidate, bool_and(CASE WHEN required THEN passed ELSE TRUE END) AS ready, bool_and(passed) AS strict_ready,
 count(*) AS checks FROM ch GROUP BY candidate""", REPORT_CTE + f""",
ch AS (SELECT report_id AS candidate, 'evaluation_integrity' AS check_name, TRUE AS required, reason IS NULL AS passed FROM ({RECON_SQL}) x
 UNION ALL SELECT doc_id % 20, 'no_toxic', TRUE, count(*) FILTER (WHERE toxic = 1) = 0 FROM labels GROUP BY doc_id % 20
 UNION ALL SELECT doc_id % 20, 'quality_majority', TRUE, avg(quality) >= 0.5 FROM labels GROUP BY doc_id % 20
 UNION ALL SELECT doc_id % 20, 'coverage', TRUE, count(*) >= 15 FROM labels GROUP BY doc_id % 20
 UNION ALL SELECT doc_id % 20, 'low_toxicity_rate', FALSE, avg(toxic) < 0.2 FROM labels GROUP BY doc_id % 20)"""))
def q_release_gate(fx):
    """Readiness per candidate from check rows (required checks; strict = all checks)."""
    reports, cases = report_inputs(fx)
    recon = audit.reconcile_report(reports, cases, NOW, min_score=0.5)
    g = (F.col("doc_id") % 20).alias("candidate")
    lab = fx.labels
    checks = recon.select(F.col("report_id").alias("candidate"), F.lit("evaluation_integrity").alias("check_name"),
                          F.lit(True).alias("required"), F.col("passed_gate").alias("passed"))
    per = lab.groupBy(g).agg(F.count_if(F.col("toxic") == 1).alias("tx"), F.avg("quality").alias("q"),
                             F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("tr"))
    for name, req, cond in [("no_toxic", True, F.col("tx") == 0), ("quality_majority", True, F.col("q") >= 0.5),
                            ("coverage", True, F.col("n") >= 15), ("low_toxicity_rate", False, F.col("tr") < 0.2)]:
        checks = checks.unionByName(per.select("candidate", F.lit(name).alias("check_name"),
                                               F.lit(req).alias("required"), cond.alias("passed")))
    return audit.release_gate(checks)


ENV_ROWS = [("bench-0", "commit1", "3.13", "fp1", "cfg0"), ("bench-1", "commit1", "3.13", "fp1", "")]


def manifests(fx):
    n = F.count(F.lit(1))
    m = fx.executions.groupBy("run_id").agg(n.alias("n"))
    k = F.col("n")
    return m.select(
        "run_id",
        F.when(k % 4 == 0, F.lit("unknown")).otherwise(F.concat(F.lit("commit"), k % 3)).alias("git_commit"),
        F.when(k % 5 == 0, F.lit("3.12")).otherwise(F.lit("3.13")).alias("python_version"),
        F.concat(F.lit("bench-"), k % 2).alias("benchmark_id"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.md5(F.concat(F.lit("fp"), k % 3))).alias("benchmark_fingerprint"),
        F.md5(F.concat(F.lit("cfg"), k % 2)).alias("config_hash"))


def environment(spark):
    rows = [(b, g, p, f"md5:{fp}", f"md5:{c}" if c else "") for b, g, p, fp, c in ENV_ROWS]
    df = spark.createDataFrame(rows, "benchmark_id string, git_commit string, python_version string, "
                                     "benchmark_fingerprint string, config_hash string")
    unmd5 = lambda c: F.when(F.col(c).startswith("md5:"), F.md5(F.substring(F.col(c), 5, 100))).otherwise(F.col(c))
    return df.select("benchmark_id", "git_commit", "python_version", unmd5("benchmark_fingerprint").alias(
        "benchmark_fingerprint"), unmd5("config_hash").alias("config_hash"))


@register("manifest_drift", oracle(["executions"], """
SELECT m.run_id, m.benchmark_id, CAST(len(w) AS BIGINT) AS drift_count, array_to_string(w, ' | ') AS warnings, len(w) > 0 AS strict_fail
FROM (SELECT m.run_id, m.benchmark_id, list_filter([
  CASE WHEN m.git_commit <> 'unknown' AND e.git_commit IS DISTINCT FROM m.git_commit
   THEN 'Git Commit Drift: Manifest commit ' || left(m.git_commit, 8) || ' != Current ' || left(coalesce(e.git_commit, 'unknown'), 8) END,
  CASE WHEN m.python_version IS DISTINCT FROM e.python_version
   THEN 'Python Version Drift: Manifest ' || m.python_version || ' != Current ' || coalesce(e.python_version, 'None') END,
  CASE WHEN coalesce(m.benchmark_fingerprint, '') <> '' AND e.benchmark_fingerprint IS DISTINCT FROM m.benchmark_fingerprint
   THEN 'Benchmark Fingerprint Drift: Content hash mismatch for benchmark ''' || m.benchmark_id || '''' END,
  CASE WHEN coalesce(e.config_hash, '') <> '' AND e.config_hash <> m.config_hash THEN 'Configuration Drift: Run parameters hash mismatch' END
 ], lambda x: x IS NOT NULL) AS w
 FROM (SELECT run_id, CASE WHEN n % 4 = 0 THEN 'unknown' ELSE 'commit' || (n % 3) END AS git_commit,
   CASE WHEN n % 5 = 0 THEN '3.12' ELSE '3.13' END AS python_version, 'bench-' || (n % 2) AS benchmark_id,
   CASE WHEN n % 7 = 0 THEN '' ELSE md5('fp' || (n % 3)) END AS benchmark_fingerprint, md5('cfg' || (n % 2)) AS config_hash
   FROM (SELECT run_id, count(*) AS n FROM executions GROUP BY run_id) r) m
 LEFT JOIN (SELECT * FROM (VALUES ('bench-0', 'commit1', '3.13', md5('fp1'), md5('cfg0')), ('bench-1', 'commit1', '3.13', md5('fp1'), ''))
   AS t(benchmark_id, git_commit, python_version, benchmark_fingerprint, config_hash)) e ON e.benchmark_id = m.benchmark_id) m"""))
def q_manifest_drift(fx):
    """J12 + SCL-19 inputs: manifests (one per run) compared with the current environment of their benchmark."""
    return audit.manifest_drift(manifests(fx), environment(fx.spark))


@register("orphan_check", oracle(["scores", "judge_results", "responses"], """
SELECT 'labels->documents' AS relation, count(*) AS orphans FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'judge_results->documents', count(*) FROM judge_results j WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = j.subject_id)
UNION ALL SELECT 'scores->executions', count(*) FROM scores s WHERE NOT EXISTS (SELECT 1 FROM executions x WHERE x.execution_id = s.execution_id)
UNION ALL SELECT 'responses->executions', count(*) FROM responses r WHERE NOT EXISTS (SELECT 1 FROM executions x WHERE x.execution_id = r.execution_id)"""))
def q_orphan_check(fx):
    """Foreign-key violations per relation (left anti joins)."""
    return audit.orphan_check([
        ("labels->documents", fx.labels, "doc_id", fx.documents, "doc_id"),
        ("judge_results->documents", fx.judge_results, "subject_id", fx.documents, "doc_id"),
        ("scores->executions", fx.scores, "execution_id", fx.executions, "execution_id"),
        ("responses->executions", fx.responses, "execution_id", fx.executions, "execution_id"),
    ])


@register("insert_if_absent", oracle(["executions"], """
SELECT DISTINCT x.provider, x.returned_model AS model_name FROM executions x
WHERE NOT EXISTS (SELECT 1 FROM models m WHERE m.provider = x.provider AND m.model_name = x.returned_model)"""))
def q_insert_if_absent(fx):
    """Models seen in executions that the model catalogue lacks (rows an INSERT OR IGNORE adds)."""
    new = fx.executions.select("provider", F.col("returned_model").alias("model_name"))
    return audit.insert_if_absent(new, fx.models.select("provider", "model_name"), ["provider", "model_name"])


@register("latest_status", oracle([], """
SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS role, arg_max(length(text), turn) AS text_chars
FROM conversations GROUP BY conv_id"""))
def q_latest_status(fx):
    """Last write wins per key - the latest turn of each conversation."""
    c = fx.conversations.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("text_chars"))
    out = verdicts.latest_status(c, "conv_id", "turn", ["turn", "role", "text_chars"])
    return out.withColumnRenamed("turn", "last_turn")


@register("update_run_status", oracle(["executions"], """
SELECT run_id, arg_max(CASE WHEN status = 'failed' THEN 'completed_with_errors' ELSE 'running' END, (request_ts, execution_id)) AS status,
 strftime(max(request_ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM executions GROUP BY run_id"""))
def q_update_run_status(fx):
    """SRC-7 + W10: run status events resolved to the latest per run."""
    ev = fx.executions.select(
        "run_id", "request_ts", "execution_id",
        F.when(F.col("status") == "failed", F.lit("completed_with_errors")).otherwise(F.lit("running")).alias("status"),
        F.date_format("request_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))
    return verdicts.latest_status(ev, "run_id", ["request_ts", "execution_id"], ["status", "updated_at"])


@register("report_age", oracle([], f"""
SELECT event_id, s AS generated_at, regexp_matches(s, '(Z|[+-]\\d{{2}}:?\\d{{2}})$') AS has_zone,
 CASE WHEN regexp_matches(s, '(Z|[+-]\\d{{2}}:?\\d{{2}})$') THEN round(epoch(TIMESTAMPTZ '2024-02-01T00:00:00Z') - epoch(CAST(s AS TIMESTAMPTZ)), 3) END AS age_seconds
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
  WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS s FROM events) e"""))
def q_report_age(fx):
    """SCL-15: ISO-8601 times with a zone -> age in seconds; a missing zone is an error (NULL age)."""
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    s = (F.when(F.col("event_id") % 3 == 0, F.concat(base, F.lit("Z")))
         .when(F.col("event_id") % 3 == 1, F.concat(base, F.lit("+02:00"))).otherwise(base))
    e = fx.events.select("event_id", s.alias("generated_at"))
    has_zone, age = audit.report_age_seconds("generated_at", "2024-02-01T00:00:00Z")
    return e.select("event_id", "generated_at", has_zone.alias("has_zone"), F.round(age, 3).alias("age_seconds"))
