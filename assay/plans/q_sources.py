"""Sources, sinks, plug-in contracts and record hashes over data that Spark derives from the driver tables:
SRC-2, SRC-3, SRC-4, SRC-6, SRC-8, SRC-9, SRC-10, SRC-11, SRC-14, SCL-9, SCL-12, SCL-19, SCL-20, UDF-1..4."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from assay.functions import hashing as H
from assay.functions import text as T
from assay.operators import contracts, evaluators
from assay.plans.catalog import register
from assay.plans.fixtures import oracle
from assay.plans.q_files import _scratch
from assay.sources import dims, files, scenarios, sinks

# One scenario per document: id, two steps whose contents are digests of the whole text, every
# seventh without a category, every eleventh of another version.
SCENARIO_PARTS = """SELECT doc_id, md5(text) AS d, sha256(text) AS s FROM documents"""


def _scenario_json(fx):
    k = F.col("doc_id")
    checks = F.array(F.struct(F.lit("contains").alias("type"), F.sha2("text", 256).alias("value")))
    asked = F.struct(F.lit("user").alias("role"), F.md5("text").alias("content"), checks.alias("assertions"))
    answered = F.struct(F.lit("assistant").alias("role"), F.sha2("text", 256).alias("content"),
                        F.lit(None).cast("array<struct<type:string,value:string>>").alias("assertions"))
    cells = F.struct(
        F.concat(F.lit("doc-"), k).alias("id"), F.when(k % 11 == 0, "2.0").otherwise("1.0").alias("version"), F.lit("t").alias("title"),
        F.when(k % 7 != 0, F.lit("c")).alias("category"), F.array(asked, answered).alias("steps"),
        F.lit("stale").alias("fingerprint"))
    return fx.documents.select(k, F.to_json(cells).alias("document"))


CANONICAL = """'{"category":"c","id":"doc-' || doc_id || '","steps":[{"assertions":[{"type":"contains","value":"' || s ||
 '"}],"content":"' || d || '","role":"user"},{"content":"' || s || '","role":"assistant"}],"title":"t","version":"1.0"}'"""


@register("scan_scenarios", oracle([], f"""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing_category' WHEN doc_id % 11 = 0 THEN 'unknown_version' END AS error,
 CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN 'doc-' || doc_id END AS id,
 CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN CAST(2 AS BIGINT) END AS n_steps,
 CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN 'output:"' || s || '"' END AS first_check,
 CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN sha256({CANONICAL}) END AS fingerprint FROM ({SCENARIO_PARTS}) p"""))
def q_scan_scenarios(fx):
    """SRC-2 + SCL-12: scenario rules, defaults and fingerprints over one scenario document per text."""
    s = scenarios.checked_scenarios(_scenario_json(fx))
    first = F.col("steps")[0]["assertions"][0]
    return s.select("doc_id", "error", "id", F.when(F.col("error").isNull(), F.size("steps").cast("bigint")).alias("n_steps"),
                    F.concat(first["target"], F.lit(":"), first["value"]).alias("first_check"), "fingerprint")


@register("adapt_legacy_jsonl", oracle([], """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'legacy_case' ELSE 'L' || doc_id END AS id,
 CASE WHEN doc_id % 2 = 0 THEN 'name ' || doc_id WHEN doc_id % 3 = 0 THEN 'Legacy Benchmark' ELSE 'L' || doc_id END AS title,
 coalesce(lang, 'general') AS category, md5(text) AS prompt_md5, CASE WHEN doc_id % 5 = 0 THEN '"' || md5(text) || '"' END AS expected,
 '{"source":"' || source || '"}' AS metadata FROM documents"""))
def q_adapt_legacy_jsonl(fx):
    """SRC-3: one legacy record per document, read back from JSON lines written by Spark."""
    k = F.col("doc_id")
    cells = F.struct(k.alias("_doc"), F.when(k % 3 != 0, F.concat(F.lit("L"), k)).alias("id"),
                     F.when(k % 2 == 0, F.concat(F.lit("name "), k)).alias("name"), F.col("lang").alias("category"),
                     F.col("text").alias("prompt"), F.when(k % 5 == 0, F.md5("text")).alias("expected"), "source")
    root = _scratch(fx.spark, "legacy")
    fx.documents.select(F.to_json(cells).alias("value")).write.text(root)
    rows = scenarios.adapt_legacy_jsonl(fx.spark, root).withColumn("_m", F.from_json("metadata", "_doc long, source string"))
    step = F.col("steps")[0]
    return rows.select(F.col("_m._doc").alias("doc_id"), "id", "title", "category", F.md5(step["content"]).alias("prompt_md5"),
                       F.try_element_at(step["assertions"], F.lit(1))["value"].alias("expected"),
                       F.to_json(F.struct(F.col("_m.source").alias("source"))).alias("metadata"))


# The same of every document, unsound ones as they are: without a category, or of another version.
ANY_CANONICAL = CANONICAL.replace('{"category":"c",', """{' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '"category":"c",' END || '""").replace(
    '"version":"1.0"', """"version":"' || CASE WHEN doc_id % 11 = 0 THEN '2.0' ELSE '1.0' END || '\"""")


@register("scenario_fingerprint", oracle([], f"""
SELECT doc_id, sha256({ANY_CANONICAL}) AS fingerprint FROM ({SCENARIO_PARTS}) p"""))
def q_scenario_fingerprint(fx):
    """SCL-12 on JSON whose fields come in another order and carry an old fingerprint."""
    return _scenario_json(fx).select("doc_id", H.scenario_fingerprint(F.col("document")).alias("fingerprint"))


@register("canonical_json", oracle([], """
SELECT doc_id, '{"a":{"m":null,"z":[' || doc_id || ',true]},"b":"' || md5(text) || '"}' AS canonical FROM documents"""))
def q_canonical_json(fx):
    """SCL-9 on free-form JSON: spaced, unsorted text in, sorted compact text out."""
    return fx.documents.select("doc_id", H.canonical_json_text(_loose_json()).alias("canonical"))


def _loose_json():
    return F.concat(F.lit('{ "b" : "'), F.md5("text"), F.lit('", "a": {"z":[ '), F.col("doc_id").cast("string"), F.lit(', true ], "m":null} }'))


@register("config_hash", oracle([], """
SELECT doc_id, sha256('{"a": {"m": null, "z": [' || doc_id || ', true]}, "b": "' || md5(text) || '"}') AS config_hash FROM documents"""))
def q_config_hash(fx):
    """SCL-19: SHA-256 of sorted JSON with spaces after its separators."""
    return fx.documents.select("doc_id", H.config_hash(_loose_json()).alias("config_hash"))


@register("structured_text", oracle([], """
SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN '' ELSE text END) AS text_md5 FROM documents"""))
def q_structured_text(fx):
    """SCL-20: message content as null, string, list of parts and list of strings, from whole texts."""
    k = F.col("doc_id") % 4
    half = (F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.expr("substr(text, cast(length(text) / 2 as int) + 1)")
    content = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.to_json(F.to_variant_object(F.array("text"))))
               .when(k == 2, F.to_json(F.array(F.struct(F.lit("text").alias("type"), head.alias("text")),
                                               F.struct(F.lit("text").alias("type"), tail.alias("text")))))
               .otherwise(F.to_json(F.array(head, tail))))
    return fx.documents.select("doc_id", F.md5(files.structured_text(content)).alias("text_md5"))


@register("append_results", oracle(["executions"], """
SELECT run_id, execution_id, status, latency_ms, input_tokens FROM executions"""))
def q_append_results(fx):
    """SRC-6: two bulk appends to one result table partitioned by run, read back."""
    root = os.path.join(_scratch(fx.spark, "results"), "executions")
    rows = fx.executions.select("run_id", "execution_id", "status", "latency_ms", "input_tokens")
    sinks.append_results(rows.where("latency_ms % 2 = 0"), root)
    sinks.append_results(rows.where("latency_ms % 2 <> 0"), root)
    return fx.spark.read.parquet(root).select(*rows.columns)


@register("export_run_document", oracle(["executions"], """
SELECT run_id, execution_id, provider, configured_model AS model, status, latency_ms,
 CASE WHEN status = 'completed' THEN input_tokens END AS input_tokens,
 CASE WHEN status <> 'completed' THEN error_type END AS error_type FROM executions"""))
def q_export_run_document(fx):
    """SRC-8: run documents written as JSON lines per run; the executions part read back."""
    root = _scratch(fx.spark, "documents")
    done = fx.executions
    per_run = done.groupBy("run_id").agg(F.count("*").alias("n"))
    sinks.export_run_document(done, done.select("run_id", "execution_id", "latency_ms"), per_run, per_run, root)
    kinds = ("execution_id string, provider string, model string, status string, latency_ms bigint, input_tokens bigint, "
             "error_type string, run_id string")
    back = fx.spark.read.schema(kinds).json(f"{root}/executions")
    return back.select("run_id", "execution_id", "provider", "model", "status", "latency_ms", "input_tokens", "error_type")


PARAMETERS = {"temperature": 0.2, "seed": 7, "providers": ["openai", "xai"]}


@register("build_manifest", oracle(["executions"], f"""
SELECT run_id, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers,
 array_to_string(list_sort(list(DISTINCT configured_model)), ',') AS models,
 sha256('{json.dumps(PARAMETERS, sort_keys=True)}') AS config_hash FROM executions GROUP BY run_id"""))
def q_build_manifest(fx):
    """SRC-9 + SCL-19: one reproducibility row per run."""
    m = sinks.build_manifest(fx.executions, PARAMETERS, "b", "1")
    return m.select("run_id", F.array_join("providers", ",").alias("providers"), F.array_join("models", ",").alias("models"), "config_hash")


@register("scan_integrity_reports", oracle([], """
SELECT source, CASE WHEN source = 'src3' THEN 'malformed' WHEN source IN ('src5', 'src11') THEN 'schema_mismatch' ELSE 'ok' END AS status,
 CASE WHEN source <> 'src3' THEN count(*) END AS total, CASE WHEN source <> 'src3' THEN sum(n_chars) END AS passed
FROM documents GROUP BY source"""))
def q_scan_integrity_reports(fx):
    """SRC-10: a report file per source (one cut short with a bad byte, two with an extra field), read fail-closed."""
    root = _scratch(fx.spark, "reports")
    sums = fx.documents.groupBy("source").agg(F.count("*").alias("total"), F.sum("n_chars").alias("passed"))
    cells = [F.lit("1.0").alias("schema_version"), F.lit("2026-01-01T00:00:00Z").alias("generated_at"), F.lit("s").alias("suite"), "total",
             "passed", F.lit(0).alias("failed"), F.lit(1.0).alias("resistance_score"),
             F.array(F.struct(F.col("source").alias("case_id"), F.lit(True).alias("passed"))).alias("cases"),
             F.when(F.col("source").isin("src5", "src11"), F.lit("x")).alias("extra")]
    text = F.to_json(F.struct(*cells))
    body = F.when(F.col("source") == "src3", F.concat(F.expr("left(to_json(struct(total)), 5)").cast("binary"), F.unhex(F.lit("FF"))))
    rows = sums.select(F.col("source").alias("s"), F.coalesce(body, text.cast("binary")).cast("string").alias("value"))
    rows.write.partitionBy("s").text(root)
    found = files.scan_integrity_reports(fx.spark, os.path.join(root, "*"))
    return found.select(F.regexp_extract("file_path", "/s=([^/]+)/", 1).alias("source"), "status", "total", "passed")


# Number of the first rule that a text matches.
FIRST_RULE = "CASE " + " ".join(
    "WHEN regexp_matches(text, '" + p.replace("'", "''") + f"') THEN {i + 1}" for i, (_, p, _) in enumerate(T.REDACTION_RULES)) + " END"
ARTIFACT_DOCS = 500


@register("scan_artifacts", oracle([], f"""
SELECT source, 'g=' || CAST(floor(doc_id / {ARTIFACT_DOCS}) AS BIGINT) AS folder, {[n for n, _, _ in T.REDACTION_RULES]}[min(rule)] AS pattern
FROM (SELECT *, {FIRST_RULE} AS rule FROM documents) d WHERE rule IS NOT NULL GROUP BY ALL"""))
def q_scan_artifacts(fx):
    """SRC-11: artifact files with a secret and the first rule each matches; a file per source and some 500 whole documents."""
    root = _scratch(fx.spark, "artifacts")
    rows = fx.documents.select(F.col("source").alias("s"), F.floor(F.col("doc_id") / ARTIFACT_DOCS).alias("g"), F.col("text").alias("value"))
    rows.repartition("s", "g").write.partitionBy("s", "g").text(root)
    found = files.scan_artifacts(fx.spark, root)
    return found.select(F.regexp_extract("path", "/s=([^/]+)/", 1).alias("source"), F.regexp_extract("path", "/(g=[^/]+)/", 1).alias("folder"), "pattern")


@register("load_dims", oracle(["executions"], """
SELECT x.provider, d.cap_usd, CAST(30.0 AS DOUBLE) AS effective_global_cap_usd, d.rpm_limit, count(*) AS requests FROM executions x
JOIN (VALUES ('openai', CAST(8.0 AS DOUBLE), 60), ('anthropic', 8.0, 50), ('google', 8.0, 60), ('xai', 8.0, 30)) d(provider, cap_usd, rpm_limit)
 ON d.provider = x.provider GROUP BY x.provider, d.cap_usd, d.rpm_limit"""))
def q_load_dims(fx):
    """SRC-4: the budget and request-limit dimensions beside the requests of each provider."""
    caps = dims.budgets(fx.spark).join(dims.rpm_limits(fx.spark), "provider")
    asked = fx.executions.groupBy("provider").agg(F.count("*").alias("requests"))
    return asked.join(caps, "provider").select("provider", "cap_usd", "effective_global_cap_usd", F.col("rpm_limit").cast("int"), "requests")


@register("execution_event_source", oracle(["executions"], """
SELECT provider, status, count(*) AS requests, sum(latency_ms) AS latency_ms, sum(input_tokens) AS input_tokens
FROM executions GROUP BY provider, status"""))
def q_execution_event_source(fx):
    """SRC-14: the event folder read for backfill; the same folder feeds the streams."""
    root = os.path.join(_scratch(fx.spark, "events"), "e")
    fx.executions.selectExpr("execution_id", "run_id", "cast(request_ts as timestamp) request_ts", "provider", "configured_model",
                             "returned_model", "category", "status", "error_type", "cast(latency_ms as bigint) latency_ms",
                             "cast(input_tokens as bigint) input_tokens", "cast(output_tokens as bigint) output_tokens").write.parquet(root)
    events = files.execution_event_source(fx.spark, root, streaming=False)
    return events.groupBy("provider", "status").agg(F.count("*").alias("requests"), F.sum("latency_ms").alias("latency_ms"),
                                                    F.sum("input_tokens").alias("input_tokens"))


@register("judge_api", oracle([], """
SELECT doc_id AS subject_id, coalesce(ok AND score >= 0.8, FALSE) AS passed, CASE WHEN ok THEN score ELSE CAST(0.0 AS DOUBLE) END AS score,
 md5(CASE WHEN ok THEN text WHEN fenced THEN 'markdown_fence' ELSE 'reason_too_long' END) AS reason_md5
FROM (SELECT doc_id, text, contains(text, '```') AS fenced, length(text) <= 2000 AND NOT contains(text, '```') AS ok,
  CAST((doc_id % 11) / 10.0 AS DOUBLE) AS score FROM documents) t"""))
def q_judge_api(fx):
    """UDF-3 + SCL-10: judge texts whose reason is a whole document; invalid ones fail closed."""
    score = ((F.col("doc_id") % 11) / F.lit(10.0)).cast("double")
    raw = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), score.alias("score"), F.col("text").alias("reason")))
    judged = contracts.judge_from_raw(fx.documents.select(F.col("doc_id").alias("subject_id"), raw.alias("raw")), "j")
    return judged.select("subject_id", "passed", "score", F.md5("reason").alias("reason_md5"))


@register("user_evaluator_contract", oracle([], """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'output is not JSON' WHEN 1 THEN 'missing required ''passed'' or ''score'' fields'
 WHEN 2 THEN '''score'' must be a valid float' END AS error, CASE WHEN doc_id % 5 > 2 THEN length(text) > 1000 END AS passed,
 CASE WHEN doc_id % 5 > 2 THEN CAST(length(text) AS DOUBLE) END AS score,
 CASE doc_id % 5 WHEN 3 THEN '{"raw":"' || md5(text) || '"}' WHEN 4 THEN '{"d":"' || md5(text) || '"}' END AS details FROM documents"""))
def q_user_evaluator_contract(fx):
    """UDF-4: outputs of a user evaluator over whole documents, sound ones and three kinds of broken ones."""
    k, n = F.col("doc_id") % 5, F.length("text")
    passed, score = (n > 1000).alias("passed"), n.cast("double").alias("score")
    out = (F.when(k == 0, F.concat(F.lit("score: "), n)).when(k == 1, F.to_json(F.struct(passed)))
           .when(k == 2, F.to_json(F.struct(passed, F.lit("high").alias("score"))))
           .when(k == 3, F.to_json(F.struct(passed, score, F.md5("text").alias("details"))))
           .otherwise(F.to_json(F.struct(passed, score, F.struct(F.md5("text").alias("d")).alias("details")))))
    checked = contracts.user_evaluator_contract(fx.documents.select("doc_id", out.alias("output")))
    return checked.select("doc_id", "error", "passed", "score", "details")


def length_evaluator(df):
    """A user's evaluator: one score per response, by its length in words."""
    n = F.size(F.split("text", " "))
    return df.select("execution_id", F.lit("answer_length").alias("evaluator_name"), F.lit("1.0.0").alias("evaluator_version"),
                     F.lit(1).cast("bigint").alias("score_pos"), F.lit("words").alias("metric_name"), n.cast("double").alias("numeric_score"),
                     F.lit(20.0).alias("pass_threshold"), (n >= 20).alias("passed"), F.lit(1.0).alias("confidence"),
                     F.concat(n.cast("string"), F.lit(" words")).alias("explanation"))


ANSWER_LENGTH = """
SELECT execution_id, 'answer_length' AS evaluator_name, n AS words, n >= 20 AS passed, n || ' words' AS explanation
FROM (SELECT execution_id, CAST(len(string_split(text, ' ')) AS DOUBLE) AS s, len(string_split(text, ' ')) AS n FROM responses) r"""


def _length_scores(fx, evaluate):
    return evaluators.check_scores(evaluate(fx.responses)).select(
        "execution_id", "evaluator_name", F.col("numeric_score").cast("bigint").alias("words"), "passed", "explanation")


@register("evaluator_api", oracle(["responses"], ANSWER_LENGTH))
def q_evaluator_api(fx):
    """UDF-1: a user evaluator over all responses, its output held to the score contract."""
    return _length_scores(fx, length_evaluator)


@register("evaluator_registry", oracle(["responses"], ANSWER_LENGTH))
def q_evaluator_registry(fx):
    """UDF-2: the same evaluator looked up by its category; the registry is left as it was."""
    evaluators.register_evaluator("answer_length", length_evaluator)
    try:
        found = evaluators.get_evaluator("answer_length")
    finally:
        evaluators.EVALUATORS.pop("answer_length")
    return _length_scores(fx, found)
