"""Request-side and set queries: J4, P2, P3, P4, P4b, P6, P6b, P8, P9, P11, W1, SET-1, SET-2, SET-3."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from assay.operators import requests as R
from assay.plans.catalog import register
from assay.plans.fixtures import oracle
from assay.plans.q_files import _scratch
from assay.sources.config import load_models

CATEGORIES = ["tool_use_boundaries", "prompt_robustness", "context_isolation", "long_context_behavior",
              "content_integrity", "guardrail_consistency"]


def cases(fx):
    return fx.test_cases.select(F.col("id").alias("case_id"), "category", F.split("tags_csv", ",").alias("tags"))


@register("build_plan", oracle(["test_cases", "models"], """
SELECT c.id AS case_id, m.provider, m.model_name, sha256(concat_ws(chr(1), m.provider, m.model_name, c.id)) AS execution_id
FROM test_cases c JOIN models m ON NOT (list_contains(string_split(c.tags_csv, ','), 'tool-use') AND NOT m.supports_tools)"""))
def q_build_plan(fx):
    """J4 + P4: (case, provider, model) triples, tool-use cases only on tool-capable models."""
    return R.build_plan(cases(fx), fx.models).select("case_id", "provider", "model_name", "execution_id")


@register("capability_filter", oracle(["executions"], """
SELECT x.execution_id, x.provider, x.configured_model FROM executions x JOIN models m
 ON m.provider = x.provider AND m.model_name = x.configured_model
WHERE NOT (x.category = 'tool_use_boundaries' AND NOT m.supports_json_schema)"""))
def q_capability_filter(fx):
    """P4 on executions: drop tool-boundary work for models lacking the capability flag (here: JSON schema)."""
    m = fx.models.select("provider", F.col("model_name").alias("configured_model"),
                         F.col("supports_json_schema").alias("supports_tools"))
    x = fx.executions.select("execution_id", "provider", "configured_model",
                             F.when(F.col("category") == "tool_use_boundaries", F.array(F.lit("tool-use")))
                             .otherwise(F.array().cast("array<string>")).alias("tags"))
    return R.capability_filter(x.join(m, ["provider", "configured_model"])).select(
        "execution_id", "provider", "configured_model")


@register("supports_capability", oracle(["executions"], """
SELECT x.provider, count(*) AS executions FROM executions x JOIN models m ON m.provider = x.provider AND m.model_name = x.configured_model
WHERE m.supports_json_schema GROUP BY x.provider"""))
def q_supports_capability(fx):
    """Executions on models whose capability set contains 'json', per provider."""
    m = fx.models.select("provider", F.col("model_name").alias("configured_model"),
                         R.model_capabilities(fx.models).alias("capabilities"))
    capable = R.supports_capability(m, "json")
    return fx.executions.join(capable, ["provider", "configured_model"]).groupBy("provider").agg(
        F.count(F.lit(1)).alias("executions"))


MODEL_FILE = {"openai": {"gpt-4o": {"supports_json_schema": True, "context_limit": 128000}, "gpt-4o-mini": None},
              "anthropic": {"claude-sonnet-4-6": {"supports_tools": True, "supports_json_schema": True}}}


@register("capabilities_by_file", oracle(["executions"], """
SELECT x.provider, x.configured_model, m.context_limit, m.max_output_tokens, m.capabilities, count(*) AS executions FROM executions x
JOIN (VALUES ('gpt-4o', 128000, 800, 'text,json'), ('gpt-4o-mini', 4096, 800, 'text'), ('claude-sonnet-4-6', 4096, 800, 'text,tools,json')) m(name, context_limit, max_output_tokens, capabilities)
 ON m.name = x.configured_model GROUP BY ALL"""))
def q_capabilities_by_file(fx):
    """SRC-4 + P4b: executions per model of a capability registry loaded from a file, with its defaults."""
    path = _scratch(fx.spark, "models")
    fx.spark.createDataFrame([(json.dumps(MODEL_FILE),)], "value string").coalesce(1).write.text(path)
    known = load_models(fx.spark, path)
    m = known.select("provider", F.col("model_name").alias("configured_model"), F.col("context_limit").cast("int").alias("context_limit"),
                     F.col("max_output_tokens").cast("int").alias("max_output_tokens"), F.array_join(R.model_capabilities(known), ",").alias("capabilities"))
    return fx.executions.join(m, ["provider", "configured_model"]).groupBy(
        "provider", "configured_model", "context_limit", "max_output_tokens", "capabilities").agg(F.count(F.lit(1)).alias("executions"))


@register("build_requests", oracle(["test_cases", "models"], """
SELECT sha256(concat_ws(chr(1), m.provider, m.model_name, c.id)) AS execution_id, m.provider, m.model_name,
 CAST(0.0 AS DOUBLE) AS temperature, CAST(m.max_output_tokens AS BIGINT) AS max_output_tokens
FROM test_cases c JOIN models m ON NOT (list_contains(string_split(c.tags_csv, ','), 'tool-use') AND NOT m.supports_tools)"""))
def q_build_requests(fx):
    """Request rows with temperature / output cap from the model row (defaults 0.0 / 800)."""
    plan = R.build_plan(cases(fx), fx.models).drop("max_output_tokens", "supports_tools")
    return R.build_requests(plan, fx.models).select("execution_id", "provider", "model_name", "temperature",
                                                     "max_output_tokens")


@register("validate_requests", oracle([], """
SELECT id, array_to_string(list_filter([
  CASE WHEN trim(id) = '' THEN 'id must not be empty' END,
  CASE WHEN trim(category) = '' THEN 'category must not be empty' END,
  CASE WHEN n_messages <= 0 THEN 'messages must not be empty' END,
  CASE WHEN trim(model) = '' THEN 'model must not be empty' END,
  CASE WHEN NOT (temperature BETWEEN 0.0 AND 2.0) THEN 'temperature must be within [0, 2]' END], lambda e: e IS NOT NULL), '; ') AS errors
FROM (SELECT concat('case-', item_id) AS id, CASE WHEN item_id % 7 = 0 THEN '' ELSE 'general' END AS category,
  CASE WHEN item_id % 9 = 0 THEN 0 ELSE 1 END AS n_messages, CASE WHEN item_id % 11 = 0 THEN ' ' ELSE 'gpt-4o' END AS model,
  CAST(item_id % 5 AS DOUBLE) * 0.6 AS temperature FROM benchmark) r"""))
def q_validate_requests(fx):
    """Request validation errors (empty id / category / messages / model, temperature outside [0, 2])."""
    b = fx.benchmark
    msgs = F.when(F.col("item_id") % 9 == 0, F.array().cast("array<struct<role:string,content:string>>")).otherwise(
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    r = b.select(F.concat(F.lit("case-"), F.col("item_id")).alias("id"),
                 F.when(F.col("item_id") % 7 == 0, F.lit("")).otherwise(F.lit("general")).alias("category"),
                 msgs.alias("messages"),
                 F.when(F.col("item_id") % 11 == 0, F.lit(" ")).otherwise(F.lit("gpt-4o")).alias("model"),
                 ((F.col("item_id") % 5).cast("double") * 0.6).alias("temperature"))
    return R.validate_requests(r).select("id", F.array_join("errors", "; ").alias("errors"))


@register("cases_per_category_limit", oracle(["test_cases"], """
SELECT id, category FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY CAST(substr(id, 6) AS BIGINT)) AS rn
 FROM test_cases) t WHERE rn <= 5"""))
def q_cases_per_category_limit(fx):
    """The first 5 cases of each category in load order (the per-model case cap)."""
    c = fx.test_cases.select("id", "category", F.substring("id", 6, 20).cast("bigint").alias("line_no"))
    return R.cases_per_category_limit(c, 5, order=["line_no"]).select("id", "category")


ERR_SQL_BASE = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'google' ELSE 'xai' END AS provider,
 CASE event_id % 10 WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 529 WHEN 4 THEN 408 WHEN 5 THEN 404
  WHEN 6 THEN NULL WHEN 7 THEN 503 WHEN 8 THEN NULL ELSE 400 END AS status_code,
 CASE WHEN event_id % 10 = 6 THEN 'connection' WHEN event_id % 10 = 8 THEN 'value_error' ELSE 'http' END AS error_kind
FROM events WHERE event_type = 'error'"""


def error_events(fx):
    e = fx.events.where(F.col("event_type") == "error")
    k = F.col("event_id") % 10
    code = (F.when(k == 0, 401).when(k == 1, 429).when(k == 2, 500).when(k == 3, 529).when(k == 4, 408)
            .when(k == 5, 404).when(k == 7, 503).when(k == 9, 400))
    prov = F.element_at(F.array(*[F.lit(p) for p in ("openai", "anthropic", "google", "xai")]),
                        (F.col("event_id") % 4 + 1).cast("int"))
    kind = F.when(k == 6, F.lit("connection")).when(k == 8, F.lit("value_error")).otherwise(F.lit("http"))
    return e.select("event_id", prov.alias("provider"), code.cast("int").alias("status_code"), kind.alias("error_kind"))


@register("classify_errors", oracle([], f"""
SELECT event_id, provider, status_code,
 CASE WHEN status_code = 401 THEN 'AuthenticationError' WHEN status_code = 429 THEN 'RateLimitError'
  WHEN status_code IS NULL AND error_kind = 'connection' THEN 'RetryableProviderError' WHEN status_code IS NULL THEN 'UnknownError'
  WHEN list_contains(CASE provider WHEN 'anthropic' THEN [500, 502, 503, 504, 529] WHEN 'google' THEN [408, 429, 500, 502, 503, 504]
   ELSE [500, 502, 503, 504] END, status_code) THEN 'RetryableProviderError' ELSE 'NonRetryableProviderError' END AS error_class,
 CASE WHEN status_code = 401 THEN FALSE WHEN status_code = 429 THEN TRUE WHEN status_code IS NULL THEN error_kind = 'connection'
  ELSE list_contains(CASE provider WHEN 'anthropic' THEN [500, 502, 503, 504, 529] WHEN 'google' THEN [408, 429, 500, 502, 503, 504]
   ELSE [500, 502, 503, 504] END, status_code) END AS retryable
FROM ({ERR_SQL_BASE}) e"""))
def q_classify_errors(fx):
    """Provider error classification and retryability per failed request."""
    return R.classify_errors(error_events(fx)).select("event_id", "provider", "status_code", "error_class", "retryable")


@register("map_finish_reason", oracle([], """
SELECT event_id, raw, CASE WHEN raw IS NULL THEN NULL WHEN raw IN ('end_turn', 'stop_sequence') THEN 'stop'
 WHEN raw = 'max_tokens' THEN 'length' WHEN raw = 'tool_use' THEN 'tool_calls' ELSE raw END AS finish_reason
FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'stop_sequence'
  WHEN 3 THEN 'tool_use' WHEN 4 THEN 'refusal' END AS raw FROM events) e"""))
def q_map_finish_reason(fx):
    """Provider stop reasons mapped to normalised finish reasons."""
    k = F.col("event_id") % 6
    raw = (F.when(k == 0, "end_turn").when(k == 1, "max_tokens").when(k == 2, "stop_sequence")
           .when(k == 3, "tool_use").when(k == 4, "refusal"))
    e = fx.events.select("event_id", raw.alias("raw"))
    return e.select("event_id", "raw", R.map_finish_reason(F.col("raw")).alias("finish_reason"))


PROVIDER_CSV_SQL = """CASE user_id % 5 WHEN 0 THEN 'openai, Gemini' WHEN 1 THEN 'anthropic,mistral' WHEN 2 THEN ' xai ,openai,OpenAI'
 WHEN 3 THEN 'gemini,,cohere' ELSE '' END"""


def provider_requests(fx):
    k = F.col("user_id") % 5
    csv = (F.when(k == 0, "openai, Gemini").when(k == 1, "anthropic,mistral").when(k == 2, " xai ,openai,OpenAI")
           .when(k == 3, "gemini,,cohere").otherwise(""))
    return fx.events.select(F.concat(F.lit("run-"), F.col("user_id") % 20).alias("run_id"), csv.alias("csv")).distinct()


@register("normalise_providers", oracle([], f"""
SELECT DISTINCT concat('run-', user_id % 20) AS run_id, coalesce(array_to_string(list_distinct_ordered, ','), '') AS providers
FROM (SELECT user_id, (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (
   SELECT CASE WHEN lower(trim(s)) = 'gemini' THEN 'google' ELSE lower(trim(s)) END AS x, i
   FROM (SELECT unnest(string_split({PROVIDER_CSV_SQL}, ',')) AS s, generate_subscripts(string_split({PROVIDER_CSV_SQL}, ','), 1) AS i)
   WHERE trim(s) <> '') GROUP BY x)) AS list_distinct_ordered FROM events) t"""))
def q_normalise_providers(fx):
    """Requested provider list per run - trimmed, lower-cased, aliased, de-duplicated in order."""
    p = provider_requests(fx)
    return p.select("run_id", F.array_join(R.normalise_providers(F.col("csv")), ",").alias("providers")).distinct()


@register("missing_providers", oracle(["models"], f"""
SELECT DISTINCT concat('run-', user_id % 20) AS run_id, p AS provider FROM events,
 unnest(string_split({PROVIDER_CSV_SQL}, ',')) AS t(s), LATERAL (SELECT CASE WHEN lower(trim(s)) = 'gemini' THEN 'google' ELSE lower(trim(s)) END AS p) q
WHERE p <> '' AND p NOT IN (SELECT provider FROM models)"""))
def q_missing_providers(fx):
    """SET-2: requested providers that are not available (left anti join)."""
    req = provider_requests(fx).select("run_id", F.explode(R.normalise_providers(F.col("csv"))).alias("provider"))
    avail = fx.models.select("provider").distinct()
    return req.join(avail, "provider", "left_anti").select("run_id", "provider").distinct()


@register("usable_providers", oracle(["models"], f"""
SELECT DISTINCT concat('run-', user_id % 20) AS run_id, p AS provider FROM events,
 unnest(string_split({PROVIDER_CSV_SQL}, ',')) AS t(s), LATERAL (SELECT CASE WHEN lower(trim(s)) = 'gemini' THEN 'google' ELSE lower(trim(s)) END AS p) q
WHERE p IN (SELECT provider FROM models)"""))
def q_usable_providers(fx):
    """SET-3: requested providers that are available (left semi join)."""
    req = provider_requests(fx).select("run_id", F.explode(R.normalise_providers(F.col("csv"))).alias("provider"))
    avail = fx.models.select("provider").distinct()
    return req.join(avail, "provider", "left_semi").select("run_id", "provider").distinct()


@register("union_cases", oracle(["test_cases"], "SELECT id, category FROM test_cases"))
def q_union_cases(fx):
    """SET-1: per-category case sets concatenated (unionByName of the category loads)."""
    parts = [fx.test_cases.where(F.col("category") == c).select("id", "category") for c in CATEGORIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ATTR_KEYS = ["provider", "Authorization", "prompt_tokens", "user_secret_hint", "latency_ms", "model", "raw_response_id"]


@register("safe_attributes", oracle([], """
SELECT event_id, array_to_string(list_sort(list_filter(['provider', 'Authorization', 'prompt_tokens', 'user_secret_hint', 'latency_ms', 'model', 'raw_response_id'],
 lambda k: NOT (contains(lower(k), 'api_key') OR contains(lower(k), 'authorization') OR contains(lower(k), 'access_token')
  OR contains(lower(k), 'refresh_token') OR contains(lower(k), 'secret') OR contains(lower(k), 'password') OR contains(lower(k), 'prompt')
  OR contains(lower(k), 'response') OR contains(lower(k), 'raw_response') OR contains(lower(k), 'thought_signature'))
  AND (k <> 'model' OR event_id % 3 <> 0))), ',') AS kept_keys,
 props || repeat('x', 300) AS provider_value FROM events"""))
def q_safe_attributes(fx):
    """Telemetry attributes without forbidden keys (substring, case-insensitive), nulls dropped, long strings whole."""
    vals = {"provider": F.concat(F.col("props"), F.lit("x" * 300)), "Authorization": F.lit("Bearer abc"),
            "prompt_tokens": F.col("event_id").cast("string"), "user_secret_hint": F.lit("h"),
            "latency_ms": F.col("value").cast("string"),
            "model": F.when(F.col("event_id") % 3 != 0, F.lit("gpt-4o")), "raw_response_id": F.lit("r")}
    m = F.create_map(*[x for k in ATTR_KEYS for x in (F.lit(k), vals[k])])
    s = R.safe_attributes(m)
    return fx.events.select("event_id", F.array_join(F.array_sort(F.map_keys(s)), ",").alias("kept_keys"),
                            s["provider"].alias("provider_value"))


ENV_KEYS = ["PATH", "HOME", "OPENAI_API_KEY", "aws_region", "LANG", "db_password", "MONKEY", "USER"]


@register("scrub_secret_keys", oracle([], """
SELECT event_id, array_to_string(list_sort(list_filter(['PATH', 'HOME', 'OPENAI_API_KEY', 'aws_region', 'LANG', 'db_password', 'MONKEY', 'USER'],
 lambda k: NOT regexp_matches(k, '(?i)(API_KEY|SECRET|TOKEN|KEY|PASSWORD|AUTH|CREDENTIAL|PRIVATE|DATABASE_URL|AWS_)'))), ',') AS kept_keys
FROM events"""))
def q_scrub_secret_keys(fx):
    """Environment maps with secret-named keys removed."""
    m = F.create_map(*[x for k in ENV_KEYS for x in (F.lit(k), F.concat(F.lit(k.lower()), F.col("event_id")))])
    return fx.events.select("event_id", F.array_join(F.array_sort(F.map_keys(R.scrub_secret_keys(m))), ",")
                            .alias("kept_keys"))
