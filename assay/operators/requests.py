"""Request-side operators: planning (J4, P4, P4b), request rows (P3), validation (P2), case pairing (J5),
per-category limits (W1), label / status / finish-reason mapping (P8, P9, P11), attribute hygiene
(P6, P6b) and the run explorer filter (P7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attribute names that must never reach telemetry (matched as substrings of the case-folded key).
FORBIDDEN_ATTRIBUTE_NAMES = (
    "api_key", "authorization", "access_token", "refresh_token", "secret",
    "password", "prompt", "response", "raw_response", "thought_signature",
)
# Environment-variable names that count as secrets (case-insensitive search).
SECRET_ENV_KEYS = r"(?i)(API_KEY|SECRET|TOKEN|KEY|PASSWORD|AUTH|CREDENTIAL|PRIVATE|DATABASE_URL|AWS_)"
# Provider stop reasons mapped to normalised finish reasons.
STOP_REASON_MAP = {"end_turn": "stop", "max_tokens": "length", "stop_sequence": "stop", "tool_use": "tool_calls"}
# Provider aliases on the command line.
PROVIDER_ALIASES = {"gemini": "google"}
# HTTP statuses each provider family retries (besides 429 rate limits).
RETRYABLE_STATUS = {
    "openai": (500, 502, 503, 504),
    "anthropic": (500, 502, 503, 504, 529),
    "google": (408, 429, 500, 502, 503, 504),
    "xai": (500, 502, 503, 504),
}
DEFAULT_TEMPERATURE = 0.0
DEFAULT_MAX_OUTPUT_TOKENS = 800


def capability_filter(plan: DataFrame, tags: str = "tags", supports_tools: str = "supports_tools") -> DataFrame:
    """Drop cases tagged ``tool-use`` for models without tool support."""
    return plan.where(~(F.coalesce(F.array_contains(tags, "tool-use"), F.lit(False)) &
                        ~F.coalesce(F.col(supports_tools), F.lit(False))))


def build_plan(cases: DataFrame, models: DataFrame) -> DataFrame:
    """J4 + P4: every (provider, model, case) triple that passes the capability filter.

    The model catalogue is configuration; Spark broadcasts it where it measures it small, and
    each case row is paired with the eligible models inside the join - the filter is the
    join condition, so ineligible pairs are never materialised.  The execution id is a
    deterministic hash of the triple.
    """
    m = models.select("provider", "model_name", "supports_tools", "max_output_tokens")
    eligible = ~(F.coalesce(F.array_contains(cases["tags"], "tool-use"), F.lit(False)) & ~m["supports_tools"])
    plan = cases.join(m, eligible, "inner")
    return plan.withColumn(
        "execution_id", F.sha2(F.concat_ws("\u0001", "provider", "model_name", "case_id"), 256))


def supports_capability(models: DataFrame, capability: str, caps_col: str = "capabilities") -> DataFrame:
    """Models whose capability set contains ``capability``."""
    return models.where(F.array_contains(caps_col, capability))


def model_capabilities(models: DataFrame) -> Column:
    """Capability set of a model row: text always, plus tools / json when supported."""
    return F.array_compact(F.array(
        F.lit("text"),
        F.when(F.col("supports_tools"), F.lit("tools")),
        F.when(F.col("supports_json_schema"), F.lit("json")),
    ))


def build_requests(plan: DataFrame, models: DataFrame) -> DataFrame:
    """Case x model -> request row; temperature / output cap from the model row, defaults 0.0 / 800."""
    m = models.select("provider", "model_name",
                      *[c for c in ("temperature", "max_output_tokens") if c in models.columns])
    m = m.withColumnsRenamed({c: f"_m_{c}" for c in m.columns if c not in ("provider", "model_name")})
    j = plan.drop(*[c for c in ("temperature", "max_output_tokens") if c in plan.columns]).join(
        m, ["provider", "model_name"], "left")
    temp = F.col("_m_temperature") if "_m_temperature" in j.columns else F.lit(None)
    cap = F.col("_m_max_output_tokens") if "_m_max_output_tokens" in j.columns else F.lit(None)
    return j.withColumn("temperature", F.coalesce(temp.cast("double"), F.lit(DEFAULT_TEMPERATURE))).withColumn(
        "max_output_tokens", F.coalesce(cap.cast("bigint"), F.lit(DEFAULT_MAX_OUTPUT_TOKENS).cast("bigint"))
    ).drop(*[c for c in j.columns if c.startswith("_m_")])


def validate_requests(df: DataFrame) -> DataFrame:
    """Id / category / messages not empty, model not empty, temperature in [0, 2] -> ``errors`` array."""
    def blank(c):
        return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")

    checks = [
        F.when(blank("id"), F.lit("id must not be empty")),
        F.when(blank("category"), F.lit("category must not be empty")),
        F.when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, F.lit("messages must not be empty")),
        F.when(blank("model"), F.lit("model must not be empty")),
        F.when(~F.col("temperature").between(0.0, 2.0) | F.col("temperature").isNull(),
               F.lit("temperature must be within [0, 2]")),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def response_with_case(responses: DataFrame, cases: DataFrame) -> DataFrame:
    """Pair each successful response with its case (failed executions have no response row).

    Equi-join on the case id.  A hot case (one case answered by a third of all
    responses) is handled by AQE's skew-join split of the large side.
    """
    return responses.join(cases.withColumnRenamed("id", "test_case_id"), "test_case_id")


def cases_per_category_limit(cases: DataFrame, n: int = 50, category: str = "category",
                             order: Sequence[str] = ("file_name", "line_no")) -> DataFrame:
    """The first n cases of each category in load order.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before the shuffle,
    so each partition ships at most n rows per category.
    """
    w = Window.partitionBy(category).orderBy(*order)
    return cases.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def classify_errors(df: DataFrame, provider: str = "provider", status_code: str = "status_code",
                    kind: str = "error_kind") -> DataFrame:
    """HTTP status / failure kind -> (error_class, retryable).

    401 -> authentication (never retried); 429 -> rate limit (always retried); a
    connection failure (no status, kind 'connection') retries; other statuses retry when
    the provider family lists them; anything else is a non-retryable provider error.  The
    per-provider retry lists are a literal map lookup (configuration-sized).
    """
    pairs = []
    for p, codes in sorted(RETRYABLE_STATUS.items()):
        pairs += [F.lit(p), F.array(*[F.lit(c) for c in codes])]
    retry_list = F.create_map(*pairs)[F.col(provider)]
    code = F.col(status_code)
    in_list = F.coalesce(F.array_contains(retry_list, code), F.lit(False))
    cls = (F.when(code == 401, F.lit("AuthenticationError"))
           .when(code == 429, F.lit("RateLimitError"))
           .when(code.isNull() & (F.col(kind) == "connection"), F.lit("RetryableProviderError"))
           .when(code.isNull(), F.lit("UnknownError"))
           .when(in_list, F.lit("RetryableProviderError"))
           .otherwise(F.lit("NonRetryableProviderError")))
    retry = (F.when(code == 401, F.lit(False)).when(code == 429, F.lit(True))
             .when(code.isNull(), F.col(kind) == "connection").otherwise(in_list))
    return df.withColumn("error_class", cls).withColumn("retryable", F.coalesce(retry, F.lit(False)))


def map_finish_reason(c: Column) -> Column:
    """Provider stop reason -> normalised finish reason; unknown values pass through, null stays null."""
    m = F.create_map(*[x for k, v in STOP_REASON_MAP.items() for x in (F.lit(k), F.lit(v))])
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(m[c], c))


def normalise_providers(csv: Column) -> Column:
    """Split a comma list, trim, lower, alias gemini -> google, drop blanks, keep first of duplicates."""
    alias = F.create_map(*[x for k, v in PROVIDER_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    items = F.transform(F.split(csv, ","), lambda x: F.lower(F.trim(x)))
    items = F.filter(items, lambda x: x != "")
    items = F.transform(items, lambda x: F.coalesce(alias[x], x))
    return F.array_distinct(items)


def safe_attributes(attrs: Column) -> Column:
    """Drop entries whose lower-cased key contains a forbidden name; drop nulls; string values stay whole."""
    def forbidden(k):
        low = F.lower(k)
        cond = F.lit(False)
        for name in FORBIDDEN_ATTRIBUTE_NAMES:
            cond = cond | low.contains(name)
        return cond

    return F.map_filter(attrs, lambda k, v: ~forbidden(k) & v.isNotNull())


def scrub_secret_keys(m: Column) -> Column:
    """Drop map entries whose key matches the secret-name pattern."""
    return F.map_filter(m, lambda k, v: ~k.rlike(SECRET_ENV_KEYS))


def run_explorer(exec_verdicts: DataFrame, text: str | None = None, verdict: str | None = None,
                 provider: str | None = None) -> DataFrame:
    """Free-text (over id, category, provider, model, status), verdict and provider filters."""
    df = exec_verdicts
    if text:
        hay = F.lower(F.concat_ws(" ", "execution_id", "category", "provider", "configured_model", "status"))
        df = df.where(hay.contains(text.lower()))
    if verdict:
        df = df.where(F.col("verdict") == verdict)
    if provider:
        df = df.where(F.col("provider") == provider)
    return df
