"""Streaming queries: STR-1..5 and STR-8 in batch (backfill) form with oracles; STR-6 and STR-7 run as
Structured Streaming jobs to completion (rows-only check, unit-tested against the batch fold)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import costs
from assay.plans.catalog import register
from assay.plans.fixtures import oracle
from assay.plans.q_costs import PRICE_CTE
from assay.sources import dims
from assay.streaming import stateful, windows
from assay.operators.metrics import LATENCY_BUCKETS_S

X = ["executions"]


def _slide_sql(unit: str, k: int) -> str:
    to = {"minute": "to_minutes", "hour": "to_hours"}[unit]
    return (f"strftime(time_bucket(INTERVAL '1 {unit}', request_ts) - {to}(k), '%Y-%m-%d %H:%M:%S') AS window_start",
            f"range(0, {k}) t(k)")


W5, R5 = _slide_sql("minute", 5)


@register("request_rate_5m", oracle(X, f"""
SELECT {W5}, provider, configured_model AS model, count(*) AS requests, round(CAST(count(*) AS DOUBLE) / 300.0, 6) AS rate_per_s
FROM executions, {R5} GROUP BY ALL"""))
def q_request_rate_5m(fx):
    """STR-1: requests per second by provider and model over 5-minute windows sliding by 1 minute."""
    e = fx.executions.select("request_ts", "provider", F.col("configured_model").alias("model"))
    return windows.request_rate(e)


@register("error_rate_5m", oracle(X, f"""
SELECT {W5}, provider, count(*) AS requests, count(*) FILTER (WHERE status <> 'completed') AS errors,
 round(CAST(count(*) FILTER (WHERE status <> 'completed') AS DOUBLE) * 100.0 / count(*), 6) AS error_pct
FROM executions, {R5} GROUP BY ALL"""))
def q_error_rate_5m(fx):
    """STR-2: percentage of non-successful requests per provider and 5-minute window."""
    return windows.error_rate(fx.executions.select("request_ts", "provider", "status"))


def _quantile_sql(q: float) -> str:
    cum = [f"count(*) FILTER (WHERE CAST(latency_ms AS DOUBLE) / 1000.0 <= {float(b)})" for b in LATENCY_BUCKETS_S]
    cum.append("count(*)")
    rank = f"({q} * count(*))"
    expr = f"{float(LATENCY_BUCKETS_S[-1])}"
    for i in range(len(LATENCY_BUCKETS_S) - 1, -1, -1):
        lo = 0.0 if i == 0 else float(LATENCY_BUCKETS_S[i - 1])
        prev = "0" if i == 0 else cum[i - 1]
        hi = float(LATENCY_BUCKETS_S[i])
        interp = f"({lo} + ({hi} - {lo}) * ({rank} - {prev}) / ({cum[i]} - {prev}))"
        expr = f"CASE WHEN {cum[i]} >= {rank} THEN {interp} ELSE {expr} END"
    return f"CASE WHEN count(*) > 0 THEN round({expr}, 6) END"


@register("p95_latency_5m", oracle(X, f"""
SELECT {W5}, provider, count(*) AS requests, {_quantile_sql(0.95)} AS latency_p95_s
FROM executions, {R5} GROUP BY ALL"""))
def q_p95_latency_5m(fx):
    """STR-3: histogram-quantile p95 latency per provider and 5-minute window."""
    return windows.p95_latency(fx.executions.select("request_ts", "provider", "latency_ms"))


W24, R24 = _slide_sql("hour", 24)


@register("cost_24h", oracle(X, f"""
SELECT {W24}, provider, (CAST((sum(CAST(round(cost * 100000000.0) AS BIGINT)) + 50) // 100 AS DOUBLE) / 1000000.0) AS cost_usd
FROM costed, {R24} WHERE status = 'completed' GROUP BY ALL""", PRICE_CTE))
def q_cost_24h(fx):
    """STR-4: cost per provider over 24-hour windows sliding by 1 hour."""
    c = costs.with_cost(fx.executions.where(F.col("status") == "completed"), dims.pricing_from_models(fx.models))
    return windows.cost_window(c.select("request_ts", "provider", "cost_usd"))


@register("active_executions", oracle(X, """
SELECT provider, execution_id, kind,
 CAST(sum(delta) OVER (PARTITION BY provider ORDER BY t, delta, execution_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS active
FROM (SELECT provider, execution_id, request_ts AS t, CAST(1 AS BIGINT) AS delta, 'start' AS kind FROM executions
 UNION ALL SELECT provider, execution_id, request_ts + to_milliseconds(latency_ms), CAST(-1 AS BIGINT), 'end' FROM executions) e"""))
def q_active_executions(fx):
    """STR-5: in-flight executions per provider after every start / end event."""
    return windows.active_executions(fx.executions.select("provider", "execution_id", "request_ts", "latency_ms"))


@register("rpm_breach", oracle(X, """
SELECT strftime(time_bucket(INTERVAL '1 minute', request_ts), '%Y-%m-%d %H:%M:%S') AS window_start, provider, count(*) AS requests,
 CAST(CASE provider WHEN 'openai' THEN 60 WHEN 'anthropic' THEN 50 WHEN 'google' THEN 60 WHEN 'xai' THEN 30 END AS BIGINT) AS rpm_limit,
 coalesce(count(*) > CASE provider WHEN 'openai' THEN 60 WHEN 'anthropic' THEN 50 WHEN 'google' THEN 60 WHEN 'xai' THEN 30 END, FALSE) AS breach
FROM executions GROUP BY 1, provider"""))
def q_rpm_breach(fx):
    """STR-8: requests per minute per provider against the configured ceiling."""
    return windows.rpm_breach(fx.executions.select("request_ts", "provider"), dims.DEFAULT_RPM_LIMITS)


@register("budget_admission_stream")
def q_budget_admission_stream(fx):
    """STR-6: the exact budget gate as a stateful streaming job (state: spend per provider and global per run)."""
    b = dims.Budget()
    c = costs.with_cost(fx.executions.where(F.col("status") == "completed"), dims.pricing_from_models(fx.models))
    src = c.select("run_id", "execution_id", "provider", "cost_usd", F.col("request_ts").cast("timestamp"))
    return stateful.run_available(
        fx.spark, src, lambda s: stateful.budget_admission_stream(s, b.caps, b.effective_global_cap),
        "budget", arrival=["request_ts", "execution_id"])


@register("append_decisions")
def q_append_decisions(fx):
    """STR-7: decisions appended to their stream only when they extend its head (stateful streaming)."""
    src = fx.decisions.select("stream_id", "decision_id", "stream_sequence", "previous_record_digest",
                              "current_record_digest", "pos")
    return stateful.run_available(fx.spark, src, lambda s: stateful.append_decisions(s, arrival="pos"),
                                  "decisions", arrival=["pos", "stream_sequence", "decision_id"])


@register("active_executions_stream")
def q_active_executions_stream(fx):
    """STR-5 online: the in-flight gauge per provider as a stateful stream over start / end events."""
    ev = windows.gauge_events(fx.executions.select("provider", "execution_id", "request_ts", "latency_ms"))
    return stateful.run_available(fx.spark, ev, stateful.active_executions_stream, "gauge",
                                  arrival=["_t", "delta", "execution_id"])
