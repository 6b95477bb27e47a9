"""Queries under the survey's own operator keys, for operators that the other modules exercise as
parts of larger queries: SRC-5, J7, A19, L3, L4, L5, L6, L7, SET-4, SET-5, SCL-1, SCL-6, SCL-10,
SCL-11, SCL-16."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.functions import judge as J
from assay.functions import text as T
from assay.functions.money import clamp_invert, request_cost
from assay.operators import costs, judges, metrics, stats, verdicts
from assay.plans.catalog import register
from assay.plans.fixtures import oracle
from assay.plans.q_costs import PRICE_CTE
from assay.plans.q_judges import JUDGE_WEIGHTS, _interval_sql, _splits_sql
from assay.plans.q_metrics import LEADER_SQL, VERDICT_CTE, exec_verdicts
from assay.sources import dims
from assay.sources.tables import lookup, scan_decision_stream


@register("scan_tables", oracle(["executions"], """
SELECT execution_id, provider, configured_model, status, latency_ms FROM executions WHERE run_id = 'run-7'"""))
def q_scan_tables(fx):
    """SRC-5: point lookup of one run's executions (a pushed-down filter, not a collect)."""
    return lookup(fx.executions, "run_id", "run-7").select("execution_id", "provider", "configured_model",
                                                           "status", "latency_ms")


@register("judge_with_weight", oracle(["judge_results"], """
SELECT subject_id, judge_id, CASE judge_id WHEN 'quality' THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS weight
FROM judge_results"""))
def q_judge_with_weight(fx):
    """Weight per judge result from the configured weights (default 1.0; negative is an error)."""
    return fx.judge_results.select("subject_id", "judge_id", judges.judge_weight(JUDGE_WEIGHTS).alias("weight"))


@register("panels_by_dimension", oracle(["executions", "scores", "metric_rules"], """
SELECT category, provider, count(*) AS executions, count(*) FILTER (WHERE verdict = 'fail') AS failures,
 round(avg(latency_ms), 6) AS avg_latency_ms FROM ev GROUP BY category, provider""", VERDICT_CTE))
def q_panels_by_dimension(fx):
    """Executions, failures and mean latency by category x provider."""
    return exec_verdicts(fx).groupBy("category", "provider").agg(
        F.count(F.lit(1)).alias("executions"), F.count_if(F.col("verdict") == "fail").alias("failures"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"))


@register("leaderboard_order", oracle(["executions"], """
SELECT provider, configured_model AS model_name, count(*) AS total_execs,
 CAST(row_number() OVER (ORDER BY count(*) DESC, provider, configured_model) AS BIGINT) AS position
FROM executions WHERE status = 'completed' GROUP BY provider, configured_model"""))
def q_leaderboard_order(fx):
    """L3: cost-leaderboard order (execution count desc, names as tie-break) as an explicit position."""
    lb = costs.leaderboard_cost(fx.executions, dims.pricing_from_models(fx.models)).select(
        "provider", "model_name", "total_execs")
    w = Window.orderBy(F.col("total_execs").desc(), "provider", "model_name")  # one row per model: bounded
    return lb.withColumn("position", F.row_number().over(w).cast("bigint"))


@register("pass_rate_order", oracle(["executions", "scores", "metric_rules"],
                                    f"SELECT model, pass_rate_pct, rank FROM ({LEADER_SQL}) r", VERDICT_CTE))
def q_pass_rate_order(fx):
    """L4: models by pass rate desc (W6 ranking)."""
    return metrics.leaderboard_quality(exec_verdicts(fx)).select("model", "pass_rate_pct", "rank")


@register("stream_order", oracle(["decisions"], """
SELECT stream_id, CAST(pos AS BIGINT) AS pos, CAST(stream_sequence AS BIGINT) AS stream_sequence FROM decisions"""))
def q_stream_order(fx):
    """Every stream's decisions in sequence order (range-partitioned by stream and position)."""
    d = fx.decisions.select("stream_id", F.col("pos").cast("bigint"), F.col("stream_sequence").cast("bigint"))
    return scan_decision_stream(d, None, "pos")


@register("longest_match", oracle(["executions"], """
SELECT model AS returned_model, priced_as FROM price WHERE model IN (SELECT returned_model FROM executions)""",
                                  PRICE_CTE))
def q_longest_match(fx):
    """The registered model name each returned model is priced as (top-1 by name length)."""
    names = fx.executions.select("returned_model").distinct()
    return costs.price_by_longest_prefix(names, "returned_model", dims.pricing_from_models(fx.models)).select(
        "returned_model", "priced_as")


@register("bootstrap_quantile", oracle(["judge_results"], f"""
SELECT s.g AS judge_id, round(e.lo, 6) AS ci_lower, round(e.hi, 6) AS ci_upper{_interval_sql(0.90)}""",
    "vals AS (SELECT judge_id AS g, score AS v FROM judge_results)," + _splits_sql("vals", None), recursive=True))
def q_bootstrap_quantile(fx):
    """The percentile picks of the sorted bootstrap means at 90% (indices 49 and 950 of 1000)."""
    return stats.bootstrap_ci(fx.judge_results, "judge_id", "score", "subject_id", 0.90, 1000, 42, "hash").select(
        "judge_id", "ci_lower", "ci_upper")


@register("key_set_diff", oracle(["judge_raw"], """
SELECT doc_id, array_to_string(list_sort(list_filter(json_keys(raw), lambda k: NOT list_contains(['reason', 'schema_version', 'score'], k))), ',') AS unknown_fields
FROM judge_raw WHERE CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' AND len(json_keys(raw)) = len(list_distinct(json_keys(raw))) ELSE FALSE END"""))
def q_key_set_diff(fx):
    """SET-4: unknown fields (keys minus the allowed set, sorted) of single-document judge objects."""
    d = fx.judge_raw.select("doc_id", J.top_level_keys("raw").alias("k")).where(F.col("k").isNotNull())
    return d.select("doc_id", F.array_join(J.key_set_diff("k")["unknown"], ",").alias("unknown_fields"))


@register("distinct_models", oracle(["executions"], """
SELECT DISTINCT x.returned_model FROM costed x LEFT JOIN price o ON o.model = x.configured_model
WHERE x.status = 'completed' AND x.cost = 0.0
 AND round(CAST(x.input_tokens AS DOUBLE) / 1000000.0 * coalesce(o.pin, 0.0) + CAST(x.output_tokens AS DOUBLE) / 1000000.0 * coalesce(o.pout, 0.0), 8) <> 0.0""",
                                    PRICE_CTE))
def q_distinct_models(fx):
    """SET-5: the distinct models whose re-priced cost fell to zero (unmatched by the price table)."""
    p = dims.pricing_from_models(fx.models)
    done = fx.executions.where(F.col("status") == "completed")
    old = costs.with_cost(done, p, model_col="configured_model", out="old_cost")
    both = costs.with_cost(old, p, model_col="returned_model", out="new_cost")
    return both.where((F.col("new_cost") == 0.0) & (F.col("old_cost") != 0.0)).select("returned_model").distinct()


@register("request_cost", oracle(["executions"], """
SELECT execution_id, cost AS cost_usd FROM costed WHERE status = 'completed'""", PRICE_CTE))
def q_request_cost(fx):
    """SCL-1: per-request cost = in/1e6 * p_in + out/1e6 * p_out, rounded to 8 places."""
    ex = fx.executions.where(F.col("status") == "completed").select("execution_id", "returned_model",
                                                                    "input_tokens", "output_tokens")
    p = costs.price_by_longest_prefix(ex, "returned_model", dims.pricing_from_models(fx.models))
    return p.select("execution_id", request_cost("input_tokens", "output_tokens", "input_per_million",
                                                 "output_per_million").alias("cost_usd"))


@register("is_clean", oracle([], "SELECT doc_id, NOT (" + " OR ".join(
    "regexp_matches(text, '" + p.replace("'", "''") + "')" for _, p, _ in T.REDACTION_RULES) + ") AS is_clean FROM documents"))
def q_is_clean(fx):
    """SCL-6: documents free of every secret pattern."""
    return fx.documents.select("doc_id", T.is_clean("text").alias("is_clean"))


@register("parse_judge_output", oracle(["judge_raw"], """
SELECT doc_id, valid FROM jp""", """
jp AS (SELECT doc_id, raw,
  CASE WHEN raw IS NULL OR raw <> trim(raw) OR raw = '' OR contains(raw, '```') OR NOT coalesce(json_valid(raw), FALSE) THEN FALSE
  ELSE (json_type(raw) = 'OBJECT' AND list_sort(json_keys(raw)) = ['reason', 'schema_version', 'score']
   AND json_type(raw, '$.schema_version') = 'VARCHAR' AND json_extract_string(raw, '$.schema_version') = '1.0'
   AND json_type(raw, '$.score') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND CAST(json_extract(raw, '$.score') AS DOUBLE) BETWEEN 0.0 AND 1.0
   AND json_type(raw, '$.reason') = 'VARCHAR' AND trim(json_extract_string(raw, '$.reason')) <> ''
   AND length(json_extract_string(raw, '$.reason')) <= 2000) END AS valid FROM judge_raw)"""))
def q_parse_judge_output(fx):
    """SCL-10: strict judge-output validity per raw text (fail closed)."""
    return fx.judge_raw.select("doc_id", J.parse_judge_output("raw")["valid"].alias("valid"))


@register("judge_passed", oracle(["judge_results"], """
SELECT subject_id, judge_id, score >= 0.8 AS passed_locally FROM judge_results"""))
def q_judge_passed(fx):
    """SCL-11: pass flag derived locally from the score (>= 0.8), never taken from the judge."""
    return fx.judge_results.select("subject_id", "judge_id", J.judge_passed("score").alias("passed_locally"))


@register("clamp_invert", oracle(["scores", "metric_rules"], """
SELECT s.execution_id, s.metric_name,
 CASE WHEN coalesce(r.invert, FALSE) THEN CAST(1.0 AS DOUBLE) - least(greatest(s.numeric_score, 0.0), 1.0)
      ELSE least(greatest(s.numeric_score, 0.0), 1.0) END AS quality
FROM scores s LEFT JOIN metric_rules r ON r.category = s.category AND r.metric_name = s.metric_name"""))
def q_clamp_invert(fx):
    """SCL-16: quality = clamp(score, 0, 1), inverted when the metric rule says so."""
    s = verdicts.score_with_rule(fx.scores, fx.metric_rules)
    return s.select("execution_id", "metric_name", clamp_invert("numeric_score", "invert").alias("quality"))
