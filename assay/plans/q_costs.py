"""Cost queries: J2, J3, L6, SCL-1, A1, L3, A11, A12, A13, SET-5, W8, W8b."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from assay.functions.money import usd_exact, usd_round
from assay.operators import costs
from assay.operators.cumulative import materialised
from assay.plans.catalog import register
from assay.plans.fixtures import oracle
from assay.session import checkpoint_dir
from assay.sources import dims

# Oracle helpers: longest-prefix price per distinct model name, and costed executions.
PRICE_CTE = """
price AS (
 SELECT d.m AS model, max_by(p.model_name, length(p.model_name)) AS priced_as,
  max_by(p.input_per_million, length(p.model_name)) AS pin,
  max_by(p.output_per_million, length(p.model_name)) AS pout
 FROM (SELECT returned_model AS m FROM executions UNION SELECT configured_model FROM executions) d
 LEFT JOIN models p ON starts_with(d.m, p.model_name)
 GROUP BY d.m),
costed AS (
 SELECT x.*, round(CAST(x.input_tokens AS DOUBLE) / 1000000.0 * coalesce(p.pin, 0.0)
  + CAST(x.output_tokens AS DOUBLE) / 1000000.0 * coalesce(p.pout, 0.0), 8) AS cost
 FROM executions x LEFT JOIN price p ON p.model = x.returned_model)
"""
BUDGET_CTE = """
budgets AS (SELECT * FROM (VALUES ('openai',CAST(8.0 AS DOUBLE)),('anthropic',CAST(8.0 AS DOUBLE)),
 ('google',CAST(8.0 AS DOUBLE)),('xai',CAST(8.0 AS DOUBLE))) AS b(provider, cap_usd))
"""


def _pricing(fx):
    return dims.pricing_from_models(fx.models)


def _costed_completed(fx):
    return costs.with_cost(fx.executions.where(F.col("status") == "completed"), _pricing(fx))


@register("leaderboard_cost", oracle(["executions"], """
SELECT provider, configured_model AS model_name, count(*) AS total_execs,
 round(avg(latency_ms), 6) AS avg_latency_ms, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
 (CAST((sum(CAST(round(cost * 100000000.0) AS BIGINT)) + 50) // 100 AS DOUBLE) / 1000000.0) AS total_cost
FROM costed WHERE status = 'completed' GROUP BY provider, configured_model
ORDER BY total_execs DESC, provider, model_name""", PRICE_CTE))
def q_leaderboard_cost(fx):
    """A1 + J2 + J3 + SCL-1 + L3: the flagship cost leaderboard."""
    return costs.leaderboard_cost(fx.executions, _pricing(fx))


@register("price_by_longest_prefix", oracle(["executions"], """
SELECT x.execution_id, x.returned_model, p.priced_as,
 coalesce(p.pin, 0.0) AS input_per_million, coalesce(p.pout, 0.0) AS output_per_million, x.cost AS cost_usd
FROM costed x LEFT JOIN price p ON p.model = x.returned_model WHERE x.status = 'completed'""", PRICE_CTE))
def q_price_by_longest_prefix(fx):
    """J3 / L6 / SCL-1: per completed execution, the matched price row and the request cost."""
    ex = fx.executions.where(F.col("status") == "completed").select(
        "execution_id", "returned_model", "input_tokens", "output_tokens")
    p = costs.price_by_longest_prefix(ex, "returned_model", _pricing(fx))
    from assay.functions.money import request_cost
    return p.select(
        "execution_id", "returned_model", "priced_as",
        F.coalesce("input_per_million", F.lit(0.0)).alias("input_per_million"),
        F.coalesce("output_per_million", F.lit(0.0)).alias("output_per_million"),
        request_cost("input_tokens", "output_tokens", "input_per_million", "output_per_million").alias("cost_usd"))


@register("executions_with_models", oracle(["executions"], """
SELECT x.execution_id, x.provider, x.configured_model, m.context_limit, m.max_output_tokens, m.supports_tools
FROM executions x JOIN models m ON m.provider = x.provider AND m.model_name = x.configured_model
WHERE x.status = 'completed'"""))
def q_executions_with_models(fx):
    """Executions joined to the model dimension (bounded by configuration)."""
    m = fx.models.select(F.col("provider"), F.col("model_name").alias("configured_model"),
                         "context_limit", "max_output_tokens", "supports_tools")
    return (fx.executions.where(F.col("status") == "completed")
            .join(m, ["provider", "configured_model"])
            .select("execution_id", "provider", "configured_model", "context_limit", "max_output_tokens",
                    "supports_tools"))


@register("reprice_executions", oracle(["executions"], """
SELECT run_id, count(*) AS rows_evaluated, count(*) FILTER (WHERE old_cost <> new_cost) AS rows_changed,
 (CAST((sum(CAST(round(old_cost * 100000000.0) AS BIGINT)) + 50) // 100 AS DOUBLE) / 1000000.0) AS old_total_usd, (CAST((sum(CAST(round(new_cost * 100000000.0) AS BIGINT)) + 50) // 100 AS DOUBLE) / 1000000.0) AS new_total_usd,
 coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN old_cost <> new_cost AND new_cost = 0.0 THEN returned_model END))), ','), '') AS unmatched_models
FROM (SELECT x.run_id, x.returned_model,
  round(CAST(x.input_tokens AS DOUBLE) / 1000000.0 * coalesce(o.pin, 0.0) + CAST(x.output_tokens AS DOUBLE) / 1000000.0 * coalesce(o.pout, 0.0), 8) AS old_cost,
  x.cost AS new_cost
  FROM costed x LEFT JOIN price o ON o.model = x.configured_model WHERE x.status = 'completed') t
GROUP BY run_id""", PRICE_CTE))
def q_reprice_executions(fx):
    """A13 + SET-5: dry-run re-pricing per run."""
    return costs.reprice_executions(fx.executions, _pricing(fx))


# Runs of even number were stored before the price list changed: at the configured model's prices.
STALE_RUN = "CAST(substr(run_id, 5) AS INT) % 2 = 0"


@register("backfill_costs", oracle(["executions"], f"""
SELECT run_id, count(*) FILTER (WHERE status = 'completed') AS rows_evaluated,
 count(*) FILTER (WHERE status = 'completed' AND stale AND old_cost <> cost) AS rows_changed,
 CAST((coalesce(sum(CASE WHEN status = 'completed' THEN CAST(round((CASE WHEN stale THEN old_cost ELSE cost END) * 100000000.0) AS BIGINT) END), 0) + 50) // 100 AS DOUBLE) / 1000000.0 AS old_total_usd,
 CAST((coalesce(sum(CASE WHEN status = 'completed' THEN CAST(round(cost * 100000000.0) AS BIGINT) END), 0) + 50) // 100 AS DOUBLE) / 1000000.0 AS stored_total_usd,
 count(*) AS stored_rows, count(*) FILTER (WHERE status = 'completed' AND stale AND old_cost <> cost) > 0 AS rewritten
FROM (SELECT x.*, {STALE_RUN} AS stale, round(CAST(x.input_tokens AS DOUBLE) / 1000000.0 * coalesce(o.pin, 0.0)
  + CAST(x.output_tokens AS DOUBLE) / 1000000.0 * coalesce(o.pout, 0.0), 8) AS old_cost
 FROM costed x LEFT JOIN price o ON o.model = x.configured_model) t GROUP BY run_id""", PRICE_CTE))
def q_backfill_costs(fx):
    """A13 with write-back: stored costs re-priced, only changed runs' partitions written, the table read back."""
    spark = fx.spark
    root = os.path.join(checkpoint_dir(spark), f"backfill-{uuid.uuid4().hex}")
    both = costs.with_cost(costs.with_cost(fx.executions, _pricing(fx), "configured_model", "_old"), _pricing(fx), "returned_model", "_new")
    stored = both.withColumn("estimated_cost_usd", F.when(F.col("status") == "completed", F.when(F.expr(STALE_RUN), F.col("_old")).otherwise(F.col("_new"))))
    stored.drop("_old", "_new").write.partitionBy("run_id").parquet(root)

    def files():
        return spark.read.parquet(root).select("run_id", "_metadata.file_path").distinct()

    before = materialised(files(), "files-before")
    preview = costs.backfill_costs(spark, root, _pricing(fx), dry_run=True)
    report = costs.backfill_costs(spark, root, _pricing(fx))
    kept = files().join(before, ["run_id", "file_path"], "left_semi").select("run_id").distinct().withColumn("_kept", F.lit(True))
    total = F.sum(F.when(F.col("status") == "completed", usd_exact("estimated_cost_usd")).otherwise(0))
    now = spark.read.parquet(root).groupBy("run_id").agg(usd_round(total).alias("stored_total_usd"), F.count(F.lit(1)).alias("stored_rows"))
    same = preview.select("run_id", F.col("rows_changed").alias("_previewed"))  # the dry run reports the same and writes nothing
    told = report.join(now, "run_id").join(kept, "run_id", "left").join(same, "run_id").where(F.col("_previewed") == F.col("rows_changed"))
    return told.select("run_id", "rows_evaluated", "rows_changed", "old_total_usd", "stored_total_usd", "stored_rows",
                       F.col("_kept").isNull().alias("rewritten"))


@register("preflight_estimate", oracle(["executions"], """
SELECT c.run_id, c.provider, f.first_model, c.num_cases,
 round(round(CAST(500 AS DOUBLE) / 1000000.0 * coalesce(p.pin, 0.0) + CAST(800 AS DOUBLE) / 1000000.0 * coalesce(p.pout, 0.0), 8) * c.num_cases * 2, 6) AS estimated_usd,
 coalesce(round(round(CAST(500 AS DOUBLE) / 1000000.0 * coalesce(p.pin, 0.0) + CAST(800 AS DOUBLE) / 1000000.0 * coalesce(p.pout, 0.0), 8) * c.num_cases * 2, 6) > b.cap_usd, FALSE) AS provider_breach,
 round(round(CAST(500 AS DOUBLE) / 1000000.0 * coalesce(p.pin, 0.0) + CAST(800 AS DOUBLE) / 1000000.0 * coalesce(p.pout, 0.0), 8) * c.num_cases * 2, 6) > 30.0 AS global_breach
FROM (SELECT run_id, provider, count(*) AS num_cases FROM executions GROUP BY run_id, provider) c
JOIN (SELECT provider, arg_min(model_name, model_no) AS first_model FROM models GROUP BY provider) f ON f.provider = c.provider
LEFT JOIN (SELECT d.m, max_by(q.input_per_million, length(q.model_name)) AS pin, max_by(q.output_per_million, length(q.model_name)) AS pout
   FROM (SELECT DISTINCT model_name AS m FROM models) d JOIN models q ON starts_with(d.m, q.model_name) GROUP BY d.m) p ON p.m = f.first_model
LEFT JOIN budgets b ON b.provider = c.provider""", BUDGET_CTE))
def q_preflight_estimate(fx):
    """Worst-case estimate per (run, provider) with breach flags."""
    return costs.preflight_estimate(fx.executions, fx.models, dims.Budget())


@register("spend_summary", oracle(["executions"], """
SELECT 'provider' AS scope, c.provider, (CAST((sum(CAST(round(c.cost * 100000000.0) AS BIGINT)) + 50) // 100 AS DOUBLE) / 1000000.0) AS spend_usd, b.cap_usd, b.cap_usd AS effective_cap_usd
FROM costed c LEFT JOIN budgets b ON b.provider = c.provider WHERE c.status = 'completed' GROUP BY c.provider, b.cap_usd
UNION ALL
SELECT 'global', NULL, (CAST((sum(CAST(round(cost * 100000000.0) AS BIGINT)) + 50) // 100 AS DOUBLE) / 1000000.0), CAST(35.0 AS DOUBLE), CAST(30.0 AS DOUBLE) FROM costed WHERE status = 'completed'
""", PRICE_CTE + "," + BUDGET_CTE))
def q_spend_summary(fx):
    """Spend per provider + global (rollup), caps and effective cap."""
    return costs.spend_summary(_costed_completed(fx), dims.Budget())


@register("cumulative_spend", oracle(["executions"], """
SELECT execution_id, provider, cost AS cost_usd,
 (CAST((sum(CAST(round(cost * 100000000.0) AS BIGINT)) OVER (PARTITION BY provider ORDER BY request_ts, execution_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 50) // 100 AS DOUBLE) / 1000000.0) AS provider_spend_usd,
 (CAST((sum(CAST(round(cost * 100000000.0) AS BIGINT)) OVER (ORDER BY request_ts, execution_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 50) // 100 AS DOUBLE) / 1000000.0) AS global_spend_usd,
 sum(CAST(round(cost * 100000000.0) AS BIGINT)) OVER (PARTITION BY provider ORDER BY request_ts, execution_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 800000000 AS provider_breach,
 sum(CAST(round(cost * 100000000.0) AS BIGINT)) OVER (ORDER BY request_ts, execution_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 3000000000 AS global_breach
FROM costed WHERE status = 'completed'""", PRICE_CTE))
def q_cumulative_spend(fx):
    """Running spend per provider and global with breach flags (sliced prefix sums)."""
    out = costs.cumulative_spend(_costed_completed(fx), dims.Budget())
    return out.drop("request_ts")


@register("budget_admission")
def q_budget_admission(fx):
    """Exact per-run admission fold (order-dependent; rows-only check, unit-tested branches)."""
    b = dims.Budget()
    return costs.budget_admission(_costed_completed(fx), b.caps, b.effective_global_cap)
