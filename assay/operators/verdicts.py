"""Scores -> verdicts: rule attachment (J6), weighted verdict (A6), first blocking metric (W9),
latest verdict per execution (W10/J8), the run-scores view (J1), run result (A5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.money import clamp_invert
from assay.sources import dims

VERDICT_COLUMNS = ["execution_id", "status", "severity", "confidence", "requires_human_review",
                   "blocking_metric", "overall_quality"]


def score_with_rule(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach weight / invert by (category, metric); no rule -> weight 1.0, invert false.

    ``rules`` is the scoring configuration; Spark picks the join by its measured size.
    """
    r = rules.select("category", "metric_name", F.col("weight").alias("_w"), F.col("invert").alias("_inv"))
    j = scores.join(r, ["category", "metric_name"], "left")
    return j.withColumn("weight", F.coalesce("_w", F.lit(1.0))).withColumn(
        "invert", F.coalesce("_inv", F.lit(False))).drop("_w", "_inv")


def decide_verdict(scores: DataFrame, rules: DataFrame, executions: DataFrame,
                   severity_col: str | None = None,
                   pass_threshold: float = dims.PASS_THRESHOLD, warn_threshold: float = dims.WARN_THRESHOLD,
                   min_confidence: float = dims.MIN_CONFIDENCE,
                   blocking: Sequence[str] = dims.BLOCKING_CATEGORIES,
                   polarity: str = "faithful") -> DataFrame:
    """A6 (+J6, W9, SCL-16): one verdict per execution.

    quality = clamp(score) (inverted when the rule says so); overall = sum(q*w)/sum(w);
    a blocking category with any failed score -> FAIL (first failed metric in score
    order is reported); else >= pass -> PASS, >= warn -> WARN, else FAIL.  Mean
    confidence < min -> human review.  Executions without scores get INCONCLUSIVE
    (severity low, confidence 0, review) through a left join.

    ``polarity="corrected"`` treats the two rate metrics that already emit 1.0 = good
    (unauthorized_call_rate, unsupported_claim_rate) as not inverted.

    Scale: scores are aggregated per execution_id (high cardinality, bounded rows per
    key; partial aggregation before the shuffle); the left join to executions is on the
    same key.
    """
    s = score_with_rule(scores, rules)
    invert: Column = F.col("invert")
    if polarity == "corrected":
        invert = invert & ~F.col("metric_name").isin("unauthorized_call_rate", "unsupported_claim_rate")
    s = s.withColumn("_q", clamp_invert("numeric_score", invert))
    # category is a property of the execution, so it is a grouping key; the first failed metric
    # comes from the (small) per-execution list of failed (position, name) pairs.  No string
    # aggregation buffers, so Spark can aggregate by hashing instead of sorting all scores.
    failed = F.when(~F.col("passed"), F.struct(F.col("score_pos").alias("p"), F.col("metric_name").alias("m")))
    agg = s.groupBy("execution_id", F.col("category").alias("_category")).agg(
        F.sum(F.col("_q") * F.col("weight")).alias("_wsum"),
        F.sum("weight").alias("_w"),
        F.avg("confidence").alias("_conf"),
        F.array_min(F.collect_list(failed)).getField("m").alias("_first_failed"),
    )
    sev = F.col(severity_col) if severity_col else F.lit("low")
    base = executions.select("execution_id", sev.alias("_sev"))
    j = base.join(agg, "execution_id", "left")
    scored = F.col("_w").isNotNull()
    overall = F.when(F.col("_w") != 0, F.col("_wsum") / F.col("_w")).otherwise(F.lit(0.0))
    blocked = F.col("_category").isin(*blocking) & F.col("_first_failed").isNotNull()
    status = (
        F.when(~scored, F.lit("inconclusive"))
        .when(blocked, F.lit("fail"))
        .when(overall >= F.lit(pass_threshold), F.lit("pass"))
        .when(overall >= F.lit(warn_threshold), F.lit("warn"))
        .otherwise(F.lit("fail"))
    )
    return j.select(
        "execution_id",
        status.alias("status"),
        F.when(scored, F.col("_sev")).otherwise(F.lit("low")).alias("severity"),
        F.when(scored, F.round("_conf", 3)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(scored, F.col("_conf") < F.lit(min_confidence)).otherwise(F.lit(True)).alias("requires_human_review"),
        F.when(scored & blocked, F.col("_first_failed")).alias("blocking_metric"),
        F.when(scored, F.round(overall, 6)).alias("overall_quality"),
    )


def latest_status(df: DataFrame, key: Sequence[str] | str, order: Sequence[str] | str,
                  cols: Sequence[str]) -> DataFrame:
    """Last write wins per key - ``max_by`` of the payload on the order column(s).

    An aggregate, not a window: map-side partial aggregation keeps one row per key per
    partition, so a hot key never lands whole in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order_cols = [order] if isinstance(order, str) else list(order)
    ordering = F.struct(*order_cols) if len(order_cols) > 1 else F.col(order_cols[0])
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), ordering).alias("_last"))
    return latest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])


def execution_with_verdict(executions: DataFrame, verdicts: DataFrame, order: str = "verdict_seq") -> DataFrame:
    """Every execution with its last verdict status, default 'unknown'."""
    v = verdicts
    if order not in v.columns:
        v = v.withColumn(order, F.lit(0))
    last = latest_status(v, "execution_id", order, ["status"]).withColumnRenamed("status", "_verdict")
    return executions.join(last, "execution_id", "left").withColumn(
        "verdict", F.coalesce("_verdict", F.lit("unknown"))).drop("_verdict")


def run_scores_view(executions: DataFrame, scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Executions JOIN scores LEFT JOIN verdicts on execution_id (several verdicts fan out)."""
    e = executions.select("execution_id", "run_id", "provider", F.col("configured_model").alias("model_name"))
    s = scores.select("execution_id", "metric_name", "numeric_score", "passed")
    v = verdicts.select("execution_id", F.col("status").alias("verdict_status"))
    return e.join(s, "execution_id").join(v, "execution_id", "left")


def run_result(executions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A5: per run - total, passed, failed (verdict fail), errored; completed_with_errors if any error."""
    j = executions.select("execution_id", "run_id", "status").join(
        verdicts.select("execution_id", F.col("status").alias("v")), "execution_id", "left")
    agg = j.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("v") == "pass").alias("passed"),
        F.count_if(F.col("v") == "fail").alias("failed"),
        F.count_if(F.col("status") != "completed").alias("errored"),
    )
    return agg.withColumn("run_status", F.when(F.col("errored") > 0, F.lit("completed_with_errors"))
                          .otherwise(F.lit("completed")))
