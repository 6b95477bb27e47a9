"""Run accounting: percentiles (W7), run metrics (A4), KPIs (A3), quality leaderboard (A2, W6, L4),
request counters (A16, P5), latency histogram (A17), models per provider (A18), panels (A19),
recent lists (L1, L2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.money import usd_sum
from assay.operators.cumulative import running_sum

# Telemetry label sets and latency histogram bounds (seconds).
ALLOWED_STATUSES = ("success", "failed", "errored", "timeout", "cancelled")
ALLOWED_RETRY_REASONS = ("rate_limit", "connection", "timeout", "server_error")
LATENCY_BUCKETS_S = (0.1, 0.25, 0.5, 1, 2, 5, 10, 20, 60)


def cumulative_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group..., value, _c, _cum, _n): per distinct value its count, the running count in value
    order, and the group size.  The counts are a partial aggregate (a hot group shrinks to its
    distinct values before the shuffle) and the running count uses range slices, so neither
    a hot group nor one with very many distinct values lands in a single task."""
    g = list(group)
    if not g:  # one global group: a constant key keeps the size lookup an equi-join
        df, g = df.withColumn("_all", F.lit(0)), ["_all"]
    hist = df.where(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sum(hist, g, [value], "_c", "_cum")
    sizes = hist.groupBy(*g).agg(F.sum("_c").alias("_n"))
    out = cum.join(sizes, g)
    return out.drop("_all") if "_all" in g else out


def rank_percentile(df: DataFrame, group: Sequence[str], value: str, p: float, out: str) -> DataFrame:
    """The k-th order statistic, k = floor(n * p) (zero-based), no interpolation."""
    return rank_percentiles(df, group, value, {out: p})


def rank_percentiles(df: DataFrame, group: Sequence[str], value: str, outs: dict[str, float]) -> DataFrame:
    """W7 for several p at once: for each, the first value whose running count exceeds
    floor(n * p), read from one set of cumulative value counts (exact, skew-proof)."""
    g = list(group)
    ranked = cumulative_counts(df, g, value)
    aggs = [F.min(F.when(F.col("_cum") > F.floor(F.col("_n").cast("double") * F.lit(float(p))), F.col(value)))
            .alias(name) for name, p in outs.items()]
    return ranked.groupBy(*g).agg(*aggs) if g else ranked.agg(*aggs)


def run_metrics(executions: DataFrame, costed: DataFrame | None = None) -> DataFrame:
    """A4: per run - successes, errors, tokens, cost (round 6), p50, p95 (rank pick), error map.

    The error map ("provider.error_type" -> count) is emitted as a sorted
    ``key:count`` list string; ``run_error_counts`` gives it as rows.
    """
    src = costed if costed is not None else executions.withColumn("cost_usd", F.lit(0.0))
    ok = F.col("status") == "completed"
    base = src.groupBy("run_id").agg(
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("error_count"),
        F.sum(F.when(ok, F.col("input_tokens") + F.col("output_tokens")).otherwise(F.lit(0))).alias("total_tokens"),
        usd_sum(F.when(ok, F.col("cost_usd")).otherwise(F.lit(0.0))).alias("total_cost_usd"),
    )
    done = src.where(ok)
    pct = rank_percentiles(done, ["run_id"], "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    errs = run_error_counts(src).groupBy("run_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "error_key", F.col("n").cast("string")))))
        .alias("provider_errors"))
    return (base.join(pct, "run_id", "left").join(errs, "run_id", "left")
            .select("run_id", "success_count", "error_count", "total_tokens", "total_cost_usd",
                    F.coalesce("p50_latency_ms", F.lit(0)).alias("p50_latency_ms"),
                    F.coalesce("p95_latency_ms", F.lit(0)).alias("p95_latency_ms"),
                    F.coalesce("provider_errors", F.lit("")).alias("provider_errors")))


def run_error_counts(executions: DataFrame) -> DataFrame:
    """A4 error map as rows: (run_id, "provider.error_type", n)."""
    return (executions.where(F.col("status") != "completed")
            .groupBy("run_id", F.concat_ws(".", "provider", "error_type").alias("error_key"))
            .agg(F.count(F.lit(1)).alias("n")))


def run_kpis(verdicts_by_exec: DataFrame, metrics: DataFrame) -> DataFrame:
    """A3: per run - pass/fail/warn counts, total verdicts, pass rate (1 decimal, 0 if none), tokens, cost, p50."""
    v = verdicts_by_exec.groupBy("run_id").agg(
        F.count_if(F.col("status") == "pass").alias("pass_count"),
        F.count_if(F.col("status") == "fail").alias("fail_count"),
        F.count_if(F.col("status") == "warn").alias("warn_count"),
        F.count(F.col("status")).alias("total_verdicts"),
    )
    rate = F.when(F.col("total_verdicts") > 0,
                  F.round(F.col("pass_count") / F.col("total_verdicts") * F.lit(100.0), 1)).otherwise(F.lit(0.0))
    return v.withColumn("pass_rate_pct", rate).join(
        metrics.select("run_id", "total_tokens", "total_cost_usd", "p50_latency_ms"), "run_id", "left")


def leaderboard_quality(exec_verdicts: DataFrame) -> DataFrame:
    """A2 + W6 + L4: per model - total, pass, fail (everything else), pass rate, mean of non-zero
    latencies (rounded to an integer), tokens of rows with input tokens; ranked by pass rate.

    The rank is a window over the per-model result (one row per model - bounded by the
    model catalogue), tie-broken by model name.
    """
    is_pass = F.col("verdict") == "pass"
    ev = exec_verdicts.where(F.col("configured_model").isNotNull()).withColumnRenamed("configured_model", "model")
    # provider = the one seen first for the model: earliest time per (model, provider) with a hash
    # aggregate, then the pick on that small table (ties on time go to the smaller provider name)
    first_seen = ev.groupBy("model", "provider").agg(F.min("request_ts").alias("_t")).groupBy("model").agg(
        F.min_by("provider", F.struct("_t", "provider")).alias("provider"))
    agg = ev.groupBy("model").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_pass).alias("pass_count"),
        F.count_if(~is_pass).alias("fail_count"),
        F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("_lat"),
        F.sum(F.when(F.coalesce(F.col("input_tokens"), F.lit(0)) != 0,
                     F.col("input_tokens") + F.coalesce(F.col("output_tokens"), F.lit(0)))).alias("_tok"),
    )
    rate = F.col("pass_count") / F.col("total")
    out = agg.join(first_seen, "model").select(
        "model", "provider", "total", "pass_count", "fail_count",
        F.round(rate * F.lit(100.0), 1).alias("pass_rate_pct"),
        F.round("_lat").cast("bigint").alias("avg_latency_ms"),
        F.coalesce("_tok", F.lit(0)).cast("bigint").alias("tokens"),
        rate.alias("_rate"),
    )
    w = Window.orderBy(F.col("_rate").desc(), F.col("model"))
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).drop("_rate")


def normalise_labels(status: Column, reason: Column | None = None) -> tuple[Column, Column | None]:
    """P5: status outside the allowed set -> 'errored'; retry reason outside four values -> 'other'."""
    s = F.when(status.isin(*ALLOWED_STATUSES), status).otherwise(F.lit("errored"))
    r = None if reason is None else F.when(reason.isin(*ALLOWED_RETRY_REASONS), reason).otherwise(F.lit("other"))
    return s, r


def request_counters(events: DataFrame) -> DataFrame:
    """Counters as long rows (provider, model, metric, label, value).

    ``events`` carries provider, model, status (request status label), retry_reason
    (nullable), input_tokens, output_tokens, cost_usd.  requests by status, retries by
    reason, tokens by direction (negatives -> 0), cost (negatives -> 0).  One aggregate
    per counter family, then unioned.
    """
    st, rr = normalise_labels(F.col("status"), F.col("retry_reason"))
    e = events.withColumn("_st", st).withColumn("_rr", rr)
    req = e.groupBy("provider", "model", F.col("_st").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit("requests"))
    ret = e.where(F.col("retry_reason").isNotNull()).groupBy("provider", "model", F.col("_rr").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit("retries"))
    tok = e.groupBy("provider", "model").agg(
        F.sum(F.greatest(F.col("input_tokens"), F.lit(0))).cast("double").alias("input"),
        F.sum(F.greatest(F.col("output_tokens"), F.lit(0))).cast("double").alias("output"),
    ).select("provider", "model", F.expr("stack(2, 'input', input, 'output', output) AS (label, value)")
             ).withColumn("metric", F.lit("tokens"))
    cost = e.groupBy("provider", "model").agg(
        usd_sum(F.greatest(F.col("cost_usd"), F.lit(0.0))).alias("value")).withColumn(
        "label", F.lit("usd")).withColumn("metric", F.lit("cost"))
    cols = ["provider", "model", "metric", "label", "value"]
    return req.select(cols).unionByName(ret.select(cols)).unionByName(tok.select(cols)).unionByName(cost.select(cols))


def latency_histogram(df: DataFrame, group: Sequence[str] = ("provider", "model"),
                      latency_ms: str = "latency_ms", bounds=LATENCY_BUCKETS_S) -> DataFrame:
    """Cumulative ``le`` buckets per group (+Inf = count), as rows (group..., le, count).

    One aggregate with one ``count_if`` per bound (no row explosion before the shuffle),
    then ``stack`` to long form.
    """
    g = list(group)
    secs = F.col(latency_ms).cast("double") / F.lit(1000.0)
    aggs = [F.count_if(secs <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(F.lit(1)).alias("_inf"))
    wide = df.groupBy(*g).agg(*aggs)
    labels = [str(float(b)) for b in bounds] + ["+Inf"]
    cols = [f"_b{i}" for i in range(len(bounds))] + ["_inf"]
    stack = ", ".join(f"'{lab}', {c}" for lab, c in zip(labels, cols))
    return wide.select(*g, F.expr(f"stack({len(cols)}, {stack}) AS (le, bucket_count)"))


def models_per_provider(executions: DataFrame) -> DataFrame:
    """Number of models seen per provider."""
    return executions.groupBy("provider").agg(F.count_distinct("configured_model").alias("model_count"))


def recent_executions(exec_verdicts: DataFrame, n: int = 10) -> DataFrame:
    """L2: first n executions (by request time, id) with their verdict."""
    return exec_verdicts.orderBy("request_ts", "execution_id").limit(n)


def recent_runs(executions: DataFrame, n: int = 50) -> DataFrame:
    """L1: runs by start time desc, top n (TakeOrderedAndProject)."""
    runs = executions.groupBy("run_id").agg(F.min("request_ts").alias("started_at"),
                                            F.count(F.lit(1)).alias("executions"))
    return runs.orderBy(F.col("started_at").desc(), "run_id").limit(n)
