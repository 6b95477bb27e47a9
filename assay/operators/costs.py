"""Cost operators: longest-prefix pricing (J3/L6), re-pricing (A13), pre-flight estimates (A12),
spend summaries (A11), running spend (W8) and exact budget admission (W8b)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.money import request_cost, usd_exact, usd_round, usd_sum
from assay.operators.cumulative import materialised, running_sums
from assay.sources.dims import Budget


def price_by_longest_prefix(df: DataFrame, model_col: str, pricing: DataFrame,
                            prefix: str = "") -> DataFrame:
    """Attach the prices of the longest registered model name that prefixes ``model_col``.

    An exact name is its own longest prefix, so one rule covers both steps of the
    reference lookup; no match prices at 0.  The price table is a configuration dimension: it
    is folded into one array (a scalar subquery, run once with the query) and each row picks
    its longest prefix from it, so there is one scan of ``df`` and no join or extra job.
    """
    entry = F.struct(F.length("model_name").alias("size"), "model_name", "input_per_million", "output_per_million")
    entries = pricing.where(F.col("model_name").isNotNull()).agg(F.collect_list(entry).alias("entries")).scalar()
    fitting = F.filter("_entries", lambda e: F.startswith(F.col(model_col), e["model_name"]))
    priced = df.withColumn("_entries", entries).withColumn("_price", F.array_max(fitting))
    return priced.withColumns({
        f"{prefix}priced_as": F.col("_price.model_name"),
        f"{prefix}input_per_million": F.col("_price.input_per_million"),
        f"{prefix}output_per_million": F.col("_price.output_per_million")}).drop("_price", "_entries")


def with_cost(executions: DataFrame, pricing: DataFrame, model_col: str = "returned_model",
              out: str = "cost_usd") -> DataFrame:
    """Executions + ``cost_usd`` (SCL-1 on longest-prefix prices)."""
    priced = price_by_longest_prefix(executions, model_col, pricing)
    return priced.withColumn(
        out, request_cost("input_tokens", "output_tokens", "input_per_million", "output_per_million")
    ).drop("priced_as", "input_per_million", "output_per_million")


def leaderboard_cost(executions: DataFrame, pricing: DataFrame) -> DataFrame:
    """A1 (+J2, L3): completed executions per (provider, model): count, mean latency, tokens, cost.

    One partial+final aggregate; ordered by execution count desc with a name tie-break.
    """
    done = with_cost(executions.where(F.col("status") == "completed"), pricing)
    return (
        done.groupBy("provider", F.col("configured_model").alias("model_name"))
        .agg(
            F.count(F.lit(1)).alias("total_execs"),
            F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
            usd_sum("cost_usd").alias("total_cost"),
        )
        .orderBy(F.col("total_execs").desc(), "provider", "model_name")
    )


def reprice_executions(executions: DataFrame, pricing: DataFrame) -> DataFrame:
    """A13 / SET-5: re-price completed executions by the model that actually answered.

    The stored cost is what the configured model's price gave; the new cost prices the
    returned model by longest prefix.  Per run: rows evaluated, rows changed, old and new
    totals, and the sorted set of models re-priced to zero.  (Writing back = writing a
    new table version with ``cost_usd`` replaced; never row updates.)
    """
    done = executions.where(F.col("status") == "completed")
    old = with_cost(done, pricing, model_col="configured_model", out="old_cost")
    both = with_cost(old, pricing, model_col="returned_model", out="new_cost")
    changed = F.col("old_cost") != F.col("new_cost")
    return both.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows_evaluated"),
        F.count_if(changed).alias("rows_changed"),
        usd_sum("old_cost").alias("old_total_usd"),
        usd_sum("new_cost").alias("new_total_usd"),
        F.concat_ws(",", F.array_sort(F.collect_set(
            F.when(changed & (F.col("new_cost") == 0.0), F.col("returned_model"))))).alias("unmatched_models"),
    )


def backfill_costs(spark: SparkSession, path: str, pricing: DataFrame, dry_run: bool = False,
                   cost_col: str = "estimated_cost_usd", model_col: str = "returned_model") -> DataFrame:
    """A13 with write-back: re-price the completed executions stored at ``path`` (Parquet by ``run_id``) by the
    current prices and store the costs that changed.  Returns the report per run.

    Only partitions of runs with a changed cost are written again (dynamic partition overwrite), all
    others keep their files.  The new rows are materialised first, so the table is never read
    while it is replaced; ``dry_run`` gives the same report and writes nothing.
    """
    stored = spark.read.parquet(path)
    done = F.col("status") == "completed"
    priced = with_cost(stored, pricing, model_col, "_new").withColumn("_changed", F.coalesce(done & ~F.col(cost_col).eqNullSafe(F.col("_new")), F.lit(False)))
    unmatched = F.collect_set(F.when(F.col("_changed") & (F.col("_new") == 0.0), F.col(model_col)))
    report = materialised(priced.groupBy("run_id").agg(
        F.count_if(done).alias("rows_evaluated"), F.count_if("_changed").alias("rows_changed"),
        usd_round(F.sum(F.when(done, usd_exact(F.coalesce(F.col(cost_col), F.lit(0.0)))).otherwise(0))).alias("old_total_usd"),
        usd_round(F.sum(F.when(done, usd_exact("_new")).otherwise(0))).alias("new_total_usd"),
        F.concat_ws(",", F.array_sort(unmatched)).alias("unmatched_models")), "backfill-report")
    if not dry_run:
        runs = report.where("rows_changed > 0").select("run_id")
        new = F.when(F.col("_changed"), F.col("_new")).otherwise(F.col(cost_col))
        rows = priced.join(runs, "run_id", "left_semi").withColumn(cost_col, new).select(*stored.columns)
        materialised(rows, "backfill-rows").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "run_id").parquet(path)
    return report


def preflight_estimate(plan: DataFrame, models: DataFrame, budget: Budget,
                       avg_input_tokens: int = 500, max_output_tokens: int = 800,
                       attempts: int = 2) -> DataFrame:
    """Worst-case pre-flight cost per (run, provider) and breach flags.

    Cases = planned items of the run for the provider; the provider's first model
    (lowest ``model_no``) is priced by longest prefix at (500 in, 800 out) tokens,
    times cases times attempts, rounded to 6.  Each provider is checked against zero
    spend, as the reference does.
    """
    first_model = models.groupBy("provider").agg(F.min_by("model_name", "model_no").alias("first_model"))
    priced = price_by_longest_prefix(first_model, "first_model",
                                     models.select("model_name", "input_per_million", "output_per_million"))
    per_req = priced.select(
        "provider", "first_model",
        request_cost(F.lit(avg_input_tokens), F.lit(max_output_tokens), "input_per_million", "output_per_million")
        .alias("per_request_usd"))
    cases = plan.groupBy("run_id", "provider").agg(F.count(F.lit(1)).alias("num_cases"))
    # per_req has one row per configured provider: bounded by configuration.
    est = cases.join(per_req, "provider").withColumn(
        "estimated_usd", F.round(F.col("per_request_usd") * F.col("num_cases") * F.lit(attempts), 6))
    return est.select(
        "run_id", "provider", "first_model", "num_cases", "estimated_usd",
        F.coalesce(F.col("estimated_usd") > budget.cap_of("provider"), F.lit(False)).alias("provider_breach"),
        (F.col("estimated_usd") > F.lit(budget.effective_global_cap)).alias("global_breach"),
    )


def spend_summary(costed: DataFrame, budget: Budget) -> DataFrame:
    """Spend per provider and in total (one ``rollup`` pass), with caps.

    The total row has ``scope = 'global'``, the global cap and the effective cap (cap - reserve).
    """
    rolled = costed.rollup("provider").agg(usd_sum("cost_usd").alias("spend_usd"), F.grouping_id().alias("_g"))
    is_global = F.col("_g") == 1
    cap = budget.cap_of("provider")
    return rolled.select(
        F.when(is_global, F.lit("global")).otherwise(F.lit("provider")).alias("scope"),
        F.when(is_global, F.lit(None)).otherwise(F.col("provider")).alias("provider"),
        "spend_usd",
        F.when(is_global, F.lit(budget.global_cap)).otherwise(cap).alias("cap_usd"),
        F.when(is_global, F.lit(budget.effective_global_cap)).otherwise(cap).alias("effective_cap_usd"),
    )


def cumulative_spend(costed: DataFrame, budget: Budget, ts_col: str = "request_ts",
                     id_col: str = "execution_id") -> DataFrame:
    """Running spend per provider and overall in (ts, id) order, with breach flags.

    Sums are exact decimals; the running sums use quantile slices (no single-task window per provider).
    """
    exact = costed.withColumn("_usd", usd_exact("cost_usd"))
    both = running_sums(exact, [ts_col, id_col], [(["provider"], "_usd", "_p"), ([], "_usd", "_g")])
    return both.select(
        id_col, "provider", ts_col, "cost_usd",
        usd_round("_p").alias("provider_spend_usd"),
        usd_round("_g").alias("global_spend_usd"),
        F.coalesce(F.col("_p") > budget.cap_of("provider") * F.lit(1e8), F.lit(False)).alias("provider_breach"),
        (F.col("_g") > F.lit(budget.effective_global_cap * 1e8)).alias("global_breach"),
    )


_ADMIT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("execution_id", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("admitted", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("provider_spend_usd", T.DoubleType()),
    T.StructField("global_spend_usd", T.DoubleType()),
])


def admission_fold(caps: dict[str, float], effective_global_cap: float):
    """The W8b fold over one partition holding whole runs in (run, ts, id) order.

    State is (spend per provider, global spend) of the current run - O(providers) memory;
    batches stream through, so a run of any size is processed without being collected.
    """

    def fn(batches):
        run = object()
        spend: dict[str, float] = {}
        total = 0.0
        for pdf in batches:
            admitted, reasons, pspend, gspend = [], [], [], []
            for r, p, c in zip(pdf["run_id"], pdf["provider"], pdf["cost_usd"]):
                if r != run:
                    run, spend, total = r, {}, 0.0
                c = float(c or 0.0)
                cur = spend.get(p, 0.0)
                if cur + c > caps.get(p, float("inf")):
                    ok, why = False, "provider_cap"
                elif total + c > effective_global_cap:
                    ok, why = False, "global_cap"
                else:
                    ok, why = True, None
                    spend[p] = cur + c
                    total += c
                admitted.append(ok)
                reasons.append(why)
                pspend.append(spend.get(p, 0.0))
                gspend.append(total)
            yield pd.DataFrame({
                "run_id": pdf["run_id"], "execution_id": pdf["execution_id"], "provider": pdf["provider"],
                "cost_usd": pdf["cost_usd"].astype("float64"), "admitted": admitted, "reason": reasons,
                "provider_spend_usd": pspend, "global_spend_usd": gspend,
            })

    return fn


def budget_admission(requests: DataFrame, caps: dict[str, float], effective_global_cap: float,
                     ts_col: str = "request_ts", id_col: str = "execution_id") -> DataFrame:
    """Exact budget gate per run.  A rejected request adds nothing, so later smaller ones may pass.

    Admission is a fold whose every step depends on the previous one, so it is
    parallel across runs only: rows are hash-partitioned by run, sorted by (ts, id)
    within the partition, and folded in one streaming pass per partition.
    """
    df = requests.select(F.col("run_id"), F.col(id_col).alias("execution_id"), "provider",
                         F.col("cost_usd").cast("double"), F.col(ts_col).alias("_ts"))
    ordered = df.repartition("run_id").sortWithinPartitions("run_id", "_ts", "execution_id").drop("_ts")
    return ordered.mapInPandas(admission_fold(caps, effective_global_cap), _ADMIT_SCHEMA)
