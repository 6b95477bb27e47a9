"""Sinks: result tables (SRC-6), run-status updates (SRC-7), run documents (SRC-8), manifests (SRC-9).

Writes are bulk DataFrame writes (one job per table), never row inserts; updates are new
rows resolved by "last write wins" (W10) on read.
"""

from __future__ import annotations

import json
import platform
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.hashing import config_hash
from assay.functions.text import text_preview
from assay.operators.verdicts import latest_status


def append_results(df: DataFrame, path: str, partition_by: str | None = "run_id") -> None:
    """SRC-6: append rows to a result table (parquet), partitioned by run so later reads prune."""
    w = df.write.mode("append")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def append_status(events: DataFrame, path: str) -> None:
    """SRC-7 write side: a status change is an appended event (run_id, ts, status, cost, reason)."""
    append_results(events, path, partition_by=None)


def current_run_status(events: DataFrame) -> DataFrame:
    """SRC-7 read side: the latest status event per run (``max_by``)."""
    return latest_status(events, "run_id", "ts", ["status", "ts", "actual_cost_usd", "failure_reason"])


def export_run_document(executions: DataFrame, scores: DataFrame, verdicts: DataFrame, metrics: DataFrame,
                        path: str) -> None:
    """SRC-8: the run document as a folder per run: ``metrics`` (one row), ``executions``
    (error or completed shape, text cut to 500 characters), ``scores`` and ``verdicts`` as JSON
    lines partitioned by run_id.  Every part is written by many tasks - a run of any size is
    never gathered into one row."""
    ok = F.col("status") == "completed"
    ex = executions.select(
        "run_id", "execution_id", "provider", F.col("configured_model").alias("model"), "status", "latency_ms",
        F.when(ok, F.col("input_tokens")).alias("input_tokens"), F.when(ok, F.col("output_tokens")).alias("output_tokens"),
        F.when(~ok, F.col("error_type")).alias("error_type"),
        *([F.when(ok, text_preview("text")).alias("text")] if "text" in executions.columns else []))
    metrics.write.mode("overwrite").partitionBy("run_id").json(f"{path}/metrics")
    ex.write.mode("overwrite").partitionBy("run_id").json(f"{path}/executions")
    scores.write.mode("overwrite").partitionBy("run_id").json(f"{path}/scores")
    verdicts.write.mode("overwrite").partitionBy("run_id").json(f"{path}/verdicts")


def build_manifest(executions: DataFrame, parameters: dict, benchmark_id: str, benchmark_version: str,
                   benchmark_fingerprint: str | None = None, git_commit: str = "unknown", seed: int | None = None) -> DataFrame:
    """SRC-9: one reproducibility row per run; config_hash = SHA-256 of the sorted-key JSON of the
    parameters (SCL-19); providers / models are the sorted distinct values seen in the run."""
    params = json.dumps(parameters, sort_keys=True)
    per_run = executions.groupBy("run_id").agg(
        F.array_sort(F.collect_set("provider")).alias("providers"),
        F.array_sort(F.collect_set("configured_model")).alias("models"))
    return per_run.select(
        "run_id", F.lit(git_commit).alias("git_commit"), F.lit(sys.version.split()[0]).alias("python_version"),
        F.lit(platform.platform()).alias("platform_info"), config_hash(F.lit(params)).alias("config_hash"),
        F.lit(benchmark_id).alias("benchmark_id"), F.lit(benchmark_version).alias("benchmark_version"),
        F.lit(benchmark_fingerprint).cast("string").alias("benchmark_fingerprint"), "providers", "models",
        F.lit(params).alias("parameters"), F.lit(seed).cast("bigint").alias("seed"))
