"""Run report: verdicts once, then several roll-ups from the same materialised table.

Executions-with-verdicts feeds KPIs, run results, the quality leaderboard and panels.  It is
checkpointed (a reliable checkpoint in the shared ``spark.checkpoint.dir``, never a local one)
so the roll-ups read a cut lineage: a lost executor recomputes from the checkpoint files, not
from the scans, joins and aggregations behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators import metrics, verdicts
from assay.session import checkpoint_dir


def run_report(executions: DataFrame, scores: DataFrame, rules: DataFrame,
               costed: DataFrame | None = None) -> dict[str, DataFrame]:
    checkpoint_dir(executions.sparkSession)
    done = executions.where(F.col("status") == "completed")
    v = verdicts.decide_verdict(scores, rules, done)
    ev = verdicts.execution_with_verdict(executions, v).checkpoint(eager=True)
    judged = ev.where(F.col("status") == "completed").withColumnRenamed("verdict", "status_v")
    vrows = judged.select("execution_id", "run_id", F.col("status_v").alias("status"))
    run_metrics = metrics.run_metrics(executions, costed)
    result = ev.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "pass").alias("passed"),
        F.count_if(F.col("verdict") == "fail").alias("failed"),
        F.count_if(F.col("status") != "completed").alias("errored"))
    return {
        "executions_with_verdicts": ev,
        "kpis": metrics.run_kpis(vrows, run_metrics),
        "result": result.withColumn("run_status", F.when(F.col("errored") > 0, "completed_with_errors")
                                    .otherwise("completed")),
        "leaderboard": metrics.leaderboard_quality(ev),
    }
