"""Judge ensembles: weights (J7) and consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("weighted_majority", "consensus", "unanimous")


def judge_weight(weights: dict[str, float] | None, judge_col: str = "judge_id") -> Column:
    """Weight by judge id (literal map from configuration), default 1.0; negative -> runtime error."""
    weights = weights or {}
    if weights:
        m = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
        w = F.coalesce(m[F.col(judge_col)], F.lit(1.0))
    else:
        w = F.lit(1.0)
    return F.when(w < 0, F.raise_error(F.concat(F.lit("Invalid negative weight for judge "), F.col(judge_col)))
                  .cast("double")).otherwise(w)


def ensemble_consolidate(results: DataFrame, subjects: DataFrame | None = None,
                         weights: dict[str, float] | None = None, strategy: str = "weighted_majority",
                         subject_col: str = "subject_id") -> DataFrame:
    """One ensemble verdict per subject.

    weighted_majority: pass when passed weight > half the total, fail when below, on a tie
    pass iff mean score >= 0.5 (``tie_broken``); consensus / unanimous: pass iff every judge
    passed.  final_score = mean score; agreement = max(p, n - p) / n; disagreement when
    judges split.  Subjects with no results fail closed (via left join from ``subjects``).
    One aggregate per subject: partial aggregation before the shuffle.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unsupported ensemble strategy: {strategy!r}")
    r = results.withColumn("_w", judge_weight(weights))
    agg = r.groupBy(subject_col).agg(
        F.count(F.lit(1)).alias("total_judges"),
        F.count_if("passed").alias("pass_count"),
        F.sum("_w").alias("total_weight"),
        F.sum(F.when(F.col("passed"), F.col("_w")).otherwise(F.lit(0.0))).alias("passed_weight"),
        F.avg("score").alias("final_score"),
    )
    half = F.col("total_weight") / 2.0
    if strategy == "weighted_majority":
        passed = (F.when(F.col("passed_weight") > half, F.lit(True)).when(F.col("passed_weight") < half, F.lit(False))
                  .otherwise(F.col("final_score") >= 0.5))
        tie = (F.col("passed_weight") == half)
    else:
        passed = F.col("pass_count") == F.col("total_judges")
        tie = F.lit(False)
    n, p = F.col("total_judges"), F.col("pass_count")
    out = agg.select(
        subject_col, passed.alias("passed"), F.round("final_score", 6).alias("final_score"),
        F.lit(strategy).alias("strategy"),
        F.round(F.greatest(p, n - p) / n, 6).alias("agreement_ratio"),
        ((p > 0) & (p < n)).alias("disagreement_reported"), tie.alias("tie_broken"),
        "total_judges", F.round("passed_weight", 6).alias("passed_weight"), F.round("total_weight", 6).alias("total_weight"),
    )
    if subjects is None:
        return out
    base = subjects.select(subject_col).distinct()
    j = base.join(out, subject_col, "left")
    empty = F.col("total_judges").isNull()
    return j.select(
        subject_col,
        F.when(empty, F.lit(False)).otherwise(F.col("passed")).alias("passed"),
        F.when(empty, F.lit(0.0)).otherwise(F.col("final_score")).alias("final_score"),
        F.lit(strategy).alias("strategy"),
        F.when(empty, F.lit(0.0)).otherwise(F.col("agreement_ratio")).alias("agreement_ratio"),
        F.when(empty, F.lit(True)).otherwise(F.col("disagreement_reported")).alias("disagreement_reported"),
        F.when(empty, F.lit(False)).otherwise(F.col("tie_broken")).alias("tie_broken"),
        F.coalesce("total_judges", F.lit(0)).alias("total_judges"),
        F.coalesce("passed_weight", F.lit(0.0)).alias("passed_weight"),
        F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"),
    )
