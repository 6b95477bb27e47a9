"""Plug-in contracts: judges (UDF-3) and user evaluator output (UDF-4).

A judge is any function DataFrame -> judge_results rows (subject_id, judge_id, passed,
score, reason).  A user evaluator runs as a ``mapInPandas`` producing a JSON text per row;
its output is validated here with JVM JSON functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.judge import judge_passed, parse_judge_output

JUDGE_COLUMNS = ["subject_id", "judge_id", "passed", "score", "reason"]
Judge = Callable[[DataFrame], DataFrame]


def judge_from_raw(raw: DataFrame, judge_id: str, subject_col: str = "subject_id", raw_col: str = "raw") -> DataFrame:
    """UDF-3: a judge whose model output is raw text: strict parse (SCL-10), pass derived locally
    (SCL-11); invalid output fails closed (passed = false, score = 0)."""
    p = raw.select(F.col(subject_col).alias("subject_id"), parse_judge_output(raw_col).alias("p"))
    return p.select("subject_id", F.lit(judge_id).alias("judge_id"),
                    F.coalesce(judge_passed(F.col("p.score")), F.lit(False)).alias("passed"),
                    F.coalesce(F.col("p.score"), F.lit(0.0)).alias("score"),
                    F.coalesce(F.col("p.reason"), F.col("p.error")).alias("reason"))


def run_judges(df: DataFrame, judges: dict[str, Judge]) -> DataFrame:
    """Apply several judges and union their rows (input to A7)."""
    parts = [fn(df).select(*JUDGE_COLUMNS) for fn in judges.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def user_evaluator_contract(df: DataFrame, output_col: str = "output") -> DataFrame:
    """UDF-4: validate user evaluator output JSON - an object with ``passed`` and a float-able
    ``score``; non-object ``details`` are wrapped as {"raw": ...}.  Adds valid / error / passed /
    score / details columns (errors are values, not exceptions)."""
    v = F.try_parse_json(F.col(output_col))
    obj = F.try_variant_get(v, "$", "map<string,variant>")
    keys = F.map_keys(obj)
    score = F.try_variant_get(v, "$.score", "double")
    details = F.try_variant_get(v, "$.details", "variant")
    details_json = F.when(details.isNull(), F.lit("{}")).when(
        F.schema_of_variant(details).startswith("OBJECT"), F.to_json(details)).otherwise(
        F.concat(F.lit('{"raw":'), F.to_json(details), F.lit("}")))
    error = (F.when(F.col(output_col).isNull() | (F.trim(F.col(output_col)) == ""), F.lit("empty output"))
             .when(v.isNull(), F.lit("output is not JSON"))
             .when(obj.isNull() | ~F.array_contains(keys, "passed") | ~F.array_contains(keys, "score"),
                   F.lit("missing required 'passed' or 'score' fields"))
             .when(score.isNull(), F.lit("'score' must be a valid float")))
    passed_any = F.try_variant_get(v, "$.passed", "boolean")
    return df.withColumn("valid", error.isNull()).withColumn("error", error).withColumn(
        "passed", F.when(error.isNull(), F.coalesce(passed_any, F.lit(True)))).withColumn(
        "score", F.when(error.isNull(), score)).withColumn("details", F.when(error.isNull(), details_json))
