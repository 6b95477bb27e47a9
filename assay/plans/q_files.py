"""File-source queries over files that Spark writes from the driver tables: SRC-1 (case files)
and P1 (case-file validation)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from assay.plans.catalog import register
from assay.plans.fixtures import oracle
from assay.session import checkpoint_dir
from assay.sources import cases as C

CATEGORY_SQL = """CASE item_id % 6 WHEN 0 THEN 'tool_use_boundaries' WHEN 1 THEN 'prompt_robustness' WHEN 2 THEN 'context_isolation'
 WHEN 3 THEN 'long_context_behavior' WHEN 4 THEN 'content_integrity' ELSE 'guardrail_consistency' END"""


def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"files-{name}-{uuid.uuid4().hex}")


def _case_records(fx):
    b = fx.benchmark
    k = F.col("item_id")
    category = F.element_at(F.array(*[F.lit(c) for c in (
        "tool_use_boundaries", "prompt_robustness", "context_isolation", "long_context_behavior",
        "content_integrity", "guardrail_consistency")]), (k % 6 + 1).cast("int"))
    expected = F.struct(F.array(F.when(k % 3 == 0, F.col("text")).otherwise(F.split_part("text", F.lit(" "), F.lit(2))))
                        .alias("must_contain"),
                        F.when(k % 2 == 0, F.array(F.lit("i CANNOT"))).alias("must_not_contain"))
    rec = F.struct(
        F.concat(F.lit("case-"), k).alias("id"), F.when(k % 3 != 0, F.lit(2)).alias("version"),
        category.alias("category"), F.lit("sub").alias("subcategory"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
        expected.alias("expected"), F.when(k % 4 != 0, F.array(F.lit("t1"), F.lit("t2"))).alias("tags"),
        F.when(k % 5 == 0, F.lit("high")).alias("risk_level"))
    return b.select(k, F.to_json(rec).alias("value"))


@register("scan_cases_jsonl", oracle([], f"""
SELECT concat('case-', item_id) AS id, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 2 END AS version, {CATEGORY_SQL} AS category,
 'sub' AS subcategory, CASE WHEN item_id % 3 = 0 THEN text ELSE split_part(text, ' ', 2) END AS must_contain,
 CASE WHEN item_id % 2 = 0 THEN 'i CANNOT' ELSE '' END AS must_not_contain,
 CASE WHEN item_id % 4 = 0 THEN '' ELSE 't1,t2' END AS tags, CASE WHEN item_id % 5 = 0 THEN 'high' ELSE 'low' END AS risk_level,
 CAST(length(text) AS BIGINT) AS first_message_chars
FROM benchmark"""))
def q_scan_cases_jsonl(fx):
    """SRC-1: case JSONL files (written from benchmark, with comment and blank lines) loaded with defaults."""
    root = _scratch(fx.spark, "cases")
    lines = _case_records(fx).select("value").unionByName(
        fx.benchmark.where(F.col("item_id") % 7 == 0).select(F.lit("# generated case file").alias("value"))).unionByName(
        fx.benchmark.where(F.col("item_id") % 9 == 0).select(F.lit("   ").alias("value")))
    lines.write.text(os.path.join(root, "cases"))
    c = C.scan_cases_jsonl(fx.spark, root, "*/*.txt")
    return c.select("id", "version", "category", "subcategory", F.array_join("must_contain", ",").alias("must_contain"),
                    F.array_join("must_not_contain", ",").alias("must_not_contain"), F.array_join("tags", ",").alias("tags"),
                    "risk_level", F.length(F.col("messages")[0]["content"]).cast("bigint").alias("first_message_chars"))


@register("validate_cases", oracle([], """
SELECT 'JSON parse error' AS error FROM benchmark WHERE item_id % 5 = 0
UNION ALL SELECT 'missing field ''subcategory'' in case ''case-' || item_id || '''' FROM benchmark WHERE item_id % 5 = 1
UNION ALL SELECT '''messages'' must be a list' FROM benchmark WHERE item_id % 5 = 1
UNION ALL SELECT 'missing field ''' || f || ''' in case ''?''' FROM benchmark, unnest(['category', 'expected', 'id', 'messages', 'subcategory', 'version']) t(f)
 WHERE item_id % 5 = 2
UNION ALL SELECT 'missing field ''version'' in case ''case-' || item_id || '''' FROM benchmark WHERE item_id % 5 IN (3, 4) AND item_id % 3 = 0"""))
def q_validate_cases(fx):
    """Validation errors of case lines - broken JSON, missing fields, messages not a list."""
    root = _scratch(fx.spark, "validate")
    k = F.col("item_id")
    good = _case_records(fx)
    value = (F.when(k % 5 == 0, F.concat(F.lit('{"id": "case-'), k, F.lit('", ')))
             .when(k % 5 == 1, F.to_json(F.struct(F.concat(F.lit("case-"), k).alias("id"), F.lit(1).alias("version"),
                                                  F.lit("x").alias("category"), F.lit("oops").alias("messages"),
                                                  F.struct(F.lit("e").alias("expected_behavior")).alias("expected"))))
             .when(k % 5 == 2, F.lit('{"note": "no case fields"}'))
             .otherwise(F.col("value")))
    good.select(value.alias("value")).write.text(os.path.join(root, "cases"))
    return C.validate_cases(fx.spark, root, "*/*.txt").select("error")
