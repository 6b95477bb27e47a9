"""SRC-1 case files (JSONL per category) and P1 case-file validation.

Files are read with the splittable text source, so a file may be of any size and a line is the
largest unit a task holds.  A line's number is its place in its block plus the lines of the
file's earlier blocks: one count per block, prefix-summed per file.  Parsing and validation
are JSON functions in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.operators.cumulative import materialised

CASE_SCHEMA = (
    "id string, version int, category string, subcategory string, description string, "
    "messages array<struct<role:string,content:string>>, "
    "expected struct<must_contain:array<string>,must_not_contain:array<string>,expected_behavior:string,json_schema:string>, "
    "follow_up_messages array<struct<role:string,content:string>>, tags array<string>, risk_level string"
)
# Fields every case line must carry.
REQUIRED_FIELDS = ("category", "expected", "id", "messages", "subcategory", "version")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line_no, value) of every line of the text files at ``path``, numbered from 1 per file."""
    # rows of a block are read in order by one task, so row numbers within it differ by line
    rows = spark.read.option("lineSep", "\n").text(path).select(
        "value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("file_path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("file_path", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # one row per block, written so that Spark knows how few they are: the lines stay where they were read
    joined = rows.join(materialised(placed, "file-blocks"), ["file_path", "_block"])
    return joined.select("file_path", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


def case_lines(spark: SparkSession, root: str, pattern: str = "*/*.jsonl") -> DataFrame:
    """(category_dir, file_name, line_no, line) for every non-blank, non-comment line."""
    lines = numbered_lines(spark, f"{root.rstrip('/')}/{pattern}")
    out = lines.select(
        F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("category_dir"),
        F.regexp_extract("file_path", r"([^/]+)$", 1).alias("file_name"), "line_no",
        F.trim(F.regexp_replace("value", "\r$", "")).alias("line"))
    return out.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def scan_cases_jsonl(spark: SparkSession, root: str, pattern: str = "*/*.jsonl") -> DataFrame:
    """SRC-1: parsed cases with the loader's defaults (version 1, description "", tags [], risk low)."""
    lines = case_lines(spark, root, pattern)
    p = lines.withColumn("c", F.from_json("line", CASE_SCHEMA))
    empty = F.array().cast("array<string>")
    return p.select(
        "category_dir", "file_name", "line_no",
        F.col("c.id").alias("id"), F.coalesce("c.version", F.lit(1)).alias("version"),
        F.col("c.category").alias("category"), F.col("c.subcategory").alias("subcategory"),
        F.coalesce("c.description", F.lit("")).alias("description"), F.col("c.messages").alias("messages"),
        F.coalesce("c.expected.must_contain", empty).alias("must_contain"),
        F.coalesce("c.expected.must_not_contain", empty).alias("must_not_contain"),
        F.coalesce("c.expected.expected_behavior", F.lit("")).alias("expected_behavior"),
        F.col("c.expected.json_schema").alias("json_schema"),
        (F.coalesce(F.col("c.expected.json_schema"), F.lit("")) != "").alias("has_json_schema"),
        F.coalesce("c.follow_up_messages", F.array().cast("array<struct<role:string,content:string>>"))
        .alias("follow_up_messages"),
        F.coalesce("c.tags", empty).alias("tags"), F.coalesce("c.risk_level", F.lit("low")).alias("risk_level"),
    )


def _keys(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def validate_cases(spark: SparkSession, root: str, pattern: str = "*/*.jsonl") -> DataFrame:
    """One error row per problem: JSON parse error, each missing required field, messages not a list."""
    lines = case_lines(spark, root, pattern)
    v = lines.withColumn("_v", F.try_parse_json("line"))
    keys = _keys(F.col("_v"))
    case_id = F.coalesce(F.try_variant_get(F.col("_v"), "$.id", "string"), F.lit("?"))
    parse_err = F.when(F.col("_v").isNull(), F.array(F.lit("JSON parse error")))
    missing = F.transform(F.array_sort(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_FIELDS]), keys)),
                          lambda k: F.concat(F.lit("missing field '"), k, F.lit("' in case '"), case_id, F.lit("'")))
    msg_type = F.schema_of_variant(F.try_variant_get(F.col("_v"), "$.messages", "variant"))
    not_list = F.when(F.array_contains(keys, "messages") & ~msg_type.startswith("ARRAY"),
                      F.array(F.lit("'messages' must be a list")))
    errors = F.coalesce(parse_err, F.concat(missing, F.coalesce(not_list, F.array().cast("array<string>"))))
    return v.select("file_name", "line_no", F.explode(errors).alias("error"))


def load_order(cases: DataFrame) -> DataFrame:
    """Cases in the loader's order (category, file name, line) - for W1's per-category limit."""
    return cases.orderBy("category_dir", "file_name", "line_no")
