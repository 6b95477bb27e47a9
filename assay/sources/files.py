"""File sources: integrity reports (SRC-10), artifact secret scan (SRC-11), raw provider payloads
(SRC-13, SCL-20) and the execution-event source (SRC-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import text as T
from assay.operators.requests import map_finish_reason
from assay.sources.tables import read_whole_files

REPORT_SCHEMA = ("schema_version string, generated_at string, suite string, total bigint, passed bigint, "
                 "failed bigint, resistance_score double, cases array<struct<case_id:string,passed:boolean>>, "
                 "_corrupt_record string")
REPORT_KEYS = ("cases", "failed", "generated_at", "passed", "resistance_score", "schema_version", "suite", "total")
# Artifact extensions scanned by default.
SCAN_EXTENSIONS = (".json", ".jsonl", ".yaml", ".yml", ".txt", ".log", ".md", ".html")


def scan_integrity_reports(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: report files, each read whole; malformed or schema-mismatched ones fail closed
    (``status`` = malformed / schema_mismatch) instead of failing the job."""
    files = read_whole_files(spark, path).select("file_path", "value")
    v = F.try_parse_json("value")
    keys = F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    parsed = files.select("file_path", v.alias("_v"), keys.alias("_keys"),
                          F.from_json("value", REPORT_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    status = (F.when(F.col("_v").isNull(), F.lit("malformed"))
              .when(~(F.col("_keys") == F.array(*[F.lit(k) for k in REPORT_KEYS])), F.lit("schema_mismatch"))
              .otherwise(F.lit("ok")))
    return parsed.select("file_path", status.alias("status"), "r.*").drop("_corrupt_record")


def report_cases(reports: DataFrame) -> DataFrame:
    """Report case arrays in long form (report_id = file path) for A14 / A20."""
    return reports.select(F.col("file_path").alias("report_id"), F.explode("cases").alias("c")).select(
        "report_id", F.col("c.case_id").alias("case_id"), F.col("c.passed").alias("passed"))


def scan_artifacts(spark: SparkSession, directory: str, extensions=SCAN_EXTENSIONS) -> DataFrame:
    """SRC-11: files under ``directory`` (recursive) with a scanned extension that hold a secret
    pattern; undecodable bytes are replaced; the first matching rule is reported."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
             .select("path", "content"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    text = F.make_valid_utf8(F.col("content").cast("string"))  # bad bytes become U+FFFD
    hits = files.where(ext.isin(*extensions)).select("path", T.first_secret(text).alias("pattern"))
    return hits.where(F.col("pattern").isNotNull())


# --- SRC-13: raw provider payloads ---------------------------------------------------------

OPENAI_SCHEMA = ("id string, model string, choices array<struct<message:struct<content:string,"
                 "tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>,"
                 "finish_reason:string>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>")
ANTHROPIC_SCHEMA = ("id string, model string, content array<struct<type:string,text:string,id:string,name:string,"
                    "input:string>>, stop_reason string, usage struct<input_tokens:bigint,output_tokens:bigint>")
GEMINI_SCHEMA = ("id string, model string, choices array<struct<message:struct<content:string>,finish_reason:string>>, "
                 "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>")
RESPONSE_COLUMNS = ["payload_id", "provider", "model", "text", "finish_reason", "tool_calls", "input_tokens",
                    "output_tokens", "total_tokens", "latency_ms", "error"]
CALLS = "array<struct<id:string,type:string,name:string,arguments:string>>"


def structured_text(content_json) -> F.Column:
    """SCL-20: message content that is a string, null, or a list of parts -> text (parts concatenated)."""
    c = F.col(content_json) if isinstance(content_json, str) else content_json
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    parts = F.try_variant_get(v, "$", "array<variant>")
    part_text = F.transform(parts, lambda p: F.coalesce(
        F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"), F.lit("")))
    return (F.when(c.isNull() | (kind == "VOID"), F.lit(""))
            .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            .when(kind.startswith("ARRAY"), F.array_join(part_text, ""))
            .otherwise(F.lit("")))


def normalise_raw_responses(raw: DataFrame) -> DataFrame:
    """SRC-13: raw provider payloads (payload_id, provider, payload JSON, latency_ms) -> one response shape.

    Chat-completion (openai / xai): first choice, null text -> "", missing usage -> 0.
    Anthropic: text blocks joined by newline, tool_use blocks -> calls, total = in + out, stop
    reason mapped.  Gemini (chat-completion shape): string or list content concatenated; no
    choices is an error.  Each family is a ``from_json`` with its schema, then ``unionByName``.
    """
    chat = raw.where(F.col("provider").isin("openai", "xai")).withColumn("p", F.from_json("payload", OPENAI_SCHEMA))
    first = F.try_element_at("p.choices", F.lit(1))
    calls = F.transform(F.coalesce(first["message"]["tool_calls"], F.array().cast(
        "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")),
        lambda t: F.struct(t["id"].alias("id"), t["type"].alias("type"), t["function"]["name"].alias("name"),
                           t["function"]["arguments"].alias("arguments")))
    chat_out = chat.select(
        "payload_id", "provider", F.col("p.model").alias("model"),
        F.coalesce(first["message"]["content"], F.lit("")).alias("text"), first["finish_reason"].alias("finish_reason"),
        calls.alias("tool_calls"),
        F.coalesce("p.usage.prompt_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("p.usage.completion_tokens", F.lit(0)).alias("output_tokens"),
        F.coalesce("p.usage.total_tokens", F.lit(0)).alias("total_tokens"), "latency_ms",
        F.when(F.size(F.coalesce("p.choices", F.array())) == 0, F.lit("no choices")).alias("error"))

    an = raw.where(F.col("provider") == "anthropic").withColumn("p", F.from_json("payload", ANTHROPIC_SCHEMA))
    blocks = F.coalesce(F.col("p.content"), F.array().cast(
        "array<struct<type:string,text:string,id:string,name:string,input:string>>"))
    an_out = an.select(
        "payload_id", "provider", F.col("p.model").alias("model"),
        F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))),
                     "\n").alias("text"),
        map_finish_reason(F.col("p.stop_reason")).alias("finish_reason"),
        F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(
            b["id"].alias("id"), F.lit("function").alias("type"), b["name"].alias("name"),
            b["input"].alias("arguments"))).alias("tool_calls"),
        F.coalesce("p.usage.input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("p.usage.output_tokens", F.lit(0)).alias("output_tokens"),
        (F.coalesce("p.usage.input_tokens", F.lit(0)) + F.coalesce("p.usage.output_tokens", F.lit(0))).alias("total_tokens"),
        "latency_ms", F.lit(None).cast("string").alias("error"))

    gm = raw.where(F.col("provider") == "google")

    def gemini_call(call):
        part = lambda path: F.try_variant_get(call, path, "string")
        return F.struct(part("$.id").alias("id"), part("$.type").alias("type"), part("$.function.name").alias("name"),
                        part("$.function.arguments").alias("arguments"))

    choices = F.try_variant_get(F.try_parse_json("payload"), "$.choices", "array<variant>")
    first_g = F.try_element_at(choices, F.lit(1))
    gm_out = gm.select(
        "payload_id", "provider", F.try_variant_get(F.try_parse_json("payload"), "$.model", "string").alias("model"),
        structured_text(F.to_json(F.try_variant_get(first_g, "$.message.content", "variant"))).alias("text"),
        F.try_variant_get(first_g, "$.finish_reason", "string").alias("finish_reason"),
        F.coalesce(F.transform(F.try_variant_get(first_g, "$.message.tool_calls", "array<variant>"), gemini_call),
                   F.array().cast(CALLS)).alias("tool_calls"),
        F.coalesce(F.try_variant_get(F.try_parse_json("payload"), "$.usage.prompt_tokens", "bigint"), F.lit(0))
        .alias("input_tokens"),
        F.coalesce(F.try_variant_get(F.try_parse_json("payload"), "$.usage.completion_tokens", "bigint"), F.lit(0))
        .alias("output_tokens"),
        F.coalesce(F.try_variant_get(F.try_parse_json("payload"), "$.usage.total_tokens", "bigint"), F.lit(0))
        .alias("total_tokens"),
        "latency_ms", F.when(F.coalesce(F.size(choices), F.lit(0)) == 0, F.lit("no choices")).alias("error"))
    return chat_out.select(RESPONSE_COLUMNS).unionByName(an_out.select(RESPONSE_COLUMNS)).unionByName(
        gm_out.select(RESPONSE_COLUMNS))


EVENT_SCHEMA = ("execution_id string, run_id string, request_ts timestamp, provider string, configured_model string, "
                "returned_model string, category string, status string, error_type string, latency_ms bigint, "
                "input_tokens bigint, output_tokens bigint")


def execution_event_source(spark: SparkSession, path: str, streaming: bool = True, files_per_trigger: int = 1000):
    """SRC-14: execution events (request / retry / usage / latency) as a stream from a parquet folder,
    or the same folder as a batch table for backfill - both feed the STR-* metrics."""
    if streaming:
        return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return spark.read.schema(EVENT_SCHEMA).parquet(path)
