"""Text-hygiene queries over whole documents: SCL-2, SCL-3, SCL-5, SCL-6, SCL-7, SCL-8, SCL-17, SCL-18."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from assay.functions import text as T
from assay.plans.catalog import register
from assay.plans.fixtures import oracle
from assay.plans.q_files import _scratch
from assay.sources.config import Redaction


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _redact_sql(expr: str) -> str:
    out = expr
    for _n, p, r in T.REDACTION_RULES:
        out = f"regexp_replace({out}, {_q(p)}, {_q(r)}, 'g')"
    return out


CTRL = _q(T.CONTROL_CHARS)


@register("redact_text", oracle([], f"SELECT doc_id, {_redact_sql('text')} AS redacted FROM documents"))
def q_redact_text(fx):
    """SCL-5: ordered secret / PII redaction of whole documents."""
    return fx.documents.select("doc_id", T.redact_text("text").alias("redacted"))


@register("first_secret", oracle([], "SELECT doc_id, CASE " + " ".join(
    f"WHEN regexp_matches(text, {_q(p)}) THEN '{n}'" for n, p, _ in T.REDACTION_RULES)
    + " END AS first_secret, NOT (" + " OR ".join(f"regexp_matches(text, {_q(p)})" for _, p, _ in T.REDACTION_RULES)
    + ") AS is_clean FROM documents"))
def q_first_secret(fx):
    """SCL-6: first matching secret pattern per document, and the clean flag."""
    return fx.documents.select("doc_id", T.first_secret("text").alias("first_secret"), T.is_clean("text").alias("is_clean"))


@register("secret_guard", oracle([], f"SELECT doc_id, regexp_matches(text, {_q(T.SECRET_GUARD_PATTERN)}) AS has_secret FROM documents"))
def q_secret_guard(fx):
    """SCL-8: documents holding a secret that must never enter a decision record."""
    return fx.documents.select("doc_id", T.secret_guard("text").alias("has_secret"))


@register("normalise_text", oracle([], f"""
SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars FROM (
 SELECT doc_id, CASE WHEN length(c) > 64000 THEN left(c, 64000) || chr(10) || chr(10) || '[RESPONSE TRUNCATED]' ELSE c END AS t
 FROM (SELECT doc_id, regexp_replace(nfc_normalize(text), {CTRL}, '', 'g') AS c FROM documents) a) b"""))
def q_normalise_text(fx):
    """SCL-2: NFC, control characters removed, cut to 64 000 characters + marker (whole texts)."""
    d = T.normalised_column(fx.documents.select("doc_id", "text"), "text", "_t")
    return d.select(
        "doc_id", F.md5("_t").alias("text_md5"), F.length("_t").cast("bigint").alias("n_chars"))


@register("sanitize_output", oracle([], f"""
SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (
 SELECT page_id, CASE WHEN length(c) > 64000 THEN left(c, 64000) || chr(10) || chr(10) || '[TRUNCATED]' ELSE c END AS t
 FROM (SELECT page_id, regexp_replace(nfc_normalize(html), {CTRL}, '', 'g') AS c FROM pages) a) b"""))
def q_sanitize_output(fx):
    """SCL-3: the output sanitizer (NFC, control characters, 64 000-character cap) on whole raw pages."""
    p = T.normalised_column(fx.pages.select("page_id", "html"), "html", "_t", T.MAX_CHARS, T.SANITIZE_TRUNCATED)
    return p.select(
        "page_id", F.md5("_t").alias("text_md5"), F.length("_t").cast("bigint").alias("n_chars"))


@register("text_preview", oracle([], "SELECT doc_id, left(text, 500) AS preview FROM documents"))
def q_text_preview(fx):
    """SCL-17: first 500 characters."""
    return fx.documents.select("doc_id", T.text_preview("text").alias("preview"))


@register("tag_values", oracle(["test_cases"], """
SELECT id, array_to_string(list_transform(list_filter(string_split(tags_csv, ','), lambda t: starts_with(t, 'denied-tool:')),
 lambda t: replace(t, 'denied-tool:', '')), ',') AS denied_tools FROM test_cases"""))
def q_tag_values(fx):
    """SCL-18: values of the ``denied-tool:`` tags per case."""
    return fx.test_cases.select("id", F.array_join(T.tag_values(F.split("tags_csv", ","), "denied-tool:"), ",")
                                .alias("denied_tools"))


@register("redact_fields", oracle([], f"""
SELECT event_id, '[REDACTED]' AS api_key, {_redact_sql("concat('contact ', 'user', event_id % 40, '@example.org ', props)")} AS note,
 event_type AS kind FROM events"""))
def q_redact_fields(fx):
    """SCL-7: sensitive keys of an attribute map replaced, other values pattern-redacted."""
    m = F.create_map(F.lit("API_Key"), F.concat(F.lit("sk-"), F.md5(F.col("event_id").cast("string"))),
                     F.lit("note"), F.concat(F.lit("contact user"), F.col("event_id") % 40, F.lit("@example.org "),
                                             F.col("props")),
                     F.lit("kind"), F.col("event_type"))
    r = T.redact_map(m)
    return fx.events.select("event_id", r["API_Key"].alias("api_key"), r["note"].alias("note"), r["kind"].alias("kind"))


# Documents as JSON: nested below as many brackets as the id says, a sensitive key with a container, one with a
# text in a list, escaped characters; every 13th text is no JSON but 100 000 brackets.
NESTED = "CASE WHEN doc_id % 13 = 0 THEN 'deep' WHEN doc_id % 13 = 1 THEN 'broken' ELSE 'json' END"


def nested_documents(fx):
    body = F.struct(
        F.col("doc_id").alias("id"), F.struct(F.array(F.col("text"), F.lit("x")).alias("parts"), F.col("lang").alias("Token")).alias("API_Key"),
        F.struct(F.col("text").alias("note"), F.array(F.struct(F.col("source").alias("Password"), F.col("text").alias("body"))).alias("list")).alias("in"))
    depth = (F.col("doc_id") % 40).cast("int")
    whole = F.concat(F.repeat(F.lit("[ "), depth), F.to_json(body, {"ignoreNullFields": "false"}), F.repeat(F.lit(" ]"), depth))
    kind = F.expr(NESTED)
    text = F.when(kind == "deep", F.repeat(F.lit("["), F.lit(100_000))).when(kind == "broken", F.concat(F.lit('{"note": '), "text")).otherwise(whole)
    return fx.documents.select("doc_id", kind.alias("kind"), text.alias("raw"))


@register("redact_nested_fields", oracle([], f"""
SELECT doc_id, kind, CASE kind WHEN 'deep' THEN md5(repeat('[', 100000)) WHEN 'broken' THEN md5({_redact_sql("'{\"note\": ' || text")}) END AS whole_md5,
 CASE WHEN kind = 'json' THEN doc_id END AS id, CASE WHEN kind = 'json' THEN '[REDACTED]' END AS api_key, CASE WHEN kind = 'json' THEN '[REDACTED]' END AS password,
 CASE WHEN kind = 'json' THEN md5({_redact_sql("text")}) END AS note_md5, CASE WHEN kind = 'json' THEN md5({_redact_sql("text")}) END AS body_md5
FROM (SELECT *, {NESTED} AS kind FROM documents) d"""))
def q_redact_nested_fields(fx):
    """SCL-7 on JSON nested at any depth: sensitive containers and texts replaced, other strings pattern-redacted."""
    r = T.redact_json(nested_documents(fx), "raw", "clean").drop("raw")
    is_json = F.col("kind") == "json"
    inner = F.when(is_json, F.try_parse_json(F.rtrim(F.ltrim("clean", F.lit("[")), F.lit("]"))))
    text = lambda path: F.try_variant_get(F.col("_v"), path, "string")
    return r.withColumn("_v", inner).select(
        "doc_id", "kind", F.when(~is_json, F.md5("clean")).alias("whole_md5"), F.try_variant_get("_v", "$.id", "bigint").alias("id"),
        text("$.API_Key").alias("api_key"), text("$.in.list[0].Password").alias("password"),
        F.md5(text("$.in.note")).alias("note_md5"), F.md5(text("$.in.list[0].body")).alias("body_md5"))


REDACTION_FILE = {"sensitive_field_names": ["lang"], "value_patterns": [
    {"pattern": "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}", "replacement": "<mail $1>"},
    {"pattern": "[0-9]{1,3}(?:\\.[0-9]{1,3}){3}", "replacement": "<address>"}]}
FILE_REDACT_SQL = "text"
for _rule in REDACTION_FILE["value_patterns"]:
    FILE_REDACT_SQL = f"regexp_replace({FILE_REDACT_SQL}, {_q(_rule['pattern'])}, {_q(_rule['replacement'])}, 'g')"


@register("redact_by_file", oracle([], f"""
SELECT doc_id, '[REDACTED]' AS lang, md5({FILE_REDACT_SQL}) AS text_md5 FROM documents"""))
def q_redact_by_file(fx):
    """SRC-4 + SCL-7: fields redacted by rules and key names that are loaded from a file."""
    path = _scratch(fx.spark, "redaction")
    fx.spark.createDataFrame([(json.dumps(REDACTION_FILE),)], "value string").coalesce(1).write.text(path)
    by = Redaction.load(fx.spark, path)
    fields = T.redact_map(F.create_map(F.lit("Lang"), F.col("lang"), F.lit("text"), F.col("text")), by.rules, by.field_names)
    return fx.documents.select("doc_id", fields["Lang"].alias("lang"), F.md5(fields["text"]).alias("text_md5"))
