"""Text hygiene as Column expressions (SCL-2..8, SCL-17, SCL-18).

Everything is a JVM-side regex / string function except Unicode NFC, which Spark does
not have; that one step is an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Control characters removed from model text (tab, LF, CR are kept).
CONTROL_CHARS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
RESPONSE_TRUNCATED = "\n\n[RESPONSE TRUNCATED]"
SANITIZE_TRUNCATED = "\n\n[TRUNCATED]"
MAX_CHARS = 64_000

# Ordered secret redaction rules (pattern, replacement).  Order matters:
# the Anthropic key rule must run before the generic "sk-" rule.
REDACTION_RULES = [
    ("anthropic_key", r"sk-ant-[A-Za-z0-9_-]{20,}", "[ANTHROPIC-KEY-REDACTED]"),
    ("openai_key", r"sk-[A-Za-z0-9_-]{20,}", "[OPENAI-KEY-REDACTED]"),
    ("google_key", r"AIza[A-Za-z0-9_-]{35}", "[GOOGLE-KEY-REDACTED]"),
    ("bearer_token", r"Bearer\s+[A-Za-z0-9._-]{20,}", "Bearer [TOKEN-REDACTED]"),
    ("hex_token", r"[0-9a-fA-F]{64}", "[HEX-TOKEN-REDACTED]"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL-REDACTED]"),
]
# A rule of our own that callers may append.
TOKEN_ASSIGNMENT_RULE = ("token_assignment", r'token\s*=\s*"[0-9a-f]{40}"', "[TOKEN-REDACTED]")
# What a text must contain for a rule to be able to match: a plain search that spares most texts the regex.
RULE_MARKS = {"anthropic_key": "sk-ant-", "openai_key": "sk-", "google_key": "AIza", "bearer_token": "Bearer", "email": "@",
              "token_assignment": "token"}
# Keys whose values are always replaced (case-insensitive key match).
SENSITIVE_FIELD_NAMES = (
    "api_key", "apikey", "api-key", "x-api-key", "authorization", "bearer", "token", "secret",
    "password", "credential", "private_key", "client_secret", "access_token", "refresh_token",
    "session_token", "auth_token",
)
REDACTED = "[REDACTED]"
# Secrets that must never enter a decision record (case-insensitive).
SECRET_GUARD_PATTERN = r"(?i)(sk-[a-zA-Z0-9]{20,}|Bearer\s+[a-zA-Z0-9_\-\.]+|api-key\s*:\s*[a-zA-Z0-9_\-]+)"
# The refusal phrases (case-insensitive, any one matches).
REFUSAL_PATTERNS = [
    r"\bI (cannot|can't|won't|am unable to|must decline)\b",
    r"\bI do not (assist|help|provide)\b",
    r"\bas an AI\b.*\bI (cannot|won't)\b",
    r"\bnot (able|appropriate|something I can)\b",
    r"\bagainst my (guidelines|policy|policies)\b",
]
SCRIPT_TAG = r"(?i)<script[\s\S]*?>[\s\S]*?</script>"
IFRAME_TAG = r"(?i)<iframe[\s\S]*?>"
FENCED_JSON = r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```"
BARE_JSON = r"(?s)(\{.*\}|\[.*\])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC (Arrow batch; ASCII values pass through untouched)."""
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


def bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over values that are computed once, however often it reads them (also inside lambdas)."""
    fields = F.struct(*(v.alias(k) for k, v in values.items()))
    return F.get(F.transform(F.array(fields), body), F.lit(0))


def strip_control(text) -> Column:
    return F.regexp_replace(_c(text), CONTROL_CHARS, "")


def _truncate(text: Column, max_chars: int, marker: str) -> Column:
    return F.when(F.length(text) > F.lit(max_chars), F.concat(F.left(text, F.lit(max_chars)), F.lit(marker))
                  ).otherwise(text)


def normalise_text(text, max_chars: int = MAX_CHARS, unicode_nfc: bool = True) -> Column:
    """SCL-2: NFC, drop control characters except tab/LF/CR, cut to max_chars + marker."""
    t = nfc(_c(text)) if unicode_nfc else _c(text)
    return _truncate(strip_control(t), max_chars, RESPONSE_TRUNCATED)


def sanitize_output(text, max_chars: int = MAX_CHARS, unicode_nfc: bool = True) -> Column:
    """SCL-3: as SCL-2 with the short marker."""
    t = nfc(_c(text)) if unicode_nfc else _c(text)
    return _truncate(strip_control(t), max_chars, SANITIZE_TRUNCATED)


NON_ASCII = "[^\\x00-\\x7F]"


def normalised_column(df, col: str, out: str, max_chars: int = MAX_CHARS, marker: str = RESPONSE_TRUNCATED):
    """SCL-2 / SCL-3 as a DataFrame step: only rows holding non-ASCII characters go through the
    NFC Arrow UDF; ASCII rows (NFC is the identity for them) stay in codegen'd JVM expressions."""
    needs = F.col(col).rlike(NON_ASCII)
    native = df.where(~needs | F.col(col).isNull()).withColumn(
        out, _truncate(strip_control(F.col(col)), max_chars, marker))
    python = df.where(needs).withColumn(out, _truncate(strip_control(nfc(F.col(col))), max_chars, marker))
    return native.unionByName(python)


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract_json_block(text) -> Column:
    """SCL-4: fenced JSON block first, else greedy first-brace..last-brace; NULL if none."""
    t = _c(text)
    fenced = F.nullif(F.regexp_extract(t, FENCED_JSON, 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(t, BARE_JSON, 1), F.lit(""))
    return strip_ws(F.coalesce(fenced, bare))


def redact_text(text, rules=REDACTION_RULES) -> Column:
    """SCL-5: ordered left fold of ``regexp_replace`` over the rule table, for texts that some rule may match."""
    t = out = _c(text)
    touched = F.lit(False)
    for name, pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))
        touched = touched | (_may_match(t, name) if name in RULE_MARKS else t.rlike(pattern))
    return F.when(touched, out).otherwise(t)


def _may_match(text: Column, rule: str) -> Column:
    return F.contains(text, F.lit(RULE_MARKS[rule])) if rule in RULE_MARKS else F.lit(True)


def first_secret(text, rules=REDACTION_RULES) -> Column:
    """SCL-6: name of the first rule (in rule order) that matches, else NULL."""
    t = _c(text)
    return F.coalesce(*[F.when(_may_match(t, n) & t.rlike(p), F.lit(n)) for n, p, _ in rules], F.lit(None).cast("string"))


def is_clean(text, rules=REDACTION_RULES) -> Column:
    """SCL-6: true when no rule matches."""
    return first_secret(text, rules).isNull()


def secret_guard(text) -> Column:
    """SCL-8: true when the value holds a secret that must not enter a decision record."""
    return _c(text).rlike(SECRET_GUARD_PATTERN)


def text_preview(text, n: int = 500) -> Column:
    """SCL-17: the first 500 characters."""
    return F.left(_c(text), F.lit(n))


def tag_values(tags, prefix: str) -> Column:
    """SCL-18: values of the tags that start with ``prefix`` (every occurrence of the prefix removed)."""
    return F.transform(F.filter(_c(tags), lambda t: t.startswith(prefix)),
                       lambda t: F.regexp_replace(t, re.escape(prefix), ""))


def refusal_regex(patterns=REFUSAL_PATTERNS) -> str:
    return "(?i)" + "|".join(patterns)


def has_refusal(text, patterns=REFUSAL_PATTERNS) -> Column:
    return _c(text).rlike(refusal_regex(patterns))


def has_unsafe_markup(text) -> Column:
    t = _c(text)
    return t.rlike(SCRIPT_TAG) | t.rlike(IFRAME_TAG)


# --- SCL-7: field redaction ------------------------------------------------------------

def redact_map(m, rules=REDACTION_RULES, field_names=SENSITIVE_FIELD_NAMES) -> Column:
    """SCL-7 on a MAP<STRING,STRING>: sensitive keys -> [REDACTED], other values pattern-redacted."""
    names = [n.lower() for n in field_names]
    return F.transform_values(_c(m), lambda k, v: F.when(F.lower(k).isin(*names), F.lit(REDACTED))
                              .otherwise(redact_text(v, rules)))


# A JSON text as tokens: strings, brackets and marks, and other scalars; white space is dropped.  Escaped
# backslashes and quotes are set aside first, as control characters, which valid JSON can't hold.
JSON_TOKEN = r'"[^"]*+"|[\[\]{},:]|[^\s\[\]{},:"]++'
SET_ASIDE = (("\\\\", "\x01"), ('\\"', "\x02"))


def _json_tokens(text: Column) -> Column:
    for escape, mark in SET_ASIDE:
        text = F.replace(text, F.lit(escape), F.lit(mark))

    def restored(token: Column) -> Column:
        for escape, mark in SET_ASIDE:
            token = F.replace(token, F.lit(mark), F.lit(escape))
        return token

    return F.transform(F.regexp_extract_all(text, F.lit(JSON_TOKEN), 0), restored)


def _decoded(token: Column) -> Column:
    """The text of a JSON string token."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.try_variant_get(F.try_parse_json(token), "$", "string")).otherwise(plain)


def _encoded(text: Column) -> Column:
    """A text as a JSON string token."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _is_text(token: Column) -> Column:
    return F.startswith(token, F.lit('"'))


def _names_secret(token: Column, field_names) -> Column:
    return F.coalesce(_is_text(token) & F.lower(_decoded(token)).isin(*(n.lower() for n in field_names)), F.lit(False))


def _redacted_tokens(tokens: Column, rules, field_names) -> Column:
    """(token, secret) per token: values redacted, and whether the token is the value of a sensitive key."""
    def one(t: Column, i: Column) -> Column:
        secret = (F.get(tokens, i - 1) == ":") & _names_secret(F.get(tokens, i - 2), field_names)
        is_value = _is_text(t) & F.coalesce(F.get(tokens, i + 1) != ":", F.lit(True))
        clean = bound({"own": t, "text": _decoded(t)}, lambda s: bound(
            {"own": s["own"], "text": s["text"], "clean": redact_text(s["text"], rules)},
            lambda v: F.when(v["clean"] != v["text"], _encoded(v["clean"])).otherwise(v["own"])))
        return F.struct(F.when(is_value, clean).otherwise(t).alias("token"), F.coalesce(secret, F.lit(False)).alias("secret"))

    return F.transform(tokens, one)


def redact_json(df: DataFrame, col: str, out: str, rules=REDACTION_RULES, field_names=SENSITIVE_FIELD_NAMES) -> DataFrame:
    """SCL-7 on free-form JSON text of any depth: add ``out``, the JSON without white space in which values of
    sensitive keys (whole containers too) are ``[REDACTED]`` and other strings are pattern-redacted; keys keep
    their order.  Text that isn't JSON is pattern-redacted as it stands.

    JVM functions only, row by row: nothing is shuffled.  One pass over a row's brackets finds the
    containers under sensitive keys, and the tokens between these are put together.
    """
    held = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    tokens = F.when(F.try_parse_json("_text").isNotNull(), _json_tokens(F.col("_text")))
    # a row that isn't JSON is one token of its own
    whole = F.when(F.col("_text").isNotNull(), F.array(F.struct(redact_text("_text", rules).alias("token"), F.lit(False).alias("secret"))))
    rows = df.select(held, F.col(f"`{col}`").alias("_text")).withColumn("_t", tokens)
    marked = rows.select("_row", F.coalesce(_redacted_tokens(F.col("_t"), rules, field_names), whole).alias("_m"))
    shown = marked.select("_row", F.transform("_m", lambda m: F.when(m["secret"], F.lit(f'"{REDACTED}"')).otherwise(m["token"])).alias("_s"),
                          _secret_containers(F.col("_m")).alias("_h"))
    return shown.withColumn(out, _without(F.col("_s"), F.col("_h"))).select("_row.*", out)


OPENERS, CLOSERS = ("{", "["), ("}", "]")
RANGES = "array<struct<first:int,last:int>>"


def _secret_containers(marked: Column) -> Column:
    """Places of the first and last token of each container under a sensitive key that is in no other such container."""
    places = F.transform(marked, lambda m, i: F.struct(
        i.alias("at"), F.when(m["token"].isin(*OPENERS), 1).when(m["token"].isin(*CLOSERS), -1).otherwise(0).alias("step"), m["secret"].alias("secret")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("first"), F.lit(0).alias("outside"),
                     F.array().cast(RANGES).alias("found"))

    def step(acc: Column, b: Column) -> Column:
        depth = acc["depth"] + b["step"]
        begins = acc["first"].isNull() & b["secret"] & (b["step"] > 0)
        ends = acc["first"].isNotNull() & (depth == acc["outside"])
        own = F.array(F.struct(acc["first"].alias("first"), b["at"].alias("last")))
        return F.struct(
            depth.alias("depth"), F.when(begins, b["at"]).when(~ends, acc["first"]).alias("first"),
            F.when(begins, acc["depth"]).otherwise(acc["outside"]).alias("outside"),
            F.when(ends, F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    brackets = F.filter(places, lambda b: b["step"] != 0)
    held = F.exists(marked, lambda m: m["secret"] & m["token"].isin(*OPENERS))
    return F.when(held, F.aggregate(brackets, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(RANGES))


def _without(tokens: Column, ranges: Column) -> Column:
    """The tokens as one text, of each range only the first."""
    def piece(r: Column, i: Column) -> Column:
        after = F.coalesce(F.get(ranges, i - 1)["last"], F.lit(-1))
        return F.slice(tokens, after + 2, r["first"] - after)

    last = F.coalesce(F.get(ranges, F.size(ranges) - 1)["last"], F.lit(-1))
    rest = F.slice(tokens, last + 2, F.size(tokens))
    kept = F.concat(F.flatten(F.transform(ranges, piece)), rest)
    return F.array_join(F.when(F.size(ranges) == 0, tokens).otherwise(kept), "")
