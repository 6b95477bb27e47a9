"""Hashes over records: canonical JSON (SCL-9), fingerprints (SCL-12), decision digests (SCL-13),
HMAC-SHA256 signatures (SCL-14), config hashes (SCL-19).

Fixed-schema records are canonicalised natively: ``to_json`` of a struct whose fields are
in alphabetical order is compact, sorted JSON.  HMAC is composed from ``sha2`` / ``unhex``
with the key pads held in a small key table joined on ``signing_key_id`` (so key material
never appears as a literal in plans or logs).
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Decision-record contract.
SCHEMA_VERSION = "1.0.0"
CANONICALIZATION_VERSION = "HARNESS-JSON-SORTED-COMPACT-v1"
DIGEST_FIELDS = (
    "action", "algorithm", "canonicalization_version", "correlation_id", "decision_id", "evaluator_version",
    "policy_version", "previous_record_digest", "resource_id", "schema_version", "signing_key_id",
    "stream_sequence", "tenant_id", "timestamp", "user_id", "verdict",
)
MIN_KEY_BYTES = 32
_BLOCK = 64


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_json(cols) -> Column:
    """SCL-9 for fixed schemas: compact JSON with keys sorted (fields ordered alphabetically)."""
    names = sorted(cols)
    return F.to_json(F.struct(*[F.col(n).alias(n) for n in names]), {"ignoreNullFields": "false"})


def record_digest(df: DataFrame) -> Column:
    """SCL-13: SHA-256 hex of the canonical JSON of the 16 digest fields."""
    return F.sha2(canonical_json(DIGEST_FIELDS), 256)


def key_table(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    """signing_key_id -> (ipad, opad) for HMAC-SHA256; keys must hold at least 32 bytes."""
    rows = []
    for kid, key in keys.items():
        if not key or len(key) < MIN_KEY_BYTES:
            raise ValueError("signing_key must contain at least 256 bits (32 bytes)")
        k = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
        k = k.ljust(_BLOCK, b"\0")
        rows.append((kid, bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)))
    return spark.createDataFrame(rows, "signing_key_id string, _ipad binary, _opad binary")


def hmac_sha256(msg: Column, ipad: Column, opad: Column) -> Column:
    """HMAC-SHA256 hex of ``msg`` (string, UTF-8) from the key pads: H(opad || H(ipad || msg))."""
    inner = F.sha2(F.concat(ipad, F.encode(msg, "UTF-8")), 256)
    return F.sha2(F.concat(opad, F.unhex(inner)), 256)


def sign_records(df: DataFrame, keys: DataFrame, digest_col: str = "current_record_digest",
                 out: str = "signature") -> DataFrame:
    """SCL-14: signature = HMAC-SHA256(key of signing_key_id, hex digest).  The key table is bounded
    by the number of signing keys; Spark picks the join by its measured size."""
    j = df.join(keys, "signing_key_id", "left")
    return j.withColumn(out, hmac_sha256(F.col(digest_col), F.col("_ipad"), F.col("_opad"))).drop("_ipad", "_opad")


def verify_records(df: DataFrame, keys: DataFrame) -> DataFrame:
    """SCL-13 + SCL-14 + SCL-8 per record: version check, secret guard, digest and signature match.

    Adds ``record_error`` (NULL when the record verifies), in the reference's order.
    """
    from assay.functions.text import secret_guard

    j = df.join(keys, "signing_key_id", "left")
    secret = F.lit(False)
    for f in DIGEST_FIELDS:
        if f != "stream_sequence":
            secret = secret | F.coalesce(secret_guard(F.col(f)), F.lit(False))
    expected = record_digest(j)
    sig = hmac_sha256(F.col("current_record_digest"), F.col("_ipad"), F.col("_opad"))
    err = (F.when(F.col("schema_version") != SCHEMA_VERSION, F.lit("unsupported_schema_version"))
           .when(F.col("canonicalization_version") != CANONICALIZATION_VERSION, F.lit("unsupported_canonicalization"))
           .when(secret, F.lit("secret_in_record"))
           .when(F.col("current_record_digest") != expected, F.lit("digest_mismatch"))
           .when(F.col("algorithm") != "HMAC-SHA256", F.lit("unsupported_algorithm"))
           .when(F.col("_ipad").isNull(), F.lit("unknown_signing_key"))
           .when(F.col("signature") != sig, F.lit("signature_mismatch")))
    return j.withColumn("record_error", err).drop("_ipad", "_opad")


def _per_json(s: pd.Series, fn) -> pd.Series:
    """``fn`` of each parsed JSON text; null for null, for text that isn't JSON and for JSON nested too deep."""
    def one(v):
        try:
            return None if v is None else fn(json.loads(v))
        except (ValueError, RecursionError):
            return None

    return s.map(one)


@F.pandas_udf(StringType())
def canonical_json_text(s: pd.Series) -> pd.Series:
    """SCL-9 for free-form JSON text with byte parity: sorted keys, compact, non-ASCII escaped; null for a bad row."""
    return _per_json(s, lambda d: json.dumps(d, sort_keys=True, separators=(",", ":")))


@F.pandas_udf(StringType())
def config_hash(s: pd.Series) -> pd.Series:
    """SCL-19: SHA-256 of sorted-key JSON with the default (spaced) separators; null for a bad row."""
    return _per_json(s, lambda d: hashlib.sha256(json.dumps(d, sort_keys=True).encode("utf-8")).hexdigest())


def scenario_fingerprint(json_text) -> Column:
    """SCL-12: SHA-256 of the canonical JSON of a scenario without its ``fingerprint`` field."""
    return F.sha2(canonical_json_text(_drop_fingerprint(_c(json_text))), 256)


@F.pandas_udf(StringType())
def _drop_fingerprint(s: pd.Series) -> pd.Series:
    return _per_json(s, lambda d: json.dumps({k: x for k, x in d.items() if k != "fingerprint"} if isinstance(d, dict) else d))
