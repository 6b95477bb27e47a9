"""Audit operators: hash-chain checks (W2-W5, STR-10), chain building (STR-9), access decisions
(P10), report reconciliation and release gates (A14, A15, A20), manifest drift (J12),
foreign-key orphans (J10) and insert-if-absent (J9).

Chains are verified fully in parallel: a record's predecessor is found by an equi-join on
(stream, rank - 1), ranks come from the sliced running count, duplicates from an
aggregate - no window holds a whole stream, however hot.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import hashing as H
from assay.operators.cumulative import materialised, order_slices
from assay.operators.stats import dense_index
from assay.session import checkpoint_dir

GENESIS = "GENESIS"
# Rows of all streams that are chained at a time; changes no result.
CHAIN_ROWS = 1 << 21


def with_rank(decisions: DataFrame, order_col: str = "stream_sequence", tie: str | None = None,
              materialize: bool = False) -> DataFrame:
    """1-based position of each record within its stream in (order_col, tie) order.

    ``materialize=True`` writes the ranked table once as a reliable checkpoint (in the shared
    ``spark.checkpoint.dir``): the chain checks read it several times (self-join, duplicate
    aggregate, verification), and without the cut each read would recompute the input and
    the ranking.
    """
    order = [order_col] + ([tie] if tie else [])
    ranked = dense_index(decisions, ["stream_id"], order, "_rk0").withColumn("rank", F.col("_rk0") + 1).drop("_rk0")
    if materialize:
        checkpoint_dir(ranked.sparkSession)
        ranked = ranked.checkpoint(eager=True)
    return ranked


def chain_link_check(ranked: DataFrame) -> DataFrame:
    """previous_record_digest must equal the prior record's current digest; the first must be GENESIS.

    The prior record is found by an equi-join on (stream_id, rank - 1).
    """
    prev = ranked.select("stream_id", (F.col("rank") + 1).alias("rank"),
                         F.col("current_record_digest").alias("_prev_digest"))
    j = ranked.join(prev, ["stream_id", "rank"], "left")
    expected = F.when(F.col("rank") == 1, F.lit(GENESIS)).otherwise(F.col("_prev_digest"))
    return j.withColumn("link_ok", F.coalesce(F.col("previous_record_digest") == expected, F.lit(False))).drop(
        "_prev_digest")


def sequence_check(ranked: DataFrame) -> DataFrame:
    """stream_sequence must be 1, 2, 3, ... in record order."""
    return ranked.withColumn("sequence_ok", F.col("stream_sequence") == F.col("rank"))


def duplicate_decisions(ranked: DataFrame) -> DataFrame:
    """Per record, whether its decision_id already occurred earlier in the chain.

    One aggregate per (stream, decision_id) gives the first rank; copies after it are duplicates.
    """
    first = ranked.groupBy("stream_id", "decision_id").agg(F.min("rank").alias("_first"),
                                                          F.count(F.lit(1)).alias("copies"))
    return ranked.join(first, ["stream_id", "decision_id"]).withColumn(
        "duplicate", F.col("rank") > F.col("_first")).drop("_first")


def stream_head(decisions: DataFrame, order_col: str = "stream_sequence") -> DataFrame:
    """The last record of each stream - its sequence and digest (``max_by``: partial aggregation)."""
    last = decisions.groupBy("stream_id").agg(
        F.max_by(F.struct("stream_sequence", "current_record_digest"), F.col(order_col)).alias("_h"))
    return last.select("stream_id", F.col("_h.stream_sequence").alias("head_sequence"),
                       F.col("_h.current_record_digest").alias("head_digest"))


def verify_chain(decisions: DataFrame, order_col: str = "stream_sequence", tie: str | None = None,
                 keys: DataFrame | None = None, streams: DataFrame | None = None) -> DataFrame:
    """STR-10: per stream, valid or the first failure (record rank and reason).

    Per-record checks in the reference's order: record verification (versions, secrets,
    digest, HMAC - when ``keys`` is given), duplicate id, sequence break, broken link.
    ``streams`` (stream_id list) reports empty streams as errors.
    """
    ranked = with_rank(decisions, order_col, tie, materialize=True)
    if keys is not None:
        ranked = H.verify_records(ranked, keys)
    else:
        ranked = ranked.withColumn("record_error", F.lit(None).cast("string"))
    checked = sequence_check(chain_link_check(duplicate_decisions(ranked)))
    reason = (F.when(F.col("record_error").isNotNull(), F.col("record_error"))
              .when(F.col("duplicate"), F.lit("duplicate_decision_id"))
              .when(~F.col("sequence_ok"), F.lit("sequence_break"))
              .when(~F.col("link_ok"), F.lit("chain_broken")))
    per = checked.withColumn("_reason", reason)
    out = per.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.min_by(F.struct(F.col("rank"), F.col("_reason")), F.when(F.col("_reason").isNotNull(), F.col("rank")))
        .alias("_first"))
    res = out.select("stream_id", "records", F.col("_first.rank").alias("first_failure_rank"),
                     F.col("_first._reason").alias("reason"))
    if streams is not None:
        res = streams.select("stream_id").distinct().join(res, "stream_id", "left").select(
            "stream_id", F.coalesce("records", F.lit(0)).alias("records"), "first_failure_rank",
            F.when(F.col("records").isNull(), F.lit("empty_chain")).otherwise(F.col("reason")).alias("reason"))
    return res.withColumn("valid", F.col("reason").isNull())


_CHAIN_SCHEMA = T.StructType([T.StructField(n, T.LongType() if n == "stream_sequence" else T.StringType())
                              for n in (*H.DIGEST_FIELDS, "stream_id", "current_record_digest")])


def _chain_fold(batches):
    import hashlib
    import json

    stream, prev, seq = object(), GENESIS, 0
    for pdf in batches:
        heads = pdf["current_record_digest"].notna()
        digests, prevs, seqs = [], [], []
        for rec, is_head in zip(pdf.to_dict("records"), heads):
            if is_head:  # where an earlier piece of the stream ended
                stream, prev, seq = rec["stream_id"], rec["current_record_digest"], rec["stream_sequence"]
                continue
            if rec["stream_id"] != stream:
                stream, prev, seq = rec["stream_id"], GENESIS, 0
            seq += 1
            rec["stream_sequence"], rec["previous_record_digest"] = seq, prev
            payload = {k: rec[k] for k in H.DIGEST_FIELDS}
            d = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            digests.append(d)
            prevs.append(prev)
            seqs.append(seq)
            prev = d
        if not digests:
            continue
        out = pdf[~heads].copy()
        out["stream_sequence"], out["previous_record_digest"], out["current_record_digest"] = seqs, prevs, digests
        yield out[[f.name for f in _CHAIN_SCHEMA.fields]]


def build_chain(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """STR-9: assign sequence numbers and chained digests per stream, in ``order``.

    Each digest covers the previous one, so a stream is inherently sequential.  The rows are cut into
    pieces of ``CHAIN_ROWS`` rows along ``order``, which are folded one after another: each is
    hash-partitioned by stream, sorted, and folded in one streaming pass per partition with O(1)
    state from the streams' heads so far.  So streams run in parallel, and a task never reads more
    than a piece, however long a stream is or however many share a partition.
    Records must carry the digest fields other than stream_sequence / previous_record_digest.
    """
    cols = [c for c in H.DIGEST_FIELDS if c not in ("stream_sequence", "previous_record_digest")]
    base = records.select("stream_id", *cols, *[c for c in order if c not in cols and c != "stream_id"])
    path = os.path.join(checkpoint_dir(base.sparkSession), f"chain-{uuid.uuid4().hex}")
    heads = None
    for i, piece in enumerate(order_slices(base, order, CHAIN_ROWS)):
        rows = piece.withColumns({"stream_sequence": F.lit(0).cast("long"), "previous_record_digest": F.lit(None).cast("string"),
                                  "current_record_digest": F.lit(None).cast("string")})
        if heads is not None:
            rows = rows.unionByName(heads, allowMissingColumns=True)
        ordered = rows.repartition("stream_id").sortWithinPartitions("stream_id", F.col("current_record_digest").isNull(), *order)
        ordered.mapInPandas(_chain_fold, _CHAIN_SCHEMA).write.parquet(os.path.join(path, f"piece={i}"))
        done = base.sparkSession.read.schema(_CHAIN_SCHEMA).parquet(os.path.join(path, f"piece={i}"))
        ends = done if heads is None else heads.unionByName(done.select(heads.columns))
        heads = materialised(stream_head(ends.select("stream_id", "stream_sequence", "current_record_digest")).select(
            "stream_id", F.col("head_sequence").alias("stream_sequence"), F.col("head_digest").alias("current_record_digest")), "heads")
    return base.sparkSession.read.schema(_CHAIN_SCHEMA).option("recursiveFileLookup", True).parquet(path)


# --- access decisions ------------------------------------------------------------------

MUTATING_ACTIONS = ("UPDATE", "DELETE", "CANCEL", "ADMIN")


def authorize_access(req: DataFrame) -> DataFrame:
    """P10: ordered checks -> (allowed, status_code, reason).

    other tenant -> 404; parent owned by another tenant -> 404; requested parent differs
    from the resource's parent -> 403; non-admin non-owner mutating -> 403; else allowed.
    """
    def present(c):
        return F.col(c).isNotNull() & (F.col(c) != "")

    code = (F.when(F.col("identity_tenant") != F.col("owner_tenant"), F.lit(404))
            .when(present("parent_tenant") & (F.col("parent_tenant") != F.col("identity_tenant")), F.lit(404))
            .when(present("requested_parent") & present("parent_id") & (F.col("requested_parent") != F.col("parent_id")),
                  F.lit(403))
            .when(~F.coalesce(F.col("is_admin"), F.lit(False)) & (F.col("identity_user") != F.col("owner_user"))
                  & F.col("action").isin(*MUTATING_ACTIONS), F.lit(403))
            .otherwise(F.lit(200)))
    reason = (F.when(F.col("identity_tenant") != F.col("owner_tenant"), F.lit("not_found"))
              .when(present("parent_tenant") & (F.col("parent_tenant") != F.col("identity_tenant")), F.lit("not_found"))
              .when(present("requested_parent") & present("parent_id")
                    & (F.col("requested_parent") != F.col("parent_id")), F.lit("parent_mismatch"))
              .when(code == 403, F.lit("insufficient_permissions"))
              .otherwise(F.lit("allowed")))
    return req.withColumn("status_code", code).withColumn("allowed", code == 200).withColumn("reason", reason)


# --- reports and gates -----------------------------------------------------------------

def report_age_seconds(ts_text, now_iso: str) -> tuple[Column, Column]:
    """SCL-15: (has_zone, age in seconds) for an ISO-8601 time; 'Z' or +hh:mm required."""
    t = F.col(ts_text) if isinstance(ts_text, str) else ts_text
    has_zone = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    ts = F.to_timestamp(t)
    now = F.to_timestamp(F.lit(now_iso))
    age = (F.unix_micros(now) - F.unix_micros(ts)).cast("double") / 1e6
    return has_zone, F.when(has_zone, age)


def reconcile_report(reports: DataFrame, cases: DataFrame, now_iso: str, min_score: float = 1.0,
                     max_age_s: int = 24 * 3600) -> DataFrame:
    """A14 (+A20, SCL-15): declared report totals vs totals recomputed from the case rows.

    ``reports``: report_id, schema_version, suite, generated_at, total, passed, failed,
    resistance_score.  ``cases``: report_id, case_id, passed (long form - aggregated per
    report, never gathered into arrays).  First failing rule wins.
    """
    agg = cases.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("passed") == True).alias("actual_passed"),  # noqa: E712
        F.count_distinct("case_id").alias("distinct_ids"))
    j = reports.join(agg, "report_id", "left").fillna(0, ["n_cases", "actual_passed", "distinct_ids"])
    has_zone, age = report_age_seconds("generated_at", now_iso)
    actual_failed = F.col("total") - F.col("actual_passed")
    recomputed = F.when(F.col("total") > 0, F.col("actual_passed") / F.col("total")).otherwise(F.lit(0.0))
    reason = (F.when(F.col("schema_version") != "1.0", F.lit("unsupported_version"))
              .when(F.col("suite") != "evaluation_integrity", F.lit("unexpected_suite"))
              .when(~has_zone, F.lit("missing_timezone"))
              .when((age < 0) | (age > max_age_s), F.lit("stale"))
              .when((F.col("total") <= 0) | (F.col("passed") < 0) | (F.col("failed") < 0)
                    | (F.col("passed") + F.col("failed") != F.col("total")), F.lit("inconsistent_counts"))
              .when(F.col("n_cases") != F.col("total"), F.lit("cases_total_mismatch"))
              .when((F.col("actual_passed") != F.col("passed")) | (actual_failed != F.col("failed")),
                    F.lit("case_results_mismatch"))
              .when(F.abs(recomputed - F.col("resistance_score")) > 1e-6, F.lit("score_mismatch"))
              .when(F.col("distinct_ids") != F.col("n_cases"), F.lit("duplicate_case_ids"))
              .when((F.col("resistance_score") < min_score) | (F.col("failed") != 0), F.lit("threshold_not_met")))
    return j.select("report_id", reason.isNull().alias("passed_gate"), reason.alias("reason"),
                    F.round(age, 3).alias("age_seconds"))


def duplicate_case_ids(cases: DataFrame) -> DataFrame:
    """Per report, case ids that occur more than once."""
    return cases.groupBy("report_id", "case_id").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def release_gate(checks: DataFrame) -> DataFrame:
    """Per candidate, ready = every required check passed; strict_ready = every check passed."""
    return checks.groupBy("candidate").agg(
        F.every(F.when(F.col("required"), F.col("passed")).otherwise(F.lit(True))).alias("ready"),
        F.every("passed").alias("strict_ready"),
        F.count(F.lit(1)).alias("checks"))


def manifest_drift(manifests: DataFrame, environment: DataFrame, key: str = "benchmark_id") -> DataFrame:
    """Drift warnings of each manifest against the current environment of its benchmark.

    The environment table is a configuration-sized dimension, joined on the benchmark id.
    """
    env = environment.select(key, *[F.col(c).alias(f"env_{c}") for c in
                                    ("git_commit", "python_version", "benchmark_fingerprint", "config_hash")])
    j = manifests.join(env, key, "left")
    gc, egc = F.col("git_commit"), F.coalesce(F.col("env_git_commit"), F.lit("unknown"))
    w = F.array_compact(F.array(
        F.when((gc != "unknown") & ~F.col("env_git_commit").eqNullSafe(gc), F.concat(
            F.lit("Git Commit Drift: Manifest commit "), F.left(gc, F.lit(8)), F.lit(" != Current "), F.left(egc, F.lit(8)))),
        F.when(~F.col("python_version").eqNullSafe(F.col("env_python_version")), F.concat(
            F.lit("Python Version Drift: Manifest "), F.col("python_version"), F.lit(" != Current "),
            F.coalesce(F.col("env_python_version"), F.lit("None")))),
        F.when((F.coalesce(F.col("benchmark_fingerprint"), F.lit("")) != "")
               & ~F.col("env_benchmark_fingerprint").eqNullSafe(F.col("benchmark_fingerprint")), F.concat(
            F.lit("Benchmark Fingerprint Drift: Content hash mismatch for benchmark '"), F.col(key), F.lit("'"))),
        F.when((F.coalesce(F.col("env_config_hash"), F.lit("")) != "")
               & (F.col("env_config_hash") != F.col("config_hash")),
               F.lit("Configuration Drift: Run parameters hash mismatch")),
    ))
    return j.select("run_id", key, F.size(w).cast("bigint").alias("drift_count"),
                    F.array_join(w, " | ").alias("warnings"), (F.size(w) > 0).alias("strict_fail"))


def orphan_check(pairs: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Foreign-key violations per relation: one ``left_anti`` join per (child, parent) pair."""
    out = None
    for name, child, ckey, parent, pkey in pairs:
        p = parent.select(F.col(pkey).alias("_k")).distinct()
        bad = child.where(F.col(ckey).isNotNull()).join(p, child[ckey] == p["_k"], "left_anti")
        part = bad.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("relation"), "orphans")
        out = part if out is None else out.unionByName(part)
    return out


def insert_if_absent(new: DataFrame, old: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``new`` (first per key) whose key is not in ``old`` - what an append would add."""
    k = list(key)
    return new.dropDuplicates(k).join(old.select(*k).distinct(), k, "left_anti")
