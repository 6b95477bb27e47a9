"""Stateful streaming operators (STR-6, STR-7) and the availableNow test rig.

Both keep a few numbers of state per key (``applyInPandasWithState``): the budget gate
keeps provider and global spend per run, the decision log keeps the stream head
(sequence, digest).  Rows of a key inside one micro-batch are processed in event order;
micro-batches arrive in order, so the result equals the batch fold.  A Python worker holds a
key's rows of one micro-batch, so the size of a micro-batch bounds its memory (``arrivals``).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from assay.operators.cumulative import order_slices
from assay.session import checkpoint_dir

# Rows of one micro-batch; changes no result.
BATCH_ROWS = 1 << 21

ADMIT_OUT = ("run_id string, execution_id string, provider string, cost_usd double, admitted boolean, reason string, "
             "provider_spend_usd double, global_spend_usd double")
ADMIT_STATE = "spend_json string"


def _admit_fn(caps: dict[str, float], effective_global_cap: float):
    def fn(key, pdfs, state):
        spend, total = ({}, 0.0)
        if state.exists:
            s = json.loads(state.get[0])
            spend, total = s["p"], s["g"]
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["_ts", "execution_id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            c = float(r.cost_usd or 0.0)
            cur = spend.get(r.provider, 0.0)
            if cur + c > caps.get(r.provider, float("inf")):
                ok, why = False, "provider_cap"
            elif total + c > effective_global_cap:
                ok, why = False, "global_cap"
            else:
                ok, why = True, None
                spend[r.provider] = cur + c
                total += c
            out.append((r.run_id, r.execution_id, r.provider, c, ok, why, spend.get(r.provider, 0.0), total))
        state.update((json.dumps({"p": spend, "g": total}),))
        yield pd.DataFrame(out, columns=["run_id", "execution_id", "provider", "cost_usd", "admitted", "reason",
                                         "provider_spend_usd", "global_spend_usd"])

    return fn


def budget_admission_stream(requests: DataFrame, caps: dict[str, float], effective_global_cap: float,
                            ts: str = "request_ts") -> DataFrame:
    """STR-6: W8b online - per run, reject a request that would exceed its provider cap or the
    effective global cap; a rejected request adds nothing.  State: spend per provider + global."""
    df = requests.select("run_id", "execution_id", "provider", F.col("cost_usd").cast("double"),
                         F.col(ts).cast("timestamp").alias("_ts"))
    return df.groupBy("run_id").applyInPandasWithState(
        _admit_fn(caps, effective_global_cap), ADMIT_OUT, ADMIT_STATE, "append", GroupStateTimeout.NoTimeout)


APPEND_OUT = ("stream_id string, decision_id string, stream_sequence bigint, accepted boolean, reason string")
APPEND_STATE = "head_seq bigint, head_digest string"


def _append_fn(key, pdfs, state):
    head_seq, head_digest = (0, "GENESIS")
    if state.exists:
        head_seq, head_digest = state.get
    rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["_arrival", "stream_sequence", "decision_id"],
                                                                kind="stable", ignore_index=True)
    reasons = []
    for seq, previous, current in zip(rows["stream_sequence"], rows["previous_record_digest"], rows["current_record_digest"]):
        seq = int(seq)
        if head_seq == 0 and seq != 1:
            why = "first_sequence_must_be_1"
        elif seq != head_seq + 1:
            why = "sequence_gap"
        elif previous != head_digest:
            why = "broken_link"
        else:
            why = None
            head_seq, head_digest = seq, current
        reasons.append(why)
    state.update((head_seq, head_digest))
    yield pd.DataFrame({"stream_id": key[0], "decision_id": rows["decision_id"], "stream_sequence": rows["stream_sequence"].astype("int64"),
                        "accepted": [why is None for why in reasons], "reason": pd.Series(reasons, dtype=object)})


def append_decisions(records: DataFrame, watermark_col: str | None = None, watermark: str = "1 day",
                     arrival: str | None = None) -> DataFrame:
    """STR-7: accept a decision only if it extends its stream's head (sequence head + 1 and
    previous digest = head digest); first record must be sequence 1.  Decision ids are
    de-duplicated globally first (``dropDuplicatesWithinWatermark`` when an event-time column
    is given, bounded state; else exact ``dropDuplicates``).  Within a micro-batch a stream's
    records are applied in ``arrival`` order (default: sequence order)."""
    df = records
    if watermark_col:
        df = df.withColumn(watermark_col, F.col(watermark_col).cast("timestamp")).withWatermark(watermark_col, watermark)
        df = df.dropDuplicatesWithinWatermark(["decision_id"])
    else:
        df = df.dropDuplicates(["decision_id"])
    order = F.col(arrival).cast("bigint") if arrival else F.col("stream_sequence").cast("bigint")
    df = df.select("stream_id", "decision_id", F.col("stream_sequence").cast("bigint"), "previous_record_digest",
                   "current_record_digest", order.alias("_arrival"))
    return df.groupBy("stream_id").applyInPandasWithState(
        _append_fn, APPEND_OUT, APPEND_STATE, "append", GroupStateTimeout.NoTimeout)


def arrivals(source: DataFrame, order: Sequence[str], path: str) -> None:
    """Write ``source`` below ``path`` in ``order`` (nulls last): files of about ``BATCH_ROWS`` rows, one after the
    other, so that a stream which takes a file per micro-batch, oldest first, gets the rows in that order."""
    by = [F.col(c).asc_nulls_last() for c in order]
    for part in order_slices(source, by, BATCH_ROWS):
        part.coalesce(1).sortWithinPartitions(*by).write.mode("append").parquet(path)


def run_available(spark: SparkSession, source: DataFrame, build, name: str, files_per_trigger: int = 1,
                  output_mode: str = "append", arrival: Sequence[str] | None = None) -> DataFrame:
    """Run ``build(stream_df)`` over ``source`` as a Structured Streaming job to completion.

    The source rows are written as parquet files under the shared checkpoint folder, read
    back with ``readStream`` (``maxFilesPerTrigger`` -> several micro-batches), processed with
    ``trigger(availableNow=True)`` into a parquet sink (exactly-once with the checkpoint), and
    the sink is returned as a batch DataFrame.  ``output_mode="complete"`` (aggregations) uses the
    memory sink and returns the final result table.  With ``arrival`` (order columns) the rows come in
    that order in micro-batches of ``BATCH_ROWS`` rows, whatever ``files_per_trigger``.
    """
    base = os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
    src, sink, ckpt = (os.path.join(base, p) for p in ("source", "sink", "checkpoint"))
    if arrival:
        arrivals(source, arrival, src)
        files_per_trigger = 1
    else:
        source.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    if output_mode == "complete":
        table = f"assay_{name}_{uuid.uuid4().hex[:8]}"
        q = (build(stream).writeStream.format("memory").queryName(table).option("checkpointLocation", ckpt)
             .outputMode("complete").trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.table(table)
    q = (build(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


GAUGE_OUT = "provider string, execution_id string, kind string, active bigint"
GAUGE_STATE = "active bigint"


def _gauge_fn(key, pdfs, state):
    active = int(state.get[0]) if state.exists else 0
    rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t", "delta", "execution_id"], kind="stable", ignore_index=True)
    gauge = rows["delta"].astype("int64").cumsum() + active
    state.update((int(gauge.iloc[-1]),))
    yield pd.DataFrame({"provider": key[0], "execution_id": rows["execution_id"], "kind": rows["kind"], "active": gauge})


def active_executions_stream(events: DataFrame) -> DataFrame:
    """STR-5 online: the in-flight gauge per provider from start (+1) / end (-1) events arriving in
    time order; state is one counter per provider.  Within a micro-batch events are applied in
    (time, ends before starts, id) order."""
    df = events.select("provider", "execution_id", "kind", F.col("delta").cast("bigint"), F.col("_t").cast("timestamp"))
    return df.groupBy("provider").applyInPandasWithState(_gauge_fn, GAUGE_OUT, GAUGE_STATE, "append",
                                                         GroupStateTimeout.NoTimeout)
