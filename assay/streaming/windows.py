"""Windowed request metrics (STR-1..5, STR-8).

Every function takes a DataFrame that may be batch or streaming: the same plan runs as a
backfill over the table or incrementally under Structured Streaming (``withWatermark`` +
event-time ``window``; the watermark bounds state, it is a no-op in batch).

Sliding windows are rolled up from panes: rows are first aggregated once per slide step, and
the few pane rows, not the requests, are copied into the windows that cover them.  As a stream
these are two chained aggregations, which Spark runs in append mode: a window is emitted when
the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.money import usd_exact, usd_round
from assay.operators.cumulative import running_sum
from assay.operators.metrics import LATENCY_BUCKETS_S


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session zone is UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _watched(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    d = event_time(df, ts)
    return d.withWatermark(ts, watermark) if watermark else d


def rolled_up(df: DataFrame, ts: str, keys: Sequence[str], sums: dict[str, Column], size: str, slide: str,
              watermark: str | None) -> DataFrame:
    """Sums per key over windows of ``size`` sliding by ``slide`` (which divides it), by way of one pane per slide step."""
    panes = _watched(df, ts, watermark).groupBy(F.window(ts, slide).alias("pane"), *keys).agg(
        *(F.sum(c.cast("bigint")).alias(n) for n, c in sums.items()))
    return panes.groupBy(F.window("pane", size, slide).alias("window"), *keys).agg(*(F.sum(n).alias(n) for n in sums))


def _start(c: str = "window") -> Column:
    return F.date_format(F.col(f"{c}.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start")


def request_rate(df: DataFrame, ts: str = "request_ts", keys: Sequence[str] = ("provider", "model"),
                 size: str = "5 minutes", slide: str = "1 minute", watermark: str | None = "10 minutes",
                 seconds: float = 300.0) -> DataFrame:
    """STR-1: requests per second per key over sliding windows (count / window seconds)."""
    agg = rolled_up(df, ts, keys, {"requests": F.lit(1)}, size, slide, watermark)
    return agg.select(_start(), *keys, "requests", F.round(F.col("requests") / F.lit(seconds), 6).alias("rate_per_s"))


def error_rate(df: DataFrame, ts: str = "request_ts", keys: Sequence[str] = ("provider",),
               ok: Column | None = None, size: str = "5 minutes", slide: str = "1 minute",
               watermark: str | None = "10 minutes") -> DataFrame:
    """STR-2: 100 * non-success / all per key and window."""
    okc = ok if ok is not None else (F.col("status") == "completed")
    agg = rolled_up(df, ts, keys, {"requests": F.lit(1), "errors": F.coalesce((~okc).cast("int"), F.lit(0))}, size, slide, watermark)
    return agg.select(_start(), *keys, "requests", "errors",
                      F.round(F.col("errors") * 100.0 / F.col("requests"), 6).alias("error_pct"))


def histogram_quantile(q: float, cum: Sequence[Column], bounds=LATENCY_BUCKETS_S) -> Column:
    """Prometheus-style quantile from cumulative bucket counts (last = +Inf = total).

    rank = q * total; the first bucket whose cumulative count reaches the rank holds the
    quantile, interpolated linearly inside it; if that is the +Inf bucket the highest finite
    bound is returned.  No observations -> NULL.
    """
    total = cum[-1]
    rank = F.lit(float(q)) * total
    result = F.lit(float(bounds[-1]))  # +Inf bucket
    for i in range(len(bounds) - 1, -1, -1):
        lo = F.lit(0.0) if i == 0 else F.lit(float(bounds[i - 1]))
        prev = F.lit(0).cast("bigint") if i == 0 else cum[i - 1]
        hi = F.lit(float(bounds[i]))
        interp = lo + (hi - lo) * (rank - prev) / (cum[i] - prev)
        reached = cum[i] >= rank
        result = F.when(reached, interp).otherwise(result)
    return F.when(total > 0, result)


def p95_latency(df: DataFrame, ts: str = "request_ts", keys: Sequence[str] = ("provider",),
                latency_ms: str = "latency_ms", q: float = 0.95, size: str = "5 minutes",
                slide: str = "1 minute", watermark: str | None = "10 minutes") -> DataFrame:
    """STR-3: quantile of latency (seconds) per key and window from the A17 buckets."""
    secs = F.col(latency_ms).cast("double") / F.lit(1000.0)
    sums = {f"_b{i}": F.coalesce((secs <= F.lit(float(b))).cast("int"), F.lit(0)) for i, b in enumerate(LATENCY_BUCKETS_S)}
    agg = rolled_up(df, ts, keys, {**sums, "_inf": F.lit(1)}, size, slide, watermark)
    cum = [F.col(f"_b{i}") for i in range(len(LATENCY_BUCKETS_S))] + [F.col("_inf")]
    return agg.select(_start(), *keys, F.col("_inf").alias("requests"),
                      F.round(histogram_quantile(q, cum), 6).alias("latency_p95_s"))


def cost_window(df: DataFrame, ts: str = "request_ts", keys: Sequence[str] = ("provider",),
                size: str = "24 hours", slide: str = "1 hour", watermark: str | None = "1 hour") -> DataFrame:
    """STR-4: cost increase per key over 24 h windows sliding by 1 h (plain sum, exact money)."""
    agg = rolled_up(df, ts, keys, {"_s": usd_exact("cost_usd")}, size, slide, watermark)
    return agg.select(_start(), *keys, usd_round("_s").alias("cost_usd"))


def rpm_breach(df: DataFrame, limits: dict[str, int], ts: str = "request_ts", key: str = "provider",
               watermark: str | None = "2 minutes") -> DataFrame:
    """STR-8: requests per minute per provider against its configured ceiling (literal map)."""
    agg = _watched(df, ts, watermark).groupBy(F.window(ts, "1 minute").alias("window"), key).agg(F.count(F.lit(1)).alias("requests"))
    lim = F.create_map(*[x for k, v in sorted(limits.items()) for x in (F.lit(k), F.lit(int(v)))])[F.col(key)]
    return agg.select(_start(), key, "requests", lim.cast("bigint").alias("rpm_limit"),
                      F.coalesce(F.col("requests") > lim, F.lit(False)).alias("breach"))


def active_executions(df: DataFrame, start: str = "request_ts", latency_ms: str = "latency_ms",
                      key: str = "provider", id_col: str = "execution_id") -> DataFrame:
    """STR-5 (batch form): in-flight gauge, +1 at start and -1 at end, as a running sum per key.

    At equal times ends are applied before starts.  The running sum uses range slices, so
    a provider with a third of all traffic is still spread over many tasks.
    """
    ev = gauge_events(df, start, latency_ms, key, id_col)
    out = running_sum(ev, [key], ["_t", "delta", id_col], "delta", "active")
    return out.select(key, id_col, "kind", "active")


def gauge_events(df: DataFrame, start: str = "request_ts", latency_ms: str = "latency_ms",
                 key: str = "provider", id_col: str = "execution_id") -> DataFrame:
    """+1 at each execution's start, -1 at its end (start + latency), as event rows."""
    t0 = F.col(start).cast("timestamp")
    starts = df.select(key, id_col, t0.alias("_t"), F.lit(1).cast("bigint").alias("delta"), F.lit("start").alias("kind"))
    t1 = F.timestamp_micros(F.unix_micros(t0) + F.col(latency_ms).cast("bigint") * 1000)
    ends = df.select(key, id_col, t1.alias("_t"), F.lit(-1).cast("bigint").alias("delta"), F.lit("end").alias("kind"))
    return starts.unionByName(ends)
