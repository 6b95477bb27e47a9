"""SRC-5 / SRC-12: read result tables.

Plain parquet reads: Catalyst pushes filters and prunes columns into the scan, so callers
just ``select``/``filter`` what they need.  Point lookups are filters, never collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def scan_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> dict[str, DataFrame]:
    """SRC-5: one lazily-read DataFrame per table."""
    return {n: read_table(spark, sf_dir, n) for n in names}


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup (``get_run_summary(run_id)``) - a pushed-down filter."""
    return df.filter(F.col(key) == F.lit(value))


def recent(df: DataFrame, ts_col: str, n: int = 50, tie: str | None = None) -> DataFrame:
    """L1 ``list_runs(limit)``: newest first, top-n (TakeOrderedAndProject: per-partition top-n, then merge)."""
    order: list[Column] = [F.col(ts_col).desc()]
    if tie:
        order.append(F.col(tie).asc())
    return df.orderBy(*order).limit(n)


def read_whole_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file_path, file_size, value): one row per file with its whole UTF-8 text (``binaryFile`` source).

    For small configuration-like files (cases, scenarios, reports) where a record can span
    lines or line numbers matter; each file is one task's worth of bytes.
    """
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r.load(path).select(F.col("path").alias("file_path"), F.col("length").alias("file_size"),
                               F.make_valid_utf8(F.col("content").cast("string")).alias("value"))


def scan_decision_stream(decisions: DataFrame, stream_id: str | None = None,
                         order_col: str = "stream_sequence") -> DataFrame:
    """SRC-12 / L5: the decisions of one stream (partition-filtered) in sequence order.

    With ``stream_id=None`` all streams are returned, range-partitioned by
    (stream_id, order_col) and sorted within partitions, so a hot stream spreads over
    many partitions while order is kept.
    """
    df = decisions if stream_id is None else decisions.filter(F.col("stream_id") == F.lit(stream_id))
    return df.orderBy("stream_id", order_col)
