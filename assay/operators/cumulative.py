"""Running totals that do not funnel a hot key into one task.

``sum(x) OVER (PARTITION BY provider ORDER BY ts)`` puts every row of a provider into a
single task; with four providers that is four tasks for the whole table.  Here Spark
range-partitions the rows on the order key alone and the number of a row's partition becomes
its slice; the sliced rows are written to the shared folder, so a slice is a stored value and
the same for every later read.  Each (key, slice) computes its local running sum in its own
window group, and the per-(key, slice) totals - a table with at most ``keys x slices`` rows -
are prefix-summed and added back.  One path at every size.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.session import checkpoint_dir


def materialised(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, and Spark knows its size."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slice_by_order(df: DataFrame, cols: Sequence[str], slices: int, out: str = "_slice") -> DataFrame:
    """Add ``out`` = number of the range partition that holds the composite order key ``cols``."""
    return materialised(df.repartitionByRange(max(1, slices), *cols).withColumn(out, F.spark_partition_id()), "slices")


def order_slices(df: DataFrame, cols: Sequence, rows: int) -> Iterator[DataFrame]:
    """``df`` in pieces of about ``rows`` rows, written to the shared folder, in the order of ``cols``; rows with equal
    ``cols`` stay together."""
    slices = max(1, -(-df.count() // rows))
    sliced = slice_by_order(df, cols, slices)
    for i in range(slices):
        yield sliced.where(F.col("_slice") == i).drop("_slice")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                slices: int | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` per ``keys`` in ``order`` (rows up to and including the current).

    ``order`` must be a total order within a key (end it with a unique column).
    """
    return running_sums(df, order, [(keys, value, out)], slices)


def running_sums(df: DataFrame, order: Sequence[str], specs: Sequence[tuple[Sequence[str], str, str]],
                 slices: int | None = None) -> DataFrame:
    """Several running sums over one ordering; ``specs`` = [(keys, value, out), ...].

    The rows are sliced once on ``order`` alone (global time / order ranges); that is valid for
    any partition keys - each (key, slice) group is a contiguous piece of that key's order - and
    it keeps every group no larger than one slice, however hot the key.
    """
    order = list(order)
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cur = slice_by_order(df, order, n)
    for keys, value, out in specs:
        keys = list(keys)
        w_local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        local = cur.withColumn("_local", F.sum(value).over(w_local))
        totals = cur.groupBy(*keys, "_slice").agg(F.sum(value).alias("_tot"))
        w_off = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*keys, "_slice", F.sum("_tot").over(w_off).alias("_off"))
        zero = F.lit(0).cast(df.schema[value].dataType)
        cur = local.join(offsets, [*keys, "_slice"], "left").withColumn(
            out, F.col("_local") + F.coalesce(F.col("_off"), zero)).drop("_local", "_off")
    return cur.drop("_slice")
