"""Shared helpers of the operators: session set-up, shared-folder tables, record keys."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import checkpoint_dir, configure

# Rows per Arrow batch handed to a Python worker: a batch of whole texts stays a few MB.
ARROW_BATCH_ROWS = 256
# Words are maximal runs of anything but space, tab, LF, VT, FF, CR (fixed by the contract).
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the cluster's shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and values that
    depend on how the input was split (partition ids) are fixed from here on.
    """
    spark = df.sparkSession
    path = posixpath.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Key of a row's content: equal rows share it, different rows don't (128 bits)."""
    parts = F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), text_or_empty(text_col))
    return F.unhex(F.md5(parts))


def words(col: Column) -> Column:
    """Words of a text as an array; empty for texts without words."""
    return F.filter(F.split(col, SPACE_CLASS + "+"), lambda w: w != "")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def extended(batch: pa.RecordBatch, keep: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch, untouched (nulls and all), and new ones after them."""
    return pa.RecordBatch.from_arrays([*(column(batch, n) for n in keep), *added.values()], names=[*keep, *added])


def at_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task.  Behind them, memory that Arrow holds unused goes back: workers outlive tasks and stages."""
    yield from batches
    pa.default_memory_pool().release_unused()


def held(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name can clash with a helper column."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def unfolded(df: DataFrame, docs: DataFrame, struct: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` again from their struct, some of them changed."""
    changed = changed or {}
    return df.select(*(changed.get(c, F.col(struct)[c]).alias(c) for c in docs.columns))
