"""Whitening of embeddings from exact integer cross-products, counted on bit planes.

Entries become whole numbers ``floor(scale * c)``, and the fit list holds each distinct
vector once.  A task cuts its share of the list into blocks of ``BLOCK_ROWS`` rows, shifts
every dimension by its least value in the block and packs each bit plane across the rows into
64-bit words.  ``sum of 2^(b+c) * popcount(plane b of i AND plane c of j)`` is the exact cross-
product of two shifted dimensions; the shift is taken back in whole numbers.  A dimension of
ones rides along, so that its products are the sums and the row count.

A task gives one row per pair of dimensions, as limbs of 32 bits whose sums can't overflow;
Spark adds them up, and only the sums reach the driver: (d + 1)(d + 2) / 2 rows for d
dimensions, however many vectors there are.  The scatter ``n * P - S S'`` is centred in whole
numbers, divided by n^2 with correct rounding, and decomposed by ``eigh``.

Cases: vectors that are null or hold null or non-finite entries are dropped; shorter vectors
count as filled up with zeros; rows without id stay, with a null id; repeated rows count once
in the fit list and are returned each; entries beyond 64 bits count as the nearest 64-bit
number; a deviation beyond 64 bits is null; components whose eigenvalue is zero (within
rounding) have no whitened coordinate and are not returned, so a single distinct vector, like
an empty table, gives no rows; equal eigenvalues come in the order of ``eigh``; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import column, written

SCALE = 256
COMPONENTS = 4
# Rows packed at a time: 64 words a plane.
BLOCK_ROWS = 4096
LIMBS = 5
LIMB_BITS = 32
# Whole numbers below this are computed in 64 bits, larger ones as Python integers.
SAFE = 2 ** 62


@dataclass(frozen=True)
class Whitening:
    """What the fit list says; rows of ``vectors`` are unit eigenvectors."""

    n: int
    sums: tuple[int, ...]
    scale: int
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole_vectors(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows that remain."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return df.filter(F.col(vec_col).isNotNull()).filter(usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"))


def filled(rows: DataFrame, width: int) -> DataFrame:
    """Shorter vectors filled up with zeros."""
    missing = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < width, F.concat("x", missing)).otherwise(F.col("x")))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """int64 rows of the batch's ``x``."""
    return column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, bit) of every bit plane of unsigned columns: a row of 64-bit words each."""
    lengths = np.array([int(m).bit_length() for m in shifted.max(0)])
    words, dimension, bit = [], [], []
    for b in range(lengths.max(initial=0)):
        wide = np.nonzero(lengths > b)[0]
        packed = np.packbits(((shifted[:, wide] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        words.append(np.ascontiguousarray(packed).view(np.uint64))
        dimension.append(wide)
        bit.append(np.full(len(wide), b))
    if not words:
        return np.zeros((0, 1), np.uint64), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(words), np.concatenate(dimension), np.concatenate(bit)


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums of x_i * x_j over the rows, as Python integers; the last dimension is the ones."""
    rows, width = len(x), x.shape[1] + 1
    low = x.min(0)
    words, dimension, bit = planes(x.view(np.uint64) - low.view(np.uint64))  # modulo 2**64: never negative
    together = np.zeros((len(words), len(words)), np.int64)
    for i in range(len(words)):
        together[i, i:] = together[i:, i] = np.bitwise_count(words[i:] & words[i]).sum(1, dtype=np.int64)
    narrow = rows << (2 * int(bit.max(initial=0)) + 2) < SAFE
    weights = np.zeros((width, len(words)), np.int64 if narrow else object)
    weights[dimension, np.arange(len(words))] = [1 << int(b) for b in bit]
    counted = together if narrow else together.astype(object)
    product = (weights @ counted @ weights.T).astype(object)
    shifted_sums = (weights @ np.diagonal(counted)).astype(object)
    shift = np.array([*map(int, low), 1], object)
    return product + np.outer(shift, shifted_sums) + np.outer(shifted_sums, shift) + rows * np.outer(shift, shift)


def limbs(value: int) -> list[int]:
    """32-bit digits, the last one signed: sums of digits make up the sum of the values."""
    out = []
    for _ in range(LIMBS - 1):
        value, low = value >> LIMB_BITS, value & (1 << LIMB_BITS) - 1
        out.append(low)
    return [*out, value]


def scatter(fit_list: DataFrame, width: int) -> list[list[int]]:
    """The cross-products of all rows, the ones included."""
    names = ["i", "j", *(f"l{k}" for k in range(LIMBS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, count = None, [], 0

        def add() -> None:
            nonlocal total, held, count
            if count:
                own = cross_products(np.concatenate(held))
                total = own if total is None else total + own
            held, count = [], 0

        for batch in batches:
            if batch.num_rows:
                held.append(matrix(batch, width))
                count += batch.num_rows
            if count >= BLOCK_ROWS:
                add()
        add()
        if total is not None:
            rows = [(i, j, *limbs(total[i, j])) for i in range(width + 1) for j in range(i, width + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    schema = ", ".join(f"{n} long" for n in names)
    added = fit_list.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(*(F.sum(n).alias(n) for n in names[2:]))
    out = [[0] * (width + 1) for _ in range(width + 1)]
    for r in added.collect():  # one row per pair of dimensions
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = sum(r[f"l{k}"] << (LIMB_BITS * k) for k in range(LIMBS))
    return out


def decomposed(products: list[list[int]], scale: int, components: int) -> Whitening | None:
    """Mean, covariance and its leading eigenvectors; ``None`` where nothing varies."""
    width, n = len(products) - 1, products[-1][-1]
    if not n or not width:
        return None
    sums = products[-1][:-1]
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    trace = sum(centred[i][i] for i in range(width)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    varies = values > width * np.finfo(float).eps * max(values[0], 0)
    if not varies.any():
        return None
    return Whitening(n, tuple(sums), scale, vectors[varies], values[varies], trace)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened): the exact deviation from the mean and the whitened coordinates of (id, x)."""
    n, sums = model.n, np.array(model.sums, object)
    turn = (model.vectors / np.sqrt(model.eigenvalues)[:, None]).T
    largest = max(abs(s) for s in model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, len(sums))
            most = n * int(np.abs(x.astype(float)).max(initial=0) + 1) + largest
            if most * most * len(sums) < SAFE:
                apart = n * x - sums.astype(np.int64)
                deviation = pa.array((apart * apart).sum(1), pa.int64())
            else:
                apart = n * x.astype(object) - sums
                exact = [int((row * row).sum()) for row in apart]
                deviation = pa.array([d if d < 2 ** 63 else None for d in exact], pa.int64())
            white = (apart.astype(float) / n) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * turn.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), deviation, lists], names=["id", "deviation", "whitened"])

    return rows.mapInArrow(run, "id long, deviation long, whitened array<double>")


def fit(rows: DataFrame, width: int, scale: int = SCALE, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The fit list (written) of (id, x) and its model."""
    fit_list = written(rows.select("x").distinct(), "fit-list")
    return fit_list, decomposed(scatter(fit_list, width), scale, components) if width else None


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.eigenvalues)
    own = whitened(fit_list.select(F.lit(None).cast("long").alias("id"), "x"), model)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    one = own.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in cells)).first()
    return max(abs(one[f"c{i}_{j}"] - (i == j)) for i, j in cells)


def whitening_rows(embeddings: DataFrame) -> DataFrame:
    """The contract's rows."""
    rows = whole_vectors(embeddings)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = filled(rows, width)
    fit_list, model = fit(rows, width)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    explained = F.array(*(F.lit(float(e) / model.trace) for e in model.eigenvalues))
    own = whitened(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return own.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                      "deviation", F.col("value").alias("whitened"), F.get(explained, F.col("at")).alias("explained"),
                      F.lit(identity_error(fit_list, model)).alias("identity_error"))
