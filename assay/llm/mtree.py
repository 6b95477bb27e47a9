"""Exact top-k by inner product with M-trees and best-first search.

The vectors are dealt into cells by the nearest of a few pivots (a bounded sample), and a
cell into blocks of at most about ``TREE_BYTES``, however many rows it holds.  Every block is
bulk-loaded into an M-tree: pages hold a routing vector, the covering radius around it, its
distance to the parent's routing vector, the largest norm and the smallest id below it; leaf
pages hold vectors with their distances to the routing vector.

With d the Euclidean distance, ``q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2``, so a lower bound of
the distance bounds the score from above.  The triangle inequality gives such bounds from
stored distances alone: ``|d(q, p) - d(c, p)| - r`` for a page c with parent p, and
``|d(q, c) - d(x, c)|`` for a vector x of leaf c; pages and vectors whose bound is below a
query's k-th best score are not computed, nor are ties with it where all ids are larger.
Queries go through a tree in blocks, the page with the best bound first.  A query starts with
the k-th best score among a bounded sample of all vectors; that is a lower bound of its final
one, so nothing is lost.

Every query meets every tree.  A task holds a tile of the queries, at most ``TILE_BYTES`` with
their results, and reads its part of the trees as a stream, one tree at a time; tiles and
trees are moved as rows of at most about ``TREE_BYTES``, so a task's memory doesn't grow with
the table.  Results of a task are the k best of each query; they are shuffled.

Cases: vectors that are null or hold null or non-finite components, and rows without id,
take no part; shorter vectors count as filled up with zeros; with fewer than k candidates
all are returned; ties go to the smaller id; repeated rows are candidates each for itself
and only the query's own row is left out; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import at_rest, column, extended, written
from assay.llm.sharding import number_slots

SCALE = 64
TOP = 20
# Vectors of a tree or a packed row of queries: Arrow batches hold 256 of these rows.
TREE_BYTES = 1 << 16
# Queries of a task with their results.
TILE_BYTES = 1 << 26
# Queries that go through a tree together.
QUERY_BLOCK = 4096
LEAF = 256
FANOUT = 4
MAX_PIVOTS = 64
# Vectors whose scores give the queries their first thresholds.
SAMPLE = 4096
# Tasks of the search for each that runs at once.
WAVES = 2
# Intervals of a leaf's distances over which a bound of all queries is taken.
STEPS = 4
SLACK = 1e-7
NEVER = np.iinfo(np.int64).min
# What a page holds of the pages below it, by their own names.
OF_PAGES = {"radii": "radius", "parent_distances": "parent_distance", "squares": "square", "leasts": "least"}


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, id, v): ``floor(scale * x)`` per component of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    rows = df.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).filter(usable)
    return written(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                               whole.alias("v")), "vectors")


@dataclass(frozen=True)
class Shape:
    """Width of the vectors and the least and largest of their components."""

    width: int
    least: int
    largest: int

    @property
    def stored(self) -> np.dtype:
        """The smallest type that holds the components."""
        return next(np.dtype(t) for t in (np.int8, np.int16, np.int32, np.int64)
                    if np.iinfo(t).min <= self.least and self.largest <= np.iinfo(t).max)

    @property
    def computed(self) -> np.dtype:
        """The smallest type whose inner products are exact: in floating point while all sums stay in the mantissa."""
        most = max(abs(self.least), abs(self.largest)) ** 2 * max(1, self.width)
        return np.dtype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64)

    def rows(self, size: int, more: int, computed: bool = False) -> int:
        """Vectors that fit ``size`` bytes with ``more`` bytes each beside them."""
        return max(1, size // (self.width * (self.computed if computed else self.stored).itemsize + more))

    def matrix(self, vectors: pa.ListArray) -> np.ndarray:
        """Rows of the vectors, short ones filled up with zeros."""
        out = np.zeros((len(vectors), self.width), self.stored)
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        out[np.arange(self.width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products.  Vectors in floating point are known to fit (``Shape.computed``)."""
    if a.dtype.kind == "f":
        return a @ b.T
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if float(most) ** 2 * max(1, a.shape[1]) < 2.0 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.astype(float), b.astype(float)
    square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def bulk_load(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, center: np.ndarray | None = None,
              parent_distance: float = 0.0) -> dict:
    """A page over the vectors and the pages below it."""
    if center is None:
        center = np.rint(vectors.mean(0)).astype(vectors.dtype)
    to_center = distances(vectors, center[None])[:, 0]
    square = (vectors.astype(float) ** 2).sum(1)
    page = {"center": center, "radius": float(to_center.max()), "parent_distance": parent_distance,
            "square": float(square.max()), "least": int(ids.min())}
    if len(ids) <= LEAF:
        return page | {"rows": rows, "ids": ids, "vectors": vectors, "distances": to_center, "squares": square}
    chosen = [int(to_center.argmax())]  # routing vectors far from each other
    nearest = distances(vectors, vectors[chosen])[:, 0]
    owner = np.zeros(len(ids), int)
    while len(chosen) < FANOUT and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        d = distances(vectors, vectors[chosen[-1:]])[:, 0]
        owner[d < nearest] = len(chosen) - 1
        nearest = np.minimum(nearest, d)
    if not owner.any():  # equal vectors: pages of rising ids
        owner[np.lexsort((rows, ids))] = np.arange(len(ids)) // LEAF
        chosen = chosen[:1] * (int(owner.max()) + 1)
    pages = [bulk_load(rows[part], ids[part], vectors[part], vectors[c], float(to_center[c]))
             for k, c in enumerate(chosen) if (part := owner == k).any()]
    return page | {"pages": pages, "centers": np.stack([p["center"] for p in pages])} | {
        n: np.array([p[own] for p in pages]) for n, own in OF_PAGES.items()}


def loaded(page: dict, computed: np.dtype) -> dict:
    """The page with its vectors in the type that they are computed in."""
    own = {n: page[n].astype(computed) for n in ("center", "centers", "vectors") if n in page}
    return page | own | ({"pages": [loaded(p, computed) for p in page["pages"]]} if "pages" in page else {})


class Queries:
    """A block of queries with their k best candidates so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.rows, self.ids, self.vectors, self.k = rows, ids, vectors, k
        self.real = vectors if vectors.dtype.kind == "f" else vectors.astype(float)
        self.square = (vectors.astype(float) ** 2).sum(1)
        self.threshold = floor.copy()
        self.last = np.full(len(ids), np.iinfo(np.int64).max)  # id of the k-th best
        self.count = np.zeros(len(ids), np.int64)
        self.scores, self.found = (np.zeros((len(ids), k), np.int64) for _ in range(2))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (query, score, id) not among the best yet
        self.waits = 0

    def distances(self, centers: np.ndarray) -> np.ndarray:
        square = self.square[:, None] + (centers.astype(float) ** 2).sum(1) - 2.0 * (self.real @ centers.T)
        return np.sqrt(np.maximum(square, 0))

    def bound(self, low: np.ndarray, square) -> np.ndarray:
        """Largest possible score at a distance of ``low`` at least."""
        most = (self.square[:, None] + square - np.maximum(low, 0) ** 2) / 2
        return most + SLACK * (1 + self.square[:, None] + square)

    def needed(self, least) -> np.ndarray:
        """Score that a candidate whose id is ``least`` or more needs; scores are whole numbers."""
        return self.threshold + (least > self.last)

    def useful(self, active: np.ndarray, page: dict, to_page: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """Places in a leaf of the vectors whose bound reaches a query's score.

        Of ``|q|^2 + |x|^2 - (d(q, c) - d(x, c))^2 >= 2 needed`` what depends on q is a line over d(x, c); the
        largest of all lines is convex, so it lies below its chords.
        """
        a, b, square = to_page[active], page["distances"], self.square[active]
        slack = 2 * SLACK * (1 + square + (1 + a) * (1 + a + b.max()))
        ends = np.unique(np.linspace(b.min(), b.max(), STEPS + 1))
        largest = (square - 2.0 * needed - a * a + slack + 2 * ends[:, None] * a).max(1)
        return np.nonzero(np.interp(b, ends, largest) + (1 + 2 * SLACK) * page["squares"] - b * b >= 0)[0]

    def offer(self, which: np.ndarray, needed: np.ndarray, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = scores >= needed.astype(scores.dtype)[:, None]
        some = np.flatnonzero(hit.any(1))  # few
        i, j = np.nonzero(hit[some])
        i = some[i]
        other = rows[j] != self.rows[which[i]]
        i, j = i[other], j[other]
        if len(i):
            self.waiting.append((which[i], scores[i, j].astype(np.int64), ids[j]))
            self.waits += len(i)
        if self.waits >= len(self.ids) * self.k // 2:
            self.settle()

    def settle(self) -> None:
        """What waits joins the best."""
        if not self.waiting:
            return
        some = np.unique(np.concatenate([w[0] for w in self.waiting]))
        held = np.arange(self.k) < self.count[some][:, None]
        best = (np.repeat(some, self.count[some]), self.scores[some][held], self.found[some][held])
        q, score, ids = (np.concatenate(x) for x in zip(best, *self.waiting))
        self.waiting, self.waits = [], 0
        order = np.lexsort((ids, -score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order, place = order[place < self.k], place[place < self.k]
        self.scores[q[order], place], self.found[q[order], place] = score[order], ids[order]
        self.count[some] = np.bincount(q[order], minlength=len(self.ids))[some]
        full = some[self.count[some] == self.k]
        self.threshold[full], self.last[full] = self.scores[full, -1], self.found[full, -1]

    def search(self, root: dict) -> None:
        """Best-first through one tree."""
        turn = 0
        to_root = self.distances(root["center"][None])[:, 0]
        low = to_root - root["radius"] - SLACK * (1 + to_root)
        queue = [(0.0, turn, root, to_root, self.bound(low[:, None], root["square"])[:, 0])]
        while queue:
            _, _, page, to_page, bound = heapq.heappop(queue)
            needed = self.needed(page["least"])
            active = np.nonzero(bound >= needed)[0]
            if not len(active):
                continue
            if "pages" not in page:
                useful = self.useful(active, page, to_page, needed[active])
                if len(useful):
                    own = self.vectors if len(active) == len(self.ids) else self.vectors[active]
                    rows, ids, vectors = (page[n] if len(useful) == len(page["ids"]) else page[n][useful]
                                          for n in ("rows", "ids", "vectors"))
                    self.offer(active, needed[active], rows, ids, products(own, vectors))
                continue
            needed = self.needed(page["leasts"][:, None]).T
            # before any distance to the children is computed
            low = np.abs(to_page[:, None] - page["parent_distances"]) - page["radii"] - SLACK * (1 + to_page)[:, None]
            open_ = np.nonzero((self.bound(low, page["squares"]) >= needed)[active].any(0))[0]
            to_child = self.distances(page["centers"][open_])
            own = to_child - page["radii"][open_] - SLACK * (1 + to_child)
            bounds = np.minimum(bound[:, None], self.bound(own, page["squares"][open_]))
            gains = (bounds - needed[:, open_])[active].max(0, initial=-1.0)
            for at in np.nonzero(gains >= 0)[0]:
                turn += 1
                child = page["pages"][open_[at]]
                heapq.heappush(queue, (-float(gains[at]), turn, child, to_child[:, at], bounds[:, at]))

    def columns(self) -> list[np.ndarray]:
        """Query rows, query ids, ids and scores of the best."""
        self.settle()
        held = np.arange(self.k) < self.count[:, None]
        return [np.repeat(self.rows, self.count), np.repeat(self.ids, self.count), self.found[held], self.scores[held]]

    def results(self) -> Iterator[tuple[int, int, int, int]]:
        yield from zip(*(x.tolist() for x in self.columns()))


def drawn(vectors: DataFrame, n: int, size: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Rows and vectors of least hash, ``size`` of all n; hashes that are hardly among them don't go to the driver."""
    key, share = F.xxhash64("row"), (2 * size + 100) / max(1, n)
    some = vectors.filter(key < int(share * 2.0 ** 64) - (1 << 63)) if share < 1 else vectors
    found = some.orderBy(key, "row").limit(size).select("row", "v").collect()
    return np.array([r["row"] for r in found], np.int64), shape.matrix(pa.array([r["v"] for r in found], pa.list_(pa.int64())))


def to_blocks(vectors: DataFrame, n: int, shape: Shape, block: int) -> DataFrame:
    """(row, id, v, cell, block): nearest pivot and a part of its cell of at most about ``block`` rows; v as bytes."""
    _, centers = drawn(vectors, n, max(1, min(MAX_PIVOTS, n // (2 * block))), shape)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shape.matrix(column(batch, "v"))
            cell = distances(own, centers).argmin(1) if len(own) else np.zeros(0, int)
            yield extended(batch, ["row", "id"], {"v": pa.array([v.tobytes() for v in own], pa.binary()),
                                                  "cell": pa.array(cell, pa.int32())})

    celled = vectors.mapInArrow(nearest, "row long, id long, v binary, cell int")
    parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    # one row per cell, at most MAX_PIVOTS
    return celled.join(F.broadcast(parts), "cell").withColumn("block", F.col("cell") * F.lit(1 << 32) + part)


def trees(vectors: DataFrame, n: int, shape: Shape) -> DataFrame:
    """(number, data): one M-tree per block, numbered from 0."""

    def build(block: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(b"".join(block["v"]), shape.stored).reshape(len(block), shape.width)
        root = bulk_load(block["row"].to_numpy(), block["id"].to_numpy(), own)
        return pd.DataFrame({"block": block["block"].iloc[:1], "data": [pickle.dumps(root)]})

    # 32 bytes of a vector are its row, id, norm and distance
    blocks = to_blocks(vectors, n, shape, shape.rows(TREE_BYTES, 32))
    built = blocks.groupBy("block").applyInPandas(build, "block long, data binary")
    return number_slots(built.withColumn("forest", F.lit(0)), "forest", "number").select("number", "data")


def query_blocks(vectors: DataFrame, n: int, is_query, shape: Shape, k: int) -> DataFrame:
    """(number, data): rows, ids, vectors and first thresholds of queries, packed, numbered from 0."""
    sample_rows, sample_vectors = drawn(vectors, n, SAMPLE, shape)
    size = shape.rows(TREE_BYTES, 24)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = (column(batch, n).to_numpy() for n in ("row", "id"))
            own = shape.matrix(column(batch, "v"))
            scores = products(own.astype(shape.computed), sample_vectors.astype(shape.computed))
            scores[rows[:, None] == sample_rows] = NEVER
            floor = np.partition(scores, -k, 1)[:, -k].astype(np.int64) if scores.shape[1] >= k else np.full(len(ids), NEVER)
            packed = [pickle.dumps(tuple(x[at:at + size] for x in (rows, ids, own, floor))) for at in range(0, len(ids), size)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["data"])

    packed = vectors.filter(is_query).mapInArrow(pack, "data binary")
    return number_slots(packed.withColumn("asked", F.lit(0)), "asked", "number").select("number", "data")


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP) -> DataFrame:
    """(query_id, rank, id, score): the k best other rows of every row for which ``is_query(id column)`` holds."""
    vectors = integer_vectors(df, id_col, vec_col)
    asks = is_query(F.col("id"))
    n, width, least, largest, queries = vectors.agg(
        F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v")), F.count_if(asks)).first()
    shape = Shape(width or 1, min(0, least or 0), max(0, largest or 0))
    forest = trees(vectors, n, shape)
    asked = query_blocks(vectors, n, asks, shape, k)
    # 16 bytes of a query for each result, 64 for its row, id, norm, threshold and the like
    tiles = max(1, -(-queries // shape.rows(TILE_BYTES, 16 * k + 64, computed=True)))
    parts = max(1, min(forest.count(), -(-WAVES * df.sparkSession.sparkContext.defaultParallelism // tiles)))

    def sent(rows: DataFrame, number, first, last, step: int) -> DataFrame:
        return rows.select(F.explode(F.sequence(first.cast("int"), last.cast("int"), F.lit(step))).alias("task"),
                           number.cast("long").alias("number"), "data")

    # task t has tile t // parts of the queries and part t % parts of the trees; the queries come first
    tile, part = F.col("number") % tiles, F.col("number") % parts
    visits = sent(asked, F.lit(-1), tile * parts, (tile + 1) * parts - 1, 1).unionByName(
        sent(forest, F.col("number"), part, part + (tiles - 1) * parts, parts))
    dealt = visits.repartitionById(tiles * parts, F.col("task")).sortWithinPartitions("number")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, blocks = [], []
        for batch in batches:
            for number, data in zip(column(batch, "number").to_pylist(), column(batch, "data")):
                if number < 0:
                    packed.append(pickle.loads(data.as_buffer()))
                    continue
                if packed:
                    rows, ids, own, floor = (np.concatenate(x) for x in zip(*packed))
                    packed, cuts = [], [slice(at, at + QUERY_BLOCK) for at in range(0, len(ids), QUERY_BLOCK)]
                    blocks = [Queries(rows[c], ids[c], own[c].astype(shape.computed), floor[c], k) for c in cuts]
                if blocks:
                    root = loaded(pickle.loads(data.as_buffer()), shape.computed)
                    for block in blocks:
                        block.search(root)
        for block in blocks:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.columns()],
                                             names=["query_row", "query_id", "id", "score"])

    found = dealt.mapInArrow(lambda batches: at_rest(search(batches)), "query_row long, query_id long, id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


def top_rows(embeddings: DataFrame) -> DataFrame:
    """The contract's rows."""
    found = top_k(embeddings, lambda i: i % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
