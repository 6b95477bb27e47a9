"""Near-duplicate vectors by spherical-cap filters with random product codes.

A filter is a direction, and a vector passes it if their inner product reaches a threshold:
it lies in the cap around the direction.  Similar vectors share caps far more often than
others do.  Directions are not free but products: after a random rotation the dimensions are
split into ``PARTS`` parts, each with a code of random unit vectors, and every combination of
codewords is a direction.  A vector is list-decoded to all directions above the threshold from
its inner products with the codewords alone: partial sums that can't reach the threshold with
the best remaining codewords are not followed.  ``CODES`` product codes with rotations of
their own even out the holes that the directions of one code leave.

With a the threshold in standard deviations of a random inner product, a pair at the cosine
sought shares a filter with probability p2(a), the bivariate normal tail.  The threshold is
set so that a cap holds about ``CAP_ROWS`` of n vectors in directions without structure, and
the number of filters so that a pair at the cosine sought shares ``SHARED`` filters on average;
closer pairs share more.  The pairs that share none are the only ones missed; none below the
cosine are linked, as all pairs of a cap are compared in double precision.

Equal vectors are one node, so a common vector costs nothing.  A cap of more than
``BLOCK`` nodes is split into blocks, and cells of two blocks are compared each for itself, so
no cap is held by one task.  A pair counts in the first cap that its two nodes share; a cell
gives, for each node, the number of rows it is linked with there, and a spanning forest of the
links, never the pairs.  Components of the forest edges are found over written tables.

Cases: vectors that are null, zero or hold null or non-finite components link with nothing and
are their own component; shorter vectors count as filled up with zeros; repeated rows and
equal vectors under other ids are linked with each other; a component's id is its smallest
non-null id, null where all are null, and a row without id is kept only then; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import column, written
from assay.llm.partenum import components

COSINE = 0.9
PARTS = 2
CODES = 8
# Nodes that a cap holds on average, by which the threshold follows the table's size.
CAP_ROWS = 128
# Caps that a pair at the cosine sought shares on average.
SHARED = 8.0
# Nodes compared with each other at a time.
BLOCK = 1024
SEED = 20011


def pair_tail(a: float, rho: float, steps: int = 400) -> float:
    """P(X >= a and Y >= a) of standard normals with correlation ``rho``."""
    normal, top = NormalDist(), a + 9.0
    width = (top - a) / steps
    at = [a + (i + 0.5) * width for i in range(steps)]
    return sum(normal.pdf(x) * normal.cdf((rho * x - a) / math.sqrt(1 - rho * rho)) for x in at) * width


class ProductCode:
    """A rotation and, for each part of the dimensions, ``each`` random codewords."""

    def __init__(self, width: int, parts: int, each: int, seed: int):
        rng = np.random.default_rng(seed)
        self.each = each
        self.rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
        self.cuts = np.linspace(0, width, parts + 1).astype(int)
        words = [rng.standard_normal((each, high - low)) for low, high in zip(self.cuts, self.cuts[1:])]
        # a part's codewords have the length that its share of the dimensions has in a unit vector
        self.words = [w / np.linalg.norm(w, axis=1)[:, None] * math.sqrt(w.shape[1] / width) for w in words]

    def decode(self, units: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of every direction whose inner product with a unit vector reaches the threshold."""
        turned = units @ self.rotation
        found = [turned[:, low:high] @ word.T for low, high, word in zip(self.cuts, self.cuts[1:], self.words)]
        rest = np.append(np.cumsum([f.max(1) for f in found[::-1]], axis=0)[::-1][1:], np.zeros((1, len(units))), axis=0)
        row, name, partial = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
        for products, best in zip(found, rest):
            grown = partial[:, None] + products[row]
            which, word = np.nonzero(grown + best[row][:, None] >= threshold)
            row, name, partial = row[which], name[which] * self.each + word, grown[which, word]
        return row, name


class Filters:
    """The filters of ``nodes`` vectors of ``width`` dimensions, by number."""

    def __init__(self, width: int, nodes: int, cosine: float = COSINE, seed: int = SEED):
        parts = min(PARTS, width)
        a = NormalDist().inv_cdf(1 - min(0.25, CAP_ROWS / max(nodes, 1)))
        each = math.ceil((SHARED / CODES / pair_tail(a, cosine)) ** (1 / parts))
        self.width, self.threshold, self.per_code = width, a / math.sqrt(width), each ** parts
        self.codes = [ProductCode(width, parts, each, seed + i) for i in range(CODES)]

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a unit vector passes, by row and filter."""
        found = [c.decode(units, self.threshold) for c in self.codes]
        row = np.concatenate([r for r, _ in found])
        name = np.concatenate([n + i * self.per_code for i, (_, n) in enumerate(found)])
        order = np.lexsort((name, row))
        return row[order], name[order]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is brought to 1 first, so nothing over- or underflows."""
    high = np.abs(vectors).max(1, initial=0)[:, None]
    out = vectors / high
    return out / np.sqrt((out * out).sum(1))[:, None]


def filled(lists: pa.Array, width: int) -> np.ndarray:
    """float rows, short ones filled up with zeros."""
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        own = v.values.to_numpy(zero_copy_only=False)
        out[i, :len(own)] = own
    return out


def usable(vec_col: str):
    """Whether a vector can be compared."""
    x = F.col(vec_col)
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(x.isNotNull() & fit & F.exists(x, lambda c: c != 0), F.lit(False))


def trimmed(vec_col: str):
    """A vector without trailing zeros, and no -0.0: equal vectors are equal arrays."""
    x = F.col(vec_col)
    last = F.array_max(F.transform(x, lambda c, i: F.when(c != 0, i + 1).otherwise(0)))
    return F.slice(F.transform(x, lambda c: F.when(c == 0, F.abs(c)).otherwise(c)), F.lit(1), last)


def vector_key():
    """128 bits that tell vectors apart; null for null."""
    return F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(SEED), "v").alias("y")))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, v, least_id, size): one row per distinct vector."""
    distinct = rows.groupBy("v").agg(F.min("id").alias("least_id"), F.count("*").alias("size"))
    return written(distinct.select(F.monotonically_increasing_id().alias("node"), "v", "least_id", "size"), "vectors")


def passed(nodes: DataFrame, filters: Filters) -> DataFrame:
    """(cap, earlier, node, size, v): a row per node and filter, with the smaller filters of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cap = filters.decode(scaled(filled(column(batch, "v"), filters.width)))
            first = np.searchsorted(row, row)  # place of the row's first filter
            earlier = [cap[a:b] for a, b in zip(first, range(len(row)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cap), pa.array(earlier, pa.list_(pa.int64())), *(column(batch, n).take(pa.array(row)) for n in own)],
                names=["cap", "earlier", *own])

    own = ("node", "size", "v")
    kind = nodes.schema["v"].dataType.simpleString()
    return nodes.select(*own).mapInArrow(run, f"cap long, earlier array<bigint>, node long, size long, v {kind}")


def cells(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows dealt to (cap, left, right): every two nodes of a cap meet in one cell, which holds two blocks at most."""
    counts = rows.groupBy("cap").count().filter(F.col("count") > block)
    # written, so that Spark knows its size when it picks the join: small ones leave the rows in place
    large = written(counts.select("cap", F.ceil(F.col("count") / block).alias("blocks")), "large-caps")
    split = rows.join(large, "cap", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), blocks).cast("long")
    met = split.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return met.select("cap", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own",
                      "node", "size", "v", "earlier")


def counted_once(earlier: list[np.ndarray]) -> np.ndarray:
    """Whether no earlier filter is shared, for every two rows."""
    names, where = np.unique(np.concatenate(earlier), return_inverse=True)
    held = np.zeros((len(earlier), len(names)), np.float32)
    held[np.repeat(np.arange(len(earlier)), [len(e) for e in earlier]), where] = 1
    return held @ held.T == 0


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, fewer than there are rows."""
    unseen, edges = np.ones(len(links), bool), []
    for start in range(len(links)):
        if unseen[start]:
            unseen[start], queue = False, [start]
            while queue:
                at = queue.pop()
                new = np.nonzero(links[at] & unseen)[0]
                unseen[new] = False
                edges += [(at, int(j)) for j in new]
                queue += new.tolist()
    return edges


def compared(own: np.ndarray, left: int, right: int, vectors: np.ndarray, earlier: list[np.ndarray], cosine: float) -> np.ndarray:
    """The links of a cell that no earlier cap has, as a symmetric matrix."""
    units = scaled(vectors)
    near = units @ units.T >= cosine
    near[np.diag_indices(len(near))] = False
    if left != right:  # pairs of one block meet in that block's own cell
        near &= own[:, None] != own
    some = np.nonzero(near.any(1))[0]
    out = np.zeros_like(near)
    if len(some):
        out[np.ix_(some, some)] = near[np.ix_(some, some)] & counted_once([earlier[i] for i in some])
    return out


def links_in_cells(dealt: DataFrame, width: int, cosine: float = COSINE) -> DataFrame:
    """(a, links, b): rows that node a is linked with in a cell, or (b given) an edge of a spanning forest."""
    key = ("cap", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None

        def done() -> pa.RecordBatch:
            node, linked, other = [], [], []
            if held and sum(b.num_rows for b in held) > 1:
                cell = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                ids, sizes = (column(cell, n).to_numpy() for n in ("node", "size"))
                earlier = [e.values.to_numpy() for e in column(cell, "earlier")]
                near = compared(column(cell, "own").to_numpy(), name[1], name[2], filled(column(cell, "v"), width), earlier, cosine)
                totals = near @ sizes
                has = np.nonzero(totals)[0]
                edges = forest(near)
                node = [*ids[has].tolist(), *(int(ids[a]) for a, _ in edges)]
                linked = [*totals[has].tolist(), *[0] * len(edges)]
                other = [*[None] * len(has), *(int(ids[b]) for _, b in edges)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (node, linked, other)], names=["a", "links", "b"])

        for batch in batches:
            keys = np.array([column(batch, k).to_numpy() for k in key]).T
            starts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)]
            for low, high in zip(starts, starts[1:]):
                if low < high:
                    if name is not None and tuple(keys[low]) != name:
                        yield done()
                        held = []
                    name = tuple(keys[low].tolist())
                    held.append(batch.slice(low, high - low))
        yield done()

    ordered = dealt.repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(run, "a long, links long, b long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(usable(vec_col), trimmed(vec_col)).alias("v"))
    nodes = nodes_of(rows.filter(F.col("v").isNotNull()))
    count, width = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    filters = Filters(width or 1, count, cosine)
    found = written(links_in_cells(cells(written(passed(nodes, filters), "caps")), filters.width, cosine), "links")
    linked = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null").select("a", "b"))
    named = nodes.drop("v").join(linked, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    told = named.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    # the rows of a common vector share a key; Spark splits such partitions of the left side
    by_vector = told.join(nodes.select("node", vector_key().alias("key")), "node").drop("node")
    joined = rows.withColumn("key", vector_key()).join(by_vector, "key", "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.col("id").eqNullSafe(component).alias("kept"))


def near_duplicate_rows(embeddings: DataFrame) -> DataFrame:
    """The contract's rows."""
    return near_duplicates(embeddings).withColumnRenamed("id", "vec_id")
