"""Jaccard self-join of word-shingle sets by PartEnum signatures, and its components.

Sizes a <= b with ``100 * |A & B| >= T * |A | B|`` differ in at most
``d(a, b) = floor((a + b) * (100 - T) / (100 + T))`` elements.  Sizes fall into bands that
double; a band has a fixed partitioning of the hash domain, and each partition's content is
a signature.  Two sets that differ in d elements differ in at most d partitions, so in any
global order of signatures each set's first d + 1 hold one that both share (empty
partitions come last and are only a signature where a set has too few others).  A set signs in its own band with d for the
largest partner it can have, and in the band below if it can have partners there.  The order
puts signatures of shingles that are frequent in a bounded sample of documents last: any
order gives the same result, this one avoids buckets of unrelated documents that share a
passage.

Equal sets are one node.  Signatures carry 64 bits of its 128-bit key; where sets share these,
all but one are renamed and are candidates too.  Sharing a signature makes candidates.  Buckets of the same
members count once, and before all pairs of a bucket are compared, buckets of nearly the same members become
their union, so a pair of large sets is met in a few groups and not in each of the signatures it shares.  First the neighbours in each bucket, in a few orders, are compared and linked
sets are merged into components, then every pair of a
group that is still in different components and whose sizes and parity sketches allow
similarity.  A pair inside one component needs no check, so nothing is lost and no bucket of
copies is expanded into pairs.  Distinct pairs meet a second sketch whose length follows the size
of the set, so nearly only similar pairs are compared exactly.  Components come from
alternating large-star and small-star steps, with a written table between them.

Cases: null and empty texts and texts of white space have an empty set, size 0 and stand
alone; texts of fewer than five words are one shingle; null ids are kept, never the
component of others unless no row of the component has an id; repeated rows are linked as
equal sets; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import column, held, text_or_empty, unfolded, written

SHINGLE = 5
THRESHOLD = 75
# Documents whose shingles tell frequent ones; how often in the sample makes one frequent,
# and how many of these are told to the tasks.  None of them changes a result.
SAMPLE = 32768
FREQUENT = 2
FREQUENT_ENTRIES = 1 << 17
# Words of a set's parity sketch; see ``sketch``.
SKETCH_WORDS = 8
# Texts of candidates are found by a bitmap of so many slots, which bounds the broadcast.
SLOTS = 1 << 20
HELD_SETS = 256
# Orders in which the neighbours of a bucket are compared before all its pairs are.
ORDERS = 16
# How often buckets of nearly the same members are merged.
MERGES = 2

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(tokens), seed=len(tokens))], np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    out, n = np.zeros(len(tokens) - SHINGLE + 1, np.uint64), len(tokens) - SHINGLE + 1
    for k in range(SHINGLE):
        out = mixed(out * MIX + one[k:k + n])
    return np.unique(out)


def most_apart(a: int, b: int, threshold: int) -> int:
    return (a + b) * (100 - threshold) // (100 + threshold)


def band_of(size: int) -> int:
    return size.bit_length() - 1


def partitions_of(band: int) -> int:
    """Partitions of a band of sizes 2**band to 2**(band+1) - 1: fine enough that a set may leave
    out more than half of its content, such as passages that many documents share."""
    return max(4 << band, 1 << 10)


def sketch(hashes: np.ndarray) -> list[int]:
    """Parities of the set's counts in 64 * SKETCH_WORDS cells.  An element of one set alone
    flips one bit, so two sketches differ in at most as many bits as the sets in elements."""
    bits = np.bincount((mixed(hashes + MIX) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def parity(hashes: np.ndarray) -> bytes:
    """A sketch of more cells than the set has elements.  Cells are a power of two in number and a
    cell is the low bits of a hash, so a longer sketch folds into a shorter one by XOR."""
    cells = 1 << max(9, len(hashes).bit_length())
    return np.packbits((np.bincount((mixed(hashes + MIX) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def apart_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the elements that stand in one of two sets only, from their parities."""
    cells = min(len(a), len(b))
    fold = lambda x: np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, cells // 8), axis=0)
    return int(np.bitwise_count(fold(a) ^ fold(b)).sum())


def may_be_similar(a: str, b: str, threshold: int):
    """Whether sizes and sketches of two sets (columns ``size_x`` and ``sketch_x``) allow similarity."""
    size_a, size_b = F.col(f"size_{a}"), F.col(f"size_{b}")
    apart = sum((F.bit_count(F.col(f"sketch_{a}")[i].bitwiseXOR(F.col(f"sketch_{b}")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    return (100 * F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b)) & (
        apart * (100 + threshold) <= (size_a + size_b) * (100 - threshold))


class Signer:
    """Signatures of sets, rarest first."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, threshold: int):
        self.frequent, self.counts, self.threshold = frequent, counts, threshold

    def often(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, self.counts[at], 0)

    def in_band(self, hashes: np.ndarray, often: np.ndarray, band: int, wanted: int) -> np.ndarray:
        """The first ``wanted`` signatures of a set in a band's partitioning."""
        scrambled = mixed(hashes ^ MIX)
        part = (scrambled >> np.uint64(20)) % np.uint64(partitions_of(band))
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
        content = np.add.reduceat(scrambled[order], first)
        rarest = np.minimum.reduceat(often[order], first)
        found = mixed(content ^ mixed(part[first] * MIX + np.uint64(band + 1)))
        if len(found) < wanted:  # partitions that are empty in both sets may be all they share
            return np.append(found, mixed(np.array([band + 1], np.uint64)))
        return found[np.lexsort((found, rarest))[:wanted]]

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        size, t = len(hashes), self.threshold
        if not size:
            return hashes
        often, band = self.often(hashes), band_of(size)
        out = [self.in_band(hashes, often, band, most_apart(size, size * 100 // t, t) + 1)]
        below = (1 << band) - 1
        if below and below * 100 >= size * t:
            out.append(self.in_band(hashes, often, band - 1, most_apart(size, below, t) + 1))
        return np.concatenate(out)


def text_key(text_col: str):
    return F.unhex(F.md5(text_or_empty(text_col)))


def nodes_of(docs: DataFrame, id_col: str, text_col: str, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, size, node, set_key, sketch, parity, sigs) of every document; equal sets share node and
    set_key.  A task sketches and signs equal sets once: the last three are null in their other rows."""
    frequent, counts = frequent_shingles(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen = Signer(frequent, counts, threshold), set()
        for batch in batches:
            sizes, keys, sketches, parities, sigs = [], [], [], [], []
            for t in column(batch, "text"):
                own = shingles(t.as_py())
                key = xxhash.xxh128_digest(own.tobytes())
                new = key not in seen
                seen.add(key)
                sizes.append(len(own))
                keys.append(key)
                sketches.append(sketch(own) if new else None)
                parities.append(parity(own) if new else None)
                sigs.append(signer.sign(own).view(np.int64) if new else None)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "text_key"), pa.array(sizes, pa.int64()),
                 pa.array([node_name(k) for k in keys], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sketches, pa.list_(pa.int64())), pa.array(parities, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "size", "node", "set_key", "sketch", "parity", "sigs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"),
                       F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, text_key binary, size long, node long, set_key binary, "
                                        "sketch array<bigint>, parity binary, sigs array<bigint>"), "nodes")


def node_name(set_key: bytes) -> int:
    return int.from_bytes(set_key[:8], "little", signed=True)


def frequent_shingles(docs: DataFrame, text_col: str, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles of a bounded sample of distinct texts, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["h"])

    keys = docs.select(F.xxhash64(text_col).alias("k")).distinct().orderBy(F.hash("k"), "k").limit(sample)
    # at most ``sample`` numbers
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("k")).join(F.broadcast(keys), "k")
    chosen = texts.groupBy("k").agg(F.first("text").alias("text")).select("text")
    counts = chosen.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT_ENTRIES).collect()
    found = sorted((r["h"] % (1 << 64), r["n"]) for r in top)
    return np.array([h for h, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def distinct_sets(nodes: DataFrame) -> DataFrame:
    """(set_key, node, name, text_key, size, sketch, parity): one row per set; ``name`` is its node
    unless another set has that node, and the hash of its key then."""
    firsts = (F.first(c, ignorenulls=True).alias(c) for c in ("node", "size", "sketch", "parity"))
    one = nodes.filter("size > 0").groupBy("set_key").agg(F.min("text_key").alias("text_key"), *firsts)
    first = F.lag("set_key").over(Window.partitionBy("node").orderBy("set_key")).isNull()
    return written(one.withColumn("name", F.when(first, F.col("node")).otherwise(F.xxhash64("set_key"))), "sets")


def shared_signatures(nodes: DataFrame) -> DataFrame:
    """(sig, node): members of buckets of two nodes at least; of buckets with the same members one."""
    in_bucket = Window.partitionBy("sig").orderBy("node")
    rows = nodes.select(F.explode("sigs").alias("sig"), "node").withColumns({
        "before": F.lag("node").over(in_bucket), "after": F.lead("node").over(in_bucket)})
    # a node that several tasks signed stands in a row
    apart = (F.col("before") != F.col("node")) | (F.col("after") != F.col("node"))
    members = written(rows.filter(apart).groupBy("sig", "node").agg(F.lit(True).alias("_")).select("sig", "node"), "buckets")
    names = (F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2))
    chosen = members.groupBy("sig").agg(F.count("*").alias("n"), *names).groupBy("n", "x0", "x1").agg(F.min("sig").alias("sig"))
    return members.join(chosen.select("sig"), "sig", "left_semi")


def renamed(sets: DataFrame) -> DataFrame:
    """The sets whose node another set has."""
    return sets.filter("name <> node").select("set_key", "node", "name")


def candidate_texts(docs: DataFrame, needed: DataFrame, text_col: str) -> DataFrame:
    """(text_key, text): one row per needed text."""
    slot = lambda key: F.pmod(F.xxhash64(key), F.lit(SLOTS))
    slots = needed.select(slot(F.col("text_key")).alias("slot")).distinct()
    keyed = docs.select(text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    # at most SLOTS numbers; keeps most texts that aren't needed out of the shuffle
    near = keyed.withColumn("slot", slot(F.col("text_key"))).join(F.broadcast(slots), "slot").drop("slot")
    return near.join(needed.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key").agg(
        F.first("text").alias("text"))


def similar_pairs(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, threshold: int = THRESHOLD) -> DataFrame:
    """The (a, b) whose sets are similar: those that their parities allow, by exact comparison of their shingle sets."""

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (column(batch, f"parity_{n}").to_pylist() for n in "ab")
            total = column(batch, "total").to_pylist()
            fit = [apart_at_least(x, y) * (100 + threshold) <= n * (100 - threshold) for x, y, n in zip(a, b, total)]
            kept = batch.filter(pa.array(fit, pa.bool_()))
            yield pa.RecordBatch.from_arrays([column(kept, n) for n in ("a", "b", "key_a", "key_b")], names=["a", "b", "key_a", "key_b"])

    side = lambda n: sets.select(F.col("name").alias(n), F.col("text_key").alias(f"key_{n}"),
                                 F.col("parity").alias(f"parity_{n}"), F.col("size").alias(f"size_{n}"))
    named = pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", "key_a", "key_b", "parity_a", "parity_b", (F.col("size_a") + F.col("size_b")).alias("total"))
    checked = written(named.mapInArrow(fits, "a long, b long, key_a binary, key_b binary"), "pairs")
    needed = checked.select(F.explode(F.array("key_a", "key_b")).alias("text_key")).distinct()
    texts = written(candidate_texts(docs, needed, text_col), "texts")
    of = lambda n: texts.select(F.col("text_key").alias(f"key_{n}"), F.col("text").alias(f"text_{n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def own(batch: pa.RecordBatch, side: str, i: int) -> np.ndarray:
            key = column(batch, f"key_{side}")[i].as_py()
            if key not in held:
                held[key] = shingles(column(batch, f"text_{side}")[i].as_py())
                if len(held) > HELD_SETS:
                    held.popitem(last=False)
            held.move_to_end(key)
            return held[key]

        for batch in batches:
            alike = []
            for i in range(batch.num_rows):
                a, b = own(batch, "a", i), own(batch, "b", i)
                both = len(np.intersect1d(a, b, assume_unique=True))
                alike.append(100 * both >= threshold * (len(a) + len(b) - both))
            kept = batch.filter(pa.array(alike, pa.bool_()))
            yield pa.RecordBatch.from_arrays([column(kept, "a"), column(kept, "b")], names=["a", "b"])

    joined = checked.join(of("a"), "key_a").join(of("b"), "key_b")
    return written(joined.mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(edges, "edges")
    before = digest(edges)
    while True:
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small, "edges")
        if (now := digest(edges)) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def digest(edges: DataFrame) -> tuple:
    """Number and hash sum of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``members``, with their roots, of the buckets with nodes of different components."""
    placed = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_up = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("sig")
    return written(placed.join(mixed_up, "sig", "left_semi"), "open")


def neighbours(rows: DataFrame, threshold: int, orders: int = ORDERS) -> DataFrame:
    """Pairs next to each other in one of some orders, by signature."""
    order = Window.partitionBy("sig").orderBy(F.xxhash64("node", F.pmod("sig", F.lit(orders))), "node")
    cells = F.struct("node", "root", "size", "sketch")
    pairs = rows.select(cells.alias("y"), F.lag(cells).over(order).alias("x")).filter("x is not null")
    sided = pairs.select(*(F.col(f"{s}.{c}").alias(n) for s, t in (("x", "a"), ("y", "b"))
                           for c, n in (("node", t), ("root", f"root_{t}"), ("size", f"size_{t}"), ("sketch", f"sketch_{t}"))))
    fitting = sided.filter((F.col("root_a") != F.col("root_b")) & may_be_similar("a", "b", threshold))
    return fitting.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged_buckets(rows: DataFrame, merges: int = MERGES) -> DataFrame:
    """(sig, node): each bucket or a union that holds it, so no two nodes are parted.  Buckets whose least member
    by a hash is the same become one, but only where the union has no more pairs than they have together."""
    rows = rows.select("sig", "node")
    pairs = F.col("n").cast("double") * (F.col("n") - 1)
    for i in range(merges):
        buckets = rows.groupBy("sig").agg(F.min(F.xxhash64("node", F.lit(i))).alias("least"), F.count("*").alias("n"))
        keyed = rows.join(buckets.select("sig", "least"), "sig")
        union = keyed.select("least", "node").distinct().groupBy("least").agg(F.count("*").alias("n"))
        apart = buckets.groupBy("least").agg(F.sum(pairs).alias("apart"))
        worth = union.join(apart, "least").filter(pairs <= F.col("apart")).select("least", F.lit(True).alias("worth"))
        sig = F.when(F.col("worth"), F.col("least")).otherwise(F.col("sig"))
        rows = written(keyed.join(worth, "least", "left").select(sig.alias("sig"), "node").distinct(), "merged")
    return rows


def all_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """Every pair of a bucket whose components differ and whose sizes and sketches fit."""
    described = rows.dropDuplicates(["node"]).drop("sig")
    grouped = merged_buckets(rows).join(described, "node")
    side = lambda n: grouped.select("sig", F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("root", "size", "sketch")))
    apart = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
    return side("a").join(side("b"), "sig").filter(apart & may_be_similar("a", "b", threshold)).select("a", "b").distinct()


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    nodes = nodes_of(docs, id_col, text_col, threshold)
    sets = distinct_sets(nodes)
    described = sets.select("node", "name", "size", "sketch")
    members = written(shared_signatures(nodes).join(described, "node").drop("node").withColumnRenamed("name", "node"), "members")
    twins = renamed(sets)
    near = neighbours(members.withColumn("root", F.col("node")), threshold, 1)
    near = written(near.unionByName(twins.select(F.least("node", "name").alias("a"), F.greatest("node", "name").alias("b"))), "near")
    found = components(similar_pairs(near, sets, docs, text_col, threshold))
    # buckets that hold different components still: neighbours in several other orders, then all pairs
    for pairs_of in (neighbours, all_pairs):
        pairs = pairs_of(open_buckets(members, found), threshold)
        more = similar_pairs(pairs.join(near, ["a", "b"], "left_anti"), sets, docs, text_col, threshold)
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = nodes.select("doc_id", "text_key", "size", "node", "set_key")
    if not twins.isEmpty():
        named = named.join(twins.drop("node"), "set_key", "left").withColumn("node", F.coalesce("name", "node"))
    rooted = named.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.filter("size > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = rooted.join(least, "root", "left")
    alone = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("size").alias("n_shingles"), alone.alias("component_id"), "text_key", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The documents without those linked to one of smaller id (or text key, where ids are equal or null)."""
    rows = linked(docs, id_col, text_col, threshold).filter("n_shingles > 0")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    chosen = rows.groupBy("root").agg(F.min(name).alias("first"))
    placed = rows.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")).join(chosen, "root")
    stays = (F.col("first")["text_key"] == F.col("text_key")) & F.col("first")["doc_id"].eqNullSafe(F.col("doc_id"))
    acts = written(placed.select("doc_id", "text_key", stays.alias("stays"), "n").filter(~F.col("stays") | (F.col("n") > 1)),
                   "duplicates")
    own = docs.select(held(docs).alias("doc"), F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"))
    joined = own.join(acts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    kept = joined.filter(F.col("stays").isNull()).select("doc")
    if not acts.filter("stays").isEmpty():  # equal rows: one of them
        repeated = joined.filter(F.col("stays")).groupBy("id", "key").agg(F.first("doc").alias("doc"))
        kept = kept.unionByName(repeated.select("doc"))
    return unfolded(kept, docs, "doc")


def linked_rows(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return linked(docs).drop("text_key", "root")
