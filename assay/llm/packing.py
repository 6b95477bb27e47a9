"""Hierarchical multi-length packing of token sequences.

Context sizes are tiers, each a power of two.  In every task, a batch of documents at a time:

1. *Route*: full windows of the longest tier are cut off a document; what is left belongs to
   the smallest tier that holds it.
2. *Pack each tier*, longest first: the longest piece opens a window of its tier.
3. *Fill gaps* from shorter tiers: the longest piece that fits, again and again; if none
   fits, the shortest piece gives exactly its head and its rest goes back to its tier.
   A window that can't be filled waits for the next batch.
4. At the end of the task's input the waiting window is cut into powers of two, so no
   sequence needs padding.

Memory of a task: a few Arrow batches, ``bpe.GROUP_CHARS`` in all or one batch, and less than one window; nothing is shuffled, so a hot
source or group of copies costs nothing.  ``balance_steps`` then deals the sequences of each
tier into training steps of equal token counts, from counts per task and tier.

Cases: a null or empty token list is a document of its end token alone; null ids are kept;
repeated rows are packed each for itself; an empty table gives no pieces; other columns are
ignored, except those named.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm import bpe
from assay.llm.common import at_rest, column, written

TIERS = (128, 256, 512, 1024, 2048)
END_ID = 1
ID_BYTES = 4
# Tokens of one training step.
STEP_TOKENS = 1 << 19
# sequence_id = task * 2**TASK_SHIFT + number within the task
TASK_SHIFT = 40

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False), T.StructField("doc_tokens", T.LongType(), False),
    T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False),
    T.StructField("tier", T.LongType(), False), T.StructField("task", T.IntegerType(), False),
    T.StructField("tier_rank", T.LongType(), False), T.StructField("tokens", T.BinaryType(), False),
])


class TierPacker:
    """Packs pieces (length, number, document, start) of one task into full windows."""

    def __init__(self, tiers: tuple[int, ...]):
        if any(t < 1 or t & (t - 1) for t in tiers):
            raise ValueError("tiers must be powers of two")
        self.tiers = tuple(sorted(tiers))
        self.loose: list[tuple] = []  # sorted by length; a tier is a range of it
        self.seen = 0

    def add(self, doc, length: int) -> Iterator[list[tuple]]:
        """Route a document: yields its full windows, keeps the rest."""
        longest, start = self.tiers[-1], 0
        while length - start >= longest:
            yield [(longest, doc, start)]
            start += longest
        if (rest := length - start) in self.tiers:
            yield [(rest, doc, start)]
        elif rest:
            self._keep(rest, doc, start)

    def _keep(self, length: int, doc, start: int) -> None:
        self.seen += 1
        bisect.insort(self.loose, (length, self.seen, doc, start))

    def fill(self) -> Iterator[list[tuple]]:
        """Full windows from the loose pieces; pieces of a window that stays open are kept."""
        loose = self.loose
        while loose:
            length, _, doc, start = loose.pop()
            window, gap = [(length, doc, start)], self.tiers[bisect.bisect_left(self.tiers, length)] - length
            while gap and loose:
                if at := bisect.bisect_right(loose, (gap, self.seen + 1)):
                    length, _, doc, start = loose.pop(at - 1)
                    window.append((length, doc, start))
                    gap -= length
                else:
                    length, _, doc, start = loose.pop(0)
                    window.append((gap, doc, start))
                    self._keep(length - gap, doc, start + gap)
                    gap = 0
            if gap:
                for length, doc, start in window:
                    self._keep(length, doc, start)
                return
            yield window

    def finish(self) -> Iterator[list[tuple]]:
        """What is left, cut into sequences of powers of two."""
        left = sum(p[0] for p in self.loose)
        while self.loose:
            size, window = 1 << (left.bit_length() - 1), []
            size = min(size, self.tiers[-1])
            left -= size
            while size:
                length, _, doc, start = self.loose.pop()
                window.append((min(size, length), doc, start))
                if length > size:
                    self._keep(length - size, doc, start + size)
                size -= window[-1][0]
            yield window


def packed(batches: Iterator[list[tuple]], tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's documents, each its name and its packed ids (little-endian 32-bit)."""
    task, packer = TaskContext.get().partitionId(), TierPacker(tiers)
    ranks: dict[int, int] = {}
    sequences = 0

    def rows(windows) -> Iterator[tuple]:
        nonlocal sequences
        for window in windows:
            size, offset = sum(p[0] for p in window), 0
            rank = ranks[size] = ranks.get(size, -1) + 1
            for length, (name, ids), start in window:
                yield (name, start, length, len(ids) // ID_BYTES, (task << TASK_SHIFT) + sequences, offset, size, task, rank,
                       ids[ID_BYTES * start:ID_BYTES * (start + length)])
                offset += length
            sequences += 1

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else [[] for _ in PIECES]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, ARROW_TYPES)],
                                          names=PIECES.names)

    for batch in batches:
        out = []
        for name, ids in batch:
            out += rows(packer.add((name, ids), len(ids) // ID_BYTES))
        out += rows(packer.fill())
        yield batch_of(out)
    yield batch_of(list(rows(packer.finish())))


def packed_end(end_id: int | None) -> bytes:
    return b"" if end_id is None else np.array([end_id], "<i4").tobytes()


def pack(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tiers: tuple[int, ...] = TIERS,
         end_id: int | None = END_ID) -> DataFrame:
    """Pieces of all documents with their place and their token ids (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = packed_end(end_id)
        coded = lambda ids: end if ids.values is None else ids.values.to_numpy().astype("<i4").tobytes() + end
        yield from packed(([(name, coded(ids)) for name, ids in zip(column(batch, "doc").to_pylist(), column(batch, "ids"))]
                           for batch in batches), tiers)

    return tokens.select(F.col(id_col).cast("long").alias("doc"), F.col(ids_col).alias("ids")).mapInArrow(run, PIECES)


def encode_and_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS,
                    end_id: int | None = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """The pieces that ``pack`` makes of the encoded texts, by one Python worker a task."""
    path = tokenizer_path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = bpe.codec(path), packed_end(end_id)

        def coded(group: list[pa.RecordBatch]) -> Iterator[list[tuple]]:
            ids = tool.encode_all([t for batch in group for t in column(batch, "text").to_pylist()])
            for batch in group:
                yield [(name, next(ids) + end) for name in column(batch, "doc").to_pylist()]

        def documents() -> Iterator[list[tuple]]:
            group, size = [], 0
            for batch in batches:
                group.append(batch)
                size += batch.nbytes
                if size >= bpe.GROUP_CHARS:
                    yield from coded(group)
                    group, size = [], 0
            yield from coded(group)

        yield from at_rest(packed(documents(), tiers))

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


ARROW_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]


def balance_steps(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Add ``step``: the training step of each sequence.

    A step holds sequences of one tier, ``step_tokens`` in all (the last of a tier may hold
    fewer).  Only counts per task and tier are brought together.
    """
    fixed = written(pieces, "pieces")
    counts = fixed.groupBy("tier", "task").agg((F.max("tier_rank") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("tier", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    per_step = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    joined = fixed.join(first, ["tier", "task"])
    return joined.withColumn("step", F.floor((F.col("first") + F.col("tier_rank")) / per_step).cast("long")).drop("first")


def packed_documents(docs: DataFrame, tokenizer_path: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Encode, pack and deal out ``documents``: the contract's rows."""
    pieces = encode_and_pack(docs, tiers=tiers, tokenizer_path=tokenizer_path)
    slim = pieces.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
    return balance_steps(slim).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                                      "tier", "step")
