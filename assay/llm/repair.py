"""Cheapest repair of conversations by a Viterbi search that runs in parallel chunks.

A conversation is well formed if its role initials spell ``(s?(ua)+)?``.  Four states read
that language, and the cost of the cheapest repair of what follows a row, by state, is a
vector that depends on the next row's vector alone.  Rows are range-partitioned on
conversation and order, so a long conversation lies in many partitions, and are cut into
chunks of at most ``2**CHUNK_BITS`` rows.

* Speculation: every chunk runs backwards at once, from guessed cost vectors at its end.  The
  guesses are the four generators of the cone that all true vectors lie in (what a state can
  gain over another is bounded: ``BOUNDS``), so a true vector is a minimum of guesses plus
  constants.  If the four results differ only by constants, the chunk's costs are settled
  whatever follows; the last chunk of a conversation starts from its true end.
* Fix-up passes: an unsettled chunk is rerun from the vectors of the chunk where its own run
  ends.  Runs are linear over (min, +), so a rerun is a product of its results with that
  chunk's; the distance doubles with each pass, and passes end when all vectors differ only
  by constants.  Even rows that never converge take a logarithmic number of passes.
* Tracing: from the stitched costs each chunk traces its least audit for every state it could
  be entered in.  The states that chunks hand on are settled by the same doubling passes, and
  a last run writes the edits.

The digest and the audit of a conversation are sequential, so its rows go through one task as
a sorted stream; memory is constant but for the audit, which is one string by contract.

Cases: null role or text counts as one space, a null turn or id as one space in the damage
key; a null turn comes first, rows of one turn are taken by (role, text) after damage, so
repeated rows lie side by side and all but the first are duplicates; a null conversation id is
an id of its own; other roles than system, user and assistant go by their initial, and have to
be rewritten or deleted if it is not s, u or a; texts may be empty or very long; a conversation
whose rows are all dropped gives zeros, an empty audit and the digest of nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import SPACE_CLASS, column, written

CHUNK_BITS = 12
DAMAGES = 20
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# States: nothing read, after s, after u, after a.  What user / assistant as needed next leads to.
STATES = 4
NEXT = (2, 2, 3, 2)
NEEDED = ("user", "user", "assistant", "user")
INITIALS = {"s": 1, "u": 2, "a": 3}
# State after a row of initial s, u, a is kept; None where the language forbids it.
KEPT = ({1: 1, 2: 2}, {2: 2}, {3: 3}, {2: 2})
END = (0, 2 * INSERT, INSERT, 0)
# BOUNDS[q][t]: cost of q is at most cost of t plus this, before any row and at the end.
BOUNDS = {(0, 3): 0, (3, 1): 0, (3, 0): DELETE, (0, 2): INSERT, (1, 2): INSERT, (2, 3): INSERT, (3, 2): INSERT}
BLANK, DUPLICATE, CUT = 1, 2, 3
# A row's code: initial, then its fault.
FAULT_SHIFT = 2


def generators() -> list[tuple[int, ...]]:
    """The least vectors that keep BOUNDS, one for each state whose cost is 0."""
    far = 10 ** 6
    cost = [[0 if q == t else BOUNDS.get((q, t), far) for t in range(STATES)] for q in range(STATES)]
    for k in range(STATES):
        for q in range(STATES):
            for t in range(STATES):
                cost[q][t] = min(cost[q][t], cost[q][k] + cost[k][t])
    return [tuple(cost[q][t] for q in range(STATES)) for t in range(STATES)]


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cost by state before a row, given the costs after it."""
    fault = code >> FAULT_SHIFT
    if fault in (BLANK, DUPLICATE):
        return tuple(c + DELETE for c in after)
    c0, c1, c2, c3 = after
    extra = TRUNCATED if fault == CUT else 0
    user, helped = c2 + REROLE + extra, c3 + REROLE + extra
    initial = code & 3
    if initial == 2:
        user -= REROLE
    elif initial == 3:
        helped -= REROLE
    n0, n1, n2, n3 = min(c0 + DELETE, user), min(c1 + DELETE, user), min(c2 + DELETE, helped), min(c3 + DELETE, user)
    if initial == 1:
        n0 = min(n0, c1 + extra)
    m2, m3 = min(n2, n3 + INSERT), min(n3, n2 + INSERT)
    return min(n0, m2 + INSERT), min(n1, m2 + INSERT), m2, m3


def traced(codes: list[int], costs: list[tuple[int, ...]], state: int) -> tuple[list[str], int]:
    """Least edits before and at each row from a state, and the state after them; ``costs`` has one more entry than rows."""
    out = []
    for i, code in enumerate(codes):
        here, after = costs[i], costs[i + 1]
        fault, edits = code >> FAULT_SHIFT, ""
        extra = TRUNCATED if fault == CUT else 0
        while True:  # the letters in ASCII order
            if here[state] == after[state] + DELETE:
                edits += "D"
                break
            if here[state] == here[NEXT[state]] + INSERT:
                edits += "I"
                state = NEXT[state]
                continue
            kept = KEPT[state].get(code & 3)
            if kept is not None and here[state] == after[kept] + extra:
                edits += "K"
                state = kept
            else:
                edits += "R"
                state = NEXT[state]
            break
        out.append(edits)
    return out, state


def tail(state: int) -> str:
    """Inserts after the last row."""
    return "I" * (END[state] // INSERT)


def costs_of(codes: list[int], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    out = [end]
    for code in reversed(codes):
        out.append(before(code, out[-1]))
    return out[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) after damage; ``conv`` is the id as text, empty for null."""
    own = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
                               F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce("conv", F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = own.withColumn("kind", F.crc32(key) % DAMAGES).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return hit.select(F.coalesce("conv", F.lit("")).alias("conv"), "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))


def placed(rows: DataFrame) -> DataFrame:
    """The rows, written in order; ``place`` grows in that order over the whole table."""
    # the last key only deals equal rows to several partitions
    order = ["conv", "turn", "role", "text", "equal"]
    ranged = rows.withColumn("equal", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("place")), "turns")


SLICE_BITS = 33  # Spark's row numbers hold the partition above these bits


def coded(rows: DataFrame) -> DataFrame:
    """(conv, place, code): initial and first fault of every row."""
    said = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    firsts = rows.groupBy("conv", said.alias("said")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    blank = ~F.col("text").rlike(f"[^{SPACE_CLASS[1:]}")
    ended = F.col("text").rlike(f"[.!?]{SPACE_CLASS}*\\z")
    marks = rows.select("conv", "place", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), ended.alias("ended"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(~F.col("ended"), CUT).otherwise(0)
    initial = F.coalesce(*(F.when(F.col("initial") == i, n) for i, n in INITIALS.items()), F.lit(0))
    return marks.join(firsts, "place", "left").select("conv", "place", (initial + fault * (1 << FAULT_SHIFT)).alias("code"))


def chunked(rows: DataFrame, codes: DataFrame, chunk_bits: int) -> DataFrame:
    """(conv, chunk, is_first, is_last, rows): chunks of a conversation are numbered without gaps."""
    def parts(place):
        return F.shiftright(place, SLICE_BITS), F.shiftright(place.bitwiseAND((1 << SLICE_BITS) - 1), chunk_bits)

    piece, block = parts(F.col("place"))
    # one row per partition: their number is a setting
    sizes = rows.groupBy(piece.alias("piece")).agg((F.max(block) + 1).alias("blocks"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("piece", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)).alias("base"))
    numbered = codes.withColumn("piece", piece).join(bases, "piece").withColumn("chunk", F.col("base") + block)
    chunks = numbered.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("rows"))
    ends = codes.withColumn("piece", piece).groupBy("conv", "piece").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    spans = ends.join(bases, "piece").groupBy("conv").agg(
        F.min(F.col("base") + parts(F.col("low"))[1]).alias("low"), F.max(F.col("base") + parts(F.col("high"))[1]).alias("high"))
    return written(chunks.join(spans, "conv").select(
        "conv", "chunk", (F.col("chunk") == F.col("low")).alias("is_first"), (F.col("chunk") == F.col("high")).alias("is_last"), "rows"),
        "chunks")


def settled_runs(runs: DataFrame, toward: int, combined: Callable[[Column, Column], Column], done: Callable[[Column], Column]) -> DataFrame:
    """Runs (conv, chunk, run) after fix-up passes: each is combined with the run that begins where it ends
    (``toward`` 1: later chunks, -1: earlier ones) until ``done`` holds for all."""
    runs, distance = written(runs.withColumn("settled", done(F.col("run"))), "runs"), 1
    while not runs.filter(~F.col("settled")).isEmpty():
        other = runs.select("conv", (F.col("chunk") - toward * distance).alias("chunk"), F.col("run").alias("beyond"))
        open_ones = runs.filter(~F.col("settled")).join(other, ["conv", "chunk"]).select(
            "conv", "chunk", combined(F.col("run"), F.col("beyond")).alias("run")).withColumn("settled", done(F.col("run")))
        runs, distance = written(runs.filter("settled").unionByName(open_ones), "runs"), 2 * distance
    return runs


def speculated(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, run): costs by state at a chunk's start, for each guess about its end."""
    guesses = generators()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rows, is_last in zip(column(batch, "rows").to_pylist(), column(batch, "is_last").to_pylist()):
                vectors = [END] if is_last else guesses
                for row in reversed(rows):
                    vectors = [before(row["code"], v) for v in vectors]
                found.append([c for v in (vectors * STATES if is_last else vectors) for c in v])
            yield pa.RecordBatch.from_arrays([column(batch, "conv"), column(batch, "chunk"), pa.array(found, pa.list_(pa.int64()))],
                                             names=["conv", "chunk", "run"])

    return chunks.mapInArrow(run, "conv string, chunk long, run array<bigint>")


def rerun(run: Column, beyond: Column) -> Column:
    """A chunk's costs when its end has the costs ``beyond``."""
    return F.array(*(F.least(*(beyond[STATES * t + u] + run[STATES * u + q] for u in range(STATES)))
                     for t in range(STATES) for q in range(STATES)))


def parallel(run: Column) -> Column:
    """Whether the vectors of a run differ only by constants."""
    same = [run[STATES * t + q] - run[STATES * t] == run[q] - run[0] for t in range(1, STATES) for q in range(1, STATES)]
    return F.forall(F.array(*same), lambda x: x)


def handed_on(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, run): the state after a chunk for each state before it; the first chunk has only state 0 before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rows, end, is_first in zip(*(column(batch, n).to_pylist() for n in ("rows", "end", "is_first"))):
                codes = [r["code"] for r in rows]
                costs = costs_of(codes, tuple(end))
                found.append([traced(codes, costs, 0 if is_first else q)[1] for q in range(STATES)])
            yield pa.RecordBatch.from_arrays([column(batch, "conv"), column(batch, "chunk"), pa.array(found, pa.list_(pa.int64()))],
                                             names=["conv", "chunk", "run"])

    return chunks.select("conv", "chunk", "is_first", "rows", "end").mapInArrow(run, "conv string, chunk long, run array<bigint>")


def edits_of(chunks: DataFrame) -> DataFrame:
    """(conv, place, fault, edits): letters of the inserts before a row and of its own edit; inserts at the end follow the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            names = ("conv", "rows", "end", "state", "is_last")
            for conv, rows, end, state, is_last in zip(*(column(batch, n).to_pylist() for n in names)):
                codes = [r["code"] for r in rows]
                edits, state = traced(codes, costs_of(codes, tuple(end)), state)
                if is_last:
                    edits[-1] += tail(state)
                told += [(conv, r["place"], r["code"] >> FAULT_SHIFT, e) for r, e in zip(rows, edits)]
            columns = zip(*told) if told else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv", "place", "fault", "edits"])

    return chunks.select("conv", "rows", "end", "state", "is_last").mapInArrow(
        run, "conv string, place long, fault long, edits string")


def least_edits(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(conv, place, fault, edits) of every row of ``placed``."""
    chunks = chunked(rows, written(coded(rows), "codes"), chunk_bits)
    costs = settled_runs(speculated(chunks), 1, rerun, parallel)
    ends = costs.select("conv", (F.col("chunk") - 1).alias("chunk"), F.slice("run", 1, STATES).alias("end"))
    true_end = F.array(*(F.lit(c).cast("long") for c in END))
    ended = written(chunks.join(ends, ["conv", "chunk"], "left").withColumn(
        "end", F.when(F.col("is_last"), true_end).otherwise(F.col("end"))), "chunks")
    one_state = lambda run: F.array_min(run) == F.array_max(run)
    through = lambda run, earlier: F.transform(earlier, lambda q: F.get(run, q.cast("int")))
    states = settled_runs(handed_on(ended), -1, through, one_state)
    entered = states.select("conv", (F.col("chunk") + 1).alias("chunk"), F.col("run")[0].alias("state"))
    own = ended.join(entered, ["conv", "chunk"], "left").withColumn("state", F.when(F.col("is_first"), F.lit(0).cast("long")).otherwise(F.col("state")))
    return edits_of(own)


class Told:
    """Running result of one conversation."""

    def __init__(self, conv: str):
        self.conv, self.digest, self.audit, self.state, self.said = conv, hashlib.sha256(), [], 0, False
        self.faults, self.cost, self.illegal, self.initial = [0] * 4, 0, 0, None
        self.low = self.high = None
        self.turns = 0

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.said else ''}{role}:{text}".encode())
        self.said = True

    def row(self, turn: int | None, role: str, text: str, fault: int, edits: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.faults[fault] += 1
        self.audit.append(edits)
        for edit in edits:
            if edit == "D":
                self.cost += DELETE
                continue
            self.cost += {"I": INSERT, "K": 0, "R": REROLE}[edit] + (TRUNCATED if edit != "I" and fault == CUT else 0)
            if edit == "K":
                self.state = KEPT[self.state][INITIALS[role[:1]]]
                self.say(role, text)
            else:
                self.say(NEEDED[self.state], "" if edit == "I" else text)
                self.state = NEXT[self.state]

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


RESULT = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per conversation: its faults, audit, cost and the digest of its repaired turns."""
    no = lambda kind: F.lit(None).cast(kind)
    told = edits.select("conv", "place", F.lit(0).alias("part"), no("long").alias("turn"), no("string").alias("role"),
                        no("string").alias("text"), "fault", "edits")
    turns = rows.select("conv", "place", F.lit(1).alias("part"), "turn", "role", "text", no("long").alias("fault"), no("string").alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        names = [p.split()[0] for p in RESULT.split(", ")]

        def batch_of(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * len(kinds), kinds)], names=names)

        current, fault, edits = None, 0, ""
        for batch in batches:
            done = []
            fields = ("conv", "part", "turn", "role", "text", "fault", "edits")
            for conv, part, turn, role, text, own_fault, own_edits in zip(*(column(batch, n).to_pylist() for n in fields)):
                if part == 0:
                    fault, edits = own_fault, own_edits
                    continue
                if current is None or conv != current.conv:
                    if current is not None:
                        done.append(current.result())
                    current = Told(conv)
                current.row(turn, role, text, fault, edits)
            yield batch_of(done)
        yield batch_of([current.result()] if current is not None else [])

    return told.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "place", "part").mapInArrow(run, RESULT)


def repaired_conversations(conversations: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The contract's rows."""
    rows = placed(damaged(conversations))
    found = repaired(rows, least_edits(rows, chunk_bits))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn(
        "conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
