"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one document: too few words, or too many words in repeated five-word
windows.  The cross-document rule hashes normalised lines (lower case, single spaces) and
counts, per host, the distinct documents that hold a line.  Lines above the host's limit are
boilerplate and are removed; a document of which too little is left is rejected.

Copies of a document aren't independent evidence, so copies and near copies count about once.
Lines that enough distinct texts of a host hold are common; the rest of a document, its own
part, tells it apart by the smallest hash of five-word windows inside the own lines, which two
texts share as often as those windows agree.  Shared lines have no say in that, however much
of a document they make up.  Only where the own part is less than ``OWN_SHARE`` of what stands
beside the longest common line (two such texts have 75 % of their windows in common, which
links them in the Jaccard join too), documents with the same common lines are near copies.

The distinct counts are two-stage (host, line, document) then (host, line), so a line that a
third of all documents hold is spread over many tasks before it is summed up.  Whole texts
are read once; what is passed on is one row of counts and line hashes per document.

Cases: null and empty texts have no words and fail; a null host is a host of its own; null
ids are kept; repeated rows are judged each for itself and alike; an empty table gives no
rows; other columns are ignored (``kept_documents`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import SPACE_CLASS, held, text_or_empty, unfolded, words, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
# A line is above the limit when at least so many distinct documents of its host hold it,
# and at least this share of the host's distinct documents or, whatever the host's size,
# MANY_LINE_DOCS of them.
MIN_LINE_DOCS = 10
MAX_LINE_SHARE = 0.05
MANY_LINE_DOCS = 10_000
# Own parts below this share are those of near copies: (1 - s) / (1 + s) = 0.75.
OWN_SHARE = 1 / 7
# A document is depleted when less than this share of its words is left.
MIN_LEFT_SHARE = 0.3


def window_hashes(tokens: Column) -> Column:
    """One hash per five-word window, in order; none for shorter texts."""
    starts = F.sequence(F.lit(0), F.size(tokens) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(WINDOW))))
    return F.when(F.size(tokens) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def with_repeated_words(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Add ``out``: words covered by windows whose hash occurs twice or more.

    Each sorted array is a column of its own that is read several times, so Spark keeps it and
    sorts once; texts without a repeat aren't sorted at all.
    """
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(repeats, placed))
    alike = F.zip_with("_placed", F.slice("_placed", 2, F.greatest(F.size("_placed"), F.lit(0))),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(alike, lambda p: p.isNotNull()))))
    df = df.withColumn("_at", at)
    steps = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(0))),
                       lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0), lambda acc, n: acc + n)
    return df.withColumn(out, F.coalesce(covered, F.lit(0))).drop("_placed", "_at")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE_CLASS + "+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per document: base counts and (hash, words, smallest window hash) of its lines; fixed."""
    text = text_or_empty(text_col)
    split = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                        F.xxhash64(text).alias("text_hash"), text.alias("t"), words(text).alias("w"))
    hashed = split.withColumn("h", window_hashes(F.col("w")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    apart = with_repeated_words(hashed.withColumn("lines", lines), "h", "repeats")
    length = F.length("t")
    of_line = lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words"))
    apart = apart.withColumn("bare", F.transform(F.transform("lines", normalised), of_line))
    # where each line's first word stands among the words of the text: the words' line numbers, and where they change
    apart = apart.withColumn("of_word", F.flatten(F.transform("bare", lambda x, i: F.array_repeat(i, x["words"]))))
    changes = F.zip_with("of_word", F.concat(F.array(F.lit(-1)), "of_word"), lambda own, prior: own != prior)
    at = F.filter(F.transform(changes, lambda new, p: F.when(new, p)), lambda p: p.isNotNull())
    # both arrays are arguments of the zip, so each is built once and not once a line
    windows = lambda x, start: F.slice("h", start + 1, F.greatest(x["words"] - WINDOW + 1, F.lit(0)))
    placed = lambda x, start: F.struct(x["line"], x["words"], F.coalesce(F.array_min(windows(x, start)), x["line"]).alias("least"))
    rows = apart.select(
        "doc_id", "host", "text_hash", F.monotonically_increasing_id().alias("row"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeats").cast("long").alias("n_repeat_words"),
        F.zip_with("bare", at, placed).alias("lines"))
    return written(rows, "quality")


def told_apart(rows: DataFrame, min_docs: int = MIN_LINE_DOCS) -> DataFrame:
    """(host, identity, common lines) of every document; fixed."""
    lines = rows.select("row", "host", "text_hash", F.explode(F.array_distinct("lines")).alias("l")).select(
        "row", "host", "text_hash", "l.*")
    common = lines.groupBy("host", "line").agg(F.countDistinct("text_hash").alias("texts")).filter(
        F.col("texts") >= min_docs).select("host", "line")
    shared = lines.join(common, ["host", "line"]).groupBy("row").agg(
        F.sum("words").alias("shared_words"), F.max("words").alias("longest"), F.sort_array(F.collect_set("line")).alias("common"),
        F.collect_list("least").alias("shared_least"))
    all_words = F.aggregate(F.array_distinct("lines"), F.lit(0).cast("long"), lambda n, x: n + x["words"])
    own_words = F.col("all_words") - F.coalesce("shared_words", F.lit(0))
    least = F.transform("lines", lambda x: x["least"])
    own = F.array_min(F.when(F.col("common").isNull(), least).otherwise(F.array_except(least, F.col("shared_least"))))
    near = own_words < OWN_SHARE * (F.col("all_words") - F.coalesce("longest", F.lit(0)))
    alike = F.when(F.col("common").isNotNull(), F.xxhash64("common"))
    identity = F.coalesce(F.when(~near, own), alike, "text_hash")
    joined = rows.select("row", "host", "text_hash", "lines", all_words.alias("all_words")).join(shared, "row", "left")
    return written(joined.select("host", identity.alias("identity"), "common"), "quality-identities")


def frequent_lines(rows: DataFrame, min_docs: int = MIN_LINE_DOCS, max_share: float = MAX_LINE_SHARE,
                   many_docs: int = MANY_LINE_DOCS) -> DataFrame:
    """(host, line, line_docs): lines above their host's limit."""
    told = told_apart(rows, min_docs)
    hosts = told.groupBy("host").agg(F.countDistinct("identity").alias("host_docs"))
    lines = told.select("host", "identity", F.explode("common").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.countDistinct("identity").alias("line_docs"))
    counts = counts.filter(F.col("line_docs") >= min_docs)
    above = (F.col("line_docs") >= max_share * F.col("host_docs")) | (F.col("line_docs") >= many_docs)
    return counts.join(hosts, "host").filter(above).drop("host_docs")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
           min_docs: int = MIN_LINE_DOCS, max_share: float = MAX_LINE_SHARE, min_left: float = MIN_LEFT_SHARE,
           many_docs: int = MANY_LINE_DOCS) -> DataFrame:
    """One row per document: base counts, removed lines and words, verdicts."""
    rows = measured(docs, id_col, text_col, host_col)
    lines = rows.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.words")
    gone = lines.join(frequent_lines(rows, min_docs, max_share, many_docs), ["host", "line"]).groupBy("row").agg(
        F.count("*").alias("removed_lines"), F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed"))
    all_rows = rows.drop("lines").join(gone, "row", "left")
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = left < min_left * F.col("n_words")
    return all_rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"), F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), depleted.alias("depleted"),
        "text_hash", "removed")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   **limits) -> DataFrame:
    """The documents that stay, without their lines above the limit (a length column is not touched)."""
    verdicts = judged(docs, id_col, text_col, host_col, **limits)
    acts = verdicts.filter(~F.col("kept") | F.col("removed").isNotNull()).select(
        "doc_id", "text_hash", "kept", "removed").dropDuplicates(["doc_id", "text_hash"])
    own = docs.select(held(docs).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("hash"))
    joined = own.join(acts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    text = F.col("doc")[text_col]
    stays = lambda x: ~F.array_contains("removed", line_hash(x))
    cleaned = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))
    return unfolded(joined.filter(F.col("kept").isNull() | F.col("kept")), docs, "doc", {text_col: cleaned})


def quality_rows(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return judged(docs).drop("text_hash", "removed")
