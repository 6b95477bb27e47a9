"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: lower case, compatibility forms, accents and look-alike letters of other scripts
become plain letters, digits and signs that stand for letters become these, all else is a
space.  The lexicon holds whole words and word beginnings ("stems"); its weights are the
smoothed log-odds of a document being toxic, learned from a bounded sample of labelled
documents outside the held-out fold.  Exception phrases (a hit with its neighbouring word)
that clean documents of the sample use cancel the hit inside them.  The weight of all hits,
as a sum and per thousand characters, goes through a logistic curve fitted on the sample.

Bounds: ``SAMPLE`` labelled documents, ``LEXICON`` entries, ``EXCEPTIONS`` phrases; these
are the only things the driver sees and the only ones broadcast.  Scoring is one pass over
the documents without a shuffle.

Cases: null and empty texts have no hits and get the score of a text without hits; null ids
count as held out; repeated rows score alike; labels that are null are ignored and of
several labels of a document the largest holds; without labels of both kinds every score is
the share of toxic labels (0 if there are none); an empty table gives no rows; other columns
are passed through, a column named like an output is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import column, extended, written

SAMPLE = 20_000
LEXICON = 2_000
EXCEPTIONS = 1_000
HELD_OUT_PARTS = 5
STEM_LENGTHS = range(3, 8)
MIN_TOXIC_DOCS = 5
MIN_Z = 4.0
MIN_EXCEPTION_DOCS = 3

# Signs that stand for letters, and look-alike letters of other scripts.
SIGNS = dict(zip("013457@$!", "oieastasi"))
PUNCTUATION = re.compile(r"[@$!]+(?![^\W_])")
LOOKALIKES = dict(zip("абеорсухікмнтвѕјԁɡαβεηικνορτυχωı", "abeopcyxikmhtbsjdgabenikvoptuxwi"))


class Folding(dict):
    """Translation table that works out each character when it is first met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in SIGNS:
            out = SIGNS[char]
        elif char in LOOKALIKES:
            out = LOOKALIKES[char]
        else:
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()
            plain = "".join(SIGNS.get(c, LOOKALIKES.get(c, c)) for c in plain)
            out = plain if plain.isalnum() else "" if unicodedata.combining(char) else " "
        self[code] = out
        return out


FOLDING = Folding()


def fold(text: str | None) -> str:
    """Folded text between two spaces; words are what stands between spaces.  Signs that no
    letter or digit follows are punctuation."""
    plain = (text or "").lower()
    if "!" in plain or "$" in plain or "@" in plain:
        plain = PUNCTUATION.sub(" ", plain)
    return f" {plain.translate(FOLDING)} "


def features(text: str | None) -> set[str]:
    """What lexicon entries may be: " word " for whole words, " stem" for beginnings."""
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEM_LENGTHS if len(w) >= n}


@dataclass
class Model:
    """Weighted lexicon, exception phrases and the curve from (sum, density) to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0))
        if len(found):
            found.make_automaton()
        return found

    def hits(self, folded: str, automaton) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the hits that no exception phrase covers; a word counts
        once, with its heaviest entry."""
        if not len(automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for last, (size, weight) in automaton.iter(folded):
            start = last + 1 - size
            if not weight:
                spared.append((start, last + 1))
            elif start not in best or weight > best[start][1]:
                best[start] = (last + 1, weight)
        return [(s, e, w) for s, (e, w) in best.items() if not any(a <= s and e <= b for a, b in spared)]

    def strength(self, text: str | None, automaton) -> tuple[float, float, int]:
        folded = fold(text)
        found = self.hits(folded, automaton)
        total = sum(w for *_, w in found)
        return math.log1p(total), 1000 * total / len(folded), len(found)

    def score(self, total: float, density: float) -> float:
        base, by_total, by_density = self.curve
        z = base + by_total * total + by_density * math.log1p(density)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fold_part(id_col: Column) -> Column:
    """Fold number of a document; 0 is held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % HELD_OUT_PARTS


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents outside the held-out fold, chosen by a hash;
    of rows that share an id the least text."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_part(F.col("doc_id")) != 0))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def counted(sample: DataFrame, of_text, name: str) -> DataFrame:
    """(entry, clean, toxic): documents of either kind that hold an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(column(batch, "text"), column(batch, "toxic").to_pylist()):
                counts[int(toxic > 0)].update(of_text(text.as_py()))
            entries = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(entries, pa.string()), *(pa.array([c[e] for e in entries], pa.int64()) for c in counts)],
                names=[name, "clean", "toxic"])

    parts = sample.mapInArrow(run, f"{name} string, clean long, toxic long")
    return parts.groupBy(name).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def learn_lexicon(sample: DataFrame, n_clean: int, n_toxic: int, size: int = LEXICON) -> dict[str, float]:
    counts = counted(sample, features, "entry").filter(F.col("toxic") >= MIN_TOXIC_DOCS)
    odds = lambda n, of: F.log((F.col(n) + 0.5) / (F.lit(of) - F.col(n) + 0.5))
    weight = odds("toxic", n_toxic) - odds("clean", n_clean)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.withColumn("weight", weight).filter((weight > 0) & (weight / error >= MIN_Z)).orderBy(
        (F.col("weight") * F.col("toxic")).desc(), "entry").limit(size)
    found = {r["entry"]: float(r["weight"]) for r in best.collect()}
    # a stem speaks for the words that begin with it unless they weigh clearly more
    return {e: w for e, w in found.items() if not any(found.get(e[:n], -1.0) >= w - 0.7 for n in range(2, len(e.rstrip())))}


def learn_exceptions(sample: DataFrame, model: Model, size: int = EXCEPTIONS) -> tuple[str, ...]:
    def phrases(text: str | None) -> Iterable[str]:
        automaton, folded, out = model.automaton(), fold(text), set()
        for start, _, _ in model.hits(folded, automaton):
            before, after = folded[:start].rsplit(" ", 1)[-1], folded[start:].split(" ", 3)
            word, rest = after[1], after[2] if len(after) > 2 else ""
            if before:
                out.add(f" {before} {word} ")
            if rest:
                out.add(f" {word} {rest} ")
        return out

    counts = counted(sample, phrases, "phrase").filter((F.col("clean") >= MIN_EXCEPTION_DOCS) & (F.col("toxic") * 10 < F.col("clean")))
    return tuple(r["phrase"] for r in counts.orderBy(F.col("clean").desc(), "phrase").limit(size).collect())


def fit_curve(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Logistic curve with a small penalty (Newton steps)."""
    x = np.array([[1.0, t, math.log1p(d)] for t, d, _ in rows])
    y = np.array([float(label > 0) for *_, label in rows])
    b, penalty = np.zeros(3), np.diag([1e-6, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (y - p) - penalty @ b
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, slope)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: Iterable[str] = ()) -> Model:
    """Fit lexicon, exception phrases and curve; ``exceptions`` adds phrases of the caller."""
    rows = written(labelled_sample(docs, labels, sample), "toxicity-sample")
    sizes = {r["kind"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("kind")).agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(False, 0), sizes.get(True, 0)
    if not clean or not toxic:
        share = toxic / (clean + toxic) if clean + toxic else 0.0
        return Model(curve=(math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0))
    model = Model(learn_lexicon(rows, clean, toxic))
    own = tuple(f" {' '.join(fold(p).split())} " for p in exceptions)
    model.exceptions = tuple(dict.fromkeys((*own, *learn_exceptions(rows, model))))
    seen = strengths(rows, model).select("total", "density", "toxic").collect()  # at most ``sample`` rows
    model.curve = fit_curve([(r["total"], r["density"], r["toxic"]) for r in seen])
    return model


def strengths(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Replace the text by (total, density, hits, score)."""
    added = [("total", T.DoubleType()), ("density", T.DoubleType()), ("hits", T.LongType()), ("score", T.DoubleType())]
    names = {text_col, *(n for n, _ in added)}
    kept = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found = [model.strength(t.as_py(), automaton) for t in column(batch, text_col)]
            yield extended(batch, [f.name for f in kept], {
                "total": pa.array([f[0] for f in found], pa.float64()), "density": pa.array([f[1] for f in found], pa.float64()),
                "hits": pa.array([f[2] for f in found], pa.int64()),
                "score": pa.array([model.score(f[0], f[1]) for f in found], pa.float64())})

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, t) for n, t in added)]))


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents whose score is below the limit, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            scores = [model.score(*model.strength(t.as_py(), automaton)[:2]) for t in column(batch, text_col)]
            yield batch.filter(pa.array([s < limit for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows."""
    scored = strengths(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", (fold_part(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")
