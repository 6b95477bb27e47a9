"""Regex spans with code-point offsets, built from SQL functions only.

``regexp_extract_all`` gives the matches and ``split`` with the same pattern the gaps
between them; summing lengths in order gives each match's place.  Patterns must not match
the empty string.  Quantifiers over groups and over classes that can't give anything back
are possessive, which keeps the matches and makes long runs linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:int,start:int,stop:int,value:string>"
NO_SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(NO_SPANS)


def span(kind: int, start: Column, stop: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), stop.cast("int").alias("stop"),
                    value.alias("value"))


def find(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches; ``keep`` filters by the match."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("value"),
                         F.split(text, pattern, -1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        stop = at + F.coalesce(F.length(pair["value"]), F.lit(0))
        found = F.when(pair["value"].isNull(), acc["found"]).otherwise(
            F.concat(acc["found"], F.array(span(kind, at, stop, pair["value"]))))
        return F.struct(stop.alias("at"), found.alias("found"))

    found = F.aggregate(pairs, start, step, lambda acc: acc["found"])
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["value"]))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(no_spans())


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written_out(spans: Column, names: list[str], by_start: bool) -> Column:
    """``kind:start:end`` joined by commas, ordered by kind then start or by start then kind."""
    order = ("start", "kind") if by_start else ("kind", "start")
    keyed = F.transform(spans, lambda s: F.struct(s[order[0]].alias("a"), s[order[1]].alias("b"), s["stop"].alias("c"),
                                                  s["kind"].alias("kind"), s["start"].alias("start")))
    labels = F.array(*map(F.lit, names))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(
        ":", F.get(labels, s["kind"]), s["start"].cast("string"), s["c"].cast("string"))), ",")


def replaced(text: Column, spans: Column, labels: Column) -> Column:
    """The text with each span's code points replaced by its kind's label; overlapping spans
    become one hole with the first one's label."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["stop"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        out = F.when(apart, F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]),
                                     F.get(labels, s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    done = F.aggregate(by_place, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
