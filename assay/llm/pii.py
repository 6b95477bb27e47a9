"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that the
base patterns find.  Words around them may reveal them as well: a word t discloses entity e
as far as the corpus lets one conclude e from t, measured in bits by

    PMI(e; t) = log2(N * n(e, t) / (n(e) * n(t)))   against   IC(e) = log2(N / n(e))

with N distinct texts, n(t) of them holding t, n(e) holding e and n(e, t) holding both, at any
distance.  PMI equals IC where t occurs with e alone.  Words whose PMI reaches ``generalise``
times IC become their class, those that reach ``remove`` times IC are taken out, both wherever
they stand in documents that hold the entity.  A context is the entity's surroundings of
``CONTEXT`` code points on either side; equal surroundings, as in near copies of a text, are
one context, and texts with fewer than ``MIN_CONTEXTS`` of them are no evidence.

Only documents with base spans have contexts, and only entities in enough contexts are paired
with the terms of their documents; the words of all other documents are only
counted, after map-side aggregation, and the repeats of a text are taken off again.

Cases: null and empty texts have no spans and stay as they are; null ids are kept; repeated
rows are sanitised each for itself; an empty table gives no rows; other columns of
``sanitise`` are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import spans as S
from assay.llm.common import held, text_or_empty, unfolded, written

KINDS = ["email", "ip", "card", "phone", "generalised", "removed"]
EMAIL, IP, CARD, PHONE, GENERALISED, REMOVED = range(6)
LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]

CONTEXT = 80
MIN_CONTEXTS = 3
# Repeated texts are found by a bitmap of so many slots, which bounds the broadcast.
SLOTS = 1 << 20
GENERALISE_SHARE = 0.85
REMOVE_SHARE = 0.95

# The contract's base patterns.  Possessive quantifiers keep the matches; the
# look-behinds say that an attempt that fails at the start of a run fails all along it.
EMAIL_PATTERN = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_PATTERN = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD_PATTERN = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE_PATTERN = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM_PATTERN = r"\p{L}[\p{L}\p{N}'-]{2,}+"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(value), "")

    def add(acc: Column, i: Column) -> Column:
        d = F.get(places, i).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    is_card = lambda m: F.length(digits(m)).between(16, 19) & luhn(digits(m))
    is_ip = lambda m: F.rlike(m, F.lit(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
    is_phone = lambda m: F.length(digits(m)).between(8, 15)
    some = F.when(F.rlike(text, F.lit("[0-9](?:[\\x20-]?+[0-9]){15}")), S.find(text, CARD_PATTERN, CARD, is_card))
    return F.concat(
        F.when(F.contains(text, F.lit("@")), S.find(text, EMAIL_PATTERN, EMAIL)).otherwise(S.no_spans()),
        S.find(text, IP_PATTERN, IP, is_ip), some.otherwise(S.no_spans()),
        F.when(F.contains(text, F.lit("+")), S.find(text, PHONE_PATTERN, PHONE, is_phone)).otherwise(S.no_spans()))


def entity(kind: Column, value: Column) -> Column:
    """One name for the spellings of a protected value."""
    return F.concat_ws(":", kind.cast("string"), F.when(kind.isin(CARD, PHONE), digits(value)).otherwise(F.lower(value)))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM_PATTERN), 0), F.lower))


def found_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, base spans, contexts) of every document, with the terms and the text of those
    that have base spans; fixed in the shared folder."""
    text = text_or_empty(text_col)
    spans = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("t"),
                        base_spans(text).alias("base"))

    def context(s: Column) -> Column:
        start = F.greatest(s["start"] - CONTEXT, F.lit(0))
        around = F.substr(F.col("t"), start + 1, s["stop"] - start + CONTEXT)
        return F.struct(entity(s["kind"], s["value"]).alias("entity"), F.xxhash64(F.lower(around)).alias("context"))

    bearing = F.size("base") > 0
    return written(spans.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("row"), "base",
                                F.transform("base", context).alias("contexts"), F.when(bearing, terms_of(F.col("t"))).alias("terms"),
                                F.when(bearing, F.col("t")).alias("t")), "pii")


def document_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t): distinct texts that hold a term; repeats in a text count once.  All documents are counted
    where they are; only the terms of texts that are repeated are shuffled, to take their repeats off again."""
    text = text_or_empty(text_col)
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("t"))
    counts = texts.groupBy("text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = written(counts.select("text_hash", (F.col("n") - 1).alias("more")), "repeated")
    slot = F.pmod("text_hash", F.lit(SLOTS))
    # at most SLOTS numbers; keeps most texts that aren't repeated out of the shuffle
    near = texts.withColumn("slot", slot).join(F.broadcast(repeated.select(slot.alias("slot")).distinct()), "slot")
    one = near.join(repeated.select("text_hash"), "text_hash", "left_semi").select(
        "text_hash", terms_of(F.col("t")).alias("terms")).groupBy("text_hash").agg(F.first("terms").alias("terms"))
    again = one.join(repeated, "text_hash").select(F.explode("terms").alias("term"), (-F.col("more")).alias("n"))
    every = texts.select(F.explode(terms_of(F.col("t"))).alias("term"), F.lit(1).cast("long").alias("n"))
    return every.unionByName(again).groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str, min_contexts: int = MIN_CONTEXTS,
                     generalise: float = GENERALISE_SHARE, remove: float = REMOVE_SHARE) -> DataFrame:
    """(entity, term, kind): the words that disclose an entity and what becomes of them."""
    bearing = found.filter(F.size("contexts") > 0)
    # one context stands for all of an entity's contexts in a text, so near copies of a text stay one context
    texts = bearing.select("row", "text_hash", F.explode("contexts").alias("c")).groupBy("c.entity", "text_hash").agg(
        F.min("c.context").alias("context"), F.min("row").alias("row"))
    per_entity = texts.groupBy("entity").agg(F.count("*").alias("n_e"), F.countDistinct("context").alias("n_contexts"))
    repeated = texts.join(per_entity.filter(F.col("n_contexts") >= min_contexts).drop("n_contexts"), "entity")
    held_terms = repeated.join(bearing.select("row", "terms"), "row").select("entity", "n_e", "context", F.explode("terms").alias("term"))
    joint = held_terms.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et"), F.countDistinct("context").alias("n_contexts"))
    counted = joint.filter(F.col("n_contexts") >= min_contexts).join(document_counts(docs, text_col), "term")
    top = F.lit(found.select("text_hash").distinct().count())
    pmi, ic = F.log2(top * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), F.log2(top / F.col("n_e"))
    share = F.try_divide(pmi, ic)  # null where every document is about the entity
    kind = F.when(F.col("share") >= remove, REMOVED).when(F.col("share") >= generalise, GENERALISED)
    return counted.withColumn("share", share).withColumn("kind", kind).filter("kind is not null").select(
        "entity", "term", "kind")


def disclosing_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, extra spans): where disclosing terms stand in documents that hold their entity."""
    bearing = found.filter(F.size("contexts") > 0)
    holders = bearing.select("row", "terms", F.explode(F.array_distinct(F.transform("contexts", lambda c: c["entity"]))).alias("entity"))
    holders = holders.join(terms.select("entity").distinct(), "entity", "left_semi")
    hits = holders.select("row", "entity", F.explode("terms").alias("term")).join(terms, ["entity", "term"])
    kinds = hits.groupBy("row", "term").agg(F.max("kind").alias("kind")).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    placed = bearing.select("row", "base", "t").join(kinds, "row").select(
        "row", "base", "kinds", S.find(F.col("t"), TERM_PATTERN, GENERALISED).alias("places"))
    marked = F.transform("places", lambda w: F.struct(F.try_element_at("kinds", F.lower(w["value"])).alias("kind"),
                                                      w["start"].alias("start"), w["stop"].alias("stop")))
    apart = lambda w: ~F.exists("base", lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"]))
    return placed.select("row", F.filter(marked, lambda w: w["kind"].isNotNull() & apart(w)).alias("extra"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """(id, text_hash, base spans, extra spans) of every document."""
    found = found_entities(docs, id_col, text_col)
    extra = disclosing_spans(found, disclosing_terms(docs, found, text_col, **thresholds))
    bare = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return found.select("doc_id", "text_hash", "row", bare.alias("base")).join(extra, "row", "left").withColumn(
        "extra", F.coalesce("extra", F.array().cast("array<struct<kind:int,start:int,stop:int>>"))).drop("row")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """The documents with base spans replaced by their kind and disclosing words by ``[TERM]`` or nothing."""
    hits = scan(docs, id_col, text_col, **thresholds).select(
        "doc_id", "text_hash", F.concat("base", "extra").alias("spans"))
    hits = hits.filter(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    own = docs.select(held(docs).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("hash"))
    joined = own.join(hits, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    text = F.col("doc")[text_col]
    clean = S.replaced(text, F.col("spans"), F.array(*map(F.lit, LABELS)))
    return unfolded(joined, docs, "doc", {text_col: F.when(F.col("spans").isNull(), text).otherwise(clean)})


def pii_spans(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    found = scan(docs)
    count = lambda k: S.count_kind(F.col("base"), k)
    return found.select(
        "doc_id", count(EMAIL).alias("n_email"), count(IP).alias("n_ip"), count(CARD).alias("n_card"),
        count(PHONE).alias("n_phone"), F.sha2(S.written_out(F.col("base"), KINDS, False), 256).alias("base_sha256"),
        S.written_out(F.concat("base", "extra"), KINDS, False).alias("spans"))
