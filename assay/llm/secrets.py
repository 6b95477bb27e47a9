"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong spans (assignments, access keys, long hex) are reported as they are.  Weak parts are
found beside them: bare identifiers (``user=``, ``client_id:``), bare high-variety tokens
that may be secrets, and endpoints (URLs with a host).  On its own a weak part says nothing,
so parts are linked by an interval join: two parts of a document complement each other if
their kinds differ in role and no more than ``SCOPE`` code points lie between them.

* a bare token is reported when an identifier or access key is in its scope,
* an identifier when a secret (assignment, hex or bare token) is,
* an endpoint when both an identifier and a secret are.

The join is an equi-join on (document row, scope cell): a partner stands in the cells of its
start and of its stop, one of which is near whatever its length, and a weak part also in the
neighbouring cells, so a cell holds what fits into a few hundred code points and no document,
however long, is one group.

Cases: null and empty texts have no spans; null ids are kept; repeated rows are scanned each
for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import spans as S
from assay.llm.common import text_or_empty, written

KINDS = ["assign", "access", "hex", "token", "identifier", "endpoint"]
ASSIGN, ACCESS, HEX, TOKEN, IDENTIFIER, ENDPOINT = range(6)
# Code points that may lie between linked parts.
SCOPE = 160

# The contract's strong patterns (long runs written with counted quantifiers
# where no shorter match of the run could pass).
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?+"""
ASSIGN_PATTERN = ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]++"
ACCESS_PATTERN = "AKIA[A-Z0-9]{16,}+"
HEX_PATTERN = "[0-9a-f]{24,}+"

TOKEN_PATTERN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}+"
IDENTIFIER_PATTERN = (r"""(?<![A-Za-z])(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*+[:=]"""
                      r"""\x20*+["']?+[A-Za-z0-9@._-]{4,}+""")
ENDPOINT_PATTERN = r"""(?i:https?|ftp|jdbc:[a-z]{2,12}|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:@-]++[^\x00-\x20"'<>]*+"""


def strong_spans(text: Column) -> Column:
    value_of = lambda m: F.regexp_extract(m, "^" + ASSIGN_HEAD + "(.*)$", 1)
    return F.concat(S.find(text, ASSIGN_PATTERN, ASSIGN, lambda m: F.length(value_of(m)) >= 6),
                    S.find(text, ACCESS_PATTERN, ACCESS), S.find(text, HEX_PATTERN, HEX))


def weak_spans(text: Column) -> Column:
    varied = lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Z]")) & F.rlike(m, F.lit("[a-z]"))
    return F.concat(S.find(text, TOKEN_PATTERN, TOKEN, varied), S.find(text, IDENTIFIER_PATTERN, IDENTIFIER),
                    S.find(text, ENDPOINT_PATTERN, ENDPOINT))


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts (row, kind, start, stop) that complementary parts of the same row support."""
    role = F.when(F.col("kind").isin(ACCESS, IDENTIFIER), "identifier").when(F.col("kind") == ENDPOINT, "endpoint") \
        .otherwise("secret")
    own = parts.withColumn("role", role)
    ends = F.array_distinct(F.array(F.floor(F.col("start") / scope), F.floor(F.col("stop") / scope)))
    # a part reaches from the cell before its start to the cell after its end
    reach = F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("stop") / scope) + 1)
    weak = own.filter(F.col("kind") >= TOKEN).select("row", "kind", "start", "stop", "role", F.explode(reach).alias("cell"))
    other = own.filter(F.col("role") != "endpoint").select(
        "row", F.explode(ends).alias("cell"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), F.col("role").alias("o_role"))
    near = (F.col("o_start") - F.col("stop") <= scope) & (F.col("start") - F.col("o_stop") <= scope)
    apart = (F.col("o_start") >= F.col("stop")) | (F.col("start") >= F.col("o_stop"))
    found = weak.join(other, ["row", "cell"]).filter(near & apart & (F.col("role") != F.col("o_role")))
    roles = found.groupBy("row", "kind", "start", "stop").agg(
        F.max((F.col("o_role") == "identifier").cast("int")).alias("by_id"),
        F.max((F.col("o_role") == "secret").cast("int")).alias("by_secret"))
    complete = F.when(F.col("kind") == TOKEN, F.col("by_id") == 1).when(
        F.col("kind") == IDENTIFIER, F.col("by_secret") == 1).otherwise((F.col("by_id") == 1) & (F.col("by_secret") == 1))
    return roles.filter(complete).select("row", "kind", "start", "stop")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, row, strong spans, linked weak spans) of every document."""
    text = text_or_empty(text_col)
    bare = "kind", "start", "stop"
    found = docs.select(F.col(id_col).alias("doc_id"), strong_spans(text).alias("strong"), weak_spans(text).alias("weak"))
    places = lambda c: F.transform(c, lambda s: F.struct(*(s[k].alias(k) for k in bare)))
    inside = lambda w: F.exists("strong", lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"]))
    fixed = written(found.select("doc_id", F.monotonically_increasing_id().alias("row"), places("strong").alias("strong"),
                                 places(F.filter("weak", lambda w: ~inside(w))).alias("weak")), "secrets")
    bearing = fixed.filter(F.size("weak") > 0)
    parts = bearing.select("row", F.explode(F.concat("strong", "weak")).alias("p")).select("row", "p.*")
    linked = linked_parts(parts, scope).groupBy("row").agg(F.collect_list(F.struct(*bare)).alias("linked"))
    return fixed.drop("weak").join(linked, "row", "left").withColumn(
        "linked", F.coalesce("linked", F.array().cast("array<struct<kind:int,start:int,stop:int>>")))


def secret_spans(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    found = scan(docs)
    return found.select(
        "doc_id", S.count_kind(F.col("strong"), ASSIGN).alias("n_assign"),
        S.count_kind(F.col("strong"), ACCESS).alias("n_access"), S.count_kind(F.col("strong"), HEX).alias("n_hex"),
        F.sha2(S.written_out(F.col("strong"), KINDS, True), 256).alias("base_sha256"),
        S.written_out(F.concat("strong", "linked"), KINDS, True).alias("spans"))
