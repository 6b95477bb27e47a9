"""Judge queries: SCL-4, SCL-10, SCL-11, SET-4, J7, A7, A8, A9, A10, L7."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import judge as J
from assay.functions import text as T
from assay.operators import judges, stats
from assay.plans.catalog import register
from assay.plans.fixtures import oracle

JUDGE_WEIGHTS = {"quality": 2.0, "toxicity": 1.0, "length": 1.0}
B = 1000

PARSE_CTE = """
jp AS (SELECT doc_id, raw,
  CASE WHEN raw IS NULL OR raw <> trim(raw) OR raw = '' OR contains(raw, '```') OR NOT coalesce(json_valid(raw), FALSE) THEN FALSE
  ELSE (json_type(raw) = 'OBJECT'
   AND list_sort(json_keys(raw)) = ['reason', 'schema_version', 'score']
   AND json_type(raw, '$.schema_version') = 'VARCHAR' AND json_extract_string(raw, '$.schema_version') = '1.0'
   AND json_type(raw, '$.score') IN ('DOUBLE', 'UBIGINT', 'BIGINT')
   AND CAST(json_extract(raw, '$.score') AS DOUBLE) BETWEEN 0.0 AND 1.0
   AND json_type(raw, '$.reason') = 'VARCHAR' AND trim(json_extract_string(raw, '$.reason')) <> ''
   AND length(json_extract_string(raw, '$.reason')) <= 2000) END AS valid
 FROM judge_raw)
"""


@register("judge_parse", oracle(["judge_raw"], """
SELECT doc_id, valid, CASE WHEN valid THEN CAST(json_extract(raw, '$.score') AS DOUBLE) END AS score,
 CASE WHEN valid THEN json_extract_string(raw, '$.reason') END AS reason,
 CASE WHEN valid THEN CAST(json_extract(raw, '$.score') AS DOUBLE) >= 0.8 END AS passed
FROM jp""", PARSE_CTE))
def q_judge_parse(fx):
    """SCL-10 + SCL-11: strict judge-output parsing, fail closed; pass = score >= 0.8."""
    p = fx.judge_raw.select("doc_id", J.parse_judge_output("raw").alias("p"))
    return p.select("doc_id", F.col("p.valid").alias("valid"), F.col("p.score").alias("score"),
                    F.col("p.reason").alias("reason"), J.judge_passed(F.col("p.score")).alias("passed"))


@register("judge_key_set_diff", oracle(["judge_raw"], """
SELECT doc_id, array_to_string(list_sort(list_filter(json_keys(raw), lambda k: NOT list_contains(['reason', 'schema_version', 'score'], k))), ',') AS unknown_fields,
 array_to_string(list_sort(list_filter(['reason', 'schema_version', 'score'], lambda k: NOT list_contains(json_keys(raw), k))), ',') AS missing_fields
FROM judge_raw WHERE CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' AND len(json_keys(raw)) = len(list_distinct(json_keys(raw))) ELSE FALSE END"""))
def q_judge_key_set_diff(fx):
    """SET-4: unknown and missing fields of judge objects (sorted, distinct)."""
    keys = J.top_level_keys("raw")
    d = fx.judge_raw.select("doc_id", keys.alias("k")).where(F.col("k").isNotNull())
    diff = J.key_set_diff("k")
    return d.select("doc_id", F.array_join(diff["unknown"], ",").alias("unknown_fields"),
                    F.array_join(diff["missing"], ",").alias("missing_fields"))


@register("extract_json_block", oracle(["judge_raw"], """
SELECT doc_id, regexp_replace(coalesce(nullif(regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{.*?\\}|\\[.*?\\])\\s*```', 1), ''),
  nullif(regexp_extract(raw, '(?s)(\\{.*\\}|\\[.*\\])', 1), '')), '^\\s+|\\s+$', '', 'g') AS block FROM judge_raw"""))
def q_extract_json_block(fx):
    """SCL-4: fenced JSON block first, else the greedy brace span."""
    return fx.judge_raw.select("doc_id", T.extract_json_block("raw").alias("block"))


ENSEMBLE_SQL = """
SELECT d.doc_id AS subject_id,
 CASE WHEN a.n IS NULL THEN FALSE WHEN a.pw > a.tw / 2.0 THEN TRUE WHEN a.pw < a.tw / 2.0 THEN FALSE ELSE a.fs >= 0.5 END AS passed,
 CASE WHEN a.n IS NULL THEN 0.0 ELSE round(a.fs, 6) END AS final_score, 'weighted_majority' AS strategy,
 CASE WHEN a.n IS NULL THEN 0.0 ELSE round(greatest(a.p, a.n - a.p) / a.n, 6) END AS agreement_ratio,
 CASE WHEN a.n IS NULL THEN TRUE ELSE a.p > 0 AND a.p < a.n END AS disagreement_reported,
 coalesce(a.pw = a.tw / 2.0, FALSE) AS tie_broken, coalesce(a.n, 0) AS total_judges,
 coalesce(round(a.pw, 6), 0.0) AS passed_weight, coalesce(round(a.tw, 6), 0.0) AS total_weight
FROM documents d LEFT JOIN (
 SELECT subject_id, count(*) AS n, count(*) FILTER (WHERE passed) AS p,
  sum(CASE judge_id WHEN 'quality' THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) AS tw,
  sum(CASE WHEN passed THEN (CASE judge_id WHEN 'quality' THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) ELSE CAST(0.0 AS DOUBLE) END) AS pw, avg(score) AS fs
 FROM judge_results GROUP BY subject_id) a ON a.subject_id = d.doc_id"""


@register("ensemble_consolidate", oracle(["judge_results"], ENSEMBLE_SQL))
def q_ensemble_consolidate(fx):
    """A7 + J7: weighted-majority ensemble per document; unjudged documents fail closed."""
    subjects = fx.documents.select(F.col("doc_id").alias("subject_id"))
    return judges.ensemble_consolidate(fx.judge_results, subjects, JUDGE_WEIGHTS)


@register("ensemble_unanimous", oracle(["judge_results"], """
SELECT subject_id, count(*) FILTER (WHERE passed) = count(*) AS passed, round(avg(score), 6) AS final_score
FROM judge_results GROUP BY subject_id"""))
def q_ensemble_unanimous(fx):
    """Unanimous strategy (every judge must pass)."""
    return judges.ensemble_consolidate(fx.judge_results, None, None, "unanimous").select(
        "subject_id", "passed", "final_score")


@register("summary_stats", oracle(["judge_results"], """
SELECT judge_id, count(*) AS count, round(avg(score), 6) AS mean, round(median(score), 6) AS median,
 round(coalesce(var_samp(score), 0.0), 6) AS variance, round(sqrt(coalesce(var_samp(score), 0.0)), 6) AS std_dev
FROM judge_results GROUP BY judge_id"""))
def q_summary_stats(fx):
    """Count, mean, interpolated median, sample variance and std dev per judge."""
    return stats.summary_stats(fx.judge_results, ["judge_id"], "score")


def _horner_sql(x: str, coefficients, one: bool) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return f"({out} * {x} + 1.0::DOUBLE)" if one else out


def _low_sql(v: str) -> str:
    t = f"sqrt(-2.0::DOUBLE * ln({v}))"
    return f"({_horner_sql(t, stats.QUANTILE_C, False)} / {_horner_sql(t, stats.QUANTILE_D, True)})"


QUANTILE_SQL = f"""CASE WHEN u < {stats.QUANTILE_LOW} THEN {_low_sql('u')} WHEN u > {1.0 - stats.QUANTILE_LOW} THEN -{_low_sql('(1.0::DOUBLE - u)')}
  ELSE {_horner_sql('((u - 0.5::DOUBLE) * (u - 0.5::DOUBLE))', stats.QUANTILE_A, False)} * (u - 0.5::DOUBLE)
   / {_horner_sql('((u - 0.5::DOUBLE) * (u - 0.5::DOUBLE))', stats.QUANTILE_B, True)} END"""


def _splits_sql(source: str, tag: str | None, sfx: str = "") -> str:
    """CTEs up to means(g, b, m): n draws split down the tree of value counts, as ``stats.bootstrap_means`` does."""
    label = "d.g" if tag is None else f"'{tag}'"
    digits = stats.UNIFORM_BITS // 4
    return f"""
 hist{sfx} AS (SELECT g, v, count(*) AS c, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS idx FROM {source} WHERE v IS NOT NULL GROUP BY g, v),
 heights{sfx} AS (SELECT length(bin(greatest(max(idx), 1)::BIGINT)) AS top FROM hist{sfx}),
 nodes{sfx} AS (SELECT g, k, idx >> k AS i, sum(c)::BIGINT AS c FROM hist{sfx}, heights{sfx}, range(0, top + 1) t(k) GROUP BY 1, 2, 3),
 draws{sfx} AS (
  SELECT g, b, k, i, c AS m FROM nodes{sfx}, heights{sfx}, range(0, {B}) b(b) WHERE k = top
  UNION ALL SELECT g, b, k - 1, 2 * i + side, CASE side WHEN 0 THEN x ELSE m - x END FROM (
   SELECT g, b, k, i, m, CASE WHEN share = 1.0 THEN m WHEN share <= 0.5 THEN least(greatest(y, 0), m) ELSE m - least(greatest(y, 0), m) END AS x FROM (
    SELECT *, CASE WHEN mean < {stats.SMALL_MEAN} THEN list_reduce(list_prepend(
      {{'k': 0::BIGINT, 'f': pow(1.0::DOUBLE - r, m), 'c': pow(1.0::DOUBLE - r, m), 'x': CASE WHEN u > pow(1.0::DOUBLE - r, m) THEN 1::BIGINT ELSE 0::BIGINT END}},
      list_transform(range(1, least(m, ceil(mean + 8.0::DOUBLE * sqrt(mean) + 12.0::DOUBLE)::BIGINT) + 1), lambda j: {{'k': j, 'f': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'x': 0::BIGINT}})),
      lambda a, e: {{'k': e.k, 'f': a.f * ((m::DOUBLE - e.k + 1) / e.k) * (r / (1.0::DOUBLE - r)), 'c': a.c + a.f * ((m::DOUBLE - e.k + 1) / e.k) * (r / (1.0::DOUBLE - r)),
       'x': a.x + CASE WHEN u > a.c + a.f * ((m::DOUBLE - e.k + 1) / e.k) * (r / (1.0::DOUBLE - r)) THEN 1::BIGINT ELSE 0::BIGINT END}}).x
     ELSE floor(mean + sqrt(mean * (1.0::DOUBLE - r)) * z + (z * z - 1.0::DOUBLE) * (1.0::DOUBLE - 2.0::DOUBLE * r) / 6.0::DOUBLE + 0.5::DOUBLE)::BIGINT END AS y FROM (
     SELECT *, m::DOUBLE * r AS mean, {QUANTILE_SQL} AS z FROM (
      SELECT *, least(share, 1.0::DOUBLE - share) AS r FROM (
       SELECT d.g, d.b, d.k, d.i, d.m, l.c::DOUBLE / p.c::DOUBLE AS share,
        (('0x' || substr(md5(concat_ws(':', '42', {label}, CAST(d.b AS VARCHAR), CAST(d.k AS VARCHAR), CAST(d.i AS VARCHAR))), 1, {digits}))::BIGINT + 0.5::DOUBLE)
         / {float(2 ** stats.UNIFORM_BITS)!r}::DOUBLE AS u
       FROM draws{sfx} d JOIN nodes{sfx} p ON p.g = d.g AND p.k = d.k AND p.i = d.i JOIN nodes{sfx} l ON l.g = d.g AND l.k = d.k - 1 AND l.i = 2 * d.i
       WHERE d.k > 0 AND d.m > 0))))) t, range(0, 2) s(side)),
 means{sfx} AS (SELECT d.g, d.b, sum(d.m * h.v) / any_value(n) AS m FROM draws{sfx} d JOIN hist{sfx} h ON h.g = d.g AND h.idx = d.i
  JOIN (SELECT g, sum(c) AS n FROM hist{sfx} GROUP BY g) s ON s.g = d.g WHERE d.k = 0 GROUP BY d.g, d.b)"""


def _interval_sql(confidence: float) -> str:
    lo, hi = stats.quantile_index(confidence, B)
    return f"""
FROM (SELECT g, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, any_value(v) AS only FROM vals WHERE v IS NOT NULL GROUP BY g) s
LEFT JOIN (SELECT g, ms[{lo + 1}] AS lo, ms[{hi + 1}] AS hi FROM (SELECT g, list_sort(list(m)) AS ms FROM means GROUP BY g)) e ON e.g = s.g"""


def _bootstrap_sql(group: str) -> str:
    return f"""
SELECT s.g AS {group}, s.n AS sample_size, round(s.mean, 6) AS mean, round(CASE WHEN s.n = 1 THEN s.only ELSE e.lo END, 6) AS ci_lower,
 round(CASE WHEN s.n = 1 THEN s.only ELSE e.hi END, 6) AS ci_upper, CAST(0.95 AS DOUBLE) AS confidence_level,
 round(CASE WHEN s.n = 1 THEN 0.0 ELSE coalesce(s.sd, 0.0) END, 6) AS std_dev,
 CASE WHEN s.n < 10 THEN 'Small sample size (' || s.n || ' < 10); confidence intervals may be wide or unstable.' ELSE '' END AS warning,
 'hash' AS mode{_interval_sql(0.95)}"""


@register("bootstrap_ci", oracle(["judge_results"], _bootstrap_sql("judge_id"),
          "vals AS (SELECT judge_id AS g, score AS v FROM judge_results)," + _splits_sql("vals", None), recursive=True))
def q_bootstrap_ci(fx):
    """A9 + L7: hash-seeded percentile bootstrap of the mean score per judge (B = 1000)."""
    return stats.bootstrap_ci(fx.judge_results, "judge_id", "score", "subject_id", 0.95, B, 42, "hash")


@register("bootstrap_ci_latency", oracle(["executions"], _bootstrap_sql("provider"),
          "vals AS (SELECT provider AS g, CAST(latency_ms AS DOUBLE) AS v FROM executions)," + _splits_sql("vals", None), recursive=True))
def q_bootstrap_ci_latency(fx):
    """A9 over many distinct values: bootstrap interval of the mean latency per provider (B = 1000)."""
    return stats.bootstrap_ci(fx.executions, "provider", "latency_ms", "execution_id", 0.95, B, 42, "hash")


@register("pairwise_delta_ci", oracle(["judge_results"], f"""
SELECT 'quality' AS sample_a, 'toxicity' AS sample_b,
 round((SELECT avg(score) FROM judge_results WHERE judge_id = 'quality')
  - (SELECT avg(score) FROM judge_results WHERE judge_id = 'toxicity'), 6) AS delta_mean,
 round(d.ds[{int((0.05 / 2.0) * B) + 1}], 6) AS ci_lower, round(d.ds[{min(int((1.0 - 0.05 / 2.0) * B), B - 1) + 1}], 6) AS ci_upper
FROM (SELECT list_sort(list(a.m - b.m)) AS ds FROM means_a a JOIN means_b b ON a.b = b.b) d""",
    "va AS (SELECT judge_id AS g, score AS v FROM judge_results WHERE judge_id = 'quality'),"
    "vb AS (SELECT judge_id AS g, score AS v FROM judge_results WHERE judge_id = 'toxicity'),"
    + _splits_sql("va", "a", "_a") + "," + _splits_sql("vb", "b", "_b"), recursive=True))
def q_pairwise_delta_ci(fx):
    """A10: bootstrap interval of mean(quality) - mean(toxicity)."""
    return stats.pairwise_delta_ci(fx.judge_results, "judge_id", "score", "subject_id", "quality", "toxicity",
                                   0.95, B, 42)


@register("bootstrap_ci_poisson")
def q_bootstrap_ci_poisson(fx):
    """A9 at scale: Poisson-weighted bootstrap (B running sums per partition, no n * B explosion)."""
    return stats.bootstrap_ci(fx.judge_results, "judge_id", "score", "subject_id", 0.95, B, 42, "poisson")


@register("structured_output", oracle(["judge_raw"], """
SELECT CAST(doc_id AS VARCHAR) AS execution_id,
 CAST(CASE WHEN kind = 'container' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS numeric_score, coalesce(kind = 'container', FALSE) AS passed,
 CAST(CASE WHEN kind IS NULL THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence
FROM (SELECT doc_id, CASE WHEN NOT coalesce(json_valid(raw), FALSE) THEN NULL
  WHEN json_type(raw) IN ('OBJECT', 'ARRAY') THEN 'container' ELSE 'scalar' END AS kind FROM judge_raw) j"""))
def q_structured_output(fx):
    """Structured-output validity of raw judge texts (cases that carry a JSON schema)."""
    from assay.operators import evaluators as ev

    empty = F.array().cast("array<string>")
    rc = fx.judge_raw.select(F.col("doc_id").cast("string").alias("execution_id"), F.col("raw").alias("text"),
                             empty.alias("tags"), empty.alias("must_contain"), empty.alias("must_not_contain"),
                             empty.alias("tool_calls"), F.lit(True).alias("has_json_schema"))
    s = ev.content_integrity(rc).where(F.col("metric_name") == "structured_output_validity")
    return s.select("execution_id", "numeric_score", "passed", "confidence")
