"""The contract queries of the operators, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assay.llm import bpe, caps, chat, mtree, packing, partenum, pii, quality, repair, secrets, sharding, toxicity, whitening
from assay.llm.common import prepare, table


def op1_entity_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(prepare(spark), sf_dir, "documents"))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(prepare(spark), sf_dir, "documents"))


def op3_schema_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_rows(table(prepare(spark), sf_dir, "conversations"))


def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(prepare(spark), sf_dir, "documents"))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(prepare(spark), sf_dir, "documents"))


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.linked_rows(table(prepare(spark), sf_dir, "documents"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(prepare(spark), sf_dir, "documents"))


def op8_folded_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_rows(table(prepare(spark), sf_dir, "embeddings"))


def op10_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(prepare(spark), sf_dir, "documents"))


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_rows(table(prepare(spark), sf_dir, "embeddings"))


def op12_rank_convergence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(table(prepare(spark), sf_dir, "conversations"))


def op13_cap_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicate_rows(table(prepare(spark), sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_entity_disclosure, op2_rendezvous_sharding, op3_schema_fingerprint_chat, op4_tier_packing, op5_bpe_transducer, op6_partenum_join, op7_line_frequency,
                               op8_folded_lexicon, op9_mtree_search, op10_credential_linking, op11_bit_sliced_whitening,
                               op12_rank_convergence_repair, op13_cap_filter_dedup)}


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLES: dict[str, str] = {
    "op3_schema_fingerprint_chat": f"""
WITH c AS (
 SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
 CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
 CAST(sum({len(chat.TURN_OPEN) + len(chat.TURN_CLOSE) + 2} + length(r) + length({_escaped_sql('t')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op6_partenum_join": f"""
WITH RECURSIVE w AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_hold AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s GROUP BY 1, 2),
links AS (SELECT x, y FROM both_hold JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= {partenum.THRESHOLD} * (a.n + b.n - i)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least_id AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_id ON x = w.doc_id""",
    "op9_mtree_search": f"""
WITH v AS (
 SELECT vec_id, list_transform(embedding, lambda x: floor({mtree.SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER best AS INTEGER) AS rank, c.vec_id AS vec_id,
 CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
WINDOW best AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) QUALIFY row_number() OVER best <= {mtree.TOP}""",
    "op12_rank_convergence_repair": f"""
WITH RECURSIVE src AS (
 SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
  flatten(list_transform(string_split(k, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda x, e: xor(xor(x, e) >> 1, (xor(x, e) & 1) * 3988292384))) % {repair.DAMAGES} AS kind FROM src),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
r AS (SELECT *, substr(role, 1, 1) AS first, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
steps AS (SELECT conv_id, i, first, role, text, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS x FROM r),
back AS (
 SELECT conv_id, max(i) + 1 AS i, 0 AS c0, 10 AS c1, 5 AS c2, 0 AS c3 FROM steps GROUP BY conv_id
 UNION ALL SELECT conv_id, i, least(n0, 5 + n2, 10 + n3), least(n1, 5 + n2, 10 + n3), least(n2, 5 + n3), least(n3, 5 + n2) FROM (
  SELECT s.conv_id, s.i,
   CASE WHEN must THEN c0 + 2 ELSE least(c0 + 2, c2 + x + CASE first WHEN 'u' THEN 0 ELSE 1 END, CASE first WHEN 's' THEN c1 + x ELSE c0 + 2 END) END AS n0,
   CASE WHEN must THEN c1 + 2 ELSE least(c1 + 2, c2 + x + CASE first WHEN 'u' THEN 0 ELSE 1 END) END AS n1,
   CASE WHEN must THEN c2 + 2 ELSE least(c2 + 2, c3 + x + CASE first WHEN 'a' THEN 0 ELSE 1 END) END AS n2,
   CASE WHEN must THEN c3 + 2 ELSE least(c3 + 2, c2 + x + CASE first WHEN 'u' THEN 0 ELSE 1 END) END AS n3
  FROM back b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i - 1)),
costs AS (SELECT conv_id, i, unnest([0, 1, 2, 3]) AS q, unnest([c0, c1, c2, c3]) AS c FROM back),
walk AS (
 SELECT conv_id, CAST(1 AS BIGINT) AS i, 0 AS q, c AS left_cost, '' AS audit, '' AS said, c AS cost FROM costs WHERE i = 1 AND q = 0
 UNION ALL SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END,
  CASE e WHEN 'D' THEN q WHEN 'K' THEN CASE first WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE nx END, left_cost - paid, audit || e,
  said || CASE e WHEN 'D' THEN '' ELSE chr(10) || CASE e WHEN 'K' THEN role WHEN 'R' THEN need ELSE need END || ':' || CASE e WHEN 'I' THEN '' ELSE text END END,
  cost FROM (
  SELECT w.*, s.first, s.role, s.text, CASE w.q WHEN 2 THEN 3 ELSE 2 END AS nx, CASE w.q WHEN 2 THEN 'assistant' ELSE 'user' END AS need,
   CASE WHEN 2 + d.c = left_cost THEN 'D' WHEN 5 + n.c = left_cost THEN 'I'
    WHEN NOT s.must AND s.x + k.c = left_cost THEN 'K' WHEN s.i IS NOT NULL THEN 'R' END AS e,
   CASE WHEN 2 + d.c = left_cost THEN 2 WHEN 5 + n.c = left_cost THEN 5
    WHEN NOT s.must AND s.x + k.c = left_cost THEN s.x ELSE s.x + 1 END AS paid
  FROM walk w LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i
  LEFT JOIN costs d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.i = w.i + 1 AND d.q = w.q
  LEFT JOIN costs n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i AND n.q = CASE w.q WHEN 2 THEN 3 ELSE 2 END
  LEFT JOIN costs k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i + 1 AND k.q = CASE
   WHEN s.first = 's' AND w.q = 0 THEN 1 WHEN s.first = 'u' AND w.q <> 2 THEN 2 WHEN s.first = 'a' AND w.q = 2 THEN 3 END) t
 WHERE e IS NOT NULL),
told AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(said, length(audit)) AS said, any_value(cost) AS cost FROM walk GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (prior IS NOT NULL AND prior || first NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
 coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
 sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op13_cap_filter_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {caps.COSINE}),
reach AS (SELECT x, y FROM links UNION SELECT p.x, l.y FROM reach p JOIN links l ON l.x = p.y),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
c AS (SELECT x, min(vec_id) AS c FROM reach JOIN v ON v.r = y GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, c) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, c) AS kept
FROM v LEFT JOIN n ON n.x = v.r LEFT JOIN c ON c.x = v.r""",
}
