"""Derived input views over the driver tables.

The driver ships generic tables (events, conversations, labels, benchmark, ...).  These
views turn them into the evaluation-domain inputs (executions, responses, scores,
judge results, decision logs, access requests) so every operator runs on data that grows
with the scale factor.  The view texts are shared: Spark runs them through
``spark.sql(text, **frames)`` and the DuckDB oracle inlines them as CTEs, so both
engines see identical inputs.  ``{name}`` is a table placeholder; ``{{``/``}}`` are
literal braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.sources.tables import read_table

# Fixed fixture definitions (must stay identical to the oracle side).
VIEWS: dict[str, str] = {
    "models": """
SELECT * FROM (VALUES
 (0,'openai','gpt-4o',128000,4096,TRUE,TRUE,CAST(5.0 AS DOUBLE),CAST(15.0 AS DOUBLE)),
 (1,'openai','gpt-4o-mini',128000,4096,TRUE,TRUE,CAST(0.15 AS DOUBLE),CAST(0.6 AS DOUBLE)),
 (2,'anthropic','claude-sonnet-4-6',200000,8192,TRUE,FALSE,CAST(3.0 AS DOUBLE),CAST(15.0 AS DOUBLE)),
 (3,'anthropic','claude-opus-4-5-20251101',200000,8192,TRUE,FALSE,CAST(15.0 AS DOUBLE),CAST(75.0 AS DOUBLE)),
 (4,'google','gemini-3.6-flash',1000000,8192,TRUE,TRUE,CAST(0.075 AS DOUBLE),CAST(0.3 AS DOUBLE)),
 (5,'xai','grok-4.3',1000000,8192,TRUE,TRUE,CAST(1.25 AS DOUBLE),CAST(2.5 AS DOUBLE))
) AS t(model_no,provider,model_name,context_limit,max_output_tokens,supports_tools,supports_json_schema,input_per_million,output_per_million)
""",
    "executions": """
SELECT concat('exec-',e.event_id) AS execution_id, concat('run-',e.user_id % 20) AS run_id,
 e.ts AS request_ts, m.provider, m.model_name AS configured_model,
 CASE WHEN e.event_id % 97 = 0 THEN 'mystery-model' WHEN e.event_id % 12 < 6 THEN concat(m.model_name,'-2026-01-15') ELSE m.model_name END AS returned_model,
 CASE e.event_id % 7 WHEN 0 THEN 'tool_use_boundaries' WHEN 1 THEN 'prompt_robustness' WHEN 2 THEN 'context_isolation' WHEN 3 THEN 'long_context_behavior' WHEN 4 THEN 'content_integrity' ELSE 'guardrail_consistency' END AS category,
 CASE WHEN e.event_type='error' THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN e.event_type<>'error' THEN NULL WHEN e.event_id % 3 = 0 THEN 'RateLimitError' WHEN e.event_id % 3 = 1 THEN 'ProviderTimeoutError' ELSE 'AuthenticationError' END AS error_type,
 CAST(floor(e.value*10) AS BIGINT) AS latency_ms, 100 + (e.event_id*7) % 900 AS input_tokens, 50 + (e.event_id*13) % 700 AS output_tokens
 FROM {events} e JOIN {models} m ON m.model_no = e.event_id % 6
""",
    "responses": """
SELECT concat('exec-',conv_id,'-',turn) AS execution_id, concat('case-',conv_id % 40) AS test_case_id, conv_id, turn, role,
 CASE (conv_id+turn) % 6 WHEN 0 THEN 'send_email' WHEN 1 THEN 'get_weather,send_email' WHEN 2 THEN 'get_weather' ELSE '' END AS tool_calls_csv,
 CASE WHEN (conv_id+turn) % 5 = 0 THEN concat('I cannot help with that. ',text) WHEN (conv_id+turn) % 11 = 0 THEN concat(text,' <iframe src=x>') ELSE text END AS text
 FROM {conversations} WHERE role='assistant'
""",
    "judge_results": """
SELECT doc_id AS subject_id, 'quality' AS judge_id, quality=1 AS passed, CASE WHEN quality=1 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS score FROM {labels}
 UNION ALL SELECT doc_id,'toxicity', toxic=0, CASE WHEN toxic=0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END FROM {labels}
 UNION ALL SELECT doc_id,'length', doc_id % 3 <> 0, CASE WHEN doc_id % 3 <> 0 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END FROM {labels} WHERE doc_id % 2 = 0
""",
    "test_cases": """
SELECT concat('case-',item_id) AS id,
 CASE item_id % 6 WHEN 0 THEN 'tool_use_boundaries' WHEN 1 THEN 'prompt_robustness' WHEN 2 THEN 'context_isolation' WHEN 3 THEN 'long_context_behavior' WHEN 4 THEN 'content_integrity' ELSE 'guardrail_consistency' END AS category,
 CASE item_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS risk_level,
 CASE WHEN item_id % 3 = 0 THEN 'refusal' WHEN item_id % 3 = 1 THEN 'benign,baseline' ELSE 'tool-use,denied-tool:send_email' END AS tags_csv FROM {benchmark}
""",
    "case_phrases": """
SELECT concat('case-',item_id) AS test_case_id, 'must_contain' AS kind, CASE WHEN item_id % 3 = 0 THEN text ELSE split_part(text,' ',2) END AS phrase FROM {benchmark} WHERE item_id % 5 <> 4
 UNION ALL SELECT concat('case-',item_id), 'must_not_contain', CASE WHEN item_id % 4 = 0 THEN 'i CANNOT' ELSE upper(split_part(text,' ',3)) END FROM {benchmark} WHERE item_id % 2 = 0
""",
    "metric_rules": """
SELECT * FROM (VALUES
 ('guardrail_consistency',1,'refusal_consistency',CAST(0.30 AS DOUBLE),FALSE),('guardrail_consistency',2,'forbidden_content',CAST(NULL AS DOUBLE),CAST(NULL AS BOOLEAN)),
 ('tool_use_boundaries',1,'unauthorized_call_rate',CAST(0.35 AS DOUBLE),TRUE),('tool_use_boundaries',2,'forbidden_content',CAST(NULL AS DOUBLE),CAST(NULL AS BOOLEAN)),
 ('prompt_robustness',1,'semantic_consistency',CAST(0.35 AS DOUBLE),FALSE),('prompt_robustness',2,'forbidden_content',CAST(NULL AS DOUBLE),CAST(NULL AS BOOLEAN)),
 ('context_isolation',1,'cross_session_leak_rate',CAST(0.45 AS DOUBLE),TRUE),('context_isolation',2,'role_boundary_compliance',CAST(0.30 AS DOUBLE),FALSE),
 ('long_context_behavior',1,'exact_retrieval_accuracy',CAST(0.30 AS DOUBLE),FALSE),('long_context_behavior',2,'distraction_resistance',CAST(NULL AS DOUBLE),CAST(NULL AS BOOLEAN)),
 ('content_integrity',1,'markup_safety',CAST(0.20 AS DOUBLE),FALSE),('content_integrity',2,'unsupported_claim_rate',CAST(0.25 AS DOUBLE),TRUE)
) AS t(category,score_pos,metric_name,weight,invert)
""",
    "scores": """
SELECT x.execution_id, x.category, r.score_pos, r.metric_name,
 CASE WHEN (x.latency_ms + 3 * r.score_pos) % 5 = 0 THEN CAST(0.0 AS DOUBLE) WHEN (x.latency_ms + r.score_pos) % 7 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS numeric_score,
 (x.latency_ms + 3 * r.score_pos) % 5 <> 0 AS passed,
 CASE WHEN x.latency_ms % 9 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence
 FROM {executions} x JOIN {metric_rules} r ON r.category = x.category WHERE x.status = 'completed' AND x.latency_ms % 50 <> 0
""",
    "judge_raw": """
SELECT doc_id, CASE doc_id % 8
 WHEN 0 THEN '{{"schema_version":"1.0","score":0.9,"reason":"safe"}}'
 WHEN 1 THEN '{{"schema_version":"1.0","score":0.5,"reason":"weak"}}'
 WHEN 2 THEN '{{"schema_version":"1.0","score":0.1,"score":1.0,"reason":"dup"}}'
 WHEN 3 THEN '{{"schema_version":"1.0","score":0.9,"reason":"safe"}} trailing'
 WHEN 4 THEN '{{"schema_version":"1.0","score":true,"reason":"bool"}}'
 WHEN 5 THEN '{{"schema_version":"1.0","score":999,"reason":"range"}}'
 WHEN 6 THEN '```{{"schema_version":"1.0","score":0.9,"reason":"safe"}}```'
 ELSE '{{"schema_version":"1.0","score":0.1,"reason":"x","passed":true}}' END AS raw FROM {labels}
""",
    "decisions": """
SELECT concat('stream-',event_id % 10) AS stream_id, CAST(floor(event_id / 10) AS BIGINT) + 1 AS pos, event_id,
 CAST(floor(event_id / 10) AS BIGINT) + 1 + CASE WHEN event_id % 499 = 0 THEN 1 ELSE 0 END AS stream_sequence,
 concat('dec-', CASE WHEN event_id % 251 = 0 AND event_id > 10 THEN event_id - 10 ELSE event_id END) AS decision_id,
 CASE WHEN event_id % 307 = 0 THEN 'broken' WHEN event_id < 10 THEN 'GENESIS' ELSE md5(concat('d',event_id - 10)) END AS previous_record_digest,
 md5(concat('d',event_id)) AS current_record_digest FROM {events}
""",
    "access_requests": """
SELECT event_id AS request_id, concat('t',user_id % 5) AS identity_tenant, concat('u',user_id) AS identity_user, user_id % 17 = 0 AS is_admin,
 concat('t',CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE user_id % 5 END) AS owner_tenant,
 concat('u',CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id % 150 END) AS owner_user,
 CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'UPDATE' WHEN 'purchase' THEN 'EXPORT' WHEN 'signup' THEN 'ADMIN' ELSE 'DELETE' END AS action,
 CASE WHEN event_id % 13 = 0 THEN 't9' END AS parent_tenant, CASE WHEN event_id % 7 = 0 THEN 'p1' END AS parent_id,
 CASE WHEN event_id % 14 = 0 THEN 'p2' WHEN event_id % 7 = 0 THEN 'p1' END AS requested_parent FROM {events}
""",
}

# view -> the tables / views it reads, in creation order.
DEPS: dict[str, tuple[str, ...]] = {
    "models": (),
    "executions": ("events", "models"),
    "responses": ("conversations",),
    "judge_results": ("labels",),
    "test_cases": ("benchmark",),
    "case_phrases": ("benchmark",),
    "metric_rules": (),
    "scores": ("executions", "metric_rules"),
    "judge_raw": ("labels",),
    "decisions": ("events",),
    "access_requests": ("events",),
}


class Fixtures:
    """Lazily builds fixture DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEWS:
                frames = {d: self[d] for d in DEPS[name]}
                self._cache[name] = self.spark.sql(VIEWS[name], **frames)
            else:
                self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "sf_dir"):
            raise AttributeError(name)
        return self[name]


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n not in VIEWS or n in out:
            return
        for d in DEPS[n]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def oracle(views, body: str, ctes: str = "", recursive: bool = False) -> str:
    """DuckDB text: the needed fixture views as CTEs, then optional extra CTEs, then the body."""
    parts = []
    for n in _closure(views):
        deps = {d: d for d in DEPS[n]}
        parts.append(f"{n} AS ({VIEWS[n].format(**deps).strip()})")
    if ctes.strip():
        parts.append(ctes.strip())
    return (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else "") + body.strip()
