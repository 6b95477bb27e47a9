"""SRC-4: scoring, capability and redaction rules as data, loaded from a JSON or YAML file.

A file is read with Spark's own reader, so it may lie in any store Spark reaches, and is
configuration-sized: it becomes plain values that the operators turn into expressions when
the plan is built.  Missing parts fall back to the built-in rules; malformed ones are errors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from assay.functions import text as T
from assay.sources import dims

RULE_SCHEMA = "category string, metric_name string, weight double, invert boolean, pass_threshold double, penalty_on_fail double"
MODEL_SCHEMA = ("provider string, model_name string, context_limit bigint, max_output_tokens bigint, supports_tools boolean, "
                "supports_system_messages boolean, supports_json_schema boolean")
# What a model without an entry for them has.
MODEL_DEFAULTS = {"context_limit": 4096, "max_output_tokens": 800, "supports_tools": False, "supports_system_messages": True,
                  "supports_json_schema": False}


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration file (or a folder that Spark wrote one into) as a dict."""
    parts = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]  # one small file
    text = "".join(p for p in parts if p.strip())
    try:
        loaded = json.loads(text or "{}")
    except ValueError:
        import yaml  # optional; only needed for files that aren't JSON

        loaded = yaml.safe_load(text) or {}
    if not isinstance(loaded, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return loaded


@dataclass(frozen=True)
class Scoring:
    """Metric rules and verdict thresholds."""

    metrics: tuple[tuple, ...]
    pass_threshold: float = dims.PASS_THRESHOLD
    warn_threshold: float = dims.WARN_THRESHOLD
    min_confidence: float = dims.MIN_CONFIDENCE
    blocking: tuple[str, ...] = dims.BLOCKING_CATEGORIES
    category_weights: dict[str, float] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scoring:
        raw = read_config(spark, path)
        metrics = []
        for category, entry in (raw.get("categories") or {}).items():
            for name, rule in ((entry or {}).get("metrics") or {}).items():
                rule = rule or {}
                weight = float(rule.get("weight", 1.0))
                if weight < 0:
                    raise ValueError(f"{category}.{name}: negative weight")
                limit, penalty = rule.get("pass_threshold"), rule.get("penalty_on_fail")
                metrics.append((category, name, weight, bool(rule.get("invert", False)), None if limit is None else float(limit),
                                None if penalty is None else float(penalty)))
        verdicts = raw.get("verdicts") or {}
        return cls(tuple(metrics), float(verdicts.get("pass_threshold", dims.PASS_THRESHOLD)),
                   float(verdicts.get("warn_threshold", dims.WARN_THRESHOLD)),
                   float(verdicts.get("min_auto_confidence", dims.MIN_CONFIDENCE)),
                   tuple(verdicts.get("blocking_categories", dims.BLOCKING_CATEGORIES)),
                   {k: float(v) for k, v in (raw.get("category_weights") or {}).items()})

    def rules(self, spark: SparkSession) -> DataFrame:
        """One row per metric, as ``verdicts.score_with_rule`` takes them."""
        return spark.createDataFrame(list(self.metrics), RULE_SCHEMA)

    def thresholds(self) -> dict:
        """Arguments of ``verdicts.decide_verdict``."""
        return {"pass_threshold": self.pass_threshold, "warn_threshold": self.warn_threshold,
                "min_confidence": self.min_confidence, "blocking": self.blocking}


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """The capability registry: provider -> model -> capabilities, with the defaults for what is left out."""
    names = [c.split()[0] for c in MODEL_SCHEMA.split(", ")][2:]
    rows = [(provider, model, *((meta or {}).get(n, MODEL_DEFAULTS[n]) for n in names))
            for provider, models in read_config(spark, path).items() for model, meta in (models or {}).items()]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


@dataclass(frozen=True)
class Redaction:
    """Redaction rules in order, and the keys whose values are always replaced."""

    rules: tuple[tuple[str, str, str], ...] = tuple(T.REDACTION_RULES)
    field_names: tuple[str, ...] = T.SENSITIVE_FIELD_NAMES
    forbidden_fields: tuple[str, ...] = ()
    scan_extensions: tuple[str, ...] = ()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Redaction:
        raw = read_config(spark, path)
        # names of their own: the built-in names have search marks that needn't fit another pattern
        rules = tuple((f"rule_{i}", r["pattern"], r["replacement"]) for i, r in enumerate(raw["value_patterns"])) if "value_patterns" in raw else cls.rules
        return cls(rules, tuple(raw.get("sensitive_field_names", T.SENSITIVE_FIELD_NAMES)),
                   tuple(raw.get("forbidden_output_fields", ())), tuple(raw.get("scan_extensions", ())))
