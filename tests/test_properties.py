"""Property tests: distributed algorithms against straightforward references on random inputs."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.functions import judge as J
from assay.operators.cumulative import running_sum
from assay.operators.metrics import rank_percentile
from assay.operators.stats import exact_median

SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "hot", "hot", "hot"]), st.integers(-50, 50)), min_size=1, max_size=300))
def test_running_sum_equals_window(spark, rows):
    data = [(k, i, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, t long, v long")
    got = {(r["k"], r["t"]): r["rs"] for r in running_sum(df, ["k"], ["t"], "v", "rs", slices=5).collect()}
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r["k"], r["t"]): r["rs"] for r in df.withColumn("rs", F.sum("v").over(w)).collect()}
    assert got == want


@settings(**SETTINGS)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=200), st.sampled_from([0.5, 0.9, 0.95, 0.99]))
def test_rank_percentile_and_median(spark, values, p):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v long")
    s = sorted(values)
    assert rank_percentile(df, ["g"], "v", p, "x").first()["x"] == s[int(len(s) * p)]
    n = len(s)
    med = s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2
    assert exact_median(df, ["g"], "v", "m").first()["m"] == med


_reasons = st.text(st.characters(codec="utf-8", exclude_categories=["Cs"], exclude_characters="`\x00"), min_size=1, max_size=12).filter(str.strip)
# what is done to an accepted verdict to make it unacceptable
_DEFECTS = [
    lambda d: json.dumps(d) + "}", lambda d: " " + json.dumps(d), lambda d: json.dumps([d]), lambda d: json.dumps(d)[:-1],
    lambda d: json.dumps({**d, "passed": True}), lambda d: json.dumps({k: v for k, v in d.items() if k != "reason"}),
    lambda d: json.dumps({**d, "score": d["score"] + 1.5}), lambda d: json.dumps({**d, "score": -0.5 - d["score"]}),
    lambda d: json.dumps({**d, "score": str(d["score"])}), lambda d: json.dumps({**d, "score": float("nan")}),
    lambda d: json.dumps({**d, "schema_version": "1.1"}), lambda d: json.dumps({**d, "reason": " "}),
    lambda d: json.dumps({**d, "reason": "r" * 2001}), lambda d: "```" + json.dumps(d) + "```"]


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.floats(0, 1), _reasons), min_size=1, max_size=4))
def test_sound_verdicts_pass_and_every_defect_fails(spark, cases):
    rows = []
    for score, reason in cases:
        sound = {"schema_version": "1.0", "score": score, "reason": reason}
        rows.append((json.dumps(sound), True))
        rows += [(defect(sound), False) for defect in _DEFECTS]
    df = spark.createDataFrame(rows, "raw string, sound boolean").select("raw", "sound", J.parse_judge_output("raw")["valid"].alias("valid"))
    assert [r["raw"] for r in df.collect() if r["valid"] != r["sound"]] == []
