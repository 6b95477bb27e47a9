"""Strict judge parsing against hand-written outcomes, ensembles, statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assay.functions import judge as J
from assay.operators import judges, stats

VALID = '{"schema_version":"1.0","score":0.62,"reason":"grounded in the source"}'


def verdict(score="0.5", reason='"ok"', version='"1.0"', more=""):
    return f'{{"reason":{reason},"schema_version":{version},"score":{score}{more}}}'


# raw text -> (score, reason) of an accepted verdict, or the error code
EXPECTED = [
    (VALID, (0.62, "grounded in the source")), (verdict("0"), (0.0, "ok")), (verdict("1"), (1.0, "ok")),
    (verdict("1.0e-1"), (0.1, "ok")), (verdict("0.12345678901234567890123456789"), (0.12345678901234568, "ok")),
    (verdict(reason='"naïve ☃"'), (0.5, "naïve ☃")), (verdict(reason='"' + "q" * 2000 + '"'), (0.5, "q" * 2000)),
    (verdict(reason='"' + "q" * 2001 + '"'), "reason_too_long"), (verdict(reason='"\\t "'), "reason_blank"),
    (verdict(reason="7"), "reason_blank"), (verdict(reason="null"), "reason_blank"),
    ("", "empty"), ("\n" + VALID, "outer_whitespace"), (VALID + "\u00a0", "outer_whitespace"),
    ("```\n" + VALID + "\n```", "markdown_fence"), (VALID + VALID, "trailing_content"), (VALID + ",", "trailing_content"),
    (VALID + ' and "more"', "trailing_content"), ("Verdict " + VALID, "invalid_json"), (VALID[:-1], "invalid_json"),
    (verdict(more=',"score":0.1'), "invalid_json"), (verdict("NaN"), "invalid_json"), (verdict("-Infinity"), "invalid_json"),
    (verdict("+1"), "invalid_json"), (verdict(".5"), "invalid_json"), (verdict("01"), "invalid_json"), (verdict("0b1"), "invalid_json"),
    (verdict(reason='"tab\there"'), "invalid_json"), (verdict(more=","), "invalid_json"), ("{'score': 1}", "invalid_json"),
    ("[" + VALID + "]", "not_object"), ("17", "not_object"), ('"verdict"', "not_object"), ("true", "not_object"),
    (verdict(more=',"passed":true'), "field_set"), ('{"score":1,"reason":"ok"}', "field_set"), ("{}", "field_set"),
    ('{"Reason":"ok","schema_version":"1.0","score":1}', "field_set"),
    (verdict(version='"1"'), "schema_version"), (verdict(version="1.0"), "schema_version"),
    (verdict('"0.5"'), "score_type"), (verdict("false"), "score_type"), (verdict("null"), "score_type"), (verdict("[1]"), "score_type"),
    (verdict("-0.001"), "score_range"), (verdict("1.001"), "score_range"), (verdict("80"), "score_range"),
]


def test_native_parser_matches_contract(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(EXPECTED)], "i int, raw string")
    got = {r["i"]: r for r in df.select("i", J.parse_judge_output("raw").alias("p")).select("i", "p.*").collect()}
    for i, (raw, want) in enumerate(EXPECTED):
        if isinstance(want, str):
            assert not got[i]["valid"] and got[i]["error"] == want, (raw, got[i])
        else:
            assert got[i]["valid"] and math.isclose(got[i]["score"], want[0]) and got[i]["reason"] == want[1], (raw, got[i])


def test_a_text_is_parsed_once_however_many_rules_read_it(spark, capsys):
    from assay.operators import contracts

    df = spark.createDataFrame([("a", VALID), ("b", "{} x"), ("c", None), ("d", "\n{}"), ("e", "{}\u2028"),
                                ("f", verdict(reason='" \u3000 "'))], "subject_id string, raw string")
    judged = contracts.judge_from_raw(df, "j")
    judged.explain()
    # the wrapper, and the bare text of a row whose wrapper does not parse
    assert capsys.readouterr().out.count("parseJson") <= 2
    reasons = {r["subject_id"]: r["reason"] for r in judged.collect()}
    assert [reasons[k] for k in "bcdef"] == ["trailing_content", "not_text", "outer_whitespace", "outer_whitespace", "reason_blank"]


def test_pass_flag_and_error_codes(spark):
    rows = [(VALID,), (VALID + " trailing",), ("{bad",), ('{"schema_version":"1.0","score":0.5,"reason":"weak"}',)]
    df = spark.createDataFrame(rows, "raw string").select(J.parse_judge_output("raw").alias("p"))
    out = [(r["p"]["valid"], r["p"]["error"]) for r in df.collect()]
    assert out == [(True, None), (False, "trailing_content"), (False, "invalid_json"), (True, None)]
    passed = spark.createDataFrame([(0.8,), (0.79,)], "s double").select(J.judge_passed("s")).collect()
    assert [r[0] for r in passed] == [True, False]


def test_key_set_diff(spark):
    df = spark.createDataFrame([('{"score":1,"extra":2,"zeta":3}',)], "raw string")
    r = df.select(J.key_set_diff(J.top_level_keys("raw")).alias("d")).first()["d"]
    assert r["unknown"] == ["extra", "zeta"] and r["missing"] == ["reason", "schema_version"]


def _results(spark, rows):
    return spark.createDataFrame(rows, "subject_id string, judge_id string, passed boolean, score double")


def test_ensemble_strategies(spark):
    panel = [("essay", f"p{i}", ok, score) for i, (ok, score) in enumerate(
        [(True, 0.95), (False, 0.3), (True, 0.85), (True, 0.9), (False, 0.1)])]
    voted = judges.ensemble_consolidate(_results(spark, panel)).first()
    assert voted["passed"] and voted["disagreement_reported"] and math.isclose(voted["agreement_ratio"], 0.6)
    agreed = judges.ensemble_consolidate(_results(spark, panel), strategy="consensus").first()
    assert not agreed["passed"]
    even = [("even", "left", False, 0.25), ("even", "right", True, 0.75)]
    tied = judges.ensemble_consolidate(_results(spark, even)).first()
    assert tied["passed"] and tied["tie_broken"]
    with pytest.raises(ValueError):
        judges.ensemble_consolidate(_results(spark, panel), strategy="coin")


def test_ensemble_negative_weight_and_empty(spark):
    r = _results(spark, [("s", "solo", True, 0.7)])
    with pytest.raises(Exception, match="negative weight"):
        judges.ensemble_consolidate(r, weights={"solo": -0.5}).collect()
    subjects = spark.createDataFrame([("s",), ("empty",)], "subject_id string")
    out = {x["subject_id"]: x for x in judges.ensemble_consolidate(r, subjects).collect()}
    assert out["empty"]["passed"] is False and out["empty"]["disagreement_reported"] is True
    assert out["empty"]["final_score"] == 0.0 and out["s"]["passed"] is True


def test_summary_stats_single_value(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("b", 2.0), ("b", 4.0), ("b", 10.0)], "g string, v double")
    out = {r["g"]: r for r in stats.summary_stats(df, ["g"], "v").collect()}
    assert out["a"]["variance"] == 0.0 and out["a"]["median"] == 0.5
    assert out["b"]["median"] == 3.0 and out["b"]["mean"] == 4.25


@pytest.mark.parametrize("n", [1, 2, 20, 100])
def test_rank_percentile_floor_rule(spark, n):
    from assay.operators.metrics import rank_percentile

    vals = list(range(n, 0, -1))
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v long")
    p95 = rank_percentile(df, ["g"], "v", 0.95, "p").first()["p"]
    p50 = rank_percentile(df, ["g"], "v", 0.5, "p").first()["p"]
    s = sorted(vals)
    assert p95 == s[int(n * 0.95)] and p50 == s[n // 2]


def test_bootstrap_properties(spark):
    vals = [0.1, 0.4, 0.35, 0.8, 0.9, 0.55, 0.6, 0.2, 0.7, 0.65]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(vals)] + [("one", 0, 0.3)],
                               "g string, id long, v double")
    a = {r["g"]: r for r in stats.bootstrap_ci(df, "g", "v", "id", iterations=200).collect()}
    b = {r["g"]: r for r in stats.bootstrap_ci(df, "g", "v", "id", iterations=200).collect()}
    assert a == b  # reproducible
    assert a["g"]["ci_lower"] <= a["g"]["mean"] <= a["g"]["ci_upper"] and a["g"]["warning"] == ""
    assert a["one"]["ci_lower"] == a["one"]["ci_upper"] == 0.3 and "Small sample size (1 < 10)" in a["one"]["warning"]
    p = {r["g"]: r for r in stats.bootstrap_ci(df, "g", "v", "id", iterations=200, mode="poisson").collect()}
    assert p["g"]["ci_lower"] <= p["g"]["mean"] <= p["g"]["ci_upper"]


def test_quantile_index():
    assert stats.quantile_index(0.95, 1000) == (25, 975)
    assert stats.quantile_index(0.90, 1000) == (49, 950)


def test_pairwise_delta(spark):
    df = spark.createDataFrame([("a", i, 1.0 + i % 3) for i in range(12)] + [("b", i, 0.5) for i in range(12)],
                               "g string, id long, v double")
    r = stats.pairwise_delta_ci(df, "g", "v", "id", "a", "b", iterations=100).first()
    assert r["ci_lower"] <= r["delta_mean"] <= r["ci_upper"] and math.isclose(r["delta_mean"], 1.5)


def test_multinomial_resamples_have_the_right_moments(spark):
    import statistics

    rng = random.Random(12)
    groups = {"two": [0.0] * 900 + [1.0] * 100, "rare": [5.0] + [0.0] * 1999, "many": [rng.random() ** 3 for _ in range(1500)], "few": [1.0, 2.0, 4.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {}
    for r in stats.bootstrap_means(df, "g", "v", iterations=400).collect():
        found.setdefault(r["_g"], []).append(r["_mean"])
    for g, vs in groups.items():
        own, n = found[g], len(vs)
        assert len(own) == 400
        error = statistics.pstdev(vs) / n ** 0.5
        assert abs(statistics.mean(own) - statistics.mean(vs)) < 4 * error / 400 ** 0.5
        assert 0.85 < statistics.pstdev(own) / error < 1.15
        assert min(vs) <= min(own) and max(own) <= max(vs)
    # whole draws: the rare value is drawn a whole number of times, about e**-1 of the time never
    times = [round(m * 2000 / 5.0, 6) for m in found["rare"]]
    assert all(t == int(t) for t in times) and 0.28 < times.count(0.0) / 400 < 0.46
