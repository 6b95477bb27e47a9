"""The checkpointed run report agrees with the direct queries."""

import __spark_entry__ as E
from assay.plans.fixtures import Fixtures
from assay.plans.report import run_report

SF = "/root/testdata/sf0.001"


def test_run_report_matches_direct_queries(spark):
    fx = Fixtures(spark, SF)
    rep = run_report(fx.executions, fx.scores, fx.metric_rules)
    qs = E.queries()
    lb = sorted(tuple(r) for r in rep["leaderboard"].collect())
    assert lb == sorted(tuple(r) for r in qs["leaderboard_quality"](spark, SF).collect())
    cols = ["run_id", "pass_count", "fail_count", "warn_count", "total_verdicts", "pass_rate_pct"]
    got = sorted(tuple(r) for r in rep["kpis"].select(cols).collect())
    want = sorted(tuple(r) for r in qs["run_kpis"](spark, SF).select(cols).collect())
    assert got == want
