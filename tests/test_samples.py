"""Resampling queries take the whole table."""

from floeworks.plans import reviews
from floeworks.plans.adapters import adapt


def test_all_ok_runs_are_samples(spark, sf_dir):
    runs = adapt(spark, sf_dir, "bench").where("status = 'ok'")
    assert reviews.samples(spark, sf_dir).count() == runs.count()
    n = {r["planner"]: r["count"] for r in runs.groupBy("planner").count().collect()}
    assert {r["key"]: r["n"] for r in reviews.intervals(spark, sf_dir).collect()} == n
