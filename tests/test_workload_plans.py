"""What the queries' inputs shuffle and make, and that season rows hold the same as long rows."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from workload import queries, standins  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


def plan(df, form="executedPlan"):
    return getattr(df._jdf.queryExecution(), form)().toString()


def test_items_are_dealt_once(spark):
    assert plan(standins.observations(spark, SF_DIR)).count("REPARTITION_BY_NUM") == 1


def test_unread_predictions_are_not_made(spark):
    assert "pmod" not in plan(queries.cutoff_values(spark, SF_DIR), "optimizedPlan")
    assert "pmod" in plan(queries.score_sequence_rows(spark, SF_DIR), "optimizedPlan")


def test_seasons_are_gathered_in_as_many_tasks_as_the_items_ask_for(spark, monkeypatch):
    monkeypatch.setattr(standins, "season_tasks", lambda *_: 23, raising=False)
    assert queries.cutoff_values(spark, SF_DIR).rdd.getNumPartitions() == 23


def test_season_rows_hold_the_steps(spark):
    names = ("true_first", "true_full", "pred_first", "pred_full")
    long = queries.predicted_steps(spark, SF_DIR).select("sim_id", "site", "year", "step", *names)
    nested = queries._nested_predictions(spark, SF_DIR, queries.SIM_IDS)
    steps = nested.select("sim_id", F.col("site_name").alias("site"), "year", F.posexplode(F.arrays_zip(*names)).alias("step", "x"))
    steps = steps.select("sim_id", "site", "year", "step", *[f"x.{n}" for n in names])
    assert long.count() == steps.count() > 0
    assert long.exceptAll(steps).count() == 0
