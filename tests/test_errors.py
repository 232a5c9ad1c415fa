import datetime as dt
import statistics as st

import pytest

from phenoline.operators import errors
from phenoline.plans.comparison import compare_runs


def test_errors_by(spark):
    rows = [("A", 1.0, 2.0), ("A", 3.0, None), ("A", 8.0, 4.0), ("B", 5.0, 6.0), (None, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "site string, mae_first double, mae_full double")
    got = {r.site: r for r in errors.errors_by(df, ["site"]).collect()}
    assert set(got) == {"A", "B"}
    a = got["A"]
    std = st.stdev([1, 3, 8])
    assert (a.mae_first_mean, a.mae_first_count, a.mae_full_count) == (4.0, 3, 2)
    assert a.mae_first_std == pytest.approx(std) and a.mae_first_sem == pytest.approx(std / 3**0.5)
    assert a.mae_first_upper - a.mae_first_lower == pytest.approx(2 * 1.96 * std / 3**0.5)
    assert got["B"].mae_first_std is got["B"].mae_first_sem is got["B"].mae_first_ci is None


def test_overall_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "mae_first double, mae_full double")
    assert tuple(errors.overall_metrics(df).first()) == (2.0, 4.0, 3.0)


def predictions(spark, *rows):
    """(sim_id, fraction, hours off for first, hours off for full)"""
    true = dt.datetime(2000, 4, 1)
    made = [(s, f, true, true, true + dt.timedelta(hours=a), true + dt.timedelta(hours=b)) for s, f, a, b in rows]
    schema = (
        "sim_id int, fraction double, date_first timestamp_ntz, date_full timestamp_ntz, "
        "pred_first_bloom_date timestamp_ntz, pred_full_bloom_date timestamp_ntz"
    )
    return spark.createDataFrame(made, schema)


def test_run_summary_floors_and_is_asymmetric(spark):
    df = predictions(spark, (1, 0.5, -18, -18), (1, 0.5, 18, 30), (1, 0.5, 50, 50))
    # errors in days: first -1, 0, 2 and full -1, 1, 2
    r = errors.run_summary(df, cutoff="fraction").first()
    assert r.mean_first == 1.0 and r.std_first == pytest.approx(st.stdev([1, 0, 2]))
    assert r.mean_full == pytest.approx(4 / 3) and r.std_full == pytest.approx(st.stdev([-1, 1, 2]))
    absolute = errors.run_summary(df, cutoff="fraction", std_mode="abs").first()
    assert absolute.std_full == pytest.approx(st.stdev([1, 1, 2]))
    with pytest.raises(ValueError):
        errors.run_summary(df, std_mode="signed")


def test_best_run_ties_go_to_the_first_listed(spark):
    df = predictions(
        spark, (1, 0.5, 48, 72), (1, 0.9, 24, 24), (2, 0.5, 24, 24), (2, 0.9, 48, 24), (3, 0.5, 0, 0), (3, 0.9, 0, 0)
    )
    pick = lambda ids: {r.event: (r.best_sim_id, r.best_mae) for r in compare_runs(df, ids)[1].collect()}
    assert pick([1, 2]) == {"first": (1, 1.5), "full": (2, 1.0)}
    assert pick([2, 1, 9]) == {"first": (2, 1.5), "full": (2, 1.0)}
    assert pick([1, 2, 3])["first"] == (3, 0.0)


def test_bands_are_sorted_by_number(spark):
    df = predictions(spark, *[(1, f, h, h) for f in (0.5, 0.95, 0.825) for h in (24, 72)])
    rows = errors.error_bands(errors.run_summary(df, cutoff="fraction")).collect()
    assert [r.cutoff for r in rows] == [0.5, 0.825, 0.95]
    assert rows[0].high_first - rows[0].low_first == pytest.approx(2 * st.stdev([1, 3]))


def test_lengths_and_distinct(spark):
    df = spark.createDataFrame([("b", [1, 2]), ("a", []), ("a", [1])], "k string, a array<int>")
    assert tuple(errors.length_stats(df, "a").first()) == (0, 2)
    assert [r.k for r in errors.distinct_sorted(df, "k").collect()] == ["a", "b"]


def test_best_run_needs_every_cutoff(spark):
    rows = [(1, 0.5, None, 1.0), (1, 0.9, 1.0, 1.0), (2, 0.5, 5.0, 9.0), (2, 0.9, 5.0, 9.0)]
    summary = spark.createDataFrame(rows, "sim_id int, cutoff double, mean_first double, mean_full double")
    best = {r["event"]: (r["best_sim_id"], r["best_mae"]) for r in errors.best_runs(summary, [1, 2]).collect()}
    assert best == {"first": (2, 5.0), "full": (1, 1.0)}
