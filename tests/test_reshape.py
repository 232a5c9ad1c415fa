import datetime as dt

import pytest

from phenoline.operators import reshape


def test_year_and_site_columns(spark):
    df = spark.createDataFrame([("A", "x", "2000-03-01")], "`Site Name` string, Notes string, `2000` string")
    assert reshape.year_columns(df) == ["2000"]
    obs = spark.createDataFrame([("2000-01-01", "1", "2")], "Date string, A string, `B.1` string")
    assert [r.site for r in reshape.site_keys(obs).collect()] == ["A", "B.1"]


def test_unpivot_events(spark):
    df = spark.createDataFrame(
        [("A", "yes", "2000-03-01", "", "n"), ("B", None, "none", "2001-4-5", "n"), (None, "x", "2000-03-02", None, "n")],
        "`Site Name` string, `Currently Being Observed` string, `2000` string, `2001` string, Notes string",
    )
    got = sorted(map(tuple, reshape.unpivot_events(df, "Site Name").collect()))
    assert got == [("A", 2000, dt.date(2000, 3, 1)), ("B", 2001, dt.date(2001, 4, 5))]


def test_unpivot_observations(spark):
    df = spark.createDataFrame(
        [("2000-01-01", "1.5", "missing"), ("2000-01-02", "", "2")], "Date string, A string, `B.1` string"
    )
    day = lambda n: dt.date(2000, 1, n)
    got = sorted(map(tuple, reshape.unpivot_observations(df).collect()), key=lambda r: (r[1], r[0]))
    assert got == [(day(1), "A", 1.5), (day(2), "A", None), (day(1), "B.1", None), (day(2), "B.1", 2.0)]
    bad = spark.createDataFrame([("soon", "1")], "Date string, A string")
    with pytest.raises(Exception, match="soon|CANNOT_PARSE|CAST"):
        reshape.unpivot_observations(bad).collect()


def season(spark, first, full, temps):
    schema = (
        "site_name string, year int, data_start_date timestamp_ntz, countdown_to_first array<int>, "
        "countdown_to_full array<int>, temps_to_full array<double>, lat double, lng double"
    )
    return spark.createDataFrame([("A", 2000, dt.datetime(1999, 8, 1), first, full, temps, 1.0, 2.0)], schema)


def test_explode_pads_short_targets(spark):
    df = season(spark, [1, 0], [2, 1, 0], [5.0, 6.0, 7.0])
    got = [(r.step, r.temp, r.target_first, r.target_full) for r in reshape.explode_steps(df).orderBy("step").collect()]
    assert got == [(0, 5.0, 1.0, 2.0), (1, 6.0, 0.0, 1.0), (2, 7.0, 0.0, 0.0)]
    daily = reshape.explode_daily(df).orderBy("date").collect()
    assert [r.date for r in daily] == [dt.date(1999, 8, 1), dt.date(1999, 8, 2), dt.date(1999, 8, 3)]
    assert reshape.explode_steps(season(spark, [], [], [])).count() == 0


def test_summary_to_long(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0, None), (1, 0.825, 3.0, 1.0)], "sim_id int, cutoff double, m double, s double")
    got = {(r["key"], r["values"]) for r in reshape.summary_to_long(df, "m", "s").collect()}
    assert got == {("mean_0.5", 2.0), ("std_0.5", None), ("mean_0.825", 3.0), ("std_0.825", 1.0)}
