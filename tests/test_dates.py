import datetime as dt

import pytest
from pyspark.sql import functions as F

from phenoline.functions import dates


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_parse_day_month():
    assert dates.parse_day_month("01:08") == (1, 8)
    assert dates.parse_day_month("31/12", "/") == (31, 12)
    for bad in ("00:08", "32:01", "01:13", "01:00"):
        with pytest.raises(ValueError):
            dates.parse_day_month(bad)


def test_lenient_and_strict_dates(spark):
    cells = ["2000-03-25", "2000-3-5", "", "none", "2001-02-29", "2000-03-25 10:00:00", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(dates.lenient_date("c")).collect()]
    assert got == [dt.date(2000, 3, 25), dt.date(2000, 3, 5), None, None, None, None, None]
    with pytest.raises(Exception, match="none|parse|CAST|CANNOT"):
        df.filter("c = 'none'").select(dates.strict_date("c")).collect()


def test_season_start_and_impossible_day(spark):
    assert one(spark, dates.season_start(F.lit(2000), 1, 8))[0] == dt.date(1999, 8, 1)
    with pytest.raises(Exception, match="Invalid date|DATETIME"):
        one(spark, dates.season_start(F.lit(2000), 30, 2))


def test_season_year_turns_on_the_start_day(spark):
    days = ["1999-07-31", "1999-08-01", "1999-12-31", "2000-01-01", "2000-02-29"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date")
    assert [r[0] for r in df.select(dates.season_year(F.col("d"), 1, 8)).collect()] == [1999, 2000, 2000, 2000, 2000]


def test_floored_days_round_down(spark):
    cases = {
        ("2020-01-02 00:00:00", "2020-01-01 06:00:00"): -1,
        ("2020-01-01 06:00:00", "2020-01-02 00:00:00"): 0,
        ("2020-01-01 00:00:00", "2020-01-03 00:00:00"): 2,
        ("2020-01-03 00:00:00", "2020-01-01 00:00:00"): -2,
        ("2020-01-03 00:00:00", "2020-01-02 23:59:59.999999"): -1,
    }
    for (a, b), days in cases.items():
        assert one(spark, dates.floored_days(ts(a), ts(b)))[0] == days


def test_fractional_and_whole_days(spark):
    row = one(
        spark,
        dates.add_fractional_days(ts("2000-01-01 00:00:00"), F.lit(1.25)),
        dates.add_fractional_days(ts("2000-01-01 00:00:00"), F.lit(-0.5)),
        dates.add_days(F.lit("2000-02-28").cast("date"), F.lit(2)),
        dates.whole_days(F.lit("2000-08-01").cast("date"), F.lit("2001-03-25").cast("date")),
        dates.day_of_year(F.lit("2000-12-31").cast("date")),
    )
    assert list(row) == [dt.datetime(2000, 1, 2, 6), dt.datetime(1999, 12, 31, 12), dt.date(2000, 3, 1), 236, 366]


def test_daily_axis(spark):
    day = lambda text: F.lit(text).cast("date")
    row = one(spark, dates.daily_axis(day("2000-02-28"), day("2000-03-01")), dates.daily_axis(day("2000-03-01"), day("2000-02-28")))
    assert row[0] == [dt.date(2000, 2, 28), dt.date(2000, 2, 29), dt.date(2000, 3, 1)]
    assert row[1] == []


def test_floored_days_ignore_the_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            row = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS a, timestamp_ntz'2024-03-11 02:30:00' AS b")
            assert row.select(dates.floored_days(F.col("a"), F.col("b")), dates.floored_days(F.col("b"), F.col("a"))).first()[:] == (1, -1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
