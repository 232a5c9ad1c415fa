import datetime as dt
import math
import random

import numpy as np
import pytest

from phenoline.functions.splines import fill_spline
from phenoline.operators import reshape, seasons
from phenoline.sources import paths
from test_gapfill import linear
from workload import standins

DAY = dt.timedelta(days=1)
START = dt.date(1999, 8, 1)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), "site string, year int, date date")


def places(spark, *rows):
    return spark.createDataFrame(list(rows) or [("A", 1.0, 2.0)], "city_ascii string, lat double, lng double")


def readings(spark, values, site="A", start=START):
    """One reading per item: a number, None for a null cell, or "gap" for no row at all."""
    rows = [(site, start + i * DAY, v) for i, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(rows, "site string, date date, temp double")


def build(spark, obs, first=None, full=None, sites=None, **options):
    first = first or events(spark, ("A", 2000, START + 9 * DAY))
    full = full or events(spark, ("A", 2000, START + 11 * DAY))
    options = {"min_points": 3, **options}
    return seasons.build_season_steps(first, full, obs, sites or places(spark), **options)


def steps_of(df):
    return [(r.step, r.temp_first, r.temp_full) for r in df.orderBy("site", "year", "lat", "copy", "step").collect()]


def test_both_windows_are_filled_separately(spark):
    values = [None, 1.0, None, 3.0] + [None] * 7 + [22.0] + [50.0]
    got = steps_of(build(spark, readings(spark, values), min_points=2))
    assert [s for s, _, _ in got] == list(range(12))
    assert [a for _, a, _ in got] == linear(values[:10]) + [None, None]
    assert [b for _, _, b in got] == linear(values[:12])


def test_dates_and_countdowns(spark):
    row = build(spark, readings(spark, [1.0] * 12)).filter("step = 4").first()
    assert (row.data_start_date, row.date) == (START, START + 4 * DAY)
    assert (row.days_to_first, row.days_to_full, row.bloom_offset) == (9, 11, 2)
    assert (row.countdown_first, row.countdown_full, row.lat, row.lng, row.copy) == (5, 7, 1.0, 2.0, 1)


def test_point_threshold(spark):
    first, full = events(spark, ("A", 2000, START + 39 * DAY)), events(spark, ("A", 2000, START + 41 * DAY))
    for known, kept in ((29, 0), (30, 42)):
        values = [1.0] * known + [None] * (42 - known)
        assert build(spark, readings(spark, values), first, full, min_points=30).count() == kept


def test_missing_date_row_drops_the_season_and_densify_keeps_it(spark):
    values = [1.0, 2.0, "gap", 4.0] + [5.0] * 8
    assert build(spark, readings(spark, values)).count() == 0
    got = steps_of(build(spark, readings(spark, values), densify=True))
    assert [b for _, _, b in got][:4] == [1.0, 2.0, 3.0, 4.0]


def test_event_before_the_start_and_all_null(spark):
    early = events(spark, ("A", 2000, START - 3 * DAY))
    assert build(spark, readings(spark, [1.0] * 12), first=early).count() == 0
    assert build(spark, readings(spark, [1.0] * 12), full=early).count() == 0
    assert build(spark, readings(spark, [None] * 12)).count() == 0


def test_full_before_first(spark):
    first, full = events(spark, ("A", 2000, START + 11 * DAY)), events(spark, ("A", 2000, START + 8 * DAY))
    steps = build(spark, readings(spark, [float(i) for i in range(12)]), first, full)
    row = reshape.nest_seasons(steps).first()
    assert row.bloom_offset == -3
    assert row.countdown_to_first == list(range(11, 2, -1)) and row.countdown_to_full == list(range(8, -1, -1))
    assert row.temps_to_first == [float(i) for i in range(12)] and row.temps_to_full == [float(i) for i in range(9)]


def test_leap_day_is_counted(spark):
    last = dt.date(2000, 3, 1)
    days = (last - START).days
    steps = build(
        spark, readings(spark, [1.0] * (days + 1)), events(spark, ("A", 2000, last)), events(spark, ("A", 2000, last))
    )
    assert steps.count() == days + 1 == 214


def test_duplicate_and_unknown_places(spark):
    obs = readings(spark, [1.0] * 12)
    two = places(spark, ("A", 1.0, 2.0), ("A", 3.0, 4.0))
    assert sorted({r.lat for r in build(spark, obs, sites=two).collect()}) == [1.0, 3.0]
    same = places(spark, ("A", 1.0, 2.0), ("A", 1.0, 2.0))
    assert sorted(build(spark, obs, sites=same).groupBy("copy").count().collect()) == [(1, 12), (2, 12)]
    other = places(spark, ("B", 1.0, 2.0))
    assert build(spark, obs, sites=other).count() == 0
    assert build(spark, obs, sites=other, drop_na=False).count() == 12


def test_repeated_sites_are_reported(spark):
    assert [tuple(r) for r in seasons.repeated_sites(places(spark, ("A", 1.0, 2.0), ("A", 1.0, 2.0), ("B", 1.0, 2.0))).collect()] == [("A", 2)]


def test_repeated_events_multiply(spark):
    first = events(spark, *[("A", 2000, START + 9 * DAY)] * 2, ("A", 2000, START + 8 * DAY))
    full = events(spark, *[("A", 2000, START + 11 * DAY)] * 3)
    pairs = seasons.pair_events(first, full)
    assert sorted((r.first_bloom.day, r.copies) for r in pairs.collect()) == [(9, 3), (10, 6)]
    steps = build(spark, readings(spark, [1.0] * 12), first, full)
    assert reshape.nest_seasons(steps).count() == 9


def test_many_seasons_of_one_year(spark):
    two = places(spark, ("A", 1.0, 2.0), ("A", 3.0, 4.0))
    for promised in (False, True):
        assert build(spark, readings(spark, [1.0] * 12), sites=two, unique_dates=promised, one_year=promised).count() == 24


def test_sites_without_observations(spark):
    first = events(spark, ("A", 2000, START + 9 * DAY), ("B", 2000, START + 9 * DAY))
    obs = readings(spark, [1.0] * 12)
    assert [r.site for r in seasons.with_observations(first, obs).collect()] == ["A"]
    assert [r.site for r in seasons.skipped_sites(first, obs).collect()] == ["B"]


def test_invalid_seasons_can_be_kept(spark):
    first = events(spark, ("A", 2000, START + 9 * DAY), ("A", 2005, dt.date(2004, 9, 1)), ("B", 2000, START + DAY))
    full = events(spark, ("A", 2000, START + 11 * DAY), ("A", 2005, dt.date(2004, 9, 2)), ("B", 2000, START + DAY))
    steps = build(spark, readings(spark, [1.0] * 11), first, full, drop_invalid=False)
    rows = {(r.site_name, r.year): r for r in reshape.nest_seasons(steps).collect()}
    assert set(rows) == {("A", 2000), ("A", 2005)}
    assert rows["A", 2005].temps_to_first == rows["A", 2005].temps_to_full == []
    assert rows["A", 2000].temps_to_full == [1.0] * 11 and len(rows["A", 2000].countdown_to_full) == 12


def test_windows_longer_than_a_year(spark):
    full = events(spark, ("A", 2000, START + 400 * DAY))
    obs = readings(spark, [float(i) for i in range(402)])
    steps = build(spark, obs, full=full)
    assert steps.count() == 401 and steps.filter("temp_full = step").count() == 401
    assert build(spark, obs, full=full, drop_invalid=False).count() == 401


def test_repeated_dates_are_exact(spark):
    """Repeats are counted, also when one stands in for a gap; seasons that they spoil can be kept."""
    whole = readings(spark, [float(i) for i in range(14)])
    doubled = whole.unionByName(readings(spark, [9.0], start=START + 5 * DAY))
    swapped = readings(spark, [0.0, 1.0, "gap"] + [float(i) for i in range(3, 14)]).unionByName(
        readings(spark, [9.0], start=START + 5 * DAY)
    )
    late = whole.unionByName(readings(spark, [7.0] * 1, start=START + 13 * DAY))
    assert steps_of(build(spark, whole)) == steps_of(build(spark, whole, unique_dates=True))
    assert build(spark, doubled).count() == 0
    assert [b for _, _, b in steps_of(build(spark, swapped))] == [0, 1, 3, 4, 5, 9, 6, 7, 8, 9, 10, 11]
    assert build(spark, late).count() == 12
    kept = steps_of(build(spark, doubled, drop_invalid=False))
    assert [b for _, _, b in kept] == [0, 1, 2, 3, 4, 5, 9, 6, 7, 8, 9, 10, 11]
    assert [a for _, a, _ in kept] == [0, 1, 2, 3, 4, 5, 9, 6, 7, 8, 9, None, None]


def test_one_date_repeated_very_often(spark):
    """More rows on a date than a year has days, none of them gathered for the decision."""
    day = spark.range(3000).selectExpr("'A' AS site", "DATE'1999-08-04' AS date", "IF(id % 7 = 0, NULL, CAST(id AS double)) AS temp")
    obs = readings(spark, [1.0] * 12).unionByName(day)
    assert build(spark, obs).count() == 0
    rows = build(spark, obs, drop_invalid=False)
    assert rows.count() == 3012
    # Null readings come first on their date, between the third reading and the first known one of the fourth date.
    got = [(r.temp, r.temp_full) for r in rows.orderBy("step").limit(500).collect()]
    blanks = [f for t, f in got if t is None]
    assert len(blanks) == 429 and blanks == pytest.approx([1.0] * 429)


def test_no_job_runs_before_the_action(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("seasons-plan", "")
    try:
        build(spark, readings(spark, [1.0] * 12))
        assert not tracker.getJobIdsForGroup("seasons-plan")
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_random_tables_with_repeats_and_invalid_seasons(spark):
    """Seasons over year borders, repeated and missing dates, kept or not, against row-by-row loops."""
    rng = random.Random(8)
    first, full, obs = [], [], []
    for site in ("A", "B", "C"):
        for year in (1999, 2000, 2001, 2005):
            a = dt.date(year - 1, 8, 1) + rng.choice([rng.randint(-2, 25), rng.randint(360, 500)]) * DAY
            first.append((site, year, a))
            full.append((site, year, a + rng.randint(-4, 9) * DAY))
        for i in range(1300):
            for _ in range(rng.choices([0, 1, 2], [1, 98, 1])[0]):
                obs.append((site, dt.date(1998, 7, 20) + i * DAY, None if rng.random() < 0.5 else round(rng.uniform(-5, 30), 1)))
    table = spark.createDataFrame(obs, "site string, date date, temp double").repartition(5)
    obs.sort(key=lambda r: (r[1], r[2] is not None, r[2] or 0))
    want = {}
    for (site, year, a), (_, _, b) in zip(first, full):
        windows = []
        for end in (a, b):
            values = [v for s, d, v in obs if s == site and dt.date(year - 1, 8, 1) <= d <= end]
            windows.append(linear(values) if sum(v is not None for v in values) >= 4 else [])
        want[site, year] = windows
    known = places(spark, ("A", 1.0, 2.0), ("B", 3.0, 4.0), ("C", 5.0, 6.0))
    steps = build(spark, table, events(spark, *first), events(spark, *full), known, min_points=4, drop_invalid=False)
    rows = reshape.nest_seasons(steps).collect()
    assert {(r.site_name, r.year) for r in rows} == set(want)
    for r in rows:
        got = [r.temps_to_first, r.temps_to_full]
        assert [len(g) for g in got] == [len(w) for w in want[r.site_name, r.year]]
        for g, w in zip(got, want[r.site_name, r.year]):
            assert g == pytest.approx(w)
    sizes = {(s, y): [(a - dt.date(y - 1, 8, 1)).days + 1, (b - dt.date(y - 1, 8, 1)).days + 1] for (s, y, a), (_, _, b) in zip(first, full)}
    valid = {k for k, w in want.items() if [len(x) for x in w] == sizes[k] and min(sizes[k]) > 0}
    kept = reshape.nest_seasons(build(spark, table, events(spark, *first), events(spark, *full), known, min_points=4)).collect()
    assert {(r.site_name, r.year) for r in kept} == valid


def test_kept_seasons_are_one_plan_that_places_readings_once(spark):
    """No job ahead of the action, no sampled ranges, no stored copy; neighbours of both methods as in windows of a season."""
    rng = random.Random(5)
    obs = readings(spark, [None if rng.random() < 0.6 else round(rng.uniform(-5, 30), 1) for _ in range(800)])
    first, full = events(spark, ("A", 2000, START + 9 * DAY), ("A", 2001, START + 700 * DAY)), events(spark, ("A", 2000, START + 460 * DAY), ("A", 2001, START + 760 * DAY))
    tracker = spark.sparkContext.statusTracker()
    for method in ("linear", "quadratic"):
        spark.sparkContext.setJobGroup(f"kept-{method}", "")
        try:
            kept = build(spark, obs, first, full, method=method, drop_invalid=False)
            assert not tracker.getJobIdsForGroup(f"kept-{method}")
        finally:
            spark.sparkContext.setJobGroup("", "")
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert "rangepartitioning" not in kept._jdf.queryExecution().executedPlan().toString() and "parquet" not in plan
        assert steps_of(kept) == steps_of(build(spark, obs, first, full, method=method, drop_invalid=False, unique_dates=True))
    assert kept.count() == 461 + 395


def test_valid_seasons_place_readings_once(spark):
    """Counts per date and filled days come from one placement by site and season year."""
    obs = readings(spark, [1.0] * 12).unionByName(readings(spark, [2.0] * 400, site="B"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = build(spark, obs)
        assert len(steps.collect()) == 12
        plan = steps._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    placed = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert len(placed) == 3 and sum("ReusedExchange" not in line for line in placed) == 1


def test_spline_seasons(spark):
    rng = random.Random(2)
    values = [None if rng.random() < 0.4 else 10 * math.sin(i / 9) + rng.uniform(-3, 3) for i in range(80)]
    first, full = events(spark, ("A", 2000, START + 69 * DAY)), events(spark, ("A", 2000, START + 79 * DAY))
    steps = build(spark, readings(spark, values), first, full, method="spline").orderBy("step").collect()
    nan = np.array([np.nan if v is None else v for v in values])
    assert [r.temp_full for r in steps] == pytest.approx(fill_spline(nan).tolist())
    assert [r.temp_first for r in steps][:70] == pytest.approx(fill_spline(nan[:70]).tolist())
    assert [r.temp_first for r in steps][70:] == [None] * 10
    with pytest.raises(ValueError):
        build(spark, readings(spark, values), method="spline", drop_invalid=False)


def brute(first, full, obs, sites, min_points):
    """Row by row, as one would on one machine."""
    out = {}
    for site, year, a in first:
        for site2, year2, b in full:
            if (site2, year2) != (site, year):
                continue
            start = dt.date(year - 1, 8, 1)
            windows = []
            for end in (a, b):
                values = [v for s, d, v in sorted(obs, key=lambda r: r[1]) if s == site and start <= d <= end]
                enough = sum(v is not None for v in values) >= min_points
                windows.append(linear(values) if enough else [])
            sizes = [(a - start).days + 1, (b - start).days + 1]
            if min(sizes) > 0 and [len(w) for w in windows] == sizes and site in sites:
                out[site, year] = windows
    return out


def test_random_tables_against_brute_force(spark):
    rng = random.Random(5)
    names = ["A", "B", "C", "D"]
    first, full, obs = [], [], []
    for site in names:
        for year in (1999, 2000, 2001):
            a = dt.date(year - 1, 8, 1) + rng.randint(-2, 25) * DAY
            first.append((site, year, a))
            full.append((site, year, a + rng.randint(-4, 9) * DAY))
            for i in range(40):
                if rng.random() > 0.01:
                    value = None if rng.random() < 0.6 else round(rng.uniform(-5, 30), 1)
                    obs.append((site, dt.date(year - 1, 8, 1) + i * DAY, value))
    sites = {"A": (1.0, 2.0), "B": (3.0, 4.0), "C": (5.0, 6.0)}
    table = spark.createDataFrame(obs, "site string, date date, temp double")
    known = places(spark, *[(s, *c) for s, c in sites.items()])
    want = brute(first, full, obs, sites, 4)
    assert 2 < len(want) < 12
    for parts in (1, 17):
        steps = build(spark, table.repartition(parts), events(spark, *first), events(spark, *full), known, min_points=4)
        got = {(r.site_name, r.year): [r.temps_to_first, r.temps_to_full] for r in reshape.nest_seasons(steps).collect()}
        assert got == want


def test_arguments(spark):
    obs = readings(spark, [1.0] * 12)
    for options in ({"start": "01:13"}, {"start": "40:01"}, {"method": "cubic"}):
        with pytest.raises(ValueError):
            build(spark, obs, **options)


def test_country_filter(spark):
    cities = spark.createDataFrame([("Japan", "A", 1.0, 2.0), ("Peru", "B", 3.0, 4.0)], "country string, city_ascii string, lat double, lng double")
    assert [r.city_ascii for r in seasons.sites_in_country(cities).collect()] == ["A"]
    assert seasons.sites_in_country(cities, None).count() == 2


def test_the_plan_shuffles_readings_once(spark):
    steps = build(spark, readings(spark, [1.0] * 12).repartition(3), unique_keys=True, unique_dates=True, one_year=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nested = reshape.nest_seasons(
            build(spark, readings(spark, [1.0] * 12), unique_keys=True, unique_dates=True, one_year=True)
        )
        plan = nested._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert steps.count() == 12
    # first, full, pairs by site, places, seasons by (site, year), readings by (site, year)
    assert plan.count("Exchange hashpartitioning") <= 6


def test_season_tasks_grow_with_the_items(spark, monkeypatch):
    """What a task sorts stays the same: the session's number of partitions doesn't bound the tasks."""
    sf = "/root/testdata/sf0.001"
    plain = {tuple(r) for r in standins.season_steps(spark, sf).collect()}
    assert standins.season_tasks(spark, sf) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(standins, "TASK_BYTES", paths.input_bytes(spark, f"{sf}/lineitem.parquet") // 21 + 1)
    assert standins.season_tasks(spark, sf) == 21
    steps = standins.season_steps(spark, sf)
    assert steps.rdd.getNumPartitions() == 21 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {tuple(r) for r in steps.collect()} == plain


def test_days_are_sorted_and_shuffled_once(spark):
    """Blank days aren't shuffled before they are joined, days aren't sorted to be joined, and valid seasons not numbered."""
    sf = "/root/testdata/sf0.001"
    plan = standins.season_steps(spark, sf)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "ShuffledHashJoin" in plan and "row_number" not in plan
    assert "Union" not in plan


def test_blank_days_stand_between_items(spark, tmp_path):
    """Days of two items, a supplier with one item, one with a row without a date."""
    day = dt.datetime(1999, 1, 30)
    items = [(1, day, 5.0), (1, day, 7.0), (1, day + 3 * DAY, 2.0), (2, day, None), (3, None, 4.0), (3, None, 6.0), (3, day, 1.0), (9, day, 1.0)]
    rows = spark.createDataFrame(items, "l_suppkey bigint, l_shipdate timestamp_ntz, l_extendedprice double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    places = [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    spark.createDataFrame(places, "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    found = sorted((tuple(r) for r in standins.observations(spark, str(tmp_path)).collect()), key=str)
    d = [(day + k * DAY).date() for k in range(4)]
    wanted = [("a", d[0], 7.0), ("a", d[1], None), ("a", d[2], None), ("a", d[3], 2.0), ("b", d[0], None), ("c", None, 6.0), ("c", d[0], 1.0)]
    assert found == sorted(wanted, key=str)
