import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from phenoline.operators.reshape import explode_daily
from phenoline.plans.comparison import compare_runs
from phenoline.plans.evaluation import sweep
from phenoline.plans.training import load_seasons, season_table
from phenoline.sources.wide import read_cities, read_wide_csv

SITES, YEARS = ["Akita", "Kobe", "Nara", "Oita"], range(2001, 2006)


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("inputs")
    days = [dt.date(2000, 8, 1) + dt.timedelta(days=i) for i in range((dt.date(2005, 5, 1) - dt.date(2000, 8, 1)).days)]

    def temp(s, d):
        return "" if (d.toordinal() + s) % 5 == 0 else f"{15 - 10 * math.cos(d.timetuple().tm_yday / 58) + s:.1f}"

    lines = ["Date," + ",".join(SITES)] + [f"{d}," + ",".join(temp(s, d) for s in range(4)) for d in days]
    (folder / "temps.csv").write_text("\n".join(lines) + "\n")
    for name, shift in (("first", 0), ("full", 7)):
        lines = ["Site Name,Currently Being Observed," + ",".join(map(str, YEARS)) + ",Notes"]
        for s, site in enumerate([*SITES, "Elsewhere"]):
            dates = [str(dt.date(y, 3, 20) + dt.timedelta(days=s + shift)) for y in YEARS]
            lines.append(f"{site},yes," + ",".join(dates) + ",")
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    lines = ["city_ascii,country,lat,lng"] + [f"{s},Japan,{30 + i},{130 + i}" for i, s in enumerate(SITES)]
    (folder / "cities.csv").write_text("\n".join([*lines, "Lima,Peru,1,2"]) + "\n")
    return {n: str(folder / f"{n}.csv") for n in ("first", "full", "temps", "cities")}


def test_training_table_end_to_end(spark, inputs, tmp_path):
    args = (str(tmp_path / "t"), inputs["first"], inputs["full"], inputs["temps"], inputs["cities"])
    rows, scalers = load_seasons(spark, *args)
    assert rows.count() == 20 and set(scalers) == {
        "countdown_to_first", "countdown_to_full", "temps_to_first", "temps_to_full", "lat", "lng",
    }
    assert rows.columns == [
        "site_name", "year", "first_bloom", "full_bloom", "data_start_date", "days_to_first", "days_to_full",
        "bloom_offset", "countdown_to_first", "countdown_to_full", "temps_to_first", "temps_to_full", "city_ascii",
        "lat", "lng", "copy",
    ]
    bounds = rows.agg(F.min(F.array_min("countdown_to_full")), F.max(F.array_max("temps_to_full"))).first()
    assert tuple(bounds) == pytest.approx((-1.0, 1.0))
    assert rows.filter("size(temps_to_full) != days_to_full + 1 OR size(temps_to_first) != days_to_first + 1").count() == 0
    assert load_seasons(spark, *args)[0].count() == 20


def test_training_table_of_more_sites_than_a_csv_schema_holds(spark, inputs, tmp_path):
    """The readings have a column a site; the CSV reader stops at 20,480. A line may also end before its last cells."""
    n = 20_600
    lines = open(inputs["temps"]).read().splitlines()
    head = "Date," + ",".join(f"s{i}" for i in range(n)) + "," + lines[0].partition(",")[2]
    wide = [head, *["{},{}{}".format(day, "," * n, cells) for day, _, cells in (x.partition(",") for x in lines[1:])]]
    # Oita's cell, the last one, is missing and not just blank on some lines.
    wide = [x.rstrip(",") if i % 50 == 7 else x for i, x in enumerate(wide)]
    (tmp_path / "temps.csv").write_text("\n".join([wide[0], *[x for x in wide[1:] if x < "2002-04-15"]]) + "\n")
    rows, _ = load_seasons(spark, str(tmp_path / "t"), inputs["first"], inputs["full"], str(tmp_path / "temps.csv"), inputs["cities"], scale=False)
    assert {(r.site_name, r.year) for r in rows.collect()} == {(s, y) for s in SITES for y in (2001, 2002)}


def test_sweep_learns_and_is_compared(spark, inputs):
    from phenoline.operators.reshape import unpivot_events, unpivot_observations
    from phenoline.operators.seasons import build_season_steps, sites_in_country
    from phenoline.sources.paths import stored

    steps = stored(
        build_season_steps(
            unpivot_events(read_wide_csv(spark, inputs["first"]), "Site Name"),
            unpivot_events(read_wide_csv(spark, inputs["full"]), "Site Name"),
            unpivot_observations(read_wide_csv(spark, inputs["temps"])),
            sites_in_country(read_cities(spark, inputs["cities"])),
        )
    )
    scores, models = sweep(steps, alphas=[1.0, 1e6], fractions=[0.5, 0.9], seed=1)
    rows = scores.collect()
    assert len(rows) == 2 * 2 * 4 and len(models) == 2
    assert len({(r.site, r.year) for r in rows}) == 4
    good = max(r.mae_full for r in rows if r.sim_id == 1)
    assert good < 10 < min(r.mae_full for r in rows if r.sim_id == 2)
    _, best = compare_runs(scores, [2, 1])
    assert {r.event: r.best_sim_id for r in best.collect()} == {"first": 1, "full": 1}


def test_unscaled_seasons_explode_to_days(spark, inputs):
    seasons = season_table(
        read_wide_csv(spark, inputs["first"]),
        read_wide_csv(spark, inputs["full"]),
        read_wide_csv(spark, inputs["temps"]),
        read_cities(spark, inputs["cities"]),
        start="01:09",
    )
    daily = explode_daily(seasons)
    last = daily.groupBy("site_name", "year").agg(F.max("date").alias("date"), F.min("date").alias("start"))
    row = last.filter("site_name = 'Kobe' AND year = 2003").first()
    assert (row.start, row.date) == (dt.date(2002, 9, 1), dt.date(2003, 3, 28))
