"""Pair event dates, attach coordinates, and join every season to its site's daily readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoline.functions.arrays import known
from phenoline.functions.dates import parse_day_month, season_start, season_year, whole_days
from phenoline.operators.gapfill import METHODS, carried, known_so_far, neighbour_columns, with_carried, with_filled, with_spline
from phenoline.operators.layout import repeat_rows, spread

SEASON_COLUMNS = [
    "site",
    "year",
    "first_bloom",
    "full_bloom",
    "data_start_date",
    "days_to_first",
    "days_to_full",
    "bloom_offset",
    "lat",
    "lng",
]

# What decides a season: its readings up to each event, and how many of those are known.
TOTALS = ("n_first", "n_full", "known_first", "known_full")


def pair_events(first: DataFrame, full: DataFrame, unique: bool = False) -> DataFrame:
    """Inner join of two ``(site, year, date)`` tables on site and year.

    Repeated rows multiply. They are counted before the join, so a key with many copies costs one row per
    distinct date, and the result carries the product in ``copies``. ``unique=True`` promises one row per
    (site, year) on both sides and skips the counting.
    """
    keys = ["site", "year"]
    if unique:
        a = first.select(*keys, F.col("date").alias("first_bloom"))
        b = full.select(*keys, F.col("date").alias("full_bloom"))
        return a.join(b, keys).withColumn("copies", F.lit(1).cast("bigint"))
    a = first.groupBy(*keys, F.col("date").alias("first_bloom")).agg(F.count("*").alias("n_first"))
    b = full.groupBy(*keys, F.col("date").alias("full_bloom")).agg(F.count("*").alias("n_full"))
    return a.join(b, keys).withColumn("copies", F.col("n_first") * F.col("n_full")).drop("n_first", "n_full")


def sites_in_country(cities: DataFrame, country: str | None = "Japan") -> DataFrame:
    """Rows of one country (all with ``None``), projected to ``city_ascii, lat, lng``."""
    rows = cities if country is None else cities.filter(F.col("country") == country)
    return rows.select("city_ascii", "lat", "lng")


def join_coordinates(df: DataFrame, sites: DataFrame, site: str = "site", unique: bool = False) -> DataFrame:
    """Left join to the coordinates; a name listed twice doubles the rows, an unknown one gets nulls.

    Sites grow with the data, so no broadcast is asked for: Catalyst and AQE broadcast them when their
    measured size allows. Equal coordinate rows are counted first and multiply ``copies`` if there is one.
    """
    if unique or "copies" not in df.columns:
        places = sites.select(F.col("city_ascii").alias(site), "lat", "lng")
        return df.join(places, site, "left")
    places = sites.groupBy(F.col("city_ascii").alias(site), "lat", "lng").agg(F.count("*").alias("n_places"))
    joined = df.join(places, site, "left")
    return joined.withColumn("copies", F.col("copies") * F.coalesce("n_places", F.lit(1))).drop("n_places")


def repeated_sites(sites: DataFrame) -> DataFrame:
    """Names listed more than once, which double the seasons of their site, with their number of rows."""
    counts = sites.groupBy("city_ascii").agg(F.count("*").alias("n_rows"))
    return counts.filter(F.col("n_rows") > 1)


def season_windows(pairs: DataFrame, day: int, month: int) -> DataFrame:
    """Add the start date of each season, the days to both events and their offset."""
    start = season_start(F.col("year"), day, month)
    return (
        pairs.withColumn("data_start_date", start)
        .withColumn("days_to_first", whole_days(F.col("data_start_date"), F.col("first_bloom")))
        .withColumn("days_to_full", whole_days(F.col("data_start_date"), F.col("full_bloom")))
        .withColumn("bloom_offset", F.col("days_to_full") - F.col("days_to_first"))
    )


def densify_observations(obs: DataFrame) -> DataFrame:
    """Add a null reading for every date a site lacks between its first and last one.

    The axis is made per site and its blank rows are merged with the readings by an anti join on
    (site, date), so no site is gathered in one task and repeated dates stay as they are.
    """
    span = obs.groupBy("site").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    axis = spread(span).select("site", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    blank = axis.join(obs.select("site", "date").distinct(), ["site", "date"], "left_anti")
    return obs.select("site", "date", "temp").unionByName(blank.withColumn("temp", F.lit(None).cast("double")))


def with_observations(events: DataFrame, obs_sites: DataFrame) -> DataFrame:
    """Events of sites that have observations. Observations fold to distinct sites before they are shuffled."""
    return events.join(obs_sites.select("site").distinct(), "site", "left_semi")


def skipped_sites(events: DataFrame, obs_sites: DataFrame) -> DataFrame:
    """Sites that have events but no observations."""
    return events.select("site").distinct().join(obs_sites.select("site").distinct(), "site", "left_anti")


def _cover_years(seasons: DataFrame, day: int, month: int) -> DataFrame:
    """One row per season year that a season reaches into, for windows longer than a year."""
    last = F.greatest(season_year(F.col("full_bloom"), day, month), season_year(F.col("first_bloom"), day, month))
    return seasons.withColumn("season_year", F.explode(F.sequence(F.col("year"), F.greatest("year", last))))


def _in_window():
    return F.col("date").between(F.col("data_start_date"), F.greatest("first_bloom", "full_bloom"))


def _season_days(seasons: DataFrame, readings: DataFrame, one_year: bool, day: int, month: int, how: str = "inner", small: bool = False) -> DataFrame:
    """Season rows times daily readings as an equi-join on (site, season year).

    Each side is shuffled once on that key, and with ``one_year`` the later windows reuse the partitioning. Otherwise a season is
    first copied to every season year that it reaches into. ``small`` says that a task's seasons, a row for a year of days, fit in its memory,
    so that the days aren't sorted to be joined.
    """
    if not one_year:
        seasons = _cover_years(seasons, day, month)
    held = "year" if one_year else "season_year"
    days = readings.withColumnsRenamed({"site": "_site", "season_year": "_year"})
    match = (F.col("site") == F.col("_site")) & (F.col(held) == F.col("_year")) & _in_window()
    if small:
        seasons = seasons.hint("shuffle_hash")
    joined = seasons.join(days, match, how).drop("_site", "_year")
    return joined if one_year else joined.drop("season_year")


def season_totals(seasons: DataFrame, readings: DataFrame, day: int, month: int) -> DataFrame:
    """``seasons`` with ``TOTALS``, counted without multiplying seasons by readings.

    Readings fold to one count per date, however often a date is repeated, and those to one array per site and season year, of at
    most a year's dates; nothing is shuffled for it if they are placed by site and season year. A season looks its sums up in the arrays of the years that it covers.
    """
    daily = readings.groupBy("site", "season_year", "date").agg(F.count("*").alias("n"), F.count("temp").alias("known"))
    years = daily.groupBy("site", "season_year").agg(F.collect_list(F.struct("date", "n", "known")).alias("days"))
    zero = F.lit(0).cast("bigint")

    def total(event: str, what: str) -> Column:
        inside = F.filter("days", lambda d: d["date"].between(F.col("data_start_date"), F.col(event)))
        return F.coalesce(F.aggregate(inside, zero, lambda n, d: n + d[what]), zero)

    events = {"first": "first_bloom", "full": "full_bloom"}
    found = _cover_years(seasons, day, month).join(years, ["site", "season_year"], "left")
    found = found.select(*seasons.columns, *[total(events[t.split("_")[1]], t.split("_")[0]).alias(t) for t in TOTALS])
    return found.groupBy(*seasons.columns).agg(*[F.sum(t).alias(t) for t in TOTALS])


def build_season_steps(
    first: DataFrame,
    full: DataFrame,
    obs: DataFrame,
    sites: DataFrame,
    start: str = "01:08",
    min_points: int = 30,
    method: str = "linear",
    drop_na: bool = True,
    drop_invalid: bool = True,
    densify: bool = False,
    unique_keys: bool = False,
    unique_dates: bool = False,
    one_year: bool | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Daily steps of every valid season.

    ``first`` and ``full`` hold ``(site, year, date)``, ``obs`` holds ``(site, date, temp)`` and ``sites``
    ``(city_ascii, lat, lng)``. A season runs from the start day of the year before to its events. It is kept
    when both windows hold exactly days + 1 readings, at least ``min_points`` of them known; null readings
    are then filled within each window. The result has one row per season and step, up to the later event;
    ``temp_first`` and ``temp_full`` are null past their own event. ``drop_invalid=False`` keeps the other
    seasons too, with the readings they have, repeated dates included, and nulls where a window has too few known ones.

    Whoever knows it can promise ``unique_keys`` (one event row per site and year, one coordinate row per
    site), ``unique_dates`` (one reading per site and date) and ``one_year`` (all events precede the next
    season's start). Each promise saves steps of the plan, which depends on the arguments alone, never on the data. Without
    ``unique_dates`` readings are placed once, by site and season year, and counts per date decide which seasons are kept before any reading is joined, so
    a date may be repeated any number of times; seasons are then filled by the season years that they cover. Without ``unique_keys`` copies are counted and the result numbers
    equal seasons in ``copy``.

    ``partitions`` is the number of tasks among which the seasons are dealt. It should grow with the readings, so that what a task sorts
    doesn't; without it the session's setting stands, whatever the size.
    """
    if method not in METHODS:
        raise ValueError(f"unknown fill method {method!r}, choose one of {list(METHODS)}")
    by_years = not unique_dates and method != "spline"
    if not unique_dates and not drop_invalid and method == "spline":
        raise ValueError("the spline needs whole seasons in memory; with drop_invalid=False promise unique_dates")
    day, month = parse_day_month(start)

    pairs = pair_events(first, full, unique=unique_keys)
    seasons = join_coordinates(season_windows(pairs, day, month), sites, unique=unique_keys)
    if drop_invalid:
        seasons = seasons.filter((F.col("days_to_first") >= 0) & (F.col("days_to_full") >= 0))
    if drop_na:
        seasons = seasons.dropna("any")

    if densify:
        obs = densify_observations(obs)
    readings = obs.select("site", F.col("date").cast("date").alias("date"), known(F.col("temp")).alias("temp"))
    readings = readings.withColumn("season_year", season_year(F.col("date"), day, month))

    if not drop_invalid:
        seasons = with_observations(seasons, readings)
    keys = ["site", "year"] if unique_keys else ["site", "year", "first_bloom", "full_bloom", "lat", "lng"]
    if partitions and one_year:
        readings = readings.repartition(partitions, "site", "season_year")
        seasons = seasons.repartition(partitions, "site", "year")
    if unique_dates:
        small = drop_invalid and unique_keys
        rows = _season_days(seasons, readings, bool(one_year), day, month, "inner" if drop_invalid else "left", small)
        if not unique_keys:
            # Many seasons of one site and year are placed by their full key, so they don't share a task.
            rows = rows.repartition(*keys)
        rows = _with_totals(rows, keys, blanks=not drop_invalid)
    else:
        # Placed once, for the counts, the sums of the years and the rows. What a join on them asks for is asked here, or each would place its own.
        readings = readings.filter("site IS NOT NULL AND season_year IS NOT NULL")
        readings = readings.repartition(*([partitions] if partitions else []), "site", "season_year")
        seasons = season_totals(seasons, readings, day, month)
        if drop_invalid:
            seasons = seasons.filter(_valid(min_points))
    if by_years:
        steps = _filled_by_years(seasons, readings, keys, min_points, method, day, month)
    else:
        if not unique_dates:
            rows = _season_days(seasons, readings, bool(one_year), day, month).filter(_valid(min_points))
        steps = _filled(rows, keys, min_points, method, by_day=drop_invalid and unique_dates)
    if not unique_keys:
        return repeat_rows(steps, "copies", "copy").drop("copies")
    return steps.drop("copies")


def _valid(min_points: int) -> Column:
    """Both windows hold exactly days + 1 readings, and enough known ones."""
    whole = (F.col("n_first") == F.col("days_to_first") + 1) & (F.col("n_full") == F.col("days_to_full") + 1)
    return whole & (F.col("known_first") >= min_points) & (F.col("known_full") >= min_points)


def _with_totals(rows: DataFrame, keys: list[str], blanks: bool) -> DataFrame:
    """Add ``TOTALS`` of each season. With ``blanks`` there are rows without a reading: a season keeps one of them if it has no other row."""
    whole = f"(PARTITION BY {', '.join(keys)} ORDER BY date, temp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    tests = {"first": "date <= first_bloom", "full": "date <= full_bloom"}
    shown = {t: f"CASE WHEN {tests[t.split('_')[1]]} THEN {'1' if t[0] == 'n' else 'temp'} END" for t in TOTALS}
    counted = rows.withColumns({t: F.expr(f"count({x}) OVER {whole}") for t, x in shown.items()})
    if not blanks:
        return counted
    number = F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY date, temp)")
    blank = F.col("date").isNull()
    some = F.greatest("n_first", "n_full") > 0
    return counted.withColumn("_row", number).filter(~blank | (~some & (F.col("_row") == 1))).drop("_row")


def _filled(rows: DataFrame, keys: list[str], min_points: int, method: str, by_day: bool) -> DataFrame:
    """Steps and gap fill in windows over one season at a time; both windows use one partitioning and one order, so rows are sorted once.

    With ``by_day`` dates are unique and valid seasons alone are kept, which have a row for each day: steps are days, and no row is numbered.
    """
    window = f"PARTITION BY {', '.join(keys)} ORDER BY date, temp"
    ends = {"fill_first": "_last_first", "fill_full": "_last_full"}
    step = whole_days(F.col("data_start_date"), F.col("date")) if by_day else F.expr(f"CAST(row_number() OVER ({window}) - 1 AS INT)")
    placed = rows.withColumn("step", step)
    if method != "spline":
        placed = neighbour_columns(placed, window, "step", "temp", method)
    if by_day:
        placed = placed.filter(_valid(min_points))
    placed = placed.withColumns({"_last_first": F.col("n_first") - 1, "_last_full": F.col("n_full") - 1})
    if method == "spline":
        return _steps(with_spline(placed, keys, "step", "temp", ends), min_points)
    return _steps(with_filled(placed, "step", "temp", ends, method), min_points)


def _filled_by_years(seasons: DataFrame, readings: DataFrame, keys: list[str], min_points: int, method: str, day: int, month: int) -> DataFrame:
    """The same for seasons with any number of readings, which may cover several season years, from ``seasons`` with ``TOTALS``.

    Readings are put in order and look for their neighbours once, within their site and season year, whose windows spill what a task can't hold, and
    stay there. A season takes them from the years that it covers: a scan of the years' sums, a row each, gives every year its place and
    the points before and after it.
    """
    reach, year = METHODS[method], ["site", "season_year"]
    window = f"PARTITION BY {', '.join(year)} ORDER BY date, temp"
    near = readings.withColumn("_at", F.expr(f"CAST(row_number() OVER ({window}) - 1 AS BIGINT)"))
    near = neighbour_columns(near, window, "_at", "temp", method).withColumn("_upto", known_so_far(window, "temp"))
    known_, point = F.col("temp").isNotNull(), F.struct(F.col("_at"), F.col("temp").alias("val"))
    ends = near.withColumns({"_first": known_ & F.col(f"_p{reach}_pos").isNull(), "_last": known_ & F.col(f"_n{reach}_pos").isNull()})
    sums = ends.withColumn("_end", F.expr(f"lead(_at) OVER ({window}) IS NULL")).filter("_first OR _last OR _end").groupBy(*year).agg(
        (F.max("_at") + 1).alias("_n"),
        F.max("_upto").alias("_k"),
        F.array_sort(F.collect_list(F.when(F.col("_first"), point))).alias("_firsts"),
        F.array_sort(F.collect_list(F.when(F.col("_last"), point))).alias("_lasts"),
    )
    covered = _cover_years(seasons, day, month).join(sums, year, "left").withColumn("_low", F.lit(0))
    covered = carried(covered, keys, "season_year", reach).withColumnRenamed("_known", "_of_season")
    days = near.withColumnsRenamed({"site": "_site", "season_year": "_year"})
    rows = covered.join(days, (F.col("site") == F.col("_site")) & (F.col("season_year") == F.col("_year")) & _in_window(), "left")
    # A season without readings keeps one row.
    rows = rows.filter("date IS NOT NULL OR (n_first = 0 AND n_full = 0 AND season_year = year)")
    places = ["_at", *[f"_{tag}{k}_pos" for tag in ("p", "n") for k in range(1, reach + 1)]]
    rows = with_carried(rows.withColumns({c: F.col(c) + F.col("_shift") + 1 for c in places}), "temp", reach)
    # Positions count from 1 here.
    rows = rows.withColumn("_pos", F.coalesce("_at", F.lit(1)))
    near_ends = {"_last_first": F.col("n_first"), "_last_full": F.col("n_full")}
    filled = with_filled(rows.withColumns(near_ends), "_pos", "temp", {"fill_first": "_last_first", "fill_full": "_last_full"}, method)
    filled = filled.withColumns({"step": (F.col("_pos") - 1).cast("int"), "_last_first": F.col("n_first") - 1, "_last_full": F.col("n_full") - 1})
    return _steps(filled, min_points)


def _steps(filled: DataFrame, min_points: int) -> DataFrame:
    def shown(event: str) -> Column:
        inside = (F.col(f"known_{event}") >= min_points) & (F.col("step") <= F.col(f"_last_{event}"))
        return F.when(inside, F.col(f"fill_{event}")).alias(f"temp_{event}")

    return filled.select(
        *SEASON_COLUMNS,
        "copies",
        "step",
        "date",
        "temp",
        shown("first"),
        shown("full"),
        (F.col("days_to_first") - F.col("step")).alias("countdown_first"),
        (F.col("days_to_full") - F.col("step")).alias("countdown_full"),
    )
