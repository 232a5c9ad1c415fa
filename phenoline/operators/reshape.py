"""Wide to long, long to nested, nested to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoline.functions.arrays import clean_number, countdown, pad_zeros, prefix
from phenoline.functions.dates import lenient_date, strict_date
from phenoline.operators.seasons import SEASON_COLUMNS


def year_columns(df: DataFrame) -> list[str]:
    """Columns whose name is all digits."""
    return [c for c in df.columns if c.isdigit()]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpivot_events(df: DataFrame, key: str, fmt: str = "yyyy-M-d") -> DataFrame:
    """Year columns of a wide event table to ``(site, year, date)``; rows without a valid date are dropped."""
    years = year_columns(df)
    cells = df.select(F.col(quoted(key)).alias("site"), *[F.col(quoted(y)).cast("string").alias(y) for y in years])
    long = cells.unpivot(["site"], [F.col(quoted(y)) for y in years], "year", "date")
    return long.select("site", F.col("year").cast("int"), lenient_date("date", fmt).alias("date")).dropna("any")


def site_columns(df: DataFrame) -> list[str]:
    """All columns but the first, which holds the date."""
    return df.columns[1:]


def site_keys(df: DataFrame) -> DataFrame:
    """The site names of a wide observation table as rows; reads the schema only."""
    names = [(c,) for c in site_columns(df)]
    return df.sparkSession.createDataFrame(names, "site string")


def unpivot_observations(df: DataFrame, fmt: str = "yyyy-M-d") -> DataFrame:
    """Site columns of a wide observation table to ``(date, site, temp)``; a bad date fails the query."""
    date, sites = df.columns[0], site_columns(df)
    is_text = dict(df.dtypes)[date] == "string"
    day = strict_date(F.col(quoted(date)), fmt) if is_text else F.col(quoted(date)).cast("date")
    cells = df.select(day.alias("date"), *[F.col(quoted(s)).cast("string").alias(s) for s in sites])
    long = cells.unpivot(["date"], [F.col(quoted(s)) for s in sites], "site", "temp")
    return long.select("date", "site", clean_number(F.col("temp")).alias("temp"))


def nest_seasons(steps: DataFrame) -> DataFrame:
    """One row per season with the four day-ordered arrays.

    A group is one season, at most as many rows as it has days, and steps that come from
    ``build_season_steps`` are already partitioned by it, so nothing is shuffled again.
    """
    extra = [c for c in ("copy",) if c in steps.columns]
    days = F.array_sort(F.collect_list(F.struct("step", "temp_first", "temp_full")))
    rows = steps.groupBy(*SEASON_COLUMNS, *extra).agg(days.alias("days"))
    to_first, to_full = F.col("days_to_first"), F.col("days_to_full")
    return rows.select(
        F.col("site").alias("site_name"),
        "year",
        *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_bloom", "full_bloom", "data_start_date")],
        "days_to_first",
        "days_to_full",
        "bloom_offset",
        countdown(to_first, -F.col("bloom_offset"), to_full).alias("countdown_to_first"),
        countdown(to_full, F.lit(0), to_full).alias("countdown_to_full"),
        F.filter("days.temp_first", lambda t: t.isNotNull()).alias("temps_to_first"),
        F.filter("days.temp_full", lambda t: t.isNotNull()).alias("temps_to_full"),
        F.col("site").alias("city_ascii"),
        "lat",
        "lng",
        *extra,
    )


def explode_steps(seasons: DataFrame, keys: Sequence[str] = ("site_name", "year")) -> DataFrame:
    """Season rows to one row per step: inputs ``lat, lng, temp`` and the two targets.

    Targets shorter than the sequence are padded with zeros.
    """
    length = F.size("temps_to_full")
    zipped = F.arrays_zip(
        F.col("temps_to_full").alias("temp"),
        pad_zeros(F.col("countdown_to_first").cast("array<double>"), length).alias("target_first"),
        pad_zeros(F.col("countdown_to_full").cast("array<double>"), length).alias("target_full"),
    )
    rows = seasons.select(*keys, "lat", "lng", F.posexplode(prefix(zipped, length)).alias("step", "day"))
    return rows.select(*keys, "step", "lat", "lng", "day.temp", "day.target_first", "day.target_full")


def explode_daily(seasons: DataFrame, keys: Sequence[str] = ("site_name", "year")) -> DataFrame:
    """Season rows to a daily series with a date column in place of the step."""
    start = F.col("data_start_date").cast("date")
    steps = explode_steps(seasons.withColumn("_start", start), [*keys, "_start"])
    return steps.select(
        *keys,
        F.date_add("_start", F.col("step")).alias("date"),
        F.col("temp").alias("temperature"),
        "lat",
        "lng",
        F.col("target_first").alias("countdown_first"),
        F.col("target_full").alias("countdown_full"),
    )


def summary_to_long(summary: DataFrame, mean: str, std: str, keys: Sequence[str] = ("sim_id",)) -> DataFrame:
    """Mean and std columns per cutoff to rows keyed ``mean_<cutoff>`` and ``std_<cutoff>``."""
    pair = F.explode(
        F.array(
            F.struct(F.concat(F.lit("mean_"), F.col("cutoff")).alias("key"), F.col(mean).alias("values")),
            F.struct(F.concat(F.lit("std_"), F.col("cutoff")).alias("key"), F.col(std).alias("values")),
        )
    )
    return summary.select(*keys, pair.alias("pair")).select(*keys, "pair.key", "pair.values")
