"""From the four input tables to scaled seasons on disk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from phenoline.operators.reshape import nest_seasons, unpivot_events, unpivot_observations
from phenoline.operators.scaling import DEFAULT_CONFIG, Scaler, apply_scalers, fit_scalers
from phenoline.operators.seasons import build_season_steps, sites_in_country
from phenoline.operators.split import split_exact
from phenoline.sources.commits import cache_key
from phenoline.sources.paths import free_shuffles, stored
from phenoline.sources.store import load_or_create
from phenoline.sources.wide import read_cities, read_wide_csv, read_wide_observations

DEFAULT_START = "01:08"
FIT_ON = ("all", "train")


def season_table(
    first_wide: DataFrame,
    full_wide: DataFrame,
    obs_wide: DataFrame,
    cities: DataFrame,
    key: str = "Site Name",
    country: str | None = "Japan",
    **options,
) -> DataFrame:
    """Season rows from wide tables. ``options`` go to ``build_season_steps``."""
    return _season_rows(first_wide, full_wide, unpivot_observations(obs_wide), cities, key, country, **options)


def _season_rows(
    first_wide: DataFrame, full_wide: DataFrame, obs: DataFrame, cities: DataFrame, key: str = "Site Name", country: str | None = "Japan", **options
) -> DataFrame:
    steps = build_season_steps(unpivot_events(first_wide, key), unpivot_events(full_wide, key), obs, sites_in_country(cities, country), **options)
    return nest_seasons(steps)


def scale_seasons(
    seasons: DataFrame,
    config: Mapping[str, Mapping] = DEFAULT_CONFIG,
    fit_on: str = "all",
    fraction: float = 0.8,
    seed: int = 0,
) -> tuple[DataFrame, dict[str, Scaler]]:
    """Scaled rows and their scalers, fitted on all rows or on the training part only.

    Fitting reads the rows several times, so they are stored first.
    """
    if fit_on not in FIT_ON:
        raise ValueError(f"fit_on must be one of {FIT_ON}, got {fit_on!r}")
    rows = stored(seasons, "zstd")
    free_shuffles(rows.sparkSession)
    basis = rows if fit_on == "all" else split_exact(rows, ["site_name", "year"], fraction, seed)[0]
    scalers = fit_scalers(basis, config)
    return apply_scalers(rows, scalers), scalers


def load_seasons(
    spark: SparkSession,
    path: str,
    first_csv: str,
    full_csv: str,
    obs_csv: str,
    cities_csv: str,
    start: str = DEFAULT_START,
    scale: bool = True,
    **options,
) -> tuple[DataFrame, dict[str, Scaler]]:
    """The scaled season table at ``path``, built from the CSV files if it isn't there or was built from other files or options.

    Files count as others when their names, sizes or times differ. The readings have a column for each site, so they are read by line, whatever
    the number of sites.
    """

    def create():
        seasons = _season_rows(
            read_wide_csv(spark, first_csv),
            read_wide_csv(spark, full_csv),
            read_wide_observations(spark, obs_csv),
            read_cities(spark, cities_csv),
            start=start,
            **options,
        )
        return scale_seasons(seasons) if scale else (seasons, {})

    inputs = (first_csv, full_csv, obs_csv, cities_csv)
    return load_or_create(spark, path, create, cache_key(spark, inputs, {**options, "start": start, "scale": scale}))
