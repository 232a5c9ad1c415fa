"""Seasonal event analytics on Spark: DataFrame functions from wide input tables to run comparisons."""

from phenoline.operators.calendar import latest_day_of_year
from phenoline.operators.errors import (
    best_runs,
    date_errors,
    error_bands,
    errors_by,
    length_stats,
    overall_metrics,
    run_summary,
)
from phenoline.operators.families import Family, register_family
from phenoline.operators.gapfill import fill_gaps, fill_series
from phenoline.operators.lags import fit_lag_readouts, lag_products, predict_from_lags
from phenoline.operators.overlap import key_counts, key_overlap, shared_keys
from phenoline.operators.readout import Readout, fit_lines, fit_readouts, predict
from phenoline.operators.reshape import (
    explode_daily,
    explode_steps,
    nest_seasons,
    site_keys,
    summary_to_long,
    unpivot_events,
    unpivot_observations,
)
from phenoline.operators.scaling import CustomScaler, Scaler, apply_scalers, fit_scalers, invert_scalers
from phenoline.operators.scoring import (
    point_rows,
    predict_rows,
    predict_sequences,
    score_at_cutoffs,
    score_sequences,
    step_errors,
    step_mse,
    with_cutoffs,
)
from phenoline.operators.seasons import (
    build_season_steps,
    densify_observations,
    pair_events,
    repeated_sites,
    sites_in_country,
    skipped_sites,
    with_observations,
)
from phenoline.operators.split import split_exact
from phenoline.operators.windows import lag_windows
from phenoline.plans.comparison import compare_runs
from phenoline.plans.evaluation import sweep
from phenoline.plans.training import load_seasons, scale_seasons, season_table
from phenoline.sources.runs import finished_runs, read_finished_runs, read_run_folders, read_runs, write_run, write_runs
from phenoline.sources.sheets import read_sheets
from phenoline.sources.store import load_or_create, read_seasons, write_seasons
from phenoline.sources.wide import column_keys, melt_wide_csv, read_cities, read_wide_csv, read_wide_observations

__all__ = [
    "CustomScaler",
    "Family",
    "Readout",
    "Scaler",
    "apply_scalers",
    "best_runs",
    "build_season_steps",
    "column_keys",
    "compare_runs",
    "date_errors",
    "densify_observations",
    "error_bands",
    "errors_by",
    "explode_daily",
    "explode_steps",
    "fill_gaps",
    "fill_series",
    "finished_runs",
    "fit_lag_readouts",
    "fit_lines",
    "fit_readouts",
    "fit_scalers",
    "invert_scalers",
    "key_counts",
    "key_overlap",
    "lag_products",
    "lag_windows",
    "latest_day_of_year",
    "length_stats",
    "load_or_create",
    "load_seasons",
    "melt_wide_csv",
    "nest_seasons",
    "overall_metrics",
    "pair_events",
    "point_rows",
    "predict",
    "predict_from_lags",
    "predict_rows",
    "predict_sequences",
    "read_cities",
    "read_finished_runs",
    "read_run_folders",
    "read_runs",
    "read_seasons",
    "read_sheets",
    "read_wide_csv",
    "read_wide_observations",
    "register_family",
    "repeated_sites",
    "run_summary",
    "scale_seasons",
    "score_at_cutoffs",
    "score_sequences",
    "season_table",
    "shared_keys",
    "site_keys",
    "sites_in_country",
    "skipped_sites",
    "split_exact",
    "step_errors",
    "step_mse",
    "summary_to_long",
    "sweep",
    "unpivot_events",
    "unpivot_observations",
    "with_cutoffs",
    "with_observations",
    "write_run",
    "write_runs",
    "write_seasons",
]
