"""Summaries of prediction errors by site, year, cutoff and run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoline.functions.dates import floored_days

# Half width of a 95% normal interval in standard errors (fixed value).
Z_95 = 1.96

STD_MODES = ("reference", "abs")


def errors_by(
    df: DataFrame, keys: Sequence[str], values: Sequence[str] = ("mae_first", "mae_full"), z: float = Z_95
) -> DataFrame:
    """Mean, sample std, count, standard error and interval of each error column per group.

    Null keys form no group. A group of one row has null std, standard error and interval.
    """
    rows = df.dropna("any", subset=list(keys))
    aggregates = []
    for v in values:
        aggregates += [
            F.avg(v).alias(f"{v}_mean"),
            F.stddev_samp(v).alias(f"{v}_std"),
            F.count(v).alias(f"{v}_count"),
        ]
    stats = rows.groupBy(*keys).agg(*aggregates)
    for v in values:
        sem = F.col(f"{v}_std") / F.sqrt(f"{v}_count")
        stats = stats.withColumns({f"{v}_sem": sem, f"{v}_ci": z * sem})
        stats = stats.withColumns(
            {
                f"{v}_lower": F.col(f"{v}_mean") - F.col(f"{v}_ci"),
                f"{v}_upper": F.col(f"{v}_mean") + F.col(f"{v}_ci"),
            }
        )
    return stats


def overall_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the sequence errors, each sequence counted once, and the average of the two means."""
    means = df.groupBy(*keys).agg(F.avg("mae_first").alias("mae_first"), F.avg("mae_full").alias("mae_full"))
    return means.withColumn("mae_average", (F.col("mae_first") + F.col("mae_full")) / 2)


def date_errors(df: DataFrame) -> DataFrame:
    """Add ``error_first`` and ``error_full``: predicted minus true date in whole days, floored."""
    moment = {
        c: F.col(c).cast("timestamp_ntz")
        for c in ("date_first", "date_full", "pred_first_bloom_date", "pred_full_bloom_date")
    }
    return df.withColumns(
        {
            "error_first": floored_days(moment["date_first"], moment["pred_first_bloom_date"]),
            "error_full": floored_days(moment["date_full"], moment["pred_full_bloom_date"]),
        }
    )


def run_summary(
    df: DataFrame, keys: Sequence[str] = ("sim_id",), cutoff: str = "cutoff", std_mode: str = "reference"
) -> DataFrame:
    """Mean and std of the date errors per run and cutoff.

    Means are of absolute errors. In the reference mode the std is of absolute errors for the first event but
    of signed errors for the full event; ``std_mode="abs"`` takes absolute errors for both.
    """
    if std_mode not in STD_MODES:
        raise ValueError(f"unknown std mode {std_mode!r}, choose one of {STD_MODES}")
    errors = date_errors(df)
    spread = F.col("error_full") if std_mode == "reference" else F.abs("error_full")
    return errors.groupBy(*keys, F.col(cutoff).cast("double").alias("cutoff")).agg(
        F.avg(F.abs("error_first")).alias("mean_first"),
        F.stddev_samp(F.abs("error_first")).alias("std_first"),
        F.avg(F.abs("error_full")).alias("mean_full"),
        F.stddev_samp(spread).alias("std_full"),
    )


def error_bands(summary: DataFrame) -> DataFrame:
    """Mean minus and plus std for both events, sorted by cutoff."""
    bands = {}
    for t in ("first", "full"):
        bands[f"low_{t}"] = F.col(f"mean_{t}") - F.col(f"std_{t}")
        bands[f"high_{t}"] = F.col(f"mean_{t}") + F.col(f"std_{t}")
    return summary.withColumns(bands).orderBy("sim_id", "cutoff")


def best_runs(summary: DataFrame, sim_ids: Sequence[int]) -> DataFrame:
    """The run with the smallest mean over cutoffs, per event; ties go to the run listed first.

    A run that has no error at one of its cutoffs never wins, as its mean is unknown. ``sim_ids`` is the caller's list, whose order decides ties.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in sim_ids]), F.col("sim_id"))
    listed = summary.filter(F.col("sim_id").isin(list(sim_ids)))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.avg(c))
    means = listed.groupBy("sim_id").agg(whole("mean_first").alias("first"), whole("mean_full").alias("full"))
    sides = F.explode(
        F.array(*[F.struct(F.lit(t).alias("event"), F.col(t).alias("mae")) for t in ("first", "full")])
    )
    long = means.select("sim_id", place.alias("place"), sides.alias("side")).select("sim_id", "place", "side.*")
    rank = F.struct("mae", "place")
    ranked = long.filter(F.col("mae").isNotNull()).groupBy("event")
    return ranked.agg(F.min("mae").alias("best_mae"), F.min_by("sim_id", rank).alias("best_sim_id"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def length_stats(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest array length."""
    return df.groupBy(*keys).agg(
        F.min(F.size(column)).alias("min_length"), F.max(F.size(column)).alias("max_length")
    )
