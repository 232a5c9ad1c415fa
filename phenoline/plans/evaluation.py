"""Fit readouts on the training seasons and score every run at every cutoff in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoline.functions.arrays import fourier_terms
from phenoline.operators.readout import Readout, fit_readouts, predict
from phenoline.operators.scaling import apply_scalers, fit_scalers, invert_scalers
from phenoline.operators.scoring import DEFAULT_FRACTIONS, score_at_cutoffs
from phenoline.operators.split import split_exact

# Scalers over all steps, and over one row per season.
STEP_CONFIG = {c: {"kind": "minmax"} for c in ("temp_full", "countdown_first", "countdown_full")}
SITE_CONFIG = {c: {"kind": "robust", "quantile_range": (5, 95)} for c in ("lat", "lng")}
BASE_FEATURES = ("bias", "lat", "lng", "temp_full", "season_1", "season_2", "season_3")


def with_features(steps: DataFrame, period: float = 365.25) -> DataFrame:
    """Add a constant and three seasonal terms of the step."""
    terms = {f"season_{k}": fourier_terms(F.col("step"), period / k, [1.0]) for k in (1, 2, 3)}
    return steps.withColumns({"bias": F.lit(1.0), **terms})


def sweep(
    steps: DataFrame,
    alphas: Sequence[float] = (1.0, 10.0, 100.0, 1000.0),
    features: Sequence[str] = BASE_FEATURES,
    fractions: Sequence[float] = DEFAULT_FRACTIONS,
    train_share: float = 0.8,
    seed: int = 0,
    keys: Sequence[str] = ("site", "year"),
    form: str = "sequence",
    align: str = "reference",
) -> tuple[DataFrame, list[Readout]]:
    """Scores of one run per alpha, tagged ``sim_id`` 1, 2, ..., and the fitted readouts.

    ``steps`` come from ``build_season_steps``; several jobs read them, so pass a stored table. Only training
    seasons are fitted on. One pass gathers the sums for all runs, and one plan scores all runs and cutoffs.
    """
    rows = steps.filter(F.col("step") <= F.col("days_to_full"))
    train, test = split_exact(rows, keys, train_share, seed)
    scalers = fit_scalers(rows, STEP_CONFIG) | fit_scalers(rows.filter(F.col("step") == 0), SITE_CONFIG)
    targets = ("countdown_first", "countdown_full")
    models = fit_readouts(with_features(apply_scalers(train, scalers)), features, targets, alphas)

    truth = test.withColumns({"true_first": F.col(targets[0]), "true_full": F.col(targets[1])})
    inputs = with_features(apply_scalers(truth, {c: s for c, s in scalers.items() if c not in targets}))
    outputs = {targets[0]: "pred_first", targets[1]: "pred_full"}
    predicted = predict(inputs, dict(enumerate(models, start=1)), outputs)
    predicted = invert_scalers(
        predicted, {"pred_first": scalers["countdown_first"], "pred_full": scalers["countdown_full"]}
    )
    predicted = predicted.withColumn("full_length", F.col("days_to_full") + 1)
    extra = [c for c in ("copy",) if c in steps.columns]
    group = ["sim_id", *keys, *[c for c in extra if c not in keys], "first_bloom", "full_bloom"]
    scores = score_at_cutoffs(predicted, group, fractions, form, align)
    return scores.withColumnsRenamed({"first_bloom": "date_first", "full_bloom": "date_full"}), models
