"""Ridge readout from step features to the countdowns, fitted from sums that Spark collects in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Readout:
    """One weight per feature and target; a constant feature plays the intercept."""

    alpha: float
    features: tuple[str, ...]
    weights: Mapping[str, tuple[float, ...]]


def fit_readouts(
    steps: DataFrame, features: Sequence[str], targets: Sequence[str], alphas: Sequence[float] = (1.0,)
) -> list[Readout]:
    """Minimise ``sum (w x - y)^2 + alpha |w|^2`` for every alpha and target.

    The sums of products are gathered once for all alphas and targets together: a task sends one square of the features and
    targets, whatever the number of rows, and the squares are added up before the driver gets one. Rows with a null feature
    or target are left out.
    """
    if not features:
        raise ValueError("need at least one feature")
    names = [*features, *targets]
    size, width = len(features), len(names)
    rows = steps.select(*[F.col(n).cast("double").alias(f"c_{i}") for i, n in enumerate(names)]).dropna("any")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((size, width)), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            held += x[:, :size].T @ x
            n += len(x)
        if n:
            sums = np.append(held.ravel(), float(n))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["place", "value"])

    made = rows.mapInArrow(products, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    sums = np.zeros(size * width + 1)
    for r in made.collect():
        sums[r["place"]] = r["value"]
    if sums[-1] == 0:
        raise ValueError("no complete row to fit on")
    square = sums[:-1].reshape(size, width)
    return solve_ridge(square, features, targets, alphas)


def solve_ridge(square: np.ndarray, features: Sequence[str], targets: Sequence[str], alphas: Sequence[float]) -> list[Readout]:
    """Weights for every alpha from the sums of products of the features with themselves and then with the targets."""
    size = len(features)
    gram, cross = square[:, :size], square[:, size:]
    models = []
    for alpha in alphas:
        solved = np.linalg.lstsq(gram + alpha * np.eye(size), cross, rcond=None)[0]
        weights = {t: tuple(float(w) for w in solved[:, k]) for k, t in enumerate(targets)}
        models.append(Readout(float(alpha), tuple(features), weights))
    return models


def weighted_sum(model: Readout, target: str) -> Column:
    terms = [F.col(f).cast("double") * F.lit(w) for f, w in zip(model.features, model.weights[target])]
    return reduce(lambda a, b: a + b, terms)


def predict(steps: DataFrame, models: Mapping[int, Readout], outputs: Mapping[str, str]) -> DataFrame:
    """Add the predictions of every model, one row per model and step, tagged ``sim_id``.

    ``outputs`` names the prediction column of each target. The models are literals, so this is a generator.
    """
    made = [
        F.struct(
            F.lit(sim).alias("sim_id"), *[weighted_sum(model, t).alias(name) for t, name in outputs.items()]
        )
        for sim, model in models.items()
    ]
    rows = steps.withColumn("_made", F.explode(F.array(*made)))
    return rows.select("*", "_made.*").drop("_made")


def fit_lines(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x per group."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n")
    )
