"""Scalers that no centre and scale describe: families kept by name, with what fits them and Column builders both ways.

A fitted member is its family's name and a list of numbers, which goes into expressions as literals and into the scaler table as an
array. `register_family` adds one's own; the name must be registered again where a stored table is read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoline.operators.ranks import exact_quantiles


@dataclass(frozen=True)
class Family:
    """``fit`` gets the values (``name``, ``value``; all of one column) and the options and returns the parameters.

    ``forward`` and ``inverse`` build a column from a value column and the parameters. ``options`` are the names that ``fit`` knows.
    """

    fit: Callable[[DataFrame, Mapping], Sequence[float]]
    forward: Callable[[Column, Sequence[float]], Column]
    inverse: Callable[[Column, Sequence[float]], Column]
    options: tuple[str, ...] = ()


FAMILIES: dict[str, Family] = {}


def register_family(name: str, family: Family) -> None:
    FAMILIES[name.lower()] = family


def family(name: str) -> Family:
    if name not in FAMILIES:
        raise ValueError(f"scaler family {name!r} isn't registered, available: {sorted(FAMILIES)}")
    return FAMILIES[name]


def stepwise(value: Column, borders: Sequence[float], pieces: Sequence[Column]) -> Column:
    """``pieces[i]`` where ``i`` borders are at most the value: a binary search as nested conditions."""
    if len(pieces) == 1:
        return pieces[0]
    middle = len(pieces) // 2
    low = stepwise(value, borders[: middle - 1], pieces[:middle])
    high = stepwise(value, borders[middle:], pieces[middle:])
    return F.when(value < F.lit(borders[middle - 1]), low).otherwise(high)


def line(value: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return F.lit(y0) + (value - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))


# Quantiles: the share of values below, by a table of knots

MOST_KNOTS = 256


def _fit_quantile(values: DataFrame, options: Mapping) -> list[float]:
    n = options.get("n_quantiles", 100)
    if not 2 <= n <= MOST_KNOTS:
        raise ValueError(f"n_quantiles must be 2 to {MOST_KNOTS}, got {n}")
    name = values.select("name").first()
    if name is None:
        raise ValueError("no value to fit quantiles on")
    shares = [i / (n - 1) for i in range(n)]
    found = exact_quantiles(values, {name["name"]: shares})
    return [found[name["name"], s] for s in shares]


def _quantile_knots(parameters: Sequence[float]) -> list[tuple[float, float, float]]:
    """Different knots, each with the first and the last share that it stands for."""
    n = len(parameters)
    knots: list[tuple[float, float, float]] = []
    for i, x in enumerate(parameters):
        share = i / (n - 1)
        knots = [*knots[:-1], (x, knots[-1][1], share)] if knots and knots[-1][0] == x else [*knots, (x, share, share)]
    return knots


def _quantile_forward(value: Column, parameters: Sequence[float]) -> Column:
    """0 up to the smallest value, 1 from the largest one on; on a repeated knot the middle of its shares."""
    knots = _quantile_knots(parameters)
    if len(knots) == 1:
        return F.when(value.isNotNull(), F.when(value < F.lit(knots[0][0]), 0.0).when(value > F.lit(knots[0][0]), 1.0).otherwise(0.5))
    pieces = [F.lit(0.0)]
    for i, (x, first, last) in enumerate(knots):
        if i == len(knots) - 1:
            pieces.append(F.lit(1.0))
            break
        after = line(value, x, last, knots[i + 1][0], knots[i + 1][1])
        pieces.append(F.when(value == F.lit(x), F.lit(0.0 if i == 0 else (first + last) / 2)).otherwise(after))
    return F.when(value.isNotNull(), stepwise(value, [k[0] for k in knots], pieces))


def _quantile_inverse(value: Column, parameters: Sequence[float]) -> Column:
    n = len(parameters)
    pieces = [F.lit(float(parameters[0]))]
    for i in range(n - 1):
        pieces.append(line(value, i / (n - 1), parameters[i], (i + 1) / (n - 1), parameters[i + 1]))
    pieces.append(F.lit(float(parameters[-1])))
    return F.when(value.isNotNull(), stepwise(value, [i / (n - 1) for i in range(n)], pieces))


register_family("quantile", Family(_fit_quantile, _quantile_forward, _quantile_inverse, ("n_quantiles",)))


# Symmetric logarithm: straight near zero, logarithmic on both sides


def _fit_symlog(values: DataFrame, options: Mapping) -> list[float]:
    unit = options.get("unit")
    if unit is None:
        unit = values.agg(F.avg(F.abs("value")).alias("a")).first()["a"] or 1.0
    if not unit > 0 or math.isinf(unit):
        raise ValueError(f"unit must be positive, got {unit}")
    return [float(unit)]


def _symlog_forward(value: Column, parameters: Sequence[float]) -> Column:
    return F.signum(value) * F.log1p(F.abs(value) / F.lit(parameters[0]))


def _symlog_inverse(value: Column, parameters: Sequence[float]) -> Column:
    return F.signum(value) * F.expm1(F.abs(value)) * F.lit(parameters[0])


register_family("symlog", Family(_fit_symlog, _symlog_forward, _symlog_inverse, ("unit",)))
