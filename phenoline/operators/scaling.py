"""Fit, apply and invert column scalers for scalar and array columns.

Fitting returns plain numbers, a few per column, which are put into expressions as literals. Applying or
inverting is therefore a projection: no join, no UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoline.operators.families import FAMILIES, family
from phenoline.operators.ranks import exact_quantiles

# Kinds of scalers and their options.
OPTIONS = {
    "minmax": ("feature_range",),
    "standard": ("with_mean", "with_std"),
    "robust": ("quantile_range", "with_centering", "with_scaling"),
    "maxabs": (),
}
KINDS = tuple(OPTIONS)

# Default configuration (fixed values): column -> scaler and its options.
DEFAULT_CONFIG = {
    "countdown_to_first": {"kind": "minmax"},
    "countdown_to_full": {"kind": "minmax"},
    "temps_to_first": {"kind": "minmax"},
    "temps_to_full": {"kind": "minmax"},
    "lat": {"kind": "robust", "quantile_range": (5, 95)},
    "lng": {"kind": "robust", "quantile_range": (5, 95)},
}


@dataclass(frozen=True)
class Scaler:
    """``scaled = (x - center) / scale + floor``; members of a family (`families`) go by their parameters instead."""

    column: str
    kind: str
    center: float
    scale: float
    floor: float = 0.0
    parameters: tuple[float, ...] = ()


@dataclass(frozen=True)
class CustomScaler:
    """A caller's own scaler: aggregates over ``value``, and what to make of the fitted row.

    ``aggregates`` takes the value column and gives named aggregate columns; ``make`` turns the dict of
    results into ``(center, scale, floor)``.
    """

    aggregates: Callable[[Column], Mapping[str, Column]]
    make: Callable[[Mapping[str, float]], tuple[float, float, float]]


def is_array(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column].startswith("array")


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(name, value)`` of all scalars and array elements of some columns; a projection, nothing is shuffled."""

    def named(column: str) -> Column:
        if is_array(df, column):
            items = F.col(column).cast("array<double>")
            return F.transform(items, lambda v: F.struct(F.lit(column).alias("name"), v.alias("value")))
        return F.array(F.struct(F.lit(column).alias("name"), F.col(column).cast("double").alias("value")))

    parts = [named(column) for column in columns]
    empty = F.array().cast("array<struct<name:string,value:double>>")
    rows = df.select(F.explode(F.concat(*[F.coalesce(part, empty) for part in parts])).alias("pair"))
    value = F.col("pair.value")
    return rows.select("pair.name", F.when(~F.isnan(value), value).alias("value"))


def fit_scalers(df: DataFrame, config: Mapping[str, Mapping] = DEFAULT_CONFIG) -> dict[str, Scaler]:
    """Fit one scaler per configured column over all rows and, for arrays, all elements.

    Options: ``kind`` (one of ``KINDS``, a registered family or a ``CustomScaler``), ``feature_range`` for minmax (default -1 to 1),
    ``quantile_range`` in percent for robust (default 25 to 75), ``with_centering`` / ``with_scaling`` for
    robust, ``with_mean`` / ``with_std`` for standard. Minmax and maxabs of all columns share one aggregation
    without an explode, standard and custom ones share another, robust ones the quantile passes.
    """
    plans = {column: _options(options) for column, options in config.items()}
    fitted: dict[str, Scaler] = {}
    fitted.update(_fit_extremes(df, {c: o for c, o in plans.items() if o["kind"] in ("minmax", "maxabs")}))
    fitted.update(_fit_moments(df, {c: o for c, o in plans.items() if o["kind"] == "standard"}))
    fitted.update(_fit_custom(df, {c: o for c, o in plans.items() if isinstance(o["kind"], CustomScaler)}))
    fitted.update(_fit_quantiles(df, {c: o for c, o in plans.items() if o["kind"] == "robust"}))
    for column, options in plans.items():
        if isinstance(options["kind"], str) and options["kind"] in FAMILIES:
            values = long_values(df, [column]).filter(F.col("value").isNotNull())
            found = family(options["kind"]).fit(values, options)
            fitted[column] = Scaler(column, options["kind"], 0.0, 1.0, 0.0, tuple(float(p) for p in found))
    return {column: fitted[column] for column in plans}


def _options(options: Mapping) -> dict:
    kind = options.get("kind", "minmax")
    if isinstance(kind, str):
        kind = kind.lower()
        if kind not in KINDS and kind not in FAMILIES:
            raise ValueError(f"unknown scaler kind {kind!r}, available: {[*KINDS, *FAMILIES]}")
        # One set of options may serve several kinds, but a name that none knows is a mistake.
        if unknown := set(options).difference({"kind"}, *OPTIONS.values(), *[f.options for f in FAMILIES.values()]):
            own = OPTIONS[kind] if kind in OPTIONS else FAMILIES[kind].options
            raise ValueError(f"unknown scaler options {sorted(unknown)}, those of {kind!r} are {list(own)}")
    return {**options, "kind": kind}


def _nonzero(scale: float | None) -> float:
    return 1.0 if scale is None or scale == 0 else float(scale)


def _fit_extremes(df: DataFrame, plans: Mapping[str, Mapping]) -> dict[str, Scaler]:
    if not plans:
        return {}
    aggregates = []
    for i, column in enumerate(plans):
        value = F.col(column)
        if is_array(df, column):
            # NaN sorts last: it shows as the largest item, and as the smallest only where there is no other.
            top, bottom = F.array_max(value), F.array_min(value)
            numbers = F.filter(value, lambda v: ~F.isnan(v))
            high = F.when(F.isnan(top), F.array_max(numbers)).otherwise(top).cast("double")
            low = F.when(~F.isnan(bottom), bottom).cast("double")
        else:
            number = value.cast("double")
            low = high = F.when(~F.isnan(number), number)
        aggregates += [F.min(low).alias(f"lo_{i}"), F.max(high).alias(f"hi_{i}")]
    row = df.agg(*aggregates).first()
    fitted = {}
    for i, (column, options) in enumerate(plans.items()):
        low, high = row[f"lo_{i}"], row[f"hi_{i}"]
        if low is None:
            raise ValueError(f"column {column!r} has no value to fit a scaler on")
        if options["kind"] == "maxabs":
            fitted[column] = Scaler(column, "maxabs", 0.0, _nonzero(max(abs(low), abs(high))))
        else:
            bottom, top = options.get("feature_range", (-1.0, 1.0))
            if bottom >= top:
                raise ValueError(f"feature range must grow, got {(bottom, top)}")
            scale = _nonzero(high - low) / (top - bottom)
            fitted[column] = Scaler(column, "minmax", low, scale, float(bottom))
    return fitted


def _fit_moments(df: DataFrame, plans: Mapping[str, Mapping]) -> dict[str, Scaler]:
    if not plans:
        return {}
    values = long_values(df, list(plans)).groupBy("name")
    rows = values.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).collect()
    fitted = {}
    for r in rows:
        options = plans[r["name"]]
        center = r["mean"] if options.get("with_mean", True) else 0.0
        scale = _nonzero(r["std"]) if options.get("with_std", True) else 1.0
        fitted[r["name"]] = Scaler(r["name"], "standard", center, scale)
    return fitted


def _fit_custom(df: DataFrame, plans: Mapping[str, Mapping]) -> dict[str, Scaler]:
    fitted = {}
    for column, options in plans.items():
        kind = options["kind"]
        aggregates = [agg.alias(name) for name, agg in kind.aggregates(F.col("value")).items()]
        row = long_values(df, [column]).agg(*aggregates).first()
        center, scale, floor = kind.make(row.asDict())
        fitted[column] = Scaler(column, "custom", float(center), _nonzero(scale), float(floor))
    return fitted


def _fit_quantiles(df: DataFrame, plans: Mapping[str, Mapping]) -> dict[str, Scaler]:
    if not plans:
        return {}
    wanted = {}
    for column, options in plans.items():
        low, high = options.get("quantile_range", (25.0, 75.0))
        if not 0 <= low <= high <= 100:
            raise ValueError(f"invalid quantile range {(low, high)}")
        wanted[column] = (low / 100.0, 0.5, high / 100.0)
    found = exact_quantiles(long_values(df, list(plans)), wanted)
    fitted = {}
    for column, options in plans.items():
        low, middle, high = (found[column, q] for q in wanted[column])
        center = middle if options.get("with_centering", True) else 0.0
        scale = _nonzero(high - low) if options.get("with_scaling", True) else 1.0
        fitted[column] = Scaler(column, "robust", center, scale)
    return fitted


def _affine(scaler: Scaler) -> bool:
    return scaler.kind in KINDS or scaler.kind == "custom"


def scaled(value: Column, scaler: Scaler) -> Column:
    if not _affine(scaler):
        return family(scaler.kind).forward(value, scaler.parameters)
    return (value - F.lit(scaler.center)) / F.lit(scaler.scale) + F.lit(scaler.floor)


def unscaled(value: Column, scaler: Scaler) -> Column:
    if not _affine(scaler):
        return family(scaler.kind).inverse(value, scaler.parameters)
    return (value - F.lit(scaler.floor)) * F.lit(scaler.scale) + F.lit(scaler.center)


def _map_columns(df: DataFrame, scalers: Mapping[str, Scaler], formula) -> DataFrame:
    def changed(column: str, scaler: Scaler) -> Column:
        if is_array(df, column):
            return F.transform(F.col(column).cast("array<double>"), lambda v: formula(v, scaler))
        return formula(F.col(column).cast("double"), scaler)

    return df.withColumns({column: changed(column, scaler) for column, scaler in scalers.items()})


def apply_scalers(df: DataFrame, scalers: Mapping[str, Scaler]) -> DataFrame:
    """Scale each column in place; empty arrays stay empty, nulls stay null."""
    return _map_columns(df, scalers, scaled)


def invert_scalers(df: DataFrame, scalers: Mapping[str, Scaler]) -> DataFrame:
    """Undo ``apply_scalers``. Keys name the columns to invert, so predictions can borrow a target's scaler."""
    return _map_columns(df, scalers, unscaled)


SCALER_SCHEMA = "column string, kind string, center double, scale double, floor double, parameters array<double>"


def scalers_to_table(spark: SparkSession, scalers: Mapping[str, Scaler]) -> DataFrame:
    rows = [(s.column, s.kind, s.center, s.scale, s.floor, list(s.parameters)) for s in scalers.values()]
    return spark.createDataFrame(rows, SCALER_SCHEMA)


def scalers_from_table(table: DataFrame) -> dict[str, Scaler]:
    """One row per scaled column, so collecting is bounded by the table's width. Tables without parameters are read too."""
    rows = [r.asDict() for r in table.collect()]
    return {r["column"]: Scaler(**r | {"parameters": tuple(r.get("parameters") or ())}) for r in rows}
