"""Score predicted countdowns of sequences cut at many points."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phenoline.functions.arrays import cutoff_length, item_at, last_item, prefix, prefix_sums
from phenoline.functions.dates import add_days, add_fractional_days

if TYPE_CHECKING:
    import pandas as pd

# Default shares of a sequence that are shown to the model (fixed values).
DEFAULT_FRACTIONS = (
    0.5, 0.6, 0.7, 0.75, 0.8, 0.825, 0.85, 0.875, 0.9, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99,
)

FORMS = ("sequence", "point")
ALIGNMENTS = ("reference", "exact")


def _check(form: str, align: str) -> None:
    if form not in FORMS:
        raise ValueError(f"unknown form {form!r}, choose one of {FORMS}")
    if align not in ALIGNMENTS:
        raise ValueError(f"unknown alignment {align!r}, choose one of {ALIGNMENTS}")


def with_cutoffs(seasons: DataFrame, fractions: Sequence[float] = DEFAULT_FRACTIONS) -> DataFrame:
    """Every row once per cutoff: ``fraction`` and ``cutoff``, the number of steps shown.

    The fractions are a literal list, so this is a generator and not a join. Needs ``full_length``.
    """
    shares = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    rows = seasons.withColumn("fraction", shares)
    return rows.withColumn("cutoff", cutoff_length(F.col("full_length"), F.col("fraction")))


def predicted_date(start, cutoff, prediction, align: str = "reference"):
    """Start plus the days shown plus the last predicted countdown.

    A countdown at 0-based index t counts from day t, so the exact date adds ``cutoff - 1``. The reference
    form adds ``cutoff``, one day more.
    """
    shown = cutoff if align == "reference" else cutoff - 1
    return add_fractional_days(add_days(start, shown).cast("timestamp_ntz"), prediction)


def score_at_cutoffs(
    steps: DataFrame,
    keys: Sequence[str],
    fractions: Sequence[float] = DEFAULT_FRACTIONS,
    form: str = "sequence",
    align: str = "reference",
) -> DataFrame:
    """Errors and predicted dates of each sequence at each cutoff, from long rows.

    ``steps`` holds one row per key and step with ``step``, ``full_length`` (the same for all rows of a key),
    ``data_start_date`` and ``true_first, true_full, pred_first, pred_full``. The sequence form averages
    |pred - true| over the steps shown; the point form compares the last step shown with the truth at the
    cutoff (``align="reference"``) or at the same step (``"exact"``).

    Rows are not copied per cutoff. The cutoffs divide a sequence into segments; each segment is folded to
    one row by a partial aggregation, and running sums over those few rows give each cutoff its prefix.
    """
    _check(form, align)
    shares = sorted(float(f) for f in fractions)
    cuts = [cutoff_length(F.col("full_length"), f) for f in shares]
    segment = F.lit(0)
    for cut in cuts:
        segment = segment + (F.col("step") >= cut).cast("int")
    group = [*keys, "data_start_date", "full_length"]
    folded = (
        steps.filter(F.col("step") < F.col("full_length"))
        .groupBy(*group, segment.alias("segment"))
        .agg(
            F.sum(F.abs(F.col("pred_first") - F.col("true_first"))).alias("sum_first"),
            F.sum(F.abs(F.col("pred_full") - F.col("true_full"))).alias("sum_full"),
            F.count("*").alias("n"),
            F.max("step").alias("last_step"),
            F.min("step").alias("first_step"),
            *[F.max_by(c, "step").alias(f"last_{c}") for c in ("pred_first", "pred_full", "true_first", "true_full")],
            *[F.min_by(c, "step").alias(f"next_{c}") for c in ("true_first", "true_full")],
        )
    )
    # Sums up to each segment that holds steps. It and the next such segment frame the cutoffs that lie between them.
    ordered = Window.partitionBy(*group).orderBy("segment")
    so_far = {c: F.sum(c).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) for c in ("sum_first", "sum_full", "n")}
    coming = {f"next_{t}": F.lead(f"next_true_{t}").over(ordered) for t in ("first", "full")}
    framed = folded.withColumns({**so_far, **coming, "_next": F.lead("segment").over(ordered), "_row": F.row_number().over(ordered)})
    shown = {"pred_first": "last_pred_first", "pred_full": "last_pred_full", "shown_first": "last_true_first", "shown_full": "last_true_full"}
    found = F.struct(*[c for c in so_far], *[F.col(old).alias(new) for new, old in shown.items()], *coming)
    before = F.struct(
        *[F.lit(None).cast(folded.schema[c].dataType).alias(c) for c in so_far],
        *[F.lit(None).cast(folded.schema[old].dataType).alias(new) for new, old in shown.items()],
        *[F.col(f"next_true_{t}").alias(f"next_{t}") for t in ("first", "full")],
    )
    inside, until = F.array(*[F.lit(f) for f in shares]), F.coalesce("_next", F.lit(len(shares)))
    # Cutoffs ahead of the first step show nothing.
    empty = F.when(F.col("_row") == 1, F.transform(F.slice(inside, F.lit(1), F.col("segment")), lambda f: F.struct(f.alias("fraction"), before.alias("x"))))
    held = F.transform(F.slice(inside, F.col("segment") + 1, until - F.col("segment")), lambda f: F.struct(f.alias("fraction"), found.alias("x")))
    cuts = F.concat(F.coalesce(empty, F.slice(held, F.lit(1), F.lit(0))), held)
    picked = framed.select(*group, F.explode(cuts).alias("c")).select(*group, "c.fraction", "c.x.*")
    cutoff = cutoff_length(F.col("full_length"), F.col("fraction"))
    rows = picked.withColumn("cutoff", cutoff)
    if form == "sequence":
        errors = [(F.col(f"sum_{t}") / F.col("n")).alias(f"mae_{t}") for t in ("first", "full")]
        truth = []
    else:
        beyond = F.raise_error(F.lit("cutoff lies past the end of the sequence"))
        source = "next" if align == "reference" else "shown"
        inside = F.lit(True) if align == "exact" else F.col("cutoff") < F.col("full_length")
        actual = {t: F.when(inside, F.col(f"{source}_{t}")).otherwise(beyond.cast("double")) for t in ("first", "full")}
        errors = [F.abs(F.col(f"pred_{t}") - actual[t]).alias(f"mae_{t}") for t in ("first", "full")]
        truth = [actual[t].alias(f"true_{t}") for t in ("first", "full")]
    return rows.select(
        *group,
        "fraction",
        "cutoff",
        *truth,
        "pred_first",
        "pred_full",
        add_days(F.col("data_start_date"), F.col("cutoff")).alias("cutoff_date"),
        predicted_date(F.col("data_start_date"), F.col("cutoff"), F.col("pred_first"), align).alias(
            "pred_first_bloom_date"
        ),
        predicted_date(F.col("data_start_date"), F.col("cutoff"), F.col("pred_full"), align).alias(
            "pred_full_bloom_date"
        ),
        *errors,
    )


POINT_COLUMNS = (
    "site_name", "year", "start_date", "date_first", "date_full", "true_first", "true_full", "pred_first", "pred_full",
    "cutoff", "cutoff_date", "pred_first_bloom_date", "pred_full_bloom_date", "mae_first", "mae_full",
)


def point_rows(scores: DataFrame) -> DataFrame:
    """What ``score_at_cutoffs(form="point")`` gives, as rows of ``POINT_COLUMNS``, after ``sim_id`` if there is one and before ``fraction``."""
    old = {"site": "site_name", "data_start_date": "start_date", "first_bloom": "date_first", "full_bloom": "date_full"}
    rows = scores.withColumnsRenamed({a: b for a, b in old.items() if a in scores.columns})
    return rows.select(*[c for c in ("sim_id",) if c in rows.columns], *POINT_COLUMNS, "fraction")


def score_sequences(
    seasons: DataFrame, fractions: Sequence[float] = DEFAULT_FRACTIONS, align: str = "reference"
) -> DataFrame:
    """Prediction rows with the sequences themselves, one per season and cutoff.

    ``seasons`` holds ``site_name, year, start_date, date_first, date_full`` and whole-season arrays
    ``true_first, true_full, pred_first, pred_full``. The arrays are cut, never gathered again. Errors of a season are added up once, for all
    cutoffs.
    """
    _check("sequence", align)
    shares = sorted({float(f) for f in fractions})
    sized = seasons.withColumn("full_length", F.size("true_full"))
    errors = {f"_{t}": F.zip_with(f"pred_{t}", f"true_{t}", lambda p, a: F.abs(p - a)) for t in ("first", "full")}
    sized = sized.withColumns(errors)
    cuts = [cutoff_length(F.col("full_length"), f) for f in shares]
    sums = {f"_sums_{t}": prefix_sums(F.col(f"_{t}"), cuts) for t in ("first", "full")}
    sized = sized.withColumns({**sums, **{f"_size_{t}": F.size(f"_{t}") for t in ("first", "full")}}).drop(*errors)
    rows = with_cutoffs(sized, fractions)

    def mean_error(t: str) -> Column:
        n = F.least(F.col(f"_size_{t}"), F.greatest("cutoff", F.lit(0)))
        place = F.array_position(F.array(*[F.lit(f) for f in shares]), F.col("fraction")).cast("int")
        return F.when(n > 0, F.get(f"_sums_{t}", place - 1) / n).alias(f"mae_{t}")

    names = ("true_first", "true_full", "pred_first", "pred_full")
    shown = rows.withColumns({f"{n}_sequence": prefix(F.col(n), F.col("cutoff")) for n in names})
    start = F.col("start_date").cast("date")
    extra = [c for c in ("sim_id",) if c in seasons.columns]
    return shown.select(
        *extra,
        "site_name",
        "year",
        "start_date",
        "date_first",
        "date_full",
        *[f"{n}_sequence" for n in names],
        "fraction",
        "cutoff",
        add_days(start, F.col("cutoff")).alias("cutoff_date"),
        *[
            predicted_date(start, F.col("cutoff"), last_item(F.col(f"pred_{t}_sequence")), align).alias(
                f"pred_{t}_bloom_date"
            )
            for t in ("first", "full")
        ],
        "full_length",
        *[mean_error(t) for t in ("first", "full")],
    )


def true_at_cutoff(seasons: DataFrame, fractions: Sequence[float] = DEFAULT_FRACTIONS, strict: bool = True) -> DataFrame:
    """The two true countdowns at each cutoff; a cutoff at the end of a sequence fails unless ``strict=False``."""
    rows = with_cutoffs(seasons.withColumn("full_length", F.size("true_full")), fractions)
    return rows.withColumns({f"{n}_at": item_at(F.col(n), F.col("cutoff"), strict) for n in ("true_first", "true_full")})


def step_mse(steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Squared error averaged over both outputs and then over all steps."""
    first = F.col("pred_first") - F.col("true_first")
    full = F.col("pred_full") - F.col("true_full")
    return steps.groupBy(*keys).agg((F.sum((first * first + full * full) / 2) / F.count("*")).alias("mse"))


def step_errors(steps: DataFrame, floor: float = 1e-10) -> DataFrame:
    """Per-step mean squared error over both outputs, kept above ``floor`` for log axes."""
    first = F.col("pred_first") - F.col("true_first")
    full = F.col("pred_full") - F.col("true_full")
    return steps.withColumn("mse", F.greatest(F.lit(floor), (first * first + full * full) / 2))


def _converters(schema: T.StructType | str) -> tuple[T.StructType, Callable, Callable]:
    """The schema, and functions to pandas, with dates as ``datetime64`` and not as an object each, and back. They go to tasks whole."""
    kinds = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def frame(table: pa.RecordBatch | pa.Table) -> pd.DataFrame:
        return table.to_pandas(date_as_object=False)

    def batches(made: pd.DataFrame) -> list[pa.RecordBatch]:
        return pa.Table.from_pandas(made, schema=arrow, preserve_index=False).to_batches()

    return kinds, frame, batches


def predict_rows(steps: DataFrame, predict: Callable, schema: T.StructType | str) -> DataFrame:
    """A caller's own row model: ``predict`` maps an iterator of pandas batches, as in ``mapInPandas``; dates are ``datetime64``."""
    kinds, to_frame, to_batches = _converters(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in predict(to_frame(b) for b in batches):
            yield from to_batches(frame)

    return steps.mapInArrow(run, kinds)


def predict_sequences(steps: DataFrame, keys: Sequence[str], predict: Callable, schema: T.StructType | str) -> DataFrame:
    """A caller's own sequence model: ``predict`` maps the pandas frame of one sequence; dates are ``datetime64``.

    Choose keys that bound the group, such as site and year. Sequences travel many to a batch and are cut apart in the task, which holds
    one batch and the sequence that it ends in.
    """
    kinds, to_frame, to_batches = _converters(schema)
    names = steps.columns
    # Places a sequence's rows together, each numbered from 1; Spark shuffles only if they aren't placed so already.
    numbered = steps.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd  # not with the module, which every Python worker loads

        def predicted(table: pa.Table, begins: np.ndarray) -> list[pa.RecordBatch]:
            frame = to_frame(table.select(names))
            made = [predict(frame.iloc[a:b].reset_index(drop=True)) for a, b in zip(begins, [*begins[1:], len(frame)])]
            return to_batches(pd.concat(made, ignore_index=True))

        rest = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("_row").to_numpy() == 1)
            if not len(begins):
                rest.append(batch)
                continue
            held = pa.Table.from_batches([*rest, batch.slice(0, int(begins[-1]))])
            if held.num_rows:
                yield from predicted(held, np.flatnonzero(held.column("_row").to_numpy() == 1))
            rest = [batch.slice(int(begins[-1]))]
        if rest:
            held = pa.Table.from_batches(rest)
            yield from predicted(held, np.flatnonzero(held.column("_row").to_numpy() == 1))

    return numbered.mapInArrow(run, kinds)
