"""Latest day of the year over all year columns of a wide event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoline.functions.dates import day_of_year, lenient_date

# Columns of a wide event table that hold no dates (fixed values).
NOT_DATES = ("Site Name", "Currently Being Observed", "30 Year Average 1981-2010", "Notes")


def latest_day_of_year(
    df: DataFrame,
    order: str | None = None,
    exclude: Sequence[str] = NOT_DATES,
    on_null_first: str = "skip",
    fmt: str = "yyyy-M-d",
) -> DataFrame:
    """``(latest_date, day_of_year)``: the date latest in its year; ties go to the first column, then row.

    ``order`` numbers the rows; without it the read order is used. A column whose first cell is null is left
    out whole, unless ``on_null_first="keep"``. Without any valid date the result is ``(null, 0)``. The read order is
    that of file names, blocks and lines. Cells fold to one row per column and day of the year before they are shuffled.
    """
    if on_null_first not in ("skip", "keep"):
        raise ValueError(f"on_null_first must be 'skip' or 'keep', got {on_null_first!r}")
    columns = [c for c in df.columns if c not in exclude and c != order]
    if order is None:
        row = F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())
    else:
        row = F.col(f"`{order}`").cast("bigint")
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("cell"))
            for i, c in enumerate(columns)
        ]
    )
    long = df.select(row.alias("row"), F.explode(cells).alias("c")).select("row", "c.col", "c.cell")
    dated = long.withColumn("date", lenient_date("cell", fmt)).withColumn("doy", day_of_year(F.col("date")))
    per_day = dated.groupBy("col", "doy").agg(
        F.min("row").alias("row"),
        F.min_by(F.col("cell").isNotNull(), "row").alias("starts_with_text"),
        F.min_by("date", "row").alias("date"),
    )
    per_column = per_day.groupBy("col").agg(
        F.min_by("starts_with_text", "row").alias("starts_with_text"),
        F.max_by("date", "doy").alias("date"),
        F.max("doy").alias("doy"),
    )
    if on_null_first == "skip":
        per_column = per_column.filter("starts_with_text")
    found = per_column.filter(F.col("date").isNotNull())
    best = F.struct(F.col("doy"), -F.col("col"))
    return found.agg(
        F.max_by("date", best).alias("latest_date"), F.coalesce(F.max("doy"), F.lit(0)).alias("day_of_year")
    )
