"""One text file per sheet, with the header at an unknown line."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoline.operators.reshape import quoted
from phenoline.sources.paths import path_exists, scratch_path, stored

SHEET_NAME = r"([^/]*?)(?:\.[^./]*)?$"

# Files are split between tasks, so a line's place is its block's start and then its order within the task.
_PLACE = ("block", "line_id")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        # The path is URL-encoded but for plus signs, which decoding would turn into blanks.
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )


def read_sheets(
    spark: SparkSession,
    path: str,
    marker: str = "Year",
    min_year: int = 1955,
    sep: str = ",",
    site_column: str = "City",
    site_pattern: str = SHEET_NAME,
) -> DataFrame:
    """All sheets of a folder as one table, columns matched by name.

    In each file the first line whose first cell contains ``marker`` is the header; lines above it are
    dropped. Columns that a sheet lacks are null. ``site_column`` holds the sheet's name, which is the first
    group of ``site_pattern`` in the file path: by default the file name without its extension.
    Rows are kept whose ``Year`` is all digits and at least ``min_year``. A file without a header fails.

    Files are read as lines, so a large sheet is split between tasks. The lines are stored once together with
    their places, which later passes could not count on to be the same again. A header is found by an
    aggregation that keeps one line per file, and rejoined to its lines; nothing gathers a whole sheet. Lines are written by the header of their
    sheet, and every different header gets one parser of just its width, so a broken, very wide header costs its own sheet alone. The driver
    sees the different headers.
    """
    lines = stored(_lines(spark, path))
    cut = "\\Q" + sep + "\\E"
    is_header = F.split("line", cut, 2)[0].contains(marker)
    per_file = lines.groupBy("file").agg(F.bool_or(is_header).alias("found"))
    missing = per_file.filter(~F.coalesce("found", F.lit(False))).count()
    if missing:
        raise ValueError(f"{missing} sheet(s) below {path} have no line whose first cell contains {marker!r}")
    candidates = lines.filter(is_header).groupBy("file")
    headers = stored(candidates.agg(F.min(F.struct(*_PLACE, "line")).alias("header")))
    signed = headers.withColumn("signature", F.sha1("header.line"))
    tagged = lines.join(signed, "file")
    body = tagged.filter(F.struct(*_PLACE) > F.struct(*[F.col(f"header.{c}") for c in _PLACE]))
    kept = body.select(F.regexp_extract("file", site_pattern, 1).alias("site"), "line", "signature")
    place = scratch_path(spark, "sheets")
    kept.write.partitionBy("signature").parquet(place)
    seen = signed.groupBy("signature").agg(F.any_value("header.line").alias("line")).orderBy("line").collect()
    sheets = []
    for r in seen:
        header = next(csv.reader([r["line"]], delimiter=sep))
        columns = _columns(header)
        if marker not in columns:
            raise ValueError(f"a sheet below {path} has no column named {marker!r}: {r['line'][:200]!r}")
        # A header without lines has no folder.
        if not path_exists(spark, f"{place}/signature={r['signature']}"):
            rows = spark.createDataFrame([], "site string, line string")
        else:
            rows = spark.read.schema("site string, line string").parquet(f"{place}/signature={r['signature']}")
        fields = ", ".join(f"c{i} string" for i in range(max(columns.values()) + 1))
        options = {"sep": sep, "mode": "PERMISSIVE", "maxColumns": str(max(1 << 17, 2 * len(header)))}
        cells = rows.select("site", F.from_csv("line", fields, options).alias("x"))
        sheets.append(cells.select(*[F.col(f"x.c{i}").alias(c) for c, i in columns.items()], F.col("site").alias(site_column)))
    if not sheets:
        raise ValueError(f"there is no sheet below {path}")
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)
    names = sorted((c for c in whole.columns if c != site_column), key=lambda c: (c != marker, c))
    rows = whole.select(*[F.col(quoted(c)) for c in names], F.col(quoted(site_column)))
    year = F.col(quoted(marker))
    digits = rows.filter(year.rlike("^[0-9]+$"))
    return digits.withColumn(marker, year.try_cast("int")).filter(F.col(quoted(marker)) >= min_year)


def _columns(cells: list[str]) -> dict[str, int]:
    """Names and places of a header's columns; blank ones have none, and of equal ones the first counts."""
    columns: dict[str, int] = {}
    for i, name in enumerate(c.strip(" ") for c in cells):
        if name:
            columns.setdefault(name, i)
    return columns
