"""Headered CSV inputs with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenoline.functions.arrays import clean_number
from phenoline.functions.dates import strict_date


# Cells of a line that travel together to their names (fixed value).
BLOCK = 256


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a headered CSV; reads its first line only."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns


def read_wide_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Wide CSV with every column as text, since which columns exist differs per file. Blanks become null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in csv_header(spark, path, sep)])
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def read_cities(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``country, city_ascii, lat, lng`` of a city list, found by name; unreadable numbers become null."""
    rows = read_wide_csv(spark, path, sep)
    return rows.selectExpr(
        "country", "city_ascii", "try_cast(lat AS double) AS lat", "try_cast(lng AS double) AS lng"
    )


def csv_cells(line: Column, sep: str = ",") -> Column:
    """The cells of a CSV line as an array of text; quoted cells may hold separators and doubled quotes, but no line breaks."""
    cut = "\\Q" + sep + "\\E"
    # Every cell is followed by a separator, the last one by an added one. No backtracking, so cells may be long.
    cell = f'("(?:[^"]++|"")*+"|(?:(?!{cut}).)*+){cut}'
    found = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(cell), F.lit(1))
    return F.transform(found, lambda c: F.when(c.rlike('(?s)^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )


def _headers(lines: DataFrame) -> DataFrame:
    """(file, header, head): a file's header is the first line of its first block; files that share one share ``head``."""
    headers = lines.filter("block = 0").groupBy("file").agg(F.min_by("line", "line_id").alias("header"))
    return headers.withColumn("head", F.md5("header"))


def _header_cells(headers: DataFrame, sep: str) -> DataFrame:
    """(head, place, name) of the different headers."""
    different = headers.groupBy("head").agg(F.first("header").alias("header"))
    return different.select("head", F.posexplode(csv_cells(F.col("header"), sep)).alias("place", "name"))


def column_keys(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(site): the different column names of wide CSV files, but for the first of each file, as rows."""
    return _header_cells(_headers(_lines(spark, path)), sep).filter("place > 0").select(F.col("name").alias("site")).distinct()


def melt_wide_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(key, name, cell) of a headered wide CSV, for any number of columns: the first cell of a line, and each other column's name and cell.

    Lines are cut into cells and the cells take their names by place from the header of their file, so the plan has one expression whatever the
    number of columns, and the files may differ in theirs. Names are listed once for each different header, not for each file, and meet the cells in
    blocks of ``BLOCK`` columns, so that only text in arrays is shuffled where the names are too many to be sent to the cells. Blank cells and
    those that a short line lacks become null. Lines that begin as the header does are headers; cells beyond the header's are dropped, as are
    blank lines.
    """
    lines = _lines(spark, path)
    headers = _headers(lines)
    heads = headers.groupBy("head").agg(F.first("header").alias("header")).select("head", csv_cells(F.col("header"), sep).alias("names"))
    names = heads.select("head", F.explode(_blocks("names", F.size("names"))).alias("b")).select("head", "b.*")
    found = csv_cells(F.col("header"), sep)
    files = headers.select("file", "head", F.get(found, F.lit(0)).alias("first"), F.size(found).alias("width"))
    # A short row a file, which the driver has listed anyway: lines aren't shuffled for it.
    cells = lines.filter(F.length("line") > 0).select("file", csv_cells(F.col("line"), sep).alias("cells")).join(F.broadcast(files), "file")
    # A header's key is null, so nothing that reads keys can fail on it, wherever the optimizer moves the reading.
    key = F.get("cells", F.lit(0))
    cells = cells.withColumn("key", F.when(key != F.col("first"), key)).filter("key IS NOT NULL")
    blocks = cells.select("head", "key", F.explode(_blocks("cells", F.col("width"))).alias("b")).select("head", "key", "b.*")
    named = blocks.join(names, ["head", "block"]).select("key", F.explode(F.arrays_zip("names", "cells")).alias("c"))
    named = named.select("key", F.col("c.names").alias("name"), F.col("c.cells").alias("cell")).filter("name IS NOT NULL")
    return named.select("key", "name", F.when(F.col("cell") != "", F.col("cell")).alias("cell"))


def _blocks(cells: str, width: Column) -> Column:
    """The cells of a line but for the first as numbered blocks of ``BLOCK``, as many as ``width`` cells have."""
    numbers = F.sequence(F.lit(0), F.floor((width - 2) / BLOCK).cast("int"))
    made = F.transform(numbers, lambda i: F.struct(i.alias("block"), F.slice(cells, i * BLOCK + 2, BLOCK).alias(cells)))
    return F.when(width > 1, made)


def read_wide_observations(spark: SparkSession, path: str, sep: str = ",", fmt: str = "yyyy-M-d") -> DataFrame:
    """``(date, site, temp)`` from a wide CSV of any width; a bad date fails the query."""
    long = melt_wide_csv(spark, path, sep)
    return long.select(strict_date(F.col("key"), fmt).alias("date"), F.col("name").alias("site"), clean_number(F.col("cell")).alias("temp"))
