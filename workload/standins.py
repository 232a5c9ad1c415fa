"""Inputs of the library's shape, derived by Spark from the test tables.

A supplier is a site, its daily top price a reading, and the first ship dates from March and from April of
a year are that year's two events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenoline.operators.seasons import build_season_steps, sites_in_country
from phenoline.sources.paths import input_bytes


# Column types of the tables (fixed values). Naming them saves a job per read that would look them up.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

# Items of a season task: some 100,000 rows, which make half a million days (fixed value).
TASK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("site")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, date, temp): one row per day between a site's first and last day, null where nothing shipped.

    Items fold to days in as many tasks as their size asks for, dealt by site, as its days meet in one task anyway to be put in order; a task holds
    the days of its sites, not their items. Nearly every row is a day of its own, so folding them ahead of the shuffle would only cost memory. Each day then brings forth the blank ones up to the next, so
    blank days aren't shuffled. A site has one row for each of its days there.
    """
    tasks = season_tasks(spark, sf_dir)
    day = F.col("l_shipdate").cast("date").alias("date")
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", day, F.col("l_extendedprice").alias("temp"))
    daily = items.repartition(tasks, "l_suppkey").groupBy("l_suppkey", "date").agg(F.max("temp").alias("temp"))
    following = F.lead("date").over(Window.partitionBy("l_suppkey").orderBy("date"))
    daily = daily.withColumn("next", following)
    named = daily.join(_suppliers(spark, sf_dir), "l_suppkey")
    # The last day has no next one, and a row without a date stays as it is.
    places = F.sequence(F.lit(0), F.coalesce(F.date_diff("next", "date") - 1, F.lit(0)))
    days = named.select("site", "date", "temp", F.explode(places).alias("place"))
    return days.select("site", F.date_add("date", F.col("place")).alias("date"), F.when(F.col("place") == 0, F.col("temp")).alias("temp"))


def observed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site): those that ``observations`` holds, from the keys alone."""
    keys = table(spark, sf_dir, "lineitem").filter("l_shipdate IS NOT NULL").select("l_suppkey").distinct()
    return keys.join(_suppliers(spark, sf_dir), "l_suppkey").select("site").distinct()


def _yearly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year(day).alias("year"), day.alias("date"))
    dates = items.groupBy("l_suppkey", "year").agg(
        F.min(F.when(F.month("date") >= 3, F.col("date"))).alias("first"),
        F.min(F.when(F.month("date") >= 4, F.col("date"))).alias("full"),
    )
    return dates.join(_suppliers(spark, sf_dir), "l_suppkey")


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _yearly_events(spark, sf_dir).select("site", "year", F.col("first").alias("date"))
    return rows.filter(F.col("date").isNotNull())


def full_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _yearly_events(spark, sf_dir).select("site", "year", F.col("full").alias("date"))
    return rows.filter(F.col("date").isNotNull())


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, city_ascii, lat, lng): suppliers with their balance, and their nation's top customer balance."""
    top = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("lng"))
    nations = table(spark, sf_dir, "nation").join(top, F.col("n_nationkey") == F.col("c_nationkey"))
    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country"), F.col("s_name").alias("city_ascii"), F.col("s_acctbal").alias("lat"), "lng"
    )


def season_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the seasons: one for every ``TASK_BYTES`` of items, at least as many as there are slots."""
    size = input_bytes(spark, f"{sf_dir}/lineitem.parquet")
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def season_steps(spark: SparkSession, sf_dir: str, method: str = "linear") -> DataFrame:
    """All valid seasons. The stand-ins are unique by construction, which the flags state."""
    return build_season_steps(
        first_events(spark, sf_dir),
        full_events(spark, sf_dir),
        observations(spark, sf_dir),
        sites_in_country(cities(spark, sf_dir), None),
        method=method,
        unique_keys=True,
        unique_dates=True,
        one_year=True,
        partitions=season_tasks(spark, sf_dir),
    )
