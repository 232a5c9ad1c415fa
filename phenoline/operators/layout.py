"""Physical layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPEAT_BLOCK = 4096


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table evenly over all task slots, ahead of a generator that multiplies its rows.

    Left alone, adaptive execution sizes the partitions by the small input and one task makes all the output.
    """
    spark = df.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(slots)


def repeat_rows(df: DataFrame, count: str, name: str) -> DataFrame:
    """Every row ``count`` times, numbered from 1 in ``name``.

    Numbers are made block by block, so a row with very many copies never holds them all in one array.
    """
    last_block = ((F.col(count) - 1) / REPEAT_BLOCK).cast("int")
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), last_block)))
    first = F.col("_block").cast("bigint") * REPEAT_BLOCK + 1
    last = F.least(F.col(count).cast("bigint"), first + (REPEAT_BLOCK - 1))
    return blocks.withColumn(name, F.explode(F.sequence(first, last))).drop("_block")
