"""Which keys several datasets share."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Datasets per mask column.
WORD = 62


def _masks(datasets: Mapping[str, DataFrame], count_null: bool) -> DataFrame:
    """Number ``n`` of distinct keys per combination of datasets, with ``held``, the sorted places in name order of those.

    A key's datasets are bits, in as many columns as they need. A key that fills a dataset folds into one row per task
    before the shuffle, keys fold to combinations, and only those get the list.
    """
    order = sorted(datasets)
    words = [f"mask_{w}" for w in range(-(-len(order) // WORD))]
    parts = []
    for i, name in enumerate(order):
        df = datasets[name]
        key = F.col(f"`{df.columns[0]}`").cast("string").alias("key")
        bits = [F.lit(1 << i % WORD if i // WORD == w else 0).cast("bigint").alias(c) for w, c in enumerate(words)]
        parts.append(df.select(key, *bits))
    members = reduce(DataFrame.unionAll, parts).groupBy("key").agg(*[F.bit_or(w).alias(w) for w in words])
    if not count_null:
        members = members.filter(F.col("key").isNotNull())
    masks = members.groupBy(*words).agg(F.count("*").alias("n"))
    bit = [F.lit(1 << i % WORD).cast("bigint") for i in range(len(order))]
    held = [F.when(F.col(words[i // WORD]).bitwiseAND(bit[i]) != 0, i) for i in range(len(order))]
    return masks.select("n", F.array_compact(F.array(*held)).alias("held"))


def _name(datasets: Mapping[str, DataFrame], place: str) -> Column:
    return F.get(F.array(*map(F.lit, sorted(datasets))), F.col(place))


def key_counts(datasets: Mapping[str, DataFrame], count_null: bool = True) -> DataFrame:
    """Number of distinct keys per dataset. The key is the first column; null counts as a key unless told not to."""
    if not datasets:
        raise ValueError("need at least one dataset")
    rows = _masks(datasets, count_null).select("n", F.explode("held").alias("i"))
    counted = rows.groupBy(_name(datasets, "i").alias("dataset")).agg(F.sum("n").alias("n_keys"))
    return _with_all(counted, [(n,) for n in datasets], ["dataset"], "n_keys", datasets)


def key_overlap(datasets: Mapping[str, DataFrame], count_null: bool = True) -> DataFrame:
    """Number of shared keys for every pair of datasets, in name order; pairs without any are kept with 0.

    All pairs come out of one pass over the keys; a combination of datasets meets only the pairs within it.
    """
    order = sorted(datasets)
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :]]
    if not pairs:
        raise ValueError("need at least two datasets")
    one = _masks(datasets, count_null).select("n", "held", F.explode("held").alias("i"))
    rows = one.select("n", "i", F.explode(F.filter("held", lambda j: j > F.col("i"))).alias("j"))
    both = rows.groupBy("i", "j").agg(F.sum("n").alias("overlap_count"))
    totals = both.select(_name(datasets, "i").alias("dataset_1"), _name(datasets, "j").alias("dataset_2"), "overlap_count")
    return _with_all(totals, pairs, ["dataset_1", "dataset_2"], "overlap_count", datasets)


def _with_all(counted: DataFrame, names, columns, count, datasets) -> DataFrame:
    """Keep names that met no mask at all, which happens when every dataset is empty."""
    spark = next(iter(datasets.values())).sparkSession
    schema = ", ".join(f"{c} string" for c in columns)
    zero = spark.createDataFrame(names, schema).withColumn(count, F.lit(0).cast("bigint"))
    return counted.unionByName(zero).groupBy(*columns).agg(F.max(count).alias(count))


def shared_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct keys that two one-column tables share."""
    return a.intersect(b)
