"""Season tables on disk with their scalers.

``path`` is a folder: each build is a folder of its own in it, with a table of seasons and one of scalers, and ``manifest.json`` names the
build that counts. It is written last, so seasons and scalers always belong together and half-written builds are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from phenoline.operators.scaling import Scaler, scalers_from_table, scalers_to_table
from phenoline.sources.commits import published, publish


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}/manifest.json"


def write_seasons(seasons: DataFrame, scalers: Mapping[str, Scaler], path: str, key: str = "") -> dict:
    """Write a build and make it the one that counts; returns its manifest. ``key`` says what it was built from."""
    spark = seasons.sparkSession
    entry = {"build": f"build-{uuid.uuid4().hex}", "key": key}
    place = f"{path.rstrip('/')}/{entry['build']}"
    seasons.write.option("compression", "zstd").parquet(f"{place}/seasons")
    scalers_to_table(spark, scalers).write.parquet(f"{place}/scalers")
    publish(spark, manifest_path(path), entry)
    return entry


def _read_build(spark: SparkSession, path: str, entry: Mapping) -> tuple[DataFrame, dict[str, Scaler]]:
    place = f"{path.rstrip('/')}/{entry['build']}"
    return spark.read.parquet(f"{place}/seasons"), scalers_from_table(spark.read.parquet(f"{place}/scalers"))


def read_seasons(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Scaler]]:
    entry = published(spark, manifest_path(path))
    if entry is None:
        raise FileNotFoundError(f"no finished build at {path}")
    return _read_build(spark, path, entry)


def load_or_create(
    spark: SparkSession, path: str, create: Callable[[], tuple[DataFrame, Mapping[str, Scaler]]], key: str | None = None
) -> tuple[DataFrame, dict[str, Scaler]]:
    """Read the finished build, else create, write and read one. With a ``key``, a build from another key doesn't count."""
    entry = published(spark, manifest_path(path))
    if entry is None or (key is not None and entry["key"] != key):
        seasons, scalers = create()
        entry = write_seasons(seasons, scalers, path, key or "")
    return _read_build(spark, path, entry)
