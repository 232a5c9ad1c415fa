"""Prediction tables of many runs and cutoffs, and the summaries made from them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoline.operators.reshape import summary_to_long
from phenoline.sources.commits import files, folders, move, published, publish


# How many folders a task may write to at once, beyond which Spark sorts its rows by folder, and what each holds of its file (fixed values).
OPEN_FILES, MOST_OPEN, HELD_BYTES = "spark.sql.maxConcurrentOutputFileWriters", "64", 8 << 20


def write_runs(df: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per run and cutoff share, as partition columns that later reads can prune by.

    Rows are rebalanced by folder first: small folders get one file each, large ones are split between tasks.
    """
    rows = df.hint("rebalance", "sim_id", "fraction")
    rows.write.mode(mode).partitionBy("sim_id", "fraction").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_runs`` wrote."""
    rows = spark.read.parquet(path)
    return rows.withColumns({"sim_id": F.col("sim_id").cast("int"), "fraction": F.col("fraction").cast("double")})


def read_run_folders(spark: SparkSession, stem: str, sim_ids: Sequence[int] | None = None) -> DataFrame:
    """Read ``<stem>/sim_id_N/test_cutoff_X/predictions.parquet`` with N and X taken from the path.

    X, the last ``_`` token of its folder, becomes ``fraction``. ``sim_ids`` narrows the folders that are listed.
    """
    wanted = ["*"] if sim_ids is None else [str(s) for s in sim_ids]
    # A brace list matches nothing for absent runs instead of failing on them.
    pattern = f"{stem.rstrip('/')}/sim_id_{{{','.join(wanted)}}}/test_cutoff_*/predictions.parquet"
    return spark.read.parquet(pattern).select("*", *_from_path())


def _from_path() -> list[Column]:
    where = F.col("_metadata.file_path")
    return [
        F.regexp_extract(where, "/sim_id_([0-9]+)/", 1).cast("int").alias("sim_id"),
        F.regexp_extract(where, "/test_cutoff_(?:[^/]*_)?([^/_]+)/", 1).cast("double").alias("fraction"),
    ]


# A catalogue of finished runs


def write_run(predictions: DataFrame, stem: str, sim_id: int, parameters: Mapping | None = None, gather: bool = True) -> dict:
    """Write one run as ``<stem>/sim_id_N/test_cutoff_X/predictions.parquet`` and then list it as finished; returns its entry.

    ``predictions`` has a column ``fraction``, the X; a column ``sim_id`` is dropped. All folders are written by one job, to a place of
    their own, and get their names when it has ended. The entry in ``<stem>/catalogue`` comes last, with the folders, the columns
    and the parameters, so a run that stopped halfway is never listed. A run's folders are written once: names that are taken raise FileExistsError.

    Rows are gathered by folder before they are written. ``gather=False`` leaves them in their tasks, each of which writes a file to each folder:
    for rows with long arrays, whose shuffle would take more disk than the run. They go to their files as they come, unsorted, so a task
    may make any number of them; numbers of long arrays seldom repeat in a way that a dictionary of them would pay for.
    """
    spark, stem = predictions.sparkSession, stem.rstrip("/")
    rows = predictions.drop("sim_id")
    draft = f"{stem}/draft-{uuid.uuid4().hex}"
    if gather:
        rows.hint("rebalance", "fraction").write.option("compression", "zstd").partitionBy("fraction").parquet(draft)
    else:
        before = spark.conf.get(OPEN_FILES)
        spark.conf.set(OPEN_FILES, MOST_OPEN)
        try:
            writer = rows.write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": HELD_BYTES})
            writer.partitionBy("fraction").parquet(draft)
        finally:
            spark.conf.set(OPEN_FILES, before)
    places = {}
    for name in folders(spark, draft):
        places[name] = f"sim_id_{sim_id}/test_cutoff_{name.partition('=')[2]}/predictions.parquet"
        move(spark, f"{draft}/{name}", f"{stem}/{places[name]}")
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "fraction"]
    entry = {"sim_id": sim_id, "folders": sorted(places.values()), "columns": columns, "parameters": dict(parameters or {})}
    publish(spark, f"{stem}/catalogue/sim_id_{sim_id}.json", entry)
    return entry


def finished_runs(spark: SparkSession, stem: str, sim_ids: Sequence[int] | None = None) -> list[dict]:
    """Entries of the catalogue, a file a run, by ``sim_id``; runs that aren't listed are left out."""
    place = f"{stem.rstrip('/')}/catalogue"
    entries = [published(spark, f"{place}/{name}") for name in files(spark, place) if name.endswith(".json")]
    return sorted((e for e in entries if e and (sim_ids is None or e["sim_id"] in sim_ids)), key=lambda e: e["sim_id"])


def read_finished_runs(spark: SparkSession, stem: str, sim_ids: Sequence[int] | None = None) -> DataFrame:
    """Predictions of all finished runs with ``sim_id`` and ``fraction``, from the listed folders alone.

    Runs of one set of columns are read together; sets that differ, such as sequences and points, are matched by name, with nulls for what a
    run lacks.
    """
    forms: dict[tuple[str, ...], list[str]] = {}
    for entry in finished_runs(spark, stem, sim_ids):
        forms.setdefault(tuple(entry["columns"]), []).extend(f"{stem.rstrip('/')}/{f}" for f in entry["folders"])
    if not forms:
        raise FileNotFoundError(f"no finished run below {stem}")
    out = None
    for columns, paths in forms.items():
        rows = spark.read.schema(", ".join(f"`{c.partition(' ')[0]}` {c.partition(' ')[2]}" for c in columns)).parquet(*paths).select("*", *_from_path())
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def parameters_table(spark: SparkSession, stem: str, sim_ids: Sequence[int] | None = None) -> DataFrame:
    """(sim_id, name, value as text) of the parameters of all finished runs."""
    rows = [(e["sim_id"], n, None if v is None else str(v)) for e in finished_runs(spark, stem, sim_ids) for n, v in e["parameters"].items()]
    return spark.createDataFrame(rows, "sim_id int, name string, value string")


def write_summary_csv(summary: DataFrame, path: str, mode: str = "error") -> None:
    """Rows ``mean_<cutoff>`` and ``std_<cutoff>`` with their values, one folder per run and event; one job."""
    sides = [
        F.struct(F.lit(f"mae_{t}").alias("event"), F.col(f"mean_{t}").alias("mean"), F.col(f"std_{t}").alias("std"))
        for t in ("first", "full")
    ]
    rows = summary.select("sim_id", "cutoff", F.explode(F.array(*sides)).alias("side"))
    long = summary_to_long(rows.select("sim_id", "cutoff", "side.*"), "mean", "std", ["sim_id", "event"])
    write_csv(long.hint("rebalance", "sim_id", "event"), path, mode, ["sim_id", "event"])


def write_csv(df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "error") -> None:
    """Metrics per run and cutoff as JSON lines, one folder per run and cutoff."""
    keys = [c for c in ("sim_id", "fraction") if c in metrics.columns]
    metrics.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).json(path)


def _parameter_type(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    if kinds == {bool}:
        return "boolean"
    if kinds == {int}:
        return "bigint"
    return "double" if kinds and kinds <= {int, float} else "string"


def write_parameters_json(spark: SparkSession, parameters: Mapping[int, Mapping], path: str, mode: str = "error") -> None:
    """The settings of each run as JSON, keyed by run. Numbers and truth values keep their type; anything else is text."""
    names = sorted({n for p in parameters.values() for n in p})
    types = {n: _parameter_type([p.get(n) for p in parameters.values()]) for n in names}
    cast = {"boolean": bool, "bigint": int, "double": float, "string": str}
    rows = [(sim, *[None if p.get(n) is None else cast[types[n]](p[n]) for n in names]) for sim, p in parameters.items()]
    schema = ", ".join(["sim_id int", *[f"`{n}` {types[n]}" for n in names]])
    spark.createDataFrame(rows, schema).write.mode(mode).partitionBy("sim_id").json(path)

