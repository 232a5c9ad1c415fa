"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenoline.sources.paths import scratch_path

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = {
    "documents": DOCUMENTS,
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared scratch folder and read back; later jobs start from files that outlive executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx`` (from 0 within ``tree``, by ``order``, which tells all rows apart) and ``m`` (rows of the tree).

    By a range partitioned sort and the counts of its parts; no tree is gathered in a task.
    """
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # The upper bits of this number are the part, the lower ones count its rows.
    dealt = stored(spread.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "sorted")
    counts = dealt.groupBy("tree", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select("tree", "part", (before - F.col("low")).alias("shift"), F.sum("n").over(tree).alias("m"))
    return dealt.join(stored(parts, "parts"), ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sub_batches(texts: list, most_chars: int = 2_000_000):
    """Cut a list of texts into runs of about ``most_chars``; yields (start, texts). A longer text is a run of its own."""
    for start, end in _runs([len(text) if text else 0 for text in texts], most_chars):
        yield start, texts[start:end]


def sub_columns(column: pa.Array, most_chars: int = 2_000_000):
    """The same for an Arrow column of texts, of which one run at a time becomes Python strings."""
    for start, end in _runs(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), most_chars):
        yield start, column.slice(start, end - start).to_pylist()


def _runs(sizes: list[int], most: int):
    """(start, end) of runs of about ``most`` in all."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def tidied(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives unused memory back to the system now and then, and at its end.

    Python workers stay for the next stage, beside the JVM's heap, and would keep what the allocators hold.
    """

    def tidying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for i, batch in enumerate(run(batches)):
                yield batch
                if i % 8 == 7:
                    give_back()
        finally:
            gc.collect()
            give_back()

    return tidying


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)
