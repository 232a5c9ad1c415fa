"""Fixed-length history windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_windows(
    df: DataFrame, keys: Sequence[str], step: str, values: Sequence[str], n_in: int = 30, block: int = 4096
) -> DataFrame:
    """Add ``past_<value>``, the ``n_in`` values before each row; rows with less history are dropped.

    ``step`` counts 0, 1, 2, ... within each key. Long sequences are cut into blocks of ``block`` steps, each
    with the last ``n_in`` rows of the block before, so a key that holds a large share of the rows is spread
    over many window groups. Sequences shorter than a block are not copied at all.
    """
    if n_in < 1 or block < n_in:
        raise ValueError(f"need 1 <= n_in <= block, got n_in={n_in}, block={block}")
    rows = in_blocks(df, step, n_in, block)
    home = F.floor(F.col(step) / block)
    past = Window.partitionBy(*keys, "_block").orderBy(step).rowsBetween(-n_in, -1)
    # One list of all values; a struct is never null, so null values keep their place.
    rows = rows.withColumn("_past", F.collect_list(F.struct(*values)).over(past))
    full = rows.filter((F.size("_past") == n_in) & (F.col("_block") == home))
    return full.select(*df.columns, *[F.col(f"_past.{v}").alias(f"past_{v}") for v in values])


def in_blocks(df: DataFrame, step: str, n_in: int, block: int) -> DataFrame:
    """Add ``_block``; the last ``n_in`` rows of a block also stand before the next one."""
    home = F.floor(F.col(step) / block)
    reaches_next = F.pmod(F.col(step), F.lit(block)) >= block - n_in
    return df.withColumn("_block", F.explode(F.when(reaches_next, F.array(home, home + 1)).otherwise(F.array(home))))
