"""Exact, seeded train/test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoline.operators.ranks import FEW, Ranked
from phenoline.sources.paths import stored

# Equal parts of the hashes that a pass counts.
PARTS = 4096


def check_fraction(fraction: float) -> float:
    if not 0 < fraction < 1:
        raise ValueError(f"training share must be between 0 and 1, got {fraction}")
    return fraction


def split_exact(
    df: DataFrame, keys: Sequence[str], fraction: float = 0.8, seed: int = 0, unique: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Split so that exactly ``floor(fraction * n)`` of the n distinct keys are in the first part.

    A key's place is the hash of its values and the seed, so the split depends neither on partitioning nor
    on row order. The k-th smallest hash is found by counting, mostly in one pass; both parts are then plain filters, without a
    sort, a shuffle or a window. Rows that share a key stay together. ``unique=True`` promises one row per key.
    """
    check_fraction(fraction)
    marked = df.withColumn("_place", _place(keys, seed))
    names = df.select(*keys, _place(keys, seed).alias("value"))
    if not unique:
        # Several passes read the keys, so they are folded and shuffled once.
        names = stored(names.distinct())
    found = _threshold(names.select("value"), fraction)
    if found is None:
        return marked.filter(F.lit(False)).drop("_place"), marked.drop("_place")

    place = F.col("_place")
    taken = place <= found.value
    if found.among_ties + 1 < found.ties:
        # Distinct keys whose hashes collide at the threshold: the first ones in key order are taken.
        tied = names.filter(F.col("value") == found.value).orderBy(*keys).limit(found.among_ties + 1)
        chosen = F.lit(False)
        for row in tied.collect():
            same = F.lit(True)
            for key in keys:
                same = same & F.col(key).eqNullSafe(F.lit(row[key]))
            chosen = chosen | same
        taken = (place < found.value) | ((place == found.value) & chosen)
    return marked.filter(taken).drop("_place"), marked.filter(~taken).drop("_place")


def _threshold(values: DataFrame, fraction: float) -> Ranked | None:
    """The place of the last key taken. Places are spread evenly by their hash, so equal parts of the range are counted until few are left."""
    low, width, rank = 0.0, 2.0**52, None
    while True:
        inside = values.filter((F.col("value") >= low) & (F.col("value") < low + width))
        step = width / PARTS
        counts = {r["part"]: r["count"] for r in inside.groupBy(F.floor((F.col("value") - low) / step).alias("part")).count().collect()}
        if rank is None:
            rank = int(fraction * sum(counts.values())) - 1
            if rank < 0:
                return None
        for part in sorted(counts):
            if rank < counts[part]:
                break
            rank -= counts[part]
        low, width = low + part * step, step
        if counts[part] <= FEW or width <= 1:
            break
    # A few values, or a single one.
    left = values.filter((F.col("value") >= low) & (F.col("value") < low + width)).groupBy("value").count().collect()
    for value, n in sorted(map(tuple, left)):
        if rank < n:
            return Ranked(value, n, rank)
        rank -= n
    raise RuntimeError("the keys changed between two passes")


def _place(keys: Sequence[str], seed: int):
    """The first 52 bits of the md5 of the keys and the seed, joined by ``|``, which a double holds exactly."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
