"""Exact order statistics of large columns without sorting or gathering them.

Each pass draws splitters close to every wanted rank from the data, by approximate percentiles within the range that is
left, and counts the values between and at them exactly, which combines map-side down to a few numbers per task. The part
that holds the rank becomes the next range, about one value in a thousand of the one before, whatever the distribution; a splitter
is a value of the data, so every pass narrows. A value that makes up a third of the rows is a splitter, and a part of its own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Approximate percentiles are off by at most one rank in so many.
ACCURACY = 10_000
# Ranges of at most so many values are read as they are.
FEW = 2048


@dataclass
class _Search:
    name: str
    rank: int  # 0-based rank within the current range
    low: float
    high: float
    count: int  # values within the current range
    wanted: int  # 0-based rank within all values


@dataclass(frozen=True)
class Ranked:
    """The value at a rank, how many values equal it, and the rank among those."""

    value: float
    ties: int
    among_ties: int


def value_ranges(values: DataFrame) -> dict[str, tuple[int, float, float]]:
    """Count, smallest and largest value per name of a ``(name, value)`` table; one row per name is collected."""
    known = values.filter(F.col("value").isNotNull())
    rows = known.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return {r["name"]: (r["n"], r["lo"], r["hi"]) for r in rows.collect()}


def select_ranks(values: DataFrame, ranks: Mapping[str, Sequence[int]], ranges=None) -> dict[tuple[str, int], Ranked]:
    """The value at each 0-based rank, for every name of a ``(name string, value double)`` table; infinities are values."""
    ranges = ranges or value_ranges(values)
    found: dict[tuple[str, int], Ranked] = {}
    searches = []
    for name, wanted in ranks.items():
        count, low, high = ranges[name]
        for rank in sorted(set(wanted)):
            searches.append(_Search(name, rank, low, high, count, rank))
    while True:
        for s in searches:
            if s.low == s.high:
                found[s.name, s.wanted] = Ranked(s.low, s.count, s.rank)
        searches = [s for s in searches if s.low != s.high]
        short = [s for s in searches if s.count <= FEW]
        if short:
            found.update(_read(values, short))
            searches = [s for s in searches if s.count > FEW]
        if not searches:
            return found
        counted = _count_parts(values, _splitters(values, searches))
        for s in searches:
            before, size = 0, s.count
            for count, low, high in counted[s.name, s.low, s.high]:
                if s.rank < before + count:
                    s.rank, s.low, s.high, s.count = s.rank - before, low, high, count
                    break
                before += count
            if s.count == size:
                raise RuntimeError(f"the values of {s.name!r} changed between two passes")


def _read(values: DataFrame, searches: Sequence[_Search]) -> dict[tuple[str, int], Ranked]:
    """The values at the ranks wanted in ranges of at most ``FEW`` values each."""
    ranges = {(s.name, s.low, s.high) for s in searches}
    rows = values.filter(reduce(lambda a, b: a | b, [_inside(*at) for at in ranges])).groupBy("name", "value").count().collect()
    found = {}
    for s in searches:
        inside = sorted((r["value"], r["count"]) for r in rows if r["name"] == s.name and s.low <= r["value"] <= s.high)
        before = 0
        if sum(n for _, n in inside) != s.count:
            raise RuntimeError(f"the values of {s.name!r} changed between two passes")
        for value, n in inside:
            if s.rank < before + n:
                found[s.name, s.wanted] = Ranked(value, n, s.rank - before)
                break
            before += n
    return found


def _inside(name: str, low: float, high: float) -> Column:
    return (F.col("name") == name) & F.col("value").between(low, high)


def _splitters(values: DataFrame, searches: Sequence[_Search]) -> dict[tuple[str, float, float], list[float]]:
    """For each range of a name, values of the data on both sides of every rank wanted in it, closer than the accuracy parts them."""
    shares: dict[tuple, set[float]] = {}
    for s in searches:
        middle, off = (s.rank + 0.5) / s.count, 2 / ACCURACY
        shares.setdefault((s.name, s.low, s.high), set()).update(min(max(middle + d, 0.0), 1.0) for d in (-off, 0.0, off))
    # Ranges don't overlap unless they are equal, so each value is asked for in at most one.
    number = reduce(lambda rest, i: F.when(_inside(*i[1]), i[0]).otherwise(rest), enumerate(shares), F.lit(None))
    rows = values.select("value", number.alias("range")).filter(F.col("range").isNotNull()).groupBy("range")
    every = sorted(set().union(*shares.values()))
    drawn = rows.agg(F.percentile_approx("value", F.array(*map(F.lit, every)), ACCURACY).alias("drawn")).collect()
    found = {r["range"]: dict(zip(every, r["drawn"])) for r in drawn}
    return {at: sorted({found[i][share] for share in wanted}) for i, (at, wanted) in enumerate(shares.items())}


def _count_parts(values: DataFrame, splitters: Mapping[tuple[str, float, float], Sequence[float]]) -> dict[tuple, list[tuple]]:
    """For each range the count, smallest and largest value of its parts, in value order.

    A part holds the values equal to a splitter, or those between two. After the first pass few rows are inside any
    range, and the filter that keeps them can reach the scan.
    """
    part, inside_any, value = F.lit(None), F.lit(False), F.col("value")
    for i, (at, split) in enumerate(splitters.items()):
        inside = _inside(*at)
        inside_any = inside_any | inside
        place = reduce(lambda a, s: a + (value >= s).cast("int") + (value > s).cast("int"), split, F.lit(0))
        part = F.when(inside, F.struct(F.lit(i).alias("range"), place.alias("place"))).otherwise(part)
    rows = (
        values.filter(inside_any)
        .select(value, part.alias("part"))
        .groupBy(F.col("part.range").alias("range"), F.col("part.place").alias("place"))
        .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        .collect()
    )
    names = list(splitters)
    result: dict[tuple, list[tuple]] = {at: [] for at in names}
    for r in sorted(rows, key=lambda r: (r["range"], r["place"])):
        result[names[r["range"]]].append((r["n"], r["lo"], r["hi"]))
    return result


def _between(low: float, high: float, part: float) -> float:
    if low == high or part == 0:
        return low
    step = high - low
    if math.isinf(step) and not (math.isinf(low) or math.isinf(high)):
        return low * (1 - part) + high * part
    return low + step * part


def exact_quantiles(values: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[tuple[str, float], float]:
    """Linearly interpolated quantiles per name of a ``(name string, value double)`` table; nulls are ignored."""
    ranges = value_ranges(values)
    places = {}
    for name, qs in wanted.items():
        if name in ranges:
            for q in qs:
                at = q * (ranges[name][0] - 1)
                places[name, q] = (int(at), min(int(at) + 1, ranges[name][0] - 1), at - int(at))
    ranks: dict[str, list[int]] = {}
    for (name, _), (low, high, _) in places.items():
        ranks.setdefault(name, []).extend([low, high])
    found = {at: r.value for at, r in select_ranks(values, ranks, ranges).items()}
    return {(name, q): _between(found[name, low], found[name, high], part) for (name, q), (low, high, part) in places.items()}
