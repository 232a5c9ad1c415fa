"""Fill null readings from the known ones, by position and in both directions.

For bounded groups (season rows are: one per day) all lookups are null-skipping ``lag`` and ``lead`` over one sorted window, so a
fill costs one pass over the rows of each group. `fill_series` fills groups of any size on two levels: blocks of a range
partitioned sort, and a scan of the blocks' first and last known points. The spline looks at a whole group; splines are fitted in Arrow
batches, some hundred bounded groups side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenoline.functions.splines import fill_splines
from phenoline.sources.paths import stored

# How many known points each method looks at on either side; the spline looks at all.
METHODS = {"linear": 1, "quadratic": 3, "spline": 0}
# Rows of groups that a task fits splines to at once: some hundred seasons (fixed value).
SPLINE_ROWS = 1 << 16


def neighbour_columns(df: DataFrame, window: str, pos: str, value: str, method: str) -> DataFrame:
    """Add position and value of the nearest known points before (``_p``) and after (``_n``) each row."""
    known_pos = f"(CASE WHEN {value} IS NOT NULL THEN {pos} END)"
    found = {}
    for k in range(1, METHODS[method] + 1):
        for tag, lookup in (("p", "lag"), ("n", "lead")):
            found[f"_{tag}{k}_pos"] = F.expr(f"{lookup}({known_pos}, {k}) IGNORE NULLS OVER ({window})")
            found[f"_{tag}{k}_val"] = F.expr(f"{lookup}({value}, {k}) IGNORE NULLS OVER ({window})")
    return df.withColumns(found)


def with_filled(df: DataFrame, pos: str, value: str, windows: Mapping[str, str | None], method: str) -> DataFrame:
    """Add one filled column per window; ``windows`` maps its name to the column with its last position.

    Points after a window's end count as absent, so a trailing gap never sees later values. Points before a
    row are always inside. This lets one set of neighbours serve windows that share their start. The points
    are picked in a projection of their own, so that each formula is generated once and on plain columns.
    """
    picked, filled = {}, {}
    for name, last in windows.items():
        picked.update(_points(name, last, method))
        filled[name] = F.coalesce(F.col(value), *_formulas(name, F.col(pos), method))
    return df.withColumns(picked).withColumns(filled).drop(*picked)


def _points(name: str, last: str | None, method: str) -> dict[str, Column]:
    """Position and value of the points to draw through: before and after, or the nearest ones at an edge."""

    def seen(k: int) -> Column:
        return F.col(f"_n{k}_pos").isNotNull() if last is None else F.col(f"_n{k}_pos") <= F.col(last)

    leads, trails = F.col("_p1_pos").isNull(), ~F.coalesce(seen(1), F.lit(False))
    points = {f"_{name}_edge": leads | trails}
    for part in ("pos", "val"):
        before = [F.col(f"_p{k}_{part}") for k in range(1, METHODS[method] + 1)]
        after = [F.when(seen(k), F.col(f"_n{k}_{part}")) for k in range(1, METHODS[method] + 1)]
        points[f"_{name}_a_{part}"] = F.coalesce(before[0], after[0])
        if method == "linear":
            points[f"_{name}_b_{part}"] = after[0]
        else:
            points[f"_{name}_b_{part}"] = F.when(leads, after[1]).when(trails, before[1]).otherwise(after[0])
            third = F.coalesce(before[1], after[1])
            points[f"_{name}_c_{part}"] = F.when(leads, after[2]).when(trails, before[2]).otherwise(third)
    return points


def _formulas(name: str, at: Column, method: str) -> list[Column]:
    a, b = _point(name, "a"), _point(name, "b")
    line = F.when(F.col(f"_{name}_edge"), a[1]).otherwise((b[1] - a[1]) / (b[0] - a[0]) * (at - a[0]) + a[1])
    return [line] if method == "linear" else [_parabola(at, a, b, _point(name, "c")), line]


def _point(name: str, letter: str) -> tuple[Column, Column]:
    return F.col(f"_{name}_{letter}_pos"), F.col(f"_{name}_{letter}_val")


def _parabola(at: Column, a, b, c) -> Column:
    """Value at ``at`` of the parabola through three points; null if one of them is null."""
    (xa, ya), (xb, yb), (xc, yc) = a, b, c
    return (
        ya * ((at - xb) * (at - xc)) / ((xa - xb) * (xa - xc))
        + yb * ((at - xa) * (at - xc)) / ((xb - xa) * (xb - xc))
        + yc * ((at - xa) * (at - xb)) / ((xc - xa) * (xc - xb))
    )


def with_spline(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, windows: Mapping[str, str | None], start: int = 0
) -> DataFrame:
    """Add one column per window, filled by an order-2 smoothing spline through the window's known values.

    ``windows`` maps its name to the column with its last position; rows behind that get null. ``df`` must hold each group of ``keys`` in one
    partition, as after a window function over them, with ``pos`` counting up from ``start``. Windows for which no spline exists are filled by
    lines. A task holds some ``SPLINE_ROWS`` rows, whose splines are fitted side by side, and the group that they end in.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in windows]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filled(table: pa.Table) -> list[pa.RecordBatch]:
            at = table.column(pos).to_numpy()
            values = table.column(value).to_numpy().astype(float)
            begins = np.flatnonzero(at == start)
            ends = np.append(begins[1:], len(at))
            stops = {n: ends if last is None else np.minimum(ends, begins + table.column(last).to_numpy()[begins] + 1 - start) for n, last in windows.items()}
            spans = [(n, a, b) for n, stop in stops.items() for a, b in zip(begins, stop) if b > a]
            out = {n: np.full(len(values), np.nan) for n in windows}
            for (n, a, b), made in zip(spans, fill_splines([values[a:b] for _, a, b in spans])):
                out[n][a:b] = made
            for n in windows:
                table = table.append_column(n, pa.array(out[n], from_pandas=True))
            return table.combine_chunks().to_batches(SPLINE_ROWS // 8)

        rest, rows, due = [], 0, SPLINE_ROWS
        for batch in batches:
            rest.append(batch)
            rows += batch.num_rows
            if rows < due:
                continue
            table = pa.Table.from_batches(rest)
            cut = int(np.flatnonzero(table.column(pos).to_numpy() == start)[-1])
            if cut:
                yield from filled(table.slice(0, cut))
            rest = table.slice(cut).to_batches()
            rows -= cut
            due = max(SPLINE_ROWS, 2 * rows)
        if rows:
            yield from filled(pa.Table.from_batches(rest))

    return df.sortWithinPartitions(*keys, pos).mapInArrow(run, schema)


def series_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, method: str) -> DataFrame:
    """What `neighbour_columns` adds, and ``_pos`` (from 1) and ``_known`` (of the group), for groups of any size.

    A range partitioned sort by keys and order cuts groups into blocks, whatever their size. The sorted rows are written once. Each block of a
    group is summed up by its number of rows and its first and last known points; a scan of those sums, a row a block, gives every
    block its place and the points before and after it. The rest happens within blocks.
    """
    reach = METHODS[method]
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # The upper bits of this number are the partition, the lower ones count its rows.
    rows = stored(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    block = [*keys, "_part"]
    known = F.col(value).isNotNull()
    sums = rows.groupBy(*block).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"), F.count(value).alias("_k"))
    ends = rows.filter(known)
    for name, way in (("_first", F.col("_at").asc()), ("_last", F.col("_at").desc())):
        ends = ends.withColumn(name, F.row_number().over(Window.partitionBy(*block).orderBy(way)) <= reach)
    point = F.struct(F.col("_at"), F.col(value).alias("val"))
    ends = ends.filter("_first OR _last").groupBy(*block).agg(
        F.array_sort(F.collect_list(F.when(F.col("_first"), point))).alias("_firsts"),
        F.array_sort(F.collect_list(F.when(F.col("_last"), point))).alias("_lasts"),
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in block]
    placed = carried(sums.alias("a").join(ends.alias("b"), same, "left").select("a.*", "_firsts", "_lasts"), keys, "_part", reach)
    scan = placed.select(*block, "_shift", "_known", "_k", "_past", "_coming")
    joined = rows.alias("a").join(stored(scan).alias("b"), same).select("a.*", "_shift", "_known", "_k", "_past", "_coming")
    joined = joined.withColumn("_pos", F.col("_at") + F.col("_shift") + 1)
    window = f"PARTITION BY {', '.join(block)} ORDER BY _at"
    near = neighbour_columns(joined, window, "_pos", value, method)
    seen = near.withColumn("_upto", known_so_far(window, value))
    return with_carried(seen, value, reach).drop("_at", "_part", "_shift", "_past", "_coming", "_k", "_upto")


def known_so_far(window: str, value: str) -> Column:
    """The number of known points up to each row of a block.

    What is ahead of a row is the rest of its block's: a frame that ends with the block would be counted anew for each row.
    """
    return F.expr(f"count({value}) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def carried(sums: DataFrame, keys: Sequence[str], part: str, reach: int) -> DataFrame:
    """A scan of blocks: what to add to a block's row numbers, the known points of its group, and the points before and after the block.

    ``sums`` holds a row for each block ``part`` of a group, with its lowest row number ``_low``, its rows ``_n`` and known points ``_k``, and the
    first and last of these in ``_firsts`` and ``_lasts``, as arrays of row number ``_at`` and value ``val``.
    """
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(part)
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")
    placed = sums.withColumns({"_shift": shift, "_known": F.sum("_k").over(group)})

    def moved(points: str) -> Column:
        """Points with their places in the group."""
        return F.transform(points, lambda p: F.struct((p["_at"] + F.col("_shift") + 1).alias("pos"), p["val"].alias("val")))

    placed = placed.withColumns({"_firsts": moved("_firsts"), "_lasts": moved("_lasts")})
    if reach == 1:
        found = F.array(F.last(F.get("_lasts", F.lit(0)), True).over(before)), F.array(F.first(F.get("_firsts", F.lit(0)), True).over(after))
    else:
        past, coming = F.flatten(F.collect_list("_lasts").over(before)), F.flatten(F.collect_list("_firsts").over(after))
        found = F.slice(past, F.greatest(F.size(past) - reach + 1, F.lit(1)), reach), F.slice(coming, 1, reach)
    return placed.withColumns({"_past": found[0], "_coming": found[1]}).drop("_low", "_n", "_firsts", "_lasts")


def with_carried(seen: DataFrame, value: str, reach: int) -> DataFrame:
    """`neighbour_columns` of blocks, completed by the points carried over from their neighbours. ``_k`` counts a block's known points."""
    # How many known points the block has before and after each row; the others are carried over.
    behind = F.col("_upto") - F.col(value).isNotNull().cast("int")
    seen = seen.withColumns({"_behind": behind, "_ahead": F.col("_k") - F.col("_upto")})
    found = {}
    for k in range(1, reach + 1):
        for part in ("pos", "val"):
            # Never 0: a block that has seen k points needs none of the carried ones.
            back = F.least(F.col("_behind") - k, F.lit(-1)).cast("int")
            on = F.greatest(k - F.col("_ahead"), F.lit(1)).cast("int")
            found[f"_p{k}_{part}"] = F.coalesce(F.col(f"_p{k}_{part}"), F.when(F.col("_behind") < k, F.try_element_at("_past", back)[part]))
            found[f"_n{k}_{part}"] = F.coalesce(F.col(f"_n{k}_{part}"), F.when(F.col("_ahead") < k, F.try_element_at("_coming", on)[part]))
    return seen.withColumns(found).drop("_behind", "_ahead")


def fill_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    method: str = "linear",
    min_points: int = 0,
    output: str = "filled",
) -> DataFrame:
    """`fill_gaps` for groups of any size, such as all days of a site: no task gathers a group.

    ``order`` should tell the rows of a group apart, or equal ones stand in any order. The spline, which needs a whole group, isn't offered.
    """
    if METHODS.get(method, 0) == 0:
        raise ValueError(f"unknown fill method {method!r} for series, choose one of {[m for m, n in METHODS.items() if n]}")
    near = series_neighbours(df, keys, order, value, method).filter(F.col("_known") >= min_points)
    return with_filled(near, "_pos", value, {output: None}, method).select(*df.columns, output)


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    method: str = "linear",
    min_points: int = 0,
    output: str = "filled",
) -> DataFrame:
    """Fill ``value`` within each group of ``keys``, ordered by ``order``.

    Groups with fewer than ``min_points`` known values are dropped. Choose keys that bound the group, such
    as site and season year rather than site alone; `fill_series` takes groups of any size.
    """
    if method not in METHODS:
        raise ValueError(f"unknown fill method {method!r}, choose one of {list(METHODS)}")
    window = f"PARTITION BY {', '.join(keys)} ORDER BY {order}"
    rows = df.withColumn("_pos", F.expr(f"row_number() OVER ({window})"))
    if min_points > 0:
        whole = f"({window} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        rows = rows.withColumn("_known", F.expr(f"count({value}) OVER {whole}")).filter(F.col("_known") >= min_points)
    if method == "spline":
        return with_spline(rows, keys, "_pos", value, {output: None}, start=1).select(*df.columns, output)
    near = neighbour_columns(rows, f"PARTITION BY {', '.join(keys)} ORDER BY _pos", "_pos", value, method)
    return with_filled(near, "_pos", value, {output: None}, method).select(*df.columns, output)
