"""Ridge readouts on lagged values, fitted from sums of lagged products; the rows of lagged features are never made.

With c columns and n_in lags a materialised row has c * n_in values and its square of products c^2 n_in^2. But the product of lags i and i + d
depends on the place only through i, so for each d one running sum over the sequence, read at n_in places, gives all its squares:
the matrix is block-Toeplitz but for the sequence's ends. One pass takes n * c^2 * n_in steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoline.operators.readout import Readout, solve_ridge
from phenoline.operators.windows import in_blocks, lag_windows


def lagged_sums(x: np.ndarray, y: np.ndarray, n_in: int) -> np.ndarray:
    """Sums over t >= n_in of z z' and z y', where z is 1 and then, column by column, the values 1 to n_in steps before t.

    Returns the square of z beside the products with y, and in the last place the number of rows t.
    """
    n, c = x.shape
    size = 1 + c * n_in
    out = np.zeros((size, size + y.shape[1]))
    if n <= n_in:
        return out
    gram = out[:, :size]
    # blocks[a, i, b, j]: column a at lag i + 1 with column b at lag j + 1.
    blocks = np.zeros((c, n_in, c, n_in))
    for d in range(n_in):
        running = np.zeros((n - d + 1, c, c))
        np.cumsum(x[d:, :, None] * x[: n - d, None, :], axis=0, out=running[1:])
        i = np.arange(n_in - d)
        part = running[n - 1 - i - d] - running[n_in - 1 - i - d]
        blocks[:, i, :, i + d] = part
        blocks[:, i + d, :, i] = part.transpose(0, 2, 1)
    gram[1:, 1:] = blocks.reshape(size - 1, size - 1)
    gram[0, 0] = n - n_in
    target = y[n_in:]
    out[0, size:] = target.sum(0)
    for i in range(n_in):
        past = x[n_in - 1 - i : n - 1 - i]
        at = 1 + np.arange(c) * n_in + i
        gram[0, at] = gram[at, 0] = past.sum(0)
        out[at, size:] = past.T @ target
    return out


def lag_names(values: Sequence[str], n_in: int) -> list[str]:
    """``bias`` and then, value by value, ``<value>_lag_<i>``."""
    return ["bias", *[f"{v}_lag_{i}" for v in values for i in range(1, n_in + 1)]]


def lag_products(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    values: Sequence[str],
    targets: Sequence[str],
    n_in: int = 30,
    block: int = 4096,
) -> DataFrame:
    """(i, j, value): sums of products of ``lag_names`` (i) with ``lag_names`` and ``targets`` (j), over all rows with whole histories.

    ``step`` counts 0, 1, 2, ... within each key. Rows whose history or target holds a null are left out, as are steps behind a missing one.
    Long sequences are cut into blocks that overlap by ``n_in`` rows, so a key may hold any share of the rows; a task streams
    through its blocks with ``n_in`` rows in hand and sends one square of sums.
    """
    if n_in < 1 or block < n_in:
        raise ValueError(f"need 1 <= n_in <= block, got n_in={n_in}, block={block}")
    c, m = len(values), len(targets)
    size = 1 + c * n_in
    numbers = [F.col(v).cast("double").alias(f"c_{i}") for i, v in enumerate([*values, *targets])]
    names = [f"k_{i}" for i in range(len(keys))]
    place = [F.xxhash64(*keys).alias("key"), F.col("_block").cast("long").alias("block"), F.col(step).cast("long").alias("step")]
    rows = in_blocks(df, step, n_in, block).select(*place, *[F.col(k).alias(n) for k, n in zip(keys, names)], *numbers)
    rows = rows.repartition(*names, "block").sortWithinPartitions(*names, "block", "step").drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size + m)), False
        # The end of the last batch's last run: its last rows, and the place they reach to.
        held, last = np.zeros((0, c + m)), None
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            place = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            data = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 3 + c + m)])
            whole = ~np.isnan(data).any(1)
            before = np.vstack([place[:1] - 1 if last is None else last[None], place[:-1]])
            goes_on = (place[:, :2] == before[:, :2]).all(1) & (place[:, 2] == before[:, 2] + 1)
            starts = np.flatnonzero(~goes_on | ~whole | np.concatenate([[False], ~whole[:-1]]))
            if not len(held):
                starts = np.union1d(starts, [0])
            bounds = [0, *starts[starts > 0].tolist(), len(data)]
            for a, b in zip(bounds, bounds[1:]):
                part = data[a:b]
                if a == 0 and 0 not in starts:
                    part = np.vstack([held, part])
                part = part[~np.isnan(part).any(1)]
                total += lagged_sums(part[:, :c], part[:, c:], n_in)
            last = place[-1]
            held = part[-n_in:]
        if seen:
            at = np.arange(size * (size + m))
            yield pa.RecordBatch.from_arrays([pa.array(at // (size + m)), pa.array(at % (size + m)), pa.array(total.ravel())], names=["i", "j", "value"])

    return rows.mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def fit_lag_readouts(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    values: Sequence[str],
    targets: Sequence[str],
    n_in: int = 30,
    alphas: Sequence[float] = (1.0,),
) -> list[Readout]:
    """`fit_readouts` on ``lag_names``, for every alpha; the driver gets one square of sums, whose size the arguments fix."""
    size = 1 + len(values) * n_in
    square = np.zeros((size, size + len(targets)))
    for r in lag_products(df, keys, step, values, targets, n_in).collect():
        square[r["i"], r["j"]] = r["value"]
    if square[0, 0] == 0:
        raise ValueError("no row has a whole history to fit on")
    return solve_ridge(square, lag_names(values, n_in), targets, alphas)


def predict_from_lags(
    df: DataFrame, keys: Sequence[str], step: str, values: Sequence[str], model: Readout, outputs: dict[str, str], n_in: int = 30
) -> DataFrame:
    """Predictions of the rows that have a whole history. ``outputs`` names the prediction column of each target."""
    rows = lag_windows(df, keys, step, values, n_in)

    def predicted(target: str) -> Column:
        weights = model.weights[target]
        total = F.lit(weights[0])
        for k, v in enumerate(values):
            # Histories run from the oldest to the newest value, weights from the first lag.
            own = F.array(*[F.lit(w) for w in reversed(weights[1 + k * n_in : 1 + (k + 1) * n_in])])
            products = F.zip_with(F.col(f"past_{v}"), own, lambda a, w: a.cast("double") * w)
            total = total + F.aggregate(products, F.lit(0.0), lambda s, p: s + p)
        return total

    made = rows.withColumns({name: predicted(t) for t, name in outputs.items()})
    return made.drop(*[f"past_{v}" for v in values])
