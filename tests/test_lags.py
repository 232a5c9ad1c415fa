"""Lagged products against materialised windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoline.operators.lags import fit_lag_readouts, lag_names, lag_products, lagged_sums, predict_from_lags
from phenoline.operators.readout import fit_readouts
from phenoline.operators.windows import lag_windows


def table(spark, seed=1, sizes=(40, 3, 25, 7, 60), nulls=0.0):
    rng = random.Random(seed)
    rows = [(g, i, rng.uniform(-3, 3), rng.uniform(0, 5), None if rng.random() < nulls else rng.uniform(-1, 1)) for g, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "g int, t int, a double, b double, y double").repartition(5)


def plain_sums(rows, n_in):
    """rows: (a, b, y) of one sequence, None for a missing number."""
    size = 1 + 2 * n_in
    out = np.zeros((size, size + 1))
    for t in range(n_in, len(rows)):
        part = rows[t - n_in : t + 1]
        if any(v is None for r in part for v in r):
            continue
        z = [1.0, *[part[n_in - i][0] for i in range(1, n_in + 1)], *[part[n_in - i][1] for i in range(1, n_in + 1)]]
        out += np.outer(z, [*z, part[n_in][2]])
    return out


def test_sums_of_one_sequence():
    rng = np.random.default_rng(2)
    for n, n_in in ((30, 5), (6, 5), (5, 5), (1, 3), (12, 1)):
        x, y = rng.standard_normal((n, 2)), rng.standard_normal((n, 1))
        want = plain_sums(np.hstack([x, y]).tolist(), n_in)
        assert lagged_sums(x, y, n_in) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("block, nulls", [(4096, 0.0), (8, 0.0), (9, 0.05)])
def test_products(spark, block, nulls):
    n_in = 4
    df = table(spark, nulls=nulls)
    want = np.zeros((1 + 2 * n_in, 2 + 2 * n_in))
    rows = df.orderBy("g", "t").collect()
    for g in {r.g for r in rows}:
        want += plain_sums([(r.a, r.b, r.y) for r in rows if r.g == g], n_in)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = np.zeros_like(want)
        for r in lag_products(df, ["g"], "t", ["a", "b"], ["y"], n_in, block).collect():
            got[r.i, r.j] = r.value
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(want, abs=1e-8)


def test_weights_equal_those_of_windows(spark):
    df, n_in = table(spark, sizes=(90, 50, 70)), 6
    wide = lag_windows(df, ["g"], "t", ["a", "b"], n_in)
    names = lag_names(["a", "b"], n_in)
    columns = {f"{v}_lag_{i}": F.element_at(f"past_{v}", -i) for v in ("a", "b") for i in range(1, n_in + 1)}
    wide = wide.withColumns({"bias": F.lit(1.0), **columns})
    want = fit_readouts(wide, names, ["y"], [0.1, 10.0])
    got = fit_lag_readouts(df, ["g"], "t", ["a", "b"], ["y"], n_in, [0.1, 10.0])
    for w, g in zip(want, got):
        assert g.features == w.features and g.weights["y"] == pytest.approx(w.weights["y"], abs=1e-8)
    made = predict_from_lags(df, ["g"], "t", ["a", "b"], got[0], {"y": "p"}, n_in).orderBy("g", "t").collect()
    rows = wide.orderBy("g", "t").collect()
    assert [r.p for r in made] == pytest.approx([sum(w * r[n] for w, n in zip(got[0].weights["y"], names)) for r in rows])


def test_arguments(spark):
    with pytest.raises(ValueError):
        lag_products(table(spark), ["g"], "t", ["a"], ["y"], n_in=0)
    with pytest.raises(ValueError):
        fit_lag_readouts(table(spark, sizes=(3,)), ["g"], "t", ["a"], ["y"], n_in=5)
