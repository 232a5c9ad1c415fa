import random

import numpy as np
import pytest

from phenoline.operators.readout import fit_lines, fit_readouts, predict


@pytest.fixture(scope="module")
def data():
    rng = random.Random(6)
    x = [[1.0, rng.gauss(0, 1), rng.gauss(3, 2)] for _ in range(200)]
    y = [[2 * a + 3 * b - c + rng.gauss(0, 0.1), b - 4] for a, b, c in x]
    return np.array(x), np.array(y)


def test_ridge_against_numpy(spark, data):
    x, y = data
    rows = [tuple(map(float, [*a, *b])) for a, b in zip(x, y)] + [(1.0, None, 2.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "one double, b double, c double, u double, v double").repartition(7)
    models = fit_readouts(df, ["one", "b", "c"], ["u", "v"], [0.0, 5.0])
    for model in models:
        want = np.linalg.solve(x.T @ x + model.alpha * np.eye(3), x.T @ y)
        got = np.array([model.weights["u"], model.weights["v"]]).T
        assert got == pytest.approx(want, rel=1e-8)
    made = predict(df.dropna(), dict(enumerate(models, start=1)), {"u": "pu"})
    assert made.count() == 400
    row = made.filter("sim_id = 2").first()
    assert row.pu == pytest.approx(sum(w * f for w, f in zip(models[1].weights["u"], (row.one, row.b, row.c))))


def test_fit_lines(spark):
    df = spark.createDataFrame([(k, float(i), 2.0 * i + k) for k in (1, 2) for i in range(5)], "k int, x double, y double")
    got = {r.k: (r.slope, r.intercept, r.n) for r in fit_lines(df, ["k"], "x", "y").collect()}
    assert got[1] == pytest.approx((2, 1, 5)) and got[2] == pytest.approx((2, 2, 5))


def test_arguments(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    with pytest.raises(ValueError):
        fit_readouts(df, ["x"], ["y"])
    with pytest.raises(ValueError):
        fit_readouts(df, [], ["y"])


def test_more_features_than_rows_of_a_small_model(spark):
    rng = np.random.default_rng(4)
    x, true = rng.normal(size=(300, 40)), rng.normal(size=40)
    names = [f"f{i}" for i in range(40)]
    data = [(*map(float, row), float(row @ true)) for row in x]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in [*names, "y"]))
    (model,) = fit_readouts(df, names, ["y"], [1e-9])
    assert np.allclose(model.weights["y"], true)
