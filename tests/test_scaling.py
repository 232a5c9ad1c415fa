import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoline.operators import scaling
from phenoline.operators.scaling import CustomScaler, apply_scalers, fit_scalers, invert_scalers

ARRAYS = [[1.0, 5.0], [], [2.5, -3.0, 4.0], [0.0]]
SCALARS = [3.0, -7.0, 12.5, 0.25]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, a, s, 4.0) for i, (a, s) in enumerate(zip(ARRAYS, SCALARS))]
    return spark.createDataFrame(rows, "i int, a array<double>, s double, c double").repartition(3)


def column(df, name):
    return [r[0] for r in df.orderBy("i").select(name).collect()]


def expected(kind, values):
    v = np.array(values)
    if kind == "minmax":
        return lambda x: (x - v.min()) / (v.max() - v.min()) * 2 - 1
    if kind == "standard":
        return lambda x: (x - v.mean()) / v.std()
    if kind == "maxabs":
        return lambda x: x / np.abs(v).max()
    low, high = np.quantile(v, [0.05, 0.95])
    return lambda x: (x - np.median(v)) / (high - low)


@pytest.mark.parametrize("kind", scaling.KINDS)
def test_kinds_on_scalars_and_arrays(df, kind):
    config = {c: {"kind": kind, "quantile_range": (5, 95)} for c in ("a", "s")}
    fitted = fit_scalers(df, config)
    scaled = apply_scalers(df, fitted)
    scalar, items = expected(kind, SCALARS), expected(kind, [x for a in ARRAYS for x in a])
    assert column(scaled, "s") == pytest.approx([scalar(x) for x in SCALARS])
    for got, a in zip(column(scaled, "a"), ARRAYS):
        assert got == pytest.approx([items(x) for x in a])
    back = invert_scalers(scaled, fitted)
    assert column(back, "s") == pytest.approx(SCALARS)
    assert [list(a) for a in column(back, "a")] == [pytest.approx(a) for a in ARRAYS]


def test_constant_column_and_feature_range(df):
    for kind in ("minmax", "standard", "robust"):
        assert fit_scalers(df, {"c": {"kind": kind}})["c"].scale in (1.0, 0.5)
    scaled = apply_scalers(df, fit_scalers(df, {"c": {"kind": "minmax"}, "s": {"kind": "minmax", "feature_range": (0, 10)}}))
    assert column(scaled, "c") == [-1.0] * 4
    assert min(column(scaled, "s")) == 0 and max(column(scaled, "s")) == 10


def test_nan_is_missing(spark):
    df = spark.createDataFrame([([1.0, float("nan")], float("nan")), ([3.0], 2.0)], "a array<double>, s double")
    fitted = fit_scalers(df, {"a": {"kind": "minmax"}, "s": {"kind": "maxabs"}})
    assert (fitted["a"].center, fitted["a"].scale, fitted["s"].scale) == (1.0, 1.0, 2.0)


def test_custom_scaler(df):
    kind = CustomScaler(
        lambda v: {"low": F.min(v), "n": F.count(v)}, lambda row: (row["low"], float(row["n"]), 0.0)
    )
    fitted = fit_scalers(df, {"s": {"kind": kind}})
    assert column(apply_scalers(df, fitted), "s") == pytest.approx([(x + 7) / 4 for x in SCALARS])


def test_options_are_checked(df):
    for config in ({"kind": "cubic"}, {"kind": "robust", "quantile_range": (90, 10)}, {"feature_range": (1, -1)}):
        with pytest.raises(ValueError):
            fit_scalers(df, {"s": config})
    with pytest.raises(ValueError, match="minmax.*standard.*robust.*maxabs"):
        fit_scalers(df, {"s": {"kind": "other"}})
    assert fit_scalers(df, {"s": {"kind": "MinMax"}})["s"].kind == "minmax"


def test_table_round_trip(spark, df):
    fitted = fit_scalers(df, {"s": {"kind": "standard"}, "a": {"kind": "minmax"}})
    assert scaling.scalers_from_table(scaling.scalers_to_table(spark, fitted)) == fitted


def test_applying_needs_no_shuffle(df):
    plan = apply_scalers(df, fit_scalers(df, {"a": {}, "s": {}}))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_unknown_options_are_rejected(spark):
    with pytest.raises(ValueError, match="quantile_rang"):
        scaling.fit_scalers(spark.createDataFrame([(1.0,)], "x double"), {"x": {"kind": "robust", "quantile_rang": (5, 95)}})


def plain_quantile(values, n, x):
    """Shares by interpolation from both sides, as repeated knots ask for."""
    knots, shares = np.quantile(values, np.linspace(0, 1, n)), np.linspace(0, 1, n)
    out = (np.interp(x, knots, shares) - np.interp(-np.asarray(x), -knots[::-1], -shares[::-1])) / 2
    out[np.asarray(x) <= knots[0]], out[np.asarray(x) >= knots[-1]] = 0, 1
    return out


@pytest.mark.parametrize("n", [2, 5, 100])
def test_quantile_family(spark, n):
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.exponential(3, 300), [1.0] * 60, [2.5] * 25]).round(2)
    df = spark.createDataFrame([(i, float(v), [float(v), None]) for i, v in enumerate(values)], "i int, s double, a array<double>").repartition(3)
    fitted = fit_scalers(df, {c: {"kind": "Quantile", "n_quantiles": n} for c in ("s", "a")})
    fitted = scaling.scalers_from_table(scaling.scalers_to_table(spark, fitted))
    scaled = apply_scalers(df, fitted)
    want = plain_quantile(values, n, values)
    assert column(scaled, "s") == pytest.approx(want)
    assert [a for a, _ in column(scaled, "a")] == pytest.approx(want) and {b for _, b in column(scaled, "a")} == {None}
    back = np.array(column(invert_scalers(scaled, fitted), "s"))
    assert back == pytest.approx(np.interp(want, np.linspace(0, 1, n), np.quantile(values, np.linspace(0, 1, n))))
    if n == 100:
        assert np.abs(back - values)[values < 8] == pytest.approx(0, abs=1e-9)
    beyond = spark.createDataFrame([(0, -5.0), (1, 1e9), (2, None)], "i int, s double")
    assert column(apply_scalers(beyond, {"s": fitted["s"]}), "s") == [0.0, 1.0, None]


def test_constant_quantiles_and_symlog(spark, df):
    fitted = fit_scalers(df, {"c": {"kind": "quantile", "n_quantiles": 4}, "s": {"kind": "symlog", "unit": 2.0}, "a": {"kind": "symlog"}})
    scaled = apply_scalers(df, fitted)
    assert column(scaled, "c") == [0.5] * 4
    assert column(scaled, "s") == pytest.approx([np.sign(x) * np.log1p(abs(x) / 2) for x in SCALARS])
    back = invert_scalers(scaled, fitted)
    assert column(back, "s") == pytest.approx(SCALARS) and column(back, "c") == [4.0] * 4
    assert [list(a) for a in column(back, "a")] == [pytest.approx(a) for a in ARRAYS]


def test_own_family(spark, df):
    from phenoline.operators import families

    square = families.Family(lambda values, options: [options.get("shift", 0.0)], lambda v, p: (v + p[0]) ** 2, lambda v, p: F.sqrt(v) - p[0], ("shift",))
    families.register_family("square", square)
    try:
        fitted = fit_scalers(df, {"s": {"kind": "square", "shift": 10.0}})
        table = scaling.scalers_to_table(spark, fitted)
        scaled = apply_scalers(df, scaling.scalers_from_table(table))
        assert column(scaled, "s") == pytest.approx([(x + 10) ** 2 for x in SCALARS])
        assert column(invert_scalers(scaled, fitted), "s") == pytest.approx(SCALARS)
    finally:
        del families.FAMILIES["square"]
    with pytest.raises(ValueError, match="square"):
        apply_scalers(df, fitted)
    old = table.drop("parameters").withColumn("kind", F.lit("standard"))
    assert scaling.scalers_from_table(old)["s"].parameters == ()
    for options in ({"kind": "quantile", "n_quantiles": 1}, {"kind": "symlog", "unit": 0}):
        with pytest.raises(ValueError):
            fit_scalers(df, {"s": options})
