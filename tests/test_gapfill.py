import math
import random

import numpy as np
import pytest

from phenoline.functions.splines import fill_spline
from phenoline.operators.gapfill import fill_gaps, fill_series


def series(spark, *groups):
    rows = [(g, i, v) for g, values in enumerate(groups) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g int, i int, v double")


def filled(df, **options):
    rows = fill_gaps(df, ["g"], "i", "v", **options).orderBy("g", "i").collect()
    out = {}
    for r in rows:
        out.setdefault(r["g"], []).append(r["filled"])
    return out


def linear(values):
    """Plain loop to compare with."""
    known = [i for i, v in enumerate(values) if v is not None]
    out = []
    for i, v in enumerate(values):
        before = [k for k in known if k <= i]
        after = [k for k in known if k >= i]
        if v is not None:
            out.append(v)
        elif not known:
            out.append(None)
        elif not before:
            out.append(values[after[0]])
        elif not after:
            out.append(values[before[-1]])
        else:
            a, b = before[-1], after[0]
            out.append((values[b] - values[a]) / (b - a) * (i - a) + values[a])
    return out


def test_linear_golden(spark):
    assert filled(series(spark, [None, 1.0, None, None, 4.0, None]))[0] == [1, 1, 2, 3, 4, 4]


def test_linear_against_a_loop(spark):
    rng = random.Random(1)
    groups = [[rng.choice([None, None, round(rng.uniform(-9, 9), 2)]) for _ in range(40)] for _ in range(30)]
    for parts in (1, 17):
        got = filled(series(spark, *groups).repartition(parts))
        for g, values in enumerate(groups):
            assert got[g] == linear(values)


def test_quadratic_is_exact_on_a_parabola(spark):
    curve = [float(i * i) for i in range(12)]
    holes = [v if i in (2, 5, 6, 9) else None for i, v in enumerate(curve)]
    assert filled(series(spark, holes), method="quadratic")[0] == pytest.approx(curve)


def test_quadratic_falls_back_to_linear_below_three_points(spark):
    values = [None, 1.0, None, 3.0, None]
    assert filled(series(spark, values), method="quadratic")[0] == [1, 1, 2, 3, 3]


def test_min_points_and_known_values(spark):
    got = filled(series(spark, [1.0, None, 3.0], [1.0, None, None]), min_points=2)
    assert got == {0: [1.0, 2.0, 3.0]}
    assert filled(series(spark, [None, None]))[0] == [None, None]
    with pytest.raises(ValueError):
        fill_gaps(series(spark, [1.0]), ["g"], "i", "v", method="cubic")


def test_spline_groups(spark):
    rng = random.Random(6)
    groups = [[None if rng.random() < 0.3 else 20 * math.sin(i / 11) + rng.uniform(-4, 4) for i in range(n)] for n in (60, 3, 41, 90, 1)]
    got = filled(series(spark, *groups).repartition(7), method="spline")
    for g, values in enumerate(groups):
        want = fill_spline(np.array([np.nan if v is None else v for v in values], float))
        assert got[g] == pytest.approx([None if np.isnan(w) else w for w in want])


@pytest.mark.parametrize("method", ["linear", "quadratic"])
def test_series_equal_the_window_form(spark, method):
    """Small groups, empty ones, null keys, and one that lies in many blocks, some without a known point."""
    rng = random.Random(3)
    rows = [(None if g == 3 else g, i, rng.choice([None, None, float(rng.randint(-50, 50))])) for g in range(40) for i in range(rng.randint(1, 9))]
    rows += [(99, i, float(rng.randint(-50, 50)) if i % 1900 in (3, 4, 900) else None) for i in range(9000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, v double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        got = sorted((tuple(r) for r in fill_series(df, ["g"], ["i"], "v", method).collect()), key=key)
        want = sorted((tuple(r) for r in fill_gaps(df, ["g"], "i", "v", method).collect()), key=key)
        few = fill_series(df, ["g"], ["i"], "v", method, min_points=4)
        assert few.select("g").distinct().count() == fill_gaps(df, ["g"], "i", "v", method, min_points=4).select("g").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == [r[3] if r[3] is None else pytest.approx(r[3]) for r in want]


def test_series_arguments(spark):
    with pytest.raises(ValueError):
        fill_series(series(spark, [1.0]), ["g"], ["i"], "v", method="spline")
    assert fill_series(series(spark), ["g"], ["i"], "v").count() == 0


@pytest.mark.parametrize("method", ["linear", "quadratic"])
def test_no_window_of_a_series_is_counted_anew_for_each_row(spark, method):
    rows = spark.createDataFrame([("a", k, float(k * k) if k % 3 else None) for k in range(60)], "k string, t int, v double")
    made = fill_series(rows, ["k"], ["t"], "v", method)
    assert "specifiedwindowframe(RowFrame, 1, unboundedfollowing$())" not in made._jdf.queryExecution().optimizedPlan().toString()
    # By groups, as one window.
    assert sorted(made.collect()) == sorted(fill_gaps(rows, ["k"], "t", "v", method).collect())
