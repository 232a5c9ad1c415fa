"""The smoothing spline against a plain computation by scalar loops and orthogonal factors."""

import numpy as np
import pytest

from phenoline.functions import splines
from phenoline.functions.splines import basis, fill_linear, fill_spline, jumps, smoothing_spline


def one_spline(knots, k, i, x, last):
    """The i-th B-spline at x, by its definition."""
    if k == 0:
        inside = knots[i] <= x < knots[i + 1]
        return 1.0 if inside or (last and knots[i] < x == knots[i + 1] == knots[-1]) else 0.0
    out = 0.0
    if knots[i + k] > knots[i]:
        out += (x - knots[i]) / (knots[i + k] - knots[i]) * one_spline(knots, k - 1, i, x, last)
    if knots[i + k + 1] > knots[i + 1]:
        out += (knots[i + k + 1] - x) / (knots[i + k + 1] - knots[i + 1]) * one_spline(knots, k - 1, i + 1, x, last)
    return out


def plain_matrix(knots, k, x):
    return np.array([[one_spline(knots, k, i, v, True) for i in range(len(knots) - k - 1)] for v in x])


def points(seed, n=120, share=0.7, noise=2.0, scale=10.0):
    rng = np.random.default_rng(seed)
    x = np.flatnonzero(rng.random(n) < share).astype(float)
    return x, scale * np.sin(x / 15) + noise * rng.standard_normal(len(x))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_basis(k):
    x, _ = points(1, 40)
    knots = np.concatenate([[x[0]] * (k + 1), x[[4, 9, 10, 17]], [x[-1]] * (k + 1)])
    first, values = basis(knots, k, x)
    dense = np.zeros((len(x), len(knots) - k - 1))
    for row, (f, v) in enumerate(zip(first, values)):
        dense[row, f : f + k + 1] = v
    assert dense == pytest.approx(plain_matrix(knots, k, x), abs=1e-12)


def test_jumps_are_those_of_the_derivative():
    k, knots = 2, np.array([0.0, 0, 0, 3, 4, 9, 12, 12, 12])
    made = jumps(knots, k)

    def jump(i, at):
        # The second derivative is constant between knots.
        def second(x):
            return sum(w * one_spline(knots, k, i, x + d, False) for w, d in ((1, -0.1), (-2, 0), (1, 0.1))) / 0.01

        return second(at + 0.3) - second(at - 0.3)

    for row, at in enumerate([3.0, 4.0, 9.0]):
        for i in range(len(knots) - k - 1):
            assert made[row, i] / made[0, 0] == pytest.approx(jump(i, at) / jump(0, 3.0), abs=1e-8)


@pytest.mark.parametrize("seed", range(8))
def test_least_squares_and_smoothing(seed):
    """On the knots found, the weights minimise residuals plus weighted jumps, and the residuals keep to the bound."""
    x, y = points(seed, noise=[0.1, 0.5, 1.5, 3][seed % 4])
    spline = smoothing_spline(x, y)
    residual = float(((spline(x) - y) ** 2).sum())
    a = plain_matrix(spline.knots, 2, x)
    rough = jumps(spline.knots, 2)
    if len(spline.knots) == 6:
        assert residual <= len(x) * 1.001
        assert spline.weights == pytest.approx(np.linalg.lstsq(a, y, rcond=None)[0], rel=1e-6)
        return
    assert residual == pytest.approx(len(x), rel=1.1e-3)

    def fitted(p):
        return np.linalg.lstsq(np.vstack([a, rough / p]), np.concatenate([y, np.zeros(len(rough))]), rcond=None)[0]

    # The weight that gives this residual, by bisection.
    low, high = 1e-9, 1e9
    for _ in range(200):
        mid = np.sqrt(low * high)
        if ((a @ fitted(mid) - y) ** 2).sum() > residual:
            low = mid
        else:
            high = mid
    grid = np.linspace(x[0] - 3, x[-1] + 3, 50)
    want = plain_matrix(spline.knots, 2, x) @ fitted(high)
    assert spline(x) == pytest.approx(want, abs=1e-6 * np.abs(y).max())
    assert np.isfinite(spline(grid)).all()


def test_knots_lie_on_points_until_there_are_as_many():
    x, y = points(3, noise=2.0)
    knots = smoothing_spline(x, y).knots[3:-3]
    assert set(knots) <= set(x)
    x, y = points(3, noise=400.0)
    knots = smoothing_spline(x, y).knots[3:-3]
    assert knots.tolist() == ((x[1:-2] + x[2:-1]) / 2).tolist()


def test_a_parabola_is_met_exactly():
    x = np.array([0, 1, 3, 4, 7, 9, 12.0])
    spline = smoothing_spline(x, 2 + 3 * x - x * x)
    at = np.arange(-2, 16.0)
    assert len(spline.knots) == 6 and spline(at) == pytest.approx(2 + 3 * at - at * at)


def test_gaps():
    nan = np.nan
    assert fill_spline(np.array([nan, 1.0, nan, 3.0, nan])).tolist() == [1, 1, 2, 3, 3]  # two points: lines
    assert fill_linear(np.array([nan, 1.0, nan, nan, 4.0, nan])).tolist() == [1, 1, 2, 3, 4, 4]
    assert np.isnan(fill_spline(np.array([nan, nan]))).all()
    values = np.array([float(i * i) if i % 3 else nan for i in range(20)])
    assert fill_spline(values) == pytest.approx([i * i for i in range(20)], abs=1e-8)
    assert fill_spline(np.array([1.0, nan, np.inf, 3.0, nan, 5.0])).tolist()[0] == 1.0
    with pytest.raises(ValueError):
        smoothing_spline(np.array([0.0, 1.0]), np.array([0.0, 1.0]))


@pytest.mark.parametrize("side_by_side", [1, 7, 512])
def test_splines_side_by_side_are_those_fitted_alone(monkeypatch, side_by_side):
    """All lengths and bounds: polynomials, few knots, knots on all points, interpolation, and series that no spline is fitted to."""
    rng = np.random.default_rng(3)
    many = []
    for share in (0.05, 0.3, 0.9):
        for noise in (0.0, 0.5, 1.5, 400.0):
            for n in (1, 4, 6, 9, 30, 120, 240):
                curve = 10 * np.sin(np.arange(n) / 15) + noise * rng.standard_normal(n)
                many += [np.where(rng.random(n) < share, curve, np.nan), np.where(rng.random(n) < share, 1e5 * rng.random(n), np.nan)]
    many += [np.array([1.0, np.nan, np.inf, 3.0, np.nan, 5.0]), np.full(5, np.nan), np.array([]), np.arange(4.0)]
    want = [fill_spline(v) for v in many]
    alone = []
    monkeypatch.setattr(splines, "SIDE_BY_SIDE", side_by_side)
    monkeypatch.setattr(splines, "fill_spline", lambda v, k=2: alone.append(v) or fill_spline(v, k))
    got = splines.fill_splines(many)
    for g, w, v in zip(got, want, many):
        assert g == pytest.approx(w, rel=1e-6, abs=1e-6 * np.nanmax(np.abs(v), initial=1.0), nan_ok=True)
    # Only series without gaps or with too few or infinite values go alone.
    assert all((~np.isnan(v)).sum() <= 2 or not np.isnan(v).any() or np.isinf(v).any() for v in alone)
