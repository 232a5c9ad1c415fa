"""Smoothing splines with knots chosen by the data, after P. Dierckx, "Curve and Surface Fitting with Splines" (1993), chapters 4 and 5.

Knots are added where the least-squares residual is largest until the sum of squared residuals is within the bound ``s``. Then, on those knots,
the jumps of the highest derivative are made small as far as that sum stays at ``s``. The defaults (bound of one per point, tolerance of 0.001, at most 20
steps, and knots that first fill half as many places as there are points) are those of the usual numerical library.

`fill_splines` fits many short series side by side: every step is taken for all of them at once, on arrays with a row or a column a series, and
the systems, which are narrow bands, are solved by columns.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

TOLERANCE, STEPS = 1e-3, 20
# Degree of the splines that are fitted side by side, and how many are (fixed values).
DEGREE, SIDE_BY_SIDE = 2, 512


def basis(knots: np.ndarray, k: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and values of the k + 1 B-splines that aren't zero at each x; beyond the ends the outer pieces go on."""
    span = np.clip(np.searchsorted(knots, x, "right") - 1, k, len(knots) - k - 2)
    values = np.zeros((len(x), k + 1))
    values[:, 0] = 1.0
    for d in range(1, k + 1):
        carried = np.zeros(len(x))
        for j in range(d):
            right, left = knots[span + j + 1], knots[span + j + 1 - d]
            part = values[:, j] / (right - left)
            values[:, j] = carried + (right - x) * part
            carried = (x - left) * part
        values[:, d] = carried
    return span - k, values


def jumps(knots: np.ndarray, k: int) -> np.ndarray:
    """A row for each inner knot: the jump of the k-th derivative of every B-spline there, but for a common factor."""
    n_splines = len(knots) - k - 1
    inner = np.arange(k + 1, n_splines)
    scale = (n_splines - k) / (knots[n_splines] - knots[k])
    out = np.zeros((len(inner), n_splines))
    for row, at in enumerate(inner):
        for i in range(at - k - 1, at + 1):
            # Divided difference of the k + 2 knots of the spline: the jump is one term of it.
            others = np.delete(knots[i : i + k + 2], at - i)
            out[row, i] = (knots[i + k + 1] - knots[i]) / np.prod((knots[at] - others)) / scale**k
    return out


@dataclass(frozen=True)
class Spline:
    knots: np.ndarray
    weights: np.ndarray
    degree: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        first, values = basis(self.knots, self.degree, np.asarray(x, float))
        return (values * self.weights[first[:, None] + np.arange(self.degree + 1)]).sum(1)


class _Fit:
    """Least squares on one set of knots."""

    def __init__(self, x: np.ndarray, y: np.ndarray, inner: list[float], k: int):
        self.y, self.k = y, k
        self.knots = np.concatenate([np.full(k + 1, x[0]), inner, np.full(k + 1, x[-1])])
        self.n = len(self.knots) - k - 1
        first, self.values = basis(self.knots, k, x)
        self.place = first[:, None] + np.arange(k + 1)
        products = self.values[:, :, None] * self.values[:, None, :]
        cells = self.place[:, :, None] * self.n + self.place[:, None, :]
        self.gram = np.bincount(cells.ravel(), products.ravel(), self.n * self.n).reshape(self.n, self.n)
        self.cross = np.bincount(self.place.ravel(), (self.values * y[:, None]).ravel(), self.n)

    def solve(self, penalty: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and squared residuals of the points."""
        gram = self.gram if penalty is None else self.gram + penalty
        weights = np.linalg.solve(gram, self.cross)
        # Once more on what is left, as squaring the system costs half the digits.
        weights += np.linalg.solve(gram, self.cross - gram @ weights)
        return weights, (self.y - (self.values * weights[self.place]).sum(1)) ** 2


def _interval_sums(x: np.ndarray, squares: np.ndarray, inner: list[float]) -> list[float]:
    """Squared residuals between knots; a point at a knot counts half on either side."""
    at = np.searchsorted(x, inner)
    below = np.concatenate([[0], np.cumsum(squares)])
    half = np.concatenate([[0], squares[at] / 2, [0]])
    edges = np.concatenate([[0], below[at + 1], [below[-1]]])
    return (np.diff(edges) + half[:-1] - half[1:]).tolist()


def _add_knot(x: np.ndarray, inner: list[float], inside: list[int], sums: list[float]) -> None:
    """Put a knot on the middle point of the interval with the largest residual that still has points inside."""
    place = max((i for i in range(len(inside)) if inside[i] > 0), key=lambda i: sums[i])
    points, residual = inside[place], sums[place]
    before = points // 2
    start = sum(inside[:place]) + place
    inner.insert(place, float(x[start + before + 1]))
    inside[place : place + 1] = [before, points - before - 1]
    sums[place : place + 1] = [residual * before / points, residual * (points - before - 1) / points]


def smoothing_spline(x: np.ndarray, y: np.ndarray, s: float | None = None, k: int = 2) -> Spline:
    """The smoothing spline of degree k (even or odd) of points with rising x. ``s`` defaults to the number of points.

    Raises ValueError for k points or fewer.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    m = len(x)
    if m <= k:
        raise ValueError(f"a spline of degree {k} needs more than {k} points, got {m}")
    bound = float(m) if s is None else s
    close = TOLERANCE * bound
    fewest, most = 2 * (k + 1), m + k + 1
    room = max(m // 2, fewest)
    inner: list[float] = []
    inside = [m - 2]
    adding, growing, before, flat = 0, False, 0.0, 0.0
    while True:
        fit = _Fit(x, y, inner, k)
        weights, squares = fit.solve()
        total = float(squares.sum())
        if not inner:
            flat = total
        over = total - bound
        if abs(over) < close or (over < 0 and not inner):
            return Spline(fit.knots, weights, k)
        size = fewest + len(inner)
        if over < 0 or size == most:
            break
        if size == room:
            # The library starts its count of new knots anew when it makes more room.
            room, growing = most, False
        if not growing:
            adding, growing = 1, True
        else:
            wanted = int(adding * over / (before - total)) if before - total > close else adding * 2
            adding = min(adding * 2, max(wanted, adding // 2, 1))
        before = total
        sums = _interval_sums(x, squares, inner)
        for _ in range(adding):
            _add_knot(x, inner, inside, sums)
            if fewest + len(inner) == most:
                # As many splines as points: the knots of interpolation, on points or, for an even degree, between them.
                half = k // 2
                inner = ((x[half : m - half - 1] + x[half + 1 : m - half]) / 2 if k % 2 == 0 else x[half + 1 : m - half - 1]).tolist()
                break
            if fewest + len(inner) == room:
                break
    return _smoothed(fit, bound, flat - bound, over, close)


def _smoothed(fit: _Fit, bound: float, low: float, high: float, close: float) -> Spline:
    """Weigh the jumps so that the squared residuals add up to the bound.

    ``p`` is the weight of the points against the jumps: with 0 the spline is a polynomial and the sum is ``low`` over the bound, without end it is ``high``.
    The root is found by rational interpolation through three values of p.
    """
    rough = jumps(fit.knots, fit.k)
    penalty = rough.T @ rough
    search = _search(fit.n / np.trace(np.linalg.cholesky(fit.gram)), low, high, close)
    p = next(search)
    while p is not None:
        weights, squares = fit.solve(penalty / p**2)
        p = search.send(float(squares.sum()) - bound)
    return Spline(fit.knots, weights, fit.k)


def _search(p: float, low: float, high: float, close: float) -> Generator[float | None, float, None]:
    """The values of p to try, each answered by how far its sum is over the bound; None when the last one is to be kept."""
    p1, f1, p3, f3 = 0.0, low, -1.0, high
    sure_low = sure_high = False
    for step in range(STEPS):
        f = yield p
        if abs(f) < close or step == STEPS - 1:
            break
        p2, f2 = p, f
        if not sure_high:
            if f2 - f3 <= close:
                # p is too large to tell.
                p3, f3 = p2, f2
                p *= 0.04
                if p <= p1:
                    p = 0.9 * p1 + 0.1 * p2
                continue
            sure_high = f2 < 0
        if not sure_low:
            if f1 - f2 <= close:
                # p is too small to tell.
                p1, f1 = p2, f2
                p /= 0.04
                if 0 <= p3 <= p:
                    p = 0.1 * p2 + 0.9 * p3
                continue
            sure_low = f2 > 0
        if not f1 > f2 > f3:
            break
        if p3 > 0:
            h1, h2, h3 = f1 * (f2 - f3), f2 * (f3 - f1), f3 * (f1 - f2)
            p = -(p1 * p2 * h3 + p2 * p3 * h1 + p3 * p1 * h2) / (p1 * h1 + p2 * h2 + p3 * h3)
        else:
            p = (p1 * (f1 - f3) * f2 - p2 * (f2 - f3) * f1) / ((f1 - f2) * f3)
        if f2 < 0:
            p3, f3 = p2, f2
        else:
            p1, f1 = p2, f2
    yield None


class _Fits:
    """Least squares of many series, each on its own knots. Points are rows of a series, systems are columns; what a series lacks is zero.

    ``seen`` counts the inner knots up to each point and ``inner`` holds them, ``n_inner`` of each series.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, m: np.ndarray, seen: np.ndarray, inner: np.ndarray, n_inner: np.ndarray):
        k, rows = DEGREE, np.arange(len(x))
        self.y, self.real = y, np.arange(x.shape[1]) < m[:, None]
        self.n = n_inner + k + 1
        self.size = int(self.n.max())
        last = x[rows, m - 1]
        self.knots = np.repeat(last[:, None], self.size + k + 1, 1)
        self.knots[:, : k + 1] = x[:, :1]
        held = np.arange(inner.shape[1]) < n_inner[:, None]
        self.knots[:, k + 1 : k + 1 + inner.shape[1]][held] = inner[held]
        span = k + np.minimum(seen, n_inner[:, None])
        values = _bases(self.knots, span, x)
        self.values = np.where(self.real[:, :, None], values, 0.0)
        self.first = span - k
        cells = self.first * len(x) + rows[:, None]
        self.bands = np.zeros((self.size, k + 1, len(x)))
        self.cross = np.zeros((self.size, len(x)))
        for a in range(k + 1):
            at, v = (cells + a * len(x)).ravel(), self.values[:, :, a]
            self.cross += self._added(at, v * y)
            for d in range(k + 1 - a):
                self.bands[:, d] += self._added(at, v * self.values[:, :, a + d])
        # Columns that a series lacks are solved by zero.
        self.bands[:, 0][np.arange(self.size)[:, None] >= self.n] = 1.0

    def kept(self, which: np.ndarray) -> None:
        for name in ("n", "knots", "y", "real", "values", "first"):
            setattr(self, name, getattr(self, name)[which])
        self.bands, self.cross = self.bands[:, :, which], self.cross[:, which]

    def _added(self, at: np.ndarray, what: np.ndarray) -> np.ndarray:
        columns = len(self.y)
        return np.bincount(at, what.ravel(), self.size * columns).reshape(self.size, columns)

    def solve(self, bands: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights, squared residuals of the points, and the diagonal of the triangular factors, which isn't positive where there is none."""
        bands = self.bands if bands is None else bands
        factors = _factored(bands)
        weights = _substituted(factors, self.cross)
        # Once more on what is left, as squaring the system costs half the digits.
        weights += _substituted(factors, self.cross - _product(bands, weights))
        fitted = _evaluated(self.values, self.first, weights)
        return weights, np.where(self.real, (self.y - fitted) ** 2, 0.0), factors[: self.size, 0]


def _bases(knots: np.ndarray, span: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`basis` of points in the rows of ``x``, each row on its own knots, with the places of the points among them given."""
    flat, at = knots.ravel(), span + np.arange(len(x))[:, None] * knots.shape[1]
    values = np.zeros((*x.shape, DEGREE + 1))
    values[:, :, 0] = 1.0
    for d in range(1, DEGREE + 1):
        passed = np.zeros(x.shape)
        for j in range(d):
            right, left = flat[at + j + 1], flat[at + j + 1 - d]
            part = values[:, :, j] / (right - left)
            values[:, :, j] = passed + (right - x) * part
            passed = (x - left) * part
        values[:, :, d] = passed
    return values


def _evaluated(values: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    flat, at = weights.ravel(), first * weights.shape[1] + np.arange(weights.shape[1])[:, None]
    return sum(values[:, :, a] * flat[at + a * weights.shape[1]] for a in range(DEGREE + 1))


def _factored(bands: np.ndarray) -> np.ndarray:
    """Triangular factors of symmetric band systems, a column a system: ``bands[j, d]`` is what stands in row j + d of column j."""
    size, width = len(bands), bands.shape[1] - 1
    out = np.concatenate([bands, np.zeros((width, *bands.shape[1:]))])
    for j in range(size):
        below = out[j, 1:].copy()
        out[j, 1:] /= out[j, 0]
        for i in range(width):
            out[j + 1 + i, : width - i] -= out[j, 1 + i] * below[i:]
    return out


def _substituted(factors: np.ndarray, right: np.ndarray) -> np.ndarray:
    size, width = len(right), factors.shape[1] - 1
    out = np.concatenate([right, np.zeros((width, right.shape[1]))])
    for j in range(size):
        out[j + 1 : j + 1 + width] -= factors[j, 1:] * out[j]
    out[:size] /= factors[:size, 0]
    for j in range(size - 1, -1, -1):
        out[j] -= (factors[j, 1:] * out[j + 1 : j + 1 + width]).sum(0)
    return out[:size]


def _product(bands: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = bands[:, 0] * weights
    for d in range(1, min(bands.shape[1], len(weights))):
        out[:-d] += bands[:-d, d] * weights[d:]
        out[d:] += bands[:-d, d] * weights[:-d]
    return out


def _penalties(knots: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bands of the squared `jumps` of each row's knots."""
    k, rows = DEGREE, np.arange(len(knots))
    size = knots.shape[1] - k - 1
    many = size - k - 1
    scale = (n - k) / (knots[rows, n] - knots[:, k])
    own = np.arange(k + 1, size) < n[:, None]
    at = knots[:, k + 1 : size]
    rough = []
    for o in range(k + 2):
        spread = knots[:, o + k + 1 : o + k + 1 + many] - knots[:, o : o + many]
        others = [at - knots[:, o + j : o + j + many] for j in range(k + 2) if o + j != k + 1]
        product = others[0]
        for other in others[1:]:
            product = product * other
        rough.append(np.where(own, spread / np.where(own, product, 1.0) / scale[:, None] ** k, 0.0).T)
    out = np.zeros((size, k + 2, len(knots)))
    for o in range(k + 2):
        for d in range(k + 2 - o):
            out[o : o + many, d] += rough[o] * rough[o + d]
    return out


class _Knots:
    """The knots of many series while they are added: on points, or between them where a series has as many splines as points."""

    def __init__(self, x: np.ndarray, m: np.ndarray):
        self.x, self.m = x, m
        self.on = np.zeros(x.shape, bool)
        self.full = np.zeros(len(x), bool)
        self.low = np.zeros((len(x), 1), int)
        self.high = (m - 1)[:, None].copy()

    def kept(self, which: np.ndarray) -> None:
        for name in ("x", "m", "on", "full", "low", "high"):
            setattr(self, name, getattr(self, name)[which])

    def fits(self, y: np.ndarray) -> _Fits:
        n_inner = np.where(self.full, self.m - 3, self.on.sum(1))
        places = np.arange(self.x.shape[1])
        seen = np.where(self.full[:, None], np.clip(places - 1, 0, np.maximum(self.m - 3, 0)[:, None]), self.on.cumsum(1))
        inner = np.zeros((len(self.x), max(int(n_inner.max()), 1)))
        row, at = np.nonzero(self.on & ~self.full[:, None])
        inner[row, seen[row, at] - 1] = self.x[row, at]
        if self.full.any():
            between = (self.x[self.full, 1:-2] + self.x[self.full, 2:-1]) / 2
            width = min(between.shape[1], inner.shape[1])
            inner[self.full, :width] = between[:, :width]
        return _Fits(self.x, y, self.m, seen, inner, n_inner)

    def add(self, squares: np.ndarray, adding: np.ndarray, room: np.ndarray) -> None:
        """`_add_knot` as often as asked for, until a series fills its room."""
        rows = np.arange(len(self.x))[:, None]
        below = np.concatenate([np.zeros((len(self.x), 1)), squares.cumsum(1)], 1)
        ends = self.high == (self.m - 1)[:, None]
        edge = np.where(ends, below[:, -1:], below[rows, np.minimum(self.high, self.m[:, None] - 1) + 1])
        begin = np.where(self.low > 0, below[rows, self.low + 1], 0.0)
        sums = edge - begin + np.where(self.low > 0, squares[rows, self.low] / 2, 0.0) - np.where(ends, 0.0, squares[rows, self.high] / 2)
        n, fewest, most = self.on.sum(1), 2 * (DEGREE + 1), self.m + DEGREE + 1
        for turn in range(int(adding.max())):
            r = np.flatnonzero((turn < adding) & ~self.full & ~((turn > 0) & (fewest + n == room)))
            if not len(r):
                break
            low, high, s = self.low[r], self.high[r], sums[r]
            points = high - low - 1
            largest = np.where(points > 0, s, -np.inf)
            top = largest == largest.max(1)[:, None]
            place = np.where(top & (points > 0), low, self.x.shape[1]).argmin(1)
            i = np.arange(len(r))
            inside, residual, start, end = points[i, place], s[i, place], low[i, place], high[i, place]
            before = inside // 2
            at = start + before + 1
            self.on[r, at] = True
            n[r] += 1
            new = np.full((len(self.x), 1), 0)
            self.low, self.high, sums = (np.concatenate([old, new], 1) for old in (self.low, self.high, sums))
            self.high[r, place], sums[r, place] = at, residual * before / inside
            self.low[r, -1], self.high[r, -1], sums[r, -1] = at, end, residual * (inside - before - 1) / inside
            self.full[r] = fewest + n[r] == most[r]


def _fitted(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """`smoothing_spline` of the first ``m`` points in each row, by parts as they are done: rows, knots, number of splines, weights.

    Rows whose systems can't be solved so are left out.
    """
    bound, fewest, most = m.astype(float), 2 * (DEGREE + 1), m + DEGREE + 1
    close, room = TOLERANCE * bound, np.maximum(m // 2, fewest)
    adding, growing = np.zeros(len(x), int), np.zeros(len(x), bool)
    last, flat, high = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    row, knots, first = np.arange(len(x)), _Knots(x, m), True
    # Those whose knots are found are smoothed together.
    found, smoothed = _Knots(x, m), np.zeros(len(x), bool)
    while len(row):
        fits = knots.fits(y[row])
        weights, squares, diagonal = fits.solve()
        total = squares.sum(1)
        sound = (diagonal > 0).all(0) & np.isfinite(total)
        if first:
            flat[:] = total
        over, near = total - bound[row], close[row]
        done = sound & ((np.abs(over) < near) | ((over < 0) & first))
        first = False
        if done.any():
            yield row[done], fits.knots[done], fits.n[done], weights[:, done]
        size = fewest + fits.n - DEGREE - 1
        smooth = sound & ~done & ((over < 0) | (size == most[row]))
        which = row[smooth]
        smoothed[which], high[which], found.on[which], found.full[which] = True, over[smooth], knots.on[smooth], knots.full[smooth]
        going = sound & ~done & ~smooth
        row, total, over, near, size, squares = (v[going] for v in (row, total, over, near, size, squares))
        knots.kept(going)
        filled = size == room[row]
        room[row] = np.where(filled, most[row], room[row])
        again = growing[row] & ~filled
        fell = last[row] - total
        wanted = np.where(fell > near, adding[row] * over / np.where(fell > near, fell, 1.0), adding[row] * 2)
        wanted = np.minimum(wanted, most[row]).astype(int)
        adding[row] = np.where(again, np.minimum(adding[row] * 2, np.maximum(np.maximum(wanted, adding[row] // 2), 1)), 1)
        growing[row], last[row] = True, total
        if len(row):
            knots.add(squares, adding[row], room[row])
    if smoothed.any():
        found.kept(smoothed)
        for part, *spline in _all_smoothed(found.fits(y[smoothed]), *(v[smoothed] for v in (bound, flat - bound, high, close))):
            yield np.flatnonzero(smoothed)[part], *spline


def _all_smoothed(fits: _Fits, bound, low, high, close) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """`_smoothed` of all rows."""
    real = np.arange(fits.size)[:, None] < fits.n
    diagonal = _factored(fits.bands)[: fits.size, 0]
    traces = np.where(real, np.sqrt(np.where(real, diagonal, 1.0)), 0.0).sum(0)
    searches = [_search(*map(float, start)) for start in zip(fits.n / traces, low, high, close)]
    p = np.array([next(s) for s in searches])
    penalty = _penalties(fits.knots, fits.n)
    gram = np.concatenate([fits.bands, np.zeros((fits.size, 1, len(p)))], 1)
    left = np.arange(len(p))
    while len(left):
        weights, squares, found = fits.solve(gram + penalty / p**2)
        over = squares.sum(1) - bound[left]
        sound = (found > 0).all(0) & np.isfinite(over)
        following = [searches[i].send(float(f)) if ok else None for i, f, ok in zip(left, over, sound)]
        ends = np.array([q is None for q in following])
        kept = ends & sound
        if kept.any():
            yield left[kept], fits.knots[kept], fits.n[kept], weights[:, kept]
        if ends.any():
            left, penalty, gram = left[~ends], penalty[:, :, ~ends], gram[:, :, ~ends]
            fits.kept(~ends)
        p = np.array([q for q in following if q is not None])


def fill_linear(values: np.ndarray) -> np.ndarray:
    """NaN by the line between the nearest known values by position, and by the nearest one at the ends."""
    known = np.flatnonzero(~np.isnan(values))
    return np.interp(np.arange(len(values)), known, values[known]) if len(known) else values


def fill_spline(values: np.ndarray, k: int = 2) -> np.ndarray:
    """NaN by a smoothing spline through the known values by position, which goes on at the ends; by lines where there is none."""
    gaps = np.isnan(values)
    known = np.flatnonzero(~gaps)
    if not gaps.any() or not len(known):
        return values
    try:
        spline = smoothing_spline(known, values[known], k=k)
        out = values.copy()
        out[gaps] = spline(np.flatnonzero(gaps))
    except (ValueError, np.linalg.LinAlgError):
        return fill_linear(values)
    return out if np.isfinite(out).all() else fill_linear(values)


def fill_splines(many: Sequence[np.ndarray]) -> list[np.ndarray]:
    """`fill_spline` of each series, fitted side by side. Those that are too short or whose systems are singular are filled one by one."""
    out: list[np.ndarray | None] = [None] * len(many)
    points = [np.flatnonzero(~np.isnan(values)) for values in many]
    fit = [i for i, at in enumerate(points) if DEGREE < len(at) < len(many[i]) and np.isfinite(many[i][at]).all()]
    # Series of about one length share a batch, so that little of it is empty.
    fit.sort(key=lambda i: len(points[i]))
    for begin in range(0, len(fit), SIDE_BY_SIDE):
        batch = fit[begin : begin + SIDE_BY_SIDE]
        m = np.array([len(points[i]) for i in batch])
        x, y = np.zeros((len(batch), m.max())), np.zeros((len(batch), m.max()))
        for r, i in enumerate(batch):
            x[r], y[r, : m[r]] = points[i][-1], many[i][points[i]]
            x[r, : m[r]] = points[i]
        with np.errstate(all="ignore"):
            for rows, knots, n, weights in _fitted(x, y, m):
                gaps = [np.flatnonzero(np.isnan(many[batch[r]])) for r in rows]
                at = np.zeros((len(rows), max(map(len, gaps))))
                for r, g in enumerate(gaps):
                    at[r], at[r, : len(g)] = g[-1], g
                # Inner knots of all rows in one rising list, each row's apart from the next one's.
                apart = (np.arange(len(rows)) * (x.max() + len(max(many, key=len)) + 2))[:, None]
                held = np.arange(DEGREE + 1, knots.shape[1]) < n[:, None]
                counts = np.searchsorted((knots[:, DEGREE + 1 :] + apart)[held], (at + apart).ravel(), "right").reshape(at.shape)
                counts -= np.concatenate([[0], held.sum(1).cumsum()[:-1]])[:, None]
                made = _evaluated(_bases(knots, counts + DEGREE, at), counts, weights)
                for r, g, line in zip(rows, gaps, made):
                    if np.isfinite(line).all():
                        out[batch[r]] = many[batch[r]].copy()
                        out[batch[r]][g] = line[: len(g)]
    return [fill_spline(values) if filled is None else filled for values, filled in zip(many, out)]
