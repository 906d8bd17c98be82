"""Exact Gaussian likelihood of seasonal ARMA models and a search without a grid, for blocks of series.

The filter is the innovations form of the state-space model with an approximately diffuse start. Nothing but the model itself moves the
observation, so a filtered state is known in its first element; the filter's gains depend on the moving-average values alone and its
innovations are linear in the autoregressive ones. For given moving-average values these therefore have a closed form, and a search
runs over one value, or two for a seasonal model. A seasonal model's sums come from the errors its state begins with, without the filter's
matrices.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from .kernels import _autoregression, css_fit, isolated, smoothed
from .kernels import smoothing_fit as grid_smoothing

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: variance of the unknown state at the start, in units of the error's.
DIFFUSE = 1e6
#: Moving-average values stay inside the unit circle by so much.
EDGE = 0.99999
LIKELIHOOD = "phi double, theta double, seasonal_phi double, seasonal_theta double, sse double, n_used int, log_f double, error string"


def state_size(p: int, q: int, sp: int, sq: int, season: int) -> int:
    """Elements of the state, and the first months that the likelihood leaves out."""
    return max(p + season * sp, q + season * sq + 1)


def _aligned(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(v) for v in series])
    block = np.zeros((len(series), int(lengths.max(initial=0))))
    for row, values in enumerate(series):
        block[row, : len(values)] = values
    return block, lengths


def moments(block: np.ndarray, lengths: np.ndarray, skip: np.ndarray, theta: np.ndarray, big_theta: np.ndarray, season: int, size: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Products of the innovations of w(t), w(t-1), w(t-s), w(t-s-1), each over its variance, summed from ``skip`` on; and the sum of the variances' logarithms.

    ``theta`` and ``big_theta`` have a row for each series and a column for each pair of values. Without ``exact`` all variances are one
    and the errors before the series are zero: the conditional squares.
    """
    if exact and season > 1 and size == season + 2 < block.shape[1] and (skip >= size).all():
        return seasonal_moments(block, lengths, skip, theta, big_theta, season)
    return filtered_moments(block, lengths, skip, theta, big_theta, season, size, exact)


def filtered_moments(block: np.ndarray, lengths: np.ndarray, skip: np.ndarray, theta: np.ndarray, big_theta: np.ndarray, season: int, size: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """:func:`moments` by the filter itself, month by month."""
    rows, width = block.shape
    lags = (0, 1, season, season + 1) if season else (0, 1)
    shape = theta.shape
    weights = np.zeros((size, *shape))  # of the error in each element of the state
    weights[0] = 1.0
    if size > 1:
        weights[1] = theta
    if season and size > season:
        weights[season] = big_theta
    if season and size > season + 1:
        weights[season + 1] = theta * big_theta
    outer = weights[:, None] * weights[None, :]
    spread = np.zeros((size, size, *shape))
    spread[np.arange(size), np.arange(size)] = DIFFUSE
    state = np.zeros((len(lags), size, *shape))
    out, log_f = np.zeros((len(lags), len(lags), *shape)), np.zeros(shape)
    for t in range(width):
        now = np.stack([block[:, t - lag] if t >= lag else np.zeros(rows) for lag in lags])[:, :, None]
        error = now - state[:, 0]
        f = spread[0, 0] if exact else np.ones(shape)
        live = ((t >= skip) & (t < lengths))[:, None]
        if live.any():
            weighted = np.where(live, error / f, 0.0)
            for i in range(len(lags)):
                for j in range(i, len(lags)):
                    out[i, j] += weighted[i] * error[j]
            log_f += np.where(live, np.log(f), 0.0)
        gain = spread[:, 0] / f if exact else weights
        moved = np.zeros_like(state)
        if exact or t > 0:
            moved[:, :-1] = state[:, 1:] + gain[None, 1:] * error[:, None]
        state = moved
        if exact:
            after = outer.copy()
            after[:-1, :-1] += spread[1:, 1:] - gain[1:, None] * spread[None, 0, 1:]
            spread = after
    for i in range(len(lags)):
        for j in range(i):
            out[i, j] = out[j, i]
    return out, log_f


def seasonal_moments(block: np.ndarray, lengths: np.ndarray, skip: np.ndarray, theta: np.ndarray, big_theta: np.ndarray, season: int, cells: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """:func:`moments` of the exact model with both moving-average values, for a ``skip`` of its state's size at least.

    The first s + 2 months have a diffuse part each, and after them all depends on the errors e(1) .. e(s + 1) that the state then holds.
    Given these the later errors follow by recursion, so the sums up to a month are those of least squares for them. In e(1) .. e(s) and
    e(s + 1) + ``big_theta`` e(1) its equations are an arrow: an error moves only the months a whole number of seasons after it, the last
    unknown all of them, and the diffuse months join neighbours. What counts is the difference between the end and ``skip``.
    """
    if theta.shape[1] == 1:  # sums for a single place run in another order; a perfect fit's error, all rounding, would not be the one searched for
        out, log_f = seasonal_moments(block, lengths, skip, np.repeat(theta, 2, axis=1), np.repeat(big_theta, 2, axis=1), season, cells)
        return out[..., :1], log_f[:, :1]
    (rows, k), width = theta.shape, block.shape[1]
    out, log_f = np.zeros((4, 4, rows, k)), np.zeros((rows, k))
    lots = max(cells // max(k * width, 1), 1)  # so many rows that what is read again stays in the processor's cache
    for begin in range(0, rows, lots):
        at = slice(begin, begin + lots)
        ends, first = np.minimum(np.maximum(lengths[at], skip[at]), width), np.minimum(skip[at], width)
        a, b = theta[at], big_theta[at]
        errors, last, powers = _responses(block[at, : ends.max()], a, b, season)
        if (first == first[0]).all() and (ends == ends[0]).all():
            before, live = None, None
        else:
            month = np.arange(ends.max())[:, None, None]
            before, live = (month < first[:, None]) * 1.0, ((month >= first[:, None]) & (month < ends[:, None])) * 1.0
        left = _season_sums(errors, last, powers, season, 2, first.max(), before)
        done = _season_sums(errors, last, powers, season, first.min(), ends.max(), live)
        known, known_product = _season_solved(errors, a, b, season, left)
        whole, whole_product = _season_solved(errors, a, b, season, [x + y for x, y in zip(left, done, strict=True)])
        lagged = _lagged(errors, season, first.min(), ends.max(), live)
        for i in range(4):
            for j in range(i, 4):
                out[i, j, at] = out[j, i, at] = np.einsum("trk,trk->rk", lagged[i], lagged[j]) - whole[i][j] + known[i][j]
        log_f[at] = np.log(whole_product / known_product)
    return out, log_f


def _responses(block: np.ndarray, theta: np.ndarray, big_theta: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Errors with none before the series, after s + 1 zeros; what the last unknown moves each month by; and what the others do, by seasons since."""
    rows, width = block.shape
    pad = season + 1
    errors, last = np.zeros((pad + width, *theta.shape)), np.zeros((width, *theta.shape))
    months = block.T[:, :, None]
    for t in range(width):
        np.subtract(months[t], theta * errors[pad + t - 1], out=errors[pad + t])
    for t in range(pad + season, pad + width, season):
        some = errors[t : t + season]
        some -= big_theta * errors[t - season : t - season + len(some)]
    fade = -theta
    for t in range(pad + 1, width):
        last[t] = fade if t == pad + 1 else fade * last[t - 1]
    for t in range(pad + 1 + season, width, season):
        some = last[t : t + season]
        some -= big_theta * last[t - season : t - season + len(some)]
    powers = np.ones((-(-max(width - 2, 1) // season), *theta.shape))
    for i in range(1, len(powers)):
        np.multiply(powers[i - 1], -big_theta, out=powers[i])
    return errors, last, powers


def _lagged(errors: np.ndarray, season: int, begin: int, end: int, live: np.ndarray | None) -> list[np.ndarray]:
    """The errors of w(t), w(t-1), w(t-s), w(t-s-1) from month ``begin`` up to ``end``."""
    parts = [errors[season + 1 - lag + begin : season + 1 - lag + end] for lag in (0, 1, season, season + 1)]
    return parts if live is None else [part * live[begin:end] for part in parts]


def _season_sums(errors: np.ndarray, last: np.ndarray, powers: np.ndarray, season: int, begin: int, end: int, live: np.ndarray | None) -> list[np.ndarray]:
    """The months' share in the equations: of e(2) .. e(s + 1) with the errors, themselves and the last unknown, and of that with the errors and itself."""
    shape = powers.shape[1:]
    lagged = _lagged(errors, season, begin, end, live)
    moved = last[begin:end] if live is None else last[begin:end] * live[begin:end]
    sides, own, shared = np.zeros((4, season, *shape)), np.zeros((season, *shape)), np.zeros((season, *shape))
    for i, power in enumerate(powers):
        t, upto = max(begin, 2 + i * season), min(end, 2 + (i + 1) * season)
        if t < upto:
            to, of = slice(t - 2 - i * season, upto - 2 - i * season), slice(t - begin, upto - begin)
            for side, part in zip(sides, lagged, strict=True):
                side[to] += power * part[of]
            own[to] += power**2 if live is None else power**2 * live[t:upto]
            shared[to] += power * moved[of]
    all_sides = np.stack([np.einsum("trk,trk->rk", moved, part) for part in lagged])
    return [sides, own, shared, all_sides, np.einsum("trk,trk->rk", moved, moved)]


def _season_solved(errors: np.ndarray, theta: np.ndarray, big_theta: np.ndarray, season: int, sums: list[np.ndarray]) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """What the unknown errors take off the products, and the determinant of their equations."""
    sides, own, shared, all_sides, all_own = sums
    start = errors[season + 1] / DIFFUSE  # the first month's error is all diffuse, and moves the diffuse months after it
    pushed = np.zeros((season + 2, *theta.shape))
    pushed[1] += theta * start
    pushed[season] += big_theta * start
    pushed[season + 1] += theta * big_theta * start
    columns = np.empty((5, season, *theta.shape))  # four sides, and the equations' last column
    for i, lag in enumerate((0, 1, season, season + 1)):
        columns[i, 0] = errors[season + 2 - lag] - big_theta * sides[i, -1]
        columns[i, 1:] = sides[i, :-1]
    columns[0] -= pushed[1:-1] + theta * pushed[2:]
    columns[4, 0] = -big_theta * (own[-1] + shared[-1])
    columns[4, 1:] = shared[:-1]
    columns[4, -1] += theta / DIFFUSE
    pivots = np.empty((season, *theta.shape))
    pivots[0] = 1.0 + big_theta**2 * own[-1]
    pivots[1:] = own[:-1]
    pivots += (1.0 + theta**2) / DIFFUSE
    beside = theta / DIFFUSE
    for j in range(1, season):
        ratio = beside / pivots[j - 1]
        pivots[j] -= ratio * beside
        columns[:, j] -= ratio * columns[:, j - 1]
    over = columns / pivots
    corner = own[-1] + 2 * shared[-1] + all_own + 1 / DIFFUSE - np.einsum("trk,trk->rk", columns[4], over[4])
    ends = [sides[i, -1] + all_sides[i] - (pushed[-1] if i == 0 else 0.0) - np.einsum("trk,trk->rk", columns[i], over[4]) for i in range(4)]
    taken = [[np.einsum("trk,trk->rk", columns[i], over[j]) + ends[i] * ends[j] / corner if j >= i else None for j in range(4)] for i in range(4)]
    return taken, pivots.prod(axis=0) * corner


def nelder_mead(value, start: np.ndarray, step: float, low: float, high: float, rounds: int = 120, close: float = 1e-7) -> np.ndarray:
    """For each row the point where ``value`` is least, from ``start`` on; all rows at once, and only those that still move.

    ``value(rows, points)`` gives the values of (row, k, dimension) points. All steps a simplex could take are valued together: mirrored, stretched,
    drawn in on either side; a row whose steps all fail shrinks towards its best corner.
    """
    count, dims = start.shape
    corners = np.repeat(start[:, None, :], dims + 1, axis=1)
    for i in range(dims):
        inward = np.where(start[:, i] + step > high, -step, step)
        corners[:, i + 1, i] += inward
    corners = np.clip(corners, low, high)
    values = value(np.arange(count), corners)
    for _ in range(rounds):
        order = np.argsort(values, axis=1, kind="stable")
        values = np.take_along_axis(values, order, 1)
        corners = np.take_along_axis(corners, order[:, :, None], 1)
        open_ = np.flatnonzero(np.abs(corners - corners[:, :1]).max(axis=(1, 2)) > close)
        if not len(open_):
            break
        x, fx = corners[open_], values[open_]
        centre, worst = x[:, :-1].mean(axis=1), x[:, -1]
        tried = np.clip(np.stack([centre + k * (centre - worst) for k in (1.0, 2.0, 0.5, -0.5)], axis=1), low, high)
        ft = value(open_, tried)
        mirrored, stretched, outside, inside = ft.T
        pick = np.where(mirrored < fx[:, 0], np.where(stretched < mirrored, 1, 0), np.where(mirrored < fx[:, -2] if dims > 1 else mirrored < fx[:, 0], 0, np.where(mirrored < fx[:, -1], 2, 3)))
        best = ft[np.arange(len(open_)), pick]
        good = best < np.where(pick == 2, np.minimum(mirrored, fx[:, -1]), fx[:, -1])
        rows = open_[good]
        corners[rows, -1] = tried[np.arange(len(open_)), pick][good]
        values[rows, -1] = best[good]
        rows = open_[~good]
        if len(rows):
            corners[rows, 1:] = corners[rows, :1] + 0.5 * (corners[rows, 1:] - corners[rows, :1])
            values[rows, 1:] = value(rows, corners[rows, 1:])
    at = np.argmin(values, axis=1)
    return corners[np.arange(count), at]


def fit(series: list[np.ndarray], skip: np.ndarray, order: tuple[int, int], season_order: tuple[int, int, int], exact: bool, bound: float = np.inf, block_rows: int = 128, fixed: tuple[float, float] | None = None) -> list[tuple]:
    """(phi, theta, seasonal phi, seasonal theta, weighted squares, months, log of the variances) of each differenced series.

    The search begins at the three best points of a coarse grid and at that of the conditional squares on a finer one, so it never ends above
    that. ``fixed`` gives the moving-average values instead.
    """
    (p, q), (sp, sq, season) = order, season_order
    season = season if sp or sq else 0
    size = state_size(p, q, sp, sq, season) if exact else (q + season * sq + 1)
    out: list[tuple] = [(None,) * 7] * len(series)
    good = [i for i, v in enumerate(series) if len(v) > max(skip[i], size if exact else 1)]
    good.sort(key=lambda i: (len(series[i]), skip[i]))  # a block of one length needs no masks
    free = [k for k, used in enumerate((q, sq)) if used] if fixed is None else []
    for begin in range(0, len(good), block_rows):
        chosen = good[begin : begin + block_rows]
        block, lengths = _aligned([series[i] for i in chosen])
        scale = np.sqrt((block**2).sum(axis=1) / lengths)
        scale[scale == 0] = 1.0
        block = block / scale[:, None]
        from_ = np.maximum(np.array([skip[i] for i in chosen]), size if exact else 1)
        used = lengths - from_

        def solved(rows, points):
            full = np.zeros((*points.shape[:2], 2))
            full[:, :, free] = points
            if fixed is not None:
                full[:] = fixed
            m, log_f = moments(block[rows], lengths[rows], from_[rows], full[:, :, 0], full[:, :, 1], season, size, exact)
            return full, log_f, *_autoregression(m, bool(p), bool(sp), bound)

        def value(rows, points):
            _, log_f, _, _, sse = solved(rows, points)
            n = used[rows][:, None]
            return n * np.log(np.maximum(sse, 1e-300) / n) + log_f

        rows = np.arange(len(chosen))
        best = np.zeros((len(chosen), len(free)))
        if free:
            line = np.linspace(-0.95, 0.95, 39) if len(free) == 1 else np.linspace(-0.8, 0.8, 9)
            grid = np.stack([g.ravel() for g in np.meshgrid(*[line] * len(free), indexing="ij")], axis=-1)
            first = value(rows, np.repeat(grid[None], len(rows), axis=0))
            near = grid[np.argsort(first, axis=1, kind="stable")[:, :3]]
            finer = css_fit([series[i] for i in chosen], from_, order, season_order, ((line[1] - line[0], len(line) // 2), (0.05, 3), (0.0125, 3)), bound)
            starts = np.concatenate([near, finer[:, None, [1, 3]][:, :, free]], axis=1)
            if len(free) == 1:  # the likelihood can bend sharply just before the unit circle
                starts = np.concatenate([starts, np.broadcast_to(np.array([[-EDGE], [EDGE]]), (len(rows), 2, 1))], axis=1)
            owner = np.repeat(rows, starts.shape[1])
            found = nelder_mead(lambda at, points: value(owner[at], points), starts.reshape(-1, len(free)), (line[1] - line[0]) / 2, -EDGE, EDGE).reshape(starts.shape)
            best = found[rows, np.argmin(value(rows, found), axis=1)]
        full, log_f, phi, big, sse = solved(rows, best[:, None, :])
        for row, i in enumerate(chosen):
            squares = max(float(sse[row, 0]), 0.0) * scale[row] ** 2
            out[i] = (float(phi[row, 0]), float(full[row, 0, 0]), float(big[row, 0]), float(full[row, 0, 1]), squares, int(used[row]), float(log_f[row, 0]))
    return out


def likelihood_udf(order, season_order, exact: bool, bound: float = np.inf, fixed: tuple[float, float] | None = None):
    """Pandas UDF (differenced series or null, skipped values) -> struct of ``LIKELIHOOD``."""

    @F.pandas_udf(LIKELIHOOD)
    def run(series: pd.Series, skip: pd.Series) -> pd.DataFrame:
        values = [np.zeros(0) if v is None else np.asarray(v, dtype=float) for v in series]
        skips = skip.fillna(1).astype(int).to_numpy()
        found, errors = isolated(lambda at: fit([values[i] for i in at], skips[at], order, season_order, exact, bound, fixed=fixed), len(values), 7)
        out = pd.DataFrame(found, columns=["phi", "theta", "seasonal_phi", "seasonal_theta", "sse", "n_used", "log_f"])
        return out.astype({c: "Int32" if c == "n_used" else "float64" for c in out.columns}).assign(error=errors)

    return run.asNondeterministic()


def smoothing_fit(series: list[np.ndarray], season: int, block_rows: int = 64) -> list[tuple]:
    """As :func:`tallycast.functions.kernels.smoothing_fit`, with a search for the three smoothing values from a grid's best point on."""
    coarse = grid_smoothing(series, season, ((0.2, 2), (0.05, 2)))
    out: list[tuple] = list(coarse)
    good = [i for i, v in enumerate(series) if coarse[i][0] is not None]
    for begin in range(0, len(good), block_rows):
        chosen = good[begin : begin + block_rows]
        some = [series[i] for i in chosen]
        start = np.array([coarse[i][:3] for i in chosen])
        value = lambda at, points, some=some: smoothed([some[i] for i in at], season, points)[0]
        found = nelder_mead(value, start, 0.1, 0.0, 1.0, rounds=200)
        errors, level, trend, seasonal = smoothed(some, season, found[:, None, :])
        for row, i in enumerate(chosen):
            if errors[row, 0] <= coarse[i][6]:
                out[i] = (*map(float, found[row]), float(level[row, 0]), float(trend[row, 0]), [float(v) for v in seasonal[:, row, 0]], float(errors[row, 0]), coarse[i][7])
    return out
