"""The few fits that no built-in function expresses, as Arrow-batched Pandas UDFs.

A row is one entity with its packed months, so a batch is a block of short series and NumPy works on the
whole block at once. Spark decides which task holds which entity. Each function returns null parts
with a status when a series cannot be fitted, so one bad entity never stops the job. All are marked
non-deterministic: the planner then neither copies a fit into a filter nor runs it twice.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# Ship this module inside the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])



def isolated(run, rows: int, width: int) -> tuple[list[tuple], list[str | None]]:
    """``run`` of all places 0 .. rows - 1 at once; where it fails, of each half, down to the row that is to blame.

    Returns a tuple of ``width`` values for each row (nulls where it failed) and the failure's text, null elsewhere.
    """
    out: list[tuple] = [(None,) * width] * rows
    errors: list[str | None] = [None] * rows
    open_ = [np.arange(rows)] if rows else []
    while open_:
        at = open_.pop()
        try:
            found = list(run(at))
        except Exception as problem:
            if len(at) == 1:
                errors[at[0]] = f"error: {type(problem).__name__}: {problem}"
            else:
                open_ += [at[: len(at) // 2], at[len(at) // 2 :]]
            continue
        for place, row in zip(at.tolist(), found, strict=True):
            out[place] = tuple(row)
    return out, errors


UNIT_ROOT = "tau double, used_lag int, n_used int, p_value double, status string"


def unit_root_fit(y: np.ndarray, fixed_lag: int | None = None) -> tuple:
    """t-value of the level in the augmented Dickey-Fuller regression with a constant.

    The lag order has the least AIC over one common sample unless it is fixed. One triangular
    factor of the widest design holds the residual sums of all narrower ones.
    """
    n = len(y)
    if n < 4 or np.ptp(y) == 0:
        return None, None, None, "constant" if n and np.ptp(y) == 0 else "short"
    most = min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2) if fixed_lag is None else fixed_lag
    y = (y - y.mean()) / y.std()
    step = np.diff(y)

    def design(p: int) -> np.ndarray:
        rows = len(step) - p
        lags = [step[p - i : p - i + rows] for i in range(1, p + 1)]
        return np.column_stack([np.ones(rows), y[p : p + rows], *lags, step[p:]])

    if fixed_lag is None:
        wide = np.linalg.qr(design(most), mode="r")
        left = np.cumsum(wide[::-1, -1] ** 2)[::-1]
        rows = len(step) - most
        orders = np.arange(most + 1)
        with np.errstate(divide="ignore"):
            scores = rows * np.log(left[2 : most + 3] / rows) + 2.0 * (orders + 2)
        p = int(np.argmin(scores))
    else:
        p = most
    full = design(p)
    rows, width = full.shape[0], full.shape[1] - 1
    if rows <= width:
        return None, p, rows, "short"
    triangle = np.linalg.qr(full, mode="r")
    inner, target = triangle[:width, :width], triangle[:width, -1]
    if np.min(np.abs(np.diag(inner))) < 1e-12:
        return None, p, rows, "collinear"
    inverse = np.linalg.inv(inner)
    beta = inverse @ target
    left = triangle[width, -1] ** 2
    if left < 1e-20 * np.sum(triangle[:, -1] ** 2):
        return None, p, rows, "exact fit"
    sigma2 = left / (rows - width)
    error = np.sqrt(sigma2 * np.sum(inverse[1] ** 2))
    return float(beta[1] / error), p, rows, "ok"


def unit_root_block(series: list[np.ndarray], fixed_lag: int | None = None) -> list[tuple]:
    """:func:`unit_root_fit` of many series. Those of one length, and then those of one length and lag order, are one stack of matrices."""
    out: list[tuple] = [(None, None, None, "short")] * len(series)
    lengths = np.array([len(y) for y in series])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        block = np.stack([series[i] for i in at]) if n else np.zeros((len(at), 0))
        flat = np.ptp(block, axis=1) == 0 if n else np.zeros(len(at), bool)
        for i in at[flat].tolist():
            out[i] = (None, None, None, "constant")
        at, block = at[~flat], block[~flat]
        if n < 4 or not len(at):
            continue
        most = min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2) if fixed_lag is None else fixed_lag
        y = (block - block.mean(axis=1, keepdims=True)) / block.std(axis=1, keepdims=True)
        lags = np.full(len(at), most)
        if fixed_lag is None:
            wide = np.linalg.qr(_unit_root_design(y, most), mode="r")
            left = np.cumsum(wide[:, ::-1, -1] ** 2, axis=1)[:, ::-1]
            rows, orders = n - 1 - most, np.arange(most + 1)
            with np.errstate(divide="ignore"):
                lags = np.argmin(rows * np.log(left[:, 2 : most + 3] / rows) + 2.0 * (orders + 2), axis=1)
        for p in np.unique(lags).tolist():
            same = np.flatnonzero(lags == p)
            for i, row in zip(at[same].tolist(), _unit_root_values(_unit_root_design(y[same], p), p), strict=True):
                out[i] = row
    return out


def _unit_root_design(y: np.ndarray, p: int) -> np.ndarray:
    """For each series the constant, the level, p lagged differences and the difference they explain."""
    step = np.diff(y, axis=1)
    rows = step.shape[1] - p
    lags = [step[:, p - i : p - i + rows] for i in range(1, p + 1)]
    return np.stack([np.ones((len(y), rows)), y[:, p : p + rows], *lags, step[:, p:]], axis=2)


def _unit_root_values(full: np.ndarray, p: int) -> list[tuple]:
    rows, width = full.shape[1], full.shape[2] - 1
    if rows <= width:
        return [(None, p, rows, "short")] * len(full)
    triangle = np.linalg.qr(full, mode="r")
    inner, target = triangle[:, :width, :width], triangle[:, :width, -1]
    collinear = np.abs(np.diagonal(inner, axis1=1, axis2=2)).min(axis=1) < 1e-12
    inverse = np.linalg.inv(np.where(collinear[:, None, None], np.eye(width), inner))
    beta = (inverse[:, 1, :] * target).sum(axis=1)
    left = triangle[:, width, -1] ** 2
    exact = left < 1e-20 * (triangle[:, :, -1] ** 2).sum(axis=1)
    error = np.sqrt(left / (rows - width) * (inverse[:, 1, :] ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        tau = beta / error
    return [(None, p, rows, "collinear") if c else (None, p, rows, "exact fit") if e else (float(t), p, rows, "ok") for c, e, t in zip(collinear, exact, tau, strict=True)]


def unit_root_udf(surface, fixed_lag: int | None = None):
    """Pandas UDF (series) -> struct of ``UNIT_ROOT``; ``surface`` turns the t-value into a p-value."""

    def p_value(tau: float | None) -> float | None:
        if tau is None:
            return None
        if tau > surface["max"]:
            return 1.0
        if tau < surface["min"]:
            return 0.0
        weights = surface["small"] if tau <= surface["star"] else surface["large"]
        z = sum(w * tau**i for i, w in enumerate(weights))
        return 0.5 * math.erfc(-z / math.sqrt(2.0))

    @F.pandas_udf(UNIT_ROOT)
    def fit(series: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [(None, None, None, "not tested")] * len(series)
        asked = [i for i, values in enumerate(series) if values is not None]
        values = [np.asarray(series.iloc[i], dtype=float) for i in asked]
        found, errors = isolated(lambda at: unit_root_block([values[i] for i in at], fixed_lag), len(values), 4)
        for i, row, error in zip(asked, found, errors, strict=True):
            rows[i] = row if error is None else (None, None, None, error)
        out = pd.DataFrame(rows, columns=["tau", "used_lag", "n_used", "status"])
        out.insert(3, "p_value", [p_value(row[0]) for row in rows])
        return out.astype({"tau": "float64", "used_lag": "Int32", "n_used": "Int32", "p_value": "float64"})

    return fit.asNondeterministic()


CSS = "phi double, theta double, seasonal_phi double, seasonal_theta double, sse double, n_used int, error string"


def _right_aligned(series, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values at the right edge of a block, where the recursion runs, and where squares are summed."""
    lengths = np.array([len(v) for v in series])
    width = int(lengths.max())
    block = np.zeros((len(series), width))
    for row, values in enumerate(series):
        block[row, width - len(values) :] = values
    place = np.arange(width)[None, :] - (width - lengths)[:, None]  # 0 at the first value of a row
    return block, (place >= 1).astype(float), (place >= np.maximum(skip, 1)[:, None]).astype(float)


def _moments(block, runs, sums, theta, big_theta, season):
    """Sums of products of four filtered series, for a grid of moving-average values per row.

    The series are w(t), w(t-1), w(t-s), w(t-s-1), each passed through the inverse of the
    moving-average polynomial, starting from zero. The residual is a combination of them.
    """
    rows, width = block.shape
    lags = (0, 1, season, season + 1) if season else (0, 1)
    kinds = len(lags)
    memory = season + 1 if season else 1
    past = np.zeros((memory, kinds, rows, theta.shape[1]))
    out = np.zeros((kinds, kinds, rows, theta.shape[1]))
    for t in range(1, width):
        now = np.stack([block[:, t - lag] if t >= lag else np.zeros(rows) for lag in lags])[:, :, None]
        value = now - theta * past[(t - 1) % memory]
        if season:
            value = value - big_theta * (past[(t - season) % memory] + theta * past[(t - season - 1) % memory])
        value = value * runs[:, t][:, None]
        past[t % memory] = value
        if sums[:, t].any():
            weighted = value * sums[:, t][:, None]
            for i in range(kinds):
                for j in range(i, kinds):
                    out[i, j] += weighted[i] * value[j]
    for i in range(kinds):
        for j in range(i):
            out[i, j] = out[j, i]
    return out


def _autoregression(m, use_ar: bool, use_seasonal: bool, bound: float):
    """Least squares for the autoregressive values given the moments; exact for one value, alternating
    for the product of two."""
    shape = m.shape[2:]
    phi, big = np.zeros(shape), np.zeros(shape)

    def ratio(top, bottom):
        return np.clip(np.divide(top, bottom, out=np.zeros(shape), where=bottom > 0), -bound, bound)

    for _ in range(12 if use_seasonal else 1):
        if use_ar and use_seasonal:
            phi = ratio(
                m[0, 1] - big * (m[0, 3] + m[1, 2]) + big**2 * m[2, 3],
                m[1, 1] - 2 * big * m[1, 3] + big**2 * m[3, 3],
            )
        elif use_ar:
            phi = ratio(m[0, 1], m[1, 1])
        if use_seasonal:
            big = ratio(
                m[0, 2] - phi * (m[0, 3] + m[1, 2]) + phi**2 * m[1, 3],
                m[2, 2] - 2 * phi * m[2, 3] + phi**2 * m[3, 3],
            )
    weights = [np.ones(shape), -phi, -big, phi * big][: m.shape[0]]
    sse = sum(weights[i] * weights[j] * m[i, j] for i in range(m.shape[0]) for j in range(m.shape[0]))
    return phi, big, sse


def css_fit(series, skip, order, season_order, grids, bound=np.inf, block_rows=64):
    """Conditional least squares of one specification for a list of differenced series.

    ``skip`` is the number of leading values of each series whose squares are not counted (at least
    one). ``grids`` is a list of (step, half count): the first is laid around zero, each later one around
    the best point so far. Returns phi, theta, seasonal phi, seasonal theta, sse, number of squares.
    """
    p, q = order
    sp, sq, season = season_order
    results = np.full((len(series), 6), np.nan)
    good = [i for i, v in enumerate(series) if len(v) > max(skip[i], 1)]
    for start in range(0, len(good), block_rows):
        chosen = good[start : start + block_rows]
        block, runs, sums = _right_aligned([series[i] for i in chosen], np.array([skip[i] for i in chosen]))
        scale = np.sqrt(np.mean(block**2, axis=1))
        scale[scale == 0] = 1.0
        block = block / scale[:, None]
        rows = np.arange(len(chosen))
        best = np.zeros((len(chosen), 2))
        for step, half in grids:
            line = np.round(np.arange(-half, half + 1) * step, 6)
            one = line if q else np.zeros(1)
            two = line if sq else np.zeros(1)
            a, b = np.meshgrid(one, two, indexing="ij")
            limit = 0.99
            theta = np.clip(np.round(best[:, :1] + a.ravel(), 6), -limit, limit)
            big_theta = np.clip(np.round(best[:, 1:] + b.ravel(), 6), -limit, limit)
            m = _moments(block, runs, sums, theta, big_theta, season if (sp or sq) else 0)
            phi, big, sse = _autoregression(m, bool(p), bool(sp), bound)
            pick = np.argmin(sse, axis=1)
            best = np.stack([theta[rows, pick], big_theta[rows, pick]], axis=1)
            if not q and not sq:
                break
        found = np.column_stack(
            [
                phi[rows, pick],
                best[:, 0],
                big[rows, pick],
                best[:, 1],
                np.maximum(sse[rows, pick], 0.0) * scale**2,
                sums.sum(axis=1),
            ]
        )
        results[chosen] = found
    return results


def css_udf(order, season_order, grids, bound=np.inf):
    """Pandas UDF (differenced series or null, skipped values) -> struct of ``CSS``."""

    @F.pandas_udf(CSS)
    def fit(series: pd.Series, skip: pd.Series) -> pd.DataFrame:
        values = [np.zeros(0) if v is None else np.asarray(v, dtype=float) for v in series]
        skips = skip.fillna(1).astype(int).to_numpy()
        found, errors = isolated(lambda at: css_fit([values[i] for i in at], skips[at], order, season_order, grids, bound), len(values), 6)
        out = pd.DataFrame(found, columns=["phi", "theta", "seasonal_phi", "seasonal_theta", "sse", "n_used"])
        return out.astype("float64").astype({"n_used": "Int32"}).assign(error=errors)

    return fit.asNondeterministic()


PATH = "errors array<double>, ahead array<double>, growth array<double>, error string"


def _lag_weights(values: dict[str, np.ndarray], season: int) -> tuple[list, list, list]:
    """(lag, weight per row) of the autoregressive part, the moving-average part, and the summing back."""
    phi, big = values["phi"], values["seasonal_phi"]
    theta, big_theta = values["theta"], values["seasonal_theta"]
    d, sd = values["d"], values["sd"]
    return (
        [(1, phi), (season, big), (season + 1, -phi * big)],
        [(1, theta), (season, big_theta), (season + 1, theta * big_theta)],
        [(1, d), (season, sd), (season + 1, -d * sd)],
    )


def _weigh(terms, block, t):
    return sum(weight * block[:, t - lag] for lag, weight in terms if t >= lag)


def css_path(worked, ys, values, steps, season, block_rows=256):
    """Residuals, future values and the running sum of squared impulse responses of fitted models.

    ``worked`` are the differenced series, ``values`` the model values and difference counts per row,
    ``steps`` the number of future months per row.
    """
    out: list[tuple] = [(None, None, None)] * len(worked)
    fitted = ~np.isnan(values["phi"])
    good = [i for i in range(len(worked)) if fitted[i] and len(worked[i])]
    for start in range(0, len(good), block_rows):
        chosen = np.array(good[start : start + block_rows])
        ar, ma, undo = _lag_weights({k: v[chosen] for k, v in values.items()}, season)
        far = max(int(steps[chosen].max()), 1)
        w, runs, _ = _right_aligned([worked[i] for i in chosen], np.ones(len(chosen)))
        y, _, _ = _right_aligned([ys[i] for i in chosen], np.ones(len(chosen)))
        room = np.zeros((len(chosen), far))
        w, y, e = np.hstack([w, room]), np.hstack([y, room]), np.zeros((len(chosen), w.shape[1] + far))
        known = w.shape[1] - far
        for t in range(1, known):
            e[:, t] = runs[:, t] * (w[:, t] - _weigh(ar, w, t) - _weigh(ma, e, t))
        shift = y.shape[1] - w.shape[1]
        impulse_w, impulse_y, impulse_e = (np.zeros((len(chosen), far + 1)) for _ in range(3))
        impulse_w[:, 0] = impulse_y[:, 0] = impulse_e[:, 0] = 1.0
        for k in range(far):
            t = known + k
            w[:, t] = _weigh(ar, w, t) + _weigh(ma, e, t)
            y[:, t + shift] = w[:, t] + _weigh(undo, y, t + shift)
            impulse_w[:, k + 1] = _weigh(ar, impulse_w, k + 1) + _weigh(ma, impulse_e, k + 1)
            impulse_y[:, k + 1] = impulse_w[:, k + 1] + _weigh(undo, impulse_y, k + 1)
        growth = np.cumsum(impulse_y[:, :far] ** 2, axis=1)
        for row, i in enumerate(chosen):
            first = known - len(worked[i])
            ahead = y[row, known + shift : known + shift + steps[i]]
            out[i] = (e[row, first:known].tolist(), ahead.tolist(), growth[row, : steps[i]].tolist())
    return out


def css_path_udf(season):
    """Pandas UDF (differenced series, series, phi, theta, seasonal phi, seasonal theta, d, sd, months)."""

    @F.pandas_udf(PATH)
    def path(
        worked: pd.Series,
        ys: pd.Series,
        phi: pd.Series,
        theta: pd.Series,
        seasonal_phi: pd.Series,
        seasonal_theta: pd.Series,
        d: pd.Series,
        sd: pd.Series,
        months: pd.Series,
    ) -> pd.DataFrame:
        named = {"phi": phi, "theta": theta, "seasonal_phi": seasonal_phi, "seasonal_theta": seasonal_theta}
        values = {k: v.to_numpy(dtype=float) for k, v in {**named, "d": d, "sd": sd}.items()}
        series = [np.zeros(0) if v is None else np.asarray(v, dtype=float) for v in worked]
        steps = months.fillna(0).astype(int).to_numpy()
        some = lambda at: css_path([series[i] for i in at], [ys.iloc[i] for i in at], {k: v[at] for k, v in values.items()}, steps[at], season)
        found, errors = isolated(some, len(series), 3)
        return pd.DataFrame(found, columns=["errors", "ahead", "growth"]).assign(error=errors)

    return path.asNondeterministic()


SMOOTH = (
    "alpha double, beta double, gamma double, level double, trend double, season array<double>, sse double, n_used int, "
    "error string"
)


def smoothing_fit(series, season, grids, block_rows=256):
    """Additive trend and additive season, with the three smoothing values of least squared error.

    The first season gives the starting level and seasonal values, the first two the starting trend.
    """
    out: list[tuple] = [(None,) * 8] * len(series)
    good = [i for i, v in enumerate(series) if len(v) >= 2 * season]
    for start in range(0, len(good), block_rows):
        chosen = good[start : start + block_rows]
        some = [series[i] for i in chosen]
        rows = np.arange(len(chosen))
        best = np.full((len(chosen), 3), 0.5)
        for step, half in grids:
            line = np.arange(-half, half + 1) * step
            cube = np.stack([g.ravel() for g in np.meshgrid(line, line, line, indexing="ij")], axis=-1)
            weights = np.clip(np.round(best[:, None, :] + cube[None], 6), 0.0, 1.0)
            sse, level, trend, seasonal = smoothed(some, season, weights)
            # Without a level's change the trend's value doesn't matter: of equal errors the first, whatever their last digits.
            pick = np.argmax(sse <= sse.min(axis=1, keepdims=True) * (1 + 1e-9), axis=1)
            best = weights[rows, pick]
        for row, i in enumerate(chosen):
            k = pick[row]
            out[i] = (
                *map(float, best[row]),
                float(level[row, k]),
                float(trend[row, k]),
                [float(v) for v in seasonal[:, row, k]],
                float(sse[row, k]),
                int(len(some[row]) - season),
            )
    return out


def smoothed(series, season, weights):
    """Squared errors, level, trend and seasonal values at the end, for each (series, k) of the smoothing values ``weights``."""
    lengths = np.array([len(v) for v in series])
    width = int(lengths.max())
    block = np.zeros((len(series), width))
    for row, values in enumerate(series):
        block[row, : lengths[row]] = values
    first, second = block[:, :season].mean(axis=1), block[:, season : 2 * season].mean(axis=1)
    alpha, beta, gamma = weights[..., 0], weights[..., 1], weights[..., 2]
    shape = alpha.shape
    level = np.broadcast_to(first[:, None], shape).copy()
    trend = np.broadcast_to(((second - first) / season)[:, None], shape).copy()
    seasonal = np.broadcast_to((block[:, :season] - first[:, None]).T[:, :, None], (season, *shape)).copy()
    sse = np.zeros(shape)
    for t in range(season, width):
        live = (t < lengths)[:, None]
        y = block[:, t][:, None]
        place = t % season
        error = y - (level + trend + seasonal[place])
        sse += np.where(live, error * error, 0.0)
        raised = alpha * (y - seasonal[place]) + (1 - alpha) * (level + trend)
        sloped = beta * (raised - level) + (1 - beta) * trend
        turned = gamma * (y - level - trend) + (1 - gamma) * seasonal[place]
        level, trend = np.where(live, raised, level), np.where(live, sloped, trend)
        seasonal[place] = np.where(live, turned, seasonal[place])
    return sse, level, trend, seasonal


def smoothing_udf(season, grids, fit_block=smoothing_fit):
    """Pandas UDF (series) -> struct of ``SMOOTH``; null parts below two seasons. ``fit_block`` is another fit with the same results."""

    @F.pandas_udf(SMOOTH)
    def fit(series: pd.Series) -> pd.DataFrame:
        values = [np.zeros(0) if v is None else np.asarray(v, dtype=float) for v in series]
        names = ["alpha", "beta", "gamma", "level", "trend", "season", "sse", "n_used"]
        found, errors = isolated(lambda at: fit_block([values[i] for i in at], season, *([grids] if grids else [])), len(values), 8)
        out = pd.DataFrame(found, columns=names)
        floats = {name: "float64" for name in names if name not in ("season", "n_used")}
        return out.astype({**floats, "n_used": "Int32"}).assign(error=errors)

    return fit.asNondeterministic()
