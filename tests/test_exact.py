"""The exact likelihood against a textbook filter, the search against fine grids, and failures of single rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.functions import kernels, likelihood
from tallycast.operators import models, series
from tallycast.plans import pipeline

from conftest import ledger_of, month_rows


def textbook(w, phi, theta, big_phi, big_theta, season):
    """Log-likelihood (without constants) from full matrices: squares over variances and logarithms, after as many months as there are states."""
    long = lambda a, b: np.convolve([1, a], np.concatenate([[1], np.zeros(season - 1), [b]]) if season else [1])
    ar, ma = -long(-phi, -big_phi)[1:], long(theta, big_theta)
    m = max(len(ar), len(ma))
    move, load = np.zeros((m, m)), np.zeros(m)
    move[: len(ar), 0], load[: len(ma)] = ar, ma
    move[:-1, 1:] += np.eye(m - 1)
    state, spread, squares, logs = np.zeros(m), np.eye(m) * likelihood.DIFFUSE, 0.0, 0.0
    for t, y in enumerate(w):
        error, f = y - state[0], spread[0, 0]
        gain = spread[:, 0] / f
        if t >= m:
            squares, logs = squares + error**2 / f, logs + np.log(f)
        state = move @ (state + gain * error)
        spread = move @ (spread - np.outer(gain, spread[0])) @ move.T + np.outer(load, load)
    return m, squares, logs


@pytest.mark.parametrize(("season", "values"), [(0, (0.6, 0.4, 0, 0)), (0, (0.6, -1.4, 0, 0)), (12, (0.5, -0.3, 0.4, 0.6)), (4, (0.0, 0.8, -0.4, 0.2))])
def test_likelihood_is_that_of_the_state_space_model(season, values):
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=n).cumsum() * 0.3 + rng.normal(size=n) for n in (40, 70, 55)]
    phi, theta, big_phi, big_theta = values
    block, lengths = likelihood._aligned(rows)
    size = likelihood.state_size(1, 1, bool(season), bool(season), season)
    m, logs = likelihood.moments(block, lengths, np.full(3, size), np.full((3, 1), theta), np.full((3, 1), big_theta), season, size, True)
    weights = [1, -phi, -big_phi, phi * big_phi][: len(m)]
    squares = sum(weights[i] * weights[j] * m[i, j, :, 0] for i in range(len(m)) for j in range(len(m)))
    for row, w in enumerate(rows):
        states, want, want_logs = textbook(w, phi, theta, big_phi, big_theta, season)
        assert states == size
        assert squares[row] == pytest.approx(want, rel=1e-9) and logs[row, 0] == pytest.approx(want_logs, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("season", [2, 4, 12])
@pytest.mark.parametrize("first", [(0, 0, 0, 0), (0, 3, 9, 80)])
def test_seasonal_sums_are_those_of_the_filter(season, first):
    rng = np.random.default_rng(5)
    size = season + 2
    rows = [rng.normal(size=n).cumsum() * 0.3 + rng.normal(size=n) for n in (40, 70, 55, 70)]
    block, lengths = likelihood._aligned(rows)
    edge = likelihood.EDGE
    pairs = np.array([(0, 0), (0.5, 0.5), (-0.7, 0.9), (0.3, 0), (0, -0.8), (edge, -edge), (-edge, -edge), (edge, edge)])
    theta, big_theta = np.tile(pairs[:, 0], (4, 1)), np.tile(pairs[:, 1], (4, 1))
    for some in (slice(0, 4), slice(1, 2)):
        given = block[some], lengths[some], size + np.array(first)[some], theta[some], big_theta[some], season
        want, want_logs = likelihood.filtered_moments(*given, size, True)
        got, got_logs = likelihood.seasonal_moments(*given)
        scale = np.sqrt(np.einsum("iirk,jjrk->ijrk", want, want))
        assert (abs(got - want) <= 1e-10 * scale).all() and got_logs == pytest.approx(want_logs, rel=1e-10, abs=1e-10)


def yearly_months(count):
    rng = np.random.default_rng(12)
    return [np.diff(rng.normal(size=n + 1)) + np.tile(rng.normal(size=12), 8)[:n] for n in rng.integers(55, 71, count).tolist()]


def test_an_exact_seasonal_fit_costs_no_multiple_of_the_state():
    rows, skip = yearly_months(32), np.full(32, 14)
    grids = models.PLANE_SEARCH

    def seconds(run):
        begin = time.process_time()
        run()
        return time.process_time() - begin

    plain = min(seconds(lambda: kernels.css_fit(rows, skip, (1, 1), (1, 1, 12), grids)) for _ in range(3))
    exact = min(seconds(lambda: likelihood.fit(rows, skip, (1, 1), (1, 1, 12), True)) for _ in range(2))
    assert exact < 40 * plain  # about 14; with a filter of 14 by 14 elements a month more than 80


def test_a_seasonal_fit_does_not_depend_on_the_rows_beside_it():
    rows, skip = yearly_months(12), np.array([14, 16, 20] * 4)
    together = np.array(likelihood.fit(rows, skip, (1, 1), (1, 1, 12), True))
    alone = [likelihood.fit([w], skip[i : i + 1], (1, 1), (1, 1, 12), True)[0] for i, w in enumerate(rows)]
    assert together == pytest.approx(np.array(alone), rel=1e-5, abs=1e-5)
    assert together == pytest.approx(np.array(likelihood.fit(rows, skip, (1, 1), (1, 1, 12), True, block_rows=5)), rel=1e-5, abs=1e-5)


def simulated(count, months, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        e, w, theta = rng.normal(size=months), np.zeros(months), rng.uniform(-0.9, 0.9)
        for t in range(1, months):
            w[t] = 0.5 * w[t - 1] + e[t] + theta * e[t - 1]
        out.append(w)
    return out


def test_the_search_beats_a_fine_grid():
    rows, skip = simulated(12, 80), np.ones(12, int)
    found = np.array([r[4] for r in likelihood.fit(rows, skip, (1, 1), (0, 0, 0), False)])
    grid = kernels.css_fit(rows, skip, (1, 1), (0, 0, 0), ((0.001, 990),))[:, 4]
    assert (found <= grid * (1 + 1e-12)).all() and (found < grid).mean() > 0.9
    rng = np.random.default_rng(9)
    yearly = [np.tile(rng.normal(size=12), 6) + rng.normal(size=72) * 0.5 for _ in range(8)]
    seasonal = likelihood.fit(yearly, np.ones(8, int), (1, 1), (1, 1, 12), False)
    grid = kernels.css_fit(yearly, np.ones(8, int), (1, 1), (1, 1, 12), models.PLANE_SEARCH)
    assert all(a[4] <= b[4] * (1 + 1e-6) for a, b in zip(seasonal, grid))
    smooth, cube = likelihood.smoothing_fit(yearly, 12), kernels.smoothing_fit(yearly, 12, models.CUBE_SEARCH)
    assert all(a[6] <= b[6] for a, b in zip(smooth, cube)) and any(a[6] < 0.999 * b[6] for a, b in zip(smooth, cube))


def test_exact_fit_finds_the_simulated_values():
    rng = np.random.default_rng(7)
    e = rng.normal(size=(6, 2000))
    rows = [np.array(w) for w in (e[:, 1:] + 0.6 * e[:, :-1])]
    found = likelihood.fit(rows, np.ones(6, int), (0, 1), (0, 0, 0), True)
    assert [r[1] for r in found] == pytest.approx([0.6] * 6, abs=0.06)
    short = likelihood.fit([np.ones(2), np.zeros(0), rows[0]], np.ones(3, int), (1, 1), (0, 0, 0), True)
    assert short[0][4] is None and short[1][4] is None and short[2][4] > 0


def test_exact_method_in_a_plan(spark):
    rows = [r for i, w in enumerate(simulated(4, 60)) for r in month_rows(f"e{i}", 100 + 10 * w)] + month_rows("short", [1, 2, 3])
    ledger = ledger_of(spark, rows)
    fits = models.fit_specs(series.packed(series.monthly_series(ledger)), [models.AR, models.ARMA, models.ARIMA], method=models.EXACT)
    by_entity = {r["entity"]: r["fits"] for r in fits.collect()}
    assert {f["n_used"] for f in by_entity["e0"]} == {59 - 3} and all(f["status"] == "ok" for f in by_entity["e1"])
    assert all(f["status"] == "short" for f in by_entity["short"])
    results = pipeline.forecast_ledger(ledger, method=models.EXACT).collect()
    assert {r["entity"]: r["method"] for r in results} == {**{f"e{i}": "model" for i in range(4)}, "short": "naive"}


def test_unit_roots_in_stacks_are_those_of_single_series():
    rng = np.random.default_rng(11)
    rows = [rng.normal(size=n).cumsum() if n % 2 else rng.normal(size=n) for n in rng.integers(3, 60, 80).tolist()]
    rows += [np.ones(20), np.zeros(0), np.arange(30.0), np.tile([1.0, 2.0], 15), np.ones(2)]
    for lag in (None, 0, 3):
        for row, many in zip(rows, kernels.unit_root_block(rows, lag)):
            one = kernels.unit_root_fit(row, lag)
            assert one[1:] == many[1:] and (one[0] is None) == (many[0] is None)
            assert one[0] is None or many[0] == pytest.approx(one[0], rel=1e-9)


def test_isolated_rows():
    def run(at):
        if 5 in at or 9 in at:
            raise ValueError("bad row")
        return [(i, -i) for i in at]

    rows, errors = kernels.isolated(run, 12, 2)
    assert [i for i, e in enumerate(errors) if e] == [5, 9] and errors[5] == "error: ValueError: bad row"
    assert rows[5] == (None, None) and rows[11] == (11, -11)
    assert kernels.isolated(run, 0, 2) == ([], [])


@pytest.mark.parametrize("kernel", ["css_fit", "css_path", "unit_root_block"])
def test_one_bad_entity_leaves_the_others_equal(spark, monkeypatch, kernel):
    rows = [r for i, w in enumerate(simulated(5, 48)) for r in month_rows(f"e{i}", 100 + 10 * w)]
    bad = month_rows("bad", [777_000 + (7 * i * i) % 31 for i in range(48)])
    ledger = ledger_of(spark, rows + bad)
    columns = ("entity", "status", "method", "model", "aic", "path")
    want = {r["entity"]: tuple(r) for r in pipeline.forecast_ledger(ledger).select(*columns).collect()}
    plain = getattr(kernels, kernel)

    def failing(first, *rest, **named):
        whole = rest[0] if kernel == "css_path" else first
        # The bad entity's differences are small numbers, so it is known by its values or, differenced, by whole ones.
        if any(len(v) and (abs(v[-1]) > 500_000 or all(float(x).is_integer() for x in v)) for v in whole):
            raise ArithmeticError("no such fit")
        return plain(first, *rest, **named)

    monkeypatch.setattr(kernels, kernel, failing)
    results = pipeline.forecast_ledger(ledger)
    got = {r["entity"]: tuple(r) for r in results.select(*columns).collect()}
    assert {k: v for k, v in got.items() if k != "bad"} == {k: v for k, v in want.items() if k != "bad"}
    if kernel == "css_fit":  # smoothing steps in and says why
        assert got["bad"][1:4] == ("ok", "smoothing", "HOLT_WINTERS")
        said = results.where("entity = 'bad'").first()["explanations"]
        assert "No model could be fitted: error: ArithmeticError: no such fit" in said
        return
    assert got["bad"][1] == "error: ArithmeticError: no such fit" and got["bad"][2] is None
    summary = {r["entity"]: (r["status"], r["out_path"]) for r in pipeline.run_summary(results, "out/entity_key=").collect()}
    assert summary["bad"] == ("error: ArithmeticError: no such fit", "") and summary["e0"] == ("ok", "out/entity_key=e0/entity=e0")
    assert not pipeline.forecast_rows(results).where("entity = 'bad'").collect()
