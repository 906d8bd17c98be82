import numpy as np
import pytest
from conftest import ledger_of, month_rows
from pyspark.sql import functions as F

from tallycast.functions import kernels
from tallycast.operators import anomaly, backtest, correlogram, decompose, forecast, models, series, unitroot


def packed_of(spark, named):
    rows = [(name, [float(v) for v in values]) for name, values in named.items()]
    df = spark.createDataFrame(rows, "entity string, ys array<double>")
    months = F.sequence(F.lit("2010-01-01").cast("date"), F.add_months(F.lit("2010-01-01").cast("date"), F.size("ys") - 1), F.expr("interval 1 month"))
    return df.withColumn("months_axis", months).withColumn("last_month", F.element_at("months_axis", -1))


def ar1(phi, n, seed):
    rng = np.random.default_rng(seed)
    out = [0.0]
    for _ in range(n):
        out.append(phi * out[-1] + rng.normal())
    return np.array(out[1:])


def brute_residuals(w, phi, theta, big_phi, big_theta, s):
    e = np.zeros(len(w))
    at = lambda v, t: v[t] if t >= 0 else 0.0
    for t in range(1, len(w)):
        e[t] = (
            w[t] - phi * at(w, t - 1) - big_phi * at(w, t - s) + phi * big_phi * at(w, t - s - 1)
            - theta * at(e, t - 1) - big_theta * at(e, t - s) - theta * big_theta * at(e, t - s - 1)
        )
    return e


def test_ar_value_is_recovered():
    y = ar1(0.7, 2000, 1)
    phi, theta, _, _, sse, n = kernels.css_fit([y], [1], (1, 0), (0, 0, 0), models.LINE_SEARCH)[0]
    assert abs(phi - 0.7) < 0.05 and theta == 0 and n == 1999
    assert sse == pytest.approx(np.sum((y[1:] - phi * y[:-1]) ** 2))


def test_ma_value_is_recovered():
    rng = np.random.default_rng(2)
    e = rng.normal(size=2001)
    y = e[1:] + 0.5 * e[:-1]
    phi, theta, *_ = kernels.css_fit([y], [1], (0, 1), (0, 0, 0), models.LINE_SEARCH)[0]
    assert phi == 0 and abs(theta - 0.5) < 0.06


def test_fits_do_not_depend_on_the_block():
    rng = np.random.default_rng(3)
    many = [rng.normal(size=n) for n in (40, 25, 61, 33)]
    together = kernels.css_fit(many, [1] * 4, (1, 1), (1, 1, 12), models.PLANE_SEARCH)
    alone = [kernels.css_fit([v], [1], (1, 1), (1, 1, 12), models.PLANE_SEARCH)[0] for v in many]
    assert np.allclose(together, alone)


def test_seasonal_sse_matches_plain_recursion():
    rng = np.random.default_rng(4)
    w = rng.normal(size=70)
    phi, theta, big_phi, big_theta, sse, n = kernels.css_fit([w], [3], (1, 1), (1, 1, 12), models.PLANE_SEARCH)[0]
    e = brute_residuals(w, phi, theta, big_phi, big_theta, 12)
    assert n == 67 and sse == pytest.approx(np.sum(e[3:] ** 2), rel=1e-9)
    # No point of a coarse independent search is better.
    values = np.linspace(-0.9, 0.9, 7)
    best = min(
        np.sum(brute_residuals(w, a, b, c, d, 12)[3:] ** 2) for a in values for b in values for c in values for d in values
    )
    assert sse <= best * 1.02


def test_enforced_values_stay_inside():
    y = 1.05 ** np.arange(60)
    free = kernels.css_fit([y], [1], (1, 0), (0, 0, 0), models.LINE_SEARCH)[0]
    held = kernels.css_fit([y], [1], (1, 0), (0, 0, 0), models.LINE_SEARCH, bound=models.ENFORCED_BOUND)[0]
    assert free[0] == pytest.approx(1.05) and held[0] == 0.99


def test_path_matches_plain_recursion():
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=60)) + 50
    w = (y[1:] - y[:-1])[12:] - (y[1:] - y[:-1])[:-12]
    phi, theta, big_phi, big_theta = 0.4, -0.3, 0.2, -0.5
    values = {"phi": [phi], "theta": [theta], "seasonal_phi": [big_phi], "seasonal_theta": [big_theta], "d": [1], "sd": [1]}
    values = {k: np.array(v, dtype=float) for k, v in values.items()}
    errors, ahead, growth = kernels.css_path([w], [y], values, np.array([30]), 12)[0]
    e = brute_residuals(w, phi, theta, big_phi, big_theta, 12)
    assert np.allclose(errors, e)
    ww, yy, ee = list(w), list(y), list(e) + [0.0] * 30
    for k in range(30):
        t = len(ww)
        ww.append(
            phi * ww[t - 1] + big_phi * ww[t - 12] - phi * big_phi * ww[t - 13]
            + theta * ee[t - 1] + big_theta * ee[t - 12] + theta * big_theta * ee[t - 13]
        )
        yy.append(ww[-1] + yy[-1] + yy[-12] - yy[-13])
    assert np.allclose(ahead, yy[60:])
    assert growth[0] == 1 and np.all(np.diff(growth) >= 0) and len(growth) == 30


def test_unit_root_matches_least_squares_search():
    rng = np.random.default_rng(6)
    for y in (np.cumsum(rng.normal(size=80)), rng.normal(size=80), ar1(0.8, 50, 7)):
        n = len(y)
        most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
        step = np.diff(y)

        def regress(p, first):
            rows = range(first, len(step))
            x = np.array([[1, y[t]] + [step[t - i] for i in range(1, p + 1)] for t in rows])
            target = step[first:]
            beta, *_ = np.linalg.lstsq(x, target, rcond=None)
            left = np.sum((target - x @ beta) ** 2)
            error = np.sqrt(left / (len(target) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
            return len(target) * np.log(left / len(target)) + 2 * (p + 2), beta[1] / error

        p = min(range(most + 1), key=lambda q: regress(q, most)[0])
        tau, used, _, status = kernels.unit_root_fit(y)
        assert status == "ok" and used == p and tau == pytest.approx(regress(p, p)[1], rel=1e-8)


def test_unit_root_decisions(spark):
    rng = np.random.default_rng(8)
    rows = packed_of(spark, {"walk": np.cumsum(rng.normal(size=200)), "noise": rng.normal(size=200), "flat": [3] * 30, "short": [1, 2, 3]})
    got = {r.entity: r for r in unitroot.with_unit_root(rows).collect()}
    assert got["walk"].stationary is False and got["noise"].stationary is True
    assert (got["flat"].unit_root_status, got["flat"].stationary) == ("constant", None)
    assert (got["short"].unit_root_status, got["short"].stationary) == ("short", None)


@pytest.mark.parametrize("tau, p", [(-3.43, 0.0100), (-2.86, 0.0502), (-2.57, 0.0994)])
def test_p_values_match_the_published_table(spark, tau, p):
    got = spark.range(1).select(unitroot.p_value(F.lit(tau))).first()[0]
    assert got == pytest.approx(p, abs=5e-5)


def test_decomposition_finds_a_known_season(spark):
    season = np.array([5, -5, 3, -3, 1, -1, 2, -2, 4, -4, 6, -6], dtype=float)
    values = [100 + 2 * t + season[t % 12] for t in range(48)]
    monthly = series.monthly_series(ledger_of(spark, month_rows("a", values)), "keep")
    rows = decompose.decompose(monthly).orderBy("month").collect()
    assert np.allclose([r.seasonal for r in rows[:12]], season, atol=1e-6)
    assert all(r.trend is None for r in rows[:6] + rows[-6:])
    assert np.allclose([r.residual for r in rows[6:-6]], 0, atol=1e-6)
    short = decompose.seasonality(series.monthly_series(ledger_of(spark, month_rows("b", values[:23])), "keep")).first()
    assert short.seasonal is False and short.season_amplitude is None


def test_pacf_of_ar1(spark):
    rows = correlogram.correlogram(packed_of(spark, {"a": ar1(0.6, 3000, 9)})).orderBy("lag").collect()
    assert rows[0].acf == 1.0 and abs(rows[1].pacf - 0.6) < 0.05 and abs(rows[2].pacf) < 0.06
    assert len(rows) == 25


def test_smoothing_follows_a_season(spark):
    season = [10, -10, 5, -5, 0, 3, -3, 8, -8, 2, -2, 0]
    values = [200 + season[t % 12] for t in range(60)]
    row = packed_of(spark, {"a": values, "short": values[:20]})
    fitted = models.fit_smoothing(row).withColumn("path", forecast.smooth_path(F.col("smooth"), F.size("ys"), F.lit(12)))
    got = {r.entity: r for r in fitted.collect()}
    want = [200 + season[t % 12] for t in range(60, 72)]
    assert np.allclose([p.value for p in got["a"].path], want)
    assert got["short"].smooth is None


def test_planted_outlier_is_found_both_ways(spark):
    rng = np.random.default_rng(10)
    values = rng.normal(size=60)
    values[40] += 12
    fitted = forecast.with_path(models.fit_one(packed_of(spark, {"a": values}), models.AR), F.lit(1))
    rows = anomaly.scan(anomaly.fitted_rows(fitted)).collect()
    worst = max(rows, key=lambda r: r.std_deviations)
    assert worst.anomaly_date.isoformat() == "2013-05-01" and worst.severity == "HIGH"
    assert "supérieure" in worst.description and worst.description.startswith("🔴")
    listed = fitted.select(anomaly.anomaly_list().alias("x")).first().x
    assert sorted((a.date, round(a.residual, 6)) for a in listed) == sorted(
        (r.anomaly_date.isoformat(), round(r.residual, 6)) for r in rows
    )
    assert [a.severity for a in listed] == sorted((a.severity for a in listed))  # HIGH before MEDIUM
    assert listed[0].date == "2013-05-01"


def test_burn_in_counts_when_asked(spark):
    values = 1000 + np.random.default_rng(11).normal(size=40)
    fitted = forecast.with_path(models.fit_one(packed_of(spark, {"a": values}), models.AR), F.lit(1))
    assert anomaly.fitted_rows(fitted).count() == 39
    first = anomaly.fitted_rows(fitted, include_burn_in=True).orderBy("month").first()
    assert first.predicted == 0 and first.residual == pytest.approx(values[0])


def test_no_spread_no_anomaly(spark):
    rows = [("a", f"2024-0{m}-01", 5.0, 5.0, 0.0) for m in range(1, 9)]
    df = spark.createDataFrame(rows, "entity string, month string, y double, predicted double, residual double")
    assert anomaly.scan(df).count() == 0


def test_backtest_of_a_perfect_season(spark):
    season = [10, -10, 5, -5, 0, 3, -3, 8, -8, 2, -2, 0]
    rng = np.random.default_rng(12)
    values = [500 + 2 * t + season[t % 12] + 0.01 * rng.normal() for t in range(72)]
    row = backtest.mape(backtest.tested_rows(packed_of(spark, {"a": values, "short": values[:30]}))).collect()
    assert len(row) == 1 and row[0].n_tested == 12 and row[0].mape < 0.01
