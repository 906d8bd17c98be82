"""Correlograms, unit roots, model scores, choices, forecasts, anomalies, back-tests, pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import (
    anomaly,
    backtest,
    clean,
    correlogram,
    decompose,
    forecast,
    models,
    select,
    series,
    unitroot,
)
from ..plans import pipeline
from .ledger_queries import DECOMPOSED, asked_months
from .ledgers import INCOMPLETE, MONTHLY, PROFILE, SAFE, SUPPLIER, customer_ledger, supplier_ledger

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


BASE = f"{SUPPLIER}, {MONTHLY}"


def monthly(spark, folder: str) -> DataFrame:
    return series.monthly_series(supplier_ledger(spark, folder))


def packed(spark, folder: str) -> DataFrame:
    return series.packed(monthly(spark, folder))


# --- Correlogram ----------------------------------------------------------------------------------------------------

ACF = """dev AS (SELECT entity, t, n, y - avg(y) OVER (PARTITION BY entity) AS d FROM ser),
var AS (SELECT entity, sum(d * d) AS v FROM dev GROUP BY 1),
acf AS (
  SELECT e.entity, e.n, e.lag, CASE WHEN e.lag = 0 THEN 1.0 ELSE sum(a.d * b.d) / any_value(v) END AS r
  FROM (SELECT DISTINCT entity, n, unnest(generate_series(0, 24)) AS lag FROM ser) e
  JOIN var ON var.entity = e.entity
  JOIN dev a ON a.entity = e.entity
  JOIN dev b ON b.entity = a.entity AND b.t = a.t + e.lag
  GROUP BY 1, 2, 3
)"""


@query(
    "acf",
    f"""WITH {BASE}, {ACF} SELECT entity, CAST(lag AS INTEGER) AS lag, round(r, 7) AS acf,
    round(1.959963984540054 / sqrt(n), 7) AS band FROM acf""",
)
def acf(spark, folder):
    rows = correlogram.correlogram(packed(spark, folder))
    return rows.select("entity", "lag", F.round("acf", 7).alias("acf"), F.round("band", 7).alias("band"))


@query(
    "pacf",
    f"""WITH RECURSIVE {BASE}, {ACF},
    rs AS (SELECT entity, list(r ORDER BY lag) AS r FROM acf GROUP BY 1),
    dl(entity, r, k, phi, value) AS (
      SELECT entity, r, 0, CAST([] AS DOUBLE[]), CAST(1 AS DOUBLE) FROM rs
      UNION ALL
      SELECT entity, r, k + 1,
        list_append([phi[i] - new * phi[k + 1 - i] for i in range(1, k + 1)], new), new
      FROM (SELECT *,
              (r[k + 2] - list_sum(list_append([phi[i] * r[k + 2 - i] for i in range(1, k + 1)], CAST(0 AS DOUBLE))))
              / (1 - list_sum(list_append([phi[i] * r[i + 1] for i in range(1, k + 1)], CAST(0 AS DOUBLE)))) AS new
            FROM dl WHERE k < 24) s
    )
    SELECT entity, CAST(k AS INTEGER) AS lag, round(value, 6) AS pacf FROM dl WHERE k > 0""",
)
def pacf(spark, folder):
    rows = correlogram.correlogram(packed(spark, folder)).filter("lag > 0")
    return rows.select("entity", "lag", F.round("pacf", 6).alias("pacf"))


# --- Unit root ------------------------------------------------------------------------------------------------------

POLY_SMALL = "2.1659 + tau * (1.4412 + tau * 0.038269)"
POLY_LARGE = "1.7339 + tau * (0.93202 + tau * (-0.12745 + tau * -0.010368))"
# The level of the distribution function is compared through its argument: z <= -1.6448536 is p <= 0.05.
STATIONARY = f"""CASE WHEN tau > 2.74 THEN false WHEN tau < -18.83 THEN true
  ELSE (CASE WHEN tau <= -1.61 THEN {POLY_SMALL} ELSE {POLY_LARGE} END) <= -1.6448536269514722 END"""


@query(
    "df_test",
    f"""WITH {BASE}, p AS (
      SELECT entity, y - b AS step, b FROM (
        SELECT entity, y, lag(y) OVER (PARTITION BY entity ORDER BY month) AS b FROM ser) WHERE b IS NOT NULL
    ), s AS (SELECT entity, count(*) AS n_used, regr_slope(step, b) AS slope, regr_sxx(step, b) AS sxx,
             regr_syy(step, b) AS syy, regr_sxy(step, b) AS sxy FROM p GROUP BY 1
    ), f AS (SELECT entity, n_used, slope / sqrt((syy - sxy * sxy / sxx) / (n_used - 2) / sxx) AS tau FROM s)
    SELECT entity, n_used, round(tau, 6) AS tau, {STATIONARY} AS stationary FROM f""",
)
def df_test(spark, folder):
    rows = unitroot.plain_unit_root(monthly(spark, folder))
    return rows.select("entity", "n_used", F.round("tau", 6).alias("tau"), "stationary")


def _sweeps(source: str, name: str) -> str:
    i, j = "(x // m)", "(x % m)"
    cell = f"""CASE WHEN {i} = k AND {j} = k THEN 1 / a[k * m + k + 1]
             WHEN {i} = k THEN a[k * m + {j} + 1] / a[k * m + k + 1]
             WHEN {j} = k THEN -a[{i} * m + k + 1] / a[k * m + k + 1]
             ELSE a[x + 1] - a[{i} * m + k + 1] * a[k * m + {j} + 1] / a[k * m + k + 1] END"""
    return f"""{name}(entity, m, pivots, k, a) AS (
      SELECT entity, m, pivots, 0, a FROM {source}
      UNION ALL
      SELECT entity, m, pivots, k + 1, [{cell} for x in range(0, m * m)] FROM {name} WHERE k < pivots
    )"""


def _cross(name: str, order: str, rows: str) -> str:
    """Cross products of (1, level, lagged steps 1..order, step), one packed matrix per entity."""
    return f"""{name}x AS (
      SELECT s.entity, s.t, o.p, list_concat([CAST(1 AS DOUBLE), s.level], list_concat(
        [sl.steps[s.t - q] for q in range(1, o.p + 1)], [s.step])) AS x
      FROM st s JOIN {order} o ON o.entity = s.entity JOIN sl ON sl.entity = s.entity
      WHERE s.t > {rows}
    ), {name} AS (
      SELECT entity, any_value(p) + 3 AS m, any_value(p) + 2 AS pivots, count(*) AS n_rows, any_value(p) AS p FROM {name}x GROUP BY 1
    ), {name}c AS (
      SELECT entity, m, pivots, list(v ORDER BY g) AS a FROM (
        SELECT b.entity, b.m, b.pivots, g, sum(x[g // b.m + 1] * x[g % b.m + 1]) AS v
        FROM {name}x JOIN (SELECT *, unnest(range(0, m * m)) AS g FROM {name}) b ON b.entity = {name}x.entity
        GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3
    )"""


ADF_PARTS = f"""sd AS (
  SELECT entity, t, n, (y - avg(y) OVER e) / stddev_pop(y) OVER e AS y FROM ser WINDOW e AS (PARTITION BY entity)
), st AS (
  SELECT entity, t - 1 AS t, n, lag(y) OVER w AS level, y - lag(y) OVER w AS step
  FROM sd WINDOW w AS (PARTITION BY entity ORDER BY t) QUALIFY lag(y) OVER w IS NOT NULL
), sl AS (SELECT entity, list(step ORDER BY t) AS steps FROM st GROUP BY 1
), most AS (
  SELECT DISTINCT entity, least(CAST(ceil(12 * pow(n / 100.0, 0.25)) AS BIGINT), n // 2 - 2) AS p FROM st
), {_cross("wide", "most", "o.p")}, {_sweeps("widec", "ws")},
adf_scored AS (
  SELECT ws.entity, k - 2 AS p, n_rows * ln(a[ws.m * ws.m] / n_rows) + 2 * k AS score
  FROM ws JOIN wide ON wide.entity = ws.entity WHERE k >= 2
), adf_best AS (SELECT entity, arg_min(p, score) AS p FROM adf_scored GROUP BY 1
), {_cross("fin", "adf_best", "o.p")}, {_sweeps("finc", "fs")},
adf AS (
  SELECT fs.entity, p AS used_lag, n_rows AS n_used,
         a[2 * fs.m] / sqrt(a[fs.m * fs.m] / (n_rows - fs.pivots) * a[fs.m + 2]) AS tau
  FROM fs JOIN fin ON fin.entity = fs.entity WHERE k = fs.pivots
)"""


@query(
    "adf_test",
    f"""WITH RECURSIVE {BASE}, {ADF_PARTS}
    SELECT entity, CAST(used_lag AS INTEGER) AS used_lag, CAST(n_used AS INTEGER) AS n_used, round(tau, 5) AS tau,
      {STATIONARY} AS stationary FROM adf""",
)
def adf_test(spark, folder):
    rows = unitroot.with_unit_root(packed(spark, folder))
    return rows.select("entity", "used_lag", "n_used", F.round("tau", 5).alias("tau"), "stationary")


# --- Scores of the four plain models --------------------------------------------------------------------------------

FOUR = [models.AR, models.MA, models.ARMA, models.ARIMA]


def four_fits(spark, folder: str, method: models.Method = models.GRID) -> DataFrame:
    return models.fit_specs(packed(spark, folder), FOUR, method=method)


def _run(name: str, points: str) -> str:
    """The two filtered series and their cross products, month by month, for each theta of ``points``.
    d is the number of differences; squares count after the months that the longest start takes (``start``)."""
    return f"""{name}(entity, d, theta, t, a, b, aa, ab, bb) AS (
      SELECT entity, d, theta, CAST(1 AS BIGINT), 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM {points}
      UNION ALL
      SELECT entity, d, theta, t, a, b, aa + c * a * a, ab + c * a * b, bb + c * b * b FROM (
        SELECT r.entity, r.d, r.theta, w.t, r.aa, r.ab, r.bb, w.w - r.theta * r.a AS a, w.wp - r.theta * r.b AS b,
               CASE WHEN w.t > w.start - r.d THEN 1 ELSE 0 END AS c
        FROM {name} r JOIN wl w ON w.entity = r.entity AND w.d = r.d AND w.t = r.t + 1) s
    )"""


FAMILIES = """(VALUES ('AR', 0, 0), ('MA', 1, 0), ('ARMA', 2, 0), ('ARIMA', 3, 1)) v(name, place, d)"""
SSE = "CASE WHEN v.name = 'MA' THEN aa ELSE aa - ab * ab / bb END"


def _fitted(start: str, source: str = "ser") -> str:
    """The four plain models by two searches over theta. ``start`` is the number of first months whose squares
    do not count, as an expression over a row of ``u``; ``source`` is the table of the series."""
    return f"""wl AS MATERIALIZED (
  SELECT entity, d, t, w, lag(w) OVER (PARTITION BY entity, d ORDER BY t) AS wp, m, {start} AS start FROM (
    SELECT entity, 0 AS d, t, y AS w, n AS m FROM {source}
    UNION ALL
    SELECT entity, 1, t - 1, y - p, n - 1 FROM (
      SELECT *, lag(y) OVER (PARTITION BY entity ORDER BY t) AS p FROM {source}) WHERE p IS NOT NULL) u
), whole AS (SELECT DISTINCT entity, d, m, start FROM wl), p1 AS (
  SELECT entity, d, CAST(k * 0.05 AS DOUBLE) AS theta FROM whole, (SELECT unnest(range(-19, 20)) AS k)
), {_run("r1", "p1")}, c1 AS (
  SELECT entity, name, d, CASE WHEN name = 'AR' THEN 0 ELSE arg_min(theta, sse) END AS theta FROM (
    SELECT r1.entity, v.name, r1.d, theta, {SSE} AS sse
    FROM r1 JOIN whole USING (entity, d) JOIN {FAMILIES} ON v.d = r1.d WHERE t = m) GROUP BY 1, 2, 3
), p2 AS (
  SELECT DISTINCT entity, d, name, least(0.99, greatest(-0.99, round(theta + k * 0.005, 6))) AS theta
  FROM c1, (SELECT unnest(range(-9, 10)) AS k) WHERE name <> 'AR'
  UNION ALL SELECT entity, d, name, theta FROM c1 WHERE name = 'AR'
), p2d AS (SELECT DISTINCT entity, d, theta FROM p2), {_run("r2", "p2d")}, fits AS (
  SELECT entity, name, place, d, arg_min(theta, sse) AS theta, arg_min(phi, sse) AS phi, min(sse) AS sse,
         any_value(m - start) + d AS n_used
  FROM (
    SELECT p2.entity, p2.name, place, p2.d, p2.theta, m, start, {SSE} AS sse,
           CASE WHEN v.name = 'MA' THEN 0 ELSE ab / bb END AS phi
    FROM p2 JOIN {FAMILIES} ON v.name = p2.name
    JOIN r2 ON r2.entity = p2.entity AND r2.d = p2.d AND r2.theta = p2.theta
    JOIN whole ON whole.entity = r2.entity AND whole.d = r2.d WHERE t = m
  ) GROUP BY entity, name, place, d
), scored AS (
  SELECT *, n_used * (ln(2 * pi() * sse / n_used) + 1)
            + 2 * CASE name WHEN 'AR' THEN 2 WHEN 'MA' THEN 2 ELSE 3 END AS aic FROM fits
)"""
FITTED = _fitted("2")
LABEL = "CASE name WHEN 'AR' THEN 'AR(1)' WHEN 'MA' THEN 'MA(1)' WHEN 'ARMA' THEN 'ARMA(1,1)' ELSE 'ARIMA(1,1,1)' END"


@query(
    "css_scores",
    f"""WITH RECURSIVE {BASE}, {FITTED} SELECT entity, {LABEL} AS label, round(phi, 6) AS phi, round(theta, 6) AS theta,
    round(sse / 1e6, 1) AS sse_millions, CAST(n_used AS INTEGER) AS n_used, round(aic, 5) AS aic FROM scored""",
)
def css_scores(spark, folder):
    fits = four_fits(spark, folder).select("entity", F.explode("fits").alias("f"))
    return fits.select(
        "entity",
        F.col("f.label").alias("label"),
        F.round("f.phi", 6).alias("phi"),
        F.round("f.theta", 6).alias("theta"),
        F.round(F.col("f.sse") / 1e6, 1).alias("sse_millions"),
        F.col("f.n_used").alias("n_used"),
        F.round("f.aic", 5).alias("aic"),
    )


@query(
    "candidate_rank",
    f"""WITH RECURSIVE {BASE}, {FITTED}, k AS (
      SELECT entity, {LABEL} AS label, aic, row_number() OVER w AS rank, lead(aic) OVER w AS nxt
      FROM scored WINDOW w AS (PARTITION BY entity ORDER BY aic, place))
    SELECT entity, label, round(aic, 5) AS score, CAST(rank AS INTEGER) AS rank, round(nxt, 5) AS next_score,
      round(nxt - aic, 5) AS delta, round((nxt - aic) / abs(aic), 8) AS relative_delta FROM k""",
)
def candidate_rank(spark, folder):
    ranked = select.rank_scores(select.score_table(four_fits(spark, folder)))
    return ranked.select(
        "entity",
        "label",
        F.round("score", 5).alias("score"),
        "rank",
        F.round("next_score", 5).alias("next_score"),
        F.round("delta", 5).alias("delta"),
        F.round("relative_delta", 8).alias("relative_delta"),
    )


@query(
    "model_report",
    f"""WITH RECURSIVE {BASE}, {FITTED}
    SELECT entity, arg_min(name, (aic, place)) AS model,
      arg_min(CASE name WHEN 'AR' THEN '(1, 0, 0)' WHEN 'MA' THEN '(0, 0, 1)' WHEN 'ARMA' THEN '(1, 0, 1)'
              ELSE '(1, 1, 1)' END, (aic, place)) AS model_order,
      '(0, 0, 0, 0)' AS seasonal_order, round(min(aic), 5) AS aic FROM scored GROUP BY 1""",
)
def model_report(spark, folder):
    report = select.model_report(select.choose_best(four_fits(spark, folder)))
    return report.withColumn("aic", F.round("aic", 5))


def each_fit(spark, folder: str) -> DataFrame:
    """One row per entity and plain model."""
    rows = four_fits(spark, folder).withColumn("last_month", F.element_at("months_axis", -1))
    return rows.select("entity", "months_axis", "ys", "last_month", F.explode("fits").alias("fit")).withColumn(
        "label", F.col("fit.label")
    )


def arma_fit(spark, folder: str) -> DataFrame:
    """One row per entity: the ARMA model of the four alone, over the months that count for all of them."""
    rows = packed(spark, folder).withColumn("last_month", F.element_at("months_axis", -1))
    fitted = models.fit_one(rows, models.ARMA, first=max(spec.start for spec in FOUR))
    return fitted.filter(F.col("fit").isNotNull())


RESIDUALS = f"""{FITTED}, res(entity, name, d, phi, theta, sse, n_used, t, w, e) AS (
  SELECT s.entity, name, s.d, phi, theta, sse, n_used, CAST(1 AS BIGINT), wl.w, 0::DOUBLE
  FROM scored s JOIN wl ON wl.entity = s.entity AND wl.d = s.d AND wl.t = 1
  UNION ALL
  SELECT r.entity, r.name, r.d, phi, theta, sse, n_used, wl.t, wl.w, wl.w - phi * wl.wp - theta * r.e
  FROM res r JOIN wl ON wl.entity = r.entity AND wl.d = r.d AND wl.t = r.t + 1
)"""


@query(
    "forecast_models",
    f"""WITH RECURSIVE {BASE}, {RESIDUALS}, tail AS (
      SELECT res.*, s.y, s.month FROM res JOIN ser s ON s.entity = res.entity AND s.t = res.t + res.d AND s.t = s.n
    ), go(entity, name, d, phi, theta, s2, month, h, wh, yh, psi_w, psi_y, var) AS (
      SELECT entity, name, d, phi, theta, sse / n_used, month, 1, phi * w + theta * e,
             d * y + phi * w + theta * e, 1::DOUBLE, 1::DOUBLE, 1::DOUBLE FROM tail
      UNION ALL
      SELECT entity, name, d, phi, theta, s2, month, h + 1, phi * wh, d * yh + phi * wh, pw, d * psi_y + pw,
             var + (d * psi_y + pw) * (d * psi_y + pw)
      FROM (SELECT *, CASE WHEN h = 1 THEN phi + theta ELSE phi * psi_w END AS pw FROM go) g WHERE h < 12
    )
    SELECT entity, {LABEL} AS label, h, CAST(month + to_months(h) AS DATE) AS month, round(yh, 1) AS value,
      round(yh - 1.959963984540054 * sqrt(s2 * var), 1) AS lower,
      round(yh + 1.959963984540054 * sqrt(s2 * var), 1) AS upper FROM go""",
)
def forecast_models(spark, folder):
    rows = forecast.long_forecast(forecast.with_path(each_fit(spark, folder), F.lit(12)), "label")
    return rows.select("entity", "label", "h", "month", *[F.round(c, 1).alias(c) for c in ("value", "lower", "upper")])


@query(
    "forecast_kpis",
    f"""WITH RECURSIVE {BASE}, {RESIDUALS}, tail AS (
      SELECT res.*, s.y FROM res JOIN ser s ON s.entity = res.entity AND s.t = res.t AND s.t = s.n WHERE name = 'ARMA'
    ), f AS (SELECT entity, y, unnest(generate_series(1, 12)) AS h, phi, phi * w + theta * e AS w1 FROM tail)
    SELECT entity, any_value(y) AS last_value, round(avg(pow(phi, h - 1) * w1), 1) AS mean_forecast,
      round(max(pow(phi, h - 1) * w1) - min(pow(phi, h - 1) * w1), 1) AS forecast_range FROM f GROUP BY 1""",
)
def forecast_kpis(spark, folder):
    chosen = arma_fit(spark, folder)
    ahead = forecast.long_forecast(forecast.with_path(chosen, F.lit(12)))
    rows = forecast.forecast_kpis(monthly(spark, folder), ahead)
    rounded = [F.round(c, 1).alias(c) for c in ("mean_forecast", "forecast_range")]
    return rows.select("entity", "last_value", *rounded)


@query(
    "in_sample_mse",
    f"""WITH RECURSIVE {BASE}, {RESIDUALS} SELECT entity, {LABEL} AS label, round(avg(e * e) / 1e6, 2) AS mse_millions
    FROM res WHERE t > 1 GROUP BY 1, 2""",
)
def in_sample_mse(spark, folder):
    rows = anomaly.fitted_rows(forecast.with_path(each_fit(spark, folder), F.lit(1)), False, "label")
    mse = backtest.in_sample_mse(rows, "label")
    return mse.select("entity", "label", F.round(F.col("mse") / 1e6, 2).alias("mse_millions"))


# --- Anomalies ------------------------------------------------------------------------------------------------------

SCAN = """spread_ AS (SELECT *, stddev_samp(residual) OVER (PARTITION BY entity) AS sd FROM rows_),
an AS (
  SELECT entity, month AS anomaly_date, round(y, 1) AS actual_value, round(y - residual, 1) AS predicted_value,
    round(residual, 1) AS residual, round(abs(residual) / sd, 6) AS std_deviations,
    CASE WHEN abs(residual) / sd >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    CASE WHEN abs(residual) / sd >= 3 THEN '🔴' ELSE '🟡' END || ' Dépense '
      || CAST(CAST(round(abs(residual) / abs(y - residual) * 100) AS BIGINT) AS VARCHAR)
      || '% ' || CASE WHEN residual > 0 THEN 'supérieure' ELSE 'inférieure' END || ' à la normale' AS description
  FROM spread_ WHERE sd > 0 AND abs(residual) / sd >= 2
)
SELECT * FROM an"""


def rounded_anomalies(rows: DataFrame) -> DataFrame:
    numbers = [F.round(c, 1).alias(c) for c in ("actual_value", "predicted_value", "residual")]
    return rows.select(
        "entity", "anomaly_date", *numbers, F.round("std_deviations", 6).alias("std_deviations"), "severity", "description"
    )


@query(
    "anomalies_seasonal",
    f"WITH {BASE}, {DECOMPOSED}, rows_ AS (SELECT * FROM dec WHERE residual IS NOT NULL), {SCAN}",
)
def anomalies_seasonal(spark, folder):
    parts = decompose.decompose(monthly(spark, folder)).filter(F.col("residual").isNotNull())
    expected = parts.withColumn("predicted", F.col("trend") + F.col("seasonal"))
    return rounded_anomalies(anomaly.in_report_order(anomaly.scan(expected)))


@query(
    "anomaly_report",
    f"""WITH {BASE}, {DECOMPOSED}, rows_ AS (SELECT * FROM dec WHERE residual IS NOT NULL), {SCAN.replace("SELECT * FROM an", "")}
    SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 ELSE 1 END, std_deviations DESC, entity, anomaly_date) AS place FROM an""",
)
def anomaly_report(spark, folder):
    parts = decompose.decompose(monthly(spark, folder)).filter(F.col("residual").isNotNull())
    expected = parts.withColumn("predicted", F.col("trend") + F.col("seasonal"))
    return anomaly.placed_in_report(rounded_anomalies(anomaly.scan(expected)))


def _anomalies_of_model(start: str) -> str:
    return f"""WITH RECURSIVE {BASE}, {RESIDUALS}, rows_ AS (
      SELECT s.entity, s.month, s.y, CASE WHEN s.t = 1 THEN s.y ELSE e END AS residual
      FROM res JOIN ser s ON s.entity = res.entity AND s.t = res.t WHERE name = 'ARMA' AND {start}), {SCAN}"""


@query("anomalies_model", _anomalies_of_model("s.t > 1"))
def anomalies_model(spark, folder):
    chosen = arma_fit(spark, folder)
    return rounded_anomalies(anomaly.scan(anomaly.fitted_rows(forecast.with_path(chosen, F.lit(1)))))


@query("anomalies_with_start", _anomalies_of_model("true").replace("abs(residual) / abs(y - residual) * 100", "CASE WHEN y = residual THEN 0 ELSE abs(residual) / abs(y - residual) * 100 END"))
def anomalies_with_start(spark, folder):
    chosen = arma_fit(spark, folder)
    fitted = forecast.with_path(chosen, F.lit(1)).withColumn("anomalies", anomaly.anomaly_list(include_burn_in=True))
    rows = pipeline.anomaly_rows(fitted).withColumn("anomaly_date", F.col("date").cast("date"))
    return rounded_anomalies(rows)


@query(
    "residual_moments",
    f"""WITH RECURSIVE {BASE}, {RESIDUALS} SELECT entity, count(*) AS n_residuals, round(avg(e), 1) AS mean_residual,
    round(stddev_samp(e), 1) AS std_residual FROM res WHERE name = 'ARMA' AND t > 1 GROUP BY 1""",
)
def residual_moments(spark, folder):
    chosen = arma_fit(spark, folder)
    rows = anomaly.residual_moments(anomaly.fitted_rows(forecast.with_path(chosen, F.lit(1))))
    return rows.select("entity", "n_residuals", *[F.round(c, 1).alias(c) for c in ("mean_residual", "std_residual")])


# --- Back-test ------------------------------------------------------------------------------------------------------

# One model alone counts its squares from its own start.
TRAINED = _fitted("1 + d", "tr_")


@query(
    "backtest_mape",
    f"""WITH RECURSIVE {BASE}, tr_ AS (SELECT entity, month, y, t, n - 12 AS n FROM ser WHERE t <= n - 12),
    {RESIDUALS.replace(FITTED, TRAINED)}, tail AS (
      SELECT res.* FROM res JOIN tr_ ON tr_.entity = res.entity AND tr_.t = res.t AND tr_.t = tr_.n WHERE name = 'ARMA'
    ), f AS (
      SELECT s.entity, s.y, pow(phi, s.t - tail.t - 1) * (phi * w + theta * e) AS value
      FROM tail JOIN ser s ON s.entity = tail.entity AND s.t > tail.t)
    SELECT entity, count(*) AS n_tested, CAST(printf('%.6e', avg(abs(y - value) / greatest(abs(y), 2.220446049250313e-16))) AS DOUBLE) AS mape
    FROM f GROUP BY 1""",
)
def backtest_mape(spark, folder):
    rows = backtest.mape(backtest.tested_rows(packed(spark, folder), models.ARMA))
    # A month without payment makes the relative error huge, so it is shown to seven digits.
    return rows.select("entity", "n_tested", significant("mape").alias("mape"))


# --- Exponential smoothing ------------------------------------------------------------------------------------------


def _smooth(name: str, points: str) -> str:
    """Level, trend and the coming twelve seasonal values, month by month, for each set of smoothing values."""
    return f"""{name}(entity, al, be, ga, t, lv, tr, se, sse) AS (
      SELECT p.entity, al, be, ga, CAST(12 AS BIGINT), m1, (m2 - m1) / 12, [v - m1 for v in y12], 0::DOUBLE
      FROM {points} p JOIN s0 ON s0.entity = p.entity
      UNION ALL
      SELECT entity, al, be, ga, t, nl, be * (nl - lv) + (1 - be) * tr,
             list_append(se[2:12], ga * (y - lv - tr) + (1 - ga) * se[1]), sse + er * er
      FROM (SELECT r.*, s.t AS t1, s.y, s.y - (lv + tr + se[1]) AS er,
                   al * (s.y - se[1]) + (1 - al) * (lv + tr) AS nl
            FROM {name} r JOIN ser s ON s.entity = r.entity AND s.t = r.t + 1) q(entity, al, be, ga, t0, lv, tr, se, sse, t, y, er, nl)
    )"""


SMOOTHED = f"""s0 AS (
  SELECT entity, avg(y) FILTER (WHERE t <= 12) AS m1, avg(y) FILTER (WHERE t > 12 AND t <= 24) AS m2,
         list(y ORDER BY t) FILTER (WHERE t <= 12) AS y12, any_value(n) AS n, max(month) AS last_month
  FROM ser WHERE n >= 24 GROUP BY 1
), k2 AS (SELECT unnest(range(-2, 3)) AS k), h1 AS (
  SELECT entity, a, CAST(0.5 + 0.2 * i.k AS DOUBLE) AS al, CAST(0.5 + 0.2 * j.k AS DOUBLE) AS be, CAST(0.5 + 0.2 * l.k AS DOUBLE) AS ga
  FROM s0, (SELECT 1 AS a), k2 i, k2 j, k2 l
), {_smooth("q1", "h1")}, b1 AS (
  SELECT entity, al, be, ga FROM (
    SELECT q1.entity, al, be, ga, sse > min(sse) OVER (PARTITION BY q1.entity) * (1 + 1e-9) AS worse FROM q1 JOIN s0 ON s0.entity = q1.entity AND q1.t = s0.n)
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY worse, al, be, ga) = 1
), h2 AS (
  SELECT DISTINCT entity, least(1, greatest(0, round(al + 0.05 * i.k, 6))) AS al,
    least(1, greatest(0, round(be + 0.05 * j.k, 6))) AS be, least(1, greatest(0, round(ga + 0.05 * l.k, 6))) AS ga
  FROM b1, k2 i, k2 j, k2 l
), {_smooth("q2", "h2")}, b2 AS (
  SELECT * EXCLUDE (worse) FROM (
    SELECT q2.entity, n, last_month, al, be, ga, lv, tr, se, sse, sse > min(sse) OVER (PARTITION BY q2.entity) * (1 + 1e-9) AS worse
    FROM q2 JOIN s0 ON s0.entity = q2.entity AND q2.t = s0.n)
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY worse, al, be, ga) = 1
)"""


@query(
    "holt_winters",
    f"""WITH RECURSIVE {BASE}, {SMOOTHED} SELECT entity, round(al, 4) AS alpha, round(be, 4) AS beta, round(ga, 4) AS gamma,
    round(lv + 1e-7, 1) AS level, round(tr + 1e-7, 3) AS trend, round(sse / (n - 12) / 1e6, 2) AS mse_millions,
    round((n - 12) * ln(sse / (n - 12)) + 32, 5) AS aic FROM b2""",
)
def holt_winters(spark, folder):
    rows = models.fit_smoothing(packed(spark, folder)).filter(F.col("smooth").isNotNull())
    return rows.select(
        "entity",
        *[F.round(f"smooth.{c}", 4).alias(c) for c in ("alpha", "beta", "gamma")],
        # Averages of whole cents can end just halfway, where the last digit of a sum would decide.
        F.round(F.col("smooth.level") + 1e-7, 1).alias("level"),
        F.round(F.col("smooth.trend") + 1e-7, 3).alias("trend"),
        F.round(F.col("smooth.mse") / 1e6, 2).alias("mse_millions"),
        F.round("smooth.aic", 5).alias("aic"),
    )


@query(
    "holt_winters_forecast",
    f"""WITH RECURSIVE {BASE}, {SMOOTHED}, go AS (
      SELECT *, CASE WHEN h = 1 THEN 1 ELSE
          1 + list_sum([pow(al * (1 + be * j) + CASE WHEN j % 12 = 0 THEN ga ELSE 0 END, 2) for j in range(1, h)]) END AS g
      FROM (SELECT *, unnest(generate_series(1, 15)) AS h FROM b2))
    SELECT entity, CAST(h AS INTEGER) AS h, CAST(last_month + to_months(CAST(h AS INTEGER)) AS DATE) AS month,
      round(lv + h * tr + se[(h - 1) % 12 + 1], 1) AS value,
      round(lv + h * tr + se[(h - 1) % 12 + 1] - 1.959963984540054 * sqrt(sse / (n - 12) * g), 1) AS lower,
      round(lv + h * tr + se[(h - 1) % 12 + 1] + 1.959963984540054 * sqrt(sse / (n - 12) * g), 1) AS upper FROM go""",
)
def holt_winters_forecast(spark, folder):
    rows = models.fit_smoothing(packed(spark, folder)).withColumn("last_month", F.element_at("months_axis", -1))
    paths = rows.withColumn("path", forecast.smooth_path(F.col("smooth"), F.size("ys"), F.lit(15)))
    ahead = forecast.long_forecast(paths.filter(F.col("smooth").isNotNull()))
    return ahead.select("entity", "h", "month", *[F.round(c, 1).alias(c) for c in ("value", "lower", "upper")])


# --- The seasonal model (1, 0, 1)(1, 1, 1, 12) -----------------------------------------------------------------------


def _plane(name: str, points: str, tag: str, bound: float | None = None) -> str:
    """Best point of one search. The inverse of the moving-average polynomial is written out as weights
    of the past values; the autoregressive values come from twelve alternating least-squares steps, each kept within ``bound``."""
    held = (lambda x: f"greatest(-{bound}, least({bound}, {x}))") if bound else (lambda x: x)
    return f"""{name}w AS MATERIALIZED (
      SELECT entity, th, bt, place, [list_sum([pow(-th, k - 12 * j) * pow(-bt, j) for j in range(0, k // 12 + 1)])
        for k in range(0, longest)] AS weights
      FROM {points}, (SELECT max(m) AS longest FROM sw{tag})
    ), {name}f AS (
      SELECT g.entity, th, bt, place, list_inner_product(weights[1:t - 1], x0) AS f0, list_inner_product(weights[1:t - 1], x1) AS f1,
        list_inner_product(weights[1:t - 1], x2) AS f2, list_inner_product(weights[1:t - 1], x3) AS f3
      FROM {name}w g JOIN sx{tag} x ON x.entity = g.entity
    ), {name}m AS (
      SELECT entity, th, bt, place, sum(f0 * f0) AS m00, sum(f0 * f1) AS m01, sum(f0 * f2) AS m02, sum(f0 * f3) AS m03,
        sum(f1 * f1) AS m11, sum(f1 * f2) AS m12, sum(f1 * f3) AS m13, sum(f2 * f2) AS m22, sum(f2 * f3) AS m23, sum(f3 * f3) AS m33
      FROM {name}f GROUP BY 1, 2, 3, 4
    ), {name}a AS (
      SELECT *, 0 AS step, 0::DOUBLE AS phi, 0::DOUBLE AS big FROM {name}m
      UNION ALL
      SELECT * EXCLUDE (step, phi, big, nphi), step + 1, nphi,
        {held("(m02 - nphi * (m03 + m12) + nphi * nphi * m13) / (m22 - 2 * nphi * m23 + nphi * nphi * m33)")}
      FROM (SELECT *, {held("(m01 - big * (m03 + m12) + big * big * m23) / (m11 - 2 * big * m13 + big * big * m33)")} AS nphi
            FROM {name}a WHERE step < 12) s
    ), {name} AS (
      SELECT entity, th, bt, phi, big, m00 + phi * phi * m11 + big * big * m22 + phi * phi * big * big * m33
          - 2 * phi * m01 - 2 * big * m02 + 2 * phi * big * m03 + 2 * phi * big * m12 - 2 * phi * phi * big * m13
          - 2 * phi * big * big * m23 AS sse
      FROM {name}a WHERE step = 12 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY sse, place) = 1
    )"""


def _around(best: str, half: int, step: float) -> str:
    def near(c: str, k: str) -> str:
        return f"least(0.99, greatest(-0.99, round({c} + {k} * {step}, 6)))"

    return f"""(SELECT entity, min(place) AS place, th, bt FROM (
        SELECT entity, {near("th", "i")} AS th, {near("bt", "j")} AS bt, (i + {half}) * {2 * half + 1} + j AS place
        FROM {best}, (SELECT unnest(range(-{half}, {half + 1})) AS i), (SELECT unnest(range(-{half}, {half + 1})) AS j))
      GROUP BY entity, th, bt)"""


def _seasonal(d: int = 0, bound: float | None = None, source: str = "ser") -> str:
    """The fit on the seasonal difference, after d plain differences; ``source`` is the table of the series."""
    tag = f"_{d}" if d else ""
    plain = "y" if d == 0 else "y - lag(y) OVER (PARTITION BY entity ORDER BY t)"
    return f"""sw{tag} AS (
  SELECT entity, t - {12 + d} AS t, n - {12 + d} AS m, x - before AS w FROM (
    SELECT *, lag(x, 12) OVER (PARTITION BY entity ORDER BY t) AS before FROM (
      SELECT *, {plain} AS x FROM {source} WHERE n >= {24 + d})) WHERE before IS NOT NULL
), sl2{tag} AS (
  SELECT entity, m, list_concat([CAST(0 AS DOUBLE) for i in range(0, 13)], list(w ORDER BY t)) AS ws FROM sw{tag} GROUP BY 1, 2
), sx{tag} AS MATERIALIZED (
  SELECT entity, t, [ws[13 + t - k] for k in range(0, t - 1)] AS x0, [ws[12 + t - k] for k in range(0, t - 1)] AS x1,
    [ws[1 + t - k] for k in range(0, t - 1)] AS x2, [ws[t - k] for k in range(0, t - 1)] AS x3
  FROM (SELECT *, unnest(range(2, m + 1)) AS t FROM sl2{tag})
), z0{tag} AS (SELECT entity, 0::DOUBLE AS th, 0::DOUBLE AS bt FROM sl2{tag}
), {_plane(f"z1{tag}", _around(f"z0{tag}", 4, 0.2), tag, bound)}, {_plane(f"z2{tag}", _around(f"z1{tag}", 3, 0.05), tag, bound)},
{_plane(f"z3{tag}", _around(f"z2{tag}", 3, 0.0125), tag, bound)}, seasonal_fits{tag} AS (
  SELECT z.entity, phi, th AS theta, big AS seasonal_phi, bt AS seasonal_theta, sse, m - 1 AS n_used,
         (m - 1) * (ln(2 * pi() * sse / (m - 1)) + 1) + 10 AS aic FROM z3{tag} z JOIN sl2{tag} l ON l.entity = z.entity
)"""


SEASONAL = _seasonal()


@query(
    "seasonal_fit",
    f"""WITH RECURSIVE {BASE}, {SEASONAL} SELECT entity, round(phi, 5) AS phi, round(theta, 5) AS theta,
      round(seasonal_phi, 5) AS seasonal_phi, round(seasonal_theta, 5) AS seasonal_theta,
      round(sse / 1e6, 1) AS sse_millions, CAST(n_used AS INTEGER) AS n_used, round(aic, 5) AS aic FROM seasonal_fits""",
)
def seasonal_fit(spark, folder):
    rows = models.fit_one(packed(spark, folder), models.SARIMA).filter(F.col("fit").isNotNull())
    names = ("phi", "theta", "seasonal_phi", "seasonal_theta")
    return rows.select(
        "entity",
        *[F.round(f"fit.{c}", 5).alias(c) for c in names],
        F.round(F.col("fit.sse") / 1e6, 1).alias("sse_millions"),
        F.col("fit.n_used").alias("n_used"),
        F.round("fit.aic", 5).alias("aic"),
    )


# --- Choice of a model by the service rule ---------------------------------------------------------------------------

FLAGS = f"""{DECOMPOSED}, {ADF_PARTS}, flags AS (
  SELECT a.entity, seasonal, stationary, CASE WHEN seasonal THEN 13 WHEN stationary THEN 1 ELSE 2 END AS start
  FROM (SELECT entity, coalesce(max(seasonal) - min(seasonal) > 0.2 * (max(y) - min(y)), false) AS seasonal FROM dec GROUP BY 1) a
  JOIN (SELECT entity, {STATIONARY} AS stationary FROM adf) b ON b.entity = a.entity
)"""
CHOSEN = f"""{FLAGS}, {_fitted("(SELECT start FROM flags WHERE flags.entity = u.entity)")}, {SEASONAL}, cands AS (
  SELECT s.entity, name, CASE name WHEN 'ARIMA' THEN 1 WHEN 'AR' THEN 2 WHEN 'MA' THEN 3 ELSE 4 END AS place, aic
  FROM scored s JOIN flags ON flags.entity = s.entity WHERE (name = 'ARIMA') <> stationary
  UNION ALL
  SELECT s.entity, 'SARIMA', 0, aic FROM seasonal_fits s JOIN flags ON flags.entity = s.entity WHERE seasonal
), ranked AS (
  SELECT *, row_number() OVER w AS rank, lead(name) OVER w AS name2, lead(aic) OVER w AS aic2
  FROM cands WINDOW w AS (PARTITION BY entity ORDER BY aic, place)
), picked AS (
  SELECT *, name = 'SARIMA' AND name2 IS NOT NULL AS judged,
         name = 'SARIMA' AND name2 IS NOT NULL AND NOT (aic2 - aic > 2 AND (aic2 - aic) / abs(aic) > 0.10) AS replaced
  FROM ranked WHERE rank = 1
)"""


@query(
    "select_service",
    f"""WITH RECURSIVE {BASE}, {CHOSEN}, m AS (
      SELECT *, CASE WHEN replaced THEN name2 ELSE name END AS model FROM picked)
    SELECT m.entity, model, CASE model WHEN 'AR' THEN '(1, 0, 0)' WHEN 'MA' THEN '(0, 0, 1)' WHEN 'ARIMA' THEN '(1, 1, 1)'
        ELSE '(1, 0, 1)' END AS model_order,
      CASE model WHEN 'SARIMA' THEN '(1, 1, 1, 12)' ELSE '(0, 0, 0, 0)' END AS seasonal_order,
      round(CASE WHEN replaced THEN aic2 ELSE aic END, 5) AS aic, seasonal, stationary,
      CASE WHEN replaced THEN 'replaced' WHEN judged THEN 'kept' ELSE 'not applicable' END AS margin_rule
    FROM m JOIN flags ON flags.entity = m.entity""",
)
def select_service(spark, folder):
    chosen = pipeline.chosen_models(pipeline.diagnosed_series(supplier_ledger(spark, folder)))
    report = select.model_report(chosen, "seasonal", "stationary", "margin_rule")
    return report.withColumn("aic", F.round("aic", 5))


# --- Pipelines ------------------------------------------------------------------------------------------------------


CLASSIC_BASE = f"{SUPPLIER}, {MONTHLY.replace(INCOMPLETE, 'month = m1 AND m1 > m0')}"
CLASSIC_FLAGS = FLAGS.replace("> 0.2 *", "> 0.1 *").replace("WHEN seasonal THEN 13", "WHEN seasonal AND stationary THEN 13 WHEN seasonal THEN 14")


@query(
    "select_classic",
    f"""WITH RECURSIVE {CLASSIC_BASE}, {CLASSIC_FLAGS},
    {_fitted("(SELECT start FROM flags WHERE flags.entity = u.entity)")}, {SEASONAL}, {_seasonal(1)}, cands AS (
      SELECT s.entity, name, place, '(0, 0, 0, 0)' AS seasonal_order, aic,
        CASE name WHEN 'AR' THEN '(1, 0, 0)' WHEN 'MA' THEN '(0, 0, 1)' WHEN 'ARMA' THEN '(1, 0, 1)' ELSE '(1, 1, 1)' END AS model_order
      FROM scored s JOIN flags ON flags.entity = s.entity WHERE NOT seasonal AND (name = 'ARIMA') <> stationary
      UNION ALL
      SELECT s.entity, 'SARIMA', 0, '(1, 1, 1, 12)', aic, '(1, 0, 1)'
      FROM seasonal_fits s JOIN flags ON flags.entity = s.entity WHERE seasonal AND stationary
      UNION ALL
      SELECT s.entity, 'SARIMA', 0, '(1, 1, 1, 12)', aic, '(1, 1, 1)'
      FROM seasonal_fits_1 s JOIN flags ON flags.entity = s.entity WHERE seasonal AND NOT stationary
    )
    SELECT entity, name AS model, model_order, seasonal_order, round(aic, 5) AS aic FROM cands
    QUALIFY row_number() OVER (PARTITION BY entity ORDER BY aic, place) = 1""",
)
def select_classic(spark, folder):
    diagnosed = pipeline.diagnosed_series(supplier_ledger(spark, folder), "classic")
    report = select.model_report(pipeline.chosen_models(diagnosed, "classic"))
    return report.withColumn("aic", F.round("aic", 5))


@query(
    "select_extended",
    f"""WITH RECURSIVE {BASE}, {CHOSEN}, {SMOOTHED}, all_ AS (
      SELECT entity, name, place, aic FROM cands
      UNION ALL SELECT entity, 'HOLT_WINTERS', 100, (n - 12) * ln(sse / (n - 12)) + 32 FROM b2)
    SELECT entity, name, round(aic, 5) AS score FROM all_
    QUALIFY row_number() OVER (PARTITION BY entity ORDER BY aic, place) = 1""",
)
def select_extended(spark, folder):
    diagnosed = pipeline.diagnosed_series(supplier_ledger(spark, folder))
    scored = models.fit_smoothing(select.service_candidates(diagnosed))
    chosen = select.extended_choice(select.score_table(scored))
    return chosen.select("entity", "name", F.round("score", 5).alias("score"))


def _ahead(w: str, e: str) -> str:
    """Next value of a differenced series out of the ends of its values and errors."""
    return f"""phi * {w}[-1] + big * {w}[-12] - phi * big * {w}[-13] + theta * {e}[-1] + bth * {e}[-12] + theta * bth * {e}[-13]"""


ZEROS = "[CAST(0 AS DOUBLE) for z in range(0, 13)]"


def _paths(params: str, worked: str, source: str = "ser", months: int = 24) -> str:
    """Errors and future of fitted models. ``params`` has (entity, model, d, sd, phi, theta, big, bth, s2), ``worked`` the differenced
    values (entity, d, sd, w) as lists, ``source`` the series."""
    return f"""params AS ({params}
), series_ AS (
  SELECT p.*, list_concat({ZEROS}, w) AS w, list_concat({ZEROS}, y) AS y, len(w) AS m, last_month
  FROM params p
  JOIN (SELECT entity, list(y ORDER BY t) AS y, max(month) AS last_month FROM {source} GROUP BY 1) a ON a.entity = p.entity
  JOIN ({worked}) b ON b.entity = p.entity AND b.d = p.d AND b.sd = p.sd
), errs AS (
  SELECT entity, 1 AS t, m, phi, theta, big, bth, w, list_append({ZEROS}, CAST(0 AS DOUBLE)) AS e FROM series_
  UNION ALL
  SELECT entity, t + 1, m, phi, theta, big, bth, w, list_append(e,
    w[t + 14] - phi * w[t + 13] - big * w[t + 2] + phi * big * w[t + 1] - theta * e[-1] - bth * e[-12] - theta * bth * e[-13])
  FROM errs WHERE t < m
), path AS (
  SELECT s.entity, model, d, sd, s.phi, s.theta, s.big, s.bth, s2, last_month, 0 AS h, s.w, e, y,
    list_append({ZEROS}, CAST(1 AS DOUBLE)) AS pw, list_append({ZEROS}, CAST(1 AS DOUBLE)) AS pe,
    list_append({ZEROS}, CAST(1 AS DOUBLE)) AS py, 0::DOUBLE AS var
  FROM series_ s JOIN errs ON errs.entity = s.entity AND errs.t = errs.m
  UNION ALL
  SELECT entity, model, d, sd, phi, theta, big, bth, s2, last_month, h + 1, list_append(w, nw), list_append(e, CAST(0 AS DOUBLE)),
    list_append(y, nw + d * y[-1] + sd * y[-12] - d * sd * y[-13]), list_append(pw, np), list_append(pe, CAST(0 AS DOUBLE)),
    list_append(py, np + d * py[-1] + sd * py[-12] - d * sd * py[-13]), var + py[-1] * py[-1]
  FROM (SELECT *, {_ahead("w", "e")} AS nw, {_ahead("pw", "pe")} AS np FROM path WHERE h < {months}) q
)"""


SELECTED = f"""{CHOSEN}, m AS (SELECT entity, CASE WHEN replaced THEN name2 ELSE name END AS model FROM picked
), {_paths("""
  SELECT m.entity, model, s.d, 0 AS sd, phi, theta, 0::DOUBLE AS big, 0::DOUBLE AS bth, sse / n_used AS s2
  FROM m JOIN scored s ON s.entity = m.entity AND s.name = model
  UNION ALL
  SELECT m.entity, model, 0, 1, phi, theta, seasonal_phi, seasonal_theta, sse / n_used
  FROM m JOIN seasonal_fits s ON s.entity = m.entity AND model = 'SARIMA'""", """
  SELECT entity, d, 0 AS sd, list(w ORDER BY t) AS w FROM wl GROUP BY 1, 2
  UNION ALL SELECT entity, 0, 1, list(w ORDER BY t) FROM sw GROUP BY 1""")}"""


def _final(source: str, months: int) -> str:
    """The fixed seasonal model, its autoregressive values kept inside the unit interval, and its path."""
    params = "SELECT entity, 'SARIMA' AS model, 1 AS d, 1 AS sd, phi, theta, seasonal_phi AS big, seasonal_theta AS bth, sse / n_used AS s2 FROM seasonal_fits_1"
    worked = "SELECT entity, 1 AS d, 1 AS sd, list(w ORDER BY t) AS w FROM sw_1 GROUP BY 1"
    return f"{_seasonal(1, models.ENFORCED_BOUND, source)}, {_paths(params, worked, source, months)}"


def significant(column, digits: int = 7):
    """A number to so many digits, whatever its size."""
    return F.format_string(f"%.{digits - 1}e", column).cast("double")


def _significant(expression: str, digits: int = 7) -> str:
    return f"CAST(printf('%.{digits - 1}e', {expression}) AS DOUBLE)"


FINAL_BASE = f"{SUPPLIER}, {MONTHLY.replace(INCOMPLETE, 'month = m1')}"


@query(
    "seasonal_final_forecast",
    f"""WITH RECURSIVE {FINAL_BASE}, {_final("ser", 18)}
    SELECT entity, h, CAST(last_month + to_months(h) AS DATE) AS month, round(y[-1], 1) AS value,
      round(y[-1] - 1.959963984540054 * sqrt(s2 * var), 1) AS lower, round(y[-1] + 1.959963984540054 * sqrt(s2 * var), 1) AS upper
    FROM path WHERE h > 0""",
)
def seasonal_final_forecast(spark, folder):
    rows = forecast.long_forecast(pipeline.final_forecast(supplier_ledger(spark, folder)))
    return rows.select("entity", "h", "month", *[F.round(c, 1).alias(c) for c in ("value", "lower", "upper")])


@query(
    "backtest_seasonal",
    f"""WITH RECURSIVE {BASE}, tr_ AS (SELECT entity, month, y, t, n - 12 AS n FROM ser WHERE t <= n - 12), {_final("tr_", 12)}, f AS (
      SELECT s.entity, s.y, path.y[-1] AS value FROM path JOIN ser s ON s.entity = path.entity AND s.t = s.n - 12 + path.h WHERE h > 0)
    SELECT entity, count(*) AS n_tested, {_significant("avg(abs(y - value) / greatest(abs(y), 2.220446049250313e-16))")} AS mape FROM f GROUP BY 1""",
)
def backtest_seasonal(spark, folder):
    rows = backtest.mape(backtest.tested_rows(packed(spark, folder)))
    return rows.select("entity", "n_tested", significant("mape").alias("mape"))


@query(
    "forecast_selected",
    f"""WITH RECURSIVE {BASE}, {PROFILE}, {SELECTED}
    SELECT path.entity, model, 'model' AS method, h, CAST(path.last_month + to_months(h) AS DATE) AS month,
      round(y[-1], 1) AS value, round(y[-1] - 1.959963984540054 * sqrt(s2 * var), 1) AS lower,
      round(y[-1] + 1.959963984540054 * sqrt(s2 * var), 1) AS upper
    FROM path JOIN prof ON prof.entity = path.entity WHERE h BETWEEN 1 AND {SAFE}""",
)
def forecast_selected(spark, folder):
    rows = pipeline.forecast_rows(pipeline.forecast_ledger(supplier_ledger(spark, folder)))
    bands = [F.round(c, 1).alias(c) for c in ("value", "lower", "upper")]
    return rows.select("entity", "model", "method", "h", "month", *bands)


@query("forecast_sparse")
def forecast_sparse(spark, folder):
    ledger = customer_ledger(spark, folder)
    return pipeline.forecast_rows(pipeline.forecast_ledger(ledger, requests=asked_months(spark, folder)))


@query("run_summary")
def run_summary(spark, folder):
    return pipeline.run_summary(pipeline.forecast_ledger(customer_ledger(spark, folder), rule="classic"), "forecasts/")


@query(
    "by_code_pipeline",
    f"""WITH RECURSIVE {BASE}, {PROFILE}, {SELECTED}, asked AS (
      SELECT entity, place, 6 AS wanted FROM (VALUES ('5', 0), ('17', 1), ('no-such-code', 2), ('42', 3)) v(entity, place)),
    known AS (SELECT string_agg(entity, ', ' ORDER BY entity) AS codes FROM (SELECT DISTINCT entity FROM led ORDER BY entity LIMIT 10))
    SELECT a.entity, place, CASE WHEN prof.entity IS NULL THEN 'missing' ELSE 'ok' END AS status, CASE WHEN prof.entity IS NULL THEN codes END AS known_codes,
      CASE WHEN prof.entity IS NOT NULL THEN 'model' END AS method, model, CASE WHEN prof.entity IS NOT NULL THEN wanted END AS months,
      CASE WHEN prof.entity IS NULL THEN NULL WHEN wanted <= {SAFE} THEN 'USER OVERRIDE (6 <= safe ' || {SAFE} || ')' WHEN wanted <= n_months THEN 'USER OVERRIDE (6)' END AS reason,
      h, CAST(path.last_month + to_months(h) AS DATE) AS month, round(y[-1], 1) AS value,
      round(y[-1] - 1.959963984540054 * sqrt(s2 * var), 1) AS lower, round(y[-1] + 1.959963984540054 * sqrt(s2 * var), 1) AS upper
    FROM asked a LEFT JOIN prof ON prof.entity = a.entity LEFT JOIN path ON path.entity = a.entity AND h BETWEEN 1 AND wanted, known""",
)
def by_code_pipeline(spark, folder):
    codes = clean.code_list(spark, "5, 17, no-such-code, 42")
    rows = pipeline.by_code(supplier_ledger(spark, folder), codes, months=6)
    known = F.when(F.col("known_codes").isNotNull(), F.array_join("known_codes", ", "))
    shown = rows.select("entity", "place", "status", known.alias("known_codes"), "method", "model", "months", "reason", "last_month", "path")
    points = shown.select("*", F.posexplode_outer("path").alias("at", "p"))
    month = F.add_months(F.trunc("last_month", "month"), F.col("at") + 1)
    numbers = [F.round(F.col(f"p.{c}"), 1).alias(c) for c in ("value", "lower", "upper")]
    return points.select(*shown.columns[:8], (F.col("at") + 1).alias("h"), month.alias("month"), *numbers)


POOLED_BASE = BASE.replace("CAST(l_suppkey AS VARCHAR) AS entity", "'ALL' AS entity")


@query(
    "whole_ledger_pipeline",
    f"""WITH RECURSIVE {POOLED_BASE}, {PROFILE}, {SELECTED}
    SELECT path.entity, model, 'model' AS method, h, CAST(path.last_month + to_months(h) AS DATE) AS month,
      {_significant("y[-1]", 9)} AS value, {_significant("y[-1] - 1.959963984540054 * sqrt(s2 * var)", 9)} AS lower,
      {_significant("y[-1] + 1.959963984540054 * sqrt(s2 * var)", 9)} AS upper
    FROM path JOIN prof ON prof.entity = path.entity WHERE h BETWEEN 1 AND {SAFE}""",
)
def whole_ledger_pipeline(spark, folder):
    rows = pipeline.forecast_rows(pipeline.whole_ledger(supplier_ledger(spark, folder)))
    # The pooled sums are large, so they're shown to nine digits.
    return rows.select("entity", "model", "method", "h", "month", *[significant(c, 9).alias(c) for c in ("value", "lower", "upper")])


@query(
    "pipeline_anomalies",
    f"""WITH RECURSIVE {BASE}, {SELECTED}, rows_ AS (
      SELECT s.entity, s.month, s.y, e[13 + s.t - (s.n - m)] AS residual
      FROM errs JOIN ser s ON s.entity = errs.entity WHERE errs.t = errs.m AND s.t - (s.n - m) >= 2), {SCAN}""",
)
def pipeline_anomalies(spark, folder):
    rows = pipeline.anomaly_rows(pipeline.forecast_ledger(supplier_ledger(spark, folder)))
    return rounded_anomalies(rows.withColumn("anomaly_date", F.col("date").cast("date")))


@query("result_json")
def result_json(spark, folder):
    rows = pipeline.result_json(pipeline.forecast_ledger(supplier_ledger(spark, folder)))
    return rows.withColumn("document", F.regexp_replace("document", r'"timestamp":"[^"]*",', ""))
