"""Fits by the exact likelihood and by a search without a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import likelihood
from ..operators import models, select
from .model_queries import BASE, LABEL, four_fits, packed

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


#: Moving-average values at which the likelihood itself is shown.
GIVEN = ((models.AR, 0.0), (models.MA, 0.7), (models.ARMA, -0.4), (models.ARMA, 0.6), (models.ARIMA, -0.8))

WORKED = """wl AS MATERIALIZED (
  SELECT entity, d, t, w, coalesce(lag(w) OVER (PARTITION BY entity, d ORDER BY t), 0) AS wp, m FROM (
    SELECT entity, 0 AS d, t, y AS w, n AS m FROM ser
    UNION ALL
    SELECT entity, 1, t - 1, y - p, n - 1 FROM (SELECT *, lag(y) OVER (PARTITION BY entity ORDER BY t) AS p FROM ser) WHERE p IS NOT NULL) u
), whole AS (SELECT DISTINCT entity, d, m FROM wl)"""


def _filter(name: str, points: str, exact: bool) -> str:
    """Month by month the innovations of w(t) and w(t-1), their variance, and the sums over the months from ``skip`` on."""
    first, f = (("w.w", f"{likelihood.DIFFUSE}") if exact else ("0.0", "1.0"))
    gain = "CASE WHEN r.name = 'AR' OR r.t = 1 THEN 0 ELSE r.theta / r.f END" if exact else "r.theta"
    grown = f"CASE WHEN r.name = 'AR' THEN 1 WHEN r.t = 1 THEN {likelihood.DIFFUSE} + 1 ELSE 1 + r.theta * r.theta - r.theta * r.theta / r.f END" if exact else "1.0"
    return f"""{name}(entity, name, d, theta, basin, skip, t, a, b, f, aa, ab, bb, lf) AS (
      SELECT p.entity, p.name, p.d, p.theta, basin, skip, CAST(1 AS BIGINT), {first}::DOUBLE, 0::DOUBLE, {f}::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE
      FROM {points} p JOIN wl w ON w.entity = p.entity AND w.d = p.d AND w.t = 1
      UNION ALL
      SELECT entity, name, d, theta, basin, skip, t, a, b, f, aa + c * a * a / f, ab + c * a * b / f, bb + c * b * b / f, lf + c * ln(f) FROM (
        SELECT r.entity, r.name, r.d, r.theta, r.basin, r.skip, w.t, r.aa, r.ab, r.bb, r.lf, w.w - {gain} * r.a AS a, w.wp - {gain} * r.b AS b, {grown} AS f,
               CASE WHEN w.t > r.skip THEN 1 ELSE 0 END AS c
        FROM {name} r JOIN wl w ON w.entity = r.entity AND w.d = r.d AND w.t = r.t + 1) s
    )"""


def _valued(run: str) -> str:
    """What a filter has come to at the end of each series."""
    return f"""SELECT r.entity, r.name, r.d, r.theta, basin, CASE WHEN r.name = 'MA' THEN 0 ELSE ab / bb END AS phi, m - skip AS n_used,
      CASE WHEN r.name = 'MA' THEN aa ELSE aa - ab * ab / bb END AS sse, lf FROM {run} r JOIN whole ON whole.entity = r.entity AND whole.d = r.d WHERE r.t = m"""


DEVIANCE = "n_used * (ln(2 * pi() * sse / n_used) + 1) + lf"


def _searched(exact: bool) -> str:
    """Five searches over theta, each ten times finer around the three best places of the first."""
    start = 3 if exact else 2
    parts = [f"""{WORKED}, p1 AS (
      SELECT entity, name, d, CAST(theta AS DOUBLE) AS theta, 0 AS basin, {start} - d AS skip
      FROM whole JOIN (VALUES ('AR', 0), ('MA', 0), ('ARMA', 0), ('ARIMA', 1)) v(name, d) USING (d), (SELECT unnest(range(-19, 20)) * 0.05 AS theta) WHERE name <> 'AR' OR theta = 0
    ), {_filter("r1", "p1", exact)}, b1 AS (
      SELECT entity, name, d, theta, row_number() OVER (PARTITION BY entity, name ORDER BY {DEVIANCE}, theta) AS basin FROM ({_valued("r1")}) QUALIFY basin <= 3)"""]
    for level in range(2, 6):
        step = 0.05 / 10 ** (level - 1)
        parts.append(f"""p{level} AS (
      SELECT DISTINCT entity, name, d, basin, {start} - d AS skip, least({likelihood.EDGE}, greatest(-{likelihood.EDGE}, theta + k * {step:.10f})) AS theta
      FROM b{level - 1}, (SELECT unnest(range(-10, 11)) AS k) WHERE name <> 'AR' OR k = 0
    ), {_filter(f"r{level}", f"p{level}", exact)}, b{level} AS (
      SELECT entity, name, d, theta, basin, phi, n_used, sse, lf FROM ({_valued(f"r{level}")}) QUALIFY row_number() OVER (PARTITION BY entity, name, basin ORDER BY {DEVIANCE}) = 1)""")
    parts.append(f"""scored AS (
      SELECT *, {DEVIANCE} + 2 * CASE name WHEN 'AR' THEN 2 WHEN 'MA' THEN 2 ELSE 3 END AS aic,
        CASE name WHEN 'AR' THEN 0 WHEN 'MA' THEN 1 WHEN 'ARMA' THEN 2 ELSE 3 END AS place
      FROM b5 QUALIFY row_number() OVER (PARTITION BY entity, name ORDER BY {DEVIANCE}) = 1)""")
    return ", ".join(parts)


def _given() -> str:
    rows = ", ".join(f"('{spec.name}', {spec.d}, {theta}, {spec.burn(models.EXACT) - spec.lost})" for spec, theta in GIVEN)
    return f"VALUES {rows}"


@query(
    "exact_likelihood",
    f"""WITH RECURSIVE {BASE}, {WORKED}, p AS (
      SELECT entity, name, v.d, CAST(theta AS DOUBLE) AS theta, 0 AS basin, skip FROM whole JOIN ({_given()}) v(name, d, theta, skip) ON v.d = whole.d
    ), {_filter("r", "p", True)}
    SELECT entity, {LABEL} AS label, theta, round(phi, 6) AS phi, CAST(n_used AS INTEGER) AS n_used, round(-0.5 * ({DEVIANCE}), 6) AS loglik FROM ({_valued("r")})""",
)
def exact_likelihood(spark, folder):
    rows = packed(spark, folder)
    for i, (spec, theta) in enumerate(GIVEN):
        rows = models.likelihood_at(rows, spec, theta).withColumnRenamed("fit", f"fit{i}")
    each = [F.struct(F.lit(spec.label).alias("label"), F.lit(theta).alias("theta"), F.col(f"fit{i}").alias("fit")) for i, (spec, theta) in enumerate(GIVEN)]
    shown = rows.select("entity", F.explode(F.array(*each)).alias("e")).where("e.fit is not null")
    return shown.select("entity", "e.label", "e.theta", F.round("e.fit.phi", 6).alias("phi"), "e.fit.n_used", F.round("e.fit.loglik", 6).alias("loglik"))


def _scores(spark, folder: str, method: models.Method) -> DataFrame:
    fits = four_fits(spark, folder, method).select("entity", F.explode("fits").alias("f"))
    return fits.select("entity", F.col("f.label").alias("label"), F.col("f.n_used").alias("n_used"), F.round("f.aic", 5).alias("aic"))


SCORES = f"SELECT entity, {LABEL} AS label, CAST(n_used AS INTEGER) AS n_used, round(aic, 5) AS aic FROM scored"


@query("exact_scores", f"WITH RECURSIVE {BASE}, {_searched(True)} {SCORES}")
def exact_scores(spark, folder):
    return _scores(spark, folder, models.EXACT)


@query("continuous_scores", f"WITH RECURSIVE {BASE}, {_searched(False)} {SCORES}")
def continuous_scores(spark, folder):
    return _scores(spark, folder, models.CONTINUOUS)


@query(
    "exact_model_report",
    f"""WITH RECURSIVE {BASE}, {_searched(True)}
    SELECT entity, arg_min(name, (aic, place)) AS model,
      arg_min(CASE name WHEN 'AR' THEN '(1, 0, 0)' WHEN 'MA' THEN '(0, 0, 1)' WHEN 'ARMA' THEN '(1, 0, 1)'
              ELSE '(1, 1, 1)' END, (aic, place)) AS model_order,
      '(0, 0, 0, 0)' AS seasonal_order, round(min(aic), 5) AS aic FROM scored GROUP BY 1""",
)
def exact_model_report(spark, folder):
    report = select.model_report(select.choose_best(four_fits(spark, folder, models.EXACT)))
    return report.withColumn("aic", F.round("aic", 5))


@query("exact_seasonal_fit")
def exact_seasonal_fit(spark, folder):
    """The seasonal model by its exact likelihood; its search over two values has no SQL form."""
    fit = F.col("fit")
    rows = models.fit_one(packed(spark, folder), models.SARIMA, method=models.EXACT).where(fit.isNotNull())
    return rows.select("entity", *[F.round(fit[k], 3).alias(k) for k in ("phi", "theta", "seasonal_phi", "seasonal_theta")], fit["n_used"].alias("n_used"), F.round(fit["aic"], 3).alias("aic"))


@query("holt_winters_continuous")
def holt_winters_continuous(spark, folder):
    """Smoothing values searched for without a grid, which SQL can't; never a larger error than ``holt_winters``."""
    rows = models.fit_smoothing(packed(spark, folder), method=models.CONTINUOUS).filter(F.col("smooth").isNotNull())
    return rows.select("entity", *[F.round(f"smooth.{c}", 3).alias(c) for c in ("alpha", "beta", "gamma")], F.round(F.col("smooth.mse") / 1e6, 2).alias("mse_millions"))
