"""Model specifications, their fit by conditional least squares, and AIC.

All candidates of a series are fitted in the row that holds the series: no shuffle, no copy of the
series per candidate. The block fit is an Arrow-batched Pandas UDF; differencing, scoring and choosing
are built-in expressions around it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, kernels, likelihood, packed
from ..functions.text import order_text

# (step, half count) of the searches over the moving-average values.
LINE_SEARCH = ((0.05, 19), (0.005, 9))
PLANE_SEARCH = ((0.2, 4), (0.05, 3), (0.0125, 3))
CUBE_SEARCH = ((0.2, 2), (0.05, 2))
ENFORCED_BOUND = 0.99


@dataclass(frozen=True)
class Method:
    """How a specification is fitted.

    ``exact`` is the likelihood of the state-space model with a diffuse start instead of conditional squares; ``continuous`` a search without
    a grid, which the exact likelihood always has.
    """

    exact: bool = False
    continuous: bool = False

    @property
    def gridded(self) -> bool:
        return not (self.exact or self.continuous)


GRID, CONTINUOUS, EXACT = Method(), Method(continuous=True), Method(exact=True)


@dataclass(frozen=True)
class Spec:
    """(p, d, q)(P, D, Q, s); ``enforced`` keeps the autoregressive values inside the unit interval."""

    name: str
    p: int
    d: int
    q: int
    sp: int = 0
    sd: int = 0
    sq: int = 0
    s: int = 0
    enforced: bool = False

    @property
    def lost(self) -> int:
        """Months lost to differencing."""
        return self.d + self.sd * self.s

    @property
    def start(self) -> int:
        """Months without a one-step forecast."""
        return self.lost + 1

    def burn(self, method: Method) -> int:
        """Months whose errors don't count: those without a one-step forecast, or as many as the exact model's state has elements."""
        return self.lost + likelihood.state_size(self.p, self.q, self.sp, self.sq, self.s) if method.exact else self.start

    @property
    def n_values(self) -> int:
        return self.p + self.q + self.sp + self.sq + 1

    @property
    def least_months(self) -> int:
        return fixed.MIN_SEASONAL_MONTHS + self.d if self.s else self.start + self.n_values

    @property
    def label(self) -> str:
        plain = {"AR": f"AR({self.p})", "MA": f"MA({self.q})", "ARMA": f"ARMA({self.p},{self.q})"}
        base = plain.get(self.name, f"{self.name}({self.p},{self.d},{self.q})")
        return f"{base}({self.sp},{self.sd},{self.sq},{self.s})" if self.s else base


AR = Spec("AR", 1, 0, 0)
MA = Spec("MA", 0, 0, 1)
ARMA = Spec("ARMA", 1, 0, 1)
ARIMA = Spec("ARIMA", 1, 1, 1)
SARIMA = Spec("SARIMA", 1, 0, 1, 1, 1, 1, fixed.SEASON)
SARIMA_DIFF = Spec("SARIMA", 1, 1, 1, 1, 1, 1, fixed.SEASON)
SARIMA_FINAL = Spec("SARIMA", 1, 1, 1, 1, 1, 1, fixed.SEASON, enforced=True)


def working_series(ys: Column, d: Column | int, sd: Column | int, s: int = fixed.SEASON) -> Column:
    """The series after d plain and sd seasonal differences."""
    if isinstance(d, int) and isinstance(sd, int):
        out = packed.differenced(ys, 1) if d else ys
        return packed.differenced(out, s) if sd else out
    once = F.when(d == 1, packed.differenced(ys, 1)).otherwise(ys)
    return F.when(sd == 1, packed.differenced(once, s)).otherwise(once)


def aic(sse: Column, n_used: Column, n_values: Column | int, log_f: Column | float = 0.0) -> Column:
    """Gaussian AIC; a perfect fit counts as one with a tiny error. ``log_f`` are the logarithms of the errors' relative variances, summed."""
    spread = F.lit(2 * math.pi) * F.greatest(sse, F.lit(1e-300)) / n_used
    log_f = F.lit(log_f) if isinstance(log_f, float) else log_f
    return F.when(sse.isNotNull() & (n_used > 0), n_used * (F.log(spread) + 1) + log_f + 2.0 * n_values)


def fit_specs(
    series: DataFrame,
    specs: list[Spec],
    active: list[Column] | None = None,
    values: str = "ys",
    column: str = "fits",
    method: Method = GRID,
    first: int = 0,
) -> DataFrame:
    """Add an array of fits, one struct per active specification.

    The squares of all active candidates of a series are summed over the same months (those after the
    longest start among them, and after ``first``), so that their AIC can be compared. A series whose fit fails keeps the others' and has
    the failure as that fit's status.
    """
    n = F.size(values)
    least = [max(spec.least_months, spec.burn(method) + spec.n_values) for spec in specs]
    usable = [(active[i] if active else F.lit(True)) & (n >= least[i]) for i in range(len(specs))]
    start = F.greatest(F.lit(first), F.lit(0), *[F.when(usable[i], spec.burn(method)).otherwise(0) for i, spec in enumerate(specs)])
    rows = series.withColumn("_start", start)
    fitted = {}
    for i, spec in enumerate(specs):
        search = PLANE_SEARCH if spec.s else LINE_SEARCH
        bound = ENFORCED_BOUND if spec.enforced else math.inf
        orders = (spec.p, spec.q), (spec.sp, spec.sq, spec.s)
        udf = kernels.css_udf(*orders, search, bound) if method.gridded else likelihood.likelihood_udf(*orders, method.exact, bound)
        worked = F.when(usable[i], working_series(F.col(values), spec.d, spec.sd))
        fitted[f"_fit{i}"] = udf(worked, (F.col("_start") - spec.lost).cast("int"))
    rows = rows.withColumns(fitted)  # one projection: one round trip to Python for all candidates
    structs = []
    for i, spec in enumerate(specs):
        fit = F.col(f"_fit{i}")
        score = aic(fit["sse"], fit["n_used"], spec.n_values, 0.0 if method.gridded else fit["log_f"])
        score = F.when(~F.isnan(score), score)
        status = F.when(n < least[i], "short").when(fit["error"].isNotNull(), fit["error"]).when(score.isNull(), "no fit").otherwise("ok")
        structs.append(
            F.when(
                active[i] if active else F.lit(True),
                F.struct(
                    F.lit(i).alias("place"),
                    F.lit(spec.name).alias("name"),
                    F.lit(spec.label).alias("label"),
                    *[F.lit(getattr(spec, k)).alias(k) for k in ("p", "d", "q", "sp", "sd", "sq", "s")],
                    F.lit(spec.burn(method)).alias("start"),
                    *[fit[k].alias(k) for k in ("phi", "theta", "seasonal_phi", "seasonal_theta", "sse", "n_used")],
                    (fit["sse"] / fit["n_used"]).alias("sigma2"),
                    score.alias("aic"),
                    status.alias("status"),
                ),
            )
        )
    fits = F.filter(F.array(*structs), lambda f: f.isNotNull())
    return rows.select(*series.columns, fits.alias(column))


def fit_one(series: DataFrame, spec: Spec, values: str = "ys", column: str = "fit", method: Method = GRID, first: int = 0) -> DataFrame:
    """Fit one fixed specification to every series; null where it cannot be fitted. ``first`` months at least don't count."""
    many = fit_specs(series, [spec], values=values, column="_fits", method=method, first=first)
    one = F.get("_fits", F.lit(0))
    return many.withColumn(column, F.when(one["status"] == "ok", one)).drop("_fits")


def likelihood_at(series: DataFrame, spec: Spec, theta: float, big_theta: float = 0.0, values: str = "ys") -> DataFrame:
    """Add ``fit``: the exact likelihood where the moving-average values are given: phi, seasonal_phi, sigma2, n_used, loglik, error.

    Null for series that are too short."""
    udf = likelihood.likelihood_udf((spec.p, spec.q), (spec.sp, spec.sq, spec.s), True, fixed=(theta, big_theta))
    long_enough = F.size(values) > spec.burn(EXACT) + spec.n_values
    rows = series.withColumn("_fit", udf(F.when(long_enough, working_series(F.col(values), spec.d, spec.sd)), F.lit(1)))
    fit, n = F.col("_fit"), F.col("_fit.n_used")
    loglik = -0.5 * aic(fit["sse"], n, 0, fit["log_f"])
    parts = [fit["phi"], fit["seasonal_phi"], (fit["sse"] / n).alias("sigma2"), n.alias("n_used"), loglik.alias("loglik"), fit["error"]]
    return rows.withColumn("fit", F.when(fit["sse"].isNotNull() | fit["error"].isNotNull(), F.struct(*parts))).drop("_fit")


def fit_smoothing(series: DataFrame, values: str = "ys", column: str = "smooth", method: Method = GRID) -> DataFrame:
    """Add the Holt-Winters fit with its mean squared error and AIC; null below two years, and where the fit failed, with
    the failure in ``<column>_error``."""
    udf = kernels.smoothing_udf(fixed.SEASON, CUBE_SEARCH) if method.gridded else kernels.smoothing_udf(fixed.SEASON, None, likelihood.smoothing_fit)
    rows = series.withColumn("_smooth", udf(F.col(values)))
    fit = F.col("_smooth")
    names = ("alpha", "beta", "gamma", "level", "trend", "season", "sse", "n_used")
    n_values = fixed.SEASON + 4
    full = F.struct(
        *[fit[k].alias(k) for k in names],
        (fit["sse"] / fit["n_used"]).alias("mse"),
        F.when(fit["sse"] > 0, fit["n_used"] * F.log(fit["sse"] / fit["n_used"]) + 2.0 * n_values).alias("aic"),
    )
    whole = F.when(fit["sse"].isNotNull() & ~F.isnan(fit["sse"]), full)
    return rows.withColumns({column: whole, f"{column}_error": fit["error"]}).drop("_smooth")


def order_of(fit: Column) -> Column:
    return order_text(fit["p"], fit["d"], fit["q"])


def season_order_of(fit: Column) -> Column:
    return order_text(fit["sp"], fit["sd"], fit["sq"], fit["s"])
