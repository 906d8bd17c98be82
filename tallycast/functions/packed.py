"""Arithmetic on a series held as an array column, with built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """``body`` of a value that is worked out once.

    An expression that is named inside the function of a higher-order function is worked out again for
    every element; the variable of a one-element ``transform`` is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def sample_deviation(values: Column) -> Column:
    """Sample standard deviation; null below two values."""
    squares = lambda v, centre: total(F.transform(v, lambda x: (x - centre) * (x - centre)))
    spread = bind(values, lambda v: bind(mean(v), lambda centre: F.sqrt(squares(v, centre) / (F.size(v) - 1))))
    return F.when(F.size(values) > 1, spread)


def sum_of_products(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def differenced(values: Column, lag: int) -> Column:
    """Each value minus the one ``lag`` places before; shorter by ``lag``."""
    later = F.slice(values, lag + 1, F.greatest(F.size(values) - lag, F.lit(0)))
    earlier = F.slice(values, 1, F.greatest(F.size(values) - lag, F.lit(0)))
    return F.zip_with(later, earlier, lambda a, b: a - b)


def autocorrelation(values: Column, lags: int) -> Column:
    """Array of r_0 .. r_lags with the biased (divide by n) estimator; null for a constant series."""

    def deviations(values: Column) -> Column:
        return bind(mean(values), lambda centre: F.transform(values, lambda v: v - centre))

    def ratios(dev: Column) -> Column:
        def products(lag: Column) -> Column:
            overlap = F.greatest(F.size(dev) - lag, F.lit(0))
            return sum_of_products(F.slice(dev, F.lit(1), overlap), F.slice(dev, (lag + 1).cast("int"), overlap))

        steps = F.sequence(F.lit(0), F.lit(lags))
        return bind(
            sum_of_products(dev, dev),
            lambda spread: F.when(spread > 0, F.transform(steps, lambda k: products(k) / spread)),
        )

    return bind(deviations(values), ratios)


def partial_autocorrelation(acf: Column, lags: int) -> Column:
    """Array of partial autocorrelations 1 .. lags out of r_0 .. r_lags (Durbin-Levinson recursion)."""
    empty = F.array().cast("array<double>")
    start = F.struct(acf.alias("acf"), empty.alias("phi"), empty.alias("out"))

    def step(state: Column, k: Column) -> Column:
        phi, acf = state["phi"], state["acf"]
        back = F.reverse(F.slice(acf, 2, (k - 1).cast("int")))
        ahead = F.slice(acf, 2, (k - 1).cast("int"))
        new = (F.get(acf, k) - sum_of_products(phi, back)) / (F.lit(1.0) - sum_of_products(phi, ahead))

        def grown(new: Column) -> Column:
            moved = F.zip_with(phi, F.reverse(phi), lambda a, b: a - new * b)
            return F.struct(
                acf.alias("acf"),
                F.concat(moved, F.array(new)).alias("phi"),
                F.concat(state["out"], F.array(new)).alias("out"),
            )

        return bind(new, grown)

    return F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, step, lambda s: s["out"])
