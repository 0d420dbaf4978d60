"""Numeric column expressions: normal distribution, entropy terms, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf(x: Column) -> Column:
    """Standard normal CDF, Zelen-Severo polynomial (absolute error below 7.5e-8)."""
    a = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2.0) * F.lit(0.3989422804014327) * poly
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def sql_norm_cdf(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.2316419 * abs({x})))"
    poly = (f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * "
            f"(-1.821255978 + {t} * 1.330274429)))))")
    tail = f"(exp(-abs({x}) * abs({x}) / 2.0) * 0.3989422804014327 * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def norm_ppf(p: Column) -> Column:
    """Inverse normal CDF (error below 4.5e-4).

    Fixed values: the published rational form, Abramowitz-Stegun 26.2.23.
    """
    q = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), p))
    tail = F.least(q, 1.0 - q)
    t = F.sqrt(-2.0 * F.ln(tail))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1.0 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return F.when(q < 0.5, -z).otherwise(z)


def sql_norm_ppf(p: str) -> str:
    q = f"greatest(1e-10, least(1 - 1e-10, {p}))"
    t = f"sqrt(-2.0 * ln(least({q}, 1.0 - {q})))"
    z = (f"({t} - (2.515517 + {t} * (0.802853 + {t} * 0.010328)) / "
         f"(1.0 + {t} * (1.432788 + {t} * (0.189269 + {t} * 0.001308))))")
    return f"(CASE WHEN {q} < 0.5 THEN -{z} ELSE {z} END)"


def plogp(p: Column) -> Column:
    """``p * log2 p`` with 0 at p = 0."""
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))


def at_least(x: Column, low: float) -> Column:
    """``max(x, low)`` for denominators."""
    return F.greatest(x.cast("double"), F.lit(float(low)))
