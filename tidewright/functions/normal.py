"""The normal distribution as column expressions (Spark has no erf), accurate to about 1e-7, and its inverse to about 1e-9."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Abramowitz and Stegun 26.2.17.
_P = 0.2316419
_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Coefficients of Acklam's rational approximation of the inverse.
_A1 = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B1 = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C1 = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D1 = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def cdf(x: Column) -> Column:
    t = 1 / (1 + _P * F.abs(x))
    poly = F.lit(0.0)
    for b in reversed(_B):
        poly = (poly + b) * t
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def cdf_sql(x: str) -> str:
    t = f"(1 / (1 + {_P} * abs({x})))"
    poly = "0.0::DOUBLE"
    for b in reversed(_B):
        poly = f"(({poly}) + ({b})) * {t}"
    tail = f"exp(-({x}) * ({x}) / 2) * 0.3989422804014327 * ({poly})"
    return f"CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END"


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def inverse(p: Column) -> Column:
    """Quantile of the normal distribution; null outside (0, 1)."""
    q, low = p - 0.5, F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    middle = _horner(_A1, q * q) * q / _horner(_B1, q * q)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, _horner(_C1, low) / _horner(_D1, low)).when(p > 0.97575, -_horner(_C1, high) / _horner(_D1, high)).otherwise(middle)
