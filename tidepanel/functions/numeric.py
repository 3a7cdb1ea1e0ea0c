"""Numeric expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

SMAPE_EPS = 1e-8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is zero or missing."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def null_if_nan(df: DataFrame) -> DataFrame:
    """One missing-value convention: NaN and infinities in double columns become NULL."""
    cols = {f.name: F.when(is_finite(f.name), F.col(f.name)) for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(cols) if cols else df


def forecast_metrics(actual: Column | str, pred: Column | str) -> dict[str, Column]:
    """MAE, RMSE, WAPE and SMAPE as one-pass aggregates over rows that have a prediction."""
    a, p = col(actual), col(pred)
    err = F.abs(a - p)
    return {
        "MAE": F.avg(err),
        "RMSE": F.sqrt(F.avg(err * err)),
        "WAPE": ratio(F.sum(err), F.sum(F.when(err.isNotNull(), F.abs(a)))),
        "SMAPE": F.avg(2 * err / (F.abs(a) + F.abs(p) + SMAPE_EPS)),
    }


def named(metrics: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in metrics.items()]


def whole(c: Column) -> Column:
    """Floor of a double as a double. From 2^53 on every double is whole, so nothing is cut to the range of BIGINT."""
    return F.when(F.abs(c) < float(2 ** 53), F.floor(c).cast("double")).otherwise(c)


def stable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation form: doubles rounded half-up, dates as ISO text, integers widened to BIGINT, whole decimals as text.

    The order in which a cluster adds doubles is not fixed, so the last bits of an aggregate may differ between
    runs; rounding makes report tables comparable. ``floor(x * 10^d + 0.5) / 10^d`` is used because it is the
    same chain of IEEE operations in every engine.
    """
    scale = float(10 ** digits)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0:
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = whole(c.cast("double") * scale + 0.5) / scale
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- tail probabilities (driver side, scalar inputs)

def normal_sf2(z: float) -> float:
    """Two-sided normal tail probability."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_sf2(t: float, df: float) -> float:
    """Two-sided Student-t tail probability."""
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def student_quantile(p: float, df: float) -> float:
    """Upper quantile: P(T <= q) = p for p > 0.5, by bisection."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1.0 - student_sf2(mid, df) / 2 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution with integer degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if k % 2 == 0:
        term, total = math.exp(-half), math.exp(-half)
        for i in range(1, k // 2):
            term *= half / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(k // 2):
        total += term
        term *= half / (i + 1.5)
    return min(1.0, total)
