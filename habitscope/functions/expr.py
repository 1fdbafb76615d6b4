"""Column expressions shared by the scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453
DAY = 86_400


def clamp(value: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(lower), F.least(F.lit(upper), value)))


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def bounded_delta(delta: Column, scale: float) -> Column:
    """tanh-bounded score of a signed difference, 0.5 when nothing moved."""
    return clamp(0.5 + 0.5 * F.tanh(delta / F.lit(max(scale, 1e-6))))


def sigmoid(value: Column) -> Column:
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), value))
    return 1.0 / (1.0 + F.exp(-z))


def recency_weight(started_at: Column, window_end: Column, half_life_days: float = 180.0) -> Column:
    """Exponential half-life weight; rows after the window end count as age zero."""
    age = F.greatest(F.lit(0.0), (window_end - started_at).cast("double"))
    return F.exp(-F.lit(LN2) * age / F.lit(max(half_life_days, 1e-6) * DAY))


def activity_rate(kills: Column, assists: Column, duration: Column) -> Column:
    return F.when(duration >= 600, (kills + assists) / (duration / F.lit(60.0)))


def death_rate(deaths: Column, duration: Column) -> Column:
    return F.when(duration >= 600, deaths / (duration / F.lit(600.0)))


def entropy_term(count: Column, total: Column) -> Column:
    p = count / total
    return F.when(count > 0, -p * F.ln(p)).otherwise(0.0)


def kish(sum_weight: Column, sum_square: Column) -> Column:
    return F.coalesce(F.try_divide(sum_weight * sum_weight, sum_square), F.lit(0.0))


def element_confidence(
    sample: Column, effective: Column, coverage: Column, stability: Column, quality: Column, minimum: Column
) -> Column:
    """Evidence strength of an element, in [0, 1]."""
    sample_part = clamp(F.sqrt(ratio(sample, minimum)))
    effective_part = clamp(F.sqrt(ratio(F.greatest(F.lit(0.0), effective.cast("double")), minimum)))
    score = (
        0.25 * sample_part
        + 0.20 * effective_part
        + 0.20 * clamp(coverage)
        + 0.20 * clamp(stability)
        + 0.15 * clamp(quality)
    )
    return F.when((sample <= 0) | (minimum <= 0), 0.0).otherwise(clamp(score))


def element_confidence_label(score: Column, unavailable: Column) -> Column:
    return (
        F.when(unavailable, "unavailable").when(score >= 0.75, "high").when(score >= 0.50, "moderate").otherwise("low")
    )


def dimension_confidence(
    sample: Column, effective: Column, coverage: Column, stability: Column, quality: Column, minimum: float
) -> Column:
    """Evidence strength of a dimension; zero below the minimum sample."""
    sample_part = F.least(F.lit(1.0), effective.cast("double") / F.lit(float(max(minimum, 1))))
    score = 0.35 * clamp(coverage) + 0.35 * sample_part + 0.20 * clamp(stability) + 0.10 * clamp(quality)
    return F.when((sample < minimum) | (coverage <= 0), 0.0).otherwise(clamp(score))


def dimension_confidence_label(score: Column, unavailable: Column) -> Column:
    return (
        F.when(unavailable | (score <= 0), "unavailable")
        .when(score >= 0.75, "high")
        .when(score >= 0.50, "moderate")
        .otherwise("low")
    )


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share; (0, 1) when nothing was observed."""
    n = total.cast("double")
    p = ratio(successes, total)
    denominator = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    margin = z * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z), 4 * n), n))
    low = F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - margin) / denominator))
    high = F.when(total <= 0, 1.0).otherwise(F.least(F.lit(1.0), (centre + margin) / denominator))
    return low, high


def normal_interval(mean: Column, variance: Column, count: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a mean from its sample variance; zero width for a single value."""
    margin = F.when(count < 2, 0.0).otherwise(z * F.sqrt(F.try_divide(variance, count.cast("double"))))
    return F.coalesce(mean - margin, F.lit(0.0)), F.coalesce(mean + margin, F.lit(0.0))


def interval_label(low: Column, high: Column, null_value: float = 0.0) -> Column:
    inside = (low <= null_value) & (high >= null_value)
    return F.when(inside, "low").when(high - low < 0.25, "high").otherwise("moderate")


def log_odds_ratio(successes: Column, total: Column, other_successes: Column, other_total: Column) -> Column:
    """Log odds ratio with one half added to each of the four cells."""
    left = (successes + 0.5) / (total - successes + 0.5)
    right = (other_successes + 0.5) / (other_total - other_successes + 0.5)
    return F.ln(left / right)


def normal_two_sided_p(value: Column) -> Column:
    """Two-sided normal p-value; rational approximation of erf, absolute error below 1.5e-7."""
    x = F.abs(value) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    # The five published coefficients of the approximation.
    a1, a2, a3, a4, a5 = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    return poly * F.exp(-x * x)


def zone_index(score: Column) -> Column:
    """Zone 0 to 4 by the half-open cuts 0.2, 0.4, 0.6 and 0.8."""
    s = clamp(score)
    return (
        F.when(s.isNull(), None).when(s < 0.20, 0).when(s < 0.40, 1).when(s < 0.60, 2).when(s < 0.80, 3).otherwise(4)
    )
