"""The per-match measure table that every element reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitscope.functions.expr import activity_rate, clamp, death_rate, sigmoid
from habitscope.functions.ordered import chunked, is_plain
from habitscope.functions.robust import leave_one_out
from habitscope.operators.sessions import sessionize, with_recency
from habitscope.session import cut


def with_rates(rows: DataFrame) -> DataFrame:
    """Activity per minute and deaths per ten minutes, null for short or incomplete rows."""
    return rows.withColumns(
        {
            "activity": activity_rate(F.col("kills"), F.col("assists"), F.col("duration_seconds")),
            "death_rate": death_rate(F.col("deaths"), F.col("duration_seconds")),
        }
    )


def with_performance(rows: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Bounded performance proxy of each match against the account's other matches."""
    centred = leave_one_out(with_rates(rows), ["account_id"], ["activity", "death_rate"], hot_rows)

    def part(distance, scale, known):
        return F.when(known, sigmoid(distance / F.greatest(F.abs(scale), F.lit(1e-6)))).otherwise(0.5)

    activity_part = part(
        F.col("activity") - F.col("activity_centre"), F.col("activity_scale"), F.col("activity").isNotNull()
    )
    survival_part = part(
        F.col("death_rate_centre") - F.col("death_rate"), F.col("death_rate_scale"), F.col("death_rate").isNotNull()
    )
    measured = F.col("won").isNotNull() & (F.col("duration_seconds") >= 600)
    outcome_part = F.when(F.col("won"), 1.0).otherwise(0.0)
    return (
        centred.withColumns(
            {
                "outcome_component": F.when(measured, outcome_part),
                "activity_component": F.when(measured, activity_part),
                "survival_component": F.when(measured, survival_part),
            }
        )
        .withColumn(
            "performance",
            clamp(
                0.50 * F.col("outcome_component")
                + 0.30 * F.col("activity_component")
                + 0.20 * F.col("survival_component")
            ),
        )
        .drop("activity_centre", "activity_scale", "death_rate_centre", "death_rate_scale")
    )


def match_measures(
    matches: DataFrame,
    gap_minutes: int = 90,
    window_end: int | None = None,
    half_life_days: float = 180.0,
    hot_rows: int | None = None,
) -> DataFrame:
    """Sessions, rates, performance and recency weight of every eligible dated match."""
    base = chunked(matches.where(F.col("started_at").isNotNull()), ("account_id",), "started_at", hot_rows, tie="match_id")
    measured = with_performance(base, hot_rows)
    if not is_plain(base):
        # Scans of a table with hot keys read it twice; start them from written files.
        measured = cut(measured)
    return with_recency(sessionize(measured, gap_minutes, hot_rows=hot_rows), window_end, half_life_days)
