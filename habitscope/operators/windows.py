"""Comparisons between parts of a history: windows, splits, positions, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.functions.ordered import chunked, scan

ORDER = ("started_at", "match_id")


def numbered(rows: DataFrame, order=ORDER, hot_rows: int | None = None, keys=("account_id",)) -> DataFrame:
    """Place ``rn`` (oldest first) and size ``n`` of each row among the rows given."""
    one = F.lit(1).cast("bigint")
    base = chunked(rows.drop("rn", "n"), keys, order[0], hot_rows)
    return scan(base, keys, order, {"rn": ("sum", one), "n": ("total", one)})


def position_curve(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Performance by place in the session, places from the fourth on pooled; sessions of two or more."""
    long_enough = sessions.where(F.col("match_count") >= 2).select("account_id", "session_no")
    return (
        rows.where(~F.col("session_corrupt") & F.col("performance").isNotNull())
        .join(long_enough, ["account_id", "session_no"], "left_semi")
        .groupBy("account_id", F.least("session_index", F.lit(4)).alias("position"))
        .agg(F.count(F.lit(1)).alias("sample"), F.avg("performance").alias("mean_performance"))
    )


def transition_groups(rows: DataFrame) -> DataFrame:
    """Medians of activity, deaths and performance after a win and after a loss."""
    usable = rows.where(
        F.col("paired") & ~F.col("prev_corrupt") & ~F.col("session_corrupt") & F.col("prev_won").isNotNull()
    )
    long = usable.select(
        "account_id",
        "prev_won",
        F.explode(
            F.array(
                F.struct(F.lit("activity").alias("metric"), F.col("activity").alias("x")),
                F.struct(F.lit("death").alias("metric"), F.col("death_rate").alias("x")),
                F.struct(F.lit("performance").alias("metric"), F.col("performance").alias("x")),
            )
        ).alias("e"),
    ).select("account_id", "prev_won", "e.metric", "e.x")
    won = F.when(F.col("prev_won"), F.col("x"))
    lost = F.when(~F.col("prev_won"), F.col("x"))
    return (
        long.where(F.col("x").isNotNull())
        .groupBy("account_id", "metric")
        .agg(
            F.count(won).alias("after_win_rows"),
            F.count(lost).alias("after_loss_rows"),
            F.median(won).alias("after_win"),
            F.median(lost).alias("after_loss"),
        )
    )


def recent_and_prior(rows: DataFrame, value: str, hot_rows: int | None = None) -> DataFrame:
    """Medians of the last 20 measured rows and of the 40 before them."""
    placed = numbered(rows.where(F.col(value).isNotNull()), hot_rows=hot_rows)
    back = F.col("n") - F.col("rn")
    recent, prior = back < 20, (back >= 20) & (back < 60)
    return (
        placed.where(back < 60)
        .groupBy("account_id")
        .agg(
            F.first("n").alias("measured"),
            F.count_if(recent).alias("recent_rows"),
            F.count_if(prior).alias("prior_rows"),
            F.median(F.when(recent, F.col(value))).alias("recent"),
            F.median(F.when(prior, F.col(value))).alias("prior"),
        )
    )


def chronological_split(rows: DataFrame, share: float = 0.70, order=ORDER, hot_rows: int | None = None) -> DataFrame:
    """Mark the older part: the first max(1, floor(n * share)) rows."""
    placed = numbered(rows, order, hot_rows)
    return placed.withColumn("older", F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share))))


def balanced_windows(rows: DataFrame, limit: int = 24, hot_rows: int | None = None) -> DataFrame:
    """The last 2k rows as two windows of k = min(limit, n / 2): ``previous`` and ``recent``."""
    placed = numbered(rows, hot_rows=hot_rows)
    k = F.least(F.lit(limit), F.floor(F.col("n") / 2))
    back = F.col("n") - F.col("rn")
    return placed.where(back < 2 * k).withColumn("window", F.when(back < k, "recent").otherwise("previous"))


def longest_streak(rows: DataFrame, value: str, hot_rows: int | None = None) -> DataFrame:
    """Longest run of neighbouring rows with the same value, per account."""
    keys = ("account_id",)
    base = chunked(rows, keys, "started_at", hot_rows, tie="match_id")
    one = F.lit(1).cast("bigint")
    placed = scan(base, keys, ORDER, {"_rn": ("sum", one), "_prev": ("lag", F.col(value))})
    breaks = ~F.coalesce(F.col(value) == F.col("_prev"), F.lit(False))
    islands = scan(placed.withColumn("_b", breaks), keys, ORDER, {"_run": ("max", F.when(F.col("_b"), F.col("_rn")))})
    return (
        islands.groupBy("account_id", value, "_run")
        .agg(F.count(F.lit(1)).alias("length"))
        .groupBy("account_id")
        .agg(F.max("length").alias("longest_streak"))
    )


def quarter_recurrence(rows: DataFrame, by: str = "hero_id", hot_rows: int | None = None) -> DataFrame:
    """Number of different quarters of the history in which a hero appears, as a share of four."""
    placed = numbered(rows, hot_rows=hot_rows)
    quarter = F.least(F.lit(3), F.floor((F.col("rn") - 1) * 4 / F.col("n")))
    return (
        placed.groupBy("account_id", by)
        .agg(F.count_distinct(quarter).alias("quarters"))
        .withColumn("recurrence", F.col("quarters") / 4.0)
    )


def persistence(rows: DataFrame, by: str = "hero_id", patch: Column | None = None) -> DataFrame:
    """Different patches of a hero, or 30-day buckets where no patch is known, over four, at most one."""
    patch = F.lit(None).cast("string") if patch is None else patch
    bucket = F.floor(F.col("started_at") / (30 * 86_400))
    return (
        rows.groupBy("account_id", by)
        .agg(F.count_distinct(patch).alias("patches"), F.count_distinct(bucket).alias("buckets"))
        .withColumn(
            "persistence",
            F.least(F.lit(1.0), F.when(F.col("patches") > 0, F.col("patches")).otherwise(F.col("buckets")) / 4.0),
        )
        .select("account_id", by, "persistence")
    )


def rolling_days(rows: DataFrame, days: int = 7) -> DataFrame:
    """Each active date of an account with the rows of the following ``days`` days.

    A row belongs to at most ``days`` windows, so it is copied to the dates before it and
    matched to the active ones by equality.
    """
    dated = rows.withColumn("day", F.to_date(F.timestamp_seconds("started_at")))
    starts = dated.select("account_id", F.col("day").alias("window_start")).distinct()
    spread = dated.withColumn(
        "window_start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda d: F.date_sub("day", d)))
    )
    return spread.join(starts, ["account_id", "window_start"], "left_semi")
