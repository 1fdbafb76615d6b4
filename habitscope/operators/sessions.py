"""Sessions, their censoring, and per-row order features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitscope.functions.expr import recency_weight
from habitscope.functions.ordered import chunked, scan, unchunked

ORDER = ("started_at", "match_id")


def sessionize(
    matches: DataFrame,
    gap_minutes: int = 90,
    tolerance_seconds: int = 300,
    keys: Sequence[str] = ("account_id",),
    hot_rows: int | None = None,
    gap_column: str | None = None,
) -> DataFrame:
    """Number sessions per key by the gap from the previous row's END.

    A row opens a session when the gap is longer than allowed, when the previous end is
    missing, or when it overlaps the previous row by more than the tolerance; in the last two
    cases both neighbours are marked.  Adds ``rn`` and ``n`` (place in and size of the
    history), ``session_no``, ``session_index`` and ``session_corrupt``.
    """
    gap = F.col(gap_column) * 60 if gap_column else F.lit(max(1, gap_minutes) * 60)
    dated = chunked(matches.where(F.col("started_at").isNotNull()), keys, "started_at", hot_rows, tie="match_id")
    one = F.lit(1).cast("bigint")
    neighbours = scan(
        dated,
        keys,
        ORDER,
        {
            "rn": ("sum", one),
            "n": ("total", one),
            "_before": ("lag", F.struct(F.col("ended_at").alias("end"))),
            "_after": ("lead", F.struct(F.col("started_at").alias("start"))),
        },
    )
    first = F.col("_before").isNull()
    idle = F.col("started_at") - F.col("_before.end")
    bad = ~first & (F.col("_before.end").isNull() | (idle < -abs(tolerance_seconds)))
    next_bad = F.col("_after").isNotNull() & (
        F.col("ended_at").isNull() | (F.col("_after.start") - F.col("ended_at") < -abs(tolerance_seconds))
    )
    marked = neighbours.withColumns(
        {
            "session_corrupt": F.coalesce(bad | next_bad, F.lit(False)),
            "_opens": F.coalesce(first | bad | (idle > gap), F.lit(True)),
        }
    ).drop("_before", "_after")
    numbered = scan(
        marked,
        keys,
        ORDER,
        {
            "session_no": ("sum", F.col("_opens").cast("bigint")),
            "_start_rn": ("max", F.when(F.col("_opens"), F.col("rn"))),
        },
    )
    return numbered.withColumn("session_index", F.col("rn") - F.col("_start_rn") + 1).drop("_opens", "_start_rn")


def by_gap(matches: DataFrame, gaps: Sequence[int] = (60, 90, 120), hot_rows: int | None = None) -> DataFrame:
    """The same history partitioned into sessions at several gaps."""
    copies = matches.withColumn("gap", F.explode(F.array(*[F.lit(g) for g in gaps])))
    return sessionize(copies, keys=("account_id", "gap"), gap_column="gap", hot_rows=hot_rows)


def sessions_of(
    rows: DataFrame,
    gap_minutes: int = 90,
    window_end: int | None = None,
    anchored: bool = False,
    keys: Sequence[str] = ("account_id",),
    gap_column: str | None = None,
) -> DataFrame:
    """One row per session with its censoring.

    The first session is left-censored unless the history is anchored before the window;
    the last is right-censored when its end is unconfirmed or too close to the window end.
    """
    gap = F.col(gap_column) * 60 if gap_column else F.lit(max(1, gap_minutes) * 60)
    place = F.struct("started_at", "match_id")
    rolled = (
        rows.groupBy(*keys, "session_no")
        .agg(
            F.min("started_at").alias("start_time"),
            F.max_by(F.coalesce("ended_at", "started_at"), place).alias("_end"),
            F.count(F.lit(1)).alias("match_count"),
            F.every("session_corrupt").alias("corrupt"),
            F.sum(F.col("session_corrupt").cast("bigint")).alias("corrupt_rows"),
            (F.max("rn") == F.max("n")).alias("_is_last"),
        )
        .withColumn("end_time", F.greatest("start_time", "_end"))
    )
    if window_end is None:
        too_close = F.lit(True)
    else:
        too_close = F.lit(window_end) - F.col("end_time") <= gap
    return (
        rolled.withColumn("elapsed_seconds", F.greatest(F.lit(0), F.col("end_time") - F.col("start_time")))
        .withColumn("left_censored", (F.col("session_no") == 1) & F.lit(not anchored))
        .withColumn("right_censored", F.col("_is_last") & too_close)
        .withColumn("completed", ~F.col("right_censored") & ~F.col("corrupt"))
        .drop("_end", "_is_last")
    )


def legacy_sessions(rows: DataFrame, gap_minutes: int = 90, hot_rows: int | None = None) -> DataFrame:
    """Gap-only sessions of the older summary path.

    Undated rows come last and each opens its own session; an overlap never splits.
    """
    keys = ("account_id",)
    dated = chunked(rows.where(F.col("started_at").isNotNull()), keys, "started_at", hot_rows, tie="match_id")
    one = F.lit(1).cast("bigint")
    placed = scan(
        dated,
        keys,
        ORDER,
        {
            "_rn": ("sum", one),
            "_end": ("lag", F.col("started_at") + F.greatest(F.lit(0), F.col("duration_seconds"))),
        },
    )
    opens = F.coalesce(F.col("started_at") - F.col("_end") > max(1, gap_minutes) * 60, F.lit(True))
    numbered = scan(
        placed.withColumn("_opens", opens),
        keys,
        ORDER,
        {
            "session_no": ("sum", F.col("_opens").cast("bigint")),
            "_start_rn": ("max", F.when(F.col("_opens"), F.col("_rn"))),
        },
    )
    dated_out = unchunked(
        numbered.withColumn("session_index", F.col("_rn") - F.col("_start_rn") + 1).drop(
            "_rn", "_end", "_opens", "_start_rn"
        )
    )
    last = dated_out.groupBy(*keys).agg(F.max("session_no").alias("_last"))
    undated = chunked(rows.where(F.col("started_at").isNull()), keys, "match_id", hot_rows)
    undated = unchunked(scan(undated, keys, ["match_id"], {"_k": ("sum", one)}))
    undated_out = undated.join(last, list(keys), "left").select(
        *rows.columns,
        (F.coalesce("_last", F.lit(0)) + F.col("_k")).alias("session_no"),
        F.lit(1).cast("bigint").alias("session_index"),
    )
    return dated_out.unionByName(undated_out)


def with_recency(rows: DataFrame, window_end: int | None = None, half_life_days: float = 180.0) -> DataFrame:
    """Recency weight per row, measured from the window end or the account's last start."""
    if window_end:
        end = F.lit(window_end)
        return rows.withColumn("weight", recency_weight(F.col("started_at"), end, half_life_days))
    dated = chunked(rows.where(F.col("started_at").isNotNull()), ("account_id",), "started_at")
    return (
        scan(dated, ("account_id",), ORDER, {"_window_end": ("total_max", F.col("started_at"))})
        .withColumn(
            "weight",
            F.coalesce(recency_weight(F.col("started_at"), F.col("_window_end"), half_life_days), F.lit(0.0)),
        )
        .drop("_window_end")
    )


def transitions(rows: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Neighbour pairs inside a session: the previous result and the current row.

    Adds ``prev_won``, ``prev_corrupt``, ``prev_performance`` and ``loss_streak``: consecutive
    valid transitions after losses, reset by a win or by a corrupt or unmeasured row.
    """
    keys = ("account_id",)
    placed = scan(
        chunked(rows, keys, "started_at", hot_rows, tie="match_id"),
        keys,
        ORDER,
        {
            "_prev": (
                "lag",
                F.struct(
                    F.col("session_no").alias("session_no"),
                    F.col("won").alias("won"),
                    F.col("session_corrupt").alias("corrupt"),
                    F.col("performance").alias("performance"),
                ),
            )
        },
    )
    same = F.col("_prev.session_no") == F.col("session_no")
    paired = placed.withColumns(
        {
            "paired": F.coalesce(same, F.lit(False)),
            "prev_won": F.when(same, F.col("_prev.won")),
            "prev_corrupt": F.when(same, F.col("_prev.corrupt")),
            "prev_performance": F.when(same, F.col("_prev.performance")),
        }
    ).drop("_prev")
    valid = (
        F.col("paired")
        & ~F.col("prev_corrupt")
        & ~F.col("session_corrupt")
        & F.col("prev_performance").isNotNull()
        & F.col("performance").isNotNull()
    )
    flagged = paired.withColumn("valid_transition", F.coalesce(valid, F.lit(False)))
    loss = F.col("valid_transition") & ~F.coalesce(F.col("prev_won"), F.lit(False))
    counted = scan(
        flagged.withColumn("_loss", loss),
        keys,
        ORDER,
        {
            "_losses": ("sum", F.col("_loss").cast("bigint")),
            "_base": ("last", F.when(~F.col("_loss"), F.col("rn"))),
        },
    )
    # Rows since the last row that was not a loss transition: the length of the streak.
    streak = F.when(F.col("_loss"), F.col("rn") - F.coalesce(F.col("_base"), F.lit(0))).otherwise(0)
    return counted.withColumn("loss_streak", streak).drop("_loss", "_losses", "_base")
