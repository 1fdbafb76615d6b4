"""The scored metrics of an account.

Every scorer returns one row per account: ``account_id``, ``score`` (null when its own
conditions fail), ``sample_size``, ``effective_sample_size``, ``coverage``, ``stability``, ``quality``
and the numbers behind the score.  :func:`envelope` turns these into gated results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitscope.constants import (
    ELEMENTS,
    ROLE_ACTIVITY,
    ROLE_ACTIVITY_DEFAULT,
    ROLE_DEATHS,
    ROLE_DEATHS_DEFAULT,
    ROLE_KILL_SHARE,
    ROLE_KILL_SHARE_DEFAULT,
    SESSION_BUCKETS,
)
from habitscope.functions.expr import (
    bounded_delta,
    clamp,
    dimension_confidence,
    element_confidence,
    element_confidence_label,
    kish,
    ratio,
    recency_weight,
    zone_index,
)
from habitscope.functions.ordered import is_plain, marks
from habitscope.functions.robust import lower_weighted_median, spread
from habitscope.operators.baselines import leave_session_out
from habitscope.operators.pools import (
    diversity,
    evaluation_groups,
    expanding_familiar,
    familiar_pool,
    shift_of_counts,
)
from habitscope.operators.sessions import transitions
from habitscope.operators.windows import numbered, recent_and_prior, transition_groups
from habitscope.session import cut


def by_role(values: Mapping[str, float], default: float, role: Column | None = None) -> Column:
    role = F.col("role_hint") if role is None else role
    out = None
    for name, value in values.items():
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(default)


def totals(rows: DataFrame) -> DataFrame:
    """Matches per account, the base of every coverage."""
    return rows.groupBy("account_id").agg(F.count(F.lit(1)).alias("total"))


def credible_role() -> Column:
    return F.col("role_hint").isNotNull() & (F.coalesce("role_confidence", F.lit(0.0)) >= 0.60)


# Hero identity -------------------------------------------------------------------------------


def hero_window_counts(rows: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Per account and hero the counts that the pool metrics compare, in one pass over the rows."""
    placed = numbered(rows.where(F.col("hero_id").isNotNull()), hot_rows=hot_rows)
    back = F.col("n") - F.col("rn")
    split = F.greatest(F.lit(30), F.floor(F.col("n") * F.lit(0.70)))
    return placed.groupBy("account_id", "hero_id").agg(
        F.first("n").alias("n"),
        F.count(F.lit(1)).alias("c"),
        F.count_if(back < 50).alias("c50"),
        F.count_if(back < 100).alias("c100"),
        F.count_if(F.col("rn") <= F.floor(F.col("n") / 2)).alias("older_half"),
        F.count_if(F.col("rn") > F.floor(F.col("n") / 2)).alias("newer_half"),
        F.count_if(F.col("rn") <= split).alias("learned"),
        F.count_if(F.col("rn") > split).alias("evaluated"),
    )


def hero_window_stability(hero_counts: DataFrame) -> DataFrame:
    """Spread of the off-top-five share over the last 50, last 100 and all rows."""
    over = Window.partitionBy("account_id")
    names = ("c50", "c100", "c")
    ranked = hero_counts.withColumns(
        {f"_r_{c}": F.row_number().over(over.orderBy(F.desc(c), "hero_id")) for c in names}
    )
    outside = [
        1.0 - ratio(F.sum(F.when(F.col(f"_r_{c}") <= 5, F.col(c)).otherwise(0)), F.sum(c)) for c in names
    ]
    return (
        ranked.groupBy("account_id")
        .agg(F.first("n").alias("n"), (F.greatest(*outside) - F.least(*outside)).alias("_spread"))
        .select(
            "account_id",
            F.when(F.col("n") < 20, 0.65).otherwise(clamp(1.0 - F.col("_spread") * 2.0, 0.55, 1.0)).alias("stability"),
        )
    )


def hero_pool_breadth(rows: DataFrame, hero_counts: DataFrame | None = None) -> DataFrame:
    hero_counts = hero_window_counts(rows) if hero_counts is None else hero_counts
    effective = F.col("effective_count")
    concentration = (
        0.45 * F.col("top5_share")
        + 0.35 * (1.0 - F.col("normalized_entropy"))
        + 0.20 * F.least(F.lit(1.0), 10.0 / F.greatest(effective, F.lit(1.0)))
    )
    return (
        totals(rows)
        .join(diversity(hero_counts), "account_id")
        .join(hero_window_stability(hero_counts), "account_id")
        .select(
            "account_id",
            (1.0 - concentration).alias("score"),
            F.col("sample").alias("sample_size"),
            effective.alias("effective_sample_size"),
            ratio(F.col("sample"), F.col("total")).alias("coverage"),
            "stability",
            F.lit(1.0).alias("quality"),
            F.col("categories").alias("unique_heroes"),
            "top5_share",
            "normalized_entropy",
        )
    )


def hero_pool_stability(rows: DataFrame, hero_counts: DataFrame | None = None) -> DataFrame:
    hero_counts = hero_window_counts(rows) if hero_counts is None else hero_counts
    halves = shift_of_counts(hero_counts, "older_half", "newer_half")
    older, newer = F.col("left_rows"), F.col("right_rows")
    return (
        totals(rows)
        .join(halves, "account_id")
        .join(hero_window_stability(hero_counts), "account_id")
        .withColumn("sample_size", older + newer)
        .select(
            "account_id",
            F.when(F.col("sample_size") >= 60, F.col("similarity")).alias("score"),
            "sample_size",
            F.when(F.col("sample_size") >= 60, F.least(older, newer) * 2)
            .otherwise(F.col("sample_size"))
            .alias("effective_sample_size"),
            ratio(F.col("sample_size"), F.col("total")).alias("coverage"),
            "stability",
            F.lit(1.0).alias("quality"),
        )
    )


def hero_exploration_rate(rows: DataFrame, hero_counts: DataFrame | None = None) -> DataFrame:
    hero_counts = hero_window_counts(rows) if hero_counts is None else hero_counts
    split = F.greatest(F.lit(30), F.floor(F.col("n") * F.lit(0.70)))
    pool = familiar_pool(hero_counts, split, count="learned").select(
        "account_id", "hero_id", F.lit(True).alias("familiar")
    )
    rolled = (
        hero_counts.join(pool, ["account_id", "hero_id"], "left")
        .groupBy("account_id")
        .agg(
            F.first("n").alias("sample_size"),
            F.sum("evaluated").alias("evaluated"),
            F.sum(F.when(F.col("familiar"), 0).otherwise(F.col("evaluated"))).alias("off_pool"),
            F.count_if("familiar").alias("familiar_heroes"),
        )
    )
    enough = F.col("sample_size") >= 60
    return (
        totals(rows)
        .join(rolled, "account_id")
        .select(
            "account_id",
            F.when(enough, F.col("off_pool") / F.greatest(F.col("evaluated"), F.lit(1))).alias("score"),
            "sample_size",
            F.when(enough, F.col("evaluated")).otherwise(F.col("sample_size")).alias("effective_sample_size"),
            ratio(F.col("sample_size"), F.col("total")).alias("coverage"),
            F.lit(1.0).alias("stability"),
            F.lit(1.0).alias("quality"),
            "familiar_heroes",
        )
    )


def post_loss_familiarity_shift(
    rows: DataFrame, hot_rows: int | None = None, paired: DataFrame | None = None
) -> DataFrame:
    """Familiar picks after a loss minus after a win, with a pool learned from all earlier rows."""
    paired = transitions(rows, hot_rows) if paired is None else paired
    pools = expanding_familiar(rows, hot_rows)
    usable = (
        F.col("paired")
        & F.col("hero_id").isNotNull()
        & ~F.col("session_corrupt")
        & F.col("prev_won").isNotNull()
        & ~F.col("prev_corrupt")
    )
    flags = (
        paired.where(usable)
        .select("account_id", "match_id", "prev_won")
        .join(pools.where(F.col("earlier_pool") > 0), ["account_id", "match_id"])
    )
    flag = F.col("is_familiar").cast("double")
    after = flags.groupBy("account_id").agg(
        F.count_if(~F.col("prev_won")).alias("losses"),
        F.count_if(F.col("prev_won")).alias("wins"),
        F.median(F.when(~F.col("prev_won"), flag)).alias("after_loss"),
        F.median(F.when(F.col("prev_won"), flag)).alias("after_win"),
    )
    return _transition_score(rows, after, 0.35, 1.0)


def _transition_score(rows: DataFrame, after: DataFrame, scale: float, quality: float) -> DataFrame:
    losses, wins = F.coalesce("losses", F.lit(0)), F.coalesce("wins", F.lit(0))
    return (
        totals(rows)
        .join(after, "account_id", "left")
        .select(
            "account_id",
            F.when(
                (losses >= 15) & (wins >= 15), bounded_delta(F.col("after_loss") - F.col("after_win"), scale)
            ).alias("score"),
            (losses + wins).alias("sample_size"),
            (F.least(losses, wins) * 2).alias("effective_sample_size"),
            ratio(losses + wins, F.col("total")).alias("coverage"),
            F.lit(1.0).alias("stability"),
            F.lit(quality).alias("quality"),
            "after_loss",
            "after_win",
        )
    )


# Roles and combat ----------------------------------------------------------------------------


def role_breadth(rows: DataFrame) -> DataFrame:
    counted = rows.where(credible_role()).groupBy("account_id", "role_hint").agg(F.count(F.lit(1)).alias("c"))
    anchoring = 0.65 * F.col("top_share") + 0.35 * (1.0 - F.col("normalized_entropy"))
    coverage = F.coalesce(ratio(F.col("sample"), F.col("total")), F.lit(0.0))
    return (
        totals(rows)
        .join(diversity(counted), "account_id", "left")
        .select(
            "account_id",
            (1.0 - anchoring).alias("score"),
            F.coalesce("sample", F.lit(0)).alias("sample_size"),
            (F.coalesce("sample", F.lit(0)) * coverage).alias("effective_sample_size"),
            coverage.alias("coverage"),
            F.when(coverage >= 0.65, 1.0).otherwise(0.70).alias("stability"),
            coverage.alias("quality"),
            F.col("top_share").alias("dominant_role_share"),
        )
    )


def combat_involvement(rows: DataFrame) -> DataFrame:
    rate = F.col("activity")
    role = credible_role() & rate.isNotNull()
    residual = rate - by_role(ROLE_ACTIVITY, ROLE_ACTIVITY_DEFAULT)
    rolled = rows.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(rate).alias("sample_size"),
        F.count_if(role).alias("role_rows"),
        F.median(rate).alias("median_rate"),
        F.median(F.when(role, residual)).alias("role_residual"),
    )
    adjusted = F.col("role_rows") >= 20
    # Without role support the residuals are taken from their own median, so their median is zero.
    central = F.when(adjusted, F.col("role_residual")).otherwise(0.0)
    coverage = ratio(F.col("sample_size"), F.col("total"))
    stability = F.when(F.col("sample_size") >= 50, 0.85).otherwise(0.65)
    quality = F.when(adjusted, 0.75).otherwise(0.55)
    confidence = F.least(
        F.lit(0.70),
        dimension_confidence(F.col("sample_size"), F.col("sample_size"), coverage, stability, quality, 30),
    )
    return rolled.select(
        "account_id",
        F.when(F.col("sample_size") >= 30, clamp(0.5 + 0.5 * F.tanh(central / 0.30))).alias("score"),
        "sample_size",
        F.col("sample_size").alias("effective_sample_size"),
        coverage.alias("coverage"),
        confidence.alias("stability"),
        confidence.alias("quality"),
        confidence.alias("confidence_override"),
        "median_rate",
        adjusted.alias("role_adjusted"),
        (F.abs(central) <= 0.15).alias("neutral"),
    )


def finisher_orientation(rows: DataFrame) -> DataFrame:
    involved = F.col("kills") + F.col("assists")
    usable = involved > 0
    role = usable & credible_role()
    expected = by_role(ROLE_KILL_SHARE, ROLE_KILL_SHARE_DEFAULT)
    rolled = rows.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(usable).alias("sample_size"),
        F.sum(F.when(usable, F.col("kills"))).alias("kills"),
        F.sum(F.when(usable, involved)).alias("involvement"),
        F.count_if(role).alias("role_rows"),
        F.sum(F.when(role, involved)).alias("role_involvement"),
        F.sum(F.when(role, involved * expected)).alias("role_expected"),
    )
    total = F.coalesce("involvement", F.lit(0)).cast("double")
    adjusted = F.col("role_rows") >= 20
    share = F.coalesce(ratio(F.col("kills"), F.col("involvement")), F.lit(0.5))
    baseline = F.when(adjusted, ratio(F.col("role_expected"), F.col("role_involvement"))).otherwise(0.5)
    shrunk = (share - baseline) * total / (total + 100.0)
    coverage = ratio(F.col("sample_size"), F.col("total"))
    effective = F.least(total, F.lit(300.0))
    quality = F.when(adjusted, 0.75).otherwise(0.55)
    confidence = F.least(
        F.lit(0.70), dimension_confidence(F.col("sample_size"), effective, coverage, F.lit(1.0), quality, 30)
    )
    enough = (F.col("sample_size") >= 30) & (total >= 100)
    return rolled.select(
        "account_id",
        F.when(enough, clamp(0.5 + shrunk / 0.40)).alias("score"),
        "sample_size",
        F.when(enough, effective).otherwise(total).alias("effective_sample_size"),
        coverage.alias("coverage"),
        confidence.alias("stability"),
        confidence.alias("quality"),
        confidence.alias("confidence_override"),
        share.alias("kill_share"),
        baseline.alias("expected_kill_share"),
        adjusted.alias("role_adjusted"),
        (F.abs(shrunk) <= 0.04).alias("neutral"),
    )


def death_exposure(rows: DataFrame) -> DataFrame:
    rate = F.col("death_rate")
    residual = rate - by_role(ROLE_DEATHS, ROLE_DEATHS_DEFAULT)
    rolled = rows.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(rate).alias("sample_size"),
        F.count_if(rate.isNotNull() & credible_role()).alias("role_rows"),
        F.median(rate).alias("median_rate"),
        F.median(F.when(F.col("role_hint").isNotNull(), residual)).alias("role_residual"),
    )
    adjusted = F.col("role_rows") >= 20
    value = F.when(adjusted, 0.5 + 0.5 * F.tanh(F.col("role_residual") / 1.2)).otherwise(
        0.5 + 0.5 * F.tanh((F.col("median_rate") - 0.75) / 1.5)
    )
    return rolled.select(
        "account_id",
        F.when(F.col("sample_size") >= 30, clamp(value)).alias("score"),
        "sample_size",
        F.col("sample_size").alias("effective_sample_size"),
        ratio(F.col("sample_size"), F.col("total")).alias("coverage"),
        F.lit(1.0).alias("stability"),
        F.when(adjusted, 0.75).otherwise(0.55).alias("quality"),
        "median_rate",
        adjusted.alias("role_adjusted"),
    )


# Adaptability --------------------------------------------------------------------------------


def off_pool_performance(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    groups = evaluation_groups(rows) if groups is None else groups
    value, familiar = F.col("performance"), F.col("familiar")
    rolled = groups.groupBy("account_id").agg(
        F.first("method").alias("method"),
        F.count(F.when(familiar, value)).alias("familiar_rows"),
        F.count(F.when(~familiar, value)).alias("off_rows"),
        F.median(F.when(familiar, value)).alias("familiar_median"),
        F.median(F.when(~familiar, value)).alias("off_median"),
    )
    left, right = F.col("familiar_rows"), F.col("off_rows")
    enough = (left >= 20) & (right >= 20)
    return (
        totals(rows)
        .join(rolled, "account_id", "left")
        .na.fill(0, ["familiar_rows", "off_rows"])
        .select(
            "account_id",
            F.when(enough, bounded_delta(F.col("off_median") - F.col("familiar_median"), 0.30)).alias("score"),
            (left + right).alias("sample_size"),
            F.when(enough, F.least(left, right) * 2).otherwise(F.least(left, right)).alias("effective_sample_size"),
            ratio(left + right, F.col("total")).alias("coverage"),
            F.when(F.col("method") == "time_split_70_30", 0.85).otherwise(0.60).alias("stability"),
            F.lit(0.80).alias("quality"),
            "method",
            "familiar_median",
            "off_median",
        )
    )


def off_pool_activity_stability(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    groups = evaluation_groups(rows) if groups is None else groups
    value, familiar = F.col("activity"), F.col("familiar")
    rolled = groups.groupBy("account_id").agg(
        F.count(F.when(familiar, value)).alias("familiar_rows"),
        F.count(F.when(~familiar, value)).alias("off_rows"),
        F.median(F.when(familiar, value)).alias("familiar_median"),
        F.median(F.when(~familiar, value)).alias("off_median"),
    )
    pooled = spread(groups, ["account_id"], "activity").select("account_id", "mad")
    left, right = F.col("familiar_rows"), F.col("off_rows")
    enough = (left >= 12) & (right >= 12)
    scale = F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.0)
    standardized = (F.col("off_median") - F.col("familiar_median")) / scale
    return (
        totals(rows)
        .join(rolled, "account_id", "left")
        .join(pooled, "account_id", "left")
        .na.fill(0, ["familiar_rows", "off_rows"])
        .select(
            "account_id",
            F.when(enough, clamp(1.0 - F.least(F.lit(1.0), F.abs(standardized) / 2.0))).alias("score"),
            (left + right).alias("sample_size"),
            F.when(enough, F.least(left, right) * 2).otherwise(F.least(left, right)).alias("effective_sample_size"),
            ratio(left + right, F.col("total")).alias("coverage"),
            F.lit(1.0).alias("stability"),
            F.lit(1.0).alias("quality"),
            standardized.alias("standardized_delta"),
        )
    )


# Consistency and form ------------------------------------------------------------------------


def performance_volatility(rows: DataFrame) -> DataFrame:
    dispersion = spread(rows, ["account_id"], "performance")
    sample = F.coalesce("sample", F.lit(0))
    return (
        totals(rows)
        .join(dispersion, "account_id", "left")
        .select(
            "account_id",
            F.when(sample >= 30, clamp(F.col("mad") / 0.30)).alias("score"),
            sample.alias("sample_size"),
            sample.alias("effective_sample_size"),
            ratio(sample, F.col("total")).alias("coverage"),
            F.lit(1.0).alias("stability"),
            F.lit(1.0).alias("quality"),
            "mad",
        )
    )


def recent_shift(rows: DataFrame, value: str, scale: float) -> DataFrame:
    windows = recent_and_prior(rows, value)
    measured = F.coalesce("measured", F.lit(0))
    used = F.col("recent_rows") + F.col("prior_rows")
    enough = measured >= 45
    return (
        totals(rows)
        .join(windows, "account_id", "left")
        .select(
            "account_id",
            F.when(enough, bounded_delta(F.col("recent") - F.col("prior"), scale)).alias("score"),
            F.when(enough, used).otherwise(measured).alias("sample_size"),
            F.when(enough, F.least("recent_rows", "prior_rows") * 2)
            .otherwise(measured)
            .alias("effective_sample_size"),
            ratio(F.when(enough, used).otherwise(measured), F.col("total")).alias("coverage"),
            F.lit(1.0).alias("stability"),
            F.lit(1.0).alias("quality"),
            "recent",
            "prior",
        )
    )


def recent_form_shift(rows: DataFrame) -> DataFrame:
    return recent_shift(rows, "performance", 0.30)


def recent_activity_shift(rows: DataFrame) -> DataFrame:
    return recent_shift(rows, "activity", 2.0)


# Sessions ------------------------------------------------------------------------------------


def session_length_tendency(
    rows: DataFrame, sessions: DataFrame, window_end: int, half_life_days: float = 180.0
) -> DataFrame:
    """Typical session length, hours and share of long sessions; each session weighs once."""
    plain = is_plain(rows)
    done = sessions.where(F.col("completed")).withColumns(
        {
            "w": recency_weight(F.col("start_time"), F.lit(window_end), half_life_days),
            "length": F.col("match_count").cast("double"),
            "elapsed": F.col("elapsed_seconds").cast("double"),
        }
    )
    w = F.col("w")
    rolled = done.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("completed_sessions"),
        kish(F.sum(w), F.sum(w * w)).alias("effective_sample_size"),
        F.try_divide(F.sum(F.when(F.col("match_count") >= 5, w).otherwise(0.0)), F.sum(w)).alias("share_long"),
    )
    long = done.select(
        "account_id",
        "w",
        F.explode(
            F.array(
                F.struct(F.lit("length").alias("metric"), F.col("length").alias("x")),
                F.struct(F.lit("elapsed").alias("metric"), F.col("elapsed").alias("x")),
            )
        ).alias("e"),
    ).select("account_id", "w", "e.metric", "e.x")
    middle = (
        lower_weighted_median(long, ["account_id", "metric"], "x", "w", plain=plain)
        .groupBy("account_id")
        .agg(
            F.max(F.when(F.col("metric") == "length", F.col("weighted_median"))).alias("median_length"),
            F.max(F.when(F.col("metric") == "elapsed", F.col("weighted_median")) / 3600).alias("median_hours"),
        )
    )
    value = clamp(
        0.5
        + 0.35 * (F.col("median_length") - 3.0) / 2.0
        + 0.20 * (F.col("median_hours") - 3.0) / 2.0
        + 0.15 * (F.col("share_long") - 0.5)
    )
    enough = (F.col("completed_sessions") >= 10) & (F.col("total") >= 25)
    return (
        totals(rows)
        .join(rolled, "account_id", "left")
        .join(middle, "account_id", "left")
        .select(
            "account_id",
            F.when(enough, value).alias("score"),
            F.col("total").alias("sample_size"),
            F.coalesce("effective_sample_size", F.lit(0.0)).alias("effective_sample_size"),
            F.lit(1.0).alias("coverage"),
            F.lit(1.0).alias("stability"),
            F.lit(1.0).alias("quality"),
            "median_length",
            "median_hours",
            "share_long",
        )
    )


def bucket(position: Column) -> Column:
    out = F.when(position <= 1, SESSION_BUCKETS[0])
    for place, name in ((2, "G2"), (3, "G3"), (4, "G4")):
        out = out.when(position == place, name)
    return out.otherwise("G5+")


# What baselines read of a row.
_BASELINE_COLUMNS = (
    "account_id",
    "match_id",
    "hero_id",
    "role_hint",
    "function",
    "session_no",
    "performance",
    "weight",
)


def curve_rows(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Measured rows of closed, sound sessions that keep at least two of them."""
    closed = sessions.where(~F.col("corrupt") & ~F.col("right_censored")).select(
        "account_id", "session_no", "start_time", "left_censored"
    )
    kept = rows.where(F.col("performance").isNotNull() & ~F.col("session_corrupt"))
    busy = kept.groupBy("account_id", "session_no").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= 2)
    return kept.join(closed.join(busy, ["account_id", "session_no"]).drop("_k"), ["account_id", "session_no"])


def session_residuals(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Residual of each measured row of a session against its comparable baseline; ``rows`` carry ``function``.

    Written once, since the curves by median and by mean are read from it.
    """
    # Read for the baselines and for the residuals.
    usable = cut(
        curve_rows(rows, sessions).select(
            *_BASELINE_COLUMNS, "session_index", "start_time", "left_censored", *marks(rows)
        )
    )
    counts = ~(F.col("left_censored") & (F.col("session_index") == 1))
    baseline = leave_session_out(usable, counts)
    return cut(
        usable.where(counts)
        .join(baseline, ["account_id", "match_id"])
        .select(
            "account_id",
            "session_no",
            "session_index",
            "start_time",
            (F.col("performance") - F.col("baseline")).alias("residual"),
        )
    )


def session_bucket_residuals(
    rows: DataFrame, sessions: DataFrame, mean: bool = False, residuals: DataFrame | None = None
) -> DataFrame:
    """The :func:`session_residuals` per session and bucket."""
    residuals = session_residuals(rows, sessions) if residuals is None else residuals
    middle = F.avg("residual") if mean else F.median("residual")
    return (
        residuals.groupBy("account_id", "session_no", bucket(F.col("session_index")).alias("bucket"))
        .agg(
            middle.alias("residual"),
            F.count(F.lit(1)).alias("observations"),
            F.first("start_time").alias("start_time"),
        )
    )


def breakpoint_of(curve: Column, direction: Column, minimum_effect: float = 0.08, minimum_count: int = 8) -> Column:
    """Earliest supported bucket whose effect persists in every later one.

    ``curve`` is an array of (place, bucket, value, sessions) in bucket order; the result is a
    struct of state, bucket and effect.
    """
    sign = F.when(direction == "rise", 1.0).otherwise(-1.0)
    supported = F.filter(curve, lambda p: p["sessions"] >= minimum_count)
    signed = F.transform(supported, lambda p: p["value"] * sign)
    reach = F.transform(
        supported,
        lambda p, i: F.when(
            F.forall(F.slice(signed, i + 1, F.size(signed) - i), lambda v: v >= minimum_effect), p
        ),
    )
    first = F.try_element_at(F.array_compact(reach), F.lit(1))
    gradual = F.forall(signed, lambda v: v >= 0) & F.exists(signed, lambda v: v >= minimum_effect)
    none = F.lit(None)
    unresolved = F.struct(
        F.lit("unresolved").alias("state"), none.cast("string").alias("bucket"), none.cast("double").alias("effect")
    )
    return (
        F.when(F.size(supported) < 2, unresolved)
        .when(
            first.isNotNull(),
            F.struct(
                F.lit("stable_breakpoint").alias("state"),
                first["bucket"].alias("bucket"),
                first["value"].alias("effect"),
            ),
        )
        .when(
            gradual,
            F.struct(
                F.lit("gradual").alias("state"),
                none.cast("string").alias("bucket"),
                none.cast("double").alias("effect"),
            ),
        )
        .otherwise(unresolved)
    )


def session_curve(residuals: DataFrame, window_end: int, half_life_days: float = 180.0) -> DataFrame:
    """Session-balanced, recency-weighted curve per account, with late minus early and breakpoint."""
    w = recency_weight(F.col("start_time"), F.lit(window_end), half_life_days)
    points = (
        residuals.withColumn("w", w)
        .groupBy("account_id", "bucket")
        .agg(
            F.try_divide(F.sum(F.col("residual") * F.col("w")), F.sum("w")).alias("value"),
            F.count(F.lit(1)).alias("sessions"),
            F.sum("observations").alias("observations"),
        )
    )
    independent = (
        residuals.select("account_id", "session_no", w.alias("w"))
        .distinct()
        .groupBy("account_id")
        .agg(
            F.count(F.lit(1)).alias("independent_sessions"),
            kish(F.sum("w"), F.sum(F.col("w") * F.col("w"))).alias("effective_sample_size"),
        )
    )
    early = F.col("bucket").isin("G1", "G2")
    rolled = points.groupBy("account_id").agg(
        F.sum("observations").alias("sample_size"),
        (F.avg(F.when(~early, F.col("value"))) - F.avg(F.when(early, F.col("value")))).alias("delta"),
        # Five buckets at most.
        F.array_sort(F.collect_list(F.struct("bucket", "value", "sessions"))).alias("curve"),
    )
    direction = F.when(F.col("delta") < -0.04, "fade").when(F.col("delta") > 0.04, "rise").otherwise("flat")
    return (
        rolled.join(independent, "account_id")
        .withColumn("direction", direction)
        .withColumn("_bp", breakpoint_of(F.col("curve"), F.col("direction")))
        .withColumn("breakpoint_state", F.when(F.col("direction") == "flat", "unresolved").otherwise(F.col("_bp.state")))
        .withColumn("breakpoint_bucket", F.when(F.col("direction") != "flat", F.col("_bp.bucket")))
        .drop("_bp")
    )


def late_session_performance(
    rows: DataFrame, sessions: DataFrame, window_end: int, residuals: DataFrame | None = None
) -> DataFrame:
    # Read for the points of the curve and for its sessions.
    curve = session_curve(cut(session_bucket_residuals(rows, sessions, residuals=residuals)), window_end)
    settled = (F.col("direction") == "flat") | (F.col("breakpoint_state") != "unresolved")
    sample = F.coalesce("sample_size", F.lit(0))
    sessions_used = F.coalesce("independent_sessions", F.lit(0))
    return (
        totals(rows)
        .join(curve, "account_id", "left")
        .select(
            "account_id",
            F.when(sessions_used >= 12, bounded_delta(F.col("delta"), 0.20)).alias("score"),
            sample.alias("sample_size"),
            F.coalesce("effective_sample_size", F.lit(0.0)).alias("effective_sample_size"),
            ratio(sample, F.col("total")).alias("coverage"),
            F.when(settled, 1.0).otherwise(0.75).alias("stability"),
            F.least(F.lit(1.0), 0.70 + F.least(F.lit(0.30), sessions_used / 40.0)).alias("quality"),
            "delta",
            sessions_used.alias("independent_sessions"),
            "breakpoint_state",
            "breakpoint_bucket",
        )
    )


def post_loss_activity_shift(rows: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    paired = transitions(rows) if paired is None else paired
    after = (
        transition_groups(paired)
        .where(F.col("metric") == "activity")
        .select(
            "account_id",
            F.col("after_loss_rows").alias("losses"),
            F.col("after_win_rows").alias("wins"),
            "after_loss",
            "after_win",
        )
    )
    return _transition_score(rows, after, 2.0, 0.80)


def post_loss_residuals(rows: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows after a loss with their leave-session-out baseline, and the loss transitions per account.

    Neighbours are the measured sound rows of a sound session, in order.
    """
    sound = sessions.where(~F.col("corrupt")).select("account_id", "session_no", "start_time")
    usable = (
        rows.where(F.col("performance").isNotNull() & ~F.col("session_corrupt"))
        .join(sound, ["account_id", "session_no"])
        .select(*_BASELINE_COLUMNS, "started_at", "start_time", "won", "rn", "session_corrupt", *marks(rows))
    )
    lost = F.col("paired") & (F.col("prev_won") == F.lit(False))
    # Read for the counts, the baselines and the residuals.
    placed = cut(
        transitions(usable).select(
            *_BASELINE_COLUMNS, "started_at", "start_time", F.coalesce(lost, F.lit(False)).alias("lost"), *marks(rows)
        )
    )
    after_loss = placed.where("lost")
    counted = after_loss.groupBy("account_id").agg(F.count(F.lit(1)).alias("loss_transitions"))
    baseline = leave_session_out(placed, F.col("lost"))
    joined = after_loss.join(baseline, ["account_id", "match_id"]).withColumn(
        "residual", F.col("performance") - F.col("baseline")
    )
    # Read by three summaries here, and for the contexts of a recovery.
    return cut(joined), counted


def post_loss_performance_response(
    rows: DataFrame,
    sessions: DataFrame,
    window_end: int,
    half_life_days: float = 180.0,
    residuals: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    plain = is_plain(rows)
    residuals, counted = post_loss_residuals(rows, sessions) if residuals is None else residuals
    session_keys = ["account_id", "session_no"]
    within = lower_weighted_median(residuals, session_keys, "residual", "weight", "delta", plain=plain)
    starts = residuals.groupBy(*session_keys).agg(
        F.first("start_time").alias("start_time"), F.count(F.lit(1)).alias("rows")
    )
    # One row per session, read for the median across sessions and for their counts.
    per_session = cut(
        within.join(starts, session_keys).withColumn(
            "w", recency_weight(F.col("start_time"), F.lit(window_end), half_life_days)
        )
    )
    across = lower_weighted_median(per_session, ["account_id"], "delta", "w", "delta_across", plain=plain)
    rolled = per_session.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("rows").alias("rows"),
        kish(F.sum("w"), F.sum(F.col("w") * F.col("w"))).alias("session_effective"),
    )
    rows_effective = residuals.groupBy("account_id").agg(
        kish(F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))).alias("row_effective")
    )
    n, k = F.coalesce("rows", F.lit(0)), F.coalesce("sessions", F.lit(0))
    coverage = n / F.greatest(F.coalesce("loss_transitions", F.lit(0)), F.lit(1))
    enough = (n >= 30) & (k >= 3) & (coverage >= 0.50)
    return (
        totals(rows)
        .join(counted, "account_id", "left")
        .join(rolled, "account_id", "left")
        .join(rows_effective, "account_id", "left")
        .join(across, "account_id", "left")
        .select(
            "account_id",
            F.when(enough, bounded_delta(F.col("delta_across"), 0.20)).alias("score"),
            n.alias("sample_size"),
            F.coalesce(
                F.when(enough, F.col("session_effective")).otherwise(F.col("row_effective")), F.lit(0.0)
            ).alias("effective_sample_size"),
            coverage.alias("coverage"),
            F.lit(1.0).alias("stability"),
            F.least(F.lit(1.0), 0.70 + 0.10 * F.least(F.lit(1.0), k / 5.0) + 0.20 * coverage).alias("quality"),
            F.col("delta_across").alias("delta"),
            k.alias("independent_sessions"),
        )
    )


# Result envelope -----------------------------------------------------------------------------


def zone_label(key: Column, score: Column) -> Column:
    labels = F.create_map(*[x for e in ELEMENTS for x in (F.lit(e[0]), F.array(*[F.lit(z) for z in e[4]]))])
    return F.element_at(F.try_element_at(labels, key), zone_index(score) + 1)


def envelope(raw: DataFrame) -> DataFrame:
    """Gates, confidence, status and zone of raw scores in long form (one row per account and key)."""
    minimum = F.create_map(*[x for e in ELEMENTS for x in (F.lit(e[0]), F.lit(e[2]))])
    coverage_floor = F.create_map(*[x for e in ELEMENTS for x in (F.lit(e[0]), F.lit(e[3]))])
    dimension = F.create_map(*[x for e in ELEMENTS for x in (F.lit(e[0]), F.lit(e[1]))])
    key = F.col("key")
    gated = raw.withColumns(
        {
            "coverage": F.coalesce(clamp(F.col("coverage")), F.lit(0.0)),
            "_minimum": F.element_at(minimum, key),
            "dimension": F.element_at(dimension, key),
        }
    ).withColumn(
        "_available",
        F.col("score").isNotNull()
        & (F.col("sample_size") >= F.col("_minimum"))
        & (F.col("coverage") >= F.element_at(coverage_floor, key)),
    )
    computed = element_confidence(
        F.col("sample_size"),
        F.col("effective_sample_size"),
        F.col("coverage"),
        F.col("stability"),
        F.col("quality"),
        F.col("_minimum"),
    )
    confidence = F.when(
        F.col("_available"), clamp(F.coalesce(F.col("confidence_override"), computed))
    ).otherwise(0.0)
    final = F.when(F.col("_available"), clamp(F.col("score")))
    return (
        gated.withColumn("confidence_score", confidence)
        .withColumn("score", final)
        .select(
            "account_id",
            "key",
            "dimension",
            F.when(F.col("score").isNull(), "unavailable")
            .when(F.col("confidence_score") >= 0.50, "available")
            .otherwise("limited")
            .alias("status"),
            "score",
            (2.0 * F.col("score") - 1.0).alias("centered_score"),
            element_confidence_label(F.col("confidence_score"), F.col("score").isNull()).alias("confidence"),
            "confidence_score",
            "sample_size",
            F.greatest(F.lit(0.0), F.col("effective_sample_size")).alias("effective_sample_size"),
            "coverage",
            clamp(F.col("stability")).alias("stability"),
            clamp(F.col("quality")).alias("quality"),
            zone_label(key, F.col("score")).alias("zone"),
        )
    )


RAW_COLUMNS = ("sample_size", "effective_sample_size", "coverage", "stability", "quality")


def long_form(raw: DataFrame, key: str) -> DataFrame:
    override = F.col("confidence_override") if "confidence_override" in raw.columns else F.lit(None)
    return raw.select(
        "account_id",
        F.lit(key).alias("key"),
        F.col("score").cast("double").alias("score"),
        F.col("sample_size").cast("bigint").alias("sample_size"),
        F.col("effective_sample_size").cast("double").alias("effective_sample_size"),
        F.col("coverage").cast("double").alias("coverage"),
        F.col("stability").cast("double").alias("stability"),
        F.col("quality").cast("double").alias("quality"),
        override.cast("double").alias("confidence_override"),
    )
