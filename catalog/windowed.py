"""Splits, streaks and rolling windows."""

from pyspark.sql import functions as F

from catalog.base import MATCH_ROWS, matches, register
from habitscope.operators import windows

_ORDERED = f"""{MATCH_ROWS}, o as (select *, row_number() over (partition by account_id order by started_at, match_id) as rn,
  count(*) over (partition by account_id) as n from match_rows)"""


@register(
    "win_chronological_split",
    f"with {_ORDERED} select account_id, match_id, rn <= greatest(1, floor(n * 0.7)) as older from o",
)
def win_chronological_split(spark, folder):
    return windows.chronological_split(matches(spark, folder)).select("account_id", "match_id", "older")


@register(
    "win_balanced_windows",
    f"""with {_ORDERED} select account_id, match_id, case when n - rn < least(24, n // 2) then 'recent' else 'previous' end as "window"
    from o where n - rn < 2 * least(24, n // 2)""",
)
def win_balanced_windows(spark, folder):
    return windows.balanced_windows(matches(spark, folder)).select("account_id", "match_id", "window")


@register(
    "win_longest_streak",
    f"""with {_ORDERED}, g as (select *, rn - row_number() over (partition by account_id, hero_id order by rn) as grp from o),
    c as (select account_id, hero_id, grp, count(*) as k from g group by 1, 2, 3)
    select account_id, max(k) as longest_streak from c group by 1""",
)
def win_longest_streak(spark, folder):
    return windows.longest_streak(matches(spark, folder), "hero_id")


@register(
    "win_quarter_recurrence",
    f"""with {_ORDERED} select account_id, hero_id, count(distinct least(3, floor((rn - 1) * 4 / n))) as quarters,
      count(distinct least(3, floor((rn - 1) * 4 / n))) / 4.0 as recurrence from o group by 1, 2""",
    "recurrence",
)
def win_quarter_recurrence(spark, folder):
    return windows.quarter_recurrence(matches(spark, folder))


@register(
    "win_persistence",
    f"""with {MATCH_ROWS} select account_id, hero_id, least(1, count(distinct started_at // 2592000) / 4.0) as persistence from match_rows group by 1, 2""",
    "persistence",
)
def win_persistence(spark, folder):
    return windows.persistence(matches(spark, folder))


@register(
    "win_rolling_days",
    f"""with {MATCH_ROWS}, d as (select *, (timestamp '1970-01-01' + to_seconds(started_at))::date as day from match_rows),
    s as (select distinct account_id, day as start from d)
    select s.account_id, s.start::varchar as window_start, count(*) as rows, count(distinct hero_id) as heroes
    from s join d on s.account_id = d.account_id and d.day between s.start and s.start + 6 group by 1, 2""",
)
def win_rolling_days(spark, folder):
    rows = windows.rolling_days(matches(spark, folder))
    return rows.groupBy("account_id", F.col("window_start").cast("string").alias("window_start")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("hero_id").alias("heroes")
    )
