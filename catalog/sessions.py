"""Session and recency queries."""

from pyspark.sql import functions as F

from catalog.base import (
    DAY_GAP,
    GAP,
    MATCH_ROWS,
    WINDOW_END,
    loo,
    matches,
    measured,
    measures,
    register,
    session_rows,
    session_table,
    sessionized,
)
from habitscope.functions.expr import kish
from habitscope.functions.robust import leave_one_out, lower_weighted_median, spread
from habitscope.operators import sessions
from habitscope.operators.measures import with_rates


@register(
    "ses_sessionize",
    f"with {MATCH_ROWS},{sessionized(90)} select account_id, match_id, session_no, session_index, session_corrupt from s",
)
def ses_sessionize(spark, folder):
    return sessions.sessionize(matches(spark, folder), 90).select(
        "account_id", "match_id", "session_no", "session_index", "session_corrupt"
    )


@register(
    "ses_session_table",
    f"with {MATCH_ROWS},{sessionized(90)},{session_table(90)} select * from sess",
)
def ses_session_table(spark, folder):
    return sessions.sessions_of(sessions.sessionize(matches(spark, folder), 90), 90, WINDOW_END)


_GAP_UNION = " union all ".join(
    f"select account_id, {g} as gap, count(*) as sessions, max(match_count) as longest, "
    f"sum(completed::int)::bigint as completed from sess{g} group by 1"
    for g in (60, 90, 120)
)


@register(
    "ses_gap_sensitivity",
    f"with {MATCH_ROWS}"
    + "".join(
        f",{sessionized(g, name=f's{g}')},{session_table(g, f's{g}', f'sess{g}')}" for g in (60, 90, 120)
    )
    + f" select account_id, gap::bigint as gap, sessions, longest, completed from ({_GAP_UNION})",
)
def ses_gap_sensitivity(spark, folder):
    rows = sessions.by_gap(matches(spark, folder))
    table = sessions.sessions_of(rows, window_end=WINDOW_END, keys=("account_id", "gap"), gap_column="gap")
    return table.groupBy("account_id", "gap").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.max("match_count").alias("longest"),
        F.sum(F.col("completed").cast("bigint")).alias("completed"),
    )


@register(
    "ses_legacy_sessions",
    f"""with {MATCH_ROWS}, d as (
      select match_id, account_id, case when match_id % 13 <> 0 then started_at end as started_at, duration_seconds
      from match_rows),
    l as (select *, lag(started_at + greatest(0, duration_seconds)) over o as prev_end,
          lag(match_id) over o is null as is_first from d
          window o as (partition by account_id order by started_at is null, coalesce(started_at, 0), match_id)),
    k as (select *, sum(case when is_first or started_at is null or prev_end is null
              or started_at - prev_end > 43200 then 1 else 0 end) over
              (partition by account_id order by started_at is null, coalesce(started_at, 0), match_id
               rows unbounded preceding)::bigint as session_no from l)
    select account_id, match_id, session_no,
           row_number() over (partition by account_id, session_no order by started_at, match_id) as session_index
    from k""",
)
def ses_legacy_sessions(spark, folder):
    rows = matches(spark, folder).select(
        "match_id",
        "account_id",
        F.when(F.col("match_id") % 13 != 0, F.col("started_at")).alias("started_at"),
        "duration_seconds",
    )
    return sessions.legacy_sessions(rows, GAP).select("account_id", "match_id", "session_no", "session_index")


@register(
    "rec_weights",
    f"""with {MATCH_ROWS}, w as (select *, exp(-0.6931471805599453 * greatest(0.0,
          (max(started_at) over (partition by account_id) - started_at)::double) / 15552000.0) as weight,
          (kills + assists)::double as ka from match_rows),
        c as (select *, sum(weight) over (partition by account_id order by ka rows unbounded preceding) as cum,
                     sum(weight) over (partition by account_id) as total from w)
        select account_id, any_value(total) as weight_sum,
               sum(weight) * sum(weight) / sum(weight * weight) as effective_sample,
               sum(weight * ka) / sum(weight) as weighted_mean,
               min(case when cum >= total / 2 - 1e-9 * total then ka end) as weighted_median
        from c group by account_id""",
    "weight_sum effective_sample weighted_mean weighted_median",
)
def rec_weights(spark, folder):
    rows = sessions.with_recency(matches(spark, folder)).withColumn(
        "ka", (F.col("kills") + F.col("assists")).cast("double")
    )
    w = F.col("weight")
    sums = rows.groupBy("account_id").agg(
        F.sum(w).alias("weight_sum"),
        kish(F.sum(w), F.sum(w * w)).alias("effective_sample"),
        F.try_divide(F.sum(w * F.col("ka")), F.sum(w)).alias("weighted_mean"),
    )
    return sums.join(lower_weighted_median(rows, ["account_id"], "ka", "weight"), "account_id")


@register(
    "agg_leave_one_out",
    f"with {MATCH_ROWS},{loo('match_rows')} select account_id, match_id, coalesce(ac, 0) as activity_centre, "
    "asc_ as activity_scale, coalesce(dc, 0) as death_rate_centre, dsc as death_rate_scale from perf_scale",
    "activity_centre activity_scale death_rate_centre death_rate_scale",
)
def agg_leave_one_out(spark, folder):
    return leave_one_out(with_rates(matches(spark, folder)), ["account_id"], ["activity", "death_rate"]).select(
        "account_id", "match_id", "activity_centre", "activity_scale", "death_rate_centre", "death_rate_scale"
    )


@register(
    "agg_performance_proxy",
    f"with {measured()} select account_id, match_id, activity, death_rate, outcome_component, activity_component, "
    "survival_component, performance, weight from perf",
    "activity death_rate outcome_component activity_component survival_component performance weight",
)
def agg_performance_proxy(spark, folder):
    return measures(spark, folder).select(
        "account_id",
        "match_id",
        "activity",
        "death_rate",
        "outcome_component",
        "activity_component",
        "survival_component",
        "performance",
        "weight",
    )


@register(
    "agg_robust_spread",
    f"with {MATCH_ROWS}, c as (select *, median(kills::double) over (partition by account_id) as m from match_rows) "
    "select account_id, any_value(m) as centre, median(abs(kills - m)) as mad, count(*) as sample from c group by 1",
    "centre mad",
)
def agg_robust_spread(spark, folder):
    rows = matches(spark, folder).select("account_id", F.col("kills").cast("double").alias("kills"))
    return spread(rows, ["account_id"], "kills")


_TRANSITIONS = """
tr as (
  select *, lag(won) over w as prev_won, lag(session_corrupt) over w as prev_corrupt,
         lag(performance) over w as prev_performance, lag(match_id) over w is not null as paired
  from perf window w as (partition by account_id, session_no order by session_index)),
tv as (select *, paired and not prev_corrupt and not session_corrupt and prev_performance is not null
         and performance is not null as valid_transition from tr),
tl as (select *, coalesce(valid_transition, false) and not coalesce(prev_won, false) as loss from tv),
tg as (select *, sum(case when loss then 0 else 1 end) over
         (partition by account_id order by rn rows unbounded preceding) as grp from tl),
streak as (select *, case when loss then sum(loss::int) over
         (partition by account_id, grp order by rn rows unbounded preceding) else 0 end::bigint as loss_streak from tg)"""


@register(
    "win_transitions",
    f"""with {measured(DAY_GAP)},{_TRANSITIONS}
    select account_id, sum((valid_transition and prev_won)::int)::bigint as after_win,
           sum(loss::int)::bigint as after_loss, sum((loss_streak >= 2)::int)::bigint as after_two_losses,
           avg(performance) filter (valid_transition and prev_won) as mean_after_win,
           avg(performance) filter (loss) as mean_after_loss,
           avg(performance) filter (loss_streak >= 2) as mean_after_two_losses
    from streak group by account_id""",
    "mean_after_win mean_after_loss mean_after_two_losses",
)
def win_transitions(spark, folder):
    rows = sessions.transitions(measures(spark, folder, DAY_GAP))
    valid, won = F.col("valid_transition"), F.coalesce(F.col("prev_won"), F.lit(False))
    performance = F.col("performance")
    win, loss, two = valid & won, valid & ~won, F.col("loss_streak") >= 2
    return rows.groupBy("account_id").agg(
        F.count_if(win).alias("after_win"),
        F.count_if(loss).alias("after_loss"),
        F.count_if(two).alias("after_two_losses"),
        F.avg(F.when(win, performance)).alias("mean_after_win"),
        F.avg(F.when(loss, performance)).alias("mean_after_loss"),
        F.avg(F.when(two, performance)).alias("mean_after_two_losses"),
    )


@register(
    "win_position_curve",
    f"""with {measured(DAY_GAP)}
    select account_id, least(session_index, 4)::bigint as position, count(*) as sample, avg(performance) as mean_performance
    from perf join sess using (account_id, session_no)
    where match_count >= 2 and not session_corrupt and performance is not null group by 1, 2""",
    "mean_performance",
)
def win_position_curve(spark, folder):
    from habitscope.operators.windows import position_curve

    rows = measures(spark, folder, DAY_GAP)
    return position_curve(rows, session_rows(rows, DAY_GAP))


@register(
    "win_transition_groups",
    f"""with {measured(DAY_GAP)},{_TRANSITIONS}
    select account_id, metric, count(x) filter (prev_won) as after_win_rows, count(x) filter (not prev_won) as after_loss_rows,
           median(x) filter (prev_won) as after_win, median(x) filter (not prev_won) as after_loss
    from (select account_id, prev_won, unnest([{{'m': 'activity', 'x': activity}}, {{'m': 'death', 'x': death_rate}},
                 {{'m': 'performance', 'x': performance}}], recursive := true)
          from streak where paired and not prev_corrupt and not session_corrupt and prev_won is not null) t(account_id, prev_won, metric, x)
    where x is not null group by 1, 2""",
    "after_win after_loss",
)
def win_transition_groups(spark, folder):
    from habitscope.operators.windows import transition_groups

    return transition_groups(sessions.transitions(measures(spark, folder, DAY_GAP)))
