"""Dimension scores and their agreement over session gaps."""

from functools import reduce

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
from catalog.elements import _RATES, familiar_sql
from catalog.sessions import _TRANSITIONS
from habitscope.operators import dimensions, features, sessions
from habitscope.operators.measures import with_performance, with_rates

GAPS = (360, 720, 1440)


@register(
    "dim_simple_results",
    f"""with {_RATES}, c as (select account_id, hero_id, count(*) as c from r group by 1, 2),
    h as (select *, c / sum(c) over (partition by account_id) as p, row_number() over (partition by account_id order by c desc, hero_id) as k from c),
    br as (select account_id, 1 - (0.45 * sum(p) filter (k <= 5) + 0.35 * (1 - -sum(p * ln(p)) / ln(count(*))) + 0.2 * least(1, 10 / greatest(1, exp(-sum(p * ln(p)))))) as score from h group by 1),
    rc as (select account_id, role_hint, count(*) as c from r group by 1, 2),
    rp as (select *, c / sum(c) over (partition by account_id) as p from rc),
    ro as (select account_id, 1 - (0.65 * max(p) + 0.35 * (1 - case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) else 0 end)) as score from rp group by 1),
    ac as (select account_id, 0.5 + 0.5 * tanh(median(activity - base_activity) / 0.3) as score, abs(median(activity - base_activity)) <= 0.15 as neutral from r group by 1),
    orx as (select account_id, (sum(kills) / sum(kills + assists) - sum(base_share * (kills + assists)) / sum(kills + assists)) * sum(kills + assists) / (sum(kills + assists) + 100) as sr from r group by 1),
    u as (select account_id, 'breadth' as dimension, score, false as neutral, 'Balanced pool' as m, 'Focused pool' as l, 'Wide explorer' as g from br
      union all select account_id, 'role', score, false, 'Role balanced', 'Role anchored', 'Role fluid' from ro
      union all select account_id, 'activity', score, neutral, 'Balanced involvement', 'Reserved', 'Highly involved' from ac
      union all select account_id, 'orientation', greatest(0, least(1, 0.5 + sr / 0.4)), abs(sr) <= 0.04, 'Balanced contribution', 'Facilitator', 'Finisher' from orx),
    n as (select account_id, count(*) as n from r group by 1)
    select account_id, dimension, case when n >= 30 then score end as score,
      case when neutral or score between 0.42 and 0.58 then m when score > 0.5 then g else l end as label from u join n using (account_id)""",
    "score",
)
def dim_simple_results(spark, folder):
    rows = with_rates(matches(spark, folder))
    parts = [
        dimensions.result(getattr(dimensions, k)(rows), k) for k in ("breadth", "role", "activity", "orientation")
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).select("account_id", "dimension", "score", "label")


_ADAPT = f"""
ad_rows as (select *, count(*) over (partition by account_id) as en, row_number() over (partition by account_id order by started_at, match_id) as ern from r),
ad_split as (select a.*, s.split, greatest(1, floor(en * s.l)) as size, greatest(1, floor(en * s.a)) as after
  from ad_rows a, (values (0, 0.70, 0.70), (1, 0.30, 0.0), (2, 0.65, 0.35), (3, 1.0, 0.70)) s(split, l, a)),
ad_hero as (select account_id, split, hero_id, any_value(size) as n, count(*) filter (ern <= size) as c from ad_split group by 1, 2, 3),
ad_pool as ({familiar_sql('ad_hero', 5, False, keys='account_id, split')}),
ad_flag as (select e.*, p.hero_id is not null as familiar from ad_split e left join ad_pool p
  on e.account_id = p.account_id and e.split = p.split and e.hero_id = p.hero_id where e.ern > e.after),
ad_side as (select account_id, split, least(count(*) filter (familiar), count(*) filter (not familiar)) as smaller from ad_flag group by 1, 2),
ad_best as (select account_id, coalesce(max(smaller) filter (split = 0), 0) >= 20 as ok, arg_max(split, (smaller, -split)) filter (split > 0) as best from ad_side group by 1),
ad as (select f.*, case when ok then 'time_split_70_30' else 'leave_one_window_out_fallback' end as method from ad_flag f join ad_best b
  on f.account_id = b.account_id and f.split = case when ok then 0 else best end),
ad_cell as (select account_id, role_hint, count(*) filter (familiar) as l, count(*) filter (not familiar) as r,
  count(*) filter (familiar and won) as lw, count(*) filter (not familiar and won) as rw from ad group by 1, 2),
ad_out as (select account_id, sum(l) as fl, sum(r) as ofr, (sum(rw) + 4.0) / (sum(r) + 8.0) - (sum(lw) + 4.0) / (sum(l) + 8.0) as pooled,
  sum(case when l >= 8 and r >= 8 then ((rw + 4.0) / (r + 8.0) - (lw + 4.0) / (l + 8.0)) * (l + r) end) / sum(case when l >= 8 and r >= 8 then l + r end) as strat
  from ad_cell group by 1),
ad_m as (select *, median((kills + assists) / (duration_seconds / 60)) over (partition by account_id) as mm, (kills + assists) / (duration_seconds / 60) as rate from ad),
ad_act as (select account_id, any_value(method) as method, count(*) filter (familiar) as fa, count(*) filter (not familiar) as oa,
  median(rate) filter (not familiar) - median(rate) filter (familiar) as d, coalesce(nullif(median(abs(rate - mm)), 0), 1) as mad from ad_m group by 1)"""


@register(
    "dim_adaptability",
    f"""with {_RATES},{_ADAPT}, x as (select account_id, method, (fl + ofr)::bigint as sample_size, coalesce(strat, pooled) as outcome_delta,
      case when fa >= 12 and oa >= 12 then d / mad end as activity_delta, fl, ofr, (select count(*) from r where r.account_id = ad_out.account_id) as n
      from ad_out join ad_act using (account_id))
    select account_id, method, case when n < 40 then n else sample_size end as sample_size, outcome_delta, activity_delta,
      case when n >= 40 and fl >= 20 and ofr >= 20 then greatest(0, least(1, 0.5 + case when activity_delta is not null
        then 0.6 * tanh(outcome_delta / 0.25) + 0.4 * tanh(activity_delta) else tanh(outcome_delta / 0.25) end / 2)) end as score from x""",
    "outcome_delta activity_delta score",
)
def dim_adaptability(spark, folder):
    return dimensions.adaptability(with_rates(matches(spark, folder))).select(
        "account_id", "method", "sample_size", "outcome_delta", "activity_delta", "score"
    )


@register(
    "dim_resilience",
    f"""with {measured(DAY_GAP)},{_TRANSITIONS}, x as (select account_id, count(*) filter (valid_transition and prev_won) as w, count(*) filter (loss) as l,
      avg(performance) filter (loss) - avg(performance) filter (valid_transition and prev_won) as delta from streak group by 1),
    ps as (select account_id, count(*) filter (match_count >= 2 and not corrupt) as paired_sessions from sess group by 1)
    select account_id, w + l as sample_size, delta, paired_sessions,
      case when w >= 15 and l >= 15 and paired_sessions >= 10 then least(1, abs(delta) / 0.5) end as score from x join ps using (account_id)""",
    "delta score",
)
def dim_resilience(spark, folder):
    rows = measures(spark, folder, DAY_GAP)
    return dimensions.resilience(sessions.transitions(rows), session_rows(rows, DAY_GAP)).select(
        "account_id", "sample_size", "delta", "paired_sessions", "score"
    )


_ENDURANCE = """
e_rows as (select p.*, least(session_index, 4)::double as x from {rows} p join {sess} s using (account_id, session_no)
  where s.match_count >= 2 and not p.session_corrupt and p.performance is not null),
e_slope as (select account_id, session_no, regr_slope(performance, x) as slope, count(*) filter (x = 1) as f, count(*) filter (x >= 3) as l
  from e_rows group by 1, 2 having count(*) >= 2 and var_pop(x) > 0),
e_score as (select account_id, avg(slope) as slope, count(*) as k, sum(f)::bigint as f, sum(l)::bigint as l from e_slope group by 1)"""


@register(
    "dim_endurance",
    f"""with {measured(DAY_GAP)},{_ENDURANCE.format(rows='perf', sess='sess')}
    select t.account_id, coalesce(f + l, 0) as sample_size, slope,
      case when k >= 12 and f >= 15 and l >= 12 then greatest(0, least(1, 0.5 + slope / 0.8)) end as score
    from (select distinct account_id from perf) t left join e_score using (account_id)""",
    "slope score",
)
def dim_endurance(spark, folder):
    rows = measures(spark, folder, DAY_GAP)
    return dimensions.endurance(rows, session_rows(rows, DAY_GAP)).select(
        "account_id", "sample_size", "slope", "score"
    )


_RHYTHM = """select account_id, {gap} as gap, case when k >= 10 and n >= 25 then greatest(0, least(1, 0.5 + 0.35 * (len - 3) / 2 + 0.2 * (h - 3) / 2 + 0.15 * (sl - 0.5))) end as score
  from (select account_id, count(*) as n from {rows} group by 1) left join (select account_id, count(*) as k, median(match_count) as len, median(elapsed_seconds) / 3600 as h,
    avg((match_count >= 5)::int) as sl from {sess} where completed group by 1) using (account_id)"""


@register(
    "dim_rhythm",
    f"with {MATCH_ROWS},{sessionized(GAP)},{session_table(GAP)} select account_id, score from ({_RHYTHM.format(gap=GAP, rows='s', sess='sess')})",
    "score",
)
def dim_rhythm(spark, folder):
    rows = sessions.sessionize(matches(spark, folder), GAP)
    return dimensions.rhythm(rows, session_rows(rows)).select("account_id", "score")


_AGREE = " union all ".join(_RHYTHM.format(gap=g, rows=f"s{g}", sess=f"sess{g}") for g in GAPS)


@register(
    "elm_gap_agreement",
    f"with {MATCH_ROWS}"
    + "".join(f",{sessionized(g, name=f's{g}')},{session_table(g, f's{g}', f'sess{g}')}" for g in GAPS)
    + f""", sc as ({_AGREE}), d as (select *, case when score is null then null when abs(score * 2 - 1) < 0.08 then 0 when score > 0.5 then 1 else -1 end as d from sc),
    b as (select account_id, max(d) filter (gap = 720) as base, count(d) as known, count(distinct d) as kinds from d group by 1),
    a as (select d.account_id, count(*) filter (d.d = b.base) as same from d join b using (account_id) group by 1)
    select account_id, 'rhythm' as name, case when base is null then 0.6 when same >= 3 then 1.0 when same = 2 then 0.8 else 0.6 end as dimension_stability,
      case when base is null then 0.6 when kinds <= 1 then 1.0 when known >= 2 then 0.75 else 0.6 end as element_stability from b join a using (account_id)""",
    "dimension_stability element_stability",
)
def elm_gap_agreement(spark, folder):
    keys = ("account_id", "gap")
    rows = sessions.by_gap(matches(spark, folder), GAPS)
    table = sessions.sessions_of(rows, window_end=WINDOW_END, keys=keys, gap_column="gap")
    scores = dimensions.rhythm(rows, table, keys).select("account_id", "gap", F.lit("rhythm").alias("name"), "score")
    return dimensions.gap_agreement(scores, 720)


_BY_GAP = " union all ".join(
    f"""select t.account_id, {g} as gap, coalesce(f + l, 0) as sample_size, case when k >= 12 and f >= 15 and l >= 12 then greatest(0, least(1, 0.5 + slope / 0.8)) end as score
    from (select distinct account_id from s{g}) t left join e{g}_score using (account_id)"""
    for g in GAPS
)


@register(
    "dim_endurance_by_gap",
    f"with {MATCH_ROWS},{loo('match_rows')}"
    + "".join(
        f",{sessionized(g, 'perf', f's{g}')},{session_table(g, f's{g}', f'sess{g}')},"
        + _ENDURANCE.format(rows=f"s{g}", sess=f"sess{g}").replace("e_", f"e{g}_")
        for g in GAPS
    )
    + f" {_BY_GAP}",
    "score",
)
def dim_endurance_by_gap(spark, folder):
    keys = ("account_id", "gap")
    rows = sessions.by_gap(with_performance(matches(spark, folder)), GAPS)
    table = sessions.sessions_of(rows, window_end=WINDOW_END, keys=keys, gap_column="gap")
    return dimensions.endurance(rows, table, keys).select("account_id", "gap", "sample_size", "score")


# Roles count from a confidence of 0.8 here, so that some rows of the given tables are without one.
_FEATURES = f"""{measured()},
fl as (select *, count(*) over (partition by account_id) as n, case when role_confidence >= 0.8 then role_hint end as role from perf),
hc as (select account_id, hero_id, count(*) as c, any_value(n) as n from fl group by 1, 2),
fam as ({familiar_sql('hc', 5, True)}),
fx as (select fl.*, fam.hero_id is not null as familiar from fl left join fam using (account_id, hero_id)),
rc as (select account_id, role, count(*) as c, avg(performance) as mean, min(struct_pack(s := started_at, m := match_id)) as seen from fl where role is not null group by 1, 2),
hk as (select *, row_number() over (partition by account_id order by c desc, hero_id) as k, c / sum(c) over (partition by account_id) as p from hc),
rk as (select *, c / sum(c) over (partition by account_id) as p from rc)"""


def features_of(spark, folder):
    rows = measures(spark, folder)
    return rows, session_rows(rows)


@register(
    "agg_feature_set",
    f"""with {_FEATURES},
    a as (select account_id, count(*) as sample_size, count(*) as dated_rows, count(role) as role_rows, count(activity) as activity_rows, count(*) as orientation_rows,
        count(performance) filter (familiar) as familiar_rows, count(performance) filter (not familiar) as off_pool_rows,
        avg(performance) filter (familiar) as familiar_performance, avg(performance) filter (not familiar) as off_pool_performance,
        sum(weight) ** 2 / sum(weight ** 2) as effective_sample_size, min(started_at) as window_start, max(started_at) as window_end, count(role) / count(*) as role_coverage from fx group by 1),
    h as (select account_id, string_agg(hero_id || ':' || c, ',' order by hero_id) as hero_counts, case when count(*) > 1 then -sum(p * ln(p)) else 0 end as hero_entropy,
        case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) else 0 end as normalized_hero_entropy, exp(-sum(p * ln(p))) as effective_hero_count,
        sum(p) filter (k <= 1) as top1_share, sum(p) filter (k <= 3) as top3_share, sum(p) filter (k <= 5) as top5_share, sum(p) filter (k <= 10) as top10_share from hk group by 1),
    r as (select account_id, string_agg(role || ':' || c, ',' order by role) as role_counts, string_agg(role || ':' || round(mean, 6)::decimal(9, 6)::varchar, ',' order by role) as role_performance,
        case when count(*) > 1 then -sum(p * ln(p)) else 0 end as role_entropy, case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) else 0 end as normalized_role_entropy,
        exp(-sum(p * ln(p))) as effective_role_count, arg_min(role, struct_pack(less := -c, s := seen)) as dominant_role, coalesce(string_agg(role, ',' order by role) filter (c >= 3), '') as familiar_roles from rk group by 1),
    f as (select account_id, string_agg(hero_id, ',' order by hero_id) as familiar_heroes from fam group by 1),
    ses as (select account_id, count(*) filter (completed) as completed_sessions, count(*) filter (left_censored) as left_censored_sessions, count(*) filter (right_censored) as right_censored_sessions from sess group by 1)
    select a.*, h.* exclude (account_id), coalesce(role_counts, '') as role_counts, coalesce(role_performance, '') as role_performance, coalesce(role_entropy, 0) as role_entropy,
      coalesce(normalized_role_entropy, 0) as normalized_role_entropy, coalesce(effective_role_count, 0) as effective_role_count, dominant_role, coalesce(familiar_roles, '') as familiar_roles,
      coalesce(familiar_heroes, '') as familiar_heroes, ses.* exclude (account_id)
    from a join h using (account_id) left join r using (account_id) left join f using (account_id) join ses using (account_id)""",
    "familiar_performance off_pool_performance effective_sample_size role_coverage hero_entropy normalized_hero_entropy effective_hero_count top1_share top3_share top5_share top10_share role_entropy normalized_role_entropy effective_role_count",
)
def agg_feature_set(spark, folder):
    rows, sessions = features_of(spark, folder)
    table = features.feature_set(rows, sessions, 0.8)

    def listed(column, text):
        return F.coalesce(F.concat_ws(",", F.transform(F.map_entries(column), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), text(e["value"])))), F.lit("")).alias(column)

    return table.select(
        *[c for c in table.columns if c not in ("hero_counts", "role_counts", "role_performance", "familiar_heroes", "familiar_roles")],
        listed("hero_counts", lambda v: v.cast("string")),
        listed("role_counts", lambda v: v.cast("string")),
        listed("role_performance", lambda v: F.round(v, 6).cast("decimal(9,6)").cast("string")),
        F.concat_ws(",", F.col("familiar_heroes").cast("array<string>")).alias("familiar_heroes"),
        F.concat_ws(",", "familiar_roles").alias("familiar_roles"),
    )


@register(
    "agg_feature_members",
    f"""with {_FEATURES},
    m as (select account_id, match_id, started_at, unnest(list_filter(['source', 'dated', 'orientation', if(role is not null, 'role', null), if(activity is not null, 'activity', null),
      if(performance is not null, if(familiar, 'familiar', 'off_pool'), null)], lambda x: x is not null)) as population from fx),
    o as (select *, row_number() over (partition by account_id, population order by started_at, match_id) as rn, count(*) over (partition by account_id, population) as population_rows from m)
    select account_id, population, (rn - 1) // 4096 as segment, any_value(population_rows) as population_rows, string_agg(match_id, ',' order by rn) as match_ids from o group by 1, 2, 3""",
)
def agg_feature_members(spark, folder):
    table = features.feature_members(measures(spark, folder), 0.8)
    return table.withColumn("match_ids", F.concat_ws(",", F.col("match_ids").cast("array<string>")))
