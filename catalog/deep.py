"""Detectors, hypotheses and the budgeted selection."""

from pyspark.sql import functions as F

from catalog.base import GAP, MATCH_ROWS, matches, register, sessionized
from habitscope.operators import detectors, sessions
from habitscope.session import cut

_S = f"{MATCH_ROWS},{sessionized(GAP)}"


def rows(spark, folder):
    return sessions.sessionize(matches(spark, folder), GAP)


@register(
    "agg_corpus",
    f"""with {MATCH_ROWS} select account_id, count(*) as matches, 1.0 as summary_coverage, avg(won::int) as win_rate, count(distinct hero_id) as distinct_heroes,
      count(*) filter (duration_seconds < 1800) as short_games, count(*) filter (duration_seconds between 1800 and 2700) as medium_games,
      count(*) filter (duration_seconds > 2700) as long_games from match_rows group by 1""",
    "summary_coverage win_rate",
)
def agg_corpus(spark, folder):
    return detectors.corpus(matches(spark, folder))


@register(
    "agg_hero_roles",
    f"with {MATCH_ROWS} select account_id, hero_id, role_hint, count(*) as matches, avg(won::int) as win_rate from match_rows group by 1, 2, 3",
    "win_rate",
)
def agg_hero_roles(spark, folder):
    return detectors.hero_roles(matches(spark, folder))


_DETECT = f"""{_S}, x as (select *, n - rn as back, case when duration_seconds < 1800 then 'short' when duration_seconds <= 2700 then 'medium' else 'long' end as b from s),
g as (select account_id, count(*) as n, sum(won::int) as w, count(*) filter (b = 'long') as ln, count(*) filter (b = 'long' and won) as lw, count(*) filter (b = 'short') as sn,
  count(*) filter (b = 'short' and won) as sw, count(*) filter (session_index <= 3) as en, count(*) filter (session_index <= 3 and won) as ew, count(*) filter (session_index >= 4) as an,
  count(*) filter (session_index >= 4 and won) as aw, count(*) filter (back < 20) as rn, count(*) filter (back < 20 and won) as rw, count(*) filter (back between 20 and 59) as pn,
  count(*) filter (back between 20 and 59 and won) as pw, stddev_pop(deaths) as sd, list_sort(list(deaths))[count(*) // 2 + 1] as um from x group by 1),
h as (select account_id, hero_id, count(*) as hn, sum(won::int) as hw from s group by 1, 2),
hr as (select h.*, g.n - hn as o, g.w - hw as ow, hw / hn - (g.w - hw) / (g.n - hn) as e from h join g using (account_id)),
tp as (select *, sum(hn) over (partition by account_id) as t, count(*) over (partition by account_id) as d, row_number() over (partition by account_id order by hn desc, hero_id) as k from h),
u as (
  select account_id, 'overall_outcome_profile' as pattern_id, null::bigint as hero_id, w / n as effect, n as sample_size, least(1, n / 20) as stability, 0.35 as act, least(1, n / 20) as conf, 0.5 as baseline from g
  union all select account_id, case when lw / ln < sw / sn then 'long_game_decline' else 'long_game_improvement' end, null, lw / ln - sw / sn, ln, case when (lw >= ln / 2) <> (sw >= sn / 2) then 1 else 0.6 end, 0.76, least(1, least(ln, sn) / 20), sw / sn
    from g where ln >= 5 and sn >= 5 and abs(lw / ln - sw / sn) >= 0.12
  union all select account_id, 'session_decline', null, aw / an - ew / en, an, case when (aw >= an / 2) <> (ew >= en / 2) then 1 else 0.6 end, 0.82, least(1, least(an, en) / 20), ew / en
    from g where an >= 5 and en >= 5 and aw / an - ew / en < -0.12
  union all select account_id, case when rw / rn < pw / pn then 'recent_decline' else 'recent_improvement' end, null, rw / rn - pw / pn, rn, case when (rw >= rn / 2) <> (pw >= pn / 2) then 1 else 0.6 end, 0.66, least(1, least(rn, pn) / 20), pw / pn
    from g where rn >= 5 and pn >= 5 and abs(rw / rn - pw / pn) >= 0.12
  union all select account_id, 'hero_overperformance', hero_id, e, hn, case when (hw >= hn / 2) <> (ow >= o / 2) then 1 else 0.6 end, 0.78, least(1, least(hn, o) / 20), ow / o from hr where hn >= 5 and o >= 5 and e >= 0.12
  union all select account_id, 'hero_specialization', hero_id, hn / t, hn, least(1, hn / 20), 0.58, least(1, hn / 20), 1 / d from tp where k = 1 and hn >= 8 and hn / t >= 0.45
  union all select account_id, 'consistency_collapse', null, sd, n, least(1, n / 20), 0.7, least(1, n / 20), um from g where n >= 10 and sd >= 2.5),
dt as (select *, least(1, abs(effect)) * conf * act as priority from u)"""


@register(
    "det_patterns",
    f"with {_DETECT} select account_id, pattern_id, hero_id, effect, sample_size, stability, baseline, priority from dt",
    "effect stability baseline priority",
)
def det_patterns(spark, folder):
    return detectors.detect(rows(spark, folder)).select(
        "account_id", "pattern_id", "hero_id", "effect", "sample_size", "stability", "baseline", "priority"
    )


@register(
    "det_ranking",
    f"""with {_DETECT} select account_id, pattern_id, hero_id,
      row_number() over (partition by account_id order by priority desc, pattern_id, hero_id nulls first) as rank from dt""",
)
def det_ranking(spark, folder):
    return detectors.detect(rows(spark, folder)).select("account_id", "pattern_id", "hero_id", "rank")


_TEMPLATES = ", ".join(
    f"('{p}', '{s}', '{e}', {i})" for i, (p, s, e, _, _) in enumerate(detectors.TEMPLATES)
)
_HYP = f"""{_DETECT}, tm as (select * from (values {_TEMPLATES}) t(pattern_id, suffix, explanation, i)),
hy as (select account_id, pattern_id || ':' || suffix as hypothesis_id, pattern_id as source_pattern_id, hero_id, explanation, priority from dt join tm using (pattern_id)),
hk as (select *, row_number() over (partition by account_id order by priority desc, hypothesis_id, hero_id) as k from hy),
hp as (select *, row_number() over (partition by account_id, source_pattern_id order by k) as p from hk),
pr as (select * from (select *, row_number() over (partition by account_id order by p > 1, k) as place from hp) where place <= 3)"""


@register(
    "hyp_generate",
    f"with {_HYP} select account_id, hypothesis_id, source_pattern_id, hero_id, explanation, priority from hy",
    "priority",
)
def hyp_generate(spark, folder):
    return detectors.hypotheses(detectors.detect(rows(spark, folder))).select(
        "account_id", "hypothesis_id", "source_pattern_id", "hero_id", "explanation", "priority"
    )


def _primary(table):
    return detectors.primary_hypotheses(detectors.hypotheses(detectors.detect(table)))


@register(
    "hyp_primary",
    f"with {_HYP} select account_id, hypothesis_id, hero_id, place from pr",
)
def hyp_primary(spark, folder):
    return _primary(rows(spark, folder)).select("account_id", "hypothesis_id", "hero_id", "place")


def _predicate_sql(kind: str, bucket: str | None, won: bool | None) -> str:
    outcome = f"x.won = {str(won).lower()}"
    place = "x.session_index >= 4" if bucket == ">=4" else "x.session_index <= 3"
    return {
        "hero_and_outcome": f"x.hero_id = r.hero_id and {outcome}",
        "hero": "x.hero_id = r.hero_id",
        "non_hero_same_role": "x.hero_id <> r.hero_id" + ("" if won is None else f" and {outcome}"),
        "duration_bucket": f"x.b = '{bucket}'",
        "duration_and_outcome": f"x.b = '{bucket}' and {outcome}",
        "session_position": place,
        "session_position_and_outcome": f"{place} and {outcome}",
        "outcome": outcome,
    }[kind]


_ROLE_CASES = " ".join(
    f"when r.hypothesis_id = '{p}:{s}' then case when {_predicate_sql(*d[2])} then 'control' when {_predicate_sql(*d[1])} then 'negative' "
    f"when {_predicate_sql(*d[0])} then 'positive' end"
    for p, s, _, _, d in detectors.TEMPLATES
)


@register(
    "sel_candidates",
    f"""with {_HYP}, r as (select * from (select *, row_number() over (partition by account_id, hypothesis_id order by place desc) as l from pr) where l = 1),
    cr as (select x.*, r.hypothesis_id, r.priority, case {_ROLE_CASES} end as role_in from x join r on x.account_id = r.account_id),
    cm as (select account_id, match_id, string_agg(hypothesis_id || '=' || role_in, ';' order by hypothesis_id) as roles, sum(priority) as reuse,
      any_value(b) as b, any_value(won) as won, any_value(deaths) as deaths from cr where role_in is not null group by 1, 2)
    select account_id, match_id, roles, 0.22 * (0.7 + case when b in ('long', 'short') then 0.1 else 0 end) + 0.2 * least(1, 0.5 + case when won then 0.1 else 0 end + case when deaths >= 6 then 0.25 else 0 end)
      + 0.18 * 0.55 + 0.14 * least(1, 0.4 + deaths / 12) + 0.16 * least(1, reuse) as base_value from cm""",
    "base_value",
)
def sel_candidates(spark, folder):
    table = cut(rows(spark, folder))
    options = detectors.candidates(table, _primary(table))
    return options.select(
        "account_id",
        "match_id",
        F.concat_ws(
            ";", F.transform(F.map_entries("evidence_roles"), lambda e: F.concat_ws("=", e["key"], e["value"]))
        ).alias("roles"),
        "base_value",
    )


def _plan(spark, folder):
    table = cut(rows(spark, folder))
    primary = cut(_primary(table))
    options = cut(detectors.candidates(table, primary))
    return table, primary, options, detectors.plan_selection(options, primary)


# The greedy as a recursive query: a step takes each account's best match with the needs that are left by then.
_LEFT = "(3 - len(list_filter(used, lambda u: u = n.h || '=' || n.g)))"
_PLAN_SQL = f"""{_HYP}, r as (select * from (select *, row_number() over (partition by account_id, hypothesis_id order by place desc) as l from pr) where l = 1),
    cr as (select x.*, r.hypothesis_id, r.priority::double as priority, case {_ROLE_CASES} end as role_in from x join r on x.account_id = r.account_id),
    cm as (select account_id, match_id, list({{'h': hypothesis_id, 'g': role_in, 'p': priority}} order by hypothesis_id) as roles, sum(priority) as reuse,
      any_value(b) as b, any_value(won) as won, any_value(deaths)::double as deaths from cr where role_in is not null group by 1, 2),
    cv as (select account_id, match_id, roles, 0.22::double * (0.7::double + case when b in ('long', 'short') then 0.1::double else 0 end)
      + 0.2::double * least(1, 0.5::double + case when won then 0.1::double else 0 end + case when deaths >= 6 then 0.25::double else 0 end)
      + 0.18::double * 0.55::double + 0.14::double * least(1, 0.4::double + deaths / 12) + 0.16::double * least(1, reuse) as base from cm),
    gr as (
      select account_id, 0 as step, null::bigint as match_id, null::double as gain, '' as supports, []::bigint[] as taken, []::varchar[] as used from (select distinct account_id from r)
      union all
      select account_id, step + 1, best.m, best.gain, array_to_string(best.uses, ';'), list_append(taken, best.m), list_concat(used, best.uses) from (
        select account_id, step, taken, used, max({{'gain': gain, 'useful': useful, 'roles': n_roles, 'low': -match_id, 'm': match_id, 'uses': uses}}) as best from (
          select account_id, step, taken, used, match_id, len(roles) as n_roles, len(helped) as useful, list_transform(helped, lambda n: n.h || '=' || n.g) as uses,
            greatest(0, base + list_sum(list_transform(helped, lambda n: n.p / {_LEFT})) - least(0.7::double, step * 0.015::double) - 0.04::double) as gain
          from (select gr.account_id, step, taken, used, cv.match_id, roles, base, list_filter(roles, lambda n: {_LEFT} > 0) as helped
            from gr join cv using (account_id) where step < 25 and not list_contains(taken, cv.match_id)) where len(helped) > 0)
        where gain >= 0.05 group by 1, 2, 3, 4)),
    pl as (select account_id, match_id, step as selection_order, gain, supports from gr where step > 0)"""


@register("sel_plan", f"with recursive {_PLAN_SQL} select * from pl", "gain")
def sel_plan(spark, folder):
    return _plan(spark, folder)[3]


@register(
    "sel_state",
    f"""with recursive {_PLAN_SQL},
    sp as (select account_id, count(*) as selected from pl group by 1), og as (select account_id, count(*) as offered from cv group by 1),
    gv as (select account_id, unnest(string_split(supports, ';')) as need from pl), gc as (select account_id, need, count(*) as given from gv group by 1, 2),
    nd as (select account_id, hypothesis_id, grp from (select distinct account_id, hypothesis_id from pr), (values ('control'), ('negative'), ('positive')) v(grp)),
    ms as (select nd.*, 3 - coalesce(given, 0) as missing from nd left join gc on gc.account_id = nd.account_id and gc.need = hypothesis_id || '=' || grp),
    op as (select account_id, '[' || coalesce(string_agg('{{"hypothesis_id":"' || hypothesis_id || '","group":"' || grp || '","missing":' || missing || '}}', ',' order by hypothesis_id, grp)
      filter (missing > 0), '') || ']' as open_needs from ms group by 1)
    select account_id, coalesce(selected, 0) as selected, coalesce(selected, 0)::double as cost, open_needs,
      case when selected >= 25 then 'max_deep_matches' when coalesce(offered, 0) = 0 then 'no_candidates' when coalesce(selected, 0) >= offered then 'evidence_sufficient' else 'marginal_gain_exhausted' end as stopping_reason
    from op left join sp using (account_id) left join og using (account_id)""",
    "cost",
)
def sel_state(spark, folder):
    _, primary, options, plan = _plan(spark, folder)
    return detectors.plan_state(plan, options, primary).withColumn("open_needs", F.to_json("open_needs"))


@register(
    "join_hydration",
    f"""with recursive {_PLAN_SQL} select account_id, match_id, selection_order,
      case when match_id in (select match_id from match_rows where duration_seconds > 2000) then 'stored' else 'read' end as source from pl""",
)
def join_hydration(spark, folder):
    _, _, options, plan = _plan(spark, folder)
    stored = matches(spark, folder).where(F.col("duration_seconds") > 2000).select("match_id")
    return detectors.hydrate(plan, stored, options).select("account_id", "match_id", "selection_order", "source")


@register(
    "dep_evaluate",
    f"""with recursive {_PLAN_SQL},
    ur as (select account_id, match_id, unnest(roles) as e from cv join pl using (account_id, match_id)),
    vr as (select account_id, e.h as hypothesis_id, e.g as part,
        case when r.explanation in ('death_risk_difference', 'late_death_risk', 'session_risk') then x.deaths::double
          when r.explanation = 'timing_difference' then (x.kills * 20 + x.assists * 5)::double else x.won::int::double end as value
      from ur join x using (account_id, match_id) join r on r.account_id = ur.account_id and r.hypothesis_id = e.h),
    ev as (select account_id, hypothesis_id, count(*) filter (part = 'positive') as positive_matches, count(*) filter (part = 'negative') as negative_matches,
      count(*) filter (part = 'control') as control_matches, avg(value) filter (part = 'positive') as positive_value, avg(value) filter (part = 'control') as control_value from vr group by 1, 2),
    es as (select *, least(positive_matches, negative_matches, control_matches) as size, positive_value - control_value as raw from ev),
    ec as (select *, case when size < 3 or raw is null then 'low' when size >= 8 and abs(raw) >= 0.15 then 'high' else 'moderate' end as confidence from es)
    select account_id, hypothesis_id, case when size < 2 then 'insufficient_evidence' when confidence <> 'low' then 'resolved' else 'moderate' end as status,
      confidence, positive_matches, negative_matches, control_matches, positive_value, case when size >= 2 then raw end as effect from ec""",
    "positive_value effect",
)
def dep_evaluate(spark, folder):
    table, primary, options, plan = _plan(spark, folder)
    features = table.withColumn("gold_per_min", F.col("kills") * 20 + F.col("assists") * 5)
    return detectors.evaluate_hypotheses(primary, plan, options, features).select(
        "account_id",
        "hypothesis_id",
        "status",
        "confidence",
        "positive_matches",
        "negative_matches",
        "control_matches",
        "positive_value",
        "effect",
    )
