"""Pattern action queries."""

from pyspark.sql import functions as F

from catalog.base import (
    DAY_GAP,
    GAP,
    MATCH_ROWS,
    WINDOW_END,
    matches,
    measured,
    measures,
    register,
    session_rows,
)
from catalog.elements import _BUCKET_SQL, _CURVE_SQL, HERO_SQL, baseline_sql, with_function
from catalog.heroes import KNOW_SQL, ROSTER, knowledge
from catalog.rules import element_table
from habitscope.operators import actions, patterns
from habitscope.session import cut

_CORE = """
cc as (select account_id, hero_id, count(*) as c, max(started_at) as ls, arg_max(match_id, (started_at, match_id)) as lm from match_rows group by 1, 2),
cf as (select *, case when max(c) over (partition by account_id) >= 3 then 3 else 2 end as fl from cc),
cr as (select *, row_number() over w as rank, count(*) over (partition by account_id) as k, greatest(1, sum(c) over (partition by account_id) * 0.5) as goal,
  coalesce(sum(c) over (partition by account_id order by c desc, ls desc, lm desc, hero_id rows between unbounded preceding and 1 preceding), 0) as bf
  from cf where c >= fl window w as (partition by account_id order by c desc, ls desc, lm desc, hero_id)),
core as (select account_id, hero_id, c, rank from cr where rank <= {limit} and not (bf >= goal and rank - 1 >= least(3, k)))"""


@register("act_core_heroes", f"with {MATCH_ROWS},{_CORE.format(limit=10)} select * from core")
def act_core_heroes(spark, folder):
    return actions.core_heroes(matches(spark, folder), knowledge(spark), 10)


_REL = f"""{MATCH_ROWS},
rr as (select account_id, role_hint from match_rows group by 1, 2 having count(*) >= 3),
rs as (select m.*, 0.42 * won::int + 0.28 * least(1, (kills + assists) / greatest(greatest(duration_seconds / 60, 1) * 1.2, 1)) + 0.2 * (1 - least(1, deaths / greatest(greatest(duration_seconds / 60, 1) * 0.75, 1)))
  + 0.1 * case when rr.role_hint is not null or m.account_id not in (select account_id from rr) then 1 else 0.5 end as s from match_rows m left join rr on rr.account_id = m.account_id and rr.role_hint = m.role_hint),
rh as (select *, 0.5 + 0.5 * (row_number() over (partition by account_id, hero_id order by started_at, match_id) - 1) / greatest(count(*) over (partition by account_id, hero_id) - 1, 1) as wh,
  0.5 + 0.5 * (row_number() over (partition by account_id order by started_at, match_id) - 1) / greatest(count(*) over (partition by account_id) - 1, 1) as wa from rs),
rb as (select account_id, sum(wa * s) / sum(wa) as base, count(*) as n from rh group by 1),
rw as (select account_id, hero_id, sum(wh * s) / sum(wh) as raw, count(*) as n from rh group by 1, 2 having count(*) >= 5),
rx as (select rw.account_id, rw.hero_id, greatest(0, least(1, base + (raw - base) * rw.n / (rw.n + 20))) as reliability, least(1, rw.n / 25) * (0.85 + 0.15 * least(1, rw.n / rb.n * 8)) as confidence_score, rw.n as matches from rw join rb using (account_id)),
rk as (select *, row_number() over (partition by account_id order by round(reliability, 9) desc, round(confidence_score, 9) desc, hero_id) as rank from rx)"""


@register(
    "act_hero_reliability",
    f"with {_REL} select account_id, hero_id, reliability, confidence_score, matches, rank from rk where rank <= 5",
    "reliability confidence_score",
)
def act_hero_reliability(spark, folder):
    return actions.hero_reliability(matches(spark, folder), knowledge(spark), minimum=5)


@register(
    "act_comfort_edge",
    f"""with {_REL} select account_id, case when count(*) >= 5 then 'limited' else 'unavailable' end as status, string_agg(hero_id::varchar, ',' order by rank) filter (rank <= 2) as reference_core,
      count(*) as ranked_heroes, min(confidence_score) as confidence_score from rk where rank <= 5 group by 1""",
    "confidence_score",
)
def act_comfort_edge(spark, folder):
    ranked = actions.hero_reliability(matches(spark, folder), knowledge(spark), minimum=5)
    return actions.comfort_edge(ranked, knowledge(spark)).select(
        "account_id",
        "status",
        F.concat_ws(",", F.col("reference_core").cast("array<string>")).alias("reference_core"),
        "ranked_heroes",
        "confidence_score",
    )


_TRANSFER = f"""{MATCH_ROWS},{_CORE.format(limit=10)},
tm as (select m.*, core.hero_id is not null as core from match_rows m left join core on core.account_id = m.account_id and core.hero_id = m.hero_id where m.duration_seconds >= 600),
tl as (select account_id, core, 'death_exposure' as signal, deaths / (duration_seconds / 600) as x from tm
  union all select account_id, core, 'combat_involvement', (kills + assists) / (duration_seconds / 60) from tm
  union all select account_id, core, 'finisher_orientation', case when kills + assists > 0 then kills / (kills + assists) end from tm
  union all select account_id, core, 'result_distribution', won::int::double from tm),
tmed as (select *, median(x) over (partition by account_id, signal) as m from tl),
tx as (select account_id, signal, count(*) filter (core) as core_rows, count(*) filter (not core) as off_rows, count(x) filter (core) as cv, count(x) filter (not core) as ov,
  median(x) filter (core) as core_value, median(x) filter (not core) as off_value, median(abs(x - m)) as mad from tmed group by 1, 2),
ty as (select *, case signal when 'death_exposure' then 0.35 when 'combat_involvement' then 0.25 when 'finisher_orientation' then 0.18 else 0.20 end as fl from tx),
tz as (select *, abs(off_value - core_value) / greatest(mad, fl) as effect_size, least(1, least(core_rows, off_rows) / 25) as confidence_score,
  coalesce(cv >= 10 and ov >= 10 and least(1, least(core_rows, off_rows) / 25) >= 0.5 and least(cv / core_rows, ov / off_rows) >= 0.5 and abs(off_value - core_value) >= fl
    and abs(off_value - core_value) / greatest(mad, fl) >= 1, false) as direct from ty)"""


@register(
    "act_transfer_contrasts",
    f"with {_TRANSFER} select account_id, signal, core_rows, off_rows, core_value, off_value, effect_size, confidence_score, direct from tz",
    "core_value off_value effect_size confidence_score",
)
def act_transfer_contrasts(spark, folder):
    return actions.transfer_contrasts(matches(spark, folder), knowledge(spark)).drop("coverage")


@register("act_partial_transfer")
def act_partial_transfer(spark, folder):
    rows = matches(spark, folder)
    return actions.partial_transfer(
        actions.transfer_contrasts(rows, knowledge(spark)), actions.demand_hypotheses(rows, knowledge(spark))
    )


@register("act_versatile_core")
def act_versatile_core(spark, folder):
    table = actions.versatile_core(matches(spark, folder), knowledge(spark))
    return table.select(
        "account_id",
        "core_size",
        F.concat_ws(",", "strong").alias("strong"),
        F.concat_ws(",", "missing").alias("missing"),
        "primary_gap",
        "role_coverage",
        "qualified",
        "confidence_score",
    )


@register("act_versatile_additions")
def act_versatile_additions(spark, folder):
    rows, known = cut(matches(spark, folder)), knowledge(spark, ROSTER)
    core = cut(actions.versatile_core(rows, known))
    return actions.versatile_additions(rows, core, known)


@register("act_same_playbook")
def act_same_playbook(spark, folder):
    table = actions.same_playbook(cut(matches(spark, folder)), knowledge(spark, ROSTER))
    return table.select(
        "account_id",
        "status",
        F.concat_ws(",", F.col("deepen").cast("array<string>")).alias("deepen"),
        F.concat_ws(",", F.col("stretch").cast("array<string>")).alias("stretch"),
        "confidence_score",
    )


_FLEX = f"""{MATCH_ROWS},{KNOW_SQL},
fd as (select m.account_id, m.hero_id, (timestamp '1970-01-01' + to_seconds(started_at))::date as day from match_rows m join hero using (hero_id) where reviewed and len(functions) > 0),
fs as (select distinct account_id, day as start from fd),
fc as (select s.account_id, s.start, d.hero_id, count(*) as c from fs s join fd d on d.account_id = s.account_id and d.day between s.start and s.start + 6 group by 1, 2, 3),
fj as (select account_id, start, count(distinct job) as jobs from fc join hj using (hero_id) group by 1, 2),
ft as (select *, sum(c) over (partition by account_id, start) as t from fc),
fw as (select account_id, start, any_value(t)::bigint as games, count(*) as heroes, any_value(jobs) as jobs, count(*) filter (c >= 2) as repeated, case when count(*) > 1 then -sum(c / t * ln(c / t)) / ln(count(*)) else 0 end as evenness
  from ft join fj using (account_id, start) group by 1, 2),
fx as (select *, least(1, games / 10) as activity, least(1, heroes / greatest(3, games * 0.45)) * greatest(0.5, least(1, jobs / 8)) * least(1, games / 10) * least(1, evenness) as score from fw)"""


@register(
    "act_flex_windows",
    f"with {_FLEX} select account_id, start::varchar as window_start, games, heroes, jobs, repeated, activity, evenness, score from fx",
    "activity evenness score",
)
def act_flex_windows(spark, folder):
    return actions.flex_windows(matches(spark, folder), knowledge(spark)).withColumn(
        "window_start", F.col("window_start").cast("string")
    )


@register(
    "act_proven_flexibility",
    f"""with {_FLEX}, r as (select *, row_number() over (partition by account_id order by round(score, 9) desc, jobs desc, repeated desc, activity desc, start desc) as k from fx where games >= 10)
    select a.account_id, case when r.games is null then 'distributed_flexibility' else 'peak_window' end as status, start::varchar as window_start, games, heroes, jobs, score
    from (select distinct account_id from fx) a left join (select * from r where k = 1) r using (account_id)""",
    "score",
)
def act_proven_flexibility(spark, folder):
    windows = actions.flex_windows(matches(spark, folder), knowledge(spark))
    return actions.proven_flexibility(windows).drop("confidence_score")


_RECOVERY = f"""{measured(DAY_GAP)},{HERO_SQL},
pf as (select p.*, h.function from perf p left join hero_function h using (hero_id)),
u as (select p.*, s.start_time from pf p join sess s using (account_id, session_no) where not s.corrupt and p.performance is not null and not p.session_corrupt),
ul as (select *, lag(won) over (partition by account_id, session_no order by session_index) as pw from u),
al as (select * from ul where pw = false),{baseline_sql('u', 'al')},
rs as (select al.account_id, al.session_no, al.started_at, al.weight, al.performance - bl.baseline as residual,
  ['hero_role_function', 'hero_function', 'function', 'role', 'overall'][level_no + 1] as kind,
  case when level_no <= 1 then hero_id::varchar when level_no = 2 then function when level_no = 3 then role_hint else 'overall' end as identity from al join bl using (account_id, match_id)),
c1 as (select *, sum(weight) over (partition by account_id, kind, identity, session_no order by residual rows unbounded preceding) as cum, sum(weight) over (partition by account_id, kind, identity, session_no) as total from rs),
p1 as (select account_id, kind, identity, session_no, min(case when cum >= total / 2 - 1e-9 * total then residual end) as delta, count(*) as k,
  exp(-0.6931471805599453 * greatest(0, {WINDOW_END} - min(started_at)) / 15552000.0) as w from c1 group by 1, 2, 3, 4),
c2 as (select *, sum(w) over (partition by account_id, kind, identity order by delta rows unbounded preceding) as cum, sum(w) over (partition by account_id, kind, identity) as total from p1),
rc as (select account_id, kind, identity, min(case when cum >= total / 2 - 1e-9 * total then delta end) as performance_delta, sum(k)::bigint as sample_size, count(*) as session_count from c2 group by 1, 2, 3),
rq as (select *, least(1, sample_size / 20) * least(1, session_count / 5) * least(1, session_count / 5) as confidence_score from rc
  where session_count >= 3 and sample_size >= case when kind = 'overall' then 15 when kind in ('function', 'role') then 8 else 5 end)"""


@register(
    "act_recovery_contexts",
    f"with {_RECOVERY} select * from rq",
    "performance_delta confidence_score",
)
def act_recovery_contexts(spark, folder):
    rows = with_function(spark, measures(spark, folder, DAY_GAP))
    return actions.recovery_contexts(rows, session_rows(rows, DAY_GAP), WINDOW_END)


_SPEC = "case when kind in ('hero_role_function', 'hero_function') then 0 when kind = 'function' then 1 when kind = 'role' then 2 else 3 end"


@register(
    "act_bounceback",
    f"""with {_RECOVERY} select * from (select account_id, kind, identity, performance_delta, row_number() over (partition by account_id order by {_SPEC}, round(-performance_delta, 9),
      round(confidence_score, 9) desc, kind, identity) as rank from rq where performance_delta >= 0.04) where rank <= 3""",
    "performance_delta",
)
def act_bounceback(spark, folder):
    contexts = act_recovery_contexts(spark, folder)
    return actions.recovery_action(contexts, "positive").select(
        "account_id", "kind", "identity", "performance_delta", "rank"
    )


@register(
    "act_performance_slide",
    f"""with {_RECOVERY} select * from (select account_id, kind, identity, performance_delta, row_number() over (partition by account_id order by {_SPEC}, round(performance_delta, 9),
      round(confidence_score, 9) desc, kind, identity) as rank from rq where performance_delta <= -0.04) where rank <= 3""",
    "performance_delta",
)
def act_performance_slide(spark, folder):
    contexts = act_recovery_contexts(spark, folder)
    return actions.recovery_action(contexts, "negative").select(
        "account_id", "kind", "identity", "performance_delta", "rank"
    )


_PRESENCE = f"""{MATCH_ROWS},{KNOW_SQL},
pr as (select account_id, 'overall' as kind, 'overall' as identity, kills + assists as ka, deaths as d, duration_seconds / 60 as m from match_rows
  union all select account_id, 'hero', hero_id::varchar, kills + assists, deaths, duration_seconds / 60 from match_rows
  union all select account_id, 'role', role_hint, kills + assists, deaths, duration_seconds / 60 from match_rows
  union all select account_id, 'function', job, kills + assists, deaths, duration_seconds / 60 from match_rows join hj using (hero_id)),
pc as (select account_id, kind, identity, least(1, sum(ka) / greatest(sum(m), 1) / 1.2) as involvement, least(1, sum(d) / greatest(sum(m) / 10, 1) / 1.2) as exposure, count(*) as sample_size,
  least(1, count(*) / 20) as confidence_score from pr group by 1, 2, 3 having count(*) >= 5)"""


@register(
    "act_presence_contexts",
    f"with {_PRESENCE} select * from pc",
    "involvement exposure confidence_score",
)
def act_presence_contexts(spark, folder):
    return actions.presence_contexts(matches(spark, folder), knowledge(spark))


_PSPEC = "case kind when 'hero' then 0 when 'function' then 1 when 'role' then 2 else 3 end"


@register(
    "act_controlled_presence",
    f"""with {_PRESENCE} select * from (select account_id, kind, identity, row_number() over (partition by account_id order by {_PSPEC}, round(involvement - exposure, 9) desc,
      round(confidence_score, 9) desc, identity) as rank from pc where involvement >= 0.3 and exposure <= 0.9 and confidence_score >= 0.5) where rank <= 3""",
)
def act_controlled_presence(spark, folder):
    contexts = actions.presence_contexts(matches(spark, folder), knowledge(spark))
    return actions.controlled_presence(contexts, active=0.3, safe=0.9).select("account_id", "kind", "identity", "rank")


@register(
    "act_presence_tax",
    f"""with {_PRESENCE}, gs as (select account_id, hero_id, functions[1] as job, count(*) as n, sum(kills + assists) as ka, sum(deaths) as d, sum(duration_seconds / 60) as m
      from match_rows join hero using (hero_id) where len(functions) > 0 group by 1, 2, 3),
    gp as (select a.account_id, a.n, a.ka, a.d, a.m, coalesce(sum(b.n), 0) as pn, coalesce(sum(b.d), 0) as pd, coalesce(sum(b.m), 0) as pm from gs a left join gs b on a.account_id = b.account_id and a.job = b.job and a.hero_id <> b.hero_id
      group by a.account_id, a.hero_id, a.n, a.ka, a.d, a.m),
    gg as (select account_id, greatest(0, max(case when n >= 5 and pn >= 5 and least(n, pn) >= 10 and least(1, ka / greatest(m, 1) / 1.2) >= 0.3 and least(1, d / greatest(m / 10, 1) / 1.2) >= 0.6
      then least(1, d / greatest(m / 10, 1) / 1.2) - least(1, pd / greatest(pm / 10, 1) / 1.2) end)) as gap from gp group by 1),
    kp as (select * from pc where confidence_score >= 0.5 and involvement >= 0.3 and exposure >= 0.6),
    kr as (select *, row_number() over (partition by account_id order by round(exposure, 9) desc, {_PSPEC} desc, round(confidence_score, 9) desc, identity) as k from kp),
    ka as (select account_id, count(*) as exposed_contexts, count(*) filter (kind = 'function' and identity in ('initiation', 'frontline', 'catch', 'fight_control')) as contact,
      count(*) filter (kind = 'function' and identity not in ('initiation', 'frontline', 'catch', 'fight_control')) as other, count(distinct case when kind = 'function' then identity end) as jobs from kp group by 1),
    ks as (select account_id, exposed_contexts, case when coalesce(gap, 0) >= 0.18 then 'hero_specific' when contact > 0 and other = 0 then 'job_shaped' when jobs >= 2 then 'cross_context'
      when contact > 0 then 'job_shaped' else 'unresolved' end as shape from ka left join gg using (account_id))
    select account_id, shape, kind, identity, exposure, exposed_contexts, shape <> 'unresolved' as deep_candidate, confidence_score from ks join kr using (account_id) where k = 1""",
    "exposure confidence_score",
)
def act_presence_tax(spark, folder):
    rows = matches(spark, folder)
    contexts = actions.presence_contexts(rows, knowledge(spark))
    gaps = actions.exposure_gap(rows, knowledge(spark), active=0.3)
    return actions.presence_tax(contexts, gaps, active=0.3)


@register(
    "act_exposure_gap",
    f"""with {MATCH_ROWS},{KNOW_SQL}, s as (select account_id, hero_id, functions[1] as job, count(*) as n, sum(kills + assists) as ka, sum(deaths) as d, sum(duration_seconds / 60) as m
      from match_rows join hero using (hero_id) where len(functions) > 0 group by 1, 2, 3),
    p as (select a.account_id, a.n, a.ka, a.d, a.m, coalesce(sum(b.n), 0) as pn, coalesce(sum(b.d), 0) as pd, coalesce(sum(b.m), 0) as pm from s a left join s b on a.account_id = b.account_id and a.job = b.job and a.hero_id <> b.hero_id
      group by a.account_id, a.hero_id, a.n, a.ka, a.d, a.m)
    select account_id, greatest(0, max(case when n >= 5 and pn >= 5 and least(n, pn) >= 6 and least(1, ka / greatest(m, 1) / 1.2) >= 0.3 and least(1, d / greatest(m / 10, 1) / 1.2) >= 0.5
      then least(1, d / greatest(m / 10, 1) / 1.2) - least(1, pd / greatest(pm / 10, 1) / 1.2) end)) as gap from p group by 1""",
    "gap",
)
def act_exposure_gap(spark, folder):
    return actions.exposure_gap(matches(spark, folder), knowledge(spark), active=0.3, exposed=0.5, confidence=0.3)


@register(
    "act_finishing_flavour",
    f"""with {MATCH_ROWS} select account_id, case when sum(kills + assists) < 30 then null when sum(kills) / sum(kills + assists) >= 0.45 then 'controlled_finishing_presence'
      else 'controlled_setup_presence' end as flavour from match_rows group by 1""",
)
def act_finishing_flavour(spark, folder):
    return actions.finishing_flavour(matches(spark, folder))


@register(
    "act_session_curve",
    f"""with {measured()},{HERO_SQL},{_CURVE_SQL},{_BUCKET_SQL.format(middle='avg')},
    i as (select account_id, count(distinct session_no) as independent_sessions from bs group by 1),
    sc as (select account_id, bucket, -value as sv, sessions from bc where sessions >= 3), k as (select account_id, count(*) as supported_buckets from sc group by 1),
    e as (select *, min(sv) over (partition by account_id order by bucket rows between current row and unbounded following) as low from sc where sessions >= 8),
    b as (select account_id, count(*) as k, min(bucket) filter (low >= 0.08) as bucket, min(sv) >= 0 and max(sv) >= 0.08 as gradual from e group by 1)
    select i.account_id, independent_sessions, coalesce(supported_buckets, 0) as supported_buckets, case when coalesce(b.k, 0) >= 2 then bucket end as breakpoint_bucket,
      case when coalesce(b.k, 0) < 2 then 'unresolved' when bucket is not null then 'stable_breakpoint' when gradual then 'gradual' else 'unresolved' end as breakpoint_state
    from i left join k using (account_id) left join b using (account_id)""",
)
def act_session_curve(spark, folder):
    rows = with_function(spark, measures(spark, folder))
    return actions.session_curve_action(rows, session_rows(rows), WINDOW_END, "fade").select(
        "account_id", "independent_sessions", "supported_buckets", "breakpoint_bucket", "breakpoint_state"
    )


@register(
    "act_companion_signals",
    f"""with {measured(DAY_GAP)}, m as (select account_id, median(activity) filter (session_index <= 2) as ea, median(activity) filter (session_index > 2) as la,
      median(death_rate) filter (session_index <= 2) as ed, median(death_rate) filter (session_index > 2) as ld from perf where performance is not null group by 1)
    select account_id, case when la > ea * 1.1 then 'up' when la < ea * 0.9 then 'down' end as involvement_moves, case when ld > ed * 1.1 then 'up' when ld < ed * 0.9 then 'down' end as deaths_move from m""",
)
def act_companion_signals(spark, folder):
    return actions.companion_signals(measures(spark, folder, DAY_GAP))


@register("act_attach")
def act_attach(spark, folder):
    rows = cut(matches(spark, folder))
    known = knowledge(spark)
    core = actions.versatile_core(rows, known)
    found = patterns.evaluate(element_table(spark, folder))
    attached = actions.attach(
        found,
        {
            "comfort_edge": actions.comfort_edge(actions.hero_reliability(rows, known), known),
            "proven_flexibility": actions.proven_flexibility(actions.flex_windows(rows, known)),
        },
        core,
    )
    return attached.select(
        "account_id", "pattern", "status", "action_status", "suppression_reason", "strength", "confidence"
    )


@register("pat_outcomes")
def pat_outcomes(spark, folder):
    """Outcome branches and recommendation states over pattern rows with derived action facts."""
    found = patterns.evaluate(element_table(spark, folder))
    s = F.col("account_id")
    facts = {
        "status": F.element_at(
            F.array(
                *[
                    F.lit(x)
                    for x in (
                        "available",
                        "limited",
                        "direct_signal",
                        "capability_hypothesis",
                        "deep_candidate",
                        "peak_window",
                    )
                ]
            ),
            (s % 6 + 1).cast("int"),
        ),
        "ranked_heroes": s % 6,
        "stretch_eligible": s % 2 == 0,
        "has_addition": s % 3 == 0,
        "has_gap": s % 5 < 3,
        "context_hero": F.when(s % 3 == 0, s),
        "context_function": F.when(s % 3 == 1, F.lit("push")),
        "shape": F.element_at(
            F.array(*[F.lit(x) for x in ("job_shaped", "hero_specific", "cross_context", "unresolved")]),
            (s % 4 + 1).cast("int"),
        ),
        "breakpoint_state": F.element_at(
            F.array(*[F.lit(x) for x in ("stable_breakpoint", "gradual", "unresolved")]), (s % 3 + 1).cast("int")
        ),
        "rationale_intent": F.element_at(
            F.array(F.lit("double_down"), F.lit("adjacent_move"), F.lit(None)), (s % 3 + 1).cast("int")
        ),
        "development": s % 2,
    }
    return found.select(
        "account_id",
        "pattern",
        patterns.outcome(F.col("pattern"), facts).alias("outcome"),
        patterns.recommendation_state(F.col("pattern"), facts).alias("recommendation"),
    )


