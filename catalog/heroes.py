"""Hero dimension, portfolio and recommendation queries."""

from pyspark.sql import functions as F

from catalog.base import DAY_GAP, MATCH_ROWS, matches, measured, measures, register
from catalog.elements import _JS, HERO_SQL, PART_SQL, familiar_sql
from habitscope.constants import FAMILIES, JOBS, ROLE_FAMILIES
from habitscope.operators import portfolio, windows
from habitscope.session import cut
from habitscope.sources import heroes, views

_FAMILY_CASE = " ".join(f"when '{j}' then '{f}'" for f, js in FAMILIES.items() for j in js)
KNOW_SQL = f"""{HERO_SQL},
hj0 as (select hero_id, case trait when 'pickoff' then 'catch' when 'teamfight' then 'fight_control' else trait end as job, trait, value from hero_trait
  where value >= 0.6 and trait not in ('complexity', 'farm_dependency', 'micro_intensity')),
hj as (select *, case job {_FAMILY_CASE} end as family from (select *, row_number() over (partition by hero_id order by trait) as k from hj0) where k <= 7),
hero as (select h.hero_id::bigint as hero_id, hero_id % 10 <> 0 as reviewed, ['carry', 'mid', 'offlane', 'soft_support', 'hard_support'][hero_id % 5 + 1] as role,
  coalesce((select list(job order by trait) from hj where hj.hero_id = h.hero_id), []) as functions,
  coalesce((select list(distinct family order by family) from hj where hj.hero_id = h.hero_id), []) as families from range(1, 21) h(hero_id))"""


def traits(spark):
    return views.hero_traits(spark)


def knowledge(spark, roster=20):
    # One row per hero, read by many joins: written once.
    return cut(views.hero_knowledge(views.hero_traits(spark, roster)))


PART_KNOW_SQL = KNOW_SQL.replace(HERO_SQL, PART_SQL).replace(
    "from range(1, 21) h(hero_id)", "from (select p_partkey as hero_id from part) h"
)


@register(
    "src_hero_knowledge",
    f"""with {PART_KNOW_SQL} select hero_id, array_to_string(functions[1:3], ',') as primary_functions, array_to_string(functions[4:7], ',') as secondary_functions,
      case when reviewed then 'reviewed' else 'unreviewed' end as review_status from hero""",
)
def src_hero_knowledge(spark, folder):
    return views.hero_knowledge(views.part_heroes(spark, folder)).select(
        "hero_id",
        F.concat_ws(",", "primary_functions").alias("primary_functions"),
        F.concat_ws(",", "secondary_functions").alias("secondary_functions"),
        "review_status",
    )


_ELIG = f"""{MATCH_ROWS},{KNOW_SQL},
eo as (select *, row_number() over (partition by account_id order by started_at, match_id) as rn, count(*) over (partition by account_id) as n from match_rows),
eh as (select account_id, hero_id, count(*) as matches, count(*) / any_value(n) as share, (max(rn) - 1) / greatest(any_value(n) - 1, 1) as recency from eo group by 1, 2),
eg as (select eh.*, case when reviewed and len(functions) > 0 then 1.0 else 0.0 end as coverage, recency >= 0.2 or matches >= 8 as fresh from eh left join hero using (hero_id)),
el as (select *, matches >= 3 and share >= 0.03 and coverage = 1 and fresh as ct, matches >= 4 and share >= 0.03 and coverage = 1 and fresh as ex,
  matches >= 4 and share >= 0.03 and fresh as mi from eg)"""


@register(
    "her_eligibility",
    f"""with {_ELIG} select account_id, hero_id, matches, share, recency, ct as for_common_thread, ex as for_exception, mi as for_mirror,
      array_to_string(list_filter([case when matches < 3 then 'too_few_matches' end, case when share < 0.03 then 'too_small_history_share' end,
        case when coverage < 1 then 'hero_semantics_unavailable' end, case when not fresh then 'stale_without_sustained_coverage' end,
        case when matches = 3 then 'exception_sample_gate' end, case when not mi and matches < 4 then 'mirror_metrics_missing_or_incomplete' end], lambda r: r is not null), ',') as reasons from el""",
    "share recency",
)
def her_eligibility(spark, folder):
    return portfolio.eligibility(matches(spark, folder), knowledge(spark)).select(
        "account_id",
        "hero_id",
        "matches",
        "share",
        "recency",
        "for_common_thread",
        "for_exception",
        "for_mirror",
        F.concat_ws(",", "reasons").alias("reasons"),
    )


_JOB_VALUES = ", ".join(f"('{j}')" for j in JOBS)
_VECTOR = f"""jb as (select * from (values {_JOB_VALUES}) j(feature)),
jv as (select hero_id, feature, list_contains(functions, feature)::int::double as value from hero, jb)"""


@register(
    "her_common_thread",
    f"""with {_ELIG},{_VECTOR}, c as (select *, sum(matches) over (partition by account_id) as u, count(*) over (partition by account_id) as k from el where ct),
    w as (select *, least(matches, greatest(3, u * 0.35)) as w from c where k >= 3),
    s as (select account_id, feature, sum(w * value) / greatest(sum(w), 1) as score, sum(value)::bigint as spread, any_value(k) as k from w join jv using (hero_id) group by 1, 2),
    t as (select *, 0.7 * score + 0.3 * spread / k as total, row_number() over (partition by account_id order by round(0.7 * score + 0.3 * spread / k, 12) desc, feature) as p from s),
    x as (select account_id, max(feature) filter (p = 1) as f, max(score) filter (p = 1) as score, max(spread) filter (p = 1) as spread, any_value(k) as k,
      max(total) filter (p = 1) - max(total) filter (p = 2) as margin from t group by 1)
    select account_id, case when score >= 0.35 and margin >= 0.03 then 'available' else 'unavailable' end as status, case when score >= 0.35 and margin >= 0.03 then f end as trait,
      score as weighted_coverage, margin, k as denominator from x""",
    "weighted_coverage margin",
)
def her_common_thread(spark, folder):
    known = knowledge(spark)
    return portfolio.common_thread(portfolio.eligibility(matches(spark, folder), known), known).select(
        "account_id", "status", "trait", "weighted_coverage", "margin", "denominator"
    )


@register(
    "her_exception",
    f"""with {_ELIG},{_VECTOR}, c as (select *, count(*) over (partition by account_id) as k from el where ex),
    v as (select account_id, hero_id, k, value, (sum(value) over (partition by account_id, feature) - value) / (k - 1) as o from c join jv using (hero_id) where k >= 4),
    d as (select account_id, hero_id, sqrt(avg((value - o) * (value - o))) as distance, any_value(k) as candidates from v group by 1, 2),
    r as (select *, row_number() over (partition by account_id order by round(distance, 9) desc, hero_id) as p, lead(distance) over (partition by account_id order by round(distance, 9) desc, hero_id) as nx from d)
    select account_id, case when distance >= 0.32 and distance - nx >= 0.06 then 'available' else 'no_clear_exception' end as status,
      case when distance >= 0.32 and distance - nx >= 0.06 then hero_id end as hero_id, distance, distance - coalesce(nx, 0) as margin, candidates from r where p = 1""",
    "distance margin",
)
def her_exception(spark, folder):
    known = knowledge(spark)
    return portfolio.exception(portfolio.eligibility(matches(spark, folder), known), known).select(
        "account_id", "status", "hero_id", "distance", "margin", "candidates"
    )


_EVO = f"""{MATCH_ROWS},{KNOW_SQL},
vo as (select *, row_number() over (partition by account_id order by started_at, match_id) as rn, count(*) over (partition by account_id) as n from match_rows),
vw as (select *, case when n - rn < least(24, n // 2) then 'recent' else 'previous' end as win from vo where n >= 24 and n - rn < 2 * least(24, n // 2)),
vh as (select account_id, hero_id, count(*) filter (win = 'previous') as a, count(*) filter (win = 'recent') as b from vw group by 1, 2),
vj as (select account_id, job, count(*) filter (win = 'previous') as a, count(*) filter (win = 'recent') as b from (select account_id, win, unnest(functions) as job from vw join hero using (hero_id) where reviewed) group by 1, 2)"""


@register(
    "her_pool_evolution",
    f"""with {_EVO}, hs as ({_JS.format(a='a', b='b', source='vh')}), ts as ({_JS.format(a='a', b='b', source='vj')}),
    tl as (select *, row_number() over (partition by account_id order by a desc, job) as ka, row_number() over (partition by account_id order by b desc, job) as kb,
      a / sum(a) over (partition by account_id) as sa, b / sum(b) over (partition by account_id) as sb from vj),
    ov as (select account_id, count(*) filter (ka <= 3 and kb <= 3 and sa >= 0.06 and sb >= 0.06) / 3.0 as overlap from tl group by 1),
    cv as (select account_id, min(c) as coverage from (select account_id, win, avg((reviewed and len(functions) > 0)::int) as c from vw join hero using (hero_id) group by 1, 2) group by 1)
    select hs.account_id, coverage, hs.shift as hero_shift, ts.shift as toolkit_shift, overlap, case when coverage >= 0.8 then 'available' else 'unavailable' end as status,
      case when coverage >= 0.8 then case when hs.shift >= 0.22 and ts.shift >= 0.18 then 'new_heroes_new_toolkit' when hs.shift >= 0.22 then 'new_heroes_same_toolkit'
        when ts.shift >= 0.18 and overlap >= 0.35 then 'stable_core_new_branch' else 'broadly_stable' end end as variant
    from hs join ts using (account_id) join ov using (account_id) join cv using (account_id)""",
    "coverage hero_shift toolkit_shift overlap",
)
def her_pool_evolution(spark, folder):
    return portfolio.evolution(matches(spark, folder), knowledge(spark)).select(
        "account_id", "coverage", "hero_shift", "toolkit_shift", "overlap", "status", "variant"
    )


@register(
    "join_window_coverage",
    f"""with {_EVO} select account_id, win as "window", avg((reviewed and len(functions) > 0)::int) as coverage from vw join hero using (hero_id) group by 1, 2""",
    "coverage",
)
def join_window_coverage(spark, folder):
    windowed = windows.balanced_windows(matches(spark, folder)).where(F.col("n") >= 24)
    return portfolio.window_coverage(windowed, knowledge(spark))


_ROLE_SUMS = ", ".join(f"count(*) filter (role_hint = '{r}') as r{i}" for i, r in enumerate(portfolio.ROLE_KEYS))
_ROLE_TV = " + ".join(
    f"abs((h.r{i} / h.n - (a.r{i} - h.r{i}) / (a.n - h.n)) * least(1, h.n / 20))" for i in range(len(portfolio.ROLE_KEYS))
)
_MIRROR = f"""{_ELIG},
mh as (select account_id, hero_id, count(*) as n, sum(kills) as k, sum(assists) as s, sum(deaths) as d, sum(duration_seconds / 60) as m, {_ROLE_SUMS} from match_rows group by 1, 2),
ma as (select account_id, count(*) as n, sum(kills) as k, sum(assists) as s, sum(deaths) as d, sum(duration_seconds / 60) as m, {_ROLE_SUMS} from match_rows group by 1),
ms as (select h.account_id, h.hero_id, least(1, h.n / 20) as w, exp(-(
    least(2, abs(((h.k + h.s) / h.m - (a.k + a.s - h.k - h.s) / (a.m - h.m)) * least(1, h.n / 20)) / 0.35)
    + least(2, abs((h.k / greatest(h.k + h.s, 1) - (a.k - h.k) / greatest(a.k + a.s - h.k - h.s, 1)) * least(1, h.n / 20)) / 0.20)
    + least(2, abs((h.d / (h.m / 10) - (a.d - h.d) / ((a.m - h.m) / 10)) * least(1, h.n / 20)) / 0.75)
    + 0.5 * ({_ROLE_TV})) / 4) as similarity
  from mh h join ma a using (account_id) join el on el.account_id = h.account_id and el.hero_id = h.hero_id where el.mi and a.n - h.n >= 12),
mf as (select *, similarity * (0.65 + 0.35 * w) as final_score from ms)"""


@register(
    "her_mirror_scores",
    f"with {_MIRROR} select account_id, hero_id, similarity, w as sample_confidence, final_score from mf",
    "similarity sample_confidence final_score",
)
def her_mirror_scores(spark, folder):
    rows = matches(spark, folder)
    return portfolio.mirror_scores(rows, portfolio.eligibility(rows, knowledge(spark))).select(
        "account_id", "hero_id", "similarity", "sample_confidence", "final_score"
    )


@register(
    "her_mirror",
    f"""with {_MIRROR}, r as (select *, row_number() over o as p, lead(final_score) over o as nx from mf window o as (partition by account_id order by round(final_score, 9) desc, round(similarity, 9) desc, hero_id desc))
    select account_id, final_score, final_score - coalesce(nx, 0) as margin, w as confidence_score,
      case when w >= 0.35 and final_score >= 0.55 and final_score - coalesce(nx, 0) >= 0.04 then 'available' else 'no_clear_mirror' end as status from r where p = 1""",
    "final_score margin confidence_score",
)
def her_mirror(spark, folder):
    rows = matches(spark, folder)
    scores = portfolio.mirror_scores(rows, portfolio.eligibility(rows, knowledge(spark)))
    return portfolio.mirror(scores).select("account_id", "final_score", "margin", "confidence_score", "status")


@register(
    "agg_mirror_units",
    f"""with {MATCH_ROWS} select account_id, hero_id, sum(kills + assists) / sum(duration_seconds / 60) as involvement, sum(kills) / greatest(sum(kills + assists), 1) as finishing,
      sum(deaths) / (sum(duration_seconds / 60) / 10) as deaths, count(*) filter (role_hint = 'roamer') / count(*) as roamer_share from match_rows group by 1, 2""",
    "involvement finishing deaths roamer_share",
)
def agg_mirror_units(spark, folder):
    units = portfolio.behaviour_units(matches(spark, folder), ["account_id", "hero_id"])
    vector = portfolio._vector(lambda c: F.col(c))
    return units.select(
        "account_id",
        "hero_id",
        vector["involvement"].alias("involvement"),
        vector["finishing"].alias("finishing"),
        vector["deaths"].alias("deaths"),
        vector["role:roamer"].alias("roamer_share"),
    )


@register(
    "her_stable_shuffle",
    f"""with {MATCH_ROWS}, p as (select account_id, hero_id from match_rows group by 1, 2)
    select account_id, string_agg(hero_id::varchar, ',' order by sha256('seed-' || account_id || '|' || hero_id), hero_id) as options from p group by 1""",
)
def her_stable_shuffle(spark, folder):
    pool = matches(spark, folder).groupBy("account_id").agg(F.collect_set("hero_id").alias("h"))
    seed = F.concat(F.lit("seed-"), F.col("account_id").cast("string"))
    return pool.select("account_id", F.concat_ws(",", portfolio.stable_shuffle(F.col("h"), seed)).alias("options"))


_IDENT = f"""{measured(DAY_GAP)},{HERO_SQL},
ic as (select account_id, hero_id, count(*) as matches, max(started_at) as last, avg(coalesce(performance, 0.5)) as output, any_value(n) as total,
  count(distinct least(3, floor((rn - 1) * 4 / n))) as q, least(1, count(distinct started_at // 2592000) / 4) as persistence from perf group by 1, 2),
fpool as ({familiar_sql('ic', 5, True, count='matches', goal='total')}),
rl as (select account_id, arg_max(role_hint, (c, -s, -m)) as dominant from (select account_id, role_hint, count(*) as c, min(started_at) as s, arg_min(match_id, (started_at, match_id)) as m from perf group by 1, 2) group by 1),
hsim as (select a.hero_id as a, b.hero_id as b, greatest(0, 1 - sqrt(avg((a.value - b.value) ** 2))) as sim from hero_trait a join hero_trait b using (trait) group by 1, 2),
sf as (select ic.account_id, ic.hero_id, avg(hsim.sim) as fit from ic join fpool on ic.account_id = fpool.account_id and ic.hero_id <> fpool.hero_id join hsim on hsim.a = ic.hero_id and hsim.b = fpool.hero_id group by 1, 2),
il as (select *, max(last) over (partition by account_id) as latest from ic),
ik as (select il.account_id, il.hero_id, matches, total, (matches + 1.5) / (total + 3) as frequency, exp(-greatest(0, (latest - last) / 86400) * ln(2) / 60) as recency, q / 4 as repeat, persistence,
  case when dominant = ['carry', 'mid', 'offlane', 'soft_support', 'hard_support'][il.hero_id % 5 + 1] then 1.0 else 0.45 end as role_fit, output, coalesce(fit, 0.5) as semantic_fit
  from il join rl using (account_id) left join sf on sf.account_id = il.account_id and sf.hero_id = il.hero_id where matches >= case when total >= 60 then 5 else 3 end),
ix as (select *, 0.25 * frequency + 0.15 * recency + 0.15 * repeat + 0.1 * persistence + 0.1 * role_fit + 0.1 * output + 0.15 * semantic_fit as score,
  0.35 * frequency + 0.2 * recency + 0.2 * repeat + 0.1 * role_fit + 0.15 * output as comfort_score from ik)"""


@register(
    "her_identity_components",
    f"with {_IDENT} select account_id, hero_id, matches, frequency, recency, repeat, persistence, role_fit, semantic_fit, score, comfort_score from ix",
    "frequency recency repeat persistence role_fit semantic_fit score comfort_score",
)
def her_identity_components(spark, folder):
    return portfolio.identity_components(measures(spark, folder, DAY_GAP), traits(spark)).select(
        "account_id",
        "hero_id",
        "matches",
        "frequency",
        "recency",
        "repeat",
        "persistence",
        "role_fit",
        "semantic_fit",
        "score",
        "comfort_score",
    )


_PICKS = f"""{_IDENT},
ib as (select *, max(score) over (partition by account_id) as best from ix),
isg as (select account_id, arg_max(hero_id, (repeat, persistence, matches, -hero_id)) as sig from ib where best - score <= 0.02 group by 1),
icf as (select account_id, hero_id, row_number() over (partition by account_id order by round(comfort_score, 9) desc, matches desc, hero_id) as place, total from ix where total < 20 or repeat >= 0.5),
ipk as (select ib.account_id, ib.hero_id, ib.comfort_score, ib.hero_id = sig as is_signature, case when place <= case when ib.total < 60 then 3 else 5 end then place end as comfort_place
  from ib join isg using (account_id) left join icf on icf.account_id = ib.account_id and icf.hero_id = ib.hero_id),
ip as (select * from ipk where is_signature or comfort_place is not null)"""


@register("her_identity_picks", f"with {_PICKS} select account_id, hero_id, is_signature, comfort_place from ip")
def her_identity_picks(spark, folder):
    components = portfolio.identity_components(measures(spark, folder, DAY_GAP), traits(spark))
    return portfolio.identity_picks(components).select("account_id", "hero_id", "is_signature", "comfort_place")


_TRAIT_FAMILY = " ".join(f"when '{t}' then '{f}'" for f, ts in portfolio.TRAIT_FAMILIES.items() for t in ts)


@register(
    "her_themes",
    f"""with {_PICKS}, twt as (select *, case when is_signature then 1 else greatest(0.25, comfort_score) end as w from ip),
    wt as (select *, sum(w) over (partition by account_id) as t from twt),
    idf as (select trait, ln((count(*) + 1) / (count(*) filter (value >= 0.65) + 1)) as idf from hero_trait group by 1),
    tsc as (select account_id, trait, sum(case when value >= 0.65 then w else 0 end) / any_value(t) as ag, sum(w * value) / any_value(t) as it from wt join hero_trait using (hero_id) group by 1, 2),
    tff as (select *, ag * idf * (0.5 + 0.5 * it) as score, case trait {_TRAIT_FAMILY} end as family from tsc join idf using (trait) where ag >= 0.6 - 1e-12),
    tbb as (select *, row_number() over (partition by account_id, family order by round(score, 9) desc, trait) as k from tff where family is not null)
    select account_id, family, trait, score, row_number() over (partition by account_id order by round(score, 9) desc, family, trait) as place from tbb where k = 1""",
    "score",
)
def her_themes(spark, folder):
    components = portfolio.identity_components(measures(spark, folder, DAY_GAP), traits(spark))
    return portfolio.themes(portfolio.identity_picks(components), traits(spark))


_ROLE_FAMILY = ", ".join(f"('{r}', '{f}')" for r, fs in ROLE_FAMILIES.items() for f in fs)
_TOOLKIT = f"""{MATCH_ROWS},{KNOW_SQL},
th as (select account_id, hero_id, count(*) as c from match_rows group by 1, 2),
tu as (select th.*, functions, reviewed from th join hero using (hero_id)),
tr as (select * from tu where reviewed and len(functions) > 0),
trole as (select account_id, role_hint from match_rows join hero using (hero_id) where len(functions) > 0 group by 1, 2 having count(*) >= 3),
rf as (select * from (values {_ROLE_FAMILY}) x(role_hint, family)),
trel0 as (select distinct account_id, family from trole join rf using (role_hint)),
trel as (select * from trel0 union all select a.account_id, f.family from (select distinct account_id from th) a, (select distinct family from rf) f where a.account_id not in (select account_id from trel0)),
tfam as (select account_id, family, sum(c) as c, count(distinct hero_id) as heroes from tr join (select distinct hero_id, family from hj) x using (hero_id) group by 1, 2),
tjob as (select account_id, job, sum(c) as c, count(*) as heroes from tr join hj using (hero_id) group by 1, 2),
tfe as (select r.account_id, count(f.family) as k, count(*) as rel, sum(f.c) as t from trel r left join tfam f using (account_id, family) group by 1),
tfh as (select r.account_id, case when any_value(k) > 1 then -sum(f.c / t * ln(f.c / t)) / ln(any_value(k)) else 0 end as family_entropy, any_value(k) / any_value(rel) as role_coverage
  from trel r join tfe using (account_id) left join tfam f using (account_id, family) group by 1),
tjh as (select account_id, case when count(*) > 1 then -sum(c / t * ln(c / t)) / ln(count(*)) else 0 end as job_entropy, count(*) filter (heroes = 1) as unique_jobs
  from (select *, sum(c) over (partition by account_id) as t from tjob) group by 1),
tov as (select a.account_id, avg(len(list_intersect(a.functions, b.functions)) / greatest(len(list_distinct(list_concat(a.functions, b.functions))), 1)) as overlap
  from tr a join tr b on a.account_id = b.account_id and a.hero_id < b.hero_id group by 1),
tn as (select account_id, sum(c) as total, sum(case when reviewed and len(functions) > 0 then c else 0 end) as rev from tu group by 1)"""


@register(
    "elm_toolkit_breadth",
    f"""with {_TOOLKIT} select account_id, rev::bigint as sample_size, rev / total as coverage, family_entropy, job_entropy, coalesce(overlap, 0) as overlap, unique_jobs, role_coverage,
      case when rev >= 30 and rev / total >= 0.8 then 0.25 * family_entropy + 0.2 * job_entropy + 0.25 * (1 - coalesce(overlap, 0)) + 0.15 * least(1, unique_jobs / 4) + 0.15 * role_coverage end as score
    from tn join tfh using (account_id) join tjh using (account_id) left join tov using (account_id)""",
    "coverage family_entropy job_entropy overlap role_coverage score",
)
def elm_toolkit_breadth(spark, folder):
    return portfolio.toolkit_breadth(matches(spark, folder), knowledge(spark)).select(
        "account_id",
        "sample_size",
        "coverage",
        "family_entropy",
        "job_entropy",
        "overlap",
        "unique_jobs",
        "role_coverage",
        "score",
    )


@register(
    "elm_toolkit_signatures",
    f"""with {MATCH_ROWS},{HERO_SQL}, sg as (select hero_id, string_agg(trait, '|' order by trait) as signature from (select *, row_number() over (partition by hero_id order by value desc, trait) as k from hero_trait) where k <= 3 group by 1),
    c as (select account_id, signature, count(*) as c from match_rows join sg using (hero_id) group by 1, 2), d as (select *, sum(c) over (partition by account_id) as t from c)
    select account_id, any_value(t)::bigint as sample_size, case when any_value(t) >= 30 then case when count(*) > 1 then -sum(c / t * ln(c / t)) / ln(count(*)) else 0 end end as score from d group by 1""",
    "score",
)
def elm_toolkit_signatures(spark, folder):
    return portfolio.toolkit_signatures(matches(spark, folder), traits(spark)).select(
        "account_id", "sample_size", "score"
    )


_POOL = f"""{MATCH_ROWS},{HERO_SQL},
pc as (select account_id, hero_id, count(*) as c from match_rows group by 1, 2),
pw as (select *, least(c, greatest(3, sum(c) over (partition by account_id) * 0.35)) as w, sum(c) over (partition by account_id) as total from pc),
px as (select account_id, trait, 0.5 + sum((value - 0.5) * w) / greatest(sum(w), 1) as x, count(*) as heroes, any_value(total) as total from pw join hero_trait using (hero_id) group by 1, 2),
pk as (select *, row_number() over (partition by account_id order by round(x, 9) desc, trait) as hi, row_number() over (partition by account_id order by round(x, 9), trait) as lo from px),
pr as (select account_id, role_hint from match_rows group by 1, 2 having count(*) >= 3)"""


@register(
    "her_pool_profile",
    f"""with {_POOL} select account_id, string_agg(trait, ',' order by hi) filter (hi <= 5 and round(x, 9) >= 0.55) as dominant,
      string_agg(trait, ',' order by lo) filter (lo <= 6 and round(x, 9) <= 0.45 and trait not in ('complexity', 'micro_intensity')) as underrepresented,
      least(1, 0.45 * least(1, any_value(heroes) / 5) + 0.55 * least(1, any_value(total) / 40)) as confidence_score, max(x) filter (trait = 'burst') as burst from pk group by 1""",
    "confidence_score burst",
)
def her_pool_profile(spark, folder):
    return portfolio.pool_profile(matches(spark, folder), traits(spark)).select(
        "account_id",
        F.nullif(F.concat_ws(",", "dominant"), F.lit("")).alias("dominant"),
        F.nullif(F.concat_ws(",", "underrepresented"), F.lit("")).alias("underrepresented"),
        "confidence_score",
        F.element_at("centroid", 1).alias("burst"),
    )


@register("her_semantic_profile")
def her_semantic_profile(spark, folder):
    return portfolio.semantic_profile(matches(spark, folder), knowledge(spark)).select(
        "account_id",
        "reviewed_heroes",
        "overlap",
        "unique_jobs",
        "family_coverage",
        "complementarity",
        "confidence_score",
        F.concat_ws(",", "underrepresented").alias("underrepresented"),
    )


@register(
    "her_relationships",
    f"""with {PART_SQL}, ht as (select h.hero_id, t.trait, ((h.hero_id * 37 + t.i * 53) % 101) / 100.0::double as value from range(1, 21) h(hero_id), trait_names t),
    p as (select a.hero_id as hero_a, p_size % 20 + 1 as hero_b, a.trait, a.value as x, b.value as y from hero_trait a join part on p_partkey = a.hero_id join ht b on b.trait = a.trait and b.hero_id = p_size % 20 + 1)
    select hero_a, hero_b::bigint as hero_b, greatest(0, 1 - sqrt(avg((x - y) * (x - y)))) as similarity, coalesce(string_agg(trait, ',' order by least(x, y) desc, trait) filter (x >= 0.65 and y >= 0.65), '') as shared_primary,
      coalesce(string_agg(trait, ',' order by trait) filter (x >= 0.65 and y < 0.45), '') as unique_to_a, max(abs(x - y)) filter (trait = 'complexity') as complexity_distance from p group by 1, 2""",
    "similarity complexity_distance",
)
def her_relationships(spark, folder):
    partner = views.table(spark, folder, "part").select(
        F.col("p_partkey").cast("bigint").alias("hero_id"), (F.col("p_size") % 20 + 1).cast("bigint").alias("other_id")
    )
    pairs = portfolio.relationships(views.part_heroes(spark, folder).join(partner, "hero_id"), traits(spark))
    return pairs.select(
        "hero_a",
        "hero_b",
        "similarity",
        F.concat_ws(",", "shared_primary").alias("shared_primary"),
        F.concat_ws(",", "unique_to_a").alias("unique_to_a"),
        "complexity_distance",
    )


@register(
    "her_hero_against_pool",
    f"""with {_POOL}, c as (select account_id, h.hero_id, greatest(0, 1 - sqrt(avg((value - x) * (value - x)))) as similarity,
      least(1, 0.55 * max(abs(value - x)) filter (trait = 'complexity') + 0.45 * max(abs(value - x)) filter (trait = 'micro_intensity')) as learning_distance,
      coalesce(string_agg(trait, ',' order by hi) filter (hi <= 5 and round(x, 9) >= 0.55 and value >= 0.55), '') as anchors from pk join hero_trait h using (trait) group by 1, 2)
    select account_id, hero_id::bigint as hero_id, similarity, learning_distance, anchors,
      greatest(0.25, coalesce((select count(*) filter (role_hint = ['carry', 'mid', 'offlane', 'soft_support', 'hard_support'][c.hero_id % 5 + 1]) / count(*) from pr where pr.account_id = c.account_id), 0.5)) as role_fit from c""",
    "similarity learning_distance role_fit",
)
def her_hero_against_pool(spark, folder):
    profile = portfolio.pool_profile(matches(spark, folder), traits(spark))
    return portfolio.hero_against_pool(profile, traits(spark)).select(
        "account_id",
        "hero_id",
        "similarity",
        "learning_distance",
        F.concat_ws(",", "anchors").alias("anchors"),
        "role_fit",
    )


# Heroes that an account has not played are the rest of the roster: 20 of these ids occur in the data.
ROSTER = 127


@register("her_semantic_recommendations")
def her_semantic_recommendations(spark, folder):
    rows, known = cut(matches(spark, folder)), knowledge(spark, ROSTER)
    intents = dict.fromkeys(("double_down", "adjacent_move", "fill_gap", "change_angle", "specialist"))
    picked = portfolio.recommend_each(rows, known, {**intents, "fill_gap": F.lit("engage_control")})
    return picked.select("account_id", "rank", "hero_id", "intent")


@register("her_rationales")
def her_rationales(spark, folder):
    return portfolio.rationales(matches(spark, folder), knowledge(spark, ROSTER)).select(
        "account_id",
        "hero_id",
        "eligible",
        F.concat_ws(",", "anchors").alias("anchors"),
        F.concat_ws(",", "adds").alias("adds"),
        "learning_distance",
        "role_fit",
        "confidence",
    )


@register("her_trait_recommendations")
def her_trait_recommendations(spark, folder):
    from habitscope.operators.measures import match_measures

    rows, table = cut(match_measures(matches(spark, folder), DAY_GAP)), views.hero_traits(spark, ROSTER)
    picks = portfolio.identity_picks(portfolio.identity_components(rows, table))
    return portfolio.recommend_by_traits(rows, picks, table)


@register(
    "her_situations",
    f"""with {PART_SQL}, s as (select * from (values ('initiation', 'the team lacks reliable initiation'), ('mobility', 'the enemy lineup is highly mobile'), ('save', 'the team needs save / reset options'),
      ('sustain', 'the team needs sustained frontline presence'), ('wave_clear', 'the team needs wave clear'), ('push', 'the team needs global pressure or push'), ('global_presence', 'the team needs global pressure'),
      ('burst', 'the enemy backline is difficult to reach'), ('frontline', 'the team needs stronger frontline presence'), ('repositioning', 'the team needs stronger disengage'), ('pickoff', 'the enemy draft is vulnerable to isolated pickoffs')) s(trait, txt)),
    k as (select h.hero_id, txt, row_number() over (partition by h.hero_id order by h.trait) as k from hero_trait h join s using (trait) where value >= 0.6)
    select u.hero_id, coalesce(string_agg(txt, '; ' order by k) filter (k <= 3), '') as situations from (select p_partkey as hero_id from part) u left join k using (hero_id) group by 1""",
)
def her_situations(spark, folder):
    strong = F.array_sort(F.map_keys(F.map_filter("traits", lambda _, v: v >= 0.60)))
    return (
        views.part_heroes(spark, folder)
        .select("hero_id", F.concat_ws("; ", portfolio.situations(strong)).alias("situations"))
    )
