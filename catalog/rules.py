"""Element envelope, pattern and ranking queries over an element table derived from events."""

from pyspark.sql import functions as F

from catalog.base import register
from habitscope.constants import ELEMENTS, PATTERNS
from habitscope.operators import elements, patterns
from habitscope.sources import views

# Raw scores per account and element, spread over all zones and gates by account sums.
_DEFS = ", ".join(f"({i}, '{e[0]}', '{e[1]}', {e[2]}, {e[3]}, {list(e[4])!r})" for i, e in enumerate(ELEMENTS))
ELEMENT_SQL = f"""
def as (select * from (values {_DEFS}) d(i, key, dimension, minimum, floor, zones)),
acc as (select user_id::bigint as account_id, sum(event_id)::bigint as s, count(*) as n from events group by 1),
rawe as (select account_id, key, dimension, minimum, floor, zones,
  case when (s + i) % 11 <> 0 then ((s * 37 + i * 53) % 101) / 100.0::double end as score,
  (s * 7 + i * 5) % 90 + 20 as sample_size, ((s * 3 + i * 11) % 120 + 10)::double as effective_sample_size,
  ((s * 13 + i * 7) % 61 + 40) / 100.0::double as coverage, ((s * 17 + i * 3) % 61 + 40) / 100.0::double as stability,
  ((s * 19 + i * 23) % 61 + 40) / 100.0::double as quality from acc, def),
el0 as (select *, score is not null and sample_size >= minimum and coverage >= floor as ok,
  0.25 * least(1, sqrt(sample_size / minimum)) + 0.2 * least(1, sqrt(effective_sample_size / minimum)) + 0.2 * coverage + 0.2 * stability + 0.15 * quality as conf from rawe),
el as (select account_id, key, dimension, floor, zones, case when ok then score end as score, case when ok then conf else 0 end as confidence_score, sample_size, coverage, stability, quality,
  case when not ok then 'unavailable' when conf >= 0.5 then 'available' else 'limited' end as status,
  case when not ok then 'unavailable' when conf >= 0.75 then 'high' when conf >= 0.5 then 'moderate' else 'low' end as confidence,
  case when ok then zones[case when score < 0.2 then 1 when score < 0.4 then 2 when score < 0.6 then 3 when score < 0.8 then 4 else 5 end] end as zone from el0)"""


def raw_elements(spark, folder):
    accounts = (
        views.table(spark, folder, "events")
        .groupBy(F.col("user_id").cast("bigint").alias("account_id"))
        .agg(F.sum(F.col("event_id").cast("bigint")).alias("s"))
    )
    s, i = F.col("s"), F.col("i")

    def share(a: int, b: int):
        return ((s * a + i * b) % 61 + 40) / F.lit(100.0)

    return (
        accounts.select("account_id", "s", F.posexplode(F.array(*[F.lit(e[0]) for e in ELEMENTS])).alias("i", "key"))
        .withColumn("i", F.col("i").cast("bigint"))
        .select(
            "account_id",
            "key",
            F.when((s + i) % 11 != 0, ((s * 37 + i * 53) % 101) / F.lit(100.0)).alias("score"),
            ((s * 7 + i * 5) % 90 + 20).alias("sample_size"),
            ((s * 3 + i * 11) % 120 + 10).cast("double").alias("effective_sample_size"),
            share(13, 7).alias("coverage"),
            share(17, 3).alias("stability"),
            share(19, 23).alias("quality"),
            F.lit(None).cast("double").alias("confidence_override"),
        )
    )


def element_table(spark, folder):
    return elements.envelope(raw_elements(spark, folder))


@register(
    "elm_envelope",
    f"with {ELEMENT_SQL} select account_id, key, dimension, status, score, confidence, confidence_score, sample_size, coverage, zone from el",
    "score confidence_score coverage",
)
def elm_envelope(spark, folder):
    return element_table(spark, folder).select(
        "account_id",
        "key",
        "dimension",
        "status",
        "score",
        "confidence",
        "confidence_score",
        "sample_size",
        "coverage",
        "zone",
    )


_RULES = ", ".join(
    f"('{p[0]}', {c}, {j}, '{element}', {list(zones)!r}, '{p[4]}', '{p[5]}')"
    for p in PATTERNS
    for c, clause in enumerate(p[6])
    for j, (element, zones) in enumerate(clause)
)
_PATTERN_SQL = f"""{ELEMENT_SQL},
rule as (select * from (values {_RULES}) r(pattern, clause, place, key, accepted, family, tier)),
cj as (select e.*, r.pattern, r.clause, r.place, r.accepted, r.family, r.tier,
    e.score is null as missing, e.score is not null and e.coverage < e.floor as lowcov,
    e.score is not null and e.coverage >= e.floor and e.confidence_score < 0.45 as weak,
    coalesce(list_contains(r.accepted, e.zone), false) as zok,
    case when zone is null then 0 else (select max(1 - abs(list_position(e.zones, z) - list_position(e.zones, e.zone)) / 4) from unnest(r.accepted) t(z)) end as comp
  from el e join rule r using (key)),
cl as (select account_id, pattern, clause, any_value(family) as family, any_value(tier) as tier, bool_or(missing) as miss, bool_or(lowcov) as cov, bool_or(weak) as weak,
    bool_and(zok) as zok, avg(comp) as rel, sum(comp) as cs, coalesce(min(confidence_score) filter (score is not null), 0) as minc,
    coalesce(avg(confidence_score) filter (score is not null), 0) as meanc, coalesce(min(coverage) filter (score is not null), 0) as mincov, avg(quality) as q,
    not bool_or(missing) and not bool_or(lowcov) and not bool_or(weak) as gated from cj group by 1, 2, 3),
pk as (select account_id, pattern, any_value(family) as family, any_value(tier) as tier, bool_or(gated and zok) as qual, bool_or(gated) as anyg,
    bool_or(zok and cov) as zcov, bool_or(zok and weak) as zweak, bool_or(not miss and cov) as ncov, bool_or(not miss and not cov and weak) as nweak from cl group by 1, 2),
bs as (select * from (select c.*, row_number() over (partition by account_id, pattern order by (gated and zok) desc, minc desc, meanc desc, mincov desc, cs desc, clause) as k
    from cl c where gated) where k = 1),
pe0 as (select p.*, b.clause, b.rel, b.minc, b.meanc, b.mincov, b.q,
    case when qual then null when zcov then 'cov' when zweak then 'weak' when anyg then null when ncov then 'cov' when nweak then 'weak' else 'missing' end as gate
  from pk p left join bs b using (account_id, pattern)),
pe as (select account_id, pattern, family, tier, case when gate is null and qual then 'qualified' when gate = 'missing' then 'unavailable' else 'suppressed' end as status,
    case when gate is null and qual then rel * (0.6 * minc + 0.25 * meanc + 0.15) * mincov * q else 0 end as strength,
    case when gate is null then 0.6 * minc + 0.25 * meanc + 0.15 * case when qual then 1 else 0.8 end else 0 end as confidence_score,
    case when gate is null then clause end as clause, case when gate is null then rel else 0 end as relationship_strength,
    case when gate is null then mincov else 0 end as evidence_coverage from pe0)"""


@register(
    "pat_clauses",
    f"""with {_PATTERN_SQL} select account_id, pattern, clause, zok as zone_qualified, gated, rel as relationship, minc as min_confidence,
      meanc as mean_confidence, mincov as min_coverage from cl""",
    "relationship min_confidence mean_confidence min_coverage",
)
def pat_clauses(spark, folder):
    return patterns.clauses(element_table(spark, folder)).select(
        "account_id",
        "pattern",
        "clause",
        "zone_qualified",
        "gated",
        "relationship",
        "min_confidence",
        "mean_confidence",
        "min_coverage",
    )


@register(
    "pat_evaluate",
    f"with {_PATTERN_SQL} select account_id, pattern, family, tier, status, strength, confidence_score, clause::bigint as clause, relationship_strength, evidence_coverage from pe",
    "strength confidence_score relationship_strength evidence_coverage",
)
def pat_evaluate(spark, folder):
    return patterns.evaluate(element_table(spark, folder)).select(
        "account_id",
        "pattern",
        "family",
        "tier",
        "status",
        "strength",
        "confidence_score",
        "clause",
        "relationship_strength",
        "evidence_coverage",
    )


@register(
    "pat_direction",
    f"""with {_PATTERN_SQL} select account_id, pattern, case pattern when 'same_playbook' then 'hero_names_change_toolkit_holds'
      when 'comfort_edge' then 'wide_pool_results_slip_off_pool' when 'partial_transfer' then 'presence_holds_results_slip'
      when 'versatile_core' then 'focused_pool_varied_toolkit' when 'proven_flexibility' then 'wide_pool_results_travel'
      when 'bounceback' then 'positive_recovery_with_' || case when clause = 0 then 'familiarity' else 'tempo' end
      when 'performance_slide' then 'negative_recovery_with_' || case when clause = 0 then 'familiarity' else 'tempo' end
      when 'controlled_presence' then 'active_with_controlled_exposure' when 'presence_tax' then 'active_with_presence_tax'
      when 'session_fade' then 'late_session_decline' else 'late_session_improvement' end as direction from pe where status = 'qualified'""",
)
def pat_direction(spark, folder):
    return (
        patterns.evaluate(element_table(spark, folder))
        .where(F.col("status") == "qualified")
        .select("account_id", "pattern", "direction")
    )


def _greedy(step: int, limit: int, body: str) -> str:
    return body.format(step=step, previous=step - 1, limit=limit)


_ELEMENT_STEP = """,
w{step} as (select account_id, key, dimension from (select u.*, row_number() over (partition by account_id order by
    0.55 * ext + 0.3 * ev + 0.15 * case when exists (select 1 from pick{previous} p where p.account_id = u.account_id and p.dimension = u.dimension) then 0.72 else 1 end desc,
    ext desc, ev desc, key desc) as k from usable u where not exists (select 1 from pick{previous} p where p.account_id = u.account_id and p.key = u.key)) where k = 1),
pick{step} as (select * from pick{previous} union all select account_id, {step} as rank, key, dimension from w{step})"""


@register(
    "pat_element_highlights",
    f"""with {ELEMENT_SQL}, usable as (select account_id, key, dimension, abs(score - 0.5) * 2 as ext, confidence_score * coverage * quality as ev from el where score is not null),
    pick0 as (select 0::bigint as account_id, 0 as rank, '' as key, '' as dimension where false)"""
    + "".join(_greedy(s, 3, _ELEMENT_STEP) for s in (1, 2, 3))
    + " select account_id, rank::bigint as rank, key from pick3",
)
def pat_element_highlights(spark, folder):
    return patterns.element_highlights(element_table(spark, folder))


_PATTERN_STEP = """,
b{step} as (select u.*, strength - case when exists (select 1 from pick{previous} p where p.account_id = u.account_id and p.family = u.family) then 0.04 else 0 end as base
  from usable u where not exists (select 1 from pick{previous} p where p.account_id = u.account_id and p.pattern = u.pattern)),
c{step} as (select * from (select *, max(base) over (partition by account_id) as top from b{step}) where top - base <= 0.02),
d{step} as (select *, count(*) over (partition by account_id) as close from c{step}),
w{step} as (select * from (select *, row_number() over (partition by account_id order by tier = 'A' desc,
    base + case when close > 1 and tier = 'A' then 0.005 else 0 end desc, relationship_strength desc, pattern desc) as k from d{step}) where k = 1),
pick{step} as (select * from pick{previous} union all select account_id, {step} as rank, pattern, family from w{step})"""


@register(
    "pat_pattern_highlights",
    f"""with {_PATTERN_SQL}, usable as (select * from pe where status = 'qualified' and confidence_score >= 0.45 and evidence_coverage >= 0.35),
    pick0 as (select 0::bigint as account_id, 0 as rank, '' as pattern, '' as family where false)"""
    + "".join(_greedy(s, 5, _PATTERN_STEP) for s in (1, 2, 3, 4, 5))
    + " select account_id, rank::bigint as rank, pattern from pick5",
)
def pat_pattern_highlights(spark, folder):
    return patterns.pattern_highlights(patterns.evaluate(element_table(spark, folder)))


@register(
    "dim_summary",
    f"""with {ELEMENT_SQL} select account_id, dimension, count(*) filter (status = 'available') as available_elements, count(*) filter (status = 'limited') as limited_elements,
      count(*) as total_elements, case when count(*) filter (status <> 'unavailable') = 0 then 'unavailable'
        when count(*) filter (status = 'available') = count(*) and min(confidence_score) >= 0.75 then 'high'
        when count(*) filter (status = 'available') > 0 then 'moderate' else 'low' end as confidence from el group by 1, 2""",
)
def dim_summary(spark, folder):
    return patterns.dimension_summary(element_table(spark, folder))


@register(
    "dim_report_quality",
    f"""with {_PATTERN_SQL}, q as (select account_id, count(*) filter (status = 'qualified') as qualified_patterns from pe group by 1),
    e as (select account_id, count(*) filter (status = 'available') as available, count(*) filter (status = 'limited') as limited,
      count(*) filter (status = 'unavailable') as unavailable, avg(confidence_score) filter (score is not null) as m from el group by 1)
    select account_id, case when m is null then 'unavailable' when m >= 0.75 then 'high' when m >= 0.5 then 'moderate' else 'low' end as overall,
      available, limited, unavailable, qualified_patterns from e join q using (account_id)""",
)
def dim_report_quality(spark, folder):
    table = element_table(spark, folder)
    return patterns.report_quality(table, patterns.evaluate(table))


@register(
    "pat_display_bands",
    f"""with {ELEMENT_SQL} select account_id, key, case when score is null then 'unavailable' when (score - 0.5) <= -0.3 then 'very_weak' when (score - 0.5) < -0.1 then 'weak'
        when (score - 0.5) <= 0.1 then 'normal' when (score - 0.5) < 0.3 then 'strong' else 'very_strong' end as relative_band,
      case when score is null then 'unavailable' when score >= 0.6 then 'high' when score < 0.4 then 'low' else 'normal' end as level_band,
      case when score is null then 'unavailable' when (score - 0.5) / 2 <= -0.2 then 'lowest_point' when (score - 0.5) / 2 < -0.05 then 'below_usual'
        when (score - 0.5) / 2 <= 0.05 then 'about_usual' else 'above_usual' end as fade_band,
      case when score is null then 'unavailable' when (score - 0.5) / 2 <= -0.1 then 'slow_start' when (score - 0.5) / 2 < -0.03 then 'warming_up'
        when (score - 0.5) / 2 <= 0.05 then 'about_usual' when (score - 0.5) / 2 < 0.2 then 'above_usual' else 'strongest' end as rise_band from el""",
)
def pat_display_bands(spark, folder):
    delta = F.col("score") - 0.5
    return element_table(spark, folder).select(
        "account_id",
        "key",
        patterns.relative_performance_band(delta).alias("relative_band"),
        patterns.level_band(F.col("score")).alias("level_band"),
        patterns.session_curve_band(delta / 2, F.lit("fade")).alias("fade_band"),
        patterns.session_curve_band(delta / 2, F.lit("rise")).alias("rise_band"),
    )
