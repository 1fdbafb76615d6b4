"""Element queries: pools, baselines, scores."""

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
from catalog.sessions import _TRANSITIONS
from habitscope.operators import baselines, elements, pools, sessions, windows
from habitscope.operators.measures import with_rates
from habitscope.session import cut
from habitscope.sources import views

# Trait values and primary functions of the generated heroes.
HERO_SQL = """
trait_names as (select unnest(['burst','complexity','farm_dependency','frontline','global_presence','initiation',
  'micro_intensity','mobility','pickoff','push','repositioning','save','scaling','sustain','sustained_damage',
  'teamfight','wave_clear']) as trait, unnest(range(17)) as i),
hero_trait as (select h.hero_id, t.trait, ((h.hero_id * 37 + t.i * 53) % 101) / 100.0::double as value
  from range(1, 21) h(hero_id), trait_names t),
hero_function as (
  select hero_id, case when max(value) >= 0.6 then arg_max(trait, (value, trait)) end as function
  from hero_trait where trait not in ('complexity', 'farm_dependency', 'micro_intensity') group by 1)"""


def heroes(spark):
    return views.hero_traits(spark)


def with_function(spark, rows):
    return baselines.with_function(rows, heroes(spark))


@register(
    "agg_diversity",
    f"""with {MATCH_ROWS}, c as (select account_id, hero_id, count(*) as c from match_rows group by 1, 2),
    r as (select *, sum(c) over (partition by account_id) as t,
          row_number() over (partition by account_id order by c desc, hero_id) as k from c)
    select account_id, any_value(t)::bigint as sample, count(*) as categories,
      case when count(*) > 1 then -sum(c / t * ln(c / t)) else 0 end as entropy,
      case when count(*) > 1 then -sum(c / t * ln(c / t)) / ln(count(*)) else 0 end as normalized_entropy,
      exp(case when count(*) > 1 then -sum(c / t * ln(c / t)) else 0 end) as effective_count,
      case when count(*) > 1 then -sum(c / t * log2(c / t)) else 0 end as entropy_bits,
      max(c / t) as top_share, sum(c / t) filter (k <= 3) as top3_share, sum(c / t) filter (k <= 5) as top5_share,
      sum(c / t) filter (k <= 10) as top10_share from r group by 1""",
    "entropy normalized_entropy effective_count entropy_bits top_share top3_share top5_share top10_share",
)
def agg_diversity(spark, folder):
    return pools.diversity(pools.counts(matches(spark, folder)))


def familiar_sql(source: str, minimum: int, strict: bool, keys: str = "account_id", count: str = "c", goal: str = "n"):
    need = "3" if strict else "least(3, stable)"
    return f"""
    select * from (
      select *, row_number() over w as pool_rank, count(*) over (partition by {keys}) as stable,
             coalesce(sum({count}) over (partition by {keys} order by {count} desc, hero_id
                      rows between unbounded preceding and 1 preceding), 0) as before
      from {source} where {count} >= {minimum} window w as (partition by {keys} order by {count} desc, hero_id))
    where pool_rank <= 10 and not (before >= greatest(1, ceil({goal} * 0.5)) and pool_rank - 1 >= {need})"""


_COUNTS = "hc as (select account_id, hero_id, count(*) as c, any_value(n) as n from nn group by 1, 2)"
_NN = f"{MATCH_ROWS}, nn as (select *, count(*) over (partition by account_id) as n from match_rows), {_COUNTS}"


def _pools_frame(spark, folder):
    counted = pools.counts(matches(spark, folder))
    total = counted.groupBy("account_id").agg(F.sum("c").alias("n"))
    return counted.join(total, "account_id")


@register(
    "agg_familiar_strict",
    f"with {_NN} select account_id, hero_id, c, pool_rank from ({familiar_sql('hc', 5, True)})",
)
def agg_familiar_strict(spark, folder):
    frame = _pools_frame(spark, folder)
    return pools.familiar_pool(frame, F.col("n"), minimum_games=5, strict=True).select(
        "account_id", "hero_id", "c", "pool_rank"
    )


@register(
    "agg_familiar_scorer",
    f"with {_NN} select account_id, hero_id, c, pool_rank from ({familiar_sql('hc', 3, False)})",
)
def agg_familiar_scorer(spark, folder):
    frame = _pools_frame(spark, folder)
    return pools.familiar_pool(frame, F.col("n")).select("account_id", "hero_id", "c", "pool_rank")


@register(
    "agg_familiar_adaptability",
    f"with {_NN} select account_id, hero_id, c, pool_rank from ({familiar_sql('hc', 5, False)})",
)
def agg_familiar_adaptability(spark, folder):
    frame = _pools_frame(spark, folder)
    return pools.familiar_pool(frame, F.col("n"), minimum_games=5).select("account_id", "hero_id", "c", "pool_rank")


_RN = f"""{MATCH_ROWS}, nn as (select *, count(*) over (partition by account_id) as n,
  row_number() over (partition by account_id order by started_at, match_id) as rn from match_rows),
hw as (select account_id, hero_id, any_value(n) as n, count(*) as c,
  count(*) filter (n - rn < 50) as c50, count(*) filter (n - rn < 100) as c100,
  count(*) filter (rn <= n // 2) as older_half, count(*) filter (rn > n // 2) as newer_half,
  count(*) filter (rn <= greatest(30, floor(n * 0.7))) as learned,
  count(*) filter (rn > greatest(30, floor(n * 0.7))) as evaluated from nn group by 1, 2),
st_r as (select *, row_number() over (partition by account_id order by c50 desc, hero_id) as r50,
  row_number() over (partition by account_id order by c100 desc, hero_id) as r100,
  row_number() over (partition by account_id order by c desc, hero_id) as rall from hw),
st_o as (select account_id, any_value(n) as n, 1 - sum(case when r50 <= 5 then c50 else 0 end) / sum(c50) as o1,
  1 - sum(case when r100 <= 5 then c100 else 0 end) / sum(c100) as o2,
  1 - sum(case when rall <= 5 then c else 0 end) / sum(c) as o3 from st_r group by 1),
st as (select account_id, case when n < 20 then 0.65 else
  greatest(0.55, least(1, 1 - (greatest(o1, o2, o3) - least(o1, o2, o3)) * 2)) end as stability from st_o)"""


@register(
    "elm_hero_pool_breadth",
    f"""with {_RN}, d as (select *, sum(c) over (partition by account_id) as t from st_r)
    select account_id, any_value(stability) as stability, any_value(t)::bigint as sample_size,
      exp(-sum(c / t * ln(c / t))) as effective_sample_size, 1.0 as coverage, count(*) as unique_heroes,
      1 - (0.45 * sum(c / t) filter (rall <= 5) + 0.35 * (1 - -sum(c / t * ln(c / t)) / ln(count(*)))
           + 0.20 * least(1, 10 / greatest(1, exp(-sum(c / t * ln(c / t)))))) as score
    from d join st using (account_id) group by account_id""",
    "stability effective_sample_size coverage score",
)
def elm_hero_pool_breadth(spark, folder):
    return elements.hero_pool_breadth(matches(spark, folder)).select(
        "account_id", "stability", "sample_size", "effective_sample_size", "coverage", "unique_heroes", "score"
    )


_JS = """
select account_id, sum({a})::bigint as a_rows, sum({b})::bigint as b_rows,
  sqrt(greatest(0, 0.5 * sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end)
     + 0.5 * sum(case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end)) / ln(2)) as shift
from (select *, {a} / sum({a}) over (partition by account_id) as p, {b} / sum({b}) over (partition by account_id) as q
      from {source}) group by account_id"""


@register(
    "agg_jensen_shannon",
    f"""with {_RN} select account_id, a_rows as left_rows, b_rows as right_rows, shift, greatest(0, 1 - shift) as similarity
    from ({_JS.format(a='older_half', b='newer_half', source='hw')})""",
    "shift similarity",
)
def agg_jensen_shannon(spark, folder):
    return pools.shift_of_counts(elements.hero_window_counts(matches(spark, folder)), "older_half", "newer_half")


@register(
    "elm_hero_pool_stability",
    f"""with {_RN} select account_id, a_rows + b_rows as sample_size,
      case when a_rows + b_rows >= 60 then greatest(0, 1 - shift) end as score,
      (case when a_rows + b_rows >= 60 then least(a_rows, b_rows) * 2 else a_rows + b_rows end)::bigint as effective_sample_size,
      stability from ({_JS.format(a='older_half', b='newer_half', source='hw')}) join st using (account_id)""",
    "score stability",
)
def elm_hero_pool_stability(spark, folder):
    return elements.hero_pool_stability(matches(spark, folder)).select(
        "account_id", "sample_size", "score", "effective_sample_size", "stability"
    )


@register(
    "elm_hero_exploration_rate",
    f"""with {_RN}, g as (select *, greatest(30, floor(n * 0.7)) as goal from hw),
    pool as ({familiar_sql('g', 3, False, count='learned', goal='goal')})
    select account_id, any_value(hw.n) as sample_size, count(pool.hero_id) as familiar_heroes,
      case when any_value(hw.n) >= 60 then sum(case when pool.hero_id is null then hw.evaluated else 0 end)
           / greatest(sum(hw.evaluated), 1) end as score
    from hw left join pool using (account_id, hero_id) group by account_id""",
    "score",
)
def elm_hero_exploration_rate(spark, folder):
    return elements.hero_exploration_rate(matches(spark, folder)).select(
        "account_id", "sample_size", "familiar_heroes", "score"
    )


@register(
    "join_expanding_familiar",
    f"""with {measured(DAY_GAP)},
    pc as (select t.account_id, t.match_id, t.hero_id as own, c.hero_id, count(*) as c
      from perf t join perf c on t.account_id = c.account_id and c.rn < t.rn and not c.session_corrupt
      group by 1, 2, 3, 4),
    pt as (select *, sum(c) over (partition by account_id, match_id) as n from pc),
    pool as ({familiar_sql('pt', 3, False, keys='account_id, match_id')})
    select p.account_id, p.match_id, count(pool.hero_id) as earlier_pool,
      coalesce(bool_or(pool.hero_id = p.hero_id), false) as is_familiar
    from perf p left join pool on p.account_id = pool.account_id and p.match_id = pool.match_id group by 1, 2""",
)
def join_expanding_familiar(spark, folder):
    rows = sessions.sessionize(matches(spark, folder), DAY_GAP)
    return pools.expanding_familiar(rows)


@register(
    "elm_post_loss_familiarity_shift",
    f"""with {measured(DAY_GAP)},{_TRANSITIONS},
    pc as (select t.account_id, t.match_id, c.hero_id, count(*) as c
      from perf t join perf c on t.account_id = c.account_id and c.rn < t.rn and not c.session_corrupt group by 1, 2, 3),
    pt as (select *, sum(c) over (partition by account_id, match_id) as n from pc),
    pool as ({familiar_sql('pt', 3, False, keys='account_id, match_id')}),
    flag as (select s.account_id, s.match_id, any_value(s.prev_won) as prev_won,
      max((pool.hero_id = s.hero_id)::int)::double as f
      from streak s join pool on s.account_id = pool.account_id and s.match_id = pool.match_id
      where s.paired and not s.session_corrupt and not s.prev_corrupt group by 1, 2),
    x as (select account_id, count(*) filter (not prev_won) as losses, count(*) filter (prev_won) as wins,
      median(f) filter (not prev_won) as after_loss, median(f) filter (prev_won) as after_win from flag group by 1)
    select t.account_id, coalesce(losses + wins, 0) as sample_size, after_loss, after_win,
      case when losses >= 15 and wins >= 15 then 0.5 + 0.5 * tanh((after_loss - after_win) / 0.35) end as score
    from (select distinct account_id from match_rows) t left join x using (account_id)""",
    "score after_loss after_win",
)
def elm_post_loss_familiarity_shift(spark, folder):
    return elements.post_loss_familiarity_shift(measures(spark, folder, DAY_GAP)).select(
        "account_id", "sample_size", "after_loss", "after_win", "score"
    )


@register(
    "elm_role_breadth",
    f"""with {MATCH_ROWS}, c as (select account_id, role_hint, count(*) as c from match_rows where role_confidence >= 0.6 group by 1, 2),
    d as (select *, sum(c) over (partition by account_id) as t from c)
    select account_id, any_value(t)::bigint as sample_size, max(c / t) as dominant_role_share,
      1 - (0.65 * max(c / t) + 0.35 * (1 - case when count(*) > 1 then -sum(c / t * ln(c / t)) / ln(count(*)) else 0 end)) as score
    from d group by 1""",
    "dominant_role_share score",
)
def elm_role_breadth(spark, folder):
    return elements.role_breadth(matches(spark, folder)).select(
        "account_id", "sample_size", "dominant_role_share", "score"
    )


_RATES = f"""{MATCH_ROWS}, r as (select *,
  case when duration_seconds >= 600 then (kills + assists) / (duration_seconds / 60.0) end as activity,
  case when duration_seconds >= 600 then deaths / (duration_seconds / 600.0) end as death_rate,
  case role_hint when 'carry' then 0.95 when 'mid' then 0.95 when 'offlane' then 0.9 when 'jungle' then 0.88
    when 'roamer' then 0.95 else 0.88 end as base_activity,
  case role_hint when 'carry' then 0.55 when 'mid' then 0.52 when 'offlane' then 0.42 else 0.4 end as base_share,
  case role_hint when 'carry' then 0.72 when 'mid' then 0.78 when 'offlane' then 0.95 when 'jungle' then 0.85
    when 'roamer' then 1.05 else 0.85 end as base_deaths from match_rows)"""


@register(
    "elm_combat_involvement",
    f"""with {_RATES} select account_id, count(activity) as sample_size, median(activity) as median_rate,
      least(0.70, 0.35 + 0.35 * least(1, count(activity) / 30) + 0.20 * case when count(activity) >= 50 then 0.85 else 0.65 end
        + 0.10 * 0.75) as confidence_override,
      case when count(activity) >= 30 then 0.5 + 0.5 * tanh(median(activity - base_activity) / 0.30) end as score
    from r group by 1""",
    "median_rate confidence_override score",
)
def elm_combat_involvement(spark, folder):
    return elements.combat_involvement(with_rates(matches(spark, folder))).select(
        "account_id", "sample_size", "median_rate", "confidence_override", "score"
    )


@register(
    "elm_finisher_orientation",
    f"""with {_RATES}, s as (select account_id, count(*) filter (kills + assists > 0) as sample_size,
      sum(kills) as k, sum(kills + assists) as i, sum(base_share * (kills + assists)) / sum(kills + assists) as e from r group by 1)
    select account_id, sample_size, k / i as kill_share, e as expected_kill_share,
      case when sample_size >= 30 and i >= 100 then greatest(0, least(1, 0.5 + (k / i - e) * (i / (i + 100.0)) / 0.4)) end as score
    from s""",
    "kill_share expected_kill_share score",
)
def elm_finisher_orientation(spark, folder):
    return elements.finisher_orientation(with_rates(matches(spark, folder))).select(
        "account_id", "sample_size", "kill_share", "expected_kill_share", "score"
    )


@register(
    "elm_death_exposure",
    f"""with {_RATES} select account_id, count(death_rate) as sample_size, median(death_rate) as median_rate,
      case when count(death_rate) >= 30 then 0.5 + 0.5 * tanh(median(death_rate - base_deaths) / 1.2) end as score
    from r group by 1""",
    "median_rate score",
)
def elm_death_exposure(spark, folder):
    return elements.death_exposure(with_rates(matches(spark, folder))).select(
        "account_id", "sample_size", "median_rate", "score"
    )


_EVAL = f"""
ev_rows as (select *, count(*) over (partition by account_id) as en,
  row_number() over (partition by account_id order by started_at, match_id) as ern from {{rows}}
  where hero_id is not null and won is not null),
ev_split as (select r.*, s.split, greatest(1, floor(en * s.share)) as size
  from ev_rows r, (values (0, 0.70), (1, 0.35), (2, 0.50)) s(split, share)),
ev_hero as (select account_id, split, hero_id, any_value(size) as n, count(*) filter (ern <= size) as c from ev_split group by 1, 2, 3),
ev_pool as ({familiar_sql('ev_hero', 3, False, keys='account_id, split')}),
ev_flag as (select e.*, p.hero_id is not null as familiar from ev_split e left join ev_pool p
  on e.account_id = p.account_id and e.split = p.split and e.hero_id = p.hero_id where e.ern > e.size),
ev_side as (select account_id, split, least(count(*) filter (familiar), count(*) filter (not familiar)) as smaller from ev_flag group by 1, 2),
ev_best as (select account_id, max(smaller) filter (split = 0) >= 12 as base_ok, arg_max(split, (smaller, -split)) as best from ev_side group by 1),
ev as (select f.*, case when base_ok then 'time_split_70_30' else 'leave_one_window_out_fallback' end as method
  from ev_flag f join ev_best b on f.account_id = b.account_id and f.split = case when b.base_ok then 0 else b.best end)"""


@register(
    "join_evaluation_groups",
    f"with {MATCH_ROWS},{_EVAL.format(rows='match_rows')} select account_id, match_id, familiar, method from ev",
)
def join_evaluation_groups(spark, folder):
    return pools.evaluation_groups(matches(spark, folder)).select("account_id", "match_id", "familiar", "method")


@register(
    "elm_off_pool_performance",
    f"""with {measured()},{_EVAL.format(rows='perf')}, x as (select account_id, any_value(method) as method,
      count(performance) filter (familiar) as l, count(performance) filter (not familiar) as r,
      median(performance) filter (familiar) as familiar_median, median(performance) filter (not familiar) as off_median from ev group by 1)
    select account_id, method, l + r as sample_size, familiar_median, off_median,
      case when l >= 20 and r >= 20 then 0.5 + 0.5 * tanh((off_median - familiar_median) / 0.3) end as score from x""",
    "familiar_median off_median score",
)
def elm_off_pool_performance(spark, folder):
    return elements.off_pool_performance(measures(spark, folder)).select(
        "account_id", "method", "sample_size", "familiar_median", "off_median", "score"
    )


@register(
    "elm_off_pool_activity_stability",
    f"""with {_RATES},{_EVAL.format(rows='r')}, m as (select *, median(activity) over (partition by account_id) as mm from ev),
    x as (select account_id, count(activity) filter (familiar) as l, count(activity) filter (not familiar) as r,
      median(activity) filter (not familiar) - median(activity) filter (familiar) as d,
      coalesce(nullif(median(abs(activity - mm)), 0), 1) as mad from m group by 1)
    select account_id, l + r as sample_size, d / mad as standardized_delta,
      case when l >= 12 and r >= 12 then greatest(0, 1 - least(1, abs(d / mad) / 2)) end as score from x""",
    "standardized_delta score",
)
def elm_off_pool_activity_stability(spark, folder):
    return elements.off_pool_activity_stability(with_rates(matches(spark, folder))).select(
        "account_id", "sample_size", "standardized_delta", "score"
    )


@register(
    "elm_performance_volatility",
    f"""with {measured()}, m as (select *, median(performance) over (partition by account_id) as mm from perf)
    select account_id, count(performance) as sample_size, median(abs(performance - mm)) as mad,
      case when count(performance) >= 30 then least(1, median(abs(performance - mm)) / 0.3) end as score from m group by 1""",
    "mad score",
)
def elm_performance_volatility(spark, folder):
    return elements.performance_volatility(measures(spark, folder)).select(
        "account_id", "sample_size", "mad", "score"
    )


def _recent_sql(rows: str, value: str, scale: float) -> str:
    return f"""b as (select account_id, {value} as x, count(*) over (partition by account_id)
        - row_number() over (partition by account_id order by started_at, match_id) as back,
        count(*) over (partition by account_id) as m from {rows} where {value} is not null)
    select account_id, any_value(m) as measured, median(x) filter (back < 20) as recent,
      median(x) filter (back >= 20 and back < 60) as prior,
      case when any_value(m) >= 45 then 0.5 + 0.5 * tanh((median(x) filter (back < 20)
        - median(x) filter (back >= 20 and back < 60)) / {scale}) end as score from b group by 1"""


@register(
    "elm_recent_form_shift",
    f"with {measured()}, {_recent_sql('perf', 'performance', 0.30)}",
    "recent prior score",
)
def elm_recent_form_shift(spark, folder):
    rows = measures(spark, folder)
    return (
        elements.recent_form_shift(rows)
        .select("account_id", "recent", "prior", "score")
        .join(windows.recent_and_prior(rows, "performance").select("account_id", "measured"), "account_id")
    )


@register("elm_recent_activity_shift", f"with {_RATES}, {_recent_sql('r', 'activity', 2.0)}", "recent prior score")
def elm_recent_activity_shift(spark, folder):
    rows = with_rates(matches(spark, folder))
    return (
        elements.recent_activity_shift(rows)
        .select("account_id", "recent", "prior", "score")
        .join(windows.recent_and_prior(rows, "activity").select("account_id", "measured"), "account_id")
    )


_LENGTH_SQL = f"""
lw as (select *, exp(-0.6931471805599453 * greatest(0, {WINDOW_END} - start_time) / 15552000.0) as w from sess where completed),
lc as (select *, sum(w) over (partition by account_id order by match_count rows unbounded preceding) as c1,
  sum(w) over (partition by account_id order by elapsed_seconds rows unbounded preceding) as c2,
  sum(w) over (partition by account_id) as t from lw),
lx as (select account_id, count(*) as k, sum(w) * sum(w) / sum(w * w) as eff,
  min(case when c1 >= t / 2 - 1e-9 * t then match_count end)::double as median_length,
  min(case when c2 >= t / 2 - 1e-9 * t then elapsed_seconds end) / 3600 as median_hours,
  sum(case when match_count >= 5 then w else 0 end) / sum(w) as share_long from lc group by 1)"""


@register(
    "elm_session_length_tendency",
    f"""with {measured()},{_LENGTH_SQL}, y as (select t.account_id, t.n as sample_size, eff as effective_sample_size, median_length, median_hours, share_long,
      case when k >= 10 and t.n >= 25 then greatest(0, least(1, 0.5 + 0.35 * (median_length - 3) / 2 + 0.2 * (median_hours - 3) / 2
        + 0.15 * (share_long - 0.5))) end as score
    from (select account_id, count(*) as n from perf group by 1) t left join lx using (account_id))
    select *, case when score is null then null when score < 0.2 then 'Burst' when score < 0.4 then 'Short'
      when score < 0.6 then 'Medium' when score < 0.8 then 'Long' else 'Marathon' end as zone from y""",
    "effective_sample_size median_length median_hours share_long score",
)
def elm_session_length_tendency(spark, folder):
    rows = sessions.sessionize(matches(spark, folder), GAP)
    scored = elements.session_length_tendency(rows, session_rows(rows), WINDOW_END)
    return scored.select(
        "account_id",
        "sample_size",
        "effective_sample_size",
        "median_length",
        "median_hours",
        "share_long",
        "score",
        elements.zone_label(F.lit("session_length_tendency"), F.col("score")).alias("zone"),
    )


@register(
    "elm_post_loss_activity_shift",
    f"""with {measured(DAY_GAP)},{_TRANSITIONS}, x as (select account_id,
      count(activity) filter (not prev_won) as l, count(activity) filter (prev_won) as w,
      median(activity) filter (not prev_won) as after_loss, median(activity) filter (prev_won) as after_win
      from streak where paired and not prev_corrupt and not session_corrupt group by 1)
    select account_id, coalesce(l + w, 0) as sample_size, after_loss, after_win,
      case when l >= 15 and w >= 15 then 0.5 + 0.5 * tanh((after_loss - after_win) / 2) end as score
    from (select distinct account_id from perf) left join x using (account_id)""",
    "after_loss after_win score",
)
def elm_post_loss_activity_shift(spark, folder):
    return elements.post_loss_activity_shift(measures(spark, folder, DAY_GAP)).select(
        "account_id", "sample_size", "after_loss", "after_win", "score"
    )


def baseline_sql(candidates: str, targets: str, name: str = "bl") -> str:
    """Brute force: every target against every candidate outside its session, per level."""
    return f"""
{name}_pair as (
  select t.account_id, t.match_id, c.performance, c.weight, l.level
  from {targets} t join {candidates} c on t.account_id = c.account_id and t.session_no <> c.session_no
  join (values (0), (1), (2), (3), (4)) l(level) on case l.level
    when 0 then t.hero_id = c.hero_id and t.role_hint = c.role_hint and t.function = c.function
    when 1 then t.hero_id = c.hero_id and t.function = c.function
    when 2 then t.function = c.function when 3 then t.role_hint = c.role_hint else true end),
{name}_cum as (
  select *, sum(weight) over (partition by account_id, match_id, level order by performance rows unbounded preceding) as cum,
         sum(weight) over (partition by account_id, match_id, level) as total from {name}_pair),
{name}_level as (
  select account_id, match_id, level, count(*) as reference_rows,
         sum(weight) * sum(weight) / sum(weight * weight) as effective_rows,
         min(case when cum >= total / 2 - 1e-9 * total then performance end) as baseline
  from {name}_cum group by 1, 2, 3 having count(*) >= 3),
{name} as (
  select account_id, match_id, arg_min(baseline, level) as baseline, min(level) as level_no,
         arg_min(reference_rows, level) as reference_rows, arg_min(effective_rows, level) as effective_rows
  from {name}_level group by 1, 2)"""


_CURVE_SQL = f"""
pf as (select p.*, h.function from perf p left join hero_function h using (hero_id)),
cv as (select * from (
  select p.*, s.start_time, s.left_censored, count(*) over (partition by account_id, session_no) as kept
  from pf p join sess s using (account_id, session_no)
  where not s.corrupt and not s.right_censored and p.performance is not null and not p.session_corrupt) where kept >= 2),
ct as (select * from cv where not (left_censored and session_index = 1)),{baseline_sql('cv', 'ct')}"""

_LEVEL = "['hero_role_function', 'hero_function', 'function', 'role', 'overall'][level_no + 1]"


@register(
    "join_leave_session_out",
    f"""with {measured()},{HERO_SQL},{_CURVE_SQL}
    select account_id, match_id, baseline, {_LEVEL} as level, reference_rows, effective_rows from bl""",
    "baseline effective_rows",
)
def join_leave_session_out(spark, folder):
    rows = with_function(spark, measures(spark, folder))
    usable = elements.curve_rows(rows, session_rows(rows))
    return baselines.leave_session_out(usable, ~(F.col("left_censored") & (F.col("session_index") == 1)))


# The part table as a roster: trait values and primary function of every part.
PART_SQL = HERO_SQL.replace("h.hero_id,", "h.p_partkey as hero_id,").replace("h.hero_id *", "h.p_partkey *").replace(
    "range(1, 21) h(hero_id)", "part h"
)


@register("join_primary_function", f"with {PART_SQL} select hero_id, function from hero_function")
def join_primary_function(spark, folder):
    return baselines.primary_functions(views.part_heroes(spark, folder))


_BUCKET_SQL = f"""
br as (select ct.account_id, ct.session_no, ct.start_time, ct.match_id, ct.performance - bl.baseline as residual,
  case when session_index <= 1 then 'G1' when session_index = 2 then 'G2' when session_index = 3 then 'G3'
       when session_index = 4 then 'G4' else 'G5+' end as bucket
  from ct join bl using (account_id, match_id)),
bs as (select account_id, session_no, bucket, {{middle}}(residual) as residual, count(*) as observations, any_value(start_time) as start_time,
  exp(-0.6931471805599453 * greatest(0, {WINDOW_END} - any_value(start_time)) / 15552000.0) as w from br group by 1, 2, 3),
bc as (select account_id, bucket, sum(residual * w) / sum(w) as value, count(*) as sessions, sum(observations)::bigint as observations
  from bs group by 1, 2)"""


@register(
    "elm_session_curve",
    f"with {measured()},{HERO_SQL},{_CURVE_SQL},{_BUCKET_SQL.format(middle='median')} select * from bc",
    "value",
)
def elm_session_curve(spark, folder):
    rows = with_function(spark, measures(spark, folder))
    residuals = elements.session_bucket_residuals(rows, session_rows(rows))
    w = elements.recency_weight(F.col("start_time"), F.lit(WINDOW_END))
    return residuals.groupBy("account_id", "bucket").agg(
        F.try_divide(F.sum(F.col("residual") * w), F.sum(w)).alias("value"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("observations").alias("observations"),
    )


_BREAK_SQL = """
bd as (select account_id, avg(value) filter (bucket not in ('G1', 'G2')) - avg(value) filter (bucket in ('G1', 'G2')) as delta,
  sum(observations)::bigint as sample_size from bc group by 1),
bi as (select account_id, count(*) as independent_sessions from (select distinct account_id, session_no from bs) group by 1),
bdir as (select *, case when delta < -0.04 then 'fade' when delta > 0.04 then 'rise' else 'flat' end as direction from bd),
bsup as (select c.account_id, c.bucket, c.value * case when d.direction = 'rise' then 1 else -1 end as sv
  from bc c join bdir d using (account_id) where c.sessions >= 8),
blate as (select *, min(sv) over (partition by account_id order by bucket rows between current row and unbounded following) as low from bsup),
bbp as (select account_id, count(*) as k, min(bucket) filter (low >= 0.08) as bucket, min(sv) >= 0 and max(sv) >= 0.08 as gradual
  from blate group by 1),
bres as (select d.*, i.independent_sessions, case when direction = 'flat' or coalesce(k, 0) < 2 then 'unresolved'
    when bucket is not null then 'stable_breakpoint' when gradual then 'gradual' else 'unresolved' end as breakpoint_state,
  case when direction <> 'flat' and k >= 2 then bucket end as breakpoint_bucket
  from bdir d join bi i using (account_id) left join bbp using (account_id))"""


@register(
    "elm_late_session_performance",
    f"""with {measured()},{HERO_SQL},{_CURVE_SQL},{_BUCKET_SQL.format(middle='median')},{_BREAK_SQL}
    select t.account_id, coalesce(sample_size, 0) as sample_size, coalesce(independent_sessions, 0) as independent_sessions, delta,
      breakpoint_state, breakpoint_bucket,
      case when independent_sessions >= 12 then 0.5 + 0.5 * tanh(delta / 0.2) end as score
    from (select distinct account_id from perf) t left join bres using (account_id)""",
    "delta score",
)
def elm_late_session_performance(spark, folder):
    rows = with_function(spark, measures(spark, folder))
    return elements.late_session_performance(rows, session_rows(rows), WINDOW_END).select(
        "account_id",
        "sample_size",
        "independent_sessions",
        "delta",
        "breakpoint_state",
        "breakpoint_bucket",
        "score",
    )


@register(
    "elm_post_loss_performance_response",
    f"""with {measured(DAY_GAP)},{HERO_SQL},
    pf as (select p.*, h.function from perf p left join hero_function h using (hero_id)),
    u as (select p.*, s.start_time from pf p join sess s using (account_id, session_no)
          where not s.corrupt and p.performance is not null and not p.session_corrupt),
    ul as (select *, lag(won) over (partition by account_id, session_no order by session_index) as pw from u),
    al as (select * from ul where pw = false),{baseline_sql('u', 'al')},
    rs as (select al.*, al.performance - bl.baseline as residual from al join bl using (account_id, match_id)),
    c1 as (select *, sum(weight) over (partition by account_id, session_no order by residual rows unbounded preceding) as cum,
      sum(weight) over (partition by account_id, session_no) as total from rs),
    ps as (select account_id, session_no, min(case when cum >= total / 2 - 1e-9 * total then residual end) as delta, count(*) as k,
      exp(-0.6931471805599453 * greatest(0, {WINDOW_END} - any_value(start_time)) / 15552000.0) as w from c1 group by 1, 2),
    c2 as (select *, sum(w) over (partition by account_id order by delta rows unbounded preceding) as cum,
      sum(w) over (partition by account_id) as total from ps),
    x as (select account_id, min(case when cum >= total / 2 - 1e-9 * total then delta end) as delta, sum(k)::bigint as n, count(*) as s from c2 group by 1),
    tl as (select account_id, count(*) as t from al group by 1)
    select a.account_id, coalesce(n, 0) as sample_size, coalesce(s, 0) as independent_sessions, delta,
      coalesce(n, 0) / greatest(coalesce(t, 0), 1) as coverage,
      case when n >= 30 and s >= 3 and n / greatest(t, 1) >= 0.5 then 0.5 + 0.5 * tanh(delta / 0.2) end as score
    from (select distinct account_id from perf) a left join tl using (account_id) left join x using (account_id)""",
    "delta coverage score",
)
def elm_post_loss_performance_response(spark, folder):
    rows = with_function(spark, measures(spark, folder, DAY_GAP))
    return elements.post_loss_performance_response(rows, session_rows(rows, DAY_GAP), WINDOW_END).select(
        "account_id", "sample_size", "independent_sessions", "delta", "coverage", "score"
    )
