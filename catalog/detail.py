"""Detail path: nested documents, roles, features, cohorts and plain statistics."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog.base import register
from habitscope.functions import expr
from habitscope.functions.robust import spread
from habitscope.operators import cohorts, matches
from habitscope.session import cut
from habitscope.sources import views

DETAIL_SQL = """
dr as (select *, row_number() over (partition by match_id order by line_no, account_id, hero_id, net_worth) as player_no from (
  select l_orderkey + 1 as match_id, l_suppkey + 1 as account_id, l_linenumber::bigint as line_no, (l_partkey % 20) + 1 as hero_id,
    nullif(l_partkey % 6, 0) as lane_role, l_extendedprice as net_worth, l_quantity * 12 as gold_per_min, l_quantity * 14 as xp_per_min,
    (l_quantity * 5)::bigint as last_hits, l_extendedprice * 0.9 as gold_spent, l_partkey % 5 as obs_placed, l_suppkey % 3 as sen_placed,
    (l_partkey * 7) % 15 as kills, (l_orderkey * 5 + l_linenumber) % 11 as deaths, (l_suppkey * 3 + l_linenumber) % 21 as assists,
    l_extendedprice * (1 - l_discount) as hero_damage, l_quantity * 60 as tower_damage, (p_size % 8)::bigint * 10 as rank_tier, p_brand as patch,
    o_orderstatus = 'F' as won, 1200 + (l_orderkey * 37) % 2400 as duration_seconds, epoch_us(o_orderdate) // 1000000 as start_time
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey))"""


def rows(spark, folder):
    """Participants with a number in their match; a match has a handful of them."""
    order = Window.partitionBy("match_id").orderBy("line_no", "account_id", "hero_id", "net_worth")
    return views.detail_rows(spark, folder).withColumn("player_no", F.row_number().over(order).cast("bigint"))


ROLE_SQL = f"""{DETAIL_SQL},
rk as (select *, row_number() over (partition by match_id order by net_worth + gold_per_min * 15 + last_hits * 4 + gold_spent * 0.15 desc, player_no) - 1 as er,
  row_number() over (partition by match_id order by obs_placed + sen_placed desc, net_worth + gold_per_min * 15 + last_hits * 4 + gold_spent * 0.15, player_no) - 1 as sr,
  count(*) over (partition by match_id) as participants, obs_placed + sen_placed as w from dr),
rl as (select * exclude (er, sr, w), er as economy_rank, sr as support_rank,
  case when lane_role in (1, 2, 3) then lane_role when lane_role = 4 then case when w >= 2 or er >= 3 then 4 else 3 end
    when w >= 4 or sr = 0 then case when sr = 0 and er >= 3 then 5 else 4 end else least(er + 1, 5) end as role,
  case when lane_role in (1, 2, 3) then 0.86 when lane_role = 4 then case when w >= 2 or er >= 3 then 0.70 else 0.58 end
    when w >= 4 or sr = 0 then 0.68 when participants >= 5 then 0.64 else 0.52 end as role_probability from rk),
mf as (select *, kills + assists * 0.45 + hero_damage / 1000 + tower_damage / 800 as impact_score,
  (kills + assists) / greatest(deaths, 1) as kda, (kills + assists * 0.45 + hero_damage / 1000 + tower_damage / 800) / greatest(gold_per_min, 1) as economy_impact_efficiency,
  tower_damage / greatest(hero_damage + tower_damage, 1) as tower_share_proxy from rl)"""


def features(spark, folder):
    return matches.match_features(matches.infer_roles(rows(spark, folder), "player_no"))


@register(
    "agg_infer_roles",
    f"with {ROLE_SQL} select match_id, player_no, role::bigint as role, role_probability, economy_rank, support_rank from rl",
    "role_probability",
)
def agg_infer_roles(spark, folder):
    return matches.infer_roles(rows(spark, folder), "player_no").select(
        "match_id", "player_no", "role", "role_probability", "economy_rank", "support_rank"
    )


@register(
    "agg_match_features",
    f"with {ROLE_SQL} select match_id, player_no, impact_score, kda, economy_impact_efficiency, tower_share_proxy from mf",
    "impact_score kda economy_impact_efficiency tower_share_proxy",
)
def agg_match_features(spark, folder):
    return features(spark, folder).select(
        "match_id", "player_no", "impact_score", "kda", "economy_impact_efficiency", "tower_share_proxy"
    )


@register(
    "agg_by_dimensions",
    f"""with {ROLE_SQL} select hero_id, role::bigint as role, count(*) as rows, count(distinct account_id) as players,
      median(gold_per_min) as median_gold_per_min, median(coalesce(lane_role, 0)) as median_lane_role from mf group by 1, 2""",
    "median_gold_per_min median_lane_role",
)
def agg_by_dimensions(spark, folder):
    return cohorts.by_dimensions(features(spark, folder), ("hero_id", "role"), ("gold_per_min", "lane_role"))


_BUNDLE = """avg(won::int) as win_rate, median(gold_per_min) as median_gold_per_min, median(xp_per_min) as median_xp_per_min,
  median(last_hits) as median_last_hits, median(tower_damage) as median_tower_damage, median(duration_seconds) / 60 as median_duration_minutes,
  median(impact_score) as median_impact_score"""
_BUNDLE_DOUBLES = (
    "win_rate median_gold_per_min median_xp_per_min median_last_hits median_tower_damage median_duration_minutes "
    "median_impact_score"
)


@register(
    "agg_cohort_bundle",
    f"with {ROLE_SQL} select role::bigint as role, rank_tier, {_BUNDLE} from mf group by 1, 2",
    _BUNDLE_DOUBLES,
)
def agg_cohort_bundle(spark, folder):
    return cohorts.metric_bundle(features(spark, folder), ("role", "rank_tier"))


_MF_BUNDLE = _BUNDLE.replace("avg(", "avg(mf.").replace("median(", "median(mf.")
COHORT_SQL = f"""{ROLE_SQL},
tg as (select * from (select *, row_number() over (partition by account_id order by start_time desc, match_id desc, player_no desc) as k from mf) where k = 1),
lv as (select * from (values (0, true, true, true, true), (1, true, true, true, false), (2, false, true, true, true), (3, false, true, true, false), (4, false, false, true, false),
  (5, false, false, false, false)) v(level, h, r, t, p)),
cc as (select tg.account_id, lv.level, count(*) as sample_size, count(distinct mf.account_id) as distinct_players, {_MF_BUNDLE}
  from tg, lv, mf where mf.account_id <> tg.account_id and (not h or mf.hero_id is not distinct from tg.hero_id) and (not r or mf.role is not distinct from tg.role)
    and (not t or mf.rank_tier is not distinct from tg.rank_tier) and (not p or mf.patch is not distinct from tg.patch) group by 1, 2
  having count(*) >= 20 and count(distinct mf.account_id) >= 5),
ch as (select * from (select *, row_number() over (partition by account_id order by level) as k from cc) where k = 1)"""


def targets(table):
    """The newest match of each account."""
    newest = F.struct("start_time", "match_id", "player_no", "hero_id", "role", "rank_tier", "patch")
    return table.groupBy("account_id").agg(F.max(newest).alias("t")).select("account_id", "t.*")


@register(
    "join_cohort_selection",
    f"""with {COHORT_SQL} select tg.account_id, ch.level is not null as valid, ch.level::bigint as level, coalesce(sample_size, 0) as sample_size,
      coalesce(distinct_players, 0) as distinct_players from tg left join ch using (account_id)""",
)
def join_cohort_selection(spark, folder):
    newest = ("account_id", "start_time", "match_id", "player_no", *cohorts.DIMENSIONS)
    table = cut(features(spark, folder).select(*newest))
    return cohorts.select_narrowest(targets(table), table).select(
        "account_id", "valid", "level", "sample_size", "distinct_players"
    )


@register(
    "join_cohort_metrics",
    f"""with {COHORT_SQL} select account_id, win_rate, median_gold_per_min, median_xp_per_min, median_last_hits, median_tower_damage,
      median_duration_minutes, median_impact_score from ch""",
    _BUNDLE_DOUBLES,
)
def join_cohort_metrics(spark, folder):
    table = cut(features(spark, folder))
    return cohorts.cohort_metrics(cohorts.select_narrowest(targets(table), table), table)


@register(
    "agg_intervals",
    f"""with {ROLE_SQL}, g as (select account_id, sum(won::int)::double as s, count(*)::double as n, avg(impact_score) as m, var_samp(impact_score) as v from mf group by 1)
    select account_id, greatest(0, (s / n + 3.8416 / (2 * n) - 1.96 * sqrt((s / n * (1 - s / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) as wilson_low,
      least(1, (s / n + 3.8416 / (2 * n) + 1.96 * sqrt((s / n * (1 - s / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) as wilson_high,
      m - 1.96 * sqrt(v / n) as mean_low, m + 1.96 * sqrt(v / n) as mean_high, case when 2 * 1.96 * sqrt(v / n) < 0.25 then 'high' else 'moderate' end as label from g""",
    "wilson_low wilson_high mean_low mean_high",
)
def agg_intervals(spark, folder):
    grouped = (
        features(spark, folder)
        .groupBy("account_id")
        .agg(
            F.sum(F.col("won").cast("int")).alias("s"),
            F.count(F.lit(1)).alias("n"),
            F.avg("impact_score").alias("m"),
            F.var_samp("impact_score").alias("v"),
        )
    )
    low, high = expr.wilson(F.col("s"), F.col("n"))
    mean_low, mean_high = expr.normal_interval(F.col("m"), F.col("v"), F.col("n"))
    return grouped.select(
        "account_id",
        low.alias("wilson_low"),
        high.alias("wilson_high"),
        mean_low.alias("mean_low"),
        mean_high.alias("mean_high"),
        expr.interval_label(mean_low, mean_high).alias("label"),
    )


@register(
    "agg_robust_effect",
    f"""with {ROLE_SQL}, a as (select *, median(impact_score) over (partition by account_id) as am, median(impact_score) over () as gm from mf),
    g as (select median(abs(impact_score - gm)) as gmad, any_value(gm) as gm from a)
    select account_id, (any_value(am) - (select gm from g)) / greatest(1.4826 * (select gmad from g), 1.4826 * median(abs(impact_score - am)), 1e-9) as robust_effect from a group by 1""",
    "robust_effect",
)
def agg_robust_effect(spark, folder):
    # Both spreads examine the scores and count them: they are written once.
    table = cut(features(spark, folder).select("account_id", "impact_score"))
    own = spread(table, ["account_id"], "impact_score")
    overall = spread(table.withColumn("all", F.lit(1)), ["all"], "impact_score", "gc", "gm").drop("sample")
    scale = F.greatest(1.4826 * F.col("gm"), 1.4826 * F.col("mad"), F.lit(1e-9))
    # One row: the overall centre and spread.
    return own.withColumn("all", F.lit(1)).join(F.broadcast(overall), "all").select(
        "account_id", ((F.col("centre") - F.col("gc")) / scale).alias("robust_effect")
    )


@register(
    "agg_odds_and_p_values",
    f"""with {ROLE_SQL}, g as (select role::bigint as role, account_id, sum(won::int) as s, count(*) as n from mf group by 1, 2),
    t as (select *, sum(s) over (partition by role) as ts, sum(n) over (partition by role) as tn from g),
    z as (select role, account_id, ln(((s + 0.5) / (n - s + 0.5)) / ((ts - s + 0.5) / (tn - n - (ts - s) + 0.5))) as log_odds from t),
    q as (select *, abs(log_odds) / sqrt(2) as x from z), u as (select *, 1 / (1 + 0.3275911 * x) as tt from q),
    p as (select role, account_id, log_odds, ((((1.061405429 * tt - 1.453152027) * tt + 1.421413741) * tt - 0.284496736) * tt + 0.254829592) * tt * exp(-x * x) as p_value from u),
    r as (select *, row_number() over (partition by role order by p_value, account_id) as k, count(*) over (partition by role) as m from p)
    select role, account_id, log_odds, p_value, least(1, min(p_value * m / k) over (partition by role order by k desc rows unbounded preceding)) as adjusted from r""",
    "log_odds p_value adjusted",
)
def agg_odds_and_p_values(spark, folder):
    grouped = (
        features(spark, folder)
        .groupBy("role", "account_id")
        .agg(F.sum(F.col("won").cast("int")).alias("s"), F.count(F.lit(1)).alias("n"))
    )
    # The totals of the five roles.
    totals = grouped.groupBy("role").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    log_odds = expr.log_odds_ratio(
        F.col("s"), F.col("n"), F.col("ts") - F.col("s"), F.col("tn") - F.col("n")
    )
    tested = (
        grouped.join(F.broadcast(totals), "role")
        .withColumn("log_odds", log_odds)
        .withColumn("p_value", expr.normal_two_sided_p(F.col("log_odds")))
        .select("role", "account_id", "log_odds", "p_value")
    )
    from habitscope.operators.insights import benjamini_hochberg

    return benjamini_hochberg(tested, ("role",), "p_value", "account_id", "adjusted")
