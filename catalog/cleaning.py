"""Cleaning, ledger and eligibility queries over a dirty copy of the history."""

from pyspark.sql import functions as F

from catalog.base import MATCH_ROWS, WINDOW_END, matches, register
from habitscope.operators import normalize
from habitscope.sources import views

RAW_SQL = f"""{MATCH_ROWS}, raw_c as (
  select m.*, c.copy from match_rows m, (values (0), (1), (2)) c(copy)
  where c.copy = 0 or (c.copy = 1 and match_id % 7 = 0) or (c.copy = 2 and match_id % 11 = 0)),
raw as (select case when match_id % 997 = 0 then 'x' else match_id::varchar end as match_id, account_id,
  match_id * 4 + copy as source_index,
  case when match_id % 13 <> 0 then started_at end::varchar as start_time,
  case when match_id % 17 = 0 then -duration_seconds else duration_seconds end::varchar as duration,
  case when match_id % 31 <> 0 then hero_id end::varchar as hero_id,
  case when match_id % 37 <> 0 then case when match_id % 2 = 0 then 3 else 130 end end::varchar as player_slot,
  case when match_id % 41 <> 0 then case when match_id % 2 = 0 then won else not won end end::int::varchar as radiant_win,
  case when match_id % 19 = 0 then '4' else '22' end as game_mode,
  case when match_id % 43 = 0 then '1' else '7' end as lobby_type,
  case when copy = 1 then null when match_id % 47 = 0 then '12.5' else kills::varchar end as kills,
  deaths::varchar as deaths, (assists + case when copy = 2 then 1 else 0 end)::varchar as assists,
  case role_hint when 'carry' then '1' when 'mid' then '2' when 'offlane' then '3' when 'jungle' then '4' else '5' end as lane_role,
  case when match_id % 53 = 0 then '1' else '0' end as is_roaming,
  case when match_id % 23 = 0 then '3' else '0' end as leaver_status,
  case when match_id % 29 = 0 then '65001' end as leagueid,
  case when match_id % 59 = 0 then '999999' else account_id::varchar end as row_account_id from raw_c),
rid as (select *, try_cast(match_id as bigint) as id,
  concat_ws(chr(31), 'assists=' || assists, 'deaths=' || deaths, 'duration=' || duration, 'game_mode=' || game_mode, 'hero_id=' || hero_id,
    'is_roaming=' || is_roaming, 'kills=' || kills, 'lane_role=' || lane_role, 'leagueid=' || leagueid, 'leaver_status=' || leaver_status,
    'lobby_type=' || lobby_type, 'match_id=' || match_id, 'player_slot=' || player_slot, 'radiant_win=' || radiant_win,
    'row_account_id=' || row_account_id, 'start_time=' || start_time) as fp,
  10 * (1 + (start_time is not null)::int + 1 + (hero_id is not null)::int + (player_slot is not null)::int + (radiant_win is not null)::int
        + 1 + 1 + (kills is not null)::int + 1 + 1)
    + (9 + 1 + (start_time is not null)::int + (hero_id is not null)::int + (player_slot is not null)::int + (radiant_win is not null)::int
       + (kills is not null)::int + (leagueid is not null)::int) as score from raw),
dedup as (select * from (select *, row_number() over (partition by account_id, id order by score desc, fp, source_index) as k from rid where id > 0) where k = 1),
typed as (select *, try_cast(start_time as bigint) as started, case when try_cast(duration as bigint) >= 0 then try_cast(duration as bigint) end as dur,
  case when try_cast(player_slot as int) < 128 then 'radiant' when player_slot is not null then 'dire' end as side from dedup),
typed2 as (select *, (radiant_win = '1') = (side = 'radiant') as w from typed),
norm as (select *, list_distinct(x) as unordered, list_filter([
    case when kills is not null and coalesce(try_cast(kills as bigint), -1) < 0 or kills = '12.5' then 'invalid_kills' end,
    case when try_cast(duration as bigint) < 0 then 'invalid_duration' end,
    case when row_account_id <> account_id::varchar then 'account_id_mismatch' end,
    case when started is null then 'missing_start_time' end,
    case when hero_id is null then 'missing_hero' end, case when side is null then 'missing_side' end,
    case when w is null then 'missing_outcome' end, case when game_mode not in ('1', '22') then 'unsupported_game_mode' end,
    case when (dur is null or dur < 300) and not coalesce(try_cast(duration as bigint) < 0, false) then 'invalid_duration' end,
    case when leaver_status = '3' then 'abandoned' end, case when lobby_type not in ('0', '7') then 'unsupported_lobby_type' end,
    case when leagueid is not null then 'pro_or_league' end], lambda r: r is not null) as reasons
  from (select *, []::varchar[] as x from typed2))"""


def raw(spark, folder):
    return views.raw_rows(spark, folder)


@register(
    "nrm_deduplicate",
    f"with {RAW_SQL} select account_id, id as match_id, source_index, kills, assists from dedup",
)
def nrm_deduplicate(spark, folder):
    return normalize.deduplicate(raw(spark, folder)).select(
        "account_id",
        normalize.as_int(F.col("match_id")).alias("match_id"),
        "source_index",
        "kills",
        "assists",
    )


@register(
    "nrm_duplicate_conflicts",
    f"""with {RAW_SQL}, ordered as (select *, row_number() over (partition by account_id, id order by source_index) as p from rid where id > 0),
    best as (select o.account_id, o.id, o.p, o.source_index, o.fp,
       (select b.source_index from ordered b where b.account_id = o.account_id and b.id = o.id and b.p <= o.p order by b.score desc, b.fp, b.source_index limit 1) as kept_index,
       (select b.source_index from ordered b where b.account_id = o.account_id and b.id = o.id and b.p < o.p order by b.score desc, b.fp, b.source_index limit 1) as previous_index
     from ordered o)
    select b.account_id, b.id as match_id, b.previous_index, b.source_index, b.kept_index
    from best b join ordered q on q.account_id = b.account_id and q.id = b.id and q.source_index = b.previous_index where q.fp <> b.fp""",
)
def nrm_duplicate_conflicts(spark, folder):
    return normalize.duplicate_conflicts(raw(spark, folder))


@register(
    "nrm_normalize",
    f"""with {RAW_SQL} select account_id, id as match_id, source_index, started as started_at, dur as duration_seconds, started + dur as ended_at,
      try_cast(hero_id as bigint) as hero_id, side, w as won, try_cast(nullif(kills, '12.5') as bigint) as kills, try_cast(assists as bigint) as assists,
      case when is_roaming = '1' then 'roamer' else ['carry', 'mid', 'offlane', 'jungle', 'roamer'][lane_role::int] end as role_hint,
      case when is_roaming = '1' then 0.72 else 0.86 end as role_confidence, len(reasons) = 0 as eligible,
      array_to_string(reasons, ',') as reasons from norm""",
    "role_confidence",
)
def nrm_normalize(spark, folder):
    rows = normalize.normalize(normalize.deduplicate(raw(spark, folder)))
    return rows.select(
        "account_id",
        "match_id",
        "source_index",
        "started_at",
        "duration_seconds",
        "ended_at",
        "hero_id",
        "side",
        "won",
        "kills",
        "assists",
        "role_hint",
        "role_confidence",
        "eligible",
        F.concat_ws(",", "reasons").alias("reasons"),
    )


@register(
    "nrm_exclusion_ledger",
    f"""with {RAW_SQL} select account_id, source_index, id as match_id, 'invalid_match_id' as reasons from rid where id is null or id <= 0
    union all select account_id, source_index, id, array_to_string(reasons, ',') from norm where len(reasons) > 0""",
)
def nrm_exclusion_ledger(spark, folder):
    return normalize.exclusion_ledger(raw(spark, folder)).withColumn("reasons", F.concat_ws(",", "reasons"))


@register(
    "nrm_reason_histogram",
    f"""with {RAW_SQL} select reason, count(*) as rows from (
      select 'invalid_match_id' as reason from rid where id is null or id <= 0 union all select unnest(reasons) from norm) group by 1""",
)
def nrm_reason_histogram(spark, folder):
    return normalize.reason_histogram(normalize.exclusion_ledger(raw(spark, folder)))


_FLAGS = ("overall", "breadth", "role", "adaptability", "activity", "orientation", "resilience", "endurance", "rhythm")
_KDA = "nullif(kills, '12.5') is not null"


@register(
    "nrm_eligibility_flags",
    f"""with {RAW_SQL}, f as (select *, len(reasons) = 0 as ok, case when {_KDA} then [] else ['missing_kda'] end::varchar[] as mk from norm)
    select account_id, id as match_id, ok as overall, ok as breadth, ok as role, ok as adaptability,
      ok and {_KDA} and dur >= 600 as activity, ok and {_KDA} and try_cast(nullif(kills, '12.5') as bigint) + assists::bigint > 0 as orientation,
      ok as resilience, ok as endurance, ok as rhythm, array_to_string(list_concat(reasons, mk), ',') as activity_reasons from f""",
)
def nrm_eligibility_flags(spark, folder):
    rows = normalize.normalize(normalize.deduplicate(raw(spark, folder)))
    return rows.select(
        "account_id",
        "match_id",
        *[F.col(f"eligibility.{f}.included").alias(f) for f in _FLAGS],
        F.concat_ws(",", "eligibility.activity.reasons").alias("activity_reasons"),
    )


@register(
    "nrm_history_window",
    f"""with {MATCH_ROWS} select account_id, count(*) as rows, min(started_at) as first_start, max(started_at) as last_start
    from match_rows where started_at between {WINDOW_END - 20 * 86400} and {WINDOW_END} group by 1""",
)
def nrm_history_window(spark, folder):
    start, end = normalize.history_window(WINDOW_END, 20)
    kept = normalize.within_window(matches(spark, folder), start, end)
    return kept.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("started_at").alias("first_start"),
        F.max("started_at").alias("last_start"),
    )


@register(
    "src_history_cap",
    f"""with {MATCH_ROWS} select account_id, match_id, started_at from (select *, row_number() over
      (partition by account_id order by started_at desc, match_id desc) as k from match_rows) where k <= 25""",
)
def src_history_cap(spark, folder):
    return normalize.newest_per_account(matches(spark, folder), 25).select("account_id", "match_id", "started_at")


_DETAIL_SQL = """detail as (select account_id, try_cast(match_id as bigint) as id, '22' as game_mode, match_id % 5 <> 0 as present,
  case when match_id % 3 = 0 then 2 else 0 end as leaver from match_rows where match_id % 4 = 0)"""


@register(
    "nrm_legacy_assessment",
    f"""with {RAW_SQL}, {_DETAIL_SQL}, j as (select d.*, detail.game_mode as dm, present, leaver from dedup d left join detail on d.account_id = detail.account_id and d.id = detail.id)
    select account_id, source_index, id as match_id, array_to_string(list_filter([
      case when coalesce(dm, game_mode) not in ('1', '22') then 'non_standard_mode' end,
      case when leagueid is not null then 'pro_or_league' end,
      case when try_cast(duration as bigint) < 300 then 'invalid_duration' end,
      case when radiant_win is null then 'missing_outcome' end,
      case when present = false then 'player_not_found' end,
      case when leaver not in (0, 1) or leaver_status not in ('0', '1') then 'abandoned' end], lambda r: r is not null), ',') as reasons from j""",
)
def nrm_legacy_assessment(spark, folder):
    m = F.col("match_id")
    detail = (
        matches(spark, folder)
        .where(m % 4 == 0)
        .select(
            "account_id",
            "match_id",
            F.lit("22").alias("game_mode"),
            (m % 5 != 0).alias("player_present"),
            F.when(m % 3 == 0, 2).otherwise(0).cast("bigint").alias("target_leaver_status"),
        )
    )
    assessed = normalize.legacy_assessment(normalize.deduplicate(raw(spark, folder)), detail)
    return assessed.select(
        "account_id", "source_index", "match_id", F.concat_ws(",", "reasons").alias("reasons")
    )


@register(
    "nrm_legacy_summary",
    f"""with {RAW_SQL} select account_id, source_index, id as match_id, try_cast(start_time as bigint) as started_at, try_cast(duration as bigint) as duration_seconds,
      (radiant_win = '1') = (side = 'radiant') as won,
      case when is_roaming = '1' then 'roamer' else ['carry', 'mid', 'offlane', 'soft_support', 'hard_support'][lane_role::int] end as role_hint, 0.86 as role_confidence
    from typed where duration is not null and hero_id is not null and player_slot is not null and radiant_win is not null""",
    "role_confidence",
)
def nrm_legacy_summary(spark, folder):
    return normalize.legacy_summary(normalize.deduplicate(raw(spark, folder))).select(
        "account_id",
        "source_index",
        "match_id",
        "started_at",
        "duration_seconds",
        "won",
        "role_hint",
        "role_confidence",
    )


@register(
    "nrm_steam_ids",
    """select c_custkey::bigint as custkey, case when c_custkey % 9 = 0 or c_custkey % 7 = 0 then null else c_custkey::bigint end as account_id from customer""",
)
def nrm_steam_ids(spark, folder):
    key = F.col("c_custkey").cast("decimal(20,0)")
    steam = (
        F.when(F.col("c_custkey") % 9 == 0, F.lit("not-a-number"))
        .when(F.col("c_custkey") % 7 == 0, F.col("c_custkey").cast("string"))
        .otherwise((key + F.lit(normalize.STEAM_OFFSET).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"))
    )
    return (
        views.table(spark, folder, "customer")
        .select("c_custkey", steam.alias("steam"))
        .select(F.col("c_custkey").cast("bigint").alias("custkey"), normalize.steam_to_account(F.col("steam")).alias("account_id"))
    )
