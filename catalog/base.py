"""Shared pieces of the registered queries: views, rounding, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitscope.session import cut, tune
from habitscope.sources import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Session gap used on the driver tables, whose events are sparse (FIXTURES.md).
GAP = 720
DAY_GAP = 1440
# End of the history window of the driver tables: 2024-01-31 00:00:00 UTC.
WINDOW_END = 1706659200


def register(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; frames come back with plain bigint, double, string and boolean columns.

    ``doubles`` names the columns that both sides round to six places.
    """

    def wrap(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(build(tune(spark, file_compression=10.0), folder))

        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f"round({c}::double + 1e-9::double, 6) + 0.0::double as {c}" for c in doubles.split())
            ORACLE[name] = f"select * replace ({rounded}) from ({sql}) q" if rounded else sql
        return build

    return wrap


def plain(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # The shift keeps exact halves off the rounding edge; adding zero turns -0.0 into 0.0.
            column = F.round(column.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def matches(spark: SparkSession, folder: str) -> DataFrame:
    return views.match_rows(spark, folder)


MATCH_ROWS = """
match_rows as (
  select *, started_at + duration_seconds as ended_at,
         case when role_hint = 'roamer' then 0.72 else 0.86 end::double as role_confidence
  from (
    select (event_id + 1)::bigint as match_id, user_id::bigint as account_id,
           epoch_us(ts) // 1000000 as started_at,
           (600 + cast(floor(value * 30) as int) % 3000)::bigint as duration_seconds,
           (cast(json_extract_string(props, '$.k') as int) % 20 + 1)::bigint as hero_id,
           case event_type when 'signup' then 'carry' when 'view' then 'mid' when 'click' then 'offlane'
                when 'purchase' then 'jungle' else 'roamer' end as role_hint,
           (event_id * 7919 + cast(json_extract_string(props, '$.k') as int)) % 5 < 2 as won,
           ((event_id * 31) % 13)::bigint as kills, ((event_id * 17) % 11)::bigint as deaths,
           ((event_id * 13) % 17)::bigint as assists
    from events))"""


def sessionized(gap_minutes: int, source: str = "match_rows", name: str = "s") -> str:
    """CTEs that number sessions; the last one is called ``name``."""
    return f"""
{name}_lag as (
  select *, row_number() over o as rn, count(*) over (partition by account_id) as n,
         lag(ended_at) over o as prev_end, lag(started_at) over o is null as is_first,
         lead(started_at) over o as next_start
  from {source} where started_at is not null
  window o as (partition by account_id order by started_at, match_id)),
{name}_mark as (
  select *,
    coalesce((not is_first and (prev_end is null or started_at - prev_end < -300))
      or (next_start is not null and (ended_at is null or next_start - ended_at < -300)), false) as session_corrupt,
    case when is_first or prev_end is null or started_at - prev_end < -300
           or started_at - prev_end > {gap_minutes * 60} then 1 else 0 end as opens
  from {name}_lag),
{name}_num as (
  select *, (sum(opens) over (partition by account_id order by started_at, match_id
             rows unbounded preceding))::bigint as session_no
  from {name}_mark),
{name} as (
  select * exclude (opens, prev_end, is_first, next_start),
         row_number() over (partition by account_id, session_no order by started_at, match_id) as session_index
  from {name}_num)"""


def session_table(gap_minutes: int, rows: str = "s", name: str = "sess", window_end: int | None = WINDOW_END) -> str:
    close = "true" if window_end is None else f"{window_end} - end_time <= {gap_minutes * 60}"
    return f"""
{name}_roll as (
  select account_id, session_no, min(started_at) as start_time,
         greatest(min(started_at), arg_max(coalesce(ended_at, started_at), rn)) as end_time,
         count(*) as match_count, bool_and(session_corrupt) as corrupt,
         sum(session_corrupt::int)::bigint as corrupt_rows, max(rn) = max(n) as is_last
  from {rows} group by account_id, session_no),
{name} as (
  select * exclude (is_last), greatest(0, end_time - start_time) as elapsed_seconds,
         session_no = 1 as left_censored, is_last and {close} as right_censored,
         not (is_last and {close}) and not corrupt as completed
  from {name}_roll)"""


# Leave-one-out statistics by brute force: every other match of the account, per match.
def loo(rows: str, name: str = "perf") -> str:
    return f"""
{name}_rate as (
  select *, case when duration_seconds >= 600 then (kills + assists) / (duration_seconds / 60.0) end as activity,
         case when duration_seconds >= 600 then deaths / (duration_seconds / 600.0) end as death_rate
  from {rows}),
{name}_centre as (
  select a.account_id, a.match_id, median(b.activity) as ac, median(b.death_rate) as dc
  from {name}_rate a left join {name}_rate b on a.account_id = b.account_id and a.match_id <> b.match_id
  group by 1, 2),
{name}_scale as (
  select c.account_id, c.match_id, any_value(c.ac) as ac, any_value(c.dc) as dc,
         coalesce(nullif(median(abs(b.activity - c.ac)), 0), 1) as asc_,
         coalesce(nullif(median(abs(b.death_rate - c.dc)), 0), 1) as dsc
  from {name}_centre c left join {name}_rate b on c.account_id = b.account_id and c.match_id <> b.match_id
  group by 1, 2),
{name}_parts as (
  select r.*, case when r.won then 1.0 else 0.0 end as outcome_component,
    case when activity is null then 0.5 else
      1 / (1 + exp(-greatest(-12.0, least(12.0, (activity - coalesce(ac, 0)) / greatest(asc_, 1e-6))))) end as activity_component,
    case when death_rate is null then 0.5 else
      1 / (1 + exp(-greatest(-12.0, least(12.0, (coalesce(dc, 0) - death_rate) / greatest(dsc, 1e-6))))) end as survival_component
  from {name}_rate r join {name}_scale using (account_id, match_id)),
{name} as (
  select *, case when won is not null and duration_seconds >= 600 then
      greatest(0.0, least(1.0, 0.5 * outcome_component + 0.3 * activity_component + 0.2 * survival_component)) end as performance,
    exp(-0.6931471805599453 * greatest(0.0, ({WINDOW_END} - started_at)::double) / (180.0 * 86400)) as weight
  from {name}_parts)"""


def measured(gap_minutes: int = GAP) -> str:
    """CTEs up to the per-match measure table ``perf`` and the session table ``sess``."""
    return f"{MATCH_ROWS},{sessionized(gap_minutes)},{loo('s')},{session_table(gap_minutes)}"


def measures(spark: SparkSession, folder: str, gap_minutes: int = GAP) -> DataFrame:
    from habitscope.operators.measures import match_measures

    # Many operators read the measure table several times; it is written once.
    return cut(match_measures(matches(spark, folder), gap_minutes, WINDOW_END))


def session_rows(rows: DataFrame, gap_minutes: int = GAP) -> DataFrame:
    from habitscope.operators.sessions import sessions_of

    return sessions_of(rows, gap_minutes, WINDOW_END)


def canonical_sql(columns: dict[str, str]) -> str:
    """The canonical text of a row in SQL, from the text of each column by name."""
    parts = [f"coalesce('{c}=' || length({text}) || ':' || {text}, '{c}=~')" for c, text in sorted(columns.items())]
    return " || ',' || ".join(parts)
