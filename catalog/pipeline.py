"""Nested detail documents, stores, and the account and deep reports."""

from uuid import uuid4

from pyspark.sql import functions as F

from catalog.base import GAP, MATCH_ROWS, WINDOW_END, canonical_sql, matches, measured, register
from catalog.deep import _plan
from catalog.detail import DETAIL_SQL, rows
from catalog.elements import familiar_sql
from catalog.heroes import KNOW_SQL, ROSTER, knowledge, traits
from habitscope.operators import detectors
from habitscope.operators import knowledge as K
from habitscope.operators import matches as M
from habitscope.operators import portfolio
from habitscope.plans import report
from habitscope.session import checkpoint_folder, cut, new_folder
from habitscope.sources import store, views

# Nested documents ----------------------------------------------------------------------------


def documents(spark, folder):
    """Match documents with their players and logs; a match of the source has a handful of players."""
    victim = F.col("account_id") % 100 + 1
    none = F.lit(None).cast("bigint")

    def log(count, time, victim_id, item):
        return F.transform(
            F.slice(F.sequence(F.lit(0), F.lit(6)), 1, F.greatest(count, F.lit(0)).cast("int")),
            lambda i: F.struct(
                (time + i * 60).cast("bigint").alias("time"),
                F.lit(None).cast("string").alias("unit"),
                victim_id.alias("victim_account_id"),
                item.alias("item_id"),
            ),
        )

    empty = F.array().cast(M.PLAYER["kills_log"].dataType)
    values = {
        "player_slot": F.when(F.col("player_no") % 2 == 1, F.col("player_no")).otherwise(F.col("player_no") + 128),
        "denies": none,
        "hero_healing": F.lit(None).cast("double"),
        "party_size": none,
        "leaver_status": none,
        **{f"item_{i}": F.nullif((F.col("hero_id") * 3 + i * F.col("line_no")) % 5, F.lit(0)) for i in range(6)},
        "item_neutral": none,
        "kills_log": log(F.col("kills") % 3, F.lit(300) + F.col("line_no") * 90, victim, none),
        "buyback_log": log(F.col("deaths") % 2, F.lit(1500), none, none),
        "death_log": F.when(F.col("deaths") % 4 == 0, log(F.col("deaths") % 5, F.lit(400), none, none)).otherwise(empty),
        "deaths_log": empty,
        "purchase_log": log(F.col("obs_placed") % 3, F.lit(60), none, F.col("hero_id") + 100),
        "obs_log": log(F.col("obs_placed") % 2, F.lit(30), none, none),
        "sen_log": empty,
    }
    player = F.struct(
        *[
            values.get(f.name, F.col(f.name) if f.name not in values else None).cast(f.dataType).alias(f.name)
            for f in M.PLAYER.fields
        ]
    )
    base = rows(spark, folder)
    return base.groupBy("match_id").agg(
        F.first("start_time").alias("start_time"),
        F.first("duration_seconds").alias("duration"),
        F.lit(22).cast("bigint").alias("game_mode"),
        F.lit(7).cast("bigint").alias("lobby_type"),
        F.lit(None).cast("bigint").alias("leagueid"),
        F.first("won").alias("radiant_win"),
        F.min("patch").alias("patch"),
        F.lit(None).cast("string").alias("version"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("player_no", player.alias("p")))), lambda s: s["p"]
        ).alias("players"),
        F.when(F.first("duration_seconds") > 2400, F.array(F.struct(F.lit("tower").alias("type"), F.lit(900).cast("bigint").alias("time")))).alias("objectives"),
        F.lit(None).cast(M.DETAIL["teamfights"].dataType).alias("teamfights"),
        F.when(F.col("match_id") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0))).alias("radiant_gold_adv"),
    )


_ITEMS = " + ".join(f"(((hero_id * 3 + {i} * line_no) % 5) <> 0)::int" for i in range(6))


@register(
    "nrm_participants",
    f"""with {DETAIL_SQL} select match_id, player_no - 1 as player_no, account_id, kills, deaths, net_worth, won = (player_no % 2 = 1) as won,
      case when player_no % 2 = 1 then 'radiant' else 'dire' end as side, ({_ITEMS})::bigint as items, (obs_placed % 3)::bigint as timings from dr""",
    "net_worth",
)
def nrm_participants(spark, folder):
    return M.participants(documents(spark, folder)).select(
        "match_id",
        "player_no",
        "account_id",
        "kills",
        "deaths",
        "net_worth",
        "won",
        "side",
        F.size("item_ids").alias("items"),
        F.size("item_timings").alias("timings"),
    )


def written_lines(frame, identity, breaks):
    """Path of a text file with one JSON document per row, some of them broken by the rest of their id by 41.

    The folder is the one that all executors share.  Field names repeat in every line, so the files are compressed;
    such a file is read by one task, so none holds more than 50,000 lines.
    """
    rest = F.col(identity) % 41
    text = F.to_json(F.struct(*[F.when(rest == 1, None).otherwise(F.col(c)).alias(c) if c == identity else F.col(c) for c in frame.columns]))
    line = F.when(rest == 0, F.substr(text, F.lit(1), F.length(text) - 9)).when(rest == 2, F.concat(F.lit("["), text, F.lit("]")))
    for value, change in breaks.items():
        line = line.when(rest == value, change(text))
    path = f"{checkpoint_folder(frame.sparkSession)}/lines-{uuid4().hex}"
    lines = frame.select(line.otherwise(text).alias("value"))
    lines.write.option("maxRecordsPerFile", 50_000).text(path, compression="gzip")
    return path


def match_documents(spark, folder):
    breaks = {
        3: lambda t: F.replace(t, F.lit('"players":['), F.lit('"players":"none","other":[')),
        4: lambda t: F.regexp_replace(t, r'"duration":\d+', '"duration":"long"'),
        5: lambda t: F.lit("  "),
        6: lambda t: F.regexp_replace(t, r'"kills":\d+', '"kills":[1]'),
    }
    path = written_lines(documents(spark, folder), "match_id", breaks)
    return store.read_documents(spark, path, M.DETAIL, "match_id", ["players"])


@register(
    "src_match_documents",
    f"""with {DETAIL_SQL} select match_id, player_no - 1 as player_no, account_id, hero_id, case when match_id % 41 <> 6 then kills else 0 end as kills, deaths, net_worth,
      won = (player_no % 2 = 1) as won, case when match_id % 41 <> 4 then duration_seconds else 0 end as duration_seconds, ({_ITEMS})::bigint as items
    from dr where match_id % 41 not in (0, 1, 2, 3, 5)""",
    "net_worth",
)
def src_match_documents(spark, folder):
    read = match_documents(spark, folder).where("usable")
    return M.participants(read).select(
        "match_id",
        "player_no",
        "account_id",
        "hero_id",
        "kills",
        "deaths",
        "net_worth",
        "won",
        "duration_seconds",
        F.size("item_ids").alias("items"),
    )


@register(
    "src_match_ledger",
    f"""with {DETAIL_SQL}, m as (select distinct match_id % 41 as r, match_id from dr),
    p as (select case r when 0 then 'not_json' when 1 then 'no_match_id' when 2 then 'not_an_object' when 3 then 'no_players' when 4 then 'wrong_type' when 5 then 'blank' when 6 then 'wrong_type' else 'none' end as problem from m)
    select problem, problem in ('none', 'wrong_type') as usable, count(*) as documents from p group by 1, 2""",
)
def src_match_ledger(spark, folder):
    return store.document_ledger(match_documents(spark, folder))


def roster_documents(spark, folder):
    """Hero documents made of parts: one ability for each word of the name, two values each."""
    key = F.col("p_partkey").cast("bigint")

    def ability(word, i):
        values = F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    F.array((F.col("p_size") * scale + i).cast("double")).alias("values_float"),
                    F.lit(False).alias("is_percentage"),
                )
                for name, scale in (("radius", 10), ("duration", 1))
            ]
        )
        return F.struct((key * 10 + i).alias("id"), word.alias("name"), F.initcap(word).alias("name_loc"), values.alias("special_values"))

    heroes = views.table(spark, folder, "part").select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("name_loc"),
        (key % 5).alias("primary_attr"),
        (key % 3 + 1).alias("complexity"),
        F.array(*[(key + i) % 3 for i in range(4)]).alias("role_levels"),
        (F.col("p_size") * 20).cast("double").alias("max_health"),
        F.transform(F.split("p_name", " "), ability).alias("abilities"),
        F.array(F.struct(F.col("p_type").alias("name"))).alias("facets"),
    )
    breaks = {4: lambda t: F.regexp_replace(t, r'"complexity":\d', '"complexity":"high"')}
    path = written_lines(heroes, "id", breaks)
    return store.read_documents(spark, path, K.HERO_DETAIL, "id", ["abilities"])


@register(
    "src_roster_documents",
    """select p_partkey as hero_id, p_name as internal_name, p_brand as display_name,
      case p_partkey % 5 when 0 then 'strength' when 1 then 'agility' when 2 then 'intelligence' when 3 then 'universal' end as primary_attribute,
      case when p_partkey % 41 <> 4 then p_partkey % 3 + 1 end as complexity,
      array_to_string(list_transform(list_filter([0, 1, 2, 3], lambda i: (p_partkey + i) % 3 > 0), lambda i: ['Carry', 'Support', 'Nuker', 'Disabler'][i + 1]), ',') as roles,
      array_to_string(string_split(p_name, ' '), ',') as abilities,
      len(string_split(p_name, ' ')) * p_size * 10 + len(string_split(p_name, ' ')) * (len(string_split(p_name, ' ')) - 1) // 2 as radius, p_type as facets, p_size * 20 as max_health
    from part where p_partkey % 41 not in (0, 1, 2)""",
    "radius max_health",
)
def src_roster_documents(spark, folder):
    heroes = K.hero_mechanics(roster_documents(spark, folder).where("usable"))
    radius = F.aggregate("abilities", F.lit(0.0), lambda t, a: t + a["special_values"]["radius"][0])
    return heroes.select(
        "hero_id",
        "internal_name",
        "display_name",
        "primary_attribute",
        "complexity",
        F.concat_ws(",", "roles").alias("roles"),
        F.concat_ws(",", F.transform("abilities", lambda a: a["internal_name"])).alias("abilities"),
        radius.alias("radius"),
        F.concat_ws(",", "facets").alias("facets"),
        F.col("base_stats.max_health").alias("max_health"),
    )


@register(
    "src_roster_ledger",
    """with p as (select case p_partkey % 41 when 0 then 'not_json' when 1 then 'no_id' when 2 then 'not_an_object' when 4 then 'wrong_type' else 'none' end as problem from part)
    select problem, problem in ('none', 'wrong_type') as usable, count(*) as documents from p group by 1, 2""",
)
def src_roster_ledger(spark, folder):
    return store.document_ledger(roster_documents(spark, folder))


@register(
    "nrm_events",
    f"""with {DETAIL_SQL}, k as (select match_id, player_no, account_id, account_id % 100 + 1 as victim, unnest(range(kills % 3)) as i from dr),
    e as (select match_id, player_no, 'kill' as event_type, count(*) as n from k group by 1, 2
      union all select match_id, player_no, 'buyback', 1 from dr where deaths % 2 = 1
      union all select match_id, player_no, 'death', deaths % 5 from dr where deaths % 4 = 0 and deaths % 5 > 0
      union all select match_id, player_no, 'purchase', obs_placed % 3 from dr where obs_placed % 3 > 0
      union all select v.match_id, v.player_no, 'death', count(*) from dr v join k on k.match_id = v.match_id and k.victim = v.account_id and k.player_no <> v.player_no group by 1, 2)
    select match_id, player_no - 1 as player_no, event_type, sum(n)::bigint as events from e group by 1, 2, 3""",
)
def nrm_events(spark, folder):
    return (
        M.events(documents(spark, folder))
        .groupBy("match_id", "player_no", "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@register(
    "nrm_coverage",
    f"""with {DETAIL_SQL}, c as (select *, count(*) over (partition by match_id) as np from dr)
    select match_id, player_no - 1 as player_no, (1 + (lane_role is not null or np >= 5)::int + 1 + 1 + 1 + (({_ITEMS}) > 0)::int) / 6 as summary_coverage,
      ((match_id % 2 = 0)::int + (duration_seconds > 2400 or kills % 3 > 0 or (deaths % 4 = 0 and deaths % 5 > 0) or obs_placed % 3 > 0 or deaths % 2 = 1)::int
       + (duration_seconds > 2400)::int + (obs_placed % 2 > 0)::int) / 5 as replay_coverage from c""",
    "summary_coverage replay_coverage",
)
def nrm_coverage(spark, folder):
    return M.coverage(documents(spark, folder)).select(
        "match_id", "player_no", "summary_coverage", "replay_coverage"
    )


@register(
    "nrm_missing_families",
    f"""with {DETAIL_SQL} select match_id, player_no - 1 as player_no, concat_ws(',', case when not (duration_seconds > 2400 or kills % 3 > 0 or (deaths % 4 = 0 and deaths % 5 > 0) or obs_placed % 3 > 0 or deaths % 2 = 1) then 'events' end,
      case when match_id % 2 <> 0 then 'time_series' end) as missing from dr""",
)
def nrm_missing_families(spark, folder):
    required = F.array(F.lit("summary"), F.lit("time_series"), F.lit("events"))
    return M.coverage(documents(spark, folder)).select(
        "match_id", "player_no", F.concat_ws(",", M.missing_families(required)).alias("missing")
    )


@register(
    "nrm_mean_coverage",
    f"""with {DETAIL_SQL}, c as (select account_id, avg((match_id % 2 = 0)::int) as time_series, avg((obs_placed % 2 > 0)::int) as wards from dr group by 1)
    select account_id, 'time_series' as family, time_series as coverage from c union all select account_id, 'wards', wards from c""",
    "coverage",
)
def nrm_mean_coverage(spark, folder):
    return M.mean_coverage(M.coverage(documents(spark, folder))).where(F.col("family").isin("time_series", "wards"))


@register(
    "agg_event_features",
    f"""with {DETAIL_SQL}, k as (select match_id, player_no, account_id % 100 + 1 as victim, 300 + line_no * 90 + i * 60 as t from (select *, unnest(range(kills % 3)) as i from dr)),
    v as (select d.match_id, d.player_no, count(*) as n, max((k.t <= 600)::int) as early from dr d join k on k.match_id = d.match_id and k.victim = d.account_id and k.player_no <> d.player_no group by 1, 2),
    m as (select match_id, any_value(duration_seconds) as dur from dr group by 1)
    select d.match_id, d.player_no - 1 as player_no, kills + assists * 0.45 + hero_damage / 1000 + tower_damage / 800 + case when dur > 2400 then 0.8 else 0 end as impact_score, (kills % 3)::bigint as kill_events,
      case when kills % 3 > 0 or deaths % 2 = 1 or (deaths % 4 = 0 and deaths % 5 > 0) or obs_placed % 3 > 0 or v.n > 0 then (case when deaths % 4 = 0 then deaths % 5 else 0 end + coalesce(v.n, 0))::bigint end as death_events,
      case when (deaths % 4 = 0 and deaths % 5 > 0) or v.early = 1 then 1.0 else 0.0 end as early_death
    from dr d join m using (match_id) left join v on v.match_id = d.match_id and v.player_no = d.player_no""",
    "impact_score early_death",
)
def agg_event_features(spark, folder):
    # Read for the participants and for the events; each would else join, number and gather the players again.
    docs = cut(documents(spark, folder))
    return M.match_features(M.participants(docs), M.events(docs)).select(
        "match_id", "player_no", "impact_score", "kill_events", "death_events", "early_death"
    )


@register(
    "knw_hero_mechanics",
    """with r as (select p_partkey, unnest(['Carry', 'Support', 'Nuker', 'Disabler', 'Jungler', 'Durable', 'Escape', 'Pusher', 'Initiator']) as role, unnest(range(9)) as i from part),
    g as (select p_partkey, string_agg(role, ',' order by i) filter ((p_partkey + i) % 3 > 0) as roles from r group by 1)
    select p_partkey as hero_id, ['strength', 'agility', 'intelligence', 'universal'][p_partkey % 4 + 1] as primary_attribute, roles, 'ability_' || p_partkey as ability, p_size::double as size_value, p_brand as facet
    from part join g using (p_partkey)""",
    "size_value",
)
def knw_hero_mechanics(spark, folder):
    """Hero documents in the shape of the roster source, one per part."""
    key = F.col("p_partkey").cast("bigint")
    ability = F.struct(
        key.alias("id"),
        F.concat(F.lit("ability_"), key.cast("string")).alias("name"),
        F.col("p_name").alias("name_loc"),
        F.col("p_type").alias("desc_loc"),
        F.lit(True).alias("ability_has_scepter"),
        F.lit(False).alias("ability_has_shard"),
        F.array(
            F.struct(
                F.lit("size").alias("name"),
                F.array(F.col("p_size").cast("double")).alias("values_float"),
                F.lit(False).alias("is_percentage"),
            )
        ).alias("special_values"),
    )
    docs = views.table(spark, folder, "part").select(
        key.alias("id"),
        F.concat(F.lit("hero_"), key.cast("string")).alias("name"),
        F.col("p_name").alias("name_loc"),
        (key % 4).alias("primary_attr"),
        (key % 3 + 1).alias("complexity"),
        F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (key + i) % 3).alias("role_levels"),
        F.lit(600.0).alias("max_health"),
        F.lit(3.0).alias("armor"),
        F.array(ability).alias("abilities"),
        F.array(ability).alias("talents"),
        F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_brand").alias("title_loc"))).alias("facets"),
    )
    table = K.hero_mechanics(docs)
    return table.select(
        "hero_id",
        "primary_attribute",
        F.concat_ws(",", "roles").alias("roles"),
        F.element_at("abilities", 1)["internal_name"].alias("ability"),
        F.element_at(F.element_at(F.element_at("abilities", 1)["special_values"], "size"), 1).alias("size_value"),
        F.element_at("facets", 1).alias("facet"),
    )


# Stores --------------------------------------------------------------------------------------

NOW = 1706659200


def payloads(spark, folder):
    """Raw payloads with repeats: several events of a user carry the same content."""
    event = views.table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    return event.select(
        F.concat(F.lit("/players/"), F.col("user_id").cast("string")).alias("endpoint"),
        F.col("event_type").alias("source_id"),
        F.create_map(F.lit("k"), k, F.lit("type"), F.col("event_type")).alias("payload"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("fetched_at"),
        F.col("event_id"),
    )


_PAY = """p as (select '/players/' || user_id as endpoint, event_type as source_id, json_extract_string(props, '$.k') as k, epoch_us(ts) // 1000000 as fetched_at,
  sha256('[{"key":"k","value":"' || json_extract_string(props, '$.k') || '"},{"key":"type","value":"' || event_type || '"}]') as payload_hash from events)"""


@register(
    "snk_new_payloads",
    f"""with {_PAY}, n as (select endpoint, source_id, payload_hash, any_value(k) as k, min(fetched_at) as fetched_at from p group by 1, 2, 3)
    select n.* from n where not exists (select 1 from p where p.fetched_at < {NOW - 20 * 86400} and p.endpoint = n.endpoint and p.source_id = n.source_id and p.payload_hash = n.payload_hash)""",
)
def snk_new_payloads(spark, folder):
    """Every event comes in; what was fetched before the last 20 days is stored already."""
    rows_ = payloads(spark, folder)
    stored = rows_.where(F.col("fetched_at") < NOW - 20 * 86_400).withColumn("payload_hash", store.payload_hash(F.col("payload")))
    fresh = store.new_payloads(rows_, stored)
    return fresh.select("endpoint", "source_id", "payload_hash", F.col("payload")["k"].alias("k"), "fetched_at")


@register(
    "snk_latest_payload",
    f"""with {_PAY} select endpoint, source_id, arg_max(payload_hash, (fetched_at, payload_hash)) as payload_hash, max(fetched_at) as fetched_at
    from p where fetched_at >= {NOW - 5 * 86400} group by 1, 2""",
)
def snk_latest_payload(spark, folder):
    rows_ = payloads(spark, folder).withColumn("payload_hash", store.payload_hash(F.col("payload")))
    return store.latest_payload(rows_, NOW, 5 * 86_400)


def _report_rows(spark, folder):
    order = F.col("o_orderkey").cast("bigint")
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return views.table(spark, folder, "orders").select(
        order.alias("report_id"),
        F.col("o_custkey").cast("bigint").alias("account_id"),
        F.concat(F.lit("model-"), (order % 3).cast("string")).alias("fingerprint"),
        F.lit("free").alias("mode"),
        (order % 2).cast("string").alias("history_hash"),
        F.lit("id").alias("identity"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        created.alias("created_at"),
        F.when(order % 5 == 0, created + 86_400 * 30).alias("expires_at"),
    )


_REP = """r as (select o_orderkey as report_id, o_custkey as account_id, 'model-' || (o_orderkey % 3) as fingerprint, (o_orderkey % 2)::varchar as history_hash, o_orderstatus = 'F' as done,
  epoch_us(o_orderdate) // 1000000 as created_at, case when o_orderkey % 5 = 0 then epoch_us(o_orderdate) // 1000000 + 2592000 end as expires_at from orders),
t as (select max(created_at) as now from r)"""


def _at_now(table, spark, folder):
    """The table with the time of the newest report in a column, from a one-row aggregate."""
    newest = _report_rows(spark, folder).agg(F.max("created_at").alias("now"))
    return table.join(F.broadcast(newest), F.lit(True))


@register(
    "snk_purge",
    f"""with {_REP} select report_id from r, t where not coalesce(expires_at <= now or created_at < now - 31536000, created_at < now - 31536000)""",
)
def snk_purge(spark, folder):
    table = _at_now(_report_rows(spark, folder), spark, folder)
    evidence = table.select("report_id", F.lit("e").alias("evidence"))
    stored = _at_now(payloads(spark, folder), spark, folder)
    kept, kept_evidence, _, _ = store.purge(table, evidence, stored, F.col("now"), 31_536_000)
    return kept.join(kept_evidence, "report_id").select("report_id")


@register(
    "snk_purge_counts",
    f"""with {_REP}, {_PAY}
    select 'reports' as "table", count(*) as rows from r, t where expires_at <= now or created_at < now - 31536000
    union all select 'payloads', count(*) from p, t where fetched_at < now - 31536000""",
)
def snk_purge_counts(spark, folder):
    """How many rows of each table go."""
    table = _at_now(_report_rows(spark, folder), spark, folder)
    stored = _at_now(payloads(spark, folder), spark, folder)
    return store.purge(table, table.select("report_id"), stored, F.col("now"), 31_536_000)[3]


@register(
    "snk_partitions",
    "select event_id, case when event_type = 'error' then 0 else value end as value, event_type from events",
)
def snk_partitions(spark, folder):
    """Events written in one folder a type; a second write replaces the folder of one type and no other."""
    path = new_folder(spark, "events")
    rows = views.table(spark, folder, "events").select("event_id", "value", "event_type")
    store.write_table(rows, path, partition="event_type", files_by="event_id")
    again = rows.where(F.col("event_type") == "error").withColumn("value", F.lit(0.0))
    store.write_table(again, path, partition="event_type", files_by="event_id")
    return spark.read.schema(rows.schema).parquet(path)


@register(
    "snk_reusable",
    f"""with {_REP}, w as (select c_custkey as account_id from customer)
    select w.account_id, arg_max(report_id, (created_at, report_id)) as report_id, max(created_at) as created_at from w join r using (account_id), t
    where fingerprint = 'model-1' and history_hash = '1' and done and created_at >= now - 63072000 group by 1""",
)
def snk_reusable(spark, folder):
    wanted = views.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("bigint").alias("account_id"),
        F.lit("model-1").alias("fingerprint"),
        F.lit("free").alias("mode"),
        F.lit("1").alias("history_hash"),
        F.lit("id").alias("identity"),
    )
    found = store.reusable(wanted, _at_now(_report_rows(spark, folder), spark, folder), F.col("now"), 63_072_000)
    return found.select("account_id", "report_id", "created_at")


_HISTORY = ("match_id", "started_at", "hero_id", "won", "kills", "deaths", "assists")


@register(
    "snk_history_hash",
    f"""with {MATCH_ROWS}, d as (select account_id, sha256({canonical_sql({c: f"({c})::varchar" for c in _HISTORY})}) as d from match_rows),
    e as (select account_id, d, count(*) as c from d group by 1, 2)
    select account_id, sum(c)::bigint as rows, sha256(string_agg(d || ':' || c, '|' order by d)) as history_hash from e group by 1""",
)
def snk_history_hash(spark, folder):
    """The digest of the rows in another order and other partitions."""
    return store.history_hash(matches(spark, folder).repartition(5, "match_id"), _HISTORY)


# Reports -------------------------------------------------------------------------------------


@register(
    "out_tiers",
    f"""with {MATCH_ROWS} select account_id, count(*) as rows, case when count(*) < 30 then 'rejected' when count(*) < 60 then 'limited' else 'normal' end as tier from match_rows group by 1""",
)
def out_tiers(spark, folder):
    return report.tiers(matches(spark, folder))


def _analysis(spark, folder):
    return report.analyse(
        matches(spark, folder), views.hero_traits(spark, ROSTER), knowledge(spark, ROSTER), WINDOW_END, GAP, (360, GAP, 1440)
    )


@register("out_elements")
def out_elements(spark, folder):
    return _analysis(spark, folder)["elements"]


@register("out_pattern_actions")
def out_pattern_actions(spark, folder):
    """All eleven patterns over scored elements, with what stands behind the qualified ones."""
    table = _analysis(spark, folder)["patterns"]
    return table.select(
        "account_id",
        "pattern",
        "status",
        "action_status",
        "outcome",
        "recommendation",
        F.col("action.action_confidence").alias("action_confidence"),
    )


@register("out_reports")
def out_reports(spark, folder):
    table = report.reports(_analysis(spark, folder), secret="catalog")
    return table.select(
        "account_id",
        "report_id",
        "tier",
        F.to_json("quality").alias("quality"),
        F.size("elements").alias("elements"),
        F.size("patterns").alias("patterns"),
        F.to_json("pattern_highlights").alias("pattern_highlights"),
        F.to_json("evolution").alias("evolution"),
    )


_SCORED = canonical_sql({c: f"({c})::varchar" for c in report.HISTORY_COLUMNS})


@register(
    "out_coverage",
    f"""with {measured()}, kept as (select *, count(*) over (partition by account_id) as n from perf qualify n >= 30),
    hc as (select account_id, hero_id, count(*) as c, any_value(n) as n from kept group by 1, 2), fam as ({familiar_sql('hc', 5, True)}),
    d as (select account_id, sha256({_SCORED}) as d, count(*) as c from kept group by 1, 2), hh as (select account_id, sha256(string_agg(d || ':' || c, '|' order by d)) as history_hash from d group by 1),
    ses as (select account_id, count(*) filter (completed) as completed_sessions, count(*) filter (left_censored) as left_censored_sessions, count(*) filter (right_censored) as right_censored_sessions from sess group by 1),
    a as (select account_id, count(*) as sample_size, count(started_at) as dated_rows, count(role_hint) as role_rows, count(activity) as activity_rows, count(*) as orientation_rows,
      count(performance) filter (fam.hero_id is not null) as familiar_rows, count(performance) filter (fam.hero_id is null) as off_pool_rows, sum(weight) ** 2 / sum(weight ** 2) as effective_sample_size,
      min(started_at) as window_start, max(started_at) as window_end from kept left join fam using (account_id, hero_id) group by 1)
    select *, case when sample_size < 60 then 'limited' else 'normal' end as tier from a join hh using (account_id) join ses using (account_id)""",
    "effective_sample_size",
)
def out_coverage(spark, folder):
    """What each report was scored on: hash of the history, rows and sessions behind it."""
    table = report.reports(_analysis(spark, folder), secret="catalog")
    return table.select("account_id", "tier", "history_hash", "coverage.*")


@register("out_public")
def out_public(spark, folder):
    table = report.public_projection(report.reports(_analysis(spark, folder), secret="catalog"))
    return table.select(
        "report_id", "tier", "overall", F.to_json("elements").alias("elements"), "evolution", "mirror"
    )


@register("out_deep_report")
def out_deep_report(spark, folder):
    table, primary, options, plan = _plan(spark, folder)
    features = table.withColumn("gold_per_min", F.col("kills") * 20 + F.col("assists") * 5)
    # Read for the findings, the state and the report; each would else run the selection again.
    plan = cut(plan)
    findings = detectors.evaluate_hypotheses(primary, plan, options, features)
    out = report.deep_report(plan, findings, state=detectors.plan_state(plan, options, primary))
    return out.select(
        "account_id",
        F.to_json("selection").alias("selection"),
        F.to_json("findings").alias("findings"),
        "stopping_reason",
        "cost",
        F.to_json("open_needs").alias("open_needs"),
    )


@register(
    "pat_job_clusters",
    f"""with {MATCH_ROWS},{KNOW_SQL}, u as (select distinct account_id, hero_id from match_rows),
    c as (select account_id, job, count(*) as hero_count, string_agg(hero_id::varchar, ',' order by hero_id) as heroes from u join hj using (hero_id) join (select hero_id, reviewed from hero) x using (hero_id) where reviewed group by 1, 2)
    select * from (select account_id, job, hero_count, heroes, row_number() over (partition by account_id order by hero_count desc, job) as place from c) where place <= 4""",
)
def pat_job_clusters(spark, folder):
    table = portfolio.job_clusters(matches(spark, folder), knowledge(spark))
    return table.withColumn("heroes", F.concat_ws(",", F.col("heroes").cast("array<string>")))
