"""The detail path: participants, events, coverage, roles and match features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitscope.functions.ordered import chunked, is_plain, scan, unchunked
from habitscope.session import cut

ITEM_SLOTS = ("item_0", "item_1", "item_2", "item_3", "item_4", "item_5", "item_neutral")
FAMILIES = (
    "summary",
    "role",
    "economy",
    "outcome",
    "hero_pool",
    "inventory",
    "time_series",
    "events",
    "teamfights",
    "objectives",
    "wards",
)

_LOG = T.ArrayType(
    T.StructType(
        [
            T.StructField("time", T.LongType()),
            T.StructField("unit", T.StringType()),
            T.StructField("victim_account_id", T.LongType()),
            T.StructField("item_id", T.LongType()),
        ]
    )
)
PLAYER = T.StructType(
    [
        T.StructField(n, T.LongType())
        for n in ("account_id", "player_slot", "hero_id", "lane_role", "kills", "deaths", "assists", "last_hits", "denies")
    ]
    + [
        T.StructField(n, T.DoubleType())
        for n in (
            "gold_per_min",
            "xp_per_min",
            "net_worth",
            "gold_spent",
            "hero_damage",
            "tower_damage",
            "hero_healing",
        )
    ]
    + [
        T.StructField(n, T.LongType())
        for n in ("obs_placed", "sen_placed", "party_size", "rank_tier", "leaver_status", *ITEM_SLOTS)
    ]
    + [
        T.StructField(n, _LOG)
        for n in ("kills_log", "buyback_log", "death_log", "deaths_log", "purchase_log", "obs_log", "sen_log")
    ]
)
DETAIL = T.StructType(
    [
        T.StructField(n, T.LongType())
        for n in ("match_id", "start_time", "duration", "game_mode", "lobby_type", "leagueid")
    ]
    + [
        T.StructField("radiant_win", T.BooleanType()),
        T.StructField("patch", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("players", T.ArrayType(PLAYER)),
        T.StructField(
            "objectives",
            T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("time", T.LongType())])),
        ),
        T.StructField("teamfights", T.ArrayType(T.StructType([T.StructField("start", T.LongType())]))),
        T.StructField("radiant_gold_adv", T.ArrayType(T.DoubleType())),
    ]
)

_ZERO = ("kills", "deaths", "assists", "last_hits", "denies", "obs_placed", "sen_placed")
_MEASURES = ("gold_per_min", "xp_per_min", "net_worth", "gold_spent", "hero_damage", "tower_damage", "hero_healing")


def participants(detail: DataFrame) -> DataFrame:
    """One row per match and player; missing counts become zero here, unlike in the history path."""
    p = F.col("p")
    radiant = F.coalesce(p["player_slot"] < 128, F.lit(False))
    return detail.select(
        "match_id",
        "start_time",
        F.coalesce("duration", F.lit(0)).alias("duration_seconds"),
        "game_mode",
        "lobby_type",
        F.coalesce("patch", "version").alias("patch"),
        F.coalesce("radiant_win", F.lit(False)).alias("_rw"),
        F.size(F.coalesce("objectives", F.array().cast(DETAIL["objectives"].dataType))).alias("objective_count"),
        F.size(F.coalesce("teamfights", F.array().cast(DETAIL["teamfights"].dataType))).alias("teamfight_count"),
        F.posexplode("players").alias("player_no", "p"),
    ).select(
        "match_id",
        "start_time",
        "duration_seconds",
        "game_mode",
        "lobby_type",
        "patch",
        "player_no",
        "objective_count",
        "teamfight_count",
        *[p[c].alias(c) for c in ("account_id", "player_slot", "hero_id", "lane_role", "party_size", "rank_tier")],
        F.when(radiant, "radiant").otherwise("dire").alias("side"),
        (F.col("_rw") == radiant).alias("won"),
        *[F.coalesce(p[c], F.lit(0)).alias(c) for c in _ZERO],
        *[F.coalesce(p[c], F.lit(0.0)).alias(c) for c in _MEASURES],
        F.filter(F.array(*[p[c] for c in ITEM_SLOTS]), lambda i: i.isNotNull() & (i != 0)).alias("item_ids"),
        F.transform(
            F.filter(F.coalesce(p["purchase_log"], F.array().cast(_LOG)), lambda e: e["item_id"].isNotNull()),
            lambda e: F.struct(e["item_id"].alias("item_id"), F.coalesce(e["time"], F.lit(0)).alias("time")),
        ).alias("item_timings"),
    )


def events(detail: DataFrame) -> DataFrame:
    """Kill, buyback, death and purchase events, and deaths seen only in another player's kills.

    Players and their logs are written once, since the logs, the kills and the victims are read from them.  The
    logs of a player explode together; the victim's deaths come from an equi-join on (match, victim), so no match
    is ever held in one row group.
    """
    p = F.col("p")
    deaths = F.when(F.size(p["death_log"]) > 0, p["death_log"]).otherwise(p["deaths_log"])
    players = cut(
        detail.select("match_id", F.posexplode("players").alias("player_no", "p")).select(
            "match_id",
            "player_no",
            p["account_id"].alias("account_id"),
            *[p[c].alias(c) for c in ("kills_log", "buyback_log", "purchase_log")],
            deaths.alias("deaths"),
        )
    )
    nothing = F.create_map().cast("map<string,string>")

    def log(kind: str, column: str, payload: Callable[[Column], Column]) -> Column:
        entries = F.transform(
            column,
            lambda e: F.struct(
                F.lit(kind).alias("event_type"), e["time"].alias("time_seconds"), payload(e).alias("payload")
            ),
        )
        return F.coalesce(entries, F.array())

    logs = F.concat(
        log("kill", "kills_log", lambda e: F.create_map(F.lit("victim"), e["unit"])),
        log("buyback", "buyback_log", lambda e: nothing),
        log("death", "deaths", lambda e: F.create_map(F.lit("source"), F.lit("death_log"))),
        log("purchase", "purchase_log", lambda e: F.create_map(F.lit("item_id"), e["item_id"].cast("string"))),
    )
    own = players.select("match_id", "player_no", "account_id", F.explode(logs).alias("e")).select(
        "match_id", "player_no", "account_id", "e.event_type", "e.time_seconds", "e.payload"
    )
    kills = players.select(
        "match_id",
        F.col("player_no").alias("_killer_no"),
        F.col("account_id").alias("_killer"),
        F.explode("kills_log").alias("e"),
    ).select("match_id", "_killer_no", "_killer", F.col("e.victim_account_id").alias("account_id"), "e.time")
    inferred = (
        players.select("match_id", "player_no", "account_id")
        .join(kills, ["match_id", "account_id"])
        .where(F.col("player_no") != F.col("_killer_no"))
        .select(
            "match_id",
            "player_no",
            "account_id",
            F.lit("death").alias("event_type"),
            F.col("time").alias("time_seconds"),
            F.create_map(
                F.lit("killer_account_id"),
                F.col("_killer").cast("string"),
                F.lit("source"),
                F.lit("opponent_kills_log"),
            ).alias("payload"),
        )
    )
    return own.unionByName(inferred)


def coverage(detail: DataFrame) -> DataFrame:
    """Evidence families present per match and player, with the summary and replay means."""
    p = F.col("p")

    def some(*logs: Column) -> Column:
        out = F.lit(False)
        for one in logs:
            out = out | F.coalesce(F.size(one) > 0, F.lit(False))
        return out

    present = {
        "summary": F.lit(True),
        "role": p["lane_role"].isNotNull() | (F.size("players") >= 5),
        "economy": p["gold_per_min"].isNotNull(),
        "outcome": F.col("radiant_win").isNotNull(),
        "hero_pool": p["hero_id"].isNotNull(),
        "inventory": F.coalesce(*[p[c] for c in ITEM_SLOTS[:6]]).isNotNull(),
        "time_series": some(F.col("radiant_gold_adv")),
        "events": some(
            F.col("objectives"),
            p["kills_log"],
            p["death_log"],
            p["deaths_log"],
            p["purchase_log"],
            p["buyback_log"],
        ),
        "teamfights": some(F.col("teamfights")),
        "objectives": some(F.col("objectives")),
        "wards": some(p["obs_log"], p["sen_log"]),
    }
    # The map is short and its keys are fixed: one entry per family.
    by_family = F.create_map(
        *[x for f in FAMILIES for x in (F.lit(f), F.when(present[f], 1.0).otherwise(0.0))]
    )
    return with_coverage_means(
        detail.select("*", F.posexplode("players").alias("player_no", "p")).select(
            "match_id", "player_no", p["account_id"].alias("account_id"), by_family.alias("by_family")
        )
    )


SUMMARY_FAMILIES = FAMILIES[:6]
REPLAY_FAMILIES = FAMILIES[6:]


def with_coverage_means(rows: DataFrame) -> DataFrame:
    def mean(families: tuple[str, ...]) -> Column:
        return sum((F.coalesce(F.try_element_at("by_family", F.lit(f)), F.lit(0.0)) for f in families), F.lit(0.0)) / len(
            families
        )

    return rows.withColumns({"summary_coverage": mean(SUMMARY_FAMILIES), "replay_coverage": mean(REPLAY_FAMILIES)})


def missing_families(required: Column, minimum: float = 1.0) -> Column:
    return F.array_sort(
        F.filter(
            F.array_distinct(required),
            lambda f: F.coalesce(F.try_element_at("by_family", f), F.lit(0.0)) < minimum,
        )
    )


def mean_coverage(rows: DataFrame) -> DataFrame:
    return (
        rows.select("account_id", F.explode("by_family").alias("family", "value"))
        .groupBy("account_id", "family")
        .agg(F.avg("value").alias("coverage"))
    )


def economy_score() -> Column:
    return F.col("net_worth") + F.col("gold_per_min") * 15 + F.col("last_hits") * 4 + F.col("gold_spent") * 0.15


def infer_roles(rows: DataFrame, tie: str = "line_no", hot_rows: int | None = None) -> DataFrame:
    """Position 1 to 5 of each participant from lane role, economy rank and ward rank in the match."""
    keys, one = ("match_id",), F.lit(1).cast("bigint")
    scored = rows.withColumns(
        {
            "_poor": -economy_score(),
            "_rich": economy_score(),
            "_wards": F.col("obs_placed") + F.col("sen_placed"),
        }
    ).withColumn("_few_wards", -F.col("_wards"))
    base = chunked(scored, keys, "_poor", hot_rows)
    plain = is_plain(base)
    by_economy = scan(base, keys, ("_poor", tie), {"_er": ("sum", one), "participants": ("total", one)})
    by_wards = chunked(unchunked(by_economy), keys, "_few_wards", hot_rows, plain)
    ranked = unchunked(scan(by_wards, keys, ("_few_wards", "_rich", tie), {"_sr": ("sum", one)}))
    economy_rank, support_rank = F.col("_er") - 1, F.col("_sr") - 1
    lane, wards = F.col("lane_role"), F.col("_wards")
    parsed, four = lane.isin(1, 2, 3), lane == 4
    supporting = (wards >= 4) | (support_rank == 0)
    four_role = F.when((wards >= 2) | (economy_rank >= 3), 4).otherwise(3)
    support_role = F.when((support_rank == 0) & (economy_rank >= 3), 5).otherwise(4)
    economy_role = F.least(economy_rank + 1, F.lit(5))
    role = F.when(parsed, lane).when(four, four_role).when(supporting, support_role).otherwise(economy_role)
    probability = (
        F.when(parsed, 0.86)
        .when(four, F.when(four_role == 4, 0.70).otherwise(0.58))
        .when(supporting, 0.68)
        .otherwise(F.when(F.col("participants") >= 5, 0.64).otherwise(0.52))
    )
    method = (
        F.when(parsed, "parsed_lane_role")
        .when(four, "parsed_lane_role_plus_signals")
        .when(supporting, "support_signals")
        .otherwise("team_relative_economy_and_support")
    )
    return ranked.withColumns(
        {
            "role": role.cast("bigint"),
            "role_probability": probability,
            "role_method": method,
            "economy_rank": economy_rank,
            "support_rank": support_rank,
        }
    ).drop("_poor", "_rich", "_wards", "_few_wards", "_er", "_sr")


def impact_score() -> Column:
    objectives = F.coalesce(F.col("objective_count"), F.lit(0))
    return (
        F.col("kills")
        + F.col("assists") * 0.45
        + F.col("hero_damage") / 1000
        + F.col("tower_damage") / 800
        + objectives * 0.8
    )


def match_features(rows: DataFrame, event_rows: DataFrame | None = None) -> DataFrame:
    """Derived numbers of each participant row: impact, KDA, efficiency, shares and event counts."""
    if "objective_count" not in rows.columns:
        rows = rows.withColumn("objective_count", F.lit(0))
    out = rows.withColumn("impact_score", impact_score()).withColumns(
        {
            "kda": (F.col("kills") + F.col("assists")) / F.greatest(F.col("deaths"), F.lit(1)),
            "economy_impact_efficiency": F.col("impact_score") / F.greatest(F.col("gold_per_min"), F.lit(1.0)),
            "tower_share_proxy": F.col("tower_damage")
            / F.greatest(F.col("hero_damage") + F.col("tower_damage"), F.lit(1.0)),
            "ward_events": (F.col("obs_placed") + F.col("sen_placed")).cast("double"),
        }
    )
    if event_rows is None:
        return out
    kind, early = F.col("event_type"), F.coalesce("time_seconds", F.lit(9999)) <= 600
    counted = event_rows.groupBy("match_id", "player_no").agg(
        F.count_if(kind == "kill").alias("kill_events"),
        F.count_if(kind == "death").alias("death_events"),
        F.max(F.when((kind == "death") & early, 1.0).otherwise(0.0)).alias("early_death"),
    )
    return out.join(counted, ["match_id", "player_no"], "left").na.fill(0, ["kill_events", "early_death"])
