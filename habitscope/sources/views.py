"""Views that give the driver tables the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 17 traits of the hero dimension, alphabetical.
TRAITS = (
    "burst",
    "complexity",
    "farm_dependency",
    "frontline",
    "global_presence",
    "initiation",
    "micro_intensity",
    "mobility",
    "pickoff",
    "push",
    "repositioning",
    "save",
    "scaling",
    "sustain",
    "sustained_damage",
    "teamfight",
    "wave_clear",
)
VIEW_ROLES = ("carry", "mid", "offlane", "soft_support", "hard_support")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def match_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The events table in the shape of a cleaned match history."""
    key = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    role = (
        F.when(kind == "signup", "carry")
        .when(kind == "view", "mid")
        .when(kind == "click", "offlane")
        .when(kind == "purchase", "jungle")
        .otherwise("roamer")
    )
    event = F.col("event_id").cast("bigint")
    return (
        table(spark, folder, "events")
        .select(
            (event + 1).alias("match_id"),
            F.col("user_id").cast("bigint").alias("account_id"),
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("started_at"),
            (F.lit(600) + F.floor(F.col("value") * 30).cast("int") % 3000).cast("bigint").alias("duration_seconds"),
            (key % 20 + 1).cast("bigint").alias("hero_id"),
            role.alias("role_hint"),
            F.when(role == "roamer", 0.72).otherwise(0.86).alias("role_confidence"),
            ((event * 7919 + key) % 5 < 2).alias("won"),
            ((event * 31) % 13).cast("bigint").alias("kills"),
            ((event * 17) % 11).cast("bigint").alias("deaths"),
            ((event * 13) % 17).cast("bigint").alias("assists"),
        )
        .withColumn("ended_at", F.col("started_at") + F.col("duration_seconds"))
    )


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A dirty, loosely typed copy of the match history, with near duplicates."""
    base = match_rows(spark, folder)
    m = F.col("match_id")
    copies = F.filter(
        F.array(
            F.lit(0),
            F.when(m % 7 == 0, F.lit(1)),
            F.when(m % 11 == 0, F.lit(2)),
        ),
        lambda x: x.isNotNull(),
    )
    copy = F.col("copy")
    role = F.col("role_hint")
    return (
        base.withColumn("copy", F.explode(copies))
        .select(
            F.when(m % 997 == 0, F.lit("x")).otherwise(m.cast("string")).alias("match_id"),
            "account_id",
            (m * 4 + copy).alias("source_index"),
            F.when(m % 13 != 0, F.col("started_at")).cast("string").alias("start_time"),
            F.when(m % 17 == 0, -F.col("duration_seconds")).otherwise(F.col("duration_seconds")).cast("string").alias(
                "duration"
            ),
            F.when(m % 31 != 0, F.col("hero_id")).cast("string").alias("hero_id"),
            F.when(m % 37 != 0, F.when(m % 2 == 0, 3).otherwise(130)).cast("string").alias("player_slot"),
            F.when(m % 41 != 0, F.when(m % 2 == 0, F.col("won")).otherwise(~F.col("won")))
            .cast("int")
            .cast("string")
            .alias("radiant_win"),
            F.lit(None).cast("string").alias("won"),
            F.when(m % 19 == 0, "4").otherwise("22").alias("game_mode"),
            F.when(m % 43 == 0, "1").otherwise("7").alias("lobby_type"),
            F.when(copy == 1, None).when(m % 47 == 0, "12.5").otherwise(F.col("kills").cast("string")).alias("kills"),
            F.col("deaths").cast("string").alias("deaths"),
            (F.col("assists") + F.when(copy == 2, 1).otherwise(0)).cast("string").alias("assists"),
            F.when(role == "carry", "1")
            .when(role == "mid", "2")
            .when(role == "offlane", "3")
            .when(role == "jungle", "4")
            .when(role == "roamer", "5")
            .alias("lane_role"),
            F.when(m % 53 == 0, "1").otherwise("0").alias("is_roaming"),
            F.when(m % 23 == 0, "3").otherwise("0").alias("leaver_status"),
            F.when(m % 29 == 0, "65001").alias("leagueid"),
            F.when(m % 59 == 0, F.lit("999999")).otherwise(F.col("account_id").cast("string")).alias("row_account_id"),
        )
    )


def detail_rows(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem, orders and part in the shape of the participants of matches.

    Orders are met last and by ``match_id``: the passes by match that follow need no shuffle of the wide rows.
    """
    lineitem = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey").cast("bigint") + 1).alias("match_id"),
        "l_suppkey",
        "l_partkey",
        "l_linenumber",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
    )
    orders = table(spark, folder, "orders").select(
        (F.col("o_orderkey").cast("bigint") + 1).alias("match_id"), "o_orderstatus", "o_orderdate"
    )
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_brand")
    price, quantity = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    order, line = F.col("match_id") - 1, F.col("l_linenumber").cast("bigint")
    part_key, supplier = F.col("l_partkey").cast("bigint"), F.col("l_suppkey").cast("bigint")
    return (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, "match_id")
        .select(
            "match_id",
            (supplier + 1).alias("account_id"),
            line.alias("line_no"),
            (part_key % 20 + 1).alias("hero_id"),
            F.nullif(part_key % 6, F.lit(0)).alias("lane_role"),
            price.alias("net_worth"),
            (quantity * 12).alias("gold_per_min"),
            (quantity * 14).alias("xp_per_min"),
            (quantity * 5).cast("bigint").alias("last_hits"),
            (price * 0.9).alias("gold_spent"),
            (part_key % 5).alias("obs_placed"),
            (supplier % 3).alias("sen_placed"),
            ((part_key * 7) % 15).alias("kills"),
            ((order * 5 + line) % 11).alias("deaths"),
            ((supplier * 3 + line) % 21).alias("assists"),
            (price * (1 - F.col("l_discount").cast("double"))).alias("hero_damage"),
            (quantity * 60).alias("tower_damage"),
            ((F.col("p_size").cast("bigint") % 8) * 10).alias("rank_tier"),
            F.col("p_brand").alias("patch"),
            (F.col("o_orderstatus") == "F").alias("won"),
            (F.lit(1200) + (order * 37) % 2400).alias("duration_seconds"),
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("start_time"),
        )
    )


def trait_map(hero: Column) -> Column:
    """Generated trait values of a hero id."""
    return F.map_from_arrays(
        F.array(*[F.lit(t) for t in TRAITS]),
        F.array(*[((hero * 37 + F.lit(i * 53)) % 101) / F.lit(100.0) for i in range(len(TRAITS))]),
    )


def as_heroes(ids: DataFrame) -> DataFrame:
    """Trait map, review status and role for every ``hero_id``."""
    hero = F.col("hero_id")
    return ids.select(
        "hero_id",
        trait_map(hero).alias("traits"),
        F.when(hero % 10 == 0, "unreviewed").otherwise("reviewed").alias("review_status"),
        F.element_at(F.array(*[F.lit(r) for r in VIEW_ROLES]), (hero % 5 + 1).cast("int")).alias("role"),
        F.lit(True).alias("available"),
    )


def hero_traits(spark: SparkSession, heroes: int = 20) -> DataFrame:
    """The generated hero dimension: one row per hero with a trait map and a role."""
    return as_heroes(spark.range(1, heroes + 1).withColumnRenamed("id", "hero_id"))


def part_heroes(spark: SparkSession, folder: str) -> DataFrame:
    """The part table as a roster of heroes, for the jobs that derive and check hero records."""
    return as_heroes(table(spark, folder, "part").select(F.col("p_partkey").cast("bigint").alias("hero_id")))


def hero_knowledge(heroes: DataFrame) -> DataFrame:
    """The dimension of generated heroes: fixed rules give their records demand, support and confidence bands."""
    from habitscope.constants import DEMANDS
    from habitscope.sources.heroes import knowledge, structural

    hero = F.col("hero_id")
    bands = F.array(*[F.lit(b) for b in ("low", "medium", "low", "high", "unknown", "low", "medium")])
    demands = F.array(*[F.element_at(bands, ((hero * 3 + i * 5) % 7 + 1).cast("int")) for i in range(len(DEMANDS))])
    reviewed = (
        structural(heroes)
        .drop("review_status")
        .join(heroes.select("hero_id", "review_status"), "hero_id")
        .select(
            "hero_id",
            "review_status",
            "primary_functions",
            "secondary_functions",
            F.map_from_arrays(F.array(*[F.lit(d) for d in DEMANDS]), demands).alias("demands"),
            "position_credibility",
            F.when(hero % 3 == 0, "high").when(hero % 3 == 1, "medium").otherwise("low").alias("empirical_support"),
            F.when(hero % 4 == 0, "medium").otherwise("high").alias("confidence"),
        )
    )
    return knowledge(heroes, reviewed)
