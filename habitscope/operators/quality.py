"""Validation as tables of violations, fingerprints and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitscope.functions.digest import content_digest
from habitscope.constants import DEMANDS, JOBS
from habitscope.sources.views import TRAITS

BANDS = ("low", "medium", "high", "unknown")
POSITION_BANDS = ("primary", "secondary", "unsupported", "unknown")


def violations(rows: DataFrame, keys: Sequence[str], checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per broken check; a check that is null counts as kept."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in checks]))
    return rows.select(*keys, F.explode(found).alias("violation"))


def duplicates(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_c"))
        .where(F.col("_c") > 1)
        .select(*keys, F.lit(name).alias("violation"))
    )


def unknown_ids(rows: DataFrame, known: DataFrame, key: str, name: str, report: Sequence[str]) -> DataFrame:
    return rows.join(known.select(F.col("hero_id").alias(key)), key, "left_anti").select(
        *report, F.lit(name).alias("violation")
    )


def count_checks(count: str, wins: str) -> list[tuple[str, Column]]:
    return [
        (f"invalid_{count}", F.col(count).isNull() | (F.col(count) < 0)),
        (f"invalid_{wins}", F.col(wins).isNull() | (F.col(wins) < 0)),
        ("wins_exceed_count", F.col(wins) > F.col(count)),
    ]


def rate_check(column: str) -> tuple[str, Column]:
    return f"{column}_out_of_range", (F.col(column) < 0) | (F.col(column) > 1)


def semantic_layer(records: DataFrame) -> DataFrame:
    """Unapproved records, unknown functions, incomplete or invalid demand and position bands."""
    jobs, demands = F.array(*[F.lit(j) for j in JOBS]), F.array_sort(F.array(*[F.lit(d) for d in DEMANDS]))
    bands, places = F.array(*[F.lit(b) for b in BANDS]), F.array(*[F.lit(b) for b in POSITION_BANDS])
    functions = F.concat("primary_functions", "secondary_functions")
    checks = [
        ("invalid_hero_id", F.col("hero_id").isNull() | (F.col("hero_id") <= 0)),
        ("hero_not_approved", F.col("review_status") != "approved"),
        ("unknown_function", F.exists(functions, lambda f: ~F.array_contains(jobs, f))),
        ("incomplete_demands", F.array_sort(F.map_keys("demands")) != demands),
        ("invalid_demand_band", F.exists(F.map_values("demands"), lambda b: ~F.array_contains(bands, b))),
        ("incomplete_position_credibility", F.size("position_credibility") != 5),
        (
            "invalid_position_credibility",
            F.exists(F.map_values("position_credibility"), lambda b: ~F.array_contains(places, b)),
        ),
        ("invalid_confidence", ~F.col("confidence").isin("high", "medium", "low")),
        ("invalid_empirical_support", ~F.col("empirical_support").isin(*BANDS)),
    ]
    return violations(records, ["hero_id"], checks).unionByName(
        duplicates(records, ["hero_id"], "duplicate_hero_ids")
    )


def roster(rows: DataFrame) -> DataFrame:
    """Missing names, duplicate ids and duplicate internal names."""
    checks = [
        ("invalid_hero_id", F.col("hero_id").isNull() | (F.col("hero_id") <= 0)),
        ("missing_internal_name", F.coalesce("internal_name", F.lit("")) == ""),
        ("missing_display_name", F.coalesce("display_name", F.lit("")) == ""),
        ("missing_abilities", F.coalesce(F.size("abilities"), F.lit(0)) <= 0),
    ]
    same = rows.groupBy("internal_name").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1)
    named = rows.join(same.select("internal_name"), "internal_name", "left_semi")
    return (
        violations(rows, ["hero_id"], checks)
        .unionByName(duplicates(rows, ["hero_id"], "duplicate_hero"))
        .unionByName(named.select("hero_id", F.lit("duplicate_internal_name").alias("violation")))
    )


def aggregates(
    brackets: DataFrame, durations: DataFrame, items: DataFrame, matchups: DataFrame, known: DataFrame
) -> DataFrame:
    """Counts, rates, unknown heroes, unknown and duplicate opponents of the empirical profiles."""

    def section(name: str, frame: DataFrame, checks: list) -> DataFrame:
        return violations(frame, ["hero_id"], checks).withColumn("section", F.lit(name))

    parts = [
        section("brackets", brackets, [*count_checks("picks", "wins"), rate_check("win_rate")]),
        section(
            "durations",
            durations,
            [
                ("invalid_duration", F.col("duration_bin_seconds").isNull() | (F.col("duration_bin_seconds") < 0)),
                *count_checks("games", "wins"),
                rate_check("win_rate"),
            ],
        ),
        section(
            "items",
            items,
            [
                ("invalid_item_id", F.col("item_id").isNull() | (F.col("item_id") <= 0)),
                ("invalid_count", F.col("count").isNull() | (F.col("count") < 0)),
                rate_check("share"),
            ],
        ),
        section(
            "matchups",
            matchups,
            [
                ("invalid_opponent", F.col("opponent_hero_id").isNull() | (F.col("opponent_hero_id") <= 0)),
                *count_checks("games", "wins"),
                rate_check("win_rate"),
            ],
        ),
        unknown_ids(
            matchups.where(F.col("opponent_hero_id") > 0), known, "opponent_hero_id", "unknown_opponent", ["hero_id"]
        ).withColumn("section", F.lit("matchups")),
        duplicates(matchups, ["hero_id", "opponent_hero_id"], "duplicate_opponent")
        .drop("opponent_hero_id")
        .withColumn("section", F.lit("matchups")),
        unknown_ids(brackets.select("hero_id").distinct(), known, "hero_id", "unknown_hero", ["hero_id"]).withColumn(
            "section", F.lit("brackets")
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("section", "hero_id", "violation")


def taxonomy(traits: DataFrame, expected: int | None = None) -> DataFrame:
    names = F.array(*[F.lit(t) for t in TRAITS])
    checks = [
        ("incomplete_traits", F.array_sort(F.map_keys("traits")) != names),
        ("trait_out_of_range", F.exists(F.map_values("traits"), lambda v: (v < 0) | (v > 1))),
        ("missing_review_status", F.coalesce("review_status", F.lit("")) == ""),
    ]
    out = violations(traits, ["hero_id"], checks).unionByName(duplicates(traits, ["hero_id"], "duplicate_hero"))
    if expected is None:
        return out
    short = traits.agg(F.count_distinct("hero_id").alias("n")).where(F.col("n") != expected)
    return out.unionByName(
        short.select(F.lit(None).cast("bigint").alias("hero_id"), F.lit("incomplete_active_roster").alias("violation"))
    )


def fingerprint(spark: SparkSession, versions: dict[str, str]) -> DataFrame:
    """Hash of the sorted version map."""
    pairs = F.array(*[F.concat(F.lit(f"{k}="), F.lit(v)) for k, v in sorted(versions.items())])
    return spark.range(1).select(F.sha2(F.concat_ws("|", pairs), 256).alias("fingerprint"))


def manifest(tables: dict[str, DataFrame], version: str) -> DataFrame:
    """Rows and content digest of every table of a snapshot."""
    out = None
    for name, table in sorted(tables.items()):
        one = content_digest(table).select(
            F.lit(name).alias("table"), "rows", F.col("digest").alias("checksum"), F.lit(version).alias("version")
        )
        out = one if out is None else out.unionByName(one)
    return out
