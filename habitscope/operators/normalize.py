"""Cleaning, typing, de-duplication and eligibility of raw history rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitscope.functions.ordered import chunked, scan, unchunked

# Meaning of the lane role in a history row, and the supported modes and lobbies.
LANE_ROLES = {1: "carry", 2: "mid", 3: "offlane", 4: "jungle", 5: "roamer"}
LEGACY_LANE_ROLES = {1: "carry", 2: "mid", 3: "offlane", 4: "soft_support", 5: "hard_support"}
LEGACY_LANES = {1: "carry", 2: "mid", 3: "offlane"}
GAME_MODES = (1, 22)
LOBBY_TYPES = (0, 7)
ABANDONED = (2, 3, 4, 5)

# The columns of a raw history row; a row may lack any of them.
RAW_COLUMNS = (
    "match_id",
    "start_time",
    "started_at",
    "duration",
    "duration_seconds",
    "hero_id",
    "player_slot",
    "side",
    "radiant_win",
    "won",
    "game_mode",
    "lobby_type",
    "kills",
    "deaths",
    "assists",
    "party_size",
    "lane_role",
    "lane",
    "is_roaming",
    "leaver_status",
    "leagueid",
    "league_id",
    "row_account_id",
    "hero_variant",
    "patch",
    "version",
    "skill",
    "skill_bracket",
    "region",
)
RAW_SUMMARY = T.StructType(
    [T.StructField("account_id", T.LongType()), T.StructField("source_index", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in RAW_COLUMNS]
)
REQUIRED = (
    "match_id",
    "start_time",
    "duration",
    "hero_id",
    "player_slot",
    "radiant_win",
    "won",
    "game_mode",
    "lobby_type",
    "kills",
    "deaths",
    "assists",
)


def as_int(value: Column) -> Column:
    return value.try_cast("bigint")


def as_count(value: Column) -> Column:
    number = as_int(value)
    return F.when(number >= 0, number)


def as_bool(value: Column) -> Column:
    text = F.lower(value.cast("string"))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def with_all_columns(raw: DataFrame) -> DataFrame:
    """Raw rows with all known fields as text; a column of numbers with a fraction loses the fraction."""
    missing = {c: F.lit(None).cast("string") for c in RAW_COLUMNS if c not in raw.columns}
    fractions = (T.DoubleType, T.FloatType, T.DecimalType)
    whole = {
        f.name: F.col(f.name).cast("bigint").cast("string")
        for f in raw.schema.fields
        if f.name in RAW_COLUMNS and isinstance(f.dataType, fractions)
    }
    return raw.withColumns(missing | whole) if missing or whole else raw


def fingerprint(columns: tuple[str, ...] = tuple(sorted(RAW_COLUMNS))) -> Column:
    """Canonical text of a row: its known fields by name."""
    return F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])


def usefulness() -> Column:
    known = sum((F.col(c).isNotNull().cast("int") for c in RAW_COLUMNS), F.lit(0))
    required = sum((F.col(c).isNotNull().cast("int") for c in REQUIRED), F.lit(0))
    return required * 10 + known


def _identified(raw: DataFrame) -> DataFrame:
    return (
        with_all_columns(raw)
        .withColumn("_id", as_int(F.col("match_id")))
        .withColumns({"_fp": fingerprint(), "_score": usefulness()})
    )


def deduplicate(raw: DataFrame) -> DataFrame:
    """One row per account and match: the most useful, then the smallest fingerprint, then the first.

    A minimum over a struct merges before the shuffle, so any number of copies is cheap.
    """
    rows = _identified(raw).where(F.col("_id") > 0)
    rank = F.struct((-F.col("_score")).alias("s"), F.col("_fp").alias("f"), F.col("source_index").alias("i"))
    keep = F.struct("source_index", *RAW_COLUMNS)
    return (
        rows.groupBy("account_id", F.col("_id").alias("_match"))
        .agg(F.min_by(keep, rank).alias("_row"))
        .select("account_id", "_row.*")
    )


def duplicate_conflicts(raw: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Every copy that differs from the winner so far, with both places and the one kept."""
    keys = ("account_id", "_id")
    rows = _identified(raw).where(F.col("_id") > 0).select(*keys, "source_index", "_fp", "_score")
    rank = F.struct((-F.col("_score")).alias("s"), F.col("_fp").alias("f"), F.col("source_index").alias("i"))
    base = chunked(rows.withColumn("_rank", rank), keys, "source_index", hot_rows)
    best = scan(base, keys, ["source_index"], {"_best": ("min", F.col("_rank"))})
    before = scan(best, keys, ["source_index"], {"_before": ("lag", F.col("_best"))})
    return unchunked(before).where(F.col("_before").isNotNull() & (F.col("_before.f") != F.col("_fp"))).select(
        "account_id",
        F.col("_id").alias("match_id"),
        F.col("_before.i").alias("previous_index"),
        "source_index",
        F.col("_best.i").alias("kept_index"),
    )


def role_hint(lane_role: Column, is_roaming: Column) -> tuple[Column, Column]:
    """Role and its confidence; a spatial lane alone never gives a role."""
    named = F.try_element_at(
        F.create_map(*[x for k, v in LANE_ROLES.items() for x in (F.lit(k).cast("bigint"), F.lit(v))]), lane_role
    )
    roaming = F.coalesce(is_roaming, F.lit(False))
    return F.when(roaming, "roamer").otherwise(named), F.when(roaming, 0.72).when(named.isNotNull(), 0.86)


def _reasons(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_distinct(
        F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in pairs]))
    )


def normalize(rows: DataFrame) -> DataFrame:
    """Typed columns, ordered exclusion reasons and nine eligibility flags of de-duplicated rows."""
    typed = rows.select(
        "account_id",
        "source_index",
        as_int(F.col("match_id")).alias("match_id"),
        as_int(F.coalesce("start_time", "started_at")).alias("_start"),
        as_count(F.coalesce("duration", "duration_seconds")).alias("duration_seconds"),
        *[as_int(F.col(c)).alias(c) for c in ("hero_id", "hero_variant", "game_mode", "lobby_type", "leaver_status")],
        *[as_count(F.col(c)).alias(c) for c in ("kills", "deaths", "assists", "party_size")],
        *[as_int(F.col(c)).alias(c) for c in ("lane_role", "lane", "region")],
        as_bool(F.col("is_roaming")).alias("is_roaming"),
        F.coalesce(
            F.when(F.col("side").isin("radiant", "dire"), F.col("side")),
            F.when(as_int(F.col("player_slot")) < 128, "radiant").when(as_int(F.col("player_slot")).isNotNull(), "dire"),
        ).alias("side"),
        as_bool(F.col("won")).alias("_won"),
        as_bool(F.col("radiant_win")).alias("_radiant_win"),
        F.col("patch").alias("patch"),
        F.col("version").alias("source_version"),
        as_int(F.coalesce(F.nullif(F.col("skill_bracket"), F.lit("0")), F.col("skill"))).alias("skill_bracket"),
        (F.coalesce(F.nullif(F.col("leagueid"), F.lit("0")), F.nullif(F.col("league_id"), F.lit("0")), F.lit("")) != "").alias(
            "_league"
        ),
        as_int(F.col("row_account_id")).alias("_row_account"),
        *[
            (F.col(c).isNotNull() & F.coalesce(as_int(F.col(c)) < 0, F.lit(True))).alias(f"_bad_{c}")
            for c in ("kills", "deaths", "assists", "duration", "duration_seconds")
        ],
    )
    role, confidence = role_hint(F.col("lane_role"), F.col("is_roaming"))
    named = typed.withColumns(
        {
            "started_at": F.when(F.col("_start") > 0, F.col("_start")),
            "won": F.coalesce("_won", F.col("_radiant_win") == (F.col("side") == "radiant")),
            "role_hint": role,
            "role_confidence": confidence,
        }
    ).withColumn("ended_at", F.col("started_at") + F.col("duration_seconds"))
    bad = [
        (F.col(f"_bad_{c}"), f"invalid_{c}") for c in ("kills", "deaths", "assists", "duration", "duration_seconds")
    ]
    reasons = _reasons(
        bad
        + [
            (F.col("_row_account") != F.col("account_id"), "account_id_mismatch"),
            (F.col("_start").isNull(), "missing_start_time"),
            (F.col("_start") <= 0, "invalid_start_time"),
            (F.col("hero_id").isNull() | (F.col("hero_id") <= 0), "missing_hero"),
            (F.col("side").isNull(), "missing_side"),
            (F.col("won").isNull(), "missing_outcome"),
            (~F.coalesce(F.col("game_mode").isin(*GAME_MODES), F.lit(False)), "unsupported_game_mode"),
            (F.col("duration_seconds").isNull() | (F.col("duration_seconds") < 300), "invalid_duration"),
            (F.col("leaver_status").isin(*ABANDONED), "abandoned"),
            (~F.coalesce(F.col("lobby_type").isin(*LOBBY_TYPES), F.lit(False)), "unsupported_lobby_type"),
            (F.col("_league"), "pro_or_league"),
        ]
    )
    ledger = named.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)
    common, why = F.col("eligible"), F.col("reasons")
    none = F.array().cast("array<string>")
    kda = F.col("kills").isNotNull() & F.col("assists").isNotNull()
    missing_kda = F.when(kda, none).otherwise(F.array(F.lit("missing_kda")))
    no_role = F.when(F.col("role_hint").isNull(), F.array(F.lit("missing_role_hint"))).when(
        F.col("role_confidence") < 0.60, F.array(F.lit("low_role_confidence"))
    ).otherwise(none)

    def flag(included: Column, extra: Column | None = None) -> Column:
        return F.struct(
            F.coalesce(common & included, F.lit(False)).alias("included"),
            (F.concat(why, extra) if extra is not None else why).alias("reasons"),
        )

    yes = F.lit(True)
    flags = F.struct(
        flag(yes).alias("overall"),
        flag(F.col("hero_id").isNotNull()).alias("breadth"),
        flag(F.col("role_confidence") >= 0.60, no_role).alias("role"),
        flag(F.col("won").isNotNull()).alias("adaptability"),
        flag(kda & (F.col("duration_seconds") >= 600), missing_kda).alias("activity"),
        flag(kda & (F.col("kills") + F.col("assists") > 0), missing_kda).alias("orientation"),
        flag(F.col("started_at").isNotNull() & F.col("won").isNotNull()).alias("resilience"),
        flag(F.col("started_at").isNotNull() & F.col("won").isNotNull()).alias("endurance"),
        flag(F.col("started_at").isNotNull()).alias("rhythm"),
    )
    private = [c for c in ledger.columns if c.startswith("_")]
    return ledger.withColumn("eligibility", flags).drop(*private)


def exclusion_ledger(raw: DataFrame) -> DataFrame:
    """Why rows are left out: unusable ids first, then the reasons of every kept row that fails."""
    unusable = (
        _identified(raw)
        .where(F.coalesce(F.col("_id") <= 0, F.lit(True)))
        .select(
            "account_id",
            "source_index",
            F.col("_id").alias("match_id"),
            F.array(F.lit("invalid_match_id")).alias("reasons"),
        )
    )
    failing = (
        normalize(deduplicate(raw))
        .where(~F.col("eligible"))
        .select("account_id", "source_index", "match_id", "reasons")
    )
    return unusable.unionByName(failing)


def reason_histogram(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def history_window(window_end: int, days: int = 365) -> tuple[int, int]:
    return window_end - max(1, days) * 86_400, window_end


def within_window(rows: DataFrame, window_start: int, window_end: int) -> DataFrame:
    """Rows that start inside the window, both edges included; undated rows are left out."""
    return rows.where(F.col("started_at").between(window_start, window_end))


def newest_per_account(rows: DataFrame, limit: int, hot_rows: int | None = None) -> DataFrame:
    """The newest ``limit`` rows of every account."""
    keys, one = ("account_id",), F.lit(1).cast("bigint")
    placed = scan(
        chunked(rows.where(F.col("started_at").isNotNull()), keys, "started_at", hot_rows, tie="match_id"),
        keys,
        ("started_at", "match_id"),
        {"_rn": ("sum", one), "_n": ("total", one)},
    )
    return unchunked(placed.where(F.col("_n") - F.col("_rn") < limit).drop("_rn", "_n"))


def legacy_assessment(summary: DataFrame, detail: DataFrame | None = None) -> DataFrame:
    """Eligibility of the older path: non-null detail columns overlay the summary.

    ``detail`` has one row per account and match with any of the overlay columns,
    ``player_present`` and ``target_leaver_status``.
    """
    overlay = ("game_mode", "leagueid", "duration", "radiant_win", "won")
    rows = with_all_columns(summary)
    if detail is not None:
        shared = [c for c in overlay if c in detail.columns]
        side = detail.select(
            "account_id",
            F.col("match_id").cast("string").alias("match_id"),
            *[F.col(c).cast("string").alias(f"_d_{c}") for c in shared],
            F.col("player_present").alias("_present"),
            F.col("target_leaver_status").alias("_target_leaver"),
        )
        rows = rows.join(side, ["account_id", "match_id"], "left").withColumns(
            {c: F.coalesce(F.col(f"_d_{c}"), F.col(c)) for c in shared}
        )
    else:
        rows = rows.withColumns(
            {"_present": F.lit(None).cast("boolean"), "_target_leaver": F.lit(None).cast("bigint")}
        )
    own, target = as_int(F.col("leaver_status")), F.col("_target_leaver")
    duration = as_int(F.col("duration"))
    reasons = _reasons(
        [
            (as_int(F.col("match_id")).isNull(), "malformed"),
            (~F.coalesce(as_int(F.col("game_mode")).isin(*GAME_MODES), F.lit(False)), "non_standard_mode"),
            (F.coalesce(F.nullif("leagueid", F.lit("0")), F.nullif("league_id", F.lit("0"))).isNotNull(), "pro_or_league"),
            (duration.isNull() | (duration < 300), "invalid_duration"),
            (F.col("radiant_win").isNull() & F.col("won").isNull(), "missing_outcome"),
            (F.col("_present") == F.lit(False), "player_not_found"),
            ((target.isNotNull() & ~target.isin(0, 1)) | (own.isNotNull() & ~own.isin(0, 1)), "abandoned"),
        ]
    )
    return rows.select("account_id", "source_index", as_int(F.col("match_id")).alias("match_id"), reasons.alias("reasons")).withColumn(
        "eligible", F.size("reasons") == 0
    )


def legacy_summary(raw: DataFrame) -> DataFrame:
    """Feature rows of the older path, with its own role map; rows lacking a key field are dropped."""
    rows = with_all_columns(raw)
    lane_role, lane = as_int(F.col("lane_role")), as_int(F.col("lane"))

    def mapped(values: dict[int, str], column: Column) -> Column:
        return F.try_element_at(
            F.create_map(*[x for k, v in values.items() for x in (F.lit(k).cast("bigint"), F.lit(v))]), column
        )

    roaming = F.coalesce(as_bool(F.col("is_roaming")), F.lit(False))
    role = (
        F.when(roaming, "roamer")
        .when(lane_role.isNotNull(), mapped(LEGACY_LANE_ROLES, lane_role))
        .otherwise(mapped(LEGACY_LANES, lane))
    )
    start, duration = as_int(F.col("start_time")), as_int(F.col("duration"))
    slot, radiant_win = as_int(F.col("player_slot")), as_bool(F.col("radiant_win"))
    side = F.when(slot < 128, "radiant").otherwise("dire")
    complete = (
        as_int(F.col("match_id")).isNotNull()
        & duration.isNotNull()
        & as_int(F.col("hero_id")).isNotNull()
        & slot.isNotNull()
        & radiant_win.isNotNull()
    )
    return rows.where(complete).select(
        "account_id",
        "source_index",
        as_int(F.col("match_id")).alias("match_id"),
        start.alias("started_at"),
        duration.alias("duration_seconds"),
        as_int(F.col("hero_id")).alias("hero_id"),
        side.alias("side"),
        (radiant_win == (side == "radiant")).alias("won"),
        *[as_int(F.col(c)).alias(c) for c in ("kills", "deaths", "assists", "game_mode", "lobby_type", "party_size")],
        lane_role.alias("lane_role"),
        role.alias("role_hint"),
        F.when(
            role.isNotNull(), F.when(lane_role.isNotNull(), 0.86).when(lane.isNotNull(), 0.62).otherwise(0.72)
        ).alias("role_confidence"),
        F.coalesce("patch", "version").alias("patch"),
        (start + duration).alias("ended_at"),
    )


STEAM_OFFSET = 76_561_197_960_265_728


def steam_to_account(value: Column) -> Column:
    """Account id of a 64-bit community id; null outside the individual-account range."""
    number = value.try_cast("decimal(20,0)")
    account = number - F.lit(STEAM_OFFSET).cast("decimal(20,0)")
    return F.when((account > 0) & (account <= 4_294_967_295), account.cast("bigint"))
