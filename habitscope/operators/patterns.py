"""Rule patterns over element results: qualification, ranking, outcome states, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitscope.constants import (
    DIMENSIONS,
    ELEMENTS,
    PATTERN_DIRECTIONS,
    PATTERN_MINIMUM_CONFIDENCE,
    PATTERNS,
)
from habitscope.functions.expr import clamp, element_confidence_label


def rule_table(spark: SparkSession) -> DataFrame:
    """One row per pattern, clause and element with the accepted zones."""
    rows = [
        (p[0], i, j, element, list(zones))
        for p in PATTERNS
        for i, clause in enumerate(p[6])
        for j, (element, zones) in enumerate(clause)
    ]
    return spark.createDataFrame(rows, "pattern string, clause int, place int, key string, accepted array<string>")


def definitions(spark: SparkSession) -> DataFrame:
    rows = [(i, p[0], p[1], list(p[2]), list(p[3]), p[4], p[5]) for i, p in enumerate(PATTERNS)]
    return spark.createDataFrame(
        rows,
        "pattern_no int, pattern string, kind string, dimensions array<string>, required array<string>, "
        "family string, tier string",
    )


def clauses(elements: DataFrame) -> DataFrame:
    """Every clause of every pattern per account: gates, zone match, components, ranking values.

    The rules are a fixed table of 26 rows, so they are broadcast; accounts that lack an element
    row get a missing gate for it.
    """
    spark = elements.sparkSession
    rules = rule_table(spark)
    floors = F.create_map(*[x for e in ELEMENTS for x in (F.lit(e[0]), F.lit(e[3]))])
    zones = F.create_map(*[x for e in ELEMENTS for x in (F.lit(e[0]), F.array(*[F.lit(z) for z in e[4]]))])
    ruled = elements.join(F.broadcast(rules), "key")
    key = F.col("key")
    missing = (F.col("status") == "unavailable") | F.col("score").isNull()
    low_coverage = ~missing & (F.col("coverage") < F.element_at(floors, key))
    weak = ~missing & ~low_coverage & (F.col("confidence_score") < PATTERN_MINIMUM_CONFIDENCE)
    labels = F.element_at(zones, key)
    zone_ok = F.coalesce(F.array_contains("accepted", F.col("zone")), F.lit(False))
    here = F.array_position(labels, F.col("zone"))
    distance = F.array_min(
        F.transform("accepted", lambda z: F.abs(F.array_position(labels, z) - here))
    )
    component = F.when(F.col("zone").isNull(), 0.0).otherwise(clamp(1.0 - distance / (F.size(labels) - 1)))
    known = F.when(F.col("score").isNotNull(), F.col("confidence_score"))
    known_coverage = F.when(F.col("score").isNotNull(), F.col("coverage"))

    def named(flag: Column) -> Column:
        # At most two elements per clause.
        return F.transform(
            F.array_sort(F.collect_list(F.when(flag, F.struct("place", "key")))), lambda s: s["key"]
        )

    sizes = rules.groupBy("pattern", "clause").agg(F.count(F.lit(1)).alias("_size"))
    return (
        ruled.groupBy("account_id", "pattern", "clause")
        .agg(
            F.count(F.lit(1)).alias("_seen"),
            named(missing).alias("missing"),
            named(low_coverage).alias("coverage_failures"),
            named(weak).alias("confidence_failures"),
            F.every(zone_ok).alias("_zones_ok"),
            F.sum(component).alias("component_sum"),
            F.min(known).alias("min_confidence"),
            F.avg(known).alias("mean_confidence"),
            F.min(known_coverage).alias("min_coverage"),
            F.avg("quality").alias("mean_quality"),
        )
        .join(F.broadcast(sizes), ["pattern", "clause"])
        .withColumns(
            {
                "zone_qualified": F.col("_zones_ok") & (F.col("_seen") == F.col("_size")),
                "relationship": clamp(F.col("component_sum") / F.col("_size")),
                "gated": (F.size("missing") == 0)
                & (F.size("coverage_failures") == 0)
                & (F.size("confidence_failures") == 0)
                & (F.col("_seen") == F.col("_size")),
            }
        )
        .withColumns(
            {
                c: F.coalesce(F.col(c), F.lit(0.0))
                for c in ("min_confidence", "mean_confidence", "min_coverage", "mean_quality")
            }
        )
        .drop("_seen", "_size", "_zones_ok")
    )


def evaluate(elements: DataFrame) -> DataFrame:
    """Qualified, suppressed or unavailable per account and pattern, with strength and direction."""
    box = F.struct(
        "clause",
        "missing",
        "coverage_failures",
        "confidence_failures",
        "zone_qualified",
        "gated",
        "relationship",
        "component_sum",
        "min_confidence",
        "mean_confidence",
        "min_coverage",
        "mean_quality",
    )
    # One or two clauses per pattern.
    per_pattern = (
        clauses(elements).groupBy("account_id", "pattern").agg(F.array_sort(F.collect_list(box)).alias("c"))
    )
    qualifying = F.filter("c", lambda c: c["gated"] & c["zone_qualified"])
    gated = F.filter("c", lambda c: c["gated"])
    pool = F.when(F.size(qualifying) > 0, qualifying).otherwise(gated)
    best = F.array_max(
        F.transform(
            pool,
            lambda c: F.struct(
                c["min_confidence"].alias("a"),
                c["mean_confidence"].alias("b"),
                c["min_coverage"].alias("c"),
                c["component_sum"].alias("d"),
                (-c["clause"]).alias("e"),
                c["relationship"].alias("relationship"),
                c["mean_quality"].alias("quality"),
            ),
        )
    )

    def gather(field: str, keep=None) -> Column:
        source = F.filter("c", keep) if keep is not None else F.col("c")
        return F.array_distinct(F.flatten(F.transform(source, lambda c: c[field])))

    on_zone = lambda c: c["zone_qualified"]
    has_zone = F.exists("c", on_zone)
    gates = per_pattern.withColumns(
        {
            "_best": best,
            "_qualifies": F.size(qualifying) > 0,
            "_gated": F.size(gated) > 0,
            "_zone_cov": gather("coverage_failures", on_zone),
            "_zone_conf": gather("confidence_failures", on_zone),
            "_cov": gather("coverage_failures", lambda c: F.size(c["missing"]) == 0),
            "_conf": gather(
                "confidence_failures",
                lambda c: (F.size(c["missing"]) == 0) & (F.size(c["coverage_failures"]) == 0),
            ),
            "_missing": gather("missing"),
            "_has_zone": has_zone,
        }
    )
    nothing = F.struct(F.lit(None).cast("string").alias("gate"), F.lit(None).cast("array<string>").alias("keys"))

    def failed(gate: str, keys: str) -> Column:
        return F.struct(F.lit(gate).alias("gate"), F.col(keys).alias("keys"))

    coverage_gate = "required_element_coverage_below_gate"
    confidence_gate = "required_element_confidence_below_gate"
    gate = (
        F.when(F.col("_qualifies"), nothing)
        .when(F.col("_has_zone") & (F.size("_zone_cov") > 0), failed(coverage_gate, "_zone_cov"))
        .when(F.col("_has_zone") & (F.size("_zone_conf") > 0), failed(confidence_gate, "_zone_conf"))
        .when(F.col("_gated"), nothing)
        .when(F.size("_cov") > 0, failed(coverage_gate, "_cov"))
        .when(F.size("_conf") > 0, failed(confidence_gate, "_conf"))
        .otherwise(failed("required_element_unavailable", "_missing"))
    )
    decided = gates.withColumn("_gate", gate)
    blocked = F.col("_gate.gate").isNotNull()
    qualified = ~blocked & F.col("_qualifies")
    confidence = clamp(
        0.60 * F.col("_best.a") + 0.25 * F.col("_best.b") + 0.15 * F.when(F.col("_qualifies"), 1.0).otherwise(0.80)
    )
    strength = clamp(F.col("_best.relationship") * confidence * F.col("_best.c") * F.col("_best.quality"))
    directions = F.create_map(*[x for k, v in PATTERN_DIRECTIONS.items() for x in (F.lit(k), F.lit(v))])
    moved = F.when(F.col("_best.e") == 0, "familiarity").otherwise("tempo")
    direction = (
        F.when(F.col("pattern") == "bounceback", F.concat(F.lit("positive_recovery_with_"), moved))
        .when(F.col("pattern") == "performance_slide", F.concat(F.lit("negative_recovery_with_"), moved))
        .otherwise(F.try_element_at(directions, F.col("pattern")))
    )
    status = (
        F.when(qualified, "qualified")
        .when(F.col("_gate.gate") == "required_element_unavailable", "unavailable")
        .otherwise("suppressed")
    )
    reason = F.when(blocked, F.concat(F.col("_gate.gate"), F.lit(":"), F.concat_ws(",", "_gate.keys"))).when(
        ~qualified, "relationship_zone_not_met"
    )
    score = F.when(blocked, 0.0).otherwise(confidence)
    return (
        decided.select(
            "account_id",
            "pattern",
            status.alias("status"),
            F.when(qualified, direction).alias("direction"),
            F.when(qualified, strength).otherwise(0.0).alias("strength"),
            F.when(F.col("_gate.gate") == "required_element_unavailable", "unavailable")
            .when(blocked, "low")
            .otherwise(element_confidence_label(score, F.lit(False)))
            .alias("confidence"),
            score.alias("confidence_score"),
            F.when(~blocked, -F.col("_best.e")).alias("clause"),
            F.when(blocked, 0.0).otherwise(F.col("_best.relationship")).alias("relationship_strength"),
            F.when(blocked, 0.0).otherwise(F.col("_best.c")).alias("evidence_coverage"),
            F.when(blocked, 0.0).otherwise(clamp(F.col("_best.quality"))).alias("qualification_quality"),
            reason.alias("suppression_reason"),
        )
        .join(F.broadcast(definitions(elements.sparkSession)), "pattern")
        .drop("required")
    )


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` (a lambda variable is never inlined)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _greedy(pool: Column, limit: int, choose) -> Column:
    """Pick up to ``limit`` entries one after the other.

    ``choose(pool, groups)`` gives a struct with ``key`` and ``group`` (null when the pool is
    empty); the pick leaves the pool and its group is remembered for the next step.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(pool.alias("pool"), empty.alias("keys"), empty.alias("groups"))

    def step(state: Column, _: Column) -> Column:
        def apply(winner: Column) -> Column:
            return F.when(winner.isNull(), state).otherwise(
                F.struct(
                    F.filter(state["pool"], lambda x: x["key"] != winner["key"]).alias("pool"),
                    F.array_append(state["keys"], winner["key"]).alias("keys"),
                    F.array_append(state["groups"], winner["group"]).alias("groups"),
                )
            )

        return let(choose(state["pool"], state["groups"]), apply)

    return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step)["keys"]


def element_highlights(elements: DataFrame, limit: int = 3) -> DataFrame:
    """The clearest elements, picked one after the other; a repeated dimension counts less."""
    usable = elements.where(F.col("score").isNotNull() & (F.col("status") != "unavailable"))
    extremity = F.abs(F.col("score") - 0.5) * 2.0
    evidence = F.col("confidence_score") * F.col("coverage") * F.col("quality")
    # At most 18 elements per account.
    pool = usable.groupBy("account_id").agg(
        F.collect_list(
            F.struct("key", F.col("dimension").alias("group"), extremity.alias("extremity"), evidence.alias("evidence"))
        ).alias("_pool")
    )

    def choose(entries: Column, groups: Column) -> Column:
        return F.array_max(
            F.transform(
                entries,
                lambda e: F.struct(
                    (
                        0.55 * e["extremity"]
                        + 0.30 * e["evidence"]
                        + 0.15 * F.when(F.array_contains(groups, e["group"]), 0.72).otherwise(1.0)
                    ).alias("score"),
                    e["extremity"].alias("extremity"),
                    e["evidence"].alias("evidence"),
                    e["key"].alias("key"),
                    e["group"].alias("group"),
                ),
            )
        )

    return pool.select(
        "account_id", F.posexplode(_greedy(F.col("_pool"), limit, choose)).alias("rank", "key")
    ).withColumn("rank", F.col("rank") + 1)


def pattern_highlights(patterns: DataFrame, limit: int = 5) -> DataFrame:
    """Strong patterns, picked one after the other; a repeated family costs 0.04, tier A wins near ties."""
    usable = patterns.where(
        (F.col("status") == "qualified") & (F.col("confidence_score") >= 0.45) & (F.col("evidence_coverage") >= 0.35)
    )
    # At most 11 patterns per account.
    pool = usable.groupBy("account_id").agg(
        F.collect_list(
            F.struct(
                F.col("pattern").alias("key"),
                F.col("family").alias("group"),
                "tier",
                "strength",
                "relationship_strength",
            )
        ).alias("_pool")
    )

    def choose(entries: Column, groups: Column) -> Column:
        scored = F.transform(
            entries,
            lambda p: F.struct(
                (p["strength"] - F.when(F.array_contains(groups, p["group"]), 0.04).otherwise(0.0)).alias("base"),
                (p["tier"] == "A").alias("leading"),
                p["relationship_strength"].alias("relationship"),
                p["key"].alias("key"),
                p["group"].alias("group"),
            ),
        )

        def rank(close: Column) -> Column:
            bonus = F.when(F.size(close) > 1, 0.005).otherwise(0.0)
            return F.array_max(
                F.transform(
                    close,
                    lambda p: F.struct(
                        p["leading"].alias("a"),
                        (p["base"] + F.when(p["leading"], bonus).otherwise(0.0)).alias("b"),
                        p["relationship"].alias("c"),
                        p["key"].alias("key"),
                        p["group"].alias("group"),
                    ),
                )
            )

        return let(
            scored,
            lambda all_: let(
                F.array_max(F.transform(all_, lambda p: p["base"])),
                lambda top: let(F.filter(all_, lambda p: top - p["base"] <= 0.02), rank),
            ),
        )

    return pool.select(
        "account_id", F.posexplode(_greedy(F.col("_pool"), limit, choose)).alias("rank", "pattern")
    ).withColumn("rank", F.col("rank") + 1)


def dimension_summary(elements: DataFrame) -> DataFrame:
    """Available and limited elements of each dimension and its confidence."""
    available = F.count_if(F.col("status") == "available")
    limited = F.count_if(F.col("status") == "limited")
    confidence = (
        F.when(F.col("available_elements") + F.col("limited_elements") == 0, "unavailable")
        .when((F.col("available_elements") == F.col("total_elements")) & (F.col("_min") >= 0.75), "high")
        .when(F.col("available_elements") > 0, "moderate")
        .otherwise("low")
    )
    return (
        elements.where(F.col("dimension").isin(*DIMENSIONS))
        .groupBy("account_id", "dimension")
        .agg(
            available.alias("available_elements"),
            limited.alias("limited_elements"),
            F.count(F.lit(1)).alias("total_elements"),
            F.min("confidence_score").alias("_min"),
        )
        .withColumn("confidence", confidence)
        .drop("_min")
    )


def report_quality(elements: DataFrame, patterns: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """Overall confidence of an account's report and the counts behind it."""
    counted = elements.groupBy("account_id").agg(
        F.count_if(F.col("status") == "available").alias("available"),
        F.count_if(F.col("status") == "limited").alias("limited"),
        F.count_if(F.col("status") == "unavailable").alias("unavailable"),
        F.avg(F.when(F.col("score").isNotNull(), F.col("confidence_score"))).alias("_mean"),
    )
    qualified = patterns.groupBy("account_id").agg(
        F.count_if(F.col("status") == "qualified").alias("qualified_patterns")
    )
    joined = counted.join(qualified, "account_id", "left")
    joined = joined.join(tiers, "account_id", "left") if tiers is not None else joined.withColumn("tier", F.lit("normal"))
    overall = (
        F.when(F.col("_mean").isNull(), "unavailable")
        .when((F.col("_mean") >= 0.75) & (F.col("tier") != "limited"), "high")
        .when(F.col("_mean") >= 0.50, "moderate")
        .otherwise("low")
    )
    return joined.select(
        "account_id",
        overall.alias("overall"),
        "available",
        "limited",
        "unavailable",
        F.coalesce("qualified_patterns", F.lit(0)).alias("qualified_patterns"),
    )


# Display bands -------------------------------------------------------------------------------


def relative_performance_band(value: Column) -> Column:
    return (
        F.when(value.isNull(), "unavailable")
        .when(value <= -0.30, "very_weak")
        .when(value < -0.10, "weak")
        .when(value <= 0.10, "normal")
        .when(value < 0.30, "strong")
        .otherwise("very_strong")
    )


def level_band(value: Column) -> Column:
    """Presence and death exposure share these cuts."""
    return (
        F.when(value.isNull(), "unavailable").when(value >= 0.60, "high").when(value < 0.40, "low").otherwise("normal")
    )


def session_curve_band(value: Column, direction: Column) -> Column:
    fade = (
        F.when(value <= -0.20, "lowest_point")
        .when(value < -0.05, "below_usual")
        .when(value <= 0.05, "about_usual")
        .otherwise("above_usual")
    )
    rise = (
        F.when(value <= -0.10, "slow_start")
        .when(value < -0.03, "warming_up")
        .when(value <= 0.05, "about_usual")
        .when(value < 0.20, "above_usual")
        .otherwise("strongest")
    )
    return F.when(value.isNull(), "unavailable").when(direction == "fade", fade).otherwise(rise)


def reliability_band(rank: Column) -> Column:
    return F.when(rank <= 2, "Anchor").when(rank == 3, "Close").otherwise("Still developing")


def recommendation_supported(patterns: DataFrame) -> Column:
    return (
        (patterns["status"] == "qualified")
        & patterns["confidence"].isin("moderate", "high")
        & (patterns["confidence_score"] >= 0.45)
        & (patterns["evidence_coverage"] >= 0.45)
    )


# Outcome states ------------------------------------------------------------------------------


def outcome(pattern: Column, action: dict[str, Column]) -> Column:
    """Semantic outcome branch of a pattern from the facts of its action."""

    def context(prefix: str) -> Column:
        return (
            F.when(action["context_hero"].isNotNull(), f"{prefix}_HERO_CONTEXT")
            .when(action["context_function"].isNotNull(), f"{prefix}_FUNCTION_CONTEXT")
            .otherwise(f"{prefix}_OVERALL_CONTEXT")
        )

    def curve(prefix: str, gradual: str) -> Column:
        state = action["breakpoint_state"]
        return (
            F.when(state == "stable_breakpoint", f"{prefix}_STABLE_BREAKPOINT")
            .when(state == "gradual", f"{prefix}_GRADUAL_{gradual}")
            .otherwise(f"{prefix}_BREAKPOINT_UNRESOLVED")
        )

    status, ranked, shape = action["status"], F.coalesce(action["ranked_heroes"], F.lit(0)), action["shape"]
    eligible = F.coalesce(action["stretch_eligible"], F.lit(False))
    addition = F.coalesce(action["has_addition"], F.lit(False))
    gap = F.coalesce(action["has_gap"], F.lit(False))
    return (
        F.when(
            pattern == "same_playbook",
            F.when(eligible, "P01_NARROW_JOB_BRIDGE_FOUND").otherwise("P01_NARROW_JOB_NO_BRIDGE"),
        )
        .when(
            pattern == "comfort_edge",
            F.when((status == "available") & (ranked >= 4), "P02_CLEAR_RELIABILITY_LADDER")
            .when(ranked > 0, "P02_GRADUAL_RELIABILITY_LADDER")
            .otherwise("P02_DEVELOPMENT_DEMAND_UNRESOLVED"),
        )
        .when(
            pattern == "partial_transfer",
            F.when(status == "capability_hypothesis", "P03_DEMAND_HYPOTHESIS")
            .when(status == "direct_signal", "P03_DIRECT_DIFFERENCE_ONLY")
            .otherwise("P03_EXPLANATION_UNRESOLVED"),
        )
        .when(
            pattern == "versatile_core",
            F.when(addition, "P04_GAP_WITH_BRIDGE").when(gap, "P04_GAP_NO_BRIDGE").otherwise("P04_NO_MEANINGFUL_GAP"),
        )
        .when(
            pattern == "proven_flexibility",
            F.when(status == "peak_window", "P05_CONCENTRATED_FLEX_WINDOW").otherwise("P05_DISTRIBUTED_FLEXIBILITY"),
        )
        .when(pattern == "bounceback", context("P06"))
        .when(pattern == "performance_slide", context("P07"))
        .when(pattern == "controlled_presence", context("P08"))
        .when(
            pattern == "presence_tax",
            F.when(shape == "job_shaped", "P09_JOB_SHAPED")
            .when(shape == "hero_specific", "P09_HERO_SPECIFIC")
            .when(shape == "cross_context", "P09_CROSS_CONTEXT")
            .otherwise("P09_SOURCE_UNRESOLVED"),
        )
        .when(pattern == "session_fade", curve("P10", "FADE"))
        .when(pattern == "session_rise", curve("P11", "RISE"))
    )


def recommendation_state(pattern: Column, action: dict[str, Column]) -> Column:
    fallback = F.lit("HR_PRACTICE_FALLBACK")
    intent = action["rationale_intent"]
    return (
        F.when(
            pattern == "same_playbook",
            F.when(intent.isNull(), fallback)
            .when(intent == "double_down", "HR_DOUBLE_DOWN")
            .otherwise("HR_ADJACENT_MOVE_ADD_FUNCTION"),
        )
        .when(
            pattern == "versatile_core",
            F.when(F.coalesce(action["has_addition"], F.lit(False)), "HR_FILL_GAP_ADD_FUNCTION").otherwise(fallback),
        )
        .when(
            pattern == "partial_transfer",
            F.when(
                action["status"].isin("direct_signal", "capability_hypothesis", "deep_candidate"),
                "HR_PRACTICE_TRANSFER_DEMAND",
            ).otherwise(fallback),
        )
        .when(
            pattern == "comfort_edge",
            F.when(F.coalesce(action["development"], F.lit(0)) > 0, "HR_CHANGE_ANGLE").otherwise(fallback),
        )
        .when(pattern == "proven_flexibility", "HR_PROTECT_RELIABLE_ANCHOR")
        .when(pattern == "bounceback", "HR_REPEAT_POST_LOSS_ANCHOR")
        .when(pattern == "performance_slide", "HR_CHANGE_ONE_TRANSITION")
        .when(pattern == "controlled_presence", "HR_PRESERVE_LOW_COST_PRESENCE")
        .when(pattern == "presence_tax", "HR_INVESTIGATE_PRESENCE_COST")
        .when(pattern == "session_fade", "HR_CHECKPOINT_AT_BREAKPOINT")
        .when(pattern == "session_rise", "HR_FRONTLOAD_FAMILIARITY")
    )
