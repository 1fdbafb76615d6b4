"""What stands behind each pattern: cores, contrasts, windows, contexts and curves.

Semantic (reviewed jobs) versions throughout.  Every action is one row per account; contexts and
contrasts are kept as small arrays or long tables bounded by the roster and the jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitscope.constants import DEMANDS, FAMILIES
from habitscope.functions.expr import kish, ratio, recency_weight
from habitscope.functions.ordered import is_plain
from habitscope.functions.robust import lower_weighted_median, spread
from habitscope.operators import elements as E
from habitscope.operators import portfolio as P
from habitscope.operators.windows import longest_streak, numbered, rolling_days
from habitscope.session import cut


def core_heroes(rows: DataFrame, available: DataFrame, limit: int = 10) -> DataFrame:
    """Heroes with three games (two where none has three), most played and most recent first,
    until half of the games of the candidates and up to three heroes are covered."""
    counted = (
        rows.where(F.col("hero_id").isNotNull())
        .groupBy("account_id", "hero_id")
        .agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("started_at", "match_id")).alias("latest"))
        .join(P.dimension(available).where(F.col("available")).select("hero_id"), "hero_id", "left_semi")
    )
    account = Window.partitionBy("account_id")
    floor = F.when(F.max("c").over(account) >= 3, 3).otherwise(2)
    order = account.orderBy(
        F.desc("c"), F.desc("latest.started_at"), F.desc("latest.match_id"), "hero_id"
    )
    ranked = (
        counted.withColumn("_floor", floor)
        .where(F.col("c") >= F.col("_floor"))
        .withColumns(
            {
                "rank": F.row_number().over(order),
                "_n": F.count(F.lit(1)).over(account),
                "_goal": F.greatest(F.lit(1.0), F.sum("c").over(account) * F.lit(0.50)),
                "_before": F.coalesce(
                    F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
            }
        )
    )
    done = (F.col("_before") >= F.col("_goal")) & (F.col("rank") - 1 >= F.least(F.lit(3), F.col("_n")))
    return ranked.where((F.col("rank") <= limit) & ~done).select("account_id", "hero_id", "c", "rank")


# Same playbook -------------------------------------------------------------------------------


def same_playbook(rows: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Heroes that deepen the repeated jobs and heroes that stretch them."""
    profile = P.semantic_profile(rows, knowledge)

    picked = P.recommend_each(rows, knowledge, {"double_down": None, "adjacent_move": None})

    def path(intent: str) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("intent") == intent, F.struct("rank", "hero_id"))))
        return F.transform(mine, lambda s: s["hero_id"])

    paths = picked.groupBy("account_id").agg(path("double_down").alias("deepen"), path("adjacent_move").alias("stretch"))
    none = F.array().cast("array<bigint>")
    joined = profile.join(paths, "account_id", "left").withColumns(
        {"deepen": F.coalesce("deepen", none), "stretch": F.coalesce("stretch", none)}
    )
    ready = (F.col("reviewed_heroes") >= 2) & (F.size("dominant") > 0)
    both = (F.size("deepen") > 0) & (F.size("stretch") > 0)
    some = (F.size("deepen") > 0) | (F.size("stretch") > 0)
    return joined.select(
        "account_id",
        F.when(~ready, "unavailable").when(both, "available").when(some, "limited").otherwise("unavailable").alias("status"),
        F.when(ready, F.col("deepen")).otherwise(none).alias("deepen"),
        F.when(ready, F.col("stretch")).otherwise(none).alias("stretch"),
        "dominant",
        "underrepresented",
        "confidence_score",
    )


# Comfort edge --------------------------------------------------------------------------------


def hero_reliability(rows: DataFrame, available: DataFrame, minimum: int = 10, limit: int = 5) -> DataFrame:
    """Shrunk, recency-ramped reliability of the heroes with ten or more games; the best five."""
    usable = (
        rows.where(P.full_metrics() & F.col("hero_id").isNotNull() & F.col("won").isNotNull())
        .join(P.credible_roles(rows.where(P.full_metrics())), "account_id", "left")
        .withColumn("_roles", F.coalesce("roles", F.array().cast("array<string>")))
        .drop("roles")
    )
    minutes = F.greatest(F.col("duration_seconds") / 60.0, F.lit(1.0))
    contribution = F.least(
        F.lit(1.0), (F.col("kills") + F.col("assists")) / F.greatest(minutes * 1.2, F.lit(1.0))
    )
    survival = 1.0 - F.least(F.lit(1.0), F.col("deaths") / F.greatest(minutes * 0.75, F.lit(1.0)))
    role = F.when(
        (F.size("_roles") == 0) | F.coalesce(F.array_contains("_roles", F.col("role_hint")), F.lit(False)), 1.0
    ).otherwise(0.5)
    score = 0.42 * F.when(F.col("won"), 1.0).otherwise(0.0) + 0.28 * contribution + 0.20 * survival + 0.10 * role
    scored = usable.withColumn("_score", score)

    def ramped(keys: tuple[str, ...], name: str) -> DataFrame:
        placed = numbered(scored.drop("_chunk", "_hot") if keys != ("account_id",) else scored, keys=keys)
        weight = 0.5 + 0.5 * (F.col("rn") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
        return placed.groupBy(*keys).agg(
            F.try_divide(F.sum(weight * F.col("_score")), F.sum(weight)).alias(name), F.count(F.lit(1)).alias(f"{name}_rows")
        )

    heroes = ramped(("account_id", "hero_id"), "raw").where(F.col("raw_rows") >= minimum)
    table = heroes.join(ramped(("account_id",), "base"), "account_id").join(
        P.dimension(available).select("hero_id"), "hero_id", "left_semi"
    )
    n = F.col("raw_rows")
    reliability = F.col("base") + (F.col("raw") - F.col("base")) * n / (n + 20.0)
    coverage = n / F.col("base_rows")
    confidence = F.least(F.lit(1.0), n / 25.0) * (0.85 + 0.15 * F.least(F.lit(1.0), coverage * 8.0))
    order = Window.partitionBy("account_id").orderBy(
        F.desc(F.round("reliability", 9)), F.desc(F.round("confidence_score", 9)), "hero_id"
    )
    return (
        table.select(
            "account_id",
            "hero_id",
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), reliability)).alias("reliability"),
            confidence.alias("confidence_score"),
            n.alias("matches"),
        )
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


def comfort_edge(ranked: DataFrame, knowledge: DataFrame, minimum: int = 5) -> DataFrame:
    """Reference core (two best) and what each of the others adds or asks for beyond it."""
    jobs = P.dimension(knowledge).select("hero_id", "functions")
    packed = ranked.join(jobs, "hero_id", "left").groupBy("account_id").agg(
        # At most five heroes.
        F.array_sort(F.collect_list(F.struct("rank", "hero_id", "functions"))).alias("heroes"),
        F.min("confidence_score").alias("confidence_score"),
    )
    core = F.filter("heroes", lambda h: h["rank"] <= 2)
    core_jobs = F.array_distinct(F.flatten(F.transform(core, lambda h: h["functions"])))
    others = F.filter("heroes", lambda h: h["rank"] > 2)
    enough = F.size("heroes") >= minimum
    development = F.transform(
        others,
        lambda h: F.struct(
            h["hero_id"].alias("hero_id"),
            F.array_intersect(h["functions"], F.col("_core_jobs")).alias("shared_anchors"),
            F.array_except(h["functions"], F.col("_core_jobs")).alias("adds_jobs"),
        ),
    )
    return packed.withColumn("_core_jobs", core_jobs).select(
        "account_id",
        # Examples of team-mates and enemies need a reviewed evidence artifact, so full status is not reached here.
        F.when(~enough, "unavailable").otherwise("limited").alias("status"),
        F.transform(core, lambda h: h["hero_id"]).alias("reference_core"),
        F.size("heroes").alias("ranked_heroes"),
        F.when(enough, development).alias("development"),
        "confidence_score",
    )


# Partial transfer ----------------------------------------------------------------------------

# Contrast signals with their smallest difference.
TRANSFER_SIGNALS = {
    "death_exposure": 0.35,
    "combat_involvement": 0.25,
    "finisher_orientation": 0.18,
    "result_distribution": 0.20,
}


def transfer_contrasts(rows: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Medians of four signals on the core against the other heroes, with the joint spread."""
    core = core_heroes(rows, knowledge, 10).select("account_id", "hero_id", F.lit(True).alias("_core"))
    known = P.dimension(knowledge).where(F.col("available")).select("hero_id")
    sided = (
        rows.join(known, "hero_id", "left_semi")
        .join(core, ["account_id", "hero_id"], "left")
        .withColumn("core", F.coalesce("_core", F.lit(False)))
    )
    long_enough = F.col("duration_seconds") >= 600
    minutes = F.col("duration_seconds") / 60.0
    involved = F.col("kills") + F.col("assists")
    signals = {
        "combat_involvement": F.when(long_enough, involved / minutes),
        "finisher_orientation": F.when(long_enough & (involved > 0), F.col("kills") / involved),
        "death_exposure": F.when(long_enough, F.col("deaths") / (minutes / 10.0)),
        "result_distribution": F.when(long_enough, F.col("won").cast("double")),
    }
    long = sided.select(
        "account_id",
        "core",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("signal"), v.cast("double").alias("x")) for k, v in signals.items()])
        ).alias("e"),
    ).select("account_id", "core", "e.signal", "e.x")
    keys = ["account_id", "signal"]
    sides = long.groupBy(*keys).agg(
        F.count_if(F.col("core")).alias("core_rows"),
        F.count_if(~F.col("core")).alias("off_rows"),
        F.count(F.when(F.col("core"), F.col("x"))).alias("core_values"),
        F.count(F.when(~F.col("core"), F.col("x"))).alias("off_values"),
        F.median(F.when(F.col("core"), F.col("x"))).alias("core_value"),
        F.median(F.when(~F.col("core"), F.col("x"))).alias("off_value"),
    )
    joint = spread(long, keys, "x").select(*keys, "mad")
    minimum = F.create_map(*[x for k, v in TRANSFER_SIGNALS.items() for x in (F.lit(k), F.lit(v))])
    delta = F.col("off_value") - F.col("core_value")
    floor = F.element_at(minimum, F.col("signal"))
    confidence = F.least(F.lit(1.0), F.least("core_rows", "off_rows") / 25.0)
    coverage = F.least(ratio(F.col("core_values"), F.col("core_rows")), ratio(F.col("off_values"), F.col("off_rows")))
    effect = F.abs(delta) / F.greatest(F.col("mad"), floor)
    return sides.join(joint, keys, "left").select(
        *keys,
        "core_rows",
        "off_rows",
        "core_value",
        "off_value",
        effect.alias("effect_size"),
        confidence.alias("confidence_score"),
        coverage.alias("coverage"),
        F.coalesce(
            (F.col("core_values") >= 10)
            & (F.col("off_values") >= 10)
            & (confidence >= 0.50)
            & (coverage >= 0.50)
            & (F.abs(delta) >= floor)
            & (effect >= 1.0),
            F.lit(False),
        ).alias("direct"),
    )


def demand_hypotheses(rows: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Demands that the off-pool heroes ask for clearly more often than the core heroes."""
    core = core_heroes(rows, knowledge, 10).select("account_id", "hero_id", F.lit(True).alias("_core"))
    names = F.array(*[F.lit(d) for d in DEMANDS])
    bands = P.dimension(knowledge).select("hero_id", "demands", F.explode(names).alias("demand")).select(
        "hero_id", "demand", F.coalesce(F.try_element_at("demands", F.col("demand")), F.lit("unknown")).alias("band")
    )
    used = rows.where(F.col("hero_id").isNotNull()).select("account_id", "hero_id").distinct()
    sided = (
        used.join(bands, "hero_id")
        .join(core, ["account_id", "hero_id"], "left")
        .withColumn("core", F.coalesce("_core", F.lit(False)))
    )
    asked = F.when(F.col("band") != "unknown", F.col("band").isin("medium", "high").cast("double"))
    rolled = sided.groupBy("account_id", "demand").agg(
        F.avg(F.when(F.col("core"), asked)).alias("core_prevalence"),
        F.avg(F.when(~F.col("core"), asked)).alias("off_prevalence"),
        F.count_if(F.col("core")).alias("core_heroes"),
        F.count_if(~F.col("core")).alias("off_heroes"),
    )
    return rolled.withColumn("separation", F.col("off_prevalence") - F.col("core_prevalence")).where(
        F.col("separation") >= 0.25
    )


def partial_transfer(contrasts: DataFrame, hypotheses: DataFrame) -> DataFrame:
    direct = F.when(
        F.col("direct"), F.struct((-F.col("effect_size")).alias("e"), F.col("signal").alias("signal"))
    )
    rolled = contrasts.groupBy("account_id").agg(
        F.max("core_rows").alias("core_rows"),
        F.max("off_rows").alias("off_rows"),
        F.min(direct).alias("_lead"),
        F.count_if("direct").alias("direct_signals"),
        F.max("confidence_score").alias("confidence_score"),
    )
    confidence = F.least(
        F.col("confidence_score"), F.least(F.lit(1.0), F.col("core_heroes") / 2.0), F.least(F.lit(1.0), F.col("off_heroes") / 2.0)
    )
    guesses = (
        hypotheses.join(rolled.select("account_id", "confidence_score"), "account_id")
        .where(confidence >= 0.50)
        .groupBy("account_id")
        .agg(F.min(F.struct((-F.col("separation")).alias("s"), "demand")).alias("_guess"))
    )
    joined = rolled.join(guesses, "account_id", "left")
    status = (
        F.when(F.col("direct_signals") > 0, "direct_signal")
        .when(F.col("_guess").isNotNull(), "capability_hypothesis")
        .when((F.col("core_rows") >= 12) & (F.col("off_rows") >= 12), "deep_candidate")
        .otherwise("unresolved")
    )
    return joined.select(
        "account_id",
        status.alias("status"),
        F.coalesce("_lead.signal", F.when(F.col("direct_signals") == 0, F.col("_guess.demand"))).alias("lead"),
        "direct_signals",
        "core_rows",
        "off_rows",
        "confidence_score",
    )


# Versatile core ------------------------------------------------------------------------------


def versatile_core(rows: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Coverage of the job families by the core heroes, the first gap, and the qualification."""
    core = core_heroes(rows, knowledge, 5)
    of_core = rows.join(core.select("account_id", "hero_id"), ["account_id", "hero_id"], "left_semi")
    profile = P.semantic_profile(of_core, knowledge)
    records = P.dimension(knowledge).select("hero_id", "families", F.col("reviewed") & (F.size("functions") > 0))
    records = records.toDF("hero_id", "families", "usable")
    packed = core.join(records, "hero_id", "left").groupBy("account_id").agg(
        F.count(F.lit(1)).alias("core_size"),
        F.count_if("usable").alias("reviewed_core"),
        F.collect_list(F.when(F.col("usable"), F.col("families"))).alias("_sets"),  # five heroes at most
    )
    table = (
        packed.join(P.credible_roles(of_core), "account_id", "left")
        .withColumn("relevant", P.relevant_families(F.coalesce("roles", F.array().cast("array<string>"))))
        .join(profile.drop("dominant", "underrepresented"), "account_id", "left")
    )
    gate = F.greatest(F.lit(2), F.floor((F.col("reviewed_core") + 1) / 2))

    def held(f: Column) -> Column:
        return F.size(F.filter("_sets", lambda s: F.array_contains(s, f)))

    staged = table.withColumns(
        {
            "_held": F.transform("relevant", lambda f: F.struct(f.alias("family"), held(f).alias("heroes"))),
            "_gate": gate,
        }
    )

    def pick(test) -> Column:
        return F.transform(F.filter("_held", test), lambda h: h["family"])

    staged = staged.withColumns(
        {
            "strong": pick(lambda h: h["heroes"] >= F.col("_gate")),
            "single": pick(lambda h: h["heroes"] == 1),
            "thin": pick(lambda h: h["heroes"] == 2),
            "missing": pick(lambda h: h["heroes"] == 0),
        }
    )
    gaps = F.concat("missing", "thin", "single")
    role_coverage = F.size(F.filter("_held", lambda h: h["heroes"] > 0)) / F.size("_held")
    qualified = (
        F.col("core_size").between(2, 5)
        & (F.col("reviewed_coverage") >= 0.80)
        & (role_coverage >= 0.60)
        & (F.col("overlap") <= 0.75)
        & (F.col("unique_jobs") >= 2)
        & (F.col("confidence_score") >= 0.35)
    )
    return staged.select(
        "account_id",
        "core_size",
        "strong",
        "single",
        "thin",
        "missing",
        F.try_element_at(gaps, F.lit(1)).alias("primary_gap"),
        role_coverage.alias("role_coverage"),
        F.coalesce(qualified, F.lit(False)).alias("qualified"),
        "confidence_score",
    )


def versatile_additions(rows: DataFrame, core: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Heroes that would fill the first gap of a qualified core."""
    gaps = core.where(F.col("qualified") & F.col("primary_gap").isNotNull())
    gaps = gaps.select("account_id", F.col("primary_gap").alias("target_family"))
    mine = rows.join(gaps.select("account_id"), "account_id", "left_semi")
    picked = P.recommend(P.rationales(mine, knowledge, "fill_gap", targets=gaps))
    return picked.join(gaps.withColumnRenamed("target_family", "family"), "account_id")


# Proven flexibility --------------------------------------------------------------------------


def flex_windows(rows: DataFrame, knowledge: DataFrame, days: int = 7) -> DataFrame:
    """Variety, jobs, activity and evenness of every seven-day window that starts on an active date."""
    known = (F.col("reviewed")) & (F.size("functions") > 0)
    records = P.dimension(knowledge).where(known).select("hero_id", "functions")
    dated = rows.where(F.col("hero_id").isNotNull()).join(records.select("hero_id"), "hero_id", "left_semi")
    # Rows per date and hero first, so that the seven copies are of counts and not of rows.
    per_day = dated.groupBy(
        "account_id", "hero_id", F.to_date(F.timestamp_seconds("started_at")).alias("_day")
    ).agg(F.count(F.lit(1)).alias("c"), F.min("started_at").alias("started_at"))
    spread_ = rolling_days(per_day, days)
    counted = spread_.groupBy("account_id", "window_start", "hero_id").agg(F.sum("c").alias("c"))
    packed = (
        counted.join(records, "hero_id")
        .withColumn("_t", F.sum("c").over(Window.partitionBy("account_id", "window_start")))
        .groupBy("account_id", "window_start")
        .agg(
            F.first("_t").alias("total"),
            F.count(F.lit(1)).alias("heroes"),
            F.size(F.array_distinct(F.flatten(F.collect_list("functions")))).alias("jobs"),
            F.count_if(F.col("c") >= 2).alias("repeated"),
            F.sum(-(F.col("c") / F.col("_t")) * F.ln(F.col("c") / F.col("_t"))).alias("_h"),
        )
    )
    total = F.col("total")
    activity = F.least(F.lit(1.0), total / 10.0)
    even = F.when(
        F.col("heroes") > 1, F.least(F.lit(1.0), F.col("_h") / F.ln(F.greatest(F.col("heroes"), F.lit(2)).cast("double")))
    ).otherwise(0.0)
    variety = F.least(F.lit(1.0), F.col("heroes") / F.greatest(F.lit(3.0), total * F.lit(0.45)))
    breadth = F.greatest(F.lit(0.50), F.least(F.lit(1.0), F.col("jobs") / 8.0))
    return packed.select(
        "account_id",
        "window_start",
        total.alias("games"),
        "heroes",
        "jobs",
        "repeated",
        activity.alias("activity"),
        even.alias("evenness"),
        (variety * breadth * activity * even).alias("score"),
    )


def proven_flexibility(windows: DataFrame, minimum: int = 10) -> DataFrame:
    """The best window of an account with at least ten games, if there is one."""
    best = windows.groupBy("account_id").agg(
        F.max(
            F.when(
                F.col("games") >= minimum,
                F.struct(
                    F.round("score", 9).alias("score"), "jobs", "repeated", "activity", "window_start", "games", "heroes", "evenness"
                ),
            )
        ).alias("b")
    )
    confidence = F.least(
        F.lit(1.0),
        0.45 * F.col("b.activity")
        + 0.30 * F.col("b.evenness")
        + 0.25 * F.least(F.lit(1.0), F.col("b.jobs") / 8.0),
    )
    return best.select(
        "account_id",
        F.when(F.col("b").isNull(), "distributed_flexibility").otherwise("peak_window").alias("status"),
        F.col("b.window_start").cast("string").alias("window_start"),
        F.col("b.games").alias("games"),
        F.col("b.heroes").alias("heroes"),
        F.col("b.jobs").alias("jobs"),
        F.col("b.score").alias("score"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence_score"),
    )


def flexibility_streak(rows: DataFrame) -> DataFrame:
    return longest_streak(rows.where(F.col("hero_id").isNotNull()), "hero_id")


# Recovery ------------------------------------------------------------------------------------


def recovery_contexts(
    rows: DataFrame,
    sessions: DataFrame,
    window_end: int,
    minimum_sessions: int = 3,
    half_life_days: float = 180.0,
    residuals: DataFrame | None = None,
) -> DataFrame:
    """Post-loss response per context of the level at which the baseline was found.

    Weighted medians inside each session and then across sessions; five rows for a hero
    context, eight for a function or role, fifteen overall, and always three sessions.
    """
    plain = is_plain(rows)
    residuals = E.post_loss_residuals(rows, sessions)[0] if residuals is None else residuals
    level = F.col("level")
    kind = F.when(level.isin("hero_role_function", "hero_function"), level).otherwise(level)
    identity = (
        F.when(level.isin("hero_role_function", "hero_function"), F.col("hero_id").cast("string"))
        .when(level == "function", F.col("function"))
        .when(level == "role", F.col("role_hint"))
        .otherwise("overall")
    )
    placed = residuals.select(
        "account_id",
        kind.alias("kind"),
        identity.alias("identity"),
        "session_no",
        "started_at",
        "residual",
        "weight",
    )
    keys = ["account_id", "kind", "identity"]
    within = lower_weighted_median(placed, [*keys, "session_no"], "residual", "weight", "delta", plain=plain)
    starts = placed.groupBy(*keys, "session_no").agg(
        F.min("started_at").alias("_s"), F.count(F.lit(1)).alias("_k")
    )
    per_session = within.join(starts, [*keys, "session_no"]).withColumn(
        "w", recency_weight(F.col("_s"), F.lit(window_end), half_life_days)
    )
    across = lower_weighted_median(per_session, keys, "delta", "w", "delta_across", plain=plain)
    sized = per_session.groupBy(*keys).agg(F.sum("_k").alias("sample_size"), F.count(F.lit(1)).alias("session_count"))
    n, k = F.col("sample_size"), F.col("session_count")
    floor = F.when(F.col("kind") == "overall", 15).when(F.col("kind").isin("function", "role"), 8).otherwise(5)
    return (
        sized.join(across, keys)
        .where((n >= floor) & (k >= minimum_sessions))
        .select(
            *keys,
            F.col("delta_across").alias("performance_delta"),
            "sample_size",
            "session_count",
            (F.least(F.lit(1.0), n / 20.0) * F.least(F.lit(1.0), k / 5.0) * F.least(F.lit(1.0), k / 5.0)).alias(
                "confidence_score"
            ),
        )
    )


def recovery_action(contexts: DataFrame, direction: str, minimum_effect: float = 0.04) -> DataFrame:
    """The strongest context of a rebound (``positive``) or a slide (``negative``)."""
    delta = F.col("performance_delta")
    keep = delta >= minimum_effect if direction == "positive" else delta <= -minimum_effect
    specificity = (
        F.when(F.col("kind").isin("hero_role_function", "hero_function"), 0)
        .when(F.col("kind") == "function", 1)
        .when(F.col("kind") == "role", 2)
        .otherwise(3)
    )
    order = Window.partitionBy("account_id").orderBy(
        specificity,
        F.round(-delta if direction == "positive" else delta, 9),
        F.desc(F.round("confidence_score", 9)),
        "kind",
        "identity",
    )
    ranked = contexts.where(keep).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= 3)


# Presence ------------------------------------------------------------------------------------


def presence_contexts(rows: DataFrame, knowledge: DataFrame, minimum: int = 5) -> DataFrame:
    """Involvement and death exposure overall, per hero, job and role.

    Sums per (hero, role) come first; only those few rows are spread over the contexts.
    """
    base = (
        rows.where(P.full_metrics() & F.col("hero_id").isNotNull())
        .groupBy("account_id", "hero_id", "role_hint")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("kills") + F.col("assists")).alias("ka"),
            F.sum("deaths").alias("d"),
            F.sum(F.col("duration_seconds") / 60.0).alias("m"),
        )
        .join(P.dimension(knowledge).select("hero_id", "functions"), "hero_id", "left")
    )

    def box(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("identity"))

    contexts = F.concat(
        F.array_compact(
            F.array(
                box("overall", F.lit("overall")),
                F.when(F.col("functions").isNotNull(), box("hero", F.col("hero_id").cast("string"))),
                F.when(
                    F.col("functions").isNotNull() & F.col("role_hint").isNotNull(), box("role", F.col("role_hint"))
                ),
            )
        ),
        F.transform(F.coalesce("functions", F.array().cast("array<string>")), lambda f: box("function", f)),
    )
    rolled = (
        base.select("account_id", "n", "ka", "d", "m", F.explode(contexts).alias("c"))
        .groupBy("account_id", "c.kind", "c.identity")
        .agg(*[F.sum(c).alias(c) for c in ("n", "ka", "d", "m")])
        .where(F.col("n") >= minimum)
    )
    return rolled.select(
        "account_id",
        "kind",
        "identity",
        F.least(F.lit(1.0), F.col("ka") / F.greatest(F.col("m"), F.lit(1.0)) / 1.2).alias("involvement"),
        F.least(F.lit(1.0), F.col("d") / F.greatest(F.col("m") / 10.0, F.lit(1.0)) / 1.2).alias("exposure"),
        F.col("n").alias("sample_size"),
        F.least(F.lit(1.0), F.col("n") / 20.0).alias("confidence_score"),
    )


# Levels at which presence counts as active, safe or exposed.
ACTIVE, SAFE, EXPOSED, CONTEXT_CONFIDENCE, HERO_GAP = 0.60, 0.40, 0.60, 0.50, 0.18
HIGH_CONTACT = ("initiation", "frontline", "catch", "fight_control")


def _specificity() -> Column:
    kind = F.col("kind")
    return F.when(kind == "hero", 0).when(kind == "function", 1).when(kind == "role", 2).otherwise(3)


def controlled_presence(
    contexts: DataFrame, active: float = ACTIVE, safe: float = SAFE, confidence: float = CONTEXT_CONFIDENCE
) -> DataFrame:
    """Contexts with high involvement and low exposure, the most specific and clearest first."""
    keep = (F.col("involvement") >= active) & (F.col("exposure") <= safe) & (F.col("confidence_score") >= confidence)
    order = Window.partitionBy("account_id").orderBy(
        _specificity(),
        F.desc(F.round(F.col("involvement") - F.col("exposure"), 9)),
        F.desc(F.round("confidence_score", 9)),
        "identity",
    )
    return contexts.where(keep).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 3)


def exposure_gap(
    rows: DataFrame,
    knowledge: DataFrame,
    minimum: int = 5,
    active: float = ACTIVE,
    exposed: float = EXPOSED,
    confidence: float = CONTEXT_CONFIDENCE,
) -> DataFrame:
    """Largest exposure of a hero above the other heroes with the same first job."""
    first = P.dimension(knowledge).select("hero_id", F.try_element_at("primary_functions", F.lit(1)).alias("job"))
    sums = (
        rows.where(P.full_metrics() & F.col("hero_id").isNotNull())
        .groupBy("account_id", "hero_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("kills") + F.col("assists")).alias("ka"),
            F.sum("deaths").alias("d"),
            F.sum(F.col("duration_seconds") / 60.0).alias("m"),
        )
        .join(first.where(F.col("job").isNotNull()), "hero_id")
    )
    over = Window.partitionBy("account_id", "job")
    peers = sums.withColumns({f"p_{c}": F.sum(c).over(over) - F.col(c) for c in ("n", "d", "m")})

    def level(total: Column, minutes: Column) -> Column:
        return F.least(F.lit(1.0), total / F.greatest(minutes, F.lit(1.0)) / 1.2)

    own = level(F.col("d"), F.col("m") / 10.0)
    other = level(F.col("p_d"), F.col("p_m") / 10.0)
    usable = (
        (F.col("n") >= minimum)
        & (F.col("p_n") >= minimum)
        & (F.least("n", "p_n") >= 20 * confidence)
        & (level(F.col("ka"), F.col("m")) >= active)
        & (own >= exposed)
    )
    return peers.groupBy("account_id").agg(
        F.greatest(F.lit(0.0), F.max(F.when(usable, own - other))).alias("gap")
    )


def presence_tax(
    contexts: DataFrame,
    gaps: DataFrame,
    active: float = ACTIVE,
    exposed: float = EXPOSED,
    confidence: float = CONTEXT_CONFIDENCE,
) -> DataFrame:
    """Where the death cost of an active account concentrates: one hero, contact jobs, or everywhere."""
    kept = contexts.where(
        (F.col("confidence_score") >= confidence) & (F.col("involvement") >= active) & (F.col("exposure") >= exposed)
    )
    job = F.when(F.col("kind") == "function", F.col("identity"))
    contact = job.isin(*HIGH_CONTACT)
    rolled = kept.groupBy("account_id").agg(
        F.count_if(F.coalesce(contact, F.lit(False))).alias("_contact"),
        F.count_if(F.coalesce(~contact, F.lit(False))).alias("_other"),
        F.count_distinct(job).alias("_jobs"),
        F.min_by(
            F.struct("kind", "identity", "exposure", "confidence_score"),
            F.struct(
                (-F.round("exposure", 9)).alias("e"),
                (-_specificity()).alias("s"),
                (-F.round("confidence_score", 9)).alias("c"),
                "identity",
            ),
        ).alias("top"),
        F.count(F.lit(1)).alias("exposed_contexts"),
    )
    shape = (
        F.when(F.coalesce("gap", F.lit(0.0)) >= HERO_GAP, "hero_specific")
        .when((F.col("_contact") > 0) & (F.col("_other") == 0), "job_shaped")
        .when(F.col("_jobs") >= 2, "cross_context")
        .when(F.col("_contact") > 0, "job_shaped")
        .otherwise("unresolved")
    )
    return rolled.join(gaps, "account_id", "left").select(
        "account_id",
        shape.alias("shape"),
        F.col("top.kind").alias("kind"),
        F.col("top.identity").alias("identity"),
        F.col("top.exposure").alias("exposure"),
        "exposed_contexts",
        (shape != "unresolved").alias("deep_candidate"),
        F.col("top.confidence_score").alias("confidence_score"),
    )


def finishing_flavour(rows: DataFrame) -> DataFrame:
    share = ratio(F.col("k"), F.col("k") + F.col("a"))
    return (
        rows.groupBy("account_id")
        .agg(F.sum(F.coalesce("kills", F.lit(0))).alias("k"), F.sum(F.coalesce("assists", F.lit(0))).alias("a"))
        .select(
            "account_id",
            F.when(F.col("k") + F.col("a") < 30, None)
            .when(share >= 0.45, "controlled_finishing_presence")
            .otherwise("controlled_setup_presence")
            .alias("flavour"),
        )
    )


# Session curve -------------------------------------------------------------------------------


def companion_signals(rows: DataFrame) -> DataFrame:
    """Movement of involvement and deaths between the first two and the later games of sessions."""
    measured = rows.where(F.col("performance").isNotNull() & F.col("session_index").isNotNull())
    early = F.col("session_index") <= 2
    rolled = measured.groupBy("account_id").agg(
        *[
            F.median(F.when(part, F.col(c))).alias(f"{name}_{c}")
            for name, part in (("early", early), ("late", ~early))
            for c in ("activity", "death_rate")
        ]
    )

    def move(c: str) -> Column:
        before, after = F.col(f"early_{c}"), F.col(f"late_{c}")
        return F.when(after > before * 1.10, "up").when(after < before * 0.90, "down")

    return rolled.select(
        "account_id", move("activity").alias("involvement_moves"), move("death_rate").alias("deaths_move")
    )


def session_curve_action(
    rows: DataFrame, sessions: DataFrame, window_end: int, direction: str, residuals: DataFrame | None = None
) -> DataFrame:
    """Balanced curve from the MEAN residual per session and bucket, with three sessions per bucket."""
    residuals = cut(E.session_bucket_residuals(rows, sessions, mean=True)) if residuals is None else residuals
    w = recency_weight(F.col("start_time"), F.lit(window_end))
    points = (
        residuals.withColumn("w", w)
        .groupBy("account_id", "bucket")
        .agg(
            F.try_divide(F.sum(F.col("residual") * F.col("w")), F.sum("w")).alias("value"),
            F.count(F.lit(1)).alias("sessions"),
            F.sum("observations").alias("observations"),
            kish(F.sum("w"), F.sum(F.col("w") * F.col("w"))).alias("effective"),
        )
    )
    independent = residuals.groupBy("account_id").agg(F.count_distinct("session_no").alias("independent_sessions"))
    packed = points.groupBy("account_id").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "value", "sessions", "observations", "effective"))).alias("curve")
    )
    supported = F.filter("curve", lambda p: p["sessions"] >= 3)
    staged = packed.join(independent, "account_id").withColumn(
        "_bp", E.breakpoint_of(supported, F.lit(direction))
    )
    state = F.col("_bp.state")
    factor = F.when(state == "stable_breakpoint", 1.0).when(state == "gradual", 0.75).otherwise(0.50)
    return staged.select(
        "account_id",
        F.lit(direction).alias("direction"),
        "curve",
        state.alias("breakpoint_state"),
        F.col("_bp.bucket").alias("breakpoint_bucket"),
        F.size(supported).alias("supported_buckets"),
        "independent_sessions",
        (
            F.least(F.lit(1.0), F.col("independent_sessions") / 12.0)
            * F.least(F.lit(1.0), F.size(supported) / 3.0)
            * factor
        ).alias("confidence_score"),
    )


def attach(patterns: DataFrame, actions: dict[str, DataFrame], core: DataFrame | None = None) -> DataFrame:
    """Status of the action behind every qualified pattern; an unqualified core suppresses its pattern."""
    out = patterns
    status = F.lit(None).cast("string")
    for name, table in actions.items():
        column = f"_a_{name}"
        out = out.join(table.select("account_id", F.col("status").alias(column)), "account_id", "left")
        status = F.when((F.col("pattern") == name) & (F.col("status") == "qualified"), F.col(column)).otherwise(status)
    out = out.withColumn("action_status", status).drop(*[f"_a_{n}" for n in actions])
    if core is None:
        return out
    gate = core.select("account_id", F.col("qualified").alias("_core_ok"))
    blocked = (
        (F.col("pattern") == "versatile_core")
        & (F.col("status") == "qualified")
        & ~F.coalesce(F.col("_core_ok"), F.lit(False))
    )
    return (
        out.join(gate, "account_id", "left")
        .withColumn("_blocked", blocked)
        .withColumns(
            {
                "suppression_reason": F.when(F.col("_blocked"), "semantic_complementarity_gate").otherwise(
                    F.col("suppression_reason")
                ),
                "strength": F.when(F.col("_blocked"), 0.0).otherwise(F.col("strength")),
                "confidence_score": F.when(F.col("_blocked"), 0.0).otherwise(F.col("confidence_score")),
                "confidence": F.when(F.col("_blocked"), "unavailable").otherwise(F.col("confidence")),
                "direction": F.when(~F.col("_blocked"), F.col("direction")),
                "status": F.when(F.col("_blocked"), "suppressed").otherwise(F.col("status")),
            }
        )
        .drop("_core_ok", "_blocked")
    )
