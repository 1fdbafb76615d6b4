"""The deep path: summary detectors, hypotheses, budgeted selection, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitscope.functions.expr import ratio
from habitscope.functions.ordered import chunked, scan, unchunked
from habitscope.operators.windows import numbered

# What makes a match comparable with others; fields that a table lacks count as unknown.
CONTEXT = ("lane_role", "average_rank", "party_size", "started_at")


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 1800, "short").when(seconds <= 2700, "medium").otherwise("long")


def sample_confidence(sample: Column) -> Column:
    return F.least(F.lit(1.0), sample / 20.0)


def _stability(left_wins, left_n, right_wins, right_n) -> Column:
    """1.0 when the two groups win on different sides of one half, else 0.6."""
    return F.when((left_wins >= left_n / 2) != (right_wins >= right_n / 2), 1.0).otherwise(0.6)


def corpus(rows: DataFrame) -> DataFrame:
    """Coverage, win rate and variety of an account's summary rows."""
    known = ("match_id", "started_at", "duration_seconds", "hero_id", "side", "won")
    present = [c for c in known if c in rows.columns]
    share = sum((F.col(c).isNotNull().cast("int") for c in present), F.lit(0)) / float(len(known))
    # The side follows from the slot and is known whenever the result is.
    share = share + (F.lit(1.0 / len(known)) if "side" not in rows.columns else F.lit(0.0))
    bucket = duration_bucket(F.col("duration_seconds"))
    return rows.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("matches"),
        F.avg(share).alias("summary_coverage"),
        F.avg(F.col("won").cast("double")).alias("win_rate"),
        F.count_distinct("hero_id").alias("distinct_heroes"),
        F.count_if(bucket == "short").alias("short_games"),
        F.count_if(bucket == "medium").alias("medium_games"),
        F.count_if(bucket == "long").alias("long_games"),
    )


def hero_roles(rows: DataFrame, role: str = "role_hint") -> DataFrame:
    """Matches and win rate per hero and role."""
    return rows.groupBy("account_id", "hero_id", role).agg(
        F.count(F.lit(1)).alias("matches"), F.avg(F.col("won").cast("double")).alias("win_rate")
    )


def detect(rows: DataFrame, minimum: int = 5, hot_rows: int | None = None) -> DataFrame:
    """Ranked summary observations of every account; ``rows`` carry the session place."""
    placed = numbered(rows, hot_rows=hot_rows)
    back = F.col("n") - F.col("rn")
    won = F.coalesce(F.col("won").cast("int"), F.lit(0))
    bucket = duration_bucket(F.col("duration_seconds"))
    groups = {
        "long": bucket == "long",
        "short": bucket == "short",
        "early": F.coalesce("session_index", F.lit(0)) <= 3,
        "late": F.coalesce("session_index", F.lit(0)) >= 4,
        "recent": back < 20,
        "prior": (back >= 20) & (back < 60),
    }
    deaths = F.col("deaths").cast("double")
    wide = placed.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(won).alias("w"),
        *[F.count_if(c).alias(f"{k}_n") for k, c in groups.items()],
        *[F.sum(F.when(c, won).otherwise(0)).alias(f"{k}_w") for k, c in groups.items()],
        F.count(deaths).alias("deaths_n"),
        F.stddev_pop(deaths).alias("deaths_sd"),
    )
    # Upper median: the element at place floor(n / 2), found on the counts of the death totals.
    over = Window.partitionBy("account_id").orderBy("deaths")
    upper = (
        rows.where(F.col("deaths").isNotNull())
        .groupBy("account_id", "deaths")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumns({"_cum": F.sum("c").over(over), "_n": F.sum("c").over(Window.partitionBy("account_id"))})
        .where(F.col("_cum") > F.floor(F.col("_n") / 2))
        .groupBy("account_id")
        .agg(F.min("deaths").cast("double").alias("deaths_upper_median"))
    )
    wide = wide.join(upper, "account_id", "left")
    no_hero = F.lit(None).cast("bigint")

    def row(pattern, effect, sample, stability, action, confidence, baseline, hero=no_hero) -> list[Column]:
        return [
            F.col("account_id"),
            pattern.alias("pattern_id"),
            hero.alias("hero_id"),
            effect.cast("double").alias("effect"),
            sample.cast("bigint").alias("sample_size"),
            stability.cast("double").alias("stability"),
            F.lit(action).alias("actionability"),
            confidence.cast("double").alias("confidence"),
            baseline.cast("double").alias("baseline"),
        ]

    n = F.col("n")
    overall = wide.select(
        *row(
            F.lit("overall_outcome_profile"),
            ratio(F.col("w"), n),
            n,
            sample_confidence(n),
            0.35,
            sample_confidence(n),
            F.lit(0.5),
        )
    )

    def contrast(left: str, right: str, name, action: float, keep) -> DataFrame:
        ln, lw, rn, rw = (F.col(f"{left}_n"), F.col(f"{left}_w"), F.col(f"{right}_n"), F.col(f"{right}_w"))
        effect = ratio(lw, ln) - ratio(rw, rn)
        return wide.where((ln >= minimum) & (rn >= minimum) & keep(effect)).select(
            *row(
                name(effect),
                effect,
                ln,
                _stability(lw, ln, rw, rn),
                action,
                sample_confidence(F.least(ln, rn)),
                ratio(rw, rn),
            )
        )

    def signed(prefix: str, below: str, above: str):
        return lambda effect: F.when(effect < 0, f"{prefix}_{below}").otherwise(f"{prefix}_{above}")

    parts = [
        overall,
        contrast(
            "long", "short", signed("long_game", "decline", "improvement"), 0.76, lambda e: F.abs(e) >= 0.12
        ),
        contrast("late", "early", lambda e: F.lit("session_decline"), 0.82, lambda e: e < -0.12),
        contrast("recent", "prior", signed("recent", "decline", "improvement"), 0.66, lambda e: F.abs(e) >= 0.12),
    ]

    heroes = rows.where(F.col("hero_id").isNotNull()).groupBy("account_id", "hero_id").agg(
        F.count(F.lit(1)).alias("hn"), F.sum(won).alias("hw")
    )
    with_rest = heroes.join(wide.select("account_id", "n", "w"), "account_id").withColumns(
        {"on": F.col("n") - F.col("hn"), "ow": F.col("w") - F.col("hw")}
    )
    effect = ratio(F.col("hw"), F.col("hn")) - ratio(F.col("ow"), F.col("on"))
    parts.append(
        with_rest.where((F.col("hn") >= minimum) & (F.col("on") >= minimum) & (effect >= 0.12)).select(
            *row(
                F.lit("hero_overperformance"),
                effect,
                F.col("hn"),
                _stability(F.col("hw"), F.col("hn"), F.col("ow"), F.col("on")),
                0.78,
                sample_confidence(F.least("hn", "on")),
                ratio(F.col("ow"), F.col("on")),
                F.col("hero_id"),
            )
        )
    )
    top = heroes.groupBy("account_id").agg(
        F.max(F.struct("hn", (-F.col("hero_id")).alias("h"))).alias("t"),
        F.sum("hn").alias("total"),
        F.count(F.lit(1)).alias("distinct"),
    )
    share = ratio(F.col("t.hn"), F.col("total"))
    parts.append(
        top.where((F.col("t.hn") >= max(minimum, 8)) & (share >= 0.45)).select(
            *row(
                F.lit("hero_specialization"),
                share,
                F.col("t.hn"),
                sample_confidence(F.col("t.hn")),
                0.58,
                sample_confidence(F.col("t.hn")),
                1.0 / F.col("distinct"),
                -F.col("t.h"),
            )
        )
    )
    parts.append(
        wide.where((F.col("deaths_n") >= max(2 * minimum, 10)) & (F.col("deaths_sd") >= 2.5)).select(
            *row(
                F.lit("consistency_collapse"),
                F.col("deaths_sd"),
                F.col("deaths_n"),
                sample_confidence(F.col("deaths_n")),
                0.7,
                sample_confidence(F.col("deaths_n")),
                F.col("deaths_upper_median"),
            )
        )
    )
    strength = F.least(F.lit(1.0), F.abs("effect"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    found = reduce(lambda a, b: a.unionByName(b), parts).withColumn(
        "priority", strength * clip(F.col("confidence")) * clip(F.col("actionability"))
    )
    # A handful of observations per account (at most one per hero of the game plus seven).
    order = Window.partitionBy("account_id").orderBy(F.desc("priority"), "pattern_id", "hero_id")
    return found.withColumn("rank", F.row_number().over(order))


# Pattern, hypothesis suffix, explanation, evidence families, and the positive, negative
# and control definitions as (kind, bucket, outcome).
TEMPLATES = (
    (
        "hero_overperformance",
        "timing_difference",
        "timing_difference",
        ("summary", "role", "economy"),
        (("hero_and_outcome", None, True), ("hero_and_outcome", None, False), ("non_hero_same_role", None, None)),
    ),
    (
        "hero_overperformance",
        "safer_engagement",
        "death_risk_difference",
        ("summary", "role", "events"),
        (("hero_and_outcome", None, True), ("hero_and_outcome", None, False), ("non_hero_same_role", None, None)),
    ),
    (
        "hero_overperformance",
        "familiarity_control",
        "familiarity_control",
        ("summary", "role", "hero_pool"),
        (("hero", None, None), ("non_hero_same_role", None, False), ("non_hero_same_role", None, True)),
    ),
    *[
        (
            pattern,
            suffix,
            explanation,
            families,
            (
                ("duration_and_outcome", "long", True),
                ("duration_and_outcome", "long", False),
                ("duration_bucket", "short", None),
            ),
        )
        for pattern in ("long_game_decline", "long_game_improvement")
        for suffix, explanation, families in (
            ("advantage_conversion", "advantage_conversion", ("summary", "time_series", "events")),
            ("late_deaths", "late_death_risk", ("summary", "events")),
        )
    ],
    *[
        (
            "session_decline",
            suffix,
            explanation,
            families,
            (
                ("session_position_and_outcome", ">=4", False),
                ("session_position_and_outcome", ">=4", True),
                ("session_position", "<=3", None),
            ),
        )
        for suffix, explanation, families in (
            ("decision_risk", "session_risk", ("summary", "events")),
            ("hero_selection", "hero_familiarity", ("summary", "hero_pool", "role")),
        )
    ],
    *[
        (
            pattern,
            "pool_shift",
            "recent_context_shift",
            ("summary", "hero_pool", "role"),
            (("outcome", None, True), ("outcome", None, False), ("duration_bucket", "medium", None)),
        )
        for pattern in ("recent_improvement", "recent_decline")
    ],
    (
        "consistency_collapse",
        "context_variance",
        "context_variance",
        ("summary", "role", "hero_pool"),
        (("outcome", None, False), ("outcome", None, True), ("duration_bucket", "medium", None)),
    ),
    (
        "hero_specialization",
        "familiarity_vs_transfer",
        "familiarity_control",
        ("summary", "role", "hero_pool"),
        (("hero", None, None), ("non_hero_same_role", None, False), ("non_hero_same_role", None, True)),
    ),
)
_PREDICATE = "struct<kind:string,bucket:string,won:boolean>"


def hypotheses(patterns: DataFrame) -> DataFrame:
    """Hypotheses of the found patterns, from a fixed table of templates."""
    rules = patterns.sparkSession.createDataFrame(
        [(p, s, e, list(f), *d) for p, s, e, f, d in TEMPLATES],
        "pattern_id string, suffix string, explanation string, families array<string>, "
        f"positive {_PREDICATE}, negative {_PREDICATE}, control {_PREDICATE}",
    )
    return patterns.join(F.broadcast(rules), "pattern_id").select(
        "account_id",
        F.concat_ws(":", "pattern_id", "suffix").alias("hypothesis_id"),
        F.col("pattern_id").alias("source_pattern_id"),
        "hero_id",
        "explanation",
        "families",
        "priority",
        "positive",
        "negative",
        "control",
    )


def primary_hypotheses(found: DataFrame, limit: int = 3) -> DataFrame:
    """The best hypothesis of each source pattern first, then the best of the rest."""
    by_account = Window.partitionBy("account_id")
    order = (F.desc("priority"), "hypothesis_id", "hero_id")
    ranked = found.withColumn("_k", F.row_number().over(by_account.orderBy(*order))).withColumn(
        "_p", F.row_number().over(Window.partitionBy("account_id", "source_pattern_id").orderBy("_k"))
    )
    chosen = ranked.withColumn("place", F.row_number().over(by_account.orderBy(F.col("_p") > 1, "_k")))
    return chosen.where(F.col("place") <= limit).drop("_k", "_p")


def _matches(predicate: str) -> Column:
    """A predicate row as one boolean expression over the match row."""
    kind, bucket, won = F.col(f"{predicate}.kind"), F.col(f"{predicate}.bucket"), F.col(f"{predicate}.won")
    same_hero = F.col("hero_id") == F.col("h_hero_id")
    other_hero = ~F.coalesce(same_hero, F.lit(False))
    outcome = F.col("won") == won
    duration = duration_bucket(F.col("duration_seconds")) == bucket
    place = F.coalesce("session_index", F.lit(0))
    position = F.when(bucket == ">=4", place >= 4).otherwise(place <= 3)
    return F.coalesce(
        F.when(kind == "hero_and_outcome", same_hero & outcome)
        .when(kind == "hero", same_hero)
        .when(kind == "non_hero_same_role", other_hero & (won.isNull() | outcome))
        .when(kind == "duration_bucket", duration)
        .when(kind == "duration_and_outcome", duration & outcome)
        .when(kind == "session_position", position)
        .when(kind == "session_position_and_outcome", position & outcome)
        .when(kind == "outcome", outcome),
        F.lit(False),
    )


def candidates(rows: DataFrame, primary: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """Matches that can serve a hypothesis, with their role for each and the selection values.

    A match meeting several definitions of one hypothesis keeps the last of positive, negative
    and control.  An account has at most three primary hypotheses, so the join adds at most two
    rows per match.  Several heroes can share a hypothesis id; the later one wins.
    """
    rules = primary.select(
        "account_id",
        "place",
        "hypothesis_id",
        F.col("hero_id").alias("h_hero_id"),
        "families",
        "priority",
        "positive",
        "negative",
        "control",
    )
    last = Window.partitionBy("account_id", "hypothesis_id").orderBy(F.desc("place"))
    rules = rules.withColumn("_l", F.row_number().over(last)).where(F.col("_l") == 1).drop("_l")
    role = F.when(_matches("control"), "control").when(_matches("negative"), "negative").when(
        _matches("positive"), "positive"
    )
    # The rules are a small table keyed like the rows; the shuffle of the rows is by account.
    joined = rows.join(rules, "account_id").withColumn("role_in", role).where(F.col("role_in").isNotNull())
    merged = joined.groupBy("account_id", "match_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("hypothesis_id", "role_in")))).alias("evidence_roles"),
        F.array_distinct(F.flatten(F.collect_list("families"))).alias("required"),
        F.sum("priority").alias("reuse"),
        *[F.first(c).alias(c) for c in ("hero_id", "session_index", "duration_seconds", "won", "deaths", "started_at")],
    )
    families = F.array_compact(
        F.array(F.lit("summary"), F.lit("outcome"), F.when(F.col("hero_id").isNotNull(), F.lit("hero_pool")))
    )
    if available is not None:
        merged = merged.join(available, ["account_id", "match_id"], "left")
        families = F.array_union(families, F.coalesce("families", F.array().cast("array<string>")))
    missing = F.array_sort(F.array_except("required", families))
    deaths = F.col("deaths")

    def context(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), 0.15).otherwise(0.0) if name in merged.columns else F.lit(0.0)

    return merged.select(
        "account_id",
        "match_id",
        "evidence_roles",
        "reuse",
        F.least(
            F.lit(1.0),
            0.5
            + F.when(F.col("hero_id").isNotNull(), 0.1).otherwise(0.0)
            + F.when(F.col("session_index").isNotNull(), 0.1).otherwise(0.0)
            + F.when(duration_bucket(F.col("duration_seconds")).isin("long", "short"), 0.1).otherwise(0.0),
        ).alias("relevance"),
        F.least(
            F.lit(1.0),
            0.5 + F.when(F.col("won"), 0.1).otherwise(0.0) + F.when(deaths >= 6, 0.25).otherwise(0.0),
        ).alias("contrast"),
        F.least(F.lit(1.0), sum((context(c) for c in CONTEXT), F.lit(0.4))).alias("comparability"),
        F.when(deaths.isNull(), 0.4).otherwise(F.least(F.lit(1.0), 0.4 + deaths / 12)).alias("extremeness"),
        missing.alias("missing_families"),
        (F.size(missing) == 0).alias("already_available"),
        F.when(F.size(missing) == 0, 0.0).otherwise(1.0).alias("detail_cost"),
    ).withColumn(
        "base_value",
        0.22 * F.col("relevance")
        + 0.20 * F.col("contrast")
        + 0.18 * F.col("comparability")
        + 0.14 * F.col("extremeness")
        + 0.16 * F.least(F.lit(1.0), F.col("reuse"))
        + 0.10 * F.when(F.col("already_available"), 1.0).otherwise(0.0),
    )


def contenders(options: DataFrame, limit: int = 25, hot_rows: int | None = None) -> DataFrame:
    """The candidates that a selection of ``limit`` matches can ever reach.

    The gain of a candidate depends on the state only through its roles and its cost, so among
    candidates with the same roles and cost the order is fixed by base value and match id, and
    no selection of ``limit`` matches goes past the first ``limit`` of them.  The cut is exact.
    """
    keys = ("account_id", "_signature", "detail_cost")
    signed = options.withColumns(
        {
            "_signature": F.concat_ws(
                ";", F.transform(F.map_entries("evidence_roles"), lambda e: F.concat_ws("=", e["key"], e["value"]))
            ),
            "_value": -F.col("base_value"),
        }
    )
    placed = scan(
        chunked(signed, keys, "_value", hot_rows),
        keys,
        ("_value", "match_id"),
        {"_k": ("sum", F.lit(1).cast("bigint"))},
    )
    return unchunked(placed.where(F.col("_k") <= limit)).drop("_k", "_value", "_signature")


def plan_selection(
    options: DataFrame,
    primary: DataFrame,
    limit: int = 25,
    max_cost: float = 50.0,
    minimum_gain: float = 0.05,
    target: int = 3,
) -> DataFrame:
    """Greedy choice of matches by marginal information gain, at most ``limit`` per account."""
    last = Window.partitionBy("account_id", "hypothesis_id").orderBy(F.desc("place"))
    priorities = (
        primary.withColumn("_l", F.row_number().over(last))
        .where(F.col("_l") == 1)
        .groupBy("account_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("hypothesis_id", "priority"))).alias("priorities"))
    )
    work = contenders(options, limit).select(
        "account_id", "match_id", "evidence_roles", "base_value", "detail_cost"
    ).join(priorities, "account_id")

    def choose(pdf):
        import pandas as pd

        weights = dict(pdf["priorities"].iloc[0])
        rows = [
            (int(m), dict(roles), float(base), float(cost))
            for m, roles, base, cost in zip(
                pdf["match_id"], pdf["evidence_roles"], pdf["base_value"], pdf["detail_cost"]
            )
        ]
        left = {(h, g): target for h in weights for g in ("positive", "negative", "control")}
        chosen, taken, cost_so_far = [], set(), 0.0
        while len(chosen) < limit:
            best = None
            for match, roles, base, cost in rows:
                if match in taken or cost_so_far + cost > max_cost:
                    continue
                useful = [(h, g) for h, g in roles.items() if left.get((h, g), 0) > 0]
                if not useful:
                    continue
                information = sum(weights[h] / left[(h, g)] for h, g in useful)
                gain = max(0.0, base + information - min(0.7, len(chosen) * 0.015) - 0.04 * cost)
                if gain < minimum_gain:
                    continue
                key = (gain, len(useful), len(roles), -match)
                if best is None or key > best[0]:
                    best = (key, match, useful, cost)
            if best is None:
                break
            (gain, *_), match, useful, cost = best
            taken.add(match)
            cost_so_far += cost
            for need in useful:
                left[need] -= 1
            chosen.append((match, len(chosen) + 1, gain, ";".join(f"{h}={g}" for h, g in sorted(useful))))
        out = pd.DataFrame(chosen, columns=["match_id", "selection_order", "gain", "supports"])
        out.insert(0, "account_id", pdf["account_id"].iloc[0])
        return out

    # The cut above leaves at most ``limit`` rows per role combination, so a group is small.
    return work.groupBy("account_id").applyInPandas(
        choose, "account_id bigint, match_id bigint, selection_order bigint, gain double, supports string"
    )


def plan_state(
    plan: DataFrame,
    options: DataFrame,
    primary: DataFrame,
    limit: int = 25,
    max_cost: float = 50.0,
    target: int = 3,
) -> DataFrame:
    """Why each account's selection stopped, what it costs, and the evidence it still lacks.

    One row for each account with a hypothesis; ``open_needs`` lists hypothesis, group and matches missing,
    at most three groups of three hypotheses.
    """
    chosen = plan.join(options.select("account_id", "match_id", "detail_cost"), ["account_id", "match_id"])
    spent = chosen.groupBy("account_id").agg(F.count(F.lit(1)).alias("selected"), F.sum("detail_cost").alias("cost"))
    offered = options.groupBy("account_id").agg(F.count_distinct("match_id").alias("offered"))
    given = (
        plan.where(F.col("supports") != "")
        .select("account_id", F.explode(F.split("supports", ";")).alias("s"))
        .groupBy("account_id", F.substring_index("s", "=", 1).alias("hypothesis_id"), F.substring_index("s", "=", -1).alias("group"))
        .agg(F.count(F.lit(1)).alias("given"))
    )
    groups = F.explode(F.array(*[F.lit(g) for g in ("control", "negative", "positive")]))
    needs = primary.select("account_id", "hypothesis_id").distinct().select("*", groups.alias("group"))
    missing = F.lit(target) - F.coalesce("given", F.lit(0))
    left = needs.join(given, ["account_id", "hypothesis_id", "group"], "left").groupBy("account_id").agg(
        F.array_sort(
            F.collect_list(F.when(missing > 0, F.struct("hypothesis_id", "group", missing.alias("missing"))))
        ).alias("open_needs")
    )
    selected, cost = F.coalesce("selected", F.lit(0)), F.coalesce("cost", F.lit(0.0))
    return left.join(spent, "account_id", "left").join(offered, "account_id", "left").select(
        "account_id",
        selected.alias("selected"),
        cost.alias("cost"),
        F.when(selected >= limit, "max_deep_matches")
        .when(cost >= max_cost, "max_data_cost")
        .when(F.coalesce("offered", F.lit(0)) == 0, "no_candidates")
        .when(selected >= F.col("offered"), "evidence_sufficient")
        .otherwise("marginal_gain_exhausted")
        .alias("stopping_reason"),
        "open_needs",
    )


def hydrate(plan: DataFrame, stored: DataFrame, options: DataFrame) -> DataFrame:
    """Where each planned match gets its detail from: stored, not needed, or to be read."""
    flags = options.select("account_id", "match_id", "already_available")
    have = stored.select("match_id").distinct().withColumn("_have", F.lit(True))
    return (
        plan.join(flags, ["account_id", "match_id"], "left")
        .join(have, "match_id", "left")
        .withColumn(
            "source",
            F.when(F.col("_have"), "stored").when(F.col("already_available"), "not_needed").otherwise("read"),
        )
        .drop("_have", "already_available")
    )


def evaluate_hypotheses(
    primary: DataFrame, plan: DataFrame, options: DataFrame, features: DataFrame, quality: DataFrame | None = None
) -> DataFrame:
    """Positive, negative and control means of every hypothesis over its selected matches.

    ``quality`` has the evidence families of a match as ``by_family``; without it every family
    counts as present.
    """
    roles = (
        plan.join(options.select("account_id", "match_id", "evidence_roles"), ["account_id", "match_id"])
        .select("account_id", "match_id", F.explode("evidence_roles").alias("hypothesis_id", "role_in"))
        .join(
            features.select("account_id", "match_id", "deaths", "gold_per_min", "won"), ["account_id", "match_id"]
        )
        .join(
            primary.groupBy("account_id", "hypothesis_id").agg(
                F.max_by(F.struct("explanation", "families"), "place").alias("h")
            ),
            ["account_id", "hypothesis_id"],
        )
    )
    if quality is not None:
        roles = roles.join(quality.select("account_id", "match_id", "by_family"), ["account_id", "match_id"], "left")
        weakest = F.array_min(
            F.transform("h.families", lambda f: F.coalesce(F.try_element_at("by_family", f), F.lit(0.0)))
        )
    else:
        weakest = F.lit(1.0)
    kind = F.col("h.explanation")
    value = (
        F.when(kind.isin("death_risk_difference", "late_death_risk", "session_risk"), F.col("deaths").cast("double"))
        .when(kind == "timing_difference", F.col("gold_per_min").cast("double"))
        .otherwise(F.col("won").cast("double"))
    )
    part = F.col("role_in")
    rolled = roles.groupBy("account_id", "hypothesis_id").agg(
        F.avg(weakest).alias("data_quality"),
        *[F.count_if(part == p).alias(f"{p}_matches") for p in ("positive", "negative", "control")],
        *[F.avg(F.when(part == p, value)).alias(f"{p}_value") for p in ("positive", "negative", "control")],
    )
    sizes = F.least("positive_matches", "negative_matches", "control_matches")
    effect = F.col("positive_value") - F.col("control_value")
    enough = (sizes >= 2) & (F.col("data_quality") >= 1.0)
    confidence = (
        F.when(~enough | (sizes < 3) | effect.isNull(), "low")
        .when((sizes >= 8) & (F.abs(effect) >= 0.15), "high")
        .otherwise("moderate")
    )
    return rolled.withColumns({"effect": F.when(enough, effect), "confidence": confidence}).withColumn(
        "status",
        F.when(~enough, "insufficient_evidence").when(F.col("confidence") != "low", "resolved").otherwise("moderate"),
    )

