"""The heroes of an account: eligibility, threads, exceptions, mirror, identity, recommendations.

Everything here works on the table of (account, hero) counts and sums, which has at most one row
per hero of the game for an account; arrays collected per account are bounded by the roster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitscope.constants import DEMANDS, FAMILIES, JOBS, ROLE_FAMILIES, ROLE_POSITIONS
from habitscope.functions.expr import LN2, clamp, ratio
from habitscope.operators.patterns import let
from habitscope.operators.pools import diversity, familiar_pool, shift_of_counts
from habitscope.operators.windows import balanced_windows, numbered, persistence, quarter_recurrence
from habitscope.sources.heroes import family_of, literal_map, packed_roster
from habitscope.sources.views import TRAITS

ROLE_KEYS = ("carry", "mid", "offlane", "soft_support", "hard_support", "roamer", "jungle")


def dimension(knowledge: DataFrame) -> DataFrame:
    """The hero dimension; whether a join broadcasts it follows from its size."""
    return knowledge


def with_roster(accounts: DataFrame, dimension: DataFrame) -> DataFrame:
    """``accounts`` with the roster in one array column, packed to a single row inside the plan."""
    return accounts.join(F.broadcast(packed_roster(dimension)), F.lit(True))


def full_metrics() -> Column:
    return (
        (F.col("duration_seconds") >= 600)
        & F.col("kills").isNotNull()
        & F.col("deaths").isNotNull()
        & F.col("assists").isNotNull()
    )


# Eligibility ---------------------------------------------------------------------------------


def eligibility(rows: DataFrame, knowledge: DataFrame, semantic: bool = True) -> DataFrame:
    """Share, recency and coverage of each hero, three gates and the ordered reasons."""
    placed = numbered(rows.where(F.col("hero_id").isNotNull()))
    full = F.coalesce(full_metrics(), F.lit(False))
    counted = placed.groupBy("account_id", "hero_id").agg(
        F.count(F.lit(1)).alias("matches"),
        F.first("n").alias("_n"),
        F.max("rn").alias("_latest"),
        F.count_if(full).alias("_full"),
    )
    known = F.col("reviewed") & (F.size("functions") > 0) if semantic else F.col("available")
    joined = counted.join(
        dimension(knowledge).select("hero_id", known.alias("_known")), "hero_id", "left"
    ).withColumns(
        {
            "share": F.col("matches") / F.col("_n"),
            "recency": (F.col("_latest") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)),
            "coverage": F.when(F.coalesce("_known", F.lit(False)), 1.0).otherwise(0.0),
        }
    )
    n = F.col("matches")
    fresh = (F.col("recency") >= 0.20) | (n >= 8)
    base = (n >= 3) & (F.col("share") >= 0.03) & (F.col("coverage") >= 1.0) & fresh
    measured = (F.col("_full") >= 4) & (F.col("_full") / n >= 0.75)
    mirror = (n >= 4) & (F.col("share") >= 0.03) & fresh & measured
    few = n < 3
    reasons = F.array_compact(
        F.array(
            F.when(few, F.lit("too_few_matches")),
            F.when(F.col("share") < 0.03, F.lit("too_small_history_share")),
            F.when(
                F.col("coverage") < 1.0,
                F.lit("hero_semantics_unavailable" if semantic else "taxonomy_unavailable"),
            ),
            F.when(~fresh, F.lit("stale_without_sustained_coverage")),
            F.when(~few & (n < 4), F.lit("exception_sample_gate")),
            F.when(~mirror & ~measured, F.lit("mirror_metrics_missing_or_incomplete")),
            F.when(~mirror & measured & (n < 4) & ~few, F.lit("mirror_sample_gate")),
        )
    )
    return joined.select(
        "account_id",
        "hero_id",
        "matches",
        "share",
        "recency",
        "coverage",
        base.alias("for_common_thread"),
        (base & (n >= 4)).alias("for_exception"),
        mirror.alias("for_mirror"),
        reasons.alias("reasons"),
    )


# Common thread and exception -----------------------------------------------------------------


def _job_vector(knowledge: DataFrame, semantic: bool) -> DataFrame:
    """Long table of hero, feature and value: jobs as 0/1, or the trait values."""
    table = dimension(knowledge)
    if semantic:
        names = F.array(*[F.lit(j) for j in JOBS])
        return table.select("hero_id", "functions", F.explode(names).alias("feature")).select(
            "hero_id", "feature", F.array_contains("functions", F.col("feature")).cast("double").alias("value")
        )
    return table.select("hero_id", F.explode("traits").alias("feature", "value"))


def common_thread(eligible: DataFrame, knowledge: DataFrame, semantic: bool = True) -> DataFrame:
    """The job (or trait) that most of the established heroes share, when it stands out."""
    chosen = eligible.where(F.col("for_common_thread")).select("account_id", "hero_id", "matches")
    over = Window.partitionBy("account_id")
    sized = chosen.withColumns(
        {"_usage": F.sum("matches").over(over), "candidates": F.count(F.lit(1)).over(over)}
    ).where(F.col("candidates") >= 3)
    weight = F.least(F.col("matches").cast("double"), F.greatest(F.lit(3.0), F.col("_usage") * F.lit(0.35)))
    strong = F.col("value") >= (1.0 if semantic else 0.55)
    scored = (
        sized.withColumn("_w", weight)
        .join(_job_vector(knowledge, semantic), "hero_id")
        .groupBy("account_id", "feature")
        .agg(
            F.try_divide(F.sum(F.col("_w") * F.col("value")), F.greatest(F.sum("_w"), F.lit(1.0))).alias("score"),
            F.count_if(strong).alias("spread"),
            F.first("candidates").alias("candidates"),
        )
        .withColumn("total", 0.70 * F.col("score") + 0.30 * F.col("spread") / F.col("candidates"))
    )
    order = over.orderBy(F.desc("total"), "feature")
    ranked = scored.withColumns({"_k": F.row_number().over(order), "_next": F.lead("total").over(order)})
    top = ranked.groupBy("account_id").agg(
        F.max(
            F.when(
                F.col("_k") == 1,
                F.struct("feature", "score", "spread", "candidates", "total", F.coalesce("_next", F.lit(0.0)).alias("next")),
            )
        ).alias("t"),
        F.array_sort(F.collect_list(F.when(F.col("_k").between(2, 4), F.struct("_k", "feature")))).alias("_s"),
    )
    margin = F.col("t.total") - F.col("t.next")
    clear = (F.col("t.score") >= 0.35) & (margin >= 0.03)
    confidence = F.least(
        F.lit(1.0),
        0.45 * F.col("t.total")
        + 0.30 * F.least(F.lit(1.0), F.col("t.candidates") / 8.0)
        + 0.25 * F.least(F.lit(1.0), margin / 0.20),
    )
    return top.select(
        "account_id",
        F.when(clear, "available").otherwise("unavailable").alias("status"),
        F.when(clear, F.col("t.feature")).alias("trait"),
        F.col("t.score").alias("weighted_coverage"),
        F.col("t.spread").alias("hero_count"),
        F.col("t.candidates").alias("denominator"),
        margin.alias("margin"),
        F.when(clear, confidence).alias("confidence_score"),
        F.transform("_s", lambda s: s["feature"]).alias("secondary"),
    )


def exception(eligible: DataFrame, knowledge: DataFrame, semantic: bool = True) -> DataFrame:
    """The hero farthest from the centre of the others, when it stands out."""
    chosen = eligible.where(F.col("for_exception")).select("account_id", "hero_id", "matches")
    account = Window.partitionBy("account_id")
    sized = chosen.withColumn("candidates", F.count(F.lit(1)).over(account)).where(F.col("candidates") >= 4)
    vectors = sized.join(_job_vector(knowledge, semantic), "hero_id")
    feature = Window.partitionBy("account_id", "feature")
    others = (F.sum("value").over(feature) - F.col("value")) / (F.col("candidates") - 1)
    distances = (
        vectors.withColumn("_d", F.col("value") - others)
        .groupBy("account_id", "hero_id")
        .agg(
            F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("distance"),
            F.first("matches").alias("matches"),
            F.first("candidates").alias("candidates"),
        )
    )
    # Nine places keep equal distances equal whatever the order of summation.
    order = account.orderBy(F.desc(F.round("distance", 9)), "hero_id")
    ranked = distances.withColumns({"_k": F.row_number().over(order), "_next": F.lead("distance").over(order)}).where(
        F.col("_k") == 1
    )
    margin = F.col("distance") - F.coalesce("_next", F.lit(0.0))
    clear = (F.col("distance") >= 0.32) & (margin >= 0.06)
    confidence = F.least(
        F.lit(1.0),
        0.35 * F.least(F.lit(1.0), F.col("matches") / 10.0)
        + 0.35 * F.least(F.lit(1.0), F.col("distance") / 0.45)
        + 0.30 * F.least(F.lit(1.0), margin / 0.15),
    )
    return ranked.select(
        "account_id",
        F.when(clear, "available").otherwise("no_clear_exception").alias("status"),
        F.when(clear, F.col("hero_id")).alias("hero_id"),
        "distance",
        margin.alias("margin"),
        confidence.alias("confidence_score"),
        "candidates",
    )


# Pool evolution ------------------------------------------------------------------------------


def window_coverage(windowed: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Share of the rows of each window whose hero has reviewed jobs."""
    known = F.col("reviewed") & (F.size("functions") > 0)
    return (
        windowed.join(dimension(knowledge).select("hero_id", known.alias("_known")), "hero_id", "left")
        .groupBy("account_id", "window")
        .agg(F.avg(F.coalesce(F.col("_known"), F.lit(False)).cast("double")).alias("coverage"))
    )


def evolution(rows: DataFrame, knowledge: DataFrame, minimum: int = 12, maximum: int = 24) -> DataFrame:
    """Movement of heroes and of jobs between two balanced windows, as one of four variants."""
    windowed = balanced_windows(rows.where(F.col("hero_id").isNotNull()), maximum).where(F.col("n") >= 2 * minimum)
    older, newer = F.col("window") == "previous", F.col("window") == "recent"

    def counts(frame: DataFrame, by: str) -> DataFrame:
        return frame.groupBy("account_id", by).agg(F.count_if(older).alias("a"), F.count_if(newer).alias("b"))

    jobs = counts(
        windowed.join(
            dimension(knowledge).where(F.col("reviewed")).select("hero_id", "functions"), "hero_id"
        ).select("account_id", "window", F.explode("functions").alias("job")),
        "job",
    )
    hero_shift = shift_of_counts(counts(windowed, "hero_id"), "a", "b").select(
        "account_id", F.col("left_rows").alias("rows"), F.col("shift").alias("hero_shift")
    )
    toolkit = shift_of_counts(jobs, "a", "b").select(
        "account_id",
        F.when((F.col("left_rows") > 0) & (F.col("right_rows") > 0), F.col("shift")).otherwise(0.0).alias("toolkit_shift"),
    )
    account = Window.partitionBy("account_id")

    def leading(column: str) -> Column:
        rank = F.row_number().over(account.orderBy(F.desc(column), "job"))
        return (rank <= 3) & (F.col(column) / F.sum(column).over(account) >= 0.06)

    overlap = (
        jobs.withColumns({"_a": leading("a"), "_b": leading("b")})
        .groupBy("account_id")
        .agg((F.count_if(F.col("_a") & F.col("_b")) / 3.0).alias("overlap"))
    )
    covered = window_coverage(windowed, knowledge).groupBy("account_id").agg(F.min("coverage").alias("coverage"))
    moved, changed = F.col("hero_shift") >= 0.22, F.col("toolkit_shift") >= 0.18
    variant = (
        F.when(moved & changed, "new_heroes_new_toolkit")
        .when(moved, "new_heroes_same_toolkit")
        .when(changed & (F.col("overlap") >= 0.35), "stable_core_new_branch")
        .otherwise("broadly_stable")
    )
    usable = F.col("coverage") >= 0.80
    confidence = F.least(
        F.lit(1.0),
        0.55 * F.least(F.lit(1.0), F.col("rows") / float(maximum))
        + 0.25 * F.col("coverage")
        + 0.20 * F.least(F.lit(1.0), (F.col("hero_shift") + F.col("toolkit_shift")) / 0.5),
    )
    return (
        hero_shift.join(covered, "account_id")
        .join(toolkit, "account_id", "left")
        .join(overlap, "account_id", "left")
        .na.fill(0.0, ["toolkit_shift", "overlap"])
        .select(
            "account_id",
            F.when(usable, "available").otherwise("unavailable").alias("status"),
            F.when(usable, variant).alias("variant"),
            "rows",
            "coverage",
            "hero_shift",
            "toolkit_shift",
            "overlap",
            F.when(usable, confidence).alias("confidence_score"),
        )
    )


# Mirror --------------------------------------------------------------------------------------


def behaviour_units(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums behind involvement, finishing, deaths and the role distribution; all are ratios of sums."""
    return (
        rows.where(full_metrics())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col("kills")).alias("k"),
            F.sum(F.col("assists")).alias("a"),
            F.sum(F.col("deaths")).alias("d"),
            F.sum(F.col("duration_seconds") / 60.0).alias("minutes"),
            *[F.count_if(F.col("role_hint") == r).alias(f"r_{r}") for r in ROLE_KEYS],
        )
    )


_SUMS = ("rows", "k", "a", "d", "minutes", *[f"r_{r}" for r in ROLE_KEYS])


def _vector(get) -> dict[str, Column]:
    roles = reduce(lambda x, y: x + y, [get(f"r_{r}") for r in ROLE_KEYS])
    return {
        "involvement": (get("k") + get("a")) / F.greatest(get("minutes"), F.lit(1e-9)),
        "finishing": get("k") / F.greatest(get("k") + get("a"), F.lit(1)),
        "deaths": get("d") / F.greatest(get("minutes") / 10.0, F.lit(1e-9)),
        **{f"role:{r}": ratio(get(f"r_{r}"), roles) for r in ROLE_KEYS},
    }


def mirror_scores(rows: DataFrame, eligible: DataFrame) -> DataFrame:
    """Every candidate hero against the account's play on all other heroes.

    The reference is the account's sums minus the hero's sums.  Where fewer than twelve other
    rows exist some of the hero's own first rows join the reference.
    """
    per_hero = behaviour_units(rows.where(F.col("hero_id").isNotNull()), ["account_id", "hero_id"])
    per_account = behaviour_units(rows, ["account_id"]).select(
        "account_id", *[F.col(c).alias(f"t_{c}") for c in _SUMS]
    )
    candidates = eligible.where(F.col("for_mirror")).select("account_id", "hero_id", "matches")
    joined = candidates.join(per_hero, ["account_id", "hero_id"]).join(per_account, "account_id")
    joined = joined.withColumns({f"o_{c}": F.col(f"t_{c}") - F.col(c) for c in _SUMS}).where(F.col("o_rows") > 0)
    short = F.col("o_rows") < 12
    borrowed = F.least(F.col("rows"), F.greatest(F.lit(3), F.floor(F.col("o_rows") / 2)))
    # Only short references need rows: their first rows of the hero, at most five.
    need = joined.where(short).select("account_id", "hero_id", borrowed.alias("_borrow"))
    first = (
        numbered(
            rows.where(full_metrics()).join(need.select("account_id", "hero_id"), ["account_id", "hero_id"], "left_semi"),
            keys=("account_id", "hero_id"),
        )
        .join(need, ["account_id", "hero_id"])
        .where(F.col("rn") <= F.col("_borrow"))
    )
    extra = behaviour_units(first, ["account_id", "hero_id"]).select(
        "account_id", "hero_id", *[F.col(c).alias(f"x_{c}") for c in _SUMS]
    )
    table = joined.join(extra, ["account_id", "hero_id"], "left")
    observed = _vector(lambda c: F.col(c))
    reference = _vector(lambda c: F.col(f"o_{c}") + F.coalesce(F.col(f"x_{c}"), F.lit(0)))
    weight = F.least(F.lit(1.0), F.col("matches") / 20.0)
    scales = {"involvement": 0.35, "finishing": 0.20, "deaths": 0.75}
    shrunk = {k: reference[k] + (observed[k] - reference[k]) * weight for k in observed}
    parts = [
        F.least(F.lit(2.0), F.abs(shrunk[k] - reference[k]) / scale) for k, scale in scales.items()
    ]
    roles = 0.5 * reduce(
        lambda x, y: x + y, [F.abs(shrunk[f"role:{r}"] - reference[f"role:{r}"]) for r in ROLE_KEYS]
    )
    total = parts[0] + parts[1] + parts[2]
    has_roles = roles.isNotNull()
    similarity = F.exp(-F.when(has_roles, (total + roles) / 4).otherwise(total / 3))
    coverage = F.when(has_roles, 1.0).otherwise(0.75)
    penalty = F.when(short, 0.82).otherwise(1.0)
    return table.select(
        "account_id",
        "hero_id",
        similarity.alias("similarity"),
        weight.alias("sample_confidence"),
        coverage.alias("dimension_coverage"),
        penalty.alias("penalty"),
        (similarity * (0.65 + 0.35 * weight) * penalty).alias("final_score"),
        F.col("o_rows").alias("reference_rows"),
        shrunk["involvement"].alias("involvement"),
        shrunk["finishing"].alias("finishing"),
        shrunk["deaths"].alias("deaths"),
    )


def mirror(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("account_id").orderBy(
        F.desc(F.round("final_score", 9)), F.desc(F.round("similarity", 9)), F.desc("hero_id")
    )
    ranked = scores.withColumns({"_k": F.row_number().over(order), "_next": F.lead("final_score").over(order)}).where(
        F.col("_k") == 1
    )
    margin = F.col("final_score") - F.coalesce("_next", F.lit(0.0))
    confidence = F.col("sample_confidence") * F.col("dimension_coverage") * F.col("penalty")
    clear = (
        (confidence >= 0.35) & (F.col("dimension_coverage") >= 0.75) & (F.col("final_score") >= 0.55) & (margin >= 0.04)
    )
    return ranked.select(
        "account_id",
        F.when(clear, "available").otherwise("no_clear_mirror").alias("status"),
        F.when(clear, F.col("hero_id")).alias("hero_id"),
        "final_score",
        margin.alias("margin"),
        confidence.alias("confidence_score"),
        five_zone(F.col("involvement"), *ZONES["involvement"]).alias("involvement_label"),
        five_zone(F.col("finishing"), *ZONES["finishing"]).alias("finishing_label"),
        five_zone(F.col("deaths"), *ZONES["deaths"]).alias("death_label"),
    )


# Cuts and labels of the behaviour zones.
ZONES = {
    "involvement": ((0.25, 0.45, 0.70, 0.95), ("Quiet", "Selective", "Present", "Active", "Everywhere")),
    "finishing": ((0.25, 0.40, 0.60, 0.75), ("Setup", "Support", "Split", "Closer", "Cleanup")),
    "deaths": ((0.50, 0.75, 1.00, 1.35), ("Elusive", "Safe", "Mixed", "Exposed", "Frequent")),
}


def five_zone(value: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    out = F.when(value < cuts[0], labels[0])
    for cut, name in zip(cuts[1:], labels[1:]):
        out = out.when(value < cut, name)
    return F.when(value.isNotNull(), out.otherwise(labels[-1]))


def stable_shuffle(items: Column, seed: Column) -> Column:
    """Options in the order of a hash of seed and key: stable, and free of row ids."""
    decorated = F.transform(
        items, lambda k: F.struct(F.sha2(F.concat(seed, F.lit("|"), k.cast("string")), 256).alias("h"), k.alias("k"))
    )
    return F.transform(F.array_sort(decorated), lambda d: d["k"])


# Identity ------------------------------------------------------------------------------------


def trait_vector(column: str = "traits") -> Column:
    return F.transform(
        F.array(*[F.lit(t) for t in TRAITS]), lambda t: F.coalesce(F.try_element_at(F.col(column), t), F.lit(0.5))
    )


def rms_similarity(left: Column, right: Column) -> Column:
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    mean = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(left)
    return clamp(1.0 - F.sqrt(mean))


def identity_components(rows: DataFrame, traits: DataFrame) -> DataFrame:
    """Seven components and the score of every stable hero of an account."""
    counted = rows.where(F.col("hero_id").isNotNull()).groupBy("account_id", "hero_id").agg(
        F.count(F.lit(1)).alias("matches"),
        F.max("started_at").alias("_last"),
        F.avg(F.coalesce("performance", F.lit(0.5))).alias("output"),
    )
    account = Window.partitionBy("account_id")
    totals = counted.withColumns(
        {"total": F.sum("matches").over(account), "_latest": F.max("_last").over(account)}
    )
    pool = familiar_pool(
        totals.select("account_id", "hero_id", F.col("matches").alias("c"), "total"),
        F.col("total"),
        minimum_games=5,
        strict=True,
    )
    roles = (
        rows.where(F.col("role_hint").isNotNull())
        .groupBy("account_id", "role_hint")
        .agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("started_at", "match_id")).alias("_first"))
        .groupBy("account_id")
        # The most common role; on equal counts the one seen first.
        .agg(F.max_by("role_hint", F.struct("c", (-F.col("_first.started_at")).alias("s"), (-F.col("_first.match_id")).alias("m"))).alias("dominant_role"))
    )
    heroes = dimension(traits).where(F.col("available")).select("hero_id", "role", trait_vector().alias("_v"))
    members = pool.join(heroes.select("hero_id", "_v"), "hero_id").groupBy("account_id").agg(
        # At most ten heroes.
        F.collect_list(F.struct("hero_id", "_v")).alias("_pool")
    )
    joined = (
        totals.where(F.col("matches") >= F.when(F.col("total") >= 60, 5).otherwise(3))
        .join(heroes, "hero_id")
        .join(quarter_recurrence(rows), ["account_id", "hero_id"])
        .join(persistence(rows), ["account_id", "hero_id"])
        .join(roles, "account_id", "left")
        .join(members, "account_id", "left")
    )
    others = F.filter("_pool", lambda p: p["hero_id"] != F.col("hero_id"))
    near = F.transform(others, lambda p: rms_similarity(F.col("_v"), p["_v"]))
    fit = F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(near))
    age = (F.col("_latest") - F.col("_last")) / 86_400.0
    table = joined.select(
        "account_id",
        "hero_id",
        "matches",
        "total",
        ((F.col("matches") + 1.5) / (F.col("total") + 3.0)).alias("frequency"),
        F.exp(-F.greatest(F.lit(0.0), age) * F.lit(LN2) / 60.0).alias("recency"),
        (F.col("quarters") / F.greatest(F.lit(1), F.least(F.lit(4), F.col("total")))).alias("repeat"),
        "persistence",
        F.when(F.col("dominant_role").isNull(), 0.5)
        .when(F.col("dominant_role") == F.col("role"), 1.0)
        .otherwise(0.45)
        .alias("role_fit"),
        clamp(F.col("output")).alias("comfort_output"),
        F.coalesce(fit, F.lit(0.5)).alias("semantic_fit"),
    )
    weights = {
        "frequency": 0.25,
        "recency": 0.15,
        "repeat": 0.15,
        "persistence": 0.10,
        "role_fit": 0.10,
        "comfort_output": 0.10,
        "semantic_fit": 0.15,
    }
    comfort = {"frequency": 0.35, "recency": 0.20, "repeat": 0.20, "role_fit": 0.10, "comfort_output": 0.15}
    add = lambda w: reduce(lambda x, y: x + y, [F.col(k) * v for k, v in w.items()])
    return table.withColumns({"score": add(weights), "comfort_score": add(comfort)})


def identity_picks(components: DataFrame) -> DataFrame:
    """The signature hero and the comfort picks of every account."""
    account = Window.partitionBy("account_id")
    ranked = components.withColumns(
        {
            "_best": F.max("score").over(account),
            "_eligible": (F.col("total") < 20) | (F.col("repeat") >= 0.50),
        }
    )
    signature = ranked.groupBy("account_id").agg(
        F.max(
            F.when(
                F.col("_best") - F.col("score") <= 0.02,
                F.struct("repeat", "persistence", "matches", (-F.col("hero_id")).alias("h")),
            )
        ).alias("s")
    )
    order = account.orderBy(F.desc(F.round("comfort_score", 9)), F.desc("matches"), "hero_id")
    comfort = (
        ranked.where(F.col("_eligible"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= F.when(F.col("total") < 60, 3).otherwise(5))
        .select("account_id", "hero_id", "place")
    )
    return (
        ranked.join(signature, "account_id")
        .join(comfort, ["account_id", "hero_id"], "left")
        .select(
            "account_id",
            "hero_id",
            "matches",
            "score",
            (F.col("hero_id") == -F.col("s.h")).alias("is_signature"),
            F.col("place").alias("comfort_place"),
            F.col("comfort_score"),
        )
        .where(F.col("is_signature") | F.col("comfort_place").isNotNull())
    )


# Trait families of the theme and the situations named for traits.
TRAIT_FAMILIES = {
    "engagement": ("initiation", "pickoff", "teamfight"),
    "movement": ("mobility", "repositioning", "global_presence"),
    "output": ("burst", "sustained_damage", "scaling"),
    "map_pressure": ("wave_clear", "push", "farm_dependency"),
    "protection": ("save", "sustain", "frontline"),
}
SITUATIONS = {
    "initiation": "the team lacks reliable initiation",
    "mobility": "the enemy lineup is highly mobile",
    "save": "the team needs save / reset options",
    "sustain": "the team needs sustained frontline presence",
    "wave_clear": "the team needs wave clear",
    "push": "the team needs global pressure or push",
    "global_presence": "the team needs global pressure",
    "burst": "the enemy backline is difficult to reach",
    "frontline": "the team needs stronger frontline presence",
    "repositioning": "the team needs stronger disengage",
    "pickoff": "the enemy draft is vulnerable to isolated pickoffs",
}


def situations(traits: Column, limit: int = 3) -> Column:
    """The first distinct situations named by a list of traits."""
    named = F.array_compact(F.transform(traits, lambda t: F.try_element_at(literal_map(SITUATIONS), t)))
    return F.slice(F.array_distinct(named), 1, limit)


def themes(picks: DataFrame, traits: DataFrame) -> DataFrame:
    """Best trait per family over the signature and comfort heroes, weighted by rarity in the roster."""
    heroes = dimension(traits).select("hero_id", F.explode("traits").alias("trait", "value"))
    rarity = heroes.groupBy("trait").agg(
        F.ln((F.count_distinct("hero_id") + 1.0) / (F.count_if(F.col("value") >= 0.65) + 1.0)).alias("idf")
    )
    weight = F.when(F.col("is_signature"), 1.0).otherwise(F.greatest(F.lit(0.25), F.col("comfort_score")))
    weighted = picks.select("account_id", "hero_id", weight.alias("w")).withColumn(
        "total", F.sum("w").over(Window.partitionBy("account_id"))
    )
    scored = (
        weighted.join(heroes, "hero_id")
        .groupBy("account_id", "trait")
        .agg(
            (F.sum(F.when(F.col("value") >= 0.65, F.col("w")).otherwise(0.0)) / F.first("total")).alias("agreement"),
            (F.sum(F.col("w") * F.col("value")) / F.first("total")).alias("intensity"),
        )
        .where(F.col("agreement") >= 0.60 - 1e-12)
        .join(rarity, "trait")
        .withColumn("score", F.col("agreement") * F.col("idf") * (0.5 + 0.5 * F.col("intensity")))
        .withColumn("family", F.try_element_at(literal_map({t: f for f, ts in TRAIT_FAMILIES.items() for t in ts}), F.col("trait")))
        .where(F.col("family").isNotNull())
    )
    best = Window.partitionBy("account_id", "family").orderBy(F.desc(F.round("score", 9)), "trait")
    winners = scored.withColumn("_k", F.row_number().over(best)).where(F.col("_k") == 1)
    order = Window.partitionBy("account_id").orderBy(F.desc(F.round("score", 9)), "family", "trait")
    return winners.select("account_id", "family", "trait", "score", F.row_number().over(order).alias("place"))


# Pool profile and toolkit --------------------------------------------------------------------


def _bits(names: Sequence[str], holds) -> Column:
    """One bit for each of a few fixed names, set where ``holds(name)`` is true."""
    return reduce(
        lambda x, y: x.bitwiseOR(y), [F.when(holds(n), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(names)]
    ).cast("bigint")


def job_bits(jobs: Column) -> Column:
    """The known jobs of an array as bits; null for a null array."""
    return F.when(jobs.isNotNull(), _bits(JOBS, lambda j: F.array_contains(jobs, F.lit(j))))


def mean_jaccard(sets: Column, bits: Column) -> Column:
    """Mean overlap of all pairs of job sets; the list has at most one set per hero of the game.

    ``bits`` are the known jobs of each set; where they tell a set apart in full, pairs are compared by them.  Both are
    named columns: an expression would be worked out again for each pair.
    """
    pairs = F.size(sets) * (F.size(sets) - 1) / 2

    def total(values: Column, overlap) -> Column:
        def with_later(one: Column, place: Column) -> Column:
            later = F.slice(values, place + 2, F.size(values))
            return F.aggregate(later, F.lit(0.0), lambda acc, other: acc + overlap(one, other))

        return F.aggregate(F.transform(values, with_later), F.lit(0.0), lambda acc, x: acc + x)

    by_bits = total(
        bits,
        lambda x, y: F.bit_count(x.bitwiseAND(y)) / F.greatest(F.bit_count(x.bitwiseOR(y)), F.lit(1)),
    )
    by_name = total(
        sets,
        lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)),
    )
    known = F.size(bits) == F.size(F.filter(F.zip_with(sets, bits, lambda x, y: F.size(x) == F.bit_count(y)), lambda k: k))
    return F.when(pairs > 0, F.when(known, by_bits).otherwise(by_name) / pairs).otherwise(0.0)


def relevant_families(roles: Column) -> Column:
    """Coverage families that matter for the credible roles, all five when none is known."""
    table = F.create_map(
        *[x for r, fs in ROLE_FAMILIES.items() for x in (F.lit(r), F.array(*[F.lit(f) for f in fs]))]
    )
    every = F.array(*[F.lit(f) for f in FAMILIES])
    wanted = F.flatten(F.array_compact(F.transform(roles, lambda r: F.try_element_at(table, r))))
    picked = F.filter(every, lambda f: F.array_contains(wanted, f))
    return F.when(F.size(picked) > 0, picked).otherwise(every)


def _array_entropy(counts: Column) -> Column:
    """Normalised entropy of a short array of counts."""
    positive = F.filter(counts, lambda c: c > 0)
    return let(
        F.struct(
            positive.alias("p"), F.aggregate(positive, F.lit(0.0), lambda a, c: a + c.cast("double")).alias("t")
        ),
        lambda s: F.when(
            F.size(s["p"]) > 1,
            F.aggregate(s["p"], F.lit(0.0), lambda a, c: a - (c / s["t"]) * F.ln(c / s["t"]))
            / F.ln(F.size(s["p"]).cast("double")),
        ).otherwise(0.0),
    )


def credible_roles(rows: DataFrame, minimum: int = 3) -> DataFrame:
    counted = rows.where(F.col("role_hint").isNotNull()).groupBy("account_id", "role_hint").agg(
        F.count(F.lit(1)).alias("c")
    )
    return counted.where(F.col("c") >= minimum).groupBy("account_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "role_hint"))), lambda s: s["role_hint"]
        ).alias("roles")
    )


def toolkit_breadth(rows: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Variety of jobs under the picked heroes, from reviewed records only."""
    heroes = rows.where(F.col("hero_id").isNotNull()).groupBy("account_id", "hero_id").agg(
        F.count(F.lit(1)).alias("c")
    )
    usable = (~F.col("review_status").isin("unknown", "stale", "draft")) & (F.size("functions") > 0)
    records = dimension(knowledge).where(usable).select(
        "hero_id", "functions", "families", "reviewed", job_bits(F.col("functions")).alias("bits")
    )
    joined = heroes.join(records, "hero_id", "left")
    reviewed = F.coalesce("reviewed", F.lit(False))
    packed = joined.groupBy("account_id").agg(
        F.sum("c").alias("total"),
        F.sum(F.when(F.col("functions").isNotNull(), F.col("c")).otherwise(0)).alias("structural_rows"),
        F.sum(F.when(reviewed, F.col("c")).otherwise(0)).alias("reviewed_rows"),
        # One entry per hero of the game at most.
        F.collect_list(F.when(reviewed, F.struct("hero_id", "c", "functions", "families", "bits"))).alias("heroes"),
    ).withColumns({"_sets": F.col("heroes.functions"), "_bits": F.col("heroes.bits")})
    usable_rows = rows.join(records.select("hero_id"), "hero_id", "left_semi")
    table = packed.join(credible_roles(usable_rows), "account_id", "left").withColumn(
        "relevant", relevant_families(F.coalesce("roles", F.array().cast("array<string>")))
    )

    def weight_of(field: str, name: Column) -> Column:
        return F.aggregate(
            F.filter("heroes", lambda h: F.array_contains(h[field], name)), F.lit(0).cast("bigint"), lambda a, h: a + h["c"]
        )

    def holders(field: str, name: Column) -> Column:
        return F.size(F.filter("heroes", lambda h: F.array_contains(h[field], name)))

    jobs = F.array(*[F.lit(j) for j in JOBS])
    family_counts = F.transform("relevant", lambda f: weight_of("families", f))
    job_counts = F.transform(jobs, lambda j: weight_of("functions", j))
    unique = F.size(F.filter(jobs, lambda j: holders("functions", j) == 1))
    role_coverage = F.size(F.filter("relevant", lambda f: holders("families", f) > 0)) / F.size("relevant")
    parts = table.withColumns(
        {
            "family_entropy": _array_entropy(family_counts),
            "job_entropy": _array_entropy(job_counts),
            "overlap": mean_jaccard(F.col("_sets"), F.col("_bits")),
            "unique_jobs": unique,
            "role_coverage": role_coverage,
            "reviewed_coverage": ratio(F.col("reviewed_rows"), F.col("total")),
            "structural_coverage": ratio(F.col("structural_rows"), F.col("total")),
        }
    )
    score = clamp(
        0.25 * F.col("family_entropy")
        + 0.20 * F.col("job_entropy")
        + 0.25 * (1.0 - F.col("overlap"))
        + 0.15 * F.least(F.lit(1.0), F.col("unique_jobs") / 4.0)
        + 0.15 * F.col("role_coverage")
    )
    enough = (F.col("reviewed_rows") >= 30) & (F.col("reviewed_coverage") >= 0.80)
    effective = F.exp(F.col("family_entropy") * F.ln(F.greatest(F.size(F.filter(family_counts, lambda c: c > 0)), F.lit(1)).cast("double")))
    return parts.select(
        "account_id",
        F.when(enough, score).alias("score"),
        F.col("reviewed_rows").alias("sample_size"),
        F.when(enough, effective).otherwise(F.col("reviewed_rows")).alias("effective_sample_size"),
        F.col("reviewed_coverage").alias("coverage"),
        F.lit(1.0).alias("stability"),
        F.lit(1.0).alias("quality"),
        "family_entropy",
        "job_entropy",
        "overlap",
        "unique_jobs",
        "role_coverage",
        "structural_coverage",
    )


def toolkit_signatures(rows: DataFrame, traits: DataFrame) -> DataFrame:
    """Fallback of the toolkit metric: entropy of the top-three trait signatures."""
    top = F.slice(
        F.array_sort(F.transform(F.map_entries("traits"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))),
        1,
        3,
    )
    names = dimension(traits).where(F.col("available")).select(
        "hero_id", F.concat_ws("|", F.array_sort(F.transform(top, lambda e: e["k"]))).alias("signature")
    )
    rated = rows.where(F.col("hero_id").isNotNull()).join(names, "hero_id", "left")
    counted = rated.where(F.col("signature").isNotNull()).groupBy("account_id", "signature").agg(
        F.count(F.lit(1)).alias("c")
    )
    total = rated.groupBy("account_id").agg(F.count(F.lit(1)).alias("total"))
    return (
        total.join(diversity(counted), "account_id", "left")
        .withColumn("coverage", ratio(F.coalesce("sample", F.lit(0)), F.col("total")))
        .select(
            "account_id",
            F.when((F.col("sample") >= 30) & (F.col("coverage") >= 0.80), F.col("normalized_entropy")).alias("score"),
            F.coalesce("sample", F.lit(0)).alias("sample_size"),
            F.col("effective_count").alias("effective_sample_size"),
            "coverage",
            F.lit(1.0).alias("stability"),
            F.lit(1.0).alias("quality"),
        )
    )


def pool_profile(rows: DataFrame, traits: DataFrame) -> DataFrame:
    """Usage-capped trait centroid, dominant and underrepresented traits, credible roles, confidence."""
    heroes = dimension(traits).where(F.col("available")).select("hero_id", trait_vector().alias("_v"))
    used = (
        rows.where(F.col("hero_id").isNotNull())
        .groupBy("account_id", "hero_id")
        .agg(F.count(F.lit(1)).alias("c"))
        .join(heroes, "hero_id")
    )
    account = Window.partitionBy("account_id")
    capped = used.withColumn("_total", F.sum("c").over(account)).withColumn(
        "_w", F.least(F.col("c").cast("double"), F.greatest(F.lit(3.0), F.col("_total") * F.lit(0.35)))
    )
    centroid = (
        capped.withColumn("_ws", F.sum("_w").over(account))
        .select(
            "account_id",
            "hero_id",
            "c",
            "_total",
            "_w",
            "_ws",
            F.posexplode("_v").alias("i", "v"),
        )
        .groupBy("account_id", "i")
        .agg(
            (0.5 + F.sum((F.col("v") - 0.5) * F.col("_w")) / F.greatest(F.first("_ws"), F.lit(1.0))).alias("x"),
            F.count(F.lit(1)).alias("heroes"),
            F.first("_total").alias("total"),
        )
    )
    names = F.array(*[F.lit(t) for t in TRAITS])
    packed = centroid.groupBy("account_id").agg(
        F.first("heroes").alias("heroes"),
        F.first("total").alias("total"),
        # Seventeen traits.
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"),
    )
    boxes = F.zip_with("centroid", names, lambda v, n: F.struct(F.round(v, 9).alias("v"), n.alias("n")))
    high = F.slice(F.array_sort(F.transform(boxes, lambda b: F.struct((-b["v"]).alias("k"), b["n"].alias("n")))), 1, 5)
    low = F.slice(F.array_sort(boxes), 1, 6)
    return (
        packed.withColumns(
            {
                "dominant": F.transform(F.filter(high, lambda b: b["k"] <= -0.55), lambda b: b["n"]),
                "underrepresented": F.transform(
                    F.filter(low, lambda b: (b["v"] <= 0.45) & ~b["n"].isin("complexity", "micro_intensity")),
                    lambda b: b["n"],
                ),
                "confidence_score": F.least(
                    F.lit(1.0),
                    0.45 * F.least(F.lit(1.0), F.col("heroes") / 5.0)
                    + 0.55 * F.least(F.lit(1.0), F.col("total") / 40.0),
                ),
            }
        )
        .join(credible_roles(rows), "account_id", "left")
        .withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    )


def semantic_profile(rows: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Job prevalence, overlap, unique jobs and complementarity of the reviewed pool."""
    records = dimension(knowledge).select(
        "hero_id", "functions", "families", "reviewed", job_bits(F.col("functions")).alias("bits")
    )
    used = (
        rows.where(F.col("hero_id").isNotNull())
        .groupBy("account_id", "hero_id")
        .agg(F.count(F.lit(1)).alias("c"))
        .join(records, "hero_id")
    )
    reviewed = F.col("reviewed") & (F.size("functions") > 0)
    packed = used.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("heroes_used"),
        F.sum("c").alias("total"),
        F.collect_list(F.when(reviewed, F.struct("hero_id", "c", "functions", "families", "bits"))).alias("heroes"),
    )
    table = packed.join(credible_roles(rows), "account_id", "left").withColumn(
        "relevant", relevant_families(F.coalesce("roles", F.array().cast("array<string>")))
    )
    cap = F.greatest(F.lit(3.0), F.col("total") * F.lit(0.35))
    family = {j: f for f, members in FAMILIES.items() for j in members}
    jobs = F.array(
        *[
            F.struct(
                F.lit(j).alias("job"), F.lit(1 << i).cast("bigint").alias("bit"),
                F.lit(family.get(j)).cast("string").alias("family"),
            )
            for i, j in enumerate(JOBS)
        ]
    )
    # Jobs whose family matters for the account.
    wanted = F.filter(jobs, lambda j: F.array_contains("relevant", j["family"]))

    def having(j: Column) -> Column:
        return F.filter("_held", lambda h: h["bits"].bitwiseAND(j["bit"]) != 0)

    def job_weight(j: Column) -> Column:
        return F.aggregate(having(j), F.lit(0).cast("bigint"), lambda a, h: a + h["w"])

    def holders(name: Column) -> Column:
        return F.size(F.filter("heroes", lambda h: F.array_contains(h["families"], name)))

    held = F.transform(
        "heroes",
        lambda h: F.struct(
            h["bits"].alias("bits"), F.greatest(F.lit(1), F.floor(F.least(h["c"].cast("double"), F.col("_cap")))).alias("w")
        ),
    )
    staged = (
        table.withColumn("_cap", cap)
        .withColumns({"_held": held, "_sets": F.col("heroes.functions"), "_bits": F.col("heroes.bits")})
        .withColumns(
            {
                "_jobs": F.transform(wanted, lambda j: F.struct(j["job"].alias("job"), job_weight(j).alias("c"))),
                "_all": F.aggregate(F.transform(jobs, job_weight), F.lit(0).cast("bigint"), lambda a, x: a + x),
                "_fams": F.transform("relevant", holders),
                "unique_jobs": F.size(F.filter(wanted, lambda j: F.size(having(j)) == 1)),
                "overlap": mean_jaccard(F.col("_sets"), F.col("_bits")),
                "reviewed_coverage": F.size("heroes") / F.col("heroes_used"),
            }
        )
    )
    family_coverage = F.size(F.filter("_fams", lambda c: c > 0)) / F.size("_fams")
    complementarity = clamp(
        0.35 * family_coverage
        + 0.25 * (1.0 - F.col("overlap"))
        + 0.20 * F.least(F.lit(1.0), F.col("unique_jobs") / 4.0)
        + 0.10 * _array_entropy(F.col("_fams"))
        + 0.10 * _array_entropy(F.transform("_jobs", lambda j: j["c"]))
    )
    share = lambda j: j["c"] / F.greatest(F.col("_all"), F.lit(1))
    confidence = F.least(
        F.lit(1.0),
        (
            0.35 * F.least(F.lit(1.0), F.size("heroes") / 5.0)
            + 0.35 * F.least(F.lit(1.0), F.col("total") / 40.0)
            + 0.30 * F.col("reviewed_coverage")
        )
        * F.col("reviewed_coverage"),
    )
    return staged.select(
        "account_id",
        F.size("heroes").alias("reviewed_heroes"),
        "reviewed_coverage",
        "overlap",
        "unique_jobs",
        family_coverage.alias("family_coverage"),
        complementarity.alias("complementarity"),
        confidence.alias("confidence_score"),
        F.transform(F.filter("_jobs", lambda j: share(j) >= 0.45), lambda j: j["job"]).alias("dominant"),
        F.transform(F.filter("_jobs", lambda j: share(j) < 0.20), lambda j: j["job"]).alias("underrepresented"),
    )


# Relationships and candidates ----------------------------------------------------------------


def relationship(pairs: DataFrame) -> DataFrame:
    """Similarity, shared and own traits, and distances of pairs of heroes.

    ``pairs`` has ``hero_a``, ``hero_b``, the trait vectors ``a`` and ``b`` and the roles ``role_a``
    and ``role_b``.
    """
    names = F.array(*[F.lit(t) for t in TRAITS])
    both = F.zip_with(
        F.zip_with("a", "b", lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        names,
        lambda p, n: F.struct(p["x"].alias("x"), p["y"].alias("y"), n.alias("n")),
    )

    def shared(threshold: float) -> Column:
        hits = F.filter(both, lambda p: (p["x"] >= threshold) & (p["y"] >= threshold))
        ranked = F.array_sort(
            F.transform(hits, lambda p: F.struct((-F.least(p["x"], p["y"])).alias("k"), p["n"].alias("n")))
        )
        return F.transform(ranked, lambda p: p["n"])

    place = {t: i + 1 for i, t in enumerate(TRAITS)}

    def gap(t: str) -> Column:
        return F.abs(F.element_at("a", place[t]) - F.element_at("b", place[t]))

    return pairs.select(
        "hero_a",
        "hero_b",
        rms_similarity(F.col("a"), F.col("b")).alias("similarity"),
        shared(0.65).alias("shared_primary"),
        F.array_except(shared(0.35), shared(0.65)).alias("shared_secondary"),
        F.transform(F.filter(both, lambda p: (p["x"] >= 0.65) & (p["y"] < 0.45)), lambda p: p["n"]).alias("unique_to_a"),
        F.when(F.col("role_a") == F.col("role_b"), 1.0).otherwise(0.0).alias("role_compatibility"),
        gap("complexity").alias("complexity_distance"),
        gap("micro_intensity").alias("micro_distance"),
    )


def relationships(heroes: DataFrame, traits: DataFrame) -> DataFrame:
    """Relationship of every row of ``heroes`` (with ``hero_id`` and ``other_id``) to its partner."""
    left = heroes.select(
        F.col("hero_id").alias("hero_a"),
        F.col("other_id").alias("hero_b"),
        trait_vector().alias("a"),
        F.col("role").alias("role_a"),
    )
    right = dimension(traits).select(
        F.col("hero_id").alias("hero_b"), trait_vector().alias("b"), F.col("role").alias("role_b")
    )
    return relationship(left.join(right, "hero_b"))


def hero_against_pool(profile: DataFrame, traits: DataFrame) -> DataFrame:
    """Every hero of the roster against the pool of every account.

    The output has accounts times roster rows by definition.
    """
    table = traits.select("hero_id", "role", "traits", trait_vector().alias("v"))
    wide = with_roster(profile, traits).withColumn("hero_id", F.explode("roster")).drop("roster").join(table, "hero_id")
    place = {t: i + 1 for i, t in enumerate(TRAITS)}

    def distance(t: str) -> Column:
        return F.abs(F.element_at("v", place[t]) - F.element_at("centroid", place[t]))

    def strong(column: str, floor: float) -> Column:
        return F.filter(column, lambda t: F.coalesce(F.try_element_at(F.col("traits"), t), F.lit(0.0)) >= floor)

    names = F.array(*[F.lit(t) for t in TRAITS])
    gaps = F.zip_with(
        F.zip_with("v", "centroid", lambda a, b: F.abs(a - b)), names, lambda d, n: F.struct(F.round(d, 9).alias("d"), n.alias("n"))
    )
    differing = F.slice(
        F.reverse(
            F.array_sort(
                F.filter(gaps, lambda g: (g["d"] >= 0.18) & ~g["n"].isin("complexity", "micro_intensity"))
            )
        ),
        1,
        3,
    )
    hits = F.size(F.filter("roles", lambda r: r == F.col("role")))
    return wide.select(
        "account_id",
        "hero_id",
        rms_similarity(F.col("v"), F.col("centroid")).alias("similarity"),
        F.when(F.size("roles") == 0, 0.5)
        .otherwise(F.greatest(F.lit(0.25), hits / F.greatest(F.size("roles"), F.lit(1))))
        .alias("role_fit"),
        F.least(F.lit(1.0), 0.55 * distance("complexity") + 0.45 * distance("micro_intensity")).alias(
            "learning_distance"
        ),
        strong("dominant", 0.55).alias("anchors"),
        strong("underrepresented", 0.60).alias("additions"),
        F.transform(differing, lambda g: g["n"]).alias("differences"),
    )


def observed_semantics(rows: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Jobs and strongest demand bands of the reviewed heroes of an account."""
    used = rows.where(F.col("hero_id").isNotNull()).select("account_id", "hero_id").distinct()
    records = dimension(knowledge).select("hero_id", "functions", "demands", "reviewed")
    joined = used.join(records, "hero_id", "left")
    heroes = joined.groupBy("account_id").agg(
        F.collect_set("hero_id").alias("used"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("reviewed"), F.col("functions"))))).alias("jobs"),
    )
    # The first hero by id that names a demand sets its band; high always wins, known beats unknown.
    demands = (
        joined.where(F.col("reviewed"))
        .select("account_id", "hero_id", F.explode("demands").alias("k", "b"))
        .groupBy("account_id", "k")
        .agg(
            F.max(F.when(F.col("b") == "high", F.lit("high"))).alias("_high"),
            F.min_by("b", F.when(F.col("b") != "unknown", F.col("hero_id"))).alias("_first"),
        )
        .select("account_id", "k", F.coalesce("_high", "_first", F.lit("unknown")).alias("b"))
        .groupBy("account_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("k", "b"))).alias("bands"))
    )
    return heroes.join(demands, "account_id", "left").join(credible_roles(rows), "account_id", "left")


def _band(source: str, key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(source), key), F.lit("unknown"))


def _pairs(rows: DataFrame, knowledge: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Every account with every hero it does not use, compared by bits of jobs, demands and positions.

    The bits are found once for each account and each hero.  A pair then costs a few operations on numbers; arrays
    of names are built where a result shows them.  Jobs beyond the fixed list, or named twice, are in ``_rest``.
    """
    places = sorted(set(ROLE_POSITIONS.values()))
    state = observed_semantics(rows, knowledge).withColumns(
        {
            "roles": F.coalesce("roles", F.array().cast("array<string>")),
            "bands": F.coalesce("bands", F.create_map().cast("map<string,string>")),
        }
    )
    if targets is not None:
        state = state.join(targets.select("account_id", "target_family"), "account_id")
    state = state.withColumns(
        {
            "_jobs": job_bits(F.col("jobs")),
            "_met": _bits(DEMANDS, lambda d: _band("bands", F.lit(d)).isin("medium", "high")),
            "_at": _bits(
                places,
                lambda p: F.arrays_overlap("roles", F.array(*[F.lit(r) for r, at in ROLE_POSITIONS.items() if at == p])),
            ),
        }
    ).drop("bands")
    known = F.array(*[F.lit(j) for j in JOBS])

    def demand(*bands: str) -> Column:
        return _bits(DEMANDS, lambda d: _band("demands", F.lit(d)).isin(*bands))

    def place(credibility: str) -> Column:
        return _bits(places, lambda p: _band("position_credibility", F.lit(p)) == credibility)

    records = knowledge.select(
        "hero_id",
        "functions",
        "reviewed",
        "empirical_support",
        F.col("confidence").alias("_confidence"),
        F.col("roles").alias("hero_roles"),
        F.size("primary_functions").alias("_primary"),
        job_bits(F.col("functions")).alias("_functions"),
        F.filter(
            "functions",
            lambda f, i: ~(F.array_contains(known, f) & (F.array_position("functions", f) == i + 1)),
        ).alias("_rest"),
        demand("medium", "high").alias("_asked"),
        demand("high").alias("_hard"),
        F.bit_count(demand("unknown")).alias("_unknown"),
        place("primary").alias("_first"),
        place("secondary").alias("_second"),
        place("unsupported").alias("_never"),
    )
    wide = (
        with_roster(state, knowledge)
        .withColumn("hero_id", F.explode(F.array_except("roster", "used")))
        .drop("roster", "used")
        .join(records, "hero_id")
    )
    at = F.col("_at")
    position = (
        F.when(at == 0, "unknown")
        .when(at.bitwiseAND(F.col("_first")) != 0, "primary")
        .when(at.bitwiseAND(F.col("_second")) != 0, "secondary")
        .when(at.bitwiseAND(F.bitwise_not("_never")) == 0, "unsupported")
        .otherwise("unknown")
    )
    role_fit = (
        F.when(F.col("position_fit") == "unsupported", "unsupported")
        .when(F.col("position_fit").isin("primary", "secondary"), "supported")
        .when((F.size("roles") == 0) | (F.size("hero_roles") == 0), "conditional")
        .when(F.arrays_overlap("hero_roles", "roles"), "supported")
        .otherwise("unsupported")
    )
    other = F.bitwise_not("_met")
    high_new = F.col("_hard").bitwiseAND(other)
    micro = high_new.bitwiseAND(F.lit(1 << DEMANDS.index("micro"))) != 0
    learning = (
        F.when((F.bit_count(high_new) >= 3) | micro, "high")
        .when((F.col("_demands") >= 2) | (F.col("_unknown") >= 4), "moderate")
        .otherwise("low")
    )
    plain = F.size("_rest") == 0
    mine = F.filter("_rest", lambda f: F.array_contains("jobs", f))
    more = F.filter("_rest", lambda f: ~F.array_contains("jobs", f))
    shared = F.bit_count(F.col("_functions").bitwiseAND(F.col("_jobs")))
    added = F.bit_count(F.col("_functions").bitwiseAND(F.bitwise_not("_jobs")))
    return wide.withColumns(
        {
            "position_fit": position,
            "_new": F.col("_asked").bitwiseAND(other),
            "_demands": F.bit_count(F.col("_asked").bitwiseAND(other)),
            "_high": F.bit_count("_hard"),
            "_anchors": F.when(plain, shared).otherwise(shared + F.size(mine)),
            "_adds": F.when(plain, added).otherwise(added + F.size(more)),
        }
    ).withColumns({"role_fit": role_fit, "learning_distance": learning})


def _rated(intent: str, family: Column | None) -> dict[str, Column]:
    """What a pair of :func:`_pairs` is worth for an intent; ``family`` is the one that ``fill_gap`` looks for."""
    anchors = F.filter("functions", lambda f: F.array_contains("jobs", f))
    adds = F.filter("functions", lambda f: ~F.array_contains("jobs", f))
    target = F.lit(0)
    if family is not None:
        wanted = lambda f: family_of(f) == family
        bits = F.coalesce(
            *[F.when(family == name, F.lit(sum(1 << JOBS.index(j) for j in jobs))) for name, jobs in FAMILIES.items()],
            F.lit(0),
        ).cast("bigint")
        target = F.bit_count(F.col("_functions").bitwiseAND(F.bitwise_not("_jobs")).bitwiseAND(bits))
        more = F.size(F.filter("_rest", lambda f: ~F.array_contains("jobs", f) & wanted(f)))
        target = F.when(F.size("_rest") == 0, target).otherwise(target + more)
        adds = F.concat(F.filter(adds, wanted), adds)
    lowered = F.when(F.col("_confidence") == "high", "medium").otherwise("low")
    confidence = F.when(~F.col("reviewed") | (F.col("_unknown") >= 4), "low").when(
        (F.col("role_fit") == "conditional") | (F.col("empirical_support") == "unknown"), lowered
    )
    if intent in ("change_angle", "specialist"):
        confidence = confidence.when(F.col("_demands") == 0, lowered)
    confidence = confidence.otherwise(F.col("_confidence"))
    near = F.col("learning_distance") != "high"
    eligible = (
        (F.size("functions") > 0)
        & (F.col("_anchors") > 0)
        & (F.col("role_fit") != "unsupported")
        & (confidence != "low")
        & (F.col("_unknown") < len(DEMANDS))
    )
    eligible = eligible & {
        "double_down": near,
        "adjacent_move": (F.col("_adds") > 0) & near,
        "fill_gap": (F.lit(False) if family is None else family.isNotNull()) & (target > 0) & near,
        "change_angle": F.col("_demands") > 0,
        "specialist": (F.col("_demands") > 0) & (~near | (F.col("_high") >= 3)),
    }[intent]

    def rank(column: Column, *order: str) -> Column:
        return F.array_position(F.array(*[F.lit(o) for o in order]), column).cast("bigint")

    four = lambda count: F.least(count, F.lit(4))
    distance = rank(F.col("learning_distance"), "low", "moderate", "high")
    lead = {
        "double_down": (distance, four(F.col("_adds")), -four(F.col("_anchors"))),
        "adjacent_move": (-four(F.col("_anchors")), -four(F.col("_adds")), distance),
        "fill_gap": (-four(target), -four(F.col("_anchors")), distance),
        "change_angle": (-four(F.col("_demands")), four(F.col("_adds")), distance),
        "specialist": (-F.col("_high"), -four(F.col("_demands")), distance),
    }[intent]
    order = (
        *lead,
        rank(F.col("role_fit"), "supported", "conditional", "unsupported"),
        rank(F.col("position_fit"), "primary", "secondary", "unsupported", "unknown"),
        rank(F.col("empirical_support"), "high", "medium", "low", "unknown"),
        rank(confidence, "high", "medium", "low"),
        -F.col("_primary"),
        F.col("hero_id"),
    )
    new = F.filter(
        F.array(*[F.when(F.col("_new").bitwiseAND(F.lit(1 << i)) != 0, F.lit(d)) for i, d in enumerate(DEMANDS)]),
        lambda d: d.isNotNull(),
    )
    return {
        "intent": F.lit(intent),
        "eligible": eligible,
        "anchors": F.slice(anchors, 1, 4),
        "adds": F.slice(F.array_distinct(adds), 1, 4),
        "new_demands": F.slice(new, 1, 4),
        "confidence": confidence,
        "order": F.struct(*[c.cast("bigint").alias(f"k{i}") for i, c in enumerate(order)]),
    }


def rationales(
    rows: DataFrame,
    knowledge: DataFrame,
    intent: str = "adjacent_move",
    family: Column | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Fit bands, anchors, additions and the rank of every unused hero for every account.

    The family that ``fill_gap`` looks for is one for all (``family``) or each account's own (``targets``:
    account_id, target_family; other accounts are left out).
    """
    rated = _rated(intent, F.col("target_family") if targets is not None else family)
    names = ("intent", "eligible", "anchors", "adds", "new_demands")
    return _pairs(rows, knowledge, targets).select(
        "account_id",
        "hero_id",
        *[rated[n].alias(n) for n in names],
        "learning_distance",
        "role_fit",
        "position_fit",
        "empirical_support",
        *[rated[n].alias(n) for n in ("confidence", "order")],
    )


def recommend_each(rows: DataFrame, knowledge: DataFrame, intents: Mapping[str, Column | None]) -> DataFrame:
    """The best eligible heroes of several intents (and the family of each), from one comparison of all pairs."""
    fits = []
    for intent, family in intents.items():
        rated = _rated(intent, family)
        fits.append(F.when(rated["eligible"], F.struct(rated["intent"].alias("intent"), rated["order"].alias("order"),
                                                       rated["adds"].alias("adds"))))
    candidates = _pairs(rows, knowledge).select(
        "account_id", "hero_id", F.explode(F.array_compact(F.array(*fits))).alias("f")
    )
    candidates = candidates.select("account_id", "hero_id", "f.*", F.lit(True).alias("eligible"))
    return recommend(candidates, keys=("account_id", "intent"))


def recommend(candidates: DataFrame, limit: int = 3, keys: Sequence[str] = ("account_id",)) -> DataFrame:
    """The best eligible heroes; one whose additions are all covered already is passed over."""
    pool = candidates.where(F.col("eligible")).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("order", "hero_id", "adds"))).alias("_pool")  # at most the roster
    )
    start = F.struct(
        F.array().cast("array<bigint>").alias("heroes"), F.array().cast("array<string>").alias("adds")
    )

    def step(state: Column, c: Column) -> Column:
        covered = (F.size(state["heroes"]) > 0) & (F.size(c["adds"]) > 0) & (
            F.size(F.array_except(c["adds"], state["adds"])) == 0
        )
        return F.when((F.size(state["heroes"]) >= limit) | covered, state).otherwise(
            F.struct(
                F.array_append(state["heroes"], c["hero_id"]).alias("heroes"),
                F.array_union(state["adds"], c["adds"]).alias("adds"),
            )
        )

    picked = F.aggregate("_pool", start, step)["heroes"]
    return pool.select(*keys, F.posexplode(picked).alias("rank", "hero_id")).withColumn("rank", F.col("rank") + 1)


def recommend_by_traits(rows: DataFrame, picks: DataFrame, traits: DataFrame, limit: int = 3) -> DataFrame:
    """Trait recommendations: score minus 0.20 of the similarity to what was picked, one role change at most."""
    comfort = picks.where(F.col("comfort_place").isNotNull())
    heroes = traits.where(F.col("available")).select("hero_id", "role", "traits", trait_vector().alias("v"))
    weight = F.greatest(F.col("comfort_score"), F.lit(0.01))
    centroid = (
        comfort.withColumn("_w", weight)
        .withColumn("_t", F.sum("_w").over(Window.partitionBy("account_id")))
        .join(heroes, "hero_id")
        .select("account_id", "_w", "_t", F.posexplode("v").alias("i", "x"))
        .groupBy("account_id", "i")
        .agg((0.5 + F.sum((F.col("x") - 0.5) * F.col("_w") / F.col("_t"))).alias("x"))
        .groupBy("account_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    )
    counted = rows.where(F.col("hero_id").isNotNull()).groupBy("account_id", "hero_id").agg(F.count(F.lit(1)).alias("c"))
    account = Window.partitionBy("account_id")
    placed = counted.withColumn("_k", F.row_number().over(account.orderBy(F.desc("c"), "hero_id")))
    exposure = placed.groupBy("account_id").agg(
        F.sum("c").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("hero_id", "c"))).alias("_counts"),
        F.collect_list(F.when((F.col("_k") <= 10) | (F.col("c") >= 5), F.col("hero_id"))).alias("_known"),
    )
    roles = rows.where(F.col("role_hint").isNotNull()).groupBy("account_id", "role_hint").agg(F.count(F.lit(1)).alias("c"))
    role_map = roles.where(F.col("c") >= 3).groupBy("account_id").agg(
        F.map_from_entries(F.collect_list(F.struct("role_hint", "c"))).alias("_roles"), F.sum("c").alias("_role_total")
    )
    wide = (
        with_roster(centroid.join(exposure, "account_id").join(role_map, "account_id", "left"), traits)
        .withColumn("hero_id", F.explode(F.array_except("roster", "_known")))
        .drop("roster")
        .join(heroes, "hero_id")
    )
    names = F.array(*[F.lit(t) for t in TRAITS])
    both = F.zip_with(
        F.zip_with("v", "centroid", lambda x, c: F.struct(x.alias("x"), c.alias("c"))),
        names,
        lambda p, n: F.struct(p["x"].alias("x"), F.round(p["c"], 9).alias("c"), n.alias("n")),
    )
    active = F.filter(both, lambda p: p["x"] >= 0.65)
    fresh = F.filter("_active", lambda p: p["c"] < 0.45)
    rising = F.filter("_active", lambda p: p["x"] - p["c"] >= 0.10)
    staged = wide.withColumn("_active", active).withColumns(
        {
            "_familiar": F.filter("_active", lambda p: p["c"] >= 0.55),
            "_adjacent": F.when(F.size(fresh) > 0, fresh).otherwise(rising),
        }
    ).where((F.size("_familiar") > 0) & (F.size("_adjacent") > 0))
    overlap = ratio(F.coalesce(F.try_element_at("_roles", F.col("role")), F.lit(0)), F.col("_role_total"))
    lift = F.array_max(F.transform("_adjacent", lambda p: F.greatest(F.lit(0.0), p["x"] - p["c"])))
    place = {t: i + 1 for i, t in enumerate(TRAITS)}
    complexity = clamp(1.0 - F.abs(F.element_at("v", place["complexity"]) - F.element_at("centroid", place["complexity"])))
    score = (
        0.40 * rms_similarity(F.col("centroid"), F.col("v"))
        + 0.25 * F.when(F.col("_roles").isNull(), 0.5).otherwise(F.greatest(F.lit(0.25), overlap))
        + 0.15 * clamp(1.0 - F.coalesce(F.try_element_at("_counts", F.col("hero_id")), F.lit(0)) / F.col("total"))
        + 0.15 * lift
        + 0.05 * complexity
    )
    pool = (
        staged.select(
            "account_id",
            F.struct(
                F.round(score, 9).alias("score"),
                "hero_id",
                (F.col("_roles").isNotNull() & (overlap < 0.25)).alias("outside"),
                "v",
            ).alias("c"),
        )
        .groupBy("account_id")
        .agg(F.collect_list("c").alias("_pool"))
    )
    empty = F.filter(F.col("_pool"), lambda _: F.lit(False))

    def step(state: Column, _: Column) -> Column:
        used = F.exists(state["picked"], lambda p: p["outside"])
        open_ = F.filter(
            F.col("_pool"),
            lambda c: ~F.exists(state["picked"], lambda p: p["hero_id"] == c["hero_id"]) & ~(c["outside"] & used),
        )
        ranked = F.transform(
            open_,
            lambda c: F.struct(
                F.round(
                    c["score"]
                    - 0.20
                    * F.coalesce(
                        F.array_max(F.transform(state["picked"], lambda p: rms_similarity(p["v"], c["v"]))), F.lit(0.0)
                    ),
                    9,
                ).alias("m"),
                c["score"].alias("s"),
                (-c["hero_id"]).alias("h"),
                c.alias("c"),
            ),
        )
        return let(
            F.array_max(ranked),
            lambda best: F.when(best.isNull(), state).otherwise(
                F.struct(F.array_append(state["picked"], best["c"]).alias("picked"))
            ),
        )

    picked = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.struct(empty.alias("picked")), step)["picked"]
    band = F.when(F.col("p.score") >= 0.70, "strong").when(F.col("p.score") >= 0.52, "good").otherwise("exploratory")
    return pool.select("account_id", F.posexplode(picked).alias("rank", "p")).select(
        "account_id",
        (F.col("rank") + 1).alias("rank"),
        "p.hero_id",
        "p.score",
        F.col("p.outside").alias("role_change"),
        band.alias("fit_band"),
    )



def job_clusters(rows: DataFrame, knowledge: DataFrame, limit: int = 4) -> DataFrame:
    """The jobs that most of an account's heroes share, with those heroes."""
    used = rows.where(F.col("hero_id").isNotNull()).select("account_id", "hero_id").distinct()
    records = dimension(knowledge).where(F.col("reviewed")).select("hero_id", "functions")
    grouped = (
        used.join(records, "hero_id")
        .select("account_id", "hero_id", F.explode("functions").alias("job"))
        .groupBy("account_id", "job")
        .agg(F.array_sort(F.collect_set("hero_id")).alias("heroes"))  # at most the roster
        .withColumn("hero_count", F.size("heroes"))
    )
    order = Window.partitionBy("account_id").orderBy(F.desc("hero_count"), "job")
    return grouped.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
