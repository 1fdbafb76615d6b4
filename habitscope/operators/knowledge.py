"""Reference-data derivation: empirical profiles, bands, mechanics tags, snapshots, differences."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from habitscope.functions.expr import ratio


def guarded_rate(wins: Column, games: Column) -> Column:
    return F.when(games > 0, F.round(ratio(wins, games), 6))


def bracket_profile(stats: DataFrame) -> DataFrame:
    """Rows per hero and bracket from wide ``<rank>_pick`` / ``<rank>_win`` columns and the public and pro totals."""
    ranks = sorted(c[:-5] for c in stats.columns if c.endswith("_pick") and c[:-5].isdigit())
    boxes = [(f"rank_tier_{r}", "public_aggregate", f"{r}_pick", f"{r}_win") for r in ranks]
    boxes += [
        (label, population, f"{p}_pick", f"{p}_win")
        for label, population, p in (("public", "public_aggregate", "pub"), ("professional", "professional", "pro"))
        if f"{p}_pick" in stats.columns
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("bracket"),
                F.lit(population).alias("population"),
                F.col(f"`{pick}`").cast("bigint").alias("picks"),
                F.col(f"`{win}`").cast("bigint").alias("wins"),
            )
            for label, population, pick, win in boxes
        ]
    )
    return (
        stats.select("hero_id", F.explode(entries).alias("e"))
        .select("hero_id", "e.*")
        .withColumn("win_rate", guarded_rate(F.col("wins"), F.col("picks")))
    )


def duration_profile(rows: DataFrame) -> DataFrame:
    return rows.select(
        "hero_id",
        F.col("duration_bin").alias("duration_bin_seconds"),
        F.col("games_played").alias("games"),
        "wins",
        guarded_rate(F.col("wins"), F.col("games_played")).alias("win_rate"),
    )


def item_profile(popularity: DataFrame) -> DataFrame:
    """Share of each item inside its hero and phase, from a map of phase to a map of item to count."""
    long = (
        popularity.select("hero_id", F.explode("phases").alias("phase", "items"))
        .select("hero_id", F.regexp_replace("phase", "_game$", "").alias("phase"), F.explode("items").alias("item", "count"))
        .select("hero_id", "phase", F.col("item").cast("bigint").alias("item_id"), "count")
    )
    total = F.sum("count").over(Window.partitionBy("hero_id", "phase"))
    return long.withColumn("share", guarded_rate(F.col("count"), total))


def matchup_profile(rows: DataFrame) -> DataFrame:
    return rows.select(
        "hero_id",
        F.col("opponent").alias("opponent_hero_id"),
        "games",
        "wins",
        guarded_rate(F.col("wins"), F.col("games")).alias("win_rate"),
    )


def behaviour_bands(
    roster: DataFrame,
    brackets: DataFrame,
    durations: DataFrame,
    items: DataFrame,
    matchups: DataFrame,
    minimum: int = 20,
) -> DataFrame:
    """Item concentration, duration and meta confidence bands of each hero, with sample gates."""
    item = items.groupBy("hero_id").agg(
        F.sum("count").alias("item_total"),
        # The first of the largest counts in phase and item order.
        F.max_by(F.struct("phase", "item_id", "count"), F.struct("count", F.lit(0))).alias("_any"),
        F.max("count").alias("_top"),
    )
    top = (
        items.withColumn(
            "_k", F.row_number().over(Window.partitionBy("hero_id").orderBy(F.desc("count"), "phase", "item_id"))
        )
        .where(F.col("_k") == 1)
        .select("hero_id", F.col("item_id").alias("top_item_id"), F.col("phase").alias("top_phase"))
    )
    span = durations.groupBy("hero_id").agg(
        F.sum("games").alias("duration_games"),
        F.try_divide(
            F.sum(F.col("duration_bin_seconds") * F.col("games")).cast("double"), F.sum("games").cast("double")
        ).alias("weighted_seconds"),
    )
    public = brackets.where(F.col("population") == "public_aggregate").groupBy("hero_id").agg(
        F.sum("picks").alias("public_matches")
    )
    met = matchups.groupBy("hero_id").agg(F.sum("games").alias("matchup_games"))
    joined = (
        roster.select("hero_id")
        .join(item.drop("_any"), "hero_id", "left")
        .join(top, "hero_id", "left")
        .join(span, "hero_id", "left")
        .join(public, "hero_id", "left")
        .join(met, "hero_id", "left")
        .na.fill(0, ["item_total", "duration_games", "public_matches", "matchup_games"])
    )
    share = ratio(F.col("_top"), F.col("item_total"))
    seconds, picks = F.col("weighted_seconds"), F.col("public_matches")
    return joined.select(
        "hero_id",
        F.when(F.col("item_total") < minimum, "unknown")
        .when(share >= 0.5, "high")
        .when(share >= 0.3, "medium")
        .otherwise("low")
        .alias("item_dependency"),
        F.when(F.col("item_total") >= minimum, F.col("top_item_id")).alias("top_item_id"),
        F.when(F.col("item_total") >= minimum, F.round(share, 6)).alias("top_item_share"),
        F.when(F.col("duration_games") < minimum, "unknown")
        .when(seconds < 1500, "earlier-biased")
        .when(seconds > 2700, "later-biased")
        .otherwise("balanced")
        .alias("duration_band"),
        F.when(F.col("duration_games") >= minimum, F.round(seconds, 3)).alias("weighted_seconds"),
        F.when(picks >= 1000, "high")
        .when(picks >= 100, "medium")
        .when(picks >= minimum, "low")
        .otherwise("unknown")
        .alias("meta_confidence"),
        picks.alias("public_matches"),
        F.when(F.col("matchup_games") > 0, "observed").otherwise("unknown").alias("matchup_context"),
    )


# Characteristics and the patterns of ability text that show them.
TAG_RULES = {
    "initiation": (r"taunt", r"stun", r"root", r"leash", r"latch", r"charge", r"force.*attack"),
    "catch": (r"stun", r"root", r"leash", r"hex", r"silence", r"slow", r"taunt"),
    "save": (
        r"ally.*(invulnerab|immun|prevent.*damage|damage.*barrier|grave|false promise)",
        r"damage.*(prevent|immun)",
        r"purge.*ally",
        r"protect.*ally",
    ),
    "displacement": (r"knockback", r"forced movement", r"push", r"pull", r"swap", r"toss", r"throw"),
    "mobility": (r"blink", r"dash", r"leap", r"jump", r"teleport", r"charge", r"roll", r"waveform", r"remnant"),
    "global_pressure": (r"global", r"anywhere", r"all enemy heroes", r"teleport.*location", r"across the map"),
    "vision": (r"provides? vision", r"reveals?", r"true sight", r"ward", r"scouting"),
    "micro": (
        r"illusion",
        r"summon",
        r"controlled unit",
        r"clone",
        r"spirit",
        r"bear",
        r"treant",
        r"familiar",
        r"multiple meepos",
    ),
    "push": (r"building", r"structures", r"tower", r"summon", r"damage.*buildings"),
    "sustained_damage": (
        r"damage over time",
        r"damage per second",
        r"burn",
        r"poison",
        r"bleed",
        r"attack speed",
    ),
    "burst": (r"deals? .*damage", r"damage.*enemy", r"nuke"),
}


def shows(text: Column, pattern: str) -> Column:
    """Does the text match the pattern?  Plain words are searched as words, and a real pattern
    runs only on texts that contain its fixed parts."""
    outside = re.sub(r"\([^()]*\)", "\0", pattern)
    # A letter before a question mark is optional and ends the fixed part.
    fixed = [w for w in re.split(r"\w\?|\.\*|[^a-z ]", outside) if len(w.strip()) > 2]
    found = [F.contains(text, F.lit(w)) for w in fixed]
    if re.fullmatch(r"[a-z ]+(\w\?)?", pattern) and len(fixed) == 1:
        return found[0]
    return reduce(lambda a, b: a & b, [*found, text.rlike(pattern)])


def tags(abilities: DataFrame, rules: dict[str, tuple[str, ...]] = TAG_RULES) -> DataFrame:
    """One row per ability text and characteristic it shows; whole texts, each lowered once.

    ``abilities`` has ``hero_id``, ``ref`` and ``text``, and may have ``damages``, a flag for damage that is known
    without its word in the text.  References stay rows, so a hero with any number of texts is never held together.
    """
    flag = F.coalesce(F.col("damages"), F.lit(False)) if "damages" in abilities.columns else F.lit(False)
    lowered = abilities.select("hero_id", "ref", F.lower("text").alias("text"), flag.alias("damages"))
    text = F.col("text")
    area = (
        F.contains(text, F.lit("radius")) | F.contains(text, F.lit("area")) | F.contains(text, F.lit("nearby"))
    ) & (F.contains(text, F.lit("damage")) | F.col("damages"))
    hits = [
        F.when(reduce(lambda a, b: a | b, [shows(text, p) for p in patterns]), F.lit(name))
        for name, patterns in rules.items()
    ]
    hits.append(F.when(area, F.lit("area")))
    return lowered.select(
        "hero_id", "ref", F.explode(F.array_compact(F.array(*hits))).alias("characteristic")
    )


def capabilities(tagged: DataFrame, base_stats: DataFrame | None = None) -> DataFrame:
    """Bands per hero: the tagged characteristics and those that follow from them.

    ``base_stats`` has ``hero_id``, ``max_health``, ``armor`` and ``complexity``.
    """
    names = (*TAG_RULES, "area")
    wide = tagged.groupBy("hero_id").agg(
        *[F.count_distinct(F.when(F.col("characteristic") == n, F.col("ref"))).alias(n) for n in names]
    )
    if base_stats is not None:
        wide = base_stats.join(wide, "hero_id", "left").na.fill(0, list(names))
        sturdy = F.coalesce((F.col("max_health") >= 600) & (F.col("armor") >= 3), F.lit(False))
        complexity = F.col("complexity")
    else:
        sturdy, complexity = F.lit(False), F.lit(None).cast("int")

    def band(count: Column) -> Column:
        return F.when(count >= 2, "high").when(count == 1, "medium")

    has = {n: F.col(n) > 0 for n in names}
    derived = {
        **{n: band(F.col(n)) for n in TAG_RULES},
        "frontline": F.when(sturdy, "high"),
        "teamfight": band(F.col("area")),
        "wave_clear": F.when(F.col("area") >= 2, "high"),
        "pickoff": F.when(has["initiation"] & (has["burst"] | has["sustained_damage"]), "high"),
        "repositioning": band(F.col("mobility")),
        "access": band(F.col("mobility")),
        "counter_initiation": band(F.col("displacement")),
        "execution": F.when(has["micro"] | F.coalesce(complexity == 3, F.lit(False)), "high"),
    }
    entries = F.array_compact(
        F.array(
            *[
                F.when(b.isNotNull(), F.struct(F.lit(n).alias("characteristic"), b.alias("band")))
                for n, b in derived.items()
            ]
        )
    )
    return wide.select("hero_id", F.explode(entries).alias("e")).select("hero_id", "e.*")


# The version of the rules and the references of what no ability shows.
RULE_VERSION = "mechanic-rules-1.0.0"
STURDY_REFS = ("base_stats:max_health", "base_stats:armor")
COMPLEX_REF = "identity:complexity"
IMMOBILE_REF = "rule:no_mobility_signal"


def ability_rows(mechanics: DataFrame) -> DataFrame:
    """``hero_id``, ``ref`` and ``text`` of each ability of the normalised hero documents."""
    a = F.col("a")
    return mechanics.select("hero_id", F.explode("abilities").alias("a")).select(
        "hero_id",
        F.concat(F.lit("ability:"), F.coalesce(a["internal_name"], a["ability_id"].cast("string"))).alias("ref"),
        F.concat_ws(" ", a["internal_name"], a["display_name"], a["description"]).alias("text"),
    )


def evidence(tagged: DataFrame, base_stats: DataFrame, abilities: DataFrame) -> DataFrame:
    """What every band and demand of a hero follows from: one row per reference.

    ``kind`` is capability or demand.  A tag row finds by itself the results that lean on it, from one row of flags
    per hero, so references are never gathered: a hero with any number of them stays many rows.  ``base_stats`` is
    as in :func:`capabilities` and has every hero; one that also has rows in ``abilities`` but no mobility needs access.
    Missing health, armour or complexity show nothing.
    """
    once = tagged.select("hero_id", "characteristic", F.col("ref").cast("string").alias("ref")).distinct()
    names = (*TAG_RULES, "area")
    counted = once.groupBy("hero_id").agg(*[F.count_if(F.col("characteristic") == n).alias(f"n_{n}") for n in names])
    flags = (
        base_stats.select(
            "hero_id",
            F.coalesce((F.col("max_health") >= 600) & (F.col("armor") >= 3), F.lit(False)).alias("sturdy"),
            F.coalesce(F.col("complexity") == 3, F.lit(False)).alias("complex"),
        )
        .join(counted, "hero_id", "left")
        .join(abilities.select("hero_id").distinct().withColumn("able", F.lit(True)), "hero_id", "left")
        .na.fill(0, [f"n_{n}" for n in names])
        .na.fill(False, ["able"])
    )
    sturdy, hard = F.col("sturdy"), F.col("complex")
    n = {name: F.col(f"n_{name}") for name in names}

    def band(count: Column) -> Column:
        return F.when(count >= 2, "high").otherwise("medium")

    def use(kind: str, characteristic: str | Column, grade: str | Column, when: Column) -> Column:
        name = F.lit(characteristic) if isinstance(characteristic, str) else characteristic
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("kind"),
                name.alias("characteristic"),
                (F.lit(grade) if isinstance(grade, str) else grade).alias("band"),
            ),
        )

    tag = F.col("characteristic")
    count = reduce(lambda a, name: F.when(tag == name, n[name]).otherwise(a), names, F.lit(0))
    committed = F.when(sturdy, "high").otherwise("medium")
    strikes = n["burst"] + n["sustained_damage"] > 0
    leans = [
        use("capability", tag, band(count), tag != "area"),
        use("capability", "teamfight", band(n["area"]), tag == "area"),
        use("capability", "wave_clear", "high", (tag == "area") & (n["area"] >= 2)),
        use("capability", "frontline", "high", (tag == "initiation") & sturdy),
        use("capability", "pickoff", "high", (tag == "initiation") & strikes),
        use("capability", "pickoff", "high", (tag == "burst") & (n["initiation"] > 0)),
        use("capability", "pickoff", "high", (tag == "sustained_damage") & (n["initiation"] > 0) & (n["burst"] == 0)),
        use("capability", "repositioning", band(n["mobility"]), tag == "mobility"),
        use("capability", "access", band(n["mobility"]), tag == "mobility"),
        use("capability", "counter_initiation", band(n["displacement"]), tag == "displacement"),
        use("capability", "execution", "high", (tag == "micro") & ~hard),
        use("demand", "commitment", committed, tag == "initiation"),
        use("demand", "exposure", committed, tag == "initiation"),
        use("demand", "execution", "high", tag == "micro"),
    ]
    shown = once.join(flags, "hero_id").select(
        "hero_id", "ref", F.explode(F.array_compact(F.array(*leans))).alias("e")
    )
    still = F.col("able") & (n["mobility"] == 0) & (n["global_pressure"] == 0)
    given = [
        (use(kind, name, "high", sturdy), ref)
        for ref in STURDY_REFS
        for kind, name in (("capability", "frontline"), ("demand", "commitment"), ("demand", "exposure"))
    ] + [
        (use("capability", "execution", "high", hard), COMPLEX_REF),
        (use("demand", "execution", "high", hard & (n["micro"] == 0)), COMPLEX_REF),
        (use("demand", "access", "high", still), IMMOBILE_REF),
    ]
    known = flags.select(
        "hero_id", F.explode(F.array(*[F.struct(F.lit(ref).alias("ref"), e.alias("e")) for e, ref in given])).alias("g")
    ).select("hero_id", "g.ref", "g.e")
    return (
        shown.unionByName(known.where(F.col("e").isNotNull()))
        .select("hero_id", "e.*", "ref")
        .distinct()
        .withColumn("rule_version", F.lit(RULE_VERSION))
    )


def demands(proof: DataFrame) -> DataFrame:
    """Demands of each hero with their band and the number of references behind it."""
    return (
        proof.where(F.col("kind") == "demand")
        .groupBy("hero_id", "characteristic", "band", "rule_version")
        .agg(F.count(F.lit(1)).alias("reference_count"))
        .withColumnRenamed("characteristic", "demand")
    )


def functions_of(bands: DataFrame) -> DataFrame:
    """Primary and secondary functions of each hero from its capability bands."""
    leading = F.col("characteristic").isin("teamfight", "initiation", "save", "mobility")
    packed = bands.groupBy("hero_id").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("band") == "high", F.struct((~leading).alias("k"), F.col("characteristic").alias("n"))))
        ).alias("_high"),
        F.array_sort(F.collect_list("characteristic")).alias("_all"),  # at most one entry per characteristic
    )
    primary = F.slice(F.transform("_high", lambda e: e["n"]), 1, 3)
    return packed.withColumn("primary", primary).select(
        "hero_id", "primary", F.slice(F.array_except("_all", "primary"), 1, 4).alias("secondary")
    )


def source_confidence(roster: DataFrame, mechanics: DataFrame, aggregate: DataFrame, optional: DataFrame, minimum: int = 20) -> DataFrame:
    """Band of source completeness; ``aggregate`` is a bracket profile, ``optional`` has a status."""
    flag = lambda df, name: df.select("hero_id").distinct().withColumn(name, F.lit(True))
    public = aggregate.where(F.col("population") == "public_aggregate").groupBy("hero_id").agg(F.sum("picks").alias("p"))
    extra = optional.where(F.col("status").isin("available", "partial"))
    joined = (
        roster.select("hero_id")
        .join(flag(mechanics, "m"), "hero_id", "left")
        .join(flag(aggregate, "a"), "hero_id", "left")
        .join(flag(extra, "o"), "hero_id", "left")
        .join(public, "hero_id", "left")
        .na.fill(False, ["m", "a", "o"])
        .na.fill(0, ["p"])
    )
    band = (
        F.when(F.col("m") & F.col("a"), F.when(F.col("p") >= minimum, "high").otherwise("moderate"))
        .when(F.col("m"), "moderate")
        .when(F.col("a"), F.when(F.col("p") >= minimum, "moderate").otherwise("low"))
        .otherwise("unknown")
    )
    sources = F.array_compact(
        F.array(
            F.when(F.col("m"), F.lit("mechanics")),
            F.when(F.col("a"), F.lit("aggregate")),
            F.when(F.col("o"), F.lit("optional")),
        )
    )
    return joined.select("hero_id", band.alias("band"), sources.alias("derived_from"))


ABILITY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("name_loc", T.StringType()),
        T.StructField("desc_loc", T.StringType()),
        T.StructField("ability_has_scepter", T.BooleanType()),
        T.StructField("ability_has_shard", T.BooleanType()),
        T.StructField(
            "special_values",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("values_float", T.ArrayType(T.DoubleType())),
                        T.StructField("is_percentage", T.BooleanType()),
                    ]
                )
            ),
        ),
    ]
)
HERO_DETAIL = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("name_loc", T.StringType()),
        T.StructField("primary_attr", T.LongType()),
        T.StructField("complexity", T.LongType()),
        T.StructField("role_levels", T.ArrayType(T.LongType())),
        T.StructField("max_health", T.DoubleType()),
        T.StructField("armor", T.DoubleType()),
        T.StructField("abilities", T.ArrayType(ABILITY)),
        T.StructField("talents", T.ArrayType(ABILITY)),
        T.StructField(
            "facets", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("title_loc", T.StringType())]))
        ),
    ]
)
# The order of the role levels and of the primary attributes.
ROLE_LEVELS = ("Carry", "Support", "Nuker", "Disabler", "Jungler", "Durable", "Escape", "Pusher", "Initiator")
ATTRIBUTES = ("strength", "agility", "intelligence", "universal")


def hero_mechanics(detail: DataFrame) -> DataFrame:
    """Roles, abilities with their special values, talents and facets of each hero document."""
    roles = F.array_compact(
        F.array(
            *[F.when(F.try_element_at("role_levels", F.lit(i + 1)) > 0, F.lit(r)) for i, r in enumerate(ROLE_LEVELS)]
        )
    )

    def ability(a: Column) -> Column:
        return F.struct(
            a["id"].alias("ability_id"),
            a["name"].alias("internal_name"),
            a["name_loc"].alias("display_name"),
            a["desc_loc"].alias("description"),
            F.map_from_entries(
                F.transform(
                    F.coalesce(a["special_values"], F.array().cast(ABILITY["special_values"].dataType)),
                    lambda v: F.struct(v["name"], v["values_float"]),
                )
            ).alias("special_values"),
        )

    return detail.select(
        F.col("id").alias("hero_id"),
        F.col("name").alias("internal_name"),
        F.col("name_loc").alias("display_name"),
        F.try_element_at(F.array(*[F.lit(a) for a in ATTRIBUTES]), F.col("primary_attr").cast("int") + 1).alias(
            "primary_attribute"
        ),
        "complexity",
        roles.alias("roles"),
        F.transform("abilities", ability).alias("abilities"),
        F.transform("talents", ability).alias("talents"),
        F.transform("facets", lambda f: f["name"]).alias("facets"),
        F.struct("max_health", "armor").alias("base_stats"),
    )


def build_snapshot(roster: DataFrame, aggregate: DataFrame, optional: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Roster with its required aggregates, the optional source, and reviewed semantics on top."""
    return (
        roster.join(aggregate, "hero_id")
        .join(optional.withColumnRenamed("status", "optional_status"), "hero_id", "left")
        .join(reviewed.select("hero_id", F.col("functions").alias("_functions"), "review_status"), "hero_id", "left")
        .withColumns(
            {
                "optional_status": F.coalesce("optional_status", F.lit("unavailable")),
                "functions": F.coalesce("_functions", "functions"),
                "review_status": F.coalesce("review_status", F.lit("unreviewed")),
            }
        )
        .drop("_functions")
    )


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes per hero between two snapshots, and whether an approved record needs a new review.

    Both carry ``hero_id``, ``identity``, ``abilities``, ``talents``, ``facets``, ``base_stats``,
    ``empirical`` and ``review_status``; abilities and talents are arrays of (name, hash).
    """
    fields = ("identity", "abilities", "talents", "facets", "base_stats", "empirical", "review_status")
    left = old.select("hero_id", *[F.col(f).alias(f"o_{f}") for f in fields], F.lit(True).alias("_o"))
    right = new.select("hero_id", *[F.col(f).alias(f"n_{f}") for f in fields], F.lit(True).alias("_n"))
    both = left.join(right, "hero_id", "full_outer")
    names = lambda c: F.transform(c, lambda a: a["name"])
    added = F.array_sort(F.array_except(names("n_abilities"), names("o_abilities")))
    removed = F.array_sort(F.array_except(names("o_abilities"), names("n_abilities")))
    common = F.array_intersect(names("o_abilities"), names("n_abilities"))
    changed = F.exists(
        F.filter("n_abilities", lambda a: F.array_contains(common, a["name"])), lambda a: ~F.array_contains("o_abilities", a)
    )

    def differs(f: str) -> Column:
        return ~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}"))

    kinds = F.array_compact(
        F.array(
            F.when(differs("identity"), F.lit("identity_changed")),
            F.when((F.size(added) > 0) | (F.size(removed) > 0), F.lit("ability_added_removed")),
            F.when(changed, F.lit("mechanics_changed")),
            F.when(differs("facets"), F.lit("facet_changed")),
            F.when(differs("talents"), F.lit("talent_changed")),
            F.when(differs("base_stats"), F.lit("base_stats_changed")),
            F.when(differs("empirical"), F.lit("empirical_changed")),
        )
    )
    changes = (
        F.when(F.col("_o").isNull(), F.array(F.lit("hero_added")))
        .when(F.col("_n").isNull(), F.array(F.lit("hero_removed")))
        .otherwise(kinds)
    )
    approved = (F.col("o_review_status") == "approved") | (F.col("n_review_status") == "approved")
    return (
        both.withColumns({"changes": changes, "added": added, "removed": removed, "_ok": approved})
        .where(F.size("changes") > 0)
        .select(
            "hero_id",
            "changes",
            F.coalesce("added", F.array().cast("array<string>")).alias("added_abilities"),
            F.coalesce("removed", F.array().cast("array<string>")).alias("removed_abilities"),
            (
                F.col("_o").isNotNull()
                & F.col("_n").isNotNull()
                & F.coalesce(F.col("_ok"), F.lit(False))
                & F.exists("changes", lambda c: c != "empirical_changed")
            ).alias("review_required"),
        )
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
