"""Reference-data derivation, validation and text queries."""

from pyspark.sql import functions as F

from catalog.base import canonical_sql, register
from catalog.detail import DETAIL_SQL
from catalog.elements import PART_SQL
from catalog.heroes import knowledge, traits
from habitscope.operators import knowledge as K
from habitscope.operators import quality, text
from habitscope.session import cut, new_folder
from habitscope.sources import heroes as H
from habitscope.sources import store, views


def detail(spark, folder):
    return views.detail_rows(spark, folder)


def stats(spark, folder):
    """Wide pick and win columns per hero, as the aggregate source has them."""
    won = F.col("won").cast("bigint")
    rank = (F.col("rank_tier") / 10).cast("int")
    columns = []
    for r in range(1, 8):
        columns += [
            F.count_if(rank == r).alias(f"{r}_pick"),
            F.sum(F.when(rank == r, won).otherwise(0)).alias(f"{r}_win"),
        ]
    return (
        detail(spark, folder)
        .groupBy("hero_id")
        .agg(*columns, F.count(F.lit(1)).alias("pub_pick"), F.sum(won).alias("pub_win"))
    )


def durations(spark, folder):
    return (
        detail(spark, folder)
        .groupBy("hero_id", (F.floor(F.col("duration_seconds") / 300) * 300).alias("duration_bin"))
        .agg(F.count(F.lit(1)).alias("games_played"), F.sum(F.col("won").cast("bigint")).alias("wins"))
    )


def popularity(spark, folder):
    phase = F.element_at(
        F.array(*[F.lit(p) for p in ("start_game", "early_game", "mid_game", "late_game")]),
        (F.col("line_no") % 4 + 1).cast("int"),
    )
    counted = (
        detail(spark, folder)
        .groupBy("hero_id", phase.alias("phase"), (F.col("obs_placed") + F.col("kills") + 1).cast("string").alias("item"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    inner = counted.groupBy("hero_id", "phase").agg(
        F.map_from_entries(F.collect_list(F.struct("item", "c"))).alias("items")
    )
    return inner.groupBy("hero_id").agg(F.map_from_entries(F.collect_list(F.struct("phase", "items"))).alias("phases"))


def matchups(spark, folder):
    return (
        detail(spark, folder)
        .groupBy("hero_id", (F.col("account_id") % 20 + 1).alias("opponent"))
        .agg(F.count(F.lit(1)).alias("games"), F.sum(F.col("won").cast("bigint")).alias("wins"))
    )


_BRACKETS = " union all ".join(
    f"select hero_id, 'rank_tier_{r}' as bracket, 'public_aggregate' as population, count(*) filter (rank_tier = {r * 10}) as picks, count(*) filter (rank_tier = {r * 10} and won) as wins from dr group by 1"
    for r in range(1, 8)
)
PROFILE_SQL = f"""{DETAIL_SQL},
br as ({_BRACKETS} union all select hero_id, 'public', 'public_aggregate', count(*), count(*) filter (won) from dr group by 1),
du as (select hero_id, duration_seconds // 300 * 300 as duration_bin_seconds, count(*) as games, count(*) filter (won) as wins from dr group by 1, 2),
it as (select hero_id, ['start', 'early', 'mid', 'late'][line_no % 4 + 1] as phase, obs_placed + kills + 1 as item_id, count(*) as count from dr group by 1, 2, 3),
mu as (select hero_id, account_id % 20 + 1 as opponent_hero_id, count(*) as games, count(*) filter (won) as wins from dr group by 1, 2)"""


@register(
    "knw_bracket_profile",
    f"with {PROFILE_SQL} select *, case when picks > 0 then wins / picks end as win_rate from br",
    "win_rate",
)
def knw_bracket_profile(spark, folder):
    return K.bracket_profile(stats(spark, folder))


@register(
    "knw_duration_profile",
    f"with {PROFILE_SQL} select *, wins / games as win_rate from du",
    "win_rate",
)
def knw_duration_profile(spark, folder):
    return K.duration_profile(durations(spark, folder))


@register(
    "knw_item_profile",
    f"with {PROFILE_SQL} select *, count / sum(count) over (partition by hero_id, phase) as share from it",
    "share",
)
def knw_item_profile(spark, folder):
    return K.item_profile(popularity(spark, folder))


@register(
    "knw_matchup_profile",
    f"with {PROFILE_SQL} select *, wins / games as win_rate from mu",
    "win_rate",
)
def knw_matchup_profile(spark, folder):
    return K.matchup_profile(matchups(spark, folder))


@register(
    "knw_behaviour_bands",
    f"""with {PROFILE_SQL}, i as (select hero_id, sum(count) as t, max(count) as m from it group by 1), tp as (select * from (select *, row_number() over (partition by hero_id order by count desc, phase, item_id) as k from it) where k = 1),
    d as (select hero_id, sum(games) as g, sum(duration_bin_seconds * games) / sum(games) as w from du group by 1), p as (select hero_id, sum(picks) as p from br group by 1)
    select i.hero_id, case when m / t >= 0.5 then 'high' when m / t >= 0.3 then 'medium' else 'low' end as item_dependency, tp.item_id as top_item_id, m / t as top_item_share,
      case when w < 1500 then 'earlier-biased' when w > 2700 then 'later-biased' else 'balanced' end as duration_band, round(w, 3) as weighted_seconds,
      case when p >= 1000 then 'high' when p >= 100 then 'medium' else 'low' end as meta_confidence, p::bigint as public_matches, 'observed' as matchup_context
    from i join tp using (hero_id) join d using (hero_id) join p using (hero_id)""",
    "top_item_share weighted_seconds",
)
def knw_behaviour_bands(spark, folder):
    brackets = K.bracket_profile(stats(spark, folder))
    return K.behaviour_bands(
        brackets.select("hero_id").distinct(),
        brackets,
        K.duration_profile(durations(spark, folder)),
        K.item_profile(popularity(spark, folder)),
        K.matchup_profile(matchups(spark, folder)),
    )


def ability_texts(spark, folder):
    doc = F.col("doc_id").cast("bigint")
    return views.table(spark, folder, "documents").select(
        (doc % 20 + 1).alias("hero_id"), doc.alias("ref"), "text"
    )


_TAGS = " union all ".join(
    f"select hero_id, ref, '{name}' as characteristic from ab where regexp_matches(t, '{'|'.join(f'(?:{p})' for p in patterns)}')"
    for name, patterns in K.TAG_RULES.items()
)
TAG_SQL = f"""ab as (select doc_id % 20 + 1 as hero_id, doc_id as ref, lower(text) as t from documents),
tg as ({_TAGS} union all select hero_id, ref, 'area' from ab where (contains(t, 'radius') or contains(t, 'area') or contains(t, 'nearby')) and contains(t, 'damage'))"""


@register("knw_mechanics_tags", f"with {TAG_SQL} select * from tg")
def knw_mechanics_tags(spark, folder):
    return K.tags(ability_texts(spark, folder))


def _capability_sql(sturdy: str, complex_: str) -> str:
    band = "case when {0} >= 2 then 'high' else 'medium' end"
    return f"""w as (select hero_id, characteristic as c, count(distinct ref) as n from tg group by 1, 2),
v as (select hero_id, coalesce(max(n) filter (c = 'area'), 0) as area, coalesce(max(n) filter (c = 'initiation'), 0) as initiation, coalesce(max(n) filter (c = 'burst'), 0) as burst,
  coalesce(max(n) filter (c = 'sustained_damage'), 0) as steady, coalesce(max(n) filter (c = 'mobility'), 0) as mobility, coalesce(max(n) filter (c = 'displacement'), 0) as moved,
  coalesce(max(n) filter (c = 'micro'), 0) as micro from w group by 1),
cap as (select hero_id, c as characteristic, {band.format('n')} as band from w where c <> 'area'
  union all select hero_id, 'frontline', 'high' from v where {sturdy}
  union all select hero_id, 'teamfight', {band.format('area')} from v where area > 0
  union all select hero_id, 'wave_clear', 'high' from v where area >= 2
  union all select hero_id, 'pickoff', 'high' from v where initiation > 0 and (burst > 0 or steady > 0)
  union all select hero_id, 'repositioning', {band.format('mobility')} from v where mobility > 0
  union all select hero_id, 'access', {band.format('mobility')} from v where mobility > 0
  union all select hero_id, 'counter_initiation', {band.format('moved')} from v where moved > 0
  union all select hero_id, 'execution', 'high' from v where micro > 0 or {complex_})"""


@register(
    "knw_capabilities",
    f"with {TAG_SQL}, {_capability_sql('500 + hero_id * 12 >= 600 and hero_id % 6 >= 3', 'hero_id % 3 + 1 = 3')} select * from cap",
)
def knw_capabilities(spark, folder):
    tagged = K.tags(ability_texts(spark, folder))
    base = tagged.select("hero_id").distinct().select(
        "hero_id",
        (F.lit(500) + F.col("hero_id") * 12).cast("double").alias("max_health"),
        (F.col("hero_id") % 6).cast("double").alias("armor"),
        (F.col("hero_id") % 3 + 1).cast("int").alias("complexity"),
    )
    return K.capabilities(tagged, base)


# The tags once more, where damage may also be a flag: ids that seven divides have it.
_FLAGGED = TAG_SQL.replace("and contains(t, 'damage')", "and (contains(t, 'damage') or ref % 7 = 0)")
_PROOF = f"""{_FLAGGED},
once as (select distinct hero_id, characteristic as c, ref::varchar as ref from tg),
have as (select hero_id, c, count(*) as n from once group by 1, 2),
hero as (select distinct hero_id, hero_id <> 20 and 500 + hero_id * 12 >= 600 and hero_id % 6 >= 3 as sturdy, hero_id <> 20 and hero_id % 3 + 1 = 3 as hard from ab),
lean as (select once.*, sturdy, hard, n, exists (from have x where x.hero_id = once.hero_id and x.c = 'initiation') as opens,
    exists (from have x where x.hero_id = once.hero_id and x.c = 'burst') as bursts, exists (from have x where x.hero_id = once.hero_id and x.c = 'sustained_damage') as burns
  from once join have using (hero_id, c) join hero using (hero_id)),
proof as (
  select hero_id, 'capability' as kind, case c when 'area' then 'teamfight' else c end as characteristic, if(n >= 2, 'high', 'medium') as band, ref from lean
  union select hero_id, 'capability', 'wave_clear', 'high', ref from lean where c = 'area' and n >= 2
  union select hero_id, 'capability', 'frontline', 'high', ref from lean where c = 'initiation' and sturdy
  union select hero_id, 'capability', 'pickoff', 'high', ref from lean where (c = 'initiation' and (bursts or burns)) or (c = 'burst' and opens) or (c = 'sustained_damage' and opens and not bursts)
  union select hero_id, 'capability', unnest(['repositioning', 'access']), if(n >= 2, 'high', 'medium'), ref from lean where c = 'mobility'
  union select hero_id, 'capability', 'counter_initiation', if(n >= 2, 'high', 'medium'), ref from lean where c = 'displacement'
  union select hero_id, 'capability', 'execution', 'high', ref from lean where c = 'micro' and not hard
  union select hero_id, 'demand', unnest(['commitment', 'exposure']), if(sturdy, 'high', 'medium'), ref from lean where c = 'initiation'
  union select hero_id, 'demand', 'execution', 'high', ref from lean where c = 'micro'
  union select hero_id, k, v, 'high', r from hero, (values ('capability', 'frontline'), ('demand', 'commitment'), ('demand', 'exposure')) kv(k, v),
    (values ('base_stats:max_health'), ('base_stats:armor')) rs(r) where sturdy
  union select hero_id, 'capability', 'execution', 'high', 'identity:complexity' from hero where hard
  union select hero_id, 'demand', 'execution', 'high', 'identity:complexity' from hero where hard and hero_id not in (select hero_id from have where c = 'micro')
  union select hero_id, 'demand', 'access', 'high', 'rule:no_mobility_signal' from hero where hero_id not in (select hero_id from have where c in ('mobility', 'global_pressure')))"""


def proof(spark, folder):
    """References behind the bands; the stats of hero 20 are not known."""
    texts = ability_texts(spark, folder).withColumn("damages", F.col("ref") % 7 == 0)
    known = F.col("hero_id") != 20
    base = texts.select("hero_id").distinct().select(
        "hero_id",
        F.when(known, 500 + F.col("hero_id") * 12).cast("double").alias("max_health"),
        F.when(known, F.col("hero_id") % 6).cast("double").alias("armor"),
        F.when(known, F.col("hero_id") % 3 + 1).cast("int").alias("complexity"),
    )
    return K.evidence(K.tags(texts), base, texts)


@register("knw_evidence", f"with {_PROOF} select *, 'mechanic-rules-1.0.0' as rule_version from proof")
def knw_evidence(spark, folder):
    return proof(spark, folder)


@register(
    "knw_demands",
    f"""with {_PROOF} select hero_id, characteristic as demand, band, 'mechanic-rules-1.0.0' as rule_version, count(*) as reference_count
    from proof where kind = 'demand' group by all""",
)
def knw_demands(spark, folder):
    return K.demands(proof(spark, folder))


@register(
    "knw_functions",
    f"""with {TAG_SQL}, {_capability_sql('false', 'false')},
    hi as (select hero_id, characteristic as c, row_number() over (partition by hero_id order by characteristic not in ('teamfight', 'initiation', 'save', 'mobility'), characteristic) as k from cap where band = 'high'),
    pr as (select * from hi where k <= 3),
    se as (select cap.hero_id, characteristic as c, row_number() over (partition by cap.hero_id order by characteristic) as k from cap left join pr on cap.hero_id = pr.hero_id and characteristic = pr.c where pr.c is null)
    select h.hero_id, coalesce((select string_agg(c, ',' order by k) from pr where pr.hero_id = h.hero_id), '') as "primary",
      coalesce((select string_agg(c, ',' order by k) from se where se.hero_id = h.hero_id and k <= 4), '') as secondary
    from (select distinct hero_id from cap) h""",
)
def knw_functions(spark, folder):
    table = K.functions_of(K.capabilities(K.tags(ability_texts(spark, folder))))
    return table.select(
        "hero_id", F.concat_ws(",", "primary").alias("primary"), F.concat_ws(",", "secondary").alias("secondary")
    )


_HERO_IDS = "(select p_partkey as hero_id from part)"
_PLAYED = "(select distinct p_partkey % 20 + 1 as hero_id from part)"


def _ids(spark, folder):
    return views.table(spark, folder, "part").select(F.col("p_partkey").cast("bigint").alias("hero_id"))


def _played(spark, folder):
    """Heroes of the detail rows."""
    return views.table(spark, folder, "part").select((F.col("p_partkey") % 20 + 1).alias("hero_id")).distinct()


def _optional(spark, folder):
    h = F.col("hero_id")
    frame = _ids(spark, folder).where(h % 4 != 0).select(
        "hero_id", F.when(h % 3 != 0, h).alias("a"), F.when(h % 5 != 0, h).alias("b")
    )
    return store.optional_status(frame, ["a", "b"]).select("hero_id", "status")


@register(
    "src_optional_status",
    f"""select hero_id, case when hero_id % 3 = 0 and hero_id % 5 = 0 then 'unavailable' when hero_id % 3 = 0 or hero_id % 5 = 0 then 'partial' else 'available' end as status
    from {_HERO_IDS} where hero_id % 4 <> 0""",
)
def src_optional_status(spark, folder):
    return _optional(spark, folder)


@register(
    "knw_source_confidence",
    f"""with {PROFILE_SQL} select h.hero_id, case when h.hero_id % 2 = 0 then 'high' else 'moderate' end as band,
      concat_ws(',', case when h.hero_id % 2 = 0 then 'mechanics' end, 'aggregate', case when h.hero_id % 4 <> 0 and not (h.hero_id % 3 = 0 and h.hero_id % 5 = 0) then 'optional' end) as derived_from
    from {_PLAYED} h join (select hero_id, sum(picks) as p from br group by 1) using (hero_id)""",
)
def knw_source_confidence(spark, folder):
    ids = _played(spark, folder)
    table = K.source_confidence(
        ids,
        ids.where(F.col("hero_id") % 2 == 0),
        K.bracket_profile(stats(spark, folder)),
        _optional(spark, folder),
    )
    return table.withColumn("derived_from", F.concat_ws(",", "derived_from"))


@register(
    "join_snapshot_build",
    f"""with {PROFILE_SQL} select h.hero_id, sum(picks)::bigint as picks, case when h.hero_id % 4 = 0 then 'unavailable' when h.hero_id % 3 = 0 and h.hero_id % 5 = 0 then 'unavailable'
      when h.hero_id % 3 = 0 or h.hero_id % 5 = 0 then 'partial' else 'available' end as optional_status, case when h.hero_id % 10 = 0 then 'unreviewed' else 'reviewed' end as review_status
    from {_PLAYED} h join br using (hero_id) group by 1""",
)
def join_snapshot_build(spark, folder):
    known = knowledge(spark)
    base = _played(spark, folder).join(known.select("hero_id", F.slice("functions", 1, 1).alias("functions")), "hero_id")
    aggregate = K.bracket_profile(stats(spark, folder)).groupBy("hero_id").agg(F.sum("picks").alias("picks"))
    reviewed = known.where(F.col("reviewed")).select("hero_id", "functions", "review_status")
    built = K.build_snapshot(base, aggregate, _optional(spark, folder), reviewed)
    return built.select("hero_id", "picks", "optional_status", "review_status")


def _snapshot(spark, folder, new: bool):
    h = F.col("hero_id")
    shift = F.when(h % 3 == 0, 1).otherwise(0) if new else F.lit(0)
    extra = F.when(h % 4 == 0, 1).otherwise(0) if new else F.lit(0)
    named = lambda prefix, n, value: F.transform(
        F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("name"), value.cast("int").alias("hash"))
    )
    keep = (h % 7 != 0) if new else (h % 6 != 0)
    return (
        _ids(spark, folder)
        .where(keep)
        .select(
            "hero_id",
            F.struct(h.alias("key")).alias("identity"),
            named("ability", F.lit(2) + extra, h + shift).alias("abilities"),
            named("talent", F.lit(2), h).alias("talents"),
            F.array(F.lit("facet")).alias("facets"),
            F.struct((h * 10 + (F.when(h % 5 == 0, 1).otherwise(0) if new else F.lit(0))).alias("health")).alias("base_stats"),
            (h * 100 + (F.when(h % 2 == 0, 1).otherwise(0) if new else F.lit(0))).alias("empirical"),
            F.when(h % 4 < 2, "approved").otherwise("draft").alias("review_status"),
        )
    )


@register(
    "join_snapshot_diff",
    f"""with d as (select hero_id, case when hero_id % 6 = 0 and hero_id % 7 <> 0 then ['hero_added'] when hero_id % 7 = 0 and hero_id % 6 <> 0 then ['hero_removed'] when hero_id % 6 <> 0 and hero_id % 7 <> 0 then list_filter([
      case when hero_id % 4 = 0 then 'ability_added_removed' end, case when hero_id % 3 = 0 then 'mechanics_changed' end, case when hero_id % 5 = 0 then 'base_stats_changed' end,
      case when hero_id % 2 = 0 then 'empirical_changed' end], lambda x: x is not null) end as changes from {_HERO_IDS})
    select hero_id, array_to_string(changes, ',') as changes, hero_id % 6 <> 0 and hero_id % 7 <> 0 and hero_id % 4 < 2 and len(list_filter(changes, lambda c: c <> 'empirical_changed')) > 0 as review_required
    from d where len(changes) > 0""",
)
def join_snapshot_diff(spark, folder):
    table = K.diff_snapshots(_snapshot(spark, folder, False), _snapshot(spark, folder, True))
    return table.select("hero_id", F.concat_ws(",", "changes").alias("changes"), "review_required")


_RECORDS = """ev as (select (p_partkey % 20) + 1 as hero_id, (p_partkey // 20) % 20 + 1 as related_hero_id, p_size as sample_size, (p_partkey % 100) / 100 as adjusted_score,
  (p_size * 2) / 100 as confidence_score, p_partkey % 9 = 0 as broken from part)"""


def _artifact(spark, folder):
    key, size = F.col("p_partkey").cast("bigint"), F.col("p_size").cast("bigint")
    fields = {
        "hero_id": key % 20 + 1,
        "related_hero_id": F.floor(key / 20) % 20 + 1,
        "sample_size": size,
        "adjusted_score": (key % 100) / 100,
        "confidence_score": (size * 2) / 100,
    }
    record = F.struct(
        *[
            (F.when(key % 9 == 0, "broken").otherwise(v.cast("string")) if n == "hero_id" else v.cast("string")).alias(n)
            for n, v in fields.items()
        ],
        F.lit("all").alias("patch_scope"),
    )
    # One artifact per part, so that no file gathers the records of the whole table.
    return views.table(spark, folder, "part").select(
        F.when(key % 11 == 0, "old").otherwise("v1").alias("version"), F.array(record).alias("records")
    )


@register(
    "src_evidence_records",
    f"with {_RECORDS} select hero_id, related_hero_id, sample_size::bigint as sample_size, adjusted_score, confidence_score from ev, part where false union all "
    "select (p_partkey % 20) + 1, (p_partkey // 20) % 20 + 1, p_size::bigint, (p_partkey % 100) / 100, (p_size * 2) / 100 from part where p_partkey % 9 <> 0 and p_partkey % 11 <> 0",
    "adjusted_score confidence_score",
)
def src_evidence_records(spark, folder):
    return H.evidence_records(_artifact(spark, folder), "v1").drop("patch_scope")


@register(
    "join_representative_matchups",
    """select * from (select (p_partkey % 20) + 1 as hero_id, (p_partkey // 20) % 20 + 1 as related_hero_id, p_size::bigint as sample_size,
      row_number() over (partition by p_partkey % 20 order by p_size desc, p_partkey % 100 desc, p_size desc, (p_partkey // 20) % 20) as place
      from part where p_partkey % 9 <> 0 and p_partkey % 11 <> 0 and p_size * 2 / 100 >= 0.65) where place <= 3""",
)
def join_representative_matchups(spark, folder):
    return H.representative(H.evidence_records(_artifact(spark, folder), "v1")).select(
        "hero_id", "related_hero_id", "sample_size", "place"
    )


@register(
    "dq_aggregates",
    f"""with {PROFILE_SQL}, b as (select hero_id, picks, case when hero_id % 4 = 0 then picks + 1 else wins end as wins from br),
      m as (select hero_id, case when hero_id % 5 = 0 and opponent_hero_id = 1 then 99 else opponent_hero_id end as o, games, wins from mu)
    select 'brackets' as section, hero_id, 'wins_exceed_count' as violation from b where wins > picks
    union all select 'matchups', hero_id, 'unknown_opponent' from m where o = 99""",
)
def dq_aggregates(spark, folder):
    h = F.col("hero_id")
    brackets = K.bracket_profile(stats(spark, folder)).withColumn(
        "wins", F.when(h % 4 == 0, F.col("picks") + 1).otherwise(F.col("wins"))
    )
    met = K.matchup_profile(matchups(spark, folder)).withColumn(
        "opponent_hero_id",
        F.when((h % 5 == 0) & (F.col("opponent_hero_id") == 1), 99).otherwise(F.col("opponent_hero_id")),
    )
    return quality.aggregates(
        brackets,
        K.duration_profile(durations(spark, folder)),
        K.item_profile(popularity(spark, folder)),
        met,
        traits(spark).select("hero_id"),
    )


@register(
    "dq_semantic_layer",
    f"select hero_id, 'hero_not_approved' as violation from {_HERO_IDS} union all select hero_id, 'unknown_function' from {_HERO_IDS} where hero_id % 6 = 0 "
    f"union all select hero_id, 'invalid_hero_id' from {_HERO_IDS} where hero_id <= 0",
)
def dq_semantic_layer(spark, folder):
    h = F.col("hero_id")
    records = (
        views.hero_knowledge(views.part_heroes(spark, folder))
        .withColumns(
            {
                "primary_functions": F.when(h % 6 == 0, F.array(F.lit("dancing"))).otherwise(F.col("primary_functions")),
                "demands": F.map_from_arrays(
                    F.array(*[F.lit(d) for d in quality.DEMANDS]), F.array(*[F.lit("low") for _ in quality.DEMANDS])
                ),
            }
        )
    )
    return quality.semantic_layer(records)


@register(
    "dq_roster",
    f"""select hero_id, 'missing_display_name' as violation from {_HERO_IDS} where hero_id % 5 = 0
    union all select hero_id, 'duplicate_internal_name' from {_HERO_IDS} where hero_id in (1, 11)
    union all select hero_id, 'invalid_hero_id' from {_HERO_IDS} where hero_id <= 0""",
)
def dq_roster(spark, folder):
    h = F.col("hero_id")
    rows = _ids(spark, folder).select(
        "hero_id",
        F.concat(F.lit("hero_"), F.when(h == 11, 1).otherwise(h).cast("string")).alias("internal_name"),
        F.when(h % 5 != 0, F.lit("name")).alias("display_name"),
        F.array(F.lit("a")).alias("abilities"),
    )
    return quality.roster(rows)


@register(
    "dq_taxonomy",
    f"select hero_id, 'trait_out_of_range' as violation from {_HERO_IDS} where hero_id % 8 = 0",
)
def dq_taxonomy(spark, folder):
    bad = F.when(F.col("hero_id") % 8 == 0, F.transform_values("traits", lambda _, v: v + 2)).otherwise(F.col("traits"))
    return quality.taxonomy(views.part_heroes(spark, folder).withColumn("traits", bad))


def _digest_sql(table, columns):
    """Rows and digest of a table: entries, chunks by three hex digits where there are more than 1,024, and their root."""
    return f"""select '{table}' as "table", (select sum(c) from e_{table})::bigint as rows,
      case when (select count(*) from e_{table}) <= 1024 then (select sha256(string_agg(d || ':' || c, '|' order by d)) from e_{table})
      else (select sha256(string_agg(p || ':' || h, '|' order by p)) from (
        select substr(d, 1, 3) as p, sha256(string_agg(d || ':' || c, '|' order by d)) as h from e_{table} group by 1)) end as checksum, 'v1' as version"""


_TABLE_TEXT = {
    "events": {"event_id": "event_id::varchar", "ts": "epoch_us(ts)::varchar", "user_id": "user_id::varchar", "event_type": "event_type", "value": "value::varchar", "props": "props"},
    "orders": {
        **{c: f"{c}::varchar" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")},
        "o_orderdate": "epoch_us(o_orderdate)::varchar",
    },
}
_ENTRIES = ", ".join(
    f"e_{t} as (select d, count(*) as c from (select sha256({canonical_sql(columns)}) as d from {t}) group by 1)"
    for t, columns in _TABLE_TEXT.items()
)


@register("dq_manifest", f"with {_ENTRIES} " + " union all ".join(_digest_sql(t, c) for t, c in _TABLE_TEXT.items()))
def dq_manifest(spark, folder):
    return quality.manifest({name: views.table(spark, folder, name) for name in _TABLE_TEXT}, "v1")


@register(
    "src_trait_load",
    f"""with {PART_SQL}, c as (select hero_id, '[' || string_agg('{{"key":"' || trait || '","value":' || value::varchar || '}}', ',' order by trait) || ']' as t from hero_trait group by 1)
    select p_partkey as hero_id, p_partkey % 9 <> 0 as factual, case when p_partkey % 7 <> 0 then sha256(t) end as checksum
    from part left join c on hero_id = p_partkey where p_partkey % 63 <> 0""",
)
def src_trait_load(spark, folder):
    """Factual and editorial rows on the same ids; each side lacks some."""
    table = views.part_heroes(spark, folder)
    factual = table.where(F.col("hero_id") % 9 != 0).select("hero_id", F.lit(True).alias("factual"))
    loaded = H.load_traits(factual, table.where(F.col("hero_id") % 7 != 0).select("hero_id", "traits"))
    return loaded.select("hero_id", F.coalesce("factual", F.lit(False)).alias("factual"), "checksum")


@register(
    "src_trait_dimension",
    f"select hero_id, 'missing_editorial' as error from {_HERO_IDS} where hero_id % 7 = 0 union all select hero_id, 'missing_factual' from {_HERO_IDS} where hero_id % 9 = 0 and hero_id % 7 <> 0",
)
def src_trait_dimension(spark, folder):
    table = views.part_heroes(spark, folder)
    factual = table.where((F.col("hero_id") % 9 != 0) | (F.col("hero_id") % 7 == 0)).select("hero_id")
    return H.trait_errors(factual, table.where(F.col("hero_id") % 7 != 0))


# Text ----------------------------------------------------------------------------------------

_CANON = """'https://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '')"""


@register(
    "txt_article_urls",
    f"""with c as (select page_id, {_CANON} as p from pages) select p || '?l=english' as canonical, min(page_id) as page_id,
      case when regexp_extract(p, '/([0-9]+)$', 1) = '' then 'unknown' else regexp_extract(p, '/([0-9]+)$', 1) end as article_id from c where regexp_matches(p, '/[0-9]+$') group by 1, 3""",
)
def txt_article_urls(spark, folder):
    return text.article_urls(views.table(spark, folder, "pages"))


@register(
    "txt_dates",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d1, strftime(o_orderdate, '%Y-%m-%d') as d2, strftime(o_orderdate, '%Y-%m-%d') as d3, 'soon' as d4 from orders""",
)
def txt_dates(spark, folder):
    day = F.col("o_orderdate")
    return views.table(spark, folder, "orders").select(
        "o_orderkey",
        text.normal_date(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("d1"),
        text.normal_date(F.date_format(day, "MMMM d, yyyy")).alias("d2"),
        text.normal_date(F.concat(F.lit("posted "), F.date_format(day, "MMM d, yyyy"), F.lit(" here"))).alias("d3"),
        text.normal_date(F.lit(" soon ")).alias("d4"),
    )


@register(
    "txt_clean_markdown",
    r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') as body from documents""",
)
def txt_clean_markdown(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", text.clean_markdown(F.col("text")).alias("body"))


@register(
    "txt_slugs",
    r"""select p_partkey, case when s = '' then 'article' else s end as slug from (select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:100], '-+$', '') as s from part)""",
)
def txt_slugs(spark, folder):
    title = F.concat(F.col("p_name"), F.lit(" & "), F.col("p_type"))
    return views.table(spark, folder, "part").select("p_partkey", text.slug(title).alias("slug"))


def _text_sql(x):
    plain = f"replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39))"
    return rf"trim(regexp_replace(replace({plain}, '&amp;', '&'), '\s+', ' ', 'g'))"


# Articles of pages that have one article of plain paragraphs and headings.
_ARTICLE_SQL = rf"""p as (
      select page_id, url, {_CANON} as canonical, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as a,
        regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) as h from SOURCE),
    b as (
      select page_id, url, case when regexp_extract(canonical, '/([0-9]+)(?:$|[/?#])', 1) = '' then 'unknown' else regexp_extract(canonical, '/([0-9]+)(?:$|[/?#])', 1) end as article_id,
        {_text_sql('h')} as raw,
        list_filter(list_transform(string_split(regexp_replace(regexp_replace(a, '<(h1|p)>', chr(1) || '\1' || chr(2), 'g'), '</(?:h1|p)>', chr(1), 'g'), chr(1)),
          lambda x: case when contains(x, chr(2)) then [string_split(x, chr(2))[1], {_text_sql('string_split(x, chr(2))[2]')}] end),
          lambda x: x is not null and x[2] <> '') as blocks from p),
    t as (
      select page_id, url, article_id, trim(regexp_replace(raw, '(?i)\s*[|–—-]\s*News\s*$', '')) as title,
        array_to_string(list_transform(blocks, lambda x: case when x[1] = 'h1' then '# ' else '' end || x[2]), chr(10) || chr(10)) as md from b),
    d as (
      select page_id, url, article_id, title,
        case when lower(trim(regexp_extract(md, '^#[ \t]+([^\n]*)', 1))) = lower(title) then regexp_replace(md, '^#[^\n]*\n*', '') else md end as body from t),
    f as (
      select *, regexp_replace(regexp_replace(regexp_replace(translate(lower(title), 'àáâãäåèéêëìíîïòóôõöùúûüýÿñç', 'aaaaaaeeeeiiiiooooouuuuyync'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:100], '-+$', '') as s from d),
    g as (
      select page_id, url, article_id, title, null::varchar as date, body,
        'undated__' || case when s = '' then 'article' else s end || '__' || article_id || '.md' as filename from f)"""


def _articles(spark, folder):
    return text.articles(cut(text.extract(views.table(spark, folder, "pages"))))


@register("txt_articles", f"with {_ARTICLE_SQL.replace('SOURCE', 'pages')} select * from g where length(trim(body)) >= 20")
def txt_articles(spark, folder):
    return _articles(spark, folder)[0]


@register(
    "txt_documents",
    f"""with {_ARTICLE_SQL.replace('SOURCE', 'pages')}
    select filename, date, '---' || chr(10) || 'title: ' || to_json(title)::varchar || chr(10) || 'date: ""' || chr(10) || 'url: ' || to_json(url)::varchar
      || chr(10) || 'article_id: ' || to_json(article_id)::varchar || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || body as text
    from g where length(trim(body)) >= 20""",
)
def txt_documents(spark, folder):
    return text.documents(_articles(spark, folder)[0])


@register(
    "txt_written",
    f"""with {_ARTICLE_SQL.replace('SOURCE', 'pages')}
    select filename, strftime(o_orderdate, '%Y-%m') as month, length(text) as n_chars from (
      select page_id, strftime(o_orderdate, '%Y-%m-%d') || substr(filename, 8) as filename, o_orderdate,
        '---' || chr(10) || 'title: ' || to_json(title)::varchar || chr(10) || 'date: "' || strftime(o_orderdate, '%Y-%m-%d') || '"' || chr(10) || 'url: ' || to_json(url)::varchar
          || chr(10) || 'article_id: ' || to_json(article_id)::varchar || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || body as text
      from g join orders on o_orderkey = page_id where length(trim(body)) >= 20)""",
)
def txt_written(spark, folder):
    """Articles dated by the order of their number, written by month and read back."""
    dates = views.table(spark, folder, "orders").select(F.col("o_orderkey").alias("page_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("raw_date"))
    parsed = text.extract(views.table(spark, folder, "pages")).drop("raw_date").join(dates, "page_id")
    kept = text.write_documents(text.documents(text.articles(parsed)[0]), new_folder(spark, "articles"))
    return kept.select("filename", "month", F.length("text").cast("bigint").alias("n_chars"))


_TEASERS = "(select page_id, url, html from pages union all select -1 - page_id, url, regexp_replace(html, '(?s)</h1>.*</article>', '</h1></article>') from pages)"


@register(
    "txt_rejected",
    f"with {_ARTICLE_SQL.replace('SOURCE', _TEASERS)} select page_id, url, title, 'short_or_empty_body' as error from g where length(trim(body)) < 20",
)
def txt_rejected(spark, folder):
    """Every page and its teaser, which has the heading alone."""
    pages = views.table(spark, folder, "pages").select("page_id", "url", "html")
    short = F.regexp_replace("html", "(?s)</h1>.*</article>", "</h1></article>")
    teasers = pages.select((-1 - F.col("page_id")).alias("page_id"), "url", short.alias("html"))
    return text.articles(text.extract(pages.unionByName(teasers)))[1]
