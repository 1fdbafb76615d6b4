"""Recommendations from bits of jobs and demands against loops over their names."""

from itertools import combinations

from pyspark.sql import functions as F

from habitscope.operators import actions, portfolio
from habitscope.sources import views

INTENTS = ("double_down", "adjacent_move", "fill_gap", "change_angle", "specialist")


def tables(spark):
    heroes = [1, 2, 2, 3, 3, 3, 8, 8, 11, 11]
    games = [(m, m % 3, heroes[m % 10] + m % 2, ("carry", "mid", "offlane")[m % 3 - 1], 1000 + m) for m in range(60)]
    rows = spark.createDataFrame(games, "match_id bigint, account_id bigint, hero_id bigint, role_hint string, started_at bigint")
    known = views.hero_knowledge(views.hero_traits(spark, 30))
    # A job beyond the fixed list and one that is named twice.
    odd = F.when(F.col("hero_id") % 4 == 1, F.concat("functions", F.array(F.lit("roshan")), F.slice("functions", 1, 1)))
    return rows, known.withColumn("functions", F.coalesce(odd, "functions"))


def test_pairs_have_the_jobs_and_demands_of_a_loop(spark):
    rows, known = tables(spark)
    heroes = {r["hero_id"]: r for r in known.collect()}
    state = {r["account_id"]: r for r in portfolio.observed_semantics(rows, known).collect()}
    pairs = portfolio._pairs(rows, known).collect()
    assert len(pairs) == sum(30 - len(s["used"]) for s in state.values())
    for p in pairs:
        hero, own = heroes[p["hero_id"]], state[p["account_id"]]
        bands = own["bands"] or {}
        new = [d for d in portfolio.DEMANDS if (hero["demands"] or {}).get(d) in ("medium", "high") and bands.get(d) not in ("medium", "high")]
        assert p["_anchors"] == sum(f in own["jobs"] for f in hero["functions"])
        assert p["_adds"] == sum(f not in own["jobs"] for f in hero["functions"])
        assert p["_demands"] == len(new)


def test_several_intents_from_one_comparison(spark):
    rows, known = tables(spark)
    families = {i: F.lit("engage_control") if i == "fill_gap" else None for i in INTENTS}
    together = portfolio.recommend_each(rows, known, families)
    # The account's own jobs are gathered once, however many intents are asked.
    assert together._jdf.queryExecution().optimizedPlan().toString().count("collect_set(hero_id") == 2
    got = {(r["account_id"], r["intent"], r["rank"], r["hero_id"]) for r in together.collect()}
    want = set()
    for intent, family in families.items():
        one = portfolio.recommend(portfolio.rationales(rows, known, intent, family)).collect()
        want |= {(r["account_id"], intent, r["rank"], r["hero_id"]) for r in one}
    assert got == want and len({i for _, i, _, _ in got}) > 1


def test_playbook_compares_all_pairs_once(spark):
    rows, known = tables(spark)
    table = actions.same_playbook(rows, known)
    assert table._jdf.queryExecution().optimizedPlan().toString().count("collect_set(hero_id") == 2
    assert table.count() == 3


def test_overlap_of_profiles_is_that_of_the_job_sets(spark):
    rows, known = tables(spark)
    heroes = {r["hero_id"]: r for r in known.collect()}
    used = {}
    for r in rows.select("account_id", "hero_id").distinct().collect():
        hero = heroes[r["hero_id"]]
        if hero["reviewed"] and hero["functions"]:
            used.setdefault(r["account_id"], []).append(set(hero["functions"]))
    for r in portfolio.semantic_profile(rows, known).collect():
        overlaps = [len(a & b) / len(a | b) for a, b in combinations(used[r["account_id"]], 2)]
        assert abs(r["overlap"] - sum(overlaps) / len(overlaps)) < 1e-9
