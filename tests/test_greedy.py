"""Greedy selections against plain loops on small tables."""

from pyspark.sql import functions as F

from habitscope.operators import detectors, patterns, portfolio


def test_selection_matches_a_plain_greedy_loop(spark):
    roles = ("positive", "negative", "control")
    options = [
        (1, m, {f"h{m % 2}": roles[m % 3], **({"h2": roles[(m // 3) % 3]} if m % 4 == 0 else {})}, ((m * 37) % 101) / 150, m % 2 * 1.0)
        for m in range(1, 160)
    ]
    weights = {"h0": 0.6, "h1": 0.4, "h2": 0.3}
    frame = spark.createDataFrame(
        options, "account_id bigint, match_id bigint, evidence_roles map<string,string>, base_value double, detail_cost double"
    )
    primary = spark.createDataFrame(
        [(1, h, w, i + 1) for i, (h, w) in enumerate(weights.items())],
        "account_id bigint, hypothesis_id string, priority double, place int",
    )
    got = [r["match_id"] for r in detectors.plan_selection(frame, primary, 12, 6.0).orderBy("selection_order").collect()]

    left = {(h, g): 3 for h in weights for g in roles}
    want, cost = [], 0.0
    while len(want) < 12:
        best = None
        for _, match, role, base, price in options:
            useful = [(h, g) for h, g in role.items() if left[(h, g)] > 0]
            if match in want or not useful or cost + price > 6.0:
                continue
            gain = max(0.0, base + sum(weights[h] / left[(h, g)] for h, g in useful) - min(0.7, 0.015 * len(want)) - 0.04 * price)
            key = (gain, len(useful), len(role), -match)
            if gain >= 0.05 and (best is None or key > best[0]):
                best = (key, match, useful, price)
        if best is None:
            break
        want.append(best[1])
        cost += best[3]
        for need in best[2]:
            left[need] -= 1
    assert got == want
    state = detectors.plan_state(detectors.plan_selection(frame, primary, 12, 6.0), frame, primary, 12, 6.0).first()
    assert state.selected == len(want) and state.cost == cost
    assert {(n.hypothesis_id, n.group): n.missing for n in state.open_needs} == {k: v for k, v in left.items() if v}
    full, spent = len(want) >= 12, cost >= 6.0
    assert state.stopping_reason == ("max_deep_matches" if full else "max_data_cost" if spent else "marginal_gain_exhausted")


def test_equal_gains_take_the_smaller_match(spark):
    """Many candidates of one role and cost tie after rounding; the cut to the best ones keeps the smallest ids."""
    import random

    chance = random.Random(11)
    options = [(1, m, {"h": "positive"}, chance.choice([0.2, 0.4, 0.4 + 1e-12]), 1.0) for m in chance.sample(range(1000), 300)]
    frame = spark.createDataFrame(
        options, "account_id bigint, match_id bigint, evidence_roles map<string,string>, base_value double, detail_cost double"
    )
    primary = spark.createDataFrame([(1, "h", 0.5, 1)], "account_id bigint, hypothesis_id string, priority double, place int")
    got = [r["match_id"] for r in detectors.plan_selection(frame, primary).orderBy("selection_order").collect()]
    best = max(o[3] for o in options)
    assert got == sorted(o[1] for o in options if o[3] == best)[: len(got)] and len(got) == 3


def test_recommendations_pass_over_covered_additions(spark):
    rows = [(1, h, True, adds, {"k0": h}) for h, adds in ((1, ["a"]), (2, ["a"]), (3, []), (4, ["b", "a"]), (5, ["c"]))]
    frame = spark.createDataFrame(
        rows, "account_id bigint, hero_id bigint, eligible boolean, adds array<string>, order struct<k0:int>"
    )
    got = [r["hero_id"] for r in portfolio.recommend(frame).orderBy("rank").collect()]
    assert got == [1, 3, 4]


def test_pattern_highlights_prefer_tier_a_in_near_ties(spark):
    rows = [
        (1, "x", "f1", "B", 0.50, 0.9),
        (1, "y", "f2", "A", 0.49, 0.9),
        (1, "z", "f1", "A", 0.46, 0.9),
        (1, "w", "f3", "B", 0.30, 0.9),
    ]
    frame = spark.createDataFrame(
        rows, "account_id bigint, pattern string, family string, tier string, strength double, relationship_strength double"
    ).withColumns({"status": F.lit("qualified"), "confidence_score": F.lit(0.8), "evidence_coverage": F.lit(0.8)})
    got = [r["pattern"] for r in patterns.pattern_highlights(frame).orderBy("rank").collect()]
    assert got == ["y", "x", "z", "w"]


def test_theme_situations_are_distinct_and_limited(spark):
    traits = F.array(*[F.lit(t) for t in ("burst", "unknown", "burst", "save", "push", "pickoff")])
    got = spark.range(1).select(portfolio.situations(traits).alias("s")).first()["s"]
    assert len(got) == 3 and got[0] == "the enemy backline is difficult to reach"
