"""Order statistics by rank against plain Python, with keys cut into ranges."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from habitscope.functions.robust import medians, middles_without_group, spread
from habitscope.operators import cohorts


@pytest.fixture(scope="module")
def values():
    """One key with thousands of distinct doubles, one with many equal values, small ones, a null key and null values."""
    draw = random.Random(11)
    rows = [("wide", draw.gauss(0, 1e6)) for _ in range(4001)]
    rows += [("ties", float(draw.randrange(4))) for _ in range(1500)]
    rows += [("one", 2.5), ("two", 1.0), ("two", 4.0), ("none", None), ("two", None), (None, 7.0), (None, 9.0)]
    return rows


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_medians_and_spread(spark, values, hot_rows):
    frame = spark.createDataFrame(values, "k string, x double")
    got = medians(frame, ["k"], {"m": F.col("x"), "d": F.col("x") * 2}, F.count(F.lit(1)).alias("n"), hot_rows=hot_rows)
    groups = {k: [x for key, x in values if key == k and x is not None] for k in {k for k, _ in values}}
    rows = {r.k: r for r in got.collect()}
    assert set(rows) == set(groups)
    for k, own in groups.items():
        want = statistics.median(own) if own else None
        assert rows[k].m == want and rows[k].d == (None if want is None else 2 * want)
        assert rows[k].n == sum(key == k for key, _ in values)
    for r in spread(frame.where("k is not null"), ["k"], "x", hot_rows=hot_rows).collect():
        own, middle = groups[r.k], statistics.median(groups[r.k])
        assert (r.centre, r.mad, r["sample"]) == (middle, statistics.median(abs(x - middle) for x in own), len(own))


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_medians_without_the_own_rows(spark, hot_rows):
    draw = random.Random(12)
    rows = [(f"c{draw.randrange(3)}", draw.randrange(40), float(draw.choice([draw.randrange(6), draw.random()]))) for _ in range(900)]
    rows += [("alone", 1, 5.0), ("alone", 1, 6.0)]
    # Group 99 asks and has no rows; group 1 asks in a cell that has none but its own.
    asked = [(f"c{g % 3}", g) for g in range(2, 40)] + [("c0", 99), ("alone", 1)]
    got = middles_without_group(
        spark.createDataFrame(rows, "cell string, g long, x double"),
        ("cell",),
        "g",
        spark.createDataFrame(asked, "cell string, g long"),
        {"m": F.col("x"), "neg": -F.col("x")},
        hot_rows,
    )
    found = {(r.cell, r.g): (r.m, r.neg) for r in got.collect()}
    want = {}
    for cell, g in asked:
        rest = [x for c, o, x in rows if c == cell and o != g]
        if rest:
            want[cell, g] = (statistics.median(rest), -statistics.median(rest))
    assert found == want


def test_the_next_level_is_tried_where_players_are_too_few(spark):
    # Account 1 plays hero 1; the rows of others at its narrowest levels come from two accounts only.
    rows = [(1, 1, 1, 10, "p")] * 3 + [(a, 1, 1, 10, "p") for a in (2, 3) for _ in range(15)]
    rows += [(a, 2, 1, 10, "q") for a in range(4, 10) for _ in range(4)] + [(20, None, None, None, None)]
    population = spark.createDataFrame(rows, "account_id long, hero_id int, role int, rank_tier int, patch string")
    targets = population.where("account_id in (1, 20)").distinct()
    got = {r.account_id: r for r in cohorts.select_narrowest(targets, population).collect()}
    assert (got[1].level_name, got[1].sample_size, got[1].distinct_players) == ("role_rank", 54, 8)
    assert (got[20].level_name, got[20].sample_size, got[20].distinct_players) == ("global", 57, 9)
    nobody = cohorts.select_narrowest(targets, population, minimum_rows=1000).collect()
    assert [(r.valid, r.suppression_reason) for r in nobody] == [(False, "NO_VALID_COHORT")] * 2
    assert cohorts.cohort_metrics(
        cohorts.select_narrowest(targets, population, 1000).withColumn("account_id", F.col("account_id")),
        population.withColumns({c: F.lit(1.0) for c in cohorts.METRICS.values()}).withColumn("won", F.lit(True)),
    ).count() == 0
