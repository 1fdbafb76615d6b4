"""Targets that are marked among the candidates get what targets given as a table get, in one shuffle."""

from conftest import table
from habitscope.functions.ordered import CHUNK
from habitscope.functions.robust import leave_one_out
from habitscope.operators.baselines import leave_session_out
from pyspark.sql import functions as F

SCHEMA = (
    "account_id bigint, hero_id bigint, role_hint string, function string, match_id bigint, session_no bigint, "
    "performance double, weight double"
)


def history():
    """Three accounts; some places, sessions and accounts are missing, and some matches come twice."""
    rows = []
    for account in (1, 2, 3):
        for i in range(60 if account < 3 else 7):
            hero = None if i % 11 == 0 else 9 if i in (20, 41) else (i * account) % 3
            role = None if i % 7 == 0 else ("carry", "mid")[i % 2]
            function = None if i % 5 == 0 or hero is None else ("push", "save", "push")[hero % 7]
            session = None if i % 13 == 0 else i // (2 + account)
            performance = ((i * 37 + account) % 10) / 10
            rows.append((account, hero, role, function, account * 100 + i, session, performance, 1.0 / (1 + i % 9)))
    again = [(*r[:5], r[5] and r[5] + 1, *r[6:]) for r in rows if r[4] % 19 == 0]
    nobody = [(None, 1, "mid", "push", 900 + i, i, 0.5, 1.0) for i in range(5)]
    return rows + rows[::10] + again + nobody


def answers(df):
    return sorted(
        (r.account_id, r.match_id, r.baseline, r.level, r.reference_rows, round(r.effective_rows, 9))
        for r in df.collect()
    )


def test_marked_targets_are_answered_in_place(spark):
    rows = spark.createDataFrame(history(), SCHEMA)
    marked = F.when(F.col("match_id") % 9 != 0, F.col("match_id") % 4 != 0)
    found = leave_session_out(rows.withColumn(CHUNK, F.lit(0).cast("bigint")), marked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan
    assert plan.count("Sort [") <= 11
    expected = answers(leave_session_out(rows, rows.where(marked)))
    assert expected
    assert {level for _, _, _, level, _, _ in expected} == {
        "hero_role_function",
        "hero_function",
        "function",
        "role",
        "overall",
    }
    assert answers(found) == expected


def test_few_rows_have_no_baseline(spark):
    rows = spark.createDataFrame([(1, 1, "mid", "push", i, i, 0.1 * i, 1.0) for i in range(3)], SCHEMA)
    plain = rows.withColumn(CHUNK, F.lit(0).cast("bigint"))
    assert leave_session_out(plain, F.lit(True)).count() == 0
    assert leave_session_out(plain, F.lit(True), minimum=2).count() == 3


def test_listed_statistics_are_the_ranked_ones(spark):
    values = {1: [0.3], 2: [0.1, 0.4], 3: [0.2, 0.2, 0.9], 4: [None, None], 5: [0.5, None, 0.1, 0.7, 0.7, -0.0, 0.2]}
    rows = spark.createDataFrame(
        [(a, i, x) for a, listed in values.items() for i, x in enumerate(listed)] + [(None, 9, 0.5)],
        "account_id bigint, match_id bigint, x double",
    )
    plain = leave_one_out(rows.withColumn(CHUNK, F.lit(0).cast("bigint")), ["account_id"], ["x"])
    assert table(plain.drop(CHUNK)) == table(leave_one_out(rows, ["account_id"], ["x"]))
    # The values are grouped once and meet their rows once.
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
