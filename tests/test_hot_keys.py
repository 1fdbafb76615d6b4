"""Results must not change when accounts count as hot and are cut into chunks."""

from pyspark.sql import functions as F

from catalog.base import WINDOW_END
from conftest import table
from habitscope.functions.ordered import CHUNK, HOT, beside, chunked, scan, unchunked
from habitscope.functions.robust import leave_one_out, lower_weighted_median
from habitscope.operators import baselines, elements, measures, normalize, pools, sessions, windows
from habitscope.operators.cohorts import cohort_metrics, select_narrowest
from habitscope.operators.detectors import contenders
from habitscope.operators.insights import benjamini_hochberg
from habitscope.operators.matches import infer_roles
from habitscope.sources import views

HOT_ROWS = 7


def test_sessions_do_not_depend_on_chunks(spark, folder):
    rows = views.match_rows(spark, folder)
    for gap in (90, 720):
        plain = sessions.sessionize(rows, gap)
        hot = sessions.sessionize(rows, gap, hot_rows=HOT_ROWS)
        assert HOT in hot.columns and HOT not in plain.columns
        columns = ("account_id", "match_id", "rn", "n", "session_no", "session_index", "session_corrupt")
        assert table(plain, *columns) == table(hot, *columns)


def test_gap_copies_do_not_depend_on_chunks(spark, folder):
    rows = views.match_rows(spark, folder)
    columns = ("account_id", "gap", "match_id", "session_no")
    assert table(sessions.by_gap(rows), *columns) == table(sessions.by_gap(rows, hot_rows=HOT_ROWS), *columns)


def test_measures_and_transitions_do_not_depend_on_chunks(spark, folder):
    rows = views.match_rows(spark, folder)
    plain = sessions.transitions(measures.match_measures(rows, 1440, WINDOW_END))
    hot = sessions.transitions(measures.match_measures(rows, 1440, WINDOW_END, hot_rows=HOT_ROWS), HOT_ROWS)
    columns = (
        "account_id",
        "match_id",
        "performance",
        "weight",
        "session_no",
        "prev_won",
        "prev_performance",
        "valid_transition",
        "loss_streak",
    )
    assert table(plain, *columns) == table(hot, *columns)


def test_weighted_median_and_leave_one_out_do_not_depend_on_chunks(spark, folder):
    rows = measures.with_rates(sessions.with_recency(views.match_rows(spark, folder), WINDOW_END))
    keys = ["account_id"]
    assert table(lower_weighted_median(rows, keys, "activity", "weight")) == table(
        lower_weighted_median(rows, keys, "activity", "weight", hot_rows=HOT_ROWS)
    )
    columns = ("account_id", "match_id", "activity_centre", "activity_scale", "death_rate_centre", "death_rate_scale")
    values = ["activity", "death_rate"]
    assert table(leave_one_out(rows, keys, values), *columns) == table(
        leave_one_out(rows, keys, values, HOT_ROWS), *columns
    )


def test_baselines_do_not_depend_on_chunks(spark, folder):
    rows = baselines.with_function(
        measures.match_measures(views.match_rows(spark, folder), 720, WINDOW_END), views.hero_traits(spark)
    ).drop("_chunk")
    assert table(baselines.leave_session_out(rows, rows)) == table(
        baselines.leave_session_out(rows, rows, hot_rows=HOT_ROWS)
    )


def test_pools_and_windows_do_not_depend_on_chunks(spark, folder):
    rows = sessions.sessionize(views.match_rows(spark, folder), 1440).drop("_chunk")
    pool = table(pools.expanding_familiar(rows))
    assert pool == table(pools.expanding_familiar(rows, HOT_ROWS))
    assert pool == table(pools.expanding_familiar(rows, block_rows=3))
    columns = ("account_id", "match_id", "familiar", "method")
    assert table(pools.evaluation_groups(rows), *columns) == table(pools.evaluation_groups(rows, HOT_ROWS), *columns)
    assert table(windows.longest_streak(rows, "hero_id")) == table(windows.longest_streak(rows, "hero_id", HOT_ROWS))
    assert table(windows.quarter_recurrence(rows)) == table(windows.quarter_recurrence(rows, hot_rows=HOT_ROWS))
    legacy = rows.select("match_id", "account_id", "started_at", "duration_seconds")
    assert table(sessions.legacy_sessions(legacy)) == table(sessions.legacy_sessions(legacy, hot_rows=HOT_ROWS))


def test_cleaning_does_not_depend_on_chunks(spark, folder):
    raw = views.raw_rows(spark, folder)
    assert table(normalize.duplicate_conflicts(raw)) == table(normalize.duplicate_conflicts(raw, hot_rows=1))
    rows = views.match_rows(spark, folder)
    columns = ("account_id", "match_id")
    assert table(normalize.newest_per_account(rows, 25), *columns) == table(
        normalize.newest_per_account(rows, 25, HOT_ROWS), *columns
    )


def test_detail_path_does_not_depend_on_chunks(spark, folder):
    rows = views.detail_rows(spark, folder).withColumn("player_no", F.col("line_no") * 1000 + F.col("account_id"))
    columns = ("match_id", "player_no", "role", "economy_rank", "support_rank")
    plain, hot = infer_roles(rows, "player_no"), infer_roles(rows, "player_no", hot_rows=2)
    assert table(plain, *columns) == table(hot, *columns)
    from habitscope.operators.matches import match_features

    features = match_features(plain).withColumn("row_id", F.struct("match_id", "player_no"))
    newest = features.groupBy("account_id").agg(
        F.max(F.struct("match_id", "player_no", "hero_id", "role", "rank_tier", "patch")).alias("t")
    )
    chosen = select_narrowest(newest.select("account_id", "t.*"), features)
    assert table(cohort_metrics(chosen, features)) == table(cohort_metrics(chosen, features, hot_rows=20))


def test_adjusted_p_values_do_not_depend_on_chunks(spark, folder):
    rows = views.table(spark, folder, "part").select(
        F.col("p_brand").alias("family"), F.col("p_partkey").alias("key"), (F.col("p_size") / 100.0).alias("p")
    )
    assert table(benjamini_hochberg(rows, ("family",), "p", "key")) == table(
        benjamini_hochberg(rows, ("family",), "p", "key", hot_rows=3)
    )


def test_contenders_do_not_depend_on_chunks(spark):
    rows = spark.range(200).select(
        F.lit(1).cast("bigint").alias("account_id"),
        F.col("id").alias("match_id"),
        F.create_map(F.lit("h"), F.when(F.col("id") % 2 == 0, "positive").otherwise("control")).alias("evidence_roles"),
        ((F.col("id") * 37) % 101 / 101.0).alias("base_value"),
        F.lit(1.0).alias("detail_cost"),
    )
    columns = ("account_id", "match_id")
    assert table(contenders(rows, 5), *columns) == table(contenders(rows, 5, hot_rows=10), *columns)


def test_elements_run_on_a_chunked_table(spark, folder):
    rows = views.match_rows(spark, folder)
    plain = measures.match_measures(rows, 1440, WINDOW_END)
    hot = measures.match_measures(rows, 1440, WINDOW_END, hot_rows=20)
    for scorer in (
        elements.recent_form_shift,
        elements.post_loss_activity_shift,
        elements.post_loss_familiarity_shift,
        elements.hero_pool_stability,
        elements.off_pool_performance,
    ):
        assert table(scorer(plain), "account_id", "score", "sample_size") == table(
            scorer(hot), "account_id", "score", "sample_size"
        )


def test_one_cell_of_equal_values_is_cut(spark):
    """Half of a cell's values are equal, and its rows belong to many groups."""
    rows = spark.range(4000).selectExpr(
        "'all' as cell",
        "cast(if(id % 2 = 0, 0, id % 97 * exp(id % 13)) as double) as value",
        "cast(id as bigint) as tie",
        "id % 500 as group",
    )
    cut = chunked(rows, ["cell"], "value", 100, tie="tie")
    sizes = [r["count"] for r in cut.groupBy(CHUNK).count().collect()]
    assert max(sizes) <= 120 and sum(sizes) == 4000
    specs = {"_sum": ("sum", F.col("tie")), "_next": ("next", F.col("tie")), "_lag": ("lag", F.col("tie"))}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keys in (["cell"], ["cell", "group"]):
            hot = unchunked(scan(cut, keys, ["value", "tie"], specs))
            plain = unchunked(scan(chunked(rows, ["cell"], "value"), keys, ["value", "tie"], specs))
            assert "BroadcastHashJoin" not in hot._jdf.queryExecution().executedPlan().toString()
            assert table(hot, "tie", "group", "_sum", "_next", "_lag") == table(plain, "tie", "group", "_sum", "_next", "_lag")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_the_next_value_is_found_in_one_pass(spark):
    """A frame that ends at the last row is read anew for every row; of 60,000 rows that is two billion reads."""
    rows = spark.range(60_000).select(
        F.lit(1).alias("k"), "id", F.when(F.col("id") % 1000 == 999, F.col("id")).alias("v")
    )
    found = scan(chunked(rows, ["k"], "id"), ["k"], ["id"], {"next": ("next", F.col("v"))})
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("next <> id - id % 1000 + 999").count() == 0
    assert found.where("next is null").count() == 0


def test_rows_of_a_hot_key_are_not_brought_together_by_a_join(spark):
    """A join that shuffles by key would put all rows of a hot key in one task before they are cut."""
    rows = [("hot", float(i % 400), i) for i in range(900)] + [("cold", float(i), i) for i in range(20)]
    frame = spark.createDataFrame(rows, "k string, x double, t long")
    small = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, v long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut_up = chunked(frame, ["k"], "x", 50, tie="t")
        joined = beside(cut_up, small, ["k"])
        plan = cut_up._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert joined._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1  # the other keys
        assert sorted((r.k, r.x, r.t, r.v) for r in joined.collect()) == sorted(
            (k, x, t, 1 if k == "hot" else 2) for k, x, t in rows
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
