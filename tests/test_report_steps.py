"""Steps that elements and actions of a report share run once, on the columns they read."""

from datetime import datetime, timedelta

from catalog.base import QUERIES, WINDOW_END
from catalog.load import load_all
from conftest import table
from habitscope.functions.ordered import chunked, is_plain, marks
from habitscope.operators import elements
from habitscope.operators.baselines import with_function
from habitscope.operators.measures import match_measures
from habitscope.operators.sessions import sessions_of
from habitscope.plans import report
from habitscope.sources import views

load_all()


def events(spark, path):
    begin = datetime(2024, 1, 1)
    rows = [
        (i, begin + timedelta(hours=5 * (i // 6) + i % 6), i % 2, ("view", "click", "signup")[i % 3], 1.5 * (i % 70), f'{{"k": {i % 7}}}')
        for i in range(160)
    ]
    spark.createDataFrame(
        rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ).write.parquet(f"{path}/events.parquet")


def test_baselines_of_a_report_are_found_once(spark, tmp_path, monkeypatch):
    events(spark, tmp_path)
    found, given, copied = elements.leave_session_out, [], []
    monkeypatch.setattr(elements, "leave_session_out", lambda *a: given.append(a[0].columns) or found(*a))
    by_gap = report.by_gap
    monkeypatch.setattr(report, "by_gap", lambda base, gaps: copied.append(base.columns) or by_gap(base, gaps))
    assert QUERIES["out_elements"](spark, str(tmp_path)).count() == 36
    assert len(given) == 2  # in a session and after a loss
    assert not any({"kills", "deaths", "assists"} & set(columns) for columns in [*given, *copied])


def test_residuals_do_not_depend_on_chunks(spark, tmp_path):
    events(spark, tmp_path)
    matches = views.match_rows(spark, str(tmp_path))
    both = []
    for hot_rows in (None, 30):
        rows = with_function(match_measures(matches, 60, WINDOW_END, hot_rows=hot_rows), views.hero_traits(spark))
        sessions = sessions_of(rows, 60, WINDOW_END)
        curve, (lost, counted) = report.baselined(rows, sessions)
        assert is_plain(rows) == (hot_rows is None)
        both.append([table(curve), table(lost, "account_id", "match_id", "residual", "level"), table(counted)])
    assert both[0] == both[1] and all(both[0])


def test_marks_are_those_of_hot_keys(spark):
    frame = spark.range(20).selectExpr("id % 2 as k", "cast(id as double) as x")
    plain, hot = chunked(frame, ["k"], "x"), chunked(frame, ["k"], "x", 5)
    assert marks(frame) == [] and is_plain(plain.select("k", *marks(plain)))
    assert set(marks(hot)) == set(hot.columns) - {"k", "x"}
