"""Boundary cases as small tables."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import table
from habitscope.functions import expr
from habitscope.operators import elements, normalize, sessions, text
from habitscope.operators.patterns import session_curve_band

START = 1_700_000_000


def history(spark, *rows):
    """(match_id, start, duration) of one account."""
    return spark.createDataFrame(
        [(1, m, s, d, s + d if s is not None else None) for m, s, d in rows],
        "account_id bigint, match_id bigint, started_at bigint, duration_seconds bigint, ended_at bigint",
    )


def numbers(frame):
    return {r["match_id"]: (r["session_no"], r["session_index"], r["session_corrupt"]) for r in frame.collect()}


def test_gap_of_exactly_ninety_minutes_stays(spark):
    edge = START + 1800 + 90 * 60
    got = numbers(sessions.sessionize(history(spark, (1, START, 1800), (2, edge, 1800), (3, edge + 1800 + 5401, 900))))
    assert got == {1: (1, 1, False), 2: (1, 2, False), 3: (2, 1, False)}


def test_overlap_beyond_tolerance_marks_both_neighbours(spark):
    got = numbers(sessions.sessionize(history(spark, (1, START, 1800), (2, START + 1499, 900), (3, START + 2600, 900))))
    assert got == {1: (1, 1, True), 2: (2, 1, True), 3: (2, 2, False)}
    mild = numbers(sessions.sessionize(history(spark, (1, START, 1800), (2, START + 1500, 900))))
    assert mild == {1: (1, 1, False), 2: (1, 2, False)}


def test_the_previous_row_counts_and_not_the_latest_end(spark):
    rows = history(spark, (1, START, 20_000), (2, START + 19_900, 60), (3, START + 26_000, 60))
    assert numbers(sessions.sessionize(rows))[3][0] == 2


def test_undated_rows_are_left_out(spark):
    assert set(numbers(sessions.sessionize(history(spark, (1, START, 60), (2, None, 60))))) == {1}


def test_censoring_needs_observed_inactivity(spark):
    rows = sessions.sessionize(history(spark, (1, START, 1800), (2, START + 50_000, 1800)))
    end = START + 51_800
    by = lambda frame: {r["session_no"]: (r["left_censored"], r["right_censored"]) for r in frame.collect()}
    assert by(sessions.sessions_of(rows, 90, end + 5400)) == {1: (True, False), 2: (False, True)}
    assert by(sessions.sessions_of(rows, 90, end + 5401)) == {1: (True, False), 2: (False, False)}
    assert by(sessions.sessions_of(rows, 90, None, anchored=True)) == {1: (False, False), 2: (False, True)}


def test_results_do_not_depend_on_input_order(spark, folder):
    from habitscope.sources import views

    rows = views.match_rows(spark, folder)
    mixed = rows.orderBy(F.rand(3)).repartition(7)
    columns = ("account_id", "match_id", "session_no", "session_index")
    assert table(sessions.sessionize(rows), *columns) == table(sessions.sessionize(mixed), *columns)


@pytest.mark.parametrize(
    "score,zone", [(0.199999, 0), (0.20, 1), (0.399999, 1), (0.40, 2), (0.599999, 2), (0.60, 3), (0.80, 4), (1.0, 4)]
)
def test_zone_cuts_are_half_open(spark, score, zone):
    assert spark.range(1).select(expr.zone_index(F.lit(score)).alias("z")).first()["z"] == zone


def curve(spark, values, counts, direction):
    points = F.array(
        *[
            F.struct(F.lit(b).alias("bucket"), F.lit(float(v)).alias("value"), F.lit(c).alias("sessions"))
            for b, v, c in zip(("G1", "G2", "G3", "G4", "G5+"), values, counts)
        ]
    )
    row = spark.range(1).select(elements.breakpoint_of(points, F.lit(direction)).alias("b")).first()["b"]
    return row["state"], row["bucket"]


def test_breakpoint_must_persist(spark):
    assert curve(spark, (0, 0.01, 0.10, 0.12, 0.09), [9] * 5, "rise") == ("stable_breakpoint", "G3")
    assert curve(spark, (0, 0.09, 0.02, 0.03, 0.05), [9] * 5, "rise") == ("gradual", None)
    assert curve(spark, (0, 0.09, -0.02, 0.03, 0.05), [9] * 5, "rise") == ("unresolved", None)
    assert curve(spark, (0, -0.1, -0.1, -0.2, -0.3), [9, 9, 9, 9, 7], "fade") == ("stable_breakpoint", "G2")
    assert curve(spark, (0.2, 0.2, 0.2, 0.2, 0.2), [9, 7, 7, 7, 7], "rise") == ("unresolved", None)


def test_window_edges_are_inclusive(spark):
    start, end = normalize.history_window(START, 1)
    rows = history(spark, (1, start, 1), (2, start - 1, 1), (3, end, 1), (4, end + 1, 1), (5, None, 1))
    assert {r["match_id"] for r in normalize.within_window(rows, start, end).collect()} == {1, 3}


def test_wilson_interval_and_p_value(spark):
    low, high = expr.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 1.0)
    got = spark.range(1).select(*[expr.normal_two_sided_p(F.lit(z)) for z in (0.0, 1.0, 1.96, 3.0)]).first()
    for value, z in zip(got, (0.0, 1.0, 1.96, 3.0)):
        assert abs(value - (1 - math.erf(z / math.sqrt(2)))) < 2e-7


def test_curve_bands_have_their_edges(spark):
    values = (-0.20, -0.06, -0.05, 0.05, 0.06)
    fade = [session_curve_band(F.lit(v), F.lit("fade")) for v in values]
    assert list(spark.range(1).select(*fade).first()) == [
        "lowest_point",
        "below_usual",
        "about_usual",
        "about_usual",
        "above_usual",
    ]


def test_coercions(spark):
    rows = spark.createDataFrame([("12.5", "-3", "yes"), ("7", "4", "1"), (None, "x", "false")], "a string, b string, c string")
    got = rows.select(
        normalize.as_int(F.col("a")), normalize.as_count(F.col("b")), normalize.as_bool(F.col("c"))
    ).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (7, 4, True), (None, None, False)]


def test_pages_become_articles(spark):
    html = (
        "<html><head><title>Tab | News</title><meta property='og:title' content='Big day - News'>"
        "<meta name='date' content='March 5, 2024'></head><body><nav><p>menu</p></nav>"
        "<article><h1>Big day</h1><p>First <b>words</b> of a page<p>More words here<ul><li>one</li></ul>"
        "<script>skip()</script><blockquote>said</blockquote></article><p>outside</p></body></html>"
    )
    pages = spark.createDataFrame(
        [(1, "HTTP://News.Example.org/en/42/?a=1#top", html), (2, "http://x.org/1", "<p>tiny</p>")],
        "page_id bigint, url string, html string",
    )
    done, rejected = text.articles(text.extract(pages))
    row = done.first()
    assert (row["title"], row["date"], row["article_id"]) == ("Big day", "2024-03-05", "42")
    assert row["body"] == "First words of a page\n\nMore words here\n\n- one\n\n> said"
    assert row["filename"] == "2024-03-05__big-day__42.md"
    assert [r["page_id"] for r in rejected.collect()] == [2]
    document = text.documents(done).first()["text"]
    assert document.startswith('---\ntitle: "Big day"\ndate: "2024-03-05"\n')


def test_additions_fill_each_account_s_own_gap(spark, folder):
    """One pass with a family for each account gives what one pass for each family gives."""
    from pyspark.sql import functions as F

    from habitscope.operators import actions, portfolio
    from habitscope.sources import views

    rows = views.match_rows(spark, folder).where("hero_id <= 4")  # a narrow pool leaves jobs open
    known = views.hero_knowledge(views.hero_traits(spark, 127))
    core = rows.select("account_id").distinct().select(
        "account_id",
        F.lit(True).alias("qualified"),
        F.when(F.col("account_id") % 3 == 0, "engage_control").when(F.col("account_id") % 3 == 1, "map_objectives").alias("primary_gap"),
    )
    got = actions.versatile_additions(rows, core, known)
    want = None
    for family in ("engage_control", "map_objectives"):
        mine = rows.join(core.where(F.col("primary_gap") == family).select("account_id"), "account_id", "left_semi")
        one = portfolio.recommend(portfolio.rationales(mine, known, "fill_gap", F.lit(family))).withColumn("family", F.lit(family))
        want = one if want is None else want.unionByName(one)
    rows_of = lambda df: sorted(tuple(r) for r in df.select("account_id", "rank", "hero_id", "family").collect())
    assert rows_of(got) == rows_of(want) and rows_of(got)
