"""How often the wide rows of the detail path are shuffled, joined and gathered."""

import datetime

import pytest

from catalog import detail, pipeline
from catalog.load import load_all

load_all()


@pytest.fixture
def tables(spark, tmp_path):
    """Five orders with up to four lines, a line without an order and an order without a key."""
    lines = [
        (o, o % 3, o * 4 + i, i + 1, 100.0 * i, 3.0, 0.1) for o in range(5) for i in range(1 + o % 4)
    ] + [(99, 1, 1, 1, 5.0, 1.0, 0.0), (None, 1, 1, 1, 5.0, 1.0, 0.0)]
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_quantity double, "
        "l_discount double",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(o, "FO"[o % 2], datetime.date(2024, 1, 1 + o)) for o in range(5)] + [(None, "F", datetime.date(2024, 1, 9))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate date").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    spark.createDataFrame([(p, p % 9, f"b{p}") for p in range(24)], "p_partkey long, p_size int, p_brand string").write.parquet(
        str(tmp_path / "part.parquet")
    )
    return str(tmp_path)


def test_players_are_numbered_where_their_match_was_joined(spark, tables):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = detail.rows(spark, tables)
        # Lines and parts by part, then lines and orders by match; none for the window behind them.
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        got = sorted((r.match_id, r.player_no, r.duration_seconds, r.deaths, r.won) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == sorted(
        (o + 1, i + 1, 1200 + o * 37 % 2400, (o * 5 + i + 1) % 11, o % 2 == 0) for o in range(5) for i in range(1 + o % 4)
    )


def test_documents_are_built_once_for_participants_and_events(spark, tables):
    found = pipeline.agg_event_features(spark, tables)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 11
