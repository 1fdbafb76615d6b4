"""The selection of a deep report runs once, whatever reads it."""

from datetime import datetime, timedelta

from catalog.base import QUERIES
from catalog.load import load_all

load_all()


def test_the_selection_is_written_once(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    events = [
        (i, begin + timedelta(hours=3 * i), i % 2, ("view", "click", "signup")[i % 3], 1.5 * (i % 70), f'{{"k": {i % 7}}}')
        for i in range(120)
    ]
    spark.createDataFrame(
        events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ).write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["out_deep_report"](spark, str(tmp_path))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 2
