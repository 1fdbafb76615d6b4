"""Readers with explicit schemas and written tables."""

import json
import os

from pyspark.sql import functions as F

from habitscope.operators import knowledge, matches, normalize
from habitscope.sources import store


def test_history_is_read_as_text_and_typed_later(spark, tmp_path):
    rows = [
        {"account_id": 7, "source_index": 0, "match_id": "5", "start_time": 1_700_000_000, "duration": 1800, "hero_id": 3,
         "player_slot": 2, "radiant_win": True, "game_mode": 22, "lobby_type": 7, "kills": "x"},
        {"account_id": 7, "source_index": 1, "match_id": 6},
    ]
    (tmp_path / "h.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = normalize.normalize(normalize.deduplicate(store.read_history(spark, str(tmp_path / "h.json"))))
    by = {r["match_id"]: r for r in got.collect()}
    assert by[5]["won"] is True and by[5]["reasons"] == ["invalid_kills"]
    assert by[6]["reasons"][0] == "missing_start_time" and not by[6]["eligible"]


def test_detail_documents_give_participants_and_events(spark, tmp_path):
    document = {
        "match_id": 9, "duration": 2000, "radiant_win": True, "patch": "7",
        "players": [
            {"account_id": 1, "player_slot": 0, "hero_id": 4, "kills": 2, "item_0": 5, "item_1": 0,
             "kills_log": [{"time": 100, "unit": "two", "victim_account_id": 2}]},
            {"account_id": 2, "player_slot": 130, "hero_id": 6, "purchase_log": [{"time": 30, "item_id": 8}]},
        ],
    }
    (tmp_path / "d.json").write_text(json.dumps(document, indent=1))
    detail = store.read_detail(spark, str(tmp_path / "d.json"))
    people = {r["account_id"]: r for r in matches.participants(detail).collect()}
    assert people[1]["won"] and not people[2]["won"] and people[2]["kills"] == 0 and people[1]["item_ids"] == [5]
    events = {(r["account_id"], r["event_type"]) for r in matches.events(detail).collect()}
    assert events == {(1, "kill"), (2, "death"), (2, "purchase")}


def test_events_build_their_documents_once(spark):
    """Logs, kills and victims were read from documents that each of them built anew."""
    log = [(100, "two", 2, None), (200, None, None, None), None]
    rows = [
        (9, 1, log, None, None, None, [(5, None, None, 8)]),
        (9, 2, None, [(7, None, None, None)], [], [(50, None, None, None)], None),
        (9, 2, [(300, "two", 2, None)], None, [(60, None, None, None)], [(70, None, None, None)], None),
        (None, None, None, None, None, None, None),
    ]
    entry = matches.PLAYER["kills_log"].dataType.simpleString()
    names = ("kills_log", "buyback_log", "death_log", "deaths_log", "purchase_log")
    table = spark.createDataFrame(rows, f"match_id long, account_id long, {', '.join(f'{n} {entry}' for n in names)}")
    player = F.struct("account_id", *names)
    detail = table.groupBy("match_id").agg(F.array_sort(F.collect_list(player)).alias("players"))
    found = matches.events(detail)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.match_id, r.account_id, r.event_type, r.time_seconds, tuple(sorted(r.payload.items()))) for r in found.collect()]
    seen = (("killer_account_id", "1"), ("source", "opponent_kills_log"))
    other = (("killer_account_id", "2"), ("source", "opponent_kills_log"))
    want = [
        (9, 1, "kill", 100, (("victim", "two"),)),
        (9, 1, "kill", 200, (("victim", None),)),
        (9, 1, "kill", None, (("victim", None),)),
        (9, 1, "purchase", 5, (("item_id", "8"),)),
        (9, 2, "buyback", 7, ()),
        (9, 2, "death", 50, (("source", "death_log"),)),
        (9, 2, "kill", 300, (("victim", "two"),)),
        (9, 2, "death", 60, (("source", "death_log"),)),
        (9, 2, "death", 100, seen),  # one for each row of the victim
        (9, 2, "death", 100, seen),
        (9, 2, "death", 300, other),  # the killer's own row is left out
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_documents_are_parsed_once_under_a_filter(spark):
    lines = spark.createDataFrame([('{"match_id": 1, "players": []}',), ("x",), (None,), ("[]",)], "value string")
    usable = store.typed_documents(lines, matches.DETAIL, "match_id", ["players"]).where("usable")
    assert usable._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r.match_id for r in usable.collect()] == [1]


def test_written_lines_are_compressed_and_whole(spark, tmp_path):
    from catalog.pipeline import written_lines

    frame = spark.range(1, 4001).select(F.col("id").alias("match_id"), F.lit("the same words " * 20).alias("text"))
    path = written_lines(frame, "match_id", {})
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and sum(os.path.getsize(f"{path}/{f}") for f in files) < 200_000  # 1.3 MB of text
    assert spark.read.text(path).count() == 4000


def test_aggregate_files_carry_their_hero_in_the_path(spark, tmp_path):
    (tmp_path / "heroStats.json").write_text(json.dumps([{"id": 2, "1_pick": 4, "1_win": 1, "pub_pick": 4, "pub_win": 1}]))
    folder = tmp_path / "heroes" / "2"
    folder.mkdir(parents=True)
    (folder / "durations.json").write_text(json.dumps([{"duration_bin": 1800, "games_played": 4, "wins": 3}]))
    (folder / "matchups.json").write_text(json.dumps([{"hero_id": 5, "games_played": 2, "wins": 0}]))
    (folder / "itemPopularity.json").write_text(json.dumps({"start_game_items": {"44": 3, "45": 1}}))
    tables = store.read_aggregates(spark, str(tmp_path))
    brackets = knowledge.bracket_profile(tables["stats"]).where(F.col("bracket") == "rank_tier_1").first()
    assert (brackets["hero_id"], brackets["picks"], brackets["win_rate"]) == (2, 4, 0.25)
    assert knowledge.duration_profile(tables["durations"]).first()["win_rate"] == 0.75
    assert knowledge.matchup_profile(tables["matchups"]).first()["opponent_hero_id"] == 5
    items = {r["item_id"]: (r["phase"], r["share"]) for r in knowledge.item_profile(tables["items"]).collect()}
    assert items[44][1] == 0.75 and items[45][1] == 0.25


def test_roster_documents_are_normalised(spark, tmp_path):
    hero = {"id": 2, "name": "axe", "name_loc": "Axe", "primary_attr": 0, "complexity": 1, "role_levels": [0, 1, 0, 2],
            "abilities": [{"id": 1, "name": "call", "special_values": [{"name": "radius", "values_float": [315.0]}]}],
            "talents": [], "facets": [{"name": "one"}]}
    (tmp_path / "r.json").write_text(json.dumps(hero))
    row = knowledge.hero_mechanics(store.read_roster(spark, str(tmp_path / "r.json"))).first()
    assert row["roles"] == ["Support", "Disabler"] and row["primary_attribute"] == "strength"
    assert row["abilities"][0]["special_values"] == {"radius": [315.0]} and row["facets"] == ["one"]


def test_an_optional_source_never_fails(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"hero_id": 1, "a": 2}\n{"hero_id": 2}\nnot json\n')
    got = [r["status"] for r in store.read_optional(spark, str(tmp_path / "o.json"), "hero_id bigint, a bigint").collect()]
    assert sorted(got) == ["available", "invalid_schema", "partial"]


def test_a_partitioned_table_is_overwritten_by_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10).select(F.col("id"), (F.col("id") % 2).alias("part"))
    store.write_table(rows, path, "part", "id")
    store.write_table(rows.where("part = 1").withColumn("id", F.col("id") + 100), path, "part", "id")
    got = sorted(r["id"] for r in spark.read.parquet(path).collect())
    assert got == [0, 2, 4, 6, 8, 101, 103, 105, 107, 109]


def test_numbers_lose_their_fraction_and_texts_do_not(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"match_id": 7, "kills": 12.5, "deaths": 12.0, "assists": "12.5"}\n{"match_id": "8", "kills": null}\n')
    got = store.read_history(spark, str(tmp_path / "n.json")).orderBy("match_id").collect()
    assert [(r.match_id, r.kills, r.deaths, r.assists) for r in got] == [("7", "12", "12", "12.5"), ("8", None, None, None)]
    typed = spark.createDataFrame([(12.5, "12.5")], "kills double, deaths string")
    row = normalize.with_all_columns(typed).first()
    assert (row.kills, row.deaths) == ("12", "12.5")


def test_equal_rows_do_not_cancel_in_a_checksum(spark):
    from habitscope.operators.quality import manifest

    one, three = spark.range(2, 3), spark.createDataFrame([(2,), (2,), (2,)], "id long")
    sums = [r.checksum for r in manifest({"a": one, "b": three}, "1").collect()]
    assert sums[0] != sums[1]


def test_latest_payload_of_equal_times(spark):
    rows = [("e", "1", "b", 5), ("e", "1", "a", 5), ("e", "1", "c", 4)]
    frame = spark.createDataFrame(rows, "endpoint string, source_id string, payload_hash string, fetched_at long")
    assert store.latest_payload(frame, 6, 10).first().payload_hash == "b"


def test_broken_documents_stay_as_counted_rows(spark, tmp_path):
    lines = [
        '{"match_id": 1, "duration": 10, "players": [{"hero_id": 2, "kills": "x"}, {"hero_id": 3}], "extra": 1}',
        '{"match_id": 2, "players": []}',
        '{"match_id": 3}',
        '{"match_id": 4, "players": {"hero_id": 1}}',
        '{"match_id": "five", "players": []}',
        '{"players": []}',
        '{"match_id": 6, "players": [',
        "[1, 2]",
        "null",
        "7",
        "",
        "   ",
        '{"match_id": 8, "duration": 1.5, "players": []}',
    ]
    (tmp_path / "d.json").write_text("\n".join(lines) + "\n")
    got = store.read_documents(spark, str(tmp_path / "d.json"), matches.DETAIL, "match_id", ["players"])
    assert {r["match_id"]: (r["problem"], r["usable"]) for r in got.where("match_id is not null").collect()} == {
        1: ("wrong_type", True), 2: (None, True), 3: ("no_players", False), 4: ("no_players", False), 8: ("wrong_type", True),
    }
    ledger = {r["problem"]: r["documents"] for r in store.document_ledger(got).collect()}
    assert sum(ledger.values()) == len(lines)
    assert (ledger["blank"], ledger["not_json"], ledger["not_an_object"], ledger["no_match_id"]) == (2, 1, 3, 2)
    people = {r["hero_id"]: r["kills"] for r in matches.participants(got.where("usable")).collect()}
    assert people == {2: 0, 3: 0}
    nothing = store.typed_documents(spark.createDataFrame([], "value string"), matches.DETAIL, "match_id", ["players"])
    assert store.document_ledger(nothing).count() == 0
    void = store.typed_documents(spark.createDataFrame([(None,)], "value string"), matches.DETAIL, "match_id")
    assert void.first()["problem"] == "blank"


def test_a_table_that_was_cut_is_read_by_the_columns_in_use(spark):
    from habitscope.session import cut

    frame = spark.range(1000).select("id", F.lit("x").alias("text"), F.map_from_arrays(F.array("id"), F.array(F.lit(None).cast("string"))).alias("m"))
    written = cut(frame)
    assert [(f.name, f.dataType) for f in written.schema] == [(f.name, f.dataType) for f in frame.schema]
    plan = written.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    assert written.where("m[id] is null and text = 'x'").count() == 1000
    assert cut(frame.where("id < 0")).count() == 0
