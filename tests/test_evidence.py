"""References behind mechanics bands and demands, from hero documents to rows."""

import json

from habitscope.operators import knowledge as K
from habitscope.sources import store

BASE = "hero_id bigint, max_health double, armor double, complexity int"


def rows(frame, hero):
    return {(r["kind"], r["characteristic"], r["band"], r["ref"]) for r in frame.collect() if r["hero_id"] == hero}


def test_every_band_names_what_it_follows_from(spark):
    texts = spark.createDataFrame(
        [
            (1, "ability:a", "Stuns and deals 50 damage in a radius", False),
            (1, "ability:b", "burns the ground nearby", True),
            (2, "ability:c", "An illusion blinks away", False),
            (3, "ability:d", "nothing to see", None),
            (4, "ability:e", None, None),
        ],
        "hero_id bigint, ref string, text string, damages boolean",
    )
    base = spark.createDataFrame(
        [(1, 700.0, 3.0, 1), (2, 500.0, 9.0, 3), (3, None, None, 3), (4, None, None, None), (5, 600.0, 2.9, None)], BASE
    )
    tagged = K.tags(texts)
    got = K.evidence(tagged.unionByName(tagged), base, texts)  # repeated tag rows count once
    one = rows(got, 1)
    assert {r[3] for r in one if r[1] == "frontline"} == {"ability:a", "base_stats:armor", "base_stats:max_health"}
    assert {r[2:] for r in one if r[1] == "wave_clear"} == {("high", "ability:a"), ("high", "ability:b")}
    assert {r[2:] for r in one if r[1] == "pickoff"} == {("high", "ability:a")}  # burst goes before the burning
    assert ("capability", "sustained_damage", "medium", "ability:b") in one
    assert {r[3] for r in one if r[:2] == ("demand", "exposure")} == {"ability:a", *K.STURDY_REFS}
    two = rows(got, 2)
    assert ("capability", "execution", "high", K.COMPLEX_REF) in two
    assert ("demand", "execution", "high", "ability:c") in two and ("demand", "execution", "high", K.COMPLEX_REF) not in two
    assert {r[2] for r in two if r[1] in ("access", "repositioning")} == {"medium"}
    assert rows(got, 3) == {
        ("capability", "execution", "high", K.COMPLEX_REF),
        ("demand", "execution", "high", K.COMPLEX_REF),
        ("demand", "access", "high", K.IMMOBILE_REF),
    }
    assert rows(got, 4) == {("demand", "access", "high", K.IMMOBILE_REF)}
    assert rows(got, 5) == set()
    # Bands agree with those of the capabilities.
    bands = {(r["hero_id"], r["characteristic"], r["band"]) for r in K.capabilities(tagged, base).collect()}
    assert bands == {(r["hero_id"], r["characteristic"], r["band"]) for r in got.collect() if r["kind"] == "capability"}
    counts = {(r["hero_id"], r["demand"]): r["reference_count"] for r in K.demands(got).collect()}
    assert counts[1, "exposure"] == 3 and counts[3, "access"] == 1


def test_abilities_of_documents_are_references(spark, tmp_path):
    hero = {"id": 2, "name": "axe", "abilities": [{"id": 1, "name": "call", "desc_loc": "Taunts all"}, {"id": 9, "name_loc": "Leap"}]}
    (tmp_path / "r.json").write_text(json.dumps(hero))
    texts = K.ability_rows(K.hero_mechanics(store.read_roster(spark, str(tmp_path / "r.json"))))
    assert sorted((r["ref"], r["text"]) for r in texts.collect()) == [("ability:9", "Leap"), ("ability:call", "call Taunts all")]
    shown = {(r["ref"], r["characteristic"]) for r in K.tags(texts).collect()}
    assert shown == {("ability:9", "mobility"), ("ability:call", "initiation"), ("ability:call", "catch")}


def test_no_abilities_no_evidence(spark):
    texts = spark.createDataFrame([], "hero_id bigint, ref string, text string")
    assert K.evidence(K.tags(texts), spark.createDataFrame([], BASE), texts).count() == 0
