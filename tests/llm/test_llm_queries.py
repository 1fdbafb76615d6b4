"""Registered queries against their SQL, and the pipeline against a brute-force version."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from habitscope.llm import language, mixing
from habitscope.llm.common import table
from habitscope.llm.queries import ORACLE, QUERIES
from tests.llm.test_groups import shingles, smallest_reachable
from tools.check import TABLES, rows_of


@pytest.fixture(scope="module")
def sql(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, folder, sql, name):
    frame = QUERIES[name](spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = sql.execute(ORACLE[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_all_operators_have_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


def test_pipeline(spark, folder):
    docs = table(spark, folder, "documents")
    told = language.identify(docs, language.fit(docs))
    rejected = {r.doc_id for r in told.where("rejected").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in rejected}
    assert len(rejected) <= 2
    last = {t: i for i, t in sorted(texts.items())}
    texts = {i: t for t, i in last.items()}
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    links = [
        (i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    names = smallest_reachable(sets, links)
    texts = {i: t for i, t in texts.items() if names[i] == i}
    sources = {r.doc_id: r.source for r in docs.collect()}
    left = spark.createDataFrame([(i, t, sources[i]) for i, t in texts.items()], "doc_id long, text string, source string")
    want = []
    for r in mixing.mix(left).where("taken > 0").collect():
        full, rest = divmod(r.taken, r["size"])
        want += [(r.doc_id, texts[r.doc_id])] * full
        if rest:
            text, at = texts[r.doc_id], 0
            for _ in range(rest):
                while text[at] in " \t\n\v\f\r":
                    at += 1
                while at < len(text) and text[at] not in " \t\n\v\f\r":
                    at += 1
            want.append((r.doc_id, text[:at]))
    got = corpus_pipeline.run(spark, folder).select("doc_id", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want)
