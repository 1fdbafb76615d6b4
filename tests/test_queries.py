"""Registered queries against DuckDB on the smallest tables, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

FAST = (
    "ses_sessionize",
    "ses_session_table",
    "rec_weights",
    "agg_leave_one_out",
    "agg_diversity",
    "agg_feature_set",
    "agg_feature_members",
    "src_match_documents",
    "src_match_ledger",
    "src_roster_documents",
    "knw_evidence",
    "knw_demands",
    "agg_familiar_strict",
    "agg_infer_roles",
    "agg_by_dimensions",
    "elm_envelope",
    "elm_finisher_orientation",
    "elm_session_length_tendency",
    "elm_toolkit_breadth",
    "join_leave_session_out",
    "join_cohort_selection",
    "nrm_normalize",
    "nrm_exclusion_ledger",
    "pat_evaluate",
    "pat_pattern_highlights",
    "det_patterns",
    "her_eligibility",
    "act_core_heroes",
    "act_presence_contexts",
    "knw_mechanics_tags",
    "txt_article_urls",
    "txt_articles",
    "txt_rejected",
    "txt_written",
    "snk_partitions",
    "snk_new_payloads",
    "snk_latest_payload",
    "snk_purge_counts",
    "snk_history_hash",
    "dq_manifest",
    "src_trait_load",
    "ins_replay_gates",
    "join_cohort_metrics",
    "sel_plan",
    "sel_state",
    "dep_evaluate",
)


@pytest.fixture(scope="module")
def sql(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, folder, sql, name):
    frame = QUERIES[name](spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = sql.execute(ORACLE[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_returns_every_account(spark):
    assert entry.entry(spark).count() == 15


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
