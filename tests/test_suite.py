"""A cross-section of the registered queries against their SQL twins at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as contract
import check

NAMES = ["s05_wide_to_long", "k04_idempotent_historian", "p02_canonical_clock", "j05_enrichment_chain", "j07_source_fallback",
         "w05_sequence_assignment", "w07_replay_schedule", "a03_dashboard", "u01_priority_union", "d02_excursion_board",
         "d12_commit_decision", "d13_audit_seals", "r04_cosine_search", "r05_chunker", "z04_stream_dedup",
         "s01_delimited_scan", "s04_header_detection", "s09_text_documents", "k01_bronze_landing", "k06_envelope_producer",
         "k13_append_turns", "p14_reading_id", "p18_zone", "p21_band_resolution", "p26_table_classifier", "p29_parameter_guess",
         "j02_batch_temporal_join", "j10_decompose_sql", "w02_keep_first_reading", "a02_status_counts", "a08_parse_report",
         "a15_retention", "a16_source_catalogue", "t04_newest_excursions", "t05_top_per_query", "d03_scenario_run",
         "d04_parameter_board", "d05_decompose_reading", "d09_agent_run", "d14_audit_verify", "r06_long_names", "r07_index_pipeline",
         "r11_answer_routing", "z02_stream_gold", "z05_stream_latest", "z07_stream_historian", "z08_paced_replay", "z09_stream_audit"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf, name):
    df = contract.queries()[name](spark, sf)
    cur = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cur.fetchall())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
