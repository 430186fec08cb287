"""Registered queries against their SQL, run by another engine on the same files."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from claimgraph.plans import all_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# One or two per area; ALL_QUERIES=1 runs every one.
CHOSEN = [
    "f09_citation_text", "f11_format_valid_time", "h01_fold_status", "h01b_raw_log_fold",
    "h02_current_confidence", "r05_network_counts", "r06_cap_edges", "r14_list_claims",
    "r16_coverage_by_source", "r22_find_paths", "n02_match_names", "n03_search_entities",
    "p05_entity_summary", "t02_stream_status",
    "a01_dispute", "a02_route_identity", "c05_confidence_histogram",
    "c16_multiplicity_profile", "m17_relationship_claims", "m18_anomaly_counters",
    "m23_letter_ties", "s01_read_delimited", "s03_read_letters", "s05_to_ndjson",
    "i07_import_entities", "i15_import_report",
    "x01_as_of", "x02_canonical_ids", "x04b_block_pairs", "x08b_monotone_map",
    "p08_refresh_entities", "t01_projection", "a05_supersede", "i06_split_rejects", "i09_version_records",
    "i11b_published_claims", "i16b_commit_log", "x06b_inferred_claims", "x02c_incremental_canonical",
    "h01c_status_from_snapshots", "r05b_counts_on_adjacency", "r22c_paths_on_adjacency", "n02b_match_on_kept_index",
    "m19b_whole_transform", "m25b_letter_transform", "m26b_letter_registries",
    "r08_ranked_ties", "s06_content_hash", "s08_manifest", "x06_split_candidates", "x07_er_quality",
]


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 6) + 0.0)
    return None if value is None else str(value)


def _rows(rows, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _names():
    return sorted(all_queries()[0]) if os.environ.get("ALL_QUERIES") else CHOSEN


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    text = entry.oracle_sql().get(name)
    if text is None:
        assert rows
        return
    found = sql.execute(text)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = _rows(found.fetchall(), [columns.index(c) for c in df.columns])
    assert _rows(rows, range(len(df.columns))) == expected


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
