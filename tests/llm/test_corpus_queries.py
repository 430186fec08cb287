"""The registered queries of the corpus operators against their SQL, and on whole small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from claimgraph.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = {
    "op1": "pages", "op3": "documents", "op5": "documents", "op6": "documents", "op7": "documents", "op9": "documents",
    "op10": "documents", "op11": "documents", "op12": "documents",
}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    table = TABLES.get(name.split("_")[0])
    if table:
        assert len(rows) == sql.execute(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if name in ORACLES:
        found = sql.execute(ORACLES[name])
        order = [[c[0] for c in found.description].index(c) for c in df.columns]
        expected = sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())
        assert sorted(tuple(map(str, r)) for r in rows) == expected
