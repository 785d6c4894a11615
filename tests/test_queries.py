"""Registered queries against their checking SQL at the smallest scale.

The default run takes a spread of cheap queries; TRIAGE_ALL=1 runs every one.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import canonical
from triagelake.sources.driver_views import BASE_TABLES

SF = "/root/testdata/sf0.001"
DEFAULT = ("P02_normalise_text", "P09_scanners", "P29_vocabulary_coercion", "A02_global_engagement", "J06_sender_burst", "J08_group_context",
           "R04_evidence", "R08_rule_router", "V05_validation_result", "A12_reliability", "X03_connected_components", "V06_output_contract", "R17_incremental_run")
CHECKS = entry.oracle_sql()
NAMES = sorted(CHECKS) if os.environ.get("TRIAGE_ALL") else DEFAULT
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    frame = entry.queries()[name](spark, SF)
    result = sql.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical(names, result.fetchall())


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["message_id", "action", "message_type", "rule"]
