"""Registered queries against their SQL on the smallest tables, and registry rules."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import plain
from snapledger.suite import load
from snapledger.suite.registry import TABLES

FAST = (
    "norm_text", "candidate_id", "source_url_valid", "platform_canonical", "snapshot_complete", "row_cap",
    "miss_counter", "reconcile", "company_status", "filter_postings", "dashboard", "mark_reviewed",
    "cascade_counts", "extract_links", "shape_job_criteria", "generic_eligible", "finish_status", "stream_status_feed",
)


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, small, con, name):
    frame = queries()[name](spark, small)
    cols = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in frame.collect()), key=repr)
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_registry():
    own, oracles = load()
    assert set(own) - set(oracles) == {"unique_cards"}
    assert not set(oracle_sql()) - set(queries())
    assert set(own) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and e.oracle_sql()"
    root = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
