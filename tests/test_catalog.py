"""Registered queries against their SQL on the smallest folder, one of each kind; verify.py runs all."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
from verify import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "run_all_results", "check_state_chain_since", "chain_heads_moved", "allocate_small_segments", "command_results", "repair_chain_outcomes", "persist_classify",
    "failure_retry_compensations", "report_issuance_log", "stream_failure_windows", "campaign_close_drained", "series_relay", "fn_mask_documents",
]


def test_every_statement_belongs_to_a_query():
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.queries()[name](spark, SMALL)
    got, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(registry.oracle_sql()[name])
    want, names = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert columns == names and got == want
