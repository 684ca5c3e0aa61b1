"""Queries with SQL give the rows that DuckDB gives over the same tables; the others run over the small tables and give theirs."""

import os

import duckdb
import pytest

from meridianlake.llm import queries as Q
from tests.test_catalogue import DATA, plain


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    got, want = Q.queries()[name](spark, DATA).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    assert plain(got) == plain(want)


FOUND = {
    "p1_found": ["id", "seg", "lang"], "p2_found": ["id", "kind", "found"], "p3_found": ["probe_id", "id"], "p4_found": ["id", "field", "kind", "found"],
    "p5_found": ["id_a", "id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_queries_run_over_the_whole_tables(spark, name):
    out = Q.queries()[name](spark, DATA)
    assert out.count() > 0 and (name not in FOUND or out.columns == FOUND[name])
