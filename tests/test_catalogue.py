"""Every core query with SQL gives the rows that DuckDB gives over the same tables."""

import os
import re

import duckdb
import pytest

from meridianlake import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return con


def plain(frame):
    columns = sorted(frame.columns)

    def key(v):
        return "" if v is None or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return columns, sorted(tuple(key(v) for v in row) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_every_document_is_parsed(spark):
    docs = catalogue.table(spark, DATA, "documents").select("doc_id", "mime", "text").distinct().collect()
    got = {r.doc_id: r for r in catalogue.queries()["parsed_documents"](spark, DATA).collect()}
    assert set(got) == {r.doc_id for r in docs}
    assert any(r.mime is None for r in docs) and any(r.mime == "application/pdf" for r in docs)
    for r in docs:
        if r.text is not None and r.mime is None:
            assert got[r.doc_id].error is None and got[r.doc_id].chars == len(r.text)
        if r.text is not None and r.mime == "application/pdf":
            assert got[r.doc_id].error == "no parser for application/pdf" and got[r.doc_id].chars is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["qid", "id", "score", "rank"]


def test_core_stands_without_the_training_data_package():
    root = os.path.dirname(catalogue.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"^\s*(from|import)\s.*\bllm\b", open(os.path.join(folder, f)).read(), re.M), f
