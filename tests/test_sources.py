import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from meridianlake import catalogue
from meridianlake.sources import parsers as P
from meridianlake.sources import readers as R
from meridianlake.streaming import incremental as I


def test_formats():
    assert [s[1:3] for s in P.parse_one(b"# One\ntext\n### Two", "text/markdown")["sections"]] == [("One", 1), ("Two", 3)]
    page = P.parse_one(b"<html><head><title>T</title><script>x</script></head><body><h1>Head</h1><p>a  b</p><style>y</style></body></html>", "text/html; charset=utf-8")
    assert page["metadata"] == {"title": "T"} and page["sections"][0][1:3] == ("Head", 1) and "a b" in page["text"] and "y" not in page["text"]
    assert P.parse_one(b"name,age\nAlice,30\nBob,25\n", "text/csv")["text"] == "name: Alice | age: 30\nname: Bob | age: 25"
    assert P.parse_one(b"name;age\nAlice;30", "text/csv")["text"] == "name: Alice | age: 30"
    assert P.parse_one(b"a\tb\n1\t2", "text/tab-separated-values")["text"] == "a: 1 | b: 2"
    assert P.parse_one(json.dumps({"user": {"name": "Ada", "roles": ["admin", "dev"]}, "active": True, "x": None}).encode(), "application/json")["text"].split("\n") == ["user.name: Ada", "user.roles.0: admin", "user.roles.1: dev", "active: true", "x: null"]
    assert P.parse_one(b"<r><i>one</i> <i>two</i></r>", "application/xml")["text"] == "one two"


@pytest.mark.parametrize("data, mime", [(b"{bad", "application/json"), (b"<!DOCTYPE r><r/>", "application/xml"), ("<!DOCTYPE r><r/>".encode("utf-16"), "application/xml"), (b"<r>", "text/xml"), (b"x", "image/png"), (b"x", P.BY_EXTENSION["docx"])])
def test_errors(data, mime):
    assert P.parse_one(data, mime)["error"] and P.parse_one(data, mime)["text"] is None


def word_file(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def test_docx():
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">Body &amp; </w:t><w:t>more</w:t></w:r></w:p>'
    got = P.parse_one(word_file(body), P.BY_EXTENSION["docx"])
    assert got["text"] == "Head\nBody & more" and got["sections"][0][1] == "Head"
    began = time.time()
    P.parse_one(word_file("<w:p>" * 20_000), P.BY_EXTENSION["docx"])
    assert time.time() - began < 0.5


def test_columns(spark):
    rows = spark.createDataFrame([(b"a,b\n1,2", "text/csv"), (None, "text/csv"), (b"", "text/plain"), (b"{", "application/json")], "content binary, mime string")
    got = P.parse_documents(rows).select("parsed.text", "parsed.error").collect()
    assert got[0].text == "a: 1 | b: 2" and got[1].text is None and got[2].text == "" and got[3].error


@pytest.mark.parametrize("data, text", [("a<![<_%[<%b>c", "ac"), ("<p>a<![{{x]]>c", "ac"), ("a<![foo[b]]>c", "ac"), ("a<![CDATA[b>]]>c", "ac"), ("a<![b", "a<![b")])
def test_marked_sections_in_pages(data, text):
    assert P.parse_one(data, "text/html")["text"] == text


def test_no_document_ends_the_job(spark):
    long = b"x" * 200_000
    rows = [(b'<?xml version="1.0" encoding="none"?><a/>', "text/xml"), (b'<?xml version="1.0" encoding="shift_jis"?><a/>', "text/xml"), (b'"\\ud800"', "application/json"), (b"a,b\n1," + long, "text/csv"), (b"a<![%b>c", "text/html")]
    got = P.parse_documents(spark.createDataFrame(rows, "content binary, mime string").coalesce(1)).select("parsed.text", "parsed.error").collect()
    assert [bool(r.error) for r in got] == [True, True, True, False, False]
    assert [r.text for r in got[3:]] == ["a: 1 | b: " + long.decode(), "ac"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "b").write_text("<html></html>")
    assert {r.document_key: r.mime for r in R.files(spark, str(tmp_path)).collect()} == {"a.md": "text/markdown", "b": "text/html"}
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps([{"query": "q", "relevant": ["a", "b"]}, {"query": "r", "relevant_ids": "c"}]))
    assert sorted(sorted(r.relevant) for r in R.evaluation_cases(spark, str(cases)).collect()) == [["a", "b"], ["c"]]
    assert R.texts(spark, ["x"]).count() == 1


@pytest.mark.parametrize("url, safe", [("https://example.org/x", True), ("http://8.8.8.8/", True), ("http://10.0.0.1/", False), ("http://127.0.0.1", False), ("ftp://example.org", False), ("http://[::1]/", False), ("http://localhost/", False), (None, False), ("nonsense", False)])
def test_safe_url(url, safe):
    assert R.public_address(url) is safe


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, text string").withColumn("at", F.current_timestamp())
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = I.file_stream(spark, str(tmp_path / "in" / "*.parquet"))
    assert I.run_once(I.new_texts(stream, "text", "at"), "fresh", str(tmp_path / "state")).count() == 2


def test_stream_of_a_folder(spark, tmp_path):
    """A table is a file or a folder of files; its rows are streamed either way, also if none is left."""
    docs = catalogue.table(spark, "/root/testdata/sf0.001", "documents")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = docs.where("text is not null").select("text").distinct().count()
    assert catalogue.queries()["stream_dedup"](spark, str(tmp_path)).count() == want > 0
    docs.withColumn("text", F.lit(None).cast("string")).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert catalogue.queries()["stream_dedup"](spark, str(tmp_path / "none")).count() == 0
    table = catalogue.table(spark, "/root/testdata/sf0.001", "events")
    table.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    hours = catalogue.queries()["stream_usage_hourly"](spark, str(tmp_path)).agg(F.sum("records")).first()[0]
    assert hours == table.count()
