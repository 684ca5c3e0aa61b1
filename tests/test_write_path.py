import json

import pytest
from pyspark.sql import functions as F

from meridianlake import commands
from meridianlake.operators import security as SEC
from meridianlake.operators import store as ST
from meridianlake.plans import models as M
from meridianlake.plans import pipeline as PL
from meridianlake.sources import parsers as P
from meridianlake.sources import readers as R
from meridianlake.sources import sinks as K

# --- keys --------------------------------------------------------------------------------------------------------------------


def keys_of(*tenants):
    keys = SEC.Keys(SEC.MemoryStore())
    for t in tenants:
        keys.create(t)
    return keys


def secret(spark):
    return spark.createDataFrame([("a", "x", "same"), ("b", "x", "same"), ("c", "y", "größer"), ("d", "y", None)], "id string, tenant_id string, content string")


def test_envelope(spark):
    keys = keys_of("x", "y")
    sealed = SEC.seal(secret(spark), keys.table(spark)).cache()
    rows = {r.id: r for r in sealed.collect()}
    assert rows["a"].payload != rows["b"].payload and rows["a"].wrapped_key != rows["b"].wrapped_key and rows["d"].payload is None
    assert {r.id: r.content for r in SEC.unseal(sealed, keys.table(spark)).collect()} == {"a": "same", "b": "same", "c": "größer", "d": None}
    swapped = sealed.withColumn("wrapped_key", F.when(F.col("id") == "a", F.lit(rows["b"].wrapped_key)).otherwise(F.col("wrapped_key")))
    assert {r.id: r.content for r in SEC.unseal(swapped, keys.table(spark)).collect()}["a"] is None
    with pytest.raises(Exception, match="no key"):
        SEC.seal(secret(spark), keys_of("x").table(spark)).collect()
    with pytest.raises(Exception, match="another tenant"):
        SEC.unseal(sealed, keys.table(spark), "x").collect()
    ref = sealed.select("id", SEC.stored_text(F.col("payload"), F.lit(None), F.lit("opened")).alias("t")).collect()
    assert {r.id: r.t for r in ref}["d"] == ""


def test_rotation_and_destruction(spark):
    keys = keys_of("x", "y")
    sealed = SEC.seal(secret(spark), keys.table(spark)).cache()
    sealed.count()
    assert keys.rotate("x") == 2
    keys.destroy("y")
    good, failed = SEC.rewrap(sealed, keys.table(spark))
    assert {r.id: r.key_version for r in good.collect()} == {"a": 2, "b": 2} and {r.id for r in failed.collect()} == {"c", "d"}
    newest = keys.table(spark).where("version = 2")
    assert {r.content for r in SEC.unseal(good, newest).collect()} == {"same"}
    assert {r.content for r in SEC.unseal(sealed, newest).collect()} == {None}


@pytest.mark.parametrize("master", [None, "secret"])
def test_key_file(spark, tmp_path, master):
    at = str(tmp_path / "keys")
    keys = SEC.Keys(SEC.FileStore(spark, at, master))
    keys.create("x")
    keys.create("x")
    assert len(SEC.FileStore(spark, at, master).load()["x"]) == 1 and (tmp_path / "keys").stat().st_mode & 0o77 == 0
    if master:
        with pytest.raises(ValueError):
            SEC.FileStore(spark, at, "other").load()
    keys.destroy("x")
    assert not keys.exists("x")


def test_tenants(spark):
    t = SEC.Tenants("a")
    assert t.current() == "a" and t.run_as("b", t.current) == "b" and t.current() == "a"
    with pytest.raises(ZeroDivisionError):
        with t.as_tenant("c"):
            1 / 0
    assert t.current() == "a"
    strict = SEC.Tenants("a", strict=True)
    with pytest.raises(SEC.NoTenant):
        strict.current()
    strict.set("b")
    assert strict.only(spark.createDataFrame([("a",), ("b",)], "tenant_id string")).count() == 1
    strict.forget()
    with pytest.raises(SEC.NoTenant):
        strict.current()
    with pytest.raises(ValueError):
        SEC.Tenants(isolation="database")


def test_shredding(spark):
    keys = keys_of("x", "y")
    out = SEC.shred_tenants({"documents": secret(spark)}, spark.createDataFrame([("x",), ("x",)], "tenant_id string"), keys, "asked")
    assert {r.tenant_id for r in out["documents"].collect()} == {"y"} and not keys.exists("x") and keys.exists("y")
    assert [r.tenant_id for r in out["shredded"].collect()] == ["x"] and json.loads(out["audit"].first()["context"]) == {"reason": "asked"}
    assert ST.not_shredded(secret(spark), out["shredded"]).count() == 2
    with pytest.raises(Exception, match="shredded: x"):
        ST.assert_not_shredded(secret(spark), out["shredded"]).collect()


# --- store -------------------------------------------------------------------------------------------------------------------


def test_upsert_takes_the_last_change(spark):
    schema = "namespace string, id string, v array<double>, seq int"
    old = spark.createDataFrame([("n", "a", [0.0])], "namespace string, id string, v array<double>")
    changes = spark.createDataFrame([("n", "a", [1.0], 1), ("n", "a", [3.0], 3), ("n", "a", [2.0], 2), ("n", "b", [5.0], 1), ("n", "b", [5.0], 1)], schema)
    assert sorted((r.id, r.v) for r in ST.upsert(old, changes, 1).collect()) == [("a", [3.0]), ("b", [5.0])]
    assert ST.upsert(old, changes.drop("seq"), 1).count() == 2


def test_audit_covers_actor_target_and_context(spark):
    events = spark.createDataFrame([("t", "made", "2025-01-01", 1, "me", "doc", '{"a":1}'), ("t", "read", "2025-01-02", 2, None, None, None)], "tenant_id string, action string, created string, id int, actor string, target string, context string")
    chain = ST.audit_chain(events).cache()
    ok = lambda rows: ST.audit_verify(rows, ST.anchors(chain)).first()["valid"]
    assert ok(chain)
    for column in ("actor", "target", "context"):
        assert not ok(chain.withColumn(column, F.when(F.col("seq") == 1, F.lit("other")).otherwise(F.col(column))))
    assert not ok(chain.where("seq = 1")) and not ok(chain.where("seq = 2"))


def test_usage_rows(spark):
    calls = spark.createDataFrame([("a", 5, 0.0), ("b", 0, 0.0), ("c", None, 0.5), ("d", None, None)], "tenant_id string, tokens long, cost double").withColumn("currency", F.lit("USD")).withColumn("at", F.lit("2025-03-04").cast("timestamp"))
    assert {(r.tenant_id, r.period) for r in ST.usage_rows(calls, "embedding").collect()} == {("a", "2025-03"), ("c", "2025-03")}


# --- pipeline ----------------------------------------------------------------------------------------------------------------


def sources(spark):
    rows = [("1", "a", b"# Title\n\nThe first text. Write to me@mail.example now.", "text/markdown", {"title": "t", "provenance": "p"}), ("2", "a", b"<html>", "application/pdf", {}), ("3", "b", "Zweiter Text und der ist nicht lang.".encode(), "text/plain", None), ("4", "b", b"", "text/plain", {}), ("5", "gone", b"text", "text/plain", {})]
    return spark.createDataFrame([(*r, "2025-01-01") for r in rows], "document_id string, tenant_id string, content binary, mime string, metadata map<string, string>, at string")


def test_pipeline(spark, tmp_path):
    gone = spark.createDataFrame([("gone",)], "tenant_id string")
    out = PL.index_documents(sources(spark), size=40, overlap=0, shredded=gone, cost_per_1000=1.0)
    states = {r.document_id: r for r in out.documents.collect()}
    assert {k: r.status for k, r in states.items()} == {"1": "indexed", "2": "failed", "3": "indexed", "4": "indexed"} and states["2"].error == "no parser for application/pdf" and states["3"].language == "de"
    chunks = out.chunks.collect()
    mine = sorted((r for r in chunks if r.document_id == "1"), key=lambda r: r.idx)
    assert " ".join(r.content for r in mine).count("[EMAIL]") == 1 and all(len(r.v) == 8 and r.token_count > 0 for r in mine)
    assert mine[0].metadata == {"title": "t", "chunk_index": "0", "offset": "0"} and not [r for r in chunks if r.document_id in ("2", "4", "5")]
    assert {r.tenant_id: r.tokens > 0 and r.cost > 0 for r in out.usage.collect()} == {"a": True, "b": True}
    again = PL.index_documents(sources(spark), size=40, overlap=0, shredded=gone, cache=out.cache)
    assert again.usage.count() == 0 and again.chunks.where("v is null").count() == 0
    at = str(tmp_path / "chunks")
    K.write_generation(K.replace_documents(spark, at, out.chunks), at, 1)
    assert K.read_current(spark, at).count() == len(chunks)


def test_parents_have_no_vector(spark):
    out = PL.index_documents(sources(spark).where("document_id = '1'"), strategy="parent_child", size=20, overlap=0).chunks
    assert out.where("is_parent and v is not null").count() == 0 and out.where("not is_parent and (v is null or parent_chunk_id is null)").count() == 0
    ids = {r.id for r in out.where("is_parent").collect()}
    assert ids and {r.parent_chunk_id for r in out.where("not is_parent").collect()} <= ids


def test_stages(spark):
    stages = PL.default_stages().pipe("upper", lambda d: d.withColumn("text", F.upper("text")))
    assert stages.names() == ["clean", "language", "redact", "upper"] and PL.default_stages(False).names() == ["clean", "language"]


def test_redaction_of_sections_and_metadata(spark):
    schema = "text string, sections array<struct<type: string, content: string>>, metadata map<string, string>"
    rows = [("a@b.example", [("p", "see a@b.example"), ("p", None)], {"contact": "c@d.example", "n": "1", "x": None}), (None, None, None), ("plain", [], {})]
    got = PL.redacted(spark.createDataFrame(rows, schema)).collect()
    assert got[0].text == "[EMAIL]" and [s.content for s in got[0].sections] == ["see [EMAIL]", None] and got[0].metadata == {"contact": "[EMAIL]", "n": "1", "x": None}
    assert got[0].pii_redactions == {"email": 3} and (got[1].text, got[1].sections, got[1].metadata) == (None, None, None) and (got[2].text, got[2].sections, got[2].metadata) == ("plain", [], {})


# --- models ------------------------------------------------------------------------------------------------------------------


def family(spark):
    rows = spark.createDataFrame([(1, "one", 2), (2, "two", 3), (3, "three", 1), (4, " ", None)], "id int, name string, next int")
    plain = M.Definition("n", rows, "id").text(F.col("name"))
    third = plain.include("next", plain, "next")
    return plain.include("next", plain.include("next", third, "next"), "next")


def test_cycles_and_depth(spark):
    got = {r.key: r for r in M.compile_definition(family(spark)).collect()}
    assert got[1].content == "one\n\n[next]\ntwo\n\n[next]\nthree" and got[1].included == ["n:2", "n:3"] and got[4].content == ""
    assert {r.key: r.content for r in M.compile_definition(family(spark), 1).collect()}[1] == "one\n\n[next]\ntwo"


def test_definition_parts(spark):
    rows = spark.createDataFrame([(1, "x", True, "file text"), (2, None, None, None)], "id int, name string, flag boolean, body string")
    made = M.Definition("m", rows, "id").add("Name", F.col("name")).add("Flag", F.col("flag")).add_file("Body", F.col("body")).document_key(F.concat(F.lit("k"), "id")).metadata(a=F.lit(1))
    got = {r.key: r for r in M.compile_definition(made).collect()}
    assert got[1].content == "Name: x\n\nFlag: true\n\nBody: file text" and got[2].content == "" and got[1].document_key == "k1" and got[1].metadata == {"a": "1"}


def test_auto_sync(spark):
    seen = {}
    handler = M.auto_sync(lambda rows: M.searchable("n", rows, "id", ["name"]), lambda rows, number: seen.setdefault(number, {r.document_key: r.content for r in rows.collect()}))
    handler(spark.createDataFrame([(1, "one", False), (2, "two", True), (3, "three", None)], "id int, name string, deleted boolean"), 7)
    assert seen == {7: {"n:1": "one", "n:2": "", "n:3": "three"}}
    touched = M.touched_roots(spark.createDataFrame([(1, 5), (2, 5), (3, None)], "id int, owner int"), "owner")
    assert [r.key for r in touched.collect()] == [5]


# --- sources and parsers -----------------------------------------------------------------------------------------------------


def test_web_pages(spark):
    names = {"ok.example": ["93.184.215.14"], "inner.example": ["93.184.215.14", "10.1.1.1"], "none.example": []}
    asked = ["http://ok.example/a", "https://inner.example/", "http://none.example/", "ftp://ok.example/", "http://169.254.1.1/", "http://ok.example/gone", "http://ok.example/down", None]

    def fetch(url, addresses):
        if url.endswith("down"):
            raise OSError("no route")
        return (302 if url.endswith("gone") else 200), "TEXT/HTML; charset=x", b"<p>hi</p>"

    got = {r.url: r for r in R.web_pages(spark.createDataFrame([(u,) for u in asked], "url string"), fetch, lambda h: names[h]).collect()}
    assert got["http://ok.example/a"].mime == "text/html" and bytes(got["http://ok.example/a"].content) == b"<p>hi</p>"
    assert {u: r.error for u, r in got.items() if r.error} == {"https://inner.example/": "the host has an address that isn't public", "http://none.example/": "the host has no address", "ftp://ok.example/": "not a public http or https address", "http://169.254.1.1/": "not a public http or https address", "http://ok.example/gone": "status 302", "http://ok.example/down": "no answer: no route"}


def test_local_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Hi")
    (row,) = R.local_files(spark, [str(tmp_path / "a.md")], {"owner": "me", "filename": "forged"}).collect()
    assert row.mime == "text/markdown" and row.metadata == {"filename": "a.md", "owner": "me"}
    with pytest.raises(FileNotFoundError):
        R.local_files(spark, [str(tmp_path / "missing")])


def test_row_files(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, file string")
    held = spark.createDataFrame([("a", 3, b"abc"), ("b", 0, b""), ("c", 99, b"...")], "path string, length long, content binary")
    assert {r.id: r.skipped for r in R.row_files(rows, "file", held, 10).collect()} == {1: None, 2: "empty", 3: "too large", 4: "missing"}
    with pytest.raises(Exception, match="is missing"):
        R.row_files(rows.where("id = 4"), "file", held, strict=True).collect()


def test_pdf_and_recognition():
    read = P.pdf_parser(lambda data: ([" first page of text ", "", "third"], {"title": "T", "author": None}))
    out = read(b"")
    assert out == {"text": "first page of text\n\nthird", "sections": [("page", "first page of text", 0, 1), ("page", "third", 0, 3)], "metadata": {"title": "T", "page_count": "3"}}
    bare = lambda data: (["x"], {})
    assert P.pdf_parser(bare, lambda d: "seen text")(b"")["text"] == "seen text" and P.pdf_parser(bare)(b"")["text"] == "x"

    def broken(data):
        raise RuntimeError

    assert P.pdf_parser(bare, broken)(b"")["text"] == "x"


def test_empty_metadata_is_dropped():
    assert P.falsy_free({"a": 0, "b": "", "c": None, "d": [], "e": "0", "f": ["x", 1], "g": 2, "h": False}) == {"f": "x,1", "g": "2"}
    assert "row_count" not in P.delimited(b"a,b\n").get("metadata", {})


# --- commands ----------------------------------------------------------------------------------------------------------------


def test_commands(spark, tmp_path, capsys):
    at = "/root/testdata/sf0.001"
    assert commands.main(["status", "--tables", at], spark) == commands.OK and "status\tdocuments" in capsys.readouterr().out
    assert commands.main(["tenant", "--tables", at], spark) == commands.USAGE and commands.main(["tenant", "--tables", at, "--tenant", "nobody"], spark) == commands.FAILED
    assert commands.main(["nonsense", "--tables", at], spark) == commands.USAGE
    assert commands.main(["reconcile", "--tables", at], spark) == commands.FAILED
    folder = str(tmp_path)
    spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, id string, rank int").write.parquet(f"{folder}/hits.parquet")
    spark.createDataFrame([("q", "b"), ("q", "c")], "qid string, id string").write.parquet(f"{folder}/relevant.parquet")
    assert commands.main(["evaluate", "--tables", folder, "--least-recall", "0.5"], spark) == commands.OK
    assert commands.main(["evaluate", "--tables", folder, "--least-recall", "0.6"], spark) == commands.FAILED
    spark.createDataFrame([("k", "a"), ("l", "b")], "key string, tenant_id string").write.parquet(f"{folder}/embedding_cache.parquet")
    assert commands.main(["clear-cache", "--tables", folder, "--tenant", "a"], spark) == commands.OK
    assert [r.key for r in spark.read.parquet(f"{folder}/embedding_cache.parquet.next").collect()] == ["l"]
    keys = SEC.Keys(SEC.FileStore(spark, f"{folder}/keys", "m"))
    keys.create("x")
    SEC.seal(secret(spark).where("tenant_id = 'x'"), keys.table(spark)).write.parquet(f"{folder}/payloads.parquet")
    assert commands.main(["rotate", "--tables", folder, "--tenant", "x", "--keys", f"{folder}/keys", "--master", "m"], spark) == commands.OK
    assert {r.key_version for r in spark.read.parquet(f"{folder}/payloads.parquet.next").collect()} == {2}
    assert commands.main(["rotate", "--tables", folder, "--tenant", "z", "--keys", f"{folder}/keys", "--master", "m"], spark) == commands.FAILED
    assert commands.main(["shred", "--tables", folder, "--tenant", "x"], spark) == commands.USAGE
