import numpy as np
import pytest
from pyspark.sql import functions as F

from meridianlake.operators import chunking as C
from meridianlake.operators import evaluation as E
from meridianlake.operators import search as S
from meridianlake.operators import store as ST
from meridianlake.plans.retrieval import Request, Search, ask


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, v array<double>")


def asked(spark, *qs):
    return spark.createDataFrame([(f"q{k}", q) for k, q in enumerate(qs)], "qid string, q array<double>")


def ids(df):
    return [r.id for r in df.orderBy("qid", "rank").collect()]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_topk_order(spark, metric):
    rows = vectors(spark, [("far", [-1.0, 0.0, 0.0]), ("near", [1.0, 0.0, 0.0]), ("bad", [1.0]), ("none", None), (None, [1.0, 0.0, 0.0])])
    assert ids(S.exact_topk(rows, asked(spark, [1.0, 0.0, 0.0]), 10, metric)) == ["near", "far"]
    assert ids(S.exact_topk(rows, asked(spark, [1.0, 0.0, 0.0]), 1, metric)) == ["near"]
    assert ids(S.exact_topk(rows, asked(spark, [1.0, 0.0, 0.0]), 0, metric)) == []


def test_topk_ties_threshold_and_zero(spark):
    rows = vectors(spark, [(f"t{k:02d}", [1.0, 0.0]) for k in range(20)] + [("zero", [0.0, 0.0])]).repartition(4)
    assert ids(S.exact_topk(rows, asked(spark, [2.0, 0.0]), 3)) == ["t00", "t01", "t02"]
    assert S.exact_topk(rows, asked(spark, [2.0, 0.0]), 30).count() == 21
    assert S.exact_topk(rows, asked(spark, [2.0, 0.0]), 30, threshold=0.5).count() == 20
    with pytest.raises(ValueError):
        S.exact_topk(rows, asked(spark, [1.0, 0.0]), 3, "manhattan")


def test_topk_empty(spark):
    assert S.exact_topk(vectors(spark, []), asked(spark, [1.0]), 3).count() == 0
    assert S.exact_topk(vectors(spark, [("a", [1.0])]), asked(spark), 3).count() == 0


def test_topk_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    X, Q = rng.normal(size=(60, 4)), rng.normal(size=(9, 4))
    rows = vectors(spark, [(f"v{k:02d}", x.tolist()) for k, x in enumerate(X)])
    monkeypatch.setattr(S, "QUERIES_IN_BLOCK", 2)
    got = {(r.qid, r.rank): r.id for r in S.exact_topk(rows, asked(spark, *Q.tolist()), 5).collect()}
    sims = (Q / np.linalg.norm(Q, axis=1, keepdims=True)) @ (X / np.linalg.norm(X, axis=1, keepdims=True)).T
    want = {(f"q{i}", r + 1): f"v{j:02d}" for i, s in enumerate(sims) for r, j in enumerate(np.argsort(-s)[:5])}
    assert got == want


def test_keyword_scores(spark):
    docs = [("q0", "a", "the cat sat on the mat"), ("q0", "b", "machine learning vectors and embeddings"), ("q0", "c", "a dog ran in the park"), ("q0", "d", None)]
    pool = spark.createDataFrame(docs, "qid string, id string, content string")
    q = spark.createDataFrame([("q0", "machine learning embeddings")], "qid string, text string")
    assert ids(S.keyword_scores(pool, q)) == ["b"]
    assert S.keyword_scores(pool, spark.createDataFrame([("q0", "")], "qid string, text string")).count() == 0
    assert ids(S.corpus_keyword_topk(pool.select("id", "content"), q, 5)) == ["b"]


def test_fusion(spark):
    schema = "qid string, id string, rank int"
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], schema)
    b = spark.createDataFrame([("q", "c", 1), ("q", "a", 2), ("q", "z", 3)], schema)
    assert ids(S.fuse([a, b]))[:2] == ["a", "c"] and len(ids(S.fuse([a, b], 2))) == 2


def test_diversity(spark):
    hits = spark.createDataFrame([("q0", "a", 1, [1.0, 0.0, 0.0]), ("q0", "a2", 2, [0.99, 0.01, 0.0]), ("q0", "b", 3, [0.0, 1.0, 0.0]), ("q0", "n", 4, None)], "qid string, id string, rank int, v array<double>")
    q = asked(spark, [1.0, 0.0, 0.0])
    assert ids(S.diverse(hits, q, 2, 0.3)) == ["a", "b"] and ids(S.diverse(hits, q, 2, 1.0)) == ["a", "a2"]
    assert ids(S.diverse(hits.withColumn("v", F.lit(None).cast("array<double>")), q, 2)) == ["a", "a2"]


def test_repeats_and_budget(spark):
    hits = spark.createDataFrame([("q", "a", 1, "same"), ("q", "b", 2, " same "), ("q", "c", 3, ""), ("q", "d", 4, None), ("q", "e", 5, "word " * 50)], "qid string, id string, rank int, content string")
    assert ids(S.without_repeats(hits)) == ["a", "c", "d", "e"]
    assert ids(S.within_budget(hits, 5)) == ["a", "b", "c", "d"]
    assert ids(S.within_budget(hits.where("id = 'e'"), 5)) == ["e"]


def test_parents(spark):
    rows = spark.createDataFrame([("q", "c", "p", "t", "child"), ("q", "o", "p", "u", "other")], "qid string, id string, parent_chunk_id string, tenant_id string, content string")
    parents = spark.createDataFrame([("p", "t", "parent")], "id string, tenant_id string, content string")
    got = {r.id: r.t for r in S.with_parents(rows, parents).select("id", S.hit_text().alias("t")).collect()}
    assert got == {"c": "parent", "o": "other"}


def test_evaluation(spark):
    hits = spark.createDataFrame([("q0", "x", 1), ("q0", "a", 2), ("q1", "y", 1)], "qid string, id string, rank int")
    relevant = spark.createDataFrame([("q0", "a"), ("q1", "none")], "qid string, id string")
    row = E.summary(E.by_case(hits, relevant, 5)).first()
    assert (row.cases, row.hit_rate, row.recall, row.precision, row.mrr) == (2, 0.5, 0.5, 0.1, 0.25)


def test_search_builder(spark):
    rows = [("1", "Secret alpha document about apples.", "tenant-a", "docs"), ("2", "Secret bravo document about bananas.", "tenant-b", "docs"), ("3", "Secret alpha document about apples.", "tenant-a", "docs")]
    from meridianlake.functions import vectors as V

    chunks = spark.createDataFrame(rows, "id string, content string, tenant_id string, namespace string").withColumn("v", V.embed(F.col("content"))).withColumn("metadata", F.to_json(F.struct("tenant_id")))
    q = spark.createDataFrame([("q", "Secret alpha document about apples.")], "qid string, text string")
    search = Search(chunks, q).namespace("docs")
    assert ids(search.tenant("tenant-a").hits()) == ["1"]
    assert sorted(ids(search.tenant("tenant-a").dedup(False).hits())) == ["1", "3"]
    assert ids(search.where("tenant_id", "tenant-b").hits()) == ["2"]
    assert ids(search.tenant("tenant-a").where("tenant_id", "tenant-b").hits()) == []
    assert search.first().count() == 1 and Search(chunks, q).count() == 0
    assert Request(top_k=5, hybrid=True).fetch_k == 20 and Request(top_k=5, fetch=7).fetch_k == 7
    assert ids(search.hybrid().rerank().mmr(0.7).hits())[0] == "1"
    got = ask(search.top_k(1)).first()
    assert got.answer.startswith("ANSWER: Context:") and got.citations == ["1"]


# --- chunks


def test_fixed(spark):
    docs = spark.createDataFrame([("abcdefghij" * 30,), ("",), (None,), ("   ",)], "text string")
    rows = C.fixed_chunks(docs, "text", 100, 20).orderBy("start").collect()
    assert len(rows[0].content) == 100 and rows[1].start == 80 and {r.text for r in rows} == {"abcdefghij" * 30}


def test_tokens():
    parts = list(C.by_tokens("word " * 200, 20, 5))
    assert len(parts) > 1 and all(sum(max(1, C.T.count_tokens(w)) for w in p.split()) <= 20 for _, p in parts)
    assert list(C.by_tokens("", 20, 5)) == []


def test_recursive():
    paragraphs = "x" * 15 + "\n\n" + "y" * 25
    assert all(len(p) <= 25 for _, p in C.recursive(paragraphs, 25, 20))
    text = "SECTION zero. SECTION one. SECTION two. " * 5
    parts = list(C.recursive(text, 30, 8))
    starts = [a for a, _ in parts]
    assert starts == sorted(set(starts)) and all(text[a:].startswith(p.split(" ")[0]) for a, p in parts)
    assert all(len(p) <= 25 for _, p in C.recursive("word " * 200, 25, 20))


def test_sentences_and_markdown():
    assert all(p[-1] in ".!?" for _, p in C.by_sentences("One is here. Two is here! Three is here? Four is here.", 40, 0))
    assert [h for _, _, h in C.markdown("# Intro\ntext\n## Details\nmore", 1000, 0)] == ["Intro", "Details"]
    assert {h for _, _, h in C.markdown("# Big\n" + "body text. " * 40, 80, 10)} == {"Big"}


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "para one.\n\npara two. " * 40), (2, None), (3, " ")], "id int, text string")
    rows = C.chunks(docs, "text", "parent_child", 100, 10).collect()
    parents = {r.idx: r.content for r in rows if r.is_parent}
    assert parents and all(r.content.split(" ")[0] in parents[r.parent_idx] for r in rows if not r.is_parent)
    C.extend("halves", lambda t, size, overlap: [(0, t[: len(t) // 2]), (len(t) // 2, t[len(t) // 2 :])])
    assert C.chunks(docs.where("id = 1"), "text", "halves").count() == 2
    with pytest.raises(ValueError):
        C.chunks(docs, "text", "unknown")


def test_chunking_8000_words_is_fast():
    import time

    began = time.time()
    list(C.by_tokens("word " * 8000, 500, 50))
    assert time.time() - began < 0.5


# --- store


def test_ingest(spark):
    rows = spark.createDataFrame([("t", "k", "one", 1, 1), ("t", "k", "one", 2, 2), ("t", "k", "two", 3, 3), ("u", "k", "one", 4, 4), ("t", None, "x", 5, 5), ("t", "n", None, 6, 6)], "tenant_id string, document_key string, content string, arrived int, id int")
    got = {r.id: (r.is_new, r.version, r.superseded) for r in ST.ingest(rows).collect()}
    assert got == {1: (True, 1, True), 2: (False, 0, False), 3: (True, 2, False), 4: (True, 1, False), 5: (True, 1, False)}
    held = spark.createDataFrame([("t", "h", '{"document_key":"k"}', 4, None)], "tenant_id string, content_hash string, metadata string, version int, soft_deleted_at timestamp")
    assert {r.id: r.version for r in ST.ingest(rows, held).collect()}[3] == 6
    assert ST.ingest(rows, most_bytes=2).count() == 1


def test_upsert(spark):
    schema = "namespace string, id string, v array<double>"
    old = spark.createDataFrame([("n", "a", [1.0, 2.0])], schema)
    assert [r.v for r in ST.upsert(old, spark.createDataFrame([("n", "a", [3.0, 4.0])], schema), 2).collect()] == [[3.0, 4.0]]
    with pytest.raises(Exception, match="dimensions"):
        ST.upsert(old, spark.createDataFrame([("n", "b", [3.0])], schema), 2).collect()


def test_namespaces(spark):
    names = spark.createDataFrame([("n", 2, "cosine")], "namespace string, dimensions int, metric string")
    held = spark.createDataFrame([("n", "a")], "namespace string, id string")
    assert ST.create_namespace(names, "m", 3, "dot", held).count() == 2
    with pytest.raises(ValueError):
        ST.create_namespace(names, "n", 3, "dot", held)
    with pytest.raises(ValueError):
        ST.create_namespace(names, "m", 3, "manhattan", held)


def test_audit(spark):
    events = spark.createDataFrame([("t", "search", f"2024-01-0{k}", k) for k in range(1, 6)] + [("u", "x", "2024-01-01", 9)], "tenant_id string, action string, created string, id int")
    chain = ST.audit_chain(events).cache()
    anchors = ST.anchors(chain)

    def valid(entries):
        return {r.tenant_id: r.valid for r in ST.audit_verify(entries, anchors).collect()}

    assert valid(chain) == {"t": True, "u": True}
    assert not valid(chain.withColumn("action", F.when(F.col("seq") == 2, "changed").otherwise(F.col("action"))))["t"]
    assert not valid(chain.where("not (tenant_id = 't' and seq = 5)"))["t"]
    assert not valid(chain.where("tenant_id <> 't'"))["t"]


def test_encryption(spark):
    row = spark.createDataFrame([("secret", "t")], "x string, tenant string").select("x", ST.data_key(F.lit("m"), F.col("tenant"), F.lit(1)).alias("k"), ST.data_key(F.lit("m"), F.col("tenant"), F.lit(2)).alias("o")).withColumn("e", ST.encrypt(F.col("x").cast("binary"), F.col("k"))).select(ST.decrypt(F.col("e"), F.col("k")), ST.decrypt(F.col("e"), F.col("o")), F.length("k")).first()
    assert tuple(row) == ("secret", None, 32)


def test_payload(spark):
    row = spark.createDataFrame([('{"title":"x","is_parent":true,"tenant_id":"wrong"}', "t")], "m string, t string").select(ST.payload(F.col("m"), tenant_id=F.col("t"), is_parent=F.lit(False))).first()
    assert row[0] == {"title": "x", "tenant_id": "t", "is_parent": "false"}


def test_quota(spark):
    snapshot = spark.createDataFrame([("a", 5, 10, 0), ("b", 1, 10, 0)], "tenant_id string, documents long, bytes long, tokens long")
    own = spark.createDataFrame([("b", 1, None, None)], "tenant_id string, max_documents long, max_bytes long, max_tokens long")
    assert {r.tenant_id: r.exceeded for r in ST.over_quota(snapshot, own, {"documents": 5}).collect()} == {"a": "documents", "b": "documents"}


def test_sync(spark):
    now = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "new")], "key string, content string")
    was = spark.createDataFrame([("a", "h"), ("b", "h"), ("d", "h")], "key string, content_hash string")
    assert {r.key: r.change for r in ST.sync_changes(now, was).collect()} == {"a": "update", "b": "forget", "c": "add", "d": "forget"}
