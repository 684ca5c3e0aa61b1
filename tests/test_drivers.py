import pytest
from pyspark.sql import functions as F

from meridianlake.functions import vectors as V
from meridianlake.functions.registry import Refused, Registry, Unknown, retrying
from meridianlake.operators import embedding as EM
from meridianlake.sources import sinks as K


def test_registry():
    r = Registry("thing", a=lambda: object())
    assert r.get("a") is r.get("a")
    r.extend("a", lambda: 5)
    assert r.get("a") == 5
    with pytest.raises(Unknown):
        r.get("b")


def test_retrying():
    seen = []

    def call(status):
        seen.append(status)
        raise Refused(status)

    for status, times in ((500, 3), (429, 3), (0, 3), (400, 1)):
        seen.clear()
        with pytest.raises(Refused):
            retrying(call, sleep=lambda s: None)(status)
        assert len(seen) == times


def test_embedding_agrees_with_the_expression(spark):
    texts = spark.createDataFrame([("a", "hello"), ("b", "hello"), ("c", ""), ("d", None)], "tenant_id string, text string")
    rows, fresh = EM.with_cache(texts, None, EM.EMBEDDERS.get("deterministic"), 8)
    got = rows.select("text", "v", V.embed(F.col("text")).alias("w")).where("text is not null").collect()
    assert all(abs(a - b) < 1e-12 for r in got for a, b in zip(r.v, r.w)) and fresh.count() == 3
    again, more = EM.with_cache(texts, fresh, EM.EMBEDDERS.get("deterministic"), 8)
    assert more.count() == 0 and again.agg(F.sum("tokens")).first()[0] == 0 and again.count() == 4


def test_wrong_vectors_are_refused(spark):
    rows = spark.createDataFrame([("k", "t")], "key string, text string")
    with pytest.raises(Exception, match="provider gave"):
        EM.embed_texts(rows, lambda texts: [[1.0]], 8).collect()


def test_generations(spark, tmp_path):
    at = str(tmp_path / "vectors")
    first = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3)], "document_id string, n int")
    K.write_generation(K.replace_documents(spark, at, first), at, 1)
    K.write_generation(K.replace_documents(spark, at, spark.createDataFrame([("d1", 9)], "document_id string, n int")), at, 2)
    assert sorted(r.n for r in K.read_current(spark, at).collect()) == [3, 9]
    K.drop_older(spark, at, 1)
    assert len(K.generations(spark, at)) == 1
    assert K.clustered(first, ["document_id"], 2).count() == 3
