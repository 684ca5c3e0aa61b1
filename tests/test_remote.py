import json

import numpy as np
import pyarrow as pa
import pytest

from meridianlake.functions import filters as FL
from meridianlake.functions import remote as R
from meridianlake.functions.registry import Refused
from meridianlake.operators import search as S
from meridianlake.plans import retrieval as PR


class Service:
    """Answers in turn; keeps what it was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, url, headers, body):
        self.asked.append((url, body))
        a = self.answers.pop(0)
        return a if isinstance(a, tuple) else (200, json.dumps(a))


def test_vectors_come_in_the_order_of_their_index():
    s = Service({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert R.embedder("openai", "http://x/", "m", transport=s)(["a", "b"]) == [[1.0], [2.0]] and s.asked == [("http://x/v1/embeddings", {"model": "m", "input": ["a", "b"]})]


@pytest.mark.parametrize("form, answer", [("cohere", {"embeddings": {"float": [[1.0]]}}), ("gemini", {"embeddings": [{"values": [1.0]}]}), ("huggingface", [[1.0]]), ("ollama", {"embeddings": [[1.0]]}), *((f, {"data": [{"embedding": [1.0]}]}) for f in ("azure-openai", "mistral", "jina", "voyage"))])
def test_forms_of_embedding_services(form, answer):
    assert R.embedder(form, "http://x", "m", transport=Service(answer))(["t"]) == [[1.0]]
    with pytest.raises(ValueError, match="1 vectors for 2 texts"):
        R.embedder(form, "http://x", "m", transport=Service(answer))(["t", "u"])


def test_retries_and_refusals():
    s = Service((503, ""), (429, ""), {"data": [{"embedding": [1.0]}]})
    assert R.embedder("openai", "http://x", "m", transport=s)(["t"]) == [[1.0]] and len(s.asked) == 3
    with pytest.raises(Refused):
        R.embedder("openai", "http://x", "m", transport=Service((401, "")))(["t"])
    with pytest.raises(Refused, match="no JSON"):
        R.embedder("openai", "http://x", "m", transport=Service((200, "<html>")))(["t"])


def test_usage_estimate():
    assert R.embedding_usage(["abcde", "", "abcd"], 2.0) == (3, 0.006)


@pytest.mark.parametrize("form", ["cohere", "jina"])
def test_rerankers_skip_unknown_places(form):
    s = Service({"results": [{"index": 1, "relevance_score": 0.9}, {"index": 7, "relevance_score": 0.8}, {"relevance_score": 1}, {"index": 0, "relevance_score": 0.1}]})
    assert R.reranker(form, "http://x", "m", transport=s)("q", ["a", "b"], 2) == [(1, 0.9), (0, 0.1)]
    assert R.reranker(form, "http://x", "m", transport=Service())("q", [], 2) == []


@pytest.mark.parametrize("form, answer, lines", [
    ("messages", {"content": [{"text": "Hi "}, {"text": "you"}]}, ['event: x', 'data: {"type":"content_block_delta","delta":{"text":"Hi "}}', "data: {broken", 'data: {"type":"ping"}', 'data: {"type":"content_block_delta","delta":{"text":"you"}}', "data: [DONE]", 'data: {"type":"content_block_delta","delta":{"text":"!"}}']),
    ("chat", {"choices": [{"message": {"content": "Hi you"}}]}, ['data: {"choices":[{"delta":{"content":"Hi "}}]}', 'data: {"choices":[{"delta":{}}]}', 'data: {"choices":[]}', 'data: {"choices":[{"delta":{"content":"you"}}]}', "data: [DONE]"]),
])
def test_models(form, answer, lines):
    m = R.HttpModel(form, "http://x", "m", transport=Service((500, ""), answer), lines=lambda url, headers, body: iter(lines))
    assert m.generate("p") == "Hi you" and list(m.stream("p")) == ["Hi ", "you"]
    assert list(R.HttpModel(form, "http://x", "m", transport=Service(answer)).stream("p")) == ["Hi you"]


def test_stub_and_null_models():
    assert "".join(R.StubModel().stream(" a b ")) == R.StubModel().generate(" a b ") == "ANSWER: a b" and R.Model().generate("x") == "" and list(R.Model().stream("x")) == []


def test_vector_service():
    s = Service({"result": [{"id": 1, "score": 0.5, "payload": {"a": 1}}, {"id": 2, "score": 0.4}]})
    assert R.vector_service("http://x", transport=s)("ns", [1.0], 0, {"a": 1, "b": ["x"], "c": {"gt": 3}}, 0.1) == []
    assert s.asked[0][1] == {"vector": [1.0], "limit": 1, "with_payload": True, "score_threshold": 0.1, "filter": {"must": [{"key": "a", "match": {"value": 1}}, {"key": "b", "match": {"any": ["x"]}}, {"key": "c", "range": {"gt": 3}}]}}
    for op in ("eq", "neq", "in", "nin"):
        with pytest.raises(FL.UnknownOperator):
            FL.remote_filter({"a": {op: 1}})


def test_wordings():
    class Lines(R.Model):
        def generate(self, prompt):
            return "one\n\n q \ntwo\nthree"

    assert R.wordings(Lines(), 2)("q") == ["q", "one", "two"] and R.wordings(R.Model(), 2)("q") == ["q"]


def test_registered_drivers_in_the_read_path(spark):
    PR.RERANKERS.extend("none", lambda: lambda q, texts, k: [])
    PR.WORDINGS.extend("twice", lambda: lambda q: [q, q, q + "!"])
    chunks = spark.createDataFrame([(1, [1.0] * 8, "one"), (2, [-1.0] * 8, "two")], "id long, v array<double>, content string")
    asked = spark.createDataFrame([("a", "what"), ("b", None)], "qid string, text string")
    assert PR.Search(chunks, asked.where("qid = 'a'")).rerank(by="none").hits().count() == 0
    assert {r.id for r in PR.Search(chunks, asked.where("qid = 'a'")).expand_queries("twice", 0).hits().collect()} == {1, 2}
    out = PR.Ask(PR.Search(chunks, asked.where("qid = 'a'"))).with_search(lambda s: s.top_k(1)).prompt("{question}: {context}").context_budget(5).using("stub").generate().collect()
    assert len(out) == 1 and out[0].model == "stub" and out[0].answer.startswith("ANSWER: what: [1] ")
    with pytest.raises(Exception, match="no reranker"):
        PR.Search(chunks, asked).rerank(by="unknown").hits()


def test_best_of_ties_by_id():
    scores = np.array([[1.0, 2.0, 2.0, 2.0, -np.inf], [0.0, 0.0, 0.0, 0.0, 0.0]])
    qi, vi = S._best(scores, pa.array(["e", "d", "c", "b", "a"]), 2)
    assert sorted(zip(qi.tolist(), vi.tolist())) == [(0, 2), (0, 3), (1, 3), (1, 4)]
    assert len(S._best(scores, pa.array(["e", "d", "c", "b", "a"]), 9)[0]) == 9 and len(S._best(scores, pa.array(list("abcde")), 0)[0]) == 0


def test_queries_of_a_wrong_length_are_refused(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    queries = spark.createDataFrame([("q", [1.0])], "qid string, q array<double>")
    assert S.exact_topk(vectors, queries, 1).count() == 0
    with pytest.raises(Exception, match="must have 2 dimensions"):
        S.exact_topk(vectors, queries, 1, dimensions=2).collect()
