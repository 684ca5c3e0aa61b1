import numpy as np
import pytest
from pyspark.sql import functions as F

from meridianlake.llm import neighbours as N


def table(spark, seed=3, n=600, groups=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    X = centres[rng.integers(groups, size=n)] + 0.25 * rng.normal(size=(n, 64))
    X *= rng.uniform(0.3, 4, size=(n, 1))
    rows = [(f"v{k:04d}", f"ns{k % 2}", [float(np.float32(y)) for y in x], "clash") for k, x in enumerate(X)]
    rows += rows[:20] + [("zero", "ns0", [0.0] * 64, ""), ("short", "ns0", [1.0] * 63, ""), ("null", "ns0", None, ""), ("nan", "ns0", [float("nan")] * 64, ""), ("lost", None, [1.0] * 64, ""), ("twin", "ns0", rows[0][2], "")]
    names = spark.createDataFrame([("ns0", 64, "cosine"), ("ns1", 64, "l2")], "namespace string, dimensions int, metric string")
    return spark.createDataFrame(rows, "id string, namespace string, embedding array<float>, query string"), names, rows


def brute(rows, ids, k=10):
    ok = {r[0]: r for r in rows if r[1] and r[2] and len(r[2]) == 64 and any(r[2]) and not np.isnan(r[2]).any()}
    out = {}
    for i in ids:
        if i in ok:
            q = np.array(ok[i][2])
            sims = sorted(((-round(float(q @ np.array(r[2]) / np.linalg.norm(q) / np.linalg.norm(r[2])), 12), j) for j, r in ok.items() if j != i and r[1] == ok[i][1]))
            out[i] = {j for _, j in sims[:k]}
    return out


def test_recall_against_brute_force(spark):
    vectors, names, rows = table(spark)
    ids = [f"v{k:04d}" for k in range(0, 600, 7)] + ["zero", "short", "null", "nan", "lost", "absent", None]
    got = {}
    for r in N.nearest(vectors, names, spark.createDataFrame([(i,) for i in ids], "query string")).collect():
        got.setdefault(r.query, set()).add(r.id)
    want = brute(rows, ids)
    assert set(got) == set(want)
    assert np.mean([len(got[i] & want[i]) / 10 for i in want]) >= 0.97


def test_small_namespace_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(f"v{k}", "ns0", [float(x) for x in rng.normal(size=64)]) for k in range(40)]
    vectors = spark.createDataFrame(rows, "id string, namespace string, embedding array<float>")
    names = spark.createDataFrame([("ns0", 64)], "namespace string, dimensions int")
    got = {}
    for r in N.nearest(vectors, names, vectors.select(F.col("id").alias("query"))).collect():
        got.setdefault(r.query, set()).add(r.id)
    assert got == brute([(a, b, [float(np.float32(x)) for x in c]) for a, b, c in rows], [r[0] for r in rows])


def test_few_and_none(spark):
    names = spark.createDataFrame([("n", 2)], "namespace string, dimensions int")
    vectors = spark.createDataFrame([("a", "n", [1.0, 0.0]), ("b", "n", [0.0, 1.0])], "id string, namespace string, embedding array<float>")
    queries = spark.createDataFrame([("a",)], "query string")
    assert [(r.id, r.rank) for r in N.nearest(vectors, names, queries).collect()] == [("b", 1)]
    assert N.nearest(vectors.limit(0), names, queries).count() == 0
    assert N.nearest(vectors, names, queries.limit(0)).count() == 0


def test_probes(spark):
    vectors, names, _ = table(spark)
    probes = spark.createDataFrame([(1, "v0000"), (2, "zero"), (3, "v0000")], "probe_id long, id string")
    got = N.found(vectors, names, probes).collect()
    assert {r.probe_id for r in got} == {1, 3} and len(got) == 20 and ("twin" in {r.id for r in got})


@pytest.mark.parametrize("radius, size", [(0, 1), (1, 16), (2, 120), (3, 560)])
def test_masks(radius, size):
    m = N.masks(16, radius)
    assert len(set(m.tolist())) == size and all(bin(x).count("1") == radius for x in m.tolist())


def test_ball_stays_a_small_share_of_the_keys():
    for bits in range(1, 17):
        r = N.last_radius(bits)
        assert r == 0 or 28 * sum(N.comb(bits, i) for i in range(r + 1)) <= 1 << bits


def test_probes_meet_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(4000, 32)).astype(np.float32)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    index = N.Index(X, N.learn(X[:500]))
    covered = index.parts * (N.last_radius(index.sub) + 1) - 1
    for q in X[::500]:
        apart = (N.encode(X, index.model) != N.encode(q[None, :], index.model)).sum(1)
        assert set(np.flatnonzero(apart <= covered)) <= set(index.near(q, 4000).tolist())


def test_recall_where_nothing_is_clustered(spark, monkeypatch):
    """Vectors without any groups, several shards and blocks of queries: no shard is small enough to be read whole."""
    rng = np.random.default_rng(9)
    rows = [(f"v{k:05d}", "ns0", [float(np.float32(x)) for x in rng.normal(size=32)]) for k in range(5000)]
    vectors = spark.createDataFrame(rows, "id string, namespace string, embedding array<float>")
    names = spark.createDataFrame([("ns0", 32)], "namespace string, dimensions int")
    monkeypatch.setattr(N, "SHARD_ROWS", 2500)
    monkeypatch.setattr(N, "QUERIES_IN_BLOCK", 30)
    asked = [r[0] for r in rows[::100]]
    got = {}
    for r in N.nearest(vectors, names, spark.createDataFrame([(i,) for i in asked], "query string")).collect():
        got.setdefault(r.query, set()).add(r.id)
    X = np.array([r[2] for r in rows])
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    recall = []
    for k in range(0, 5000, 100):
        s = X @ X[k]
        s[k] = -9
        recall.append(len({rows[j][0] for j in np.argsort(-s)[:10]} & got[rows[k][0]]) / 10)
    assert all(len(x) == 10 for x in got.values()) and np.mean(recall) >= 0.93


def test_ties_go_by_id(spark):
    names = spark.createDataFrame([("n", 2)], "namespace string, dimensions int")
    rows = [(f"i{k:04d}", "n", [1.0, 1.0]) for k in range(700)]
    vectors = spark.createDataFrame(rows, "id string, namespace string, embedding array<float>")
    got = N.nearest(vectors, names, spark.createDataFrame([("i0003",)], "query string"), k=5).orderBy("rank").collect()
    assert [r.id for r in got] == ["i0000", "i0001", "i0002", "i0004", "i0005"]
