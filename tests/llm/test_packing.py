import numpy as np
import pytest

from meridianlake.llm import packing as P


def table(spark):
    words = "archive review notice manual ledger gateway schedule record survey log plan desk".split()
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(words, size=int(rng.integers(1, 120)))), "en" if k % 3 else None, "hot" if k % 3 else f"s{k % 5}", "clash") for k in range(400)]
    rows += [(1000, None, "en", "hot", ""), (1001, "", "en", "hot", ""), (1002, "word " * 1000, "en", "hot", ""), (1003, " ", None, None, "")]
    windows = spark.createDataFrame([(1, "s", 64), (2, "m", 256), (2, "m", 256), (3, "bad", 0), (4, "none", None)], "window_id long, label string, capacity_tokens long")
    return spark.createDataFrame(rows + rows[:9], "doc_id long, text string, lang string, source string, tokens string"), windows, rows


@pytest.mark.parametrize("shard_rows", [60, 2000])
def test_every_text_once_within_capacity(spark, shard_rows):
    docs, windows, rows = table(spark)
    got = P.pack_documents(docs, windows, shard_rows).toPandas()
    enc = P.encoder(P.TOKENIZER)
    sizes = {r[0]: len(enc.encode_ordinary(r[1])) for r in rows if r[1]}
    for window, capacity in ((1, 64), (2, 256)):
        mine = got[got.window_id == window]
        assert mine.groupby("doc_id").tokens.sum().to_dict() == sizes
        used = mine.groupby("container_id").tokens.sum()
        assert used.max() <= capacity
        assert sizes[1002] > capacity and (mine[mine.doc_id != 1002][[sizes[d] <= capacity for d in mine[mine.doc_id != 1002].doc_id]].part == 0).all()
        whole = {d for d, n in sizes.items() if n <= capacity}
        assert mine[mine.doc_id.isin(whole)].groupby("doc_id").size().max() == 1
        assert used.sum() / (len(used) * capacity) > 0.93
    assert set(got.window_id) == {1, 2}


def test_neighbours_share_words():
    a, b, c = np.array([1, 2, 3, 4]), np.array([1, 2, 3, 9]), np.array([20, 21, 22, 23])
    index = P.Index([a, b, c, np.array([30, 31]), np.zeros(0, dtype=int)])
    ranked = lambda i, d: [x for near in i.neighbours(d) for x in near.tolist()]
    assert ranked(index, 0) == [1] and ranked(index, 3) == [] and ranked(index, 4) == []


def test_late_seeds_keep_their_neighbours():
    """Of two hot groups of alike texts without a common word, no container mixes them while unused ones are left."""
    tokens = [np.r_[np.arange(20), 40 + k] + 1000 * (k % 2) for k in range(240)]
    index = P.Index(tokens)
    assert sum(map(len, index.neighbours(0))) == 119
    mixed = [held for held in P.pack([21] * 240, 210, index) if len({d % 2 for d, _, _ in held}) > 1]
    assert mixed == []
    many = P.Index([np.arange(100), *(np.array([k]) for k in range(100))])
    assert sum(map(len, many.neighbours(0))) == 100


def test_empty(spark):
    docs, windows, _ = table(spark)
    assert P.pack_documents(docs.limit(0), windows).count() == 0 and P.pack_documents(docs, windows.limit(0)).count() == 0


def test_an_id_under_two_sources_is_packed_once(spark):
    rows = [(k, f"text number {k} of the archive", "en", f"s{k % 9}") for k in range(300)] + [(5, "text number 5 of the archive", "de", "other"), (5, "text number 5 of the archive", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    windows = spark.createDataFrame([(1, "s", 64)], "window_id long, label string, capacity_tokens long")
    got = P.pack_documents(docs, windows, shard_rows=50)
    assert got.count() == 300 and got.where("doc_id = 5").count() == 1
