import random

import pytest

from meridianlake.llm import leakage as L

R = random.Random(4)
PASSAGE = " ".join(f"{R.choice('abcdefghij')}{R.randint(10, 99)}x" for _ in range(60))
WORDS = PASSAGE.split()


def found(spark, texts, kind="passage", **more):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, "what is said here about it?", PASSAGE), (7, "what is said here about it?", PASSAGE), (8, None, None), (9, "", "short passage of few words"), (None, "x", PASSAGE)], "item_id long, query string, passage string")
    return {(r.doc_id, r.item_id): r for r in L.leaks(docs, items, **more).where(f"kind = '{kind}'").collect()}


def test_whole_part_and_changed(spark):
    changed = WORDS[10:34]
    changed[5], changed[12] = "other", "more"
    dropped = WORDS[10:19] + WORDS[20:30] + ["added"] + WORDS[30:36]
    marked = "<p>Before</p> **" + " ".join(WORDS[:12]).upper() + "**,\n<b>" + "\n".join(WORDS[12:22]) + "</b>!"
    texts = [PASSAGE, "start " + " ".join(WORDS[20:40]) + " end", " ".join(WORDS[20:39]), " ".join(changed), " ".join(dropped), marked, None, "", "what is said here about it?", " ".join(WORDS[0:15]) + " gap " * 10 + " ".join(WORDS[15:30])]
    got = found(spark, texts)
    assert set(got) == {(k, 7) for k in (0, 1, 3, 4, 5)}
    assert got[0, 7].matched_words == 60 and got[1, 7].matched_words == 20 and got[3, 7].errors == 2


def test_offsets(spark):
    text = "Before this. " + " ".join(WORDS[5:30]) + " after"
    r = found(spark, [text])[0, 7]
    assert text[r.start : r.stop] == " ".join(WORDS[5:30])


def test_too_many_errors(spark):
    worse = [w if k % 6 else "wrong" for k, w in enumerate(WORDS[:40])]
    assert found(spark, [" ".join(worse)]) == {}


def test_long_text_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "WORDS_IN_AUTOMATON", 30)
    text = "filler words go here and on " * 20000 + " ".join(WORDS[3:33])
    assert set(found(spark, [text, text])) == {(0, 7), (1, 7)}


def test_errors_next_to_each_other(spark):
    w, other = WORDS, [f"other{k}" for k in range(9)]
    texts = [
        w[:7] + other[:2] + w[9:60],
        w[:19] + other[:2] + w[21:40],
        w[:18] + [w[18] + w[19]] + w[20:39],
        w[:12] + other[:1] + w[13:19] + other[:4] + w[23:60],
        w[:19] + other[:2] + w[19:38],
        w[:19] + w[21:40],
        w[:18] + other[:5] + w[23:41],
        w[:19] + other[:6] + w[25:44],
        w[:6] + other[:4] + w[10:16] + other[:4] + w[20:26],
    ]
    assert set(found(spark, [" ".join(t) for t in texts])) == {(k, 7) for k in range(7)}


@pytest.mark.parametrize("docs, items", [(0, 1), (1, 0)])
def test_empty(spark, docs, items):
    d = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string").limit(docs)
    i = spark.createDataFrame([(1, "q", PASSAGE)], "item_id long, query string, passage string").limit(items)
    assert L.leaks(d, i).count() == 0


def test_whole_questions_and_short_passages(spark):
    texts = ["He asked: WHAT is said, here about it? Nobody knew.", "what is said here about them", "a <b>short</b> passage of few words.", "a short passage of words", PASSAGE]
    assert {k: (r.matched_words, r.start, r.stop) for k, r in found(spark, texts, "question").items()} == {(0, 7): (6, 10, 37)}
    assert {k: r.matched_words for k, r in found(spark, texts, "short passage").items()} == {(2, 9): 5}
    assert set(found(spark, texts)) == {(4, 7)}


def test_offsets_in_decomposed_text(spark):
    import unicodedata

    words = [w + "é" for w in WORDS[:30]]
    text = unicodedata.normalize("NFD", "Là où l'été, " + " ".join(words) + " été après")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, None, " ".join(words))], "item_id long, query string, passage string")
    (r,) = L.leaks(docs, items).collect()
    assert r.matched_words == 30 and unicodedata.normalize("NFC", text[r.start : r.stop]) == " ".join(words)


def test_items_in_several_automata_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(WORDS[k : k + 30])) for k in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(k, None, " ".join(WORDS[k : k + 35])) for k in range(20)], "item_id long, query string, passage string")
    once = {tuple(r) for r in L.leaks(docs, items).collect()}
    monkeypatch.setattr(L, "WORDS_IN_AUTOMATON", 150)
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == once and len(once) > 100
