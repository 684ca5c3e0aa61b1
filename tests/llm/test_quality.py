import random

import pytest
from pyspark.sql import functions as F

from meridianlake.llm import quality as Q

PROSE = "The reports were checked before the weekly review and nobody in the office has signed the note. We learned that the manual explains the rule. "
W = "report review office archive manual rule note desk plan survey catalogue letter branch folder schedule record ledger gateway".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"The {r.choice(W)} of the {r.choice(W)} was in the {r.choice(W)} and {r.choice(W)} {r.randint(1, 99)} is for a {r.choice(W)}." for _ in range(n))


TEXTS = {
    "list": ["- the first item\n- the second item\n- the third item\n- the last item", "The list:\n1. one entry\n2. another entry\n3. the third entry", "release plan, price catalogue (3), query log, field survey, key vault, data map, audit trail", "the red plan\nthe blue survey\nthe green archive\nthe long report\nthe short note"],
    "table": ["| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 | x | 6 |", "date;lot;sku\n2025-01-01;5;A-1\n2025-01-02;;B-2", "lot\tsku\tname\n1\t2\tx\n3\t\ty", "name: 17 | qty: 4 | site: A-3\nname: 18 | qty:  | site: B-3", "name            qty             price\nlog             4657            12.3"],
    "junk": ["qxzZnNY0LtyLhnyKlNitT5VukM5RBOIiUoKxshrcrgUVCm+/J3Q8tUWOBT0icFyl\nCVMAprblpUdrfTuVCvuHbvI/ua+ZgWL1ScCfgztc4gQ5MQcBH5aE9y1dXrMTw4/A", "lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem", '<div class="c4"><span/></div>{{pCeqqi}}&nbsp;&#3343;', "00000000  69 58 06 25 a9 e7 b0 f7 dd ce\n00000010  4c 11 d0 42 31 80 dd f4", "{ ^#~$ ^]{\n~/~[$=]/!]@=}~]^}\\&!*^[", "jsztdtrjs oatkl hjesqp zadj rqadrhlaq ffspfl tfotzqjfjogf jalzhedrjtj zgaqlpazd ssa sqkggf ifqpqjoeqf"],
    "prose": [PROSE, prose(1, 3) + "\n- one item\n- two items\n" + prose(2, 4), "\n".join(prose(3, 8)[k : k + 60] for k in range(0, 400, 60))],
}


def table(spark):
    r = random.Random(1)
    rows, want, k = [], {}, 0
    for kind, texts in TEXTS.items():
        for t in texts:
            rows.append((k, t, "en" if k % 2 else None))
            want[k] = kind
            k += 1
    for _ in range(60):
        rows.append((k, prose(k, r.randint(2, 9)), r.choice(["en", "EN", None])))
        want[k] = "prose"
        k += 1
    rows += [(k, None, "en"), (k + 1, "", "en"), (k + 2, " \n", "en"), (k + 3, prose(9, 3000), "en"), (k + 4, PROSE * 3000, "en")] + rows[:4]
    want |= {k + 3: "prose", k + 4: "junk"}
    return spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, words string"), want


def test_verdicts(spark):
    docs, want = table(spark)
    got = {r.doc_id: r.verdict for r in Q.quality(docs).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert set(got) == set(want)
    assert {r.doc_id: r.kind for r in Q.found(docs).collect()} == {k: v for k, v in want.items() if v != "prose"}


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_ranks_are_exact(spark, partitions):
    """Also for a value that fills several partitions, and for rows that are ranked without being counted."""
    r = random.Random(partitions)
    values = [(lang, stat, float(r.randint(0, 12)), r.randint(0, 1)) for lang in (7, 9) for stat in (0, 1) for _ in range(r.randint(1, 90))] + [(8, 0, 1.0, 1)] * 300 + [(8, 0, 2.0, 1), (8, 0, 0.0, 0)]
    rows = [(k, *v) for k, v in enumerate(values)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {g.key: (g.at_or_below, g.at_or_above, g.total) for g in Q.tails(spark.createDataFrame(rows, "key long, lang long, stat int, value double, weight long"), len(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for k, lang, stat, v, _ in rows:
        own = [x for a, b, x, w in values if (a, b) == (lang, stat) and w]
        assert got[k] == (sum(x <= v for x in own), sum(x >= v for x in own), len(own)), (lang, stat, v)


def test_common_words_are_learned(spark):
    """Copies of one text don't make its words common."""
    rows = [(k, prose(k, 6), "en") for k in range(90)] + [(100 + k, "zebra " * 30 + "quagga", "en") for k in range(60)] + [(200 + k, f"el plan {k} está en la mesa y no se mueve", "es") for k in range(20)]
    got = Q.common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"the", "of", "was", "in", "el", "la"} <= got and "zebra" not in got


def test_the_score_decides(spark):
    """A text in list lines whose statistics are those of most texts is no outlier; the same text among prose is one."""
    listed = [(k, "\n".join(f"- the {w} of the {w} was in the plan" for w in W[:5]) + f" {k}.", "en") for k in range(40)]
    texts = [(1000 + k, prose(k, 6), "en") for k in range(200)]
    schema = "doc_id long, text string, lang string"
    few = {r.doc_id: r.verdict for r in Q.quality(spark.createDataFrame(listed[:3] + texts, schema)).collect()}
    many = {r.doc_id: r.verdict for r in Q.quality(spark.createDataFrame(listed + texts[:2], schema)).collect()}
    assert few[0] == few[1] == few[2] == "list" and all(few[1000 + k] == "prose" for k in range(200))
    assert sum(many[k] == "prose" for k in range(40)) > 30


def test_copies_in_one_language(spark):
    """Copies of a table that make up most of a language come out, and weigh as one text in the ranks."""
    rows = [(k, TEXTS["table"][0], "fr") for k in range(200)] + [(200 + k, prose(k, 5), "fr") for k in range(60)] + [(300 + k, TEXTS["list"][0], None) for k in range(80)]
    got = {r.doc_id: r for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {k: r.verdict for k, r in got.items()} == {k: "table" if k < 200 else "list" if k >= 300 else "prose" for k, _, _ in rows}
    assert got[0].ranked_among == 61 and got[300].ranked_among == 1 and got[0].outlier_score > max(got[k].outlier_score for k in range(200, 260))


def test_statistics():
    s = Q.statistics(text := "One two. Three!\nfour", Q.lines_of(text), frozenset(["two"]))
    assert s["words"] == 4 and s["mean_word_length"] == 3.75 and s["line_end_share"] == 0.5 and s["sentence_density"] == 0.5 and s["common_share"] == 0.25


def test_empty(spark):
    docs, _ = table(spark)
    assert Q.quality(docs.limit(0)).count() == 0 and Q.quality(docs.where(F.col("text").isNull())).count() == 0
