import pytest
from pyspark.sql import functions as F

from meridianlake.functions import filters as FL
from meridianlake.functions import text as T
from meridianlake.functions import vectors as V


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_clean(spark):
    assert one(spark, T.clean, "a\r\nb​  c \t\n\n\n\nd\x07 ") == "a\nb c\n\nd"
    assert one(spark, T.clean, None) is None
    assert one(spark, T.clean, "") == ""


@pytest.mark.parametrize("text, want", [("the cat and the dog", "en"), ("il gatto e la casa", "it"), ("der Hund und die Katze", "de"), ("zzz", None), ("", None), (None, None)])
def test_language(spark, text, want):
    assert one(spark, T.language_vote, text) == want


@pytest.mark.parametrize("text", ["", "  ", "word", "two words", "a b c", "x" * 1000, "word " * 300])
def test_token_count_agrees(spark, text):
    if " " not in text:
        assert one(spark, T.token_count, text) == T.count_tokens(text)
    if text.strip():
        cut = one(spark, lambda c: T.truncate_tokens(c, 20), text)
        assert T.count_tokens(cut) <= 20 and text.startswith(cut)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to john.doe@example.com please", "Write to [EMAIL] please"),
        ("write to user@exämple.com please", "write to [EMAIL] please"),
        ("card 4111 1111 1111 1111 ok", "card [CREDIT_CARD] ok"),
        ("card 4111.1111.1111.1111 ok", "card [CREDIT_CARD] ok"),
        ("card 4111 1111 1111 1111 ok", "card [CREDIT_CARD] ok"),
        ("IBAN DE89370400440532013000 here", "IBAN [IBAN] here"),
        ("IBAN DE89 3704 0044 0532 0130 00 here", "IBAN [IBAN] here"),
        ("CF RSSMRA85T10A562S done", "CF [CODICE_FISCALE] done"),
        ("call +39 02 1234 5678 now", "call [PHONE] now"),
        ("from 2024-01-02 to 2024-02-03", "from 2024-01-02 to 2024-02-03"),
        ("ISBN 978-0-13-468599-1", "ISBN 978-0-13-468599-1"),
        ("", ""),
    ],
)
def test_redact(text, want):
    assert T.redact(text)[0] == want


def test_redact_column_and_tokens(spark):
    got = spark.createDataFrame([("a@b.example and a@b.example",), (None,), ("",)], "x string").select(T.redacted(F.col("x"), tokens=True).alias("r")).collect()
    words = got[0]["r"]["text"].split(" and ")
    assert words[0] == words[1] and words[0].startswith("[EMAIL:") and got[0]["r"]["counts"] == {"email": 2}
    assert got[1]["r"]["text"] is None and got[2]["r"]["text"] == ""


def test_redact_is_linear():
    import time

    began = time.time()
    T.redact("a@" + "x." * 30_000)
    assert time.time() - began < 2


def test_render_fills_once(spark):
    row = spark.createDataFrame([("see {question}", "why?")], "c string, q string").select(T.render("C {context} Q {question}", F.col("c"), F.col("q"))).first()
    assert row[0] == "C see {question} Q why?"


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.score("l2", F.col("a"), F.col("a")), V.int8(F.col("b")), V.sign_bits(F.col("a"))).first()
    assert row[0] == 1.0 and row[1] == 0.0 and row[2] == 1.0 and row[3] == [127, 127] and row[4] == 2
    with pytest.raises(ValueError):
        V.score("manhattan", F.col("a"), F.col("b"))


def test_filters(spark):
    rows = spark.createDataFrame([("a", '{"env":"prod","n":1}'), ("b", '{"env":"dev","n":2020}'), ("c", "{}"), ("d", None), ("e", "{cut"), ("f", '{"env":null,"n":1.5}'), ("g", '{"n":"1"}')], "id string, m string")

    def ids(conditions):
        return "".join(sorted(r.id for r in rows.where(FL.matches(F.col("m"), conditions)).collect()))

    assert ids({}) == "abcdefg"
    assert ids({"env": "prod"}) == "a"
    assert ids({"n": 1}) == "a"
    assert ids({"n": "1"}) == "g"
    assert ids({"n": 1.5}) == "f"
    assert ids({"env": None}) == "cdefg"
    assert ids({"env": ["prod", "dev"]}) == "ab"
    assert ids({"env": []}) == ""
    assert ids({"env": {"neq": "prod"}}) == "bcdefg"
    assert ids({"env": {"nin": ["prod", "dev"]}}) == "cdefg"
    assert ids({"n": {"gte": 2020}}) == "b"
    assert ids({"n": {"lt": 5}})[:4] == "acde"
    with pytest.raises(FL.UnknownOperator):
        FL.matches(F.col("m"), {"n": {"like": 1}})
    assert FL.scoped({"tenant_id": "b"}, "a") == {"tenant_id": "a"}
