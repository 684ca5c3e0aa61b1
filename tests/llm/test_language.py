import json

import numpy as np
import pytest

from meridianlake.llm import language as L

SENTENCES = {
    "en": ["The reports were checked before the weekly review.", "Nobody in the office has signed the delivery note yet.", "We learned that the old manual explains the new rule."],
    "it": ["I rapporti sono stati controllati prima della revisione.", "Nessuno in ufficio ha firmato la nota di consegna.", "È emerso che il vecchio manuale spiega la nuova regola."],
    "de": ["Die Berichte wurden vor der wöchentlichen Durchsicht geprüft.", "Niemand im Büro hat den Lieferschein unterschrieben.", "Das alte Handbuch erklärt die neue Regel sehr genau."],
    "fr": ["Les rapports ont été contrôlés avant la revue hebdomadaire.", "Personne au bureau a signé le bon de livraison.", "Il faut noter que le vieux manuel explique la règle."],
    "es": ["Los informes fueron comprobados antes de la revisión semanal.", "Nadie en la oficina ha firmado el albarán de entrega.", "Resulta que el manual antiguo explica la norma nueva."],
}
COLUMNS = "id string, metadata string, content string, lang string"


def rows():
    out = []
    for lang, sentences in SENTENCES.items():
        for k in range(12):
            out.append((f"{lang}{k}", json.dumps({"language": lang.upper() if k % 2 else lang}), " ".join(sentences[k % 3 :] + sentences[: k % 3]), "clash"))
    out += [
        ("none", None, " ".join(SENTENCES["de"]), None), ("cut", '{"language":"de', " ".join(SENTENCES["de"]), None), ("wrong", '{"lang":"it-IT"}', " ".join(SENTENCES["fr"]), None),
        ("mixed", '{"doc":{"language":"English"}}', SENTENCES["en"][0] + " " + SENTENCES["it"][1] + " " + SENTENCES["it"][2] + " " + SENTENCES["en"][1], None),
        ("codes", "{}", "sku: 4363 | ref: 301.56 | code: XL-99\nsku: 1 | ref: 2 | code: XL-98", None), ("empty", "{}", "", None), ("null", "{}", None, None), ("blank", "{}", " \n ", None),
        ("long", "{}", " ".join(SENTENCES["es"] * 3000), None),
    ]
    return out + out[:5]


@pytest.fixture(scope="module")
def found(spark):
    got = L.detect_languages(spark.createDataFrame(rows(), COLUMNS)).collect()
    return {(r.id, r.seg): r for r in got}


def test_segments(found):
    def langs(key):
        return [found[k].lang for k in sorted(found) if k[0] == key]

    assert langs("none") == langs("cut") == ["de"] and langs("wrong") == ["fr"] and langs("long") == ["es"]
    assert langs("mixed") == ["en", "it", "en"]
    assert not any(k[0] in ("codes", "empty", "null", "blank") for k in found)
    assert all(langs(f"{lang}{k}") == [lang] for lang in SENTENCES for k in range(12))


def test_cases(found):
    assert {k[0] for k, r in found.items() if r.is_case} == {"none", "cut", "wrong", "mixed", "long"}
    assert all(0.5 < r.confidence <= 1 for r in found.values())


def test_offsets(found):
    text = dict((r[0], r[2]) for r in rows())["mixed"]
    part = found["mixed", 2]
    assert text[part.start : part.stop] == SENTENCES["it"][1] + " " + SENTENCES["it"][2]


def test_empty_table(spark):
    assert L.detect_languages(spark.createDataFrame([], COLUMNS)).count() == 0


def test_code():
    code = L.codewords(5)
    assert code.shape == (5, 15)
    assert min((code[a] != code[b]).sum() for a in range(5) for b in range(a)) == 8


@pytest.mark.parametrize("metadata, want", [('{"language":"en_US"}', "en"), ('{"lang":" Deutsch "}', "de"), ('{"doc":{"language":"español"}}', "es"), ('{"language":"und"}', None), ('{"language":""}', None), ("{", None), (None, None), ("[1]", None)])
def test_label(metadata, want):
    assert L.label_of(metadata) == want


def test_languages_are_those_of_the_labels(spark):
    """A language beyond the usual five is learned from its labels; a label on texts of all languages names none."""
    words = "pakken kommer klokken fire på lageret hver mandag og ingen har underskrevet følgeseddelen endnu fordi kontoret er lukket".split()
    danish = [" ".join(words[k % 7 :] + words[: k % 7]) + "." for k in range(12)]
    out = rows() + [(f"da{k}", json.dumps({"language": "da"}), t, None) for k, t in enumerate(danish)] + [("unlabelled", None, danish[3], None)]
    out += [(f"xx{k}", json.dumps({"language": "xx"}), " ".join(SENTENCES[lang]), None) for k, lang in enumerate(list(SENTENCES) * 2)]
    got = {(r.id, r.seg): r for r in L.detect_languages(spark.createDataFrame(out, COLUMNS)).collect()}
    assert got["unlabelled", 1].lang == "da" and got["unlabelled", 1].is_case and not got["da1", 1].is_case
    assert all(got[f"xx{k}", 1].lang == lang and got[f"xx{k}", 1].is_case and got[f"xx{k}", 1].label is None for k, lang in enumerate(list(SENTENCES) * 2))


def test_many_languages_have_codewords_far_apart():
    code = L.codewords(12)
    assert set(np.unique(code)) == {-1, 1} and min((code[a] != code[b]).sum() for a in range(12) for b in range(a)) >= 10


def test_rare_labels_fill_the_sample(spark):
    """The share of hashes is that of the labelled rows, not of all."""
    out = rows() + [(f"plain{k}", None, SENTENCES["en"][k % 3], None) for k in range(3000)]
    got = L.detect_languages(spark.createDataFrame(out, COLUMNS), sample_rows=60)
    assert {r.lang for r in got.where("id like 'plain%'").select("lang").distinct().collect()} == {"en"}


def test_an_id_with_two_contents_is_one_of_them(spark):
    out = rows() + [("twice", None, " ".join(SENTENCES["fr"]), None), ("twice", None, SENTENCES["en"][0] + " " + SENTENCES["de"][1], None)]
    got = {r.seg: r.lang for r in L.detect_languages(spark.createDataFrame(out, COLUMNS)).where("id = 'twice'").collect()}
    assert got in ({1: "fr"}, {1: "en", 2: "de"})


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_any_number_of_languages(spark, n):
    """Thresholds hold for codes of any length."""
    few = list(SENTENCES)[:n]
    out = [r for r in rows() if r[0].rstrip("0123456789") in few]
    got = {(r.id, r.seg): r.lang for r in L.detect_languages(spark.createDataFrame([*out, ("plain", None, " ".join(SENTENCES[few[-1]]), None)], COLUMNS)).collect()}
    assert got["plain", 1] == few[-1] and len(got) == 12 * n + 1
