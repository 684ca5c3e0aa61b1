import json

import pytest

from meridianlake.llm import personal as P


def kinds(text):
    items, _ = P.structured(text)
    return sorted((k, P.BLANKS.sub(" ", text[a:b])) for a, b, k in items)


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to a.b+c@mail.example.org now", [("email", "a.b+c@mail.example.org")]),
        ("write to a.b [at] mail [dot] example [dot] org now", [("email", "a.b [at] mail [dot] example [dot] org")]),
        ("use a_b(at)büro.example or A @ b.test", [("email", "A @ b.test"), ("email", "a_b(at)büro.example")]),
        ("ring 0113 496 0734 ext. 72 today", [("phone", "0113 496 0734 ext. 72")]),
        ("ring +49 (0)30 23125-571, (415) 555-0150 or 040/66969930", [("phone", "(415) 555-0150"), ("phone", "+49 (0)30 23125-571"), ("phone", "040/66969930")]),
        ("call 900-008-115", [("phone", "900-008-115")]),
        ("to DE89 3704 0044 0532 0130 00 as agreed", [("id_number", "DE89 3704 0044 0532 0130 00")]),
        ("to de89370400440532013000 desde hace", [("id_number", "de89370400440532013000")]),
        ("to DE88 3704 0044 0532 0130 00 as agreed", []),
        ("card 4111 1111 1111 1111, card 4111 1111 1111 1112", [("id_number", "4111 1111 1111 1111")]),
        ("CF RSSMRA85T10A562S and RSSMRA85T10A562T", [("id_number", "RSSMRA85T10A562S")]),
        ("DNI 12345678Z and 12345678A", [("id_number", "12345678Z")]),
        ("number 964-51-9284 or 932 92 9039", [("id_number", "932 92 9039"), ("id_number", "964-51-9284")]),
        ("order 2024-1188663, batch 77-936-2, version 10.4.113.118 on 2025-03-14 at 08:30", []),
        ("goes to 84A Harrow Bend, Eastmere XQ2 3TX and not", [("address", "84A Harrow Bend, Eastmere XQ2 3TX")]),
        ("goes to 131A Foundry Row and not", [("address", "131A Foundry Row")]),
        ("in Vicolo del Grifo, 95 insieme; Via Caldarossa n. 57, 13697 Ravigatti", [("address", "Via Caldarossa n. 57, 13697 Ravigatti"), ("address", "Vicolo del Grifo, 95")]),
        ("an Rodelacker Str. 234, 74367 Haldbrück und Kesselbrinkstraße 76a, Am Traufgraben 88, 16931 Haldbrück", [("address", "Am Traufgraben 88, 16931 Haldbrück"), ("address", "Kesselbrinkstraße 76a"), ("address", "Rodelacker Str. 234, 74367 Haldbrück")]),
        ("Auf Seite 25 und Im Abschnitt 3 steht nichts", []),
        ("a C/ Zargorri 161, 71889 Olmeseda y no; Calle Almanzano, 113 y no", [("address", "C/ Zargorri 161, 71889 Olmeseda"), ("address", "Calle Almanzano, 113")]),
        ("au 69 bis chemin du Beaumoret, 57695 Montagnac-le-Vieux avec", [("address", "69 bis chemin du Beaumoret, 57695 Montagnac-le-Vieux")]),
        ("", []),
        ("[EMAIL] and [PHONE]", []),
    ],
)
def test_forms(text, want):
    assert kinds(text) == want


BLANK = ["\u00a0", "\u202f", " "]


@pytest.mark.parametrize("before, after", [("at ", "."), ("(", ")"), ("at ", ";"), ("\u201c", "\u201d"), ("at ", "")])
@pytest.mark.parametrize("street", ["12 Mill Road", "Lindenstraße 5", "Kantstr. 7", "Poststrasse 3", "Domring 9", "Nordufer 4", "Burgdamm 8", "Waldsteig 2", "Rossmarkt 6", "An dem Tor 3", "Hinter den Linden 4", "Via Roma 3", "C/ Mayor 4", "Avda. Norte 5", "3 bd. Voltaire", "4 av. Foch", "5 rue Monge"])
def test_streets_with_any_blank_and_mark(street, before, after):
    for blank in [*(b for b in BLANK if b in P._S), "\n"]:
        text = before + street.replace(" ", blank) + after
        assert kinds(text) == [("address", street)], text


@pytest.mark.parametrize("mail", ["ab ( at ) site.com", "ab [ AT ] site.com", "ab(at)site.com", "ab at site dot com", "ab at site DOT com", "ab AT site DOT com", "ab[at]site [ DOT ] com", "ab at site(dot)com", "ab @ site.com"])
def test_spelled_mail_with_any_blank(mail):
    for blank in (b for b in BLANK if b in P.SPACE):
        assert kinds("to " + mail.replace(" ", blank)) == [("email", mail)]


def test_numbers_with_any_separator():
    for blank in (b for b in BLANK if b in P.SPACE):
        for number in ("GB29 NWBK 6016 1331 9268 19", "MT31 MALT 0110 0001 2345 MTLC AST0 01S"):
            if P.iban_ok(number):
                assert kinds("to " + number.replace(" ", blank)) == [("id_number", number)]
    flat = next(f"XX{k:02d}A1B2C3D4E5F6" for k in range(2, 99) if P.iban_ok(f"XX{k:02d}A1B2C3D4E5F6"))
    assert kinds(f"to {flat}.") == [("id_number", flat)]


def test_numbers_as_whole_values(spark):
    dni = next(f"{n}{P.DNI_LETTERS[n % 23]}" for n in range(12345678, 12345778) if P.DNI_LETTERS[n % 23] in "ABCDEF")
    uuid, digest = "12345678-1234-1234-1234-123456789012", "06123456789"
    held = {"contact": "06123456789", "note": ["4111111111111111", dni], "chunk_id": digest, "document_id": uuid, "checksum": "4111111111111111", "other": uuid}
    df = spark.createDataFrame([("a", "no item", json.dumps(held))], "id string, content string, metadata string")
    assert {(r.field, r.kind, r.found) for r in P.found(df).collect()} == {("metadata", "phone", "06123456789"), ("metadata", "id_number", "4111111111111111"), ("metadata", "id_number", dni)}
    assert json.loads(P.sanitise(df).collect()[0].metadata) == held | {"contact": "[PHONE]", "note": ["[ID_NUMBER]", "[ID_NUMBER]"]}


def rows():
    names = ["Keith Harrowham", "Nora Dunstmere", "Alice Pembwick", "Marco Bellaschi", "Jürgen von Wiesenrieder", "Susan O'Merriby"]
    out = []
    for k in range(60):
        name = names[k % 6]
        given, *rest = name.split()
        local = f"{given}.{rest[-1].replace(chr(39), '')}".lower().replace("ü", "ue")
        out.append((f"r{k}", f"The request of {name} was filed. Write to {local}@mail.example before Friday.", json.dumps({"author": name, "n": k}), "x"))
    out += [(f"f{k}", "The quiet archive of the northern branch holds many letters from the Library Trust.", None, "x") for k in range(200)]
    out += [("inv", "Together with Dunstmere, Nora in the morning; DR. ALICE PEMBWICK signed, then M. Bellaschi and Marco De Bellaschi.", "{cut off", "x"), ("nul", None, None, None), ("emp", "", "{}", None), ("big", "The plain text goes on. " * 5000, None, None)]
    return out + out[:3]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(rows(), "id string, content string, metadata string, kind string").cache()


def test_found(chunks):
    got = {}
    for r in P.found(chunks).collect():
        got.setdefault(r.id, set()).add((r.field, r.kind, r.found))
    assert got["r0"] == {("content", "name", "Keith Harrowham"), ("content", "email", "keith.harrowham@mail.example"), ("metadata", "name", "Keith Harrowham")}
    assert ("content", "name", "Jürgen von Wiesenrieder") in got["r4"] and ("content", "name", "Susan O'Merriby") in got["r5"]
    assert got["inv"] == {("content", "name", x) for x in ("Dunstmere, Nora", "ALICE PEMBWICK", "M. Bellaschi", "Marco De Bellaschi")}
    assert not {"f0", "nul", "emp", "big"} & set(got)


def test_sanitised(chunks):
    got = {r.id: r for r in P.sanitise(chunks).collect()}
    assert got["r0"].content == "The request of [NAME] was filed. Write to [EMAIL] before Friday."
    assert json.loads(got["r0"].metadata) == {"author": "[NAME]", "n": 0}
    assert got["f0"].content.startswith("The quiet archive") and got["nul"].content is None and got["emp"].metadata == "{}"
    assert len(got) == len({r[0] for r in rows()})


def test_empty(spark):
    assert P.found(spark.createDataFrame([], "id string, content string, metadata string")).count() == 0


def test_every_item_has_its_telling_term(chunks):
    got = P.items(chunks).collect()
    assert {r.kind for r in got} == {"email", "name"} and all(r.term and 0.5 <= r.score for r in got)
    assert {r.term for r in got if r.found == "Keith Harrowham"} <= {"keith", "harrowham"}


def test_a_form_that_mostly_fails_is_told_by_the_word_before(spark):
    """Numbers of one shape: among order numbers it says little, after words that stand before valid numbers it does."""
    good = next(f"{k:016d}" for k in range(4000000000000000, 4000000000000100) if P.luhn(f"{k:016d}"))
    rows = [(f"o{k}", f"order {4 * 10**15 + 10**6 + k} is on its way and the plain text goes on for a while", None) for k in range(300) if not P.luhn(str(4 * 10**15 + 10**6 + k))]
    by_chance = ("x", f"order {good} is on its way", None)
    cards = [(f"c{k}", f"paid by visa {good} today", None) for k in range(3)]
    got = {(r.id, r.term) for r in P.items(spark.createDataFrame([*rows, by_chance, *cards], "id string, content string, metadata string"), threshold=0.8).collect()}
    assert got == {(f"c{k}", "visa") for k in range(3)}


def test_an_initial_needs_a_name_that_stands_beside_names(spark, chunks):
    more = [("j", "We asked J. Zorvex and K. Harrowham about the plan.", None, None), ("k", "Here came Keith Wexmore and Nora Wexmore, then T. Wexmore.", None, None)]
    got = {}
    for r in P.found(chunks.unionByName(spark.createDataFrame(more, "id string, content string, metadata string, kind string"))).where("id in ('j', 'k')").collect():
        got.setdefault(r.id, set()).add(r.found)
    assert got == {"j": {"K. Harrowham"}, "k": {"Keith Wexmore", "Nora Wexmore", "T. Wexmore"}}


def test_long_names_are_whole(spark, chunks):
    long_ = "Keith Marco Nora Alice Susan Harrowham Pembwick"
    got = P.found(chunks.unionByName(spark.createDataFrame([("l", f"It was {long_} who came.", None, None)], "id string, content string, metadata string, kind string"))).where("id = 'l'").collect()
    assert [r.found for r in got] == [long_]
