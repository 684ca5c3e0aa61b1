from meridianlake.llm import scans as S

CLEAN = "The regional review describes the central namespace and the northern archive before the weekly meeting. The long-term plan and the up-to-date manual explain the second registry."
PAGE = """Acme Logistics | Annual Report      Page 3
The regional rcview describes the central names-
pace and the n0rthern archive before the weekly mee-

    [4]
ACME LOGISTICS

ting. The long-term plan and the up-
to-date manual exp1ain the second registry.
- 4 -"""


def chunks(spark, more=()):
    rows = [(f"c{k}", CLEAN) for k in range(30)] + [("p", PAGE), ("p", PAGE), ("n", None), ("e", ""), ("l", CLEAN * 500)] + list(more)
    return spark.createDataFrame(rows, "id string, content string")


def test_found(spark):
    got = {(r.kind, r.found) for r in S.found(chunks(spark)).collect()}
    assert got == {
        ("running", "Acme Logistics | Annual Report      Page 3"), ("running", "[4]"), ("running", "ACME LOGISTICS"), ("running", "- 4 -"),
        ("hyphenated", "namespace"), ("hyphenated", "meeting"), ("hyphenated", "up-to-date"), ("misread", "review"), ("misread", "northern"), ("misread", "explain"),
    }


def test_repaired(spark):
    got = {r.id: r.content for r in S.repaired(chunks(spark)).collect()}
    assert got["p"] == CLEAN and got["n"] is None and got["e"] == "" and got["c0"] == CLEAN and got["l"] == CLEAN * 500


def test_unknown_words_stay(spark):
    page = "The zorvex describes the central archive and the\nnorthern archive before the weekly meeting of all."
    assert S.found(chunks(spark, [("x", page)])).where("id = 'x'").count() == 0


def test_empty(spark):
    assert S.found(spark.createDataFrame([], "id string, content string")).count() == 0


def test_distance_and_strokes():
    assert S.distance("rnodern", "modern") == 0.2 and S.distance("cat", "cut") == 1 and S.distance("x", "x") == 0
    for seen, true in (("cornplete", "complete"), ("acc6s", "accès"), ("re†urn5", "returns"), ("ansvvers", "answers"), ("valiclates", "validates")):
        assert S.skeleton(seen) == S.skeleton(true)
    assert S.skeleton("carmot", True) == S.skeleton("cannot", True)


def test_remainders_meet():
    assert set(S.remainders("modern")) & set(S.remainders("rnodern"))
    assert set(S.remainders("interne")) & set(S.remainders("inteme"))


def test_every_look_alike_meets(spark):
    for true, seen in S.CONFUSIONS:
        for a, b in ((true, seen), (f"a{true}o", f"a{seen}o"), (true * 2, seen * 2), (f"{true}ent{true}", f"{seen}ent{seen}")):
            assert set(S.remainders(a)) & set(S.remainders(b)), (a, b)
    assert set(S.remainders("annorm")) & set(S.remainders("armorrn"))
    pairs = [("tlie", "the"), ("vvas", "was"), ("rnan", "man"), ("clay", "day"), ("bam", "barn"), ("rnode1", "model"), ("rnernory", "memory"), ("cornrnunicatiori", "communication")]
    rows = [("word", seen, 0, 1) for seen, _ in pairs] + [("word", true, 9, 2) for _, true in pairs] + [("word", "thc", 0, 1), ("word", "zorvex", 0, 3)]
    got = {(r.word, r.candidate) for r in S.candidates(spark.createDataFrame(rows, "kind string, word string, typed long, paged long")).collect()}
    assert got == {*pairs, ("thc", "the")}


def test_nothing_is_lost(spark):
    """Words divided over three lines and at the end of a page keep all of their parts."""
    page = "The weekly meeting of all describes the inter-\nnatio-\nnal archive and the northern manual before the con-"
    rows = [(f"c{k}", CLEAN + " international") for k in range(9)] + [("x", page)]
    chunks_ = spark.createDataFrame(rows, "id string, content string")
    got = {r.id: r.content for r in S.repaired(chunks_).collect()}
    assert got["x"] == "The weekly meeting of all describes the international archive and the northern manual before the con-"
    assert {(r.kind, r.found) for r in S.found(chunks_).where("id = 'x'").collect()} == {("hyphenated", "international")}


def test_other_misreadings_by_context(spark):
    """A word that is no look-alike of another is repaired beside neighbours that typed texts know, and nowhere else."""
    typed = [(f"t{k}", "They sold the old house near the river before the winter came.") for k in range(50)]
    right = ("r", "They said that nobody has sold the old hause near the\nriver before the winter came and that all was well.")
    wrong = ("w", "They said that nobody has seen any hause beside the\nriver before the winter came and that all was well.")
    got = {(r.id, r.kind, r.found) for r in S.found(spark.createDataFrame([*typed, right, wrong], "id string, content string")).collect()}
    assert got == {("r", "misread", "house")}


def test_frequent_confusions_become_cheap():
    costs = {("x", "k"): 0.3}
    assert S.distance("boox", "book", costs) == 0.3 and S.distance("booz", "book", costs) == 1


def test_long_words_and_their_index(spark):
    long_ = "donaudampfschifffahrtsgesellschaftskapitaensmuetze"
    seen = long_.replace("m", "rn")
    rows = [("word", seen, 0, 1), ("word", long_, 9, 0)]
    got = [(r.word, r.candidate) for r in S.candidates(spark.createDataFrame(rows, "kind string, word string, typed long, paged long")).collect()]
    assert got == [(seen, long_)] and set(S.remainders("hause")) & set(S.remainders("house")) and not set(S.remainders("cat")) & set(S.remainders("cut"))
