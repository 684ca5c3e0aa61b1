"""Personal items in free text and JSON values, replaced by typed placeholders.

Protected entities are the persons whom the corpus names, with their mail addresses, telephone and identity numbers and street
addresses. The corpus tells by co-occurrence how much a term reveals of them: the disclosure of a term is its pointwise mutual
information with an entity kind, as a share of the information of the kind itself (1: who reads the term knows the kind).
Forms with their check digits are the seeds of mail addresses, numbers and street addresses; their terms are the shape of an
item and the word before it, which also stand on spans that fail their check and in plain text. Persons are seeded by the local
parts of mail addresses; the terms of a name are its words, which also co-occur with each other in runs of capitalised words. An
item whose most telling term reaches the threshold is generalised to its kind: a placeholder takes its place.

One map-only pass over the texts finds spans, runs and counts. Only these are shuffled, never texts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

SPACE = r"[    ]"
_AT = rf"(?:{SPACE}?@{SPACE}?|{SPACE}?[\(\[]{SPACE}?(?:at|AT){SPACE}?[\)\]]{SPACE}?|{SPACE}(?:at|AT){SPACE})"
_DOT = rf"(?:\.|{SPACE}?[\(\[]{SPACE}?(?:dot|DOT){SPACE}?[\)\]]{SPACE}?|{SPACE}(?:dot|DOT){SPACE})"
EMAIL = re.compile(rf"[\w%+'](?:[\w.%+'\-]*[\w+])?{_AT}[^\W_](?:[\w\-]{{0,62}}(?<![_\-]))?(?:{_DOT}[^\W_](?:[\w\-]{{0,62}}(?<![_\-]))?)+")
IBAN = re.compile(rf"(?<![^\W_])[A-Za-z]{{2}}\d{{2}}(?:{SPACE}?[A-Za-z0-9]{{4}}){{2,7}}(?:{SPACE}?[A-Za-z0-9]{{1,3}})?(?![^\W_])")
FISCAL = re.compile(r"(?<![^\W_])[A-Za-z]{6}\d{2}[A-Za-z]\d{2}[A-Za-z]\d{3}[A-Za-z](?![^\W_])")
CARD = re.compile(r"(?<![\w.\-])\d{4}([   .\-]?)\d{4}\1\d{4}\1\d{1,7}(?![\w\-])|(?<![\w.\-])3[47]\d{2}([  .\-]?)\d{6}\2\d{5}(?![\w\-])")
DNI = re.compile(rf"(?<![\w.\-])(?:[XYZxyz][ \-]?\d{{7}}|\d{{2}}\.?\d{{3}}\.?\d{{3}})[  \-]?[A-Za-z](?![^\W_])")
SOCIAL = re.compile(r"(?<![\w.\-/])\d{3}([-  .])\d{2}\1\d{4}(?![\w\-/])")
PHONE = re.compile(rf"(?<![\w.\-/+])(?:\+\d{{1,3}}|00\d{{2}}|0|\(\d{{2,5}}\)|1[-.\s](?=\d{{3}}[-.\s]))(?:{SPACE}?[\-./]?{SPACE}?(?:\(0?\d{{0,5}}\)|\d)){{5,14}}(?:,?{SPACE}?(?:ext\.?|extension|Durchwahl|DW|int\.|interno|poste|x){SPACE}?\d{{1,6}})?(?![\w]|-\d)")

PHONE_PLAIN = re.compile(r"(?<![\w.\-/+])[6-9]\d{2}([  .\-])(?:\d{3}\1\d{3}|\d{2}\1\d{2}\1\d{2})(?![\w]|[.\-]\d)")
_TOWN = r"[A-ZÀ-Ý][\w'’]*(?:[  \-\n](?:[A-ZÀ-Ý][\w'’]*|le|la|les|de|del|della|di|sur|en|am|an der|im|lès|sous)(?![\w'’]))*"
_S = r"[  \n]"
# Words that name kinds of streets.
_EN = "Road|Street|Lane|Avenue|Row|Bend|Close|Drive|Way|Court|Place|Square|Terrace|Crescent|Hill|Walk|Gardens|Grove|Park|Mews|Parade|Rise|Green|Boulevard"
_IT = "Via|Viale|Corso|Vicolo|Piazza|Piazzale|Largo|Strada|Contrada|Salita|Lungomare|Borgo"
_ES = "Calle|C/|Plaza|Avenida|Avda\\.|Paseo|Camino|Carretera|Ronda|Travesía|Glorieta"
_FR = "rue|avenue|av\\.|boulevard|bd\\.?|bld|place|allée|impasse|chemin|quai|cours|route|square|passage|sentier|ruelle"
_DE_NOT = "Abschnitt|Seite|Kapitel|Absatz|Zimmer|Raum|Jahr|Fall|Punkt|Teil|Band|Blatt|Bild|Artikel|Anhang|Schritt|Protokoll|Monat|Quartal"
_CODE_TOWN = rf"(?:,?{_S}\d{{5}}{_S}{_TOWN})?"
_NAMES = r"(?:(?:dei|del|della|delle|degli|di|de|las|los|la|el)[  \n])*[A-ZÀ-Ý][\w'’]*(?:[  \n](?:(?:dei|del|della|di|de|la|las|los|e|y)[  \n])*[A-ZÀ-Ý][\w'’]*)*"
ADDRESSES = [
    re.compile(rf"(?<![\w\-/.])\d{{1,4}}[A-Za-z]?,?{_S}(?:[A-ZÀ-Ý][\w'’]*{_S}){{1,3}}(?:{_EN})(?![\w])(?:,?{_S}(?:Flat|Apartment|Apt\.?|Unit|Suite|Floor){_S}\d{{1,4}}[A-Za-z]?)?(?:,?{_S}(?:[A-ZÀ-Ý][\w'’]*{_S}){{1,3}}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_S}\d[A-Z]{{2}}(?!\w)|,{_S}[A-ZÀ-Ý][a-zà-ÿ'’]+(?:{_S}[A-ZÀ-Ý][a-zà-ÿ'’]+)*)?"),
    re.compile(rf"(?<![\w])(?:(?:Am|Im|Zum|Zur|(?:An|In|Auf|Hinter|Unter){_S}(?:der|dem|den)){_S}(?!(?:{_DE_NOT})(?!\w))[A-ZÄÖÜ][\wäöüß]+|(?:[A-ZÄÖÜ][\wäöüß\-]+{_S})?(?:[A-ZÄÖÜ][\wäöüß\-]*(?:straße|strasse|str\.|gasse|allee|weg|platz|damm|ufer|ring|steig|graben|markt)|(?:Straße|Strasse|Str\.|Gasse|Allee|Weg|Platz|Damm|Ring)(?!\w))){_S}\d{{1,4}}(?:[a-zA-Z](?!\w))?(?!\w){_CODE_TOWN}"),
    re.compile(rf"(?<![\w])(?:{_IT}){_S}{_NAMES}(?:,?{_S}(?:n\.?°?{_S}?|nr\.{_S}?|n°{_S}?)?|{_S}n\.{_S})\d{{1,4}}(?:/?[a-zA-Z](?!\w))?(?!\w){_CODE_TOWN}"),
    re.compile(rf"(?<![\w])(?:{_ES}){_S}{_NAMES}(?:,?{_S}(?:n\.?[ºo°]?{_S}?|nº{_S}?|núm\.{_S}?)?)\d{{1,4}}(?:[a-zA-Z](?!\w))?(?!\w){_CODE_TOWN}"),
    re.compile(rf"(?<![\w\-/.])\d{{1,4}}(?:{_S}?(?:bis|ter|quater|[A-Ca-c](?!\w)))?,?{_S}(?:{_FR}){_S}(?:(?:du|de|des|de la|de l['’]|d['’]|la|le|les){_S}?)*[A-ZÀ-Ý][\w'’\-]*(?:[  \n](?:(?:du|de|des|la|le){_S})*[A-ZÀ-Ý][\w'’\-]*)*{_CODE_TOWN}"),
]

# What any mail address, number of a person and street holds: told before the patterns proper are tried. Each takes in all that
# its patterns accept.
MAILY = re.compile(r"@|[(\[]\s?(?:at|AT|dot|DOT)\s?[)\]]|\s(?:dot|DOT)\s")
NUMBERY = re.compile(r"\d[\d\s().\-/]{4,}\d|\d{2}[A-Za-z]\d{2}[A-Za-z]\d{3}|[A-Za-z]{2}\d{2}(?:\s?[A-Za-z0-9]{4}){2}")
DIGIT = re.compile(r"\d")
TERM = re.compile(r"\w+")
STREET_WORDS = frozenset(TERM.findall(re.sub(r"\\\.\??", "", f"{_EN}|{_IT}|{_ES.replace('C/|', '')}|{_FR}")))
STREETY = re.compile(r"(?<!\w)C/\s|(?:(?i:straße|strasse|str\.|gasse|allee|weg|platz|damm|ring)|ufer|steig|graben|markt)\s\d|(?<!\w)(?:Am|Im|Zum|Zur|(?:An|In|Auf|Hinter|Unter)\s(?:der|dem|den))\s[A-ZÄÖÜ]\w+\s\d")


def may_hold_street(text: str) -> bool:
    if not DIGIT.search(text):
        return False
    return not STREET_WORDS.isdisjoint(TERM.findall(text)) or bool(STREETY.search(text))


_CAP = r"(?:[OD]['’])?[A-ZÀ-Ý][\w]*(?:['’][\w]+)?(?:-[A-ZÀ-Ý][\w]*)*"
_PART = r"(?:von der|von dem|van der|van den|de la|de los|von|van|zu|zum|zur|de|di|da|del|della|dal|dalla|du|des|le|la|Von|Van|Di|De|Del|Della|VON|VAN|DI|DE|DEL|DELLA|DU|LA|LE)"
TOKEN = re.compile(rf"(?<![\w'’\-.@])(?:(?P<initial>[A-ZÀ-Ý]\.(?:[  ]?\-?[A-ZÀ-Ý]\.)*)|(?P<cap>{_CAP})(?![\w@]))")
LINK = re.compile(rf"(?:[  \n]+|(?P<comma>,[  \n]+))(?:(?P<part>{_PART})[  \n]+)?$")

PARTICLE = re.compile(_PART)
LEAD = re.compile(rf"(?<![\w'’])({_PART})[  \n]+$")

ODD = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)))  # fixed values of the Italian fiscal code
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    flat = re.sub(r"\s", "", text).upper()
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def fiscal_ok(text: str) -> bool:
    t = text.upper()
    even = {c: int(c, 36) - 10 * (c > "9") for c in ODD}
    return chr(65 + sum(ODD[c] if k % 2 == 0 else even[c] for k, c in enumerate(t[:15])) % 26) == t[15]


def dni_ok(text: str) -> bool:
    t = re.sub(r"[^0-9A-Za-z]", "", text).upper()
    number = str("XYZ".index(t[0])) + t[1:-1] if t[0] in "XYZ" else t[:-1]
    return number.isdigit() and DNI_LETTERS[int(number) % 23] == t[-1]


def term(word: str) -> str:
    """Form in which a word of a name is counted: lower case, without accents, umlauts spelled out, letters only."""
    w = word.lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")
    w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    return re.sub(r"[^a-z]", "", w)


def structured(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Items with a form of their own, and further spans that look like one but fail their check; none overlap."""
    items: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, kind: str | None) -> None:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            if kind:
                items.append((a, b, kind))

    if MAILY.search(text):
        for m in EMAIL.finditer(text):
            spelled = "@" not in m[0]
            if not spelled or re.search(rf"[\(\[]|{SPACE}(?:dot|DOT){SPACE}", m[0]):
                add(m.start(), m.end(), "email")
    if NUMBERY.search(text):
        numbers(text, add)
    if may_hold_street(text):
        for pattern in ADDRESSES:
            for m in pattern.finditer(text):
                add(m.start(), m.end(), "address")
    return items, taken


def numbers(text: str, add) -> None:
    """Identity and telephone numbers of a text, the stricter forms first."""
    for m in FISCAL.finditer(text):
        add(m.start(), m.end(), "id_number" if fiscal_ok(m[0]) else None)
    for m in IBAN.finditer(text):
        whole = m[0]
        # A number may be followed by a short word that looks like its last group: the longest right part counts.
        while whole and not iban_ok(whole) and re.search(rf"{SPACE}[A-Za-z0-9]{{1,7}}$", whole):
            whole = re.sub(rf"{SPACE}[A-Za-z0-9]{{1,7}}$", "", whole)
        if whole and iban_ok(whole):
            add(m.start(), m.start() + len(whole), "id_number")
        elif sum(c.isdigit() for c in m[0]) >= 10:
            add(m.start(), m.end(), None)
    for m in CARD.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        add(m.start(), m.end(), "id_number" if 13 <= len(digits) <= 19 and luhn(digits) else None)
    for m in DNI.finditer(text):
        add(m.start(), m.end(), "id_number" if dni_ok(m[0]) else None)
    for m in SOCIAL.finditer(text):
        add(m.start(), m.end(), "id_number")
    for m in PHONE.finditer(text):
        digits = re.sub(r"\D", "", re.split(r"(?i)ext|durch|dw|int|poste|x", m[0])[0])
        if 8 <= len(digits) <= 15:
            add(m.start(), m.end(), "phone")
    for m in PHONE_PLAIN.finditer(text):
        add(m.start(), m.end(), "phone")


def runs(text: str, taken: list[tuple[int, int]]) -> list[list[tuple[int, int, str, str]]]:
    """Runs of neighbouring capitalised words and initials outside the taken spans: (start, end, role, link before)."""
    out, run, last = [], [], -1
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if taken and any(a < y and b > x for x, y in taken):
            continue
        if m["cap"] and PARTICLE.fullmatch(m["cap"]):
            continue
        role = "initial" if m["initial"] or b - a == 1 else "word"
        link = None
        if run and last >= 0:
            between = text[last:a]
            if between.strip("  \n") == "" and between:
                link = " "
            elif len(between) < 14 and (k := LINK.match(between)):
                link = "," if k["comma"] else "part"
        if link is None:
            if len(run) > 1 and run[-2][2] != "lead":
                out.append(run)
            lead = LEAD.search(text, max(0, a - 14), a)
            run = [(lead.start(1), lead.end(1), "lead", "")] if lead else []
            link = ""
        run.append((a, b, role, link))
        last = b
    if len(run) > 1 and run[-2][2] != "lead":
        out.append(run)
    return out


def parts(word: str) -> list[str]:
    """Terms of a capitalised word: the whole and, for double names, its halves."""
    whole = term(word)
    halves = [term(x) for x in word.split("-")] if "-" in word else []
    if re.match(r"[OD]['’]", word):
        halves = halves or [term(word[2:])]
    return [whole, *[h for h in halves if h]]


# Words of organisations, which no name holds.
ORGANISATION = frozenset("logistics library trust works institute holdings services foundry cooperative mutual instruments group labs office gmbh ag srl spa ltd inc bank society press university street road lane".split())


def names_in(text: str, run: list[tuple[int, int, str, str]], score) -> list[tuple[int, int]]:
    """Spans of names in a run. score(word) is 2 for a protected term, 1 for one that stands beside such terms, 0 for any other."""
    marks = [(1 if role == "initial" else 0, score(text[a:b]) if role == "word" else 0) for a, b, role, _ in run]
    found, i = [], 0
    while i < len(run):
        if not (marks[i][0] or marks[i][1]):
            i += 1
            continue
        j = i
        while j + 1 < len(run) and (marks[j + 1][0] or marks[j + 1][1]) and not (run[j + 1][3] == "," and (j > i or marks[i][0] or marks[j + 1] == (0, 1))):
            j += 1
        span = list(range(i, j + 1))
        while span and marks[span[-1]][0] and run[span[-1]][3] != " ":
            span.pop()
        words = [k for k in span if not marks[k][0]]
        if len(span) >= 2 and words and (any(marks[k][1] == 2 for k in words) or marks[span[0]][0] and len(words) == 1):
            if not any(term(text[run[k][0] : run[k][1]]) in ORGANISATION for k in words) and not (j + 1 < len(run) and run[j + 1][3] == " " and term(text[run[j + 1][0] : run[j + 1][1]]) in ORGANISATION):
                # An initial that ends a name keeps its point, as it stands.
                first = 0 if span[0] == 1 and run[0][2] == "lead" and any(run[k][3] == "," for k in span) else span[0]
                found.append((run[first][0], run[span[-1]][1]))
        i = j + 1
    return found


# Keys whose hexadecimal values name chunks, documents and contents, and the form of other such values.
ID_KEYS = frozenset(("chunk_id", "document_id", "checksum"))
HEXADECIMAL = re.compile(r"[0-9a-fA-F]{8,}(?:-[0-9a-fA-F]{4,}){0,4}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def is_id(path: tuple, text: str) -> bool:
    key = next((k for k in reversed(path) if isinstance(k, str)), None)
    return bool(UUID.fullmatch(text) or key in ID_KEYS and HEXADECIMAL.fullmatch(text))


def values_of(metadata: str | None):
    """(path, text) of every string in the JSON object but ids; the raw text where it can't be read."""
    if not metadata:
        return
    try:
        obj = json.loads(metadata)
        if isinstance(obj, str):
            obj = json.loads(obj)
    except ValueError:
        yield (), metadata
        return
    stack = [((), obj)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, str):
            if not is_id(path, x):
                yield path, x
        elif isinstance(x, dict):
            stack += [((*path, k), v) for k, v in x.items()]
        elif isinstance(x, list):
            stack += [((*path, k), v) for k, v in enumerate(x)]


def fields(content, metadata):
    if isinstance(content, str) and content:
        yield "content", "", content
    if isinstance(metadata, str):
        for path, text in values_of(metadata):
            yield "metadata", json.dumps(path), text


def _rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(*(F.col(c).cast("string").alias(c) for c in ("id", "content", "metadata"))).where(F.col("id").isNotNull())


RAW = "id string, field string, path string, start long, stop long, kind string, found string, text string, run string, terms array<string>, n long"
COLUMNS = ["id", "field", "path", "start", "stop", "kind", "found", "text", "run", "terms", "n"]
BLANKS = re.compile(r"\s+")
SHAPE = re.compile(r"\d+|[^\W\d_]+")
BEFORE = re.compile(r"([^\W\d_]+)[^\w\n]{0,3}$")


def shape(kind: str, text: str) -> str:
    """What a span looks like: of numbers the length of each run of digits, else 9 for digits, A and a for capitalised and other words, however many there are of each."""
    numeric = kind not in ("email", "address")
    flat = SHAPE.sub(lambda m: (f"9{len(m[0])}" if numeric else "9") if m[0][0].isdigit() else "a" if kind == "email" or m[0].islower() else "A", text)
    flat = BLANKS.sub(" ", flat)
    return "=" + (flat if numeric else re.sub(r"(\S+?)(?:\s?\1)+", r"\1", flat))


def mail_terms(address: str) -> list[str]:
    local = re.split(_AT, address, maxsplit=1)[0].split("+")[0]
    return [t for t in (term(x) for x in re.split(r"[._\-\d]+", local)) if len(t) > 2]


def spans(chunks: DataFrame) -> DataFrame:
    """What one pass over the texts finds, by `kind`: items by their form, `other` spans that fail their check, `run`s of
    capitalised words, and under `#` counts of a term (found): in mail addresses (start), capitalised (stop) and lower-case (n)."""

    def run(frames):
        mail, text_, lower = Counter(), Counter(), Counter()
        for pdf in frames:
            got = []
            for key, content, metadata in zip(pdf["id"], pdf["content"], pdf["metadata"]):
                for field, path, text in fields(content, metadata):
                    found, taken = structured(text)
                    plain = text
                    if taken:
                        kinds = {(a, b): kind for a, b, kind in found}
                        for a, b in taken:
                            kind = kinds.get((a, b), "other")
                            if kind == "email":
                                mail.update(mail_terms(text[a:b]))
                            cue = BEFORE.search(text, max(0, a - 30), a)
                            terms = [shape(kind, text[a:b]), *([cue[1].lower()] if cue else [])]
                            got.append((key, field, path, a, b, kind, BLANKS.sub(" ", text[a:b]), None, None, terms, None))
                            plain = plain[:a] + " " * (b - a) + plain[b:]
                    words = WORDS.findall(plain)
                    lower.update(filter(str.islower, words))
                    text_.update(w for w in words if not w.islower())
                    for r in runs(text, taken):
                        a, b = r[0][0], r[-1][1]
                        terms = sorted({t for x, y, role, _ in r if role == "word" for t in parts(text[x:y])})
                        got.append((key, field, path, a, b, "run", None, text[a:b], json.dumps([(x - a, y - a, role, link) for x, y, role, link in r]), terms, None))
            if len(text_) + len(lower) > 300_000:
                got += _counted(mail, text_, lower)
            yield pd.DataFrame(got, columns=COLUMNS)
        yield pd.DataFrame(_counted(mail, text_, lower), columns=COLUMNS)

    return _rows(chunks).mapInPandas(run, RAW)


WORDS = re.compile(r"[^\W\d_]+")


def _counted(mail: Counter, text: Counter, lower: Counter) -> list[tuple]:
    got: dict[str, list[int]] = {}
    for k, counter in enumerate((mail, text, lower)):
        for w, n in counter.items():
            t = w if k == 0 else term(w)
            if t:
                got.setdefault(t, [0, 0, 0])[k] += n
        counter.clear()
    return [(None, None, None, a, b, "#", t, None, None, None, c) for t, (a, b, c) in got.items()]


def disclosure(counts: DataFrame) -> DataFrame:
    """(term, in_mail, in_text, lower, score): how much of the information on a person a term gives, by its pointwise mutual
    information over the contexts in which it stands, mail addresses and text."""
    totals = counts.agg(F.sum("in_mail").alias("mails"), F.sum(F.col("in_mail") + F.col("in_text") + F.col("lower")).alias("all"))
    scored = counts.crossJoin(F.broadcast(totals))  # totals is one row
    bits = F.log2((F.col("in_mail") * (F.col("all") + 1)) / ((F.col("in_mail") + F.col("in_text") + F.col("lower") + 1) * (F.col("mails") + 1)))
    return scored.select("term", "in_mail", "in_text", "lower", "all", F.when(F.col("in_mail") > 0, bits / F.log2((F.col("all") + 2) / (F.col("mails") + 1))).otherwise(0.0).alias("score"))


def kind_disclosure(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, term, score) for shapes of items and words before them. A shape's marginal are all spans, a word's its occurrences in the corpus."""
    of = candidates.where("kind <> 'run'").select("kind", F.explode("terms").alias("term")).groupBy("kind", "term").agg(F.count("*").alias("joint"))
    kinds = candidates.where("kind not in ('run', 'other')").groupBy("kind").agg(F.count("*").alias("items"))  # one row for each kind
    every = counts.agg(F.sum(F.col("in_mail") + F.col("in_text") + F.col("lower")).alias("all"))
    shapes = of.where("term like '=%'").groupBy("term").agg(F.sum("joint").alias("n"))
    words = counts.select("term", (F.col("in_text") + F.col("lower")).alias("n"))
    both = of.where("kind <> 'other'").join(shapes.unionByName(words), "term").join(F.broadcast(kinds), "kind").crossJoin(F.broadcast(every))
    bits = F.log2(F.col("joint") * (F.col("all") + F.col("items")) / (F.greatest("n", "joint") * F.col("items")))
    return both.select("kind", "term", (bits / F.log2((F.col("all") + F.col("items")) / F.col("items"))).alias("score"))


SALT = 16


def items(chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per personal item: id, field, path of the JSON value, start, stop, kind, the item as it stands, its most telling term
    and the term's disclosure, a share of the information on the kind that is at least `threshold`.

    Null contents and metadata hold nothing; metadata that can't be read is searched as plain text. Rows delivered twice
    count once. Items never overlap: addresses of mail come before numbers, numbers before street addresses, names last.
    """
    raw = cut(spans(chunks))
    counts = cut(raw.where("kind = '#'").groupBy(F.col("found").alias("term")).agg(F.sum("start").alias("in_mail"), F.sum("stop").alias("in_text"), F.sum("n").alias("lower")))
    candidates = cut(raw.where("kind <> '#'").drop("n").dropDuplicates(["id", "field", "path", "start", "stop"]))
    place = ["id", "field", "path", "start", "stop"]

    formed = candidates.where("kind not in ('run', 'other')")
    known = small(kind_disclosure(candidates, counts))
    telling = formed.select(*place, "kind", "found", F.explode("terms").alias("term")).join(known, ["kind", "term"]).groupBy(*place, "kind", "found").agg(F.max_by("term", F.struct("score", "term")).alias("term"), F.max("score").alias("score"))
    sure = telling.where(F.col("score") >= threshold)

    people = cut(disclosure(counts))
    # Equal runs are decided once, however often they stand in the corpus.
    texts = cut(candidates.where("kind = 'run'").groupBy("text", "run").agg(F.count("*").alias("n"), F.first("terms").alias("terms")))
    words = texts.select("text", "run", "n", F.explode("terms").alias("term"))
    shown = words.join(people.where(F.col("score") >= threshold).select("term"), "term").groupBy("text", "run").agg(F.collect_set("term").alias("protected"))  # words of one run
    # Of the occurrences of a term in runs, the share beside a protected one.
    beside = words.join(shown, ["text", "run"], "left").groupBy("term").agg(F.sum("n").alias("stood"), F.sum(F.when(F.size(F.array_remove(F.coalesce("protected", F.array().cast("array<string>")), F.col("term"))) > 0, F.col("n")).otherwise(0)).alias("beside"))
    rare = (F.col("in_text") <= F.greatest(F.lit(20), F.col("all") / 200_000)) & (2 * F.coalesce("beside", F.lit(0)) >= F.col("stood"))
    level = F.when(F.col("score") >= threshold, 2).when((F.col("lower") == 0) & ((F.col("in_mail") > 0) | rare), 1)
    # A term beside protected ones reveals as much as the share of its occurrences says.
    scores = people.join(beside, "term").select("term", level.alias("level"), F.greatest("score", F.coalesce(F.col("beside") / F.col("stood"), F.lit(0.0))).alias("score")).where("level is not null")
    scored = words.join(scores, "term").groupBy("text", "run").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("level", "score").alias("s")))).alias("scores"))

    def decide(frames):
        for pdf in frames:
            got = []
            for text, shifted, known in zip(pdf["text"], pdf["run"], pdf["scores"]):
                known = dict(known)
                level_of = lambda t: known[t]["level"] if t in known else 0

                def score(word: str) -> int:
                    whole, *halves = parts(word)
                    best = level_of(whole)
                    if halves and best < 2:
                        best = max(best, min(map(level_of, halves)), 2 if any(level_of(h) == 2 for h in halves) else 0)
                    return best

                for a, b in names_in(text, [tuple(x) for x in json.loads(shifted)], score):
                    held = [t for w in WORDS.findall(text[a:b].replace("'", "").replace("’", "")) if (t := term(w)) in known] or list(known)
                    best = max(held, key=lambda t: (known[t]["score"], t))
                    got.append((text, shifted, a, b, BLANKS.sub(" ", text[a:b]), best, float(known[best]["score"])))
            yield pd.DataFrame(got, columns=["text", "run", "a", "b", "name", "term", "score"])

    decided = scored.mapInPandas(decide, "text string, run string, a long, b long, name string, term string, score double").where(F.col("score") >= threshold)
    # A frequent run is spread over SALT tasks, its decision sent to each.
    salted = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    standing = candidates.where("kind = 'run'").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(salted, ["text", "run", "salt"])
    names = standing.select("id", "field", "path", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("stop"), F.lit("name").alias("kind"), F.col("name").alias("found"), "term", "score")
    return sure.unionByName(names)


def found(chunks: DataFrame) -> DataFrame:
    return items(chunks).select("id", "field", "kind", "found").distinct()


def sanitise(chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """id, content, metadata with each item generalised to its kind by a placeholder such as [EMAIL]; everything else unchanged.

    Metadata that can't be read stays text and is sanitised as such. Rows without an item come out as they are. Null ids are
    left out; a repeated id comes out once.
    """
    spans = items(chunks, threshold).groupBy("id").agg(F.collect_list(F.struct("field", "path", "start", "stop", "kind")).alias("spans"))  # bounded by one chunk's length
    rows = _rows(chunks).dropDuplicates(["id"]).join(spans, "id", "left")

    def replace(text: str, own: list) -> str:
        for a, b, kind in sorted(own, reverse=True):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        return text

    def run(frames):
        for pdf in frames:
            got = []
            for key, content, metadata, spans_ in zip(pdf["id"], pdf["content"], pdf["metadata"], pdf["spans"]):
                content = content if isinstance(content, str) else None
                metadata = metadata if isinstance(metadata, str) else None
                if spans_ is not None:
                    by: dict = {}
                    for s in spans_:
                        by.setdefault((s["field"], s["path"]), []).append((s["start"], s["stop"], s["kind"]))
                    if ("content", "") in by:
                        content = replace(content, by[("content", "")])
                    changed = {k[1]: v for k, v in by.items() if k[0] == "metadata"}
                    if changed and "[]" in changed:
                        metadata = replace(metadata, changed["[]"])
                    elif changed:
                        obj = json.loads(metadata)
                        obj = json.loads(obj) if isinstance(obj, str) else obj
                        for path, own in changed.items():
                            *most, end = json.loads(path)
                            at = obj
                            for step in most:
                                at = at[step]
                            at[end] = replace(at[end], own)
                        metadata = json.dumps(obj, ensure_ascii=False, separators=(",", ":"))
                got.append((key, content, metadata))
            yield pd.DataFrame(got, columns=["id", "content", "metadata"])

    return rows.mapInPandas(run, "id string, content string, metadata string")
