"""Repair of text from scanned pages: running lines out, divided words joined, misread words corrected.

The corpus is its own dictionary. A first pass counts words, apart for typed texts and for page layouts; words that stand
almost only on pages are suspects. Suspects and the words of typed texts meet in a symmetric-delete index: both sides leave out
up to one or two glyphs, what is left is written in the strokes of look-alike glyphs, and a join on these remainders generates
the candidates. The weighted edit distance orders them; its costs are learned from the corpus: a confusion that many suspects
show is cheap. Counts of the word pairs that a candidate would form with its neighbours decide between close candidates, and
whether a word that is no look-alike of any is repaired at all. A second pass over the pages finds the lines and words to repair.

Only counts, remainders and repairs are shuffled, never texts. Suspect words are sent out as a filter of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# Glyphs and what they are read as, cheap from the start.
CONFUSIONS = (
    ("m", "rn"), ("rn", "m"), ("n", "ri"), ("ri", "n"), ("u", "ii"), ("ii", "u"), ("ü", "ii"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("vv", "w"),
    ("h", "li"), ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"), ("o", "0"), ("l", "1"), ("i", "1"), ("l", "|"), ("i", "|"), ("i", "l"), ("l", "i"), ("s", "5"),
    ("b", "8"), ("g", "9"), ("q", "9"), ("t", "†"), ("a", "ɑ"), ("a", "@"), ("z", "2"), ("nn", "rm"), ("é", "6"), ("è", "6"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("s", "$"), ("e", "€"),
)
READ = {}
for _true, _seen in CONFUSIONS:
    READ.setdefault(_seen, []).append(_true)

BITS = 1 << 22
HYPHENS = "-‐¬­‑"
SPLIT = re.compile(r"[\s\-'’‘“”\"«»(){}\[\].,;:!?/–—·‐¬­‑]+")
EDGE = " \t\n.,;:!?…()«»\"'“”‘’[]{}*_–—·"
_PAGE = r"(?:(?:page|pag\.|pagina|página|pág\.|seite|p\.|s\.|blatt|folio|hoja|foglio)\s*\d{1,4}(?:\s*(?:of|di|de|von|sur|/)\s*\d{1,5})?|[\-–—]\s?\d{1,4}\s?[\-–—]|\[\d{1,4}\]|\d{1,4}\s?/\s?\d{1,5}|\d{1,4}\s(?:of|di|de|von|sur)\s\d{1,5}|\d{1,4})"
PAGE = re.compile(rf"\s*{_PAGE}\s*", re.I)
PAGE_END = re.compile(rf"(?:\s{{2,}}{_PAGE}|\s+(?!\d{{1,4}}\s*$){_PAGE})\s*$", re.I)
NUMBER_END = re.compile(r"\s\d{1,4}\s*$")
NUMBERED = re.compile(r"\S{4,14}\s\d{1,3}:\s\S")
HEADING = re.compile(r"\s*\d{1,3}(?:\.\d{1,3})+\.?\s")
MARK = re.compile(r"\s[·|–—•]\s")
STOP = re.compile(r"[.!?…:;,][\"'»”’)]*\s*$")


def is_page(text: str) -> bool:
    """Layout of a page: hard-wrapped lines of prose, or a page number on a line of its own."""
    if "\n" not in text:
        return False
    lines = text.split("\n")
    wrapped = rows = 0
    for a, b in zip(lines, lines[1:]):
        if not b.strip():
            continue
        s = a.strip()
        if s.count(" | ") > 1 or s.count(";") > 2 or s.count("\t"):
            rows += 1
        elif len(s) >= 25 and s[-1] not in ".!?:;…" and s.count(" ") >= 3 and sum(map(str.isalpha, s)) > 0.7 * len(s):
            wrapped += 1
    return wrapped > rows or not rows and any(PAGE.fullmatch(x) for x in lines if x.strip())


def skeleton(word: str, doubled: bool = False) -> str:
    """The same for two words of which one can be read as the other: glyphs broken up into the strokes they share.

    doubled: two n may also have been read as r and m.
    """
    out = word.lower()
    for seen, strokes in STROKES:
        out = out.replace(seen, strokes)
    while doubled and NN_AS_RM[0] in out:
        out = out.replace(*NN_AS_RM)
    return out


# Glyphs and their strokes, wide glyphs first.
STROKES = (("m", "rn"), ("ü", "u"), ("8", "b"), ("h", "b"), ("b", "li"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("w", "vv"), ("é", "6"), ("è", "6"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("e", "c"), ("€", "c"), ("0", "o"), ("l", "1"), ("i", "1"), ("|", "1"), ("5", "s"), ("$", "s"), ("9", "g"), ("q", "g"), ("†", "t"), ("ɑ", "a"), ("@", "a"), ("2", "z"))
NN_AS_RM = ("rrr1", "r1r1")


def core_of(line: str) -> str:
    """The line without a page number at its end."""
    return PAGE_END.sub("", line.strip())


def certain(line: str) -> bool:
    """A running line by its form: page number, numbered chapter, capitals, or parts set apart by a mark."""
    s = line.strip()
    if PAGE.fullmatch(s):
        return True
    if HEADING.match(s) or len(s) > 90:
        return False
    core = core_of(s)
    if STOP.search(core) and not re.search(r"\d\.?$|print$", core):
        return False
    letters = [c for c in core if c.isalpha()]
    if len(letters) >= 4 and sum(map(str.isupper, letters)) >= len(letters) - 1 and " " in core:
        return True
    if MARK.search(core) and core[:1].isupper() and len(core) < 70:
        return True
    if NUMBERED.match(core) and core[:1].isupper() and len(core) < 70:
        return True
    return False


def titled(line: str) -> bool:
    """May be a running line if its words are known as a title: a few words, no end of a sentence."""
    core = core_of(line)
    return bool(core) and core[0].isupper() and len(core) < 45 and len(core.split()) <= 5 and not STOP.search(core) and not HEADING.match(core) and core[-1] not in HYPHENS


def segments(line: str) -> list[str]:
    """Titles that a running line shows: its parts between marks, without page number."""
    return [x for x in (p.strip() for p in MARK.split(core_of(line))) if x and any(map(str.isalpha, x))]


def layout(text: str, known=None):
    """For each line: (line, role), role one of run, title, blank, text.

    A line in title case that breaks a divided word is a running line, as is one whose parts are known titles; `known` tells
    that of a skeleton. Other such lines stay titles, which may be headings or ordinary text.
    """
    lines = text.split("\n")
    roles = ["blank" if not x.strip() else "run" if certain(x) else "title" if titled(x) else "text" for x in lines]
    for i, role in enumerate(roles):
        if role not in ("title", "text"):
            continue
        line = lines[i].strip()
        if i and line[0].isupper() and not STOP.search(line):
            before = next((lines[k].rstrip() for k in range(i - 1, -1, -1) if roles[k] in ("text", "title")), "")
            after = next((lines[k].lstrip() for k in range(i + 1, len(lines)) if roles[k] in ("text", "title")), "")
            if len(before) > 1 and before[-1] in HYPHENS and before[-2].isalpha() and after[:1].islower():
                left = before[:-1].split(" ")[-1]
                if not left[:1].isupper() or role == "title" and len(line.split()) > 1:
                    roles[i] = "run"
                    continue
        if role == "title":
            if core_of(line) != line:
                roles[i] = "run"
            elif known is not None and all(map(known, titles_of(line))):
                roles[i] = "run?"
    return list(zip(lines, roles))


def titles_of(line: str) -> list[str]:
    return [skeleton(s) for s in segments(NUMBER_END.sub("", line))]


def tokens_of(lines):
    """(text, divided left part or None, its hyphen) of each word in the (line, role) pairs, None between paragraphs.

    A word may be divided over any number of lines; where no line follows, its left part stays as it stands.
    """
    left, hyphen = None, ""
    for line, role in lines:
        if role == "blank" and left is None:
            yield None
        words = line.split()
        for k, w in enumerate(words):
            if k == len(words) - 1 and w[-1] in HYPHENS and len(w) > 1 and (w[-2].isalnum() or w[-2] in "†|@"):
                left, hyphen = (left or "") + w[:-1], w[-1]
            else:
                yield w, left, hyphen
                left, hyphen = None, ""
    if left is not None:
        yield left + hyphen, None, ""


def flow(text: str, known=None):
    """(running lines, lines of known titles, tokens) of a page; a token is (text, divided left part or None, its hyphen)."""
    lines = layout(text, known)
    tokens = [t for t in tokens_of((line, role) for line, role in lines if role not in ("run", "run?")) if t]
    return [line.strip() for line, role in lines if role == "run"], [line.strip() for line, role in lines if role == "run?"], tokens


def pieces(token: str) -> list[str]:
    return [p for p in SPLIT.split(token) if p and any(map(str.isalpha, p))]


COUNTS = "kind string, word string, typed long, paged long"


def corpus_counts(rows: DataFrame) -> DataFrame:
    """Counts of words (cased), of hyphenated lower-case words, and of the titles that running lines show."""

    def count(frames):
        typed, paged, joined, titles = Counter(), Counter(), Counter(), Counter()

        def out():
            got = [("word", w, typed.get(w, 0), paged.get(w, 0)) for w in typed.keys() | paged.keys()]
            got += [("hyphen", w, n, 0) for w, n in joined.items()] + [("title", w, 0, n) for w, n in titles.items()]
            for c in (typed, paged, joined, titles):
                c.clear()
            return pd.DataFrame(got, columns=["kind", "word", "typed", "paged"])

        for pdf in frames:
            for text in pdf["content"]:
                page = is_page(text)
                words = SPLIT.split(text)
                (paged if page else typed).update(w for w in words if w and not w.isdigit())
                if "-" in text and not page:
                    joined.update(x for x in (t.strip(EDGE) for t in text.split() if "-" in t) if x[:1].islower())
                if page:
                    for line, role in layout(text):
                        if role == "run" and not PAGE.fullmatch(line.strip()) and len(line) < 90:
                            titles.update(skeleton(s) for s in segments(line))
            if len(typed) + len(paged) + len(joined) > 400_000:
                yield out()
        yield out()

    return rows.mapInPandas(count, COUNTS).groupBy("kind", "word").agg(F.sum("typed").alias("typed"), F.sum("paged").alias("paged"))


def deletions(length: int) -> int:
    """Glyphs that a word of a length may lack in the index: none in words of up to three, two in words of nine to 24."""
    return 0 if length < 4 else 2 if 9 <= length <= 24 else 1


def remainders(word: str) -> list[int]:
    """Hashes of what is left of the word without up to `deletions` of its glyphs, in the strokes of look-alike glyphs.

    Words that can be read as each other by look-alikes alone, any number of them, leave the same with nothing deleted.
    """
    left = {word}
    for n in range(1, deletions(len(word)) + 1):
        left |= {"".join(word[k] for k in range(len(word)) if k not in out) for out in combinations(range(len(word)), n)}
    return [xxhash.xxh64_intdigest(b) - (1 << 63) for b in {skeleton(w) for w in left} | {skeleton(word, True)}]


#: Cost of a listed look-alike, and of a change that nothing makes likely.
LISTED, OTHER = 0.2, 1.0
#: Confusions that are learned, the most frequent ones, and suspects that have to show one.
CONFUSIONS_KEPT, LEAST_SHOWN = 2000, 3


def align(seen: str, true: str, costs: dict[tuple[str, str], float] | None = None) -> tuple[float, list[tuple[str, str]]]:
    """Weighted edit distance with the confusions (seen, true) of the cheapest way. costs: what learned confusions cost."""
    costs = costs or {}
    n, m = len(seen), len(true)
    best = [[np.inf] * (m + 1) for _ in range(n + 1)]
    came: dict[tuple[int, int], tuple[int, int]] = {}
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            d = best[i][j]
            if d == np.inf:
                continue
            steps = []
            if i < n and j < m and seen[i] == true[j]:
                steps.append((1, 1, 0.0))
            for a in (0, 1, 2):
                for b in (0, 1, 2):
                    if (a, b) == (0, 0) or i + a > n or j + b > m:
                        continue
                    x, y = seen[i : i + a], true[j : j + b]
                    cost = costs.get((x, y), OTHER if a < 2 and b < 2 else np.inf)
                    steps.append((a, b, min(cost, LISTED) if y in READ.get(x, ()) else cost))
            for a, b, cost in steps:
                if d + cost < best[i + a][j + b]:
                    best[i + a][j + b] = d + cost
                    came[i + a, j + b] = (i, j)
    path, at = [], (n, m)
    while at in came:
        i, j = came[at]
        if seen[i : at[0]] != true[j : at[1]]:
            path.append((seen[i : at[0]], true[j : at[1]]))
        at = (i, j)
    return float(best[n][m]), path[::-1]


def distance(seen: str, true: str, costs: dict[tuple[str, str], float] | None = None) -> float:
    return align(seen, true, costs)[0]


def learned(pairs: DataFrame) -> dict[tuple[str, str], float]:
    """Costs of confusions from the suspects that have one candidate: the more suspects show a confusion, the cheaper it is.

    The most frequent confusion costs half as much as a listed look-alike without examples; with each power of ten less often it
    costs 0.2 more, up to OTHER.
    """
    order = Window.partitionBy("word")
    alone = pairs.withColumn("candidates", F.count("*").over(order)).where("candidates = 1 and size(changes) = 1")
    got = alone.select(F.col("changes")[0].alias("change")).groupBy("change").count().where(F.col("count") >= LEAST_SHOWN).orderBy(F.desc("count"), "change").limit(CONFUSIONS_KEPT).collect()
    top = max((r["count"] for r in got), default=1)
    return {tuple(r["change"].split("\t")): min(OTHER, LISTED / 2 - 0.2 * float(np.log10(r["count"] / top))) for r in got}


def candidates(counts: DataFrame, most: float = 0.9) -> DataFrame:
    """(word, candidate, cased, cost, n, edit): repairs of suspect words from the symmetric-delete index.

    Look-alikes alone may cost at most `most`. A candidate that needs one other change beside them (`edit`) is kept where the
    suspect never stands in typed text: its context decides, the learned costs tell which of several is likely.
    """
    words = counts.where("kind = 'word'").withColumn("low", F.lower("word"))
    lower = words.groupBy("low").agg(F.sum("typed").alias("typed"), F.sum("paged").alias("paged"), F.max_by("word", F.struct(F.col("typed") + F.col("paged"), F.col("word"))).alias("cased"))
    suspects = lower.where((F.col("paged") > 0) & (F.col("typed") <= 0.3 * F.col("paged")) & F.col("low").rlike(r"\p{L}") & (F.length("low") >= 2)).select(F.col("low").alias("word"), F.lit(True).alias("suspect"), (F.col("typed") + F.col("paged")).alias("n"), "typed", "cased")
    known = lower.where((F.col("typed") > 0) & (F.col("typed") > 0.3 * F.col("paged")) & F.col("low").rlike(r"^[\p{L}]+$") & (F.length("low") >= 2)).select(F.col("low").alias("word"), F.lit(False).alias("suspect"), (F.col("typed") + F.col("paged")).alias("n"), "typed", "cased")

    def index(frames):
        for pdf in frames:
            yield pdf.assign(keys=[remainders(w) for w in pdf["word"]])

    both = suspects.unionByName(known).mapInPandas(index, "word string, suspect boolean, n long, typed long, cased string, keys array<long>")
    entries = cut(both.select("word", "suspect", "n", "typed", "cased", F.explode("keys").alias("key")))
    a = entries.where("suspect").select("word", F.col("n").alias("seen"), F.col("typed").alias("seen_typed"), "key")
    b = entries.where("not suspect").select(F.col("word").alias("candidate"), "n", "cased", "key")
    pairs = a.join(b, "key").where("n > seen and word <> candidate").select("word", "candidate", "cased", "n", "seen", "seen_typed").distinct()

    def weigh(costs):
        def run(frames):
            for pdf in frames:
                done = [align(x, y, costs) for x, y in zip(pdf["word"], pdf["candidate"])]
                yield pdf.assign(cost=[c for c, _ in done], other=[sum(t not in READ.get(x, ()) for x, t in path) for _, path in done], changes=[["\t".join(x) for x in path] for _, path in done])

        return run

    schema = "word string, candidate string, cased string, n long, seen long, seen_typed long, cost double, other int, changes array<string>"
    first = cut(pairs.mapInPandas(weigh(None), schema).where((F.col("other") <= 1) & (F.col("cost") <= OTHER + 2 * LISTED)))
    # What needs more than one other change stays as it is.
    final = first.drop("cost", "other", "changes").mapInPandas(weigh(learned(first)), schema)
    # Another change needs a word that is never typed, a candidate far more frequent, and some length to be told.
    edit = (F.col("other") == 1) & (F.col("seen_typed") == 0) & (F.col("n") >= 20 * F.col("seen")) & (F.length("word") >= 5)
    return final.withColumn("edit", edit).where((F.col("other") == 0) & (F.col("cost") <= most) | F.col("edit")).select("word", "candidate", "cased", "n", "cost", "edit")


def _bits(words: DataFrame, column: str) -> dict[int, int]:
    """A filter of BITS bits with the words' hashes set; at most BITS / 64 numbers come to the driver."""
    h = F.pmod(F.crc32(F.col(column).cast("binary")), F.lit(BITS))
    got = words.select(h.alias("h")).groupBy(F.expr("int(h div 64)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(h % 64)))").alias("b")).collect()
    return {r["w"]: r["b"] & 0xFFFFFFFFFFFFFFFF for r in got}


def _in(bits: dict[int, int], word: str) -> bool:
    h = zlib.crc32(word.encode()) % BITS
    return bool(bits.get(h >> 6, 0) >> (h & 63) & 1)


def recase(seen: str, cand: str, cased: str) -> str:
    """The candidate in the case of the word as seen; where its first letter was misread, in its usual case."""
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(map(str.isupper, letters)):
        return cand.upper()
    if seen[:1].isalpha() and seen[0].lower() == cand[0]:
        return (cand[0].upper() if seen[0].isupper() else cand[0]) + cand[1:]
    if seen[:1].isupper():
        return cand[:1].upper() + cand[1:]
    if seen[:1].isalpha() and seen[0].islower():
        return cand
    return cand[:1].upper() + cand[1:] if cased[:1].isupper() else cand


FINDINGS = "id string, place long, kind string, seen string, left string, hyphen string, plain string, pieces array<string>, prev string, next string"


def findings(rows: DataFrame, bits: dict[int, int], titles_: dict[int, int]) -> DataFrame:
    """What may need repair on each page: running lines, known titles, divided words, and words with a suspect piece."""
    held = rows.sparkSession.sparkContext.broadcast((bits, titles_))  # BITS / 64 numbers at most, each

    def run(frames):
        known, shown = held.value
        for pdf in frames:
            got = []
            for key, text in zip(pdf["id"], pdf["content"]):
                if not is_page(text):
                    continue
                running, titles, tokens = flow(text, lambda t: _in(shown, t))
                got += [(key, k, "running", x, None, None, None, None, None, None) for k, x in enumerate(running)]
                got += [(key, k, "title", x, None, None, titles_of(x)[0], None, None, None) for k, x in enumerate(titles)]
                for k, (w, left, hyphen) in enumerate(tokens):
                    ps = [p.lower() for p in pieces(w if left is None else left + w)]
                    if left is None and not any(_in(known, p) for p in ps):
                        continue
                    before = [p.lower() for p in pieces(tokens[k - 1][0])][-1:] if k else []
                    after = [p.lower() for p in pieces(tokens[k + 1][0])][:1] if k + 1 < len(tokens) else []
                    joint = ps[max(0, len(pieces(left)) - 1)] if left and ps else None
                    got.append((key, k, "word" if left is None else "divided", w, left, hyphen, joint, ps, before[0] if before else "", after[0] if after else ""))
            yield pd.DataFrame(got, columns=["id", "place", "kind", "seen", "left", "hyphen", "plain", "pieces", "prev", "next"])

    return rows.mapInPandas(run, FINDINGS)


def context_counts(rows: DataFrame, bits: dict[int, int]) -> DataFrame:
    """(one, two, pairs): how often two words follow each other in typed texts, for pairs with a word of the filter."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def count(frames):
        known, seen = held.value, {}
        pairs: Counter = Counter()
        for pdf in frames:
            for text in pdf["content"]:
                if is_page(text):
                    continue
                words = [w for w in SPLIT.split(text.lower()) if w]
                for k, w in enumerate(words):
                    hit = seen.get(w)
                    if hit is None:
                        hit = seen[w] = _in(known, w)
                        if len(seen) > 500_000:
                            seen.clear()
                    if hit:
                        if k:
                            pairs[words[k - 1], w] += 1
                        if k + 1 < len(words):
                            pairs[w, words[k + 1]] += 1
            if len(pairs) > 400_000:
                yield pd.DataFrame([(a, b, n) for (a, b), n in pairs.items()], columns=["one", "two", "pairs"])
                pairs.clear()
        yield pd.DataFrame([(a, b, n) for (a, b), n in pairs.items()], columns=["one", "two", "pairs"])

    return rows.mapInPandas(count, "one string, two string, pairs long").groupBy("one", "two").agg(F.sum("pairs").alias("pairs"))


def repairs(chunks: DataFrame, close: float = 0.15) -> DataFrame:
    """One row per repair: id, place, kind (running, hyphenated, misread), seen, left part, repaired word.

    Null and blank contents and texts that have no page layout need none. A word without a likely reading stays as it is; nothing but running lines is left out.
    Rows delivered twice count once. Of equal readings the more frequent one, then the first in the alphabet, is taken.
    """
    rows = chunks.select(F.col("id").cast("string").alias("id"), F.col("content").cast("string").alias("content")).where(F.col("id").isNotNull() & F.col("content").isNotNull())
    counts = cut(corpus_counts(rows))
    cands = cut(candidates(counts))
    order = Window.partitionBy("word").orderBy("cost", F.desc("n"), "candidate")
    ranked = cands.withColumn("rank", F.row_number().over(order)).withColumn("least", F.min("cost").over(Window.partitionBy("word"))).where(F.col("cost") <= F.col("least") + close)
    ranked = cut(ranked.withColumn("many", (F.count("*").over(Window.partitionBy("word")) > 1) | F.col("edit")))
    titles = counts.where("kind = 'title' and paged >= 2")
    found = cut(findings(rows, _bits(ranked.where("rank = 1"), "word"), _bits(titles, "word")).dropDuplicates(["id", "kind", "place"]))

    uses = found.where("kind in ('word', 'divided')").select("id", "kind", "place", "prev", "next", F.posexplode("pieces").alias("at", "word"))
    plain = uses.join(ranked.where("rank = 1 and not many").select("word", "candidate", "cased"), "word").select("id", "kind", "place", "at", "candidate", "cased")
    open_ = uses.join(ranked.where("many").select("word", "candidate", "cased", "cost", "n", "edit"), "word")
    pairs = context_counts(rows, _bits(ranked.where("many").select("candidate").distinct(), "candidate"))
    left, right = pairs.select(F.col("one").alias("prev"), F.col("two").alias("candidate"), F.col("pairs").alias("before")), pairs.select(F.col("one").alias("candidate"), F.col("two").alias("next"), F.col("pairs").alias("after"))
    weighed = open_.join(left, ["prev", "candidate"], "left").join(right, ["candidate", "next"], "left").fillna(0, ["before", "after"])
    # What is no look-alike is repaired only where typed texts know it beside both of its neighbours.
    weighed = weighed.where(~F.col("edit") | (F.col("before") > 0) & (F.col("after") > 0))
    pick = Window.partitionBy("id", "kind", "place", "at").orderBy(F.desc(F.log1p(F.col("before")) + F.log1p(F.col("after")) - 5 * F.col("cost")), F.desc("n"), "candidate")
    decided = weighed.withColumn("pick", F.row_number().over(pick)).where("pick = 1").select("id", "kind", "place", "at", "candidate", "cased")
    fixes = plain.unionByName(decided).groupBy("id", "kind", "place").agg(F.collect_list(F.struct("at", "candidate", "cased")).alias("fixes"))  # a few per word

    # A divided word keeps its hyphen where the corpus writes it with one.
    divided = found.where("kind = 'divided'").withColumn("with", F.lower(F.regexp_replace(F.concat_ws("-", "left", "seen"), r"^[\s.,;:!?()«»\"'“”‘’\[\]]+|[\s.,;:!?()«»\"'“”‘’\[\]…]+$", "")))
    hyphens = counts.where("kind = 'hyphen'").groupBy(F.lower("word").alias("with")).agg(F.sum("typed").alias("hyphened"))
    words = counts.where("kind = 'word'").groupBy(F.lower("word").alias("plain")).agg(F.sum("typed").alias("whole"))
    divided = divided.join(hyphens, "with", "left").join(words, "plain", "left").fillna(0, ["hyphened", "whole"])
    others = found.where("kind <> 'divided'").withColumn("hyphened", F.lit(0).cast("long")).withColumn("whole", F.lit(0).cast("long"))
    titles = titles.select(F.col("word").alias("plain"), F.lit(True).alias("title"))
    joined = divided.drop("with").unionByName(others).join(fixes, ["id", "kind", "place"], "left").join(titles, "plain", "left")

    def run(frames):
        for pdf in frames:
            got = []
            for key, place, kind, seen, left, hyphen, hyphened, whole, fix, title in zip(*(pdf[c] for c in ("id", "place", "kind", "seen", "left", "hyphen", "hyphened", "whole", "fixes", "title"))):
                fix = {} if fix is None else {f["at"]: (f["candidate"], f["cased"]) for f in fix}
                if kind == "running" or kind == "title" and title is True:
                    got.append((key, place, "running", seen, None, seen))
                elif kind == "word" and fix:
                    word = seen.strip(EDGE)
                    fixed = mend(word, fix)
                    if fixed != word:
                        got.append((key, place, "misread", word, None, fixed))
                elif kind == "divided":
                    name = hyphen in "-‑" and seen[:1].isupper() and left[:1].isupper()
                    keeps = name or hyphened > whole
                    # Joined, the parts are one piece; a kept hyphen makes two, whose repairs the corpus of parts can't give.
                    word = (left + "-" + seen if keeps else left + seen).strip(EDGE)
                    got.append((key, place, "hyphenated", seen, left, mend(word, fix) if fix and not keeps else word))
            yield pd.DataFrame(got, columns=["id", "place", "kind", "seen", "left", "found"])

    columns = ["id", "place", "kind", "seen", "left", "hyphen", "hyphened", "whole", "fixes", "title"]
    return joined.select(*columns).mapInPandas(run, "id string, place long, kind string, seen string, left string, found string")


def mend(word: str, fix: dict[int, tuple[str, str]]) -> str:
    """word with its pieces replaced by their readings, each in its case."""
    out, at, k = [], 0, 0
    for m in re.finditer(r"[^\s\-'’‘“”\"«»(){}\[\].,;:!?/–—·‐¬­‑]+", word):
        if not any(map(str.isalpha, m[0])):
            continue
        out.append(word[at : m.start()])
        out.append(recase(m[0], *fix[k]) if k in fix else m[0])
        at, k = m.end(), k + 1
    return "".join(out) + word[at:]


def found(chunks: DataFrame) -> DataFrame:
    return repairs(chunks).select("id", "kind", "found").distinct()


def repaired(chunks: DataFrame) -> DataFrame:
    """id and content as continuous paragraphs, without running lines, divided words joined and misread words corrected.

    Contents without page layout come out unchanged, null stays null; a repeated id comes out once.
    """
    fixes = repairs(chunks).groupBy("id").agg(F.collect_list(F.struct("kind", "place", "seen", "left", "found")).alias("fixes"))  # bounded by one page
    rows = chunks.select(F.col("id").cast("string").alias("id"), F.col("content").cast("string").alias("content")).where(F.col("id").isNotNull()).dropDuplicates(["id"]).join(fixes, "id", "left")

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "content": [reflow(t, f) if isinstance(t, str) else None for t, f in zip(pdf["content"], pdf["fixes"])]})

    return rows.mapInPandas(run, "id string, content string")


def reflow(text: str, fixes) -> str:
    if not is_page(text):
        return text
    fixes = [] if fixes is None else fixes
    running = {f["found"] for f in fixes if f["kind"] == "running"}
    words = {f["place"]: f for f in fixes if f["kind"] != "running"}
    paragraphs, current, place = [], [], 0
    for token in tokens_of((line, role) for line, role in layout(text) if role != "run" and line.strip() not in running):
        if token is None:
            if current and STOP.search(current[-1]):
                paragraphs.append(" ".join(current))
                current = []
            continue
        w, left, _ = token
        fix, bare = words.get(place), (left or "") + w
        if fix is not None:
            bare = bare[: len(bare) - len(bare.lstrip(EDGE))] + fix["found"] + bare[len(bare.rstrip(EDGE)) :]
        current.append(bare)
        place += 1
    if current:
        paragraphs.append(" ".join(current))
    return "\n\n".join(paragraphs)
