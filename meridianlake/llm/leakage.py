"""Evaluation texts inside training documents, by one Aho-Corasick automaton over normalised questions and answers.

The automaton holds every run of `anchor` words of each passage, shorter passages and questions as a whole. A document is
scanned once; each hit of a run is extended along the passage word by word, allowing changed, dropped and added words, and
counts as a leak where at least `least_words` words of the passage in a row stand with at most one error in `one_in` words. A
passage of fewer words, or a question, leaks where it stands entire. Positions refer to the original text.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
HANGUL = re.compile("[\u1160-\u11ff]")  # vowels and finals, which compose though they don't combine
MARKUP = re.compile(r"<[^<>]{0,400}>|&#?\w{1,8};")
#: Words of items in one automaton, some 100 MB; more items are shared out over several, each of which scans the documents.
WORDS_IN_AUTOMATON = 1_000_000

LEAKS = "doc_id long, item_id long, kind string, matched_words long, errors long, start long, stop long"


def composed(text: str) -> tuple[str, list[int] | None]:
    """The text with letters and their accents composed, and, where that changes it, the offset of each character in the original."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text, None
    out, at, k = [], [], 0
    while k < len(text):
        end = k + 1
        while end < len(text) and (unicodedata.combining(text[end]) or HANGUL.match(text[end])):
            end += 1
        made = unicodedata.normalize("NFC", text[k:end])
        out.append(made)
        at += [k] * len(made)
        k = end
    return "".join(out), at


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words without markup, and where each begins and ends in the text."""
    plain = MARKUP.sub(lambda m: " " * len(m[0]), text) if "<" in text or "&" in text else text
    plain, at = composed(plain)
    found = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(plain)]
    if at is not None:
        at.append(len(text))
        found = [(w, at[a], at[b]) for w, a, b in found]
    return [w for w, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]


def normal(text: str) -> list[str]:
    plain = MARKUP.sub(" ", text) if "<" in text or "&" in text else text
    return WORD.findall(composed(plain)[0].lower())


#: In place of an offset: the whole question, the whole of a passage that is too short to be searched in runs.
QUESTION, SHORT = -1, -2
KINDS = {QUESTION: "question", SHORT: "short passage", 0: "passage"}


class Matcher:
    """Automaton over items (item_id, question, passage). Built once per Python worker."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], anchor: int, least_words: int, one_in: int):
        import ahocorasick

        self.anchor, self.least, self.one_in = anchor, least_words, one_in
        # Wrong words in a row that a stretch may hold whose parts beside them are too short or too wrong to count alone.
        self.gap = max(1, 2 * (least_words - 1) // max(1, one_in - 1))
        # Where runs of `anchor` words are short and errors dear, `goes_on` tells without loss of a leak which runs are worth extending.
        self.screened = 4 * (anchor - 1) <= 3 * (one_in - 1) <= 6 * anchor
        self.passages = {i: normal(p or "") for i, _, p in items}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, words in self.passages.items():
            for k in range(len(words) - anchor + 1):
                places[f" {' '.join(words[k : k + anchor])} "].append((i, k))
            if 0 < len(words) < least_words:
                places[f" {' '.join(words)} "].append((i, SHORT))
        for i, q, _ in items:
            if words := normal(q or ""):
                places[f" {' '.join(words)} "].append((i, QUESTION))
        self.auto = ahocorasick.Automaton()
        for key, at in places.items():
            self.auto.add_word(key, (len(key), at))
        self.empty = not places
        if places:
            self.auto.make_automaton()

    def extend(self, doc: list[str], d: int, passage: list[str], p: int, step: int) -> list[tuple[int, int, bool]]:
        """(doc index, passage index, matches) from (d, p) on in one direction, until more than `gap` words fail in a row."""
        out, failed = [], 0
        while 0 <= p < len(passage) and 0 <= d < len(doc) and failed <= self.gap:
            if doc[d] == passage[p]:
                out.append((d, p, True))
                d, p, failed = d + step, p + step, 0
                continue
            failed += 1

            def after(dd: int, pp: int) -> int:
                n = 0
                while n < 3 and 0 <= dd < len(doc) and 0 <= pp < len(passage) and doc[dd] == passage[pp]:
                    dd, pp, n = dd + step, pp + step, n + 1
                return n

            changed, added, dropped = after(d + step, p + step), after(d + step, p), after(d, p + step)
            if added > changed and added >= dropped:
                out.append((d, -1, False))
                d += step
            elif dropped > changed:
                out.append((-1, p, False))
                p += step
            elif not changed and failed == 1 and (over := self.jump(doc, d, passage, p, step)):
                # Several words added or dropped in a row, some of them changed.
                i, j = over
                out += [(d + step * k if k < i else -1, p + step * k if k < j else -1, False) for k in range(max(i, j))]
                d, p = d + step * i, p + step * j
            else:
                out.append((d, p, False))
                d, p = d + step, p + step
        return out

    def jump(self, doc: list[str], d: int, passage: list[str], p: int, step: int) -> tuple[int, int] | None:
        """Words of the document and of the passage to pass over so that three words match behind: fewest errors first; equally many on both sides are changed words and left to `extend`."""

        def alike(dd: int, pp: int) -> bool:
            for _ in range(3):
                if not (0 <= dd < len(doc) and 0 <= pp < len(passage) and doc[dd] == passage[pp]):
                    return False
                dd, pp = dd + step, pp + step
            return True

        if not self.goes_on(doc, d, passage, p, step, self.gap):
            return None
        for most in range(2, self.gap + 1):
            if alike(d + step * most, p + step * most):
                return None
            for less in range(most - 1, -1, -1):
                if alike(d + step * most, p + step * less):
                    return most, less
                if alike(d + step * less, p + step * most):
                    return less, most
        return None

    def goes_on(self, doc: list[str], d: int, passage: list[str], p: int, step: int, most: int) -> bool:
        """A word matches behind at most `most` wrong words at (d, p).

        A leak has at least one_in - 1 right words for each wrong one. Charge half of a gap's to the run on each side of it:
        some run of `anchor` words or more can pay the charge of the smaller of its gaps. So every leak that is no exact run
        holds a run of n words that goes on behind at most 2 * n / (one_in - 1) wrong ones on one side.
        """
        ahead = doc[d : d + most + 1] if step > 0 else doc[max(0, d - most) : d + 1]
        behind = passage[p : p + most + 1] if step > 0 else passage[max(0, p - most) : p + 1]
        return not set(ahead).isdisjoint(behind)

    def best(self, path: list[tuple[int, int, bool]]) -> tuple[int, int, int, int] | None:
        """Longest stretch of the path with enough words of the passage and few enough errors: words, errors, first and last doc index."""
        if sum(ok for _, _, ok in path) < self.least - self.least // self.one_in - 1:
            return None
        found = None
        for a in range(len(path)):
            if not path[a][2]:
                continue
            n = bad = 0
            for b in range(a, len(path)):
                n += path[b][1] >= 0
                bad += not path[b][2]
                if path[b][2] and n >= self.least and bad * self.one_in <= n and (found is None or n > found[0]):
                    found = (n, bad, path[a][0], path[b][0])
        return found

    def leaks(self, text: str) -> dict[tuple[int, str], tuple[int, int, int, int]]:
        """(item, kind) -> (words, errors, first and last index of the document's words)"""
        words = normal(text)
        if self.empty or not words:
            return {}
        line = f" {' '.join(words)} "
        got: dict[tuple[int, str], tuple[int, int, int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        at_char, at_word = 0, 0
        for end, (size, places) in self.auto.iter(line):
            start = end - size + 1
            at_word += line.count(" ", at_char, start) if start >= at_char else -line.count(" ", start, at_char)
            at_char = start
            for item, k in places:
                if k < 0:
                    got.setdefault((item, KINDS[k]), (n := line.count(" ", start, end), 0, at_word, at_word + n - 1))
                    continue
                # Only what a path has covered is known; behind its end the same diagonal may go on.
                if (item, at_word, k) in seen:
                    continue
                passage = self.passages[item]
                a, b, off = at_word, at_word + self.anchor, at_word - k
                while a > 0 and a > off and words[a - 1] == passage[a - 1 - off]:
                    a -= 1
                while b < len(words) and b - off < len(passage) and words[b] == passage[b - off]:
                    b += 1
                most = 2 * (b - a) // (self.one_in - 1) if self.one_in > 1 else 0
                if b - a < self.least and self.screened and not self.goes_on(words, b, passage, b - off, 1, most) and not self.goes_on(words, a - 1, passage, a - 1 - off, -1, most):
                    seen.update((item, x, x - off) for x in range(at_word, b))
                    continue
                right = self.extend(words, at_word, passage, k, 1)
                if sum(ok for _, _, ok in right) < self.anchor:
                    continue
                left = self.extend(words, at_word - 1, passage, k - 1, -1)
                for d, p, ok in right:
                    if ok:
                        seen.add((item, d, p))
                match = self.best(left[::-1] + right)
                if match and ((item, KINDS[0]) not in got or match[0] > got[item, KINDS[0]][0]):
                    got[item, KINDS[0]] = match
        return got


_BUILT: dict[object, Matcher] = {}


def leaks(docs: DataFrame, items: DataFrame, anchor: int = 6, least_words: int = 20, one_in: int = 8) -> DataFrame:
    """One row per (document, item, kind) with the longest stretch. Kinds: passage, short passage (entire) and question (entire).

    One automaton holds all items; only where they have more than WORDS_IN_AUTOMATON words are they shared out by a hash, so that
    what is sent to the executors stays bounded. Stock questions leak like any: what of them counts is for the caller to say.
    Null and empty texts, passages and questions match nothing; repeated documents and items count once; ties go to the first
    stretch. Either table may be empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    held = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("query").cast("string").alias("query"), F.col("passage").cast("string").alias("passage")).where(F.col("item_id").isNotNull()).dropDuplicates(["item_id"])
    words = held.agg(F.sum(F.coalesce(F.size(F.split("query", r"\s+")), F.lit(0)) + F.coalesce(F.size(F.split("passage", r"\s+")), F.lit(0))).alias("n")).first()["n"] or 0
    shares = max(1, -(-words // WORDS_IN_AUTOMATON))
    out = None
    for share in range(shares):
        block = held.where(F.pmod(F.xxhash64("item_id"), F.lit(shares)) == share).collect()  # about WORDS_IN_AUTOMATON words
        found = rows.mapInPandas(_scanner(rows.sparkSession.sparkContext.broadcast(sorted(tuple(r) for r in block)), anchor, least_words, one_in), LEAKS)
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["doc_id", "item_id", "kind"])


def _scanner(held, anchor: int, least_words: int, one_in: int):
    key = (str(uuid.uuid4()), anchor, least_words, one_in)

    def run(frames):
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Matcher(held.value, anchor, least_words, one_in)
        matcher = _BUILT[key]
        for pdf in frames:
            got = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                found = matcher.leaks(text)
                if found:
                    _, starts, stops = words_of(text)
                    got += [(doc_id, item, kind, n, bad, starts[a], stops[b]) for (item, kind), (n, bad, a, b) in found.items()]
            yield pd.DataFrame(got, columns=["doc_id", "item_id", "kind", "matched_words", "errors", "start", "stop"])

    return run
