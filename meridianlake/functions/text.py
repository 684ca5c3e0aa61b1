"""Text functions as Column expressions; only checks that walk a match digit by digit run as Arrow functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM = " \t\n\r\x00\x0b"

# Stop words of the language vote, in the order in which ties are decided.
STOP_WORDS = {
    "it": ["il", "lo", "la", "che", "di", "e", "un", "una", "per", "con", "non", "sono", "gli", "nel", "alla", "come", "più", "anche"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "auf", "für", "den", "von", "zu", "auch", "werden", "sind"],
    "en": ["the", "and", "is", "of", "to", "in", "that", "it", "for", "with", "as", "are", "this", "be", "on", "not", "or"],
}

# Forms of personal items, in the order in which they are masked.
FORMS = {
    "email": r"[\p{L}\p{N}._%+\-]{1,64}@(?:[\p{L}\p{N}\-]{1,63}\.){1,12}[\p{L}]{2,24}",
    "iban": r"\b[A-Za-z]{2}\d{2}(?:\s?[A-Za-z0-9]){11,30}\b",
    "credit_card": "\\b\\d(?:[ \\-.\u00a0\u2009\u202f]?\\d){12,18}\\b",
    "codice_fiscale": r"\b[A-Za-z]{6}\d{2}[A-Za-z]\d{2}[A-Za-z]\d{3}[A-Za-z]\b",
    "vat": r"\b(?:IT)?\d{11}\b",
    "phone": r"(?<![\w.\-])\+?\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?![\w.\-])",
}


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM))


def clean(text: Column) -> Column:
    """Valid UTF-8, one kind of line end, no control or zero-width characters, no long runs of blanks or empty lines."""
    t = F.make_valid_utf8(text)
    # What is replaced, in this order.
    for pattern, put in ((r"\r\n|\r", "\n"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"[\u00AD\u200B-\u200D\uFEFF]", ""), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"[ \t]+\n", "\n")):
        t = F.regexp_replace(t, pattern, put)
    return trimmed(t)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_count(text: Column, chars_per_token: int = 4) -> Column:
    """Mean of a word-based and a character-based estimate; 0 for blank text."""
    t = trimmed(text)
    words = F.ceil(F.size(F.split(t, r"(?U)\s+")) * F.lit(1.3))
    chars = F.ceil(F.char_length(t) / F.lit(float(max(1, chars_per_token))))
    return F.when(t == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((words + chars) / 2 + 0.5))).cast("bigint")


def count_tokens(text: str, chars_per_token: int = 4) -> int:
    """token_count for one string, for functions that pack pieces one after the other."""
    t = text.strip(TRIM)
    if not t:
        return 0
    words = -(-len(re.split(r"\s+", t)) * 13 // 10)
    return max(1, (words - (-len(t) // chars_per_token) + 1) // 2)


def truncate_tokens(text: Column, most: int, chars_per_token: int = 4) -> Column:
    """The longest prefix, shortened in steps of chars_per_token characters, that keeps within `most` tokens."""
    if most <= 0:
        return F.lit("")
    lengths = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.lit(chars_per_token * most) - k * chars_per_token)
    fitting = F.filter(F.transform(lengths, lambda n: F.substring(text, F.lit(1), n.cast("int"))), lambda s: token_count(s, chars_per_token) <= most)
    return F.when(token_count(text, chars_per_token) <= most, text).otherwise(F.rtrim(F.element_at(fitting, 1), F.lit(TRIM)))


def language_vote(text: Column) -> Column:
    """The language whose stop words occur most often; ties go by the order of STOP_WORDS, no stop word gives null."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")

    def vote(stop: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(stop)))

    votes = {lang: vote(stop) for lang, stop in STOP_WORDS.items()}
    top = F.greatest(*votes.values())
    out = F.lit(None).cast("string")
    for lang, n in reversed(list(votes.items())):
        out = F.when((n == top) & (top > 0), lang).otherwise(out)
    return out


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def luhn(digits: str) -> bool:
    if not 13 <= len(digits) <= 19:
        return False
    doubled = "0246813579"
    return sum(int(c) if k % 2 == 0 else int(doubled[int(c)]) for k, c in enumerate(reversed(digits))) % 10 == 0


def iban(text: str) -> bool:
    flat = "".join(text.split()).upper()
    return 15 <= len(flat) <= 34 and flat.isalnum() and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def phone(text: str) -> bool:
    digits = sum(map(str.isdigit, text))
    t = text.strip()
    if not 8 <= digits <= 15 or re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", t) or re.fullmatch(r"97[89][\d\- ]+", t):
        return False
    return "+" in text or bool(re.search(r"[ .\-()]", text)) or digits <= 11


CHECKS: dict[str, Callable[[str], bool]] = {"iban": iban, "credit_card": lambda t: luhn(re.sub(r"\D", "", t)), "phone": phone}
# The same forms in the dialect of Python.
_PATTERNS = {
    "email": re.compile(r"[\w.%+\-]{1,64}@(?:(?:[^\W_]|-){1,63}\.){1,12}[^\W\d_]{2,24}"),
    "iban": re.compile(FORMS["iban"], re.ASCII),
    "credit_card": re.compile(FORMS["credit_card"], re.ASCII),
    "codice_fiscale": re.compile(FORMS["codice_fiscale"], re.ASCII),
    "vat": re.compile(FORMS["vat"], re.ASCII),
    "phone": re.compile(FORMS["phone"], re.ASCII),
}


def longest_valid(value: str, check: Callable[[str], bool]) -> int:
    """Length of the longest prefix that passes, dropping parts set apart by separators from the end; 0 if none does."""
    at = len(value)
    while at > 0:
        if check(value[:at]):
            return at
        cut = max(value.rfind(c, 0, at) for c in " -.\u00a0\u2009\u202f\t\n")
        at = len(value[: max(cut, 0)].rstrip(" -.\u00a0\u2009\u202f\t\n"))
    return 0


def redact(text: str, tokens: bool = False) -> tuple[str, dict[str, int]]:
    """Text with [TYPE] or [TYPE:hash] in place of each item, and the number of items by type."""
    counts: dict[str, int] = {}
    for kind, pattern in _PATTERNS.items():
        check = CHECKS.get(kind)

        def put(m: re.Match, kind=kind, check=check) -> str:
            n = len(m[0]) if check is None else longest_valid(m[0], check)
            if not n:
                return m[0]
            counts[kind] = counts.get(kind, 0) + 1
            tag = f":{hashlib.sha256(f'{kind}:{m[0][:n]}'.encode()).hexdigest()[:6]}" if tokens else ""
            return f"[{kind.upper()}{tag}]" + m[0][n:]

        text = pattern.sub(put, text)
    return text, counts


def redacted(text: Column, tokens: bool = False) -> Column:
    """struct(text, counts): items masked in the order of FORMS, with their checks."""

    @F.pandas_udf("text string, counts map<string, bigint>")
    def run(s: pd.Series) -> pd.DataFrame:
        done = [redact(x, tokens) if isinstance(x, str) else (None, None) for x in s]
        return pd.DataFrame({"text": [a for a, _ in done], "counts": [b for _, b in done]})

    return run(text)


def redacted_all(texts: Column, tokens: bool = False) -> Column:
    """struct(texts, counts) of an array of texts: each masked, the items of all of them counted."""

    @F.pandas_udf("texts array<string>, counts map<string, bigint>")
    def run(s: pd.Series) -> pd.DataFrame:
        out, counted = [], []
        for values in s:
            counts: dict[str, int] = {}
            done = []
            for x in values if values is not None else ():
                text, own = redact(x, tokens) if isinstance(x, str) else (None, {})
                done.append(text)
                for kind, n in own.items():
                    counts[kind] = counts.get(kind, 0) + n
            out.append(done)
            counted.append(counts)
        return pd.DataFrame({"texts": out, "counts": counted})

    return run(texts)


def mask_form(text: Column, kind: str) -> Column:
    """Items of a form without a check, masked by a plain expression."""
    return F.regexp_replace(text, FORMS[kind], f"[{kind.upper()}]")


def collapse_html(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def collapse_xml(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def scalar_text(value: Column) -> Column:
    """Text of a scalar: null is empty, true 1, false 0, strings trimmed."""
    return F.coalesce(trimmed(value.cast("string")), F.lit(""))


def labelled(label: str, value: Column) -> Column:
    """[label] and the value on the next line; null for a blank value."""
    return F.when(trimmed(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f"[{label}]\n"), trimmed(value)))


def render(template: str, context: Column, question: Column) -> Column:
    """{context} and {question} filled in one pass: what is filled in isn't filled again."""
    out = []
    for part in re.split(r"(\{context\}|\{question\})", template):
        out.append({"{context}": context, "{question}": question}.get(part, F.lit(part)))
    return F.concat(*[c for c in out])


def key_alias(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9_-]", "_")
