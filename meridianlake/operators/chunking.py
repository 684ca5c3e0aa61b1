"""Texts into chunks. Fixed-size chunks are a plain expression; packing one piece after the other runs in Arrow batches.

Chunk structs: idx, start, content, heading, parent_idx, is_parent. start is an offset in characters, words (by tokens) or
sentences. Blank and null texts give no chunk.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = "array<struct<idx: int, start: int, content: string, heading: string, parent_idx: int, is_parent: boolean>>"
SEPARATORS = ("\n\n", "\n", ". ", " ")


def fixed(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of (start, content) of `size` characters, each starting size - overlap after the last; blank pieces are left out."""
    size = max(1, size)
    step = size - min(max(0, overlap), size - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(step)), lambda o: F.struct(o.alias("start"), F.substring(text, o + 1, F.lit(size)).alias("content")))
    return F.filter(pieces, lambda p: T.trimmed(p["content"]) != "")


def fixed_chunks(docs: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    return docs.select("*", F.posexplode(fixed(F.col(text), size, overlap)).alias("idx", "chunk")).select(*docs.columns, "idx", "chunk.start", "chunk.content")


def by_tokens(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Runs of words of at most `size` estimated tokens, at least one word; the next run repeats words of `overlap` tokens."""
    words = text.split()
    sums = [0, *accumulate(max(1, T.count_tokens(w)) for w in words)]
    at = 0
    while at < len(words):
        end = max(at + 1, bisect_right(sums, sums[at] + size) - 1)
        yield at, " ".join(words[at:end])
        back = at + 1
        if overlap > 0:
            while back < end and sums[end] - sums[back] > overlap:
                back += 1
            at = max(at + 1, min(back, end))
        else:
            at = end


def by_sentences(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Whole sentences up to `size` characters, at least one; overlap is a number of sentences."""
    body = text.strip(T.TRIM)
    sentences = [s.strip(T.TRIM) for s in re.split(r"(?<=[.!?])\s+", body) if s] if body else []
    at = 0
    while at < len(sentences):
        end, length = at + 1, len(sentences[at])
        while end < len(sentences) and length + 1 + len(sentences[end]) <= size:
            length += 1 + len(sentences[end])
            end += 1
        yield at, " ".join(sentences[at:end])
        at += max(1, end - at - max(0, overlap))


def pieces_within(text: str, size: int, base: int = 0, level: int = 0) -> Iterator[tuple[int, str]]:
    """(offset, piece) of at most `size` characters: cut at paragraphs, then lines, sentences, words and characters."""
    if len(text) <= size:
        if text.strip(T.TRIM):
            yield base, text
    elif level == len(SEPARATORS):
        for k in range(0, len(text), size):
            if text[k : k + size].strip(T.TRIM):
                yield base + k, text[k : k + size]
    else:
        mark, at = SEPARATORS[level], 0
        for part in text.split(mark):
            yield from pieces_within(part, size, base + at, level + 1)
            at += len(part) + len(mark)


def recursive(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Pieces joined by blanks up to `size`; the next chunk repeats last pieces of at most `overlap` characters.

    The overlap gives way where piece and overlap together would exceed the size: no chunk is longer than `size`.
    """
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    held: list[tuple[int, str]] = []
    length = 0
    for piece in pieces_within(text, size):
        if held and length + 1 + len(piece[1]) > size:
            yield held[0][0], " ".join(p for _, p in held)
            room = min(overlap, size - 1 - len(piece[1]))
            tail, length = [], -1
            for p in reversed(held[1:]):
                if length + 1 + len(p[1]) > room:
                    break
                tail.append(p)
                length += 1 + len(p[1])
            held = tail[::-1]
            length = max(length, 0) if held else 0
        length += len(piece[1]) + (1 if held else 0)
        held.append(piece)
    if held:
        yield held[0][0], " ".join(p for _, p in held)


def markdown_sections(text: str) -> Iterator[tuple[str | None, str]]:
    """(heading, section with its heading line); what comes before the first heading has none."""
    heading, lines = None, []
    for line in text.split("\n"):
        m = re.match(r"^#{1,6}\s+(.*)$", line)
        if m:
            if "".join(lines).strip(T.TRIM):
                yield heading, "\n".join(lines).strip(T.TRIM)
            heading, lines = m[1].strip(T.TRIM), [m[1].strip(T.TRIM)]
        else:
            lines.append(line)
    if "".join(lines).strip(T.TRIM):
        yield heading, "\n".join(lines).strip(T.TRIM)


def markdown(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, str | None]]:
    at = 0
    for heading, body in markdown_sections(text):
        for start, part in [(0, body)] if len(body) <= size else recursive(body, size, overlap):
            yield at + start, part, heading
        at += len(body)


STRATEGIES: dict[str, Callable] = {"tokens": by_tokens, "sentence": by_sentences, "recursive": recursive, "markdown": markdown}


def extend(name: str, strategy: Callable) -> None:
    """Register a strategy (text, size, overlap) -> (start, content[, heading]); a later one of the same name wins."""
    STRATEGIES[name] = strategy


def chunk_text(text: str | None, strategy: str, size: int, overlap: int, function: Callable | None = None, parent_size: int | None = None) -> list[tuple]:
    """Structs of one text. parent_child: chunks of `size` by `function` (recursive) inside parents of parent_size (five times the size), parents first."""
    if not text or not text.strip(T.TRIM):
        return []
    if strategy == "parent_child":
        parents = list(recursive(text, parent_size or size * 5, 0))
        out = [(k, start, body, None, None, True) for k, (start, body) in enumerate(parents)]
        for k, (start, body) in enumerate(parents):
            out += [(len(out) + n, start + c[0], c[1], c[2] if len(c) > 2 else None, k, False) for n, c in enumerate((function or recursive)(body, size, overlap))]
        return out
    return [(k, c[0], c[1], c[2] if len(c) > 2 else None, None, False) for k, c in enumerate((function or STRATEGIES[strategy])(text, size, overlap))]


def chunks(docs: DataFrame, text: str, strategy: str = "recursive", size: int = 1000, overlap: int = 200, child: str = "recursive", parent_size: int | None = None) -> DataFrame:
    """One row per chunk with the other columns of its document. Map-only: a document is chunked where it was read.

    child and parent_size: the strategy of the chunks inside parents, and the parents' size, for strategy parent_child.
    """
    named = child if strategy == "parent_child" else strategy
    if named not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {named!r}")
    function = STRATEGIES[named]

    @F.pandas_udf(SCHEMA)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([chunk_text(x if isinstance(x, str) else None, strategy, size, overlap, function, parent_size) for x in s])

    return docs.select("*", F.explode(run(F.col(text))).alias("chunk")).select(*docs.columns, "chunk.*")


def context_header(title: Column, heading: Column) -> Column:
    """Document: title > Section: heading, as far as there are any."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws(" > ", part("Document", title), part("Section", heading))


def embeddable(header: Column, content: Column) -> Column:
    return F.when(F.coalesce(header, F.lit("")) != "", F.concat(header, F.lit("\n\n"), content)).otherwise(content)
