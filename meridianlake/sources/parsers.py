"""Formats into text and sections: one parser per MIME type, run in Arrow batches. The last registered parser wins."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PARSED = "struct<text: string, sections: array<struct<type: string, content: string, level: int, page: int>>, metadata: map<string, string>, error: string>"

# MIME type by file extension.
BY_EXTENSION = {"txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "xml": "application/xml", "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}

#: Bounds against archives that unpack to far more than they hold.
DOCX_TOTAL, DOCX_XML, DOCX_PARAGRAPHS = 20 << 20, 12 << 20, 500_000


csv.field_size_limit((1 << 31) - 1)  # a field may be as long as its document


class ParseError(ValueError):
    pass


def plain(data: bytes) -> dict:
    return {"text": decode(data)}


def decode(data: bytes | str) -> str:
    return data if isinstance(data, str) else data.decode("utf-8", "replace")


def markdown(data: bytes) -> dict:
    text = decode(data)
    found = re.findall(r"^(#{1,6})\s+(.*)$", text, re.M)
    return {"text": text, "sections": [("heading", body.strip(), len(marks), None) for marks, body in found]}


class _Page(HTMLParser):
    """Text of the body, title and headings; scripts, styles and noscript parts are left out."""

    HIDDEN = ("script", "style", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body: list[str] = []
        self.title: list[str] = []
        self.headings: list[tuple[int, list[str]]] = []
        self.hidden = 0
        self.in_head = self.in_title = False
        self.open: list[list[str]] = []

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # `<![` before anything but the name of a section is a comment up to the next `>`, as in browsers
            return self.parse_bogus_comment(i, report)

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "title":
            self.in_title = True
        elif re.fullmatch(r"h[1-6]", tag):
            self.headings.append((int(tag[1]), []))
            self.open.append(self.headings[-1][1])

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "head":
            self.in_head = False
        elif tag == "title":
            self.in_title = False
        elif re.fullmatch(r"h[1-6]", tag) and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.in_title:
            self.title.append(data)
        elif not self.in_head:
            self.body.append(data)
            for h in self.open:
                h.append(data)


def html_page(data: bytes) -> dict:
    page = _Page()
    page.feed(decode(data))
    page.close()
    squeeze = lambda s: re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\xa0]+", " ", s)).strip()
    found = [(level, re.sub(r"\s+", " ", "".join(parts)).strip()) for level, parts in page.headings]
    sections = [("heading", body, level, None) for level, body in sorted(found, key=lambda x: x[0]) if body]
    title = "".join(page.title).strip()
    return {"text": squeeze("".join(page.body)), "sections": sections, "metadata": {"title": title} if title else {}}


def xml_document(data: bytes) -> dict:
    text = decode(data.replace(b"\x00", b"") if isinstance(data, bytes) else data)
    if re.search(r"<!\s*(DOCTYPE|ENTITY)", text, re.I):
        raise ParseError("document type and entity declarations are refused")
    try:
        root = ElementTree.fromstring(data if isinstance(data, bytes) else data.encode())
    except (ElementTree.ParseError, LookupError, ValueError) as e:  # the latter two: an encoding that can't be read
        raise ParseError(str(e)) from None
    return {"text": re.sub(r"\s+", " ", "".join(root.itertext())).strip(), "metadata": {"root": re.sub(r"^\{.*\}", "", root.tag)}}


def delimited(data: bytes, mark: str | None = None) -> dict:
    """Rows as `column: value | ...` lines; the delimiter is the most frequent of , ; and tab in the first line."""
    lines = [x for x in decode(data).replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
    if not lines:
        return {"text": ""}
    mark = mark or max((",", ";", "\t"), key=lines[0].count)
    table = [next(csv.reader([line], delimiter=mark), []) for line in lines]
    head = [h.strip() for h in table[0]]
    out = [" | ".join(f"{h}: {v.strip()}" for h, v in zip(head, row)) for row in table[1:]]
    return {"text": "\n".join(out), "sections": [("table", x, 0, None) for x in out], "metadata": falsy_free({"columns": head if any(head) else [], "row_count": len(out)})}


def flat_json(value, path: str = "") -> list[str]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flat_json(v, f"{path}.{k}" if path else str(k))]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in flat_json(v, f"{path}.{k}" if path else str(k))]
    shown = value if isinstance(value, str) else json.dumps(value)
    return [f"{path}: {shown}" if path else shown]


def json_document(data: bytes) -> dict:
    try:
        text = "\n".join(flat_json(json.loads(decode(data))))
        text.encode()  # half of a surrogate pair is no text
        return {"text": text}
    except (ValueError, RecursionError) as e:
        raise ParseError(f"invalid JSON: {e}") from None


def docx(data: bytes) -> dict:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if sum(i.file_size for i in z.infolist()) > DOCX_TOTAL or z.getinfo("word/document.xml").file_size > DOCX_XML:
                raise ParseError("archive is too large")
            body = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError) as e:
        raise ParseError(f"not a text document: {e}") from None
    paragraphs = body.split("</w:p>")
    if len(paragraphs) > DOCX_PARAGRAPHS:
        raise ParseError("too many paragraphs")
    texts, sections = [], []
    for p in paragraphs:
        words = html.unescape("".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p))).strip()
        if words:
            texts.append(words)
            style = re.search(r'<w:pStyle\s+w:val="(Heading|Title)(\d?)', p)
            if style:
                sections.append(("heading", words, int(style[2] or 1), None))
    return {"text": "\n".join(texts), "sections": sections}


def falsy_free(metadata: dict) -> dict[str, str]:
    """Metadata without empty values: null, false, 0, '0', '' and empty lists leave no key; lists are joined by commas."""
    return {k: ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for k, v in metadata.items() if v and v != "0"}


#: Text of an image of a page; the null driver finds none. Set `OCR["driver"]` to a function bytes -> text.
OCR: dict[str, Callable[[bytes], str]] = {"driver": lambda data: ""}
OCR_BELOW = 16


def pdf_parser(pages: Callable[[bytes], tuple[list[str], dict]], ocr: Callable[[bytes], str] | None = None) -> Callable[[bytes], dict]:
    """A parser of PDF from a reader of its pages: data -> (texts of the pages, metadata).

    Pages are sections with their number, their texts joined by blank lines. Where these hold fewer than OCR_BELOW characters, the
    text is that of the OCR driver if it finds any; its failures count as none.
    """

    def run(data: bytes) -> dict:
        texts, held = pages(data)
        body = "\n\n".join(t.strip() for t in texts if t.strip())
        sections = [("page", t.strip(), 0, n + 1) for n, t in enumerate(texts) if t.strip()]
        if len(body.strip()) < OCR_BELOW:
            try:
                seen = (ocr or OCR["driver"])(data)
            except Exception:  # noqa: BLE001 - a failed recognition is no text
                seen = ""
            body = seen.strip() or body
        return {"text": body, "sections": sections, "metadata": falsy_free({"title": held.get("title"), "author": held.get("author"), "page_count": len(texts)})}

    return run


def pypdf_pages(data: bytes) -> tuple[list[str], dict]:
    """Pages by an optional library."""
    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(data))
    info = reader.metadata
    return [p.extract_text() or "" for p in reader.pages], {"title": info and info.title, "author": info and info.author}


PARSERS: dict[str, Callable[[bytes], dict]] = {
    "text/plain": plain, "text/markdown": markdown, "text/html": html_page, "application/xhtml+xml": html_page, "application/xml": xml_document, "text/xml": xml_document, "text/csv": delimited,
    "text/tab-separated-values": lambda d: delimited(d, "\t"), "application/json": json_document, BY_EXTENSION["docx"]: docx,
}


try:
    import pypdf  # noqa: F401
except ImportError:
    pass
else:
    PARSERS["application/pdf"] = pdf_parser(pypdf_pages)


def register(mime: str, parser: Callable[[bytes], dict]) -> None:
    PARSERS[mime.lower()] = parser


def parse_one(data, mime: str | None, parsers: dict | None = None) -> dict:
    """text, sections, metadata and, where it can't be parsed, error. A type without a parser is an error."""
    kind = (mime or "text/plain").split(";")[0].strip().lower()
    parser = (parsers or PARSERS).get(kind)
    empty = {"text": None, "sections": [], "metadata": {}, "error": None}
    if data is None:
        return empty
    if parser is None:
        return empty | {"error": f"no parser for {kind}"}
    try:
        return empty | parser(bytes(data) if isinstance(data, (bytes, bytearray, memoryview)) else data.encode())
    except ParseError as e:
        return empty | {"error": str(e)}


def parsed(content: Column, mime: Column) -> Column:
    """struct(text, sections, metadata, error) of each document."""
    parsers = dict(PARSERS)

    @F.pandas_udf(PARSED)
    def run(data: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        rows = [parse_one(d, m if isinstance(m, str) else None, parsers) for d, m in zip(data, kinds)]
        return pd.DataFrame({k: [r[k] for r in rows] for k in ("text", "sections", "metadata", "error")})

    return run(content, mime)


def mime_of(path: Column, content: Column | None = None) -> Column:
    """MIME type by extension, else by the first bytes, else plain text."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text/plain")
    if content is not None:
        head = F.substring(content.cast("string"), 1, 64)
        out = F.when(head.startswith("%PDF"), "application/pdf").when(head.startswith("PK"), BY_EXTENSION["docx"]).when(F.lower(F.ltrim(head)).rlike("^<(!doctype html|html)"), "text/html").when(F.ltrim(head).startswith("<?xml"), "application/xml").otherwise(out)
    for name, mime in BY_EXTENSION.items():
        out = F.when(extension == name, mime).otherwise(out)
    return out


def headings(text: Column) -> Column:
    """Array of (level, content) of the headings of Markdown text, as a plain expression."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^#{1,6}\s+"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)).alias("level"), T.trimmed(F.regexp_replace(x, r"^#{1,6}\s+", "")).alias("content")))


def parse_documents(sources: DataFrame, content: str = "content", mime: str = "mime") -> DataFrame:
    return sources.withColumn("parsed", parsed(F.col(content), F.col(mime)))
