"""Where documents come from: literals, files and object stores, URLs already fetched, rows of tables, evaluation sets."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

import pandas as pd
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .parsers import mime_of


def texts(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "content string").select(F.col("content").cast("binary").alias("content"), F.lit("text/plain").alias("mime"), F.lit("text").alias("source_type"), F.lit(None).cast("string").alias("document_key"))


def files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """Files under a path of any file system that Spark reads; files above `most_bytes` are left out by their length alone."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if most_bytes:
        rows = rows.where(F.col("length") <= most_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("content", mime_of(name, F.col("content")).alias("mime"), F.lit("storage").alias("source_type"), name.alias("document_key"))


def local_files(spark: SparkSession, paths: list[str], metadata: dict[str, str] | None = None) -> DataFrame:
    """The named files, each with its name in its metadata; a file that isn't there is an error."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(path)
    given = F.create_map(*[F.lit(x) for k, v in (metadata or {}).items() for x in (k, v)]) if metadata else F.create_map().cast("map<string, string>")
    rows = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("content", mime_of(name, F.col("content")).alias("mime"), F.lit("file").alias("source_type"), name.alias("document_key"), F.map_concat(F.create_map(F.lit("filename"), name), F.map_filter(given, lambda k, v: k != "filename")).alias("metadata"))


PAGE = "url string, content binary, mime string, status int, error string"


def web_pages(urls: DataFrame, fetch: Callable[[str, list[str]], tuple[int, str | None, bytes]], resolve: Callable[[str], list[str]]) -> DataFrame:
    """Pages of (url) rows: content, MIME type without parameters (HTML where none is named), status, and an error instead of either.

    Only public http and https addresses are asked: all addresses of the host are looked up once and `fetch` gets the very ones
    that were checked, so that a name can't point elsewhere in between. Redirects aren't followed: an answer that isn't 2xx is an error.
    """

    def one(url: str) -> tuple:
        addresses, refused = checked_addresses(url, resolve)
        if refused:
            return url, None, None, None, refused
        try:
            status, kind, body = fetch(url, addresses)
        except OSError as e:
            return url, None, None, None, f"no answer: {e}"
        if not 200 <= status < 300:
            return url, None, None, status, f"status {status}"
        return url, bytes(body), (kind or "text/html").split(";")[0].strip().lower() or "text/html", status, None

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([one(u) for u in pdf["url"]], columns=["url", "content", "mime", "status", "error"])

    return urls.select(F.col("url").cast("string").alias("url")).where("url is not null").mapInPandas(run, PAGE)


def row_files(rows: DataFrame, path: str, files_: DataFrame, most_bytes: int | None = None, strict: bool = False) -> DataFrame:
    """rows with the `content` of the file that a column names, and `skipped`: why there is none (missing, empty, too large).

    files_: path, length, content, as the binary file reader gives them. strict: the first such row ends the job.
    """
    held = files_.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("content").alias("_content"))
    both = rows.join(held, F.col(path) == F.col("_path"), "left")
    why = F.when(F.col(path).isNull() | F.col("_path").isNull(), "missing").when(F.col("_length") == 0, "empty")
    if most_bytes:
        why = why.when(F.col("_length") > most_bytes, "too large")
    out = both.withColumn("skipped", why)
    if strict:
        out = out.withColumn("skipped", F.when(F.col("skipped").isNotNull(), F.raise_error(F.concat(F.lit("file "), F.coalesce(F.col(path), F.lit("?")), F.lit(" is "), F.col("skipped"))).cast("string")))
    return out.withColumn("content", F.when(F.col("skipped").isNull(), F.col("_content"))).drop("_path", "_length", "_content")


def rows_as_text(rows: DataFrame, columns: list[str], key: str, kind: str) -> DataFrame:
    """Listed columns of a row joined by blank lines; nulls are skipped, structures written as JSON."""
    plain = dict(rows.dtypes)
    shown = [F.to_json(c) if plain[c].startswith(("array", "map", "struct")) else F.col(c).cast("string") for c in columns]
    return rows.select(F.concat_ws("\n\n", *shown).cast("binary").alias("content"), F.lit("text/plain").alias("mime"), F.lit("row").alias("source_type"), F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("document_key"))


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, relevant) from JSON files of objects with query and relevant or relevant_ids, one value or a list."""
    raw = spark.read.schema("query string, relevant string, relevant_ids string, note string").option("multiLine", "true").json(path)
    ids = F.coalesce("relevant", "relevant_ids")
    many = F.when(F.trim(ids).startswith("["), F.from_json(ids, "array<string>")).otherwise(F.array(ids))
    return raw.where("query is not null").select(T.text_hash(F.col("query")).alias("qid"), "query", F.filter(many, lambda x: x.isNotNull()).alias("relevant"), "note")


def public_address(url: str | None) -> bool:
    """http or https with a host that isn't a private, reserved or local address. Names are judged by their literal form."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith((".local", ".internal")):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return True


def checked_addresses(url: str | None, resolve: Callable[[str], list[str]]) -> tuple[list[str], str | None]:
    """All addresses of the URL's host, and why it must not be asked: by its form, without an address, or if one of them isn't public."""
    if not public_address(url):
        return [], "not a public http or https address"
    host = urlsplit(url).hostname
    try:
        found = [host] if _is_ip(host) else resolve(host)
    except OSError:
        found = []
    if not found:
        return [], "the host has no address"
    if not all(ipaddress.ip_address(a).is_global for a in found):
        return [], "the host has an address that isn't public"
    return found, None


def _is_ip(host: str) -> bool:
    try:
        ipaddress.ip_address(host)
    except ValueError:
        return False
    return True


def system_resolver(host: str) -> list[str]:
    """A and AAAA records by the resolver of the machine."""
    import socket

    return sorted({info[4][0] for info in socket.getaddrinfo(host, None)})


def safe_url(url: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda u: public_address(u if isinstance(u, str) else None))

    return run(url)


def source_ref(metadata: Column) -> Column:
    """First of url, filename, document_key, source_ref and key in JSON metadata."""
    return F.coalesce(*[F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit("")) for k in ("url", "filename", "document_key", "source_ref", "key")])
