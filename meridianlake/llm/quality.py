"""Per-document text statistics, exact ranks within a language, outlier scores and a verdict.

A first pass learns the common words of each language. One map-only pass over the texts gives the statistics, among them the
share of characters in list, table and junk lines. The values are range-partitioned by (language, statistic, value) with a
salt, so that a value which many texts share is spread over several partitions; counts within a partition plus the offsets of
the partitions before are exact ranks, without a sort of one language in one task. Each rank becomes an empirical tail
probability; the score of a document adds up their negative logarithms and decides which documents are outliers. Their lines
then tell the kind, and whether it is that of most of the characters.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: (statistic, tail that speaks against prose)
STATISTICS = (("sentence_density", "low"), ("line_end_share", "low"), ("common_share", "low"), ("symbol_ratio", "high"), ("digit_ratio", "high"), ("mean_word_length", "both"), ("distinct_share", "low"), ("formed_share", "high"))
SIDES = dict(STATISTICS)
#: Score from which on a document is an outlier: the mean of as many independent surprises.
OUTLIER = float(len(STATISTICS))
#: The ranks among the texts of all languages.
ALL = "*"
#: Common words are the most widespread ones of a language that stand in a twentieth of its texts, for languages with at least
#: LEAST_SHARE of the texts.
COMMON_WORDS = 60
LEAST_SHARE = 0.005
#: Range-partitioned rows of one task, about.
ROWS_IN_TASK = 250_000

WORD = re.compile(r"[^\W_]+")
END = re.compile(r"[.!?…][\"'»”’)\]*]*(?=\s|$)")
NUMBERED = re.compile(r"^[ \t]*\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})\.\s", re.M)
BULLET = re.compile(r"\s*(?:[*•\-–+▪◦‣·○●]\s|\[[ xX]?\]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)]\s)")
HEX = re.compile(r"\s*(?:0x)?[0-9a-fA-F]{4,16}:?\s+(?:[0-9a-fA-F]{2,4}\s+){3,}")
BLOB = re.compile(r"\S{32,}")
MARKUP = re.compile(r"<[^<>]*>|&#?\w+;|\{\{[^{}]*\}\}|[{}<>]")
PAIR = re.compile(r"[\w .\-/]{1,30}:\s?[^:]{0,40}$")
RULE = re.compile(r"[\s|+\-=:_]{3,}$")
GAP = re.compile(r"\S {3,}(?=\S)")
WIDE = re.compile(r"\S {7,}\S")


SIGN = re.compile(r"[^\w\s]|_")
HIGH = re.compile(r"[^\x00-\x7f]")
STRIPPED = ".,;:-"
ITEMS = re.compile(r"[,;/·|•]\s|\s[-–/|>→»]\s")
SEPARATORS = ",;/·|•-–>→»"
SENTENCES = re.compile(r"[.!?\n]+")


def line_kind(line: str, letters: int) -> str | None:
    """list, table or junk by the form of one line alone; None if the form says nothing. letters: those in its words.

    Each costly test stands behind one that it implies.
    """
    if HEX.match(line):
        return "junk"
    n, tokens = len(line), line.split()
    marked = sum(len(m) for m in MARKUP.findall(line)) if "<" in line or "&" in line or "{" in line else 0
    if marked > 0.5 * n:
        return "junk"
    sizes = list(map(len, tokens))
    visible = sum(sizes)
    if max(sizes, default=0) > 0.6 * n:
        blob = max(map(len, BLOB.findall(line)), default=0)
        if blob > 0.6 * n and "--" not in line and sum(map(line.count, "|\t;,")) < 2:
            return "junk"
    if len(tokens) >= 8 and "|" not in line and visible - sum(map(line.count, STRIPPED)) <= 1.6 * len(tokens):
        bare = [b for b in (t.strip(STRIPPED) for t in tokens) if b]
        if sum(map(len, bare)) <= 1.6 * len(bare):
            return "junk"
    signs = SIGN.findall(line) if visible - letters > 0.5 * visible else []
    if len(signs) > 0.7 * visible and len(set(signs) - set("|+-=:_. ")) >= 1 and (len(set(signs)) >= 4 or len(tokens) == 1):
        return "junk"
    pipes = line.count("|")
    if RULE.match(line) or pipes >= 2 or line.count("\t") >= 2 or "   " in line and (len(GAP.findall(line)) >= 2 or WIDE.search(line) or line.startswith(" " * 10)):
        return "table"
    if BULLET.match(line):
        return "list"
    if not line.isascii():
        high = HIGH.findall(line)
        if sum(not c.isalpha() for c in high) + sum(map("ÃÂÐâï\ufffd".__contains__, high)) > 0.4 * n:
            return "junk"
    if (semi := line.count(";")) >= 2 and line.count(" ") <= semi or (commas := line.count(",")) >= 2 and line.count(" ") < 0.5 * commas:
        return "table"
    if ":" in line:
        if pipes and " | " in line and PAIR.match(line.split(" | ")[0]):
            return "table"
        if 1 < len(tokens) <= 8 and not line.endswith(":") and PAIR.match(line):
            return "table"
    return None


def shares(lines: list[tuple[str, list[str]]], common: frozenset[str]) -> dict[str, float]:
    """Share of the non-blank characters that stand in list, table and junk lines. lines: those that aren't blank, with their words."""
    total, got, open_run = 0, {"list": 0, "table": 0, "junk": 0}, []

    def close():
        # Several lines in a row without the end of a sentence are entries, not wrapped prose.
        if len(open_run) >= 4 or len(open_run) == 3 and max(open_run) < 50:
            got["list"] += sum(open_run)
        open_run.clear()

    for line, words in lines:
        n = len(line.strip())
        total += n
        kind = line_kind(line, sum(map(len, words)))
        if kind is None:
            distinct = len(set(words))
            ends = END.findall(line)
            said = [s.strip() for s in END.split(line)] if distinct <= 0.5 * len(words) else []
            again = len(set(said)) <= 0.34 * len(said) if len(said) > 2 else distinct <= 0.15 * len(words)
            if said and again and len(words) >= (60 if len(said) > 2 else 10):
                kind = "junk"
            elif len(ends) <= 1 + len(words) // 120:
                items = len(ITEMS.findall(line)) + 1 if sum(map(line.count, SEPARATORS)) >= 4 else 1
                if items >= 5 and len(words) <= 6 * items:
                    kind = "list"
                elif len(words) >= 12 and sum(map(common.__contains__, words)) <= 0.08 * len(words):
                    kind = "junk"
            if kind is None and not ends and n < 90 and not line.rstrip().endswith((":", ",")):
                open_run.append(n)
                continue
        close()
        if kind:
            got[kind] += n
    close()
    out = {k: v / total if total else 0.0 for k, v in got.items()}
    whole = [s for s in map(str.strip, SENTENCES.split("\n".join(x for x, _ in lines))) if s]
    if len(whole) >= 5 and len(set(whole)) <= 0.3 * len(whole) and out["table"] < 0.5:
        out = {"list": 0.0, "table": 0.0, "junk": 1.0}
    return out


def lines_of(text: str) -> list[tuple[str, list[str]]]:
    """The lines that aren't blank, each with its lower-case words."""
    return [(x, WORD.findall(x.lower())) for x in text.split("\n") if x.strip()]


ENDINGS = (".", "!", "?", "…", '."', ".»", ".)", ":")


def statistics(text: str, lines: list[tuple[str, list[str]]], common: frozenset[str]) -> dict[str, float]:
    words = [w for _, ws in lines for w in ws]
    n, visible = len(words), max(1, len(text) - text.count(" ") - text.count("\n"))
    letters = sum(map(len, words))
    digits = sum(map(len, filter(str.isdigit, words)))
    return {
        "words": n,
        "mean_word_length": round(letters / n, 3) if n else 0.0,
        "symbol_ratio": round(max(0.0, 1 - letters / visible), 4),
        "digit_ratio": round(digits / visible, 4),
        "line_end_share": round(sum(x.rstrip().endswith(ENDINGS) for x, _ in lines) / max(1, len(lines)), 4),
        "common_share": round(sum(map(common.__contains__, words)) / n, 4) if n else 0.0,
        "distinct_share": round(len(set(words)) / n, 4) if n else 0.0,
        "sentence_density": round(max(0, len(END.findall(text)) - len(NUMBERED.findall(text))) / n, 4) if n else 0.0,
    }


COLUMNS = ["doc_id", "lang", "copy", "words", *(s for s, _ in STATISTICS), "list_share", "table_share", "junk_share"]
SCHEMA = "doc_id long, lang string, copy long, words long, " + ", ".join(f"{s} double" for s, _ in STATISTICS) + ", list_share double, table_share double, junk_share double"


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.lower(F.substring(F.trim(F.col("lang").cast("string")), 1, 2)), F.lit("un")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())


def common_words(docs: DataFrame) -> frozenset[str]:
    """The COMMON_WORDS words that most texts of a language hold, of every language with LEAST_SHARE of the texts.

    All texts are counted, but for those that stand in more than a hundredth of all rows: copies of at most a hundred texts. One set for all languages, since labels are missing or wrong.
    """
    rows = _rows(docs)
    total = rows.count()
    copies = [r["copy"] for r in rows.groupBy(F.xxhash64("text").alias("copy")).count().where(F.col("count") > max(1, total // 100)).select("copy").collect()]  # at most 100 rows
    once = rows.where(~F.xxhash64("text").isin(copies)) if copies else rows

    def count(frames):
        held: dict[str, Counter] = {}
        for pdf in frames:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                held.setdefault(lang, Counter()).update(set(WORD.findall(text.lower())))
            if sum(map(len, held.values())) > 500_000:
                yield _flat(held)
                held = {}
        yield _flat(held)

    counted = once.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    large = {r["lang"]: r["count"] for r in once.groupBy("lang").count().where(F.col("count") >= max(1, total * LEAST_SHARE)).collect()}  # at most 1 / LEAST_SHARE rows
    # The group limit leaves COMMON_WORDS words of a language in each task before anything is shuffled.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    least = F.create_map(*[F.lit(x) for lang, n in large.items() for x in (lang, max(2.0, n / 20))]) if large else F.create_map().cast("map<string, double>")
    best = counted.where(F.col("n") >= F.try_element_at(least, "lang")).where(F.col("word").rlike(r"^\p{L}+$")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= COMMON_WORDS)
    return frozenset(r["word"] for r in best.select("word").collect())  # COMMON_WORDS / LEAST_SHARE rows at most


def _flat(held: dict[str, Counter]) -> pd.DataFrame:
    return pd.DataFrame([(lang, w, n) for lang, counter in held.items() for w, n in counter.items()], columns=["lang", "word", "n"])


def text_statistics(docs: DataFrame, common: frozenset[str]) -> DataFrame:
    """Statistics of each non-blank text, one row per doc_id, and a hash that is the same for its exact copies; null and blank texts have no row."""
    held = docs.sparkSession.sparkContext.broadcast(common)  # COMMON_WORDS / LEAST_SHARE words at most

    def run(frames):
        words = held.value
        for pdf in frames:
            got = []
            for key, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
                if not text.strip():
                    continue
                lines = lines_of(text)
                k = shares(lines, words)
                s = statistics(text, lines, words) | {"formed_share": sum(k.values())}
                got.append((key, lang, xxhash.xxh64_intdigest(text) - (1 << 63), s["words"], *(float(s[x]) for x, _ in STATISTICS), k["list"], k["table"], k["junk"]))
            yield pd.DataFrame(got, columns=COLUMNS)

    return _rows(docs).mapInPandas(run, SCHEMA)


def tails(values: DataFrame, rows: int) -> DataFrame:
    """values with at_or_below, at_or_above and total: exact ranks of each row's value within (lang, stat).

    values: key, lang (a hash of the language), stat (its number), value, weight; rows: about how many. Rows of weight 1 are counted, those of weight 0 ranked among them. Ties share their
    tails, in whichever partitions they lie. What comes to the driver is a row for each partition and each (lang, stat) that
    begins in it: bounded by partitions + languages x statistics.
    """
    spark = values.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_IN_TASK))
    order = ["lang", "stat", "value"]
    ranged = cut(values.repartitionByRange(parts, *order, F.xxhash64("key").alias("salt")).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    def whole(frames) -> pd.DataFrame | None:
        frames = list(frames)  # one range of about ROWS_IN_TASK rows
        return pd.concat(frames, ignore_index=True) if frames else None

    def groups(pdf: pd.DataFrame):
        """Runs of equal (lang, stat) in one sorted range."""
        lang, stat = pdf["lang"].to_numpy(), pdf["stat"].to_numpy()
        at = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (stat[1:] != stat[:-1])])
        for a, b in zip(at, np.r_[at[1:], len(pdf)]):
            yield int(lang[a]), int(stat[a]), pdf["key"].to_numpy()[a:b], pdf["value"].to_numpy()[a:b], pdf["weight"].to_numpy()[a:b]

    def summed(frames):
        pdf = whole(frames)
        if pdf is not None and len(pdf):
            part = int(pdf["part"].iloc[0])
            got = [(part, lang, stat, w.sum(), v[0], v[-1], w[v == v[0]].sum(), w[v == v[-1]].sum()) for lang, stat, _, v, w in groups(pdf)]
            yield pd.DataFrame(got, columns=["part", "lang", "stat", "n", "first", "last", "first_n", "last_n"])

    got = ranged.mapInPandas(summed, "part int, lang long, stat int, n long, first double, last double, first_n long, last_n long").toPandas()
    got = got.sort_values(["lang", "stat", "part"], ignore_index=True)
    known: dict[tuple[int, int, int], tuple[int, int, int, int]] = {}
    for (lang, stat), g in got.groupby(["lang", "stat"]):
        n, total = g["n"].to_numpy(), int(g["n"].sum())
        before = np.cumsum(n) - n
        # Equal values of the partitions beside: runs of partitions whose ends meet.
        earlier, later = np.zeros(len(g), dtype=np.int64), np.zeros(len(g), dtype=np.int64)
        first, last, first_n, last_n = (g[c].to_numpy() for c in ("first", "last", "first_n", "last_n"))
        for k in range(1, len(g)):
            if last[k - 1] == first[k]:
                earlier[k] = last_n[k - 1] + (earlier[k - 1] if first[k - 1] == last[k - 1] else 0)
        for k in range(len(g) - 2, -1, -1):
            if first[k + 1] == last[k]:
                later[k] = first_n[k + 1] + (later[k + 1] if first[k + 1] == last[k + 1] else 0)
        for k, part in enumerate(g["part"]):
            known[int(part), int(lang), int(stat)] = (int(before[k]), int(earlier[k]), int(later[k]), total)
    held = spark.sparkContext.broadcast(known)

    def ranked(frames):
        pdf = whole(frames)
        if pdf is None or not len(pdf):
            return
        part = int(pdf["part"].iloc[0])
        for lang, stat, key, value, weight in groups(pdf):
            before, earlier, later, total = held.value[part, lang, stat]
            upto = np.concatenate([[0], np.cumsum(weight)])
            low, high = np.searchsorted(value, value, "left"), np.searchsorted(value, value, "right")
            below = before + upto[high] + np.where(value == value[-1], later, 0)
            above = total - before - upto[low] + np.where(value == value[0], earlier, 0)
            yield pd.DataFrame({"key": key, "lang": lang, "stat": np.int32(stat), "value": value, "at_or_below": below, "at_or_above": above, "total": total})

    return ranged.mapInPandas(ranked, "key long, lang long, stat int, value double, at_or_below long, at_or_above long, total long")


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: statistics, outlier score and verdict (prose, list, table or junk).

    The score adds up the surprises (negative logarithms of the tail probabilities) of all statistics; a tail is the smaller one
    of those among the distinct texts of the language and of all languages, so copies weigh as one text and texts with a rare,
    missing or wrong label are told by all others. Documents from OUTLIER on are outliers; an outlier of whose characters more
    than half stand in list, table or junk lines gets the kind with the largest share, any other text is prose. Where most
    of all texts are no prose, they are no outliers. Null and blank texts have no row. A missing language is a
    language of its own. Repeated doc_ids count once. An empty table gives no rows.
    """
    read = cut(text_statistics(docs, common_words(docs)).dropDuplicates(["doc_id"]))
    first = read.groupBy("lang", "copy").agg(F.min("doc_id").alias("doc_id"))
    every = read.groupBy("copy").agg(F.min("doc_id").alias("doc_id"))
    weights = first.select("doc_id", F.lit(1).alias("own")).join(every.select("doc_id", F.lit(1).alias("any")), "doc_id", "left")
    stats = cut(read.join(weights, "doc_id", "left").drop("copy").fillna(0, ["own", "any"]))
    pairs = F.explode(F.array([F.struct(F.col(lang).alias("lang"), F.lit(k).alias("stat"), F.col(s).alias("value"), F.col(weight).cast("long").alias("weight")) for k, (s, _) in enumerate(STATISTICS) for lang, weight in (("within", "own"), ("all", "any"))])).alias("v")
    pooled = F.xxhash64(F.lit(ALL))
    long = stats.withColumn("within", F.xxhash64("lang")).withColumn("all", pooled).select(F.col("doc_id").alias("key"), pairs).select("key", "v.lang", "v.stat", "v.value", "v.weight")
    low, high = F.col("at_or_below") / F.col("total"), F.col("at_or_above") / F.col("total")
    p = {"low": low, "high": high, "both": F.least(F.lit(1.0), 2 * F.least(low, high))}
    ranked = tails(long, 2 * len(STATISTICS) * stats.count())
    least = ranked.groupBy(F.col("key").alias("doc_id")).agg(*[F.min(F.when(F.col("stat") == k, p[side])).alias(s) for k, (s, side) in enumerate(STATISTICS)], F.max(F.when(F.col("lang") != pooled, F.col("total"))).alias("ranked_among"))
    each = [F.struct((-F.log(F.col(s))).alias("s"), F.lit(s).alias("name")) for s, _ in STATISTICS]
    surprise = least.select("doc_id", "ranked_among", F.array(*each).alias("e")).select("doc_id", F.aggregate("e", F.lit(0.0), lambda a, x: a + x["s"]).alias("outlier_score"), F.array_max("e")["s"].alias("top_surprise"), F.array_max("e")["name"].alias("top_statistic"), "ranked_among")
    most = F.greatest("list_share", "table_share", "junk_share")
    kind = F.when(F.col("junk_share") == most, "junk").when(F.col("table_share") == most, "table").otherwise("list")
    outlier = (F.col("outlier_score") >= OUTLIER) & (F.col("formed_share") > 0.5)
    return stats.drop("own", "any").join(surprise, "doc_id").withColumn("verdict", F.when(outlier, kind).otherwise("prose"))


def found(docs: DataFrame) -> DataFrame:
    return quality(docs).where(F.col("verdict") != "prose").select("doc_id", F.col("verdict").alias("kind"))
