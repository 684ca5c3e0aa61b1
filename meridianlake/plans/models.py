"""Rows of tables as documents: what of a row is text, which related rows belong to it, and keeping the index in step.

A definition names the parts of a row and its relations; compiling it is one join for each relation and level, for all roots at
once. Related rows are gathered per root: a relation of a root holds few rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import store as ST

MAX_DEPTH = 3


@dataclass(frozen=True)
class Definition:
    """rows with a key; parts in order: (label or None, column of the row, or a function of a column for files)."""

    name: str
    rows: DataFrame
    key: str
    parts: tuple[tuple[str | None, Column], ...] = ()
    relations: tuple[tuple[str, "Definition", str, str, bool], ...] = ()
    held: dict[str, Column] = field(default_factory=dict)
    document_key_: Column | None = None

    def add(self, label: str, value: Column) -> Definition:
        """A labelled part; blank values are left out."""
        return replace(self, parts=(*self.parts, (label, T.scalar_text(value))))

    def text(self, value: Column) -> Definition:
        return replace(self, parts=(*self.parts, (None, T.scalar_text(value))))

    def add_file(self, label: str, parsed: Column) -> Definition:
        """Text of a file that has been read and parsed into a column; missing and empty files are left out."""
        return replace(self, parts=(*self.parts, (label, T.trimmed(F.coalesce(parsed.cast("string"), F.lit(""))))))

    def include(self, relation: str, other: Definition, foreign_key: str) -> Definition:
        """A related row that this row points to by foreign_key."""
        return replace(self, relations=(*self.relations, (relation, other, foreign_key, other.key, False)))

    def include_many(self, relation: str, other: Definition, foreign_key: str) -> Definition:
        """Related rows that point to this one by foreign_key, in the order of their keys."""
        return replace(self, relations=(*self.relations, (relation, other, foreign_key, other.key, True)))

    def metadata(self, **values: Column) -> Definition:
        return replace(self, held={**self.held, **values})

    def document_key(self, value: Column) -> Definition:
        return replace(self, document_key_=value)


def searchable(name: str, rows: DataFrame, key: str, columns: list[str]) -> Definition:
    """A definition of the listed columns that hold text."""
    kinds = dict(rows.dtypes)
    out = Definition(name, rows, key)
    for c in columns:
        if kinds.get(c) == "string":
            out = out.text(F.col(c))
    return out


def _node(definition: Definition) -> Column:
    return F.concat(F.lit(f"{definition.name}:"), F.col(definition.key).cast("string"))


def _own_text(definition: Definition) -> Column:
    shown = [value if label is None else F.concat(F.lit(f"{label}: "), value) for label, value in definition.parts]
    blank = [F.when(value != "", text) for text, (_, value) in zip(shown, definition.parts)]
    return F.array_compact(F.array(*blank)) if blank else F.array().cast("array<string>")


def compile_definition(definition: Definition, depth: int = MAX_DEPTH) -> DataFrame:
    """(key, content, document_key, included, metadata): the text of each row with its related rows below `[relation]`.

    At most `depth` levels below the root. A row that stands on the way from the root isn't entered again, so cycles end;
    included are the nodes (name:key) of all related rows. Roots with blank texts have an empty content.
    """
    own = definition.rows.where(F.col(definition.key).isNotNull()).dropDuplicates([definition.key])
    out = own.select(F.col(definition.key).alias("key"), _own_text(definition).alias("parts"), _node(definition).alias("node"), F.coalesce(definition.document_key_ if definition.document_key_ is not None else _node(definition), _node(definition)).alias("document_key"), (F.create_map(*[x for k, v in definition.held.items() for x in (F.lit(k), v.cast("string"))]) if definition.held else F.create_map().cast("map<string, string>")).alias("metadata"))
    below = _below(definition, own.select(F.col(definition.key).alias("root"), F.col(definition.key).alias("at"), F.array(_node(definition)).alias("way")), depth)
    if below is not None:
        # One row for each related row: its place in the depth-first order, its node and its text.
        gathered = below.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("place", "node", "text"))).alias("all"))
        out = out.join(gathered, out["key"] == gathered["root"], "left").drop("root")
        # A row reached on several ways stands where it comes first.
        first = F.aggregate(F.coalesce("all", F.array().cast(gathered.schema["all"].dataType)), F.array().cast(gathered.schema["all"].dataType), lambda s, x: F.when(F.exists(s, lambda y: y["node"] == x["node"]), s).otherwise(F.array_append(s, x)))
        out = out.withColumn("all", first)
        texts = F.filter(F.transform("all", lambda x: x["text"]), lambda x: x.isNotNull())
        return out.select("key", F.array_join(F.concat("parts", texts), "\n\n").alias("content"), "document_key", F.transform("all", lambda x: x["node"]).alias("included"), "metadata")
    return out.select("key", F.array_join("parts", "\n\n").alias("content"), "document_key", F.array().cast("array<string>").alias("included"), "metadata")


def _below(definition: Definition, at: DataFrame, depth: int, place: Column | None = None) -> DataFrame | None:
    """(root, place, node, text) of all rows related to those in `at` (root, at, way, place)."""
    if depth == 0:
        return None
    found = None
    base = F.array().cast("array<string>") if place is None else place
    for number, (relation, other, foreign, key, many) in enumerate(definition.relations):
        theirs = other.rows.where(F.col(key).isNotNull()).dropDuplicates([key])
        order = F.lpad(F.col(key).cast("string"), 20, "0")
        body = F.array_join(_own_text(other), "\n\n")
        shown = theirs.select(F.col(key).alias("next"), (F.col(foreign) if many else F.col(key)).alias("meets"), _node(other).alias("node"), F.when(body != "", F.concat(F.lit(f"[{relation}]\n"), body)).alias("text"), order.alias("order"))
        here = at
        if not many:
            points = definition.rows.select(F.col(definition.key).alias("own"), F.col(foreign).alias("to")).dropDuplicates(["own"])
            here = at.join(points, at["at"] == points["own"]).drop("own", "at").withColumnRenamed("to", "at")
        step = here.join(shown, here["at"] == shown["meets"]).where(~F.array_contains("way", F.col("node")))
        path = F.concat(F.col("place") if "place" in here.columns else base, F.array(F.lit(f"{number:03d}"), F.col("order")))
        step = step.select("root", F.col("next").alias("at"), F.concat("way", F.array("node")).alias("way"), path.alias("place"), "node", "text")
        one = step.select("root", "place", "node", "text")
        found = one if found is None else found.unionByName(one)
        deeper = _below(other, step.select("root", "at", "way", "place"), depth - 1)
        if deeper is not None:
            found = found.unionByName(deeper)
    return found


def sync_plan(compiled: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_key, change, content): compiled rows against live documents (document_key, content_hash, status).

    An empty text forgets its document; a text that is indexed as it is needs nothing; one that is held but not indexed is
    processed again; documents of rows that are gone are forgotten.
    """
    now = compiled.select("document_key", "content", T.text_hash(F.col("content")).alias("now"), (T.trimmed("content") == "").alias("blank"))
    both = now.join(documents.select("document_key", F.col("content_hash").alias("was"), "status"), "document_key", "full")
    change = F.when(F.col("now").isNull() | F.col("blank"), F.when(F.col("was").isNotNull(), "forget")).when(F.col("was").isNull(), "add").when(F.col("was") != F.col("now"), "update").when(F.col("status") != "indexed", "process")
    return both.withColumn("change", change).where("change is not null").select("document_key", "change", F.when(F.col("change") != "forget", F.col("content")).alias("content"))


def other_generations(documents: DataFrame) -> DataFrame:
    """Ids of documents that a later version of the same key has replaced."""
    newest = ST.latest(documents.where(ST.LIVE), ["tenant_id", "document_key"], [F.desc("version"), F.desc("id")])
    return documents.where("document_key is not null").join(newest.select("id"), "id", "left_anti").select("id")


def resolve(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with `model` and `model_key`: by the hit's own embeddable_type and embeddable_id, else by those of its document."""
    rows = documents.select(F.col("id").alias("document_id"), F.col("embeddable_type").alias("_type"), F.col("embeddable_id").alias("_id"))
    own = {c: F.col(c) if c in hits.columns else F.lit(None).cast("string") for c in ("embeddable_type", "embeddable_id")}
    both = hits.withColumn("_own_type", own["embeddable_type"]).withColumn("_own_id", own["embeddable_id"]).join(rows, "document_id", "left")
    whole = F.col("_own_type").isNotNull() & F.col("_own_id").isNotNull()
    return both.withColumn("model", F.when(whole, F.col("_own_type")).otherwise(F.col("_type"))).withColumn("model_key", F.when(whole, F.col("_own_id")).otherwise(F.col("_id"))).drop("_own_type", "_own_id", "_type", "_id")


def touched_roots(changes: DataFrame, foreign_key: str) -> DataFrame:
    """Keys of the parents whose children changed."""
    return changes.where(F.col(foreign_key).isNotNull()).select(F.col(foreign_key).alias("key")).distinct()


def auto_sync(definition: Callable[[DataFrame], Definition], apply: Callable[[DataFrame, int], None], depth: int = MAX_DEPTH):
    """foreachBatch handler of a change stream: the changed rows of a batch are compiled and handed to `apply`, which writes them.

    Rows with `deleted` set come out with an empty content, which forgets them. A batch that is delivered again has the same
    number: `apply` overwrites what it wrote under it.
    """

    def run(batch: DataFrame, number: int) -> None:
        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        made = definition(batch.where(~gone))
        out = compile_definition(made, depth).select("document_key", "content")
        if "deleted" in batch.columns:
            named = definition(batch.where(gone))
            out = out.unionByName(named.rows.select(_node(named).alias("document_key"), F.lit("").alias("content")))
        apply(out, number)

    return run
