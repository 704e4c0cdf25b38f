"""Reference resolution as equi-joins keyed by document: links, notes, citations, headings, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "label"]


def last_definitions(definitions: DataFrame, kind: str = "link_definition") -> DataFrame:
    """One definition per label: the last in the document wins."""
    rows = definitions.where(F.col("kind") == kind)
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("value", "title"), "line_no").alias("d")).select(*KEY, F.col("d.value").alias("href"), F.col("d.title").alias("title"))


def resolve_links(references: DataFrame, definitions: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """references (doc_id, label, ...) plus href and title; where no definition has the label, the first heading of that text."""
    joined = references.join(last_definitions(definitions), KEY, "left")
    if headings is None:
        return joined
    first = headings.groupBy("doc_id", F.col("title").alias("label")).agg(F.min_by("id", "line_no").alias("heading_id"))
    return joined.join(first, KEY, "left").withColumn("href", F.coalesce("href", F.concat(F.lit("#"), "heading_id"))).drop("heading_id")


def unresolved(references: DataFrame, definitions: DataFrame) -> DataFrame:
    return references.join(definitions.select(*KEY).distinct(), KEY, "left_anti")


def unused(definitions: DataFrame, references: DataFrame) -> DataFrame:
    return definitions.join(references.select(*KEY).distinct(), KEY, "left_anti")


def referenced(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """Only the definitions that some reference uses."""
    return definitions.join(references.select(*KEY).distinct(), KEY, "left_semi")


def duplicates(rows: DataFrame, *keys: str, order: str = "line_no") -> DataFrame:
    """Second and later rows of a key in a document, with how many there are."""
    w = Window.partitionBy("doc_id", *keys)
    nth = F.row_number().over(w.orderBy(order))
    return rows.withColumn("n", F.count("*").over(w)).withColumn("nth", nth).where("n > 1 and nth > 1")


def cross_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """refs (doc_id, target) to ids (doc_id, id, title): text of the target, or null where it stays source text."""
    return refs.join(targets.select("doc_id", F.col("id").alias("target"), F.col("title").alias("target_title")), ["doc_id", "target"], "left")


def broken_fragments(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links to ``#id`` of which no id exists."""
    wanted = links.where(F.col("href").startswith("#")).withColumn("id", F.expr("substring(href, 2)"))
    return wanted.join(ids.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti")


def citation_entries(citations: DataFrame, in_document: DataFrame, shared: DataFrame) -> DataFrame:
    """citations (doc_id, key) plus entry: the document's own definition, else the shared bibliography's (key, entry)."""
    own = in_document.select("doc_id", F.col("label").alias("key"), F.col("value").alias("own"))
    return citations.join(own, ["doc_id", "key"], "left").join(shared, "key", "left").withColumn("entry", F.coalesce("own", "entry")).drop("own")


def case_repairs(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Unresolved references whose label differs from exactly one definition's in case alone: label -> repaired."""
    folded = definitions.groupBy("doc_id", F.lower("label").alias("low")).agg(F.count_distinct("label").alias("n"), F.first("label").alias("repaired")).where("n = 1")
    lost = unresolved(references, definitions).withColumn("low", F.lower("label"))
    return lost.join(folded, ["doc_id", "low"]).drop("low", "n")


def within(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """nodes plus the node_id of every ancestor in ancestors (doc_id, node_id, subtree_end): an interval test per document."""
    a = ancestors.select("doc_id", F.col("node_id").alias("ancestor"), F.col("subtree_end").alias("last"))
    return nodes.join(a, "doc_id").where("node_id > ancestor and node_id <= last").drop("last")


def rename_clashes(ids: DataFrame, key: str = "id", order: str = "file_no") -> DataFrame:
    """ids of included files: later holders of an id get -2, -3, ... in file order."""
    nth = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(order))
    return ids.withColumn("renamed", F.when(nth > 1, F.concat(key, F.lit("-"), nth.cast("string"))).otherwise(F.col(key)))


def paired_notes(anchors: DataFrame) -> DataFrame:
    """Anchors (doc_id, id, href) that point at each other: a self join on href = id both ways."""
    a, b = anchors.alias("a"), anchors.alias("b")
    both = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.href") == F.concat(F.lit("#"), "b.id")) & (F.col("b.href") == F.concat(F.lit("#"), "a.id"))
    return a.join(b, both).where("a.id < b.id").select("a.doc_id", F.col("a.id").alias("definition"), F.col("b.id").alias("reference"))
