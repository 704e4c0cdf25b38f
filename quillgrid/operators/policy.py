"""Profiles, safe mode and link policies: filters, anti-joins and CASE expressions over nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import UNSAFE_SCHEMES, col, url_scheme
from quillgrid.sources.shared import by_key, spread

#: Presets of allowed types, greatest size in bytes and greatest nesting (null: no limit).
ARTICLE = "paragraph heading list list_item block_quote code_block table table_row table_cell thematic_break link image strong emphasis code text"
PROFILES = {
    "full": (None, None, None),
    "article": (ARTICLE, None, None),
    "comment": ("paragraph list list_item block_quote code_block link strong emphasis strike code text", 100_000, 4),
    "minimal": ("paragraph list list_item strong emphasis code text", 10_000, 2),
}
#: Further schemes that no setting lets through.
FLOOR_SCHEMES = (*UNSAFE_SCHEMES, "blob", "view-source", "mhtml", "x-javascript")


def profile_rules(spark: SparkSession) -> DataFrame:
    """(profile, type) rows of the presets, for a broadcast join; of fixed size."""
    return spark.createDataFrame([(p, t) for p, (types, _, _) in PROFILES.items() if types for t in types.split()], "profile string, type string")


def allowed(nodes: DataFrame, profile: str) -> Column:
    types, _, depth = PROFILES[profile]
    fits = F.col("depth") <= depth if depth else F.lit(True)
    return (F.col("type").isin(*types.split()) if types else F.lit(True)) & fits


def violations(nodes: DataFrame, profile: str) -> DataFrame:
    """doc_id, node_id, type, reason of the nodes that the profile denies."""
    types, _, depth = PROFILES[profile]
    reason = F.when(~F.col("type").isin(*types.split()), "type") if types else F.when(F.lit(False), "type")
    if depth:
        reason = reason.when(F.col("depth") > depth, "nesting")
    return nodes.select("doc_id", "node_id", "type", reason.alias("reason")).where("reason is not null")


def strip_denied(nodes: DataFrame, denied: DataFrame) -> DataFrame:
    """nodes without the denied ones and their subtrees: a running maximum of denied subtree ends, no range join."""
    flagged = nodes.join(by_key(denied.select("doc_id", "node_id", F.lit(True).alias("denied"))), ["doc_id", "node_id"], "left")
    reach = F.max(F.when(F.col("denied"), F.col("subtree_end"))).over(Window.partitionBy("doc_id").orderBy("node_id"))
    return flagged.withColumn("reach", reach).where("reach is null or node_id > reach").drop("denied", "reach")


def denied_to_text(nodes: DataFrame, denied: DataFrame) -> DataFrame:
    """nodes with each topmost denied subtree replaced by one text node of its text."""
    flagged = nodes.join(by_key(denied.select("doc_id", "node_id", F.lit(True).alias("denied"))), ["doc_id", "node_id"], "left")
    w = Window.partitionBy("doc_id").orderBy("node_id")
    reach = F.max(F.when(F.col("denied"), F.col("subtree_end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = flagged.withColumn("top", F.col("denied") & (reach.isNull() | (F.col("node_id") > reach)))
    rows = rows.withColumn("run", F.last(F.when(F.col("top"), F.struct("node_id", "subtree_end")), ignorenulls=True).over(w))
    inside = F.col("run").isNotNull() & (F.col("node_id") <= F.col("run.subtree_end"))
    rows = rows.withColumn("own", F.when(inside, F.col("run.node_id")).otherwise(F.col("node_id"))).withColumn("inside", inside)
    parts = F.sort_array(F.collect_list(F.struct("node_id", F.coalesce("text", F.lit("")).alias("text"))))
    out = rows.groupBy("doc_id", F.col("own").alias("node_id")).agg(F.max("inside").alias("inside"), F.min_by("type", "node_id").alias("type"), F.min_by("depth", "node_id").alias("depth"), parts.alias("parts"))
    return out.select("doc_id", "node_id", F.when(F.col("inside"), "text").otherwise(F.col("type")).alias("type"), "depth", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def fail_on_violation(nodes: DataFrame, profile: str) -> DataFrame:
    """nodes; reading a denied one raises."""
    return nodes.withColumn("type", F.when(allowed(nodes, profile), F.col("type")).otherwise(F.raise_error(F.concat(F.lit(f"{profile}: not allowed: "), "type"))))


def drop_empty(nodes: DataFrame, containers: tuple[str, ...]) -> DataFrame:
    """nodes (doc_id, node_id, parent_id, type) without containers that have no children, repeated upward until none is left.

    A document's rows are read together, so one pass serves chains of any length; nothing is sent to the driver.
    """
    keys, schema = ["doc_id", "node_id", "parent_id", "type"], nodes.schema

    def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole documents; rows come sorted by document, a document may span batches."""
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column("doc_id")
            if not len(ids):
                continue
            same = pc.equal(ids, ids[len(ids) - 1]).fill_null(not ids[len(ids) - 1].is_valid)
            cut = len(ids) - pc.sum(same).as_py()
            if cut or kept and not kept[-1].column("doc_id")[-1].equals(ids[0]):
                yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield pa.Table.from_batches(kept)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_documents(batches):
            doc, node, parent, kind = (rows.column(c) for c in keys)
            known = pc.and_(pc.is_valid(doc), pc.is_valid(node)).to_numpy()
            names = pa.chunked_array([*node.chunks, *parent.chunks]).combine_chunks().dictionary_encode()
            codes = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            place = doc.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() * np.int64(len(names.dictionary) + 1)
            at, above = (place + x for x in (codes[: len(rows)], codes[len(rows) :]))
            found, at = np.unique(at, return_inverse=True)
            up = np.searchsorted(found, above)
            up = np.where(found[np.minimum(up, len(found) - 1)] == above, up, -1)
            boxes = np.zeros(len(found), bool)
            boxes[at[pc.is_in(kind, pa.array(containers)).to_numpy() & known]] = True
            children = np.bincount(up[up >= 0], minlength=len(found))
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], np.arange(len(found) + 1))
            gone, now = np.zeros(len(found), bool), np.flatnonzero(boxes & (children == 0))
            while len(now):
                gone[now] = True
                sizes = first[now + 1] - first[now]
                lost = up[order[np.repeat(first[now] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]]
                np.subtract.at(children, lost[lost >= 0], 1)
                now = np.unique(lost[lost >= 0])
                now = now[boxes[now] & (children[now] == 0) & ~gone[now]]
            yield from rows.filter(pa.array(~gone[at])).combine_chunks().to_batches()

    return spread(nodes, "doc_id").sortWithinPartitions("doc_id").mapInArrow(drop, schema)


def fits_length(docs: DataFrame, profile: str) -> DataFrame:
    most = PROFILES[profile][1]
    return docs.where(F.octet_length("source") <= most) if most else docs


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def link_verdict(url: Column | str, deny_hosts: tuple[str, ...] = (), allow_hosts: tuple[str, ...] = (), deny_schemes: tuple[str, ...] = UNSAFE_SCHEMES, external: bool = True) -> Column:
    """allowed, or why not: scheme, host, external. Order: empty, fragment, relative, scheme, mail, host lists, external."""
    u = F.regexp_replace(col(url), r"[\x00-\x20\x7f]", "")
    scheme, name = url_scheme(u), host(u)
    on = lambda names: F.lit(False) if not names else F.exists(F.array(*map(F.lit, names)), lambda h: (name == h) | name.endswith(F.concat(F.lit("."), h)))
    return (
        F.when((u == "") | u.startswith("#"), "allowed")
        .when(scheme.isNull() & ~u.startswith("//"), "allowed")
        .when(scheme.isin(*deny_schemes), "scheme")
        .when(scheme.isin("mailto", "tel"), "allowed")
        .when(on(deny_hosts), "host")
        .when(on(allow_hosts), "allowed")
        .when(F.lit(bool(allow_hosts)), "host")
        .when(F.lit(not external), "external")
        .otherwise("allowed")
    )


def safe_url(url: Column | str) -> Column:
    """The URL, or null where its scheme is unsafe."""
    return F.when(~F.coalesce(url_scheme(url).isin(*UNSAFE_SCHEMES), F.lit(False)), col(url))


def floor_url(url: Column | str) -> Column:
    return F.when(~F.coalesce(url_scheme(url).isin(*FLOOR_SCHEMES), F.lit(False)), col(url))


def safe_attributes(attrs: Column | str, strict: bool = False) -> Column:
    bad = "^on|^srcdoc$|^formaction$" + ("|^style$" if strict else "")
    return F.map_filter(col(attrs), lambda k, v: ~F.lower(k).rlike(bad))


def rel_attributes(attrs: Column | str, rel: tuple[str, ...]) -> Column:
    """attrs with the rel words added once each, in order."""
    a = col(attrs)
    old = F.filter(F.split(F.coalesce(F.try_element_at(a, F.lit("rel")), F.lit("")), " +"), lambda x: x != "")
    words = F.array_join(F.array_union(old, F.array(*map(F.lit, rel))), " ")
    return F.map_concat(F.map_filter(a, lambda k, v: k != "rel"), F.create_map(F.lit("rel"), words))


def raw_html(text: Column | str, mode: str) -> Column:
    """strip, escape or allow."""
    from quillgrid.functions.text import escape_html

    return {"strip": F.lit(""), "escape": escape_html(text), "allow": col(text)}[mode]


def route_raw(nodes: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Nodes kept for a target, and loss rows for the raw ones of other formats."""
    foreign = F.col("type").isin("raw_block", "raw_inline") & (F.col("format") != target)
    foreign = F.coalesce(foreign, F.lit(False))
    losses = nodes.where(foreign).select("doc_id", "node_id", F.lit("raw-format-dropped").alias("code"))
    return nodes.where(~foreign), losses


def suppressed(diagnostics: DataFrame, directives: DataFrame) -> DataFrame:
    """diagnostics (doc_id, line, rule) without those that a directive (doc_id, first, last, rule or *) covers.

    Directives of a document are few, so the interval test is on the equi-join by document.
    """
    d = directives.select("doc_id", "first", "last", F.col("rule").alias("muted"))
    hit = (diagnostics.doc_id == d.doc_id) & diagnostics.line.between(d["first"], d["last"]) & ((d.muted == "*") | (d.muted == diagnostics.rule))
    return diagnostics.join(d, hit, "left_anti")
