"""Trees as flat tables: JSON, structural diff and merge, identity, subtree text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.sources.shared import by_key

KEY = ["doc_id", "path"]
AST_VERSION = 1


def to_ast_json(nodes: DataFrame) -> DataFrame:
    """One JSON object per document whose children are its flat nodes in order."""
    fields = [c for c in nodes.columns if c not in ("doc_id", "node_id")]
    children = F.transform(F.sort_array(F.collect_list(F.struct("node_id", F.to_json(F.struct(*fields)).alias("json")))), lambda x: x["json"])
    body = F.concat(F.lit('{"type":"document","children":['), F.array_join(children, ","), F.lit("]}"))
    return nodes.groupBy("doc_id").agg(body.alias("json"))


def from_ast_json(docs: DataFrame, types: tuple[str, ...], schema: str = "type string, text string, level int") -> DataFrame:
    """Flat nodes of JSON documents (doc_id, json); a type that is not known makes reading fail."""
    parsed = docs.select("doc_id", F.from_json("json", f"type string, children array<struct<{schema.replace(' string', ': string').replace(' int', ': int')}>>").alias("d"))
    rows = parsed.select("doc_id", F.posexplode("d.children").alias("pos", "n"))
    checked = F.when(F.col("n.type").isin(*types), F.col("n.type")).otherwise(F.raise_error(F.concat(F.lit("unknown node type: "), F.coalesce("n.type", F.lit("null")))))
    names = [x.strip().split()[0] for x in schema.split(",")]
    return rows.select("doc_id", (F.col("pos") + 1).alias("node_id"), checked.alias("type"), *[F.col(f"n.{c}") for c in names if c != "type"])


def envelope(docs: DataFrame) -> DataFrame:
    """JSON with version and vocabulary around each document."""
    wrapped = F.concat(F.lit(f'{{"astVersion":{AST_VERSION},"document":'), "json", F.lit("}"))
    return docs.select("doc_id", wrapped.alias("json"))


def open_envelope(docs: DataFrame) -> DataFrame:
    """The document of each envelope; one of a newer version makes reading fail."""
    version = F.get_json_object("json", "$.astVersion").cast("int")
    body = F.get_json_object("json", "$.document")
    return docs.select("doc_id", F.when(version <= AST_VERSION, body).otherwise(F.raise_error(F.lit("newer version"))).alias("json"))


def schema_violation(kind: Column, fields: dict[str, Column], required: dict[str, tuple[str, ...]]) -> Column:
    """First violation of a node: an unknown type or a missing field; null if none."""
    out = F.when(~kind.isin(*required), F.concat(F.lit("unknown type "), kind))
    for t, names in required.items():
        for n in names:
            out = out.when((kind == t) & fields[n].isNull(), F.concat(kind, F.lit(f": missing {n}")))
    return out


def fingerprint(*columns: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def diff(before: DataFrame, after: DataFrame, value: str = "value") -> DataFrame:
    """doc_id, path, op (add, remove, replace), before, after: a full outer join on the path."""
    b, a = before.select(*KEY, F.col(value).alias("before"), F.lit(True).alias("in_b")), after.select(*KEY, F.col(value).alias("after"), F.lit(True).alias("in_a"))
    op = F.when(F.col("in_b").isNull(), "add").when(F.col("in_a").isNull(), "remove").when(~F.col("before").eqNullSafe(F.col("after")), "replace")
    return b.join(a, KEY, "full").withColumn("op", op).where("op is not null").select(*KEY, "op", "before", "after")


def apply_patch(nodes: DataFrame, patch: DataFrame, value: str = "value") -> DataFrame:
    """nodes after a patch; a row whose old value is not the patch's makes reading fail."""
    joined = nodes.select(*KEY, F.col(value).alias("now")).join(patch, KEY, "full")
    stale = F.col("op").isin("remove", "replace") & ~F.col("before").eqNullSafe(F.col("now"))
    out = F.when(stale, F.raise_error(F.lit("stale patch"))).when(F.col("op").isin("add", "replace"), F.col("after")).otherwise(F.col("now"))
    return joined.where("op is null or op <> 'remove'").select(*KEY, out.alias(value))


def reverse_patch(patch: DataFrame) -> DataFrame:
    op = F.when(F.col("op") == "add", "remove").when(F.col("op") == "remove", "add").otherwise(F.col("op"))
    return patch.select(*KEY, op.alias("op"), F.col("after").alias("before"), F.col("before").alias("after"))


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, value: str = "value", resolve=None) -> DataFrame:
    """Three-way merge by path: doc_id, path, base, ours, theirs, merged, conflict (null, edit or delete).

    A side that left the base alone yields to the other; equal changes collapse; else the row conflicts and
    resolve(base, ours, theirs), if given, supplies the value.
    """
    side = lambda df, n: df.select(*KEY, F.struct(F.col(value).alias("v")).alias(n))  # noqa: E731  null struct: no such node
    rows = side(base, "b").join(side(ours, "o"), KEY, "full").join(side(theirs, "t"), KEY, "full")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    clash = ~o.eqNullSafe(t) & ~o.eqNullSafe(b) & ~t.eqNullSafe(b)
    merged = F.when(o.eqNullSafe(t), o).when(o.eqNullSafe(b), t).when(t.eqNullSafe(b), o)["v"]
    conflict = F.when(clash, F.when(o.isNull() | t.isNull(), "delete").otherwise("edit"))
    if resolve is not None:
        merged = F.when(clash, resolve(b["v"], o["v"], t["v"])).otherwise(merged)
    return rows.select(*KEY, b["v"].alias("base"), o["v"].alias("ours"), t["v"].alias("theirs"), merged.alias("merged"), conflict.alias("conflict"))


def carry_identity(old: DataFrame, new: DataFrame) -> DataFrame:
    """new (doc_id, path, hash) plus identity: the old row's where path and hash agree, else a fresh one of path and hash."""
    joined = new.join(by_key(old.select(*KEY, "hash", F.col("identity").alias("kept"))), [*KEY, "hash"], "left")
    return joined.withColumn("identity", F.coalesce("kept", F.concat(F.lit("n"), F.hex(F.xxhash64(*KEY, "hash"))))).drop("kept")


def subtree_text(nodes: DataFrame) -> DataFrame:
    """Text of each top-level subtree (depth 1): leaves joined in order, by a running owner instead of a range join."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    owned = nodes.withColumn("owner", F.last(F.when(F.col("depth") == 1, F.col("node_id")), ignorenulls=True).over(w)).where("owner is not null")
    parts = F.sort_array(F.collect_list(F.struct("node_id", F.coalesce("text", F.lit("")).alias("text"))))
    return owned.groupBy("doc_id", F.col("owner").alias("node_id")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def extents(nodes: DataFrame) -> DataFrame:
    """Line extent of each top-level subtree."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    owned = nodes.withColumn("owner", F.last(F.when(F.col("depth") == 1, F.col("node_id")), ignorenulls=True).over(w)).where("owner is not null")
    return owned.groupBy("doc_id", F.col("owner").alias("node_id")).agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


def annotations_on_nodes(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """Annotation ranges (doc_id, lo, hi, note) on the nodes (doc_id, path, start, stop) that they overlap, clipped."""
    hit = (ranges.doc_id == spans.doc_id) & (ranges.lo < spans.stop) & (ranges.hi > spans.start)
    return ranges.join(spans, hit).select(ranges.doc_id, "path", "note", F.greatest("lo", "start").alias("lo"), F.least("hi", "stop").alias("hi"))


def check_edits(edits: DataFrame) -> DataFrame:
    """edits (doc_id, start, stop, text) plus valid: sorted, none overlapping the one before."""
    before = F.max("stop").over(Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    return edits.withColumn("valid", (F.col("start") <= F.col("stop")) & (before.isNull() | (before <= F.col("start"))))


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs (doc_id, source) after sorted, non-overlapping edits in code points; a document with an invalid edit stays."""
    checked = check_edits(edits).groupBy("doc_id").agg(F.min("valid").alias("valid"), F.sort_array(F.collect_list(F.struct("start", "stop", "text"))).alias("edits"))
    joined = docs.join(checked, "doc_id", "left")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    source = F.col("source")
    step = lambda a, e: F.struct(F.concat(a["out"], F.substring(source, a["at"] + 1, e["start"] - a["at"]), e["text"]).alias("out"), e["stop"].cast("int").alias("at"))
    done = F.aggregate("edits", begin, step, lambda a: F.concat(a["out"], F.substring(source, a["at"] + 1, F.length(source))))
    return joined.select("doc_id", F.when(F.col("valid"), done).otherwise(source).alias("source"))
