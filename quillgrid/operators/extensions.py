"""Bundled extensions as expressions and joins: headings, links, containers, indexes, editor mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions.svg import clean_svg
from quillgrid.functions.text import ascii_fold, col, escape_attribute, escape_html, slug
from quillgrid.operators.policy import host

#: Languages of fences that a client script draws.
DIAGRAMS = ("mermaid", "d2", "graphviz", "dot", "wavedrom", "abc", "plantuml", "vega-lite", "chart")
#: Quote characters by locale: outer open, outer close.
QUOTES = {"en": ("“", "”"), "de": ("„", "“"), "fr": ("« ", " »"), "es": ("«", "»"), "sv": ("”", "”"), "pl": ("„", "”")}
#: Node types and their names in the editor; a null name cannot be shown there.
EDITOR = {
    "document": "doc", "paragraph": "paragraph", "heading": "heading", "block_quote": "blockquote", "quote": "blockquote", "code_block": "codeBlock", "code": "codeBlock", "rule": "horizontalRule", "list": "bulletList",
    "list_item": "listItem", "table": "table", "table_row": "tableRow", "table_cell": "tableCell", "text": "text", "hard_break": "hardBreak", "image": "image", "comment": None, "raw": None, "caption": None,
}


def shift_levels(headings: DataFrame, by: int) -> DataFrame:
    """level moved and kept within 1 to 6, and whether it was cut there."""
    moved = F.col("level") + by
    return headings.withColumn("clamped", (moved > 6) | (moved < 1)).withColumn("level", F.greatest(F.lit(1), F.least(F.lit(6), moved)))


def ascii_slug(c: Column | str) -> Column:
    return slug(ascii_fold(c))


def lowercase_slug(c: Column | str) -> Column:
    return F.lower(slug(c))


def permalink(id_: Column | str, symbol: str = "¶") -> Column:
    return F.concat(F.lit(' <a class="permalink" href="#'), escape_attribute(id_), F.lit(f'" aria-hidden="true">{symbol}</a>'))


def autolinks(texts: DataFrame, text: str = "text") -> DataFrame:
    """Bare URLs and addresses that stand outside links."""
    from quillgrid.operators.inlines import grouped

    return grouped(texts, r"(?<![\w<(\[\"/])((?:https?://[^\s<>()\[\]]*[\w/])|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)", {"url": 1}, text)


def external_attributes(href: Column | str, own_hosts: tuple[str, ...], rel: str = "noopener noreferrer") -> Column:
    """`` target rel`` for links to other hosts, else nothing."""
    outside = col(href).rlike("^https?://") & ~host(href).isin(*own_hosts)
    return F.when(outside, f' target="_blank" rel="{rel}"').otherwise("")


def wikilink_html(page: Column, display: Column, base: str = "/wiki/") -> Column:
    name, fragment = F.trim(F.substring_index(page, "#", 1)), F.when(page.contains("#"), F.concat(F.lit("#"), F.substring_index(page, "#", -1))).otherwise("")
    url = F.concat(F.lit(base), F.replace(F.url_encode(F.replace(name, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")), fragment)
    return F.concat(F.lit('<a class="wikilink" href="'), url, F.lit('">'), escape_html(F.when(display != "", display).otherwise(page)), F.lit("</a>"))


def swatch_html(color: Column) -> Column:
    """A colour chip for hex, functional and plain named colours; anything else stays text."""
    valid = color.rlike(r"^#(?:[0-9A-Fa-f]{3,4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$|^(?:rgb|hsl)a?\([\d\s.,%/]+\)$|^[a-z]{3,20}$")
    chip = F.concat(F.lit('<span class="swatch" style="background:'), color, F.lit('"></span><code>'), escape_html(color), F.lit("</code>"))
    return F.when(valid, chip).otherwise(escape_html(color))


def details_html(summary: Column, body: Column, open_: bool = False) -> Column:
    return F.concat(F.lit("<details" + (" open" if open_ else "") + ">\n<summary>"), escape_html(summary), F.lit("</summary>\n"), body, F.lit("\n</details>"))


def spoiler_html(body: Column) -> Column:
    return F.concat(F.lit('<span class="spoiler" tabindex="0">'), body, F.lit("</span>"))


def diagram_html(lang: Column, content: Column) -> Column:
    """``<pre class=lang>`` for diagram languages, null for others."""
    return F.when(lang.isin(*DIAGRAMS), F.concat(F.lit('<pre class="'), lang, F.lit('">'), escape_html(content), F.lit("</pre>")))


def svg_data_uri(content: Column) -> Column:
    """SVG with nothing but drawing (see ``functions.svg``), as a data URI."""
    return F.concat(F.lit("data:image/svg+xml;base64,"), F.base64(F.encode(clean_svg(content), "UTF-8")))


def callouts(block_rows: DataFrame) -> DataFrame:
    """Numbered marks ``<n>`` in a code block joined to the items of the list that follows it: line in code, n, text."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    code = block_rows.where("type = 'code'").select("doc_id", F.col("node_id").alias("code_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marks = code.select("doc_id", "code_id", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("line", F.lit(r"<(\d+)>"), F.lit(1))).alias("n"))
    items = block_rows.withColumn("code_id", F.last(F.when(F.col("type") == "code", F.col("node_id")), ignorenulls=True).over(w)).where("type = 'list_item' and code_id is not null")
    texts = items.select("doc_id", "code_id", F.regexp_extract("text", r"^(\d+)[.)] ", 1).alias("n"), F.regexp_extract("text", r"^\d+[.)] (.*)$", 1).alias("text"))
    return marks.join(texts, ["doc_id", "code_id", "n"])


def code_groups(block_rows: DataFrame) -> DataFrame:
    """Runs of two or more neighbouring code blocks as tabs: group start, tab number, title (label or language)."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    rows = block_rows.withColumn("fresh", (~F.coalesce(F.lag("type").over(w) == "code", F.lit(False))).cast("int")).where("type = 'code'")
    rows = rows.withColumn("group", F.sum("fresh").over(w))
    g = Window.partitionBy("doc_id", "group")
    label, lang = F.regexp_extract("fence.info", r"\[([^\]]*)\]", 1), F.regexp_extract("fence.info", r"^(\S*)", 1)
    rows = rows.withColumn("size", F.count("*").over(g)).withColumn("tab", F.row_number().over(g.orderBy("node_id"))).where("size > 1")
    return rows.select("doc_id", "group", "tab", F.when(label != "", label).otherwise(lang).alias("title"))


def list_table(items: DataFrame) -> DataFrame:
    """Nested list as a table: top items are rows, their children cells: row, col, text."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = items.withColumn("row", F.sum((F.col("indent") == 0).cast("int")).over(w)).where("indent > 0")
    return rows.withColumn("col", F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("line_no"))).select("doc_id", "row", "col", "text")


def table_of_contents(headings: DataFrame, least: int = 1, most: int = 3) -> DataFrame:
    """headings (doc_id, line_no, level, title, id) -> one markup list of links per document, indented by level."""
    rows = headings.where(F.col("level").between(least, most))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - least), F.lit("- ["), "title", F.lit("](#"), "id", F.lit(")"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", line.alias("line"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("toc"))


def index_list(marks: DataFrame) -> DataFrame:
    """marks (doc_id, ord, value) -> slug, term, places: how often and where, in byte order of the slug."""
    rows = marks.withColumn("slug", slug("value"))
    return rows.groupBy("doc_id", "slug").agg(F.min("value").alias("term"), F.array_join(F.transform(F.sort_array(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("places"))


def glossary(uses: DataFrame, terms: DataFrame) -> DataFrame:
    """uses (doc_id, value) joined to terms (doc_id, term, description) by slug."""
    t = terms.select("doc_id", slug("term").alias("slug"), "term", "description")
    return uses.withColumn("slug", slug("value")).join(t, ["doc_id", "slug"], "left")


def default_attributes(attrs: Column, defaults: dict[str, str]) -> Column:
    """attrs with defaults for the keys that it lacks."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(attrs, k)), attrs)


def notes_to_parentheses(texts: DataFrame, definitions: DataFrame) -> DataFrame:
    """texts (doc_id, text) with every note reference replaced by its note in parentheses."""
    notes = definitions.where("kind = 'footnote'").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("notes"))
    joined = texts.join(notes, "doc_id", "left")
    parts = F.regexp_extract_all("text", F.lit(r"\[\^[^\]\s]+\]|[^\[]+|\["), F.lit(0))
    note = lambda p: F.try_element_at("notes", F.regexp_extract(p, r"^\[\^([^\]\s]+)\]$", 1))
    out = F.array_join(F.transform(parts, lambda p: F.coalesce(F.concat(F.lit(" ("), note(p), F.lit(")")), p)), "")
    return joined.select("doc_id", F.coalesce(out, "text").alias("text"))


def locale_quotes(text: Column | str, locale: str) -> Column:
    from quillgrid.functions.text import smart_quotes

    return smart_quotes(text, *QUOTES[locale])


def editor_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDITOR.items()), "type string, editor string")


def to_editor_json(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, node_id, type, text, level) -> editor JSON per document; types without a name are left out."""
    known = nodes.join(F.broadcast(editor_map(nodes.sparkSession)), "type").where("editor is not null")
    leaf = F.array(F.struct(F.lit("text").alias("type"), "text"))
    node = F.to_json(F.struct(F.col("editor").alias("type"), F.when(F.col("level").isNotNull(), F.struct("level")).alias("attrs"), F.when(F.col("text") != "", leaf).alias("content")))
    parts = F.sort_array(F.collect_list(F.struct("node_id", node.alias("json"))))
    return known.groupBy("doc_id").agg(F.concat(F.lit('{"type":"doc","content":['), F.array_join(F.transform(parts, lambda p: p["json"]), ","), F.lit("]}")).alias("json"))


def editor_losses(nodes: DataFrame) -> DataFrame:
    """doc_id, type, n of the types that the editor cannot show."""
    mapped = nodes.join(F.broadcast(editor_map(nodes.sparkSession)), "type", "left")
    return mapped.where("editor is null").groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def from_editor_json(docs: DataFrame) -> DataFrame:
    """doc_id, source: markup of editor JSON (doc_id, json); an unknown node name makes reading fail."""
    shape = "type string, content array<struct<type: string, attrs: struct<level: int, language: string>, content: array<struct<type: string, text: string, marks: array<struct<type: string>>>>>>"
    rows = docs.select("doc_id", F.posexplode(F.from_json("json", shape)["content"]).alias("pos", "n"))
    mark = lambda t, name, d: F.when(F.exists(F.coalesce(t["marks"], F.array().cast("array<struct<type: string>>")), lambda m: m["type"] == name), F.concat(F.lit("{" + d), t["text"], F.lit(d + "}")))
    text = F.array_join(F.transform(F.coalesce("n.content", F.array().cast("array<struct<type: string, text: string, marks: array<struct<type: string>>>>")), lambda t: F.coalesce(mark(t, "bold", "*"), mark(t, "italic", "/"), mark(t, "strike", "~"), t["text"])), "")
    kind = F.col("n.type")
    line = (
        F.when(kind == "paragraph", text).when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.col("n.attrs.level")), F.lit(" "), text)).when(kind == "blockquote", F.concat(F.lit("> "), text))
        .when(kind == "horizontalRule", "---").when(kind == "codeBlock", F.concat(F.lit("```"), F.coalesce("n.attrs.language", F.lit("")), F.lit("\n"), text, F.lit("\n```"))).when(kind == "listItem", F.concat(F.lit("- "), text))
        .otherwise(F.raise_error(F.concat(F.lit("unknown editor node: "), F.coalesce(kind, F.lit("null")))))
    )
    parts = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("source"))
