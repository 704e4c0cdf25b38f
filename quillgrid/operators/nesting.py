"""Nested blocks in five targets: rows of ``frames.nested`` rendered by one sort of opening and closing pieces by path.

The HTML here is that of a fragment, with nothing resolved; ``convert`` writes whole pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import attributes, escape_attribute, escape_html
from quillgrid.operators import blocks as B
from quillgrid.operators.frames import HIDDEN, nested
from quillgrid.operators.inlines import inline_html
from quillgrid.operators.render import block_text, line_block_html

__all__ = ["columns", "nested", "render_nested"]

LAST = 2**31 - 1
SHOWN = ("path", "type", "text", "fence", "first_item", "in_tight", "attributes", "chain", "nth_shown", "holds")


def columns(target: str) -> tuple[str, ...]:
    """The columns of nested that render_nested reads for a target."""
    if target == "html":
        return (*SHOWN, "name", "title", "marker", "style", "task", "last_item", "caption", "depth")
    return (*SHOWN, "tight", "after", "nth")


def prefix(target: str, first: bool) -> Column:
    """What stands before a row's first line, or before its others, for the holders around it."""
    quote = {"plain": "", "ansi": "│ "}.get(target, "> ")
    canonical = target == "canonical"
    told = "fresh" if canonical else "shown"

    def of(x: Column) -> Column:
        mark = F.regexp_replace(x["marker"], r"^[-*] ", "• ") if target == "ansi" else F.regexp_replace(x["marker"], r"^\* ", "- ") if target != "canonical" else x["marker"]
        bare = F.regexp_replace(mark, r"\[[^\]]\] $", "")
        blank = F.repeat(F.lit(" "), F.length(bare))
        item = F.when(x[told], mark).otherwise(blank) if first else blank
        body = F.when(F.lit(not canonical), "").when(x["fresh"] & F.lit(first), x["marker"]).otherwise(F.repeat(F.lit(" "), F.lit(2)))
        return F.when(x["kind"].isin("description", "footnote"), body).when((x["kind"] == "quote") | ((x["kind"] == "container") & (x["name"] == ">") & F.lit(target != "canonical")), quote).when(x["kind"] == "list_item", item).otherwise("")

    return F.array_join(F.transform("chain", of), "")


def html_pieces() -> tuple[Column, Column]:
    """Opening and closing piece of a row; a leaf has an opening piece alone."""
    t, name = F.col("type"), F.col("name")
    tag = F.when(name == ">", "blockquote").when(name == "figure", "figure").when(name.isin(*B.CALLOUTS), "aside").otherwise("div")
    shown = F.when(F.col("title") != "", F.col("title")).otherwise(F.initcap("name"))
    cls = F.when((name == "") | (tag == "blockquote") | (tag == "figure"), "").otherwise(F.concat(F.lit(' class="'), F.when(tag == "aside", "admonition ").otherwise(""), escape_attribute(name), F.lit('"')))
    label = F.when(tag == "aside", F.concat(F.lit(' aria-label="'), escape_attribute(shown), F.lit('">\n<p class="admonition-title">'), escape_html(shown), F.lit("</p>"))).otherwise(">")
    numbered = ~F.col("marker").isin("-", "*")
    start = F.regexp_extract("marker", "^([0-9]+)", 1)
    kind = F.substring("style", 1, 1)
    opener = F.when(numbered, F.concat(F.lit("<ol"), F.when(~start.isin("", "1"), F.concat(F.lit(' start="'), start, F.lit('"'))).otherwise(""), F.when(kind != "1", F.concat(F.lit(' type="'), kind, F.lit('"'))).otherwise(""), F.lit(">\n"))).otherwise("<ul>\n")
    box = F.concat(F.lit(' data-task-state="'), F.trim("task"), F.lit('"><input type="checkbox"'), F.when(F.lower("task") == "x", " checked").otherwise(""), F.lit(" disabled>"))
    item = F.concat(F.when(F.col("first_item"), opener).otherwise(""), F.lit("<li"), F.coalesce(box, F.lit(">")))
    a = attributes(F.coalesce("attributes", F.lit("")))
    own = F.concat(F.when(a["id"] != "", F.concat(F.lit(' id="'), escape_attribute(a["id"]), F.lit('"'))).otherwise(""), F.when(F.size(a["classes"]) > 0, F.concat(F.lit(' class="'), escape_attribute(F.array_join(a["classes"], " ")), F.lit('"'))).otherwise(""))
    leaf = F.when((t == "paragraph") & F.col("in_tight"), inline_html("text")).when(t == "container", line_block_html(F.col("text"))).when(t == "term", F.concat(F.when(F.col("first_item"), "<dl>\n").otherwise(""), F.lit("<dt>"), inline_html("text"), F.lit("</dt>"), F.when(F.col("last_item"), "\n</dl>").otherwise(""))).otherwise(block_text("html"))
    leaf = F.when(F.col("attributes").isNotNull(), F.regexp_replace(leaf, "^(<[a-z]+[0-9]?)", F.concat(F.lit("$1"), F.regexp_replace(own, r"([\\$])", r"\\$1")))).otherwise(leaf)
    leaf = F.when(F.col("caption").isNotNull(), F.concat(F.lit("<figure>\n"), leaf, F.lit("\n<figcaption>"), inline_html("caption"), F.lit("</figcaption>\n</figure>"))).otherwise(leaf)
    opening = F.when((t == "quote") & F.col("holds"), "<blockquote>").when(t == "list_item", item).when(t == "description", F.concat(F.when(F.col("first_item"), "<dl>\n").otherwise(""), F.lit("<dd>"))).when(F.col("holds"), F.concat(F.lit("<"), tag, cls, label)).otherwise(leaf)
    ends = F.concat(F.lit("\n</li>"), F.when(F.col("last_item"), F.when(numbered, "\n</ol>").otherwise("\n</ul>")).otherwise(""))
    closing = F.when(F.col("holds"), F.when(t == "quote", "\n</blockquote>").when(t == "list_item", ends).when(t == "description", F.concat(F.lit("\n</dd>"), F.when(F.col("last_item"), "\n</dl>").otherwise(""))).otherwise(F.concat(F.lit("\n</"), tag, F.lit(">"))))
    return opening, closing


def text_pieces(target: str) -> tuple[Column, Column]:
    """Opening and closing piece of a row (with its prefixes lead and hang) in a text target: the gap above it, then its lines behind their prefixes."""
    canonical = target == "canonical"
    first, others = F.col("lead"), F.col("hang")
    t, boxed = F.col("type"), F.col("type") == "container"
    term = F.concat(F.lit(":: "), "text") if canonical else F.col("text")
    verse = F.concat(F.lit("::: |\n"), "text") if canonical else F.col("text")
    leaf = F.when(t == "term", term).when(boxed, verse).otherwise(block_text(target))
    # A holder has no lines of its own, but for a container's opening line in canonical text.
    leaf = F.when(F.col("holds"), F.when(boxed & F.lit(canonical), F.col("text")).otherwise(F.lit(None).cast("string"))).otherwise(leaf)
    behind = lambda x, i: F.concat(F.when(i == 0, first).otherwise(F.when(x == "", F.rtrim(others)).otherwise(others)), x)
    lined = F.array_join(F.transform(F.split(leaf, "\n"), behind), "\n")
    parent = F.try_element_at("chain", F.lit(-1))
    below = F.when(F.lit(canonical) & (parent["kind"] == "container"), "\n").otherwise("")
    joined = F.lit(canonical) & ((t == "caption") | F.col("attributes").isNotNull())
    # Neighbours of these types would be read as one without a blank line.
    merges = F.coalesce((F.col("after") == t) & t.isin("quote", "table_row"), F.lit(False))
    defined = t.isin("term", "description") & ~F.col("first_item")
    close_up = joined | defined | (F.col("in_tight") & ~merges) | ((t == "list_item") & F.col("tight") & ~F.coalesce("first_item", F.lit(False)))
    gap = F.when(F.col("nth" if canonical else "nth_shown") == 1, below).when(close_up, "\n").otherwise(F.concat(F.lit("\n"), F.rtrim(others), F.lit("\n")))
    closing = F.when(boxed & F.lit(canonical), F.concat(F.lit("\n"), others, F.when(F.col("holds"), F.regexp_extract("text", "^:+", 0)).otherwise(":::")))
    return F.when(F.col("holds"), F.concat(gap, F.coalesce(lined, F.lit("")))).otherwise(F.concat(gap, lined)), closing


def render_nested(rows: DataFrame, target: str = "html") -> DataFrame:
    """Rows of nested -> doc_id, text in a target; one row per document that has a block which the target shows."""
    flush = F.col("in_tight") & (F.col("type") == "paragraph")
    if target != "canonical":  # notes stand where they are referred to, not where they are written
        rows = rows.where((F.col("type") != "footnote") & ~F.exists("chain", lambda x: x["kind"] == "footnote"))
    if target == "html":
        opening, closing = html_pieces()
        opening = F.concat(F.when((F.col("nth_shown") == 1) & ((F.col("depth") == 1) | flush), "").otherwise("\n"), opening)
    else:
        # As columns of their own, prefixes are made once a row and not once a line.
        rows = rows.withColumns({"lead": prefix(target, True), "hang": prefix(target, False)})
        opening, closing = text_pieces(target)
    # A filter on opening would have Spark make it twice; what has none is left out with the other nulls below.
    pieces = rows.withColumns({"opening": opening, "closing": closing})
    glue = F.when(flush, 1).when(F.col("type").isin("list_item", "description"), 2).otherwise(0)
    parts = F.array(
        F.struct(F.col("path").alias("at"), F.col("opening").alias("out"), F.when(glue == 1, 1).otherwise(0).alias("glue")),
        F.struct(F.concat("path", F.array(F.lit(LAST))).alias("at"), F.when(F.col("opening").isNotNull(), F.col("closing")).alias("out"), F.when(glue == 2, 2).otherwise(0).alias("glue")),
    )
    events = pieces.select("doc_id", F.inline(F.filter(parts, lambda x: x["out"].isNotNull())))
    ordered = events.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "out", "glue"))).alias("parts"))
    # An item that ends with bare text closes on the same line.
    said = F.transform("parts", lambda x, i: F.when((x["glue"] == 2) & (F.get("parts", i - 1)["glue"] == 1), F.substring(x["out"], F.lit(2), F.length(x["out"]))).otherwise(x["out"]))
    return ordered.select("doc_id", F.array_join(said, "").alias("text"))
