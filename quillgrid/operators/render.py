"""Renderers: block rows -> one text per document, in five targets, by CASE per node type and an ordered fold.

Block rows come from ``blocks.parse``; nested lists and containers render by their own operators. Losses
that a target causes are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import UNSAFE, ansi, col, escape_attribute, escape_html, safe_fence, slug
from quillgrid.operators import blocks as B
from quillgrid.operators.inlines import inline_html
from quillgrid.operators.windows import LEVELS, last_of_levels
from quillgrid.sources.shared import by_key

TARGETS = ("html", "markdown", "plain", "ansi", "canonical")


def paragraph_html(text: Column | str) -> Column:
    return F.concat(F.lit("<p>"), inline_html(text), F.lit("</p>"))


def heading_parts(text: Column) -> tuple[Column, Column]:
    return F.length(F.regexp_extract(text, "^(#+)", 1)), F.rtrim(F.regexp_extract(text, r"^#{1,6} +(.*)$", 1))


def heading_html(level: Column, title: Column) -> Column:
    n = level.cast("string")
    return F.concat(F.lit("<h"), n, F.lit(">"), inline_html(title), F.lit("</h"), n, F.lit(">"))


def code_html(lang: Column, content: Column) -> Column:
    cls = F.when(lang != "", F.concat(F.lit(' class="language-'), escape_attribute(lang), F.lit('"'))).otherwise("")
    return F.concat(F.lit("<pre><code"), cls, F.lit(">"), escape_html(content), F.lit("</code></pre>"))


def quote_html(text: Column) -> Column:
    return F.concat(F.lit("<blockquote>\n"), paragraph_html(F.regexp_replace(text, r"(?m)^> ?", "")), F.lit("\n</blockquote>"))


def list_item_html(text: Column) -> Column:
    """One item's line as ``<li>``; a task has a checkbox."""
    body = F.regexp_replace(text, r"^ *(?:[-*]|[0-9A-Za-z]*[.)]) +", "")
    state = F.regexp_extract(body, r"^\[([ xX_/!>?-])\] ", 1)
    rest = F.regexp_replace(body, r"^\[[ xX_/!>?-]\] ", "")
    box = F.concat(F.lit('<li data-task-state="'), F.trim(state), F.lit('"><input type="checkbox"'), F.when(F.lower(state) == "x", " checked").otherwise(""), F.lit(" disabled>"), inline_html(rest), F.lit("</li>"))
    return F.when(body.rlike(r"^\[[ xX_/!>?-]\] "), box).otherwise(F.concat(F.lit("<li>"), inline_html(body), F.lit("</li>")))


def table_html(text: Column) -> Column:
    """A pipe table: header rows by ``|=`` or a separator below the first row."""
    rows = F.split(text, "\n")
    separator = r"^\|(?:\s*:?-{2,}:?\s*\|)+\s*$"
    headed = F.coalesce(F.get(rows, F.lit(1)).rlike(separator), F.lit(False))
    body = F.filter(rows, lambda r: ~r.rlike(separator))

    def row(r: Column, i: Column) -> Column:
        cell = lambda c: F.when(
            (headed & (i == 0)) | c.startswith("="),
            F.concat(F.when(i == 0, '<th scope="col">').otherwise('<th scope="row">'), inline_html(F.trim(F.regexp_replace(c, "^=", ""))), F.lit("</th>")),
        ).otherwise(F.concat(F.lit("<td>"), inline_html(c), F.lit("</td>")))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(B.split_cells(r), cell), ""), F.lit("</tr>"))

    return F.concat(F.lit("<table>\n"), F.array_join(F.transform(body, row), "\n"), F.lit("\n</table>"))


def block_text(target: str) -> Column:
    """Text of a block row in a target; null where the target shows nothing."""
    t, text = F.col("type"), F.col("text")
    level, title = heading_parts(text)
    info = F.col("fence.info")
    lang = F.regexp_extract(info, r"^=?([^\s\"\[{]*)", 1)
    flat = F.regexp_replace(F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"(?<![\w*/_~=])[*/_~=](?=\S)|(?<=\S)[*/_~=](?![\w*/_~=])", "")
    fence = safe_fence(text)
    if target == "html":
        return (
            F.when(t == "paragraph", paragraph_html(text)).when(t == "heading", heading_html(level, title)).when(t == "rule", "<hr>").when(t == "code", code_html(lang, text))
            .when(t == "quote", quote_html(text)).when(t == "list_item", list_item_html(text)).when(t == "table_row", table_html(text))
            .when((t == "raw") & (lang == "html"), text)
        )
    if target == "markdown":
        marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?<![\w*])\*(?![\s*])([^*\n]+?)(?<!\s)\*(?![\w*])", "**$1**"), r"(?<![\w/:<])/(?![\s/])([^/\n]+?)(?<!\s)/(?![\w/])", "*$1*"), r"(?<![\w~])~(?![\s~])([^~\n]+?)(?<!\s)~(?![\w~])", "~~$1~~")
        columns = F.array_repeat(F.lit("---"), F.size(B.split_cells(F.substring_index(text, "\n", 1))))
        head = F.regexp_replace(F.substring_index(text, "\n", 1), r"\|= ?", "| ")
        rest = F.when(text.contains("\n"), F.concat(F.lit("\n"), F.expr("substring(text, instr(text, char(10)) + 1)"))).otherwise("")
        ruled = F.concat(head, F.lit("\n| "), F.array_join(columns, " | "), F.lit(" |"), rest)
        return (
            F.when(t.isin("paragraph", "quote", "list_item", "heading"), marked).when(t == "rule", "---").when(t == "code", F.concat(fence, lang, F.lit("\n"), text, F.lit("\n"), fence))
            .when(t == "table_row", F.when(head == F.substring_index(text, "\n", 1), text).otherwise(ruled)).when((t == "raw") & (lang == "markdown"), text)
        )
    if target == "plain":
        cells = F.array_join(F.transform(F.filter(F.split(text, "\n"), lambda r: ~r.rlike(r"^\|[\s:|-]+$")), lambda r: F.array_join(F.transform(B.split_cells(r), lambda c: F.trim(F.regexp_replace(c, "^=", ""))), " | ")), "\n")
        return (
            F.when(t == "heading", title).when(t == "paragraph", flat).when(t == "rule", "---").when(t == "code", text).when(t == "quote", F.regexp_replace(flat, r"(?m)^> ?", ""))
            .when(t == "list_item", F.regexp_replace(flat, r"^( *)[-*] ", "$1- ")).when(t == "table_row", cells)
        )
    if target == "ansi":
        under = F.when(level == 1, F.concat(F.lit("\n"), F.repeat(F.lit("═"), F.length(title)))).when(level == 2, F.concat(F.lit("\n"), F.repeat(F.lit("─"), F.length(title)))).otherwise("")
        return (
            F.when(t == "heading", F.concat(ansi(title, "1"), under)).when(t == "paragraph", flat).when(t == "rule", F.repeat(F.lit("─"), F.lit(40)))
            .when(t == "code", ansi(text, "2")).when(t == "quote", F.regexp_replace(flat, r"(?m)^> ?", "│ ")).when(t == "list_item", F.regexp_replace(F.regexp_replace(flat, r"^( *)[-*] ", "$1• "), r"\[[xX]\] ", "☑ "))
            .when(t == "table_row", text)
        )
    if target == "canonical":
        return (
            F.when(t == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title)).when(t == "rule", "---").when(t.isin("code", "raw"), F.concat(fence, F.when(info != "", F.concat(F.lit(" "), info)).otherwise(""), F.lit("\n"), text, F.lit("\n"), fence))
            .when(t == "comment_block", F.concat(F.lit("%%%\n"), text, F.lit("\n%%%"))).when(t == "table_row", aligned_table(text)).otherwise(F.regexp_replace(text, r"(?m)[ \t]+$", ""))
        )
    raise ValueError(f"unknown target {target}")


def aligned_table(text: Column) -> Column:
    """Cells padded to their column's width, separators to its dashes."""
    rows = F.transform(F.split(text, "\n"), B.split_cells)
    rule = r"^:?-{2,}:?$"
    n = F.array_max(F.transform(rows, F.size))
    width = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_max(F.transform(rows, lambda r: F.when(F.coalesce(F.get(r, k), F.lit("")).rlike(rule), 3).otherwise(F.length(F.coalesce(F.get(r, k), F.lit("")))))))
    cell = lambda c, k: F.when(c.rlike(rule), F.concat(F.substring(c, 1, 1), F.repeat(F.lit("-"), F.get(width, k) - 2), F.substring(c, -1, 1))).otherwise(F.rpad(c, F.get(width, k), " "))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))), "\n")


def render(block_rows: DataFrame, target: str = "html", hooks: dict | None = None, after=None) -> DataFrame:
    """doc_id, text. Items of one list stand in one ``<ul>`` or ``<ol>``; blocks are parted as the target wants.

    hooks: block type -> function of the text column that gives its output in place of the built-in one.
    after: function of the rendered text column.
    """
    w = Window.partitionBy("doc_id").orderBy("node_id")
    out = block_text(target)
    for kind, hook in (hooks or {}).items():
        out = F.when(F.col("type") == kind, hook(F.col("text"))).otherwise(out)
    rows = block_rows.withColumn("out", out).where("out is not null")
    item = F.col("type") == "list_item"
    follows = F.coalesce(item & (F.lag("type").over(w) == "list_item"), F.lit(False))
    if target == "html":
        numbered = F.col("text").rlike(r"^ *[0-9]+[.)] ")
        start = F.regexp_extract("text", r"^ *([0-9]+)", 1)
        opener = F.when(numbered, F.concat(F.lit("<ol"), F.when(start != "1", F.concat(F.lit(' start="'), start, F.lit('"'))).otherwise(""), F.lit(">"))).otherwise("<ul>")
        last = item & ~F.coalesce(F.lead("type").over(w) == "list_item", F.lit(False))
        rows = rows.withColumn("out", F.concat(F.when(item & ~follows, F.concat(opener, F.lit("\n"))).otherwise(""), "out", F.when(last, F.when(numbered, "\n</ol>").otherwise("\n</ul>")).otherwise("")))
        gap = F.lit("\n")
    else:
        gap = F.when(follows, F.lit("\n")).otherwise("\n\n")
    rows = rows.withColumn("out", F.concat(F.when(F.row_number().over(w) == 1, "").otherwise(gap), "out"))
    parts = F.sort_array(F.collect_list(F.struct("node_id", "out")))
    text = F.array_join(F.transform(parts, lambda p: p["out"]), "")
    return rows.groupBy("doc_id").agg((after(text) if after else text).alias("text"))


def line_block_html(text: Column) -> Column:
    """Verse: lines by ``<br>``, leading blanks kept as no-break spaces."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(F.repeat(F.lit("&nbsp;"), F.length(F.regexp_extract(x, "^ *", 0))), inline_html(F.ltrim(x))))
    return F.concat(F.lit('<div class="line-block">'), F.array_join(lines, "<br>\n"), F.lit("</div>"))


#: Names that make a span an element of their own.
SEMANTIC = ("kbd", "abbr", "time", "samp", "var", "cite", "dfn")


def semantic_span_html(content: Column, attributes: Column) -> Column:
    """``[x]{kbd}`` as the named element, abbr and time with their value, any other span with its classes."""
    name = F.regexp_extract(attributes, rf"^({'|'.join(SEMANTIC)})(?:=|$|\s)", 1)
    value = F.regexp_extract(attributes, r'^(?:abbr|time)=\"?([^\"]*)\"?', 1)
    shown = F.when((name == "abbr") & (value != ""), F.concat(F.lit(' title="'), escape_attribute(value), F.lit('"'))).when((name == "time") & (value != ""), F.concat(F.lit(' datetime="'), escape_attribute(value), F.lit('"'))).otherwise("")
    classes = F.array_join(F.regexp_extract_all(attributes, F.lit(r"\.([\w-]+)"), F.lit(1)), " ")
    plain = F.concat(F.lit('<span class="'), classes, F.lit('">'), inline_html(content), F.lit("</span>"))
    return F.when(name != "", F.concat(F.lit("<"), name, shown, F.lit(">"), inline_html(content), F.lit("</"), name, F.lit(">"))).otherwise(plain)


def mention_html(name: Column, url: Column) -> Column:
    """A link where the name resolves, else the marked name."""
    shown = F.concat(F.lit("@"), escape_html(name))
    return F.when(url.isNotNull(), F.concat(F.lit('<a class="mention" href="'), escape_attribute(url), F.lit('">'), shown, F.lit("</a>"))).otherwise(F.concat(F.lit('<span class="mention"><strong>'), shown, F.lit("</strong></span>")))


def cross_reference_html(target: Column, title: Column) -> Column:
    """A link with the target's title; a miss is the source text."""
    return F.when(title.isNotNull(), F.concat(F.lit('<a href="#'), escape_attribute(target), F.lit('">'), escape_html(title), F.lit("</a>"))).otherwise(F.concat(F.lit("&lt;/#"), escape_html(target), F.lit("&gt;")))


def extension_html(name: Column, content: Column) -> Column:
    return F.concat(F.lit('<span class="ext-'), name, F.lit('">'), inline_html(content), F.lit("</span>"))


def ruby_html(base: Column, reading: Column) -> Column:
    return F.concat(F.lit("<ruby>"), escape_html(base), F.lit("<rp>(</rp><rt>"), escape_html(reading), F.lit("</rt><rp>)</rp></ruby>"))


def soft_breaks(text: Column, mode: str) -> Column:
    """newline, space or br."""
    return {"newline": text, "space": F.replace(text, F.lit("\n"), F.lit(" ")), "br": F.replace(text, F.lit("\n"), F.lit("<br>\n"))}[mode]


def sections_html(block_rows: DataFrame) -> DataFrame:
    """HTML whose headings open ``<section id>`` by level: each heading closes the open sections of its level and below.

    A level is open where its last heading stands after the last one of every lower level.
    """
    w = Window.partitionBy("doc_id").orderBy("node_id")
    level, title = heading_parts(F.col("text"))
    rows = block_rows.withColumn("out", block_text("html")).where("out is not null").withColumn("level", F.when(F.col("type") == "heading", level))
    last = last_of_levels("node_id", w.rowsBetween(Window.unboundedPreceding, -1))
    under = [F.array_max(F.array(F.lit(-1), *last[:k])) for k in range(len(last))]  # the last heading of a lower level
    open_ = F.array_compact(F.array(*[F.when(x > u, F.lit(k)) for k, x, u in zip(LEVELS, last, under, strict=True)]))
    rows = rows.withColumn("open", open_)
    closing = F.repeat(F.lit("</section>\n"), F.size(F.filter("open", lambda y: y >= F.col("level"))))
    opened = F.concat(closing, F.lit('<section id="'), escape_attribute(slug(title)), F.lit('">\n'), "out")
    rows = rows.withColumn("out", F.when(F.col("level").isNotNull(), opened).otherwise(F.col("out")))
    rest = F.when(F.col("level").isNotNull(), F.concat(F.filter("open", lambda y: y < F.col("level")), F.array("level"))).otherwise(F.col("open"))
    parts = F.sort_array(F.collect_list(F.struct("node_id", "out")))
    return rows.withColumn("rest", F.size(rest)).groupBy("doc_id").agg(
        F.concat(F.array_join(F.transform(parts, lambda p: p["out"]), "\n"), F.repeat(F.lit("\n</section>"), F.max_by("rest", "node_id"))).alias("text")
    )


def definition_list_html(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, line_no, term, description) -> one ``<dl>`` per document, a term once for its run of descriptions."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    fresh = ~F.coalesce(F.lag("term").over(w) == F.col("term"), F.lit(False))
    out = F.concat(F.when(fresh, F.concat(F.lit("<dt>"), inline_html("term"), F.lit("</dt>\n"))).otherwise(""), F.lit("<dd>"), inline_html("description"), F.lit("</dd>"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "out")))
    return pairs.withColumn("out", out).groupBy("doc_id").agg(F.concat(F.lit("<dl>\n"), F.array_join(F.transform(parts, lambda p: p["out"]), "\n"), F.lit("\n</dl>")).alias("text"))


def endnotes_html(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """references (doc_id, label, position), definitions (doc_id, label, value): the notes section, numbered by first use."""
    from quillgrid.operators.windows import first_use_numbers

    used = first_use_numbers(references).groupBy("doc_id", "label", "number").agg(F.max("repeat").alias("uses"))
    rows = used.join(by_key(definitions.select("doc_id", "label", "value")), ["doc_id", "label"])
    n = F.col("number").cast("string")
    back = lambda k: F.concat(F.lit('<a href="#fnref'), n, F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""), F.lit('" role="doc-backlink">↩</a>'))
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.col("uses").cast("int")), back), " ")
    out = F.concat(F.lit('<li id="fn'), n, F.lit('"><p>'), inline_html("value"), F.lit(" "), links, F.lit("</p></li>"))
    parts = F.sort_array(F.collect_list(F.struct("number", out.alias("out"))))
    return rows.groupBy("doc_id").agg(F.concat(F.lit('<section role="doc-endnotes">\n<hr>\n<ol>\n'), F.array_join(F.transform(parts, lambda p: p["out"]), "\n"), F.lit("\n</ol>\n</section>")).alias("text"))


def note_reference_html(number: Column, repeat: Column) -> Column:
    n = number.cast("string")
    suffix = F.when(repeat > 1, F.concat(F.lit("-"), repeat.cast("string"))).otherwise("")
    return F.concat(F.lit('<a id="fnref'), n, suffix, F.lit('" href="#fn'), n, F.lit('" role="doc-noteref"><sup>'), n, F.lit("</sup></a>"))


def admonition_html(name: Column, title: Column, body: Column) -> Column:
    shown = F.when(title != "", title).otherwise(F.initcap(name))
    return F.concat(F.lit('<aside class="admonition '), escape_attribute(name), F.lit('" aria-label="'), escape_attribute(shown), F.lit('">\n<p class="admonition-title">'), escape_html(shown), F.lit("</p>\n"), paragraph_html(body), F.lit("\n</aside>"))


def figure_html(image: Column, caption: Column) -> Column:
    return F.concat(F.lit("<figure>\n"), inline_html(image), F.lit("\n<figcaption>"), inline_html(caption), F.lit("</figcaption>\n</figure>"))


def losses(block_rows: DataFrame, target: str) -> DataFrame:
    """doc_id, node_id, code of what the target cannot show."""
    t, text = F.col("type"), F.col("text")
    lang = F.regexp_extract("fence.info", r"^=?(\S*)", 1)
    text_like = F.lit(target in ("markdown", "plain", "ansi"))
    spans = text.rlike(r"(?:^|\|)\s*[\^<]\s*\|")
    hits = F.array(
        F.when((t == "raw") & (lang != target), "raw-format-dropped"),
        F.when(text_like & (t == "table_row") & spans, "table-span-flattened"),
        F.when(text_like & t.isin("paragraph", "heading") & text.rlike(r"\{[^{}|]+\|[^{}|]+\}"), "ruby-flattened"),
        F.when(text_like & t.isin("paragraph", "heading") & text.rlike(r"\{#.+?#\}"), "editorial-comment-flattened"),
        F.when(text.rlike(rf"(?i)\]\(\s*{UNSAFE}"), "destination-denied"),
        F.when(F.lit(target == "markdown") & (t == "list_item") & text.rlike(r"^ *[A-Za-z]+[.)] "), "list-style-dropped"),
        F.when(F.lit(target == "markdown") & (t == "list_item") & text.rlike(r"^ *\d+\) "), "list-delimiter-changed"),
        F.when(F.lit(target == "markdown") & (t == "attributes"), "markdown-attributes-dropped"),
        F.when(F.lit(target == "markdown") & (t == "table_row") & text.rlike(r"(?m)^(?:\|(?!=)[^|\n]*)+\|=(?!=)"), "table-header-cell-demoted"),
        F.when(F.lit(target == "markdown") & (t == "table_row") & text.rlike(r"\n\|="), "table-header-row-demoted"),
        F.when(F.lit(target == "markdown") & (t == "table_row") & ~text.rlike(r"^\|=") & ~text.rlike(r"\n\|[\s:|-]+(?:\n|$)"), "table-header-row-hoisted"),
    )
    return block_rows.select("doc_id", "node_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("code"))


def loss_counts(loss_rows: DataFrame) -> DataFrame:
    return loss_rows.groupBy("code").agg(F.count("*").alias("n"))


def refuse_losses(rendered: DataFrame, loss_rows: DataFrame) -> DataFrame:
    """rendered; reading a document with a loss raises."""
    first = loss_rows.groupBy("doc_id").agg(F.min("code").alias("code"))
    joined = rendered.join(by_key(first), "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("code").isNotNull(), F.raise_error(F.concat(F.lit("render loss: "), "code"))).otherwise(col("text")).alias("text"))
