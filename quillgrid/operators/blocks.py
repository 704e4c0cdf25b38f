"""Block operators: documents(doc_id, source) -> line rows -> block rows.

``scan`` reads a document's lines in one narrow step and knows which of them lie in a fence; ``classify``
gives each line the first form that it fits; ``blocks`` joins runs of lines to blocks by a running sum
over the lines of a document. Containers nest by what a line begins with: quote markers, list indentation,
and colon fences counted open.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillgrid.functions.text import attributes, normalize_source, roman_value
from quillgrid.sources.shared import by_key, spread

MAX_DEPTH = 200
#: Forms of a line, first match wins.
FORMS = (
    ("blank", r"^\s*$"),
    ("comment", r"^[ \t]*%%(?!%)"),
    ("div_close", r"^:{3,}[ \t]*$"),
    ("div_open", r"^:{3,}[ \t]*[^\s:]"),
    ("term", r"^:: +\S"),
    ("description", r"^: +\S"),
    ("heading", r"^#{1,6} +.*\S"),
    ("rule", r"^(?:([-*_])\1{2,}|- - -(?: -)*|\* \* \*(?: \*)*)[ \t]*$"),
    ("quote", r"^>(?: |$)"),
    ("list_item", r"^ *(?:[-*]|\d{1,9}[.)]|[ivxlcdmIVXLCDM]+[.)](?=  )|[ivxlcdmIVXLCDM]+\)|[a-zA-Z]\.(?=  )|[a-zA-Z]\)|\.) +\S"),
    ("table_row", r"^\|.*\|(?:\{[^}]*\})?[ \t]*$"),
    ("footnote", r"^\[\^[^\]\s][^\]]*\]: "),
    ("citation", r"^\[@[^\]\s]+\]: "),
    ("link_definition", r"^\[[^\]^@][^\]]*\]:\s*\S*"),
    ("abbreviation", r"^\*\[[A-Za-z0-9]+\]: "),
    ("caption", r"^\^ +\S"),
    ("continuation", r"^\+[ \t]*$"),
    ("row_continuation", r"^\+ .*\|[ \t]*$"),
    ("attributes", r"^\{[^}%~+=*/_^,-][^}]*\}[ \t]*$"),
)
FENCE = r"^(`{3,}|~{3,}|%{3,})[ \t]*([^`]*)$"


def fence_spans(lines: Column) -> Column:
    """Array of (first, last, marker, info, closed), 0-based line numbers, of the code, raw and comment fences."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    fences = F.filter(numbered, lambda x: x["line"].rlike(r"^(?:`{3,}|~{3,}|%{3,})"))
    span = "struct<first: int, last: int, marker: string, info: string, closed: boolean>"
    start = F.struct(F.lit("").alias("marker"), F.lit(0).alias("first"), F.lit("").alias("info"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        marker, info = F.regexp_extract(x["line"], FENCE, 1), F.trim(F.regexp_extract(x["line"], FENCE, 2))
        closes = (F.substring(marker, 1, 1) == F.substring(a["marker"], 1, 1)) & (F.length(marker) >= F.length(a["marker"])) & (info == "")
        done = F.struct(a["first"].alias("first"), x["i"].alias("last"), a["marker"].alias("marker"), a["info"].alias("info"), F.lit(True).alias("closed"))
        opened = F.struct(marker.alias("marker"), x["i"].alias("first"), info.alias("info"), a["spans"].alias("spans"))
        ended = F.struct(F.lit("").alias("marker"), F.lit(0).alias("first"), F.lit("").alias("info"), F.concat(a["spans"], F.array(done)).alias("spans"))
        return F.when((a["marker"] == "") & (marker != ""), opened).when((a["marker"] != "") & closes, ended).otherwise(a)

    def finish(a: Column) -> Column:
        rest = F.struct(a["first"].alias("first"), (F.size(lines) - 1).alias("last"), a["marker"].alias("marker"), a["info"].alias("info"), F.lit(False).alias("closed"))
        return F.when(a["marker"] == "", a["spans"]).otherwise(F.concat(a["spans"], F.array(rest)))

    return F.aggregate(fences, start, step, finish)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line of normalized sources."""
    return docs.select("doc_id", F.posexplode(F.split(normalize_source("source"), "\n", -1))).select("doc_id", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def scan(docs: DataFrame) -> DataFrame:
    """lines plus fence: the fence span that holds the line, or null. Documents are dealt out by doc_id, then one narrow step."""
    split = spread(docs.select("doc_id", "source"), "doc_id").select("doc_id", F.split(normalize_source("source"), "\n", -1).alias("lines"))
    spanned = split.withColumn("spans", fence_spans(F.col("lines")))
    rows = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), F.get(F.filter("spans", lambda s: (s["first"] <= i) & (s["last"] >= i)), F.lit(0)).alias("fence")))
    return spanned.select("doc_id", F.inline(rows))


def classify(scanned: DataFrame, matchers: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """scan plus form: code, raw or comment_block inside fences, else the first of matchers and FORMS, else text.

    matchers are (form, pattern) pairs of the user's own, tried before the built-in ones.
    """
    fence = F.col("fence")
    form = F.when(fence.isNotNull(), F.when(fence["marker"].startswith("%"), "comment_block").when(fence["info"].startswith("="), "raw").otherwise("code"))
    for name, pattern in (*matchers, *FORMS):
        form = form.when(F.col("line").rlike(pattern), name)
    return scanned.withColumn("form", form.otherwise("text"))


def blocks(classified: DataFrame) -> DataFrame:
    """Block rows: doc_id, node_id, type, start_line, end_line, text, fence.

    Runs of text make a paragraph; text right after a quote or a list item belongs to it (lazy
    continuation); headings, rules, definitions and the like are single lines; a fence is one block.
    Blank lines end blocks and give none. text holds the lines as they stand, fence lines left out.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    runs = ("text", "quote", "table_row", "list_item", "description")
    form, previous = F.col("form"), F.lag("form").over(order)
    lazy = (form == "text") & previous.isin("text", "quote", "list_item", "description")
    same_fence = F.col("fence").isNotNull() & (F.col("fence.first") == F.lag("fence.first").over(order))
    table = form.isin("table_row", "row_continuation") & previous.isin("table_row", "row_continuation")
    joins = lazy | same_fence | table | ((form == "quote") & (previous == "quote"))
    owner = F.last(F.when(form != "text", form).when(~previous.isin(*runs) | previous.isNull(), "text"), ignorenulls=True).over(order)
    begun = classified.withColumn("begins", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("owner", owner)
    grouped = begun.withColumn("node_id", F.sum("begins").over(order)).where("form <> 'blank'")
    inner = F.col("fence").isNull() | ((F.col("line_no") - 1 > F.col("fence.first")) & ((F.col("line_no") - 1 < F.col("fence.last")) | ~F.col("fence.closed")))
    row = F.when(inner, F.struct("line_no", "line"))
    return (
        grouped.groupBy("doc_id", "node_id")
        .agg(
            F.min_by("form", "line_no").alias("form"),
            F.min("line_no").alias("start_line"),
            F.max("line_no").alias("end_line"),
            F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["line"]), "\n").alias("text"),
            F.min_by("fence", "line_no").alias("fence"),
        )
        .select("doc_id", "node_id", F.when(F.col("form") == "text", "paragraph").otherwise(F.col("form")).alias("type"), "start_line", "end_line", "text", "fence")
    )


def parse(docs: DataFrame) -> DataFrame:
    return blocks(classify(scan(docs)))


def headings(classified: DataFrame) -> DataFrame:
    rows = classified.where("form = 'heading'")
    return rows.select("doc_id", "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.rtrim(F.regexp_extract("line", r"^#{1,6} +(.*)$", 1)).alias("title"))


def code_blocks(block_rows: DataFrame) -> DataFrame:
    """lang, header ("..."), label ([...]), marker and content of fenced code; raw blocks have a format."""
    info = F.col("fence.info")
    return block_rows.where("type in ('code', 'raw')").select(
        "doc_id",
        "start_line",
        "type",
        F.regexp_extract(info, r"^=?([^\s\"\[{]*)", 1).alias("lang"),
        F.regexp_extract(info, r'"([^"]*)"', 1).alias("header"),
        F.regexp_extract(info, r"\[([^\]]*)\]", 1).alias("label"),
        F.length("fence.marker").alias("fence_length"),
        F.col("fence.closed").alias("closed"),
        F.col("text").alias("content"),
    )


def quotes(classified: DataFrame) -> DataFrame:
    """Quoted lines with their depth (capped) and their text without markers."""
    marks = F.regexp_extract("line", r"^((?:> ?)+)", 1)
    depth = F.least(F.length(F.regexp_replace(marks, "[^>]", "")), F.lit(MAX_DEPTH))
    return classified.where("form = 'quote'").select("doc_id", "line_no", depth.alias("depth"), F.regexp_replace("line", r"^(?:> ?)+", "").alias("text"))


def list_items(classified: DataFrame) -> DataFrame:
    """One row per item: indent, marker, style, delimiter, value, task state, text and list_no.

    An item continues the open list of its indentation when style and delimiter agree; a one-letter Roman
    marker between letters counts as a letter. list_no numbers a document's lists at one indentation.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    previous_ink = F.last(F.when(F.col("form") != "blank", F.col("form")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    blank_before = F.coalesce(F.lag("form").over(order) == "blank", F.lit(False))
    shape = r"^( *)([-*]|[0-9A-Za-z]+(?=[.)])|(?=\.))([.)]?) +(.*)$"
    part = lambda i: F.regexp_extract("line", shape, i)
    rows = classified.withColumn("after", previous_ink).withColumn("blank_before", blank_before).where("form = 'list_item'")
    marker = part(2)
    style = (
        F.when(marker.isin("-", "*"), marker)
        .when(marker.rlike("^[0-9]*$"), "decimal")
        .when(marker.rlike("^[ivxlcdm]+$"), "roman")
        .when(marker.rlike("^[IVXLCDM]+$"), "ROMAN")
        .when(marker.rlike("^[a-z]$"), "alpha")
        .otherwise("ALPHA")
    )
    rows = rows.select("doc_id", "line_no", F.length(part(1)).alias("indent"), marker.alias("marker"), style.alias("style"), part(3).alias("delimiter"), part(4).alias("rest"), "after", "blank_before")
    level = Window.partitionBy("doc_id", "indent").orderBy("line_no")
    lettered = F.lag("style").over(level).isin("alpha", "ALPHA") & (F.length("marker") == 1)
    rows = rows.withColumn("style", F.when(lettered & (F.col("style") == "roman"), "alpha").when(lettered & (F.col("style") == "ROMAN"), "ALPHA").otherwise(F.col("style")))
    fresh = (
        F.lag("line_no").over(level).isNull()
        | (F.lag("style").over(level) != F.col("style"))
        | (F.lag("delimiter").over(level) != F.col("delimiter"))
        | ~F.col("after").isin("list_item", "text", "code")
    )
    state = F.regexp_extract("rest", r"^\[([ xX_/!>?-])\] ", 1)
    value = F.when(F.col("style") == "decimal", F.coalesce(F.expr("try_cast(marker as int)"), F.lit(1))).when(F.col("style").isin("roman", "ROMAN"), roman_value("marker")).when(
        F.col("style").isin("alpha", "ALPHA"), F.ascii(F.lower("marker")) - 96
    )
    return rows.withColumn("list_no", F.sum(fresh.cast("int")).over(level)).select(
        "doc_id",
        "line_no",
        "indent",
        "list_no",
        "style",
        "delimiter",
        value.cast("int").alias("value"),
        F.when(F.col("rest").rlike(r"^\[[ xX_/!>?-]\] "), state).alias("task"),
        F.regexp_replace("rest", r"^\[[ xX_/!>?-]\] ", "").alias("text"),
        "blank_before",
    )


def list_tightness(items: DataFrame) -> DataFrame:
    """A list is loose when a blank line stands before one of its items but the first."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "indent", "list_no").orderBy("line_no"))
    return (
        items.withColumn("nth", nth)
        .groupBy("doc_id", "indent", "list_no")
        .agg(F.count("*").alias("n_items"), F.min("value").alias("start"), (~F.max(F.col("blank_before") & (F.col("nth") > 1))).alias("tight"))
    )


@F.pandas_udf(ArrayType(IntegerType()))
def nearest_smaller(indents: pd.Series) -> pd.Series:
    """For each entry of an array, the position of the last one before it that is smaller, or -1: one stack an array."""

    def positions(row) -> list[int]:
        stack, out = [], []
        for i, indent in enumerate(row):
            while stack and row[stack[-1]] >= indent:
                stack.pop()
            out.append(stack[-1] if stack else -1)
            stack.append(i)
        return out

    return indents.map(positions)


def item_parents(items: DataFrame) -> DataFrame:
    """parent_line: the last item before with a smaller indentation; one sorted array and one stack a document."""
    of_doc = items.select("doc_id", "line_no", "indent").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "indent"))).alias("items"))
    above = of_doc.withColumn("above", nearest_smaller(F.col("items.indent")))
    rows = above.select("doc_id", "items.line_no", "above", F.posexplode("items").alias("at", "item"))
    parents = rows.select("doc_id", F.col("item.line_no").alias("line_no"), F.when(F.get("above", F.col("at")) >= 0, F.get(rows["line_no"], F.get("above", F.col("at")))).alias("parent_line"))
    return items.join(by_key(parents), ["doc_id", "line_no"])


def split_cells(row: Column) -> Column:
    """Cells of a pipe row: escaped pipes and those in code spans do not cut."""
    body = F.regexp_replace(row, r"^\||\|(?:\{[^}]*\})?[ \t]*$", "")
    pieces = F.regexp_extract_all(body, F.lit(r"((?:\\.|`[^`]*`|[^|\\`]|`(?![^`]*`))*)(\||$)"), F.lit(1))
    cut = F.regexp_extract_all(body, F.lit(r"((?:\\.|`[^`]*`|[^|\\`]|`(?![^`]*`))*)(\||$)"), F.lit(2))
    last = F.array_position(cut, "")
    return F.transform(F.slice(pieces, F.lit(1), F.greatest(last, F.lit(1)).cast("int")), lambda x: F.trim(x))


def joined_rows(text: Column) -> Column:
    """Lines of a table as an array in which a ``+`` line's cells are added to the cells above."""
    lines = F.split(text, "\n")

    def step(rows: Column, line: Column) -> Column:
        above, more = split_cells(F.element_at(rows, -1)), split_cells(F.regexp_replace(line, r"^\+", "|"))
        cells = F.zip_with(above, more, lambda a, b: F.trim(F.concat_ws(" ", a, F.when(b != "", b))))
        merged = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        return F.when(line.startswith("+ ") & (F.size(rows) > 0), F.concat(F.slice(rows, F.lit(1), F.size(rows) - 1), F.array(merged))).otherwise(F.concat(rows, F.array(line)))

    return F.when(text.rlike(r"(?m)^\+ "), F.aggregate(lines, F.array().cast("array<string>"), step)).otherwise(lines)


def table_cells(block_rows: DataFrame) -> DataFrame:
    """Cells of pipe tables: doc_id, table_line, row, col (from 1), text, header, align, span marker.

    ``|=`` begins a header cell; a row of dashes is a separator: the row above is a header and the colons
    give column alignments; ``{<} {>} {~}`` at a cell's start align it; ``^`` and ``<`` alone join cells.
    """
    rows = block_rows.where("type = 'table_row'").select("doc_id", F.col("start_line").alias("table_line"), F.posexplode(joined_rows(F.col("text"))).alias("nth", "line"))
    separator = F.col("line").rlike(r"^\|(?:\s*:?-{2,}:?\s*\|)+\s*$")
    order = Window.partitionBy("doc_id", "table_line").orderBy("nth")
    rows = rows.withColumn("separator", separator).withColumn("headed", F.coalesce(F.lead("separator").over(order), F.lit(False)))
    rows = rows.withColumn("aligns", F.first(F.when(separator, split_cells(F.col("line"))), ignorenulls=True).over(Window.partitionBy("doc_id", "table_line")))
    rows = rows.where("not separator").withColumn("row", F.row_number().over(order))
    cells = rows.select("doc_id", "table_line", "row", "headed", "aligns", F.posexplode(split_cells(F.col("line"))).alias("pos", "cell"))
    marked = F.regexp_extract("cell", r"^=?\{([<>~])[v^~]?\}", 1)
    column = F.get("aligns", F.col("pos"))
    align = (
        F.when(marked == "<", "left").when(marked == ">", "right").when(marked == "~", "center")
        .when(column.rlike("^:-+:$"), "center").when(column.rlike("-:$"), "right").when(column.rlike("^:-"), "left")
    )
    return cells.select(
        "doc_id",
        "table_line",
        "row",
        (F.col("pos") + 1).alias("col"),
        F.trim(F.regexp_replace("cell", r"^=?(?:\{[<>~][v^~]?\})?", "")).alias("text"),
        (F.col("headed") | F.col("cell").startswith("=")).alias("header"),
        align.alias("align"),
        F.when(F.col("cell").isin("^", "<"), F.col("cell")).alias("span"),
    )


def table_spans(cells: DataFrame) -> DataFrame:
    """Cells without their span markers, with rowspan and colspan counted over the runs of markers that follow."""
    down = Window.partitionBy("doc_id", "table_line", "col").orderBy("row")
    across = Window.partitionBy("doc_id", "table_line", "row").orderBy("col")
    rows = cells.withColumn("v", F.sum(F.when(~F.coalesce(F.col("span") == "^", F.lit(False)), 1).otherwise(0)).over(down))
    rows = rows.withColumn("h", F.sum(F.when(~F.coalesce(F.col("span") == "<", F.lit(False)), 1).otherwise(0)).over(across))
    rows = rows.withColumn("rowspan", F.count("*").over(Window.partitionBy("doc_id", "table_line", "col", "v"))).withColumn("colspan", F.count("*").over(Window.partitionBy("doc_id", "table_line", "row", "h")))
    return rows.where("span is null").select("doc_id", "table_line", "row", "col", "text", "header", "align", F.col("rowspan").cast("int"), F.col("colspan").cast("int"))


def definitions(classified: DataFrame) -> DataFrame:
    """Footnote, link, abbreviation and citation definitions: kind, label, value, title, line_no."""
    rows = classified.where("form in ('footnote', 'link_definition', 'abbreviation', 'citation')")
    shape = r"^\*?\[[\^@]?([^\]]+)\]:\s*(.*)$"
    value = F.regexp_extract("line", shape, 2)
    is_link = F.col("form") == "link_definition"
    return rows.select(
        "doc_id",
        "line_no",
        F.col("form").alias("kind"),
        F.trim(F.regexp_replace(F.regexp_extract("line", shape, 1), " +", " ")).alias("label"),
        F.when(is_link, F.regexp_extract(value, r"^<?([^\s>]*)", 1)).otherwise(value).alias("value"),
        F.when(is_link & value.rlike(r'"[^"]*"'), F.regexp_extract(value, r'"([^"]*)"', 1)).alias("title"),
    )


def description_lists(classified: DataFrame) -> DataFrame:
    """term and description pairs: a description belongs to the last term above."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    term = F.last(F.when(F.col("form") == "term", F.regexp_replace("line", "^:: +", "")), ignorenulls=True).over(order)
    return classified.withColumn("term", term).where("form = 'description' and term is not null").select("doc_id", "line_no", "term", F.regexp_replace("line", "^: +", "").alias("description"))


def containers(classified: DataFrame) -> DataFrame:
    """Colon containers with depth, name, title, label, and the line that closes them (null if none does).

    A closing line ends the innermost open container. Its opener is the last one opened at its depth.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    step = F.when(F.col("form") == "div_open", 1).when(F.col("form") == "div_close", -1).otherwise(0)
    rows = classified.where("form in ('div_open', 'div_close')").withColumn("open", F.sum(step).over(order)).withColumn("depth", F.when(F.col("form") == "div_close", F.col("open") + 1).otherwise(F.col("open")))
    level = Window.partitionBy("doc_id", "depth").orderBy("line_no")
    closed = F.when(F.lead("form").over(level) == "div_close", F.lead("line_no").over(level))
    info = F.regexp_extract("line", r"^:+[ \t]*(.*)$", 1)
    return rows.withColumn("end_line", closed).where(f"form = 'div_open' and depth <= {MAX_DEPTH}").select(
        "doc_id",
        F.col("line_no").alias("start_line"),
        "end_line",
        F.col("depth").cast("int").alias("depth"),
        F.regexp_extract(info, r"^([^\s\"\[{]+)", 1).alias("name"),
        F.regexp_extract(info, r'"([^"]*)"', 1).alias("title"),
        F.regexp_extract(info, r"\[([^\]]*)\]", 1).alias("label"),
    )


#: Container names with a meaning of their own.
CALLOUTS = ("note", "tip", "warning", "danger", "info", "success", "example", "quote")
GENERATED = ("bibliography", "footnotes", "glossary", "index", "references", "toc")


def container_kind(name: Column) -> Column:
    return (
        F.when(name == ">", "block_quote").when(name == "|", "line_block").when(name == "\\", "hard_break_block").when(name == "figure", "figure_group")
        .when(name.isin(*GENERATED), "directive").when(name.rlike("^[A-Za-z]"), "admonition").otherwise("div")
    )


def number_slot(text):
    """Position, from 1, of the first unescaped ``#`` of a caption; 0 without one."""
    return F.instr(F.regexp_replace(text, r"\\.", "  "), "#")


def captions(block_rows: DataFrame) -> DataFrame:
    """Captions with the type of the block they follow; the first unescaped ``#`` marks the number's place and the text before it the counter."""
    order = Window.partitionBy("doc_id").orderBy("node_id")
    target = F.lag("type").over(order)
    rows = block_rows.withColumn("target", target).where("type = 'caption'")
    text = F.regexp_replace("text", r"^\^ +", "")
    slot = number_slot(text)
    return rows.select("doc_id", "node_id", "start_line", "target", text.alias("text"), F.when(slot > 0, F.trim(F.substring(text, F.lit(1), slot - 1))).alias("counter"))


def attached_attributes(block_rows: DataFrame) -> DataFrame:
    """Blocks whose line above is an attribute block: id, classes and pairs."""
    order = Window.partitionBy("doc_id").orderBy("node_id")
    rows = block_rows.withColumn("above", F.when(F.lag("type").over(order) == "attributes", F.lag("text").over(order))).where("above is not null")
    return rows.select("doc_id", "node_id", "type", "text", attributes("above").alias("a")).select("doc_id", "node_id", "type", "text", "a.id", "a.classes", "a.pairs")


def table_sections(cells: DataFrame, header_rows: int = 1, footer_rows: int = 0) -> DataFrame:
    """cells plus section: head, body or foot by row counts."""
    n = F.max("row").over(Window.partitionBy("doc_id", "table_line"))
    section = F.when(F.col("row") <= header_rows, "head").when(F.col("row") > n - footer_rows, "foot").otherwise("body")
    return cells.withColumn("section", section)


def column_widths(cells: DataFrame) -> DataFrame:
    """Per table column its widest cell and the table's number of columns."""
    from quillgrid.functions.text import display_width

    widths = cells.groupBy("doc_id", "table_line", "col").agg(F.max(display_width("text")).alias("width"))
    return widths.withColumn("arity", F.max("col").over(Window.partitionBy("doc_id", "table_line")))


def block_images(block_rows: DataFrame) -> DataFrame:
    """Paragraphs that are one image and nothing else."""
    shape = r"^!\[([^\]]*)\]\(([^()\s]*)\)$"
    return block_rows.where("type = 'paragraph'").where(F.col("text").rlike(shape)).select("doc_id", "node_id", F.regexp_extract("text", shape, 1).alias("alt"), F.regexp_extract("text", shape, 2).alias("src"))


def attached_blocks(block_rows: DataFrame) -> DataFrame:
    """Blocks that a ``+`` line attaches to the list item above: item and block node ids."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    item = F.last(F.when(F.col("type") == "list_item", F.col("node_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = block_rows.withColumn("item_id", item).withColumn("before", F.lag("type").over(w)).withColumn("before_end", F.lag("end_line").over(w))
    return rows.where("before = 'continuation' and item_id is not null and start_line = before_end + 1").select("doc_id", "item_id", "node_id", "type", "text")


def decisions(classified: DataFrame) -> DataFrame:
    """One record per source line with the form that decided it and the pattern of that form."""
    patterns = F.create_map(*[F.lit(x) for name, pattern in FORMS for x in (name, pattern)])
    return classified.select("doc_id", "line_no", "form", F.try_element_at(patterns, F.col("form")).alias("pattern"))


def visible(classified: DataFrame) -> DataFrame:
    """Lines without comments, so that their neighbours join."""
    return classified.where("form not in ('comment', 'comment_block')")
