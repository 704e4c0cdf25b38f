"""A document's HTML: block rows and inline rows, resolved by joins and woven together by one sort.

Every row gives pieces of output, each with the place at which it stands: a block's path, and within it the numbers
at which an inline construct opens and closes. References, heading ids, cross-references, notes and abbreviations are
equi-joins on a document and a label; sections follow from the last heading of each level, note numbers from
their first use. What is shown elsewhere, as notes are at the end, only changes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import attributes, escape_attribute, escape_html, render_attributes, roman_value, safe_value, slug, smart_dashes, smart_symbols
from quillgrid.operators import blocks as B
from quillgrid.operators.frames import HIDDEN, nested
from quillgrid.operators.inlines import FORCED
from quillgrid.operators.render import SEMANTIC
from quillgrid.operators.spans import inline_rows
from quillgrid.operators.windows import first_use_numbers, sections, unique_ids
from quillgrid.sources.shared import by_key, discard, materialize

LAST = 2**31 - 1
TEXTS = ("text", "literal", "soft_break", "literal_text", "code", "math", "display_math", "mention", "tag", "autolink")


def lit(text: str) -> Column:
    return F.lit(text)


def at(*parts: Column | str | int) -> Column:
    """A place: arrays and numbers one after the other."""
    return F.concat(*[F.array(F.lit(p)) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts])


def one(number: Column) -> Column:
    return F.array(number.cast("int"))


def label_key(label: Column) -> Column:
    """Labels meet whatever runs of blanks they hold; other white space counts."""
    return F.regexp_replace(F.regexp_replace(label, "^ +| +$", ""), " +", " ")


def parsed(own: Column | str) -> Column:
    """Blocks of attributes as one struct of id, classes and pairs."""
    own = F.col(own) if isinstance(own, str) else own
    return attributes(F.regexp_replace(F.coalesce(own, lit("{}")), r"\}\s*\{|\n", " "))


def shown_attributes(own: Column | str, classes: Column | None = None, with_id: bool = True) -> Column:
    a = parsed(own)
    names = a["classes"] if classes is None else F.concat(classes, a["classes"])
    named = F.when(F.coalesce(a["id"], lit("")) != "", F.concat(lit(' id="'), escape_attribute(a["id"]), lit('"'))).otherwise("") if with_id else lit("")
    return F.concat(named, F.when(F.size(names) > 0, F.concat(lit(' class="'), escape_attribute(F.array_join(names, " ")), lit('"'))).otherwise(""), render_attributes(a["pairs"]))


def note_path() -> Column:
    """The path of the innermost note around a block, or null."""
    places = F.transform("chain", lambda x, i: F.when(x["kind"] == "footnote", i + 1))
    k = F.array_max(places)
    return F.when(k.isNotNull(), F.slice("path", F.lit(1), k))


def inline_texts(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, place, note, text of everything that inline constructs are read from; breaks: whether its line ends are shown."""
    t = F.col("type")
    verse = F.regexp_replace(F.regexp_replace("text", r"\n+\z", ""), r"(?m)(?<=^ {0,200}) ", "\u00a0")
    breaks = F.coalesce(F.when(t == "container", F.col("name") == "|").otherwise(F.try_element_at("chain", F.lit(-1))["name"] == "\\"), F.lit(False))
    text = F.when(t == "heading", F.regexp_replace("text", r"^#{1,6} +", "")).when(t == "container", F.when(F.col("name") == "|", verse)).when(t.isin("paragraph", "term"), F.col("text"))
    parts = F.array(
        F.struct(F.col("path").alias("place"), text.alias("text")),
        F.struct(at("path", LAST - 2).alias("place"), F.col("caption").alias("text")),
        F.struct(at("path", 0).alias("place"), F.when(t == "container", F.col("label")).alias("text")),
    )
    own = rows.withColumn("breaks", breaks).select("doc_id", "note", "breaks", F.inline(F.filter(parts, lambda x: x["text"].isNotNull())))
    return own.unionByName(cells.select("doc_id", "place", "note", "text", F.lit(False).alias("breaks")))


def table_rows(rows: DataFrame) -> DataFrame:
    """Cells with spans, sections and places."""
    tables = rows.where("type = 'table_row'")
    found = B.table_spans(B.table_cells(tables))
    bodies = F.min(F.when(~F.col("headed"), F.col("row"))).over(Window.partitionBy("doc_id", "table_line"))
    found = found.withColumn("headed", F.min("header").over(Window.partitionBy("doc_id", "table_line", "row"))).withColumn("body", F.coalesce(bodies, F.lit(LAST)))
    placed = found.join(tables.select("doc_id", F.col("start_line").alias("table_line"), "path", "note"), ["doc_id", "table_line"])
    return placed.withColumn("place", at("path", one(F.col("row")), one(F.col("col"))))


def table_pieces(cells: DataFrame) -> DataFrame:
    head = F.col("row") < F.col("body")
    span = lambda name: F.when(F.col(name) > 1, F.concat(lit(f' {name}="'), F.col(name).cast("string"), lit('"'))).otherwise("")
    style = F.when(F.col("align").isNotNull(), F.concat(lit(' style="text-align: '), "align", lit(';"'))).otherwise("")
    tag = F.when(F.col("header"), "th").otherwise("td")
    scope = F.when(~F.col("header"), "").when(head, ' scope="col"').otherwise(' scope="row"')
    each = F.array(
        F.struct(F.col("place").alias("place"), F.concat(lit("<"), tag, scope, span("rowspan"), span("colspan"), style, lit(">")).alias("out")),
        F.struct(at("place", LAST).alias("place"), F.concat(lit("</"), tag, lit(">")).alias("out")),
    )
    lines = cells.groupBy("doc_id", "path", "note", "table_line", "row", "body").agg(F.lit(1).alias("one"))
    order = Window.partitionBy("doc_id", "table_line").orderBy("row")
    last = F.lead("row").over(order).isNull()
    begins = F.when(F.col("row") == F.col("body"), lit("\n<tbody>")).when((F.col("row") == 1) & head, lit("\n<thead>")).otherwise("")
    ends = F.when(last & ~head, lit("\n</tbody>")).when(head & (last | (F.lead("row").over(order) == F.col("body"))), lit("\n</thead>")).otherwise("")
    lines = lines.withColumns({"begins": begins, "ends": ends})
    around = F.array(
        F.struct(at("path", one(F.col("row"))).alias("place"), F.concat("begins", lit("\n<tr>")).alias("out")), F.struct(at("path", one(F.col("row")), LAST).alias("place"), F.concat(lit("</tr>"), "ends").alias("out"))
    )
    return cells.select("doc_id", "note", F.inline(each)).unionByName(lines.select("doc_id", "note", F.inline(around)))


def block_pieces(rows: DataFrame) -> DataFrame:
    """Opening and closing pieces of blocks; heading rows have id and level."""
    t, name, own = F.col("type"), F.col("name"), F.col("attributes")
    first = F.when(F.col("in_tight") & (t == "paragraph") & (F.col("nth_shown") == 1), "").otherwise("\n")
    flush = F.col("in_tight") & (t == "paragraph")
    level = F.col("level").cast("string")
    lang = F.regexp_extract("fence.info", r"^=?([^\s\"\[{]*)", 1)
    code = F.concat(lit("<pre"), shown_attributes(own), lit("><code"), F.when(lang != "", F.concat(lit(' class="language-'), escape_attribute(lang), lit('"'))).otherwise(""), lit(">"), escape_html("text"), F.when(F.col("text") != "", "\n").otherwise(""), lit("</code></pre>"))
    aside = F.coalesce(name.isin(*B.CALLOUTS), F.lit(False))
    told = F.when(F.col("title") != "", F.col("title")).otherwise(F.initcap("name"))
    classes = F.when(aside, F.array(lit("admonition"), name)).when(name == "", F.array().cast("array<string>")).otherwise(F.array(name))
    tag = F.when(aside, "aside").when(name == ">", "blockquote").when(name == "figure", "figure").otherwise("div")
    title = F.when(F.col("title") != "", F.concat(lit('\n<p class="admonition-title">'), escape_html("title"), lit("</p>"))).otherwise("")
    bare = tag.isin("blockquote", "figure")
    box = F.concat(lit("<"), tag, shown_attributes(own, F.when(bare, F.array().cast("array<string>")).otherwise(classes)), F.when(aside, F.concat(lit(' aria-label="'), escape_attribute(told), lit('"'))).otherwise(""), lit(">"), title, F.when(F.col("label").isNotNull(), '\n<p class="div-label">').otherwise(""))
    letters = F.regexp_extract("marker", "^([0-9A-Za-z]*)", 1)
    kind = F.substring("style", 1, 1)
    number = F.when(kind == "1", F.try_to_number(letters, lit("999999999"))).when(kind.isin("i", "I"), roman_value(letters)).otherwise(F.ascii(F.lower(letters)) - 96)
    numbered = ~F.col("marker").isin("-", "*")
    start = F.when((number != 1) & (letters != ""), F.concat(lit(' start="'), number.cast("string"), lit('"'))).otherwise("")
    typed = F.when(kind != "1", F.concat(lit(' type="'), kind, lit('"'))).otherwise("")
    delim = F.when(F.col("style").endswith(")"), ' data-delim=")"').otherwise("")
    tasks = F.when(F.col("task").isNotNull(), F.array(lit("task-list"))).otherwise(F.array().cast("array<string>"))
    opener = F.when(numbered, F.concat(lit("<ol"), typed, start, delim, shown_attributes(own, tasks), lit(">\n"))).otherwise(F.concat(lit("<ul"), shown_attributes(own, tasks), lit(">\n")))
    state = F.when(F.trim("task") != "", F.concat(lit(' data-task-state="'), escape_attribute(F.col("task")), lit('"'))).otherwise("")
    checkbox = F.when(F.col("task").isNotNull(), F.concat(lit('<input type="checkbox"'), F.when(F.lower("task") == "x", " checked").otherwise(""), lit(" disabled"), F.when(F.col("said").isNotNull(), F.concat(lit(' aria-label="'), escape_attribute("said"), lit('"'))).otherwise(""), lit("> "))).otherwise("")
    item = F.concat(F.when(F.col("first_item"), opener).otherwise(""), lit("<li"), shown_attributes("item_attributes"), state, lit(">"), checkbox)
    head = F.concat(F.when(F.col("section"), F.concat(lit('<section id="'), escape_attribute("id"), lit('">\n'))).otherwise(""), lit("<h"), level, F.when(~F.col("section"), F.concat(lit(' id="'), escape_attribute("id"), lit('"'))).otherwise(""), shown_attributes(own, with_id=False), lit(">"))
    dl = F.when(F.col("first_item"), F.concat(lit("<dl"), shown_attributes(own), lit(">\n"))).otherwise("")
    opening = (
        F.when(flush, "").when(t == "paragraph", F.concat(lit("<p"), shown_attributes(own), lit(">"))).when(t == "heading", head).when(t == "rule", F.concat(lit("<hr"), shown_attributes(own), lit(">")))
        .when(t == "code", code).when((t == "raw") & (lang == "html"), F.col("text")).when(t == "quote", F.concat(lit("<blockquote"), shown_attributes(own), lit(">"))).when(t == "list_item", item)
        .when(t == "term", F.concat(dl, lit("<dt>"))).when(t == "description", F.concat(dl, lit("<dd>"))).when(t == "table_row", F.concat(lit("<table"), shown_attributes(own), lit(">")))
        .when((t == "container") & (name == "|"), F.concat(lit("<div"), shown_attributes(own, F.array(lit("line-block"))), lit(">"), F.when(F.trim("text") != "", "\n<p>").otherwise(""))).when(t == "container", box)
    )
    ended = F.when(F.col("ends_flush"), "").otherwise("\n")
    over = lambda close: F.when(F.col("last_item"), close).otherwise("")
    closing = (
        F.when(flush, "").when(t == "paragraph", "</p>").when(t == "heading", F.concat(lit("</h"), level, lit(">"))).when(t == "quote", "\n</blockquote>")
        .when(t == "list_item", F.concat(ended, lit("</li>"), over(F.when(numbered, "\n</ol>").otherwise("\n</ul>")))).when(t == "term", F.concat(lit("</dt>"), over(lit("\n</dl>")))).when(t == "description", F.concat(ended, lit("</dd>"), over(lit("\n</dl>"))))
        .when(t == "table_row", "\n</table>").when((t == "container") & (name == "|"), F.when(F.trim("text") != "", "</p>\n</div>").otherwise("\n</div>")).when(t == "container", F.concat(lit("\n</"), tag, lit(">")))
    )
    framed = F.col("caption").isNotNull()
    pieces = F.array(
        F.struct(F.col("path").alias("place"), F.concat(first, F.when(framed, "<figure>\n").otherwise(""), opening).alias("out")),
        F.struct(at("path", 0, LAST).alias("place"), F.when((t == "container") & F.col("label").isNotNull(), "</p>").alias("out")),
        F.struct(at("path", LAST - 3).alias("place"), F.when(framed, F.concat(F.coalesce(closing, lit("")), lit("\n<figcaption>"))).alias("out")),
        F.struct(at("path", LAST).alias("place"), F.when(framed, "</figcaption>\n</figure>").otherwise(closing).alias("out")),
    )
    return rows.where(~t.isin(*HIDDEN)).select("doc_id", "note", F.inline(F.filter(pieces, lambda p: p["out"].isNotNull())))


def inline_pieces(inl: DataFrame) -> DataFrame:
    """Pieces of inline rows; resolved ones bring href, number, repeat, linked, said."""
    k, value, own = F.col("kind"), F.col("value"), F.col("attributes")
    a = shown_attributes(own)
    named = lambda name, x: F.when(x.isNotNull(), F.concat(lit(f' {name}="'), escape_attribute(x), lit('"'))).otherwise("")
    element = F.create_map(*[lit(x) for _, kind, e in FORCED for x in (kind, e)])
    semantic = F.regexp_extract(own, rf"^\{{({'|'.join(SEMANTIC)})(?:[=}}\s]|$)", 1)
    typed = escape_html(F.replace(smart_symbols(smart_dashes(value)), lit("..."), lit("…")))
    words = F.transform(F.regexp_extract_all(typed, lit(r"[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0)), lambda w: F.coalesce(F.concat(lit('<abbr title="'), escape_attribute(F.try_element_at("abbreviations", w)), lit('">'), w, lit("</abbr>")), w))
    text = F.when(F.col("abbreviations").isNotNull(), F.array_join(words, "")).otherwise(typed)
    n = F.col("number").cast("string")
    ref = F.concat(n, F.when(F.col("repeat") > 1, F.concat(lit("-"), F.col("repeat").cast("string"))).otherwise(""))
    note = F.when(F.col("linked"), F.concat(lit('<sup id="fnref'), ref, lit('"'), a, lit(">"), n, lit("</sup>"))).otherwise(F.concat(lit('<a id="fnref'), ref, lit('" href="#fn'), n, lit('" role="doc-noteref"'), a, lit("><sup>"), n, lit("</sup></a>")))
    note = F.when(n.isNull(), F.concat(lit("[^"), escape_html(value), lit("]"))).otherwise(note)
    math = lambda kind, x, y: F.concat(lit(f'<span class="math {kind}" role="math">{x}'), escape_html(value), lit(f"{y}</span>"))
    image = F.concat(lit("<img"), named("src", safe_value("href")), lit(' alt="'), escape_attribute(value), lit('"'), named("title", F.col("title")), a, lit(">"))
    href = safe_value("href")
    link = F.concat(lit("<a"), named("href", href), named("title", F.col("title")), a, lit(">"))
    spelled = escape_html(F.col("source"))
    opening = (
        F.when(k == "text", text).when((k == "soft_break") & F.col("breaks"), "<br>\n").when(k.isin("literal", "soft_break", "literal_text"), escape_html(value)).when(k == "hard_break", "<br>\n").when(element[k].isNotNull(), F.concat(lit("<"), element[k], a, lit(">")))
        .when(k == "code", F.concat(lit("<code"), a, lit(">"), escape_html(value), lit("</code>"))).when(k == "math", math("inline", "\\(", "\\)")).when(k == "display_math", math("display", "\\[", "\\]"))
        .when(k == "raw", F.when(F.col("target") == "html", value)).when(k == "editorial_comment", F.concat(lit('<span class="critic-comment">'), escape_html(value), lit("</span>")))
        .when(k.isin("link", "reference"), F.when(F.col("href").isNotNull(), link).otherwise("[")).when(k == "image", image)
        .when(k == "image_reference", F.when(F.col("href").isNotNull(), image).otherwise(F.concat(lit("!["), escape_html(value), lit("]"), spelled)))
        .when(k == "autolink", F.concat(lit('<a href="'), F.when(value.contains(":"), "").otherwise("mailto:"), escape_attribute(value), lit('"'), a, lit(">"), escape_html(value), lit("</a>")))
        .when(k == "crossref", F.when(F.col("said").isNotNull(), F.concat(lit('<a href="#'), escape_attribute("href"), lit('"'), a, lit(">"), escape_html("said"), lit("</a>"))).otherwise(F.concat(lit("&lt;/#"), escape_html(value), lit("&gt;"))))
        .when(k == "span", F.when(semantic != "", F.concat(lit("<"), semantic, lit(">"))).otherwise(F.concat(lit("<span"), a, lit(">")))).when(k == "extension", F.concat(lit("<span"), shown_attributes(own, F.array(F.concat(lit("ext-"), "target"))), lit(">")))
        .when(k.isin("mention", "tag"), F.concat(lit('<span class="'), k, lit('"><strong>'), escape_html(value), lit("</strong></span>"))).when(k.isin("note_ref", "inline_note"), note)
    )
    closing = (
        F.when(element[k].isNotNull(), F.concat(lit("</"), element[k], lit(">"))).when(k == "link", "</a>").when(k == "reference", F.when(F.col("href").isNotNull(), "</a>").otherwise(F.concat(lit("]"), spelled)))
        .when(k == "span", F.concat(lit("</"), F.when(semantic != "", semantic).otherwise("span"), lit(">"))).when(k == "extension", "</span>")
    )
    pieces = F.array(F.struct(at("place", one(F.col("open") + 1)).alias("place"), opening.alias("out")), F.struct(at("place", one(F.col("close") + 1)).alias("place"), closing.alias("out")))
    return inl.select("doc_id", "note", F.inline(F.filter(pieces, lambda p: p["out"].isNotNull())))


def heading_ids(rows: DataFrame, inl: DataFrame) -> DataFrame:
    """doc_id, start_line, path, level, section, said, id of headings: ids given, else the slug of what they say, unique in the document."""
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("open", F.when(F.col("kind") == "soft_break", " ").otherwise(F.col("value")).alias("value")))), lambda x: x["value"]), "")
    heads = rows.where("type = 'heading'").select("doc_id", "start_line", "path", F.length(F.regexp_extract("text", "^#+", 0)).alias("level"), (F.col("depth") == 1).alias("section"), parsed("attributes")["id"].alias("own"))
    told = inl.where(F.col("kind").isin(*TEXTS)).join(heads.select("doc_id", F.col("path").alias("place")), ["doc_id", "place"], "left_semi").groupBy("doc_id", "place").agg(said.alias("said"))
    heads = heads.join(told.withColumnRenamed("place", "path"), ["doc_id", "path"], "left").withColumn("said", F.coalesce("said", lit(""))).withColumn("slug", slug("said"))
    given = F.coalesce("own", lit("")) != ""
    reserved = rows.select("doc_id", parsed("attributes")["id"].alias("id")).unionByName(inl.where("attributes is not null").select("doc_id", parsed("attributes")["id"].alias("id"))).where("id <> ''").distinct()
    made = unique_ids(heads.where(~given), "slug", "start_line", reserved)
    columns = ["doc_id", "start_line", "path", "level", "section", "said", "id"]
    return made.select(*columns).unionByName(heads.where(given).withColumn("id", F.col("own")).select(*columns))


def section_ends(ids: DataFrame) -> DataFrame:
    tops = ids.where("section").select("doc_id", F.col("path")[0].alias("p"), "level")
    order = (10 - F.col("level")).cast("int")
    place = F.when(F.col("next").isNull(), F.array(F.lit(LAST - 1), order)).otherwise(F.array((F.col("next") - 1).cast("int"), F.lit(LAST), order))
    return sections(tops, "p").select("doc_id", F.lit(None).cast("array<int>").alias("note"), place.alias("place"), lit("\n</section>").alias("out"))


def link_targets(rows: DataFrame) -> DataFrame:
    """doc_id, key, href, title, attributes of link definitions, the last of a label."""
    shape = r"^\[([^\]]*)\]:[ \t]*<?([^\s>]*)>?(?:[ \t]+\"([^\"]*)\")?[ \t]*(\{.*\})?"
    part = lambda i: F.regexp_extract("text", shape, i)
    found = rows.where("type = 'link_definition'").select("doc_id", "path", label_key(part(1)).alias("key"), F.struct(part(2).alias("href"), F.when(part(3) != "", part(3)).alias("title"), F.when(part(4) != "", part(4)).alias("attributes")).alias("to"))
    return found.groupBy("doc_id", "key").agg(F.max_by("to", "path").alias("to"))


def resolved_references(refs: DataFrame, targets: DataFrame, ids: DataFrame) -> DataFrame:
    """refs with href and title: by definition, a collapsed one else by a heading's text."""
    keyed = refs.withColumn("source", F.col("title")).withColumn("key", label_key(F.col("target")))
    named = ids.groupBy("doc_id", label_key(F.col("said")).alias("key")).agg(F.min_by("id", "start_line").alias("id"))
    joined = keyed.join(targets, ["doc_id", "key"], "left").join(named, ["doc_id", "key"], "left")
    href = F.coalesce("to.href", F.when(F.col("source") == "[]", F.concat(lit("#"), "id")))
    own = F.concat_ws(" ", "to.attributes", "attributes")
    return joined.withColumns({"href": href, "title": F.col("to.title"), "attributes": F.when(own != "", own)}).drop("key", "to", "id")


def noted(inl: DataFrame, notes: DataFrame) -> DataFrame:
    """Note references and inline notes with key, number, repeat and linked (whether a link holds them).

    Numbers follow the first use; uses in notes come after those in the text. A reference without a note has no number.
    """
    uses = inl.where("kind in ('note_ref', 'inline_note')")
    own = F.concat(lit("\u0000"), F.array_join(F.transform("place", lambda x: x.cast("string")), "."), lit(":"), F.col("open").cast("string"))
    uses = uses.withColumn("label", F.when(F.col("kind") == "note_ref", F.col("value")).otherwise(own)).withColumn("position", F.struct(F.col("note").isNotNull().alias("later"), F.col("place"), F.col("open")))
    known = uses.where("kind = 'inline_note'").unionByName(uses.where("kind = 'note_ref'").join(notes.select("doc_id", "label"), ["doc_id", "label"], "left_semi"))
    numbers = first_use_numbers(known.select("doc_id", "label", "position", "place", "ord")).select("doc_id", "place", "ord", "number", "repeat")
    links = inl.where("kind in ('link', 'reference')").groupBy("doc_id", "place").agg(F.collect_list(F.struct("open", "close")).alias("links"))
    held = uses.join(numbers, ["doc_id", "place", "ord"], "left").join(links, ["doc_id", "place"], "left")
    linked = F.coalesce(F.exists("links", lambda x: (x["open"] < F.col("open")) & (x["close"] > F.col("open"))), F.lit(False))
    return held.withColumn("linked", linked).drop("links", "position")


def endnotes(used: DataFrame, notes: DataFrame, rows: DataFrame) -> DataFrame:
    """Pieces around the notes at the end: the section, an item for each number, links back."""
    numbers = used.where("number is not null").groupBy("doc_id", "number").agg(F.max("repeat").cast("int").alias("uses"), F.max(F.col("kind") == "inline_note").alias("inline"), F.max("label").alias("label"))
    inner = rows.where(F.col("note").isNotNull() & (F.col("depth") == F.size("note") + 1) & ~F.col("type").isin(*HIDDEN))
    lasts = inner.groupBy("doc_id", F.col("note").alias("path")).agg(F.max_by(F.struct("type", F.element_at("path", -1).alias("nth")), F.element_at("path", -1)).alias("last"))
    told = numbers.join(notes.join(lasts, ["doc_id", "path"], "left").select("doc_id", "label", "last"), ["doc_id", "label"], "left")
    n, many = F.col("number").cast("string"), F.col("uses") > 1
    nth = lambda k: F.when(k > 1, F.concat(lit("-"), k.cast("string"))).otherwise("")
    back = lambda k: F.concat(lit('<a href="#fnref'), n, nth(k), lit('" role="doc-backlink" aria-label="Back to reference'), F.when(many, F.concat(lit(" "), k.cast("string"))).otherwise(""), lit('">↩'), F.when(many, F.concat(lit("<sup>"), k.cast("string"), lit("</sup>"))).otherwise(""), lit("</a>"))
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.col("uses")), back), " ")
    place = F.array(F.lit(LAST), F.col("number").cast("int"))
    within = F.col("last.type") == "paragraph"
    parts = F.array(
        F.struct(place.alias("place"), F.concat(lit('\n<li id="fn'), n, lit('">'), F.when(F.col("inline"), "\n<p>").otherwise("")).alias("out")),
        F.struct(F.when(within, F.concat(place, F.array("last.nth", F.lit(LAST - 1)))).otherwise(F.concat(place, F.array(F.lit(LAST - 1)))).alias("place"), F.when(within, links).when(F.col("inline"), F.concat(links, lit("</p>"))).otherwise(F.concat(lit("\n<p>"), links, lit("</p>"))).alias("out")),
        F.struct(F.concat(place, F.array(F.lit(LAST))).alias("place"), lit("\n</li>").alias("out")),
    )
    whole = numbers.select("doc_id").distinct().select("doc_id", F.inline(F.array(
        F.struct(F.array(F.lit(LAST)).alias("place"), lit('\n<section role="doc-endnotes" aria-label="Footnotes">\n<hr>\n<ol>').alias("out")), F.struct(F.array(F.lit(LAST), F.lit(LAST)).alias("place"), lit("\n</ol>\n</section>").alias("out")))))
    return told.select("doc_id", F.inline(parts)).unionByName(whole)


def moved(pieces: DataFrame, notes: DataFrame, used: DataFrame) -> DataFrame:
    """Pieces with those of used notes at the end of the document and those of unused ones left out."""
    numbers = used.where("number is not null and kind = 'note_ref'").select("doc_id", "label", F.col("number").cast("int").alias("number")).distinct()
    places = notes.join(numbers, ["doc_id", "label"]).select("doc_id", F.col("path").alias("note"), "number")
    inside = pieces.where("note is not null").join(by_key(places), ["doc_id", "note"])
    place = F.concat(F.array(F.lit(LAST), F.col("number")), F.slice("place", F.size("note") + 1, F.greatest(F.size("place") - F.size("note"), F.lit(0))))
    return pieces.where("note is null").select("doc_id", "place", "out").unionByName(inside.select("doc_id", place.alias("place"), "out"))


def out_of_line(inl: DataFrame, used: DataFrame) -> DataFrame:
    """Inline rows with those that an inline note holds placed at the note's number."""
    held = used.where("kind = 'inline_note' and number is not null").groupBy("doc_id", "place").agg(F.collect_list(F.struct("open", "close", F.col("number").cast("int").alias("number"))).alias("held"))
    joined = inl.join(held, ["doc_id", "place"], "left")
    within = F.filter("held", lambda x: (x["open"] < F.col("open")) & (x["close"] > F.col("open")))
    number = F.array_max(within)["number"]  # the innermost opens last
    return joined.withColumns({"note": F.when(number.isNull(), F.col("note")), "place": F.when(number.isNull(), F.col("place")).otherwise(F.array(F.lit(LAST), number))}).drop("held")


def convert(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source) -> doc_id, html: the whole page with ids, sections, references, notes and abbreviations resolved.

    A null or empty source gives an empty page. An unresolved reference shows its source; the last definition of a link's label holds, the first
    of a note's. doc_id is a key; other columns are ignored.
    """
    rows = by_key(materialize(nested(docs).withColumn("note", note_path()), "blocks"))
    cells = by_key(materialize(table_rows(rows), "cells"))
    inl = by_key(materialize(inline_rows(inline_texts(rows, cells), ["doc_id", "place", "note", "breaks"]), "inlines"))
    ids = by_key(materialize(heading_ids(rows, inl), "ids"))
    notes = rows.where("type = 'footnote'").groupBy("doc_id", "label").agg(F.min("path").alias("path"))
    used = by_key(materialize(noted(inl, notes), "notes"))
    short = rows.where("type = 'abbreviation'").select("doc_id", F.regexp_extract("text", r"^\*\[([^\]]+)\]", 1).alias("key"), F.trim(F.regexp_extract("text", r"^\*\[[^\]]+\]:(.*)$", 1)).alias("value"), "path")
    short = short.groupBy("doc_id", "key").agg(F.max_by("value", "path").alias("value")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("abbreviations"))

    refs = resolved_references(inl.where("kind in ('reference', 'image_reference')"), link_targets(rows), ids)
    crossed = inl.where("kind = 'crossref'").join(ids.select("doc_id", F.col("id").alias("value"), "said", F.col("id").alias("href")), ["doc_id", "value"], "left")
    rest = inl.where("kind not in ('reference', 'image_reference', 'crossref', 'note_ref', 'inline_note')").withColumn("href", F.col("target"))
    whole = rest.unionByName(refs, True).unionByName(crossed, True).unionByName(used.drop("label"), True)
    whole = out_of_line(whole, used).join(short, "doc_id", "left")
    whole = whole.withColumn("linked", F.coalesce("linked", F.lit(False)))

    tasks = rows.where("type = 'list_item' and task is not null").select("doc_id", F.col("path").alias("item"))
    lead = inl.where(F.col("kind").isin(*TEXTS)).withColumn("item", F.slice("place", 1, F.size("place") - 1)).where(F.element_at("place", -1) == 1).join(tasks, ["doc_id", "item"], "left_semi")
    said = lead.groupBy("doc_id", F.col("item").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("open", "value"))), lambda x: x["value"]), "").alias("said"))
    heads = rows.where("type = 'heading'").join(ids.drop("start_line", "said"), ["doc_id", "path"])
    items = rows.where("type = 'list_item'").join(said, ["doc_id", "path"], "left")
    others = rows.where("type not in ('heading', 'list_item')")
    blocks = others.unionByName(heads, True).unionByName(items, True)

    pieces = block_pieces(blocks).unionByName(table_pieces(cells)).unionByName(inline_pieces(whole)).unionByName(section_ends(ids))
    pieces = moved(pieces, notes, used).unionByName(endnotes(used, notes, rows))
    parts = F.sort_array(F.collect_list(F.struct("place", "out")))
    pages = pieces.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["out"]), "").alias("html"))
    made = materialize(docs.select("doc_id").join(by_key(pages), "doc_id", "left").select("doc_id", F.regexp_replace(F.coalesce("html", lit("")), r"^\n", "").alias("html")), "pages")
    discard(rows, cells, inl, ids, used)
    return made
