"""Inline operators: a text column -> one row per construct, by patterns over the text outside code spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import col, escape_attribute, escape_html, smart_dashes, smart_quotes, smart_symbols

CODE = r"(?<!`)(?<run>`+)(?!`)((?s:.+?))(?<!`)\k<run>(?!`)"
#: Delimiter, node type and HTML element of the inline marks.
MARKS = (("*", "strong", "strong"), ("/", "emphasis", "em"), ("_", "underline", "u"), ("~", "strike", "s"), ("=", "highlight", "mark"))
FORCED = (*MARKS, ("^", "superscript", "sup"), (",", "subscript", "sub"), ("+", "insert", "ins"), ("-", "delete", "del"))


def bare(delimiter: str) -> str:
    """A mark opens before ink, after no word character and beside no second delimiter; it closes after ink."""
    d = f"\\{delimiter}"
    return rf"(?<![\w\\{d}]){d}(?![\s{d}])((?:[^{d}\\\n]|\\.)*?[^\s{d}\\]){d}(?![\w{d}])"


def forced(delimiter: str) -> str:
    d = f"\\{delimiter}"
    return rf"(?<!\\)\{{{d}(.+?)(?<!\\){d}\}}"


#: Patterns of one construct each, and the groups that matter.
CONSTRUCTS = {
    "escape": (r"\\([!-/:-@\[-`{-~])", 1),
    "raw_inline": (r"`+([^`]+)`+\{=(\w+)\}", 1),
    "literal": (r"!`([^`]+)`", 1),
    "math": (r"(?<!\$)\$`([^`]+)`", 1),
    "display_math": (r"\$\$`([^`]+)`", 1),
    "bold_italic": (r"/\*(?!\s)(.+?)(?<!\s)\*/", 1),
    "substitution": (r"\{~(.+?)~>(.*?)~\}", 1),
    "editorial_comment": (r"\{#(.+?)#\}", 1),
    "inline_comment": (r"\{%(.*?)%\}", 1),
    "autolink": (r"<((?:https?://|mailto:)[^\s>]+|[^\s<>@]+@[^\s<>@]+\.[^\s<>@]+)>", 1),
    "crossref": (r"</#([^\s>]+)>", 1),
    "footnote_ref": (r"\[\^([^\]\s]+)\]", 1),
    "inline_footnote": (r"\^\[([^\]]+)\]", 1),
    "extension": (r":([a-z][\w-]*)\[([^\]]*)\]", 1),
    "symbol": (r"(?<![\w:]):([a-z][\w+-]*):(?![\w\[])", 1),
    "mention": (r"(?<![\w@])@([A-Za-z0-9_]*[A-Za-z][\w-]*)", 1),
    "tag": (r"(?<![\w#&])#([A-Za-z0-9_]*[A-Za-z][\w-]*)", 1),
    "citation": (r"\[((?:[^\[\]@]*-?@[^\[\]]+))\]", 1),
    "caption_number": (r"(?<!\S)#(?!\S)", 0),
    "include": (r"\{\{ *([^\s}]+)([^}]*)\}\}", 1),
    "wikilink": (r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", 1),
    "ruby": (r"\{([^{}|]+)\|([^{}|]+)\}", 1),
} | {name: (bare(d), 1) for d, name, _ in MARKS} | {f"forced_{name}": (forced(d), 1) for d, name, _ in FORCED}
LINK = r"(?<![!\\\]])\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?: \"([^\"]*)\")?\)(\{[^}]*\})?"
IMAGE = r"!\[([^\]]*)\]\(([^()\s]*)(?: \"([^\"]*)\")?\)"
REFERENCE = r"(?<![!\\\]])\[([^\[\]^@]+)\]\[([^\[\]]*)\]"
SPAN = r"(?<![!\\\]])\[([^\[\]]+)\]\{([^}]*)\}"


def outside_code(text: Column | str) -> Column:
    """The text with code spans blanked to the same length, so that positions stay."""
    parts = F.regexp_extract_all(col(text), F.lit(rf"(?:{CODE})|[^`]+|`+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^`.*`$"), F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")


def occurrences(texts: DataFrame, construct: str, text: str = "text", group: int | None = None, skip_code: bool = True) -> DataFrame:
    """texts plus ord and value for every occurrence of a construct in a text column."""
    pattern, own = CONSTRUCTS[construct]
    body = outside_code(text) if skip_code and construct not in ("raw_inline", "literal", "math", "display_math") else F.col(text)
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(own if group is None else group))
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.posexplode(found).alias("ord", "value"))


def code_spans(texts: DataFrame, text: str = "text") -> DataFrame:
    keep = [c for c in texts.columns if c != text]
    body = F.regexp_extract_all(F.col(text), F.lit(CODE), F.lit(2))
    stripped = F.transform(body, lambda x: F.when(x.rlike("^ .*[^ ].* $|^ `|` $"), F.regexp_replace(x, "^ | $", "")).otherwise(x))
    return texts.select(*keep, F.posexplode(stripped).alias("ord", "value"))


def grouped(texts: DataFrame, pattern: str, names: dict[str, int], text: str = "text") -> DataFrame:
    """texts plus ord and one column per named group for every match outside code."""
    keep = [c for c in texts.columns if c != text]
    body = outside_code(text)
    parts = [F.regexp_extract_all(body, F.lit(pattern), F.lit(i)).alias(n) for n, i in names.items()]
    return texts.select(*keep, F.posexplode(F.arrays_zip(*parts)).alias("ord", "m")).select(*keep, "ord", *[F.col(f"m.{n}") for n in names])


def links(texts: DataFrame, text: str = "text") -> DataFrame:
    return grouped(texts, LINK, {"label": 1, "href": 2, "title": 3, "attributes": 4}, text)


def images(texts: DataFrame, text: str = "text") -> DataFrame:
    return grouped(texts, IMAGE, {"alt": 1, "src": 2, "title": 3}, text)


def references(texts: DataFrame, text: str = "text") -> DataFrame:
    """``[text][label]`` and ``[label][]`` with the normalized label."""
    rows = grouped(texts, REFERENCE, {"label_text": 1, "ref": 2}, text)
    label = F.when(F.col("ref") == "", F.col("label_text")).otherwise(F.col("ref"))
    return rows.withColumn("label", F.trim(F.regexp_replace(label, " +", " ")))


def spans(texts: DataFrame, text: str = "text") -> DataFrame:
    return grouped(texts, SPAN, {"content": 1, "attributes": 2}, text)


def citations(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per item of a citation group: prefix, key, suppressed author, locator."""
    rows = occurrences(texts, "citation", text)
    keep = [c for c in texts.columns if c != text]
    items = rows.select(*keep, "ord", F.posexplode(F.split("value", r";\s*")).alias("item", "part"))
    shape = r"^(.*?)(-?)@([\w:.-]*\w)(?:,\s*(.*))?$"
    pick = lambda i: F.regexp_extract("part", shape, i)
    return items.select(*keep, "ord", "item", F.trim(pick(1)).alias("prefix"), (pick(2) == "-").alias("suppressed"), pick(3).alias("key"), pick(4).alias("locator"))


def expand_symbols(text: Column | str, symbols: dict[str, str]) -> Column:
    """``:name:`` replaced where the name has a replacement."""
    known = F.create_map(*[F.lit(x) for kv in symbols.items() for x in kv])
    parts = F.regexp_extract_all(col(text), F.lit(r":[a-z][\w+-]*:|[^:]+|:"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, F.regexp_replace(p, "^:|:$", "")), p)), "")


def abbreviations(texts: DataFrame, keys: DataFrame, text: str = "text") -> DataFrame:
    """Whole-word hits of a document's abbreviation keys: tokens joined to keys (doc_id, label, value) by equality."""
    keep = [c for c in texts.columns if c != text]
    tokens = texts.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z0-9]+"), F.lit(0))).alias("ord", "label"))
    return tokens.join(keys.select("doc_id", "label", F.col("value").alias("expansion")), ["doc_id", "label"])


def coalesce_text(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, node_id, type, text): neighbouring text nodes become one, islands over node order."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("node_id")
    begins = ~F.coalesce((F.col("type") == "text") & (F.lag("type").over(order) == "text"), F.lit(False))
    rows = nodes.withColumn("run", F.sum(begins.cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("node_id", "text")))
    return rows.groupBy("doc_id", "run").agg(F.min("node_id").alias("node_id"), F.first("type").alias("type"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")).drop("run")


def inline_html(text: Column | str, typography: bool = False) -> Column:
    """HTML of a flat inline text: code spans kept apart, then escapes, links, images, marks, breaks."""
    parts = F.regexp_extract_all(col(text), F.lit(rf"(?:\$\$?|!)?(?:{CODE})|[^`]+?(?=(?:\$\$?|!)?`|\z)|`"), F.lit(0))

    def piece(p: Column) -> Column:
        body = F.regexp_extract(p, r"`+(.+?)`+$", 1)
        math = lambda kind, a, b: F.concat(F.lit(f'<span class="math {kind}" role="math">{a}'), escape_html(body), F.lit(f"{b}</span>"))
        return (
            F.when(p.rlike(r"^\$\$`.*`$"), math("display", "\\[", "\\]"))
            .when(p.rlike(r"^\$`.*`$"), math("inline", "\\(", "\\)"))
            .when(p.rlike(r"^!`.*`$"), escape_html(body))
            .when(p.rlike(r"^`.*`$"), F.concat(F.lit("<code>"), escape_html(body), F.lit("</code>")))
            .otherwise(marks_html(p, typography))
        )

    return F.array_join(F.transform(parts, piece), "")


def marks_html(c: Column, typography: bool = False) -> Column:
    """Marks, links and breaks of a text without code spans; an escaped delimiter neither opens nor closes."""
    c = F.regexp_replace(c, r"\{%.*?%\}", "")
    if typography:
        c = smart_symbols(smart_dashes(smart_quotes(c)))
    c = escape_html(c)
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\(([^()\s]*)\)", '<img src="$2" alt="$1">')
    c = F.regexp_replace(c, r"(?<![!\\])\[([^\[\]]*)\]\(([^()\s]*)(?: \"([^\"]*)\")\)", '<a href="$2" title="$3">$1</a>')
    c = F.regexp_replace(c, r"(?<![!\\])\[([^\[\]]*)\]\(([^()\s]*)\)", '<a href="$2">$1</a>')
    c = F.regexp_replace(c, r"&lt;(https?://[^\s&]+)&gt;", '<a href="$1">$1</a>')
    for d, _, element in FORCED:
        c = F.regexp_replace(c, forced(d), f"<{element}>$1</{element}>")
    for d, _, element in MARKS:
        if d == "/":
            c = F.regexp_replace(c, r"(?<![\w\\/<:])/(?![\s/])((?:[^/\\\n<]|\\.|</?[a-z]+>)*?[^\s/\\<])/(?![\w/>])", "<em>$1</em>")
        elif d == "=":
            c = F.regexp_replace(c, r"(?<![\w\\=])=(?![\s=>\"])((?:[^=\\\n<]|\\.)*?[^\s=\\])=(?![\w=\"])", "<mark>$1</mark>")
        else:
            c = F.regexp_replace(c, bare(d), f"<{element}>$1</{element}>")
    c = F.regexp_replace(c, r"\\\n", "<br>\n")
    return F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")


def attribute(name: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f' {name}="'), escape_attribute(value), F.lit('"'))).otherwise("")
