"""Importers: BBCode, Markdown and Djot columns to markup by chains of expressions, HTML by a tree; their losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import UNSAFE, UNSAFE_SCHEMES, col
from quillgrid.operators.policy import url_scheme
from quillgrid.sources.html_tree import html_markup

#: BBCode passes, in order: pattern and replacement.
BBCODE = (
    (r"(?s)\[code=(\w+)\]\n?(.*?)\n?\[/code\]", "\n\n```$1\n$2\n```\n\n"),
    (r"(?s)\[code\]\n?(.*?)\n?\[/code\]", "\n\n```\n$1\n```\n\n"),
    (r"\[(?:c|icode)\](.*?)\[/(?:c|icode)\]", "`$1`"),
    (r"\[url=([^\]]+)\](.*?)\[/url\]", "[$2]($1)"),
    (r"\[url\](.*?)\[/url\]", "<$1>"),
    (r"\[email\](.*?)\[/email\]", "<mailto:$1>"),
    (r"\[img[^\]]*\](.*?)\[/img\]", "![]($1)"),
    (r"\[youtube\](.*?)\[/youtube\]", "[video](https://www.youtube.com/watch?v=$1)"),
    (r"(?s)\[b\](.*?)\[/b\]", "*$1*"),
    (r"(?s)\[i\](.*?)\[/i\]", "/$1/"),
    (r"(?s)\[u\](.*?)\[/u\]", "_$1_"),
    (r"(?s)\[s\](.*?)\[/s\]", "~$1~"),
    (r"\[sup\](.*?)\[/sup\]", "{^$1^}"),
    (r"\[sub\](.*?)\[/sub\]", "{,$1,}"),
    (r"(?s)\[spoiler\]\n?(.*?)\n?\[/spoiler\]", "\n\n::: spoiler\n$1\n:::\n\n"),
    (r"\[hr\]", "\n\n---\n\n"),
    (r"\n?\[th\](.*?)\[/th\]", "|= $1 "),
    (r"\n?\[td\](.*?)\[/td\]", "| $1 "),
    (r"(?s)\[tr\](.*?)\[/tr\]\n?", "$1|\n"),
    (r"\[/?table\]\n?", "\n\n"),
    (r"\n*\[\*\]\s*", "\n- "),
    (r"\[/?list(?:=\w+)?\]\n?", "\n"),
    (r"(?s)\[/?(?:center|left|right)\]", ""),
    (r"(?s)\[/?(?:size|color|font)(?:=[^\]]*)?\]", ""),
)


def bbcode(c: Column | str) -> Column:
    """BBCode text as markup; a list with a number type is numbered, quotes get markers line by line."""
    c = F.replace(col(c), F.lit("\r\n"), F.lit("\n"))
    numbered = c.rlike(r"\[list=1\]")
    for pattern, to in BBCODE:
        c = F.regexp_replace(c, pattern, to)
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\[quote(?:=[^\]]*)?\].*?\[/quote\]|(?:(?!\[quote)[^\[]+)|\["), F.lit(0))

    def quoted(p: Column) -> Column:
        who, body = F.regexp_extract(p, r"^\[quote=\"?([^\]\"]*)", 1), F.trim(F.regexp_extract(p, r"(?s)^\[quote[^\]]*\]\n?(.*?)\n?\[/quote\]$", 1))
        lines = F.concat(F.lit("> "), F.replace(body, F.lit("\n"), F.lit("\n> ")))
        return F.when(p.startswith("[quote"), F.concat(F.lit("\n\n"), lines, F.when(who != "", F.concat(F.lit("\n^ "), who)).otherwise(""), F.lit("\n\n"))).otherwise(p)

    c = F.array_join(F.transform(parts, quoted), "")
    items = F.split(c, "\n")
    upto = lambda i: F.size(F.filter(F.slice(items, 1, i + 1), lambda x: x.startswith("- ")))
    ordered = F.array_join(F.transform(items, lambda x, i: F.when(x.startswith("- "), F.concat(upto(i).cast("string"), F.lit(". "), F.regexp_replace(x, "^- ", ""))).otherwise(x)), "\n")
    c = F.when(numbered, ordered).otherwise(c)
    c = F.regexp_replace(c, r"\[/?[a-z]+(?:=[^\]]*)?\](?!\()", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.concat(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit("\n"))


def bbcode_losses(docs: DataFrame) -> DataFrame:
    """doc_id, code, n: styling that is dropped and tags that are not known."""
    styled = F.regexp_count("source", F.lit(r"\[(?:size|color|font)="))
    return docs.select("doc_id", F.lit("styling-dropped").alias("code"), styled.alias("n")).where("n > 0")


#: Alert names of Markdown and the containers they become.
ALERTS = {"NOTE": "note", "TIP": "tip", "IMPORTANT": "info", "WARNING": "warning", "CAUTION": "danger"}


def markdown_inline(c: Column | str) -> Column:
    """CommonMark inlines outside code spans: strong, emphasis, strike, breaks, links with denied schemes reduced to text."""
    from quillgrid.operators.inlines import CODE

    parts = F.regexp_extract_all(col(c), F.lit(rf"(?:{CODE})|[^`]+|`"), F.lit(0))

    def piece(p: Column) -> Column:
        t = F.regexp_replace(p, rf"(?i)(?<!!)\[([^\]]*)\]\(\s*{UNSAFE}[^)]*\)", "$1")
        t = F.regexp_replace(t, r"(?<![*\\])\*\*\*(?=\S)(.+?)(?<=\S)\*\*\*(?!\*)", "\ue001\ue000$1\ue000\ue001")
        t = F.regexp_replace(t, r"(?<![*\\])\*\*(?=\S)(.+?)(?<=\S)\*\*(?!\*)", "\ue000$1\ue000")
        t = F.regexp_replace(t, r"(?<![\w\\])__(?=\S)(.+?)(?<=\S)__(?!\w)", "\ue000$1\ue000")
        t = F.regexp_replace(t, r"(?<![*\\])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?!\*)", "\ue001$1\ue001")
        t = F.regexp_replace(t, r"(?<![\w\\_])_(?=[^\s_])(.+?)(?<=[^\s_])_(?![\w_])", "\ue001$1\ue001")
        t = F.regexp_replace(t, r"~~(?=\S)(.+?)(?<=\S)~~", "~$1~")
        t = F.regexp_replace(t, r"  +\n", "\\\\\n")
        t = F.regexp_replace(t, r"(?<![<(\w])(https?://[^\s<>)]+)", "<$1>")
        return F.translate(t, "\ue000\ue001", "*/")

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^`.*`$"), p).otherwise(piece(p))), "")


def markdown(c: Column | str) -> Column:
    """Markdown text as markup: setext and ATX headings, indented code, alerts, GFM tables, rules, inlines. Fenced code stays."""
    c = F.replace(col(c), F.lit("\r\n"), F.lit("\n"))
    parts = F.regexp_extract_all(c, F.lit(r"(?ms)^(?:```|~~~).*?^(?:```|~~~)[ \t]*$|.+?(?=^(?:```|~~~)|\z)"), F.lit(0))

    def blocks(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?m)^([^\n#>|`\s-][^\n]*)\n=+[ \t]*$", "# $1")
        t = F.regexp_replace(t, r"(?m)^([^\n#>|`\s-][^\n]*)\n-{2,}[ \t]*$", "## $1")
        t = F.regexp_replace(t, r"(?m)^(#{1,6} .*?)[ \t]+#+[ \t]*$", "$1")
        t = F.regexp_replace(t, r"(?m)^(?:\*[ \t]*){3,}$|^(?:_[ \t]*){3,}$|^(?:-[ \t]*){3,}$", "---")
        t = F.regexp_replace(t, r"(?m)^([ \t]*)[*+] (?=\S)", "$1- ")
        for name, kind in ALERTS.items():
            t = F.regexp_replace(t, rf"(?m)^> \[!{name}\][ \t]*\n> ([^\n]*)$", f"::: {kind}\n$1\n:::")
        return markdown_inline(t)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^(?:```|~~~)"), p).otherwise(blocks(p))), "")


def djot(c: Column | str) -> Column:
    """Djot text as markup where the dialects differ: emphasis, highlight, insert, delete, sub- and superscript."""
    c = F.regexp_replace(col(c), r"(?<![\w_])_(?=[^\s_])(.+?)(?<=[^\s_])_(?![\w_])", "/$1/")
    c = F.regexp_replace(c, r"\{_(.+?)_\}", "{/$1/}")
    c = F.regexp_replace(c, r"(?<![{])\^([^\s^]+)\^(?![}])", "{^$1^}")
    c = F.regexp_replace(c, r"(?<![{~])~([^\s~]+)~(?![}~])", "{,$1,}")
    return F.regexp_replace(c, r"(?m)^\+ ", "- ")


def djot_losses(docs: DataFrame) -> DataFrame:
    hits = F.array(
        F.when(F.col("source").rlike(r"(?m)^(?:[ivx]+|[a-z])\) "), "list-style-normalized"),
        F.when(F.col("source").rlike(r"\{[^}]*%[^}]*%[^}]*\}"), "attribute-comment-dropped"),
        F.when(F.col("source").rlike(r"(?m)^\+ "), "bullet-normalized"),
    )
    return docs.select("doc_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("code"))


def html(c: Column | str) -> Column:
    """HTML text as markup, parsed as a tree (see ``html_tree``); unsafe destinations reduced to text; unknown tags dropped."""
    return html_markup(col(c))


def html_elements(pages: DataFrame, text: str = "html") -> DataFrame:
    """page_id, tag, n: how often each element opens outside comments, scripts and styles."""
    c = F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    tags = F.explode(F.regexp_extract_all(c, F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)))
    return pages.select("page_id", tags.alias("tag")).withColumn("tag", F.lower("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def html_diagnostics(pages: DataFrame, text: str = "html") -> DataFrame:
    """page_id, code, n: comments, silent elements and denied destinations that the import drops."""
    c = F.col(text)
    parts = [
        ("comment-dropped", F.regexp_count(c, F.lit(r"(?s)<!--.*?-->"))),
        ("element-dropped", F.regexp_count(c, F.lit(r"(?i)<(?:script|style|template|noscript)\b"))),
        ("destination-denied", F.regexp_count(c, F.lit(rf"(?i)href=\"\s*{UNSAFE}"))),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("code"), n.alias("n")) for k, n in parts]))
    return pages.select("page_id", rows.alias("d")).select("page_id", "d.code", "d.n").where("n > 0")


def safe_destination(url: Column | str) -> Column:
    return ~F.coalesce(url_scheme(url).isin(*UNSAFE_SCHEMES), F.lit(False))


def escape_markup(c: Column | str) -> Column:
    """Plain text in which nothing reads as markup: a backslash before marks that could open, and before block openers."""
    c = F.regexp_replace(col(c), r"([\\`*/_~=\[\]{}<])", r"\\$1")
    return F.regexp_replace(c, r"(?m)^(#{1,6} |> |[-+] |\||:{2,}|%%|\^ )", r"\\$1")


def fidelity(diagnostics: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """diagnostics (doc_id, code, n) -> per document how many were normalized, degraded and dropped."""
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    total = lambda k: F.sum(F.when(F.element_at(kind, F.col("code")) == k, F.col("n")).otherwise(0)).alias(k)
    return diagnostics.groupBy("doc_id").agg(total("normalized"), total("degraded"), total("dropped"))
