"""HTML pages to markup by a tree: an Arrow-batched function whose rows are parsed, nested and written one by one.

``html.parser`` gives the events; a stack with the usual implied ends gives the tree; blocks are written
inside their containers (lists, quotes, table cells), inlines inside their marks, and text is escaped where
it would read as markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillgrid.functions.text import UNSAFE

#: HTML elements without an end, elements that yield nothing, and inline elements with their forced marks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title iframe object svg canvas".split())
MARKS = {"strong": "*", "b": "*", "em": "/", "i": "/", "u": "_", "s": "~", "strike": "~", "mark": "=", "ins": "+", "del": "-", "sup": "^", "sub": ","}
#: Elements that stand as blocks, those that end an open paragraph, and what each optional end tag is implied by.
BLOCKS = frozenset("p div section article main header footer nav aside body html figure figcaption details summary center form fieldset address h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr td th hr".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th", "thead", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
#: Attributes that an imported block keeps, and schemes that no destination may have.
KEPT = ("id", "class", "title", "lang")
DENIED = re.compile(UNSAFE, re.IGNORECASE)
HIDDEN = re.compile(r"[\x00-\x20\x7f-\x9f​-‏  ﻿]")
SPACE = re.compile(r"[ \t\n\r\f]+")
OPENER = re.compile(r"([\\`\[{])|(?<!\w)([*/_~=])(?=\S)|(<)(?=[\w/@])")
BLOCK_OPENER = re.compile(r"^(#{1,6} |> |>$|[-+] |\||:{1,} |:{3,}|%%|\^ |-{3,}|={3,}|`{3,}|~{3,})", re.MULTILINE)
NUMBER_OPENER = re.compile(r"^(\d{1,9}|[a-zA-Z])([.)] )", re.MULTILINE)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("body")
        self.stack = [self.root]

    def close_until(self, tags: tuple[str, ...], scopes: tuple[str, ...]) -> None:
        """Close the innermost open element among tags, unless one of scopes opened since."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                del self.stack[k:]
                return self.close_until(tags, scopes)
            if self.stack[k].tag in scopes:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.close_until(("p",), ("li", "td", "th", "blockquote", "dd", "figure", "div", "table"))
        if tag in IMPLIED:
            self.close_until(IMPLIED[tag], SCOPES[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in ("table", "ul", "ol") and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def safe(url: str) -> bool:
    return not DENIED.match(HIDDEN.sub("", url))


def destination(url: str) -> str:
    return url.strip().replace(" ", "%20").replace("(", "%28").replace(")", "%29")


def escaped(text: str) -> str:
    """Text in which nothing opens an inline construct."""
    return OPENER.sub(lambda m: "\\" + m[0], text)


def guarded(text: str) -> str:
    """A paragraph's text in which no line opens a block."""
    return NUMBER_OPENER.sub(r"\1\\\2", BLOCK_OPENER.sub(r"\\\1", text))


def code_span(text: str) -> str:
    longest = max(map(len, re.findall("`+", text)), default=0)
    ticks, pad = "`" * (longest + 1), " " if text.startswith("`") or text.endswith("`") else ""
    return f"{ticks}{pad}{text}{pad}{ticks}"


def raw_text(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else raw_text(c) for c in node.children)


def find(node: Node, tag: str) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node):
            if c.tag == tag:
                yield c
            yield from find(c, tag)


def tex(node: Node) -> str | None:
    """The TeX annotation of a math element."""
    return next((raw_text(a).strip() for a in find(node, "annotation") if a.attrs.get("encoding") == "application/x-tex"), None)


def inline(children: list) -> str:
    out = []
    for c in children:
        if isinstance(c, str):
            out.append(escaped(SPACE.sub(" ", c)))
            continue
        inner = lambda: inline(c.children)  # noqa: B023, E731
        if c.tag in SILENT:
            continue
        if c.tag == "br":
            out.append("\\\n")
        elif c.tag in MARKS:
            text = inner()
            core = re.sub(r"(?:\\\n|\s)+$", "", text).lstrip()
            lead, _, tail = text.partition(core) if core else (text, "", "")
            out.append(f"{lead}{{{MARKS[c.tag]}{core}{MARKS[c.tag]}}}{tail}" if core else text)
        elif c.tag in ("code", "kbd", "samp", "tt"):
            out.append(code_span(SPACE.sub(" ", raw_text(c)).strip()) if raw_text(c).strip() else "")
        elif c.tag == "a":
            url, text = c.attrs.get("href"), inner()
            title = f' "{c.attrs["title"]}"' if c.attrs.get("title") and '"' not in c.attrs["title"] else ""
            out.append(f"[{text.strip()}]({destination(url)}{title})" if url is not None and safe(url) and text.strip() else text)
        elif c.tag == "img":
            url = c.attrs.get("src", "")
            out.append(f"![{escaped(c.attrs.get('alt', ''))}]({destination(url)})" if url and safe(url) else escaped(c.attrs.get("alt", "")))
        elif c.tag == "math":
            formula = tex(c)
            out.append(("$" if c.attrs.get("display") == "block" else "") + f"$`{formula}`" if formula and "`" not in formula else inner())
        elif c.tag == "q":
            out.append(f'"{inner()}"')
        elif c.tag == "input":
            out.append({True: "[x] ", False: "[ ] "}["checked" in c.attrs] if c.attrs.get("type") == "checkbox" else "")
        else:
            out.append(inner())
    return "".join(out)


def tidy(text: str) -> str:
    """Inline text without white space at its ends or around its breaks."""
    return re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", text)).strip().removesuffix("\\").rstrip()


def indented(text: str, by: str) -> str:
    return "\n".join(by + line if line else line for line in text.split("\n"))


def attributes(node: Node) -> str:
    """The line of attributes before a block, or nothing."""
    parts = []
    for name in KEPT:
        value = " ".join(node.attrs.get(name, "").split())
        if not value or re.search(r'["{}\\]', value):
            continue
        if name == "id":
            parts.append(f"#{value}" if re.fullmatch(r"[\w:.-]+", value) else f'id="{value}"')
        elif name == "class":
            parts += [f".{x}" for x in value.split() if re.fullmatch(r"[\w-]+", x)]
        else:
            parts.append(f'{name}="{value}"')
    return "{" + " ".join(parts) + "}\n" if parts else ""


def holds_blocks(node: Node) -> bool:
    return any(isinstance(c, Node) and c.tag not in SILENT and (c.tag in BLOCKS or holds_blocks(c)) for c in node.children)


def list_block(node: Node) -> str:
    items, n = [], int(node.attrs["start"]) if node.attrs.get("start", "").isdigit() else 1
    loose = any(isinstance(c, Node) and c.tag == "li" and any(isinstance(g, Node) and g.tag == "p" for g in c.children) for c in node.children)
    for c in node.children:
        if isinstance(c, str):
            if not c.strip():
                continue
            c = Node("li", {}, [c])
        marker = f"{n}. " if node.tag == "ol" else "- "
        inner = blocks(c.children if c.tag == "li" else [c])
        n += 1
        if not inner:
            items.append(marker.rstrip())
            continue
        body = inner[0]
        for following in inner[1:]:
            body += ("\n\n" if loose or not re.match(r"(?:[-]|\d+\.) ", following) else "\n") + following
        items.append(marker + indented(body, " " * len(marker))[len(marker) :])
    return ("\n\n" if loose else "\n").join(items)


def cell_text(node: Node) -> str:
    text = tidy(inline([x for c in node.children for x in ([c, " "] if isinstance(c, Node) and c.tag in BLOCKS else [c])]))
    return text.replace("\\\n", " ").replace("\n", " ").replace("|", "\\|")


def table_block(node: Node) -> str:
    """Rows of a table; a cell that spans others is followed by ``<`` to its right and ``^`` below."""
    rows, open_, captions = [], {}, [tidy(inline(c.children)) for c in find(node, "caption")]
    for tr in (r for r in own_rows(node)):
        cells = [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
        line, col = [], 0

        def below(col: int, line: list) -> int:
            while open_.get(col, 0) > 0:  # noqa: B023
                open_[col] -= 1  # noqa: B023
                line.append("^")
                col += 1
            return col

        for c in cells:
            col = below(col, line)
            wide, high = (max(1, min(1000, int(c.attrs[k]))) if c.attrs.get(k, "").isdigit() else 1 for k in ("colspan", "rowspan"))
            text = cell_text(c)
            line.append(("=" if c.tag == "th" else "") + (f" {text}" if text else ""))
            line += ["<"] * (wide - 1)
            for k in range(wide):
                open_[col + k] = high - 1
            col += wide
        below(col, line)
        if line:
            rows.append("|" + "|".join(f" {x} " if x in ("<", "^") else f"{x or ' '} " for x in line) + "|")
    return "\n".join(rows) + "".join(f"\n^ {c}" for c in captions[:1] if c)


def own_rows(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node):
            if c.tag == "tr":
                yield c
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield from own_rows(c)


def pre_block(node: Node) -> str:
    code = next((c for c in node.children if isinstance(c, Node) and c.tag == "code"), node)
    lang = re.search(r"\blang(?:uage)?-([\w+#.-]+)", f"{code.attrs.get('class', '')} {node.attrs.get('class', '')}")
    text = raw_text(node).removeprefix("\n").rstrip("\n")
    fence = "`" * max(3, max(map(len, re.findall("`+", text)), default=0) + 1)
    return f"{fence}{lang[1] if lang else ''}\n{text}\n{fence}"


def block(node: Node) -> list[str]:
    tag = node.tag
    if tag in SILENT:
        return []
    if re.fullmatch("h[1-6]", tag):
        title = tidy(inline(node.children)).replace("\\\n", " ").replace("\n", " ")
        return [f"{attributes(node)}{'#' * int(tag[1])} {title}"] if title else []
    if tag in ("ul", "ol"):
        text = list_block(node)
        return [attributes(node) + text] if text else []
    if tag == "pre":
        return [pre_block(node)]
    if tag == "hr":
        return ["---"]
    if tag == "table":
        text = table_block(node)
        return [attributes(node) + text] if text else []
    if tag == "blockquote":
        inner = "\n\n".join(blocks(node.children))
        return [attributes(node) + "\n".join(f"> {line}" if line else ">" for line in inner.split("\n"))] if inner else []
    if tag == "dl":
        lines = []
        for c in node.children:
            for e in [c] if isinstance(c, Node) and c.tag in ("dt", "dd") else c.children if isinstance(c, Node) else []:
                if isinstance(e, Node) and e.tag == "dt":
                    lines.append(f":: {tidy(inline(e.children))}")
                elif isinstance(e, Node) and e.tag == "dd":
                    lines.append(": " + indented("\n\n".join(blocks(e.children)), "  ")[2:])
        return ["\n".join(lines)] if lines else []
    if tag == "figure":
        caption = [tidy(inline(c.children)) for c in node.children if isinstance(c, Node) and c.tag == "figcaption"]
        inner = blocks([c for c in node.children if not (isinstance(c, Node) and c.tag == "figcaption")])
        return [*inner[:-1], inner[-1] + f"\n^ {caption[0]}"] if inner and caption and caption[0] else inner
    if holds_blocks(node):
        return blocks(node.children)
    text = guarded(tidy(inline(node.children)))
    return [(attributes(node) if tag == "p" else "") + text] if text else []


def blocks(children: list) -> list[str]:
    """Blocks of mixed children: runs of inlines are paragraphs."""
    out, run = [], []

    def settle() -> None:
        text = guarded(tidy(inline(run)))
        if text:
            out.append(text)
        run.clear()

    for c in children:
        if isinstance(c, Node) and (c.tag in BLOCKS or holds_blocks(c)):
            settle()
            out.extend(block(c) if c.tag in BLOCKS else blocks(c.children))
        else:
            run.append(c)
    settle()
    return out


def to_markup(page: str) -> str:
    builder = TreeBuilder()
    builder.feed(page)
    builder.close()
    try:
        return "\n\n".join(blocks(builder.root.children)) + "\n"
    except RecursionError:  # nested deeper than any document: its text alone
        texts = HTMLText()
        texts.feed(page)
        return guarded(tidy(escaped(SPACE.sub(" ", "".join(texts.found))))) + "\n"


class HTMLText(HTMLParser):
    """The text of a page outside silent elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        self.silent = max(0, self.silent - (tag in SILENT))

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.found.append(data)


@pandas_udf(StringType())
def html_markup(pages: pd.Series) -> pd.Series:
    return pages.map(to_markup, na_action="ignore")
