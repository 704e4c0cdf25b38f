"""Block ownership by a stack of open frames: a document's lines are read once and each goes to the block that owns it.

A frame is an open quote, item, description, note or container with the column at which its content stands. A
line is freed of the markers of the frames that it meets; what it does not meet is closed, unless the line goes
on with an open paragraph. What is left opens frames and one leaf. ``lines * depth`` steps at most, and one row
per block in document order with its parent.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import normalize_source
from quillgrid.operators.spans import ATTRIBUTES
from quillgrid.sources.shared import spread

MAX_DEPTH = 200
#: Forms of list markers (letters before a dot take two blanks) and of task states.
MARKER = re.compile(r"([-*]|\d{1,9}[.)]|[ivxlcdmIVXLCDM]+\)|[ivxlcdmIVXLCDM]+\.(?=  )|[A-Za-z]\)|[A-Za-z]\.(?=  )|\.)(\{[^{}]*\})?( +)(?=\S)")
TASK = re.compile(r"\[([ xX_/!>?-])\] ")
CODE = re.compile(r"(`{3,}|~{3,})[ \t]*(.*)$")
BOX = re.compile(r"(:{3,})[ \t]*((?:[^\s:].*)?)$")
RULE = re.compile(r"(?:([-*_])\1{2,}|- - -(?: -)*|\* \* \*(?: \*)*)[ \t]*$")
HEADING = re.compile(r"#{1,6} +\S")
TABLE = re.compile(r"\|.*\|(?:\{[^}]*\})?[ \t]*$")
ROW_GOES_ON = re.compile(r"\+ .*\|[ \t]*$")
#: Single lines that define something.
DEFINITIONS = (
    ("citation", re.compile(r"\[@[^\]\s]+\]: ")),
    ("link_definition", re.compile(r"\[[^\]^@\[][^\]\[]*\]:[ \t]*\S*")),
    ("abbreviation", re.compile(r"\*\[[A-Za-z0-9]+\]: ")),
)
NOTE = re.compile(r"\[\^([^\]]+)\]: +(?=\S)")
TERM = re.compile(r"::(?!:) +\S")
DESCRIPTION = re.compile(r": +(?=\S)")
CAPTION = re.compile(r"\^ +\S")
BARE_BOX = re.compile(r":{3,}[ \t]*$")
BOX_INFO = re.compile(r"(?:[>|\\]|[A-Za-z][\w-]*)?[ \t]*(?:\"[^\"]*\")?[ \t]*(?:\[.*\])?[ \t]*(?:\{.*\})?[ \t]*$")
HOLDERS = ("quote", "list_item", "container", "description", "footnote")
#: Types that the targets do not show where they stand.
HIDDEN = ("comment", "comment_block", "attributes", "footnote", "link_definition", "abbreviation", "citation", "caption")
VERBATIM = ("code", "raw", "comment_block", "verse")
TRANSPARENT = ("comment", "comment_block", "link_definition", "abbreviation", "citation", "footnote")
#: Blocks after which the next item can still join the list before them, and first signs of lines that may be more than text.
PASSED = (*TRANSPARENT, "list_item")
SIGNS = frozenset("%`~:#-*_|[^{\t")
CAPTIONED = ("table_row", "code", "quote", "container")
IMAGE = re.compile(r"!\[[^\n]*\](?:\([^\n]*\)|\[[^\n]*\])(?:\{[^\n]*\})?$")

LINK = "struct<kind: string, marker: string, name: string, fresh: boolean, shown: boolean>"
FENCE = "struct<first: int, last: int, marker: string, info: string, closed: boolean>"
KINDS = {
    "path": "array<int>", "type": "string", "text": "string", "fence": FENCE, "name": "string", "title": "string", "label": "string", "marker": "string", "style": "string", "task": "string",
    "first_item": "boolean", "last_item": "boolean", "tight": "boolean", "in_tight": "boolean", "item_attributes": "string", "caption": "string", "attributes": "string", "chain": f"array<{LINK}>", "after": "string",
    "nth": "int", "nth_shown": "int", "ends_flush": "boolean", "holds": "boolean", "start_line": "int", "end_line": "int",
}


@dataclass(slots=True)
class Block:
    type: str
    parent: int
    start: int
    lines: list[str] = field(default_factory=list)
    end: int = 0
    column: int = 0
    facts: dict = field(default_factory=dict)
    children: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Frame:
    kind: str
    row: int
    column: int = 0
    colons: int = 0
    #: The last list of the frame while a next item could join it.
    style: str | None = None
    items: list[int] = field(default_factory=list)


def indent(text: str) -> int:
    return len(text) - len(text.lstrip(" "))


def spaced(line: str) -> str:
    """The line with the tabs of its indentation as blanks, to the next of every four columns."""
    if "\t" not in line:
        return line
    n, i = 0, 0
    while i < len(line) and line[i] in " \t":
        n = n + 1 if line[i] == " " else n + 4 - n % 4
        i += 1
    return " " * n + line[i:]


def item_style(marker: str, before: str | None) -> str:
    """Kind and delimiter of a marker; a letter that could be Roman goes on with letters before it."""
    if marker in "-*":
        return marker
    letters, end = marker[:-1], marker[-1]
    if not letters or letters.isdigit():
        return "1" + end
    roman, alpha = ("i", "a") if letters.islower() else ("I", "A")
    if len(letters) > 1:
        return roman + end
    if before == alpha + end or letters.lower() not in "ivxlcdm":
        return alpha + end
    return roman + end if before == roman + end or letters in "iI" else alpha + end


class Blocks:
    """The blocks of one source."""

    def __init__(self, source: str):
        self.rows = [Block("document", -1, 0)]
        self.stack = [Frame("document", 0)]
        self.leaf: int | None = None
        self.leaf_depth = 0
        self.blank = self.empty = False
        self.lines = [spaced(x) for x in source.split("\n")]
        self.skip = -1
        for n, line in enumerate(self.lines):
            if n > self.skip:
                self.line(line, n)
        self.close_leaf()

    # Rows and frames

    def add(self, kind: str, n: int, text: str | None = None, depth: int = 0, **facts) -> int:
        frame = self.stack[depth - 1]
        rows, at = self.rows, len(self.rows)
        rows.append(Block(kind, frame.row, n, [] if text is None else [text], n, 0, facts, []))
        siblings = rows[frame.row].children
        siblings.append(at)
        if kind not in PASSED:
            frame.style = None
        if self.blank and frame.kind == "item" and kind in ("paragraph", "container", "verse") and len(siblings) > 1:
            rows[frame.row].facts["loose"] = True
        return at

    def push(self, kind: str, row: int, column: int = 0, colons: int = 0) -> None:
        self.rows[row].column = column
        self.stack.append(Frame(kind, row, column, colons))

    def close_leaf(self) -> None:
        self.leaf = None

    def pop(self, depth: int) -> None:
        if len(self.stack) > depth:
            del self.stack[depth:]
            self.close_leaf()

    # Lines

    def line(self, line: str, n: int) -> None:
        rest, depth, stack = line, 1, self.stack
        height = len(stack)
        while depth < height:
            found = meets(stack[depth], rest)
            if found is None:
                # A host passes on the lines of the block attached to it.
                if depth + 1 == height or stack[depth + 1].kind != "attached" or not rest.strip():
                    break
                found = rest
            rest, depth = found, depth + 1
        whole = depth == height
        kind = self.rows[self.leaf].type if self.leaf is not None else None
        if kind in VERBATIM:
            if depth >= self.leaf_depth:
                return self.verbatim(rest, n)
            if kind == "verse" and not self.rows[self.leaf].facts.get("hides") and rest.strip() and self.goes_on(rest, depth, n):
                return self.rows[self.leaf].lines.append(rest.lstrip(" "))
            self.close_leaf()
            kind = None
        inked = rest.strip()
        if not inked:
            while depth < len(self.stack) and self.stack[depth].kind not in ("quote", "attached"):
                depth += 1
            self.pop(depth)
            self.close_leaf()
            self.blank, self.empty = True, not line.strip()
            return None
        blank, count = self.blank, len(self.rows)
        self.owned(rest, inked, depth, whole, kind, n)
        # What shows nothing parts no blank line from what follows.
        self.blank = blank and len(self.rows) > count and all(r.type in (*TRANSPARENT, "attributes") for r in self.rows[count:])
        self.empty = False
        return None

    def owned(self, rest: str, inked: str, depth: int, whole: bool, kind: str | None, n: int) -> None:
        """Deal with a line (inked without blanks around it) whose first ``depth`` frames own it; kind is the open leaf's."""
        if inked[0] == ":" and (box := self.closed_box(inked, depth)) is not None:
            return self.pop(box)
        if not whole and inked[0] == "%" and comment(rest):
            return self.hidden(rest, depth, n)
        if inked == "+" and (host := self.attaches(rest, depth, n)) is not None:
            self.close_leaf()
            if n + 1 < len(self.lines) and not self.lines[n + 1].startswith(" "):
                self.pop(depth)
                row = self.rows[host]
                self.push({"list_item": "item", "footnote": "note"}.get(row.type, row.type), host, row.column)
                self.push("attached", host)
            return None
        if not whole and kind == "paragraph" and self.goes_on(rest, depth, n):
            return self.extend(rest, n)
        if not whole:
            self.pop(depth)
            kind = None
        bare = rest.lstrip(" ")
        if kind in ("paragraph", "term") and not self.interrupts(rest, n):
            if comment(rest):
                self.add("comment", n, bare)
            else:
                self.extend(rest, n)
        elif kind == "table_row" and (TABLE.match(bare) or ROW_GOES_ON.match(bare)):
            self.extend(rest, n)
        else:
            self.close_leaf()
            self.open(rest, n)
        return None

    def hidden(self, rest: str, depth: int, n: int) -> None:
        """A comment left of the frames closes none of them."""
        bare = rest.lstrip(" ")
        if bare.startswith("%%%"):
            self.close_leaf()
            self.comment_fence(bare, indent(rest), n, depth)
        else:
            self.add("comment", n, bare, depth)

    def comment_fence(self, bare: str, k: int, n: int, depth: int) -> None:
        self.leaf = self.add("comment_block", n, depth=depth, mark="%" * (len(bare) - len(bare.lstrip("%"))), info="")
        self.rows[self.leaf].column, self.leaf_depth = k, depth

    def extend(self, rest: str, n: int) -> None:
        row = self.rows[self.leaf]
        row.lines.append(rest.lstrip(" "))
        row.end = n

    def verbatim(self, rest: str, n: int) -> None:
        row = self.rows[self.leaf]
        mark, row.end = row.facts["mark"], n
        bare = rest.strip()
        hides = row.facts.get("hides")
        if row.type == "verse" and (hides or bare.startswith("%%%")):  # a comment in verse
            row.facts["hides"] = (None if bare.startswith(hides) and not bare.strip("%") else hides) if hides else "%" * (len(bare) - len(bare.lstrip("%")))
        elif bare and bare[0] == mark[0] and len(bare) >= len(mark) and not bare.strip(mark[0]) and (mark[0] != ":" or len(bare) == len(mark)):
            row.facts["closed"] = True
            self.close_leaf()
        else:
            row.lines.append(rest[min(indent(rest), row.column) :])
        self.blank = self.empty = False

    def closed_box(self, bare: str, depth: int) -> int | None:
        """The depth of the container that the line closes."""
        if len(bare) < 3 or bare.strip(":"):
            return None
        for at in range(depth - 1, 0, -1):
            frame = self.stack[at]
            if frame.kind == "box" and frame.colons == len(bare):
                return at
        return None

    def attaches(self, rest: str, depth: int, n: int) -> int | None:
        """The item or quote right above that a continuation marker gives the next line's block to."""
        if rest.rstrip() != "+" or self.empty or n + 1 < len(self.lines) and not self.lines[n + 1].strip() and any(x.strip() for x in self.lines[n + 1 :]):
            return None
        frame = self.stack[depth - 1]
        if frame.kind == "quote" and depth == len(self.stack) == 2 and not self.rows[frame.row].children:
            return frame.row
        children = [c for c in self.rows[frame.row].children if self.rows[c].type not in ("comment", "comment_block")]
        return children[-1] if children and self.rows[children[-1]].type in ("list_item", "quote", "description", "footnote") else None

    def goes_on(self, rest: str, depth: int, n: int) -> bool:
        """Whether a line that misses frames goes on with the paragraph in them."""
        bare = rest.lstrip(" ")
        missed = [f.kind for f in self.stack[depth:]]
        if MARKER.match(bare) and "item" in missed:
            return False
        if missed[0] in ("description", "item", "note") and DESCRIPTION.match(bare) and "description" in missed:
            return False
        return not self.opens(bare, n)

    def interrupts(self, rest: str, n: int) -> bool:
        bare = rest.lstrip(" ")
        if self.stack[-1].kind in ("item", "note", "description") and (MARKER.match(bare) and not RULE.match(bare)):
            return True
        kind = self.rows[self.leaf].type
        if kind == "term" and DESCRIPTION.match(bare):
            return True
        return self.opens(bare, n)

    def opens(self, bare: str, n: int) -> bool:
        """Whether a line begins a block that ends a paragraph; list markers do not."""
        c = bare[0]
        if c == "#":
            return bool(HEADING.match(bare))
        if c == ">":
            return bare[:2] in (">", "> ")
        if c in "`~":
            return self.fence(bare) is not None
        if c in "-*_":
            return bool(RULE.match(bare) or DEFINITIONS[2][1].match(bare))
        if c == "|":
            return bool(TABLE.match(bare))
        if c == ":":
            return bool(TERM.match(bare) or BARE_BOX.match(bare) or (m := BOX.match(bare)) and self.box_name(m[2]))
        if c == "[":
            return bool(NOTE.match(bare)) or any(p.match(bare) for _, p in DEFINITIONS)
        if c == "^":
            return bool(CAPTION.match(bare)) and self.takes_caption(self.leaf)
        if c == "%":
            return bare.startswith("%%%")
        if c == "{":
            return self.attribute_run(n, bare) is not None
        return False

    def fence(self, bare: str) -> tuple[str, str] | None:
        m = CODE.match(bare)
        return (m[1], m[2].strip()) if m and not ("`" in m[2] and m[1][0] == "`") else None

    def box_name(self, info: str) -> bool:
        return bool(BOX_INFO.match(info))

    def attribute_run(self, n: int, bare: str) -> tuple[str, int] | None:
        """A block of attributes that is all of its lines, and its last line."""
        text, last = bare, n
        while last - n < 20:
            if (m := ATTRIBUTES.match(text)) and not text[m.end() :].strip(" \t{}"):
                rest = text
                while m := ATTRIBUTES.match(rest):
                    rest = rest[m.end() :]
                return (text.strip(), last) if not rest.strip() and text.strip(" {}") else None
            if "}" in text or last + 1 >= len(self.lines) or not self.lines[last + 1].strip():
                return None
            last += 1
            text += "\n" + self.lines[last].strip(" >")
        return None

    def takes_caption(self, at: int | None) -> bool:
        if at is None:
            return False
        row = self.rows[at]
        return row.type in CAPTIONED or row.type == "paragraph" and bool(IMAGE.match("\n".join(row.lines).strip()))

    # Openers

    def open(self, rest: str, n: int) -> None:
        """Open the frames and the leaf that the rest of a line begins."""
        base = 0
        while True:
            bare = rest.lstrip(" ")
            if not bare:
                return
            k, c, deep = len(rest) - len(bare), bare[0], len(self.stack) > MAX_DEPTH
            if not deep and c == ">" and bare[:2] in (">", "> "):
                self.push("quote", self.add("quote", n))
                rest = bare[2:]
                if rest.rstrip() == "+":
                    if len(self.stack) == 2:
                        self.push("attached", self.stack[-1].row)
                    return
                continue
            if not deep and (m := MARKER.match(bare)) and not (c in "-*" and RULE.match(bare)):
                rest = self.item(m, bare, k, n)
                base = 0
                if rest.strip() == "+":
                    return
                continue
            if not deep and c == ":" and (m := DESCRIPTION.match(bare)) and self.in_definitions():
                self.push("description", self.add("description", n), k + m.end())
                rest = bare[m.end() :]
                if rest.strip() == "+":
                    self.push("attached", self.stack[-1].row)
                    return
                continue
            if not deep and c == "[" and (m := NOTE.match(bare)):
                self.push("note", self.add("footnote", n, label=m[1]), k + 2)
                rest = bare[m.end() :]
                continue
            break
        self.leaf_of(bare, k, n, base)

    def in_definitions(self) -> bool:
        children = [c for c in self.rows[self.stack[-1].row].children if self.rows[c].type not in HIDDEN]
        return bool(children) and self.rows[children[-1]].type in ("term", "description")

    def item(self, m: re.Match, bare: str, k: int, n: int) -> str:
        frame = self.stack[-1]
        style, task = item_style(m[1], frame.style), TASK.match(bare, m.end())
        # Tasks and other items are lists of their own.
        same = frame.style == style and bool(frame.items) and (self.rows[frame.items[-1]].facts["task"] is None) == (task is None)
        if same and self.blank:
            self.rows[frame.items[-1]].facts["parted"] = True
        own = m[2] if m[2] and ATTRIBUTES.fullmatch(m[2]) else None
        row = self.add("list_item", n, None, marker=m[1], style=style, task=task[1] if task else None, first=not same, item=own)
        if not same:
            frame.style, frame.items = style, []
        frame.items.append(row)
        self.rows[row].facts["list"] = frame.items[0]
        self.push("item", row, k + m.end())
        return bare[task.end() if task else m.end() :]

    def leaf_of(self, bare: str, k: int, n: int, base: int) -> None:
        add, c = self.add, bare[0]
        self.leaf_depth = len(self.stack)
        if c not in SIGNS:
            self.leaf = add("paragraph", n, bare)
        elif bare.startswith("%%%"):
            self.comment_fence(bare, k, n, len(self.stack))
        elif comment(bare):
            add("comment", n, bare)
        elif c in "`~" and (fence := self.fence(bare)):
            self.leaf = add("raw" if fence[1].startswith("=") else "code", n, mark=fence[0], info=fence[1])
            self.rows[self.leaf].column = k
        elif c == ":" and (m := BOX.match(bare)) and self.box_name(m[2]):
            self.container(m, bare, k, n)
        elif c == ":" and TERM.match(bare):
            self.leaf = add("term", n, re.sub(r"^:: +", "", bare))
        elif c == "#" and HEADING.match(bare):
            add("heading", n, bare.rstrip(" \t"))
        elif c in "-*_" and RULE.match(bare):
            add("rule", n, bare)
        elif c == "|" and TABLE.match(bare):
            self.leaf = add("table_row", n, bare)
        elif c in "[*" and (kind := next((kind for kind, p in DEFINITIONS if p.match(bare)), None)):
            add(kind, n, bare)
        elif c == "^" and CAPTION.match(bare) and self.takes_caption(self.shown_before()):
            row = add("caption", n, bare)
            self.rows[self.shown_before(row)].facts["caption"] = re.sub(r"^\^ +", "", bare)
        elif c == "{" and (run := self.attribute_run(n, bare)):
            add("attributes", n, run[0])
            self.skip = run[1]
        else:
            self.leaf = add("paragraph", n, bare)

    def shown_before(self, row: int | None = None) -> int | None:
        children = [c for c in self.rows[self.stack[-1].row].children if c != row and self.rows[c].type not in ("comment", "comment_block")]
        return children[-1] if children else None

    def container(self, m: re.Match, bare: str, k: int, n: int) -> None:
        name = re.match(r"[>|\\]|[A-Za-z][\w-]*|", m[2])[0]
        title, label = re.search(r'"([^"]*)"', m[2]), re.search(r"\[(.*)\]", m[2])
        own = re.search(r"\{.*\}[ \t]*$", m[2])
        facts = {"name": name, "title": title[1] if title else "", "label": label[1] if label else None, "own": own[0] if own else None}
        if name == "|":
            self.leaf = self.add("verse", n, None, mark=m[1], info="", **facts)
            self.rows[self.leaf].column = k
            return
        row = self.add("container", n, bare, **facts)
        if len(self.stack) <= MAX_DEPTH:
            self.push("box", row, 0, len(m[1]))

    # Results

    def depths(self) -> list[int]:
        """How many blocks each block is in, itself included; in the order of their lines."""
        out = [0]
        for row in self.rows[1:]:
            out.append(out[row.parent] + 1)
        return out[1:]

    def result(self) -> list[dict]:
        """A row per block in document order, with the columns of KINDS."""
        return [dict(zip(KINDS, row[:-1], strict=True)) | {"path": list(row[0])} for row in self.tuples()]

    def tuples(self) -> list[tuple]:
        """The rows of result as values in the order of KINDS, and depth."""
        rows, out = self.rows, []
        for row in rows:
            if row.type == "list_item":
                head = rows[row.facts["list"]].facts
                head["loose_list"] = head.get("loose_list") or row.facts.get("loose") or row.facts.get("parted") or False
        todo = [(c, (), [], False) for c in reversed(rows[0].children)]
        order: dict[int, tuple] = {}
        #: The last shown child of each row that has one.
        last: dict[int, Block] = {}
        for parent, row in enumerate(rows):
            shown, after = 0, None
            for nth, c in enumerate(row.children, 1):
                order[c] = (nth, shown + 1, after)
                if rows[c].type not in HIDDEN:
                    last[parent] = child = rows[c]
                    shown, after = shown + 1, "container" if child.type == "verse" else child.type
            if row.type == "description":
                row.facts["tight"] = shown == 1 and after == "paragraph"
        while todo:
            at, path, chain, tight = todo.pop()
            row = rows[at]
            facts, type_ = row.facts, row.type
            get = facts.get
            siblings = rows[row.parent].children
            nth, nth_shown, after = order[at]
            previous = rows[siblings[nth - 2]] if nth > 1 else None
            listed, defined, verbatim = type_ == "list_item", type_ in ("term", "description"), type_ in ("code", "raw", "comment_block")
            kind = "container" if type_ == "verse" else type_
            first_item, last_item, item_tight = defined and after not in ("term", "description"), False, False
            if listed or defined:
                following = next((rows[c] for c in siblings[nth:] if rows[c].type not in TRANSPARENT), None)
                last_item = not (following is not None and (following.type == "list_item" and not following.facts["first"] if listed else following.type in ("term", "description")))
                first_item = facts["first"] if listed else first_item
                item_tight = not rows[facts["list"]].facts["loose_list"] if listed else get("tight", False)
            flush = at not in last or item_tight and last[at].type == "paragraph"
            text = "\n".join(row.lines)
            own = get("own")
            before = previous.lines[0] if previous is not None and previous.type == "attributes" else None
            path = (*path, nth)
            fence = {"first": row.start, "last": row.end, "marker": facts["mark"], "info": facts["info"], "closed": get("closed", False)} if verbatim else None
            out.append((
                path, kind, text if verbatim or type_ == "verse" else text.rstrip(), fence, get("name"), get("title"), get("label"), get("marker"), get("style"), get("task"),
                first_item, last_item, item_tight, tight, get("item"), get("caption"), " ".join(x for x in (before, own) if x) or None if before or own else None, chain, after,
                nth, nth_shown, flush, type_ in HOLDERS, row.start + 1, row.end + 1, len(path),
            ))
            if row.children:
                task = f"[{facts['task']}] " if get("task") else ""
                marker = f"{get('marker')} {task}" if listed else ": " if type_ == "description" else f"[^{get('label')}]: " if type_ == "footnote" else ""
                chains: dict[tuple, list] = {}
                for i in range(len(row.children) - 1, -1, -1):
                    c = row.children[i]
                    key = first, first_shown = i == 0, order[c][1] == 1
                    if key not in chains:
                        inner = [{**x, "fresh": x["fresh"] and first, "shown": x["shown"] and first_shown} for x in chain]
                        chains[key] = [*inner, {"kind": kind, "marker": marker, "name": get("name") or "", "fresh": first, "shown": first_shown}]
                    todo.append((c, path, chains[key], item_tight))
        return out


def meets(frame: Frame, rest: str) -> str | None:
    """What a line that the frame owns is for the frames in it; None if the frame does not own it."""
    if frame.kind == "quote":
        bare = rest.lstrip(" ")
        return bare[2:] if bare.startswith("> ") else "" if bare == ">" else None
    if frame.kind in ("item", "description", "note"):
        return "" if not rest.strip() else rest[frame.column :] if indent(rest) >= frame.column else None
    if frame.kind == "attached":
        return rest if rest.strip() else None
    return rest


def comment(rest: str) -> bool:
    return "%%" in rest and rest.lstrip(" \t").startswith("%%")


def nested(docs: DataFrame, columns: Collection[str] = (*KINDS, "depth")) -> DataFrame:
    """docs (doc_id, source) -> block rows: doc_id and the columns asked for, of those of KINDS and depth.

    path holds a block's place among its siblings behind those of the blocks around it, so a row's parent is its path without
    the last entry; depth is its length; chain has the holders around it. A list is its items: first_item, last_item, tight (no blank line parts
    the items or precedes one of their later paragraphs). A null or empty source has no blocks. Below MAX_DEPTH frames
    markers are text. doc_id is a key; other columns are ignored.
    """
    kept = spread(docs.select("doc_id", "source"), "doc_id").select("doc_id", normalize_source("source").alias("source"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    told = KINDS | {"depth": "int"}
    if unknown := set(columns) - set(told):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    #: Where a wanted column stands in a row; depths alone need no rows.
    flat = set(columns) == {"depth"}
    fields = [(0 if flat else i, f) for i, f in enumerate([*_fields(), pa.field("depth", pa.int32())]) if f.name in columns]
    names = ["doc_id", *(f.name for _, f in fields)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, found, size = batch.column(0), [], [], 0

            def rows() -> pa.RecordBatch:
                made = [found] if flat else list(zip(*found, strict=True))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(made[i], f.type) for i, f in fields)], names)

            for i in range(len(batch)):
                source = batch.column(1)[i].as_py()
                if not source:
                    continue
                blocks = Blocks(source)
                more = blocks.depths() if flat else blocks.tuples()
                at += [i] * len(more)
                found += more
                size += len(source)
                if size > 1_000_000 or len(found) > 4_000:
                    yield rows()
                    at, found, size = [], [], 0
            if found:
                yield rows()

    return kept.mapInArrow(read, f"doc_id {kind}, " + ", ".join(f"`{f.name}` {told[f.name]}" for _, f in fields))


def _fields() -> list[pa.Field]:
    """KINDS as Arrow fields."""
    plain = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    struct = lambda told: pa.struct([(n.strip(), plain[t.strip()]) for n, t in (f.split(":") for f in told[len("struct<") : -1].split(","))])
    kinds = plain | {FENCE: struct(FENCE), f"array<{LINK}>": pa.list_(struct(LINK))}
    return [pa.field(k, kinds[v]) for k, v in KINDS.items()]
