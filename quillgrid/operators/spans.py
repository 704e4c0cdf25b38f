"""Inline text as a tree: one pass over a text with its openers, one row per construct with its parent.

A text is read once for its code spans and brackets, then from left to right. An opener looks for its closer
past whatever is whole by itself (escapes, code, bracketed and braced constructs), and what lies between is
read as its content; an opener without a closer is text. Every construct has the numbers at which it opens and closes, so
that rendering is a sort of pieces and resolving a join on rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Delimiter and node type of marks with a bare and a braced form, and of those with a braced form alone.
BARE = {"*": "strong", "/": "emphasis", "_": "underline", "~": "strike", "=": "highlight"}
BRACED = {**BARE, "^": "superscript", ",": "subscript", "+": "insert", "-": "delete"}
MOST_DEPTH = 100
MOST_PARENTHESES = 32

SPACE = " \t\n\r"
SPECIAL = re.compile(r"[\\`{\[!$<^:@#%\"'*/_~=\n]")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
ITEM = r"""(?:\#[^\s{}\#."=]+|\.[^\s{}\#."=]+|[A-Za-z][\w:.-]*=(?:"(?:[^"\\]|\\.)*"|[^\s{}"]+)|[A-Za-z][\w:.-]*)"""
ATTRIBUTES = re.compile(r"\{[ \n]*(?:" + ITEM + r"(?:[ \n]+" + ITEM + r"|(?=[.\#])" + ITEM + r")*)?[ \n]*\}", re.S)
AUTOLINK = re.compile(r"<((?:[A-Za-z][A-Za-z0-9+.-]*://|mailto:|tel:)[^\s<>]+|[^\s<>@]+@[^\s<>@]+\.[^\s<>@]+)>")
CROSSREF = re.compile(r"</\#([^\s<>]+)>")
NOTE = re.compile(r"\[\^([^\[\]\s]+)\]")
SOCIAL = re.compile(r"[@\#]([A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+)*)")
EXTENSION = re.compile(r":([a-z][\w-]*)(?=\[)")
RAW = re.compile(r"\{=([\w-]+)\}")
TITLE = re.compile(r"[ \n]+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)')[ \n]*(?=\))", re.S)
ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
KINDS = "ord int, parent int, open int, close int, kind string, value string, target string, title string, attributes string"


class Inlines:
    """The rows of one text: [parent, open, close, kind, value, target, title, attributes] by ord."""

    def __init__(self, text: str):
        self.s, self.rows, self.clock, self.depth, self.searches = text, [], 0, 0, 0
        self.code: dict[int, tuple[int, int, int]] = {}
        self.match: dict[int, int] = {}
        self.ends: dict[tuple[str, int, int], int | None] = {}
        #: Where a search for a closer up to an end failed: from there on all of its kind fail.
        self.fails: dict[tuple[str, int], int] = {}
        self.last = {d: text.rfind(d + "}") for d in BRACED}
        self._pair()
        self.read(0, len(text), -1, "")

    def _pair(self) -> None:
        """Where code spans end and which brackets belong together."""
        s, runs, open_ = self.s, {}, []
        for m in re.finditer("`+", s):
            runs.setdefault(len(m[0]), []).append(m.start())
        at = dict.fromkeys(runs, 0)
        i = 0
        for m in re.finditer(r"\\.|`+|\{%|\{\#|[\[\]]", s, re.S):
            if m.start() < i:
                continue
            i = m.end()
            if m[0][0] == "`":
                size, starts = len(m[0]), runs[len(m[0])]
                while at[size] < len(starts) and starts[at[size]] < i:
                    at[size] += 1
                found = at[size] < len(starts)
                stop = starts[at[size]] if found else len(s)
                self.code[m.start()] = (i, stop, stop + size if found else len(s))
                i = self.code[m.start()][2]
            elif m[0] in ("{%", "{#"):
                i = max(i, self.comment(m.start()) or i)
            elif m[0] == "[":
                open_.append(m.start())
            elif m[0] == "]" and open_:
                self.match[open_.pop()] = m.start()

    def comment(self, i: int) -> int | None:
        """The end of the comment that opens at i; a block of attributes behind a construct is none."""
        if self.s.startswith("{#", i) and i and self.s[i - 1] in "]`})*/_~=>" and (m := ATTRIBUTES.match(self.s, i)) and self.s[i - 1] != "{":
            opener = self.s[i - 1]
            if opener not in BARE or not self.s[max(0, i - 2)].isspace():
                return m.end()
        stop = self.s.find(self.s[i + 1] + "}", i + 2)
        return None if stop < 0 else stop + 2

    def add(self, parent: int, kind: str, value=None, target=None, title=None, attributes=None) -> int:
        self.rows.append([parent, self.clock, None, kind, value, target, title, attributes])
        self.clock += 1
        return len(self.rows) - 1

    def close(self, row: int) -> None:
        self.rows[row][2] = self.clock
        self.clock += 1

    def text(self, parent: int, value: str, kind: str = "text") -> None:
        if not value:
            return
        last = self.rows[-1] if self.rows else None
        if last and last[0] == parent and last[3] == kind and last[1] == self.clock - 1:
            last[4] += value
        else:
            self.add(parent, kind, value)

    def attached(self, i: int, end: int) -> tuple[str | None, int]:
        """Blocks of attributes at i as one, and where they end."""
        parts = []
        while i < end and self.s[i] == "{" and (m := ATTRIBUTES.match(self.s, i, end)):
            parts.append(m[0][1:-1])
            i = m.end()
        return ("{" + " ".join(p.strip() for p in parts).strip() + "}" if parts else None), i

    def destination(self, i: int, end: int) -> tuple[str, str | None, int] | None:
        """Address, title and end of ``(address "title")`` at i."""
        s, j, depth = self.s, i + 1, 0
        while j < end and s[j] in " \n":
            j += 1
        start = j
        if j < end and s[j] == "<" and (stop := s.find(">", j, end)) > 0 and "\n" not in s[j:stop]:
            start, j = j + 1, stop
            address, j = s[start:stop], stop + 1
        else:
            while j < end and s[j] not in SPACE:
                if s[j] == "\\" and j + 1 < end:
                    j += 1
                elif s[j] == "(":
                    depth += 1
                    if depth > MOST_PARENTHESES:
                        return None
                elif s[j] == ")":
                    if not depth:
                        break
                    depth -= 1
                j += 1
            address = s[start:j]
        title = TITLE.match(s, j, end)
        if title:
            j = title.end()
        while j < end and s[j] in " \n":
            j += 1
        if j >= end or s[j] != ")" or depth:
            return None
        found = None if not title else title[1] if title[1] is not None else title[2]
        return ESCAPE.sub(r"\1", address), None if found is None else ESCAPE.sub(r"\1", found), j + 1

    def behind(self, i: int, end: int) -> int:
        """The end of the bracket that opens at i, with its address, label and attributes."""
        j = self.match[i] + 1
        if j < end and self.s[j] == "(" and (found := self.destination(j, end)):
            j = found[2]
        elif j < end and self.s[j] == "[" and self.match.get(j, end) < end:
            j = self.match[j] + 1
        return self.attached(j, end)[1]

    def whole(self, i: int, end: int) -> int:
        """The end of what is whole by itself at i, or i."""
        s, c = self.s, self.s[i]
        if c == "\\":
            return min(i + 2, end)
        if c == "`" and i in self.code:
            return self.attached(min(self.code[i][2], end), end)[1]
        if c == "[" and self.match.get(i, end) < end:
            return self.behind(i, end)
        if c == "{" and i + 1 < end:
            if s[i + 1] in "%#" and (stop := self.comment(i)) and stop <= end:
                return stop
            if s[i + 1] in BRACED and self.searches < MOST_DEPTH and (stop := self.braced(i, end)) is not None:
                return self.attached(stop + 2, end)[1]
        return i

    def braced(self, i: int, end: int) -> int | None:
        """Where the closer of the braced opener at i stands."""
        s, d = self.s, self.s[i + 1]
        key, kind = ("{" + d, i, end), ("{" + d, end)
        if i >= self.fails.get(kind, end):
            return None
        if key not in self.ends:
            self.ends[key], j = None, i + 2
            self.searches += 1
            limit = min(end - 1, self.last[d] + 1)
            while j < limit:
                if s[j] == d and s[j + 1] == "}" and j > i + 2:
                    self.ends[key] = j
                    break
                stop = self.whole(j, end)
                j = stop if stop > j else j + 1
            self.searches -= 1
            if self.ends[key] is None:
                self.fails[kind] = min(i, self.fails.get(kind, end))
        return self.ends[key]

    def bare(self, i: int, end: int, held: str) -> int | None:
        """Where the closer of the bare opener at i stands, if the one opens and the other closes."""
        s, d = self.s, self.s[i]
        before, after = s[i - 1] if i else " ", s[i + 1] if i + 1 < end else " "
        if d in held or after in SPACE or after == d or before == d or word(before):
            return None
        if d == "=" and (after == ">" or before in "<>!") or before == "/" and d in "/_":
            return None
        key, kind = (d, i, end), (d, end)
        if i >= self.fails.get(kind, end):
            return None
        if key not in self.ends:
            self.ends[key], j = None, i + 1
            while m := STOPS[d].search(s, j, end):
                j = m.start()
                following = s[j + 1] if j + 1 < len(s) else " "
                if s[j] == d and j > i + 1 and s[j - 1] not in SPACE and s[j - 1] != d and following != d and not word(following):
                    self.ends[key] = j
                    break
                stop = self.whole(j, end)
                j = stop if stop > j else j + 1
            if self.ends[key] is None:
                self.fails[kind] = min(i, self.fails.get(kind, end))
        return self.ends[key]

    def content(self, row: int, start: int, end: int, held: str) -> None:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            self.text(row, self.s[start:end], "literal")
        else:
            self.read(start, end, row, held)
        self.depth -= 1
        self.close(row)

    def read(self, i: int, end: int, parent: int, held: str) -> None:
        s, start = self.s, i
        while i < end:
            m = SPECIAL.search(s, i, end)
            if not m:
                break
            i = m.start()
            stop = self.construct(i, end, parent, held, start)
            if stop is None:
                i += 1
                continue
            i = start = stop
        self.text(parent, s[start:end])

    def construct(self, i: int, end: int, parent: int, held: str, start: int) -> int | None:
        """Read the construct at i behind the text from start on; None if there is none."""
        s, c = self.s, self.s[i]
        flush = lambda trim=False: self.text(parent, s[start:i].rstrip(" ") if trim else s[start:i])
        if c == "\\":
            following = s[i + 1] if i + 1 < end else ""
            if following == "\n":
                flush(True)
                self.add(parent, "hard_break")
                return i + 2
            if following == " ":
                flush()
                self.text(parent, "\xa0", "literal")
                return i + 2
            if following and PUNCTUATION.match(following):
                flush()
                self.text(parent, following, "literal")
                return i + 2
            return None
        if c == "\n":
            flush(True)
            self.text(parent, "\n", "soft_break")
            return i + 1
        if c in "\"'":
            flush()
            before, after = s[i - 1] if i else " ", s[i + 1] if i + 1 < end else " "
            opens = (before in SPACE or before in "([{-/*_~=\u201c\u2018") and after not in SPACE
            self.text(parent, {'"': "\u201c\u201d", "'": "\u2018\u2019"}[c][0 if opens else 1], "literal")
            return i + 1
        if c == "%":
            if not s.startswith("%%", i) or i > 0 and s[i - 1] not in " \n[" or s.startswith("%%%", i):
                return None
            flush(True)
            stop = s.find("\n", i, end)
            return end if stop < 0 else stop
        if c == "`" or c in "!$" and i + 1 < end and s[i + 1] in "`$":
            return self.verbatim(i, end, parent, flush)
        if c == "{":
            return self.brace(i, end, parent, held, flush)
        if c == "[" or c in "!^" and i + 1 < end and s[i + 1] == "[":
            return self.bracket(i, end, parent, held, flush)
        if c == "<":
            for kind, pattern in (("autolink", AUTOLINK), ("crossref", CROSSREF)):
                if m := pattern.match(s, i, end):
                    flush()
                    attributes, stop = self.attached(m.end(), end)
                    self.add(parent, kind, m[1], m[1], None, attributes)
                    return stop
            return None
        if c == ":":
            m = EXTENSION.match(s, i, end)
            if not m or i and word(s[i - 1]) or self.match.get(m.end(), end) >= end:
                return None
            flush()
            close = self.match[m.end()]
            attributes, stop = self.attached(close + 1, end)
            row = self.add(parent, "extension", None, m[1], None, attributes)
            self.content(row, m.end() + 1, close, held)
            return stop
        if c in "@#":
            m = SOCIAL.match(s, i, end)
            if not m or i and (word(s[i - 1]) or s[i - 1] in "@#&"):
                return None
            flush()
            self.add(parent, "mention" if c == "@" else "tag", m[0], m[1])
            return m.end()
        if c in BARE and (close := self.bare(i, end, held)) is not None:
            flush()
            attributes, stop = self.attached(close + 1, end)
            row = self.add(parent, BARE[c], None, None, None, attributes)
            self.content(row, i + 1, close, held + c)
            return stop
        return None

    def verbatim(self, i: int, end: int, parent: int, flush) -> int | None:
        s = self.s
        sigil = re.match(r"!|\$\$?|", s[i : i + 2])[0]
        at = i + len(sigil)
        if at not in self.code:
            return None
        start, stop, after = self.code[at]
        stop, after = min(stop, end), min(after, end)
        value = s[start:stop]
        if len(value) > 2 and value[0] == value[-1] == " " and value.strip(" ") and (value[1] == "`" or value[-2] == "`"):
            value = value[1:-1]
        flush()
        kind = {"": "code", "!": "literal_text", "$": "math", "$$": "display_math"}[sigil]
        if kind == "code" and (m := RAW.match(s, after, end)):
            self.add(parent, "raw", value, m[1])
            return m.end()
        attributes, after = self.attached(after, end)
        self.add(parent, kind, value, None, None, attributes)
        return after

    def brace(self, i: int, end: int, parent: int, held: str, flush) -> int | None:
        s, d = self.s, self.s[i + 1 : i + 2]
        if s.startswith("{--}", i) and i + 4 <= end:
            flush()
            self.text(parent, "\u2013", "literal")
            return i + 4
        if d in ("%", "#"):
            stop = s.find(d + "}", i + 2, end)
            if stop < 0:
                return None
            flush()
            self.add(parent, "comment" if d == "%" else "editorial_comment", s[i + 2 : stop])
            return stop + 2
        if not d or d not in BRACED or (close := self.braced(i, end)) is None:
            return None
        flush()
        attributes, stop = self.attached(close + 2, end)
        arrow = self.arrow(i + 2, close) if d == "~" else None
        if arrow is not None:
            for kind, a, b in (("delete", i + 2, arrow), ("insert", arrow + 2, close)):
                self.content(self.add(parent, kind, None, None, None, attributes), a, b, "")
            return stop
        row = self.add(parent, BRACED[d], None, None, None, attributes)
        self.content(row, i + 2, close, "")
        return stop

    def arrow(self, j: int, end: int) -> int | None:
        while j < end - 1:
            if self.s[j] == "~" and self.s[j + 1] == ">":
                return j
            stop = self.whole(j, end)
            j = stop if stop > j else j + 1
        return None

    def bracket(self, i: int, end: int, parent: int, held: str, flush) -> int | None:
        s = self.s
        at = i + 1 if s[i] in "!^" else i
        close = self.match.get(at, end)
        if close >= end:
            return None
        if s[i] == "^":
            flush()
            attributes, stop = self.attached(close + 1, end)
            self.content(self.add(parent, "inline_note", s[at + 1 : close], None, None, attributes), at + 1, close, held)
            return stop
        if s[i] == "[" and (m := NOTE.match(s, i, end)):
            flush()
            attributes, stop = self.attached(m.end(), end)
            self.add(parent, "note_ref", m[1], m[1], None, attributes)
            return stop
        image, j = s[i] == "!", close + 1
        following = s[j] if j < end else ""
        target = title = None
        if following == "(" and (found := self.destination(j, end)):
            kind, (target, title, j) = "link", found
        elif following == "[" and self.match.get(j, end) < end and (j > close and s[j + 1 : self.match[j]].strip() or not s[j + 1 : self.match[j]]):
            kind, stop = "reference", self.match[j]
            target, j = s[j + 1 : stop] or s[at + 1 : close], stop + 1
            title = s[close + 1 : j]
        elif following == "{" and not image and ATTRIBUTES.match(s, j, end):
            kind = "span"
        else:  # text, but what opens in it closes in it
            flush()
            self.text(parent, s[i : at + 1])
            self.depth += 1
            if self.depth > MOST_DEPTH:
                self.text(parent, s[at + 1 : close], "literal")
            else:
                self.read(at + 1, close, parent, held)
            self.depth -= 1
            return close
        flush()
        attributes, stop = self.attached(j, end)
        if image:
            self.add(parent, "image" if kind == "link" else "image_reference", ESCAPE.sub(r"\1", s[at + 1 : close]), target, title, attributes)
            return stop
        row = self.add(parent, kind, None, target, title, attributes)
        self.content(row, at + 1, close, "")
        return stop


STOPS = {d: re.compile(rf"[\\`\[{{{re.escape(d)}]") for d in BARE}


def word(c: str) -> bool:
    return c.isalnum() or c == "_"


def inline_rows(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per inline construct of each text: keys, ord, parent (-1: the text), open, close, kind, value, target, title, attributes.

    open and close number the constructs' ends from left to right within a text; a leaf has no close. A null or empty
    text has no rows. Marks nest to MOST_DEPTH levels, what is deeper stays text. ``keys`` name the columns to carry along.
    """
    rows = texts.select(*keys, texts[text].alias("__text"))
    told = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    kinds = [pa.int32()] * 4 + [pa.string()] * 5
    names = [c.split()[0] for c in KINDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                at, out = [], []
                for i, value in enumerate(batch.column(len(keys)).to_pylist()):
                    found = Inlines(value).rows if value else []
                    at += [i] * len(found)
                    out += [(n, *row) for n, row in enumerate(found)]
                kept = batch.select(list(range(len(keys)))).take(pa.array(at, pa.int64()))
                arrays = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], [*keys, *names])

    return rows.mapInArrow(read, f"{told}, {KINDS}")
