"""SVG reduced to drawing: a whitelist of elements, attributes and references, row by row in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Elements that only draw, in the spelling they are written back with.
ELEMENTS = """svg g defs symbol use title desc switch path rect circle ellipse line polyline polygon text tspan textPath
marker linearGradient radialGradient stop clipPath mask pattern filter feGaussianBlur feOffset feBlend feColorMatrix
feComponentTransfer feFuncA feFuncR feFuncG feFuncB feComposite feFlood feMerge feMergeNode feMorphology feTile
feTurbulence feDropShadow feImage feDisplacementMap""".split()
#: Attributes of geometry and presentation, in the spelling they are written back with.
ATTRIBUTES = """d x y x1 y1 x2 y2 cx cy r rx ry width height viewBox points transform pathLength fill fill-opacity fill-rule stroke
stroke-width stroke-linecap stroke-linejoin stroke-miterlimit stroke-dasharray stroke-dashoffset stroke-opacity opacity color
offset stop-color stop-opacity gradientUnits gradientTransform spreadMethod patternUnits patternTransform patternContentUnits
clipPathUnits maskUnits maskContentUnits markerWidth markerHeight markerUnits orient refX refY preserveAspectRatio font-family
font-size font-weight font-style text-anchor dominant-baseline letter-spacing word-spacing clip-path clip-rule mask marker-start
marker-mid marker-end filter stdDeviation in in2 result mode operator values type flood-color flood-opacity class id role xmlns
xmlns:xlink xml:space version href xlink:href""".split()
TAG_NAMES = {t.lower(): t for t in ELEMENTS}
ATTRIBUTE_NAMES = {a.lower(): a for a in ATTRIBUTES}
HIDDEN = re.compile(r"[\x00-\x20\x7f-\xa0\u200b-\u200f\u2028-\u202e\u2060-\u2064\u3000\ufeff]")


def harmless(name: str, value: str) -> bool:
    """Whether a value refers to nothing outside the drawing."""
    plain = re.sub(r"\\[0-9a-fA-F]{1,6}\s?|\\.", "", HIDDEN.sub("", value)).lower()
    if name in ("href", "xlink:href"):
        return bool(re.fullmatch(r"#[\w.:-]+", value.strip()))
    if name in ("xmlns", "xmlns:xlink"):
        return value in ("http://www.w3.org/2000/svg", "http://www.w3.org/1999/xlink")
    outside = [u for u in re.findall(r"url\(([^)]*)", plain) if not re.fullmatch(r"['\"]?#[\w.:-]+['\"]?", u)]
    return not outside and "image(" not in plain and "image-set(" not in plain and "//" not in plain and not re.search(r"(?:javascript|vbscript|data|file|expression)[:(]", plain)


def text_of(value: str) -> str:
    return value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class Whitelist(HTMLParser):
    """Writes what is allowed; an element that is not allowed goes with all it holds."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.dropped: list[str] = []

    def start(self, tag: str, attrs: list, closed: bool) -> None:
        if self.dropped or tag not in TAG_NAMES or (not self.open and tag != "svg"):
            if not closed:
                self.dropped.append(tag)
            return
        seen: dict[str, str] = {}
        for name, value in attrs:
            if name in ATTRIBUTE_NAMES and value is not None and name not in seen and harmless(name, value):
                seen[name] = value
        written = "".join(f' {ATTRIBUTE_NAMES[n]}="{text_of(v).replace(chr(34), "&quot;")}"' for n, v in seen.items())
        self.out.append(f"<{TAG_NAMES[tag]}{written}{'/' if closed else ''}>")
        if not closed:
            self.open.append(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.start(tag, attrs, False)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.start(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag in self.dropped:
                while self.dropped.pop() != tag:
                    pass
        elif tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{TAG_NAMES[last]}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.open and not self.dropped:
            self.out.append(text_of(data))


def clean(source: str) -> str:
    """The drawing of an SVG text; nothing for a text that holds none."""
    w = Whitelist()
    w.feed(source)
    w.close()
    while w.open:
        w.out.append(f"</{TAG_NAMES[w.open.pop()]}>")
    return "".join(w.out)


@pandas_udf(StringType())
def clean_svg(sources: pd.Series) -> pd.Series:
    return sources.map(clean, na_action="ignore")
