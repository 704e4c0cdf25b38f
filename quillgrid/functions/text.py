"""Scalar functions on string columns. All are Catalyst expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bidirectional control characters, and zero-width ones.
BIDI = "[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"
ZERO_WIDTH = "[\u200b-\u200d\u2060\ufeff]"
#: Typographic glyphs and their ASCII spelling.
GLYPHS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "--", "—": "---", "…": "...", "→": "-->", "←": "<--", "≤": "<=", "≥": ">=", "≠": "!=", "±": "+-", "™": "(tm)"}
#: Arrows and signs that smart typography replaces, longest spelling first.
SYMBOLS = (("<-->", "↔"), ("<=>", "⇔"), ("<==", "⇐"), ("==>", "⇒"), ("<--", "←"), ("-->", "→"), ("(tm)", "™"), ("<=", "≤"), (">=", "≥"), ("!=", "≠"), ("+-", "±"))
#: Letters with marks and their ASCII letters, one to one.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repair_utf8(c: Column | str) -> Column:
    """Bytes or text with invalid UTF-8 replaced by U+FFFD."""
    return F.make_valid_utf8(col(c).cast("binary").cast("string"))


def normalize_source(c: Column | str) -> Column:
    """LF line ends, NUL as U+FFFD, one leading byte order mark dropped."""
    c = F.regexp_replace(col(c), "^\ufeff", "")
    return F.translate(F.regexp_replace(c, "\r\n?", "\n"), "\x00", "�")


def escape_html(c: Column | str) -> Column:
    """Text content: & < > and the no-break space; quotes stay; bidirectional controls go."""
    c = F.regexp_replace(col(c), BIDI, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_attribute(c: Column | str) -> Column:
    c = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_shared(c: Column | str) -> Column:
    return F.replace(escape_attribute(c), F.lit("\u00a0"), F.lit("&nbsp;"))


def detypography(c: Column | str) -> Column:
    c = col(c)
    for a, b in GLYPHS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slug(c: Column | str) -> Column:
    """Heading id: runs of other characters than ASCII alphanumerics and non-ASCII become a dash; case stays."""
    s = F.regexp_replace(detypography(c), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", "s").when(s.rlike("^[0-9]"), F.concat(F.lit("s-"), s)).otherwise(s)


def ascii_fold(c: Column | str) -> Column:
    c = F.replace(F.replace(F.replace(col(c), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.translate(c, MARKED, PLAIN)


def gfm_slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N} _-]+", ""), " ", "-")


def strip_bidi(c: Column | str) -> Column:
    return F.regexp_replace(col(c), BIDI, "")


def id_source(c: Column | str) -> Column:
    return F.regexp_replace(strip_bidi(c), ZERO_WIDTH, "")


def strip_controls(c: Column | str) -> Column:
    return F.regexp_replace(strip_bidi(c), "[\r\u007f-\u009f]", "")


def safe_fence(content: Column | str, marker: str = "`", least: int = 3) -> Column:
    """A run of the marker longer than any in the content, and at least ``least``."""
    runs = F.transform(F.regexp_extract_all(col(content), F.lit(f"{marker}+"), F.lit(0)), F.length)
    return F.repeat(F.lit(marker), F.greatest(F.lit(least), F.coalesce(F.array_max(runs), F.lit(0)) + 1).cast("int"))


def label_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), " +", " "))


#: Schemes that run scripts or hand their text to a program of the system; no target shows them.
UNSAFE_SCHEMES = (
    "javascript", "vbscript", "data", "file", "ms-msdt", "ms-office", "ms-word", "ms-excel", "ms-powerpoint", "ms-access", "ms-visio", "ms-project",
    "ms-publisher", "ms-infopath", "ms-spd", "ms-search", "search-ms", "ms-cxh", "ms-cxh-full", "shell", "vscode", "vscode-insiders", "jar",
)
UNSAFE = rf"(?:{'|'.join(UNSAFE_SCHEMES)}):"


def safe_value(c: Column | str) -> Column:
    """The value, blank if it names an unsafe scheme."""
    return F.when(F.coalesce(url_scheme(c).isin(*UNSAFE_SCHEMES), F.lit(False)), "").otherwise(col(c))


def url_scheme(c: Column | str) -> Column:
    """Lower-case text before the first colon, white space and controls removed; null without one."""
    bare = F.regexp_replace(col(c), r"[\x00-\x20\x7f-\x9f]", "")
    return F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lower(F.substring_index(bare, ":", 1)))


def leading_columns(c: Column | str, stop: int = 4) -> Column:
    """Width of leading blanks with tab stops."""
    blanks = F.regexp_extract(col(c), "^[ \t]*", 0)
    step = lambda n, x: F.when(x == "\t", n + stop - n % stop).otherwise(n + 1)
    return F.aggregate(F.filter(F.split(blanks, ""), lambda x: x != ""), F.lit(0), lambda n, x: step(n, x).cast("int"))


def attributes(c: Column | str) -> Column:
    """Struct (id, classes, pairs) of an attribute block ``{#id .class key=value key="value"}``."""
    body = F.regexp_extract(col(c), r"^\{(.*)\}$", 1)
    bare = F.regexp_replace(body, r'[A-Za-z][\w:-]*=(?:"[^"]*"|[^\s"]+)', "")
    key, value = (F.regexp_extract_all(body, F.lit(r'([A-Za-z][\w:-]*)=("[^"]*"|[^\s"]+)'), F.lit(i)) for i in (1, 2))
    pairs = F.map_from_entries(F.array_distinct(F.arrays_zip(key.alias("key"), F.transform(value, lambda v: F.regexp_replace(v, '^"|"$', "")).alias("value"))))
    ids = F.regexp_extract_all(bare, F.lit(r"#([^\s#.}]+)"), F.lit(1))
    return F.struct(F.try_element_at(ids, F.lit(-1)).alias("id"), F.regexp_extract_all(bare, F.lit(r"\.([^\s#.}]+)"), F.lit(1)).alias("classes"), pairs.alias("pairs"))


def render_attributes(pairs: Column | str) -> Column:
    """A map as `` key="value"`` in its own order, event handlers dropped."""
    kept = F.filter(F.map_entries(col(pairs)), lambda e: ~F.lower(e["key"]).rlike("^on|^srcdoc$|^formaction$"))
    return F.array_join(F.transform(kept, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escape_attribute(safe_value(e["value"])), F.lit('"'))), "")


def roman_value(c: Column | str) -> Column:
    """Value of a Roman numeral in either case."""
    value = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    letters = F.filter(F.split(F.lower(col(c)), ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda a, x: F.struct((a["total"] + value[x] - F.when(a["last"] < value[x], 2 * a["last"]).otherwise(0)).alias("total"), value[x].alias("last"))
    return F.aggregate(letters, start, step, lambda a: a["total"])


def alpha_value(c: Column | str) -> Column:
    """a = 1, z = 26, aa = 27, in either case."""
    return F.aggregate(F.filter(F.split(F.lower(col(c)), ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 96)


def code_point(n: Column) -> Column:
    """The character of a code point; Spark's char starts anew at 256."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


def alpha_label(n: Column | str) -> Column:
    """1 = a, 26 = z, 27 = aa; past 702 the first sign runs on by code point behind z."""
    n = col(n)
    return F.concat(F.when(n > 26, code_point(F.floor((n - 1) / 26) + 96)).otherwise(""), F.char(((n - 1) % 26 + 97).cast("int")))


def smart_dashes(c: Column | str) -> Column:
    """Runs of hyphens as em and en dashes; a run between white space and a word is a flag and stays."""
    c = col(c)
    parts = F.regexp_extract_all(c, F.lit("-+|[^-]+"), F.lit(0))

    def dash(part: Column) -> Column:
        n = F.length(part)
        em, en = "—", "–"
        return (
            F.when(n % 3 == 0, F.repeat(F.lit(em), (n / 3).cast("int")))
            .when(n % 2 == 0, F.repeat(F.lit(en), (n / 2).cast("int")))
            .when(n % 3 == 1, F.concat(F.repeat(F.lit(em), ((n - 4) / 3).cast("int")), F.lit(en + en)))
            .otherwise(F.concat(F.repeat(F.lit(em), F.floor(n / 3).cast("int")), F.lit(en)))
        )

    flagged = F.transform(parts, lambda p, i: F.when(p.rlike("^--+$") & ~(_ends_blank(F.get(parts, i - 1)) & _starts_ink(F.get(parts, i + 1))), dash(p)).otherwise(p))
    return F.array_join(flagged, "")


def _ends_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\s$"), F.lit(True))


def _starts_ink(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\S"), F.lit(False))


def smart_symbols(c: Column | str) -> Column:
    c = col(c)
    for a, b in SYMBOLS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def smart_quotes(c: Column | str, opening: str = "“", closing: str = "”", single: str = "’") -> Column:
    """Double quotes by what stands before them; an apostrophe inside a word."""
    c = F.regexp_replace(col(c), r'(^|[\s(\[{])"', f"$1{opening}")
    c = F.replace(c, F.lit('"'), F.lit(closing))
    return F.regexp_replace(c, r"(?<=\w)'(?=\w)", single)


def ellipsis(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("..."), F.lit("…"))


def ansi(c: Column | str, code: str) -> Column:
    return F.concat(F.lit(f"\x1b[{code}m"), col(c), F.lit("\x1b[0m"))


def superscript(c: Column | str) -> Column:
    return F.translate(col(c), "0123456789+-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻")


def subscript(c: Column | str) -> Column:
    return F.translate(col(c), "0123456789+-", "₀₁₂₃₄₅₆₇₈₉₊₋")


def percent_fraction(c: Column | str) -> Column:
    """``33.3%`` as an exact decimal fraction."""
    return (F.regexp_extract(col(c), r"^\s*([0-9.]+)\s*%", 1).cast("decimal(12,4)") / F.lit(100).cast("decimal(5,0)")).cast("decimal(12,6)")


def math_markers(c: Column | str, display: Column) -> Column:
    return F.when(display, F.concat(F.lit("\\["), escape_html(c), F.lit("\\]"))).otherwise(F.concat(F.lit("\\("), escape_html(c), F.lit("\\)")))


def stamp_version(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"(?m)^%% markup-version: ([0-9.]+)", 1)


def json_pointer(*parts: Column) -> Column:
    return F.concat(*[F.concat(F.lit("/"), p.cast("string")) for p in parts])


def expand_tabs(c: Column | str, width: int = 4) -> Column:
    return F.replace(col(c), F.lit("\t"), F.lit(" " * width))


def fnv1a(c: Column | str) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hex digits; 64-bit products by halves, so that nothing overflows."""
    octets = F.transform(F.regexp_extract_all(F.hex(F.encode(col(c), "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("long"))
    half = 4294967296
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(a: Column, b: Column) -> Column:
        # The prime is 2^40 + 435: the low half times 435 carries up, and the low half shifted by 8 adds to the high half.
        lo = a["lo"].bitwiseXOR(b)
        product = lo * 435
        hi = a["hi"] * 435 + F.floor(product / half) + lo * 256
        return F.struct((hi % half).cast("long").alias("hi"), (product % half).cast("long").alias("lo"))

    done = F.aggregate(octets, start, step)
    return F.lower(F.concat(F.lpad(F.hex(done["hi"]), 8, "0"), F.lpad(F.hex(done["lo"]), 8, "0")))


def display_width(c: Column | str) -> Column:
    """Columns that a string takes in a terminal: wide East Asian characters count two, combining marks none."""
    c = col(c)
    wide = F.regexp_count(c, F.lit("[ᄀ-ᅟ⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]"))
    return F.length(c) + wide - F.regexp_count(c, F.lit(r"\p{Mn}"))


def nfc(c: Column | str) -> Column:
    """Unicode normal form C. No built-in function has it; ASCII texts skip the Python worker's table."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return normal(col(c))


def graphemes(c: Column | str) -> Column:
    """Number of grapheme clusters."""
    return F.regexp_count(col(c), F.lit(r"\X"))


def destination(c: Column | str) -> Column:
    """A link destination without angle brackets and with escaped punctuation undone."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^<([^>]*)>$", "$1"), r"\\([!-/:-@\[-`{-~])", "$1")


def csl_author_year(entry: Column | str) -> Column:
    """``Family, 2020`` of a CSL-JSON entry; of several authors the first with et al."""
    e = col(entry)
    family = F.get_json_object(e, "$.author[0].family")
    more = F.when(F.get_json_object(e, "$.author[1].family").isNotNull(), " et al.").otherwise("")
    return F.concat(family, more, F.lit(", "), F.coalesce(F.get_json_object(e, "$.issued.date-parts[0][0]"), F.lit("n.d.")))


def json_depth(c: Column | str) -> Column:
    """Deepest nesting of a JSON text outside strings."""
    bare = F.regexp_replace(col(c), r'"(?:[^"\\]|\\.)*"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        now = a["now"] + F.when(x.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda a: a["most"])
