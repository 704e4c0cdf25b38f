"""Queries of inline operators over markup generated from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import blocks as B
from quillgrid.operators import inlines as I
from quillgrid.plans.base import query, table


def texts(spark, sf, name: str, key: str, text: str):
    """doc_id and text from a table: text is a Spark SQL expression."""
    return table(spark, sf, name).selectExpr(f"cast({key} as bigint) doc_id", f"{text} text")


MARK_NAMES = "('strong'), ('emphasis'), ('underline'), ('strike'), ('highlight')"


@query(f"SELECT p_partkey AS doc_id, k AS kind, p_name AS value FROM part, (VALUES {MARK_NAMES}) x(k)")
def i9_i10_i11_i12_i13_marks(spark, sf):
    rows = texts(spark, sf, "part", "p_partkey", "concat('a *', p_name, '* b /', p_name, '/, _', p_name, '_ ~', p_name, '~ (=', p_name, '=) **x** snake_case_x a/b/c `*code*`')")
    found = [I.occurrences(rows, k).select("doc_id", F.lit(k).alias("kind"), "value") for _, k, _ in I.MARKS]
    return found[0].union(found[1]).union(found[2]).union(found[3]).union(found[4])


@query("SELECT p_partkey AS doc_id, k AS kind, p_name AS value FROM part, (VALUES ('strong'), ('emphasis'), ('underline'), ('strike'), ('highlight'), ('superscript'), ('subscript'), ('insert'), ('delete')) x(k)")
def i16_i17_i18_forced_spans(spark, sf):
    rows = texts(spark, sf, "part", "p_partkey", "concat(" + ", ".join(f"'x{{{d}', p_name, '{d}}}y '" for d, _, _ in I.FORCED) + ")")
    out = None
    for _, k, _ in I.FORCED:
        one = I.occurrences(rows, f"forced_{k}").select("doc_id", F.lit(k).alias("kind"), "value")
        out = one if out is None else out.union(one)
    return out


@query("SELECT p_partkey AS doc_id, o::INTEGER AS ord, CASE o WHEN 0 THEN p_name WHEN 1 THEN 'a`' || p_type ELSE ' ' END AS value FROM part, RANGE(2) r(o)")
def i5_code_spans(spark, sf):
    return I.code_spans(texts(spark, sf, "part", "p_partkey", "concat('x ` ', p_name, ' ` y ``a`', p_type, '`` z')")).select("doc_id", "ord", "value")


@query("""SELECT p_partkey AS doc_id, k AS kind, CASE k WHEN 'escape' THEN '*' WHEN 'raw_inline' THEN p_type WHEN 'footnote_ref' THEN 'n' || p_size WHEN 'symbol' THEN 'rocket' WHEN 'crossref' THEN 's-' || p_size ELSE p_name END AS value
FROM part, (VALUES ('escape'), ('raw_inline'), ('literal'), ('math'), ('display_math'), ('bold_italic'), ('editorial_comment'), ('inline_comment'), ('footnote_ref'), ('inline_footnote'), ('symbol'), ('crossref')) x(k)""")
def i2_i6_i7_i8_i14_i20_i21_i25_i27_i28_i30_constructs(spark, sf):
    text = r"concat('\\* `', p_type, '`{=html} !`', p_name, '` $`', p_name, '` $$`', p_name, '` /*', p_name, '*/ {#', p_name, '#} {%', p_name, '%} x[^n', p_size, '] ^[', p_name, '] :rocket: </#s-', p_size, '>')"
    rows, out = texts(spark, sf, "part", "p_partkey", text), None
    for k in ("escape", "raw_inline", "literal", "math", "display_math", "bold_italic", "editorial_comment", "inline_comment", "footnote_ref", "inline_footnote", "symbol", "crossref"):
        one = I.occurrences(rows, k).select("doc_id", F.lit(k).alias("kind"), "value")
        out = one if out is None else out.union(one)
    return out


@query("SELECT p_partkey AS doc_id, p_name AS old, p_type AS new FROM part")
def i19_substitution(spark, sf):
    rows = texts(spark, sf, "part", "p_partkey", "concat('x {~', p_name, '~>', p_type, '~} y')")
    return I.grouped(rows, I.CONSTRUCTS["substitution"][0], {"old": 1, "new": 2}).drop("ord")


@query("SELECT c_custkey AS doc_id, c_name AS label, 'https://x.example/' || c_custkey || '_(a)' AS href, c_mktsegment AS title, '{.k}' AS attributes FROM customer")
def i22_i40_links(spark, sf):
    rows = texts(spark, sf, "customer", "c_custkey", """concat('see [', c_name, '](https://x.example/', c_custkey, '_(a) "', c_mktsegment, '"){.k} not ![', c_name, '](i.png) `[a](b)`')""")
    return I.links(rows).select("doc_id", "label", "href", "title", "attributes")


@query("SELECT c_custkey AS doc_id, c_name AS alt, 'i' || c_custkey || '.png' AS src, c_mktsegment AS title FROM customer")
def i23_images(spark, sf):
    return I.images(texts(spark, sf, "customer", "c_custkey", """concat('![', c_name, '](i', c_custkey, '.png "', c_mktsegment, '") [a](b)')""")).drop("ord")


@query("SELECT c_custkey AS doc_id, 0 AS ord, 'https://x.example/' || c_custkey AS value FROM customer UNION ALL SELECT c_custkey, 1, 'c' || c_custkey || '@x.example' FROM customer")
def i24_autolinks(spark, sf):
    return I.occurrences(texts(spark, sf, "customer", "c_custkey", "concat('<https://x.example/', c_custkey, '> <c', c_custkey, '@x.example> <b>')"), "autolink").select("doc_id", "ord", "value")


@query("SELECT c_custkey AS doc_id, c_name AS content, '.k #' || c_custkey AS attributes FROM customer")
def i26_spans(spark, sf):
    return I.spans(texts(spark, sf, "customer", "c_custkey", "concat('a [', c_name, ']{.k #', c_custkey, '} b')")).drop("ord")


@query("SELECT c_custkey AS doc_id, 'term' AS name, c_name AS content FROM customer UNION ALL SELECT c_custkey, 'index', c_mktsegment FROM customer")
def i29_extensions(spark, sf):
    rows = texts(spark, sf, "customer", "c_custkey", "concat(':term[', c_name, '] and :index[', c_mktsegment, ']')")
    return I.grouped(rows, I.CONSTRUCTS["extension"][0], {"name": 1, "content": 2}).drop("ord")


@query("SELECT s_suppkey AS doc_id, 'mention' AS kind, LOWER(REPLACE(s_name, '#', '')) AS value FROM supplier UNION ALL SELECT s_suppkey, 'tag', 't' || s_suppkey FROM supplier")
def i31_mentions_and_tags(spark, sf):
    rows = texts(spark, sf, "supplier", "s_suppkey", "concat('hi @', lower(replace(s_name, '#', '')), ' a@b.example #t', s_suppkey, ' #12 &#38; x')")
    return I.occurrences(rows, "mention").select("doc_id", F.lit("mention").alias("kind"), "value").union(I.occurrences(rows, "tag").select("doc_id", F.lit("tag").alias("kind"), "value"))


@query("SELECT p_partkey AS doc_id, i AS item, CASE i WHEN 0 THEN 'see' ELSE '' END AS prefix, i = 1 AS suppressed, CASE i WHEN 0 THEN 'k' || p_size ELSE 'other' END AS key, CASE i WHEN 0 THEN 'p. ' || p_size ELSE '' END AS locator FROM part, RANGE(2) r(i)".replace("i AS item", "i::INTEGER AS item"))
def i32_citations(spark, sf):
    return I.citations(texts(spark, sf, "part", "p_partkey", "concat('x [see @k', p_size, ', p. ', p_size, '; -@other] y')")).drop("ord")


@query("SELECT p_partkey AS doc_id, COUNT(*)::BIGINT AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def i33_caption_numbers(spark, sf):
    rows = texts(spark, sf, "part", "p_partkey", "concat('Figure ', if(p_size % 2 = 0, '#', '#x'), ' ', p_name)")
    return I.occurrences(rows, "caption_number").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, p_name || '.mk' AS path, ' @lines:1-' || p_size || ' ' AS options FROM part".replace("p_name ||", "REPLACE(p_name, ' ', '-') ||"))
def i39_includes(spark, sf):
    rows = texts(spark, sf, "part", "p_partkey", "concat('a {{ ', replace(p_name, ' ', '-'), '.mk @lines:1-', p_size, ' }} b')")
    return I.grouped(rows, I.CONSTRUCTS["include"][0], {"path": 1, "options": 2}).drop("ord")


@query("SELECT p_partkey AS doc_id, p_name AS page, p_type AS display FROM part")
def x33_wikilinks(spark, sf):
    return I.grouped(texts(spark, sf, "part", "p_partkey", "concat('see [[', p_name, '|', p_type, ']] x')"), I.CONSTRUCTS["wikilink"][0], {"page": 1, "display": 2}).drop("ord")


@query("SELECT p_partkey AS doc_id, p_name AS base, p_type AS reading FROM part")
def r18_ruby(spark, sf):
    return I.grouped(texts(spark, sf, "part", "p_partkey", "concat('a {', p_name, '|', p_type, '} b')"), I.CONSTRUCTS["ruby"][0], {"base": 1, "reading": 2}).drop("ord")


@query("SELECT p_partkey AS doc_id, 'go 🚀 ' || p_name || ' :none: 12:30' AS text FROM part")
def i30_f28_symbols(spark, sf):
    rows = texts(spark, sf, "part", "p_partkey", "concat('go :rocket: ', p_name, ' :none: 12:30')")
    return rows.select("doc_id", I.expand_symbols("text", {"rocket": "🚀"}).alias("text"))


@query("SELECT n_nationkey::BIGINT AS doc_id, 0::INTEGER AS ord, 'NATION' AS label, n_name AS expansion FROM nation UNION ALL SELECT n_nationkey, 3, 'N' || n_nationkey, 'key' FROM nation")
def i38_j9_abbreviations(spark, sf):
    docs = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) doc_id", "concat('NATION xNATION y N', n_nationkey, '\n\n*[NATION]: ', n_name, '\n*[N', n_nationkey, ']: key') source")
    scanned = B.classify(B.scan(docs))
    keys = B.definitions(scanned).where("kind = 'abbreviation'")
    return I.abbreviations(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")), keys).select("doc_id", "ord", "label", "expansion")


@query("SELECT c_custkey AS doc_id, n::BIGINT AS node_id, t AS type, CASE n WHEN 1 THEN c_name || c_mktsegment WHEN 3 THEN c_name ELSE 'x' END AS text FROM customer, (VALUES (1, 'text'), (3, 'strong'), (4, 'text')) x(n, t)")
def i41_text_coalescing(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey doc_id", "inline(transform(sequence(1L, 4L), i -> struct(i, if(i = 3, 'strong', 'text'), element_at(array(c_name, c_mktsegment, c_name, 'x'), int(i))))) as (node_id, type, text)")
    return I.coalesce_text(rows)


@query("SELECT p_partkey AS doc_id, '<strong>' || p_name || '</strong> <em>' || p_type || '</em> <code>*a*</code> &amp; <a href=\"/p/' || p_partkey || '\">' || p_brand || '</a> <sup>2</sup> <img src=\"i.png\" alt=\"' || p_name || '\"> *b* <span class=\"math inline\" role=\"math\">\\(x\\)</span>' AS html FROM part")
def r13_r14_inline_html(spark, sf):
    text = r"concat('*', p_name, '* /', p_type, '/ `*a*` & [', p_brand, '](/p/', p_partkey, ') {^2^} ![', p_name, '](i.png) \\*b\\* $`x`')"
    return texts(spark, sf, "part", "p_partkey", text).select("doc_id", I.inline_html("text").alias("html"))


@query("SELECT p_partkey AS doc_id, p_name || '<br>' || CHR(10) || p_type || CHR(10) || p_brand AS html FROM part")
def i3_i4_breaks(spark, sf):
    return texts(spark, sf, "part", "p_partkey", r"concat(p_name, '\\', char(10), p_type, char(10), p_brand)").select("doc_id", I.inline_html("text").alias("html"))
