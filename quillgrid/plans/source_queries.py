"""Queries of sources, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import blocks as B
from quillgrid.plans.base import markup, query, table
from quillgrid.sources import text as S


@query("SELECT doc_id, (i)::BIGINT AS line_no, l AS line FROM (SELECT doc_id, STRING_SPLIT(text, CHR(10)) AS a FROM documents), UNNEST(a) WITH ORDINALITY AS u(l, i)")
def s4_lines(spark, sf):
    """Line rows of documents, carriage returns and a byte order mark put in first."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("source"))
    return B.lines(docs).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("SELECT p_partkey AS doc_id, p_name || '�' || p_brand AS repaired FROM part")
def s3_repair(spark, sf):
    bad = F.concat(F.encode("p_name", "UTF-8"), F.lit(bytearray(b"\xff")), F.encode("p_brand", "UTF-8"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), T.repair_utf8(bad).alias("repaired"))


@query("SELECT p_partkey AS doc_id, 'json' AS format, '{\"name\": \"' || p_name || '\"}' AS content, '# ' || p_type AS body FROM part")
def s16_frontmatter(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", """concat('---json\n{"name": "', p_name, '"}\n---\n# ', p_type)""")
    return S.frontmatter(docs)


@query("SELECT p_partkey AS doc_id, 'name' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part")
def s16_frontmatter_pairs(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", """if(p_partkey % 2 = 0, concat('---json\n{"name": "', p_name, '", "size": "', p_size, '"}\n---\nx'), concat('---\nname: "', p_name, '"\nsize: ', p_size, '\n---\nx'))""")
    return S.frontmatter_pairs(S.frontmatter(docs))


@query("""SELECT p_partkey AS doc_id, 1 AS record, f AS field, v AS value FROM part, (VALUES (1, 'name'), (2, 'size')) h(f, v)
UNION ALL SELECT p_partkey, 2, 1, p_name || ', "' || p_brand || '"' FROM part UNION ALL SELECT p_partkey, 2, 2, p_size::VARCHAR FROM part""")
def s15_delimited_table(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "replace(concat('text\n\n```csv table\nname,size\n@', p_name, ', @@', p_brand, '@@@,', p_size, '\n```\n\n```csv table\na@b,c\n```'), '@', char(34))")
    return S.delimited_records(B.parse(docs)).select("doc_id", F.col("record").cast("int"), F.col("field").cast("int"), "value")


@query("""WITH l AS (SELECT doc_id, i, u.l FROM (SELECT doc_id, STRING_SPLIT(text, CHR(10)) AS a FROM documents), UNNEST(a) WITH ORDINALITY AS u(l, i))
SELECT doc_id, i::BIGINT AS line_no,
  COALESCE(SUM(OCTET_LENGTH(ENCODE(l)) + 1) OVER w, 0)::BIGINT AS byte_offset, COALESCE(SUM(LENGTH(l) + 1) OVER w, 0)::BIGINT AS char_offset
FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w10_offsets(spark, sf):
    rows = S.line_offsets(B.lines(table(spark, sf, "documents").selectExpr("doc_id", "text source")))
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("line_no", "byte_offset", "char_offset")])


@query("""SELECT doc_id, c::INTEGER AS chunk_no, SUBSTR(text, (c * 1024 + 1)::BIGINT, 1024) AS chunk
FROM (SELECT doc_id, text, UNNEST(RANGE(0, CEIL(LENGTH(text) / 1024)::BIGINT)) AS c FROM documents WHERE LENGTH(text) > 0)""")
def s24_chunks(spark, sf):
    return S.chunks(table(spark, sf, "documents").select("doc_id", "text"))


@query("""SELECT 'd' || n_nationkey || '.mk' AS path, 'missing.mk' AS target FROM nation WHERE n_nationkey % 5 = 0""")
def s17_migrate_links(spark, sf):
    link = "if(n_nationkey % 5 = 0, 'missing', concat('d', (n_nationkey + 1) % 25))"
    files = table(spark, sf, "nation").selectExpr("concat('d', n_nationkey, '.md') path", f"concat('see [x](', {link}, '.md#a) and [y](https://x.example/a.md)') source")
    return S.broken_links(S.migrate(files, lambda c: c))


@query("""SELECT doc_id, REPLACE(REPLACE(REPLACE(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS attribute FROM
(SELECT doc_id, text || ' <b>"''' AS text FROM documents)""")
def f8_f9_f10_escapes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" <b>\"'")).alias("text"))
    return docs.select("doc_id", T.escape_html("text").alias("html"), T.escape_attribute("text").alias("attribute"))


@query("""SELECT doc_id, CASE WHEN s = '' THEN 's' WHEN REGEXP_MATCHES(s, '^[0-9]') THEN 's-' || s ELSE s END AS slug,
LOWER(s) AS lower_slug FROM (SELECT doc_id, REGEXP_REPLACE(REGEXP_REPLACE(STRING_SPLIT(text, CHR(10))[1], '[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)""")
def f1_f3_slugs(spark, sf):
    first = F.split("text", "\n")[0]
    return table(spark, sf, "documents").select("doc_id", T.slug(first).alias("slug"), F.lower(F.regexp_replace(T.slug(first), "^s-(?=[0-9])|^s$", "")).alias("lower_slug"))


@query("""SELECT doc_id, TRANSLATE(REPLACE(text, 'ß', 'ss'), 'áâàäçèéêëíìîïñóòôöúùûüÄÇÉÈÊÍÑÓÖÚÜÁÀÂËÎÏÔÛÙ', 'aaaaceeeeiiiinoooouuuuACEEEINOOUUAAAEIIOUU') AS folded FROM documents""")
def f4_ascii_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.ascii_fold("text").alias("folded"))


@query("""SELECT p_partkey AS doc_id, '"' || p_name || '" -- ' || p_type || '... (tm)' AS plain FROM part""")
def f2_detypography(spark, sf):
    glyphs = F.expr("concat('“', p_name, '” – ', p_type, '… ™')")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), T.detypography(glyphs).alias("plain"))


@query("SELECT p_partkey AS doc_id, p_name || 'a' AS bidi, p_name || p_brand AS id_source, p_name || 'b' AS controls FROM part")
def f6_f7_strip(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        T.strip_bidi(F.concat("p_name", F.lit("‮⁦a"))).alias("bidi"),
        T.id_source(F.concat("p_name", F.lit("​‎"), "p_brand")).alias("id_source"),
        T.strip_controls(F.concat("p_name", F.lit("\r\u0085‪b"))).alias("controls"),
    )


@query("SELECT p_partkey AS doc_id, REPEAT('`', GREATEST(3, p_size % 7 + 1)) AS fence FROM part")
def f11_safe_fence(spark, sf):
    content = F.concat("p_name", F.lit(" "), F.repeat(F.lit("`"), F.col("p_size") % 7), F.lit(" x `"))
    return table(spark, sf, "part").where("true").select(F.col("p_partkey").alias("doc_id"), T.safe_fence(F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(content)).alias("fence"))


@query("SELECT p_partkey AS doc_id, p_name || ' ' || p_brand AS label, 'javascript' AS scheme, (p_size % 4 + 4)::INTEGER AS columns FROM part")
def f15_f18_f19_keys(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        T.label_key(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", F.lit(" "))).alias("label"),
        T.url_scheme(F.concat(F.lit(" java\tscript:"), "p_name")).alias("scheme"),
        T.leading_columns(F.concat(F.repeat(F.lit(" "), F.col("p_size") % 4), F.lit("\t"), F.repeat(F.lit(" "), F.col("p_size") % 4), "p_name")).alias("columns"),
    )


@query("SELECT p_partkey AS doc_id, 'i' || p_partkey AS id, 'c' || p_size || ' d' AS classes, p_name AS title, 'v' || p_size AS k, ' title=\"' || p_name || '\"' AS rendered FROM part")
def f16_f17_attributes(spark, sf):
    block = F.expr("""concat('{#i', p_partkey, ' .c', p_size, ' title="', p_name, '" k=v', p_size, ' .d}')""")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), T.attributes(block).alias("a"))
    shown = F.map_filter("a.pairs", lambda k, v: k != "k")
    shown = T.render_attributes(F.map_concat(shown, F.create_map(F.lit("onclick"), F.lit("x()"))))
    return rows.select("doc_id", "a.id", F.array_join("a.classes", " ").alias("classes"), F.element_at("a.pairs", "title").alias("title"), F.element_at("a.pairs", "k").alias("k"), shown.alias("rendered"))


@query("""WITH RECURSIVE r(n, s, left_n) AS (
  SELECT n::INTEGER, '', n::INTEGER FROM (SELECT DISTINCT p_size AS n FROM part)
  UNION ALL
  SELECT n, s || t.sym, left_n - t.v FROM r, LATERAL (SELECT v, sym FROM (VALUES (50,'l'),(40,'xl'),(10,'x'),(9,'ix'),(5,'v'),(4,'iv'),(1,'i')) x(v, sym) WHERE v <= left_n ORDER BY v DESC LIMIT 1) t WHERE left_n > 0)
SELECT p_partkey AS doc_id, p_size AS value FROM part JOIN r ON n = p_size AND left_n = 0""")
def b14_roman(spark, sf):
    """Roman numerals written by repeated subtraction, read back."""
    tens = "element_at(array('', 'x', 'xx', 'xxx', 'xl', 'l'), int(p_size / 10) + 1)"
    ones = "element_at(array('', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'), p_size % 10 + 1)"
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), T.roman_value(F.expr(f"concat({tens}, {ones})")).alias("value"))


@query("""SELECT p_partkey AS doc_id, p_name || '—' || p_brand || ' –– ' || p_type || '—–x --' || p_size AS dashes,
'“' || p_name || '” it’s' AS quotes, p_name || ' → ' || p_brand || ' ≤ ≥ ≠ ± ™ ⇒ ↔' AS symbols, p_name || '…' AS ellipsis FROM part""")
def i34_i35_i36_i37_typography(spark, sf):
    c = F.expr
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        T.smart_dashes(c("concat(p_name, '---', p_brand, ' ---- ', p_type, '-----x --', p_size)")).alias("dashes"),
        T.smart_quotes(c("""concat('"', p_name, '" it', "'", 's')""")).alias("quotes"),
        T.smart_symbols(c("concat(p_name, ' --> ', p_brand, ' <= >= != +- (tm) ==> <-->')")).alias("symbols"),
        T.ellipsis(c("concat(p_name, '...')")).alias("ellipsis"),
    )


@query("SELECT p_partkey AS doc_id, LOWER(REPLACE(p_name, ' ', '-')) || '-' || LOWER(REPLACE(p_brand, '#', '')) AS gfm, CHR(27) || '[1m' || p_name || CHR(27) || '[0m' AS ansi, TRANSLATE(p_size::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS sup, TRANSLATE(p_size::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS sub FROM part")
def f22_f23_f25_terminal(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        T.gfm_slug(F.concat_ws(" ", "p_name", "p_brand")).alias("gfm"),
        T.ansi("p_name", "1").alias("ansi"),
        T.superscript(F.col("p_size").cast("string")).alias("sup"),
        T.subscript(F.col("p_size").cast("string")).alias("sub"),
    )


@query("SELECT p_partkey AS doc_id, p_size::DOUBLE / 100 AS fraction, '\\(' || p_name || '\\)' AS inline_math, '\\[' || p_name || '\\]' AS display_math, '0.' || p_size AS version, '/children/' || p_size || '/x' AS pointer, REPLACE(p_name, ' ', '    ') AS tabs, LENGTH(p_name) + 4 AS width FROM part")
def f12_f21_f24_f27_f29_misc(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        T.percent_fraction(F.concat(F.col("p_size").cast("string"), F.lit("%"))).cast("double").alias("fraction"),
        T.math_markers("p_name", F.lit(False)).alias("inline_math"),
        T.math_markers("p_name", F.lit(True)).alias("display_math"),
        T.stamp_version(F.concat(F.lit("# a\n%% markup-version: 0."), "p_size", F.lit("; generated-by: x\n"))).alias("version"),
        T.json_pointer(F.lit("children"), F.col("p_size"), F.lit("x")).alias("pointer"),
        T.expand_tabs(F.replace("p_name", F.lit(" "), F.lit("\t"))).alias("tabs"),
        T.display_width(F.concat("p_name", F.lit("漢字"))).cast("long").alias("width"),
    )


@query("SELECT h AS fingerprint, COUNT(*)::BIGINT AS n FROM (SELECT CASE WHEN r_regionkey = 0 THEN 'cbf29ce484222325' WHEN r_regionkey = 1 THEN 'af63dc4c8601ec8c' WHEN r_regionkey = 2 THEN '85944171f73967e8' ELSE 'a430d84680aabd0b' END AS h FROM region) GROUP BY h")
def f26_fingerprint(spark, sf):
    """FNV-1a of published test vectors: the empty text, a, foobar, hello."""
    text = F.element_at(F.array(F.lit(""), F.lit("a"), F.lit("foobar"), F.lit("hello"), F.lit("hello")), F.col("r_regionkey") + 1)
    return table(spark, sf, "region").select(T.fnv1a(text).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n"))
