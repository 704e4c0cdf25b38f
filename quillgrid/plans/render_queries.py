"""Queries of renderers, importers, extensions and includes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions.text import slug
from quillgrid.operators import blocks as B
from quillgrid.operators import extensions as X
from quillgrid.operators import includes as N
from quillgrid.operators import inlines as I
from quillgrid.operators import render as R
from quillgrid.plans.base import markup, query, table
from quillgrid.sources import importers as M
from quillgrid.sources.shared import spread

PAGE = r"concat('# ', p_name, '\n\nA *', p_type, '* & b.\n\n- ', p_brand, '\n- [x] done\n\n---\n\n~~~ py\n1 < 2\n~~~\n\n> q\n\n|= k |\n| ', p_size, ' |')"


def pages(spark, sf):
    return B.parse(markup(spark, sf, "part", "p_partkey", PAGE))


NL = "' || CHR(10) || '"


def sql_text(text: str) -> str:
    """A SQL string expression: {col} stands for a column, a line end for CHR(10)."""
    import re

    out = "'" + text.replace("'", "''").replace("\n", NL) + "'"
    return re.sub(r"\{(p_\w+)\}", r"' || \1 || '", out)


@query("SELECT p_partkey AS doc_id, " + sql_text('<h1>{p_name}</h1>\n<p>A <strong>{p_type}</strong> &amp; b.</p>\n<ul>\n<li>{p_brand}</li>\n<li data-task-state="x"><input type="checkbox" checked disabled>done</li>\n</ul>\n<hr>\n<pre><code class="language-py">1 &lt; 2</code></pre>\n<blockquote>\n<p>q</p>\n</blockquote>\n<table>\n<tr><th scope="col">k</th></tr>\n<tr><td>{p_size}</td></tr>\n</table>') + " AS text FROM part")
def r1_r2_r3_r4_r5_r6_r10_r12_s19_html(spark, sf):
    return R.render(pages(spark, sf), "html")


@query("SELECT p_partkey AS doc_id, " + sql_text("# {p_name}\n\nA **{p_type}** & b.\n\n- {p_brand}\n- [x] done\n\n---\n\n```py\n1 < 2\n```\n\n> q\n\n| k |\n| --- |\n| {p_size} |") + " AS text FROM part")
def r23_s20_markdown(spark, sf):
    return R.render(pages(spark, sf), "markdown")


@query("SELECT p_partkey AS doc_id, " + sql_text("{p_name}\n\nA {p_type} & b.\n\n- {p_brand}\n- [x] done\n\n---\n\n1 < 2\n\nq\n\nk\n{p_size}") + " AS text FROM part")
def r25_s21_plain(spark, sf):
    return R.render(pages(spark, sf), "plain")


@query("SELECT p_partkey AS doc_id, CHR(27) || '[1m' || p_name || CHR(27) || '[0m' || CHR(10) || REPEAT('═', LENGTH(p_name)) || " + sql_text("\n\nA {p_type} & b.\n\n• {p_brand}\n• ☑ done\n\n") + " || REPEAT('─', 40) || CHR(10) || CHR(10) || CHR(27) || '[2m1 < 2' || CHR(27) || '[0m' || " + sql_text("\n\n│ q\n\n|= k |\n| {p_size} |") + " AS text FROM part")
def r26_s22_ansi(spark, sf):
    return R.render(pages(spark, sf), "ansi")


@query("SELECT p_partkey AS doc_id, " + sql_text("# {p_name}\n\nA *{p_type}* & b.\n\n- {p_brand}\n- [x] done\n\n---\n\n``` py\n1 < 2\n```\n\n> q\n\n") + " || '| ' || RPAD('= k', GREATEST(3, LENGTH(p_size::VARCHAR))::INTEGER, ' ') || ' |' || CHR(10) || '| ' || RPAD(p_size::VARCHAR, GREATEST(3, LENGTH(p_size::VARCHAR))::INTEGER, ' ') || ' |' AS text FROM part")
def r27_r28_s23_canonical(spark, sf):
    return R.render(pages(spark, sf), "canonical")


@query("SELECT p_partkey AS doc_id, true AS same FROM part")
def r27_r29_canonical_is_stable(spark, sf):
    """Formatting twice gives what formatting once gives."""
    once = R.render(pages(spark, sf), "canonical")
    twice = R.render(B.parse(once.withColumnRenamed("text", "source")), "canonical").withColumnRenamed("text", "again")
    return once.join(twice, "doc_id").select("doc_id", (F.col("text") == F.col("again")).alias("same"))


@query("SELECT p_partkey AS doc_id, " + sql_text('<section id="A">\n<h1>A</h1>\n<p>{p_name}</p>\n<section id="B">\n<h2>B</h2>\n</section>\n</section>\n<section id="C">\n<h1>C</h1>\n</section>') + " AS text FROM part")
def r3_w1_section_html(spark, sf):
    return R.sections_html(B.parse(markup(spark, sf, "part", "p_partkey", "concat('# A\n\n', p_name, '\n\n## B\n\n# C')")))


@query("SELECT p_partkey AS doc_id, " + sql_text("<dl>\n<dt>{p_name}</dt>\n<dd>{p_brand}</dd>\n<dd>{p_type}</dd>\n</dl>") + " AS text FROM part")
def r11_definition_list_html(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat(':: ', p_name, '\n: ', p_brand, '\n: ', p_type)")
    return R.definition_list_html(B.description_lists(B.classify(B.scan(docs))))


@query("SELECT p_partkey AS doc_id, " + sql_text('<section role="doc-endnotes">\n<hr>\n<ol>\n<li id="fn1"><p>{p_name} <a href="#fnref1" role="doc-backlink">↩</a> <a href="#fnref1-2" role="doc-backlink">↩</a></p></li>\n<li id="fn2"><p>{p_type} <a href="#fnref2" role="doc-backlink">↩</a></p></li>\n</ol>\n</section>') + " AS text FROM part")
def r16_a3_endnotes(spark, sf):
    scanned = B.classify(B.scan(markup(spark, sf, "part", "p_partkey", "concat('x[^b] y[^a] z[^b]\n\n[^a]: ', p_type, '\n[^b]: ', p_name)")))
    refs = I.occurrences(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")), "footnote_ref").select("doc_id", F.col("value").alias("label"), F.col("ord").alias("position"))
    return R.endnotes_html(refs, B.definitions(scanned))


@query("SELECT p_partkey AS doc_id, " + sql_text('<aside class="admonition note" aria-label="{p_name}">\n<p class="admonition-title">{p_name}</p>\n<p>{p_type}</p>\n</aside>') + " AS admonition, " + sql_text("<figure>\n<img src=\"a.png\" alt=\"{p_name}\">\n<figcaption>{p_type}</figcaption>\n</figure>") + " AS figure, " + sql_text('<a id="fnref{p_size}-2" href="#fn{p_size}" role="doc-noteref"><sup>{p_size}</sup></a>') + " AS note FROM part")
def r7_r9_r16_x1_elements(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        R.admonition_html(F.lit("note"), F.col("p_name"), F.col("p_type")).alias("admonition"),
        R.figure_html(F.concat(F.lit("!["), "p_name", F.lit("](a.png)")), F.col("p_type")).alias("figure"),
        R.note_reference_html(F.col("p_size"), F.lit(2)).alias("note"),
    )


@query("SELECT c AS code, (COUNT(*) * n)::BIGINT AS n FROM part, (VALUES ('raw-format-dropped', 1), ('table-span-flattened', 1), ('ruby-flattened', 1), ('editorial-comment-flattened', 1), ('destination-denied', 1), ('list-style-dropped', 1), ('list-delimiter-changed', 1), ('table-header-row-hoisted', 1), ('markdown-attributes-dropped', 1)) x(c, n) GROUP BY c, n")
def r30_a12_k_losses(spark, sf):
    text = "concat('```=html\n<b>', p_name, '</b>\n```\n\n| a | < |\n\n{漢|kan} {#note#} [x](javascript:y)\n\nb. z\n\n2) w\n\n{.k}\nend')"
    text = text.replace("b. z", "b)  z")
    return R.loss_counts(R.losses(B.parse(markup(spark, sf, "part", "p_partkey", text)), "markdown"))


@query("SELECT p_partkey AS doc_id, " + sql_text("*{p_name}* /{p_type}/ [x](/p/{p_partkey}) <u> ![](i.png) {^2^}\n\n```py\na\n```\n\n> q\n> r\n^ joe\n\n1. {p_brand}\n2. b\n\n|= h |\n| c |\n\nred\n") + " AS source FROM part")
def s12_m20_m21_m22_bbcode(spark, sf):
    text = "concat('[b]', p_name, '[/b] [i]', p_type, '[/i] [url=/p/', p_partkey, ']x[/url] [url]u[/url] [img]i.png[/img] [sup]2[/sup][code=py]\na\n[/code][quote=joe]q\nr[/quote][list=1][*]', p_brand, '[*]b[/list][table][tr][th]h[/th][/tr][tr][td]c[/td][/tr][/table][color=red]red[/color]')"
    return spread(table(spark, sf, "part").selectExpr("p_partkey doc_id", f"{text} source"), "doc_id").select("doc_id", M.bbcode("source").alias("source"))


@query("SELECT p_partkey AS doc_id, 'styling-dropped' AS code, 2::INTEGER AS n FROM part WHERE p_size % 2 = 0")
def m23_bbcode_losses(spark, sf):
    docs = table(spark, sf, "part").selectExpr("p_partkey doc_id", "if(p_size % 2 = 0, '[size=2][color=red]x', '[b]x') source")
    return M.bbcode_losses(docs)


@query("SELECT p_partkey AS doc_id, " + sql_text("# {p_name}\n\n## b\n\n*{p_type}* /x/ ~y~ `**z**` t <https://x.example/{p_partkey}>\n\n::: note\n{p_brand}\n:::\n\n---\n\n- a\n\n```\n**c**\n```") + " AS source FROM part")
def s10_m10_m11_m14_m16_markdown(spark, sf):
    text = "concat(p_name, '\n===\n\n## b ##\n\n**', p_type, '** *x* ~~y~~ `**z**` [t](javascript:1) https://x.example/', p_partkey, '\n\n> [!NOTE]\n> ', p_brand, '\n\n***\n\n* a\n\n```\n**c**\n```')"
    return spread(table(spark, sf, "part").selectExpr("p_partkey doc_id", f"{text} source"), "doc_id").select("doc_id", M.markdown("source").alias("source"))


@query("SELECT p_partkey AS doc_id, '/' || p_name || '/ x{^2^} h{,2,} *' || p_type || '*' AS source FROM part")
def s11_m17_djot(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey doc_id", "concat('_', p_name, '_ x^2^ h~2~ *', p_type, '*') source")
    return rows.select("doc_id", M.djot("source").alias("source"))


@query("SELECT p_partkey AS doc_id, c AS code FROM part, (VALUES ('list-style-normalized'), ('bullet-normalized')) x(c)")
def m18_djot_losses(spark, sf):
    return M.djot_losses(table(spark, sf, "part").selectExpr("p_partkey doc_id", "concat('a) x\n\n+ ', p_name) source"))


@query("SELECT p_partkey AS doc_id, " + sql_text("# {p_name}\n\n{*{p_type}*} [x](/a) y\\\nz & w\n\n- {p_brand}\n\n```py\n1 < 2\n```\n\n> q\n\n|= h |\n| c |\n").replace("{*", "{*").replace("*}", "*}") + " AS source FROM part")
def s9_m2_m3_m9_html(spark, sf):
    text = """concat('<!DOCTYPE html><html><head><title>t</title></head><body><script>x</script><!-- c --><h1>', p_name, '</h1><p><b>', p_type, '</b> <a href="/a">x</a> <a href="javascript:1">y</a><br>z &amp; w</p><ul><li>', p_brand, '</li></ul><pre><code class="language-py">1 &lt; 2</code></pre><blockquote><p>q</p></blockquote><table><tr><th>h</th></tr><tr><td>c</td></tr></table></body></html>')"""
    return spread(table(spark, sf, "part").selectExpr("p_partkey doc_id", f"{text} source"), "doc_id").select("doc_id", M.html("source").alias("source"))


@query("""SELECT page_id, LOWER(t) AS tag, COUNT(*)::BIGINT AS n FROM (SELECT page_id, UNNEST(REGEXP_EXTRACT_ALL(REGEXP_REPLACE(REGEXP_REPLACE(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<([A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM pages) GROUP BY ALL""")
def m2_m3_page_elements(spark, sf):
    return M.html_elements(table(spark, sf, "pages"))


@query("""SELECT page_id, 1::BIGINT AS headings, LEN(REGEXP_EXTRACT_ALL(html, '<li>'))::BIGINT AS items, false AS script_left FROM pages""")
def m9_pages_to_markup(spark, sf):
    """Every page's markup has its one heading and its list items, and nothing of its scripts."""
    pages_ = spread(table(spark, sf, "pages").select("page_id", "html"), "page_id").select("page_id", M.html("html").alias("source"))
    count = lambda p: F.regexp_count("source", F.lit(p)).cast("long")
    return pages_.select("page_id", count(r"(?m)^# ").alias("headings"), count(r"(?m)^- \[").alias("items"), F.col("source").contains("track(").alias("script_left"))


@query("SELECT page_id, c AS code, n::INTEGER AS n FROM (SELECT page_id, c, CASE c WHEN 'comment-dropped' THEN LEN(REGEXP_EXTRACT_ALL(html, '<!--')) ELSE LEN(REGEXP_EXTRACT_ALL(html, '<(script|style)')) END AS n FROM pages, (VALUES ('comment-dropped'), ('element-dropped')) x(c)) WHERE n > 0")
def m8_html_diagnostics(spark, sf):
    return M.html_diagnostics(table(spark, sf, "pages"))


@query("SELECT page_id AS doc_id, 0::BIGINT AS normalized, 0::BIGINT AS degraded, SUM(n)::BIGINT AS dropped FROM (SELECT page_id, LEN(REGEXP_EXTRACT_ALL(html, '<!--')) + LEN(REGEXP_EXTRACT_ALL(html, '<(script|style)')) AS n FROM pages) WHERE n > 0 GROUP BY page_id")
def a14_m25_fidelity(spark, sf):
    found = M.html_diagnostics(table(spark, sf, "pages")).withColumnRenamed("page_id", "doc_id")
    return M.fidelity(found, {"comment-dropped": "dropped", "element-dropped": "dropped", "destination-denied": "degraded"})


@query(r"SELECT p_partkey AS doc_id, '\*' || p_name || '\* \[x\] \# y' AS source FROM part".replace(r"\# y", "# y"))
def m24_escape_markup(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey doc_id", "concat('*', p_name, '* [x] # y') t")
    return rows.select("doc_id", M.escape_markup("t").alias("source"))


@query("SELECT p_partkey AS doc_id, LEAST(6, p_size % 6 + 3)::INTEGER AS level, p_size % 6 + 3 > 6 AS clamped, LOWER(REPLACE(p_name, ' ', '-')) || '-e' AS low, REPLACE(p_name, ' ', '-') || '-e' AS ascii, ' <a class=\"permalink\" href=\"#' || REPLACE(p_name, ' ', '-') || '\" aria-hidden=\"true\">¶</a>' AS permalink FROM part")
def x2_x3_x15_x17_headings(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey doc_id", "p_name", "p_size % 6 + 1 level")
    rows = X.shift_levels(rows, 2)
    return rows.select("doc_id", F.col("level").cast("int"), "clamped", X.lowercase_slug(F.concat("p_name", F.lit(" E"))).alias("low"), X.ascii_slug(F.concat("p_name", F.lit(" é"))).alias("ascii"), X.permalink(slug("p_name")).alias("permalink"))


@query("SELECT c_custkey AS doc_id, u AS url FROM customer, LATERAL (SELECT UNNEST(['https://x.example/' || c_custkey, 'c' || c_custkey || '@x.example']) AS u)")
def x4_autolinks(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey doc_id", "concat('see https://x.example/', c_custkey, '. or c', c_custkey, '@x.example, [a](https://y.example)') text")
    return X.autolinks(rows).select("doc_id", "url")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN ' target=\"_blank\" rel=\"noopener noreferrer\"' ELSE '' END AS external, '<a class=\"wikilink\" href=\"/wiki/' || REPLACE(p_name, ' ', '_') || '#f\">' || p_type || '</a>' AS wiki, '<span class=\"swatch\" style=\"background:#36c\"></span><code>#36c</code>' AS swatch, '<details>' || CHR(10) || '<summary>' || p_name || '</summary>' || CHR(10) || 'b' || CHR(10) || '</details>' AS details, '<pre class=\"mermaid\">a --&gt; b</pre>' AS diagram FROM part")
def x8_x10_x11_x12_x33_html(spark, sf):
    url = F.expr("if(p_size % 2 = 0, 'https://far.example/a', 'https://own.example/b')")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        X.external_attributes(url, ("own.example",)).alias("external"),
        X.wikilink_html(F.concat("p_name", F.lit("#f")), F.col("p_type")).alias("wiki"),
        X.swatch_html(F.lit("#36c")).alias("swatch"),
        X.details_html(F.col("p_name"), F.lit("b")).alias("details"),
        X.diagram_html(F.lit("mermaid"), F.lit("a --> b")).alias("diagram"),
    )


@query("SELECT p_partkey AS doc_id, 'data:image/svg+xml;base64,' || TO_BASE64(ENCODE('<svg><path id=\"a\"/><use href=\"#a\"/>' || p_name || '</svg>')) AS uri, '«' || p_name || '» x' AS spanish, '<span class=\"spoiler\" tabindex=\"0\">' || p_name || '</span>' AS spoiler, 'class,id' AS keys FROM part")
def x9_x19_x27_x28_p17_misc(spark, sf):
    svg = F.concat(F.lit('<svg onload="x()"><script>1</script><path id="a"/><use href="#a"/>'), "p_name", F.lit("</svg>"))
    attrs = X.default_attributes(F.create_map(F.lit("id"), F.col("p_name")), {"class": "k", "id": "none"})
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), X.svg_data_uri(svg).alias("uri"), X.locale_quotes(F.concat(F.lit('"'), "p_name", F.lit('" x')), "es").alias("spanish"), X.spoiler_html(F.col("p_name")).alias("spoiler"),
        F.array_join(F.sort_array(F.map_keys(attrs)), ",").alias("keys"),
    )


@query("SELECT p_partkey AS doc_id, n::VARCHAR AS n, n::INTEGER AS line, CASE n WHEN 1 THEN p_name ELSE p_type END AS text FROM part, (VALUES (1), (2)) x(n)")
def x6_callouts(spark, sf):
    rows = B.parse(markup(spark, sf, "part", "p_partkey", "concat('```\na <1>\nb <2>\n```\n\n1. ', p_name, '\n2. ', p_type)"))
    return X.callouts(rows).select("doc_id", "n", F.col("line").cast("int"), "text")


@query("SELECT p_partkey AS doc_id, t::INTEGER AS tab, CASE t WHEN 1 THEN p_name ELSE 'py' END AS title FROM part, (VALUES (1), (2)) x(t)")
def x7_x32_code_groups(spark, sf):
    rows = B.parse(markup(spark, sf, "part", "p_partkey", "concat('``` sh [', p_name, ']\na\n```\n``` py\nb\n```\n\nx\n\n```\nc\n```')"))
    return X.code_groups(rows).select("doc_id", F.col("tab").cast("int"), "title")


@query("""SELECT p_partkey AS doc_id, r::INTEGER AS "row", c::INTEGER AS col, CASE c WHEN 1 THEN p_name ELSE p_type END || r AS text FROM part, (VALUES (1), (2)) x(r), (VALUES (1), (2)) y(c)""")
def x22_m5_list_table(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('- a\n  - ', p_name, '1\n  - ', p_type, '1\n- b\n  - ', p_name, '2\n  - ', p_type, '2')")
    return X.list_table(B.list_items(B.classify(B.scan(docs)))).select("doc_id", F.col("row").cast("int"), F.col("col").cast("int"), "text")


@query("SELECT p_partkey AS doc_id, " + sql_text("- [{p_name}](#x)\n  - [{p_type}](#x)") + " AS toc FROM part")
def a8_x30_x31_contents(spark, sf):
    heads = B.headings(B.classify(B.scan(markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\n## ', p_type, '\n\n#### z')"))))
    return X.table_of_contents(heads.withColumn("id", F.lit("x")))


@query("SELECT p_partkey AS doc_id, CASE WHEN i = 0 THEN REPLACE(p_name, ' ', '-') ELSE 'z' END AS slug, CASE WHEN i = 0 THEN p_name ELSE 'z' END AS term, CASE WHEN i = 0 THEN '0,2' ELSE '1' END AS places FROM part, (VALUES (0), (1)) x(i)")
def a7_o4_x20_index(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey doc_id", "concat(':index[', p_name, '] :index[z] :index[', p_name, ']') text")
    return X.index_list(I.grouped(rows, I.CONSTRUCTS["extension"][0], {"value": 2}))


@query("SELECT p_partkey AS doc_id, p_name AS value, CASE WHEN p_size % 2 = 0 THEN p_type END AS description FROM part")
def a9_j15_x14_glossary(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('see :term[', p_name, ']\n\n:: ', if(p_size % 2 = 0, p_name, 'other'), '\n: ', p_type)")
    scanned = B.classify(B.scan(docs))
    uses = I.grouped(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")), I.CONSTRUCTS["extension"][0], {"value": 2})
    return X.glossary(uses, B.description_lists(scanned)).select("doc_id", "value", "description")


@query("SELECT p_partkey AS doc_id, 'x (' || p_name || ') y[^b]' AS text FROM part")
def x21_x34_notes_to_parentheses(spark, sf):
    scanned = B.classify(B.scan(markup(spark, sf, "part", "p_partkey", "concat('x[^a] y[^b]\n\n[^a]: ', p_name)")))
    return X.notes_to_parentheses(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")), B.definitions(scanned))


@query("SELECT p_partkey AS doc_id, '{\"type\":\"doc\",\"content\":[{\"type\":\"heading\",\"attrs\":{\"level\":2},\"content\":[{\"type\":\"text\",\"text\":\"' || p_name || '\"}]},{\"type\":\"paragraph\",\"content\":[{\"type\":\"text\",\"text\":\"' || p_type || '\"}]}]}' AS json FROM part")
def s14_j20_editor_json(spark, sf):
    from quillgrid.plans.reference_queries import flat_nodes

    return X.to_editor_json(flat_nodes(spark, sf))


@query("SELECT p_partkey AS doc_id, '## ' || p_name || CHR(10) || CHR(10) || p_type AS source FROM part")
def s13_editor_round_trip(spark, sf):
    from quillgrid.plans.reference_queries import flat_nodes

    return X.from_editor_json(X.to_editor_json(flat_nodes(spark, sf)))


@query("SELECT p_partkey AS doc_id, 'comment' AS type, 1::BIGINT AS n FROM part")
def a15_editor_losses(spark, sf):
    return X.editor_losses(B.parse(markup(spark, sf, "part", "p_partkey", "concat(p_name, '\n\n%% hidden')")))


def include_files(spark, sf):
    return table(spark, sf, "nation").selectExpr("concat('n', n_nationkey, '.mk') path", "if(n_nationkey % 5 = 4, concat('# ', n_name), concat('# ', n_name, '\nl2\n{{ n', n_nationkey + 1, '.mk }}')) content")


@query("SELECT n_nationkey::BIGINT AS doc_id, STRING_AGG('# NATION_' || k || CASE WHEN k % 5 = 4 THEN '' ELSE CHR(10) || 'l2' END, CHR(10) ORDER BY k) AS source FROM (SELECT n_nationkey, UNNEST(RANGE(n_nationkey, (n_nationkey // 5) * 5 + 5)) AS k FROM nation) GROUP BY n_nationkey")
def j11_n3_n4_includes(spark, sf):
    docs = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) doc_id", "concat('{{ n', n_nationkey, '.mk }}') source")
    return N.expand(docs, include_files(spark, sf)).select("doc_id", "source")


@query("SELECT n_nationkey::BIGINT AS doc_id, '[' || n_name || '] [' || n_name || '] ' || n_name || n_name || ' {{ gone }} A{{ up }}' AS source FROM nation")
def j11_u9_repeated_includes(spark, sf):
    """Siblings and repeats expand, one file inside another too; what is missing or a cycle stays as text."""
    files = table(spark, sf, "nation").selectExpr("concat('x', n_nationkey) path", "n_name content").unionAll(
        table(spark, sf, "nation").selectExpr("concat('box', n_nationkey) path", "concat('[{{ x', n_nationkey, ' }}]') content")
    ).unionAll(table(spark, sf, "region").where("r_regionkey = 0").selectExpr("'up' path", "'A{{ up }}' content"))
    text = "concat('{{ box', k, ' }} {{ box', k, ' }} {{ x', k, ' }}{{ x', k, ' }} {{ gone }} {{ up }}')".replace("k", "n_nationkey")
    docs = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) doc_id", f"{text} source")
    return N.expand(docs, files)


@query("SELECT n_nationkey::BIGINT AS doc_id, r AS rule, n::BIGINT AS n FROM nation, (VALUES ('include-cycle', 2), ('include-depth', 1), ('include-budget', 1), ('include-unresolved', 1)) x(r, n)")
def n1_n3_n4_n5_refusals(spark, sf):
    """Cycles, nesting and bytes past their bounds, and missing files, each refused in its place."""
    files = [("a", "A{{ b }}"), ("b", "B{{ a }}"), *((f"d{i}", f"{i}{{{{ d{i + 1} }}}}") for i in range(6)), ("big", "x" * 400)]
    docs = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) doc_id", "concat('{{ a }}{{ b }}{{ d0 }}{{ big }}{{ big }}{{ gone', n_nationkey, ' }}') source")
    found = N.refusals(docs, spark.createDataFrame(files, "path string, content string"), depth=3, budget=700)
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::BIGINT AS doc_id, 'include-non-text' AS rule FROM nation WHERE n_nationkey % 2 = 0")
def n2_include_non_text(spark, sf):
    files = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) path", "if(n_nationkey % 2 = 0, null, n_name) content", "n_nationkey % 2 = 0 binary")
    docs = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) doc_id", "concat('{{ n', n_nationkey, ' }}') source")
    return N.warnings(N.directives(docs), files).select("doc_id", "rule")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN '1. ' || p_name || CHR(10) || '   - {/' || p_type || '/}' || CHR(10) || '     3. c' || CHR(10) || '2. \\*' || p_brand || '*' || CHR(10) || CHR(10) || '> ' || p_name || CHR(10) || '>' || CHR(10) || '> - x' || CHR(10) ELSE '|= h |= ' || p_name || ' | < |' || CHR(10) || '| 1 | 2 | € |' || CHR(10) || '| ^ | [l](/q) | ' || p_size || ' |' || CHR(10) END AS source FROM part")
def m1_m2_m3_m9_nested_html(spark, sf):
    """Lists in lists, blocks in quotes, spans in tables, single-quoted and missing ends, entities and literal marks."""
    page = """if(p_partkey % 2 = 0, concat('<ol><li>', p_name, '<ul><li><i>', p_type, '</i><ol start=3><li>c</ol></ul><li>*', p_brand, '*</ol><blockquote><p>', p_name, '<ul><li>x</ul></blockquote>'),
      concat('<table><tr><th>h<th colspan=2>', p_name, '<tr><td rowspan=2>1<td>2<td>&#8364;<tr><td><a href=\\'/q\\'>l</a><td>', p_size, '</table>'))"""
    return spread(table(spark, sf, "part").selectExpr("p_partkey doc_id", f"{page} html"), "doc_id").select("doc_id", M.html("html").alias("source"))


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN '<svg><g></g></svg>' WHEN 1 THEN '<svg><rect stroke=\"url(#s)\"/></svg>' ELSE '<svg viewBox=\"0 0 1 1\"><text>' || p_name || ' &lt; b</text></svg>' END AS svg FROM part")
def p17_x19_svg_payloads(spark, sf):
    from quillgrid.functions.svg import clean_svg

    text = """case p_partkey % 3 when 0 then '<svg><g onload=alert(1)><script>1</script><foreignObject>x</foreignObject></g></svg>'
      when 1 then '<svg><rect fill="url(http://e)" stroke="url(#s)" style="x"/><a href="java&#115;cript:1">t</a></svg>'
      else concat('<svg viewBox="0 0 1 1"><text>', p_name, ' &lt; b') end"""
    return table(spark, sf, "part").selectExpr("p_partkey doc_id", f"{text} s").select("doc_id", clean_svg("s").alias("svg"))


@query("SELECT c AS code, COUNT(*)::BIGINT AS n FROM part, (VALUES ('table-header-row-demoted', 0), ('table-header-cell-demoted', 1), ('table-header-row-hoisted', 1)) x(c, k) WHERE p_partkey % 2 = k GROUP BY c")
def k10_k11_k12_header_losses(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat(if(p_partkey % 2 = 0, '|= a |\n|= b |\n| ', '| a |= b |\n| '), p_name, if(p_partkey % 2 = 0, ' |', ' | c |'))")
    return R.loss_counts(R.losses(B.parse(docs), "markdown"))


@query("SELECT n_nationkey::BIGINT AS doc_id, '## ' || n_name || CHR(10) || 'l2' AS source FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT n_nationkey, '## ' || n_name FROM nation WHERE n_nationkey % 5 = 4")
def j12_include_selectors(spark, sf):
    docs = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) doc_id", "concat('{{ n', n_nationkey, '.mk @lines:1-2 @shift:1 }}') source")
    return N.expand(docs, include_files(spark, sf)).select("doc_id", "source")


@query("SELECT 'n' || n_nationkey AS root, COUNT(*)::BIGINT AS reached, COUNT(*) > 0 AS cyclic FROM (SELECT n_nationkey, UNNEST(RANGE(5)) FROM nation) GROUP BY n_nationkey")
def j11_n3_include_cycles(spark, sf):
    """Rings of five files: each walk meets its root again on the fifth step."""
    rows = table(spark, sf, "nation")
    edges = rows.selectExpr("concat('n', n_nationkey) src", "concat('n', int(n_nationkey / 5) * 5 + (n_nationkey + 1) % 5) dst")
    walked = N.chains(edges, rows.selectExpr("concat('n', n_nationkey) src"))
    return walked.groupBy("root").agg(F.count("*").alias("reached"), F.max("cycle").alias("cyclic"))


@query("SELECT n_nationkey::BIGINT AS doc_id, r AS rule FROM nation, (VALUES ('include-unresolved'), ('include-lines-invalid'), ('include-lines-out-of-range'), ('include-unknown-option'), ('include-duplicate-option'), ('include-selection-conflict'), ('include-heading-clamp'), ('include-section'), ('include-region-invalid'), ('include-call-limit')) x(r)")
def n_include_warnings(spark, sf):
    text = "concat('{{ gone.mk }} {{ n0.mk @lines:x }} {{ n0.mk @lines:90-91 }} {{ n0.mk @odd:1 }} {{ n0.mk @shift:1 @shift:2 }} {{ n0.mk#NATION-0 @lines:1-1 }} {{ n0.mk @shift:6 }} {{ n0.mk#nope }} {{ n0.mk @region:r }} {{ n', n_nationkey, '.mk }}')"
    docs = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) doc_id", f"{text} source")
    return N.warnings(N.directives(docs), include_files(spark, sf), calls=9).select("doc_id", "rule").distinct()


@query("SELECT n_nationkey::BIGINT AS doc_id, 1::BIGINT AS line FROM nation WHERE n_nationkey % 2 = 0")
def n8_code_in_paragraph(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat(if(n_nationkey % 2 = 0, 'see ', ''), '{{ a.py @code:py }}')")
    return N.code_in_paragraph(B.classify(B.scan(docs))).select("doc_id", F.col("line").cast("long"))
