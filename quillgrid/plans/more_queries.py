"""Further queries: table details, generated lists, options, hooks, editor tools and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import blocks as B
from quillgrid.operators import extensions as X
from quillgrid.operators import inlines as I
from quillgrid.operators import references as J
from quillgrid.operators import render as R
from quillgrid.operators import tree
from quillgrid.operators import windows as W
from quillgrid.plans.base import markup, query, table
from quillgrid.plans.reference_queries import trees
from quillgrid.sources import importers as M
from quillgrid.sources.shared import spread


@query("""SELECT p_partkey AS doc_id, r::INTEGER AS "row", c::INTEGER AS col, CASE WHEN r = 1 THEN 'h' WHEN c = 1 THEN p_name || ' ' || p_type ELSE 'x' END AS text, CASE r WHEN 1 THEN 'head' ELSE 'foot' END AS section FROM part, (VALUES (1), (2)) x(r), (VALUES (1), (2)) y(c)""")
def b27_b30_continued_rows(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('| h | h |\n| ', p_name, ' | x |\n+ ', p_type, ' |  |')")
    cells = B.table_sections(B.table_cells(B.parse(docs)), 1, 1)
    return cells.select("doc_id", F.col("row").cast("int"), F.col("col").cast("int"), "text", "section")


@query("SELECT p_partkey AS doc_id, c::INTEGER AS col, CASE c WHEN 1 THEN LENGTH(p_name) ELSE GREATEST(4, LENGTH(p_size::VARCHAR)) END::BIGINT AS width, 2::INTEGER AS arity FROM part, (VALUES (1), (2)) y(c)")
def a10_a11_column_widths(spark, sf):
    cells = B.table_cells(B.parse(markup(spark, sf, "part", "p_partkey", "concat('| ', p_name, ' | 漢字 |\n| a | ', p_size, ' |')")))
    return B.column_widths(cells).select("doc_id", F.col("col").cast("int"), F.col("width").cast("long"), F.col("arity").cast("int"))


@query("SELECT p_partkey AS doc_id, p_name AS alt, 'i' || p_partkey || '.png' AS src FROM part")
def b37_block_images(spark, sf):
    return B.block_images(B.parse(markup(spark, sf, "part", "p_partkey", "concat('![', p_name, '](i', p_partkey, '.png)\n\nx ![a](b)')"))).drop("node_id")


@query("SELECT p_partkey AS doc_id, 'paragraph' AS type, p_name AS text FROM part")
def b18_attached_blocks(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('- a\n+\n', p_name, '\n\nfree')")
    return B.attached_blocks(B.parse(docs)).select("doc_id", "type", "text")


@query("SELECT p_partkey AS doc_id, l::BIGINT AS line_no, f AS form FROM part, (VALUES (1, 'heading'), (2, 'blank'), (3, 'code'), (4, 'code'), (5, 'code'), (6, 'text'), (7, 'aside')) x(l, f)")
def b2_b40_u1_decisions(spark, sf):
    """The form that decided each line, with a form of the user's own."""
    docs = markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\n```\n# x\n```\n', p_type, '\n!! mine')")
    return B.decisions(B.classify(B.scan(docs), (("aside", r"^!! "),))).select("doc_id", F.col("line_no").cast("long"), "form")


@query("SELECT p_partkey AS doc_id, COUNT(*)::BIGINT AS n, 200::INTEGER AS deepest FROM part GROUP BY 1")
def b39_depth_cap(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat(repeat('> ', 230), p_name)")
    return B.quotes(B.classify(B.scan(docs))).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("depth").cast("int").alias("deepest"))


@query("SELECT p_partkey AS doc_id, n::INTEGER AS node_id, CASE WHEN n <= 3 THEN 1 ELSE 4 END::INTEGER AS ancestor FROM part, (VALUES (2), (3), (5), (6)) x(n)")
def j10_ancestors(spark, sf):
    nodes = trees(spark, sf)
    return J.within(nodes, nodes.where("depth = 1")).select("doc_id", "node_id", "ancestor")


@query("SELECT p_partkey AS doc_id, p_name AS page, 'd' AS display, REPLACE(p_name, ' ', '-') AS id FROM part")
def j16_x18_heading_references(spark, sf):
    scanned = B.classify(B.scan(markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\nsee [[', p_name, '|d]]\n\n# ', p_name)")))
    heads = W.unique_ids(B.headings(scanned).withColumn("slug", T.slug("title"))).groupBy("doc_id", F.col("title").alias("page")).agg(F.min_by("id", "line_no").alias("id"))
    refs = I.grouped(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")), I.CONSTRUCTS["wikilink"][0], {"page": 1, "display": 2})
    return refs.join(heads, ["doc_id", "page"], "left").select("doc_id", "page", "display", "id")


@query("SELECT p_size::BIGINT AS doc_id, STRING_AGG(DISTINCT REPLACE(p_name, ' ', '_'), '; ' ORDER BY REPLACE(p_name, ' ', '_')) AS bibliography FROM part GROUP BY p_size")
def a6_o1_o3_x5_bibliography(spark, sf):
    """Distinct cited keys of a document in byte order."""
    rows = table(spark, sf, "part").selectExpr("cast(p_size as bigint) doc_id", "concat('x [@', replace(p_name, ' ', '_'), ', p. 1]') text")
    keys = I.citations(rows).select("doc_id", "key").distinct()
    return keys.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("key")), "; ").alias("bibliography"))


@query("SELECT p_partkey AS doc_id, 'a,c' || p_size || ',b' AS both_, 'note' AS kind, 'link,image' AS left_over FROM part")
def o9_o10_o11_f32_arrays(spark, sf):
    own = F.array(F.lit("a"), F.concat(F.lit("c"), "p_size"))
    split = lambda s: F.split(F.lit(s), ",")
    kinds = F.array(*map(F.lit, B.CALLOUTS))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        F.array_join(F.array_union(own, split("a,b")), ",").alias("both_"),
        F.get(F.array_intersect(F.array(F.lit("x"), F.lit("note")), kinds), F.lit(0)).alias("kind"),
        F.array_join(F.array_except(split("link,table,image"), split("table")), ",").alias("left_over"),
    )


@query("SELECT p_partkey AS doc_id, 'é' || p_name AS nfc, LENGTH(p_name) + 1 AS clusters, '/p(' || p_size || ')' AS destination, 'Doe et al., ' || (2000 + p_size) AS cited, 3::INTEGER AS depth FROM part")
def f5_f13_f20_f30_f31_scalars(spark, sf):
    entry = F.concat(F.lit('{"author":[{"family":"Doe"},{"family":"Roe"}],"issued":{"date-parts":[['), (F.col("p_size") + 2000).cast("string"), F.lit("]]}}"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        T.nfc(F.concat(F.lit("e\u0301"), "p_name")).alias("nfc"),
        T.graphemes(F.concat(F.lit("e\u0301"), "p_name")).cast("long").alias("clusters"),
        T.destination(F.concat(F.lit("</p\\("), "p_size", F.lit("\\)>"))).alias("destination"),
        T.csl_author_year(entry).alias("cited"),
        T.json_depth(F.concat(F.lit('{"a":[{"b":"['), "p_name", F.lit('"}]}'))).cast("int").alias("depth"),
    )


@query("SELECT p_partkey AS doc_id, '<div class=\"line-block\">' || p_name || '<br>' || CHR(10) || '&nbsp;&nbsp;' || p_type || '</div>' AS verse, '<kbd>' || p_name || '</kbd>' AS kbd, '<abbr title=\"' || p_type || '\">x</abbr>' AS abbr, '<ruby>' || p_name || '<rp>(</rp><rt>r</rt><rp>)</rp></ruby>' AS ruby, '<span class=\"ext-x\">' || p_name || '</span>' AS ext, p_name || ' ' || p_type AS soft FROM part")
def r8_r15_r17_r18_r22_x26_elements(spark, sf):
    two = F.concat("p_name", F.lit("\n"), "p_type")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        R.line_block_html(F.concat("p_name", F.lit("\n  "), "p_type")).alias("verse"),
        R.semantic_span_html(F.col("p_name"), F.lit("kbd")).alias("kbd"),
        R.semantic_span_html(F.lit("x"), F.concat(F.lit('abbr="'), "p_type", F.lit('"'))).alias("abbr"),
        R.ruby_html(F.col("p_name"), F.lit("r")).alias("ruby"),
        R.extension_html(F.lit("x"), F.col("p_name")).alias("ext"),
        R.soft_breaks(two, "space").alias("soft"),
    )


@query("SELECT p_partkey AS doc_id, '<h1>' || UPPER(p_name) || '</h1>' || CHR(10) || '<p>' || p_type || '</p><!-- end -->' AS text FROM part")
def u4_u7_render_hooks(spark, sf):
    rows = B.parse(markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\n', p_type)"))
    hook = lambda c: F.concat(F.lit("<h1>"), F.upper(F.regexp_replace(c, "^#+ +", "")), F.lit("</h1>"))
    return R.render(rows, "html", hooks={"heading": hook}, after=lambda c: F.concat(c, F.lit("<!-- end -->")))


@query("SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN '<a class=\"mention\" href=\"/u/' || s_suppkey || '\">@u' || s_suppkey || '</a>' ELSE '<span class=\"mention\"><strong>@u' || s_suppkey || '</strong></span>' END AS html FROM supplier")
def x24_u8_mention_resolver(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey doc_id", "concat('hi @u', s_suppkey) text")
    users = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").selectExpr("concat('u', s_suppkey) value", "concat('/u/', s_suppkey) url")
    return I.occurrences(rows, "mention").join(users, "value", "left").select("doc_id", R.mention_html(F.col("value"), F.col("url")).alias("html"))


@query("SELECT p_partkey AS doc_id, '1 ' || p_name AS numbered, '\\[' || p_type || '\\]' AS math FROM part")
def x16_x23_numbers_and_math(spark, sf):
    scanned = B.classify(B.scan(markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\n``` math\n', p_type, '\n```')")))
    heads = W.heading_numbers(B.headings(scanned)).select("doc_id", F.concat_ws(" ", "number", "title").alias("numbered"))
    math = B.code_blocks(B.blocks(scanned)).where("lang = 'math'").select("doc_id", T.math_markers("content", F.lit(True)).alias("math"))
    return heads.join(math, "doc_id")


@query("SELECT p_partkey AS doc_id, 'list_item' AS form FROM part")
def x25_u1_plus_bullets(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('+ ', p_name)")
    return B.classify(B.scan(docs), (("list_item", r"^ *\+ +\S"),)).select("doc_id", "form")


@query("SELECT p_partkey AS doc_id, '[t](/m/' || p_partkey || ')' AS resolved FROM part")
def m12_markdown_references(spark, sf):
    scanned = B.classify(B.scan(markup(spark, sf, "part", "p_partkey", "concat('[t][', p_name, ']\n\n[', p_name, ']: /m/', p_partkey)")))
    refs = I.references(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")))
    found = J.resolve_links(refs, B.definitions(scanned))
    return found.select("doc_id", F.concat(F.lit("["), "label_text", F.lit("]("), "href", F.lit(")")).alias("resolved"))


@query("""SELECT p_partkey AS doc_id, c::INTEGER AS col, CASE c WHEN 1 THEN p_name ELSE 'a \\| ' || p_size END AS text FROM part, (VALUES (1), (2)) x(c)""")
def m13_markdown_tables(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey doc_id", r"concat('| h | k |\n| --- | --- |\n| ', p_name, ' | a \\| ', p_size, ' |') source")
    docs = spread(rows, "doc_id").select("doc_id", M.markdown("source").alias("source"))
    return B.table_cells(B.parse(docs)).where("row = 2").select("doc_id", F.col("col").cast("int"), "text")


@query("SELECT p_partkey AS doc_id, n::INTEGER AS node_id, t AS kind FROM part, (VALUES (1, 'same'), (2, 'changed')) x(n, t)")
def a17_t3_structural_index(spark, sf):
    part = table(spark, sf, "part")
    old = part.selectExpr("p_partkey doc_id", "explode(map(1, p_name, 2, p_type)) as (node_id, text)").select("doc_id", "node_id", tree.fingerprint("text").alias("a"))
    new = part.selectExpr("p_partkey doc_id", "explode(map(1, p_name, 2, p_brand)) as (node_id, text)").select("doc_id", "node_id", tree.fingerprint("text").alias("b"))
    return old.join(new, ["doc_id", "node_id"]).select("doc_id", "node_id", F.when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("kind"))


@query("SELECT p_partkey AS doc_id, 1::BIGINT AS first_line, 3::BIGINT AS last_line FROM part")
def a18_w9_extents(spark, sf):
    rows = B.parse(markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\n', p_type)")).withColumn("depth", F.when(F.col("type") == "heading", 1).otherwise(2))
    return tree.extents(rows).select("doc_id", F.col("first_line").cast("long"), F.col("last_line").cast("long"))


@query("SELECT p_partkey AS doc_id, '2' AS path, 'replace' AS op, '****' AS before, '---' AS after FROM part")
def t10_t12_format_patch(spark, sf):
    """The formatter's output as line edits against the source."""
    docs = markup(spark, sf, "part", "p_partkey", "concat(p_name, '\n\n****')")
    number = lambda df, c: df.select("doc_id", F.posexplode(F.split(c, "\n")).alias("path", "value")).select("doc_id", F.col("path").cast("string").alias("path"), "value")
    done = docs.transform(B.parse).transform(lambda d: R.render(d, "canonical"))
    return tree.diff(number(docs, "source"), number(done, "text"))


@query("SELECT p_partkey AS doc_id, 'a' || p_partkey AS id FROM part")
def m19_preserved_ids(spark, sf):
    """Ids of imported headings kept as attributes."""
    rows = table(spark, sf, "part").selectExpr("p_partkey doc_id", """concat('<p>x</p><h2 class="" id="a', p_partkey, '">', p_name, '</h2>') html""")
    return B.attached_attributes(B.parse(spread(rows, "doc_id").select("doc_id", M.html("html").alias("source")))).select("doc_id", "id")


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN '{#b .a .c title=\"t\" lang=\"fr\"}' || CHR(10) || p_name WHEN 1 THEN '{#b' || p_partkey || '}' || CHR(10) || '# ' || p_name ELSE p_name END || CHR(10) || CHR(10) || 'f: $`x_' || p_size || '` g' || CHR(10) AS source FROM part")
def m4_m6_html_policy(spark, sf):
    """Attributes that an import keeps and those that it drops, and TeX from math."""
    first = """case p_partkey % 3 when 0 then concat('<p class="a c" id="b" onclick="c" data-x="d" style="e" title="t" lang="fr">', p_name, '</p>')
      when 1 then concat('<h1 id="b', p_partkey, '" onload=x>', p_name, '</h1>') else concat('<p onclick=x>', p_name) end"""
    math = """concat('<p>f: <math><semantics><mi>x</mi><annotation encoding="application/x-tex">x_', p_size, '</annotation></semantics></math> g')"""
    return spread(table(spark, sf, "part").selectExpr("p_partkey doc_id", f"concat({first}, {math}) html"), "doc_id").select("doc_id", M.html("html").alias("source"))


@query("SELECT user_id, COUNT(*)::BIGINT AS n FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 GROUP BY user_id")
def s5_variant_payloads(spark, sf):
    """JSON payloads read as variants."""
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return table(spark, sf, "events").where(k >= 50).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, COUNT(*)::BIGINT AS lines FROM (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS l FROM documents) WHERE REGEXP_MATCHES(l, '^[A-Z][a-z]') GROUP BY doc_id")
def z1_stateless_rendering(spark, sf):
    """The streaming renderer over a table: one row per line of prose."""
    from quillgrid.streaming.updates import line_html

    docs = table(spark, sf, "documents").selectExpr("doc_id", "text source")
    return line_html(docs).where(F.col("text").rlike("^<?[A-Z][a-z]")).where("text not like '<%'").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("SELECT n_nationkey::BIGINT AS doc_id, 'p' || n_nationkey % 5 AS path FROM nation WHERE n_nationkey % 5 < 2")
def z3_include_refresh(spark, sf):
    from quillgrid.streaming.updates import refresh_includes

    edges = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) doc_id", "concat('p', n_nationkey % 5) path")
    return refresh_includes(spark.createDataFrame([("p0",), ("p1",)], "path string"), edges)


@query("SELECT p_partkey AS doc_id, x AS kind FROM part, (VALUES ('mine')) v(x)")
def u2_u3_inline_matchers(spark, sf):
    """A user's own inline pattern with named groups."""
    rows = table(spark, sf, "part").selectExpr("p_partkey doc_id", "concat('a <<mine:', p_name, '>> b') text")
    return I.grouped(rows, r"<<(\w+):([^>]*)>>", {"kind": 1, "body": 2}).select("doc_id", "kind")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'widget' ELSE 'paragraph' END AS type FROM part")
def u11_application_types(spark, sf):
    """A registered type of the application's own is read like the built-in ones."""
    json = F.concat(F.lit('{"type":"document","children":[{"type":"'), F.when(F.col("p_size") % 2 == 0, "widget").otherwise("paragraph"), F.lit('","text":"x"}]}'))
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), json.alias("json"))
    return tree.from_ast_json(docs, ("paragraph", "widget")).select("doc_id", "type")


@query("SELECT p_partkey AS doc_id, '<!-- k -->' AS carrier, ' data-markup-role=\"r\"' AS attribute FROM part")
def r21_r24_carriers(spark, sf):
    """What a target cannot spell travels in a comment or a data attribute."""
    pairs = F.create_map(F.lit("data-markup-role"), F.lit("r"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<!-- "), F.lit("k"), F.lit(" -->")).alias("carrier"), T.render_attributes(pairs).alias("attribute"))


@query("SELECT p_partkey AS doc_id, 'diagram' AS kind FROM part WHERE p_size % 2 = 0")
def x12_fenced_render(spark, sf):
    rows = B.code_blocks(B.parse(markup(spark, sf, "part", "p_partkey", "concat('``` ', if(p_size % 2 = 0, 'mermaid', 'py'), '\n', p_name, '\n```')")))
    return rows.where(X.diagram_html(F.col("lang"), F.col("content")).isNotNull()).select("doc_id", F.lit("diagram").alias("kind"))
