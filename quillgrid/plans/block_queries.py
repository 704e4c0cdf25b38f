"""Queries of block and window operators over markup generated from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions.text import slug
from quillgrid.operators import blocks as B
from quillgrid.operators import windows as W
from quillgrid.plans.base import markup, query, table

BRAND_PAGE = "array_join(transform(array_sort(collect_list(struct(p_partkey, p_name, p_type, p_size))), x -> concat({line})), '{glue}')"


def brand_pages(spark, sf, line: str, glue: str = "\n\n"):
    """One document per part brand: a line of markup for each part in key order."""
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.expr(BRAND_PAGE.format(line=line, glue=glue)).alias("source"))
    return rows.select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("doc_id"), "source")


BRAND = "REGEXP_EXTRACT(p_brand, '([0-9]+)', 1)::BIGINT"
NTH = f"ROW_NUMBER() OVER (PARTITION BY {BRAND} ORDER BY p_partkey)"


@query(f"""WITH h AS (SELECT {BRAND} AS doc_id, p_partkey, p_name AS title, REPLACE(p_name, ' ', '-') AS slug, {NTH} AS nth FROM part),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, slug ORDER BY p_partkey) AS k FROM h)
SELECT doc_id, (2 * nth - 1)::BIGINT AS line_no, 2::INTEGER AS level, title, slug, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS id FROM n""")
def b3_f1_w3_heading_ids(spark, sf):
    pages = brand_pages(spark, sf, "'## ', x.p_name")
    found = B.headings(B.classify(B.scan(pages))).withColumn("slug", slug("title"))
    return W.unique_ids(found).select("doc_id", F.col("line_no").cast("long"), F.col("level").cast("int"), "title", "slug", "id")


@query(f"""WITH h AS (SELECT {BRAND} AS doc_id, p_partkey, REPLACE(p_name, ' ', '-') AS slug FROM part),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, slug ORDER BY p_partkey) AS k FROM h)
SELECT doc_id, p_partkey AS line_key, slug || '-' || CASE WHEN k = 1 THEN 3 ELSE k + 2 END AS id FROM n""")
def w3_reserved_ids(spark, sf):
    """Explicit ids hold each base and its -2, so that generated ids start at -3."""
    rows = table(spark, sf, "part").select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("doc_id"), F.col("p_partkey").alias("line_no"), slug("p_name").alias("slug"))
    bases = rows.select("doc_id", "slug").distinct()
    held = bases.select("doc_id", F.col("slug").alias("id")).union(bases.select("doc_id", F.concat("slug", F.lit("-2"))))
    return W.unique_ids(rows, reserved=held).select("doc_id", F.col("line_no").alias("line_key"), "id")


@query(f"""WITH h AS (SELECT {BRAND} AS doc_id, {NTH} AS i, p_size % 3 + 1 AS level FROM part)
SELECT doc_id, (2 * i - 1)::BIGINT AS line_no, level::INTEGER AS level,
  (2 * (SELECT MAX(b.i) FROM h b WHERE b.doc_id = h.doc_id AND b.i < h.i AND b.level < h.level) - 1)::BIGINT AS parent,
  (2 * (SELECT MIN(b.i) FROM h b WHERE b.doc_id = h.doc_id AND b.i > h.i AND b.level <= h.level) - 1)::BIGINT AS next FROM h""")
def w1_w2_sections(spark, sf):
    pages = brand_pages(spark, sf, "repeat('#', x.p_size % 3 + 1), ' ', x.p_name")
    rows = W.sections(B.headings(B.classify(B.scan(pages))))
    return rows.select("doc_id", F.col("line_no").cast("long"), F.col("level").cast("int"), F.col("parent").cast("long"), F.col("next").cast("long"))


@query(f"""WITH h AS (SELECT {BRAND} AS doc_id, {NTH} AS i FROM part),
n AS (SELECT doc_id, i, (i - 1) // 3 + 1 AS a, (i - 1) % 3 AS b FROM h)
SELECT doc_id, (2 * i - 1)::BIGINT AS line_no, CASE WHEN b = 0 THEN a::VARCHAR ELSE a || '.' || b END AS number FROM n""")
def a4_heading_numbers(spark, sf):
    """Every third heading is of level one, the others of level three: 1, 1.1, 1.2, 2, ..."""
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.expr("array_join(transform(sort_array(collect_list(p_partkey)), (x, i) -> concat(if(i % 3 = 0, '# ', '### '), x)), '\n\n')").alias("source"))
    pages = rows.select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("doc_id"), "source")
    return W.heading_numbers(B.headings(B.classify(B.scan(pages)))).select("doc_id", F.col("line_no").cast("long"), "number")


@query("SELECT doc_id, COUNT(*)::BIGINT AS paragraphs, SUM(LENGTH(l))::BIGINT AS chars FROM (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS l FROM documents) WHERE REGEXP_MATCHES(l, '^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ]') AND NOT CONTAINS(l, '[') GROUP BY doc_id")
def b1_b5_paragraphs(spark, sf):
    """Lines of prose set apart by blank lines are one paragraph each."""
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("source"))
    rows = B.parse(docs).where("type = 'paragraph'").where(F.col("text").rlike("^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ]") & ~F.col("text").contains("["))
    return rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, COUNT(*)::BIGINT AS lines, SUM(LENGTH(l))::BIGINT AS chars FROM (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS l FROM documents) WHERE TRIM(l) <> '' GROUP BY doc_id")
def b10_quotes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> "))).alias("source"))
    rows = B.quotes(B.classify(B.scan(docs))).where("trim(text) <> ''")
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


@query("SELECT p_partkey AS doc_id, d::INTEGER AS depth, p_name || d AS text FROM part, RANGE(1, 4) r(d)")
def b10_nested_quotes(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "array_join(transform(sequence(1, 3), d -> concat(repeat('> ', d), p_name, d)), '\n')")
    return B.quotes(B.classify(B.scan(docs))).select("doc_id", F.col("depth").cast("int"), "text")


@query("SELECT p_partkey AS doc_id, 'p_' || p_size AS lang, p_name AS header, p_brand AS label, (p_size % 3 + 3)::INTEGER AS fence_length, true AS closed, '# ' || p_name || CHR(10) || '```' || CHR(10) || '- ' || p_type AS content FROM part")
def b6_code_fences(spark, sf):
    """Markup in a fence stays content; a shorter run of the marker does not close it."""
    docs = markup(spark, sf, "part", "p_partkey", """concat('a\n\n', repeat('~', p_size % 3 + 3), ' p_', p_size, ' "', p_name, '" [', p_brand, ']\n# ', p_name, '\n```\n- ', p_type, '\n', repeat('~', p_size % 3 + 3), '\n# b')""")
    rows = B.code_blocks(B.parse(docs))
    return rows.select("doc_id", "lang", "header", "label", F.col("fence_length").cast("int"), "closed", "content")


@query("SELECT p_partkey AS doc_id, 'raw' AS type, 'html' AS lang, '<b>' || p_name || '</b>' AS content FROM part UNION ALL SELECT p_partkey, 'comment_block', NULL, p_type FROM part UNION ALL SELECT p_partkey, 'comment', NULL, '%% ' || p_brand FROM part")
def b7_b8_b9_raw_and_comments(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('```=html\n<b>', p_name, '</b>\n```\n%%%\n', p_type, '\n%%%\n%% ', p_brand)")
    rows = B.parse(docs).where("type in ('raw', 'comment_block', 'comment')")
    return rows.select("doc_id", "type", F.when(F.col("type") == "raw", F.regexp_replace("fence.info", "^=", "")).alias("lang"), F.col("text").alias("content"))


@query("SELECT n_nationkey AS doc_id, COUNT(*)::BIGINT AS rules FROM nation, RANGE(5) GROUP BY n_nationkey")
def b4_rules(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat('---\n\n***\n\n_____\n\n- - -\n\n* * * *\n\n--\n\n-*-\n\n', n_name)")
    return B.parse(docs).where("type = 'rule'").groupBy("doc_id").agg(F.count("*").alias("rules")).select(F.col("doc_id").cast("int"), "rules")


@query("SELECT doc_id, (COUNT(*))::BIGINT AS kept FROM (SELECT p_partkey AS doc_id, UNNEST([1, 2]) FROM part) GROUP BY doc_id")
def b38_comment_erasure(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat(p_name, '\n%% note\n', p_type)")
    return B.visible(B.classify(B.scan(docs))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(f"""SELECT {BRAND} AS doc_id, 0::INTEGER AS indent, 'decimal' AS style, {NTH}::INTEGER + 4 AS number, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE ' ' END AS task, p_name AS text FROM part""")
def b12_b13_b16_w5_lists(spark, sf):
    rows = table(spark, sf, "part").groupBy("p_brand").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(p_partkey, p_name, p_size))), (x, i) -> concat(i + 5, '. [', if(x.p_size % 2 = 0, 'x', ' '), '] ', x.p_name)), '\n')").alias("source")
    )
    pages = rows.select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("doc_id"), "source")
    items = W.sequence_numbers(B.list_items(B.classify(B.scan(pages))))
    return items.select("doc_id", F.col("indent").cast("int"), "style", F.col("number").cast("int"), "task", "text")


@query("""SELECT p_partkey AS doc_id, l::BIGINT AS list_no, s AS style, v::INTEGER AS value, p_name || t AS text FROM part,
(VALUES (1, '-', NULL, 'a'), (1, '-', NULL, 'b'), (2, '*', NULL, 'c'), (3, 'alpha', 1, 'd'), (3, 'alpha', 2, 'e'), (4, 'roman', 4, 'f'), (4, 'roman', 5, 'g')) x(l, s, v, t)""")
def b13_b15_list_styles(spark, sf):
    """A change of marker or style starts another list."""
    docs = markup(spark, sf, "part", "p_partkey", "concat('- ', p_name, 'a\n- ', p_name, 'b\n* ', p_name, 'c\na) ', p_name, 'd\nb) ', p_name, 'e\niv) ', p_name, 'f\nv) ', p_name, 'g')")
    return B.list_items(B.classify(B.scan(docs))).select("doc_id", "list_no", "style", "value", "text")


@query("SELECT p_partkey AS doc_id, 3::BIGINT AS n_items, p_size % 2 = 0 AS tight FROM part")
def b17_tightness(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('- ', p_name, '\n', if(p_size % 2 = 0, '', '\n'), '- ', p_brand, '\n- ', p_type)")
    return B.list_tightness(B.list_items(B.classify(B.scan(docs)))).select("doc_id", "n_items", "tight")


@query("SELECT p_partkey AS doc_id, l::BIGINT AS line_no, p::BIGINT AS parent_line FROM part, (VALUES (1, NULL), (2, 1), (3, 2), (4, 1), (5, NULL)) x(l, p)")
def b12_nested_lists(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('- ', p_name, '\n  - b\n    - c\n  - d\n- ', p_type)")
    rows = B.item_parents(B.list_items(B.classify(B.scan(docs))))
    return rows.select("doc_id", F.col("line_no").cast("long"), F.col("parent_line").cast("long"))


@query("""SELECT n_nationkey::BIGINT AS doc_id, r::INTEGER AS "row", c::INTEGER AS col, CASE WHEN r = 1 THEN 'h' || c WHEN c = 1 THEN n_name ELSE n_nationkey || ' | x' END AS text,
r = 1 AS header, CASE c WHEN 1 THEN NULL ELSE 'right' END AS align FROM nation, (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) x(r, c)""")
def b24_b25_b26_tables(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", r"concat('| h1 | h2 |\n|----|---:|\n| ', n_name, ' | ', n_nationkey, ' \\| x |')")
    cells = B.table_cells(B.parse(docs)).withColumn("text", F.replace("text", F.lit("\\|"), F.lit("|")))
    return cells.select("doc_id", F.col("row").cast("int"), F.col("col").cast("int"), "text", "header", "align")


@query("""SELECT n_nationkey::BIGINT AS doc_id, r::INTEGER AS "row", c::INTEGER AS col, CASE WHEN r = 1 THEN n_name ELSE t END AS text, rs::INTEGER AS rowspan, cs::INTEGER AS colspan
FROM nation, (VALUES (1, 1, '', 1, 2), (2, 1, 'a', 2, 1), (2, 2, 'b', 1, 1), (3, 2, 'c', 1, 1)) x(r, c, t, rs, cs)""")
def b28_b29_spans(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat('|= ', n_name, ' | < |\n| a | b |\n| ^ | c |')")
    rows = B.table_spans(B.table_cells(B.parse(docs)))
    return rows.select("doc_id", F.col("row").cast("int"), F.col("col").cast("int"), "text", "rowspan", "colspan")


@query("""SELECT p_partkey AS doc_id, k AS kind, CASE k WHEN 'footnote' THEN 'n' || p_size WHEN 'link_definition' THEN p_name || ' x' WHEN 'abbreviation' THEN 'AB' || p_size ELSE 'key' || p_size END AS label,
CASE k WHEN 'footnote' THEN p_type WHEN 'link_definition' THEN '/p/' || p_partkey WHEN 'abbreviation' THEN p_name ELSE p_brand END AS value, CASE k WHEN 'link_definition' THEN p_type END AS title
FROM part, (VALUES ('footnote'), ('link_definition'), ('abbreviation'), ('citation')) x(k)""")
def b31_b32_b33_b34_definitions(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", """concat('[^n', p_size, ']: ', p_type, '\n[', p_name, '  x]: /p/', p_partkey, ' "', p_type, '"\n*[AB', p_size, ']: ', p_name, '\n[@key', p_size, ']: ', p_brand)""")
    return B.definitions(B.classify(B.scan(docs))).drop("line_no")


@query("SELECT p_partkey AS doc_id, p_name AS term, d AS description FROM part, LATERAL (SELECT UNNEST([p_brand, p_type]) AS d)")
def b19_description_lists(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat(':: ', p_name, '\n: ', p_brand, '\n: ', p_type)")
    return B.description_lists(B.classify(B.scan(docs))).drop("line_no")


@query("""SELECT p_partkey AS doc_id, s::BIGINT AS start_line, e::BIGINT AS end_line, d::INTEGER AS depth, CASE d WHEN 1 THEN 'note' ELSE 'toc' END AS name,
CASE d WHEN 1 THEN p_name ELSE '' END AS title, CASE d WHEN 1 THEN 'admonition' ELSE 'directive' END AS kind FROM part, (VALUES (1, 6, 1), (3, 4, 2)) x(s, e, d)""")
def b20_containers(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", """concat('::: note "', p_name, '"\nx\n::: toc\n:::\ny\n:::')""")
    rows = B.containers(B.classify(B.scan(docs))).withColumn("kind", B.container_kind(F.col("name")))
    return rows.select("doc_id", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "depth", "name", "title", "kind")


@query("SELECT n_nationkey::BIGINT AS doc_id, k AS kind, COUNT(*)::BIGINT AS n FROM nation, (VALUES ('block_quote'), ('line_block'), ('hard_break_block'), ('figure_group'), ('div')) x(k) GROUP BY ALL")
def b11_b21_b22_b23_container_kinds(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", r"concat('::: >\n', n_name, '\n:::\n\n::: |\n  a\n:::\n\n::: \\\nb\nc\n:::\n\n::: figure\nd\n:::\n\n::: {.x}\ne\n:::')")
    rows = B.containers(B.classify(B.scan(docs))).withColumn("kind", B.container_kind(F.col("name")))
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"""SELECT {BRAND} AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'Figure' ELSE 'Table' END AS counter, 'table_row' AS target,
ROW_NUMBER() OVER (PARTITION BY {BRAND}, p_size % 2 ORDER BY p_partkey)::INTEGER AS n, (CASE WHEN p_size % 2 = 0 THEN 'Figure' ELSE 'Table' END) || ' #: ' || p_name AS text FROM part""")
def b35_a1_captions(spark, sf):
    pages = brand_pages(spark, sf, "'| ', x.p_size, ' |\n^ ', if(x.p_size % 2 = 0, 'Figure', 'Table'), ' #: ', x.p_name")
    return W.caption_counters(B.captions(B.parse(pages))).select("doc_id", "counter", "target", "n", "text")


@query("SELECT p_partkey AS doc_id, 'heading' AS type, 'i' || p_partkey AS id, 'a b' || p_size AS classes, p_name AS k FROM part")
def b36_block_attributes(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", """concat('{#i', p_partkey, ' .a .b', p_size, ' k="', p_name, '"}\n# ', p_name)""")
    rows = B.attached_attributes(B.parse(docs))
    return rows.select("doc_id", "type", "id", F.array_join("classes", " ").alias("classes"), F.element_at("pairs", "k").alias("k"))


@query("SELECT p_partkey AS doc_id, l::BIGINT AS line_no, b::BIGINT AS blanks FROM part, (VALUES (1, 0), (4, 2), (5, 0)) x(l, b)")
def w7_blank_runs(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat(p_name, '\n\n\n', p_brand, '\n', p_type)")
    return W.blank_runs(B.classify(B.scan(docs))).select("doc_id", F.col("line_no").cast("long"), F.col("blanks").cast("long"))


@query(f"""SELECT {BRAND} AS doc_id, SUM((level > above + 1)::INT)::BIGINT AS skips FROM (SELECT p_brand, p_size % 4 + 1 AS level, LAG(p_size % 4 + 1) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS above FROM part) GROUP BY ALL HAVING SUM((level > above + 1)::INT) > 0""")
def w6_v39_level_skips(spark, sf):
    pages = brand_pages(spark, sf, "repeat('#', x.p_size % 4 + 1), ' ', x.p_name")
    return W.level_skips(B.headings(B.classify(B.scan(pages)))).groupBy("doc_id").agg(F.count("*").alias("skips"))


@query(f"""SELECT {BRAND} AS doc_id, p_name AS label, number::BIGINT AS number, "repeat"::BIGINT AS "repeat" FROM (
SELECT p_brand, p_name, p_partkey, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY f) AS number, ROW_NUMBER() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS "repeat"
FROM (SELECT *, MIN(p_partkey) OVER (PARTITION BY p_brand, p_name) AS f FROM part))""")
def a3_a5_first_use_numbers(spark, sf):
    uses = table(spark, sf, "part").select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("doc_id"), F.col("p_name").alias("label"), F.col("p_partkey").alias("position"))
    return W.first_use_numbers(uses).select("doc_id", "label", F.col("number").cast("long"), F.col("repeat").cast("long"))


@query(f"""SELECT * FROM (SELECT {BRAND} AS doc_id, p_partkey, COUNT(*) OVER (PARTITION BY p_brand)::BIGINT AS total, COUNT(*) OVER (PARTITION BY p_brand) > 10 AS truncated FROM part QUALIFY {NTH} <= 10)""")
def o5_first_n(spark, sf):
    rows = table(spark, sf, "part").select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("doc_id"), "p_partkey")
    return W.first_n(rows, 10, "p_partkey").drop("nth")


@query(f"""SELECT doc_id, COUNT(*)::BIGINT AS n FROM (SELECT {BRAND} AS doc_id, SUM(LENGTH(p_name)) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS bytes FROM part) WHERE bytes <= 200 GROUP BY doc_id""")
def o7_budget(spark, sf):
    rows = table(spark, sf, "part").select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("doc_id"), "p_partkey", "p_name")
    return W.within_budget(rows, "p_name", F.lit(200), "p_partkey").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, n::BIGINT AS node_id, t AS type, p AS previous, f AS following FROM part, (VALUES (1, 'heading', NULL, 'paragraph'), (3, 'paragraph', 'heading', 'rule'), (5, 'rule', 'paragraph', NULL)) x(n, t, p, f)")
def w4_neighbours(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\n', p_brand, '\n\n---')")
    return W.neighbours(B.parse(docs)).select("doc_id", F.col("node_id").cast("long"), "type", "previous", "following")


@query(f"""SELECT {BRAND} AS doc_id, p_partkey, CASE WHEN i > 26 THEN CHR(96 + ((i - 1) // 26)::INTEGER) ELSE '' END || CHR(97 + ((i - 1) % 26)::INTEGER) AS letter FROM (SELECT p_brand, p_partkey, {NTH} AS i FROM part)""")
def a2_panel_letters(spark, sf):
    rows = table(spark, sf, "part").select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("doc_id"), F.lit(1).alias("group_id"), "p_partkey")
    return W.panel_letters(rows, "p_partkey").drop("group_id")
