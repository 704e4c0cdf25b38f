"""Queries of joins, policies and tree operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions.text import slug
from quillgrid.operators import blocks as B
from quillgrid.operators import inlines as I
from quillgrid.operators import policy as P
from quillgrid.operators import references as R
from quillgrid.operators import tree as T
from quillgrid.plans.base import markup, query, table


def order_pages(spark, sf):
    """Reference links: orders divisible by 5 lack a definition, those by 7 have two of which the last counts, by 11 one that nobody uses."""
    source = (
        "concat(if(o_orderkey % 11 = 0, 'x', concat('[t', o_orderkey, '][', o_orderkey, ' a]')), '\n\n',"
        "if(o_orderkey % 7 = 0, concat('[', o_orderkey, '  a]: /first\n'), ''),"
        "if(o_orderkey % 5 = 0, '', concat('[', o_orderkey, ' a]: /o/', o_orderkey, ' \"', o_orderpriority, '\"')))"
    )
    scanned = B.classify(B.scan(markup(spark, sf, "orders", "o_orderkey", source)))
    refs = I.references(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")))
    return refs, B.definitions(scanned)


@query("""SELECT o_orderkey AS doc_id, o_orderkey || ' a' AS label, CASE WHEN o_orderkey % 5 <> 0 THEN '/o/' || o_orderkey WHEN o_orderkey % 7 = 0 THEN '/first' END AS href,
CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS title FROM orders WHERE o_orderkey % 11 <> 0""")
def j1_resolve_links(spark, sf):
    refs, defs = order_pages(spark, sf)
    return R.resolve_links(refs, defs).select("doc_id", "label", "href", "title")


@query("SELECT o_orderkey AS doc_id, o_orderkey || ' a' AS label FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0")
def j6_v79_unresolved_links(spark, sf):
    refs, defs = order_pages(spark, sf)
    return R.unresolved(refs, defs).select("doc_id", "label")


@query("SELECT o_orderkey AS doc_id, COUNT(*)::BIGINT AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 5 <> 0) GROUP BY 1")
def j7_v81_unused_definitions(spark, sf):
    refs, defs = order_pages(spark, sf)
    return R.unused(defs, refs).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, p_name AS label, CASE WHEN p_size % 2 = 0 THEN '#' || REPLACE(p_name, ' ', '-') ELSE '/p' END AS href FROM part")
def j2_heading_fallback(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\n[', p_name, '][]\n\n', if(p_size % 2 = 0, '', concat('[', p_name, ']: /p')))")
    scanned = B.classify(B.scan(docs))
    heads = B.headings(scanned).withColumn("id", slug("title"))
    refs = I.references(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")))
    return R.resolve_links(refs, B.definitions(scanned), heads).select("doc_id", "label", "href")


def note_pages(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('x[^a', p_size, '] y[^b]\n\n[^a', p_size, ']: ', p_name, '\n[^c]: ', p_type, '\n[^c]: again')")
    scanned = B.classify(B.scan(docs))
    refs = I.occurrences(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")), "footnote_ref").withColumnRenamed("value", "label")
    return refs, B.definitions(scanned)


@query("SELECT p_partkey AS doc_id, 'a' || p_size AS label, p_name AS value FROM part")
def j4_referenced_notes(spark, sf):
    refs, defs = note_pages(spark, sf)
    return R.referenced(defs, refs).select("doc_id", "label", "value")


@query("SELECT p_partkey AS doc_id, 'unused' AS finding, 'c' AS label, 2::BIGINT AS n FROM part UNION ALL SELECT p_partkey, 'unresolved', 'b', 1 FROM part UNION ALL SELECT p_partkey, 'duplicate', 'c', 1 FROM part")
def j5_v21_v78_v80_notes(spark, sf):
    refs, defs = note_pages(spark, sf)
    count = lambda df, finding: df.groupBy("doc_id", "label").agg(F.count("*").alias("n")).select("doc_id", F.lit(finding).alias("finding"), "label", "n")
    return count(R.unused(defs, refs), "unused").union(count(R.unresolved(refs, defs), "unresolved")).union(count(R.duplicates(defs, "label"), "duplicate"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN REPLACE(p_name, ' ', '-') ELSE 'gone' END AS target, CASE WHEN p_size % 2 = 0 THEN p_name END AS target_title FROM part")
def j3_cross_references(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\nsee </#', if(p_size % 2 = 0, replace(p_name, ' ', '-'), 'gone'), '>')")
    scanned = B.classify(B.scan(docs))
    heads = B.headings(scanned).withColumn("id", slug("title"))
    refs = I.occurrences(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")), "crossref").withColumnRenamed("value", "target")
    return R.cross_references(refs, heads).select("doc_id", "target", "target_title")


@query("SELECT p_partkey AS doc_id, '#gone' || p_size AS href FROM part")
def j8_v7_broken_fragments(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\n[a](#', replace(p_name, ' ', '-'), ') [b](#gone', p_size, ') [c](/x#y)')")
    scanned = B.classify(B.scan(docs))
    ids = B.headings(scanned).select("doc_id", slug("title").alias("id"))
    return R.broken_fragments(I.links(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text"))), ids).select("doc_id", "href")


@query("SELECT p_partkey AS doc_id, 'k' || p_size AS key, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'shared ' || p_size END AS entry FROM part")
def j14_citation_entries(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('x [@k', p_size, ']\n\n', if(p_partkey % 2 = 0, concat('[@k', p_size, ']: ', p_name), ''))")
    scanned = B.classify(B.scan(docs))
    cites = I.citations(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")))
    shared = table(spark, sf, "part").select(F.concat(F.lit("k"), "p_size").alias("key"), F.concat(F.lit("shared "), "p_size").alias("entry")).distinct()
    return R.citation_entries(cites, B.definitions(scanned).where("kind = 'citation'"), shared).select("doc_id", "key", "entry")


@query("SELECT p_partkey AS doc_id, UPPER(p_name) AS label, p_name AS repaired FROM part")
def t11_case_repairs(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('[x][', upper(p_name), ']\n\n[', p_name, ']: /p')")
    scanned = B.classify(B.scan(docs))
    refs = I.references(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")))
    return R.case_repairs(refs, B.definitions(scanned)).select("doc_id", "label", "repaired")


@query("SELECT l_orderkey AS doc_id, l_partkey::VARCHAR AS id, l_linenumber AS file_no, CASE WHEN ROW_NUMBER() OVER w > 1 THEN l_partkey || '-' || ROW_NUMBER() OVER w ELSE l_partkey::VARCHAR END AS renamed FROM (SELECT DISTINCT l_orderkey % 50 AS l_orderkey, l_partkey % 20 AS l_partkey, l_linenumber FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber)")
def j13_n11_n12_clashes(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey % 50 doc_id", "cast(l_partkey % 20 as string) id", "l_linenumber file_no").distinct()
    return R.rename_clashes(rows)


@query("SELECT n_nationkey::BIGINT AS doc_id, 'fn1' AS definition, 'ref1' AS reference FROM nation")
def j21_m7_paired_notes(spark, sf):
    rows = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) doc_id", "inline(array(struct('fn1', '#ref1'), struct('ref1', '#fn1'), struct('fn2', '#ref9'))) as (id, href)")
    return R.paired_notes(rows)


def trees(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey doc_id", "p_name", "p_type").selectExpr(
        "doc_id",
        "inline(transform(array(struct(1 n, 1 d, 'paragraph' t, 3 e), struct(2 n, 2 d, 'strong' t, 3 e), struct(3 n, 3 d, 'text' t, 3 e), struct(4 n, 1 d, 'table' t, 6 e), struct(5 n, 2 d, 'table_row' t, 6 e), struct(6 n, 3 d, 'text' t, 6 e)), "
        "x -> struct(x.n, x.d, x.t, x.e, if(x.n = 3, p_name, if(x.n = 6, p_type, ''))))) as (node_id, depth, type, subtree_end, text)",
    )


@query("SELECT p_partkey AS doc_id, n::INTEGER AS node_id, t AS type, r AS reason FROM part, (VALUES (3, 'text', 'nesting'), (4, 'table', 'type'), (5, 'table_row', 'type'), (6, 'text', 'nesting')) x(n, t, r)")
def p1_p2_p4_p9_violations(spark, sf):
    return P.violations(trees(spark, sf), "minimal")


@query("SELECT p_partkey AS doc_id, COUNT(*)::BIGINT AS kept, SUM(n)::BIGINT AS ids FROM part, (VALUES (1), (2), (3)) x(n) GROUP BY 1")
def p5_strip(spark, sf):
    nodes = trees(spark, sf)
    return P.strip_denied(nodes, P.violations(nodes, "comment").where("type = 'table'")).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("node_id").alias("ids"))


@query("SELECT p_partkey AS doc_id, 4::INTEGER AS node_id, 'text' AS type, p_type AS text FROM part")
def p6_to_text(spark, sf):
    nodes = trees(spark, sf)
    return P.denied_to_text(nodes, P.violations(nodes, "comment")).where("node_id >= 4").select("doc_id", "node_id", "type", "text")


@query("SELECT p_partkey AS doc_id, COUNT(*)::BIGINT AS left_over FROM part, RANGE(1) GROUP BY 1")
def p8_empty_containers(spark, sf):
    """A text beside a chain of 2 to 12 nested containers without content."""
    chain = "transform(sequence(2, int(3 + 2 * (p_partkey % 6))), i -> named_struct('a', i, 'b', if(i = 2, 0, i - 1), 'c', if(i % 2 = 0, 'list', 'list_item')))"
    rows = table(spark, sf, "part").selectExpr("p_partkey doc_id", f"inline(concat(array(named_struct('a', 1, 'b', 0, 'c', 'text')), {chain})) as (node_id, parent_id, type)")
    return P.drop_empty(rows, ("list", "list_item")).groupBy("doc_id").agg(F.count("*").alias("left_over"))


@query("SELECT doc_id FROM documents WHERE OCTET_LENGTH(ENCODE(text)) <= 10000")
def p3_max_length(spark, sf):
    return P.fits_length(table(spark, sf, "documents").selectExpr("doc_id", "text source"), "minimal").select("doc_id")


@query("SELECT p_partkey AS doc_id, v AS verdict, s AS safe FROM part, (VALUES (0, 'allowed', true), (1, 'scheme', false), (2, 'allowed', true), (3, 'host', true), (4, 'allowed', true), (5, 'external', true)) x(k, v, s) WHERE k = p_partkey % 6")
def p10_p13_p16_f19_urls(spark, sf):
    urls = "element_at(array('#x', ' JavaScript:alert(1)', 'mailto:a@b.example', 'https://u@sub.bad.example:8/x', '/rel?a:b', 'https://far.example'), int(p_partkey % 6 + 1))"
    rows = table(spark, sf, "part").selectExpr("p_partkey doc_id", f"{urls} url")
    return rows.select("doc_id", P.link_verdict("url", deny_hosts=("bad.example",), external=False).alias("verdict"), (P.safe_url("url").isNotNull() & P.floor_url("url").isNotNull()).alias("safe"))


@query("SELECT p_partkey AS doc_id, 'a nofollow ugc' AS rel, 'class' AS keys FROM part")
def p11_p14_attributes(spark, sf):
    attrs = F.create_map(F.lit("rel"), F.lit("a nofollow"), F.lit("onclick"), F.col("p_name"), F.lit("style"), F.lit("x"), F.lit("class"), F.lit("k"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), P.rel_attributes(P.safe_attributes(attrs, strict=True), ("nofollow", "ugc")).alias("a"))
    return rows.select("doc_id", F.element_at("a", "rel").alias("rel"), F.array_join(F.array_remove(F.map_keys("a"), "rel"), ",").alias("keys"))


@query("SELECT p_partkey AS doc_id, '' AS strip, '&lt;b&gt;' || p_name AS escape, '<b>' || p_name AS allow FROM part")
def p15_raw_html(spark, sf):
    raw = F.concat(F.lit("<b>"), "p_name")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), *[P.raw_html(raw, m).alias(m) for m in ("strip", "escape", "allow")])


@query("SELECT 'raw-format-dropped' AS code, COUNT(*)::BIGINT AS n FROM part WHERE p_size % 3 = 0")
def p18_a12_k1_raw_routing(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey doc_id", "1 node_id", "'raw_inline' type", "if(p_size % 3 = 0, 'latex', 'html') format")
    return P.route_raw(rows, "html")[1].groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, l::INTEGER AS line, r AS rule FROM part, (VALUES (1, 'a'), (3, 'b')) x(l, r)")
def p20_suppression(spark, sf):
    found = table(spark, sf, "part").selectExpr("p_partkey doc_id", "inline(array(struct(1, 'a'), struct(2, 'a'), struct(3, 'a'), struct(3, 'b'))) as (line, rule)")
    mute = table(spark, sf, "part").selectExpr("p_partkey doc_id", "inline(array(struct(2, 2, '*'), struct(3, 5, 'a'))) as (first, last, rule)")
    return P.suppressed(found, mute)


@query("""SELECT p_partkey AS doc_id, '/children/0' AS path, 'replace' AS op, p_name AS before, p_brand AS after FROM part
UNION ALL SELECT p_partkey, '/children/1', 'remove', p_type, NULL FROM part UNION ALL SELECT p_partkey, '/children/3', 'add', NULL, p_size::VARCHAR FROM part""")
def j18_t2_diff(spark, sf):
    before, after, _ = versions(spark, sf)
    return T.diff(before, after)


def versions(spark, sf):
    part = table(spark, sf, "part")
    make = lambda cells: part.selectExpr("p_partkey doc_id", f"explode(map({cells})) as (path, value)")
    base = make("'/children/0', p_name, '/children/1', p_type, '/children/2', 'same'")
    ours = make("'/children/0', p_brand, '/children/2', 'same', '/children/3', cast(p_size as string)")
    theirs = make("'/children/0', upper(p_name), '/children/1', p_type, '/children/2', 'theirs'")
    return base, ours, theirs


@query("""SELECT p_partkey AS doc_id, 'after' AS side, '/children/' || i AS path, CASE i WHEN 0 THEN p_brand WHEN 2 THEN 'same' ELSE p_size::VARCHAR END AS value FROM part, (VALUES (0), (2), (3)) x(i)
UNION ALL SELECT p_partkey, 'before', '/children/' || i, CASE i WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE 'same' END FROM part, (VALUES (0), (1), (2)) x(i)""")
def t2_patch_round_trip(spark, sf):
    before, after, _ = versions(spark, sf)
    patch = T.diff(before, after)
    there = T.apply_patch(before, patch)
    back = T.apply_patch(there, T.reverse_patch(patch))
    return there.select("doc_id", F.lit("after").alias("side"), "path", "value").union(back.select("doc_id", F.lit("before").alias("side"), "path", "value"))


@query("""SELECT p_partkey AS doc_id, '/children/' || i AS path, CASE i WHEN 1 THEN NULL WHEN 2 THEN 'theirs' WHEN 3 THEN p_size::VARCHAR END AS merged, CASE i WHEN 0 THEN 'edit' END AS conflict FROM part, (VALUES (0), (1), (2), (3)) x(i)""")
def j19_t1_merge(spark, sf):
    return T.merge(*versions(spark, sf)).select("doc_id", "path", "merged", "conflict")


@query("SELECT p_partkey AS doc_id, '/children/0' AS path, p_brand || '+' || UPPER(p_name) AS merged FROM part")
def u10_merge_resolver(spark, sf):
    merged = T.merge(*versions(spark, sf), resolve=lambda b, o, t: F.concat_ws("+", o, t))
    return merged.where("conflict is not null").select("doc_id", "path", "merged")


@query("SELECT p_partkey AS doc_id, '/' || i AS path, i = 0 AS kept FROM part, (VALUES (0), (1)) x(i)")
def j17_t8_identity(spark, sf):
    part = table(spark, sf, "part")
    old = part.selectExpr("p_partkey doc_id", "explode(map('/0', p_name, '/1', p_type)) as (path, v)").select("doc_id", "path", T.fingerprint("v").alias("hash"), F.concat(F.lit("id"), "path").alias("identity"))
    new = part.selectExpr("p_partkey doc_id", "explode(map('/0', p_name, '/1', p_brand)) as (path, v)").select("doc_id", "path", T.fingerprint("v").alias("hash"))
    return T.carry_identity(old, new).select("doc_id", "path", F.col("identity").startswith("id").alias("kept"))


@query("SELECT p_partkey AS doc_id, n::INTEGER AS node_id, CASE n WHEN 1 THEN p_name ELSE p_type END AS text FROM part, (VALUES (1), (4)) x(n)")
def a16_subtree_text(spark, sf):
    return T.subtree_text(trees(spark, sf))


@query("SELECT p_partkey AS doc_id, '{\"astVersion\":1,\"document\":{\"type\":\"document\",\"children\":[{\"type\":\"heading\",\"text\":\"' || p_name || '\",\"level\":2},{\"type\":\"paragraph\",\"text\":\"' || p_type || '\"}]}}' AS json FROM part")
def s6_s7_ast_json(spark, sf):
    return T.envelope(T.to_ast_json(flat_nodes(spark, sf)))


def flat_nodes(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('## ', p_name, '\n\n', p_type)")
    rows = B.parse(docs)
    level = F.when(F.col("type") == "heading", F.length(F.regexp_extract("text", "^(#+)", 1)))
    return rows.select("doc_id", "node_id", "type", F.regexp_replace("text", "^#+ +", "").alias("text"), level.cast("int").alias("level"))


@query("SELECT p_partkey AS doc_id, n::INTEGER AS node_id, CASE n WHEN 1 THEN 'heading' ELSE 'paragraph' END AS type, CASE n WHEN 1 THEN p_name ELSE p_type END AS text, CASE n WHEN 1 THEN 2 END::INTEGER AS level FROM part, (VALUES (1), (2)) x(n)")
def s5_s7_read_ast_json(spark, sf):
    return T.from_ast_json(T.open_envelope(T.envelope(T.to_ast_json(flat_nodes(spark, sf)))), ("heading", "paragraph"))


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'unknown type zzz' WHEN 1 THEN 'heading: missing level' END AS violation FROM part")
def s8_schema_violations(spark, sf):
    kind = F.when(F.col("p_partkey") % 3 == 0, "zzz").otherwise("heading")
    level = F.when(F.col("p_partkey") % 3 == 2, F.lit(1))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), T.schema_violation(kind, {"level": level}, {"heading": ("level",), "paragraph": ()}).alias("violation"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'X' || SUBSTR(p_name, 2) || '!' ELSE p_name END AS source FROM part")
def t4_source_patch(spark, sf):
    docs = table(spark, sf, "part").selectExpr("p_partkey doc_id", "p_name source")
    edits = table(spark, sf, "part").selectExpr("p_partkey doc_id", "length(p_name) n", "p_size").selectExpr(
        "doc_id", "inline(transform(array(0, 1), i -> struct(if(i = 1 and p_size % 2 = 0, n, 0) a, if(i = 0, 1, n) b, if(i = 0, 'X', if(p_size % 2 = 0, '!', 'overlaps')) t))) as (start, stop, text)"
    )
    return T.apply_edits(docs, edits)


@query("SELECT p_partkey AS doc_id, CASE WHEN s = 0 THEN '/a' ELSE '/b' END AS path, 'n' AS note, (CASE WHEN s = 0 THEN 2 ELSE 5 END)::INTEGER AS lo, (CASE WHEN s = 0 THEN 5 ELSE 8 END)::INTEGER AS hi FROM part, (VALUES (0), (1)) x(s)")
def t5_t6_annotations(spark, sf):
    ranges = table(spark, sf, "part").selectExpr("p_partkey doc_id", "2 lo", "8 hi", "'n' note")
    spans = table(spark, sf, "part").selectExpr("p_partkey doc_id", "inline(array(struct('/a', 0, 5), struct('/b', 5, 10), struct('/c', 10, 12))) as (path, start, stop)")
    return T.annotations_on_nodes(ranges, spans)
