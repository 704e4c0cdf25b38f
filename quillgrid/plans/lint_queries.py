"""Queries of the lint rules: each builds documents of which some break the rule, and finds those."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import slug
from quillgrid.operators import blocks as B
from quillgrid.operators import lint as L
from quillgrid.operators.windows import doc_order
from quillgrid.plans.base import markup, query, table

#: A line that breaks each line rule (with {} for a name) and one that doesn't.
CASES = {
    "bare-html-tag": ("a <b>{}</b>", "a < b {}"),
    "bidi-control-in-source": ("a‮{}", "a {}"),
    "blockquote-marker-without-space": (">{}", "> {}"),
    "block-opener-overindented": ("     > {}", "  > {}"),
    "braced-comment-in-a-template-source": ("{{% if {} %}}", "{{% note {} %}}"),
    "comment-shaped-emphasis": ("/*{}*/", "/{}/"),
    "consumed-key-near-miss": ("{{header_rows=1 a={}}}", "{{header-rows=1}} {}"),
    "deprecated-cell-alignment": ("| a |> {} |", "| a | {} |"),
    "djot-plus-bullet": ("+ {}", "- {}"),
    "djot-superscript-caret": ("x^2^ {}", "x{{^2^}} {}"),
    "emphasis-marker-before-attributes": ("a *{{.x}} {}", "a [b]{{.x}} {}"),
    "empty-include-path": ("{{{{ @lines:1 }}}} {}", "{{{{ a.mk }}}} {}"),
    "empty-link-destination": ("[{}]()", "[{}](/a)"),
    "empty-reference-definition": ("[{}]:", "[{}]: /a"),
    "fence-opener-fallback": ("``` a`{}", "``` {}\n```"),
    "fence-title-syntax": ("::: note '{}'\n:::", '::: note "{}"\n:::'),
    "figure-group-opener-metadata": ('::: figure "{}"\n:::', "::: figure\n{}\n:::"),
    "github-alert-marker": ("> [!NOTE] {}", "> [NOTE] {}"),
    "glob-shaped-strong": ("*.py* {}", "*py* {}"),
    "heading-closing-hashes": ("# {} #", "# {}"),
    "heading-trailing-attribute": ("# {} {{#a}}", "# {}"),
    "html-comment-renders-as-text": ("<!-- {} -->", "%% {}"),
    "include-lines-table-rows-hint": ("{{{{ {}.csv @lines:1-2 }}}}", "{{{{ {}.mk @lines:1-2 }}}}"),
    "indented-code-block": ("    foo(1) {}", "  {}"),
    "link-gap-before-destination": ("[{}] (/a)", "[{}](/a)"),
    "markdown-italic-underline": ("a _{}_ b", "a {} b"),
    "markdown-strikethrough-double-tilde": ("~~{}~~", "~{}~"),
    "markdown-strong-double-star": ("**{}**", "*{}*"),
    "markdown-strong-underscores": ("__{}__", "*{}*"),
    "platform-issue-reference": ("see #12 {}", "see {}"),
    "platform-mention-token": ("hi @joe {}", "a@joe {}"),
    "region-marker-renders-as-text": ("// #region {}", "region {}"),
    "semantic-attribute-outside-span": ("*a*{{kbd}} {}", "[a]{{kbd}} {}"),
    "semantic-attribute-value-ignored": ("[a]{{kbd=x}} {}", "[a]{{kbd}} {}"),
    "table-marker-run-padding": ("|={} |", "|= {} |"),
    "table-separator-near-miss": ("|===|===|", "| {} |"),
    "table-shaped-paragraph": ("| a | {}", "| a | {} |"),
    "thematic-break-spelling": ("****", "---"),
    "unclosed-inline-emphasis": ("a *{}", "a *{}*"),
}


#: Rules that a document made for another one breaks as well.
ALSO = {"emphasis-marker-before-attributes": "unclosed-inline-emphasis"}


@query(
    "WITH n AS (SELECT n_nationkey::BIGINT AS k FROM nation) SELECT wanted, rule, COUNT(*)::BIGINT AS n, SUM(k)::BIGINT AS ids FROM n, (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in [*zip(CASES, CASES, strict=True), *ALSO.items()])
    + ") x(wanted, rule) WHERE k % 2 = 0 GROUP BY wanted, rule"
)
def v_line_rules(spark, sf):
    """For each line rule, documents of even keys break it and those of odd keys none; all rules are tried on all documents."""
    parts = []
    for rule, (bad, good) in CASES.items():
        text = F.when(F.col("n_nationkey") % 2 == 0, F.lit(bad.format("zoe"))).otherwise(F.lit(good.format("zoe")))
        docs = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit(rule).alias("wanted"), text.alias("source"))
        parts.append(docs)
    docs = reduce(DataFrame.union, parts)
    keyed = docs.withColumn("doc", F.concat_ws(":", "wanted", "doc_id"))
    scanned = B.classify(B.scan(keyed.select(F.col("doc").alias("doc_id"), "source")))
    found = L.line_rules(scanned).select(F.substring_index("doc_id", ":", 1).alias("wanted"), F.substring_index("doc_id", ":", -1).cast("long").alias("id"), "rule").distinct()
    return found.groupBy("wanted", "rule").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT n_nationkey::BIGINT AS doc_id, l::BIGINT AS line, r AS rule FROM nation, (VALUES (0, 2, 'list-item-block-overindented'), (1, 3, 'description-separator-below-content-column')) x(k, l, r) WHERE n_nationkey % 3 = k")
def v18_v45_overindented_blocks(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "case n_nationkey % 3 when 0 then '- a\n      > b' when 1 then ':: t\n: d\n +' else '- a\n  b\n\n:: t\n: d\n\n  e' end")
    return found(docs, L.list_rules).union(found(docs, L.description_rules)).select("doc_id", F.col("line").cast("long"), "rule")


def found(docs, rules, *more):
    return rules(B.classify(B.scan(docs)), *more)


@query("SELECT n_nationkey::BIGINT AS doc_id, l::BIGINT AS line, r AS rule FROM nation, (VALUES (1, 'unclosed-container-fence'), (2, 'footnotes-placement-in-container'), (4, 'figure-group-nested')) x(l, r)")
def v29_v30_v35_v58_v76_containers(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat('::: note\n::: footnotes\n:::\n::: figure\n:::\n', n_name)")
    return found(docs, L.container_rules).select("doc_id", F.col("line").cast("long"), "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, CASE n_nationkey % 3 WHEN 0 THEN 'figure-group-empty' ELSE 'figure-group-single-panel' END AS rule FROM nation WHERE n_nationkey % 3 < 2")
def v29_v33_figure_groups(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat('::: figure\n', repeat('![a](b)\n\n', n_nationkey % 3), ':::\n![c](d)')")
    return found(docs, L.figure_groups).select("doc_id", "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, 5::BIGINT AS line, 'figure-group-panel-number' AS rule FROM nation WHERE n_nationkey % 2 = 0")
def v32_panel_numbers(spark, sf):
    caption = "if(n_nationkey % 2 = 0, 'Panel #: ', 'Panel ')"
    docs = markup(spark, sf, "nation", "n_nationkey", f"concat('::: figure\n![a](b)\n^ c\\\\#d\n![e](f)\n^ ', {caption}, n_name, '\n:::\n^ Figure #: g\n')")
    return found(docs, L.figure_groups).select("doc_id", F.col("line").cast("long"), "rule")


@query(
    """SELECT p_partkey AS doc_id, l::BIGINT AS line, r AS rule FROM part, (VALUES (6, 'broken-crossref', 0), (7, 'broken-fragment-link', 1)) x(l, r, k)
    WHERE p_size % 2 = k""",
)
def v6_v7_broken_targets(spark, sf):
    """Of a heading's id, the second id of its name, an explicit id and one that nothing has, only the last is broken."""
    good = "replace(p_name, ' ', '-')"
    lines = f"'# ', p_name, '\n\n# ', p_name, '\n\n{{#own}}\n', if(p_size % 2 = 0, '</#gone>', '</#own>'), ' `</#code>` </#', {good}, '-2>\n', if(p_size % 2 = 1, '[a](#gone)', '[a](#own)'), ' [b](#', {good}, ') [c](/x#y)'"
    return found(markup(spark, sf, "part", "p_partkey", f"concat({lines})"), L.target_rules).select("doc_id", F.col("line").cast("long"), "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'unclosed-code-fence' ELSE 'unclosed-comment-fence' END AS rule FROM nation")
def v74_v75_unclosed_fences(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat(if(n_nationkey % 2 = 0, '```', '%%%'), '\n', n_name, '\n')")
    return L.unclosed_fences(B.parse(docs)).select("doc_id", "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, l::BIGINT AS line, r AS rule FROM nation, (VALUES (2, 'list-marker-without-blank-line'), (5, 'setext-heading-underline'), (8, 'markdown-definition-paragraph'), (10, 'caption-looking-paragraph'), (13, 'quote-fence-ends-the-quote-above')) x(l, r)")
def v8_v48_v49_v57_v63_folded_markers(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat(n_name, '\n- a\n\nt\n====\n\nterm\n: x\n\nFigure 1: y\n\n> q\n::: >\n:::')")
    return found(docs, L.folded_markers).select("doc_id", F.col("line").cast("long"), "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, 2::BIGINT AS line, 'block-marker-as-text' AS rule FROM nation")
def v82_block_markers(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat(n_name, '\n#tight\nx')")
    return L.block_markers_as_text(B.parse(docs)).select("doc_id", F.col("line").cast("long"), "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, l::BIGINT AS line, r AS rule FROM nation, (VALUES (1, 'table-span-marker-blocked'), (2, 'table-row-cell-count')) x(l, r)")
def v67_v70_tables(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat('| ^ | b |\n| ', n_name, ' |')")
    return L.table_rules(B.parse(docs)).select("doc_id", F.col("line").cast("long"), "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, r AS rule FROM nation, (VALUES ('table-width-total'), ('table-column-arity'), ('table-column-overlap')) x(r)")
def v64_v65_v71_widths(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", """concat('{widths="60 70" widths="1"}\n| a | b | ', n_name, ' |')""")
    return L.width_rules(B.parse(docs)).select("doc_id", "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'delimited-table-malformed' ELSE 'delimited-table-wide-row' END AS rule FROM nation")
def v15_v16_delimited(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat('```csv table\na,b\n', if(n_nationkey % 2 = 0, 'x\"y,z', 'x,y,z'), '\n```')")
    return L.delimited_rules(B.parse(docs)).select("doc_id", "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, l::BIGINT AS line, r AS rule FROM nation, (VALUES (2, 'ordered-list-split-by-indent'), (2, 'list-marker-below-content-column'), (4, 'list-item-body-detached'), (6, 'refused-continuation-marker')) x(l, r)")
def v13_v46_v47_v54_v59_lists(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat('1. a\n 2. ', n_name, '\n\n b\n\n+\n')")
    return found(docs, L.list_rules).select("doc_id", F.col("line").cast("long"), "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, CASE n_nationkey % 4 WHEN 0 THEN 1 ELSE 3 END::BIGINT AS line, 'continuation-marker-refused' AS rule FROM nation WHERE n_nationkey % 4 < 2")
def v13_markers_behind_markers(spark, sf):
    """A mark behind an item's own marker that a blank line or the end follows; one with a block after it, or in code, is none."""
    docs = markup(spark, sf, "nation", "n_nationkey", "concat(case n_nationkey % 4 when 0 then '- +\n\n' when 1 then '> q\n\n> 1. +' when 2 then '- +\n' else '```\n- +\n\n```\n' end, if(n_nationkey % 4 = 1, '', n_name))")
    return found(docs, L.list_rules).where("rule = 'continuation-marker-refused'").select("doc_id", F.col("line").cast("long"), "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, 'unattached-block-attribute' AS rule FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'definition-term-block-folded' FROM nation")
def v14_v73_attributes_and_terms(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat('{.a}\n', if(n_nationkey % 2 = 0, '\n', ''), n_name, '\n\n:: t\n# h')")
    return L.unattached_attributes(B.parse(docs)).select("doc_id", "rule").union(found(docs, L.description_rules).select("doc_id", "rule"))


@query("SELECT n_nationkey::BIGINT AS doc_id, r AS rule FROM nation, (VALUES ('colon-fence-length-mismatch'), ('version-unsupported')) x(r) WHERE n_nationkey % 2 = 0")
def v9_v10_widths_and_versions(spark, sf):
    docs = markup(spark, sf, "nation", "n_nationkey", "concat('%% markup-version: ', if(n_nationkey % 2 = 0, '0.2', '0.1'), '\n\n:::: note\n', n_name, '\n', if(n_nationkey % 2 = 0, ':::', '::::'))")
    return found(docs, L.colon_widths).select("doc_id", "rule").union(L.version_rule(docs).select("doc_id", "rule"))


@query("SELECT p_partkey AS doc_id, 'duplicate-heading-id' AS rule, COUNT(*)::BIGINT AS n FROM part WHERE p_size % 2 = 0 GROUP BY p_partkey")
def v22_duplicate_ids(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, '\n\n# ', if(p_size % 2 = 0, p_name, p_type))")
    heads = B.headings(B.classify(B.scan(docs))).withColumn("id", slug("title"))
    return L.duplicate_heading_id(heads).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::BIGINT AS doc_id, 2::BIGINT AS n FROM nation")
def v34_label_spacing(spark, sf):
    rows = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) doc_id", "inline(array(struct(1, 'a b'), struct(2, 'a  b'), struct(3, 'c'))) as (line_no, raw)")
    return L.label_spacing(rows).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, r AS rule, COUNT(*)::BIGINT AS n FROM part, (VALUES ('unresolved-reference-link'), ('unused-footnote-definition'), ('heading-closing-hashes'), ('markdown-strong-double-star')) x(r) GROUP BY ALL")
def o8_a13_all_rules(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('# ', p_name, ' #\n\n**a** [x][y]\n\n[^n]: z')")
    return L.lint(docs).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, l::BIGINT AS line, r AS rule, o::INTEGER AS nth FROM part, (VALUES (1, 'markdown-strong-double-star', 1), (3, 'markdown-strikethrough-double-tilde', 2)) x(l, r, o)")
def o2_o6_diagnostics_order(spark, sf):
    docs = markup(spark, sf, "part", "p_partkey", "concat('**', p_name, '**\n\n~~', p_name, '~~ **b**')")
    rows = L.line_rules(B.classify(B.scan(docs)), ("markdown-strong-double-star", "markdown-strikethrough-double-tilde"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "rule").orderBy("line"))).where("k = 1").drop("k")
    return first.withColumn("nth", F.row_number().over(doc_order("line", "rule"))).select("doc_id", F.col("line").cast("long"), "rule", "nth")


@query("SELECT n_nationkey::BIGINT AS doc_id, 4::BIGINT AS line, 'duplicate-footnote-definition' AS rule FROM nation WHERE n_nationkey % 3 = 0")
def v21_duplicate_notes(spark, sf):
    """A second definition of a note's label is told where it stands."""
    docs = markup(spark, sf, "nation", "n_nationkey", "concat(n_name, '[^a] [^b]\n\n[^a]: one\n[^', if(n_nationkey % 3 = 0, 'a', 'b'), ']: two')")
    return L.lint(docs).where("rule = 'duplicate-footnote-definition'").select("doc_id", "line", "rule")


@query("SELECT n_nationkey::BIGINT AS doc_id, 2::BIGINT AS line, CASE n_nationkey % 2 WHEN 0 THEN 'references' ELSE 'footnotes' END || '-placement-in-container' AS rule FROM nation")
def v35_v58_placement(spark, sf):
    """Generated lists inside another container; at the top they are in place."""
    name = "if(n_nationkey % 2 = 0, 'references', 'footnotes')"
    docs = markup(spark, sf, "nation", "n_nationkey", f"concat('::: note\n::: ', {name}, '\n:::\n:::\n\n::: ', {name}, '\n:::\n\n', n_name)")
    return found(docs, L.container_rules).select("doc_id", F.col("line").cast("long"), "rule")
