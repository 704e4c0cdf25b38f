"""Lint rules as filters, windows and anti-joins over lines, blocks and references.

Every rule returns diagnostics (doc_id, line, rule). ``LINE_RULES`` are predicates on single lines outside
fences and are all tried in one pass over the lines; the others look at neighbours, counts or joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import slug
from quillgrid.operators import blocks as B
from quillgrid.operators import inlines as I
from quillgrid.operators import references as R
from quillgrid.operators.windows import unique_ids
from quillgrid.sources.shared import materialize

SUPPORTED = (0, 1)

#: Rule, and the pattern of the lines that it reports.
LINE_RULES = {
    "bare-html-tag": r"<(?:b|i|em|strong|div|span|p|br|img|a|table|h[1-6])(?:\s[^>]*)?/?>",
    "bidi-control-in-source": "[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]",
    "blockquote-marker-without-space": r"^>[^\s>]",
    "block-opener-overindented": r"^ {4,}(?:```|~~~|:::|> )",
    "braced-comment-in-a-template-source": r"\{%-?\s*(?:if|for|endif|endfor|block|include)\b",
    "comment-shaped-emphasis": r"(?<!\S)/\*[^*]+\*/(?!\S)",
    "consumed-key-near-miss": r"\{[^}]*\b(?:header_rows|headerrows|col-widths|colwidths|looose)\b[^}]*\}",
    "deprecated-cell-alignment": r"^\|.*\|[<>~](?= )",
    "djot-plus-bullet": r"^\s*\+ \S",
    "djot-superscript-caret": r"\w\^\w+\^",
    "emphasis-marker-before-attributes": r"(?<![\w*])[*/_~=]\{[.#]",
    "empty-include-path": r"\{\{ *(?:@[^}]*)?\}\}",
    "empty-link-destination": r"\]\(\s*\)",
    "empty-reference-definition": r"^\[[^\]^@]+\]:\s*$",
    "fence-opener-fallback": r"^`{3,}[^`]*`[^`]*$",
    "fence-title-syntax": r"^:{3,} *\w+ +(?:'[^']*'|\([^)]*\)|“[^”]*”)",
    "figure-group-opener-metadata": r"^:{3,} *figure +[\"\[]",
    "github-alert-marker": r"^> ?\[!(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]",
    "glob-shaped-strong": r"(?<!\S)\*\*?/[\w*]+|\*\.\w+\*",
    "heading-closing-hashes": r"^#{1,6} .*\S #+\s*$",
    "heading-trailing-attribute": r"^#{1,6} .*\{[#.][^}]*\}\s*$",
    "html-comment-renders-as-text": r"<!--",
    "include-lines-table-rows-hint": r"\{\{[^}]*\.(?:csv|tsv)\b[^}]*@lines:[^}]*\}\}",
    "indented-code-block": r"^(?: {4}|\t)\s*[A-Za-z_]\w*(?:\(|\s*=)",
    "link-gap-before-destination": r"\[[^\]]+\] \([^)\s]+\)",
    "markdown-italic-underline": r"(?<![\w_])_[^_\s][^_]*_(?![\w_])",
    "markdown-strikethrough-double-tilde": r"~~[^~\s][^~]*~~",
    "markdown-strong-double-star": r"\*\*[^*\s][^*]*\*\*",
    "markdown-strong-underscores": r"__[^_\s][^_]*__",
    "platform-issue-reference": r"(?<![\w&])#\d+\b",
    "platform-mention-token": r"(?<![\w@])@[A-Za-z][\w-]*(?![^{}]*\}\})",
    "region-marker-renders-as-text": r"^\s*(?://|#|--)\s*#?(?:end)?region\b",
    "semantic-attribute-outside-span": r"(?:[*/_~]\w+[*/_~]|`[^`]+`)\{(?:kbd|abbr|time|samp|var|cite|dfn)\b",
    "semantic-attribute-value-ignored": r"\]\{(?:kbd|samp|var|cite|dfn)=",
    "table-marker-run-padding": r"^\|=[^\s=|]",
    "table-separator-near-miss": r"^\|?(?:\s*:?-+:?\s*[+|])*\s*:?-+:?\s*\+|^\|(?:\s*:?=+:?\s*\|)+\s*$|^\|(?:\s*-\s*\|)+\s*$",
    "table-shaped-paragraph": r"^\|[^|]+\|[^|]*[^|\s]\s*$",
    "thematic-break-spelling": r"^(?:\*{3,}|_{3,}|-{4,}|- - -|\* \* \*)\s*$",
    "unclosed-inline-emphasis": r"(?<![\w*])\*(?![\s*])[^*]*$",
}


#: Rules on a line and the forms around it: rule, predicate, and the pattern of the line if any.
FOLDED_RULES = {
    "list-marker-without-blank-line": ("form = 'list_item' and before = 'text'", None),
    "setext-heading-underline": ("before = 'text'", r"^(?:={2,}|-{2,})\s*$"),
    "markdown-definition-paragraph": ("before = 'text'", r"^:\s{1,3}\S"),
    "caption-looking-paragraph": ("form = 'text' and before = 'blank'", r"^(?:Figure|Table|Listing) \d+[:.] "),
    "quote-fence-ends-the-quote-above": ("form = 'div_open' and before = 'quote'", r"^:{3,} *>"),
}
ITEM_RULES = {
    "refused-continuation-marker": ("form = 'continuation' and coalesce(next, 'blank') = 'blank'", None),
    "continuation-marker-refused": ("fence is null and coalesce(next, 'blank') = 'blank'", r"^(?:[ \t]*> ?)*[ \t]*(?:[-*]|\d{1,9}[.)]) +\+[ \t]*$"),
    "list-item-body-detached": ("form = 'text' and before = 'blank' and seen = 'list_item'", r"^ {1}\S"),
    "list-item-block-overindented": ("before = 'list_item'", r"^ {5,}(?:[-*>]|#{1,6}) "),
}
DESCRIPTION_RULES = {
    "definition-term-block-folded": ("form in ('heading', 'list_item', 'table_row') and before = 'term'", None),
    "description-separator-below-content-column": ("before = 'description'", r"^ \+$"),
}


def with_neighbours(classified: DataFrame) -> DataFrame:
    """Lines plus the form before, the form after and the last form before that is not blank: one sort a document."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    seen = F.last(F.when(F.col("form") != "blank", F.col("form")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return classified.withColumns({"before": F.lag("form").over(w), "next": F.lead("form").over(w), "seen": seen})


def holding(rules: dict[str, tuple[str, str | None]]) -> list[Column]:
    """Per rule its name where the row breaks it, else null."""
    test = lambda predicate, pattern: F.expr(predicate) & (F.col("line").rlike(pattern) if pattern else F.lit(True))
    return [F.when(test(*on), F.lit(rule)) for rule, on in rules.items()]


def flagged(rows: DataFrame, hits: list[Column], line: str = "line_no") -> DataFrame:
    """A diagnostic per row and hit that is not null."""
    return rows.select("doc_id", F.col(line).alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("rule"))


def line_hits(rules: tuple[str, ...] | None = None) -> list[Column]:
    prose = F.expr("fence is null and form not in ('blank', 'comment')")
    return [F.when(prose & F.col("line").rlike(LINE_RULES[r]), F.lit(r)) for r in rules or tuple(LINE_RULES)]


def line_rules(classified: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """All chosen line rules in one pass: an array of hits per line, exploded."""
    return flagged(classified.where("fence is null and form not in ('blank', 'comment')"), line_hits(rules))


def report(rows: DataFrame, rule: str, line: str = "line_no") -> DataFrame:
    return rows.select("doc_id", F.col(line).alias("line"), F.lit(rule).alias("rule"))


def heading_level_skip(classified: DataFrame) -> DataFrame:
    from quillgrid.operators.windows import level_skips

    return report(level_skips(B.headings(classified)), "heading-level-skip")


def duplicate_heading_id(heading_ids: DataFrame) -> DataFrame:
    """heading_ids (doc_id, id, line_no)."""
    return report(R.duplicates(heading_ids, "id"), "duplicate-heading-id")


def fence_hits() -> list[Column]:
    rule = F.when(F.col("type") == "comment_block", "unclosed-comment-fence").otherwise("unclosed-code-fence")
    return [F.when(F.expr("fence is not null and not fence.closed"), rule)]


def unclosed_fences(block_rows: DataFrame) -> DataFrame:
    return flagged(block_rows, fence_hits(), "start_line")


def container_rules(classified: DataFrame) -> DataFrame:
    """Containers that never close, generated content inside another container, and figure groups by their panels."""
    c = B.containers(classified)
    unclosed = report(c.where("end_line is null"), "unclosed-container-fence", "start_line")
    nested = c.where("depth > 1")
    placed = nested.where("name in ('footnotes', 'references')").select("doc_id", F.col("start_line").alias("line"), F.concat("name", F.lit("-placement-in-container")).alias("rule"))
    groups = report(nested.where("name = 'figure'"), "figure-group-nested", "start_line")
    return unclosed.union(placed).union(groups)


def figure_lines(classified: DataFrame) -> DataFrame:
    """Lines of figure groups, from the opener to its end, each with its owner: a running last opener per document."""
    c = B.containers(classified).where("name = 'figure'").select("doc_id", F.col("start_line").alias("line_no"), F.col("end_line").alias("last"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = classified.join(c, ["doc_id", "line_no"], "left")
    owner = F.last(F.when(F.col("last").isNotNull(), F.struct("line_no", "last")), ignorenulls=True).over(w)
    return rows.withColumn("owner", owner).where("owner is not null and line_no <= owner.last")


def figure_groups(classified: DataFrame) -> DataFrame:
    """Figure groups without a panel, or with one, and panel captions that hold a number slot."""
    rows = figure_lines(classified)
    panels = rows.groupBy("doc_id", F.col("owner.line_no").alias("line")).agg(F.sum(F.col("line").rlike(r"^!\[").cast("int")).alias("panels"))
    few = panels.where("panels < 2").select("doc_id", "line", F.when(F.col("panels") == 0, "figure-group-empty").otherwise("figure-group-single-panel").alias("rule"))
    numbered = rows.where(F.col("form") == "caption").where(B.number_slot("line") > 0)
    return few.union(report(numbered, "figure-group-panel-number"))


def rendered_ids(classified: DataFrame) -> DataFrame:
    """doc_id and id of every explicit id and of every heading; generated ids avoid the explicit ones."""
    lines = classified.where("fence is null")
    explicit = lines.select("doc_id", F.explode(F.regexp_extract_all(I.outside_code("line"), F.lit(r"\{(?:[^}#]*\s)?#([^\s}.#=]+)(?=[\s}])"), F.lit(1))).alias("id")).distinct()
    heads = unique_ids(B.headings(classified).withColumn("slug", slug("title")), reserved=explicit)
    return explicit.union(heads.select("doc_id", "id"))


def target_rules(classified: DataFrame) -> DataFrame:
    """Cross-references and fragment links of which the document renders no id."""
    ids = rendered_ids(classified)
    texts = classified.where("form in ('text', 'list_item', 'quote', 'heading', 'table_row', 'description')").select("doc_id", "line_no", F.col("line").alias("text"))
    refs = I.occurrences(texts, "crossref").withColumnRenamed("value", "id")
    lost = refs.join(ids.distinct(), ["doc_id", "id"], "left_anti")
    return report(lost, "broken-crossref").union(report(R.broken_fragments(I.links(texts), ids).where("href <> '#'"), "broken-fragment-link"))


def folded_markers(classified: DataFrame) -> DataFrame:
    """Text that looks like the start of a list, a setext underline or a Markdown definition inside a paragraph."""
    return flagged(with_neighbours(classified), holding(FOLDED_RULES))


def block_markers_as_text(block_rows: DataFrame) -> DataFrame:
    """Paragraphs of which a line begins like a block of another kind."""
    rows = block_rows.where("type = 'paragraph'").select("doc_id", "start_line", F.posexplode(F.split("text", "\n")))
    hit = F.col("col").rlike(r"^(?:#{1,6}\S|\d+\.\S|:{2}\S|\|[^|]*$)")
    return rows.where(hit).select("doc_id", (F.col("start_line") + F.col("pos")).alias("line"), F.lit("block-marker-as-text").alias("rule"))


def table_rules(block_rows: DataFrame) -> DataFrame:
    """Rows with another number of cells than the first, and span markers that nothing absorbs."""
    cells = B.table_cells(block_rows)
    rows = cells.groupBy("doc_id", "table_line", "row").agg(F.count("*").alias("n"))
    first = F.first("n").over(Window.partitionBy("doc_id", "table_line").orderBy("row"))
    arity = rows.withColumn("first", first).where("n <> first").select("doc_id", (F.col("table_line") + F.col("row") - 1).alias("line"), F.lit("table-row-cell-count").alias("rule"))
    blocked = cells.where("(span = '^' and row = 1) or (span = '<' and col = 1)")
    return arity.union(blocked.select("doc_id", (F.col("table_line") + F.col("row") - 1).alias("line"), F.lit("table-span-marker-blocked").alias("rule")))


def with_block_neighbours(block_rows: DataFrame) -> DataFrame:
    """Blocks plus the text of an attribute line right above and the line at which the next block starts."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    return block_rows.withColumns({"above": F.when(F.lag("type").over(w) == "attributes", F.lag("text").over(w)), "next_line": F.lead("start_line").over(w)})


def width_hits() -> list[Column]:
    widths = F.regexp_extract_all(F.regexp_extract("above", r'widths="([^"]*)"', 1), F.lit("[0-9.]+"), F.lit(0))
    total = F.aggregate(widths, F.lit(0.0), lambda a, x: a + x.try_cast("double"))
    columns = F.size(B.split_cells(F.substring_index("text", "\n", 1)))
    headed = F.expr("type = 'table_row' and above is not null")
    return [
        F.when(headed & (total > 100), "table-width-total"),
        F.when(headed & (F.size(widths) > 0) & (F.size(widths) < columns), "table-column-arity"),
        F.when(headed & (F.regexp_count("above", F.lit("widths=")) > 1), "table-column-overlap"),
    ]


def width_rules(block_rows: DataFrame) -> DataFrame:
    """Width attributes of a table: a total above 100 %, fewer values than columns, an axis set twice."""
    return flagged(with_block_neighbours(block_rows), width_hits(), "start_line")


def delimited_rules(block_rows: DataFrame) -> DataFrame:
    """Delimited tables that are refused, and records wider than the first."""
    from quillgrid.sources.text import delimited_records

    fences = block_rows.where(F.col("type") == "code").where(F.col("fence.info").rlike(r"^(csv|tsv)\b.*\btable\b"))
    cells = delimited_records(block_rows)
    bad = fences.where(F.length("text") > 0).join(cells.select("doc_id", "start_line").distinct(), ["doc_id", "start_line"], "left_anti")
    widths = cells.groupBy("doc_id", "start_line", "record").agg(F.max("field").alias("n"))
    first = F.first("n").over(Window.partitionBy("doc_id", "start_line").orderBy("record"))
    wide = widths.withColumn("first", first).where("n > first")
    return report(bad, "delimited-table-malformed", "start_line").union(wide.select("doc_id", (F.col("start_line") + F.col("record")).alias("line"), F.lit("delimited-table-wide-row").alias("rule")))


def item_sequences(classified: DataFrame) -> DataFrame:
    """One sequence in two lists and markers between columns."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = B.list_items(classified).withColumns({f"last_{c}": F.lag(c).over(w) for c in ("value", "indent", "style")})
    hits = [
        F.when(F.expr("style = 'decimal' and last_style = 'decimal' and value = last_value + 1 and indent <> last_indent"), "ordered-list-split-by-indent"),
        F.when(F.expr("indent > 0 and indent < last_indent + 2 and indent > last_indent"), "list-marker-below-content-column"),
    ]
    return flagged(rows, hits)


def list_rules(classified: DataFrame) -> DataFrame:
    """Item sequences, bodies set apart, blocks too far in, continuation marks that attach nothing (alone or behind a marker)."""
    return item_sequences(classified).union(flagged(with_neighbours(classified), holding(ITEM_RULES)))


def description_rules(classified: DataFrame) -> DataFrame:
    return flagged(with_neighbours(classified), holding(DESCRIPTION_RULES))


def attribute_hits() -> list[Column]:
    return [F.when(F.expr("type = 'attributes' and (next_line is null or next_line > end_line + 1)"), "unattached-block-attribute")]


def unattached_attributes(block_rows: DataFrame) -> DataFrame:
    """Attribute lines that no block follows directly."""
    return flagged(with_block_neighbours(block_rows), attribute_hits(), "start_line")


def colon_widths(classified: DataFrame) -> DataFrame:
    """Closing colon fences of another width than the opener they end."""
    c = B.containers(classified).where("end_line is not null").select("doc_id", F.col("start_line").alias("line_no"), "end_line")
    opener = classified.select("doc_id", "line_no", F.length(F.regexp_extract("line", "^(:+)", 1)).alias("width"))
    pairs = c.join(opener, ["doc_id", "line_no"]).select("doc_id", F.col("end_line").alias("line_no"), F.col("width").alias("open"))
    return report(pairs.join(opener, ["doc_id", "line_no"]).where("width <> open"), "colon-fence-length-mismatch")


def version_rule(docs: DataFrame) -> DataFrame:
    """Documents stamped with a newer version than is supported."""
    parts = F.split(F.regexp_extract("source", r"(?m)^%% markup-version: ([0-9.]+)", 1), r"\.")
    major, minor = (F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in (0, 1))
    newer = (major > SUPPORTED[0]) | ((major == SUPPORTED[0]) & (minor > SUPPORTED[1]))
    return docs.where(newer).select("doc_id", F.lit(1).alias("line"), F.lit("version-unsupported").alias("rule"))


def label_spacing(definitions: DataFrame, raw: str = "raw") -> DataFrame:
    """Footnote labels of a document that differ in white space alone: definitions (doc_id, line_no, raw)."""
    w = Window.partitionBy("doc_id", F.regexp_replace(raw, r"\s+", ""))
    return report(definitions.withColumn("n", F.size(F.collect_set(raw).over(w))).where("n > 1"), "footnote-labels-differ-only-in-whitespace")


def lint(docs: DataFrame) -> DataFrame:
    """All rules that need no options, by document, line and rule.

    Lines and blocks are written to the shared folder once, so that the passes read them and not the sources. Rules on
    a line and its neighbours share one pass over the lines, those on a block and its neighbours one over the blocks.
    """
    classified = materialize(B.classify(B.scan(docs)), "lines")
    rows = materialize(B.blocks(classified), "blocks")
    parts = [
        flagged(with_neighbours(classified), [*line_hits(), *holding({**FOLDED_RULES, **ITEM_RULES, **DESCRIPTION_RULES})]),
        flagged(with_block_neighbours(rows), [*fence_hits(), *width_hits(), *attribute_hits()], "start_line"),
        heading_level_skip(classified), container_rules(classified), figure_groups(classified), block_markers_as_text(rows), table_rules(rows),
        delimited_rules(rows), item_sequences(classified), colon_widths(classified), version_rule(docs), target_rules(classified),
    ]
    definitions = B.definitions(classified)
    texts = classified.where("form in ('text', 'list_item', 'quote', 'heading')").select("doc_id", "line_no", F.col("line").alias("text"))
    notes = I.occurrences(texts, "footnote_ref").withColumnRenamed("value", "label")
    links = I.references(texts)
    note_defs, link_defs = definitions.where("kind = 'footnote'"), definitions.where("kind = 'link_definition'")
    parts += [
        report(R.unresolved(notes, note_defs), "unresolved-footnote"),
        report(R.unused(note_defs, notes), "unused-footnote-definition"),
        report(R.duplicates(note_defs, "label"), "duplicate-footnote-definition"),
        report(R.unresolved(links, link_defs), "unresolved-reference-link"),
        report(R.unused(link_defs, links), "unused-link-reference-definition"),
    ]
    return reduce(DataFrame.union, [p.select("doc_id", F.col("line").cast("long").alias("line"), "rule") for p in parts])
