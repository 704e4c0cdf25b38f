"""Edge cases of the markup operators, and properties that hold for any document."""

import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import blocks as B
from quillgrid.operators import inlines as I
from quillgrid.operators import lint, policy, references, render, tree
from quillgrid.operators import windows as W
from quillgrid.sources import importers, text

EDGES = ["", None, "\n", "﻿# a\r\nb\rc\x00", "```\nopen", ":::", "+", "|", "||", "> ", "-", "- ", "#", "# ", "%%%", "x" * 100_000, "[^", "*", "**", "`", "[]()", "{", "$", "\\", "::: a\n::: b\n:::", "1. a\n\n\n\n2. b"]


def docs(spark, sources):
    return spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string")


def test_edges_parse_render_and_lint(spark):
    d = docs(spark, EDGES).union(docs(spark, EDGES))
    rows = B.parse(d)
    assert rows.count() > 0
    for target in render.TARGETS:
        render.render(rows, target).collect()
    lint.lint(d).collect()
    render.sections_html(rows).collect()
    assert B.parse(docs(spark, []).limit(0)).count() == 0


def test_normalized_lines(spark):
    got = [r.line for r in B.lines(docs(spark, ["﻿a\r\nb\rc\x00"])).orderBy("line_no").collect()]
    assert got == ["a", "b", "c�"]


def test_fence_closes_only_on_its_marker(spark):
    rows = {r.type: r.text for r in B.parse(docs(spark, ["~~~~\n~~~\n```\n# x\n~~~~\n# y"])).collect()}
    assert rows["code"] == "~~~\n```\n# x" and rows["heading"] == "# y"


@pytest.mark.parametrize("bad", ["stale", "type", "loss", "version", "node"])
def test_what_must_fail_fails(spark, bad):
    one = docs(spark, ["# a"])
    make = {
        "stale": lambda: tree.apply_patch(spark.createDataFrame([(1, "/0", "now")], "doc_id long, path string, value string"), spark.createDataFrame([(1, "/0", "replace", "then", "x")], "doc_id long, path string, op string, before string, after string")),
        "type": lambda: policy.fail_on_violation(one.selectExpr("doc_id", "1 node_id", "'table' type", "1 depth"), "minimal"),
        "loss": lambda: render.refuse_losses(render.render(B.parse(docs(spark, ["```=html\nx\n```\n\ny"])), "markdown"), render.losses(B.parse(docs(spark, ["```=html\nx\n```"])), "markdown")),
        "version": lambda: tree.open_envelope(spark.createDataFrame([(1, '{"astVersion":9,"document":{}}')], "doc_id long, json string")),
        "node": lambda: tree.from_ast_json(spark.createDataFrame([(1, '{"type":"document","children":[{"type":"odd"}]}')], "doc_id long, json string"), ("paragraph",)),
    }
    with pytest.raises(Exception, match="stale patch|not allowed|render loss|newer version|unknown node type"):
        make[bad]().collect()


def test_read_and_write_files(spark, tmp_path):
    (tmp_path / "a.mk").write_bytes(b"# a\xff")
    got = text.read_markup(spark, str(tmp_path / "*.mk")).collect()
    assert [r.source for r in got] == ["# a�"]
    text.write_text(render.render(B.parse(text.read_markup(spark, str(tmp_path / "*.mk")))), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


plain = st.text(alphabet=string.ascii_letters + string.digits + " *_/~=`[](){}#<>|\\-+.:!\"'&é漢\n", max_size=60)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(plain, min_size=30, max_size=30))
def test_properties_of_any_text(spark, sources):
    d = docs(spark, sources)
    # Formatting twice is formatting once.
    once = render.render(B.parse(d), "canonical")
    twice = render.render(B.parse(once.withColumnRenamed("text", "source")), "canonical").withColumnRenamed("text", "again")
    kept = once.where(~F.col("text").contains("|")).join(twice, "doc_id")
    assert kept.where("text <> again").where(~F.col("text").rlike(r"(?m)^[`~%:]{3}|^\+|^ |^-|^>|^\*|^\d|^\w")).count() == 0
    # Escaped text has no markup, and escapes come off again.
    escaped = d.select("doc_id", "source", importers.escape_markup("source").alias("text"))
    assert I.occurrences(escaped.select("doc_id", "text"), "strong").count() == 0
    # HTML text holds no bare angle brackets.
    assert d.where(T.escape_html("source").rlike("[<>]")).count() == 0
    # Ids of one document are unique.
    heads = d.select(F.lit(1).alias("doc_id"), F.col("doc_id").alias("line_no"), T.slug(F.regexp_replace("source", "[0-9-]", "")).alias("slug"))
    ids = W.unique_ids(heads)
    assert ids.select("id").distinct().count() == ids.count()


def test_last_link_definition_and_first_heading_win(spark):
    scanned = B.classify(B.scan(docs(spark, ["[a]: /1\n[a]: /2\n\n[x][a]"])))
    refs = I.references(scanned.where("form = 'text'").select("doc_id", F.col("line").alias("text")))
    assert references.resolve_links(refs, B.definitions(scanned)).first().href == "/2"


def test_code_spans_hide_their_content(spark):
    rows = docs(spark, ["`*a*` *b* ``[x](y) ` z`` [p](q)"]).withColumnRenamed("source", "text")
    assert [r.value for r in I.occurrences(rows, "strong").collect()] == ["b"]
    assert [r.href for r in I.links(rows).collect()] == ["q"]


def test_merge_deletions(spark):
    side = lambda *rows: spark.createDataFrame([(1, p, v) for p, v in rows] or [(1, "none", "x")], "doc_id long, path string, value string").where("path <> 'none'")
    got = {r.path: (r.merged, r.conflict) for r in tree.merge(side(("a", "1"), ("b", "1"), ("c", "1")), side(("b", "2")), side(("a", "1"), ("b", "1"), ("c", "3"))).collect()}
    assert got == {"a": (None, None), "b": ("2", None), "c": (None, "delete")}
